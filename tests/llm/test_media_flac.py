import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsweave.llm import flac, media


def samples(blocks):
    return b"".join(x.astype(np.int8).tobytes() for _, x in blocks)


def raw(payload):
    return flac.LEVEL[np.frombuffer(payload, np.uint8)].tobytes()


def without_seek_table(s):
    n = int.from_bytes(s[43:46], "big")
    return s[:4] + b"\x80" + s[5:42] + s[46 + n :]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=64, max_size=9000), min_size=1, max_size=5))
def test_round_trip(payloads):
    for lpc in (None, ((3000, -1500, 200), 11)):
        streams = flac.encode(payloads, at_once=3, lpc=lpc)
        assert [samples(b) for b in flac.decode(streams, at_once=2)] == [raw(p) for p in payloads]
    assert [samples(b) for b in flac.decode([without_seek_table(s) for s in streams])] == [raw(p) for p in payloads]


def test_text_gets_shorter_and_blocks_are_seekable():
    text = (b"The quick brown fox jumps over the lazy dog. " * 800)[:32_000]
    (s,) = flac.encode([text])
    assert len(s) < 0.75 * len(text)
    (blocks,) = flac.decode([s])
    assert [at for at, _ in blocks] == list(range(0, len(text), flac.BLOCK))


def test_damage_is_noticed():
    (s,) = flac.encode([bytes(range(256)) * 40])
    for at in (len(s) - 1, len(s) // 2, len(s) - 200, 30):
        bad = bytearray(s)
        bad[at] ^= 1
        with pytest.raises(flac.Broken):
            flac.decode([bytes(bad)])


def test_constant_verbatim_escape_and_partitions():
    streams = flac.encode([bytes(64), np.random.default_rng(1).integers(0, 256, 640, dtype=np.uint8).tobytes()])
    assert [len(b) for b in flac.decode(streams)] == [1, 1]
    # a hand-made frame: 16 samples, fixed order 0, two partitions, the second of plain 5-bit residuals
    bits = "0" + "001000" + "0" + "00" + "0001" + "0001" + "".join("1" + str(i % 2) for i in range(8)) + "1111" + "00101" + "".join(f"{v & 31:05b}" for v in range(-4, 4))
    head = b"\xff\xf8\x60\x02\x00\x0f"
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    frame = np.frombuffer(head + bytes([flac.crc8(head)]) + body, np.uint8)
    crc = int(flac.crc16_of(frame, np.array([0]), np.array([len(frame)]))[0])
    data = np.concatenate([frame, np.array([crc >> 8, crc & 255], np.uint8)])
    (x,), _, _ = flac.decode_frames(data, np.array([0]), np.array([8]))
    assert x.tolist() == [0, -1] * 4 + list(range(-4, 4))


def test_crc16_against_bit_by_bit():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 300, dtype=np.uint8)

    def plain(b):
        c = 0
        for x in b:
            c ^= int(x) << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        return c

    start, length = np.array([0, 10, 100]), np.array([10, 90, 1])
    assert flac.crc16_of(data, start, length).tolist() == [plain(data[a : a + n]) for a, n in zip(start, length, strict=True)]


def test_texts_as_media(spark):
    rows = [(1, "a" * 64, "x"), (2, None, "x"), (3, "", "x"), (4, "héllo " * 3000, "x"), (None, "héllo", "x"), (5, "héllo", "x"), (5, "héllo", "x")]
    stored = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    got = {}
    for r in media.media_features(stored).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got[5]) == 2 and got[5][0] == got[5][1] and got[5][0].media_sha256 == got[None][0].media_sha256
    blocks = media.pcm_blocks(stored, "doc_id").where("doc_id = 4").orderBy("sample_offset").collect()
    assert len(blocks) > 1 and flac.BYTE[np.frombuffer(b"".join(r.pcm for r in blocks), np.uint8)].tobytes().rstrip(b"\0").decode() == rows[3][1]
    assert media.media_features(media.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_features_are_those_of_the_whole_payload_and_blocks_can_be_sought(spark):
    import hashlib

    rng = np.random.default_rng(3)
    texts = ["", None, "short", "".join(map(chr, rng.integers(32, 500, 30_000))), "a" * 64, "short"]
    stored = media.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: r for r in media.media_features(stored).collect()}
    blocks = media.pcm_blocks(stored, "doc_id")
    for i, t in enumerate(texts):
        payload = media.padded(t or "")
        assert found[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and found[i].payload_bytes == len(payload)
        pcm = b"".join(r.pcm for r in blocks.where(f"doc_id = {i}").orderBy("sample_offset").collect())
        x = np.frombuffer(pcm, np.int8).astype(int)
        assert flac.BYTE[np.frombuffer(pcm, np.uint8)].tobytes() == payload
        want = f"square={int((x * x).sum()) // len(x)};crossings={int(np.count_nonzero(np.diff(np.signbit(x))))};low={x.min()};high={x.max()};"
        assert found[i].feature.startswith(want)
        for first, end in ((0, 1), (10, 64), (4_000, 9_000), (len(x) - 1, len(x) + 50), (len(x), len(x) + 9)):
            cut = media.between(blocks.where(f"doc_id = {i}"), first, end).orderBy("sample_offset").collect()
            assert b"".join(r.pcm for r in cut) == pcm[first:end] and all(r.n_samples == len(r.pcm) and r.sample_offset >= first for r in cut)
    assert found[2].feature == found[5].feature
