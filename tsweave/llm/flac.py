"""FLAC streams of one channel, in numpy, many frames at a time.

Frames are independent, so those of many documents go through each step together: the encoder works on the concatenated
samples of all frames, and the decoder reads the next Rice code of every frame in one step. A stream carries a seek table
with a point for each frame; with it all frames of a stream decode at once, without it one after another.
Format: RFC 9639. encode() maps bytes one to one to signed 8-bit samples: bytes frequent in text lie near zero, as
loudness lies in sound, which is what Rice codes are short for; decode() gives samples, and BYTE maps them back.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 4096
RATE = 8000
#: Coefficients of the fixed predictors, by order (RFC 9639, table of fixed predictors).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


#: Bytes of text from the most to the less frequent, by common knowledge of letters; fixed values, the order matters.
FREQUENT = b" etaonirshdlucmfwgypbvkxjqz.,\n\xc3TAISEOHDLRNCM0123456789-'\"()BPFGWUVKYJQXZ:;/_\xa9\xb3\xa1\xad\xb1\xa4\xbc\xb6\xa8\xaa\xa7"


def _levels() -> np.ndarray:
    """The sample of each byte: 0, -1, 1, -2, 2 and so on for FREQUENT, then for the other bytes in order."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    out = np.zeros(256, np.int8)
    for rank, b in enumerate(order):
        out[b] = rank // 2 if rank % 2 == 0 else -(rank + 1) // 2
    return out


LEVEL = _levels()
BYTE = np.argsort(LEVEL.view(np.uint8)).astype(np.uint8)  # the byte of each sample, seen as unsigned


def _table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << width - 1, (1 << width) - 1, []
    for i in range(256):
        c = i << width - 8
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of bytes; all runs step together, the longest first."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    crc = np.zeros(len(order), np.uint16)
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    for i, k in enumerate(active.tolist()):
        c = crc[:k]
        crc[:k] = c << np.uint16(8) ^ CRC16[c >> np.uint16(8) ^ data[at[:k] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number as FLAC codes it, like UTF-8 carried on to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << 6 * more + 6 - more:
        more += 1
    head = (0xFF00 >> more + 1 & 0xFF) | n >> 6 * more
    return bytes([head, *(0x80 | n >> 6 * i & 0x3F for i in range(more - 1, -1, -1))])


def zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def encode_frames(samples: np.ndarray, length: np.ndarray, number: list[int], lpc: tuple[tuple[int, ...], int] | None = None) -> tuple[bytes, np.ndarray]:
    """(bytes of all frames, size of each). samples: of all frames in turn, 8 bits; number: each frame's in its stream.

    Each frame takes the fixed predictor of order 0 to 2 with the smallest residuals, or is stored as it is where that
    is shorter, or as one value where all are equal. lpc: coefficients and shift of a predictor to use throughout.
    """
    samples = samples.astype(np.int32)
    f, total = len(length), len(samples)
    end = np.cumsum(length)
    start = end - length
    inside = np.arange(total) - np.repeat(start, length)
    codes, sums = [], []
    predictors = [(lpc[0], lpc[1])] if lpc else [(c, 0) for c in FIXED[:3]]
    for coefficients, shift in predictors:
        guess = np.zeros(total, np.int32)
        for i, c in enumerate(coefficients, 1):
            guess[i:] += c * samples[:-i]
        z = zigzag(samples - (guess >> shift))
        z[inside < len(coefficients)] = 0
        codes.append(z)
        sums.append(np.add.reduceat(z, start))
    best = np.argmin(np.array(sums), axis=0)
    order = np.array([len(c) for c, _ in predictors])[best]
    z = codes[0] if lpc else np.choose(np.repeat(best, length), codes)
    count = np.maximum(length - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(np.array(sums)[best, np.arange(f)] / count, 1))), 0, 14).astype(np.int64)
    each = np.repeat(k, length)
    bits = (z >> each) + 1 + each
    bits[inside < np.repeat(order, length)] = 0
    rice = np.add.reduceat(bits, start)
    long_code = np.maximum.reduceat(z >> each, start) > 40
    low, high = np.minimum.reduceat(samples, start), np.maximum.reduceat(samples, start)
    extra = (4 + 5 + len(lpc[0]) * 15) if lpc else 0
    whole = 8 * order + extra + 10 + rice
    kind = np.where(low == high, 0, np.where((whole >= 8 * length) | long_code | (length <= order), 1, 2))
    body = np.where(kind == 0, 1, np.where(kind == 1, length, -(-whole // 8)))
    heads = []
    for i in range(f):
        head = b"\xff\xf8\x70\x02" + coded_number(number[i]) + struct.pack(">H", length[i] - 1)
        sub = 0 if kind[i] == 0 else 2 if kind[i] == 1 else (32 + order[i] - 1) << 1 if lpc else (8 + order[i]) << 1
        heads.append(head + bytes([crc8(head), sub]))
    head_n = np.fromiter(map(len, heads), np.int64, f)
    size = head_n + body + 2
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) * 8, np.uint8)
    # Rice codes, bit by bit
    coded = kind == 2
    first = (at + head_n) * 8 + 8 * order + extra + 10
    keep = np.repeat(coded, length) & (inside >= np.repeat(order, length))
    upto = np.cumsum(bits)
    place = (np.repeat(first - (upto[start] - bits[start]), length) + upto - each - 1)[keep]  # of the bit that ends the unary part
    out[place] = 1
    z, each = z[keep], each[keep]
    for value in np.unique(each).tolist():
        own = np.flatnonzero(each == value)
        p, v = place[own], z[own]
        for j in range(value):
            out[p + (1 + j)] = v >> value - 1 - j & 1
    for j in range(4):
        out[(first - 4 + j)[coded]] = (k >> 3 - j & 1)[coded]
    if lpc:  # precision 15 bits, shift, coefficients, after the first samples
        put = [(14, 4), (lpc[1], 5), *((c & 0x7FFF, 15) for c in lpc[0])]
        field = "".join(f"{v:0{n}b}" for v, n in put)
        for j, bit in enumerate(field):
            out[(first - 10 - extra + j)[coded]] = int(bit)
    packed = np.packbits(out)
    for i in range(f):
        a = at[i]
        n = head_n[i]
        packed[a : a + n] = np.frombuffer(heads[i], np.uint8)
        m = order[i] if kind[i] == 2 else 1 if kind[i] == 0 else length[i]
        if m:
            packed[a + n : a + n + m] = samples[start[i] : start[i] + m].astype(np.int8).view(np.uint8)
    crc = crc16_of(packed, at, size - 2)
    packed[at + size - 2], packed[at + size - 1] = crc >> 8, crc & 255
    return packed.tobytes(), size


def stream(samples: bytes, frames: list[bytes], lengths: list[int]) -> bytes:
    """A whole stream: marker, STREAMINFO, SEEKTABLE, frames. samples: as signed bytes, for the digest."""
    sizes = [len(x) for x in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    points, sample, at = [], 0, 0
    for n, size in zip(lengths, sizes, strict=True):
        points.append(struct.pack(">QQH", sample, at, n))
        sample, at = sample + n, at + size
    seek = b"".join(points)[: 18 * ((1 << 24) // 18 - 1)]
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode(payloads: list[bytes], at_once: int = 2_048, lpc=None) -> list[bytes]:
    """A stream for each payload of bytes, none of them empty."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    todo = [(i, a) for i, p in enumerate(payloads) for a in range(0, len(p), BLOCK)]
    signed = [LEVEL[np.frombuffer(p, np.uint8)] for p in payloads]
    for s in range(0, len(todo), at_once):
        some = todo[s : s + at_once]
        parts = [signed[i][a : a + BLOCK] for i, a in some]
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        raw, size = encode_frames(np.concatenate(parts), length, [a // BLOCK for _, a in some], lpc)
        at = 0
        for (i, _), n in zip(some, size.tolist(), strict=True):
            frames[i].append(raw[at : at + n])
            at += n
    return [stream(x.tobytes(), f, [min(BLOCK, len(x) - a) for a in range(0, len(x), BLOCK)]) for x, f in zip(signed, frames, strict=True)]


class Broken(ValueError):
    """A stream that isn't FLAC as this module reads it, or whose checksums don't hold."""


def header(data: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """(bits a sample, samples, MD5, seek points (sample, byte), where the frames start)."""
    if data[:4] != b"fLaC":
        raise Broken("no FLAC marker")
    at, info, points, last = 4, None, [], False
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            if x >> 41 & 7:
                raise Broken("more than one channel")
            info = ((x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points = [struct.unpack_from(">QQ", body, i) for i in range(0, n - 17, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + n
    if info is None:
        raise Broken("no STREAMINFO")
    return *info, points, at


class _Bits:
    """Reads bits at many places of a byte array."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 8]
        self.words = np.ascontiguousarray(self.words).view(">u8")[:, 0].astype(np.uint64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 57 bits and more, from the top."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits (up to 57, not under 0), unsigned."""
        n = np.asarray(n, np.uint64)
        return (self.peek(pos) >> np.uint64(1) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v = self.take(pos, n)
        return v - ((v >> np.asarray(n) - 1 & 1) << n)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        q, rest = np.zeros(len(pos), np.int64), None
        while True:
            at = pos if rest is None else pos[rest] + q[rest]
            top = (self.peek(at) >> np.uint64(11)).astype(np.float64)
            n = np.minimum(1075 - (top.view(np.int64) >> 52), 53)
            if rest is None:
                q = n
            else:
                q[rest] += n
            more = np.flatnonzero(n == 53)
            if not len(more):
                return q
            rest = more if rest is None else rest[more]


def decode_frames(data: np.ndarray, starts: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(samples of each frame, frame numbers, where each ends), with header and footer checksums verified."""
    raw, f = _Bits(data), len(starts)
    length, number, body = np.zeros(f, np.int64), np.zeros(f, np.int64), np.zeros(f, np.int64)
    for i, a in enumerate(starts.tolist()):
        h = data[a : a + 16].tobytes()
        if h[0] != 0xFF or h[1] & 0xFE != 0xF8:
            raise Broken("no frame where one should start")
        n, at = h[4], 5
        more = 0
        while n << more & 0x80:
            more += 1
        value = n & 0xFF >> more + 1 if more else n
        for _ in range(max(0, more - 1)):
            value, at = value << 6 | h[at] & 0x3F, at + 1
        code = h[2] >> 4
        if code == 6:
            length[i], at = h[at] + 1, at + 1
        elif code == 7:
            length[i], at = (h[at] << 8 | h[at + 1]) + 1, at + 2
        else:
            length[i] = 192 if code == 1 else 576 << code - 2 if code <= 5 else 256 << code - 8
        at += {12: 1, 13: 2, 14: 2}.get(h[2] & 15, 0)
        if crc8(h[:at]) != h[at]:
            raise Broken("a frame header's checksum doesn't hold")
        number[i], body[i] = value, a + at + 1
    pos = body * 8
    kind = raw.take(pos + 1, 6)
    wasted = raw.take(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        w = np.flatnonzero(wasted)
        more = raw.unary(pos[w]) + 1
        wasted[w] = more
        pos[w] += more
    depth = depth - wasted
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    rows = int(length.max(initial=0))
    out = np.zeros((rows, f), np.int64)  # a column for each frame
    own = np.flatnonzero(kind == 0)
    if len(own):
        out[:, own] = raw.signed(pos[own], depth[own])
        pos[own] += depth[own]
    own = np.flatnonzero(kind == 1)
    for i in range(int(length[own].max(initial=0))):
        on = own[length[own] > i]
        out[i, on] = raw.signed(pos[on], depth[on])
        pos[on] += depth[on]
    own = np.flatnonzero(kind >= 8)
    for i in range(int(order[own].max(initial=0))):
        on = own[order[own] > i]
        out[i, on] = raw.signed(pos[on], depth[on])
        pos[on] += depth[on]
    shift, taps = np.zeros(f, np.int64), np.zeros((32, f), np.int64)
    linear = own[kind[own] >= 32]
    if len(linear):
        precision = raw.take(pos[linear], 4) + 1
        shift[linear] = raw.signed(pos[linear] + 4, 5)
        pos[linear] += 9
        for i in range(int(order[linear].max())):
            has = order[linear] > i
            on = linear[has]
            taps[i, on] = raw.signed(pos[on], precision[has])
            pos[on] += precision[has]
    for o, c in enumerate(FIXED):
        for i, x in enumerate(c):
            taps[i, own[(kind[own] == 8 + o)]] = x
    if len(own):
        _residuals(raw, out, own, pos, length, order)
    for o in np.unique(order[own]).tolist():
        on = own[order[own] == o]
        if o and kind[on].max() < 32:  # fixed predictors: sums of sums
            _restore_fixed(out, on, o)
        elif o:
            for i in range(o, int(length[on].max())):
                guess = sum(taps[j, on] * out[i - 1 - j, on] for j in range(o))
                out[i, on] += guess >> shift[on]
    end = -(-pos // 8)
    stored = raw.take(end * 8, 16)
    if (crc16_of(data, starts, end - starts) != stored).any():
        raise Broken("a frame's checksum doesn't hold")
    return [out[: length[i], i] << wasted[i] for i in range(f)], number, end + 2


def _restore_fixed(out: np.ndarray, on: np.ndarray, order: int) -> None:
    """Undo the differences of a fixed predictor: its residuals are the order-th differences of the samples."""
    x = out[:, on]
    heads = [x[:order].copy()]
    for _ in range(order):
        heads.append(np.diff(heads[-1], axis=0))
    for level in range(order, 0, -1):
        # differences of order level - 1 from those of order level, the first of them known
        first = heads[level - 1][:1]
        x = np.concatenate([first, x[order - level + 1 + level - 1 :]]) if level == order else np.concatenate([first, x])
        x = np.cumsum(x, axis=0)
        x = x if level == 1 else x
    out[:, on] = x


def _residuals(raw: _Bits, out: np.ndarray, own: np.ndarray, pos: np.ndarray, length: np.ndarray, order: np.ndarray) -> None:
    """Read the Rice-coded residuals of the frames `own` into out, behind their first samples, and move pos past them."""
    wide = raw.take(pos[own], 2)
    if (wide > 1).any():
        raise Broken("a reserved coding of residuals")
    parts = 1 << raw.take(pos[own] + 2, 4)
    pos[own] += 6
    width = np.where(wide == 1, 5, 4)
    at = order[own].copy()
    for p in range(int(parts.max())):
        has = np.flatnonzero(parts > p)
        f = own[has]
        k = raw.take(pos[f], width[has])
        pos[f] += width[has]
        n = length[f] // parts[has] - (order[f] if p == 0 else 0)
        plain = k == (1 << width[has]) - 1
        for i in np.flatnonzero(plain).tolist():  # residuals as they are
            bits = int(raw.take(pos[f[i : i + 1]], 5)[0])
            where = pos[f[i]] + 5 + bits * np.arange(n[i])
            out[at[has[i]] : at[has[i]] + n[i], f[i]] = raw.signed(where, bits) if bits else 0
            pos[f[i]] += 5 + bits * n[i]
        rice = np.flatnonzero(~plain)
        rice = rice[np.argsort(-n[rice], kind="stable")]
        g, m, kk, here, row = f[rice], n[rice], k[rice], pos[f[rice]], at[has[rice]]
        low = kk.astype(np.uint64)
        active = np.searchsorted(-m, -np.arange(1, int(m.max(initial=0)) + 1), side="right")
        flat, stride = out.reshape(-1), out.shape[1]
        to = row * stride + g
        for c in active.tolist():
            q = raw.unary(here[:c])
            here[:c] += q + 1
            v = q << kk[:c] | (raw.peek(here[:c]) >> np.uint64(1) >> (np.uint64(63) - low[:c])).astype(np.int64)
            flat[to[:c]] = v >> 1 ^ -(v & 1)
            here[:c] += kk[:c]
            to[:c] += stride
        pos[g] = here
        at[has] += n


def decode(streams: list[bytes], at_once: int = 2_048) -> list[list[tuple[int, np.ndarray]]]:
    """The blocks (sample offset, samples) of each stream, every checksum verified, the MD5 of 8-bit samples included."""
    heads = [header(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams), np.uint8)
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    todo, unread = [], []
    for i, (_, samples, _, points, at) in enumerate(heads):
        if points and samples:
            todo += [(i, s, base[i] + at + b) for s, b in points]
        elif samples:
            unread.append((i, 0, base[i] + at))
    while todo or unread:
        some, todo = (todo[:at_once], todo[at_once:]) if todo else (unread, [])
        blocks, _, ends = decode_frames(data, np.array([a for *_, a in some]), np.array([heads[i][0] for i, *_ in some]))
        for (i, s, _), x in zip(some, blocks, strict=True):
            found[i].append((s, x))
        if some is unread:  # without seek points, the next frame is where this one ends
            unread = [(i, s + len(x), e) for (i, s, _), x, e in zip(some, blocks, ends.tolist(), strict=True) if s + len(x) < heads[i][1]]
    for (bits, samples, md5, _, _), blocks in zip(heads, found, strict=True):
        if sum(len(x) for _, x in blocks) != samples:
            raise Broken("samples are missing")
        if bits == 8 and any(md5) and hashlib.md5(b"".join(x.astype(np.int8).tobytes() for _, x in blocks)).digest() != md5:
            raise Broken("the samples' digest doesn't hold")
    return found
