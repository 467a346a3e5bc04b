"""Token ids of whole texts by the tokenizers library, with ids of words kept between texts.

The vocabulary's pre-tokenizer never joins characters across a space, tab or line end, and its normalizer (composition,
lower case, white space to one space) acts on each side alone. So the ids of a text are those of its words, cut at
space, tab, line feed and carriage return, one after another. The library encodes each word that isn't kept yet;
tests/llm/test_tokens.py holds this against the library's ids of whole texts. It holds for a vocabulary whose
pre-tokenizer takes letters, single digits and runs of other characters apart, as word_bpe_49k.json does.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Letters below this are their own normal form, and Python and the library agree on their lower case (but for U+0130).
PLAIN_BELOW = "\u0250"
#: The characters that words are cut at. Other white space stays inside a word, for the library to deal with.
CUT = str.maketrans("\n\t\r", "   ")

TAILS = (".", ",")
#: UTF-8 of ASCII and of letters below U+0250; of these, the sequences that are no letter, or whose lower case is two characters.
PLAIN_BYTES = bytes([*range(128), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
ODD_BYTES = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
#: What a byte is: letter or digit, white space, full stop or comma, or else.
KIND = bytes(97 if c > 127 or chr(c).isalnum() else 32 if c in b"\t\n\v\f\r " else 46 if c in b".," else 33 for c in range(256))


class _Words(dict):
    """Ids by word. A word that is asked for and isn't there is noted in `new` and stands for its ids until they are known."""

    new: list[str]

    def __init__(self, *given):
        super().__init__(*given)
        self.new = []

    def __missing__(self, word: str) -> str:
        self.new.append(word)
        self[word] = word
        return word


def _plain(word: str) -> bool:
    return word.isascii() or max(word) < PLAIN_BELOW and "\u0130" not in word


class WordEncoder:
    """ids(text): the ids of a text as little-endian bytes, of `width` bytes each. At most `keep` words are kept."""

    def __init__(self, path: str, keep: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.width, self.keep = self.dtype.itemsize, keep
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        # Words of plain letters need no normalizer but lower case, and are one pre-token each.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words = _Words()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of several whole texts. Arrow splits them and numbers their distinct words; only these are looked up."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > self.keep:
            least = sorted(map(len, self.words))[self.keep // 2]  # short words come again soonest
            self.words = _Words((w, ids) for w, ids in self.words.items() if len(w) < least)
        cut = pc.split_pattern(pa.array([self._spaced(t) for t in texts], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        del cut, coded
        find = self.words.__getitem__
        found = list(map(find, distinct))
        self._learn()
        found = [x if type(x) is bytes else find(x) for x in found]
        length = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(self.width)
        start = np.cumsum(length, dtype=np.int64) - length
        ids, out, first = np.frombuffer(b"".join(found), self.dtype), [], 0
        while first < len(texts):  # some hundred thousand words at a time, and one text at least
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + 300_000)))
            w = at[done : ends[last - 1]]
            n = length[w]
            upto = np.cumsum(n, dtype=np.int64)
            near = start[w] - (upto - n)
            tokens = ids[np.repeat(near.astype(np.int32) if len(ids) < 1 << 31 else near, n) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
            bounds = np.concatenate(([0], upto))[np.concatenate(([0], ends[first:last] - done))] * self.width
            raw = tokens.tobytes()
            out += [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            first = last
        return out

    @staticmethod
    def _spaced(text: str) -> str:
        """The text with words apart by spaces; where that is safe, in lower case and with full stops and commas apart."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw.translate(None, PLAIN_BYTES) and not any(x in raw for x in ODD_BYTES):
            text = text.lower()  # as the normalizer does; beyond these letters the two may differ
            kind = raw.translate(KIND)
            if b"!." not in kind and b".!" not in kind and b".." not in kind:  # else they are part of longer pre-tokens
                text = text.replace(".", " . ").replace(",", " , ")
        return text.translate(CUT) if "\t" in text or "\r" in text else text.replace("\n", " ")

    def _learn(self) -> None:
        """Encode the new words. One of plain letters and a last full stop or comma is put together from the two."""
        words, cores, tailed, alone = self.words, [], [], [".", ","]
        for w in words.new:
            if w.isalpha():
                (cores if _plain(w) else alone).append(w)
            elif w[-1:] in TAILS and (core := w[:-1]).isalpha() and _plain(core):
                tailed.append(w)
                if core not in words:
                    words[core] = core
                    cores.append(core)
            else:
                alone.append(w)
        words.new = []
        for at in range(0, len(cores), 20_000):
            self._together(cores[at : at + 20_000])
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            words.update((w, self._bytes(e.ids)) for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True))
        words.update([(w, words[w[:-1]] + words[w[-1]]) for w in tailed])

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _together(self, cores: list[str]) -> None:
        """Encode words of plain letters, many in a call; the last token of each is one that ends a word."""
        lines = [" ".join(cores[at : at + 100]).lower() for at in range(0, len(cores), 100)]
        found = [e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), self.dtype, sum(map(len, found)))
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        raw = ids.tobytes()
        self.words.update(zip(cores, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))


def encoder(path: str, kept: dict = {}) -> WordEncoder:  # noqa: B006
    """One encoder for each worker process and vocabulary."""
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def encoded_batches(path: str, texts, size: int = 6_000_000):
    """(index, ids) of each text, in order, a few million characters at a time, so that memory holds for any batch."""
    enc, some, total = encoder(path), [], 0
    for i, t in enumerate(texts):
        some.append(t)
        total += len(t)
        if total >= size:
            yield from zip(range(i + 1 - len(some), i + 1), enc.batch(some), strict=True)
            some, total = [], 0
    if some:
        yield from zip(range(len(texts) - len(some), len(texts)), enc.batch(some), strict=True)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
