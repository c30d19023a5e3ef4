"""Whole texts to token ids with a public tokenizer, through a bounded cache of units that encode on their own.

Both tokenizers cut a text before they merge. Some of these cuts show from two bytes alone: before ASCII white space that
follows anything else, and between ASCII letters, digits and other signs, but for apostrophes before letters. What follows
such a cut is cut without a look back; so a text's ids are those of its units in turn. Units of many texts are found and
told apart in vectors, and only those not seen yet go to the tokenizer, many at once. Where white space counts, texts for
which this doesn't hold (white space beyond ASCII) go to it whole, as do all texts with a tokenizer that cuts otherwise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa

#: White space that only Unicode has, in UTF-8 as numbers: where it counts, its texts aren't cut.
ODD_SPACE = [int.from_bytes(chr(c).encode()) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
#: A unit that can be joined with others by a line feed.
PLAIN = re.compile(rb" ?[^\s]+")

#: Classes of bytes; OTHER are those beyond ASCII and control characters.
OTHER, WHITE, LETTER, DIGIT, SIGN, APOSTROPHE = range(6)
CLASS = np.array([WHITE if c in b" \t\n\r\x0b\x0c" else APOSTROPHE if c == 39 else OTHER if c < 33 or c > 126 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN for c in range(256)], dtype=np.uint8)
#: Bytes with which odd space begins.
LEAD = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
UPPER = np.array([chr(c).isupper() and c < 128 for c in range(256)])


def cut_between(digits: bool) -> np.ndarray:
    """Whether a cut lies between bytes of two classes, at 8 times the first and the second. digits: also between digits."""
    cut = np.zeros((8, 8), dtype=bool)
    cut[:, WHITE], cut[WHITE, WHITE] = True, False
    cut[LETTER, [DIGIT, SIGN, APOSTROPHE]] = cut[DIGIT, [LETTER, SIGN, APOSTROPHE]] = cut[SIGN, [LETTER, DIGIT]] = cut[APOSTROPHE, DIGIT] = True
    cut[DIGIT, DIGIT] = digits
    return cut.ravel()


#: How the tokenizers cut for which this holds.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PLAINER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN = [(None, _BYTES | {"use_regex": True}), (_PLAINER, {"type": "Sequence", "pretokenizers": [_WORDS, _BYTES | {"use_regex": False}]})]


def vocabulary_path(name_or_path: str) -> str:
    """A file of /opt/tokenizers by its name, or any path."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy of it in an array of at least n places, twice as long or more."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """batch(texts), column(texts): ids as numpy arrays of uint32. keeps_space: white space is part of the ids (byte-level BPE)."""

    #: Units after which the cache starts anew with the next texts, whose own units all fit: about 200 bytes each; and their bytes.
    MOST, MOST_BYTES = 600_000, 1 << 26
    AT_ONCE = 256
    #: Bytes of texts and units that are looked up together, about; a longer text is cut together.
    BYTES, UNITS = 1 << 21, 1 << 20

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Strings with an id of their own, also in a text; they are units.
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))) or b"(?!)")
        self.keeps_space = bool(self.whole(" "))
        #: Whether 16 bits hold every id.
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        parts = json.loads(self.tokenizer.to_str())
        self.known = (parts["normalizer"], parts["pre_tokenizer"]) in KNOWN
        self.mark = "\n" if self.keeps_space else "\x01"
        self.mark_id = self.whole(self.mark)[0] if self.known else None
        self.cut = cut_between(digits=not self.keeps_space)
        self.forget()

    def forget(self) -> None:
        """Start the cache anew: places of units seen, and at each place where its ids begin in pool and how many they are."""
        self.seen: dict[bytes, int] = {}
        self.seen_bytes = self.held = 0
        self.first, self.count, self.pool = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 12, dtype=np.uint16 if self.narrow else np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, units: list[bytes]) -> None:
        """Encode new units: many joined by a mark that none of them holds."""
        mark = self.mark.encode()
        if self.keeps_space:
            # A plain unit has no white space but a first space; so white space before it is the mark alone.
            fits = [PLAIN.fullmatch(u) is not None for u in units]
        else:
            fits = [mark not in u for u in units]
        if self.special.search(b" ".join(units)):
            fits = [f and not self.special.search(u) for f, u in zip(fits, units, strict=True)]
        plain, odd = list(compress(units, fits)), [u for u, f in zip(units, fits, strict=True) if not f]
        glue = mark if self.keeps_space else b" " + mark + b" "
        joined = [glue.join(plain[i : i + self.AT_ONCE]).decode("utf-8", "replace") for i in range(0, len(plain), self.AT_ONCE)]
        found, counts = [], []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype=self.pool.dtype)
            marks = ids == self.mark_id
            found.append(ids[~marks])
            counts.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
        for u in odd:
            found.append(np.array(self.whole(u.decode("utf-8", "replace")), dtype=self.pool.dtype))
            counts.append(np.array([len(found[-1])]))
        ids, count, n = np.concatenate(found), np.concatenate(counts), len(self.seen)
        if len(count) != len(units):
            raise ValueError("the tokenizer doesn't cut where the mark stands")
        self.first, self.count, self.pool = (grown(a, k) for a, k in ((self.first, n + len(count)), (self.count, n + len(count)), (self.pool, self.held + len(ids))))
        self.first[n : n + len(count)] = self.held + np.cumsum(count) - count
        self.count[n : n + len(count)] = count
        self.pool[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        self.seen.update(zip([*plain, *odd], range(n, n + len(count)), strict=True))
        self.seen_bytes += sum(map(len, units))

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that lie between offsets in raw, as they are looked up, and where units begin; the last number is the end."""
        kind = CLASS[raw]
        starts = np.zeros(len(raw) + 1, dtype=bool)
        starts[1:-1] = self.cut[kind[:-1] << 3 | kind[1:]]
        starts[offsets] = True
        own = raw.copy()
        if not self.keeps_space:
            # Case and kind of ASCII white space don't matter; a letter that a mark beyond ASCII may follow stays.
            own[kind == WHITE] = 32
            upper = UPPER[raw]
            upper[:-1] &= raw[1:] < 128
            own[upper] += 32
        at = 0
        while found := self.special.search(raw, at):
            a, b = found.span()
            at = a + 1
            if b <= offsets[np.searchsorted(offsets, a, "right")]:  # not of two texts
                starts[a + 1 : b], starts[a], starts[b], at = False, True, True, b
                own[a:b] = raw[a:b]
        return own, np.flatnonzero(starts)

    def places(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The places of units in the cache; new ones are learned."""
        units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(own)]).dictionary_encode()
        different = units.dictionary.to_pylist()
        if new := [u for u in different if u not in self.seen]:
            self.learn(new)
        return np.fromiter(map(self.seen.__getitem__, different), dtype=np.int64, count=len(different))[units.indices.to_numpy()]

    def together(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one text after the other, and how many each has."""
        if len(self.seen) > self.MOST or self.seen_bytes > self.MOST_BYTES:
            self.forget()
        own, starts = self.units(raw, offsets)
        ids, ends = [], [np.zeros(1, dtype=np.int64)]
        for i in range(0, len(starts) - 1, self.UNITS):
            at = self.places(own, starts[i : i + self.UNITS + 1])
            count = self.count[at]
            end = np.cumsum(count)
            ids.append(self.pool[np.repeat(self.first[at] - end + count, count) + np.arange(end[-1])].astype(np.uint32))
            ends.append(ends[-1][-1] + end)
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), np.diff(np.concatenate(ends)[np.searchsorted(starts, offsets)])

    def odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The numbers of the texts with white space beyond ASCII."""
        at = np.flatnonzero(LEAD[raw])
        three = np.concatenate([raw, np.zeros(2, dtype=np.uint8)])
        code = three[at].astype(np.int64)
        width = np.where(code < 128, 1, np.where(code < 0xE0, 2, 3))
        for k in (1, 2):
            code = np.where(width > k, code << 8 | three[at + k], code)
        return np.unique(np.searchsorted(offsets, at[np.isin(code, ODD_SPACE)], "right") - 1)

    def some(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts between offsets in raw, one after the other, and how many each text has; some texts at a time."""
        firsts = np.flatnonzero(np.diff(offsets[:-1] // self.BYTES, prepend=-1)).tolist()
        for i, j in zip(firsts, [*firsts, len(offsets) - 1][1:], strict=True):
            base = offsets[i]
            part, at = raw[base : offsets[j]], offsets[i : j + 1] - base
            whole = list(range(j - i)) if not self.known else self.odd(part, at).tolist() if self.keeps_space else []
            if not whole:
                yield self.together(part, at)
                continue
            for a, b in zip([-1, *whole], [*whole, j - i], strict=True):
                if a >= 0:
                    ids = np.array(self.whole(part[at[a] : at[a + 1]].tobytes().decode("utf-8", "replace")), dtype=np.uint32)
                    yield ids, np.array([len(ids)])
                if a + 1 < b:
                    yield self.together(part[at[a + 1] : at[b]], at[a + 1 : b + 1] - at[a + 1])

    def column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """some() of a column of strings; null is the empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, raw = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        return self.some(np.frombuffer(raw or b"", dtype=np.uint8), offsets)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is the empty text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        return [x for ids, counts in self.some(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets) for x in np.split(ids, np.cumsum(counts)[:-1])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each worker, which Spark uses again for later tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]
