"""Token ids of whole texts by a public word-level BPE vocabulary, with a memory of the pre-tokens met before.

A pre-token's ids don't depend on its neighbours, so a text's ids are those of its pre-tokens in a row. Texts of Latin-1
characters are split many at a time in NumPy, and their pre-tokens of up to 16 bytes are looked up by these bytes. Texts with
characters outside the Latin blocks, letters whose lower case lies outside them, unusual control characters or names of
special tokens go through the library as they are.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

END_OF_TEXT = 1
#: Pre-tokens remembered by a process; beyond that it starts anew. About 130 MB.
REMEMBERED = 600_000
#: Characters of a text that are split at once.
SPAN = 1 << 20

_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: The byte-level alphabet: bytes that aren't printable have characters from 256 on, in order.
_PRINTABLE = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Letters up to U+024F whose lower case isn't one letter of the range.
_FAR = "".join(c for c in map(chr, range(0xA0, 0x250)) if c.isalpha() and not re.fullmatch(f"[{_LETTER}]", c.lower()))
_UNUSUAL = re.compile(f"[^\t\n\x0b\f\r\x20-\x7e\xa0-ɏ]|[ı{_FAR}]")

#: Texts are split together up to so many characters.
TOGETHER = 1 << 18
_LATIN = [bytes([c]).decode("latin-1") for c in range(256)]
_LOWER = "".join(_LATIN).lower().encode("latin-1")
_USUAL = bytes(c for c in range(256) if not _UNUSUAL.match(_LATIN[c]))
#: Of each lower-case character: 0 space, 1 letter, 2 number, which is a pre-token of its own, 3 other.
_KIND = np.array([0 if c.isspace() else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_NUMBER}]", c) else 3 for c in _LATIN], np.uint8)
#: Masks of the lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pre_tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of lower-case Latin-1 text, as _SPLIT finds them."""
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    edge = np.ones(len(b) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quote = np.flatnonzero((b[:-1] == 39) & edge[:-2] & (kind[1:] == 1)) if len(b) else ()
    for q in quote.tolist() if len(quote) else ():
        n = 2 if data[q + 1] in b"stmd" else 3 if data[q + 1 : q + 3] in (b"re", b"ve", b"ll") else 0
        if n:  # a contraction, whatever letters follow
            edge[q + 1] = False
            edge[q + n] = True
    at = np.flatnonzero(edge)
    word = kind[at[:-1]] != 0
    return at[:-1][word], at[1:][word]


class Remembered:
    """Ids of pre-tokens of up to 16 bytes, in a hash table whose keys are these bytes: nothing else can be taken for them. Of
    about 80 MB; it starts anew beyond WORDS pre-tokens or IDS ids, and has room for all pre-tokens that come at once."""

    BITS, WORDS, IDS = 21, 1_400_000, 1 << 23

    def __init__(self):
        n = 1 << self.BITS
        self.low, self.high, self.first, self.count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0

    def clear(self) -> None:
        self.low[:] = 0
        self.used = self.words = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, whether it is there); a pre-token has no zero bytes, so that low is 0 in free slots alone."""
        slot = self._slot(low, high)
        there = (self.low[slot] == low) & (self.high[slot] == high)
        open_ = np.flatnonzero(~there)
        while len(open_):
            open_ = open_[self.low[slot[open_]] != 0]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            hit = (self.low[slot[open_]] == low[open_]) & (self.high[slot[open_]] == high[open_])
            there[open_[hit]] = True
            open_ = open_[~hit]
        return slot, there

    def append(self, ids: list[np.ndarray]) -> np.ndarray:
        """Where each list of ids begins."""
        size = np.array([len(i) for i in ids], np.int64)
        end = self.used + np.cumsum(size)
        if end[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), int(end[-1]) - len(self.ids)), np.uint32)))
        self.ids[self.used : end[-1]] = np.concatenate(ids)
        self.used = int(end[-1])
        return end - size

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[np.ndarray]) -> None:
        """Keys that are not there, each once."""
        mask = (1 << self.BITS) - 1
        free = self.low
        for slot, a, b, first, own in zip(self._slot(low, high).tolist(), low.tolist(), high.tolist(), self.append(ids).tolist(), ids, strict=True):
            while free[slot]:
                slot = (slot + 1) & mask
            self.low[slot], self.high[slot], self.first[slot], self.count[slot] = a, b, first, len(own)
        self.words += len(ids)


class WordBpe:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) does."""

    _open: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names), re.IGNORECASE) if names else None
        self.known: dict[str, bytes] = {}
        self.remembered = Remembered()

    @classmethod
    def opened(cls, path: str) -> WordBpe:
        """One per process and file: workers keep what they remember from task to task."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Ids of pre-tokens by the model alone: bytes stand for themselves as printable characters, as it expects them."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        tokenize, known = self.model.tokenize, self.known
        for w in words:
            form = w if w.isascii() else w.encode().decode("latin-1").translate(_PRINTABLE)
            known[w] = array("I", [t.id for t in tokenize(form)]).tobytes()

    def _spans(self, text: str):
        start = 0
        while len(text) - start > SPAN:
            cut = next((i for i in range(start + SPAN, len(text)) if text[i] == " " or text[i] == "\n"), len(text))
            yield text[start:cut]
            start = cut
        yield text[start:]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, without an end token. Null is empty."""
        if not text:
            return b""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if _UNUSUAL.search(text) or self.special and self.special.search(text):
            return self._whole(text)
        out = []
        for span in self._spans(text):
            words = _SPLIT.findall(span.lower())
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                self._learn({w for w in words if w not in self.known})
                try:
                    out.append(b"".join(map(self.known.__getitem__, words)))
                except KeyError:  # just forgotten
                    self._learn(set(words))
                    out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)

    def _ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-case pre-tokens in Latin-1, by the model."""
        tokenize = self.model.tokenize
        text = [w.decode("latin-1") for w in words]
        forms = [w if w.isascii() else w.encode().decode("latin-1").translate(_PRINTABLE) for w in text]
        return [np.array([t.id for t in tokenize(f)], np.uint32) for f in forms]

    def _split_together(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends by text) of texts of usual Latin-1 characters, each with a space after it."""
        data = data.translate(_LOWER)
        start, end = pre_tokens(data)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        eight = np.ndarray(len(data) + 9, "<u8", buffer=data + bytes(16), strides=(1,))
        size, r = end - start, self.remembered
        low, high = eight[start] & _LOWEST[np.minimum(size, 8)], eight[start + np.minimum(size, 8)] & _LOWEST[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > 16)
        low[long], high[long] = 1, 0  # no pre-token: it would be of a control character
        if r.words + len(start) > r.WORDS or r.used > r.IDS:
            r.clear()
        slot, there = r.find(low, high)
        new = ~there
        new[long] = False
        if new.any():
            at = np.flatnonzero(new)
            at = at[np.lexsort((high[at], low[at]))]
            once = at[np.concatenate(([True], (low[at][1:] != low[at][:-1]) | (high[at][1:] != high[at][:-1])))]
            r.add(low[once], high[once], self._ids_of([data[a:b] for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)]))
            slot[at] = r.find(low[at], high[at])[0]
        first, count = r.first[slot], r.count[slot]
        if len(long):
            own = [np.frombuffer(self.ids(data[a:b].decode("latin-1")), np.uint32) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            used = r.used
            first[long], count[long] = r.append(own), [len(i) for i in own]
            r.used = used  # they are not remembered here
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        ids = r.ids[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, ends)]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as ids() has them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        rows: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush():
            ids, ends = self._split_together(b" ".join([*held, b""]), np.cumsum([len(d) + 1 for d in held]))
            for row, a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[row] = ids[a:b]
            rows.clear()
            held.clear()

        for row, text in enumerate(texts):
            try:
                data = (text or "").encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is None or data.translate(None, _USUAL) or len(data) > SPAN or self.special and b"<" in data and self.special.search(text):
                out[row] = np.frombuffer(self.ids(text), np.uint32)
                continue
            rows.append(row)
            held.append(data)
            size += len(data)
            if size >= TOGETHER:
                flush()
                size = 0
        if rows:
            flush()
        return out
