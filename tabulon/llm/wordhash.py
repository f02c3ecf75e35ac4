"""Words of many texts as arrays of hashes, by NumPy on their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20  # bytes that are worked on at once; a longer word is not cut

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240601)
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S29, S32 = np.uint64(29), np.uint64(32)

#: Classes of bytes for the shape of a word: A upper case, a other letters, 0 digits, punctuation itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[128:] = ord("a")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (uint64)."""
    h = (h ^ (h >> S32)) * C1
    h = (h ^ (h >> S29)) * C2
    return h ^ (h >> S32)


_powers = np.cumprod(np.full(256, BASE))


def powers(n: int) -> np.ndarray:
    return _powers if n <= len(_powers) else np.cumprod(np.full(n, BASE))


class Words:
    """Words of a run of bytes: ``starts`` and ``lengths``, and the places of their bytes (``at``, and ``inside`` their word)."""

    def __init__(self, data: np.ndarray):
        self.data = data
        word = ~SPACE[data]
        edge = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
        self.starts, ends = edge[0::2], edge[1::2]
        self.lengths = ends - self.starts
        self.at = np.flatnonzero(word)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.inside = np.arange(len(self.at)) - np.repeat(self.first, self.lengths)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """One hash for each word, or for its first ``most`` bytes (0 where it's shorter)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        value = BYTE_CODES[self.data[self.at]] * powers(int(self.lengths.max()))[self.inside]
        if most is None:
            return mix(np.add.reduceat(value, self.first))
        value[self.inside >= most] = 0
        out = mix(np.add.reduceat(value, self.first) + np.uint64(most))
        out[self.lengths < most] = 0
        return out

    def shapes(self) -> np.ndarray:
        """One hash for each word's shape: classes of bytes, runs of one class taken once."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        kind = SHAPE[self.data[self.at]]
        keep = np.r_[True, kind[1:] != kind[:-1]] | (self.inside == 0)
        kept = np.cumsum(keep) - 1
        first = kept[self.first]
        place = np.arange(int(kept[-1]) + 1) - np.repeat(first, np.diff(np.r_[first, kept[-1] + 1]))
        value = BYTE_CODES[kind[keep]] * powers(int(place.max()) + 1)[place]
        return mix(np.add.reduceat(value, first) ^ C2)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``CHUNK`` bytes, cut before white space."""
    low = 0
    while low < len(text):
        high = min(len(text), low + CHUNK)
        while high < len(text) and not SPACE[text[high]]:
            high += 1
        yield text[low:high]
        low = high


def slices(texts: Sequence[bytes], overlap: int = 0) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of ``texts`` in slices of about ``CHUNK`` bytes, with the number of each word's text.

    A text longer than that comes in several slices, cut at white space; each after the first repeats the
    last ``overlap`` words of the one before.
    """
    block: list[bytes] = []
    of: list[int] = []
    size = 0

    def made(parts, numbers):
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        words = Words(data)
        begin = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        return words, np.asarray(numbers)[np.searchsorted(begin, words.starts, side="right") - 1]

    for number, text in enumerate(texts):
        low = 0
        while low < len(text):
            high = len(text)
            if high - low > CHUNK:
                high = low + CHUNK
                while high < len(text) and not SPACE[text[high]]:
                    high += 1
            part = text[low:high]
            if size + len(part) > CHUNK and block:
                yield made(block, of)
                block, of, size = [], [], 0
            block.append(part)
            of.append(number)
            size += len(part)
            low = high
            if overlap and high < len(text):
                head = part.rsplit(None, overlap)[0] if len(part.split(None, overlap)) > overlap else b""
                low = high - (len(part) - len(head)) if head else high
                yield made(block, of)  # repeated words are never in one slice with the words they repeat
                block, of, size = [], [], 0
    if block:
        yield made(block, of)


def concatenated(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def encoded(texts, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of texts (an Arrow array or a list); null: empty."""
    values = texts.to_pylist() if hasattr(texts, "to_pylist") else list(texts)
    return [b"" if not isinstance(t, str) else (t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in values]
