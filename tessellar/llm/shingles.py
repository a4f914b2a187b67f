"""Word shingles as 64-bit hashes, for use inside tasks.

Words are the runs between white space of the lower-cased text.  A shingle is
``size`` words in a row; a text with fewer words, but some, has one shingle of all of them.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers.
MAX_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORD = _Hashes()


def mixed(x):
    """A bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(32))


#: Words hashed together, characters from which a word counts by its digest, and the numbers of bytes and of places in a word.
_PIECE, _LONG = 1 << 12, 1 << 14
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(4 * _LONG, _STEP)), dtype=np.uint64)


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_hashes(own: list[str]):
    """The hashes of words, many at once: sums of their bytes' numbers times powers by the place in the word, mixed."""
    out = []
    for i in range(0, len(own), _PIECE):
        piece = own[i : i + _PIECE]
        text = " ".join(piece) + " "
        if len(text) > _LONG:
            text = " ".join(w if len(w) < _LONG else xxhash.xxh3_128_hexdigest(w) for w in piece) + " "
        data = np.frombuffer(text.encode(), np.uint8)
        # Every word ends with a blank, which counts as its end.
        ends = np.flatnonzero(data == 32) + 1
        starts = np.append(0, ends[:-1])
        place = np.arange(len(data)) - np.repeat(starts, ends - starts)
        out.append(np.add.reduceat(np.take(_BYTES, data) * np.take(_POWERS, place), starts))
    return mixed(np.concatenate(out)) if out else np.empty(0, np.uint64)


def shingles(own: list[str], size: int = 5, hashes=None):
    """The hash of the shingle at each word position that begins one; ``hashes`` are those of the words, unless remembered ones serve."""
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD.__getitem__, own), np.uint64, len(own)) if hashes is None else hashes
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = out * _STEP + h[k : k + n]
    return mixed(out)


def shingles_of(texts: list[list[str]], size: int = 5) -> list:
    """The shingles of each of many texts, by ``word_hashes``."""
    if not texts or min(map(len, texts)) < size:
        return [shingles(own, size, word_hashes(own)) for own in texts]
    flat = [w for own in texts for w in own]
    every = shingles(flat, size, word_hashes(flat))
    ends = np.cumsum([len(own) for own in texts])
    # Those that begin in a text's last words would reach into the next.
    return [every[end - len(own) : end - size + 1] for own, end in zip(texts, ends)]


def shingle_set(text: str | None, size: int = 5):
    return np.unique(shingles(words(text), size))


def jaccard(a, b) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)
