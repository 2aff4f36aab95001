"""Words of many texts at once, as 64-bit hashes, with numpy.

Texts are laid end to end as UTF-8 and cut where the byte class changes. All
separators are ASCII, so cutting bytes and cutting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; one longer text is worked on alone.
CHUNK = 1 << 20
_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: every input bit changes half of the output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25


def _table(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Anything but the six ASCII blanks; and digits, letters and all beyond ASCII.
NON_BLANK = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 256), _BASE, dtype=np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each (one more at the end); null is empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of whole texts of about ``size`` bytes."""
    body, offsets = raw(texts)
    first, n = 0, len(texts)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, body[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the number of words before each text, and which bytes are in words."""
    mask = kind[body]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(body))]  # a word never runs on into the next text
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left"), mask


def hashed_words(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each word, the number of words before each text, word starts and ends."""
    body = LOWER[body] if lower else body
    starts, ends, before, mask = word_bounds(body, offsets, kind)
    if not len(starts):
        return np.zeros(0, np.uint64), before, starts, ends
    size = ends - starts
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    h = np.add.reduceat(_BYTE[body[mask]] * powers(int(size.max()))[place], at)
    return mixed(h + size.astype(np.uint64)), before, starts, ends


class Lookup:
    """Places of 64-bit hashes in a sorted table, by their first bits instead of a binary search."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.n, self.shift = len(keys), np.uint64(64 - bits)
        ends = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << self.shift)
        self.begin = np.concatenate([[0], ends]).astype(np.int32)
        self.most = int(np.diff(np.append(self.begin, self.n)).max(initial=0))
        self.keys = np.append(keys, np.zeros(self.most + 1, np.uint64))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        at = self.begin[(h >> self.shift).astype(np.int64)]
        known = (self.keys[at] == h) & (at < self.n)
        for _ in range(1, self.most):
            rest = np.flatnonzero(~known)
            next_ = at[rest] + 1
            found = (self.keys[next_] == h[rest]) & (next_ < self.n)
            at[rest] = next_
            known[rest] = found
        return at, known


def hash_list(words: Sequence[str]) -> np.ndarray:
    """Hashes of single words, as ``hashed_words`` gives them."""
    texts = pa.array(list(words), pa.string())
    out = [hashed_words(b, o, np.ones(256, bool), lower=False)[0] for _, _, b, o in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
