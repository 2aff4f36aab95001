"""String similarities that Spark lacks, as Arrow UDFs that work on whole batches with numpy.

The longest common subsequence is bit parallel: the shorter text of each pair is a word of
64 bits, and one step takes the next character of all longer texts of a batch at once.
Pairs whose shorter text has more than 63 characters take whole Python integers instead.
Every distinct pair of a batch is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.session import application

#: Characters that the shorter text of a pair may have to be one machine word.
WORD = 63
#: Pairs of similar length that are worked on together.
BLOCK = 512
ONE = np.uint64(1)


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row for each text, filled up with 0; and lengths. NUL counts as another character."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(size.max(initial=0)))
    texts = [t.replace("\0", "￿") if "\0" in t else t for t in texts]
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width), size


def _masks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each place of a long text, the places of the short one that hold the same character."""
    top = int(max(short.max(initial=0), long.max(initial=0))) + 1
    seen = np.zeros(top, bool)
    seen[0] = True
    seen[short] = True
    seen[long] = True
    code = np.cumsum(seen) - 1
    a, b, n = code[short], code[long], int(code[-1]) + 1
    row = np.arange(len(a)) * n
    table = np.zeros(len(a) * n, np.uint64)
    for i in range(a.shape[1]):
        table[row + a[:, i]] |= ONE << np.uint64(i)
    table[row] = 0  # places after the end
    return table[row[:, None] + b]


def _unmatched_bits(masks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence, from the masks along the last axis."""
    s = np.full(masks.shape[:-1], ~np.uint64(0))
    for j in range(masks.shape[-1]):
        u = s & masks[..., j]
        s = (s + u) | (s - u)
    low = (ONE << size.astype(np.uint64)) - ONE
    return np.bitwise_count(~s & (low if s.ndim == 1 else low[:, None])).astype(np.int64)


def _blocks(rows: np.ndarray, *sizes: np.ndarray):
    """``rows`` in blocks of similar lengths."""
    order = rows[np.lexsort(tuple(s[rows] for s in sizes))]
    for at in range(0, len(order), BLOCK):
        yield order[at : at + BLOCK]


def _by_integer(a: str, b: str) -> int:
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def lcs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = np.array([len(x) for x, _ in pairs], int), np.array([len(y) for _, y in pairs], int)
    for i in np.flatnonzero(short > WORD):
        out[i] = _by_integer(*pairs[i])
    for block in _blocks(np.flatnonzero((short > 0) & (short <= WORD)), short, long):
        x, n = _letters([pairs[i][0] for i in block])
        y, _ = _letters([pairs[i][1] for i in block])
        out[block] = _unmatched_bits(_masks(x, y), n)
    return out


def _steps(a: str, b: str) -> int:
    """The Levenshtein distance by whole Python integers; ``a`` is not empty."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & full, up & across
        out += ((more & top) > 0) - ((less & top) > 0)
        more, less = (more << 1 | 1) & full, less << 1 & full
        eq |= down
        up, down = (less | ~(eq | more)) & full, more & eq
    return out


def levenshtein(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Levenshtein distances, bit parallel as ``lcs`` is: the columns of differences are words."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = np.array([len(x) for x, _ in pairs], int), np.array([len(y) for _, y in pairs], int)
    out = long.astype(np.float64)
    for i in np.flatnonzero(short > WORD):
        out[i] = _steps(*pairs[i])
    for block in _blocks(np.flatnonzero((short > 0) & (short <= WORD)), short, long):
        x, n = _letters([pairs[i][0] for i in block])
        y, m = _letters([pairs[i][1] for i in block])
        masks = np.ascontiguousarray(_masks(x, y).T)
        up, down = np.full(len(block), ~np.uint64(0)), np.zeros(len(block), np.uint64)
        for j, first in enumerate(np.searchsorted(m, np.arange(len(masks)), side="right")):  # shorter ones are done
            eq, u, d = masks[j, first:], up[first:], down[first:]
            across = eq & u
            across += u
            across ^= u
            across |= eq
            more = across | u
            np.invert(more, out=more)
            more |= d
            across &= u
            more <<= ONE
            more |= ONE
            across <<= ONE
            eq = eq | d
            np.bitwise_and(more, eq, out=d)
            eq |= more
            np.invert(eq, out=eq)
            np.bitwise_or(across, eq, out=u)
        low = (ONE << n.astype(np.uint64)) - ONE
        out[block] = m + np.bitwise_count(up & low).astype(np.int64) - np.bitwise_count(down & low).astype(np.int64)
    return out


def _sizes(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _share(common: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.divide(2.0 * common, both, out=np.zeros(len(both)), where=both > 0)


def indel(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """2 LCS / (length of both); 0 where either is empty."""
    return _share(lcs(a, b), _sizes(a) + _sizes(b))


def _in_order(texts: Sequence[str]) -> list[str]:
    known: dict[str, str] = {}
    return [known[t] if t in known else known.setdefault(t, " ".join(sorted(t.split()))) for t in texts]


def token_sort(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return indel(_in_order(a), _in_order(b))


def _word_sets(texts: Sequence[str]) -> list[frozenset[str]]:
    known: dict[str, frozenset[str]] = {}
    return [known[t] if t in known else known.setdefault(t, frozenset(t.split())) for t in texts]


def token_set(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best of the shared words against each side with its own words added.

    Both sides begin with the shared words, which so belong to any longest common
    subsequence; only the rest is compared.
    """
    out = np.zeros(len(a))
    shared, left, right, at = [], [], [], []
    for i, (x, y) in enumerate(zip(_word_sets(a), _word_sets(b), strict=True)):
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 1.0
            continue
        at.append(i)
        shared.append(len(" ".join(both)) if both else 0)
        lead = " " if both else ""
        left.append(lead + " ".join(sorted(x - both)))
        right.append(lead + " ".join(sorted(y - both)))
    if at:
        head = np.array(shared)
        n, m = head + _sizes(left), head + _sizes(right)
        best = _share(head + lcs(left, right), n + m)
        for side in (n, m):
            best = np.maximum(best, np.where(head > 0, 2.0 * head / (head + side), 0.0))
        out[at] = best
    return out


#: Cells of a table of alignments that are worked on together, in bytes or two bytes each.
TABLE = 1 << 17


def partial(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best of the shorter text against windows of the longer, ends included.

    One pass over both texts gives for each place of the longer the first window start
    from which it adds to the common subsequence, so all windows are counted at once.
    """
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = np.array([len(x) for x, _ in pairs], int), np.array([len(y) for _, y in pairs], int)
    out = np.zeros(len(pairs))
    given = np.flatnonzero(short > 0)
    order = given[np.lexsort((short[given], long[given]))]
    at = 0
    while at < len(order):
        size = max(1, TABLE // int(long[order[min(at + BLOCK, len(order)) - 1]]))
        rows = order[at : at + size]
        at += len(rows)
        x, m = _letters([pairs[i][0] for i in rows])
        y, n = _letters([pairs[i][1] for i in rows])
        out[rows] = best_window(_first_starts(x, y).T, m, n)
    return out


def _first_starts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place of ``y`` the least number of places to skip in front so that it adds 1 to the common subsequence with ``x``; its own number if it never does."""
    top = int(max(x.max(initial=0), y.max(initial=0))) + 1
    seen = np.zeros(top, bool)
    seen[x] = True
    seen[y] = True
    code = np.cumsum(seen)
    kind = np.uint8 if y.shape[1] < 256 and code[-1] < 255 else np.uint16 if y.shape[1] < 1 << 16 and code[-1] < (1 << 16) - 1 else np.uint32
    code = code.astype(kind)
    p, q = np.ascontiguousarray(np.where(x > 0, code[x], 0).T.astype(kind)), np.ascontiguousarray(np.where(y > 0, code[y], np.iinfo(kind).max).T[::-1].astype(kind))
    return swept(p, q)[::-1].T.astype(np.int64)


def swept(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``_first_starts`` of coded texts, one column for each, 0 after the end of ``p``; ``q`` and the result begin at the end, with the greatest number after it."""
    kind, m, n = q.dtype, len(p), len(q)
    down, across = np.repeat(np.arange(n, 0, -1, dtype=kind)[:, None], p.shape[1], axis=1), np.zeros(p.shape, kind)
    for d in range(m + n - 1):
        i, j = max(0, d - n + 1), min(m, d + 1)
        back = n - 1 - d
        h, v = down[back + i : back + j], across[i:j]
        turned = (p[i:j] == q[back + i : back + j]) | (v > h)
        change = (h ^ v) * turned
        h ^= change
        v ^= change
    return down


def best_window(starts: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best likeness of any window as long as the shorter text; ``starts`` are those of ``_first_starts``, one column for each pair."""
    width, rows = starts.shape
    kind = np.int16 if width < 1 << 13 else np.int64
    place, m, n = np.arange(1, width + 1, dtype=kind)[:, None], m.astype(kind), n.astype(kind)
    starts = starts.astype(kind)
    low = np.maximum(place - m, np.where(starts > 0, starts, 1 - m))
    low[place > n] = width + 1
    whole, left = 2 * width + 1, width - 1  # windows begin from 1 - m on, so from 1 - width on
    flat = np.bincount(((low.astype(np.int64) + left) * rows + np.arange(rows)).ravel(), minlength=whole * rows).reshape(whole, rows)
    begin = (np.arange(whole) - left).astype(kind)[:, None]
    common = np.cumsum(flat, axis=0, dtype=kind) - np.clip(begin, 0, n)  # those that end before the window begins are counted out
    size = np.minimum(n, begin + m) - np.maximum(begin, 0)
    return np.where(size > 0, np.divide(2 * common, np.maximum(m + size, 1), dtype=np.float64), 0.0).max(axis=0)


def partial_token(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    met = np.array([not x.isdisjoint(y) for x, y in zip(_word_sets(a), _word_sets(b), strict=True)], bool)
    out = np.ones(len(a))
    rest = np.flatnonzero(~met)
    out[rest] = partial(_in_order([a[i] for i in rest]), _in_order([b[i] for i in rest]))
    return out


def weighted(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """A weighted best of the others: words in any order at 0.95, parts at 0.9, or 0.6 from eight times the length on."""
    n, m = _sizes(a), _sizes(b)
    given = (n > 0) & (m > 0)
    longer = np.divide(np.maximum(n, m), np.minimum(n, m), out=np.zeros(len(n)), where=given)
    out = indel(a, b)
    near, far = np.flatnonzero(given & (longer < 1.5)), np.flatnonzero(given & (longer >= 1.5))
    x, y = [a[i] for i in near], [b[i] for i in near]
    out[near] = np.maximum(out[near], 0.95 * np.maximum(token_sort(x, y), token_set(x, y)))
    x, y, scale = [a[i] for i in far], [b[i] for i in far], np.where(longer[far] <= 8, 0.9, 0.6)
    out[far] = np.maximum(out[far], np.maximum(scale * partial(x, y), 0.95 * scale * partial_token(x, y)))
    return out


def _jaro_of(a: str, b: str) -> float:
    """One pair of long texts."""
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    left, taken = [], []
    for i, c in enumerate(a):
        free = places.get(c)
        while free and free[-1] < i - reach:
            free.pop()
        if free and free[-1] <= i + reach:
            left.append(c)
            taken.append(free.pop())
    if not left:
        return 0.0
    m, moved = len(left), sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    n, m = _sizes(a), _sizes(b)
    out = np.zeros(len(a))
    for i in np.flatnonzero((n > 0) & (m > 0) & (np.maximum(n, m) > WORD)):
        out[i] = _jaro_of(a[i], b[i])
    for block in _blocks(np.flatnonzero((n > 0) & (m > 0) & (np.maximum(n, m) <= WORD)), n, m):
        x, na = _letters([a[i] for i in block])
        y, nb = _letters([b[i] for i in block])
        masks = _masks(y, x)  # the places in b of each character of a
        reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
        free = (ONE << nb.astype(np.uint64)) - ONE
        of_a, of_b = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
        for i in range(x.shape[1]):
            low, high = np.maximum(0, i - reach), np.minimum(nb, i + reach + 1)
            window = ((ONE << np.maximum(high, 0).astype(np.uint64)) - ONE) & ~((ONE << np.minimum(low, WORD).astype(np.uint64)) - ONE)
            met = masks[:, i] & free & window
            first = met & (~met + ONE)
            free ^= first
            of_b |= first
            of_a |= np.where(first > 0, ONE << np.uint64(i), np.uint64(0))
        found = np.bitwise_count(of_a).astype(np.int64)
        moved, row = np.zeros(len(block), np.int64), np.arange(len(block))
        for _ in range(int(found.max(initial=0))):
            one_a, one_b = of_a & (~of_a + ONE), of_b & (~of_b + ONE)
            at_a, at_b = (np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 0) for v in (one_a, one_b))
            moved += (one_a > 0) & (x[row, at_a] != y[row, at_b])
            of_a, of_b = of_a ^ one_a, of_b ^ one_b
        some = np.maximum(found, 1)
        out[block] = np.where(found > 0, (found / na + found / nb + (found - moved // 2) / some) / 3, 0.0)
    return out


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro similarity with a bonus for up to four shared characters in front, from 0.7 on."""
    base = jaro(a, b)
    same = np.array([next((k for k, (x, y) in enumerate(zip(s[:4], t[:4], strict=False)) if x != y), min(4, len(s), len(t))) for s, t in zip(a, b, strict=True)], int)
    return np.where(base > 0.7, base + 0.1 * same * (1 - base), base)


KERNELS: dict[str, Callable[[Sequence[str], Sequence[str]], np.ndarray]] = {f.__name__: f for f in (indel, levenshtein, token_sort, token_set, partial, weighted, jaro, jaro_winkler)}


def once(kernel: Callable[[Sequence[str], Sequence[str]], np.ndarray], a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``kernel`` over the distinct pairs only."""
    place: dict[tuple[str, str], int] = {}
    at = [place.setdefault(p, len(place)) for p in zip(a, b, strict=True)]
    return kernel([x for x, _ in place], [y for _, y in place])[at] if at else np.zeros(0)


_made: dict[tuple[str, str], Callable[..., Column]] = {}


def similarity(kind: str, a: Column, b: Column) -> Column:
    """A kernel by name over two string columns; null counts as empty.

    Equal calls give equal expressions, which Spark evaluates once.
    """
    key = (application(), kind)
    if key not in _made:
        kernel = KERNELS[kind]

        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(once(kernel, x.fillna("").tolist(), y.fillna("").tolist()))

        run.__name__ = kind
        _made[key] = F.pandas_udf(run, "double")
    return _made[key](a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, 0 where either is empty, for longer texts: a step takes a whole column of the table of distances."""
    word = F.least(F.length(a), F.length(b)) <= WORD
    steps = F.when(word, similarity("levenshtein", F.when(word, a), F.when(word, b))).otherwise(F.levenshtein(a, b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - steps / F.greatest(F.length(a), F.length(b)))
