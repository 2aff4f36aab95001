"""Measures of pairs of records that lie in one cell, over whole arrays of pairs.

What a record has is coded once for its cell (texts as rows of character codes, word sets
as rows of word codes); a pair is two row numbers. Values are rounded here as Spark rounds
them, so nothing but finished columns leaves a cell.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftlink.functions import fuzzy

#: Characters of one machine word; pairs whose tables are made together, and bytes of their words that are stepped together.
WORD, PAIRS, BLOCK = 64, 1 << 14, 1 << 14
ONE, TOP = np.uint64(1), np.uint64(63)
#: Words by the characters that they hold.
KINDS = ((16, np.uint16), (32, np.uint32), (WORD, np.uint64))
_MICRO = Decimal("0.000001")

#: A column of a measure that is no result: only pairs where it is true are sent out.
KEPT = "_kept"

#: Row numbers of anchors and targets to columns.
Measure = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def rounded(v: np.ndarray) -> np.ndarray:
    """Six places, halves away from 0, as decimal text is rounded: what is near a half is worked out by its digits."""
    size = np.abs(v) * 1e6
    low = np.floor(size)
    part = size - low
    out = np.copysign((low + (part >= 0.5)) / 1e6, v)
    for i in np.flatnonzero((np.abs(part - 0.5) < 1e-4) | (size > 1e9)):
        out[i] = float(Decimal(repr(float(v[i]))).quantize(_MICRO, ROUND_HALF_UP))
    return out + 0.0


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """The number of each row's text among the distinct ones, and these."""
    whole = column.combine_chunks()
    c = pc.dictionary_encode(pc.fill_null(pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole, ""))
    return c.indices.to_numpy(zero_copy_only=False).astype(np.int64), c.dictionary.to_numpy(zero_copy_only=False).tolist()


def equal(a: pa.ChunkedArray, t: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of both sides' rows that are alike where the texts are; 0 for an empty one."""
    known: dict[str, int] = {"": 0}
    return tuple(np.array([known.setdefault(x, len(known)) for x in texts], np.int64)[code] if texts else code for code, texts in (coded(a), coded(t)))


class Texts:
    """The distinct texts of both sides of a column, as rows of character codes from 1 on."""

    def __init__(self, *sides: pa.ChunkedArray | tuple[np.ndarray, list[str]]) -> None:
        """Each side is a column, or codes and what they stand for."""
        self.code, self.text, points, self.size = [], [], [], []
        for side in sides:
            code, text = side if isinstance(side, tuple) else coded(side)
            m, size = fuzzy._letters(text)
            self.code.append(code)
            self.text.append(text)
            points.append(m)
            self.size.append(size)
        top = int(max(m.max(initial=0) for m in points)) + 1
        seen = np.zeros(top, bool)
        for m in points:
            seen[m] = True
        seen[0] = True
        number = (np.cumsum(seen) - 1).astype(np.uint16 if seen.sum() < 1 << 16 else np.uint32)
        self.points, self.letters = [number[m] for m in points], int(number[-1]) + 1

    def sizes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.size[0][self.code[0][x]], self.size[1][self.code[1][y]]

    def levenshtein(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Levenshtein distances of pairs of rows."""
        return self._by_steps(x, y, _levenshtein, _levenshtein_words)

    def lcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences of pairs of rows."""
        return self._by_steps(x, y, _lcs, _lcs_words)

    def _by_steps(self, x: np.ndarray, y: np.ndarray, step, by_words) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), PAIRS):
            rows = slice(at, at + PAIRS)
            i, j = self.code[0][x[rows]], self.code[1][y[rows]]
            out[rows] = self.stepped(i, j, step, by_words)
        return out

    def stepped(self, i: np.ndarray, j: np.ndarray, step, by_words) -> np.ndarray:
        """A step over pairs of texts: the first is the pattern, or the second if only that fits a word."""
        out = np.zeros(len(i), np.int64)
        for side, p, q, some in self.split(i, j):
            k = np.flatnonzero(some)
            if len(k):
                out[k] = self._stepped(side, p[k], q[k], step)
        k = np.flatnonzero((self.size[0][i] > WORD) & (self.size[1][j] > WORD))
        if len(k):
            out[k] = self._stepped(0, i[k], j[k], by_words)
        return out

    def split(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The side of the pattern, patterns, texts and pairs, by the words that patterns need; pairs of two long texts are left out."""
        parts, n, least = [], self.size[0][i], -1
        for most, _ in KINDS:
            parts.append((0, i, j, (n > least) & (n <= most)))
            least = most
        parts.append((1, j, i, (n > WORD) & (self.size[1][j] <= WORD)))
        return parts

    def _stepped(self, side: int, pattern: np.ndarray, text: np.ndarray, step) -> np.ndarray:
        """Texts of the other side read character by character against patterns of one word, or of several."""
        table, place = self.tables(side, pattern)
        if len(table) == 1 and step in (_levenshtein, _lcs):
            table = table[0]
        m = self.size[1 - side][text]
        order = np.argsort(m.astype(np.uint16 if m.max(initial=0) < 1 << 16 else np.int32), kind="stable")
        out, block = np.zeros(len(text), np.int64), BLOCK // table.itemsize
        for at in range(0, len(order), block):
            k = order[at : at + block]
            size = m[k]
            letters = self.read(1 - side, text[k], int(size[-1])) + (place[k] * self.letters)
            out[k] = step(table, letters, size, self.size[side][pattern[k]])
        return out

    def read(self, side: int, text: np.ndarray, width: int) -> np.ndarray:
        """The first characters of texts, one row for each place."""
        return np.ascontiguousarray(self.points[side][text, :width].T)

    def jaro_winkler(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``fuzzy.jaro_winkler`` of pairs of rows."""
        out = np.zeros(len(x))
        for at in range(0, len(x), PAIRS):
            i, j = self.code[0][x[at : at + PAIRS]], self.code[1][y[at : at + PAIRS]]
            n, m = self.size[0][i], self.size[1][j]
            part, given = np.zeros(len(i)), (n > 0) & (m > 0)
            k = np.flatnonzero(given & (np.maximum(n, m) >= WORD))
            if len(k):
                part[k] = fuzzy.jaro_winkler([self.text[0][v] for v in i[k]], [self.text[1][v] for v in j[k]])
            least = 0
            for most in (31, WORD - 1):
                k = np.flatnonzero(given & (np.maximum(n, m) > least) & (np.maximum(n, m) <= most))
                least = most
                if len(k):
                    part[k] = self._jaro_winkler(i[k], j[k], n[k], m[k], np.uint32 if most < 32 else np.uint64)
            out[at : at + PAIRS] = part
        return out

    def _jaro_winkler(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, kind: type) -> np.ndarray:
        table, place = self.tables(1, j)
        table, base, one = table[0], place * self.letters, kind(1)
        a, b = self.read(0, i, int(n.max())), self.read(1, j, int(m.max()))
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1).astype(kind)
        free = whole = (one << m.astype(kind)) - one
        window = (one << (reach + one)) - one  # the places of the other text that a character may meet
        met_by, found, col = np.zeros((len(a) + 1, len(i)), a.dtype), np.zeros(len(i), np.int64), np.arange(len(i))
        for p, letters in enumerate(a):
            met = table.take(base + letters).astype(kind, copy=False)
            met &= free
            met &= window
            met &= ~met + one
            free = free ^ met
            met_by[found, col] = letters
            found += met > 0
            window = (window << one) | (reach > p)
        taken, at, moved = whole ^ free, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for q, letters in enumerate(b):
            own = (taken >> kind(q)) & one > 0
            moved += own & (met_by[at, col] != letters)
            at += own
        some = np.maximum(found, 1)
        jaro = np.where(found > 0, (found / n + found / m + (found - moved // 2) / some) / 3, 0.0)
        same, alike = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for letters, others in zip(a[:4], b[:4], strict=False):
            alike &= (letters == others) & (letters > 0)
            same += alike
        return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)

    def partial(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``fuzzy.partial`` of pairs of rows."""
        i, j = self.code[0][x], self.code[1][y]
        n, m = self.size[0][i], self.size[1][j]
        out, given = np.zeros(len(x)), (n > 0) & (m > 0)
        few = (np.maximum(n, m) < 255) & (self.letters < 255)
        k = np.flatnonzero(given & ~few)
        if len(k):
            out[k] = fuzzy.partial([self.text[0][v] for v in i[k]], [self.text[1][v] for v in j[k]])
        for k, side, p, q, short, long in ((np.flatnonzero(given & few & (n <= m)), 0, i, j, n, m), (np.flatnonzero(given & few & (n > m)), 1, j, i, m, n)):
            k = k[np.argsort((long[k] << 8 | short[k]).astype(np.uint16), kind="stable")]
            at = 0
            while at < len(k):
                some = k[at : at + max(1, fuzzy.TABLE // int(long[k[min(at + 2 * BLOCK, len(k)) - 1]]))]
                at += len(some)
                a, b = self.read(side, p[some], int(short[some].max())), self.read(1 - side, q[some], int(long[some].max()))
                starts = fuzzy.swept(a.astype(np.uint8), np.where(b > 0, b, 255).astype(np.uint8)[::-1])[::-1]
                out[some] = fuzzy.best_window(starts, short[some], long[some])
        return out

    def tables(self, side: int, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the patterns the places of each letter, and the number of each pattern there."""
        own, place = distinct(pattern)
        n, top = self.letters, int(self.size[side][own].max(initial=0))
        points = self.read(side, own, top)
        kind = next((k for most, k in KINDS if top <= most), np.uint64)
        table, row = np.zeros((max(1, -(-top // WORD)), len(own) * n), kind), np.arange(len(own)) * n
        for i in range(top):
            table[i // WORD, row + points[i]] |= kind(1) << kind(i % WORD)
        table[:, row] = 0  # places after the end
        return table, place


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of neighbours, and the number of each value: pairs come in the order of their anchors."""
    if not len(v):
        return v, v
    head = np.concatenate([[True], v[1:] != v[:-1]])
    if 4 * np.count_nonzero(head) > len(v):
        return np.unique(v, return_inverse=True)
    return v[head], np.cumsum(head) - 1


def _levenshtein(table: np.ndarray, letters: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    kind = table.dtype.type
    one = kind(1)
    up, down = np.full(len(m), ~kind(0)), np.zeros(len(m), kind)
    for j, first in enumerate(np.searchsorted(m, np.arange(len(letters)), side="right")):  # shorter ones are done
        eq, u, d = table.take(letters[j, first:]), up[first:], down[first:]
        across = eq & u
        across += u
        across ^= u
        across |= eq
        more = across | u
        np.invert(more, out=more)
        more |= d
        across &= u
        more <<= one
        more |= one
        across <<= one
        eq |= d
        np.bitwise_and(more, eq, out=d)
        eq |= more
        np.invert(eq, out=eq)
        np.bitwise_or(across, eq, out=u)
    low = _low(n).astype(kind)
    return m + np.bitwise_count(up & low).astype(np.int64) - np.bitwise_count(down & low).astype(np.int64)


def _lcs(table: np.ndarray, letters: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    kind = table.dtype.type
    s = np.full(len(m), ~kind(0))
    for j, first in enumerate(np.searchsorted(m, np.arange(len(letters)), side="right")):
        v = s[first:]
        u = table.take(letters[j, first:])
        u &= v
        more = v + u
        v -= u
        v |= more
    return np.bitwise_count(~s & _low(n).astype(kind)).astype(np.int64)


def _levenshtein_words(tables: np.ndarray, letters: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Patterns of several words: what leaves the top of one enters the next."""
    shape = (len(tables), len(m))
    up, down = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)
    for j, first in enumerate(np.searchsorted(m, np.arange(len(letters)), side="right")):
        more_in, less_in = np.full(len(m) - first, ONE), np.zeros(len(m) - first, np.uint64)
        for w, table in enumerate(tables):
            eq, u, d = table[letters[j, first:]], up[w, first:], down[w, first:]
            kept = eq | d
            eq |= less_in
            across = (((eq & u) + u) ^ u) | eq
            more, less = d | ~(across | u), u & across
            more_out, less_out = more >> TOP, less >> TOP
            more, less = (more << ONE) | more_in, (less << ONE) | less_in
            up[w, first:] = less | ~(kept | more)
            down[w, first:] = more & kept
            more_in, less_in = more_out, less_out
    out = m.copy()
    for w in range(len(tables)):
        low = _low(np.clip(n - w * WORD, 0, WORD))
        out += np.bitwise_count(up[w] & low).astype(np.int64) - np.bitwise_count(down[w] & low).astype(np.int64)
    return out


def _lcs_words(tables: np.ndarray, letters: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    s = np.full((len(tables), len(m)), ~np.uint64(0))
    for j, first in enumerate(np.searchsorted(m, np.arange(len(letters)), side="right")):
        carry = np.zeros(len(m) - first, np.uint64)
        for w, table in enumerate(tables):
            v = s[w, first:]
            u = table[letters[j, first:]] & v
            half = v + u
            whole = half + carry
            carry = ((half < v) | (whole < half)).astype(np.uint64)
            s[w, first:] = whole | (v - u)
    return sum(np.bitwise_count(~s[w] & _low(np.clip(n - w * WORD, 0, WORD))).astype(np.int64) for w in range(len(tables)))


def _low(n: np.ndarray) -> np.ndarray:
    """Words of ``n`` set bits, 64 at most."""
    return np.where(n > 0, ~np.uint64(0) >> (WORD - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))


def similarity(steps: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 - distance / longer length, 0 where either is empty."""
    return np.where((n == 0) | (m == 0), 0.0, 1 - steps / np.maximum(np.maximum(n, m), 1))


def mean_similarity(a: pa.Table, t: pa.Table) -> Measure:
    """p, the fixed mean of the likeness of names, addresses and countries."""
    name, place = Texts(a["name"], t["name"]), Texts(a["address_norm"], t["address_norm"])
    ca, ct = equal(a["country_norm"], t["country_norm"])

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, d = (similarity(f.levenshtein(x, y), *f.sizes(x, y)) for f in (name, place))
        return {"p": rounded(0.6 * n + 0.3 * d + 0.1 * (ca[x] == ct[y]))}

    return run


#: Thresholds of ``features.context_features``, in millionths.
ABOVE = {"0_1": 100_000, "0_3": 300_000, "0_5": 500_000, "0_675": 675_000, "0_9": 900_000, "0_99": 990_000}
CONTEXT = ("probability_rank", "group_max", "group_sum_others", "gap_to_max", *[f"others_above_{k}" for k in ABOVE], "group_sum_squares_others")


def context(group: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """``features.context_features`` but for p itself, rounded: of pairs in the order of their anchors, and of whole anchors, with p in millionths."""
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count, p = np.diff(np.append(head, len(group))), p.astype(np.int64)
    each = lambda v: np.repeat(v, count)
    place = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    key = place * (1 << 21) - p
    order = np.argsort(key)
    down = key[order]
    first = np.concatenate([[True], down[1:] != down[:-1]])
    rank = np.empty(len(p), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
    top = each(np.maximum.reduceat(p, head))
    out = {"probability_rank": rank - each(head) + 1, "group_max": top / 1e6, "group_sum_others": (each(np.add.reduceat(p, head)) - p) / 1e6, "gap_to_max": (top - p) / 1e6}
    for k, least in ABOVE.items():
        above = (p >= least).astype(np.int64)
        out[f"others_above_{k}"] = each(np.add.reduceat(above, head)) - above
    squares = each(np.add.reduceat(p * p, head)) - p * p
    out["group_sum_squares_others"] = (squares + 500_000) // 1_000_000 / 1e6
    return {k: v.astype(np.float64) for k, v in out.items()}


#: Classes of letters whose counts bound a distance.
CLASSES = 32


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has the letters of each of a few classes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    return np.bincount(row * CLASSES + points % CLASSES, minlength=len(texts) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def sure_similarity(least: float) -> Callable[[pa.Table, pa.Table], Measure]:
    """``mean_similarity`` of the pairs whose p is ``least`` or more; the others are not sent out.

    Lengths bound both similarities and letters that of the names, so most pairs need no
    distance, and most of the rest none of their addresses. A bound that lies below by more
    than rounding adds rules a pair out.
    """

    def of(a: pa.Table, t: pa.Table) -> Measure:
        name, place = Texts(a["name"], t["name"]), Texts(a["address_norm"], t["address_norm"])
        letters = [letter_counts(text) for text in name.text]
        ca, ct = equal(a["country_norm"], t["country_norm"])
        near = least - 1e-6

        def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
            rest = 0.1 * (ca[x] == ct[y])
            n, m = place.sizes(x, y)
            rest += 0.3 * np.where((n > 0) & (m > 0), np.minimum(n, m) / np.maximum(np.maximum(n, m), 1), 0.0)
            n, m = name.sizes(x, y)
            high = np.maximum(np.maximum(n, m), 1)
            k = np.flatnonzero(0.6 * (np.minimum(n, m) / high) + rest >= near)
            common = np.minimum(letters[0][name.code[0][x[k]]], letters[1][name.code[1][y[k]]]).sum(axis=1)
            k = k[0.6 * (common / high[k]) + rest[k] >= near]
            alike = similarity(name.levenshtein(x[k], y[k]), n[k], m[k])
            some = 0.6 * alike + rest[k] >= near
            k, alike = k[some], alike[some]
            i, j = x[k], y[k]
            d = similarity(place.levenshtein(i, j), *place.sizes(i, j))
            p = np.full(len(x), np.nan)
            p[k] = rounded(0.6 * alike + 0.3 * d + 0.1 * (ca[i] == ct[j]))
            return {"p": p, KEPT: p >= least}

        return run

    return of


#: Words of a text up to which sets are compared place by place.
FEW = 64


class Sets:
    """Sets of numbers, laid end to end."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.end = flat, np.concatenate([[0], np.cumsum(size)])

    def __getitem__(self, k: int) -> set[int]:
        return set(self.flat[self.end[k] : self.end[k + 1]].tolist())


def word_sets(lists: list[pa.Array]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words of lists of both sides, and for each side their numbers, list by list and rising, and the size of each set."""
    coded_ = pc.dictionary_encode(pa.chunked_array([c.flatten() for c in lists], pa.string())).combine_chunks()
    coded_ = coded_.chunk(0) if isinstance(coded_, pa.ChunkedArray) else coded_
    known = coded_.dictionary
    order = pc.sort_indices(known).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    empty = rank[np.flatnonzero(pc.equal(known, "").to_numpy(zero_copy_only=False))]
    code, out = rank[coded_.indices.to_numpy(zero_copy_only=False)], []
    for c in lists:
        count = pc.list_value_length(c).to_numpy(zero_copy_only=False)
        n = int(count.sum())
        own, code = code[:n], code[n:]
        row = np.repeat(np.arange(len(c)), count)
        if len(empty):
            row, own = row[own != empty[0]], own[own != empty[0]]
        pairs = np.sort(row << 32 | own)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        out.append((pairs & 0xFFFFFFFF, np.bincount(pairs >> 32, minlength=len(c)).astype(np.int64)))
    return known.take(pa.array(order)), out


def laid_out(flat: np.ndarray, size: np.ndarray, most: int, other: int) -> np.ndarray:
    """The numbers of each set of ``most`` or fewer, one column for each; ``other`` in the free places."""
    few = size <= most
    places = np.full((int(size[few].max(initial=0)), len(size)), other, np.int32)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    some = few[row]
    places[at[some], row[some]] = flat[some]
    return places


class Words:
    """The distinct words of the texts of a column on both sides, as codes."""

    def __init__(self, a: pa.ChunkedArray, t: pa.ChunkedArray) -> None:
        self.code, texts = map(list, zip(*(coded(column) for column in (a, t)), strict=True))
        words, sides = word_sets([pc.split_pattern(pa.array(text, pa.string()), " ") for text in texts])
        self.words, self.size = words, [size for _, size in sides]
        self.sets = [Sets(*side) for side in sides]
        self.places = [laid_out(*side, FEW, -1 - k) for k, side in enumerate(sides)]

    @property
    def known(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words.to_numpy(zero_copy_only=False).tolist())}

    def shared(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words pairs of rows share, and how many each has."""
        i, j = self.code[0][x], self.code[1][y]
        n, m = self.size[0][i], self.size[1][j]
        out = np.zeros(len(x), np.int64)
        right = [p[j] for p in self.places[1]]
        for p in self.places[0]:
            left = p[i]
            met = np.zeros(len(x), bool)
            for r in right:
                met |= left == r
            out += met
        for k in np.flatnonzero((n > FEW) | (m > FEW)):
            out[k] = len(self.sets[0][i[k]] & self.sets[1][j[k]])
        return out, n, m


def _over(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Shares; 0 of nothing."""
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def text_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.text_features``, rounded."""
    kinds = {}
    for prefix, raw, norm in (("name", "business_name", "name"), ("address", "business_address", "address_norm")):
        kinds[prefix] = Texts(a[norm], t[norm]), Words(a[norm], t[norm]), equal(a[raw], t[raw]), equal(a[norm], t[norm])

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for prefix, (texts, words, (ra, rt), (na, nt)) in kinds.items():
            n, m = texts.sizes(x, y)
            shared, p, q = words.shared(x, y)
            given = (n > 0) & (m > 0)
            out |= {
                f"{prefix}_exact": (ra[x] > 0) & (ra[x] == rt[y]),
                f"{prefix}_normalized_exact": (na[x] > 0) & (na[x] == nt[y]),
                f"{prefix}_levenshtein_similarity": rounded(similarity(texts.levenshtein(x, y), n, m)),
                f"{prefix}_jaccard_similarity": rounded(np.where((p > 0) & (q > 0), _over(shared, p + q - shared), 0.0)),
                f"{prefix}_token_overlap": shared,
                f"{prefix}_length_difference": np.abs(n - m),
                f"{prefix}_length_ratio": rounded(np.where(given, _over(np.minimum(n, m), np.maximum(n, m)), 0.0)),
                f"{prefix}_left_missing": n == 0,
                f"{prefix}_right_missing": m == 0,
            }
        return {k: v.astype(np.float64) for k, v in out.items()}

    return run


#: The n-gram similarities by field and n.
GRAMS = {"name_char_3gram_similarity": ("name_norm", 3), "name_char_4gram_similarity": ("name_norm", 4), "name_char_5gram_similarity": ("name_norm", 5), "address_char_ngram_similarity": ("address_norm", 3)}

COMPONENTS = {"postal_code": "postal_code", "city": "city", "state": "state", "street_number": "street_number", "country": "country_norm"}


def component_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.component_features``."""
    codes = {name: equal(a[field], t[field]) for name, field in COMPONENTS.items()}

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for name, (ca, ct) in codes.items():
            p, q = ca[x], ct[y]
            out[f"{name}_match"] = ((p > 0) & (p == q)).astype(np.float64)
            out[f"{name}_both_present"] = ((p > 0) & (q > 0)).astype(np.float64)
        return out

    return run


def mapped(column: pa.ChunkedArray, f: Callable[[str], str]) -> pa.ChunkedArray:
    """A function of each distinct text."""
    code, text = coded(column)
    return pa.chunked_array([pa.array([f(x) for x in text], pa.string()).take(pa.array(code))])


#: Words of a text up to which shared words are the bits of a number beside the number of the text.
MARKED = 40


class Similar:
    """The similarities of ``fuzzy`` for the texts of a column on both sides, which are coded once for a cell."""

    def __init__(self, a: pa.ChunkedArray, t: pa.ChunkedArray) -> None:
        self.plain = Texts(a, t)
        lists = [[x.split() for x in text] for text in self.plain.text]
        self.ordered = self._of([[" ".join(sorted(v)) for v in side] for side in lists])
        words, sides = word_sets([pa.array(side, pa.list_(pa.string())) for side in lists])
        self.words, self.length = words.to_numpy(zero_copy_only=False), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts, self.end = [size for _, size in sides], [np.concatenate([[0], np.cumsum(size)]) for _, size in sides]
        self.flat = [flat for flat, _ in sides]
        self.marks = [laid_out(*side, MARKED, -1 - k) for k, side in enumerate(sides)]
        self.sizes = [np.where(m >= 0, self.length[np.maximum(m, 0)], 0) if len(self.length) else np.zeros(m.shape, np.int64) for m in self.marks]
        self.once = self.ordered
        if any((size != np.fromiter(map(len, side), np.int64, len(side))).any() for size, side in zip(self.counts, lists, strict=True)):
            self.once = self._of([[" ".join(sorted(set(v))) for v in side] for side in lists])
        self.last = [np.cumsum(m + (m > 0), axis=0) - 1 for m in self.sizes]  # the place of the blank after each word
        self.spans: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        self.number = []
        for k, (last, size) in enumerate(zip(self.last, self.sizes, strict=True)):
            own, first = size > 0, last - size
            in_word = own & (last <= WORD)
            bit = np.where(in_word & (np.arange(len(size))[:, None] < self.counts[k] - 1), ONE << np.minimum(last, WORD - 1).astype(np.uint64), np.uint64(0))
            span = np.where(in_word, _low(np.minimum(last, WORD)) ^ _low(np.where(own, first, 0)), np.uint64(0))
            self.spans.append((list(span | bit), list(bit)))
            number = np.zeros(self.once.points[k].shape, np.uint8)
            for p in range(len(size)):
                number += (np.arange(number.shape[1]) > last[p][:, None]) & own[p][:, None]
            self.number.append(number)

    def _of(self, texts: list[list[str]]) -> Texts:
        """Other forms of the texts."""
        return Texts(*zip(self.plain.code, texts, strict=True))

    def indel(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return fuzzy._share(self.plain.lcs(x, y), sum(self.plain.sizes(x, y)))

    def token_sort(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return fuzzy._share(self.ordered.lcs(x, y), sum(self.ordered.sizes(x, y)))

    def by_text(self, kernel: Callable, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A kernel over the distinct pairs of texts."""
        i, j = self.plain.code[0][x], self.plain.code[1][y]
        pairs, place = np.unique(i * len(self.plain.text[1]) + j, return_inverse=True)
        if not len(pairs):
            return np.zeros(0)
        p, q = np.divmod(pairs, len(self.plain.text[1]))
        return kernel([self.plain.text[0][k] for k in p], [self.plain.text[1][k] for k in q])[place]

    def _met(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of each text the other has, as bits, and the characters of the shared ones."""
        left, right, size = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        others = [m[j] for m in self.marks[1]]
        there = [np.zeros(len(i), bool) for _ in others]
        for p, m in enumerate(self.marks[0]):
            own, here = m[i], np.zeros(len(i), bool)
            for other, hit in zip(others, there, strict=True):
                met = own == other
                here |= met
                hit |= met
            if here.any():
                left |= here.astype(np.int64) << p
                size += np.where(here, self.sizes[0][p][i], 0)
        for q, hit in enumerate(there):
            right |= hit.astype(np.int64) << q
        return left, right, size

    def _rests(self, side: int, i: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """The words of texts but for those marked, in order."""
        some, place = np.unique(i << MARKED | marks, return_inverse=True)
        flat, end = self.flat[side], self.end[side]
        own = lambda k: self.words[flat[end[k] : end[k + 1]]]
        return place, [" ".join([w for p, w in enumerate(own(v >> MARKED)) if not v >> p & 1]) for v in some.tolist()]

    def _rest_lcs(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Longest common subsequences of the words that are not marked: the places of marked ones meet nothing."""
        out = np.zeros(len(i), np.int64)
        for side, p, q, some in self.once.split(i, j):
            k = np.flatnonzero(some)
            if len(k):
                marks = (left, right) if side == 0 else (right, left)
                out[k] = self._kept_lcs(side, p[k], q[k], *(v[k] for v in marks))
        k = np.flatnonzero((self.once.size[0][i] > WORD) & (self.once.size[1][j] > WORD))
        if len(k):
            (p, before), (q, after) = self._rests(0, i[k], left[k]), self._rests(1, j[k], right[k])
            rest = Texts(pa.chunked_array([pa.array(before, pa.string())]), pa.chunked_array([pa.array(after, pa.string())]))
            out[k] = rest.lcs(p, q)
        return out

    def _kept_lcs(self, side: int, pattern: np.ndarray, text: np.ndarray, marks: np.ndarray, others: np.ndarray) -> np.ndarray:
        table, place = self.once.tables(side, pattern)
        table, kind = table[0], table.dtype.type
        keep, blank = np.zeros(len(pattern), np.uint64), np.zeros(len(pattern), np.uint64)
        for p, (span, bit) in enumerate(zip(*self.spans[side], strict=True)):
            own = np.where(marks >> p & 1, np.uint64(0), span[pattern])
            keep |= own
            blank = np.where(own > 0, bit[pattern], blank)
        keep = (keep & ~blank).astype(kind)
        there, other = self.last[1 - side], 1 - side
        end, count = np.full(len(text), -1), self.counts[other][text]
        for p, last in enumerate(there):
            end = np.where((p < count) & (others >> p & 1 == 0), np.where(p < count - 1, last[text], -1), end)
        m = self.once.size[other][text]
        order, out, block = np.argsort(m.astype(np.uint16 if m.max(initial=0) < 1 << 16 else np.int32), kind="stable"), np.zeros(len(text), np.int64), BLOCK // table.itemsize
        for at in range(0, len(order), block):
            k = order[at : at + block]
            size, t = m[k], text[k]
            letters = self.once.read(other, t, int(size[-1]))
            number = np.ascontiguousarray(self.number[other][t, : len(letters)].T)
            letters *= (others[k] >> number & 1 == 0).astype(letters.dtype)
            cut = np.flatnonzero(end[k] >= 0)
            letters[end[k[cut]], cut] = 0
            letters = letters + place[k] * self.once.letters
            s, own = np.full(len(k), ~kind(0)), keep[k]
            for j, first in enumerate(np.searchsorted(size, np.arange(len(letters)), side="right")):
                v = s[first:]
                u = table.take(letters[j, first:])
                u &= v
                u &= own[first:]
                more = v + u
                v -= u
                v |= more
            out[k] = np.bitwise_count(~s & own)
        return out

    def token_set(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        i, j = self.plain.code[0][x], self.plain.code[1][y]
        n, m = self.counts[0][i], self.counts[1][j]
        many = (n > MARKED) | (m > MARKED)
        if many.any():
            out[many] = self.by_text(fuzzy.token_set, x[many], y[many])
        k = np.flatnonzero(~many & (n > 0) & (m > 0))
        i, j = i[k], j[k]
        left, right, size = self._met(i, j)
        count = np.bitwise_count(left).astype(np.int64)
        whole = (count > 0) & ((count == n[k]) | (count == m[k]))
        out[k[whole]] = 1.0
        k, i, j, left, right, size, count = (v[~whole] for v in (k, i, j, left, right, size, count))
        if not len(k):
            return out
        head = np.where(count > 0, size + count - 1, 0)
        lead = head + (count > 0)
        n, m = (lead + self.once.size[s][v] - size - count for s, v in enumerate((i, j)))
        common = np.concatenate([self._rest_lcs(*(v[at : at + PAIRS] for v in (i, j, left, right))) for at in range(0, len(k), PAIRS)])
        best = fuzzy._share(lead + common, n + m)
        for v in (n, m):
            best = np.maximum(best, np.where(head > 0, 2.0 * head / np.maximum(head + v, 1), 0.0))
        out[k] = best
        return out

    def weighted(self, x: np.ndarray, y: np.ndarray, ratio: np.ndarray, ordered: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """From the other three; only texts of unlike lengths are compared by parts."""
        n, m = self.plain.sizes(x, y)
        given = (n > 0) & (m > 0)
        longer = np.divide(np.maximum(n, m), np.minimum(n, m), out=np.zeros(len(n)), where=given)
        near = given & (longer < 1.5)
        out = np.where(near, np.maximum(ratio, 0.95 * np.maximum(ordered, sets)), ratio)
        far = np.flatnonzero(given & (longer >= 1.5))
        i, j = self.plain.code[0][x[far]], self.plain.code[1][y[far]]
        many = (self.counts[0][i] > MARKED) | (self.counts[1][j] > MARKED)
        if many.any():
            k, far = far[many], far[~many]
            i, j = i[~many], j[~many]
            out[k] = np.maximum(out[k], self.by_text(fuzzy.weighted, x[k], y[k]))
        if len(far):
            scale, parts = np.where(longer[far] <= 8, 0.9, 0.6), np.ones(len(far))
            alone = self._met(i, j)[0] == 0
            parts[alone] = self.ordered.partial(x[far[alone]], y[far[alone]])
            best = np.maximum(scale * self.plain.partial(x[far], y[far]), 0.95 * scale * parts)
            out[far] = np.maximum(out[far], best)
        return out


def coarse_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.coarse_features`` but for the rules, rounded; ``runs`` are the runs of digits of the address."""
    kinds = {p: (Similar(a[f], t[f]), Words(a[f], t[f])) for p, f in (("name", "name"), ("address", "address_norm"))}
    ca, ct = equal(a["country_norm"], t["country_norm"])
    runs = Words(a["runs"], t["runs"])

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for p, (s, _) in kinds.items():
            ratio, ordered, sets = s.indel(x, y), s.token_sort(x, y), s.token_set(x, y)
            out |= {f"{p}_ratio": ratio, f"{p}_wratio": s.weighted(x, y, ratio, ordered, sets), f"{p}_token_set": sets, f"{p}_token_sort": ordered}
            if p == "name":
                out["name_jaro"] = s.plain.jaro_winkler(x, y)
        lengths = {p: s.plain.sizes(x, y) for p, (s, _) in kinds.items()}
        out |= {f"{p}_length_ratio": np.minimum(n, m) / np.maximum(np.maximum(n, m), 1) for p, (n, m) in lengths.items()}
        out["country_match"] = ca[x] == ct[y]
        out |= {f"{p}_missing": (n == 0) | (m == 0) for p, (n, m) in lengths.items()}
        shared, n, m = runs.shared(x, y)
        out |= {"number_overlap": shared, "number_jaccard": shared / np.maximum(n + m - shared, 1)}
        for p, (_, words) in kinds.items():
            shared, n, m = words.shared(x, y)
            out[f"{p}_token_jaccard"] = shared / np.maximum(n + m - shared, 1)
        return {k: rounded(v.astype(np.float64)) for k, v in out.items()}

    return run


def enhanced_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.enhanced_features`` without a probability; ``numbers`` and ``core`` are the words that may conflict."""
    name, place = (Similar(a[f], t[f]) for f in ("name", "address_norm"))
    na, nt = equal(a["name"], t["name"])
    blank = [np.array([not v.strip(" ") for v in text], bool)[code] for code, text in zip(place.plain.code, place.plain.text, strict=True)]
    sets = {f: Words(a[f], t[f]) for f in ("numbers", "core")}

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        no_a, no_t = blank[0][x], blank[1][y]
        ratio = name.indel(x, y)
        likeness = np.where(no_a | no_t, 0.5, place.token_set(x, y))
        conflict = {}
        for f, words in sets.items():
            shared, n, m = words.shared(x, y)
            conflict[f] = (n > 0) & (m > 0) & (shared == 0)
        out = {
            "is_target_addr_missing": no_t,
            "is_anchor_addr_missing": no_a,
            "addr_missing_either": no_a | no_t,
            "name_dominant_blank_addr": no_t & (ratio >= 0.75),
            "name_exact_blank_addr": no_t & (na[x] == nt[y]),
            "veto_num_conflict_tempered": conflict["numbers"] & ~((ratio >= 0.85) & (likeness >= 0.80)),
            "veto_name_conflict_tempered": conflict["core"] & ~(likeness >= 0.95),
            "margin_to_best": np.zeros(len(x)),
            "is_top": np.ones(len(x)),
        }
        return {k: v.astype(np.float64) for k, v in out.items()}

    return run


def rich_features(a: pa.Table, t: pa.Table) -> Measure:
    """``text_features``, ``component_features`` and ``enhanced_features``, with the columns of ``features.ngram_features``, ``fuzzy_features`` and ``combined_feature``.

    ``grams_<field>_<n>`` are n-grams joined by blanks, ``combined`` is name and address.
    """
    parts = [f(a, t) for f in (text_features, component_features, enhanced_features)]
    grams = {name: Words(a[f"grams_{f}_{n}"], t[f"grams_{f}_{n}"]) for name, (f, n) in GRAMS.items()}
    name, place = (Similar(a[f], t[f]) for f in ("name", "address_norm"))
    combined = Texts(a["combined"], t["combined"])

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for part in parts:
            out |= part(x, y)
        for k, words in grams.items():
            shared, n, m = words.shared(x, y)
            out[k] = rounded(np.where((n > 0) & (m > 0), _over(shared, n + m - shared), 0.0))
        wratio = name.weighted(x, y, name.indel(x, y), name.token_sort(x, y), name.token_set(x, y))
        more = {
            "name_jaro_winkler": name.plain.jaro_winkler(x, y),
            "name_wratio": wratio,
            "address_token_set_similarity": place.token_set(x, y),
            "name_address_combined_similarity": similarity(combined.levenshtein(x, y), *combined.sizes(x, y)),
        }
        return out | {k: rounded(v) for k, v in more.items()}

    return run


#: The longest words of a side that are aligned.
ALIGNED = 12


class Alignment:
    """``features.soft_alignment`` of the texts of a column."""

    def __init__(self, a: pa.ChunkedArray, t: pa.ChunkedArray) -> None:
        self.code, self.kept, self.count, self.size, words = [], [], [], [], []
        for column in (a, t):
            code, text = coded(column)
            known: dict[str, int] = {}
            lists = [sorted(v.split(), key=lambda w: (-len(w), w))[:ALIGNED] for v in text]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            kept, size = (np.zeros((int(count.max(initial=0)), len(lists)), np.int64) for _ in range(2))
            for k, v in enumerate(lists):
                kept[: len(v), k] = [known.setdefault(w, len(known)) for w in v]
                size[: len(v), k] = list(map(len, v))
            self.code.append(code)
            self.kept.append(kept)
            self.count.append(count)
            self.size.append(size)
            words.append(pa.chunked_array([pa.array(list(known), pa.string())]))
        self.words, self.n = Texts(*words), max(1, len(words[1]))

    def features(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        parts = [self._some(x[at : at + PAIRS], y[at : at + PAIRS]) for at in range(0, len(x), PAIRS)]
        return {k: np.concatenate([v[k] for v in parts]) for k in parts[0]}

    def _some(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        i, j = self.code[0][x], self.code[1][y]
        n, m = self.count[0][i], self.count[1][j]
        high, wide = int(n.max(initial=0)), int(m.max(initial=0))
        grid = np.zeros((high, wide, len(x)))
        p, q, row = np.nonzero((np.arange(high)[:, None, None] < n) & (np.arange(wide)[None, :, None] < m))
        if len(row):
            pairs, place = np.unique(self.kept[0][p, i[row]] * self.n + self.kept[1][q, j[row]], return_inverse=True)
            u, v = np.divmod(pairs, self.n)
            grid[p, q, row] = fuzzy._share(self.words.lcs(u, v), sum(self.words.sizes(u, v)))[place]
        out = {}
        for side, count, best, size in (("left", n, grid.max(axis=1, initial=0.0), self.size[0][:high, i]), ("right", m, grid.max(axis=0, initial=0.0), self.size[1][:wide, j])):
            own = np.arange(len(best))[:, None] < count
            out |= {
                f"{side}_mean": best.sum(axis=0) / np.maximum(count, 1),
                f"{side}_min": np.where(count > 0, np.where(own, best, 1.0).min(axis=0, initial=1.0), 0.0),
                f"{side}_unmatched": (own & (best < 0.65)).sum(axis=0),
                f"{side}_weighted": (size * best).sum(axis=0) / np.maximum(size.sum(axis=0), 1),
            }
        return out


def detail_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.detail_features`` and the two frequencies, rounded.

    Besides the views, ``detail_runs`` are the numbers in order, ``detail_cores`` the
    number of core words and ``detail_frequency`` the weight of the name.
    """
    views = ("ascii_name", "ascii_core", "phonetic_name", "phonetic_core", "ascii_address")
    similar = {v: Similar(a[f"detail_{v}"], t[f"detail_{v}"]) for v in views}
    soft = Alignment(a["detail_ascii_core"], t["detail_ascii_core"])
    runs = Similar(a["detail_runs"], t["detail_runs"])
    sets = Words(a["detail_runs"], t["detail_runs"])
    lists = [[v.split() for v in text] for text in runs.plain.text]
    count = [np.fromiter(map(len, v), np.int64, len(v))[code] for v, code in zip(lists, runs.plain.code, strict=True)]
    ends = [equal(*(mapped(c["detail_runs"], lambda v, k=k: v.split()[k] if v else "") for c in (a, t))) for k in (0, -1)]
    third = np.array([v.startswith("S3") for v in t["entity_id"].to_pylist()], bool)
    given = {f: [c[f].to_numpy().astype(np.float64) for c in (a, t)] for f in ("detail_cores", "detail_frequency")}

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for v, s in similar.items():
            out |= {f"detail_{v}_ratio": s.indel(x, y), f"detail_{v}_sort": s.token_sort(x, y), f"detail_{v}_set": s.token_set(x, y)}
        out |= {f"detail_{v}_partial": similar[v].plain.partial(x, y) for v in ("ascii_name", "ascii_address")}
        out |= {f"detail_soft_{k}": v for k, v in soft.features(x, y).items()}
        p, q = count[0][x], count[1][y]
        two = (p > 0) & (q > 0)
        shared, n, m = sets.shared(x, y)
        out |= {
            "detail_number_sequence_ratio": runs.indel(x, y),
            "detail_number_sorted_ratio": runs.token_sort(x, y),
            "detail_number_first_equal": two & (ends[0][0][x] == ends[0][1][y]),
            "detail_number_last_equal": two & (ends[1][0][x] == ends[1][1][y]),
            "detail_number_left_count": p,
            "detail_number_right_count": q,
            "detail_number_left_only": n - shared,
            "detail_number_right_only": m - shared,
            "detail_number_jaccard": shared / np.maximum(n + m - shared, 1),
            "detail_number_subset": two & ((n == shared) | (m == shared)),
        }
        for k, (side, rows) in enumerate((("left", x), ("right", y))):
            size = {f: similar[f"ascii_{f}"].plain.sizes(x, y)[k] for f in ("name", "address")}
            out |= {f"detail_{side}_name_length": size["name"], f"detail_{side}_address_length": size["address"], f"detail_{side}_core_count": given["detail_cores"][k][rows]}
        out["detail_source3"] = third[y]
        out |= {f"detail_{side}_name_frequency": given["detail_frequency"][k][rows] for k, (side, rows) in enumerate((("left", x), ("right", y)))}
        return {k: rounded(v.astype(np.float64)) for k, v in out.items()}

    return run


#: Weights of words by country up to which a cell lays them out as one table.
DENSE = 1 << 24


class Weights:
    """The weights that words have in countries; a country's own for all other words."""

    def __init__(self, sides: tuple[pa.Table, pa.Table], known: dict[str, int], country: np.ndarray, none: np.ndarray) -> None:
        """``country`` and ``none``: for each anchor the code of its country and the weight of other words there."""
        code = dict(zip(sides[0]["country_norm"].to_pylist(), country.tolist(), strict=True))
        self.n, self.none = max(1, len(known)), np.zeros(int(country.max(initial=0)) + 1)
        self.none[country] = none
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for x in sides:
            c = x["idf"].combine_chunks()
            flat = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c).flatten()
            (w, token), (k, land) = (coded(pa.chunked_array([flat.field(f)])) for f in ("token", "country"))
            of_word = np.array([known.get(v, -1) for v in token], np.int64)[w]
            of_land = np.array([code.get(v, -1) for v in land], np.int64)[k]
            some = (of_word >= 0) & (of_land >= 0)
            keys.append(of_land[some] * self.n + of_word[some])
            values.append(flat.field("v").to_numpy(zero_copy_only=False)[some])
        self.keys, first = np.unique(np.concatenate(keys), return_index=True)
        self.values = np.concatenate(values)[first]
        self.table = None
        if len(self.none) * self.n <= DENSE:
            self.table = np.repeat(self.none, self.n)
            self.table[self.keys] = self.values

    def of(self, country: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = country * self.n + word
        if self.table is not None:
            return self.table[key]
        out = self.none[country]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.values[at[hit]]
        return out


def evidence_features(a: pa.Table, t: pa.Table) -> Measure:
    """The columns of ``features.idf_features`` and ``features.evidence_set_features``, rounded, from records of ``features.with_evidence``."""
    sets = {f: Words(a[f"evidence_{f}"], t[f"evidence_{f}"]) for f in ("name", "core", "address", "address_words", "numbers", "small_numbers", "large_numbers")}
    names = Words(a["name"], t["name"])
    country = equal(a["country_norm"], t["country_norm"])[0]
    weights = Weights((a, t), names.known, country, a["idf_none"].to_numpy())
    frequency = [rounded(x["idf_frequency"].to_numpy()) for x in (a, t)]

    def weighed(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        i, j, c = names.code[0][x], names.code[1][y], country[x]
        n, m = names.size[0][i], names.size[1][j]
        both, left, right, shared, alone = (np.zeros(len(x)) for _ in range(5))
        others = [p[j] for p in names.places[1]]
        met_there = [np.zeros(len(x), bool) for _ in others]
        for at, places in enumerate(names.places[0]):
            own, given = places[i], (at < n) & (n <= FEW)
            v, met = np.where(given, weights.of(c, np.maximum(own, 0)), 0.0), np.zeros(len(x), bool)
            for q, other in enumerate(others):
                same = own == other
                met |= same
                met_there[q] |= same
            hit = np.where(met, v, 0.0)
            both += hit
            left += v
            shared, alone = np.maximum(shared, hit), np.maximum(alone, v - hit)
        for q, other in enumerate(others):
            v = np.where((q < m) & (m <= FEW), weights.of(c, np.maximum(other, 0)), 0.0)
            right += v
            alone = np.maximum(alone, np.where(met_there[q], 0.0, v))
        whole = left + np.maximum(right - both, 0.0)
        for k in np.flatnonzero((n > FEW) | (m > FEW)):
            p, q = names.sets[0][i[k]], names.sets[1][j[k]]
            vp, vb, vo = (weights.of(np.full(len(s), c[k]), np.array(sorted(s), np.int64)) for s in (p, p & q, p ^ q))
            both[k], left[k], whole[k], shared[k], alone[k] = vb.sum(), vp.sum(), vb.sum() + vo.sum(), vb.max(initial=0.0), vo.max(initial=0.0)
        return {"name_idf_jaccard": both / np.maximum(whole, 1e-9), "name_idf_left_coverage": both / np.maximum(left, 1e-9), "name_shared_max_idf": shared, "name_unshared_max_idf": alone}

    def run(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out = {k: rounded(v) for k, v in weighed(x, y).items()} | {"name_anchor_frequency": frequency[0][x], "name_target_frequency": frequency[1][y]}
        for f, words in sets.items():
            shared, n, m = words.shared(x, y)
            out |= {
                f"{f}_intersection": shared,
                f"{f}_left_coverage": rounded(shared / np.maximum(n, 1)),
                f"{f}_right_coverage": rounded(shared / np.maximum(m, 1)),
                f"{f}_conflict": (n > 0) & (m > 0) & (shared == 0),
                f"{f}_left_only": n - shared,
                f"{f}_right_only": m - shared,
            }
        return {k: v.astype(np.float64) for k, v in out.items()}

    return run
