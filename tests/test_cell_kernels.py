"""The kernels of a cell work on coded arrays: no text is built, compared or coded anew for a pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.plain import fuzzy as plain
from weftlink.functions import fuzzy
from weftlink.operators import pairwise


def _texts(seed: int, n: int, longest: int) -> list[str]:
    r = random.Random(seed)
    return ["", "a", "a a", *[" ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, longest))) for _ in range(n)]]


def _sides(longest: int) -> tuple[list[str], list[str], pa.ChunkedArray, pa.ChunkedArray, np.ndarray, np.ndarray]:
    a, t = _texts(1, 30, longest), _texts(2, 40, longest)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(t)), indexing="ij"))
    return a, t, pa.chunked_array([a]), pa.chunked_array([t]), x, y


def _refuse(*_):
    raise AssertionError("a text was built for a pair")


@pytest.mark.parametrize("longest", [3, 6, 9, 30])
def test_short_patterns_take_short_words(longest):
    a, t, ca, ct, x, y = _sides(longest)
    texts = pairwise.Texts(ca, ct)
    short = np.flatnonzero(texts.size[0][texts.code[0]] <= 16)
    assert texts.tables(0, texts.code[0][short])[0].dtype == np.uint16
    assert texts.lcs(x, y).tolist() == [plain.lcs(a[i], t[j]) for i, j in zip(x, y, strict=True)]
    assert texts.levenshtein(x, y).tolist() == fuzzy.levenshtein([a[i] for i in x], [t[j] for j in y]).tolist()


def test_word_sets_are_numbered_in_order():
    a, t = pa.chunked_array([["b a b", "", "c"]]), pa.chunked_array([["a  c", "b"]])
    words = pairwise.Words(a, t)
    assert [w for w in words.words.to_pylist() if w] == ["a", "b", "c"]
    assert [v.tolist() for v in words.shared(np.array([0, 1, 2]), np.array([0, 0, 0]))] == [[1, 0, 1], [2, 0, 1], [2, 2, 2]]


@pytest.mark.parametrize("longest", [3, 6, 12])
def test_token_sets_build_no_texts(longest, monkeypatch):
    a, t, ca, ct, x, y = _sides(longest)
    similar = pairwise.Similar(ca, ct)
    if longest <= 6:
        monkeypatch.setattr(pairwise.Similar, "_rests", _refuse)
    assert similar.token_set(x, y) == pytest.approx([plain.token_set(a[i], t[j]) for i, j in zip(x, y, strict=True)], abs=1e-12)


def test_coarse_kernels_build_no_texts(monkeypatch):
    a, t, ca, ct, x, y = _sides(6)
    similar = pairwise.Similar(ca, ct)
    monkeypatch.setattr(pairwise.Similar, "by_text", _refuse)
    assert similar.plain.jaro_winkler(x, y) == pytest.approx([plain.jaro_winkler(a[i], t[j]) for i, j in zip(x, y, strict=True)], abs=1e-12)
    found = similar.weighted(x, y, similar.indel(x, y), similar.token_sort(x, y), similar.token_set(x, y))
    assert found == pytest.approx([plain.weighted(a[i], t[j]) for i, j in zip(x, y, strict=True)], abs=1e-12)


def test_windows_build_no_texts(monkeypatch):
    a, t, ca, ct, x, y = _sides(8)
    similar = pairwise.Similar(ca, ct)
    monkeypatch.setattr(fuzzy, "partial", _refuse)
    assert similar.plain.partial(x, y) == pytest.approx([plain.partial(a[i], t[j]) for i, j in zip(x, y, strict=True)], abs=1e-12)
