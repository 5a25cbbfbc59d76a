"""The index against full multiplication, document at a time and block at a time."""

import numpy as np
import pytest

from foliolith.llm import blockmax as B


def case(seed, n_terms=50, n_items=73):
    r = np.random.default_rng(seed)
    full = r.random((n_terms, n_items)) * (r.random((n_terms, n_items)) < 0.2)
    term, item = np.nonzero(full)
    queries = r.random((30, n_terms)) * (r.random((30, n_terms)) < 0.3)
    queries[7] = 0
    owner, terms = np.nonzero(queries)
    return full, B.BlockMaxIndex(term, item, full[term, item], n_terms, n_items), queries @ full, (owner, terms, queries[owner, terms].astype(np.float32))


@pytest.mark.parametrize("way", ["pivots", "blocks"])
@pytest.mark.parametrize("seed", range(4))
def test_finds_all_above_the_threshold(seed, way, monkeypatch):
    monkeypatch.setattr(B, "CELLS", 500)
    monkeypatch.setattr(B, "POINTERS", 60)
    _, index, score, terms = case(seed)
    q, i, s = getattr(index, way)(*terms, 30, 0.8)
    assert set(zip(q.tolist(), i.tolist(), strict=True)) >= {(a, b) for a, b in zip(*np.nonzero(score >= 0.8), strict=True)}
    assert len(set(zip(q.tolist(), i.tolist(), strict=True))) == len(q)
    assert np.allclose(s, score[q, i], rtol=1e-3) and (score[q, i] > 0.79).all()


@pytest.mark.parametrize("seed", range(4))
def test_nearest(seed):
    _, index, score, terms = case(seed)
    q, i, s = index.nearest(*terms, 30, 0.3, 5)
    for k in range(30):
        want = np.sort(score[k][score[k] >= 0.3])[::-1][:5]
        assert np.allclose(np.sort(s[q == k])[::-1], want, rtol=1e-3)


def test_memory_follows_the_postings():
    r = np.random.default_rng(0)
    sizes = []
    for n in (2_000, 20_000):
        item = np.repeat(np.arange(n), 20)
        pairs = np.unique(np.column_stack([r.integers(0, n, len(item)), item]), axis=0)
        index = B.BlockMaxIndex(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), n, n)
        sizes.append(index.nbytes() / len(pairs))
    assert sizes[1] < 1.1 * sizes[0] < 60


@pytest.mark.parametrize("seed", range(3))
def test_bits_find_what_a_search_finds(seed, monkeypatch):
    _, bits, _, terms = case(seed, 40, 400)
    monkeypatch.setattr(B, "SPARSE", 0)
    _, search, _, _ = case(seed, 40, 400)
    assert bits.bits is not None and search.bits is None
    key = np.arange(40 * bits.n_blocks)
    (at, there), (at2, there2) = bits._found(key), search._found(key)
    assert there.tolist() == there2.tolist() and at[there].tolist() == at2[there].tolist()
    for way in ("pivots", "blocks"):
        assert [x.tolist() for x in getattr(bits, way)(*terms, 30, 0.8)] == [x.tolist() for x in getattr(search, way)(*terms, 30, 0.8)]


def test_repeated_terms_count_once():
    _, index, score, (owner, terms, weight) = case(1)
    twice = np.concatenate([owner, owner]), np.concatenate([terms, terms]), np.concatenate([weight, weight])
    assert [x.tolist() for x in index.blocks(*twice, 30, 0.8)] == [x.tolist() for x in index.blocks(owner, terms, weight, 30, 0.8)]


@pytest.mark.parametrize("way", ["pivots", "blocks"])
def test_empty_index(way):
    none = np.zeros(0, np.int64)
    for terms in (none, np.zeros(3, np.int64)):
        q, i, s = getattr(B.BlockMaxIndex(none, none, np.zeros(0), 1, 0), way)(terms, terms, None, 1, 1.0)
        assert len(q) == len(i) == len(s) == 0
