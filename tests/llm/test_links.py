"""The links of the join, not only its components, against brute force."""

import collections
import random

import numpy as np
import pytest

from ringwatch.llm import jaccard


def _cluster(rng, words, first, size, edits):
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = {}
    for i in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[first + i] = " ".join(w[: len(w) - rng.randrange(6)])
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_every_link_of_a_cluster_is_found(spark, monkeypatch, block):
    """A~B, A~C and B~C all count, in one block and in several, and pairs that don't reach the limit don't."""
    rng, words, percent = random.Random(3), 4, 85
    fixture = _cluster(rng, 90, 100, 50, 5) | _cluster(rng, 124, 300, 30, 4) | _cluster(rng, 60, 500, 2, 1) | {1: None, 2: "", 3: "alone here"}
    fixture |= {900: fixture[110], 901: fixture[110]}
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame(list(fixture.items()), "doc_id long, text string")
    sets = {}
    for i, t in fixture.items():
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or (frozenset({tuple(w)}) if w else frozenset())
    least = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    own = sorted({i for i, top in least.items() if i == top and sets[i]})
    want = {(a, b) for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    found = [(r["a"], r["b"]) for r in jaccard.links(df, words, percent).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    degree = collections.Counter(x for pair in want for x in pair)
    rows = jaccard.join(df, words, percent).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (top, degree[top]) for i, top in least.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == {r["doc_id"]: r["component_id"] for r in jaccard.groups(df, words, percent).collect()}


def test_counts_by_columns_are_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    want = [[100 * len(np.intersect1d(a, b)) >= 10 * len(np.union1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    assert jaccard.alike(sets[:25], sets[25:], 10).tolist() == want and 0 < np.sum(want) < 375


def test_near_copies_are_proposed_in_rows_by_their_number(spark):
    """Sets of one signature whose sketches rule nothing out: rows grow with the sets, not with their pairs."""
    size = 60
    rows = spark.range(size).selectExpr("explode(array(5L, 6L)) as sig", "id as doc_id", "id as component")
    rep = spark.range(size).selectExpr("id as doc_id", "100L as n_shingles", "unhex(repeat('0f', 32)) as sketch")
    made = jaccard.proposals(rows, rep, jaccard.Scheme(85)).collect()
    assert sorted((r["a"], r["b"]) for r in made) == [(0, i) for i in range(1, size)]


def test_stars_and_forests_join_what_their_pairs_join():
    rng = np.random.default_rng(4)
    for edges in (1, 30, 90, 2000):
        a, b = rng.integers(0, 120, (2, edges)) * 7
        part = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(120):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                part[x] = part[y] = min(part[x], part[y])
        low, other = jaccard.stars(a, b)
        assert dict(zip(other.tolist(), low.tolist(), strict=True)) == {k: v for k, v in part.items() if k != v}
        ok = np.zeros((840, 840), bool)
        ok[a, b] = ok[b, a] = True
        np.fill_diagonal(ok, False)
        forest = jaccard.spanning(ok)
        assert len(forest) == len(set(part)) - len(set(part.values())) and all(ok[x, y] for x, y in forest)
