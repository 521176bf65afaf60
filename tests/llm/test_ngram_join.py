"""Near duplicates against all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest

from strata.llm import ngram_join as N
from strata.llm.components import components
from tests.llm.helpers import ODD, PROSE, documents, shingles


def texts(seed=3):
    rng, vocabulary, out = random.Random(seed), PROSE.split(), []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(60, 200))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out + [out[0], out[0].upper(), out[5]] + ODD


def brute(some):
    sets = [shingles(t) for t in some]
    links, label = [0] * len(some), list(range(len(some)))
    for a, b in combinations(range(len(some)), 2):
        both = len(sets[a] & sets[b])
        if both and 10 * both >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return {i: (label[i], links[i]) for i in range(len(some))}


@pytest.mark.parametrize("options", [{}, {"part": 4 * N.LEAST}, {"part": N.LEAST}])
def test_equals_all_pairs(spark, options):
    some = texts()
    got = N.near_duplicates(documents(spark, some), **options).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(some)


def test_large_parts_use_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 1)
    some = texts(4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in N.near_duplicates(documents(spark, some)).collect()} == brute(some)


@pytest.mark.parametrize("small", [48, 1])
def test_a_pair_at_the_threshold_is_a_link_on_both_ways(spark, monkeypatch, small):
    """36 + 4 shingles against 36 + 5: 36 of 45 are shared, exactly four fifths."""
    monkeypatch.setattr(N, "SMALL", small)
    w = [f"w{i}" for i in range(60)]
    a, b = w[:40] + ["x1", "x2", "x3", "x4"], w[:40] + [f"y{i}" for i in range(5)]
    assert (len(shingles(" ".join(a))), len(shingles(" ".join(b))), len(shingles(" ".join(a)) & shingles(" ".join(b)))) == (40, 41, 36)
    got = N.near_duplicates(documents(spark, [" ".join(a), " ".join(b), " ".join(w[:40] + [f"z{i}" for i in range(6)])]), recall=1 - 1e-12).collect()
    assert {r.doc_id: r.n_links for r in got} == {0: 1, 1: 1, 2: 0}


def test_recall_on_a_real_table(spark):
    """Every pair of sf0.001 at or above the threshold, by postings of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(some)
    want = brute([some[i] for i in ids])
    got = {r.doc_id: r.n_links for r in N.near_duplicates(docs).collect()}
    found, there = sum(got.values()), sum(n for _, n in want.values())
    assert there and found / there >= 0.999 and all(got[i] <= want[k][1] for k, i in enumerate(ids))


def test_keeps_one_of_each_class_with_all_columns(spark):
    some = texts()
    docs = documents(spark, some).withColumnRenamed("lang", "_rid")
    kept = N.keep_one(docs)
    want = brute(some)
    empty = {i for i, t in enumerate(some) if not shingles(t)}
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert empty <= ids and sorted(want[i][0] for i in ids - empty) == sorted({want[i][0] for i in range(len(some)) if i not in empty})


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, PROSE), (4, PROSE), (4, PROSE), (None, None)], "doc_id long, text string").coalesce(1).checkpoint()
    got = sorted(map(tuple, N.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (None, None, 0)], key=str)


def test_different_texts_under_null_and_repeated_ids_stay(spark):
    some = texts()
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(some))]
    docs = documents(spark, some, ids)
    want = brute(some)
    empty = sum(not shingles(t) for t in some)
    classes = {want[k][0] for k, t in enumerate(some) if shingles(t)}
    kept = [r.text for r in N.keep_one(docs).collect()]
    first = {t: want[k][0] for k, t in enumerate(some) if shingles(t)}
    assert len(kept) == len(classes) + empty and {first[t] for t in kept if t in first} == classes
    rows = N.near_duplicates(docs).select("component").collect()
    assert sorted(Counter(r.component for r in rows).values()) == sorted(Counter(label for label, _ in want.values()).values())


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    assert N.keep_one(documents(spark, [])).count() == 0


def test_bands_reach_the_target():
    b = N.bands_for(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(100, 101), (7, 7)], "u long, v long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
