"""LM scores against dictionaries of n-grams."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import lm_score as L
from tests.llm.helpers import LOWER, ODD, PROSE, documents, held_out, words


def brute(texts, ids):
    docs = [(i, [*words((t or "").translate(LOWER)), "</s>"]) for i, t in zip(ids, texts)]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in docs:
        if i is not None and not held_out(i):
            one.update(w)
            two.update(zip(["<s>", *w], w))
            three.update(zip(["<s>", *w], w, w[1:]))
    starts = sum(i is not None and not held_out(i) for i, _ in docs)
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for i, w in docs:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for t, u, x in zip([None, "<s>", *w], ["<s>", *w], w):
            p = ((one[x] - d) / n if one[x] else d * v / n) if n else 1.0
            p = (two[u, x] + L.K2 * p) / ((starts if u == "<s>" else one[u]) + L.K2)
            if t is not None:
                p = (three[t, u, x] + L.K3 * p) / (two[t, u] + L.K3)
            score += math.log10(p)
        out.append((i is not None and held_out(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_equals_brute_force(spark, chunk):
    some = PROSE.split()
    texts = [*ODD, *[" ".join(some[i : i + 20]) for i in range(0, 60, 3)], PROSE, PROSE.upper()]
    want = dict(enumerate(brute(texts, range(len(texts)))))
    got = L.score(documents(spark, texts), chunk=chunk).collect()
    assert len(got) == len(texts) and any(r.held_out for r in got)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], abs=1e-8)


def automaton(texts, trained, k2=7.0, k3=2.0):
    """The automaton of a chunk that is its own corpus; ``trained`` texts are counted."""
    tokens, offsets = L.token_hashes(pa.array(texts))
    grams = L.Grams(tokens, offsets, np.arange(len(texts)) < trained)
    c1, c3 = grams.word_counts, grams.entry_counts
    c2 = np.bincount((grams.entries >> np.uint64(32)).astype(np.int64), weights=c3, minlength=len(grams.pairs)).astype(np.int64)
    known = c1[grams.words != L.START]
    return L.Automaton(grams, c1, c2, c3, int(known.sum()), int((known > 0).sum()), 0.4, k2, k3), grams, offsets


def test_weights_of_a_state_sum_to_one():
    """After "a b" every known word, the end and an unknown word are read once."""
    vocabulary = ["a", "b", "c", "d", "e"]
    trained = ["a b c a b d", "a b c e", "b a b a b c", "e d"]
    asked = [f"a b {w}" for w in [*vocabulary, "never"]] + ["a b"]
    made, grams, offsets = automaton(trained + asked, len(trained))
    trace: list = []
    made.traverse(grams, offsets, trace)
    ends = {}
    for k, text in enumerate(asked):
        begin = offsets[len(trained) + k]
        ends[text] = trace[0][begin + 2]
    assert len(set(ends.values())) == 1 and made.fails_to[made.fails_to[ends["a b"]]] == 0 and made.fails_to[ends["a b"]] > 0
    single = [10 ** w for w in token_weights(made, grams, offsets, [len(trained) + k for k in range(len(asked))], 2)]
    assert sum(single) == pytest.approx(1.0)


def token_weights(made, grams, offsets, texts, place):
    """The weight with which one token of each text is read."""
    trace, out = [], []
    made.traverse(grams, offsets, trace)
    for t in texts:
        i = offsets[t] + place
        state, weight = int(trace[0][i]), 0.0
        for arc in (made.triples[grams.entry[i - 1]], made.pairs[grams.pair[i]], made.words[grams.word[i]]):
            if not np.isneginf(arc):
                weight += arc
                break
            weight += made.failure[state] if state else made.unknown
            state = int(made.fails_to[state])
        out.append(weight)
    return out


def test_traversal_carries_the_state_and_takes_failure_arcs():
    """One token after another, by dictionaries of arcs."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", weights=range(1, 9), k=rng.randrange(0, 12))) for _ in range(60)]
    made, grams, offsets = automaton(texts, 40)
    trace: list = []
    got = made.traverse(grams, offsets, trace)
    for t in range(len(texts)):
        state, total = int(made.word_state[grams.before[offsets[t]]]), 0.0
        for i in range(offsets[t], offsets[t + 1]):
            assert trace[0][i] == state
            arcs = {int(made.word_state[grams.before[i]]): made.pairs[grams.pair[i]]} | {0: made.words[grams.word[i]]}
            if i > offsets[t] and made.pair_state[grams.pair[i - 1]] > len(made.c1):
                arcs[int(made.pair_state[grams.pair[i - 1]])] = made.triples[grams.entry[i - 1]]
            while state and np.isneginf(arcs[state]):
                total += made.failure[state]
                state = int(made.fails_to[state])
            total += made.unknown if np.isneginf(arcs[state]) else arcs[state]
            state = int(made.pair_state[grams.pair[i]])
        assert got[t] == pytest.approx(total)


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string").coalesce(1).checkpoint()
    got = L.score(docs).collect()
    want = brute(["a b", "a", "a"], [None, 3, 3])
    assert sorted((str(r.doc_id), r.n_known) for r in got) == sorted((str(i), w[2]) for i, w in zip([None, 3, 3], want))
    assert L.score(documents(spark, [])).count() == 0


def test_messages_round_trip():
    from strata.llm.common import pack, unpack

    for hashes in ([], [0], [2**64 - 1], [1, 5, 2**63, 2**64 - 2]):
        counts = [300 * i + 1 for i in range(len(hashes))]
        got = unpack(pack(np.array(hashes, np.uint64), np.array(counts, np.int64)))
        assert [x.tolist() for x in got] == [hashes, counts]
