"""Suffix dedup against all 200-byte strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import repeat_index as R
from tests.llm.helpers import ODD, documents


def brute(texts, match=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + match] for t in raw for i in range(len(t) - match + 1))
    out = []
    for t in raw:
        depth = np.zeros(len(t) + 1, int)
        for i in range(len(t) - match + 1):
            if seen[t[i : i + match]] > 1:
                depth[i] += 1
                depth[i + match] -= 1
        gone = np.cumsum(depth)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_up(seed, n=60):
    rng = np.random.default_rng(seed)
    letters = lambda k: bytes(rng.integers(97, 123, k).astype(np.uint8)).decode()
    base, out = letters(4000), []
    for _ in range(n):
        text = ""
        for _ in range(int(rng.integers(0, 6))):
            at, kind = int(rng.integers(0, 3500)), int(rng.integers(0, 4))
            if kind == 0:
                text += letters(int(rng.integers(1, 400)))
            elif kind == 1:
                text += base[at : at + int(rng.integers(50, 500))]
            elif kind == 2:
                text += str(rng.choice(["a", "ab", "é", "xyzw"])) * int(rng.integers(1, 300))
            else:
                part = list(base[at : at + 400])
                part[int(rng.integers(0, 400))] = "#"
                text += "".join(part)
        out.append(text)
    return out


@pytest.mark.parametrize("options", [{}, {"group": 2}, {"group": 1, "gram": 190}, {"gram": 128}])
def test_equals_brute_force(spark, options):
    texts = made_up(1) + ["a" * 199, "b" * 200, "c" * 201] + ODD
    docs = documents(spark, texts)
    got = R.remove_repeats(docs, chunk=15_000, with_text=False, **options).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(brute(texts)))


def test_index_reports_every_long_match():
    rng, match, gram = np.random.default_rng(0), 20, 6
    width = match - gram
    for _ in range(60):
        n = int(rng.integers(2, 9))
        rows = np.tile(rng.integers(97, 99, 2 * match - gram).astype(np.uint8), (n, 1))
        for r in rows:
            for j in rng.integers(0, 2 * match - gram, 3):
                if not width <= j < width + gram:
                    r[j] = rng.integers(97, 99)
        rows = np.unique(rows, axis=0)
        n = len(rows)
        left, right = np.full(n, width), np.full(n, match)
        got = R.RunLengthIndex(np.zeros(n, int), rows, left, right, match, gram).long_matches()
        for i in range(n):
            at = [d for d in range(width + 1) if any(j != i and (rows[i, width - d : width - d + match] == rows[j, width - d : width - d + match]).all() for j in range(n))]
            assert (got[0][i], got[1][i]) == ((min(at), max(at)) if at else (-1, -1))


def test_runs_do_not_grow_with_copies():
    """A column of a thousand contexts that differ in few bytes is a handful of runs."""
    rng, match, gram = np.random.default_rng(5), 200, 64
    base = rng.integers(97, 123, 2 * match - gram).astype(np.uint8)

    def index(n):
        rows = np.tile(base, (n, 1))
        for r in rows[n // 2 :]:
            r[int(rng.integers(0, match - gram))] = rng.integers(97, 123)
        full = np.full(n, match)
        return R.RunLengthIndex(np.zeros(n, int), rows, np.minimum(full, match - gram), full, match, gram)

    small, large = index(100), index(1000)
    assert large.runs < 1000 * len(large.columns) / 20 and large.runs / small.runs < 1000 / 100
    least, most = large.long_matches()
    assert (least[:500] == 0).all() and (most[:500] == match - gram).all()


@pytest.mark.parametrize("level", range(9))
def test_ranges_of_a_split_cover_every_distance_at_one_width(level):
    ranges = R.spans(level, 200, 64)
    assert {d for low, high in ranges for d in range(low, high + 1)} == set(range(137)) and len({high - low for low, high in ranges}) == 1
    assert len(ranges) <= min(137, 2**level)


def test_rows_repeated_ids_and_clashing_columns(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(260)) + "é"
    rows = [(None, text, 1, "x"), (7, text, 2, "y"), (7, text, 2, "y"), (8, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, kept_text string").coalesce(1).checkpoint()
    kept = R.keep_unrepeated(docs, chunk=300)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "", 1, "x"), (7, "", 2, "y"), (7, "", 2, "y"), (8, "", None, None)], key=str)


def test_empty_table(spark):
    assert R.remove_repeats(documents(spark, [])).count() == 0
