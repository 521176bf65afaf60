"""Exact dedup against a dictionary; quotient filters against counters."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import exact_dedup as E
from tests.llm.helpers import LOWER, ODD, documents

TEXTS = [*ODD, "Same", "sAME", "same", "É", "é", *ODD, "x" * 70_000 + "y"]


def test_equals_brute_force(spark):
    got = E.dedup(documents(spark, TEXTS)).collect()
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(TEXTS)
    for r in got:
        text = (TEXTS[r.doc_id] or "").translate(LOWER)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(groups[text]), len(groups[text]), r.doc_id == max(groups[text]), hashlib.sha256(text.encode()).hexdigest())


def test_repeated_and_null_ids_keep_one_row(spark):
    docs = spark.createDataFrame([(5, "a", 1), (5, "A", 2), (None, "a", 3), (None, "b", 4), (None, "b", 5)], "doc_id long, text string, _rid long").coalesce(1).checkpoint()
    kept = E.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.text).lower() for r in kept.collect()) == ["a", "b"]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in E.dedup(docs).collect()} == {(5, 5, 3), (None, 5, 3), (None, None, 2)}


def test_shuffled_when_too_many_to_broadcast(spark, monkeypatch):
    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in joins(E.dedup(documents(spark, TEXTS)))
    monkeypatch.setattr("strata.llm.common.BROADCAST_BYTES", 0)
    assert "broadcast" not in joins(E.dedup(documents(spark, TEXTS)))
    assert E.dedup(documents(spark, TEXTS)).filter("kept").count() == len({(t or "").translate(LOWER) for t in TEXTS})


def test_input_in_another_order_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from strata.llm.common import digest, without

    docs = documents(spark, ["a", "b", "c"], slices=1)
    gone = docs.select(F.monotonically_increasing_id().alias("rid"), digest(F.col("text")).alias("digest")).filter("rid = 1")
    assert [r.text for r in without(docs, gone).collect()] == ["a", "c"]
    with pytest.raises(Exception, match="same rows twice"):
        without(docs.orderBy(F.desc("doc_id")).coalesce(1).checkpoint(), gone.withColumn("digest", F.lit(5).cast("long"))).collect()


def test_empty_table(spark):
    assert E.dedup(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5) | st.integers(2**63, 2**63 + 5), max_size=60), min_size=1, max_size=4))
def test_filters_lose_nothing(parts):
    filters = [E.QuotientFilter.from_bytes(E.QuotientFilter.build(np.array(p, np.uint64)).to_bytes()) for p in parts]
    prints, counts = filters[0].merge(*filters[1:]).items()
    assert dict(zip(prints.tolist(), counts.tolist())) == Counter(x for p in parts for x in p)
    assert (np.diff(prints.astype(object)) > 0).all()
