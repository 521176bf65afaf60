"""Packing: ids by the library, pieces whole, sequences gapless and few."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from strata.llm import packing as P
from tests.llm.helpers import ODD, PROSE, documents


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(P.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_ids_are_the_librarys(monkeypatch):
    rng = random.Random(2)
    letters = "abcABC ÀéßΣσς'stİI½٣日本한글🙂\u0301,.!?_-\n\t \u00a0x\u2003\u200b'd'll\x01\x7f"
    texts = [x or "" for x in ODD] + [PROSE] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    want = library_ids(texts)
    for full in (False, True):
        if full:
            monkeypatch.setattr(P, "CACHE_WORDS", 10)
            monkeypatch.setattr(P, "CACHE_PIECES", 10)
        coder = P.WordTokenizer(P.default_tokenizer())
        got = [x for i in range(0, len(texts), 100) for x in coder.encode(texts[i : i + 100])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def check(rows, texts, size):
    want = {i: [*ids, 1] for i, ids in enumerate(library_ids(texts))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, ids in want.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and [r.start for r in pieces] == list(range(0, len(ids), size)) and sum(r.length for r in pieces) == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), math.ceil(sum(map(len, want.values())) / size)


def test_sequences(spark):
    rng = random.Random(5)
    texts = [*ODD[:6], *ODD[7:], PROSE * 3] + [" ".join(rng.choices(PROSE.split(), k=rng.randrange(1, 40))) for _ in range(150)]
    used, least = check(P.pack_documents(documents(spark, texts), size=64).collect(), texts, 64)
    assert used <= least * 1.05 + 1


def test_rests_of_many_nodes_are_merged(spark):
    items = spark.range(500).selectExpr("id as key", "40 + id % 20 as length")
    for node_items in (8, 100, 10_000):
        bins = P.pack(items, 100, 0, node_items).collect()
        assert sorted(m["key"] for b in bins for m in b.members) == list(range(500)) and all(b.length == sum(m["length"] for m in b.members) <= 100 for b in bins)
        # 248 bins hold the sum
        assert len(bins) <= 248 * 1.15 and len({b.sequence_id for b in bins}) == len(bins), node_items


def test_what_cannot_be_joined_ends_the_rounds(spark, monkeypatch):
    sizes, pack = [], P._pack

    def counting(*args):
        sizes.append(args)
        return pack(*args)

    monkeypatch.setattr(P, "_pack", counting)
    bins = P.pack(spark.range(90).selectExpr("id as key", "60L as length"), 100, 0, 10).collect()
    assert len(bins) == 90 == len({b.sequence_id for b in bins}) and len(sizes) == 1
    # two sizes that fit each other but for what nodes of ten items join first: 200 bins hold the sum
    bins = P.pack(spark.range(400).selectExpr("id as key", "if(id % 2 = 0, 60L, 40L) as length"), 100, 0, 10).collect()
    assert len(bins) <= 200 * 1.2 and sum(b.length for b in bins) == 400 * 50


def test_best_fit_fills_gaps():
    assert len(set(P.best_fit(np.array([6, 5, 4, 5, 10, 3, 7]), 10).tolist())) == 4
    assert P.best_fit(np.zeros(0, np.int64), 10).tolist() == []


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string").withColumn("key", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = P.pack_documents(docs).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("3", 1), ("3", 1), ("None", 3)] and len({r.offset for r in got}) == 3
    assert P.pack_documents(documents(spark, [])).count() == 0
