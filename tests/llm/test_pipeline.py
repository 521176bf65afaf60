"""The pipeline, stage by stage, against the operators' plain versions."""

import random

from strata.llm import packing
from tests.llm.helpers import LOWER, PROSE, documents, shingles
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import counts
from tests.llm.test_repeat_index import brute as repeats

import corpus_pipeline


def corpus():
    rng, vocabulary = random.Random(9), PROSE.split()
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for _ in range(25):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(20, 150)))
        if rng.random() < 0.3:
            text += "\n" + passage
        out.append(text)
        if rng.random() < 0.4:
            out.append(text.replace("b", "B"))
        if rng.random() < 0.4:
            w = text.split(" ")
            w[3] = "changed"
            out.append(" ".join(w))
    return [*out, None, "", "tiny", "a b c " * 60]


def test_stages_and_run(spark, tmp_path):
    texts = corpus()
    documents(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(enumerate(texts))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        if k == 0:
            kept = {i: t for i, t in kept.items() for c in [counts(t)] if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
        elif k == 1:
            last = {t.translate(LOWER): i for i, t in sorted(kept.items())}
            kept = {i: kept[i] for i in last.values()}
        elif k == 2:
            ids = sorted(kept)
            classes = near([kept[i] for i in ids])
            assert len({classes[ids.index(i)][0] for i in got}) == len(got) == len({c for c, _ in classes.values()})
            kept = {i: kept[i] for i in got}
        else:
            ids = sorted(kept)
            want = repeats([kept[i] for i in ids])
            assert sum(w[1] for w in want) > 0 and {i: len(t.encode()) for i, t in got.items()} == {i: w[0] - w[1] for i, w in zip(ids, want)}
            kept = got
        assert got == kept and (k != 1 or all(shingles(t) for t in got.values()))
    ids = sorted(kept)
    relabel = {d: n for n, d in enumerate(ids)}
    rows = [r for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    from pyspark.sql import Row

    check([Row(**{**r.asDict(), "doc_id": relabel[r.doc_id]}) for r in rows], [kept[i] for i in ids], packing.SEQUENCE)


def test_each_stage_takes_no_rows(spark, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), str(tmp_path)).count() == 0
