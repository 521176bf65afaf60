"""Quality rules by their wording; host verdicts by their formula."""

from collections import Counter

from strata.llm import quality_rules as Q
from tests.llm.helpers import ODD, PROSE, documents, words


def counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


TEXTS = [*ODD, PROSE, PROSE + " " + PROSE, "a b c a b c a b c", "a b c x a b c", "a a a a a", "x y\nx y\n \n\nx y", "#*$%&|<> é#" * 9, "word " * 20_000, PROSE + "\n" + PROSE]


def test_counts_equal_brute_force(spark):
    got = Q.count_rules(documents(spark, TEXTS).withColumnRenamed("lang", "kept")).collect()
    for r in got:
        want = counts(TEXTS[r.doc_id])
        assert tuple(r[c] for c in Q.COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts_that_fail_are_rejected_whole(spark):
    texts = [PROSE] * 40 + ["short"] * 39 + [PROSE] + ["short", PROSE]
    sources = ["good"] * 40 + ["bad"] * 40 + [None] * 2
    docs = documents(spark, texts, sources=sources)
    judged = Q.count_rules(docs)
    hosts = {r.host: r for r in Q.host_verdicts(judged).collect()}
    assert not hosts["good"].host_failed and hosts["bad"].host_failed and not hosts[None].host_failed
    assert hosts["bad"].failed / hosts["bad"].n > hosts["bad"].rate > hosts[None].rate > hosts["good"].rate > 0
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == {*range(40), 81}
    assert {r.doc_id for r in Q.with_verdicts(judged).filter("kept").collect()} == {*range(40), 81}


def test_the_bar_follows_the_prior(spark):
    """Twenty even hosts make a narrow prior; one that fails three times as often is rejected, documents that pass included."""
    texts, sources = [], []
    for h in range(21):
        bad = 30 if h == 20 else 9 + h % 3
        texts += ["short"] * bad + [PROSE] * (100 - bad)
        sources += [f"h{h}"] * 100
    judged = Q.count_rules(documents(spark, texts, sources=sources)).checkpoint()
    hosts = {r.host: r for r in Q.host_verdicts(judged).collect()}
    assert [h for h, r in hosts.items() if r.host_failed] == ["h20"] and 0.1 < hosts["h0"].bar < hosts["h20"].rate < 0.3
    kept = Q.with_verdicts(judged).filter("kept")
    assert kept.filter("source = 'h20'").count() == 0 and kept.count() == 20 * 100 - sum(9 + h % 3 for h in range(20))


def test_clashing_columns_are_kept(spark):
    docs = documents(spark, TEXTS[:3]).selectExpr("*", "1 as _c", "2 as _host", "3 as host_failed", "4 as host", "5 as _host_failed", "6 as n_words", "7 as rate", "8 as _told")
    got = Q.with_verdicts(Q.count_rules(docs))
    assert [got.first()[c] for c in ("_c", "_host", "host_failed", "host", "_host_failed", "rate")] == [1, 2, 3, 4, 5, 7] and got.columns.count("n_words") == 1
    assert Q.keep_good(docs.withColumn("text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(PROSE))).columns == docs.columns


def test_all_columns_stay_and_no_rows(spark):
    docs = documents(spark, TEXTS).withColumnRenamed("lang", "_rid").withColumnRenamed("n_chars", "base_failed")
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.keep_good(documents(spark, [])).count() == 0 and Q.with_verdicts(Q.count_rules(documents(spark, []))).count() == 0
