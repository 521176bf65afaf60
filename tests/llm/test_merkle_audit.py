"""Merkle audit: damage is found where it is, and nothing else."""

import hashlib

from pyspark.sql import functions as F

from strata.llm import merkle_audit as M

KIND = "file long, seq long, id long, digest string, size long"


def replica(spark, files):
    rows = [(f, i, d, hashlib.sha256(f"{d}:{body}".encode()).hexdigest(), len(body)) for f, records in enumerate(files) for i, (d, body) in enumerate(records)]
    return spark.createDataFrame(rows, KIND)


def statuses(spark, a, b):
    return {(r.file, r.id): r.status for r in M.audit(replica(spark, a), replica(spark, b)).collect()}


def test_changed_missing_added_and_moved(spark):
    a = [[(i, "x" * (i % 7)) for i in range(60)], [(100 + i, "y") for i in range(40)]]
    b = [list(f) for f in a]
    b[0][5] = (5, "q" * 5)
    assert statuses(spark, a, b) == {(f, d): "changed" if d == 5 else "ok" for f, records in enumerate(a) for d, _ in records}
    b[1] = b[1][:30] + b[1][31:] + [(999, "new")]
    got = statuses(spark, a, b)
    assert got.pop((1, 999)) == "added" and got.pop((1, 130)) == "missing" and got.pop((0, 5)) == "changed"
    assert {k for k, v in got.items() if v == "moved"} == {(1, d) for d in range(131, 140)}
    assert set(got.values()) == {"ok", "moved"}


def test_same_replicas_empty_ones_and_null_ids(spark):
    a = [[(None, "x"), (None, "x"), (3, "")]]
    assert [r.status for r in M.audit(replica(spark, a), replica(spark, a)).collect()] == ["ok"] * 3
    assert statuses(spark, [[(1, "x")]], []) == {(0, 1): "missing"}
    assert statuses(spark, [], []) == {}


def test_only_damaged_branches_are_read(spark):
    a = [[(i, "x") for i in range(600)]]
    for change, kinds in ((lambda r: r[:77] + [(77, "z")] + r[78:], {"changed"}), (lambda r: r[:77] + r[78:], {"missing", "moved"}), (lambda r: r[:77] + [(999, "n")] + r[77:], {"added", "moved"})):
        b = [change(a[0])]
        left, right = M.leaves(replica(spark, a)).checkpoint(), M.leaves(replica(spark, b)).checkpoint()
        tree_a, tree_b = M.tree(left), M.tree(right)
        sizes = [t.count() for t in tree_a]
        assert len(sizes) == M.LEVELS and sizes[-1] == 1 and 20 < sizes[0] < 60 and tree_a[-1].first().size == 600
        bad = [r.node for r in M.damaged(tree_a, tree_b).collect()]
        # one range, and the one before it if the record began one
        assert 1 <= len(bad) <= 2
        got = statuses(spark, a, b)
        assert {s for s in got.values() if s != "ok"} == kinds and sum(s not in ("ok", "moved") for s in got.values()) == 1


def test_warc_files_are_written_read_and_audited(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} é\r\n\r\nWARC/1.1</p>" * (i % 5)) for i in range(200)], "page_id long, url string, html string")
    record = M.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    texts = {r.page_id: r.t.encode() for r in pages.select("page_id", record.alias("t")).collect()}
    for name in ("a", "b"):
        M.write_warc(pages.orderBy("page_id").select(record.alias("t"), "page_id"), str(tmp_path / name), F.col("page_id"), files=2)
    a = M.read_warc(spark, str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert b"".join(f.read_bytes() for f in files) == b"".join(texts[i] for i in range(200))
    assert {r.id: r.digest for r in a.collect()} == {f"<urn:page:{i}>": hashlib.sha256(t).hexdigest() for i, t in texts.items()}
    # the copies' names differ by a random part; damage one byte, and cut the last file short
    copies = sorted((tmp_path / "b").glob("part-*"))
    raw = bytearray(copies[0].read_bytes())
    raw[raw.index(b"page 7 ")] ^= 1
    copies[0].write_bytes(raw)
    copies[1].write_bytes(copies[1].read_bytes()[:-30])
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    part = F.substring("file", 6, 5).alias("file")
    narrow = lambda rows: rows.select(part, "seq", "id", "digest", "size")
    found = M.audit(narrow(a), narrow(M.read_warc(spark, str(tmp_path / "b")))).filter("status <> 'ok'").collect()
    assert sorted((r.id or "", r.status) for r in found) == [("", "added"), ("<urn:page:199>", "missing"), ("<urn:page:7>", "changed")]


def test_record_bytes_and_order(spark):
    rows = spark.createDataFrame([(2, None, None), (None, "u", "é"), (1, "u", "")], "page_id long, url string, html string")
    texts = [r[0] for r in rows.select(M.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    assert all(t.startswith("WARC/1.1\r\n") and t.endswith("\r\n\r\n") for t in texts) and "Content-Length: 61\r\n" in texts[1] and "<urn:page:null>" in texts[1]
    assert [(r.page_id, r.number) for r in M.numbered(rows, F.col("page_id").asc_nulls_first()).orderBy("number").collect()] == [(None, 0), (1, 1), (2, 2)]
