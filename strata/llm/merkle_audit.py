"""Merkle fixity audit of WARC replicas (operator 3).

A replica is a set of files of records in order.  Each record is a leaf: the SHA-256
of its bytes, its id and its length.  An inner node is an ordered range of the file: it
hashes its children in order and carries the sum of their lengths, so where a range lies
is the sum of what is before it and not part of its hash.  Ranges begin at records whose
id's hash has enough zero digits (base sixteen), one digit for each level, and are named
after the record they begin with.  A lost or added record therefore changes the one
branch it was in: the next range begins at the same record in both replicas, and the
records after it have moved by one and the same distance.

The roots of each file's replicas are compared and only the children of nodes that differ
are looked at on the way down, so a sound file costs one comparison.  In the damaged
branches records are matched by id, which tells a changed record from a missing, an added
and a moved one (same bytes, other offsets); in a sound branch all records share its fate.

Bytes are hashed where they are read; everything after that is narrow rows keyed by
(file, node).  A file has at most ``FILE_RECORDS`` records, so no key is hot.

Defined results: a null id is written as ``null`` and sorts first; a null url or html
is empty; records that share an id are told apart by their order in the file; records are
hashed whole, however long; an empty replica makes every record of the other one missing,
two empty ones give an empty result; other columns of the input are not read, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 16
FILE_RECORDS = 4096
#: levels above the leaves: FANOUT ** LEVELS == FILE_RECORDS
LEVELS = 3


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC/1.1 response record."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(html, F.lit("")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``number``, 0, 1, ... in the given order, without passing all through one task.

    A range partitioning sorts; each partition's number of rows, one row a partition,
    is summed up and added to the place within it.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    # as many rows as partitions: a bound by the plan, not by the data
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def leaves(replica: DataFrame) -> DataFrame:
    """(file, seq, id, digest, size) records with offset range, rank among equal ids, leaf hash, and the range of each level they are in."""
    order = Window.partitionBy("file").orderBy("seq")
    out = replica.withColumns({"leaf": (F.row_number().over(order) - 1).cast("long"), "stop": F.sum("size").over(order), "rank": F.row_number().over(Window.partitionBy("file", "id").orderBy("seq"))})
    own = F.concat_ws("#", F.coalesce(F.col("id").cast("string"), F.lit("null")), "rank")
    out = out.withColumns({"start": F.col("stop") - F.col("size"), "node0": own, "hash": F.sha2(F.concat_ws(":", own, "digest", "size"), 256)})
    begins = F.xxhash64("id", "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({f"node{k}": F.coalesce(F.last(F.when(F.pmod(begins, F.lit(FANOUT**k)) == 0, own), ignorenulls=True).over(upto), F.lit("")) for k in range(1, LEVELS)})


def tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels from the lowest ranges to the roots: (file, node, parent, hash, start, size); start is where the range lies."""
    levels = [leaf_rows.select("file", "leaf", *[f"node{k}" for k in range(1, LEVELS)], "hash", "start", "size")]
    for k in range(1, LEVELS + 1):
        keys = ["file", *[f"node{j}" for j in range(k, LEVELS)]]
        children = F.transform(F.array_sort(F.collect_list(F.struct("leaf", "hash"))), lambda c: c["hash"])
        levels.append(levels[-1].groupBy(*keys).agg(F.min("leaf").alias("leaf"), F.sha2(F.concat_ws("", children), 256).alias("hash"), F.min("start").alias("start"), F.sum("size").alias("size")))
    out = []
    for k, level in enumerate(levels[1:], 1):
        name = lambda j: F.col(f"node{j}") if j < LEVELS else F.lit("")
        out.append(level.select("file", name(k).alias("node"), name(k + 1).alias("parent"), "hash", "start", "size").checkpoint())
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) at which two replicas' levels differ, or that only one has."""
    both = a.select("file", "node", F.col("hash").alias("hash_a")).join(b.select("file", "node", F.col("hash").alias("hash_b")), ["file", "node"], "full")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node")


def damaged(tree_a: list[DataFrame], tree_b: list[DataFrame]) -> DataFrame:
    """(file, node) of the lowest ranges that differ: descend from the roots, through differing nodes only."""
    found = differing(tree_a[-1], tree_b[-1]).checkpoint()
    for a, b in zip(tree_a[-2::-1], tree_b[-2::-1]):
        parents = found.withColumnRenamed("node", "parent")
        a, b = (x.join(parents, ["file", "parent"], "left_semi") for x in (a, b))
        found = differing(a, b).checkpoint()
    return found


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of ``a``, and those only ``b`` has, with what became of it.

    Both have (file, seq, id, digest, size).  Gives file, start and stop (in ``a``, or
    in ``b`` for an added record), id, digest, replica_digest and status: ok, changed,
    missing, added or moved.
    """
    leaves_a, leaves_b = leaves(a).checkpoint(), leaves(b).checkpoint()
    tree_a, tree_b = tree(leaves_a), tree(leaves_b)
    bad = damaged(tree_a, tree_b).withColumnRenamed("node", "node1")
    side_a, side_b = (x.join(bad, ["file", "node1"], "left_semi") for x in (leaves_a, leaves_b))
    pairs = side_a.alias("a").join(side_b.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.node0") == F.col("b.node0")), "full")
    status = (
        F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "added").when(F.col("a.digest") != F.col("b.digest"), "changed")
        .when(F.col("a.start") != F.col("b.start"), "moved").otherwise("ok")
    )
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    hit = pairs.select(pick("file"), pick("start"), pick("stop"), pick("id"), F.col("a.digest").alias("digest"), F.col("b.digest").alias("replica_digest"), status.alias("status"))
    # a range that is sound lies where it lay, or all of it has moved
    moved = tree_a[0].select("file", F.col("node").alias("node1"), F.col("start").alias("_a")).join(tree_b[0].select("file", F.col("node").alias("node1"), F.col("start").alias("_b")), ["file", "node1"]).join(bad, ["file", "node1"], "left_anti")
    sound = leaves_a.join(moved, ["file", "node1"]).select("file", "start", "stop", "id", "digest", F.col("digest").alias("replica_digest"), F.when(F.col("_a") == F.col("_b"), "ok").otherwise("moved").alias("status"))
    return sound.unionByName(hit)


def write_warc(records: DataFrame, path: str, *order: Column, files: int | None = None) -> None:
    """Write the one text column of ``records`` as WARC files, in the given order; each record ends with its blank lines."""
    rows = records.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    name = records.columns[0]
    # the writer ends every row with a line feed, which is the record's last byte
    rows.select(F.expr(f"substring(`{name}`, 1, length(`{name}`) - 1)").alias("value")).write.option("lineSep", "\n").text(path)


RECORDS = "file string, seq long, id string, digest string, size long, start long, stop long"


def read_warc(spark, path: str) -> DataFrame:
    """The records of plain WARC files, hashed where they are read; ``file`` is the name without its folder.

    A file is read by one task, as its records can only be found one after another.  A
    file that ends inside a record, or has no record where one should begin, gives what
    is left of it as one last record without id.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(_records, RECORDS)


def _records(batches):
    import hashlib
    import re

    import pyarrow as pa

    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, rows = 0, []
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                head = data[at:end] if end >= 0 and data.startswith(b"WARC/", at) else b""
                length, found = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", head), re.search(rb"(?im)^WARC-Record-ID:\s*(\S+)\s*$", head)
                stop = end + 4 + int(length[1]) + 4 if length else len(data)
                if stop > len(data):
                    stop, found = len(data), None
                rows.append((name, len(rows), found[1].decode() if found and length else None, hashlib.sha256(data[at:stop]).hexdigest(), stop - at, at, stop))
                at = stop
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["file", "seq", "id", "digest", "size", "start", "stop"])


#: the replica that the query audits: records with these remainders of their id are damaged
CHANGED, LOST, SPAN = 17, 101, 499


def op3_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """Audit a replica of all pages in which one record in 499 has a changed byte and one is lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rest = F.pmod("page_id", F.lit(SPAN))
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    copy = warc_record(F.col("page_id"), F.col("url"), F.when(rest == CHANGED, F.overlay("html", F.lit("#"), F.lit(1))).otherwise(F.col("html")))
    narrow = pages.select(
        F.col("page_id").alias("id"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("size"),
        F.sha2(copy, 256).alias("copy_digest"), F.octet_length(copy).cast("long").alias("copy_size"), (rest == LOST).alias("lost"),
    )
    rows = numbered(narrow, F.col("id").asc_nulls_first(), F.col("digest").asc()).withColumns({"file": F.floor(F.col("number") / FILE_RECORDS), "seq": F.col("number") % FILE_RECORDS}).checkpoint()
    replica = rows.filter(~F.coalesce("lost", F.lit(False))).select("file", "seq", "id", F.col("copy_digest").alias("digest"), F.col("copy_size").alias("size"))
    found = audit(rows.select("file", "seq", "id", "digest", "size"), replica)
    return found.select(F.col("id").alias("page_id"), "file", "start", "stop", "digest", "replica_digest", "status")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, page_id % 499 = 17 AS changed, page_id % 499 = 101 AS lost FROM pages),
b AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || repeat(chr(13) || chr(10), 2) AS head, CASE WHEN changed THEN '#' || substr(h, 2) ELSE h END AS h2 FROM p),
r AS (SELECT page_id, changed, lost,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' AS top,
  head || h AS body, head || h2 AS body2, repeat(chr(13) || chr(10), 2) AS gap FROM b),
x AS (SELECT page_id, changed, lost, top || strlen(body) || gap || body || gap AS rec, top || strlen(body2) || gap || body2 || gap AS rec2 FROM r),
d AS (SELECT page_id, lost, sha256(rec) AS digest, sha256(rec2) AS digest2, strlen(rec) AS size, strlen(rec2) AS size2, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256(rec)) - 1 AS number FROM x),
o AS (SELECT *, number // 4096 AS file, sum(size) OVER w AS stop, sum(CASE WHEN lost THEN 0 ELSE size2 END) OVER w AS stop2 FROM d WINDOW w AS (PARTITION BY number // 4096 ORDER BY number))
SELECT page_id, file::BIGINT AS file, (stop - size)::BIGINT AS start, stop::BIGINT AS stop, digest, CASE WHEN NOT lost THEN digest2 END AS replica_digest,
  CASE WHEN lost THEN 'missing' WHEN digest <> digest2 THEN 'changed' WHEN stop <> stop2 THEN 'moved' ELSE 'ok' END AS status FROM o
"""
