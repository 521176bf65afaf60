"""Exact dedup (operator 7): counting quotient filters, then byte verification.

1. One pass over the texts gives each row a 64-bit fingerprint and the SHA-256 of
   its normalised bytes (A-Z lower-cased, null as empty).
2. Each task builds counting quotient filters of its fingerprints, one for each
   range of quotients.  The filters of a range meet in one task, which merges their
   sorted remainders losslessly and adds up the counts.  A hot fingerprint is one
   slot per task, however many rows have it.
3. Only rows whose fingerprint counts above one are read again with their text.
   Within a fingerprint and digest the smallest and the largest text must be the
   same bytes, both taken by partial aggregation, so no group is gathered anywhere.

Of equal texts the row with the largest doc_id stays (nulls are smallest; among
repeated rows with that id exactly one stays).  Texts are compared whole, whatever their
length; two different texts of one fingerprint and one SHA-256 would be an error, not a
group.  An empty table gives an empty result; other columns of the input are not read,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import digest, shards_for, sized, trimmed, without

FILL = 0.75
#: a task's filter is sent on when it holds so many fingerprints
FILTER_ROWS = 1 << 22


class QuotientFilter:
    """A counting quotient filter over fingerprints of ``bits`` bits.

    The high ``q`` bits (the quotient) address 2 ** q buckets, marked in
    ``occupied``; the remainders of a bucket stand sorted in consecutive slots, the
    last of them marked in ``run_ends``; a counter belongs to each slot.
    """

    def __init__(self, q: int, bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counters: np.ndarray):
        self.q, self.bits, self.occupied, self.run_ends, self.remainders, self.counters = q, bits, occupied, run_ends, remainders, counters

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> QuotientFilter:
        """From fingerprints in any order, repeats included."""
        if counts is None:
            prints, counts = np.unique(prints, return_counts=True)
        else:
            prints, at = np.unique(prints, return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(prints)).astype(np.int64)
        return cls.from_sorted(prints, counts, bits)

    @classmethod
    def from_sorted(cls, prints: np.ndarray, counts: np.ndarray, bits: int = 64) -> QuotientFilter:
        """From distinct sorted fingerprints."""
        q = min(bits - 1, max(1, int(np.ceil(np.log2(max(1, len(prints)) / FILL)))))
        r = np.uint64(bits - q)
        quotients = (prints >> r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_ends = np.ones(len(prints), bool)
        run_ends[:-1] = quotients[1:] != quotients[:-1]
        return cls(q, bits, occupied, run_ends, prints & ((np.uint64(1) << r) - np.uint64(1)), counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts: nothing is lost."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        run = np.concatenate([[0], np.cumsum(self.run_ends)[:-1]]).astype(np.int64) if len(self.run_ends) else np.zeros(0, np.int64)
        return (quotients[run] << np.uint64(self.bits - self.q)) | self.remainders, self.counters

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        """One filter of all fingerprints, counts added up: sorted runs are merged two by two, nothing is sorted anew."""
        parts = [x.items() for x in (self, *others)]
        while len(parts) > 1:
            parts = [_merge_sorted(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return QuotientFilter.from_sorted(*parts[0], self.bits)

    def to_bytes(self) -> bytes:
        width = (self.bits - self.q + 7) // 8
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        above = np.flatnonzero(self.counters > 1)
        head = np.array([self.q, self.bits, len(self.remainders), len(above)], "<u4").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.run_ends).tobytes() + packed + above.astype("<u4").tobytes() + self.counters[above].astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        q, bits, n, above = (int(x) for x in np.frombuffer(data, "<u4", 4))
        at = 16
        size = ((1 << q) + 7) // 8
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=1 << q).astype(bool)
        at += size
        size = (n + 7) // 8
        run_ends = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool)
        at += size
        width = (bits - q + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counters = np.ones(n, np.int64)
        counters[np.frombuffer(data, "<u4", above, at)] = np.frombuffer(data, "<u8", above, at + 4 * above)
        return cls(q, bits, occupied, run_ends, wide.view("<u8").ravel().astype(np.uint64), counters)


def _merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted runs of (fingerprint, count); equal ones become one."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    found = at < len(a[0])
    found[found] = a[0][at[found]] == b[0][found]
    counts = a[1].copy()
    counts[at[found]] += b[1][found]
    new = ~found
    return np.insert(a[0], at[new], b[0][new]), np.insert(counts, at[new], b[1][new])


def _normalised(texts):
    import pyarrow as pa
    import pyarrow.compute as pc

    # ascii_lower changes A-Z only
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())


def _digests(with_text: bool):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            normal = _normalised(batch.column(2))
            raw = normal.to_pylist()
            prints = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64))
            digests = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            columns = [batch.column(0), batch.column(1), batch.column(3), prints, digests]
            yield pa.RecordBatch.from_arrays(columns + [normal.cast(pa.binary())] * with_text, ["rid", "doc_id", "digest", "fp", "sha"] + ["body"] * with_text)

    return trimmed(run)


def _filters(shards: int):
    def run(batches):
        import pyarrow as pa

        def sent(held):
            prints = np.concatenate(held)
            shard = (prints >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            order = np.argsort(shard, kind="stable")
            prints, shard = prints[order], shard[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            found = [(int(shard[a]), QuotientFilter.build(prints[a:b]).to_bytes()) for a, b in zip(cuts, [*cuts[1:], len(prints)])]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["shard", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_ROWS:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return trimmed(run)


def _merged(table):
    import pyarrow as pa

    parts = [QuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
    prints, counts = parts[0].merge(*parts[1:]).items()
    many = counts > 1
    return pa.table({"fp": pa.array(prints[many].view(np.int64)), "n": pa.array(counts[many])})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(rid, doc_id, digest, fp, sha[, body]) of every row; rid numbers the rows of the scan."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest(F.col(text)).alias("digest"))
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return rows.mapInArrow(_digests(with_text), f"rid long, doc_id {kind}, digest long, fp long, sha binary" + ", body binary" * with_text)


#: bytes of input whose fingerprints meet in one task
SHARD = 512 << 20


def repeated(prints: DataFrame, shards: int = 1) -> DataFrame:
    """(fp, n) of the fingerprints that the merged filters count above one."""
    filters = prints.select("fp").mapInArrow(_filters(shards), "shard int, filter binary")
    return filters.groupBy("shard").applyInArrow(_merged, "fp long, n long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, digest, doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    rows = fingerprints(docs, doc_id, text).checkpoint()
    again = sized(repeated(rows, shards_for(docs.select(F.col(text)), SHARD)).select("fp"))
    # the bytes of every row that shares a fingerprint; equal when the least and the greatest are
    same = fingerprints(docs, doc_id, text, True).join(again, "fp").groupBy("fp", "sha").agg((F.min("body") == F.max("body")).alias("same"))
    groups = rows.join(again, "fp").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = sized(groups.join(same, ["fp", "sha"]))
    found = rows.join(groups, ["fp", "sha"], "left")
    checked = F.when(F.col("same") == F.lit(False), F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.coalesce("n", F.lit(1)))
    return found.select(
        "rid",
        "digest",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        checked.cast("long").alias("group_size"),
        F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    ``docs`` must give the same rows in the same order each time, as a file scan does, and is found out if it does not.
    """
    return without(docs, dedup(docs, doc_id, text).filter(~F.col("kept")).select("rid", "digest"), text)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "digest")


ORACLE = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
