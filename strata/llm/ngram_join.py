"""N-gram Jaccard join by MinHash banding (operator 2).

Texts are sets of five-word shingles (words between white space, A-Z lower-cased; a
text of one to four words is one shingle).  Rows with the same set are one class and
only a representative goes on.  Bands and rows are chosen for a target recall at the
threshold; a pair of representatives is a candidate if it shares a band's hash, and
every candidate is verified on the full sets by one integer comparison.

Candidates meet without being written out.  Each member of a bucket is linked to the
bucket's least one, and the connected parts of these links hold every candidate, so the
texts of a part come together once.  Parts chain: one of more than ``PART`` shingles is
dealt by its buckets instead, where a pair is counted in the first bucket it shares, and
a bucket beyond that size by pairs of its blocks.  So a text is copied at most once a
band, or once a block of its own bucket, and no task holds more than two blocks.  Shared
shingles are counted over postings, or as a product of incidence matrices in which
shingles with the same postings are one weighted column; both give the same integers.

Defined results: a null text, or one without words, has no shingles, no links and a
class of its own; repeated rows are links of similarity one; a pair exactly at the
threshold is a link; a null id is the class's id only when all its ids are null; texts
are read whole; an empty table gives an empty result; other columns of the input are not
read, so their names cannot clash.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import LOWER, blocks, digest, mix, prefix_sums, shards_for, sized, span_hashes, string_buffer, trimmed, without, words
from strata.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
#: shingles that are verified together, a text counting as ``LEAST`` at least; larger parts go by their buckets and blocks
PART, LEAST = 1 << 20, 512
#: up to so many texts' shared shingles are counted over postings, those of more as matrices
SMALL = 48
#: bytes of input whose small parts meet in one task
SHARD = 16 << 20


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair at the threshold with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of an Arrow array, sorted, and their offsets."""
    parts = [_block_shingles(texts.slice(start, stop - start), n) for start, stop in blocks(texts)]
    lengths = np.concatenate([np.zeros(1, np.int64), *(np.diff(o) for _, o in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in parts)]), np.cumsum(lengths)


def _block_shingles(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_buffer(texts)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets)
    found = span_hashes(prefix_sums(data), starts, ends)
    counts = np.diff(firsts)
    sizes = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.repeat(firsts[:-1], sizes) + np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    padded = np.concatenate([found, np.zeros(n, np.uint64)])
    out = np.zeros(len(doc), np.uint64)
    left = np.repeat(firsts[1:], sizes) - at  # words of the text from here on
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + np.where(left > k, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(counts) + 1))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts with shingles, bands) hashes of the bands' minima."""
    firsts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(firsts), bands), np.uint64)
    if len(firsts):
        by = _multipliers(bands * rows)
        for b in range(bands):
            band = np.full(len(firsts), np.uint64(b + 1))
            for a in by[b * rows : (b + 1) * rows]:
                band = mix(band + np.minimum.reduceat(grams * a, firsts))
            out[:, b] = band
    return out


def _signed(texts_at: int, bands: int, rows: int, n: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(texts_at)
            for start, stop in blocks(texts):
                grams, offsets = shingles(texts.slice(start, stop - start), n)
                sizes = np.diff(offsets)
                some = sizes > 0
                keys = np.zeros((2, len(sizes)), np.uint64)
                if some.any():
                    firsts = offsets[:-1][some]
                    keys[0, some] = np.add.reduceat(mix(grams), firsts)
                    keys[1, some] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5DEADBEEF)), firsts)
                signs = np.zeros((len(sizes), bands), np.uint64)
                signs[some] = band_hashes(grams, offsets, bands, rows)
                flat = pa.array(signs.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in range(texts_at)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)],
                    ["rid", "doc_id", "digest", "k1", "k2", "n", "bands"],
                )

    return trimmed(run)


def _pairs_of_postings(part: np.ndarray, gram: np.ndarray, row: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that share shingles within a part, and how many: (a, b, shared), a < b."""
    order = np.lexsort((row, gram, part))
    part, gram, row = part[order], gram[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (part[1:] != part[:-1]) | (gram[1:] != gram[:-1])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(row)))
    keys = []
    for d in range(1, int(lengths.max(initial=1))):
        # pairs d places apart in the same posting list
        at = np.repeat(starts[lengths > d], lengths[lengths > d] - d)
        within = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(lengths[lengths > d] - d)[:-1]]), lengths[lengths > d] - d)
        a = at + within
        keys.append(row[a].astype(np.int64) * m + row[a + d])
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    pairs, shared = np.unique(np.concatenate(keys), return_counts=True)
    return pairs // m, pairs % m, shared


def _shared_matrix(gram: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """m x m exact numbers of shared shingles; shingles with the same rows count as one column with a weight."""
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    lengths = np.diff(np.append(starts, len(gram)))
    marks = np.random.default_rng(11).integers(1, 2**63, m, dtype=np.uint64)
    pattern = np.add.reduceat(marks[row], starts)
    _, pick, weight = np.unique(pattern, return_index=True, return_counts=True)
    many = lengths[pick] > 1
    pick, weight = pick[many], weight[many]
    kind = np.float32 if len(gram) < 1 << 24 else np.float64  # integers below are exact
    out = np.zeros((m, m), kind)
    for at in range(0, len(pick), 2048):
        some, w = pick[at : at + 2048], weight[at : at + 2048]
        column = np.repeat(np.arange(len(some)), lengths[some])
        place = np.repeat(starts[some], lengths[some]) + np.arange(len(column)) - np.repeat(np.concatenate([[0], np.cumsum(lengths[some])[:-1]]), lengths[some])
        x = np.zeros((m, len(some)), kind)
        x[row[place], column] = 1
        out += (x * w.astype(kind)) @ x.T
    return out


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row connected with each row."""
    label = np.arange(m)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def linked(a: np.ndarray, b: np.ndarray, shared: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether shared / union >= threshold, in integers."""
    ratio = Fraction(threshold).limit_denominator(10_000)
    shared = shared.astype(np.int64)
    return shared * ratio.denominator >= (sizes[a] + sizes[b] - shared) * ratio.numerator


def candidates(bands: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs whose first common band is the one of their unit; any common band will do where that is -1."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        some = slice(at, at + (1 << 16))
        same = bands[a[some]] == bands[b[some]]
        out[some] = same.any(axis=1) & ((first[some] < 0) | (same.argmax(axis=1) == first[some]))
    return out


def _verify(threshold: float, n: int, width: int):
    """Verify the candidates of the units of one task: links and least linked row of each text."""

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        grams, offsets = shingles(table.column("text"), n)
        sizes = np.diff(offsets)
        m = len(sizes)
        row = np.repeat(np.arange(m), sizes)
        rid, members = table.column("rid").to_numpy(), table.column("members").to_numpy()
        own, other = table.column("own").to_numpy(), table.column("other").to_numpy()  # the text's block, the block it meets
        band = table.column("place").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(m, width)
        keys = np.stack([table.column(c).to_numpy() for c in ("unit", "place", "low", "high")])
        _, unit = np.unique(keys, axis=1, return_inverse=True)
        unit = unit.ravel()
        count = np.bincount(unit)
        small = count[unit] <= SMALL
        at = small[row]
        a, b, shared = _pairs_of_postings(unit[row[at]], grams[at], row[at], m)
        hit = linked(a, b, shared, sizes, threshold)
        found = [(a[hit], b[hit])]
        order = np.argsort(unit, kind="stable")
        starts = np.concatenate([[0], np.cumsum(count)])
        for u in np.flatnonzero(count > SMALL):
            rows = np.sort(order[starts[u] : starts[u + 1]])
            gram = np.concatenate([grams[offsets[r] : offsets[r + 1]] for r in rows])
            shared = _shared_matrix(gram, np.repeat(np.arange(len(rows)), sizes[rows]), len(rows))
            a, b = np.nonzero(np.triu(linked(rows[:, None], rows[None, :], shared, sizes, threshold), 1))
            found.append((rows[a], rows[b]))
        a, b = (np.concatenate([x[k] for x in found]) for k in range(2))
        # blocks of one unit meet in several tasks: pairs within a block count where the block meets itself
        once = ~((own[a] == own[b]) & (own[a] != other[a]))
        a, b = a[once], b[once]
        hit = candidates(bands, a, b, band[a])
        a, b = a[hit], b[hit]
        links = np.bincount(a, weights=members[b], minlength=m) + np.bincount(b, weights=members[a], minlength=m)
        return pa.table({"rid": pa.array(rid), "links": pa.array(links.astype(np.int64)), "root": pa.array(rid[_roots(m, a, b)])})

    return trimmed(run)


def dealt(parts: DataFrame, classes: DataFrame, reps: DataFrame, part: int) -> DataFrame:
    """(rid, unit, place, members, bands, own, other, low, high, size): where each candidate text is verified.

    ``place`` is -1 in a connected part and the band's number in a bucket.
    """
    nodes = parts.join(classes.select(F.col("rep").alias("node"), "members", "n", "bands", "told"), "node").select(F.col("node").alias("rid"), "component", "members", "bands", "told", F.greatest("n", F.lit(LEAST)).alias("weight"))
    sizes = nodes.groupBy("component").agg(F.sum("weight").alias("size"))
    nodes = nodes.join(sizes, "component").checkpoint()
    whole = nodes.filter(F.col("size") <= part).select("rid", F.col("component").alias("unit"), F.lit(-1).alias("place"), "members", "bands", "told", "size")
    many = nodes.filter(F.col("size") > part).select("rid", "members", "bands", "told", "weight", F.posexplode("bands").alias("place", "unit"))
    buckets = many.groupBy("unit", "place").agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts")
    split = many.join(buckets, ["unit", "place"]).select("rid", "unit", "place", "members", "bands", "told", "size")
    out = whole.unionByName(split)
    blocks_ = F.when(F.col("size") <= part, 1).otherwise(F.ceil(2 * F.col("size") / part)).cast("int")
    out = out.withColumn("blocks", blocks_).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, n: int = WORDS, part: int = PART) -> DataFrame:
    """(rid, digest, doc_id, class_id, n_links, copy_id, n_shingles, component) of every row.

    ``class_id`` is the least doc_id among the rows connected by links, ``copy_id``
    among the rows with the same shingle set; ``component`` is the least rid of the
    connected rows, so it is the class whatever its ids are; ``n_links`` is the number
    of other rows at or above the threshold.  ``docs`` must give the same rows in the
    same order each time, as a file scan does.
    """
    bands = bands_for(threshold, recall, rows)
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = source.mapInArrow(_signed(3, bands, rows, n), f"rid long, doc_id {kind}, digest long, k1 long, k2 long, n long, bands array<long>").checkpoint()
    some = signed.filter("n > 0")
    # a representative is the row with its class's least rid; rows of one set have the same bands
    classes = some.groupBy("k1", "k2", "n").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("copy_id"), F.min_by("bands", "rid").alias("bands"), F.min_by("digest", "rid").alias("told")).checkpoint()

    reps = classes.select(F.col("rep").alias("rid"), F.posexplode("bands").alias("place", "band"))
    buckets = reps.groupBy("band", "place").agg(F.min("rid").alias("least"), F.max("rid").alias("most")).filter("least < most")
    edges = reps.join(buckets.select("band", "place", "least"), ["band", "place"]).filter("rid <> least").select(F.col("rid").alias("u"), F.col("least").alias("v"))
    parts = components(edges).checkpoint()

    placed = sized(dealt(parts, classes, reps, part))
    tasks = shards_for(docs.select(F.col(text)), SHARD)
    met = source.select("rid", "digest", "text").join(placed, "rid").filter(F.when(F.col("digest") == F.col("told"), True).otherwise(F.raise_error(F.lit("the input did not give the same rows twice; write it to a table first")).cast("boolean")))
    # units of some size have a task of their own, small ones share
    met = met.withColumn("task", F.when(F.col("size") > LEAST * SMALL, F.xxhash64("unit", "place", "low", "high")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(tasks))))
    met = met.select("rid", "unit", "place", "members", "bands", "own", "other", "low", "high", "text", "task")
    verified = met.groupBy("task").applyInArrow(_verify(threshold, n, bands), "rid long, links long, root long").checkpoint()

    links = verified.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    groups = classes.join(links.withColumnRenamed("rid", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = groups.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    groups = groups.join(least, "component").select("k1", "k2", "n", "component", "class_id", "copy_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = signed.select("rid", "digest", "doc_id", "k1", "k2", "n").join(groups, ["k1", "k2", "n"], "left")
    return found.select("rid", "digest", "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n") > 0, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but the first row of each class, all columns."""
    found = near_duplicates(docs, doc_id, text, **options)
    return without(docs, found.filter("rid <> component").select("rid", "digest"), text)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "digest")
