"""What several operators share: sized broadcasts, Arrow columns as numpy bytes, word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import threading
import time
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a side is broadcast only when its columns measure at most so many bytes
BROADCAST_BYTES = 32 << 20

#: rows in an Arrow batch; whole texts are long, and both sides hold a batch several times
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Have small Arrow batches, and a checkpoint folder: the one in spark.checkpoint.dir, or one of our own where that is unset."""
    context = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if context.getCheckpointDir() is None:
        told = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not told:
            # a local master shares its disk with its executors; a cluster shares its warehouse
            shared = tempfile.gettempdir() if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
            told = f"{shared}/checkpoints"
        context.setCheckpointDir(told)


def free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"{name}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken)


def digest(text: Column) -> Column:
    """Tells rows apart that a second reading of an input gives under another number."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``gone`` has as (rid, digest), by their running numbers.

    A number whose digest is another one means that the input came in another order the
    second time; that is an error, never a wrong row.
    """
    rid, told, kept = free(docs, "_rid"), free(docs, "_told"), [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn(rid, F.monotonically_increasing_id()).join(sized(gone.toDF(rid, told)), rid, "left")
    same = F.col(told) == digest(F.col(f"`{text}`"))
    wrong = F.raise_error(F.lit("the input did not give the same rows twice; write it to a table first")).cast("boolean")
    return marked.filter(F.when(F.col(told).isNull(), True).when(same, False).otherwise(wrong)).select(*kept)


def _width(field) -> Column:
    """Bytes of a column's value in a row, structures and arrays of numbers by their parts."""
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if kind.startswith("array"):
        return F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)).cast("long") * 16 + 16
    return F.lit(8 * (1 + kind.count(":"))).cast("long")


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` cut off by checkpoint(), with a broadcast hint only if it is small enough.

    The bytes of its columns are summed up; beyond ``limit`` of them (BROADCAST_BYTES)
    the join that follows shuffles both sides instead.
    """
    df = df.checkpoint()
    total = df.agg(F.coalesce(F.sum(functools.reduce(lambda a, b: a + b, map(_width, df.schema.fields), F.lit(16).cast("long"))), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= (BROADCAST_BYTES if limit is None else limit) else df


#: seconds after which a worker process lets go of what no task has used
IDLE_S = 2.0
_held: dict = {}
_keeper: list = []


def held(key, make, idle: float = IDLE_S):
    """``make()``, kept in this worker process until no task has asked for it for ``idle`` seconds: its memory serves other operators after that."""
    found = _held.get(key)
    value = found[0] if found else make()
    _held[key] = (value, time.monotonic() + idle)
    if not _keeper or not _keeper[0].is_alive():
        _keeper[:] = [threading.Thread(target=_let_go, daemon=True)]
        _keeper[0].start()
    return value


def _let_go() -> None:
    while _held:
        time.sleep(IDLE_S / 2)
        for key in [k for k, (_, until) in list(_held.items()) if time.monotonic() > until]:
            del _held[key]
            gc.collect()
            trim()


def trim() -> None:
    """Give memory that is free in this worker process back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def trimmed(run):
    """``run``, a function of groups or of batches, with :func:`trim` after each table it gives."""

    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def each(batches):
            for out in run(batches):
                yield out
                trim()

        return each

    def done(*args):
        try:
            return run(*args)
        finally:
            trim()

    # Spark looks at the number of arguments
    forms = {1: lambda table: done(table), 2: lambda key, table: done(key, table), 3: lambda key, left, right: done(key, left, right)}
    return forms[len(inspect.signature(run).parameters)]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of an input as the optimizer knows them from its files, or measured where it does not."""
    try:
        told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # the estimate of a long plan may have thousands of digits
        told = 1 << 64
    if told < 1 << 56:
        return told
    return df.agg(F.coalesce(F.sum(functools.reduce(lambda a, b: a + b, map(_width, df.schema.fields))), F.lit(0))).first()[0]


def shards_for(df: DataFrame, size: int) -> int:
    """Shards of an index over ``df``: one for each ``size`` bytes of input, and no fewer than there are shuffle partitions.

    So what one task holds is bounded by the shard's bytes and not by how the session is set.
    """
    return max(1, shuffle_partitions(df), -(-input_bytes(df) // size))


def string_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(pa.large_binary() if kind == pa.large_binary() else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: fixed values: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: fixed values: the contract's white space
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1) mod 2 ** 64; kept for the next call."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1 << 16), BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of the polynomial hash of ``data`` mod 2 ** 64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand in blocks of any size."""
    n = len(sums)
    # aligned to one common power, then divided by it: BASE is odd and so has an inverse
    return mix((sums[ends] - sums[starts]) * inverse_powers(n)[starts] + (ends - starts).astype(np.uint64))


_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        grown = np.full(max(n, 1 << 16), inv, np.uint64)
        grown[0] = 1
        _inverse = np.multiply.accumulate(grown)
    return _inverse[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and how many words come before each text (n + 1)."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(texts, limit: int = 1 << 20):
    """Slices (start, stop) of an Arrow string array with at most ``limit`` bytes each, or one text."""
    _, offsets = string_buffer(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, the large ones apart."""
    large = counts >= 255
    return zlib.compress(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, n)
    return counts


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as byte-split gaps, then their counts."""
    raw = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = np.flatnonzero(raw.any(axis=0))
    width = int(used[-1]) + 1 if len(used) else 1
    return np.array([len(hashes), width], "<u4").tobytes() + raw[:, :width].T.tobytes() + pack_counts(counts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 8).reshape(width, n).T
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64), unpack_counts(data[8 + n * width :], n)


def bounds(shards: int) -> np.ndarray:
    """The least hash of each shard."""
    return np.array([(s << 64) // shards for s in range(shards)], np.uint64)


def chunks(batches, size: int):
    """Tables of about ``size`` bytes of ``text``, numbered within the task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, n, seq = [], 0, 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(lengths, base + size - n, "right"))) if n < size else start
            if stop > start:
                held.append(batch.slice(start, stop - start))
                n += int(lengths[stop - 1] - base)
                base, start = lengths[stop - 1], stop
            if n >= size:
                yield seq, pa.Table.from_batches(held).combine_chunks()
                held, n, seq = [], 0, seq + 1
    if held:
        yield seq, pa.Table.from_batches(held).combine_chunks()


def chunk_id(seq: int) -> int:
    """The same for the same rows of a scan, whichever executor runs it."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 20) | seq


def rows_out(table) -> bytes:
    """A table as one compressed message."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def rows_in(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().combine_chunks()


def chunked_rows(size: int):
    """Each chunk's rows as one compressed message to itself: (chunk, rows)."""

    def run(batches):
        import pyarrow as pa

        for seq, table in chunks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([chunk_id(seq)], pa.int64()), pa.array([rows_out(table)], pa.binary())], ["chunk", "rows"])

    return trimmed(run)
