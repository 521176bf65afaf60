"""Best-fit packing of tokenised documents into sequences (operator 8).

Texts are tokenised where they lie; only lengths and checksums move on.  Packing
is hierarchical, at any size of the input: the pieces are dealt to ``FAN_IN`` nodes at
least, and to as many as hold ``NODE_ITEMS`` each; a node packs its items best-fit, sends
off the bins that are nearly full, and its underfull bins are the items of the next round.
They are counted, and meet in so many fewer nodes, neighbours in the tree first, until one
node packs the last.  So no node ever holds much more than ``NODE_ITEMS`` items, whatever
the sizes are.  A round that joins next to nothing (all that is left is larger than half
a sequence) ends it: those bins are sequences as they are.

Defined results: a null or empty text is one token (the end id); repeated rows are
packed one by one; a length of exactly 4096 fills a sequence; of bins that fit equally
well any may be taken; texts are tokenised whole, whatever their length; an empty table
gives an empty result; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import math
import os
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import held

SEQUENCE = 4096
END_ID = 1
#: a bin with at most so many free places counts as full in every round but the last
SLACK = 2
#: nodes of the first round at least
FAN_IN = 8
#: items that a node packs
NODE_ITEMS = 20_000
#: a round that leaves more than this share of its items as underfull bins ends the packing
STUCK = 0.999
#: words and pieces kept with their ids in one Python worker
CACHE_WORDS, CACHE_PIECES = 200_000, 400_000

#: fixed values: the tokenizer file's own pattern for pieces of text
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """How byte-level BPE files write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return [chr(b) if b in kept else chr(256 + others.index(b)) for b in range(256)]


class Filled(dict):
    """A table that works out what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """The ids of a word-end BPE file, each distinct piece of text tokenised once.

    No piece of the file's pattern crosses white space, so a text's ids are the ids of
    its white-space words in a row, and a word's those of its pieces.  Texts that may
    hold a special token, or a control character on which the library and
    ``str.split`` differ, go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.pieces = regex.compile(PIECES).findall
        model = json.load(open(path))["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # the file's model alone: pieces need no second pass through its normaliser and pattern
        self.merge = BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0).tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.letters = byte_letters()
        self.whole = (*(t.content for t in self.library.get_added_tokens_decoder().values()), "\x1c", "\x1d", "\x1e", "\x1f")
        self.known = Filled(self.word_ids)
        self.known_pieces = Filled(self.piece_ids)

    def alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        # the library lower-cases each character by itself: no final sigma
        return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()

    def cut(self, word: str) -> list[str]:
        """The pattern's pieces of a word; letters, and letters with a stop, need no search."""
        word = self.normal(word)
        if word.isalpha():
            return [word]
        if word[-1] in ",." and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces(word)

    def piece_ids(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):  # a printable ASCII byte is written as itself
            piece = "".join([self.letters[b] for b in piece.encode()])
        return b"".join([self.id_bytes[t.id] for t in self.merge(piece)])

    def word_ids(self, word: str) -> bytes:
        get = self.known_pieces.__getitem__
        if word.isascii() and word.isalpha():
            # a word in lower case is its own piece, one string for both tables
            return get(word if word.islower() else word.lower())
        return b"".join(map(get, self.cut(word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.known_pieces) > CACHE_PIECES:
            self.known_pieces.clear()
        get = self.known.__getitem__
        return [self.alone(text) if any(s in text for s in self.whole) else b"".join(map(get, text.split())) for text in texts]


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process: its words serve the tasks that run there one after another."""
    return held(("words", path), lambda: WordTokenizer(path))


def _pieces(path: str, size: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, len(texts), 256):
                some = [x or "" for x in texts.slice(start, 256).to_pylist()]
                rows = []
                for i, raw in enumerate(tokenizer(path).encode(some)):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[a : a + 4 * size]
                        rows.append((start + i, k, a // 4, len(part) // 4, zlib.crc32(part)))
                at, k, a, n, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' ids in pieces of at most ``size``."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(path or default_tokenizer(), size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, largest items first, each into the fullest bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    mask = 0  # bit f: some bin has f free places
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        above = mask >> s
        if above:
            f = s + ((above & -above).bit_length() - 1)
            b = bins_at[f].pop()
            if not bins_at[f]:
                mask &= ~(1 << f)
        else:
            f, b = capacity, n
            n += 1
        out[i] = b
        if f > s:
            bins_at[f - s].append(b)
            mask |= 1 << (f - s)
    return out


BIN = "bin long, node long, sent boolean, length long, members array<struct<key: bigint, length: bigint>>"


def _pack(capacity: int, slack: int, last: bool, level: int):
    """Best-fit the bins of one node; full ones are sent off, the rest stays open."""

    def run(key, table):
        import pyarrow as pa

        sizes = table.column("length").to_numpy()
        where = best_fit(sizes, capacity)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
        totals = np.add.reduceat(sizes[order], cuts) if len(cuts) else np.zeros(0, np.int64)
        sent = (totals >= capacity - slack) | last
        members = table.column("members").combine_chunks().take(pa.array(order))
        flat = members.flatten()
        member = pa.struct([pa.field("key", pa.int64()), pa.field("length", pa.int64())])
        lists = pa.StructArray.from_arrays([flat.field(0), flat.field(1)], fields=list(member))
        counts = np.diff(members.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = ends[np.append(cuts, len(order))].astype(np.int32)
        node = int(key[0].as_py())
        ids = (np.int64(level) << np.int64(58)) + (np.int64(node) << np.int64(26)) + np.arange(len(cuts))
        return pa.table({
            "bin": pa.array(ids), "node": pa.array(np.full(len(cuts), node)), "sent": pa.array(sent), "length": pa.array(totals),
            "members": pa.ListArray.from_arrays(pa.array(offsets), lists, type=pa.list_(pa.field("element", member))),
        })

    return run


def pack(items: DataFrame, capacity: int = SEQUENCE, slack: int = SLACK, node_items: int = NODE_ITEMS) -> DataFrame:
    """Bins of (key, length) items: (sequence_id, members, length), members in their order in the sequence."""
    count = items.count()
    nodes = max(FAN_IN, math.ceil(count / node_items))
    # a node's items have sizes of all kinds, as the deal does not look at them
    current = items.select(F.pmod(F.xxhash64("key"), F.lit(nodes)).alias("node"), "length", F.array(F.struct(F.col("key").alias("key"), F.col("length").alias("length"))).alias("members"))
    level, done = 0, []
    while True:
        packed = current.groupBy("node").applyInArrow(_pack(capacity, slack, nodes == 1, level), BIN)
        if nodes == 1:
            done.append(packed)
            break
        packed = packed.checkpoint()
        done.append(packed.filter("sent"))
        rest = packed.filter("not sent")
        left = rest.count()
        fewer = max(1, math.ceil(left / node_items))
        if fewer > 1 and left > STUCK * count:
            done.append(rest)
            break
        # the tree: neighbouring nodes meet; if they are as many as before, another deal
        node = F.floor(F.col("node") * fewer / nodes) if fewer < nodes else F.pmod(F.xxhash64("bin"), F.lit(fewer))
        current = rest.select(node.cast("long").alias("node"), "length", "members")
        nodes, count, level = fewer, left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), "members", "length")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    rows = pieces(docs, doc_id, text, path, size).withColumn("key", F.monotonically_increasing_id()).checkpoint()
    bins = pack(rows.select("key", "length"), size)
    step = lambda acc, m: F.struct((acc["at"] + m["length"]).alias("at"), F.concat(acc["out"], F.array(F.struct(m["key"].alias("key"), acc["at"].alias("offset")))).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<key: bigint, offset: bigint>>").alias("out"))
    placed = bins.select("sequence_id", F.explode(F.aggregate("members", start, step, lambda acc: acc["out"])).alias("m")).select("sequence_id", F.col("m.key").alias("key"), F.col("m.offset").alias("offset"))
    return rows.join(placed, "key").drop("key")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
