"""SentencePiece encoding and decoding by a shared-prefix forward search (operator 6).

Each distinct marked word of the corpus is segmented once.  A chunk of texts sends its
distinct words to shards by their first characters, so that words with a common prefix
meet wherever they are; a shard sorts them, which is a trie read depth first: the forward
states of a common prefix are computed once and kept on a stack.  A state is what is known
of a prefix's best segmentation, its last piece; pieces that may still grow are pointers
into the vocabulary's own trie.  The shard answers each chunk with the ids of its words,
and the chunk's texts are put together from them.  A frequent word is one entry a chunk,
and shards follow the input's bytes.

For a unigram model a state holds the best summed score (plain Viterbi).  For a BPE
model summed scores do not give the model's ids, as merges go by rank; there the
one valid last piece of a prefix is the piece that stays apart from the last piece
of what is before it when the two are merged alone, and the state holds that.  Both
agree with the library.

Defined results: a null text is empty and has no ids; characters outside the
vocabulary become their bytes; repeated rows are coded one by one; of segmentations of
one score the one with the longest last piece is taken; texts are coded whole, one longer
than a chunk being a chunk; an empty table gives an empty result; other columns of the
input are not read, so their names cannot clash; decoding gives the text back, but for
the mark character itself, which decodes to a space.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import chunk_id, chunked_rows, chunks, held, pack_counts, rows_in, rows_out, shards_for, trimmed, unpack_counts

MARK = "▁"
#: bytes of text in a chunk, and of input whose words meet in a shard
CHUNK, SHARD = 12 << 20, 16 << 20
#: first characters of a word that choose its shard
LEAD = 4
#: words kept with their ids, and pairs of pieces kept with their verdict, in one Python worker
CACHE_WORDS, CACHE_PAIRS = 500_000, 1_000_000
UNKNOWN_PENALTY = 10.0
#: seconds for which a worker keeps the pieces and its pairs' verdicts; a shard's words may take that long
IDLE_S = 120.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encodes and decodes with the pieces of a SentencePiece model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto or open(path, "rb").read())
        self.bpe = model.trainer_spec.model_type == 2
        self.prefix = model.normalizer_spec.add_dummy_prefix
        # the model's own rules for text; identity here
        self.normalise = None if not model.normalizer_spec.precompiled_charsmap else sentencepiece.SentencePieceNormalizer(model_proto=model.SerializeToString()).normalize
        kinds = {1, 4}  # normal and user-defined pieces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in kinds}
        self.score = {i: p.score for i, p in enumerate(model.pieces)}
        self.pieces = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.low = min((p.score for p in model.pieces if p.type == 1), default=0.0) - UNKNOWN_PENALTY
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        inner = {c for p in self.ids for c in p}
        # no piece crosses from another character to a mark, so words are cut there; nor has any a line feed
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def holds(self, left: str, right: str) -> bool:
        """Whether BPE of the two together gives these two pieces: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts, bound = [*left, *right], len(left)
        pair = [self.ids.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, i in enumerate(pair):
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return bound == 1 and len(parts) == 2
            if at == bound - 1:  # a merge across what should stay apart
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            bound -= at < bound
            del pair[at]
            if at:
                pair[at - 1] = self.ids.get(parts[at - 1] + parts[at])
            if at < len(pair):
                pair[at] = self.ids.get(parts[at] + parts[at + 1])

    def stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self.holds(self.pieces[a], self.pieces[b])
        return known

    def learn(self, words: list[str]) -> None:
        """Segment distinct words, depth first over their trie."""
        words.sort()
        trie, apart, get_apart, bpe = self.trie, self.apart, self.apart.get, self.bpe
        # by depth: the last piece (-1 unknown, -2 none yet), where it begins, the summed score, and growing pieces
        last, begin, total, growing = [-2], [0], [0.0], [[(0, trie)]]
        before = ""
        score, low = self.score, self.low
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], begin[depth + 1 :], total[depth + 1 :], growing[depth + 1 :]
            for at in range(depth, len(word)):
                c, still, found, start, best = word[at], [], None, at, None
                for j, node in growing[at]:
                    node = node.get(c)
                    if node is None:
                        continue
                    if len(node) > ("" in node):
                        still.append((j, node))
                    i = node.get("")
                    if i is None:
                        continue
                    if bpe:
                        if found is None:
                            a = last[j]
                            if a < 0:
                                fits = True
                            else:
                                fits = get_apart(a << 32 | i)
                                if fits is None:
                                    fits = self.stay_apart(a, i)
                            if fits:
                                found, start = i, j
                    else:
                        s = total[j] + score[i]
                        if best is None or s > best:
                            best, found, start = s, i, j
                if found is None or not bpe and self.ids.get(c) is None and (best is None or total[at] + low > best):
                    found, start, best = -1, at, total[at] + low
                last.append(found)
                begin.append(start)
                total.append(best or 0.0)
                still.append((at + 1, trie))
                growing.append(still)
            ids, at = [], len(word)
            while at:
                i, start = last[at], begin[at]
                if i == -1:
                    ids.extend([self.bytes[b] for b in word[start:at].encode()][::-1] if self.bytes else [self.unknown])
                else:
                    ids.append(i)
                at = start
            self.known[word] = np.array(ids[::-1], "<u4").tobytes()
            before = word

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.normalise is not None:
            text = self.normalise(text)
            marked = text.replace(" ", MARK)
        else:
            marked = (MARK + text if self.prefix else text).replace(" ", MARK)
        return [marked] if self.crosses else self.cut(marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        held = [self.words(t) for t in texts]
        every = set().union(*held)
        fresh = every.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = every
        self.learn(list(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, some)) for some in held]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    """One per worker process: its words serve the tasks that run there one after another."""
    return held(("pieces", path), lambda: PieceCodec(path), IDLE_S)


def _words_out(words: list[str]) -> bytes:
    import pyarrow as pa

    return rows_out(pa.table({"w": pa.array(words, pa.string())}))


def _dealt(coder: PieceCodec, texts, shards: int) -> dict[int, list[str]]:
    """The distinct words of a chunk's texts, sorted, by shard."""
    import xxhash

    every: set[str] = set()
    for start in range(0, len(texts), 256):
        every.update(*map(coder.words, texts.slice(start, 256).to_pylist()))
    by: dict[int, list[str]] = {}
    for word in sorted(every):
        by.setdefault(xxhash.xxh32_intdigest(word[:LEAD].encode()) % shards, []).append(word)
    return by


def _distinct(path: str, size: int, shards: int):
    """A chunk's distinct words, a message to each shard."""

    def run(batches):
        import pyarrow as pa

        for seq, table in chunks(batches, size):
            found = sorted(_dealt(codec(path), table.column("text"), shards).items())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([chunk_id(seq)] * len(found), pa.int64()), pa.array([_words_out(w) for _, w in found], pa.binary())], ["shard", "chunk", "data"])

    return trimmed(run)


def _ids_out(coded: list[bytes]) -> bytes:
    """How many ids each word has, then the ids."""
    import pyarrow as pa

    counts = pack_counts(np.array([len(x) // 4 for x in coded], np.int64))
    ids = np.frombuffer(b"".join(coded), "<u4")
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    packed = pa.compress(ids.astype(kind).tobytes(), codec="zstd", asbytes=True)
    return np.array([len(coded), len(counts), len(ids), int(kind[2])], "<u8").tobytes() + counts + packed


def _ids_in(data: bytes) -> list[bytes]:
    import pyarrow as pa

    n, size, total, width = (int(x) for x in np.frombuffer(data, "<u8", 4))
    counts = unpack_counts(data[32 : 32 + size], n)
    raw = pa.decompress(data[32 + size :], decompressed_size=total * width, codec="zstd", asbytes=True)
    ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _segmented(path: str):
    """A shard's answers: the ids of each chunk's words, in their order."""

    def run(table):
        import pyarrow as pa

        coder = codec(path)
        asked = [rows_in(x).column("w").to_pylist() for x in table.column("data").to_pylist()]
        coder.known.clear()
        coder.learn(list(set().union(*asked)))
        answers = [_ids_out([coder.known[w] for w in words]) for words in asked]
        coder.known.clear()
        return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "data": pa.array(answers, pa.binary())})

    return trimmed(run)


def _encoded(path: str, shards: int, with_ids: bool):
    def run(key, texts, answers):
        import pyarrow as pa

        coder = codec(path)
        table = rows_in(texts.column("rows")[0].as_py())
        words = _dealt(coder, table.column("text"), shards)
        coder.known.clear()
        for shard, data in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist()):
            ids = _ids_in(data)
            if len(ids) != len(words.get(shard, ())):
                raise ValueError("the input did not give the same rows twice; write it to a table first")
            coder.known.update(zip(words[shard], ids))
        get, out = coder.known.__getitem__, []
        for start in range(0, table.num_rows, 256):
            part = table.slice(start, 256)
            some = part.column("text").to_pylist()
            ids = [b"".join(map(get, coder.words(t))) for t in some]
            back = [coder.decode(x) for x in ids]
            columns = {
                "doc_id": part.column("doc_id"),
                "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                "same": pa.array([a == b for a, b in zip(some, back)]),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            out.append(pa.table(columns))
        coder.known.clear()
        return pa.concat_tables(out).combine_chunks()

    return trimmed(run)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, same[, ids]) of every row.

    ``docs`` must give the same rows in the same order each time, as a file scan does.
    """
    path = path or default_model()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    shards = shards_for(docs.select(F.col(text)), SHARD)
    words = rows.select("text").mapInArrow(_distinct(path, chunk, shards), "shard int, chunk long, data binary")
    answers = words.groupBy("shard").applyInArrow(_segmented(path), "shard int, chunk long, data binary")
    texts = rows.mapInArrow(chunked_rows(chunk), "chunk long, rows binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_encoded(path, shards, with_ids), f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids)


def decode(coded: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """``coded`` with the text of its ids; a null list decodes to null."""
    path = path or default_model()

    @F.pandas_udf("string")
    def text_of(column):
        coder = codec(path)
        return column.map(lambda x: None if x is None else coder.decode(np.asarray(x, "<u4").tobytes()))

    return coded.withColumn(out, text_of(F.col(ids)))


def op6_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
