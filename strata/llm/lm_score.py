"""LM scoring (operator 9): a weighted backoff automaton over smoothed n-grams.

States are contexts: two words that were seen in training, one word, or none; a text
starts in the state of its start.  A state has an arc for every word seen after it, with
the smoothed probability as its weight and the longest context that the word leaves as
its target, and one failure arc to the state of one word less, with the weight that the
unseen words share.  With c for training counts, order three down to one:

    P(w | u v) = (c(u v w) + K3 P(w | v)) / (c(u v) + K3),   failure arc K3 / (c(u v) + K3)
    P(w | v)   = (c(v w) + K2 P(w)) / (c(v) + K2),           failure arc K2 / (c(v) + K2)
    P(w)       = (c(w) - D) / N,                             and D V / N for the unknown word

so the weights of a state sum to one over the V known words and the unknown one, the
same events as the base score's.  A text is traversed once from left to right: the state
is carried, failure arcs are taken until the word has an arc, and weights add up.

The corpus is never in one place.  Each task hashes its texts' n-grams in chunks of
bounded size and sends sorted, delta-coded hashes with counts to shards by hash range: the
words, and each word pair with the words that follow it, from which the counts of pairs
and of triples come.  A shard adds up counts and answers every chunk with the totals of
just its n-grams, in its order.  A chunk's texts then meet its answers, which are the part
of the automaton they can reach, and are traversed.  A frequent word is one entry per
chunk, and shards follow the input's bytes, so no task's part grows with the corpus.

Defined results: a null text is empty and has one token, the end; a null id is held
out of training (its remainder is not defined) and scored; repeated rows count and
are scored one by one; texts are read whole, one longer than a chunk being a chunk; an
empty table gives an empty result; other columns of the input are not read, so their
names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import LOWER, blocks, bounds, chunk_id, chunked_rows, chunks, mix, pack, pack_counts, prefix_sums, rows_in, shards_for, span_hashes, string_buffer, trimmed, unpack, unpack_counts, words

#: bytes of text in a chunk, but for one longer text
CHUNK = 6 << 20
#: bytes of input whose n-grams meet in a shard
SHARD = 16 << 20
#: weights of the failure arcs of one and of two words: a context seen so often is trusted half
K2, K3 = 1000.0, 4.0
FOLDS, HELD_OUT = 7, 2
#: stand for the end token and for the start state
END = np.uint64(0x517CC1B727220A95)
START = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD1342543DE82EF95)
#: a pair's hash has 56 bits, the lowest byte is zero and costs nothing in a message: of 10 ** 12 pairs one in 70,000 shares its hash
_TOP = ~np.uint64(255)


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of an Arrow string array, each text closed by END, and the texts' offsets into them."""
    parts = [_block_tokens(texts.slice(start, stop - start)) for start, stop in blocks(texts)]
    lengths = np.concatenate([np.zeros(1, np.int64), *(np.diff(o) for _, o in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in parts)]), np.cumsum(lengths)


def _block_tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_buffer(texts)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets)
    found = span_hashes(prefix_sums(data), starts, ends)
    at = firsts + np.arange(len(offsets))  # an end follows each text
    out = np.empty(len(found) + len(offsets) - 1, np.uint64)
    ends_at = at[1:] - 1
    keep = np.ones(len(out), bool)
    keep[ends_at] = False
    out[keep] = found
    out[ends_at] = END
    return out, np.concatenate([[0], ends_at + 1])


class Grams:
    """The n-grams of a chunk: distinct hashes, training counts, and which of them each token has.

    ``words`` are the tokens and START, once a text; ``pairs`` each token after the one
    before it (START before the first); ``entries`` each pair with the word that follows,
    0 after the end, as the pair's number and 32 bits of the follower's hash.
    """

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, counted: np.ndarray):
        each = np.repeat(counted, np.diff(offsets))
        firsts, lasts = offsets[:-1], offsets[1:] - 1
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[firsts] = START
        after = np.zeros_like(tokens)
        after[:-1] = mix(tokens[1:] ^ _PAIR) >> np.uint64(32)
        after[lasts] = 0
        self.words, self.word = np.unique(np.concatenate([tokens, np.full(len(firsts), START, np.uint64)]), return_inverse=True)
        self.pairs, self.pair = np.unique(mix(before * _PAIR + tokens) & _TOP, return_inverse=True)
        self.entries, self.entry = np.unique(self.pair.astype(np.uint64) << np.uint64(32) | after, return_inverse=True)
        self.word_counts = self._sum(self.word, np.concatenate([each, counted]), self.words)
        self.entry_counts = self._sum(self.entry, each, self.entries)
        #: the number of the word before each token, tokens that another follows, and these
        start = self.word[-1] if len(firsts) else 0
        self.before = np.empty(len(tokens), np.int64)
        self.before[1:] = self.word[: len(tokens) - 1] if len(tokens) else 0
        self.before[firsts] = start
        goes_on = np.ones(len(tokens), bool)
        goes_on[lasts] = False
        self.goes_on = np.flatnonzero(goes_on)
        self.next = self.goes_on + 1

    @staticmethod
    def _sum(at, weights, of):
        return np.bincount(at, weights=weights, minlength=len(of)).astype(np.int64)


def pack_entries(pairs: np.ndarray, entries: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """Sorted pairs with how many followers they have, the followers' bits, and counts; ``first`` numbers the first pair."""
    followers = np.bincount((entries >> np.uint64(32)).astype(np.int64) - first, minlength=len(pairs))
    head = pack(pairs, followers)
    return len(head).to_bytes(8, "little") + head + entries.astype("<u4").tobytes() + pack_counts(counts)


def unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, and for each entry the number of its pair, the follower's bits and the count."""
    at = 8 + int.from_bytes(data[:8], "little")
    pairs, followers = unpack(data[8:at])
    n = int(followers.sum())
    return pairs, np.repeat(np.arange(len(pairs)), followers), np.frombuffer(data, "<u4", n, at).astype(np.uint64), unpack_counts(data[at + 4 * n :], n)


def _counts(size: int, shards: int):
    """A chunk's n-grams, a message to each shard for words (0) and one for pairs and their followers (1)."""

    def run(batches):
        import pyarrow as pa

        for seq, table in chunks(batches, size):
            grams = Grams(*token_hashes(table.column("text")), table.column("counted").to_numpy().astype(np.int64))
            edges = bounds(shards)
            cuts = [*np.searchsorted(grams.words, edges).tolist(), len(grams.words)]
            found = [(0, k, pack(grams.words[a:b], grams.word_counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            cuts = [*np.searchsorted(grams.pairs, edges).tolist(), len(grams.pairs)]
            starts = np.searchsorted(grams.entries, np.array(cuts, np.uint64) << np.uint64(32)).tolist()
            found += [(1, k, pack_entries(grams.pairs[a:b], grams.entries[i:j], grams.entry_counts[i:j], a)) for k, (a, b, i, j) in enumerate(zip(cuts, cuts[1:], starts, starts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([chunk_id(seq)] * len(found), pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["kind", "shard", "chunk", "data"])

    return trimmed(run)


def _totals(key, table):
    """A shard's answers: for each chunk the totals of its n-grams, in its order; with the first, sums over the shard's words."""
    import pyarrow as pa

    sums = np.zeros((4, table.num_rows), np.int64)
    if key[0].as_py() == 0:
        parts = [unpack(x) for x in table.column("data").to_pylist()]
        distinct, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(distinct)).astype(np.int64)
        own = totals[distinct != START]
        sums[:, 0] = own.sum(), (own > 0).sum(), (own == 1).sum(), (own == 2).sum()
        answers = _dealt([totals[at]], [[len(h) for h, _ in parts]])
    else:
        parts = [unpack_entries(x) for x in table.column("data").to_pylist()]
        distinct, at = np.unique(np.concatenate([p for p, *_ in parts]), return_inverse=True)
        begins = np.cumsum([0] + [len(p) for p, *_ in parts])
        pair = np.concatenate([at[begin + of] for begin, (_, of, _, _) in zip(begins, parts)])
        _, which = np.unique(pair.astype(np.uint64) << np.uint64(32) | np.concatenate([f for _, _, f, _ in parts]), return_inverse=True)
        counts = np.concatenate([c for *_, c in parts])
        triples, pairs = (np.bincount(x, weights=counts).astype(np.int64) for x in (which, pair))
        answers = _dealt([pairs[at], triples[which]], [[len(p) for p, *_ in parts], [len(f) for _, _, f, _ in parts]])
    return pa.table({
        "kind": table.column("kind"), "shard": table.column("shard"), "chunk": table.column("chunk"), "data": pa.array(answers, pa.binary()),
        "n": pa.array(sums[0]), "v": pa.array(sums[1]), "n1": pa.array(sums[2]), "n2": pa.array(sums[3]),
    })


def _dealt(totals: list[np.ndarray], lengths: list[list[int]]) -> list[bytes]:
    """Columns of totals cut into parts; each part as its lengths and packed counts."""
    out = []
    ends = [np.cumsum([0, *x]) for x in lengths]
    for k in range(len(lengths[0])):
        packed = [pack_counts(t[e[k] : e[k + 1]]) for t, e in zip(totals, ends)]
        out.append(np.array([len(packed), *(x[k] for x in lengths), *map(len, packed)], "<u8").tobytes() + b"".join(packed))
    return out


def _told(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    head = np.frombuffer(data, "<u8", 1 + 2 * n).astype(np.int64)
    ends = 8 * (1 + 2 * n) + np.cumsum([0, *head[1 + n :]])
    return [unpack_counts(data[a:b], int(length)) for a, b, length in zip(ends, ends[1:], head[1 : 1 + n])]


class Automaton:
    """The states, arcs and failure arcs that a chunk's texts can reach.

    State 0 has no context; then come the words' states, START's among them, and the
    pairs'.  ``fails_to`` and ``failure`` are each state's failure arc; the arcs of a
    state go by word (from 0), by pair (from a word) and by entry (from a pair), -inf
    where there is none, with the word's state or pair's state as their target.
    """

    def __init__(self, grams: Grams, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, n: int, v: int, discount: float, k2: float = K2, k3: float = K3):
        with np.errstate(divide="ignore"):
            known = c1 > 0
            p1 = np.where(known, c1 - discount, discount * v) / n if n else np.ones(len(c1))
            self.words = np.log10(np.where(known, p1, 0))
            self.unknown = np.log10(discount * v / n) if n else 0.0
            self.states = 1 + len(c1) + len(c2)
            self.fails_to = np.zeros(self.states, np.int64)
            self.failure = np.zeros(self.states)
            self.failure[1 : 1 + len(c1)] = np.log10(k2 / (c1 + k2))
            self.failure[1 + len(c1) :] = np.log10(k3 / (c2 + k3))
            # which words a pair has, from any token that ends it; the same for an entry and its pair
            m = len(grams.pair)
            last, first, pair_of = np.empty(len(c2), np.int64), np.empty(len(c2), np.int64), (grams.entries >> np.uint64(32)).astype(np.int64)
            last[grams.pair] = grams.word[:m]
            first[grams.pair] = grams.before
            p2 = (c2 + k2 * p1[last]) / (c1[first] + k2)
            self.pairs = np.where(c2 > 0, np.log10(p2), -np.inf)
            follows = np.full(len(c3), -1, np.int64)
            follows[grams.entry[grams.goes_on]] = grams.pair[grams.next]
            p3 = (c3 + k3 * p2[follows]) / (c2[pair_of] + k3)
            self.triples = np.where((c3 > 0) & (follows >= 0), np.log10(p3), -np.inf)
        self.fails_to[1 + len(c1) :] = 1 + last
        self.word_state = np.where(known, 1 + np.arange(len(c1)), 0)
        self.pair_state = np.where(c2 > 0, 1 + len(c1) + np.arange(len(c2)), self.word_state[last])
        self.c1 = c1

    def traverse(self, grams: Grams, offsets: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Log-probability of each text.

        The state in which a token is read is the longest context that the tokens before
        it leave, so all tokens take their failure arcs at the same time; ``trace`` gets
        the state of every token.
        """
        m = len(grams.pair)
        state = np.empty(m, np.int64)
        state[1:] = self.pair_state[grams.pair[:-1]]
        state[offsets[:-1]] = self.word_state[grams.before[offsets[:-1]]]
        if trace is not None:
            trace.append(state.copy())
        weight = np.zeros(m)
        pairs_from = 1 + len(self.c1)
        # arcs of two words, then of one, then of none
        arc = np.full(m, -np.inf)
        arc[grams.next] = self.triples[grams.entry[grams.goes_on]]
        fails = (state >= pairs_from) & np.isneginf(arc)
        done = (state >= pairs_from) & ~fails
        weight[done] = arc[done]
        weight[fails] += self.failure[state[fails]]
        state[fails] = self.fails_to[state[fails]]
        arc = self.pairs[grams.pair]
        at = ~done & (state > 0)
        fails = at & np.isneginf(arc)
        weight[at & ~fails] += arc[at & ~fails]
        weight[fails] += self.failure[state[fails]]
        done |= at & ~fails
        arc = self.words[grams.word[:m]]
        weight += np.where(done, 0.0, np.where(np.isneginf(arc), self.unknown, arc))
        return np.add.reduceat(weight, offsets[:-1])


def _scores(n: int, v: int, discount: float, k2: float, k3: float):
    def run(key, texts, answers):
        import pyarrow as pa

        table = rows_in(texts.column("rows")[0].as_py())
        tokens, offsets = token_hashes(table.column("text"))
        grams = Grams(tokens, offsets, table.column("counted").to_numpy().astype(np.int64))
        told: list[list] = [[], []]
        for kind, shard, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "data"))):
            told[kind].append((shard, _told(data)))
        c1, c2, c3 = (np.concatenate([np.zeros(0, np.int64), *(x[1][k] for x in sorted(told[kind], key=lambda x: x[0]))]) for kind, k in ((0, 0), (1, 0), (1, 1)))
        if (len(c1), len(c2), len(c3)) != (len(grams.words), len(grams.pairs), len(grams.entries)):
            raise ValueError("the input did not give the same rows twice; write it to a table first")
        word = c1[grams.word[: len(tokens)]]
        base = np.add.reduceat(np.log10((word + 1) / (n + v + 1)), offsets[:-1])
        score = Automaton(grams, c1, c2, c3, n, v, discount, k2, k3).traverse(grams, offsets)
        return pa.table([table.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.add.reduceat((word > 0).astype(np.int64), offsets[:-1])), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return trimmed(run)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k2: float = K2, k3: float = K3, chunk: int = CHUNK) -> DataFrame:
    """One row per document; ``docs`` must give the same rows in the same order each time, as a file scan does."""
    shards = shards_for(docs.select(F.col(text)), SHARD)
    remainder = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder != HELD_OUT, F.lit(False)).alias("counted"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.mapInArrow(_counts(chunk, shards), "kind int, shard int, chunk long, data binary")
    answers = sent.groupBy("kind", "shard").applyInArrow(trimmed(_totals), "kind int, shard int, chunk long, data binary, n long, v long, n1 long, n2 long").checkpoint()
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    # the usual estimate from the counts of counts; between them where a corpus has none
    discount = sums.n1 / (sums.n1 + 2 * sums.n2) if sums.n1 and sums.n2 else 0.5
    texts = rows.mapInArrow(chunked_rows(chunk), "chunk long, rows binary")
    scored = texts.groupBy("chunk").cogroup(answers.select("chunk", "kind", "shard", "data").groupBy("chunk")).applyInArrow(_scores(sums.n, sums.v, discount, k2, k3), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
