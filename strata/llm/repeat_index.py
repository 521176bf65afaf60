"""Suffix-array dedup (operator 1): a run-length positional BWT marks long matches.

A byte goes if it lies in a ``match``-byte string that also starts anywhere else.
One index over a whole corpus cannot be dealt out, so the texts are aligned first:

1. Anchors are places that a ``match``-byte string determines by itself: the least
   hashes of its ``gram``-byte grams.  Equal strings have the same anchors, so all
   occurrences of a repeated string meet in their anchor's group, with what surrounds
   it (a context: every ``match``-byte string around the anchor).
2. Contexts are counted before anything is sent, by a 128-bit digest of their bytes.  A
   gram seen once ends there; a context seen twice repeats whole; of the contexts of a
   gram that has several, one copy each goes on.
3. These contexts of one anchor are aligned strings.  Their suffixes are kept in the order
   of a positional Burrows-Wheeler transform that is extended to the left byte by byte.
   It is stored by runs: a column is, for each run of equal bytes, its head, its byte, where
   the run goes in the next column, and, sampled at the run's ends, the common lengths that
   its first and last suffix have with their new neighbours.  Inside a run neighbours stay
   neighbours, so nothing else is stored, and repeats are few runs however often they occur.
4. Matching statistics stream over the runs: each context starts at its place in the first
   column and is mapped from run to run, its common lengths with both neighbours growing by
   one inside a run and taken from the samples at its ends.  Where one reaches ``match``, a
   long match is marked.

The bytes marked around an anchor are one range, so an answer is two numbers.  An anchor
with more than ``GROUP`` contexts is split by longer grams: the strings around it are dealt
by where they begin, into 2, 4, ... ranges, and those of a range have a longer part in
common, by which they are grouped and indexed in the same way; in the end a group is the
occurrences of one string.  Rows that are equal within a chunk are sent once.

Texts travel in compressed chunks of bounded size, hashes as sorted gaps.  Shards follow
the input's bytes, so that a task's part does not grow with the corpus.

Defined results: a null text is empty; texts under ``match`` bytes keep everything;
repeated rows are matches of each other; overlapping matches count; ids may be null or
repeated, as rows are told apart by their place in their chunk; texts are read whole, one
longer than a chunk being a chunk; an empty table gives an empty result; other columns of
the input are carried in ``row``, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import blocks, bounds, chunk_id, chunks, mix, prefix_sums, rows_in, rows_out, shards_for, span_hashes, string_buffer, trimmed

MATCH = 200
GRAM = 64
#: contexts of one anchor that are indexed in one group; more are split by longer grams
GROUP = 4096
#: contexts in one index, whole groups
BATCH = 1 << 14
#: bytes of text in a chunk; bytes of input whose anchors meet in a shard
CHUNK, SHARD = 2 << 20, 8 << 20
#: ranges of a split double up to this level
LEVELS = 8
_SIDE = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minima (or maxima) of all windows of ``width`` places; two running passes over blocks."""
    n = len(x)
    f, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of a block of texts, with their grams' and contexts' hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, match: int, gram: int, places: np.ndarray | None = None):
        self.data, self.offsets, self.match, self.gram = data, offsets, match, gram
        self.sums = prefix_sums(data)
        self.places = self.find() if places is None else places
        text = np.searchsorted(offsets, self.places, "right") - 1
        self.first, self.last = offsets[text], offsets[text + 1]
        self.left = np.minimum(self.places - self.first, match - gram)
        self.right = np.minimum(self.last - self.places, match)
        # an anchor's hash is a least one; mixed again, shards by hash range are even
        self.prints = mix(span_hashes(self.sums, self.places, self.places + gram) ^ _SIDE)

    @property
    def contexts(self) -> np.ndarray:
        """Two columns: a 128-bit digest of what surrounds each anchor, and of where in it the anchor is."""
        raw = self.data.tobytes()
        made = [hashlib.blake2b(raw[p - left : p + right], digest_size=16, salt=left.to_bytes(2, "little")).digest() for p, left, right in zip(self.places.tolist(), self.left.tolist(), self.right.tolist())]
        return np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)

    def find(self) -> np.ndarray:
        n, width = len(self.data), self.match - self.gram + 1
        if n < self.match:
            return np.zeros(0, np.int64)
        at = np.arange(n - self.gram + 1)
        hashes = span_hashes(self.sums, at, at + self.gram)
        low = sliding(hashes, width, True)  # of the strings data[i : i + match]
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))[: len(low)]
        low[np.arange(len(low)) + self.match > ends] = 0  # no string crosses texts
        rim = np.zeros(width - 1, np.uint64)
        top = sliding(np.concatenate([rim, low, rim]), width, False)
        return np.flatnonzero((hashes == top) & (top > 0))

    def rows(self, pick: np.ndarray) -> np.ndarray:
        """The bytes around the picked anchors, zero where the text has ended."""
        width = self.match - self.gram
        padded = np.concatenate([np.zeros(width, np.uint8), self.data, np.zeros(self.match, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, width + self.match)[self.places[pick]]
        cut = np.flatnonzero((self.left[pick] < width) | (self.right[pick] < self.match))
        column = np.arange(width + self.match, dtype=np.int16)
        left, right = (width - self.left[pick][cut]).astype(np.int16), (width + self.right[pick][cut]).astype(np.int16)
        out[cut] *= (column >= left[:, None]) & (column < right[:, None])
        return out


class RunLengthIndex:
    """Aligned contexts as a positional BWT stored by runs, extended to the left column by column.

    ``group`` must be sorted; rows are ``match - gram`` bytes, the gram, and what follows.
    """

    def __init__(self, group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, match: int, gram: int):
        self.match, self.width = match, match - gram
        n, tail = len(rows), rows[:, match - gram :]
        padded = np.zeros((n, -(-match // 8) * 8), np.uint8)
        padded[:, :match] = tail
        words = padded.view(">u8").astype(np.uint64)
        # where bytes are equal the shorter row comes first, so that its neighbours' common lengths are right
        order = np.lexsort([right, *words.T[::-1], group])
        group = group[order]
        equal = tail[order[1:]] == tail[order[:-1]]
        common = np.where(equal.all(axis=1), match, equal.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
        common = np.minimum(common, np.minimum(right[order[1:]], right[order[:-1]]))
        #: where each context stands in the first column, and its common length with the one before it there
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)
        self.first = np.zeros(n + 1, np.int16)
        self.first[1:n] = np.where(group[1:] == group[:-1], common, 0) if n > 1 else 0
        #: for each column the runs' heads, bytes, places in the next column, and sampled lengths before and after
        self.columns = [self._extended(*state) for state in self._states(order, group, rows, left)]

    def _states(self, order, group, rows, left):
        """The only full columns there are: one at a time, while its runs are taken."""
        lcp = self.first[:-1].copy()
        for column in range(self.width - 1, -1, -1):
            byte = np.where(left[order] >= self.width - column, rows[order, column].astype(np.int16), np.int16(256))
            yield group, byte, lcp
            starts, _, base, before, _ = self.built
            lengths = np.diff(np.append(starts, len(order)))
            to = np.repeat(base - starts, lengths) + np.arange(len(order), dtype=np.int32)
            grown = np.where(byte < 256, lcp + 1, 0).astype(np.int16)
            grown[starts] = before
            moved, ranked, common = np.empty_like(order), np.empty_like(group), np.empty_like(lcp)
            moved[to], ranked[to], common[to] = order, group, grown
            order, group, lcp = moved, ranked, common

    def _extended(self, group, byte, lcp):
        n = len(byte)
        head = np.ones(n, bool)
        head[1:] = (group[1:] != group[:-1]) | (byte[1:] != byte[:-1])
        starts = np.flatnonzero(head).astype(np.int32)
        ends = np.append(starts[1:], n).astype(np.int32) - 1
        key = group[starts].astype(np.int64) * 257 + byte[starts]
        rank = np.argsort(key, kind="stable")  # runs are sorted, not suffixes
        base = np.empty(len(starts), np.int32)
        base[rank] = np.concatenate([[0], np.cumsum((ends - starts + 1)[rank])[:-1]]) if n else 0
        before, after = np.zeros(len(starts), np.int16), np.zeros(len(starts), np.int16)
        a, b = rank[:-1], rank[1:]
        same = (key[a] == key[b]) & (byte[starts[b]] < 256)
        a, b = a[same], b[same]
        if len(a):
            # the common length across what lay between two runs of a byte
            cuts = np.stack([ends[a] + 1, starts[b] + 1], axis=1).ravel()
            between = np.minimum.reduceat(np.append(lcp, 0), cuts)[::2] + 1
            before[b], after[a] = between, between
        self.built = starts, byte[starts], base, before, after
        return self.built

    @property
    def runs(self) -> int:
        return sum(len(c[0]) for c in self.columns)

    def long_matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance to the anchor at which a long match begins; -1 where none does.

        Every context is streamed over the runs from the first column on.
        """
        n = len(self.place)
        least, most = np.full(n, -1, np.int16), np.full(n, -1, np.int16)
        place = self.place
        back, ahead = self.first[place], self.first[place + 1]
        for distance in range(self.width + 1):
            if distance:
                starts, byte, base, before, after = self.columns[distance - 1]
                lengths = np.diff(np.append(starts, n))
                run = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)[place]
                at = place - starts[run]
                lives = byte[run] < 256
                back = np.where(at > 0, (back + 1) * lives, before[run])
                ahead = np.where(at < lengths[run] - 1, (ahead + 1) * lives, after[run])
                place = base[run] + at
            hit = np.maximum(back, ahead) >= self.match
            most[hit] = distance
            least[hit & (least < 0)] = distance
        return least, most


def _zip(*arrays: np.ndarray) -> bytes:
    import pyarrow as pa

    heads = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    raw = b"".join(a.tobytes() for a in arrays)
    return heads + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(data: bytes, *kinds) -> list[np.ndarray]:
    import pyarrow as pa

    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    raw = pa.decompress(data[8 + 8 * n :], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for s, e, k in zip(sizes.tolist(), ends.tolist(), kinds)]


def _distinct_pairs(prints: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (print, context) pairs, their counts, and where each given pair stands."""
    order = np.lexsort((contexts[:, 1], contexts[:, 0], prints))
    p, c = prints[order], contexts[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1]).any(axis=1)
    at = np.empty(len(p), np.int64)
    at[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return p[starts], c[starts], np.diff(np.append(starts, len(p))), at


def _of_chunk(table, match: int, gram: int, places=None) -> list[tuple[int, int, Anchors]]:
    """Anchors of a chunk's texts, block by block: (first text, last text, anchors)."""
    texts = table.column("text")
    found, used = [], 0
    for start, stop in blocks(texts, 1 << 20):
        data, offsets = string_buffer(texts.slice(start, stop - start))
        if places is None:
            found.append((start, stop, Anchors(data, offsets, match, gram)))
        else:
            n = int(places[used])
            found.append((start, stop, Anchors(data, offsets, match, gram, np.cumsum(places[used + 1 : used + 1 + n].astype(np.int64)))))
            used += 1 + n
    return found


def _messages(rows: list[tuple]):
    import pyarrow as pa

    kind, shard, chunk, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())})


MESSAGE = "kind int, shard int, chunk long, data binary"
#: kinds of messages; contexts of level k have the kind CONTEXTS + k
COUNTS, DONE, PENDING, CONTEXTS = range(4)


def _counted(size: int, shards: int, match: int, gram: int):
    """A chunk's distinct grams and contexts with their counts, one message to each shard."""

    def run(batches):
        for seq, table in chunks(batches, size):
            found = _of_chunk(table, match, gram)
            prints, contexts, counts, _ = _distinct_pairs(*(np.concatenate([getattr(a, k) for _, _, a in found]) for k in ("prints", "contexts")))
            cuts = [*np.searchsorted(prints, bounds(shards)).tolist(), len(prints)]
            rows = [(COUNTS, s, chunk_id(seq), _zip(np.diff(prints[a:b], prepend=np.uint64(0)), contexts[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield from _messages(rows).to_batches()

    return trimmed(run)


#: what a chunk is told of a context: its gram is seen once, it is its gram's only context, or (and above) it goes to the index, the level added
ONCE, WHOLE, SOME = range(3)
#: added in a group of several contexts: to one that repeats whole, and to one that this chunk sends
REPEATS, OWN = 32, 64


def spans(level: int, match: int, gram: int) -> list[tuple[int, int]]:
    """The ranges of distances to the anchor into which a level splits the strings around it, all of one width."""
    n = match - gram + 1
    width = -(-n // min(n, 1 << level))
    return [(min(a, n - width), min(a, n - width) + width - 1) for a in range(0, n, width)]


def _judged(group: int):
    """A shard's answers: is a gram seen once, a context repeated whole, or in a group to be indexed, and at which level."""

    def run(table):
        parts = [_unzip(x, np.uint64, np.uint64, np.int64) for x in table.column("data").to_pylist()]
        prints = np.concatenate([np.cumsum(p, dtype=np.uint64) for p, _, _ in parts])
        contexts = np.concatenate([c.reshape(-1, 2) for _, c, _ in parts])
        p, _, _, at = _distinct_pairs(prints, contexts)
        total = np.bincount(at, weights=np.concatenate([n for _, _, n in parts]), minlength=len(p))
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
        kinds = np.bincount(of)[of]
        level = np.minimum(np.ceil(np.log2(np.maximum(kinds / group, 1))), LEVELS)
        told = np.where(kinds == 1, np.where(total > 1, WHOLE, ONCE), SOME + level).astype(np.uint8)
        told[(kinds > 1) & (total > 1)] |= REPEATS
        # the first chunk that holds a context sends it, the others need not
        owner = np.empty(len(p), np.int64)
        owner[at[::-1]] = np.arange(len(at))[::-1]
        told = told[at] | np.where(owner[at] == np.arange(len(at)), OWN, 0).astype(np.uint8)
        cuts = np.cumsum([0] + [len(q) for q, _, _ in parts])
        rows = [(COUNTS, s, k, _zip(told[a:b])) for s, k, a, b in zip(table.column("shard").to_pylist(), table.column("chunk").to_pylist(), cuts, cuts[1:])]
        return _messages(rows)

    return trimmed(run)


def _texts(size: int, match: int, gram: int):
    """Each chunk's rows, and the places of their anchors, as one message to itself."""

    def run(batches):
        import pyarrow as pa

        for seq, table in chunks(batches, size):
            found = _of_chunk(table, match, gram)
            places = np.concatenate([np.append(len(a.places), np.diff(a.places, prepend=0)) for _, _, a in found]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk_id(seq)], pa.int64()), pa.array([rows_out(table)], pa.binary()), pa.array([_zip(places)], pa.binary())], ["chunk", "rows", "places"])

    return trimmed(run)


def _results(table, begins: np.ndarray, ends: np.ndarray, with_text: bool):
    """Result rows of texts; the removed ranges are bytes of the whole column, in any order."""
    import pyarrow as pa

    texts = table.column("text")
    offsets = string_buffer(texts)[1]
    order = np.argsort(begins)
    begins, ends = begins[order], ends[order]
    removed, spans, left = [], [], []
    for start, stop in blocks(texts, 1 << 20):  # so that no array is much larger than a block
        data, own = string_buffer(texts.slice(start, stop - start))
        low, high = np.searchsorted(begins, offsets[[start, stop]])
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, begins[low:high] - offsets[start], 1)
        np.add.at(depth, ends[low:high] - offsets[start], -1)
        gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
        heads = gone.copy()
        heads[1:] &= ~gone[:-1]
        firsts = own[:-1][np.diff(own) > 0]
        heads[firsts] = gone[firsts]
        cut, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, heads))
        cut, runs = (x[own[1:]] - x[own[:-1]] for x in (cut, runs))
        removed.append(cut)
        spans.append(runs)
        left += [(data[i:j][~gone[i:j]] if n else data[i:j]).tobytes() for i, j, n in zip(own[:-1].tolist(), own[1:].tolist(), cut.tolist())]
    removed, spans = _joined(removed), _joined(spans)
    out = {"row": table.column("row"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}
    if with_text:
        # a cut may split a character, whose other bytes then go as well
        out["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
    return pa.table(out)


def _moved(offsets: np.ndarray, keep: np.ndarray, begins: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Places in a column, as places in the column of its kept texts; rows of dropped texts go."""
    text = np.searchsorted(offsets, begins, "right") - 1
    lengths = np.where(keep, np.diff(offsets), 0)
    shift = np.concatenate([[0], np.cumsum(lengths)[:-1]]) - offsets[:-1]
    mine = keep[text]
    return [x[mine] + shift[text[mine]] for x in (begins, *others)]


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


class Sent:
    """What a chunk sends of one level: distinct rows, and for each anchor that waits for one, which and where."""

    def __init__(self, level: int, match: int, gram: int):
        self.match, self.width, self.ranges = match, match - gram, spans(level, match, gram)
        self.found: dict[bytes, int] = {}
        self.group, self.left, self.right, self.times = [], [], [], []
        self.slot, self.at = [], []  # row, place of the anchor in the chunk less the range's least distance

    def add(self, rows: np.ndarray, prints: np.ndarray, left: np.ndarray, right: np.ndarray, places: np.ndarray, asks: np.ndarray) -> None:
        for low, high in self.ranges:
            some = np.flatnonzero((left >= low) & (right >= self.match - high))  # a string of the range is in the text
            part = np.ascontiguousarray(rows[some, self.width - high : self.width - low + self.match])
            own_left, own_right = np.minimum(left[some], high) - low, np.minimum(right[some] + low, self.match)
            size, raw = part.shape[1], part.tobytes()
            core = high - low
            for k, (p, i, j, at, ask) in enumerate(zip(prints[some].tolist(), own_left.tolist(), own_right.tolist(), places[some].tolist(), asks[some].tolist())):
                row = raw[k * size : (k + 1) * size]
                key = b"%d %d %d %d " % (p, low, i, j) + row
                n = self.found.get(key)
                if n is None:
                    n = self.found[key] = len(self.group)
                    # the part that all strings of the range have in common, at the range and the anchor
                    shared = hashlib.blake2b(row[core : self.match], digest_size=8, salt=p.to_bytes(8, "little") + low.to_bytes(2, "little")).digest() if len(self.ranges) > 1 else p.to_bytes(8, "little")
                    self.group.append(int.from_bytes(shared, "little"))
                    self.left.append(i)
                    self.right.append(j)
                    self.times.append(0)
                self.times[n] += 1
                if ask:
                    self.slot.append(n)
                    self.at.append(at - low)

    def message(self) -> tuple[np.ndarray, ...]:
        """Rows by group, and the new place of each row."""
        group = np.array(self.group, np.uint64)
        size = self.ranges[0][1] - self.ranges[0][0] + self.match
        matrix = np.frombuffer(b"".join([key[-size:] for key in self.found]), np.uint8).reshape(-1, size)
        order = np.argsort(group, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        return group[order], matrix[order], np.array(self.left, np.uint8)[order], np.array(self.right, np.uint8)[order], moved


def _split(shards: int, match: int, gram: int, with_text: bool):
    """A chunk and its answers: texts that are done, contexts to index, and texts that wait for these."""

    def run(key, texts, answers):
        import pyarrow as pa

        if not texts.num_rows:
            return _messages([])
        chunk = key[0].as_py()
        table = rows_in(texts.column("rows")[0].as_py())
        found = _of_chunk(table, match, gram, _unzip(texts.column("places")[0].as_py(), np.uint32)[0])
        prints, _, _, at = _distinct_pairs(*(np.concatenate([getattr(x, k) for _, _, x in found]) for k in ("prints", "contexts")))
        told = _joined([_unzip(d, np.uint8)[0] for _, d in sorted(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist()))], np.uint8)
        if len(told) != len(prints):
            raise ValueError("the input did not give the same rows twice; write it to a table first")
        offsets = string_buffer(table.column("text"))[1]
        begins, ends, waits = [], [], np.zeros(table.num_rows, bool)
        levels: dict[int, Sent] = {}
        fresh = np.ones(len(prints), bool)  # a context is sent once a chunk
        used = 0
        for start, _, a in found:
            mine = at[used : used + len(a.places)]
            used += len(mine)
            says, base = told[mine], offsets[start]
            own, again, says = says & OWN > 0, says & REPEATS > 0, says & (REPEATS - 1)
            whole = np.flatnonzero((says == WHOLE) | again)
            short = np.maximum(match - (a.last[whole] - a.places[whole]), 0)  # near the text's end, strings begin earlier
            fits = short <= a.left[whole]
            begins.append((a.places[whole] - a.left[whole] + base)[fits])
            ends.append((a.places[whole] - short + match + base)[fits])
            some = np.flatnonzero((says >= SOME) & own)
            some = some[np.unique(mine[some], return_index=True)[1]]
            some = some[fresh[mine[some]]]
            fresh[mine[some]] = False
            for level in np.unique(says[some] - SOME).tolist():
                pick = some[says[some] - SOME == level]
                sent = levels.setdefault(level, Sent(level, match, gram))
                sent.add(a.rows(pick), a.prints[pick], a.left[pick], a.right[pick], a.places[pick] + base, ~again[pick])
            text = np.searchsorted(a.offsets, a.places, "right") - 1 + start
            waits[text[(says >= SOME) & ~again]] = True

        rows, slot_at, slot, count = [], [], [], 0
        for level, sent in sorted(levels.items()):
            group, matrix, left, right, moved = sent.message()
            cuts = [*np.searchsorted(group, bounds(shards)).tolist(), len(group)]
            rows += [(CONTEXTS + level, k, chunk, _zip(group[i:j], matrix[i:j], left[i:j], right[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            asked, places, times = np.array(sent.slot, np.int64), np.array(sent.at, np.int64), np.array(sent.times, np.int64)
            # rows that this chunk has twice repeat whole: all strings of their range
            twice = times[asked] > 1
            begins.append((places - np.array(sent.left, np.int64)[asked])[twice])
            ends.append((places - np.maximum(match - np.array(sent.right, np.int64)[asked], 0) + match)[twice])
            slot_at.append(places[~twice])
            slot.append(moved[asked[~twice]] + count)
            count += len(group)
        begins, ends, slot_at, slot = _joined(begins), _joined(ends), _joined(slot_at), _joined(slot)
        done = table.filter(pa.array(~waits))
        if done.num_rows:
            rows.append((DONE, 0, chunk, rows_out(_results(done, *_moved(offsets, ~waits, begins, ends), with_text))))
        if waits.any():
            marks = _moved(offsets, waits, begins, ends)
            slot_at = _moved(offsets, waits, slot_at)[0]
            rows.append((PENDING, 0, chunk, _pair(_zip(*marks, slot_at, slot), rows_out(table.filter(pa.array(waits))))))
        return _messages(rows)

    return trimmed(run)


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _unpair(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:8], "little")
    return data[8 : 8 + n], data[8 + n :]


def _indexed(match: int, gram: int):
    """A shard's answers for one level: the long matches of each of its contexts."""

    def run(key, table):
        low, high = spans(key[0].as_py() - CONTEXTS, match, gram)[0]
        gram_ = match - (high - low)
        parts = [_unzip(x, np.uint64, np.uint8, np.uint8, np.uint8) for x in table.column("data").to_pylist()]
        groups, rows, left, right = (np.concatenate([p[k] for p in parts]) for k in range(4))
        rows = rows.reshape(len(groups), -1)
        pick = np.argsort(groups, kind="stable")
        head = np.concatenate([[True], groups[pick][1:] != groups[pick][:-1]])
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(pick))
        least, most = np.full(len(pick), -1, np.int16), np.full(len(pick), -1, np.int16)
        begin = 0
        while begin < len(starts):
            first = starts[begin]
            end = max(begin + 1, int(np.searchsorted(stops, first + BATCH, "right")))
            last = stops[end - 1]
            some = pick[first:last]
            own = np.cumsum(head[first:last]) - 1
            many = np.bincount(own)[own] > 1  # a context alone in its group has no match
            some, own = some[many], own[many]
            index = RunLengthIndex(own, rows[some], left[some].astype(np.int64), right[some].astype(np.int64), match, gram_)
            least[some], most[some] = index.long_matches()
            begin = end
        cuts = np.cumsum([0] + [len(x[0]) for x in parts])
        return _messages([(key[0].as_py(), s, k, _zip(least[i:j], most[i:j])) for s, k, i, j in zip(table.column("shard").to_pylist(), table.column("chunk").to_pylist(), cuts, cuts[1:])])

    return trimmed(run)


def _finished(match: int, with_text: bool, schema):
    """The waiting texts of a chunk, with their answers."""

    def run(key, pending, answers):
        if not pending.num_rows:
            return schema.empty_table()
        marks, rows = _unpair(pending.column("data")[0].as_py())
        begins, ends, slot_at, slot = _unzip(marks, *[np.int64] * 4)
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "data"))))
        index = [_unzip(d, np.int16, np.int16) for _, _, d in told]
        least, most = (_joined([x[k] for x in index])[slot] if len(slot) else np.zeros(0, np.int64) for k in (0, 1))
        hit = most >= 0
        return _results(rows_in(rows), _joined([begins, slot_at[hit] - most[hit]]), _joined([ends, slot_at[hit] - least[hit] + match]), with_text).cast(schema)

    return trimmed(run)


def _opened(schema):
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from rows_in(data).cast(schema).to_batches()

    return trimmed(run)


def remove_repeats(docs: DataFrame, text: str = "text", match: int = MATCH, gram: int = GRAM, group: int = GROUP, chunk: int = CHUNK, with_text: bool = True) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]); ``row`` holds the columns of ``docs``.

    ``docs`` must give the same rows in the same order each time, as a file scan does.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shards = shards_for(docs.select(F.col(text)), SHARD)
    whole = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = whole.select("row", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").alias("kept_sha256"), *[F.lit("").alias("kept_text")] * with_text).schema
    for field in out.fields:
        field.nullable = True
    schema = to_arrow_schema(out)

    sent = whole.select("text").mapInArrow(_counted(chunk, shards, match, gram), MESSAGE)
    judged = sent.groupBy("shard").applyInArrow(_judged(group), MESSAGE).checkpoint()
    texts = whole.mapInArrow(_texts(chunk, match, gram), "chunk long, rows binary, places binary")
    split = texts.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(_split(shards, match, gram, with_text), MESSAGE).checkpoint()
    told = split.filter(F.col("kind") >= CONTEXTS).groupBy("kind", "shard").applyInArrow(_indexed(match, gram), MESSAGE)
    waiting = split.filter(F.col("kind") == PENDING).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_finished(match, with_text, schema), out)
    return split.filter(F.col("kind") == DONE).select("data").mapInArrow(_opened(schema), out).unionByName(waiting)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, with_text=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def keep_unrepeated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of its texts, all columns; a null text becomes empty."""
    found = remove_repeats(docs, text, **options)
    return found.select(*[F.col(f"row.`{c}`").alias(c) if c != text else F.col("kept_text").alias(c) for c in docs.columns])
