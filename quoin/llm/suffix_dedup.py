"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id,
or further left in the same document. Strings do not cross documents and are judged on the input.

1. Every window of `length` bytes has an anchor, the smallest k-gram hash in it; a run of windows with one anchor is a row.
   Each task first sorts its own rows and settles all but the first of each class of equal runs, so however many copies
   there are, a class sends one row a task; these rows are dealt by the anchor's hash, so equal windows meet.
2. Runs of equal bytes, by their anchor's hash and a cryptographic digest of 128 bits, are one string at several places: all but the
   earliest are covered whole, as each of their windows is its neighbour's. Anchors with one such string are done.
3. The remaining strings are suffix-sorted, some anchors together in a shard, by external induced sorting with common
   prefixes (induced.py). Neighbours that share `length` bytes are equal windows; all but the earliest are covered. A shard holds
   whole anchors; it is as large as its largest needs, and what is beyond MEMORY lies on disk.
4. What is covered goes back to its document.

Null text is empty; texts shorter than `length` keep all bytes. A null doc_id is larger than any other. Rows that repeat
a doc_id and its text count as one document and all get its result; rows that share a doc_id with other texts are ordered by a hash of
the text. Very long texts are hashed in overlapping pieces. Other columns do not matter.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.anchors import CHUNK, anchors, gram
from quoin.llm.common import BATCH_BYTES, settled
from quoin.llm.induced import Room, suffixes

LENGTH = 100
#: Bytes of documents hashed at once; bytes of runs sorted at once, where an anchor does not need more.
HASHED, SHARD = 1 << 19, 1 << 21
#: Bytes that the sort of a shard may hold.
MEMORY = 128 << 20
#: A run's first window and number of windows share a long.
LOW = 16
RUN = ("hash", "same", "more", "doc_id", "th", "at")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text as bytes); th tells documents with the same doc_id apart."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    clash = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows.withColumn("th", F.xxhash64("text") if clash else F.lit(0).cast("long")).select("doc_id", "th", "text")


def runs(length: int):
    """From documents: a row RUN for each run of windows with one anchor; same and more: the digest of its bytes; at: first window and windows."""
    k = gram(length)

    def flush(ids, ths, offsets, pieces):
        ends = np.cumsum([len(p) for p in pieces])
        whole = b"".join(pieces)
        h, first, n = anchors(np.frombuffer(whole, dtype=np.uint8), ends, length, k)
        of = np.searchsorted(ends, first, side="right")
        begin = ends - np.array([len(p) for p in pieces])
        lo = first - begin[of] + np.array(offsets)[of]
        view = memoryview(whole)
        digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)])
        same, more = np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.ascontiguousarray(same)), pa.array(np.ascontiguousarray(more)), pa.array(ids, pa.int64()).take(pa.array(of)), pa.array(np.array(ths)[of]), pa.array(lo << LOW | n)], names=RUN)

    def run(batches):
        ids, ths, offsets, pieces, held = [], [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, th, text = (c[i].as_py() for c in batch.columns)
                if len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, CHUNK // 2):
                    piece = text[at : at + CHUNK // 2 + length - 1]
                    if held + len(piece) > HASHED and pieces:
                        yield flush(ids, ths, offsets, pieces)
                        ids, ths, offsets, pieces, held = [], [], [], [], 0
                    ids.append(doc)
                    ths.append(th)
                    offsets.append(at)
                    pieces.append(piece)
                    held += len(piece)
        if pieces:
            yield flush(ids, ths, offsets, pieces)

    return run


class Sorted:
    """What a batch of rows RUN, sorted, shows, given the row before it."""

    def __init__(self) -> None:
        self.before, self.like_first = None, False

    def read(self, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hash; whether a row begins an anchor; a class; is neither its class's first nor at the very place of it."""
        h, *digest = (c.to_numpy() for c in rows[:3])
        place = [c.fill_null(2**63 - 1).to_numpy() for c in rows[3:6]]
        n = len(h)
        new_h, new_c, moved = (np.ones(n, dtype=bool) for _ in range(3))
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = np.logical_or.reduce([new_h[1:], *(d[1:] != d[:-1] for d in digest)])
        moved[1:] = np.logical_or.reduce([new_c[1:], *(p[1:] != p[:-1] for p in place)])
        if self.before is not None:
            was_h, was_digest, was_place = self.before
            new_h[0] = h[0] != was_h
            new_c[0] = new_h[0] or any(d[0] != b for d, b in zip(digest, was_digest, strict=True))
            moved[0] = new_c[0] or any(p[0] != b for p, b in zip(place, was_place, strict=True))
        # rows at the very place of their class's first are the same document again: not covered
        start = np.maximum.accumulate(np.where(moved, np.arange(n), -1))
        first_like = np.where(start >= 0, new_c[np.maximum(start, 0)], self.like_first)
        self.before, self.like_first = (h[-1], [d[-1] for d in digest], [p[-1] for p in place]), bool(first_like[-1])
        return h, new_h, new_c, ~new_c & ~first_like


def firsts(batches):
    """From a task's runs in order: the first of each class (kind 1) and those that it covers (kind 0), which need no further look."""
    seen = Sorted()
    for batch in batches:
        if not batch.num_rows:
            continue
        h, _, new_c, covered = seen.read(batch.columns)
        keep = np.flatnonzero(covered | new_c)
        # covered rows are dealt by their place
        deal = np.where(covered, batch.column(5).to_numpy() * 0x9E3779B1 ^ batch.column(3).fill_null(0).to_numpy(), h)
        kind = np.where(covered, 0, 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(deal[keep]), pa.array(kind[keep]), *(c.take(pa.array(keep)) for c in batch.columns)], names=["deal", "kind", *RUN])


def classes(batches):
    """From the tasks' rows sorted by (kind, hash, same, place): all that are covered whole (kind 0), and the first of each class where an anchor has several (kind 1).

    Holds one batch, the row before it, and the first row of the anchor at hand.
    """
    names = ["kind", "hash", "doc_id", "th", "at"]
    seen, pending, sent = Sorted(), None, True
    for batch in batches:
        settled_rows = int(np.count_nonzero(batch.column(1).to_numpy() == 0))  # they come first
        if settled_rows:
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(0, settled_rows) for i in (1, 2, 5, 6, 7)], names=names)
        rows = [c.slice(settled_rows) for c in batch.columns[2:]]
        if not len(rows[0]):
            continue
        _, new_h, new_c, covered = seen.read(rows)
        more = new_c & ~new_h  # first of a further class
        group = np.cumsum(new_h)
        several = np.bincount(group, weights=more, minlength=group[-1] + 1) > 0
        rep = more | (new_h & several[group])
        if several[0] and not sent:  # of the anchor that began in an earlier batch
            yield pending
            sent = True
        kind = np.where(covered, 0, 1)
        keep = np.flatnonzero(covered | rep)
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep].astype(np.int32)), *(rows[i].take(pa.array(keep)) for i in (0, 3, 4, 5))], names=names)
        if new_h.any():
            at = int(np.flatnonzero(new_h)[-1])
            pending = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(rows[i].slice(at, 1) for i in (0, 3, 4, 5))], names=names)
            sent = bool(several[group[-1]])


def cut(length: int):
    """From (doc_id, th, text, list of (hash, at)): each run's bytes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, th, text, wanted = (c[i].as_py() for c in batch.columns)
                for start in range(0, len(wanted), 20_000):
                    part = wanted[start : start + 20_000]
                    lo = [w["at"] >> LOW for w in part]
                    data = [text[a : a + (w["at"] & (1 << LOW) - 1) + length - 1] for a, w in zip(lo, part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([w["hash"] for w in part], pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array([th] * len(part), pa.int64()), pa.array(lo, pa.int64()), pa.array(data, pa.binary())], names=["hash", "doc_id", "th", "lo", "data"])

    return run


def repeats(strings: Iterable[bytes], length: int, room: Room, marked: np.ndarray | None = None) -> np.ndarray:
    """Marks the places, in the strings laid end to end with a byte behind each, where a window begins that begins earlier too. Neighbours in the order of suffixes that share `length` bytes are one group; its least place stays."""
    least = -1  # of the group that goes on
    for places, common in suffixes(strings, depth=length, room=room):
        if marked is None:
            marked = room.array(room.size, np.bool_)
        same = common >= length
        if not same.any():
            least = int(places[-1])
            continue
        edge = np.flatnonzero(~same) if not same[0] else np.append(0, np.flatnonzero(~same))
        lows = np.minimum.reduceat(places, edge)
        if same[0] and least >= 0:
            if least > lows[0]:
                marked[least] = True
            lows[0] = min(least, lows[0])
        group = np.cumsum(~same) - (0 if same[0] else 1)
        marked[places[places != lows[group]]] = True
        least = int(lows[-1])
    return marked if marked is not None else np.zeros(0, dtype=bool)


PLACE = np.dtype([("doc", "<i8"), ("th", "<i8"), ("lo", "<i8"), ("none", "?")])


def shards(length: int, shard: int = SHARD, memory: int = MEMORY):
    """From strings sorted by hash and place: covered stretches of windows. A shard holds whole anchors; its strings go straight to the sort's room, their places to a file beyond an eighth of `memory`."""

    def rows_of(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches):
        rows = rows_of(batches)
        row = next(rows, None)
        while row is not None:
            room = Room(memory)
            with tempfile.SpooledTemporaryFile(max_size=memory // 8) as spool:

                def strings():
                    nonlocal row
                    held, last, before = 0, None, None
                    while row is not None and (row[0] == last or held < shard):
                        last, *place, data = row
                        if place != before:  # a repeated document sends the same place twice
                            doc, th, lo = place
                            spool.write(np.array([(doc or 0, th, lo, doc is None)], dtype=PLACE).tobytes())
                            held += len(data)
                            before = place
                            yield data
                        row = next(rows, None)

                marked = repeats(strings(), length, room)
                yield from stretches(marked, room, spool)

    def stretches(marked, room, spool):
        for a, b in room.pieces(0, len(marked)):
            found = np.flatnonzero(marked[a:b]) + a
            if not len(found):
                continue
            of = np.searchsorted(room.ends, found)
            at = np.flatnonzero(np.append(True, (found[1:] != found[:-1] + 1) | (of[1:] != of[:-1])))
            n, of, begin = np.diff(np.append(at, len(found))), of[at], found[at]
            some, where = np.unique(of, return_inverse=True)
            spool.seek(int(some[0]) * PLACE.itemsize)
            place = np.frombuffer(spool.read((int(some[-1]) - int(some[0]) + 1) * PLACE.itemsize), dtype=PLACE)[some - some[0]][where]
            lo = place["lo"] + begin - np.where(of > 0, room.ends[np.maximum(of - 1, 0)] + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(place["doc"], pa.int64(), mask=place["none"]), pa.array(place["th"], pa.int64()), pa.array(lo << LOW | n, pa.int64())], names=["doc_id", "th", "at"])

    return run


def stripped(length: int):
    """From (doc_id, th, text, covered runs): what is left, and the removed spans."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                doc, _, text, covered = (c[i].as_py() for c in batch.columns)
                spans: list[list[int]] = []
                for w in sorted(covered or ()):
                    a = w >> LOW
                    b = a + (w & (1 << LOW) - 1) + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                left, at = [], 0
                for a, b in spans:
                    left.append(text[at:a])
                    at = b
                kept = b"".join([*left, text[at:]]) if spans else text
                out.append((doc, len(text), len(text) - len(kept), spans, kept))
                held += len(kept)
                if held >= BATCH_BYTES:
                    yield answer(out)
                    out, held = [], 0
            if out:
                yield answer(out)

    def answer(rows):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_bytes, n_removed, removed (array of [start, end)), kept (binary)."""
    if not 3 <= length < 1 << (LOW - 1):
        raise ValueError("length must be from 3 to 32767")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    run = "hash long, same long, more long, doc_id long, th long, at long"
    found = rows.mapInArrow(runs(length), run)
    order = ("hash", "same", "more", F.col("doc_id").asc_nulls_last(), "th", "at")
    own = found.sortWithinPartitions(*order).mapInArrow(firsts, f"deal long, kind int, {run}")
    in_order = own.repartition(parts, "deal").sortWithinPartitions("kind", *order)
    marked = settled(in_order.mapInArrow(classes, "kind int, hash long, doc_id long, th long, at long"), "runs")
    wanted = marked.where("kind = 1").groupBy("doc_id", "th").agg(F.collect_list(F.struct("hash", "at")).alias("runs"))
    joined = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["th"] == other["th"])
    data = rows.join(wanted, joined(wanted)).select(rows["doc_id"], rows["th"], "text", "runs").mapInArrow(cut(length), "hash long, doc_id long, th long, lo long, data binary")
    placed = data.repartition(parts, "hash").sortWithinPartitions("hash", F.col("doc_id").asc_nulls_last(), "th", "lo")
    covered = marked.where("kind = 0").select("doc_id", "th", "at").unionByName(placed.mapInArrow(shards(length), "doc_id long, th long, at long"))
    lists = covered.groupBy("doc_id", "th").agg(F.collect_list("at").alias("covered"))
    whole = rows.join(lists, joined(lists), "left").select(rows["doc_id"], rows["th"], "text", "covered")
    return whole.mapInArrow(stripped(length), "doc_id long, n_bytes long, n_removed long, removed array<array<long>>, kept binary")
