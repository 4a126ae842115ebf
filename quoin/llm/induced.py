"""Suffixes in order, with common prefixes, by external induced sorting.

The text is a row of strings, each closed by a terminator of its own (ordered by place), so that no comparison
leaves a string. Suffixes are of type S where they are smaller than their successor, else L; leftmost S suffixes are sampled.
Their substrings are sorted by induction and named, and the names' suffixes are sorted. The sampled order then induces all L
suffixes bucket by bucket upwards and all S suffixes downwards. Tuples (position, common prefix with the one before) wait in
priority queues whose buckets, one a symbol, lie on disk beyond a budget and are read in pieces from either end. A
tuple's common prefix is one more than the least of those between the tuples that induced it and its predecessor; these minima are
carried along by target bucket.

The string of names has too many symbols for a bucket each: it is sorted by doubling, in blocks of its groups of equal rank;
a group beyond a block is dealt by ranges of its keys. Text, words, places, ranks and orders are arrays of a Room: in memory within
the budget, beyond it in mapped files of the task, which go with it. What a sort holds besides is pieces of `memory // 64` numbers,
whatever the size of the text.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

SYMBOLS = 257  # 0: a terminator; 1 to 256: a byte
BIG = 32767
#: Bytes that a sort holds in arrays, and in tuples; beyond that they go to files.
MEMORY = 256 << 20
#: A place of the text: nine bits of symbol, then whether its suffix is of type S, and whether it is sampled.
SYMBOL, S, SAMPLED = np.uint16(511), np.uint16(512), np.uint16(1024)
#: Symbols in a word.
WIDE = 7


class Room:
    """Arrays of one sort: in memory while `memory` bytes last, then in mapped files that are gone with the task."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.left, self.files = memory, memory, 0
        self.piece = max(64, memory // 64)
        self.size, self.ends = 0, np.zeros(0, np.int64)  # of the text that is sorted here, and its terminators

    def array(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if not n or size <= self.left:
            self.left -= size
            return np.zeros(n, dtype=kind)
        self.files += 1
        return np.memmap(tempfile.TemporaryFile(), dtype=kind, mode="w+", shape=(n,))

    def pieces(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        for a in range(start, stop, self.piece):
            yield a, min(a + self.piece, stop)


class BucketQueue:
    """A monotone priority queue: tuples of arrays by bucket, in order of arrival; beyond `memory` bytes they go to a file."""

    def __init__(self, buckets: int, kinds: tuple, memory: int, piece: int) -> None:
        self.kinds, self.memory, self.piece, self.held = tuple(map(np.dtype, kinds)), memory, piece, 0
        self.parts: list[deque] = [deque() for _ in range(buckets)]  # arrays, or (place in the file, tuples there, first, one behind the last)
        self.live: set[int] = set()  # buckets with arrays in memory
        self.file, self.end = None, 0

    def push(self, bucket: int, *arrays: np.ndarray) -> None:
        self.parts[bucket].append(arrays)
        self.live.add(bucket)
        self.held += sum(a.nbytes for a in arrays)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for b in sorted(self.live):
            waiting, here = self.parts[b], []
            while waiting and isinstance(waiting[-1][0], np.ndarray):
                here.append(waiting.pop())
            if here:
                n = sum(len(a[0]) for a in here)
                waiting.append((self.end, n, 0, n))
                for i, kind in enumerate(self.kinds):
                    for arrays in reversed(here):
                        self.file.write(np.ascontiguousarray(arrays[i], dtype=kind).data)
                self.end += n * sum(k.itemsize for k in self.kinds)
        self.live.clear()
        self.held = 0

    def pop(self, bucket: int, last: bool = False) -> tuple[np.ndarray, ...]:
        """Up to a piece of what waits in a bucket, from its front or its end; in order of arrival."""
        waiting, parts, room = self.parts[bucket], [], self.piece
        while waiting and room > 0:
            part = waiting.pop() if last else waiting.popleft()
            if isinstance(part[0], np.ndarray):
                if len(part[0]) > room:
                    cut = len(part[0]) - room if last else room
                    rest, part = (part, tuple(a[cut:] for a in part)) if last else (part, tuple(a[:cut] for a in part))
                    rest = tuple(a[:cut] for a in rest) if last else tuple(a[cut:] for a in rest)
                    waiting.append(rest) if last else waiting.appendleft(rest)
                self.held -= sum(a.nbytes for a in part)
            else:
                at, n, i, j = part
                if j - i > room:
                    cut = j - room if last else i + room
                    waiting.append((at, n, i, cut)) if last else waiting.appendleft((at, n, cut, j))
                    i, j = (cut, j) if last else (i, cut)
                got = []
                for k in self.kinds:
                    self.file.seek(at + i * k.itemsize)
                    got.append(np.frombuffer(self.file.read((j - i) * k.itemsize), dtype=k))
                    at += n * k.itemsize
                part = tuple(got)
            parts.append(part)
            room -= len(part[0])
        if last:
            parts.reverse()
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(self.kinds))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """Strings with terminators: symbols and types, words, terminators' places, sampled places."""

    def __init__(self, strings: Iterable[bytes], room: Room) -> None:
        self.room, held, count = room, 0, 0
        size = max(1, room.memory // 8)
        with tempfile.SpooledTemporaryFile(max_size=size) as spool, tempfile.SpooledTemporaryFile(max_size=size) as lasts:
            for s in strings:
                spool.write(s)
                spool.write(b"\0")
                held += len(s) + 1
                count += 1
                lasts.write((held - 1).to_bytes(8, "little"))
            self.t, self.ends = room.array(held, np.uint16), room.array(count, np.int64)
            spool.seek(0)
            for a, b in room.pieces(0, held):
                self.t[a:b] = np.frombuffer(spool.read(b - a), dtype=np.uint8)
                self.t[a:b] += np.uint16(1)
            lasts.seek(0)
            for a, b in room.pieces(0, count):
                self.ends[a:b] = np.frombuffer(lasts.read(8 * (b - a)), dtype="<i8")
        for a, b in room.pieces(0, count):
            self.t[self.ends[a:b]] = 0
        room.size, room.ends = held, self.ends
        self._types()

    def _types(self) -> None:
        t, n, room = self.t, len(self.t), self.room
        following, rising, sampled = -1, True, 0  # symbol and type behind the piece
        self.first = np.zeros(SYMBOLS, dtype=np.int64)  # sampled places by symbol
        for a, b in reversed(list(room.pieces(0, n))):
            x = t[a:b].astype(np.int32)
            after = np.append(x[1:], following)
            other = x != after
            if b == n:
                other[-1] = True
            m = b - a
            change = np.where(other, np.arange(m), m)
            nearest = np.minimum.accumulate(change[::-1])[::-1]  # end of the run of equal symbols
            up = np.append(x < after, rising)
            if b == n:
                up[m - 1] = True
            s = up[nearest]
            t[a:b] |= s * S
            following, rising = int(x[0]), bool(s[0])
        before = True
        for a, b in room.pieces(0, n):
            s = (t[a:b] & S) > 0
            hit = s & ~np.append(before, s[:-1])
            before = bool(s[-1])
            t[a:b] |= hit * SAMPLED
            self.first += np.bincount(t[a:b][hit] & SYMBOL, minlength=SYMBOLS)
            sampled += int(hit.sum())
        self.places, self.number, self.close = (room.array(k, np.int64) for k in (sampled, n, sampled))  # number: of a place among the sampled; close: the terminator behind
        at = 0
        for a, b in room.pieces(0, n):
            some = np.flatnonzero(t[a:b] & SAMPLED) + a
            self.places[at : at + len(some)] = some
            self.number[some] = np.arange(at, at + len(some))
            self.close[at : at + len(some)] = self.ends[np.searchsorted(self.ends, some)]
            at += len(some)

    def words(self) -> np.ndarray:
        """WIDE symbols in one number, at each place."""
        n = len(self.t)
        out = self.room.array(n, np.uint64)
        for a, b in self.room.pieces(0, n):
            x = np.append(self.t[a : b + WIDE - 1] & SYMBOL, np.zeros(max(0, b + WIDE - 1 - n), np.uint16)).astype(np.uint64)
            word = x[: b - a] << np.uint64(9 * (WIDE - 1))
            for i in range(1, WIDE):
                word |= x[i : i + b - a] << np.uint64(9 * (WIDE - 1 - i))
            out[a:b] = word
        return out

    def run(self, p: int) -> int:
        """How many equal symbols begin at p, up to BIG."""
        c, n, step = int(self.t[p] & SYMBOL), 1, 16
        if not c:
            return 0
        while n < BIG:
            some = (self.t[p + n : p + n + step] & SYMBOL) != c
            if some.any():
                return min(BIG, n + int(some.argmax()))
            n, step = n + len(some), 4 * step
            if not len(some):
                break
        return min(n, BIG)


class Scan:
    """One direction of induction."""

    def __init__(self, text: Text, queue: BucketQueue, wanted: int, common: bool) -> None:
        self.t, self.queue, self.wanted, self.common = text.t, queue, wanted, common
        self.least = np.full(SYMBOLS, BIG, dtype=np.int16)  # by target bucket: least common prefix since its last tuple

    def __call__(self, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """Pushes the predecessors that have the wanted type, in order."""
        before = pos - 1
        symbol = np.asarray(self.t[before])  # place -1 is the last terminator, of type S; symbol 0 is left out
        target = symbol & SYMBOL
        at = np.flatnonzero(((symbol & S) == self.wanted) & (target > 0) & (pos > 0))
        if not len(at):
            if self.common and len(lcp):
                np.minimum(self.least, lcp.min(), out=self.least)
            return
        d = target[at]
        order = np.argsort(d, kind="stable")
        at, d = at[order], d[order]
        edge = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        stop = np.append(edge[1:], len(d))
        buckets = d[edge].astype(np.int64)
        moved = before[at]
        if not self.common:
            for b, i, j in zip(buckets.tolist(), edge.tolist(), stop.tolist(), strict=True):
                self.queue.push(b, moved[i:j])
            return
        low = np.append(lcp, np.int16(BIG))
        begin = np.empty(len(at), dtype=np.int64)
        begin[1:] = at[:-1] + 1
        begin[edge] = 0
        spans = np.empty(2 * len(at), dtype=np.int64)
        spans[::2], spans[1::2] = begin, at + 1
        value = np.minimum.reduceat(low, spans)[::2]
        value[edge] = np.minimum(value[edge], self.least[buckets])
        value = np.minimum(value, BIG - 1) + np.int16(1)
        np.minimum(self.least, lcp.min(), out=self.least)
        tails = at[stop - 1] + 1  # what follows the last tuple of each target
        self.least[buckets] = np.minimum.accumulate(low[::-1])[::-1][tails]
        for b, i, j in zip(buckets.tolist(), edge.tolist(), stop.tolist(), strict=True):
            self.queue.push(b, moved[i:j], value[i:j])


def induce(text: Text, order: np.ndarray, order_lcp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """From sampled suffixes in order (by first symbol only, or whole): all suffixes from the largest down, in pieces, each with its common prefix with the one before in this order, if those of `order` were given."""
    common, room = order_lcp is not None, text.room
    kinds = (np.int64, np.int16) if common else (np.int64,)
    up, done, down = (BucketQueue(SYMBOLS, kinds, room.memory // 4, room.piece) for _ in range(3))
    edges = np.append(0, np.cumsum(text.first))
    scan = Scan(text, up, 0, common)
    for c in range(SYMBOLS):
        last = -1
        while len((got := up.pop(c))[0]):
            if common and last < 0:
                got = (got[0], got[1].copy())
                got[1][0] = 0
            done.push(c, *got)
            scan(got[0], got[1] if common else None)
            last = int(got[0][-1])
        for a, b in room.pieces(int(edges[c]), int(edges[c + 1])):
            pos, lcp = np.array(order[a:b]), None
            if common:
                lcp = np.array(order_lcp[a:b])
                if a == edges[c]:
                    lcp[0] = min(text.run(last), text.run(int(pos[0]))) if last >= 0 else 0
            scan(pos, lcp)
    up.close()
    scan = Scan(text, down, int(S), common)
    for c in range(SYMBOLS - 1, 0, -1):
        last = -1
        while len((got := down.pop(c))[0]):
            if common and last < 0:
                got = (got[0], got[1].copy())
                got[1][0] = 0
            scan(got[0], got[1] if common else None)
            last = int(got[0][-1])
            yield got[0], got[1] if common else None
        carried = None
        while len((got := done.pop(c, last=True))[0]):
            back, lcp = got[0][::-1], None
            if common:
                if carried is None:
                    carried = min(text.run(last), text.run(int(back[0]))) if last >= 0 else 0
                lcp = np.append(np.int16(carried), got[1][1:][::-1])
                carried = int(got[1][0])
            scan(back, lcp)
            yield back, lcp
    done.close()
    down.close()


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols are equal from places a and b on, of at most `most`."""
    out = np.zeros(len(a), dtype=np.int64)
    live, at, top = np.arange(len(a)), 0, len(words) - 1
    while len(live):
        x = words[np.minimum(a[live] + at, top)] ^ words[np.minimum(b[live] + at, top)]
        equal = x == 0
        other = x[~equal]
        out[live[~equal]] = at + sum((other < np.uint64(1 << 9 * k)).astype(np.int64) for k in range(1, WIDE))
        live, at = live[equal], at + WIDE
        out[live] = at
        live = live[at < most[live]]
    return np.minimum(out, most)


def named(text: Text, ranked: np.ndarray, words: np.ndarray) -> np.ndarray:
    """By rank: does a sampled substring differ from the one before?"""
    places, n = text.places, len(text.t)
    new = text.room.array(len(ranked), np.bool_)
    new[:1] = True
    for a, b in text.room.pieces(1, len(ranked)):
        some = np.array(ranked[a - 1 : b])
        at = text.number[some]
        to = np.where(at + 1 < len(places), places[np.minimum(at + 1, len(places) - 1)], n - 1)
        size = to - some + 1
        x, y = some[:-1], some[1:]
        fit = np.flatnonzero((size[1:] == size[:-1]) & ((text.t[y] & SYMBOL) > 0))
        # a substring that ends on a terminator ends on one of its own
        fit = fit[(text.t[y[fit] + size[1:][fit] - 1] & SYMBOL) > 0]
        differs = np.ones(b - a, dtype=bool)
        differs[fit] = common(words, x[fit], y[fit], size[1:][fit]) < size[1:][fit]
        new[a:b] = differs
    return new


def split_by(room: Room, own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """own in the order of keys, both arrays beyond a piece: dealt by ranges of keys that fit, range by range."""
    n = len(own)
    out, out_keys = room.array(n, np.int64), room.array(n, np.int64)
    sample = np.sort(keys[:: max(1, n // room.piece)])
    step = max(1, len(sample) * room.piece // (2 * n))
    walls = [*np.unique(sample[::step]).tolist(), None]
    at, low = 0, None
    for high in walls:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for one in (False, True):  # what lies between two walls, then what equals the upper
            for a, b in room.pieces(0, n):
                k = np.array(keys[a:b])
                if one:
                    take = k == high if high is not None else np.zeros(b - a, dtype=bool)
                else:
                    take = (k > low if low is not None else np.ones(b - a, dtype=bool)) & (k < high if high is not None else True)
                if not take.any():
                    continue
                some, mine = np.array(own[a:b])[take], k[take]
                if one:  # equal keys need no order
                    out[at : at + len(some)], out_keys[at : at + len(some)] = some, mine
                    at += len(some)
                else:
                    waiting.append((some, mine))
            if not one and waiting:
                some, mine = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
                o = np.argsort(mine, kind="stable")
                out[at : at + len(o)], out_keys[at : at + len(o)] = some[o], mine[o]
                at += len(o)
                waiting = []
        low = high
    keys[:] = out_keys
    return out


def doubled(room: Room, index: np.ndarray, new: np.ndarray, depth: int) -> np.ndarray:
    """index: sampled places, by number, in the order of their names; new: where a name begins. The same, in the order of the names' suffixes, as far as `depth` symbols."""
    m = len(index)
    rank = room.array(m, np.int64)  # of each number: where its group begins
    active, count = room.array(m, np.int64), 0  # places in index that are in groups of several
    start = 0
    for a, b in room.pieces(0, m):
        x = np.where(new[a:b], np.arange(a, b), 0)
        x[0] = max(x[0], start)
        x = np.maximum.accumulate(x)
        start = int(x[-1])
        rank[index[a:b]] = x
    single = lambda a, b: np.append(new[a + 1 : b + 1], True)[: b - a] & new[a:b]
    for a, b in room.pieces(0, m):
        some = np.flatnonzero(~single(a, b)) + a
        active[count : count + len(some)] = some
        count += len(some)
    h = 1
    while count and 2 * h < max(depth, 2):  # h names are at least 2 * h symbols
        kept, at = 0, 0
        while at < count:
            to = min(count, at + room.piece)
            where = np.array(active[at:to])
            group = rank[index[where]]
            if to < count and rank[index[active[to]]] == group[-1]:  # whole groups only
                cut = int(np.searchsorted(group, group[-1]))
                if not cut:  # one group is more than a piece
                    first = int(group[0])
                    while to < count and rank[index[active[to]]] == first:
                        ahead = np.flatnonzero(rank[index[active[to : to + room.piece]]] != first)
                        to = to + int(ahead[0]) if len(ahead) else min(count, to + room.piece)
                    n = to - at
                    own, keys = room.array(n, np.int64), room.array(n, np.int64)
                    for a, b in room.pieces(0, n):
                        own[a:b] = index[first + a : first + b]
                        keys[a:b] = np.where(own[a:b] + h < m, rank[np.minimum(own[a:b] + h, m - 1)], -1)
                    own = split_by(room, own, keys)
                    begin, before = first, None
                    for a, b in room.pieces(0, n):
                        fresh = np.append(before is None or keys[a] != before, keys[a + 1 : b] != keys[a : b - 1])
                        x = np.where(fresh, np.arange(first + a, first + b), 0)
                        x[0] = max(x[0], begin)
                        x = np.maximum.accumulate(x)
                        begin, before = int(x[-1]), keys[b - 1]
                        index[first + a : first + b] = own[a:b]
                        rank[own[a:b]] = x
                        new[first + a : first + b] = fresh
                    for a, b in room.pieces(first, to - at + first):
                        last = np.append(new[a + 1 : b + 1], True)[: b - a]
                        some = np.flatnonzero(~(last & new[a:b])) + a
                        active[kept : kept + len(some)] = some
                        kept += len(some)
                    at = to
                    continue
                to, where, group = at + cut, where[:cut], group[:cut]
            own = index[where]
            key = np.where(own + h < m, rank[np.minimum(own + h, m - 1)], -1)
            o = np.argsort(group * (m + 1) + key + 1) if m < 1 << 31 else np.lexsort((key, group))
            own, key = own[o], key[o]
            fresh = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
            begin = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
            index[where] = own
            rank[own] = begin
            new[where] = fresh
            some = where[~(fresh & np.append(fresh[1:], True))]
            active[kept : kept + len(some)] = some
            kept += len(some)
            at = to
        count, h = kept, 2 * h
    return index


def sampled_order(text: Text, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled suffixes in order, and their numbers: induction of their substrings, names, the order of the names' suffixes."""
    room, places, t = text.room, text.places, text.t
    m = len(places)
    start, fill = room.array(m, np.int64), np.append(0, np.cumsum(text.first))[:-1]
    for a, b in room.pieces(0, m):
        some = np.array(places[a:b])
        c = t[some] & SYMBOL
        o = np.argsort(c, kind="stable")
        c, some = c[o], some[o]
        edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        within = np.arange(len(c)) - np.repeat(edge, np.diff(np.append(edge, len(c))))
        start[fill[c] + within] = some
        fill += np.bincount(c, minlength=SYMBOLS)
    ranked, at = room.array(m, np.int64), m
    for pos, _ in induce(text, start, None):
        some = pos[(t[pos] & SAMPLED) > 0]
        ranked[at - len(some) : at] = some[::-1]
        at -= len(some)
    ranked[:at] = start[:at]  # terminators, by place
    new = named(text, ranked, words)
    for a, b in room.pieces(0, m):
        start[a:b] = text.number[ranked[a:b]]
    index = doubled(room, start, new, depth)
    for a, b in room.pieces(0, m):
        ranked[a:b] = places[index[a:b]]
    return ranked, index


def common_prefixes(text: Text, order: np.ndarray, index: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Of neighbours among sampled suffixes, within their strings, up to `most`."""
    out = text.room.array(len(order), np.int16)
    for a, b in text.room.pieces(1, len(order)):
        some = np.array(order[a - 1 : b])
        left = text.close[index[a - 1 : b]] - some  # symbols before the terminator
        out[a:b] = common(words, some[:-1], some[1:], np.minimum(np.minimum(left[1:], left[:-1]), most))
    return out


def suffixes(strings: Iterable[bytes], memory: int = MEMORY, depth: int | None = None, room: Room | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of all suffixes from the largest down: places (in the strings laid end to end, with a terminator after each), and each one's common prefix with the one before in this order.

    With depth, suffixes that share so many bytes may stand in any order, and prefixes above it may be given as anything from depth on.
    """
    text = Text(strings, room or Room(memory))
    if not len(text.t):
        return
    words = text.words()
    order, index = sampled_order(text, words, 1 << 60 if depth is None else depth)
    yield from induce(text, order, common_prefixes(text, order, index, words, BIG - 1 if depth is None else min(depth, BIG - 1)))
