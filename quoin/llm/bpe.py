"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair whose bytes have a rank waits in the bucket of
that rank; words of 2^WORD bits say which buckets hold something, and one word above says which of them do, so the
lowest rank is found by two find-first-set steps. Entries whose pair has changed since are stale and are skipped. A pre-token of
n bytes takes O(n log n) steps however long it is, where rescanning takes O(n^2).

Null text is taken as empty; empty text has no ids. Bytes that are not UTF-8 are replaced by U+FFFD first.
Repeated rows give repeated results. Columns beside the text column are kept as they are.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from quoin.llm.common import annotated

#: Pre-tokens whose ids a worker remembers: so many recent ones, and as many that were remembered before those. Only speed depends on it.
MEMO = 300_000
#: Likewise words, which cost less to put together again from their pre-tokens.
MEMO_WORDS = 100_000
#: Longer ones are never remembered.
MEMO_CHARS = 64
#: Bits of a bitmap word.
WORD = 8
LAST = (1 << WORD) - 1

#: White space and what follows up to the next: no pre-token reaches over such a piece's ends.
pieces = re.compile(r"\s*\S+|\s+").findall
#: White space to re, but not by the Unicode property.
unsure = re.compile("[\x1c-\x1f]").search


class Codec(dict):
    """Maps a piece of text to its ids as little-endian unsigned 32-bit integers; a memo of bounded size in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # a pair of tokens has the rank of its bytes, however they are parted: by its first token, then its second
        self.pairs: list[dict[int, int]] = [{}] * (self.size + 1)  # the last is that of no token
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None:
                    if not self.pairs[x]:
                        self.pairs[x] = {}
                    self.pairs[x][y] = rank
        self.bytes = [ranks.get(bytes([b])) for b in range(256)]
        self.doubles = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]  # ranks of two bytes
        self.buckets: list[int | list[int] | None] = [None] * self.size  # the position of a rank, or several as a heap
        self.words = [0] * ((self.size >> WORD) + 1)  # which buckets of a word hold something
        self.parts: dict[str, bytes] = {}
        self.earlier: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # pieces and parts that gave way; those met again come back
        # \s in the pattern means the Unicode White_Space property
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, pairs, doubles, buckets, words = len(piece), self.pairs, self.doubles, self.buckets, self.words
        none = self.size  # stands behind the last token and, as index -1, before the first; it pairs with nothing
        token = [*map(self.bytes.__getitem__, piece), none]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        now = [doubles[x << 8 | y] for x, y in zip(piece, piece[1:])]  # the rank of the pair that begins here, or -1
        top = 0  # which words hold something
        for i, r in enumerate(now):
            if r >= 0:
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = i
                    words[r >> WORD] |= 1 << (r & LAST)
                    top |= 1 << (r >> WORD)
                elif type(bucket) is int:
                    buckets[r] = [bucket, i]
                else:
                    bucket.append(i)  # in ascending order, hence a heap
        now += (-1, -1)
        while top:
            w = (top & -top).bit_length() - 1
            x = words[w]
            r = (w << WORD) + (x & -x).bit_length() - 1
            i = buckets[r]
            if type(i) is not int and len(i) > 1:
                i = heappop(i)
            else:
                if type(i) is not int:
                    i = i[0]
                buckets[r] = None
                words[w] = x = x & (x - 1)
                if not x:
                    top &= top - 1
            if now[i] != r:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            token[i] = r
            now[gone] = token[gone] = -1
            r2 = pairs[r].get(token[end])
            if r2 is None:
                now[i] = -1
            else:
                now[i] = r2
                bucket = buckets[r2]
                if bucket is None:
                    buckets[r2] = i
                    words[r2 >> WORD] |= 1 << (r2 & LAST)
                    top |= 1 << (r2 >> WORD)
                elif type(bucket) is int:
                    buckets[r2] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            j = before[i]
            r2 = pairs[token[j]].get(r)
            if r2 is None:
                now[j] = -1
            elif now[j] != r2:
                now[j] = r2
                bucket = buckets[r2]
                if bucket is None:
                    buckets[r2] = j
                    words[r2 >> WORD] |= 1 << (r2 & LAST)
                    top |= 1 << (r2 >> WORD)
                elif type(bucket) is int:
                    buckets[r2] = [bucket, j] if bucket < j else [j, bucket]
                else:
                    heappush(bucket, j)
        del token[n]
        return [t for t in token if t is None or t >= 0]

    def part(self, word: str) -> bytes:
        """The ids of a pre-token."""
        ids = self.parts.get(word)
        if ids is None:
            ids = self.earlier[1].get(word) or array("I", self.merge(word.encode("utf-8"))).tobytes()
            if len(word) <= MEMO_CHARS:
                if len(self.parts) >= MEMO:
                    self.earlier = self.earlier[0], self.parts
                    self.parts = {}
                self.parts[word] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.earlier[0].get(piece) or b"".join(map(self.part, self.split(piece)))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.earlier = dict(self), self.earlier[1]
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if unsure(text):
            return b"".join(map(self.part, self.split(text)))
        return b"".join(map(self.__getitem__, pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """Read once in each worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True) -> DataFrame:
    """docs without text, with _ids (binary: little-endian unsigned 32-bit ids) and _decoded (binary; null unless decode).

    path: a file of base64 tokens and ranks, installed on every worker.
    """

    def worker():
        c = codec(path, pattern)

        def coded(data: bytes | None) -> tuple:
            ids = c.encode((data or b"").decode("utf-8", "replace"))
            return ids, c.decode(ids) if decode else None

        return coded

    return annotated(docs, text, "_ids binary, _decoded binary", worker, keep_text=False)
