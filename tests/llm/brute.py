"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def removed(docs, length):
    """{(doc_id, text bytes): set of covered places}; docs: (doc_id, text bytes), distinct."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    first, out = {}, {}
    for d, (i, t) in enumerate(order):
        gone = out.setdefault((i, t), set())
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            if first.setdefault(s, (d, a)) != (d, a):
                gone.update(range(a, a + length))
    return out


def spans(places):
    return sum(p - 1 not in places for p in places)


def fingerprint(text, words=4, seed=42):
    parts = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text)) if w]
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), seed) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= radius) + i + 1:
            parent[root(i)] = root(int(j))
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[root(i)].append(x)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def base_spans(text):
    def luhn(s):
        t = 0
        for i, c in enumerate(reversed(s)):
            x = int(c) * (1 + i % 2)
            t += x - 9 * (x > 9)
        return t % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    out = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def top_inner(vectors, every, k, scale=64):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors]
    out = []
    for i, q in {(i, tuple(v)): (i, v) for i, v in rows}.values():  # a repeated row asks once
        if i % every == 0:
            got = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in rows if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(got, 1)]
    return sorted(out)


def sha(x):
    return hashlib.sha256(x).hexdigest()
