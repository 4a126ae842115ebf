"""Text operators against plain versions, on documents with the awkward cases."""

import base64
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quoin.llm import bpe, induced, mixing, pii, queries, simhash, suffix_dedup, toxicity
from quoin.llm.bpe import Codec

PATH = public_tokenizers.path(queries.VOCABULARY)
DDL = "doc_id long, text string, lang string, source string, n_chars long, _fp string, size int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "tion", "Élan", "ver", "hund", "x", "naïve", "straße"]) + rng.choice(["", "s", "ly.", ",", "!\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(25)]
    passage = prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t) for i, t in enumerate(base[:8])]
    out += [(200 + i, t.replace("the", "teh", 1) + " tail") for i, t in enumerate(base[:8])]
    out += [(300 + i, prose(rng, 10) + passage + prose(rng, 10)) for i in range(6)]
    out += [(400, None), (401, ""), (402, "  \n\t "), (403, "a"), (404, "a b c"), (405, prose(rng, 9000)), (406, "é" * 400), (407, "ab" * 600), (None, base[3]), (None, "nameless"), (408, "a b c 1234567 's I'll")]
    out += [(0, base[0]), (403, "a"), (5, "another text with the id of a fifth " * 5)]
    return [(i, t, "en", ["s1", "s2", None][k % 3], 0, "x", 1) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


def octets(t):
    return (t or "").encode()


@pytest.mark.parametrize("length", [100, 20])
def test_suffix_dedup(docs, rows, length):
    import xxhash  # the order of texts under one doc_id is that of their hash, as Spark makes it

    signed = lambda b: (x := xxhash.xxh64_intdigest(b, 42)) - (x >> 63 << 64)
    distinct = sorted({(i, octets(t)) for i, t, *_ in rows}, key=lambda d: signed(d[1]))
    want = brute.removed(distinct, length)
    got = {}
    for r in suffix_dedup.dedup(docs, length).collect():
        got.setdefault((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(bytes(r["kept"]))), 0)
        got[(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(bytes(r["kept"])))] += 1
    expected = {}
    for i, t, *_ in rows:
        b, gone = octets(t), want[(i, octets(t))]
        key = (i, len(b), len(gone), brute.spans(gone), brute.sha(bytes(x for k, x in enumerate(b) if k not in gone)))
        expected[key] = expected.get(key, 0) + 1
    assert got == expected


@pytest.mark.parametrize("memory", [1 << 20, 600])
def test_induced_suffix_order(memory):
    rng = random.Random(memory)
    for _ in range(60):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0 if k else 1, 60))) for k in range(rng.randint(1, 20))]
        places, at = [], 0
        for k, s in enumerate(strings):
            places += [([x + 1000 for x in s[i:]] + [k], at + i) for i in range(len(s))]
            at += len(s) + 1
        places.sort()
        got = list(induced.suffixes(strings, memory))
        assert np.concatenate([g[0] for g in got])[::-1].tolist() == [p for _, p in places]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert np.concatenate([g[1] for g in got])[::-1].tolist() == [common(a[0], b[0]) for a, b in zip(places, places[1:])] + [0]
        near = [(int(p), int(c) >= 5) for ps, cs in induced.suffixes(strings, memory, depth=5) for p, c in zip(ps, cs)]
        exact = {p: s[:5] for s, p in places}
        assert len(near) == len(places)
        assert all(c == (exact[p][:5] == exact[q][:5] and len(exact[p]) == 5 and min(exact[p]) >= 1000) for (q, _), (p, c) in zip(near, near[1:]))


def test_a_shard_far_larger_than_its_memory():
    import tracemalloc

    rng = random.Random(5)
    memory = 1 << 19
    line = [bytes(rng.randrange(1, 256) for _ in range(3)) + prose(rng, 20).encode() for _ in range(300)]
    strings = [b"".join(rng.choice(line) for _ in range(9)) for _ in range(5_500)]
    text = b"\0".join(strings) + b"\0"
    assert len(text) > 10 * memory
    room = induced.Room(memory)
    tracemalloc.start()
    seen, last, n = 0, None, 0
    for places, common in induced.suffixes(iter(strings), depth=100, room=room):
        n += len(places)
        seen ^= int(np.bitwise_xor.reduce(places))
        if last is not None:  # order and common prefixes at the pieces' ends
            a, b = text[last : last + 100].split(b"\0")[0], text[places[0] : places[0] + 100].split(b"\0")[0]
            assert a >= b and (int(common[0]) >= 100) == (a == b and len(a) == 100)
        last = int(places[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [p for p in range(len(text)) if text[p]]
    assert n == len(want) and seen == int(np.bitwise_xor.reduce(np.array(want)))
    assert room.files > 5 and peak < 6 * memory, peak


def test_shards_in_little_memory():
    import pyarrow as pa

    rng = random.Random(6)
    passage = [prose(rng, 30).encode() for _ in range(8)]
    rows = sorted((h, i % 90, 0, 7 * i, b"".join(rng.choice(passage) for _ in range(3))) for h in range(5) for i in range(1 if h == 3 else 80))
    rows += [(9, None, 5, 0, passage[0] * 2), (9, None, 5, 0, passage[0] * 2)]  # a repeated document
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 50]), [pa.int64()] * 4 + [pa.binary()])], names=["hash", "doc_id", "th", "lo", "data"]) for a in range(0, len(rows), 50)]

    def places(memory, shard):
        out = set()
        for made in suffix_dedup.shards(20, shard, memory)(iter(batches)):
            for doc, th, at in zip(*(c.to_pylist() for c in made.columns)):
                out |= {(doc, th, (at >> suffix_dedup.LOW) + k) for k in range(at & (1 << suffix_dedup.LOW) - 1)}
        return out

    want = set()
    for h in {r[0] for r in rows}:
        seen = {}
        for _, doc, th, lo, data in dict.fromkeys(r for r in rows if r[0] == h):
            for a in range(len(data) - 19):
                if seen.setdefault(data[a : a + 20], (doc, th, lo + a)) != (doc, th, lo + a):
                    want.add((doc, th, lo + a))
    assert places(4_000, 1) == want and (None, 5, len(passage[0])) in want
    assert places(1 << 20, 1) == want


def test_simhash(docs, rows):
    prints = [brute.fingerprint(octets(t)) for _, t, *_ in rows]
    want = sorted(zip((str(r[0]) for r in rows), prints, map(str, brute.components([r[0] for r in rows], prints))))
    got = sorted((str(r["doc_id"]), r["_fp"] % 2**64, str(r["component_id"])) for r in simhash.cluster(docs).collect())
    assert got == want


def test_simhash_buckets_in_parts(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(900):
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(nodes, bucket=6)).collect()}
    got = [roots.get(x, simhash.signed(x)) for x in prints]
    want = brute.components([simhash.signed(x) for x in prints], prints)
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    masks = simhash.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not x & m for m in masks)


def test_families_of_masks():
    free = np.array([2**64 - 1], dtype=np.uint64)
    for family in range(simhash.FAMILIES):
        free = np.unique((free[:, None] & ~np.array(simhash.masks(4, family), dtype=np.uint64)[None, :]).ravel())
    assert 1 << int(np.bitwise_count(free).max()) <= simhash.BUCKET


def test_simhash_of_a_hot_bucket(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    open_bits = rng.sample(range(64), 16)  # 65,536 fingerprints that share 48 bits
    prints = {base ^ sum(1 << b for b in open_bits if rng.random() < 0.2) for _ in range(20_000)}
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in sorted(prints)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    assert len(prints) > 4_000 and len(roots) == len(prints) and len(set(roots.values())) == 1


def test_simhash_keeps_one_of_each_group(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [brute.fingerprint(octets(t)) for _, t, *_ in rows]
    parts = brute.components(range(len(rows)), prints)
    got = kept.collect()
    assert len(got) == len(set(parts))
    of = {(r[0], r[1]): p for r, p in zip(rows, parts)}
    assert len({of[(g["doc_id"], g["text"])] for g in got}) == len(got)


def test_pii_base_spans_and_kept_base(docs, rows):
    rng = random.Random(9)
    weights = pii.trained()
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "300.1.1.1", "4442765686694452", "4442 7656-8669 4452", "+1 (343) 555-6039", "+", "12", "--", "a@b.c@d.e", "+49.170.1234567", "007", " ", "é", "1..2", "\n", "(555) 123-4567", "joe at ex dot com"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(1, 9)))
        base, every = pii.spans(text, weights)
        assert pii.listed(base) == brute.base_spans(text), text
        assert set(base) <= set(every)
    got = sorted((str(r["doc_id"]), r["pii_base"]) for r in pii.detect(docs).collect())
    assert got == sorted((str(i), brute.base_spans(t or "")) for i, t, *_ in rows)
    masked = pii.detect(docs, mask=True)
    assert masked.columns == [*docs.columns, "pii_base", "pii_spans"]
    assert sum(r["text"] is None for r in masked.collect()) == 1


def test_pii_model_adds_what_rules_miss_and_leaves_look_alikes():
    w = pii.trained()
    found = lambda s: [(s[a:b], k) for a, b, k in pii.spans(s, w)[1]]
    assert found("please call (555) 123-4567 now") == [("(555) 123-4567", "phone")]
    assert found("write john at example dot com please") == [("john at example dot com", "email")]
    for clean in ("order 123456789", "on 2020-01-02 10:11:12", "version 1.23.456", "arrived at the dot and", "password=5aaa9ac60bfe74b24b ea", "pages 123-456", "key 0123 4567 8901 2345"):
        assert found(clean) == [], clean
    held = pii.composed(seed=99, size=200)
    right = sum(sorted(s) == sorted(pii.spans(t, w)[1]) for t, s in held if not pii.base_spans(t))
    assert right >= 0.9 * sum(not pii.base_spans(t) for t, _ in held)


def test_semi_markov_sums_match_enumeration():
    import math

    segments = [(0, 2, 0.7), (1, 3, 1.1), (2, 4, -0.2), (0, 1, 0.3), (3, 4, 0.9), (0, 4, 1.0)]

    def every(at):
        if at == 4:
            return [()]
        return [p for p in every(at + 1)] + [(k, *p) for k, (i, j, _) in enumerate(segments) if i == at for p in every(j)]

    paths = every(0)
    score = lambda p: sum(segments[k][2] for k in p)
    z = sum(math.exp(score(p)) for p in paths)
    log_z, post = pii.marginals(4, segments)
    assert math.isclose(log_z, math.log(z))
    for k in range(len(segments)):
        assert math.isclose(post[k], sum(math.exp(score(p)) for p in paths if k in p) / z)
    assert pii.best(4, segments) == list(max(paths, key=score))


def reference_encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(docs, rows):
    own = reference_encoding()
    got = sorted(map(tuple, queries.digests(bpe.encode_decode(docs.select("doc_id", "text"), PATH, public_tokenizers.PATTERN)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(octets(t))))
    assert got == sorted(want, key=str)


def test_bpe_long_pieces_and_odd_ranks():
    own, mine, rng = reference_encoding(), bpe.codec(PATH, public_tokenizers.PATTERN), random.Random(4)
    for alphabet in ("ab", "thean", " \n\t", "é漢字ß", "0123", "!?-="):
        for n in (1, 7, 700, 6000):
            s = "".join(rng.choice(alphabet) for _ in range(n))
            assert np.frombuffer(mine.encode(s), "<u4").tolist() == own.encode_ordinary(s)
    for _ in range(200):  # vocabularies whose ranks follow no training
        tokens = [bytes([c]) for c in b"abc"] + list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(15)})
        rng.shuffle(tokens)
        ranks = {t: r for r, t in enumerate(tokens)}
        small = Codec(ranks, r"[abc]+")
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        parts = [s[i : i + 1] for i in range(len(s))]
        while s not in ranks and (pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]):
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert small.merge(s) == ([ranks[s]] if s in ranks else [ranks[p] for p in parts])


def test_bpe_pieces_are_safe_to_part():
    own, mine, rng = reference_encoding(), bpe.codec(PATH, public_tokenizers.PATTERN), random.Random(6)
    odd = [chr(c) for c in range(0x3400) if chr(c).isspace()] + list("a'sé1!²½_ \n\t") + ["\u200b", "\u0301", "Ⅷ", "'ll", "  ", "\x1c", "漢", "😀"]
    for _ in range(4000):
        s = "".join(rng.choice(odd) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == own.encode_ordinary(s), repr(s)


def test_bpe_memo_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    own, mine, rng = reference_encoding(), bpe.codec.__wrapped__(PATH, public_tokenizers.PATTERN), random.Random(9)
    words = ["river", "stone,", "bread", "a" * 70, "cloud!!", "don't", "x1", "é", "漢字", "of"]
    for _ in range(60):
        s = " ".join(rng.choices(words, k=12))
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == own.encode_ordinary(s)
        assert max(len(mine), len(mine.parts), *map(len, mine.earlier)) <= 5


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rng = random.Random(8)
    clean = lambda n: " ".join(" ".join(rng.choice(["sun", "river", "stone", "bread", "cloud", "you", "man"]) for _ in range(8)) + "." for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        y = i % 3 == 0
        rows.append((i, clean(rng.randint(1, 6)) + (f" {clean(1)[:-1]} {rng.choice(['grumpf', 'blarg', 'zonkel' + rng.choice('abcdef')])} {clean(1)} " if y else " ") + clean(2)))
        if i < 300:
            labels.append((i, 1, int(y)))
    rows += [(900, None), (901, ""), (None, "sun blarg."), (902, "..!!"), (903, clean(3000) + " blarg.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = queries.toxicity_model(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert sum((got[i]["toxic_score"] >= 0.5) == (i % 3 == 0) for i in range(300, 400)) >= 97
    assert all(got[i]["toxic_score"] == 0 for i in (900, 901, 902)) and got[903]["toxic_score"] >= 0.5
    hit = got[333]
    text = dict(rows)[333]
    assert [any(w in text[s["start"] : s["end"]] for w in ("grumpf", "blarg", "zonkel")) for s in hit["toxic_spans"]] == [True]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["toxic_score"] for r in toxicity.score(docs, queries.toxicity_model(docs, empty)).collect()} == {0.0}


def test_mixing_pieces_meet_targets(docs, rows):
    for block in (512, 7):
        got = mixing.mix(docs, block=block).collect()
        assert len(got) == len(rows)
        of = {}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            x = of.setdefault(r["source_size"], [r["target"], 0])
            x[1] += r["taken"]
        assert all(abs(t - n) <= 1 for t, n in of.values()) and len(of) == 3
        assert sum(n for _, n in of.values()) == pytest.approx(sum(r["size"] for r in got), abs=3)


def test_mixing_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    _, pieces = mixing.schedule(docs, block=10)
    order = pieces.groupBy("slot").agg({"sid": "min"}).orderBy("slot").collect()
    first = [r[1] for r in order[:160]]
    shares = [first.count(s) / 160 for s in (1, 2, 3)]
    assert shares == pytest.approx([5 / 8, 2 / 8, 1 / 8], abs=0.03)


def test_the_schedule_decides_where_a_row_stands(docs):
    got = {str(r["doc_id"]): (r["taken"], r["first_slot"]) for r in mixing.mix(docs, block=7).collect()}
    other = {str(r["doc_id"]): (r["taken"], r["first_slot"]) for r in mixing.mix(docs, block=7, golden=0.7548776662466927).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in other.items()}
    assert sum(got[k] != other[k] for k in got) > len(got) / 3


def test_mixed_documents_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    order = [r["source"] for r in mixing.mixed_documents(docs, block=50).collect()]  # a document a slot
    assert len(order) == 600
    for n in (80, 160, 320, 480):
        assert [order[:n].count(s) / n for s in ("s0", "s1", "s2")] == pytest.approx([5 / 8, 2 / 8, 1 / 8], abs=0.04)


def test_mixed_documents_keep_the_counts_of_twins(spark):
    rng = random.Random(31)
    rows = [(i // 2 if i < 120 else None if i < 160 else i, prose(rng, rng.randint(1, 60)) if i % 7 else None, f"s{i // 2 % 4}", {"k": str(i)}, i, i, i, i) for i in range(220)]
    rows += [rows[5]] * 3 + [rows[180]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key map<string,string>, _n int, _id int, slot int, size int")
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    size = {(r[4]): len((r[1] or "").split()) for r in rows}
    want, copies = {}, {}
    key = {r["key"]: r["_n"] for r in docs.select(mixing.row_key(docs).alias("key"), "_n").collect()}
    for r in mixing.placed(docs, block=16).collect():
        n = key[r["key"]]
        want[n] = want.get(n, 0) + (1 if not size[n] else int(r["taken"] / r["size"] + 0.5))
    got = out.collect()
    for r in got:
        copies[r["_n"]] = copies.get(r["_n"], 0) + 1
        assert (r["doc_id"], r["text"], r["source"], r["key"], r["_id"], r["slot"], r["size"]) == (rows[r["_n"]][0], rows[r["_n"]][1], rows[r["_n"]][2], {"k": str(r["_n"])}, *[r["_n"]] * 3)
    assert copies == {k: v for k, v in want.items() if v} and len(set(want.values())) > 2


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _t string, _bytes string, t int, c0 int, r0 int, toxic_score string, pii_spans int, _fp string, _ids int, `odd.name` int, key int, slot int"


def test_columns_of_any_name_stay(spark):
    rows = [(i, t, "en", "s", 1, "a", "b", 2, 3, 4, "own", 5, "fp", 6, 7, 8, 9) for i, t in enumerate([None, "", "call (555) 123-4567 now", "words and words", "words and words"])]
    docs = spark.createDataFrame(rows, CLASHING)
    by_id = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    scored = toxicity.score(docs, toxicity.Model({"words": 3.0}, -4.0))
    assert scored.columns == [*docs.columns, "toxic_spans"] and by_id(scored.drop("toxic_score", "toxic_spans")) == by_id(docs.drop("toxic_score"))
    assert {type(r["toxic_score"]) for r in scored.collect()} == {float}
    masked = pii.detect(docs, mask=True)
    assert masked.columns == [*docs.columns, "pii_base"] and by_id(masked.drop("pii_base", "pii_spans", "text")) == by_id(docs.drop("pii_spans", "text"))
    assert {r["text"] for r in masked.collect()} == {None, "", "call <PHONE> now", "words and words"}
    coded = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)
    assert by_id(coded.drop("_ids", "_decoded")) == by_id(docs.drop("_ids", "text"))
    assert simhash.keep_one(docs).columns == docs.columns == mixing.mixed_documents(docs).columns
    assert by_id(simhash.keep_one(docs)) == by_id(docs.where("doc_id in (0, 2, 3)"))  # null and empty texts are linked


def test_toxicity_as_a_plain_noisy_or(spark):
    import math
    import re as r

    rng = random.Random(17)
    weights = {w: rng.uniform(0.2, 4) for w in ("bad", "grim", "baddest", "badd*", "grim*", "sunn*")}
    model = toxicity.Model(weights, -3.0)
    vocabulary = ["bad", "Bad", "grim", "grimly", "baddest", "sunny", "stone", "é", "2x"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ". ", "!", "\n", "? "]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "...", "bad " * 50, "bad " * 3, "İ bad grim."]

    def plain(text):
        clean = 1.0
        for s in r.split(r"[.!?\n]", (text or "").lower()):
            z, hit = -3.0, False
            for w in set(r.findall(r"\w+", s)):
                own = [weights[f] for f in (w, f"{w[:4]}*" * (len(w) > 4), f"{w[:5]}*" * (len(w) > 5), f"{w[:6]}*" * (len(w) > 6)) if f in weights]
                z, hit = z + sum(own), hit or bool(own)
            clean *= 1 - (1 / (1 + math.exp(-z)) if hit else 0)
        return 1 - clean

    rows = [(i, t, t) for i, t in enumerate(texts)] + [(5, texts[5], "again")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, toxic_spans string"), model).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["toxic_score"] == pytest.approx(plain(x["text"]), abs=1e-9)
        for s in x["toxic_spans"]:
            assert s["score"] >= 0.5 and "\n" not in x["text"][s["start"] : s["end"]]
    score = {x["text"]: x["toxic_score"] for x in got}
    assert score["bad " * 50] == score["bad " * 3]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_toxicity_training_rows_repeat(spark):
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(40) for j in range(3)] + [(None, "x"), (0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, labels, limit=20)
    assert len(got) == 20 and sum(y for _, y in got) == 10 and all(t.endswith(" 0") for t, _ in got)
    assert got == toxicity.training_rows(docs.repartition(7), labels, limit=20)


def test_pii_in_a_very_long_list(spark):
    import time

    rng = random.Random(2)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    text = "".join(f"call ({num(3)}) {num(3)}-{num(4)} or +{num(2)} {num(3)} {num(7)}\n" for _ in range(5_000))
    began = time.time()
    base, every = pii.spans(text, pii.trained())
    assert len(base) == 5_000 and len(every) == 10_000 and time.time() - began < 20


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert suffix_dedup.dedup(empty).count() == simhash.cluster(empty).count() == mixing.mix(empty).count() == pii.detect(empty).count() == 0
    assert bpe.encode_decode(empty, PATH, public_tokenizers.PATTERN).count() == simhash.keep_one(empty).count() == mixing.mixed_documents(empty).count() == 0
