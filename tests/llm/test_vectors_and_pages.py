"""Vector, URL and archive operators against plain versions."""

import random

import brute
import numpy as np
import pytest

from quoin.llm import ann, topk, url_filter, warc

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(700)]
    out += [(1000 + i, out[7][1]) for i in range(150)]  # one vector, many times
    out += [(2000, None), (2001, []), (2002, [NAN] * 24), (2003, [INF] + [0.0] * 23), (2004, [None] + [1.0] * 23), (2005, [0.0] * 24), (None, out[1][1]), (2020, [1.0, 2.0]), (2021, [2.0, 1.0])]
    return out + [out[3]] * 3 + [out[20]]  # rows that repeat; the last asks


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")


def usable(rows, zero=True):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def test_exact_top_k(vectors, rows):
    good = usable(rows)
    want = brute.top_inner([r for r in good if len(r[1]) == 24], 20, 20) + brute.top_inner([r for r in good if len(r[1]) == 2], 20, 20)
    assert sorted(map(tuple, topk.search(vectors).collect())) == sorted(want)


@pytest.mark.parametrize("high", [3, 60, 10**6, 10**12])
def test_branch_and_bound_is_exact(high):
    rng = np.random.default_rng(high % 97)
    c = np.floor(rng.standard_normal((40, 300)) * high)
    c[:, 50:120] = c[:, :1]
    ids = rng.permutation(300).astype(np.int64)
    got = topk.pair(ids[:20], c[:, :20], ids, c, 7)
    whole = [[int(x) for x in col] for col in c.T]
    want = []
    for a in range(20):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b])))), int(ids[b])) for b in range(300) if b != a)[:7]
        want += [(int(ids[a]), i, -x) for x, i in s]
    assert got == want


def test_approximate_neighbours(vectors, rows):
    good = [r for r in usable(rows, zero=False) if len(r[1]) == 24]
    m = np.array([v for _, v in good], dtype=np.float64)
    ids = np.array([i for i, _ in good])
    assert (ids == 3).sum() == 4
    got = {}
    for r in ann.search(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (m * m[q]).sum(1) / np.sqrt((m * m).sum(1)) / np.sqrt((m[q] * m[q]).sum())
        s[ids == ids[q]] = -9
        best = [int(ids[j]) for j in np.lexsort((ids, -s))[:5]]
        mine = sorted(got[int(ids[q])])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(x - s[list(ids).index(i)]) < 1e-12 for _, i, x in mine)
        hit += len(set(best) & {i for _, i, _ in mine})
        total += 5
    assert hit >= 0.9 * total


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(1)
    x = ann.unit(rng.standard_normal((4000, 64)))
    q = ann.unit(rng.standard_normal((30, 64)))
    kept = lost = 0
    for v in q:
        live = ann.scan(v.astype(np.float32), np.ascontiguousarray(x.T).astype(np.float32), 5)
        kept += len(live)
        lost += len(set(np.argsort(-(x @ v))[:5]) - set(live.tolist()))
    assert kept < 30 * 400 and lost <= 5


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty).count() == ann.search(empty).count() == 0


PAGES = [(1, "http://A.Example.NET:80/en/1?q#f", "<p>x</p>"), (2, "https://example.net/en/", "é" * 40_000), (3, None, None), (4, "nothing", ""), (5, "ftp://x.org/fr/9", "<p>x</p>"), (6, "http://b.example.com/de/2", "y\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (7, "http://example.com", "é" * 40_000), (None, "http://net/", "<p>x</p>"), (8, "http://u\r\nX: y/ z", "q" * 16_300), (1, "http://A.Example.NET:80/en/1?q#f", "<p>x</p>"), (2, "https://example.net/en/", "é" * 40_000), (9, "://", "z"), (None, None, "only"), (10, "http://notexample.com/de/1", None), (11, "http://example.com/de?x://y", "w")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string").repartition(3)


def test_archives_round_trip(pages):
    import base64
    import hashlib

    first = {}
    for i, _, h in PAGES:
        first.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        least = min((x for x in first[b] if x is not None), default=None)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == least else "revisit", None if i == least else least, True))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == sorted(want, key=str)


def test_reading_notices_what_is_wrong(spark):
    whole = [next(warc.parsed(r + warc.END)) for r in warc.records(5, "http://x/", b"a" * 50_000, None)]
    parts = [{"number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "type": f["warc-type"], "page_id": 5, "url": None, "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers": None, "block": b} for f, b in whole]
    assert len(parts) == 4 and warc.capture("o", parts[::-1])[-2:] == (b"a" * 50_000, True)
    for broken in (parts[:-1], parts[1:], parts[:1] + parts[2:], [*parts[:3], parts[3] | {"total": 9}], [parts[0] | {"digest": "X"}, *parts[1:]]):
        assert warc.capture("o", broken)[-1] is False
    body = b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n"
    assert warc.unchunked(body) == b"hello" and warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nhel")


def test_payloads_below_the_threshold_are_all_responses(pages):
    got = warc.round_trip(pages, least=100).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 100} == {"response"}
    assert sum(r["record_type"] == "revisit" for r in got) == 1 and len(got) == len(PAGES)


def test_url_rules_and_parts(spark, pages):
    none = spark.createDataFrame([], "host string, bad long")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, none).collect()}
    assert {(2, "example.net", "/en/", "example.net/en/", "allow"), (1, "a.example.net:80", "/en/1", None, "allow"), (3, "", "", None, "allow"), (5, "x.org", "/fr/9", "org/fr/", "allow"), (6, "b.example.com", "/de/2", "example.com/de/", "block"), (7, "example.com", "", None, "allow"), (None, "net", "/", "net/", "block"), (10, "notexample.com", "/de/1", None, "allow"), (11, "example.com", "/de", None, "allow"), (9, "", "", None, "allow")} <= got


def test_reputation_shrinks(spark):
    rng = random.Random(6)
    rows = [(f"h{i}.good.com", int(rng.random() < 0.02)) for i in range(20) for _ in range(40)] + [(f"h{i}.bad.net", int(rng.random() < 0.95)) for i in range(20) for _ in range(40)] + [("new.bad.net", 1), ("one.good.com", 1)]
    hosts = spark.createDataFrame([("new.bad.net",), ("one.good.com",), ("h3.bad.net",), ("unseen.bad.net",), ("x.unknown.org",), ("",)], "host string")
    got = {r["host"]: r for r in url_filter.reputation(hosts, spark.createDataFrame(rows, "host string, bad long")).collect()}
    assert got["h3.bad.net"]["bound"] > 0.5 and got["new.bad.net"]["bound"] > 0.5 and got["unseen.bad.net"]["rate"] > 0.8
    assert got["one.good.com"]["rate"] < 0.3 and 0.2 < got["x.unknown.org"]["rate"] < 0.8


def test_repeated_rows_have_record_ids_of_their_own(spark, tmp_path):
    rows = [(7, "http://x/", "same " * 9_000)] * 4 + [(None, "http://y/", "none")] * 3 + [(None, None, "none")] + [(8, "http://z/", "same " * 9_000)] * 2 + [(9, "http://x/", "p"), (9, "http://x/2", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    found = [f for path in (tmp_path / "w").glob("*.gz") for f, _ in warc.parsed(path.read_bytes())]
    ids = [f["warc-record-id"] for f in found]
    assert len(ids) == len(set(ids))
    heads = [f for f in found if f["warc-type"] != "continuation"]
    assert len(heads) == len(rows) and {f["warc-refers-to"] for f in heads if f["warc-type"] == "revisit"} <= set(ids)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    assert sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in got) == sorted(str(x) for x in [(7, "response", None)] * 4 + [(8, "revisit", 7)] * 2 + [(None, "response", None)] * 4 + [(9, "response", None)] * 2)


def test_archives_of_many_members_and_plain_ones():
    import gzip

    payload = b"\r\n\r\nWARC/1.1" * 3_000  # 36,000 bytes and their framing: two full segments and a rest
    whole = [r + warc.END for r in warc.records(5, "http://x/", payload, None)]
    want = [b for _, b in warc.parsed(b"".join(whole))]
    assert [len(b) for b in want[:-1]] == [warc.SEGMENT] * 2 and 0 < len(want[-1]) < warc.SEGMENT
    assert warc.unchunked(b"".join(want).partition(warc.END)[2]) == payload
    assert [b for _, b in warc.parsed(b"".join(map(gzip.compress, whole)))] == want
    with pytest.raises(ValueError):
        list(warc.parsed(b"".join(whole)[:-10]))
    with pytest.raises(ValueError):
        list(warc.parsed(b"junk"))
