"""Registered domains for the prior of op7: ports, suffixes of two labels, numeric hosts."""

from pyspark.sql import functions as F

from quoin.llm import url_filter

HOSTS = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.net:80": ("example.net", "net"), "x.example.net:": ("example.net", "net"), "example.net": ("example.net", "net"), "10.1.2.3": ("10.1.2.3", "[]"), "10.1.2.3:80": ("10.1.2.3", "[]"), "[::1]:80": ("[::1]", "[]"), "[::1]": ("[::1]", "[]"), "": ("", ""), "net": ("net", "net"), "1.2.3.example.org": ("example.org", "org")}


def test_domains_and_suffixes(spark):
    host = F.col("host")
    got = spark.createDataFrame([(h,) for h in HOSTS], "host string").select("host", url_filter.domain(host), url_filter.suffix(host), url_filter.suffix(url_filter.domain(host))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == HOSTS and all(r[2] == r[3] for r in got)


def test_priors_follow_the_registrant(spark):
    good = [(f"h{i}.g{j}.{s}", 0) for s in ("co.uk", "net") for j in range(5) for i in range(5) for _ in range(30)]
    bad = [(f"h{i}.bad.{s}", 1) for s in ("co.uk", "net") for i in range(10) for _ in range(30)] + [("10.0.7.7", 1)] * 60
    asked = ["new.bad.co.uk", "new.g1.co.uk", "new.bad.net:80", "new.g1.net:80", "10.1.7.7", "10.0.7.7:8080"]
    known = url_filter.reputation(spark.createDataFrame([(h,) for h in asked], "host string"), spark.createDataFrame(good + bad, "host string, bad long"))
    rate = {r["host"]: r["rate"] for r in known.collect()}
    assert set(rate) == set(asked)
    assert rate["new.bad.co.uk"] > 0.8 > 0.2 > rate["new.g1.co.uk"]
    assert rate["new.bad.net:80"] > 0.8 > 0.2 > rate["new.g1.net:80"]
    assert rate["10.0.7.7:8080"] > rate["10.1.7.7"]
