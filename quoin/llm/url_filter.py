"""URL filter by empirical-Bayes host reputation. DataFrame functions only.

Labelled outcomes of pages (bad or not) are counted by host. The rate of bad pages is shrunk from the whole to the
suffix, to the registered domain, to the host: at each level a beta prior around the level above, whose strength is
the moment estimate of how much the groups of that level differ from their parents (beta-binomial). A host is blocked where even
the lower bound of its posterior rate (the beta posterior's mean less z of its standard deviations) is above `cut`. Fixed rules come first: the longest that fits decides.

Null url, or no "://": host and path are empty; nothing is known of such a host, so the overall prior
judges it. Hosts without labelled pages get their domain's rate. For domain and suffix a port does not count, SUFFIXES are
suffixes of two labels, and a numeric host is its own domain. Without any outcome every page is allowed. Repeated rows give
repeated results. Names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import settled, spread_join

#: (action, rule); a rule is a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
Z, CUT = 1.645, 0.5
#: Strength of a prior, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Common suffixes of two labels, and what stands for the suffix of numeric hosts.
SUFFIXES = tuple(f"{second}.{top}" for top, seconds in {
    "uk": "co org ac gov ltd plc me net sch nhs", "au": "com net org edu gov id", "nz": "co net org ac govt school", "za": "co org net ac gov", "jp": "co ne or ac go ad ed gr lg", "kr": "co or ne ac go re",
    "in": "co net org ac gov edu res firm gen ind", "br": "com net org gov edu", "cn": "com net org gov edu ac", "tw": "com net org gov edu idv", "hk": "com net org gov edu idv", "sg": "com net org gov edu", "my": "com net org gov edu",
    "id": "co or ac go web sch", "th": "co or ac go in", "tr": "com net org gov edu", "il": "co org net ac gov", "mx": "com net org gob edu", "ar": "com net org gob edu", "co": "com net org gov edu", "pe": "com net org gob edu",
    "ua": "com net org gov edu", "pl": "com net org gov edu", "ph": "com net org gov edu", "vn": "com net org gov edu", "eg": "com net org gov edu", "sa": "com net org gov edu", "pk": "com net org gov edu", "ng": "com net org gov edu", "ke": "co or ne ac go",
}.items() for second in seconds.split())
NUMERIC = "[]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """pages (with url) plus host, path."""
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    out = None
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = (F.when if out is None else out.when)(fits, F.struct(F.lit(text).alias("rule"), F.lit(action).alias("action")))
    return out


def bare(host: Column) -> Column:
    """Without a port."""
    return F.regexp_replace(host, r":[0-9]*\z", "")


def numeric(host: Column) -> Column:
    return bare(host).rlike(r"\A(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])\z")


def suffix(host: Column) -> Column:
    two = F.substring_index(bare(host), ".", -2)
    return F.when(numeric(host), F.lit(NUMERIC)).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(bare(host), ".", -1))


def domain(host: Column) -> Column:
    """The registered domain; of a numeric host, itself."""
    two = F.substring_index(bare(host), ".", -2)
    return F.when(numeric(host), bare(host)).when(two.isin(*SUFFIXES), F.substring_index(bare(host), ".", -3)).otherwise(two)


def strength(groups: DataFrame, parent: Column) -> DataFrame:
    """One row: c, the strength of the prior under which groups (n, k) would differ from their parent's rate as they do."""
    by = groups.groupBy(parent.alias("_parent")).agg(F.count("*").alias("g"), F.sum("n").cast("double").alias("t"), F.sum("k").cast("double").alias("b"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"))
    p = F.col("b") / F.col("t")
    spread = F.col("kk") - F.col("b") * p - p * (1 - p) * (F.col("g") - 1)
    room = p * (1 - p) * (F.col("t") - F.col("nn") / F.col("t") - (F.col("g") - 1))
    s = by.agg(F.sum(spread).alias("spread"), F.sum(room).alias("room"))
    rho = F.when((F.col("room") > 0) & (F.col("spread") > 0), F.col("spread") / F.col("room")).otherwise(F.lit(0.0))
    c = F.when(rho <= 0, F.lit(STRONGEST)).when(rho >= 1, F.lit(WEAKEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), (1 - rho) / rho)))
    return s.select(F.coalesce(c, F.lit(STRONGEST)).alias("c"))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """hosts: distinct host. outcomes: host, bad (0/1), one row a labelled page. Adds rate, bound (lower posterior bound of the rate of bad pages)."""
    counts = settled(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), "counts")  # read by six plans
    by_domain = counts.groupBy(domain(F.col("host")).alias("domain")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy(suffix(F.col("domain")).alias("suffix")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = by_suffix.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 10)).alias("m0"))
    fixed = overall.crossJoin(strength(by_suffix, F.lit("")).withColumnRenamed("c", "cs")).crossJoin(strength(by_domain, suffix(F.col("domain"))).withColumnRenamed("c", "cd")).crossJoin(strength(counts, domain(F.col("host"))).withColumnRenamed("c", "ch"))  # four tables of one row
    rows = hosts.select("host").withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))).crossJoin(F.broadcast(fixed))
    for name, table in (("s", by_suffix), ("d", by_domain), ("h", counts)):
        key = table.columns[0]
        rows = rows.join(table.select(key, F.col("n").alias(f"n{name}"), F.col("k").alias(f"k{name}")), key, "left").fillna(0, [f"n{name}", f"k{name}"])
    rows = rows.withColumn("ms", (F.col("ks") + F.col("cs") * F.col("m0")) / (F.col("ns") + F.col("cs")))
    rows = rows.withColumn("md", (F.col("kd") + F.col("cd") * F.col("ms")) / (F.col("nd") + F.col("cd")))
    a = F.col("kh") + F.col("ch") * F.col("md")
    n = F.col("nh") + F.col("ch")
    rows = rows.withColumn("rate", a / n)
    return rows.select("host", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, cut: float = CUT) -> DataFrame:
    """Of each page (page_id, url): page_id, host, path, rule, verdict, rate, bound. outcomes: host, bad."""
    rows = with_parts(pages.select("page_id", "url"))
    known = reputation(rows.select("host").distinct(), outcomes, z)
    rows = spread_join(rows, known, ["host"], ["page_id", "path"], "inner").withColumn("_r", rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("bound") > cut, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "rate", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): pages whose path names a labelled document (/lang/doc_id); bad where the label says toxic or of low quality."""
    number = F.expr(r"try_cast(regexp_extract(path, '\\A/[a-z]+/([0-9]+)', 1) as bigint)")
    named = with_parts(pages.select("page_id", "url")).select("host", number.alias("doc_id")).where("doc_id is not null")
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))).cast("long").alias("bad"))
    return named.join(bad, "doc_id").select("host", "bad")
