"""The aligner's bounds hold, and a document's region is not repeated for its lines."""

import difflib
import random

from quoin.operators import regions
from quoin.plans import queries

WORDS = "the of survey stone river letter window 1990 measure".split()


def prose(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


def test_bounded_blocks_as_difflib():
    rng = random.Random(6)
    for t in range(150):
        b = prose(rng, rng.randint(1, 60))
        a = prose(rng, 8) + (b[10:40] if t % 3 == 0 else "") + prose(rng, 6)
        a = a if t % 5 else a.replace("e", "é")
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)
        assert regions._matched(a, b) == want
        if regions.PLAIN(a):
            longest = [max(n for n in range(len(a) - i + 1) if a[i : i + n] in b) for i in range(len(a))]
            assert regions._bounds(a, b) == [n if n < regions.CLIP else len(a) - i for i, n in enumerate(longest)]


def test_lines_are_grouped_before_they_meet_their_region(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc"), (2, "d"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, want in ((queries.coverage_fastpath, [1.0] * 3), (queries.coverage_full, [0.5, 1 / 3, 1 / 3])):
        got = query(spark, str(tmp_path))
        assert [r["coverage"] for r in got.orderBy("pos").collect()] == want
        tree = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert next(i for i, x in enumerate(tree) if "Join" in x) < next(i for i, x in enumerate(tree) if "collect_list" in x)
