"""The pipeline against a plain version of each stage, over awkward documents."""

import math
import random
import re
from collections import Counter

import brute
import pytest
from test_texts import reference_encoding

import corpus_pipeline
from quoin.llm import mixing, pii, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["sun", "river", "stone", "bread", "cloud", "élan"]) + rng.choice(["", "s", "ly", "."]) for _ in range(n))
    rows = [(i, text(rng.randint(30, 90)) + (" you zonkel %s. " % text(2) if i % 5 == 0 else "") + (" mail a%d@b.org " % i if i % 7 == 0 else "")) for i in range(150)]
    rows += [(500 + i, rows[i][1]) for i in range(1, 20)] + [(600 + i, rows[i][1] + " end") for i in range(1, 20)]
    rows += [(700, None), (701, ""), (702, " \n"), (703, text(4000) + " call (555) 123-4567 now"), rows[3], (None, text(40))]
    docs = [(i, t, "en", f"s{(i or 1) % 4}" if (i or 1) % 9 else None, len(t or ""), "x") for i, t in rows]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    weights = pii.trained()
    now = [tuple(r) for r in docs.collect()]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, folder)
        if name != "encoding":
            assert made.columns == docs.columns
            made.write.parquet(f"{folder}/{name}.parquet")
            frame = spark.read.parquet(f"{folder}/{name}.parquet")
            made = frame
        got = [tuple(r) for r in made.collect()]
        if name == "toxicity":
            want = [r for r in now if model.document(model.sentences(r[1] or "")) < 0.5]
            assert 20 <= len(now) - len(want) <= 45
        elif name == "near_dedup":
            prints = [brute.fingerprint((r[1] or "").encode()) for r in now]
            parts = brute.components(range(len(now)), prints)
            best = {}
            for r, p in zip(now, parts):
                best[p] = min(best.get(p, r), r, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
            want = list(best.values())
            assert len(want) < len(now)
        elif name == "pii":
            want = []
            for r in now:
                found = pii.spans(r[1] or "", weights)[1]
                t = pii.masked(r[1], found) if found else r[1]
                want.append((r[0], t, r[2], r[3], len(t) if found else r[4], r[5]))
            assert want != now
        elif name == "mixing":
            size = lambda r: len(re.findall(mixing.WORD, r[1] or ""))
            taken = {x["doc_id"]: x["taken"] for x in mixing.mix(frame_before).collect()}
            want = [r for r in now for _ in range(1 if not size(r) else math.floor(taken[r[0]] / size(r) + 0.5))]
            words = Counter()
            for r in want:
                words[r[3]] += size(r)
            own = Counter()
            for r in now:
                own[r[3]] += size(r)
            assert all(words[s] <= 3.01 * own[s] for s in own) and words["s0"] > 1.5 * words["s2"]
        else:
            coder = reference_encoding()
            import numpy as np

            want = [(r[0], len(x := coder.encode_ordinary(r[1] or "")), brute.sha(np.array(x, dtype="<u4").tobytes()), brute.sha((r[1] or "").encode())) for r in now]
        assert sorted(got, key=str) == sorted(want, key=str), name
        now, frame_before = got, frame
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(now, key=str)
