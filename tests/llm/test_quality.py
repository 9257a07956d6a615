import random
import zlib

import numpy as np

from tidemark.llm import quality


def test_isotonic_rises_and_pools():
    x, y = quality.isotonic([0, 1, 2, 3], [0, 8, 2, 10], [10, 10, 10, 10])
    assert list(np.interp([0, 1, 2, 3], x, y)) == [0, 0.5, 0.5, 1]


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n\n", "é", "x" * 500_000, "!!"):
        s = quality.statistics(t)
        assert len(s) == len(quality.STATISTICS) and np.isfinite(s).all()


def test_held_out_scores_tell_bad_from_good(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(rnd.randint(30, 120))]
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".", "k"))
        labels += [(i, 0 if bad else 1, None)] * (1 + i % 2)
    docs += [(None, None, "k"), (9000, "", "k"), (3, docs[3][1], "k")]
    labels += [(9000, None, None), (None, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.score_quality(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert len(held) > 80 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert quality.score_quality(df.where("false"), lab).count() == 0
    assert {r["predicted"] for r in quality.score_quality(df, lab.where("false")).collect()} == {1}
    assert quality.keep_good(df, lab).count() < len(docs)
