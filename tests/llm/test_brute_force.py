"""Operators beyond SQL against plain versions of themselves, and on workers that have no copy of the package."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

from tidemark.llm import language, quality

ROOT = Path(__file__).resolve().parents[2]


def plain_language(rows):
    """doc_id, lang, score of (doc_id, text, lang): words by log frequency, others by the longest known piece from the left."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts, grams = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            counts[lang].update(words(text))
    for lang, c in counts.items():
        for w, n in c.items():
            for size in range(1, 6):
                for k in range(len(w) - size + 1):
                    grams[lang][w[k : k + size]] += n
    langs = sorted(counts)
    known, pieces = set().union(*counts.values()), set().union(*grams.values())
    word_total = {x: sum(counts[x].values()) + 0.1 * len(known) for x in langs}
    size_total = {(x, s): sum(n for g, n in grams[x].items() if len(g) == s) + 0.1 * len(pieces) for x in langs for s in range(1, 6)}
    out = []
    for i, text, _ in rows:
        found = words(text)
        if not found:
            out.append((i, "und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in found:
            at = 0
            while at < len(w):
                if w in known:
                    for x in langs:
                        total[x] += math.log((counts[x][w] + 0.1) / word_total[x])
                    break
                size = next((s for s in range(min(5, len(w) - at), 0, -1) if w[at : at + s] in pieces), 0)
                for x in langs if size else ():
                    total[x] += math.log((grams[x][w[at : at + size]] + 0.1) / size_total[x, size])
                at += max(1, size)
        best = max(langs, key=lambda x: (total[x], -langs.index(x)))
        share = [math.exp((total[x] - total[best]) / math.sqrt(len(found))) for x in langs]
        out.append((i, best, max(share) / sum(share)))
    return out


def test_language_equals_the_plain_version(spark):
    rnd = random.Random(8)
    bits = {"p": ["an", "the", "ing", "é"], "q": ["al", "que", "ing", "ñ"], "r": ["zu", "ei", "ß", "an"]}
    rows = [(i, " ".join("".join(rnd.choices(bits["pqr"[i % 3]], k=rnd.randint(1, 5))) for _ in range(rnd.choice([0, 1, 3, 40]))), "pqr"[i % 3] if i % 11 else None) for i in range(240)]
    rows += [(900, None, "p"), (901, "12 ,", "q"), (902, "xyzé kkk", "r")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, lang, score in plain_language(rows):
        assert abs(got[i][1] - score) < 1e-4 and (got[i][0] == lang or score < 0.34)


def test_quality_equals_the_plain_version(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(1, 9)))
    docs = [(i, " ".join(word().upper() if rnd.random() < (0.5 if i % 3 == 0 else 0.1) else word() for _ in range(rnd.randint(3, 60)))) for i in range(400)]
    labels = [(i, int((i % 3 != 0) ^ (rnd.random() < 0.1))) for i in range(0, 400) if i % 7]
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    stats = {i: np.asarray(quality.statistics(t), np.float32).astype(float) for i, t in docs}
    seen = [(i, y) for i, y in labels if part(i) != 0]
    x = np.stack([stats[i] for i, _ in seen])
    model = quality.Model(x.mean(0), x.std(0))
    fit = [(i, y) for i, y in seen if part(i) != 1]
    z = model.features(np.stack([stats[i] for i, _ in fit]))
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) * np.eye(z.shape[1]), z.T @ np.array([y for _, y in fit], float))
    raw = lambda i: float(model.features(stats[i][None])[0] @ weights)
    bins = defaultdict(list)
    for i, y in seen:
        if part(i) == 1:
            bins[math.floor(min(max(raw(i), -0.5), 1.5) * quality.BINS)].append(y)
    at = sorted(bins)
    n, hits = np.array([len(bins[b]) for b in at], float), np.array([sum(bins[b]) for b in at], float)
    # the isotonic level of each bin by its minimax form
    level = [max(min(hits[a : c + 1].sum() / n[a : c + 1].sum() for c in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    for i, _ in docs:
        want = 0.999 * np.interp(raw(i), [(b + 0.5) / quality.BINS for b in at], level) + 0.001 * min(max(raw(i), 0), 1)
        assert abs(got[i] - want) < 1e-5


def test_workers_without_the_package(tmp_path):
    """The driver alone has the package on its path; readers and models must travel."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
def lacks(batches):
    import importlib.util, pyarrow
    found = importlib.util.find_spec("tidemark") is None
    for b in batches:
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array([found])], names=["lacks"])
import types
lacks.__module__ = "__main__"
assert spark.range(1).mapInArrow(lacks, "lacks boolean").first()[0]
for name in ("op1_language", "op9_decontaminate", "op10_hmm", "op3_quality", "directory_to_result"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-3000:]
