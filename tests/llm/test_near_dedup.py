import random

import numpy as np

from tidemark.llm import near_dedup as x
from tidemark.llm.components import components


def sets(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    s = [sets(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (not s[i] and not s[j]) or (s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])):
                at[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(sorted(g) for g in groups.values())


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = [None, "", " \n", "a", "a b", "a  b\n", "a b c d e"]
    shared = [word() for _ in range(60)]
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([8, 40, 200, 900]))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(max(1, len(base) // rnd.choice([15, 30, 60, 200]))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(shared + [word() for _ in range(rnd.choice([10, 25]))]))
    return list(enumerate(texts))


def test_shingles_equal_plain_ones():
    texts = [t or "" for _, t in corpus()]
    doc, made, count = x.shingles([t.encode() for t in texts], x._Powers())
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(sets(t))
        assert count[doc == i].sum() == (max(1, len(t.split()) - 4) if t.split() else 0)
    alone = x.shingles([texts[20].encode()], x._Powers())
    assert set(alone[1]) == set(made[doc == 20])


def test_agreement_estimates_weighted_similarity():
    rnd = np.random.default_rng(2)
    for n in (1, 4, 50, 3000):
        a, b = rnd.uniform(0.2, 3, n), rnd.uniform(0.2, 3, n)
        doc = np.repeat([0, 1], n)
        sig = x.dart_minhash(doc, np.tile(np.arange(n).astype(np.uint64) * x._BASE, 2), np.concatenate([a, b]), 2, k=4000)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, rid string")
    got = x.near_duplicates(df).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(g) for g in groups.values()) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) and r["class_id"] == min(groups[r["class_id"]]) for r in got)


def test_buckets_whose_members_are_apart(spark, monkeypatch):
    """Many texts of middling similarity to the first share buckets; small blocks, pairs among them must be found."""
    rnd = random.Random(7)
    shared = [f"s{i}" for i in range(80)]
    texts = []
    for _ in range(25):
        own = [f"o{rnd.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join(shared + own), " ".join(shared + own[:-1] + [f"o{rnd.randrange(10**6)}"])]
    rows = list(enumerate(texts))
    monkeypatch.setattr(x, "BLOCK", 4)
    got = x.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(g) for g in groups.values()) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "a b c d e f g"
    got = x.near_duplicates(spark.createDataFrame([(1, t), (1, t), (None, t), (None, "z")], "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in got) == 2 and [r["class_id"] for r in got].count(1) == 3
    assert x.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (50, 45), (45, 60), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[60] == got[50] == 45 and 7 in got
