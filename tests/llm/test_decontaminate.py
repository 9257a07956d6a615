import random

import numpy as np

from tidemark.llm import decontaminate as d


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_lcs_equals_the_table():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 90))] for _ in range(2))
        assert d.lcs(d._masks(a), len(a), b) == plain_lcs(a, b)


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices(["the", "an", "er", "st", "ou", "én", "ti", "re"], k=rnd.choice([1, 2, 3, 3])))
    items = [(i, " ".join(word() for _ in range(rnd.choice([12, 30, 60, 150]))).capitalize() + ". " + " ".join(word() for _ in range(5)) + ".") for i in range(30)]
    docs, want = [], {}
    for k in range(300):
        text = [word() for _ in range(rnd.choice([5, 60, 400, 3000]))]
        if k % 4 == 0:
            i, item = items[k % 30]
            copy = item.upper().split() if k % 8 else [w if rnd.random() > 0.12 else word() for w in item.split()]
            at = rnd.randrange(len(text))
            text[at:at] = copy
            want[k] = i
        docs.append((k, " ".join(text)))
    return items, docs, want


def test_finds_what_was_put_in_and_nothing_else(spark):
    items, docs, want = corpus()
    docs += [(1000, None), (1001, ""), (None, docs[0][1]), (1002, "the " * 20_000)]
    items += [(98, None), (99, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.find_leaks(df, bench).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"] and r["doc_id"] is not None} == {k: [i] for k, i in want.items()}
    assert [r["item_ids"] for r in got if r["doc_id"] is None] == [[want[0]]]
    assert d.drop_leaks(df, bench).count() == len(docs) - len(want) - 1
    assert d.find_leaks(df.where("false"), bench).count() == 0 and not any(r["contaminated"] for r in d.find_leaks(df, bench.where("false")).collect())


def test_svd_equals_numpy(spark):
    bench = d.Benchmark([(1, "a b c d"), (2, "b c x"), (3, "a x y z a")])
    bench.weigh(10, {k: k + 1 for k in range(7)})
    texts = ["a b c d", "b c x a", "x y z z", "a a d"]
    df = spark.createDataFrame([(t, 1.0) for t in texts], "text string, weight double")
    rows = np.zeros((4, bench.terms))
    for i, t in enumerate(texts):
        for w in d.words_of(t):
            rows[i, bench.ids[w]] += bench.idf[bench.ids[w]]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    basis, spread = d._svd(df, spark.sparkContext.broadcast(bench), bench.terms, 3, 1)
    assert np.allclose(spread, np.linalg.svd(rows)[1][:3], atol=1e-6) and np.allclose(basis.T @ basis, np.eye(3), atol=1e-8)


def settled(items):
    bench = d.Benchmark(items)
    bench.weigh(10, {})
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(bench.terms, min(bench.terms, 96))))[0]
    bench.settle(basis, np.ones(basis.shape[1]))
    return bench


def test_long_items_are_found_across_pieces_and_short_ones_at_all():
    rnd = random.Random(7)
    long = [f"w{rnd.randrange(900)}" for _ in range(2000)]
    bench = settled([(1, " ".join(long[:1990]) + ". " + " ".join(long[1990:])), (2, "zebra"), (3, "unicorn stable")])
    other = [f"o{k}".encode() for k in range(d.PIECE)]
    for before in (1200, 800):
        text = other[: d.PIECE - before] + [w.encode() for w in long] + other[:500]
        assert bench.leaks(text) == {0: 1.0}
    assert bench.leaks([b"zebra"]) == {1: 1.0} and bench.leaks(other[:40] + [b"unicorn", b"stable"] + other[40:900]) == {2: 1.0}
    assert bench.leaks(other[:40] + [b"zebra"] + other[40:80]) == {} and bench.leaks([long[0].encode()]) == {} and bench.leaks([b"stable", b"unicorn"]) == {}


def paraphrases(rnd, words, vocabulary):
    """The words of an item with some replaced, left out, put in, or moved by a place or a clause."""
    kind, out = rnd.randrange(4), list(words)
    share = rnd.choice([0.1, 0.2, 0.3])
    if kind == 0:
        out = [w if rnd.random() > share else rnd.choice(vocabulary) for w in out]
    elif kind == 1:
        out = [w for w in out if rnd.random() > share]
    elif kind == 2:
        out = [x for w in out for x in ([w, rnd.choice(vocabulary)] if rnd.random() < share else [w])]
    else:
        for i in range(0, len(out) - 1, 2):
            if rnd.random() < share * 2:
                out[i], out[i + 1] = out[i + 1], out[i]
        cut = rnd.randrange(len(out) // 4 + 1)
        out = out[cut:] + out[:cut]
    return out


def test_recall_against_brute_force(spark):
    """Every window of every document against every item by LCS and answer, without any vectors; word order changes too."""
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ti", "mu", "re", "sa", "lo", "ne") for b in range(60)]
    weights = [1 / (k + 3) for k in range(len(vocabulary))]
    some = lambda n: rnd.choices(vocabulary, weights, k=n)
    items = [(i, " ".join(some(rnd.randint(14, 40))) + ". " + " ".join(some(4)) + ".") for i in range(60)]
    docs = []
    for k in range(240):
        text = some(rnd.randint(30, 200))
        if k % 2:
            at = rnd.randrange(len(text))
            text[at:at] = paraphrases(rnd, items[k % 60][1].replace(".", "").split(), vocabulary)
        docs.append((k, " ".join(text)))
    got = {r["doc_id"]: set(r["item_ids"]) for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    bench = d.Benchmark(items)
    want = {}
    for k, text in docs:
        ids = bench.known(d.words_of(text))
        for n, (masks, m, last, m_last) in enumerate(bench.checks):
            size = next((w for w in d.WINDOWS if w >= m), d.WINDOWS[-1])
            reach = max(size // 2, m - size // 2)
            for start in range(0, max(1, len(ids) - size // 2), size // 2):
                seen = ids[max(0, start - reach) : start + size + reach].tolist()
                share = d.lcs(masks, m, seen) / m
                if share >= d.SAME or share >= d.RELATED and d.lcs(last, m_last, seen) >= d.ANSWER * m_last:
                    want.setdefault(k, set()).add(n)
    pairs = {(k, n) for k, v in want.items() for n in v}
    found = {(k, n) for k, v in got.items() for n in v}
    assert len(pairs) > 60 and found <= pairs and len(found) >= 0.9 * len(pairs)


def test_the_index_gives_what_all_pairs_give(spark, monkeypatch):
    items, docs, want = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(str, d.find_leaks(df, bench).collect()))
    monkeypatch.setattr(d, "DENSE", 0)
    assert sorted(map(str, d.find_leaks(df, bench).collect())) == plain
    monkeypatch.setattr(d, "MOST_ITEMS", 8)  # group by group
    assert {r["doc_id"]: r["item_ids"] for r in d.find_leaks(df, bench).collect() if r["contaminated"]} == {k: [i] for k, i in want.items()}


def test_the_space_is_that_of_all_different_texts(spark, monkeypatch):
    """Few words, so the SVD has no remainder: its values are those of all passages, by numpy."""
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    some = lambda n: " ".join(rnd.choices(vocabulary + ["beyond"], k=n))
    items = [(i, some(12)) for i in range(9)]
    texts = [some(rnd.choice([0, 1, 9, 40, 70])) for _ in range(3000)]
    seen, settle = [], d.Benchmark.settle
    monkeypatch.setattr(d.Benchmark, "settle", lambda self, basis, spread: (seen.append((self, spread)), settle(self, basis, spread))[1])
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:500] + [None])], "doc_id long, text string")
    d.find_leaks(rows, spark.createDataFrame(items, "item_id long, text string"))
    bench, spread = seen[0]
    corpus, listed = [bench.known(d.words_of(t)) for t in set(texts)], [bench.known(d.words_of(t)) for _, t in items]
    gram = np.zeros((bench.terms, bench.terms))
    for group, weight in ((corpus, 1.0), (listed, sum(map(len, corpus)) / sum(map(len, listed)))):
        for ids in group:
            for at in range(0, len(ids), d.PASSAGE):
                part = ids[at : at + d.PASSAGE]
                a = np.bincount(part[part >= 0], minlength=bench.terms) * bench.idf
                gram += weight * np.outer(a, a) / max(a @ a, 1e-300)
    assert np.allclose(spread, np.sqrt(np.linalg.eigvalsh(gram)[::-1]), rtol=1e-6)


def test_pairs_of_frequent_words_give_what_whole_passages_give(monkeypatch):
    items, docs, _ = corpus()
    bench = d.Benchmark(items)
    bench.weigh(300, {k: k % 200 for k in range(bench.terms)})
    shipped = type("Shipped", (), {"value": bench})
    block = np.random.default_rng(2).normal(size=(bench.terms, 7))
    batch = d.pa.RecordBatch.from_arrays([d.pa.array([t for _, t in docs]), d.pa.array([1.0 + k % 3 for k, _ in docs])], names=["text", "weight"])

    def product():
        return np.concatenate([np.reshape(x, (-1, 7)) for x in next(d._products(shipped, block)([batch]))["part"].to_pylist()])

    whole = product()
    for paired, stretch in ((0, 1 << 16), (20, 1 << 16), (20, 64)):
        monkeypatch.setattr(d, "PAIRED", paired)
        monkeypatch.setattr(d, "STRETCH", stretch)
        assert np.allclose(product(), whole, rtol=1e-9, atol=1e-9)
