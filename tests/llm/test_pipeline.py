import random
import zlib

import corpus_pipeline
from tidemark.llm import mixing, quality
from tidemark.llm.decontaminate import Benchmark, drop_leaks
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.near_dedup import drop_near
from tidemark.llm.quality import keep_good


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices(["the", "an", "er", "st", "ou", "ti", "re", "ing"], k=rnd.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, text(40)) for i in range(8)]
    docs, labels, gone = [], [], set()
    for i in range(300):
        t = text(rnd.randint(60, 150))
        if i % 6 == 5:
            t = " ".join(w.upper() + "!!" for w in t.split())
            gone.add(i)
        elif i % 20 == 1:
            t = docs[-1][1].replace(" ", "\n")
            gone.add(i)
        elif i % 20 == 3:
            w = docs[-1][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
            gone.add(i)
        elif i % 20 == 7:
            t += " " + items[i % 8][1] + " " + text(20)
            gone.add(i)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 0 if i % 6 == 5 else 1, 0))
    for name, rows, kind in [("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")]:
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in docs} - gone
    sizes = {i: len(t.split()) for i, t, *_ in docs}
    own = {s: sum(sizes[i] for i in got if i % 3 == s) for s in range(3)}
    goal = mixing.targets([own[s] for s in range(3)], mixing.WEIGHTS)
    for s in range(3):
        rows = [r for i, r in got.items() if i % 3 == s]
        assert {r["source_size"] for r in rows} == {own[s]} and abs(rows[0]["target"] - goal[s]) < 1e-6
        assert abs(sum(r["taken"] for r in rows) - goal[s]) <= 150 and all(r["size"] == sizes[r["doc_id"]] for r in rows)


def test_stages_are_in_order_and_keep_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mixing"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_row_where_ids_are_null_or_repeated(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices(["the", "an", "er", "st", "ou", "ti", "re", "ing"], k=rnd.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    kind = "doc_id long, text string"
    a, b, c, leak = text(80), text(80), text(80), text(40)
    for drop in (drop_copies, drop_near):
        got = drop(spark.createDataFrame([(1, a), (1, a), (None, b), (None, b), (1, c)], kind))
        assert sorted(r["text"] for r in got.collect()) == sorted([a, b, c])
    held = lambda t: f"{t} {leak} {text(20)}"
    got = drop_leaks(spark.createDataFrame([(None, a), (None, held(b)), (2, b), (2, held(c))], kind), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(None, a), (2, b)}
    docs = [(i, text(90)) for i in range(150)]
    docs = [(i, " ".join(w.upper() + "!!" for w in t.split()) if i % 2 else t) for i, t in docs]
    more = [(None, text(90)), (None, docs[1][1]), (900, text(90)), (900, docs[3][1])]
    got = keep_good(spark.createDataFrame(docs + more, kind), spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int"))
    assert {r["text"] for r in got.collect() if r["doc_id"] in (None, 900)} == {more[0][1], more[2][1]}


def test_the_leak_stage_learns_from_every_document_left(spark, tmp_path, monkeypatch):
    """Words of one passage a text, so the squared values of the space add up to the passages: of all texts, and as much for the items."""
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=20)), "en", "s", 0) for i in range(4000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=20))) for i in range(10)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, settle = [], Benchmark.settle
    monkeypatch.setattr(Benchmark, "settle", lambda self, basis, spread: (seen.append(spread), settle(self, basis, spread))[1])
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert corpus_pipeline.decontaminate(spark, spark.createDataFrame(docs, kind), str(tmp_path)).count() == 4000
    assert abs((seen[0] ** 2).sum() - 2 * len({t for _, t, *_ in docs})) < 1e-6 * len(docs)


def test_the_quality_stage_learns_from_every_label(spark, tmp_path, monkeypatch):
    """Weights and calibration count all labelled rows, and labels of any one fold of ids are enough to tell bad from good."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choices(["the", "an", "er", "st", "ou", "ti", "re", "ing"], k=rnd.randint(1, 3)))
    text = lambda i: " ".join(word().upper() + "!!" if i % 3 == 0 else word() for _ in range(rnd.randint(30, 90)))
    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    calibrated, solved, isotonic, solve = [], [], quality.isotonic, quality.np.linalg.solve
    monkeypatch.setattr(quality, "isotonic", lambda x, hits, n: (calibrated.append(sum(n)), isotonic(x, hits, n))[1])
    monkeypatch.setattr(quality.np.linalg, "solve", lambda a, b: (solved.append(a[-1, -1]), solve(a, b))[1])
    good = {i for i in range(300) if i % 3}
    for n, folds in enumerate(({0, 1, 2, 3, 4}, {0}, {1}, {2, 3, 4})):
        ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 in folds]
        spark.createDataFrame([(i, int(i % 3 > 0)) for i in ids], "doc_id long, quality int").write.parquet(str(tmp_path / str(n) / "labels.parquet"))
        kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path / str(n))).collect()}
        assert len(kept ^ good) <= 6, (folds, kept ^ good)
        assert calibrated[-1] == len(ids) and abs(max(solved) - len(ids) * (1 + quality.RIDGE)) < 1e-6
        solved.clear()
