import random

from tidemark.llm import language
from tidemark.llm.common import frequent


def corpus():
    rnd = random.Random(3)
    bits = {"xx": ["the", "ing", "er", "sh"], "yy": ["ción", "que", "ll", "ar"]}
    rows = []
    for i in range(400):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join("".join(rnd.choices(bits[lang], k=rnd.randint(1, 4))) for _ in range(rnd.choice([2, 20, 200]))) + ".", lang, "s"))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus() + [(9001, None, "xx", "s"), (9002, "", None, "s"), (9003, "12 3² ²!", "xx", "s"), (9004, "ÇÓ ción", None, "s"), (None, "shing", None, "s"), (5, "que", "xx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.language_id(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    held = [r for r in rows[:400] if r[0] != 5 and by[r[0]]["held_out"]]
    assert len(held) > 60 and all(by[r[0]]["lang_pred"] == r[2] for r in held)
    assert [by[k]["lang_pred"] for k in (9001, 9002, 9003, 9004, None)] == ["und", "und", "und", "yy", "xx"]
    assert language.language_id(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in language.language_id(df.withColumn("lang", df["lang"].substr(9, 1))).collect()} <= {"und", ""}


def test_unseen_words_fall_back_to_the_longest_known_piece():
    grams = [{"gram": g, "lang": x, "n": n} for g, x, n in [("a", "p", 9), ("a", "q", 1), ("ab", "q", 5), ("b", "p", 1)]]
    m = language.Model(["p", "q"], [], grams, {"p": 10, "q": 10})
    assert (m.unseen("ab") == m.gram_logs[m.grams["ab"]]).all()
    assert (m.unseen("a?") == m.gram_logs[m.grams["a"]]).all() and not m.unseen("??").any()


def test_frequent_takes_the_most_frequent_and_a_share_of_equal_ones(spark):
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate([100, 50, 50, 7, 7, 7, 1, 1])], "word string, n long")
    assert {r["n"] for r in frequent(df, 3, "word").collect()} == {100, 50} and frequent(df, 8, "word").count() == 8 and frequent(df, 0, "word").count() == 0
    equal = spark.range(3000).selectExpr("cast(id as string) as word", "if(id = 0, 9L, 2L) as n")
    got = frequent(equal, 2000, "word")
    assert 1600 < got.count() <= 2000 and got.where("n = 9").count() == 1


def test_words_and_pieces_beyond_the_held_ones_count(spark, monkeypatch):
    df = spark.createDataFrame(corpus() + [(9001, None, "xx", "s"), (9002, "12", "yy", "s")], "doc_id long, text string, lang string, score string")
    want = sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language.language_id(df).collect())
    for most in (0, 40):
        monkeypatch.setattr(language, "frequent", lambda counts, _, key: frequent(counts, most, key))  # noqa: B023
        assert sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language.language_id(df).collect()) == want
