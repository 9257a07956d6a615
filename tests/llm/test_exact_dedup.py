import random

from tidemark.llm import exact_dedup as x

GONE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(GONE), []).append((-len(t or ""), i))
    return {i: (min(groups[k])[1], len(groups[k])) for i, t in rows for k in [(t or "").translate(GONE)]}


def rows():
    rnd = random.Random(1)
    out = [(0, None), (1, ""), (2, " \n")]
    for i in range(3, 120):
        t = "".join(rnd.choices("ab é", k=rnd.choice([1, 2, 3, 8, 9, 40, 400])))
        out.append((i, t if rnd.random() < 0.6 else out[rnd.randrange(3, len(out))][1] + " " if len(out) > 4 else t))
    return out


def check(spark, **more):
    data = rows()
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, rid string")
    got = {r["doc_id"]: r for r in x.exact_dedup(df, block_bytes=8, **more).collect()}
    want = brute(data)
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items())


def test_equals_brute_force(spark):
    check(spark)


def test_digests_that_collide_change_nothing(spark):
    check(spark, digest=lambda b: bytes([len(b) % 3]))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    got = x.exact_dedup(df).collect()
    assert sum(r["kept"] for r in got) == 1 and {r["group_size"] for r in got} == {3} and {r["keep_id"] for r in got} == {1}
    assert x.exact_dedup(df.where("false")).count() == 0
