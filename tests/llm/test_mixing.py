from tidemark.llm import mixing


def test_targets_share_everything_and_stop_at_three_sizes():
    got = mixing.targets([10, 100, 1000, 0], [1, 2, 3, 1])
    assert abs(sum(got) - 1110) < 1e-9 and all(g <= 3 * s for g, s in zip(got, [10, 100, 1000, 0]))
    assert got == [30.0, 300.0, 780.0, 0.0]


def test_segments_integrate_the_schedule():
    (f0, f1, *_), (g0, g1, *_) = mixing.segments([(0, 0), (0.5, 1), (1, 1)])
    assert (f0, g1) == (0, 1) and abs(f1 - 1 / 3) < 1e-12 and f1 == g0


def test_mix_on_odd_rows(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 3}", "x") for i in range(200)] + [(None, None, "s0", "x"), (3, "a b", "s0", "x"), (3, "a b", "s0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mixing.mix(df)
    got = plan.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["positions"]) for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7 and sum(r["size"] for r in own) == own[0]["source_size"]
    assert sorted(map(str, plan.collect())) == sorted(map(str, got))
    order = [r["at"] for r in mixing.training_order(plan).collect()]
    assert order == sorted(order) and all(0 <= x <= 1 for x in order) and len(order) == sum(len(r["positions"]) for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_schedule_is_followed(spark):
    df = spark.createDataFrame([(i, "w", "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    order = mixing.training_order(mixing.mix(df, weights=[1.0], schedules=lambda i: [(0, 1 - i), (0.5, 0.5), (1, i)])).collect()
    for end in (0.25, 0.5, 1.0):
        early = [r["source"] for r in order if r["at"] < end]
        share = 1 - end / 2  # of the integral of 1 - t in that of 1 - t and t
        assert abs(early.count("a") / len(early) - share) < 0.03
