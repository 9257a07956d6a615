"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule of its weight over training time 0..1, given by knots. The
schedule is integrated piece by piece; a source's documents, in a fixed pseudo-random order, demand its words one after
the other, and inverting the integral at the middle of a document's demand gives its training position. Documents are
then range-sorted by position. Running totals within a source come from range partitions: each part sums its own rows,
and the driver adds up one figure per part and source, so a source that holds most rows is spread over many parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, partitions

Knots = list[tuple[float, float]]
#: Base weights and schedules, dealt to the sources in order of code point, null last, repeating.
WEIGHTS = [1.0, 2.0, 3.0]
SCHEDULES: list[Knots] = [[(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.5), (1.0, 0.5)]]
MOST_REPEATS = 3


def targets(sizes: list[int], weights: list[float], share: float = 1.0, repeats: int = MOST_REPEATS) -> list[float]:
    """Targets in proportion to the weights, none above repeats times its size; what is cut goes to the others by weight.

    A source is full where its cap by weight is below the level that the sources not yet full would reach.
    """
    left, weight, out = share * sum(sizes), sum(w for w, s in zip(weights, sizes)), [0.0] * len(sizes)
    by_level = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    for n, i in enumerate(by_level):
        cap = float(repeats * sizes[i])
        if cap / weights[i] >= left / weight:
            for j in by_level[n:]:
                out[j] = weights[j] * (left / weight)
            break
        out[i], left, weight = cap, left - cap, weight - weights[i]
    return out


def segments(knots: Knots) -> list[tuple[float, ...]]:
    """f0, f1, t0, dt, a, b of each piece: the share of the source's demand before and after it, its start, length, and end weights."""
    if len(knots) < 2 or any(t1 <= t0 for (t0, _), (t1, _) in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("knots: rising times and weights of at least 0")
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
    if not sum(areas):
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:]), areas):
        if area:
            out.append(tuple(map(float, (done / sum(areas), (done + area) / sum(areas), t0, t1 - t0, a, b))))
        done += area
    return out


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: list[float] | None = None,
    schedules: Callable[[int], Knots] | None = None, share: float = 1.0, repeats: int = MOST_REPEATS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions, position, range-sorted by position.

    size counts words, 0 for null and empty texts, which take nothing. taken counts words with repeats: size times a
    number of passes, at most repeats. positions holds the place in 0..1 of each pass, position the first in billionths,
    -1 where nothing is taken. Null sources form a source of their own, after all others. Rows that repeat a doc_id
    are mixed each by itself. An empty table gives an empty result. The list of sources goes to the driver: it needs to
    hold one row per source, not per document.
    """
    weights = weights or WEIGHTS
    schedules = schedules or (lambda i: SCHEDULES[i % len(SCHEDULES)])
    spark = docs.sparkSession
    order = [F.col("source").isNull(), "source", "key", "doc_id", "size"]
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    dealt = materialize(sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "dealt")
    sums = sorted(((r["source"] is None, r["source"] or "", r["part"], r["words"]) for r in dealt.groupBy("source", "part").agg(F.sum("size").alias("words")).collect()))
    names = list(dict.fromkeys(x[:2] for x in sums))
    total: dict[tuple, int] = {}
    for *n, _, words in sums:
        total[tuple(n)] = total.get(tuple(n), 0) + words
    goal = dict(zip(names, targets([total[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], share, repeats)))
    rank = {n: i for i, n in enumerate(names)}
    before, run, plan = {}, {}, []
    for n0, n1, part, words in sums:
        n = (n0, n1)
        before[n, part] = run.get(n, 0)
        run[n] = before[n, part] + words
        plan.append((None if n0 else n1, part, before[n, part], total[n], goal[n], segments(schedules(rank[n]))))
    piece = "array<struct<f0:double,f1:double,t0:double,dt:double,a:double,b:double>>"
    table = spark.createDataFrame(plan, f"p_source string, p_part int, before long, source_size long, target double, pieces {piece}")
    joined = dealt.join(table, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    inside = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = joined.withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    rest = F.col("target") - whole * F.col("source_size")
    passes = F.when(F.col("size") > 0, whole + F.when(2 * F.col("start") + F.col("size") < 2 * rest, 1).otherwise(0)).otherwise(0)
    counted = start.withColumn("passes", passes.cast("int"))

    def place(n):
        f = (n * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target")
        p = F.element_at(F.filter("pieces", lambda x: (f >= x["f0"]) & (x["f0"] < 1)), -1)
        g = F.least((f - p["f0"]) / (p["f1"] - p["f0"]), F.lit(1.0))
        a, b = p["a"], p["b"]
        return p["t0"] + p["dt"] * F.when(a == b, g).otherwise((-a + F.sqrt(a * a + (b - a) * (a + b) * g)) / F.when(a != b, b - a))

    spread = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), place)).otherwise(F.array().cast("array<double>"))
    out = counted.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), spread.alias("positions"), "key")
    out = out.withColumn("position", F.coalesce(F.floor(F.get("positions", F.lit(0)) * 1e9), F.lit(-1)))
    return out.repartitionByRange(partitions(spark), "position", "key").sortWithinPartitions("position", "key", "doc_id").drop("key")


def training_order(plan: DataFrame) -> DataFrame:
    """One row per pass over a document, in training order: doc_id, source, size, pass, at."""
    rows = plan.select("doc_id", "source", "size", F.posexplode("positions").alias("pass", "at"))
    return rows.repartitionByRange(partitions(plan.sparkSession), "at", "doc_id").sortWithinPartitions("at", "doc_id")


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as i from d group by source),
w as (select *, (i % 3 + 1)::double as weight, 3 * source_size / ((i % 3 + 1)::double) as level, sum(source_size) over ()::bigint as total from s),
o as (select *, row_number() over (order by level, i) as rank from w),
r as (select *,
    total - coalesce(sum(3 * source_size) over (order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
    sum(weight) over (order by rank rows between current row and unbounded following) as weights from o),
f as (select min_by(rest::double / weights, rank) as height, min(rank) as first from r where level >= rest::double / weights),
t as (select r.source, r.source_size, r.i, case when rank < first then (3 * source_size)::double else weight * height end as target from r, f),
c as (select d.doc_id, d.size, t.*, sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id)::bigint - d.size as start
  from d join t on d.source is not distinct from t.source),
p as (select *, floor(target / source_size) as whole from c),
q as (select *, case when size > 0 then (whole + case when 2 * start + size < 2 * (target - whole * source_size) then 1 else 0 end)::bigint else 0 end as passes,
    (start + size / 2::double) / target as g, case i % 3 when 0 then 0.5::double when 1 then 1::double else 1.5::double end as a from p)
select doc_id, size, source_size, target, size * passes as taken,
  case when passes > 0 then floor((case when i % 3 = 1 then g else (-a + sqrt(a * a + (2 - a - a) * 2::double * g)) / (2 - a - a) end) * 1e9)::bigint else -1 end as position
from q
"""
