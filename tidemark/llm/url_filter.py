"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

The first filter encodes the listed keys. Every key that the corpus can ask for is known, so the second encodes those
that the first wrongly passes, the third the listed keys that the second wrongly passes, and so on until none is left:
on the corpus's keys the answers are exact, and asking needs no join, only bits in a literal. A cascade takes about
1.44 * listed * log2(corpus keys / listed) bits; MOST_BITS bounds what goes to the executors. A list that takes more is
met by a join on the keys instead, with the same answers.

Rules and listed hosts are tables or lists of the caller's. Both are keys of one universe: hosts with a start of their
path, and hosts alone; one pass over the pages finds it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MOST_BITS = 1 << 26


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    level: int
    words: tuple[tuple[int, int], ...] = ()

    def places(self, key: Column) -> list[Column]:
        one, two = (F.pmod(F.xxhash64(key, F.lit(2 * self.level + k)), F.lit(self.bits)) for k in (0, 1))
        return [(one + i * two) % self.bits for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = [0] * -(-self.bits // 64)
        for k, v in self.words:
            words[k] = v
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # folds into one literal
        found = F.lit(True)
        for place in self.places(key):
            found = found & (F.getbit(F.get(table, (place / 64).cast("int")), (place % 64).cast("int")) == 1)
        return found

    def filled(self, keys: DataFrame) -> Bloom:
        """With the bits of all keys, gathered as at most bits / 64 words."""
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("place"))
        words = place.groupBy((F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        return Bloom(self.bits, self.hashes, self.level, tuple(sorted((r["word"], r["bits"]) for r in words.collect())))


def bits_of(n: int, rate: float) -> int:
    return max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
        """listed, universe: distinct keys, written. Exact on both; None where the first level would take more than most_bits."""
        inside, outside = listed, materialize(universe.join(listed, "key", "left_anti"), "others")
        n, others = inside.count(), outside.count()
        rate, levels = min(0.5, n * math.sqrt(0.5) / max(1, others)), []
        while n:
            bits = bits_of(n, rate or 0.5)
            if bits > most_bits:
                return None
            level = Bloom(bits, max(1, round(math.log2(1 / (rate or 0.5)))), len(levels)).filled(inside)
            levels.append(level)
            wrong = materialize(outside.where(level.passes(F.col("key"))), f"cascade{len(levels)}")
            inside, outside = wrong, inside
            n, rate = wrong.count(), 0.5
        return cls(tuple(levels))

    def holds(self, key: Column) -> Column:
        """Out at an odd level: not listed; out at an even one: listed; through all: listed if their number is odd."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            found = F.when(self.levels[k].passes(key), found).otherwise(F.lit(k % 2 == 1))
        return found


def _members(rows: DataFrame, keys: str, out: str, listed: DataFrame, universe: DataFrame, most_bits: int) -> DataFrame:
    """rows (rid, ..) with out: those of the array keys that are listed."""
    cascade = Cascade.build(listed, universe, most_bits)
    if cascade is not None:
        return rows.withColumn(out, F.filter(keys, lambda k: cascade.holds(k)))
    found = rows.select("rid", F.explode(keys).alias("key")).join(listed, "key").groupBy("rid").agg(F.collect_set("key").alias(out))
    return rows.join(found, "rid", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _table(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return _table(spark, [{"host": h, "path": p, "verdict": v} for h, p, v in rules], "host:string,path:string,verdict:string")


def host_table(spark: SparkSession, hosts: list[str]) -> DataFrame:
    return _table(spark, [{"host": h} for h in hosts], "host:string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    clean = lambda c: F.coalesce(c, F.lit(""))
    return clean(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), clean(path)


def filter_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, page_id: str = "page_id", url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of pages.

    rules: host, path, verdict; listed_hosts: host; repeated and null entries count once and not at all, of rules that
    contradict each other the one that blocks counts. A rule fits its host and all subdomains where the path starts with the rule's;
    the longest host and path wins, of equals the longer host. Where none fits, rule is null and the verdict is block for
    listed hosts and their subdomains, else allow. A url that is null or has no :// has an empty host and path, which no
    rule fits. Repeated rows are judged each by itself; other columns of pages are not read; an empty table gives an
    empty result.
    """
    rules = materialize(rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max_by("verdict", (F.col("verdict") == "block").cast("int")).alias("verdict")), "rules")
    hosts = materialize(listed_hosts.where("host is not null").select("host").distinct(), "hosts")
    # keys of rules have a mark before the path, so that they and hosts alone are different
    listed = materialize(rules.select(F.concat("host", F.lit(" "), "path").alias("key"), "verdict").unionByName(hosts.select(F.col("host").alias("key"), F.lit(None).cast("string").alias("verdict"))), "listed")
    dots = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))).alias("dots")
    shape = rules.select(dots(F.col("host")), F.length("path").alias("start")).unionByName(hosts.select(dots(F.col("host")), F.lit(None).alias("start")))
    found = shape.agg(F.array_sort(F.collect_set("dots")).alias("dots"), F.array_sort(F.collect_set("start")).alias("starts")).first()
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -(n + 1)) for n in found["dots"]]).cast("array<string>"))
    starts = F.filter(F.array(*[F.lit(n) for n in found["starts"]]).cast("array<int>"), lambda n: F.length("path") >= n)
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda n: F.concat(h, F.lit(" "), F.substring(F.col("path"), F.lit(1), n)))))
    rows = rows.withColumn("keys", F.concat(F.array_distinct(asked), suffixes))
    universe = materialize(rows.select(F.explode("keys").alias("key")).distinct(), "keys")
    fit = _members(rows, "keys", "fit", listed.select("key"), universe, most_bits)
    block = materialize(listed.where("verdict = 'block'").select("key"), "block")
    is_rule = lambda k: F.contains(k, F.lit(" "))
    longest = F.array_max(F.transform(F.filter("fit", is_rule), lambda k: F.struct(F.length(k).alias("all"), F.length(F.substring_index(k, " ", 1)).alias("host"), k.alias("key"))))
    judged = fit.withColumns({"best": longest["key"], "listed": F.exists("fit", lambda k: ~is_rule(k))})
    judged = judged.withColumn("asked", F.array_compact(F.array("best")))
    judged = _members(judged, "asked", "blocked", block, listed.where("verdict is not null").select("key"), most_bits)
    verdict = F.when(F.when(F.col("best").isNotNull(), F.size("blocked") > 0).otherwise(F.col("listed")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.replace("best", F.lit(" "), F.lit("")).alias("rule"), verdict.alias("verdict"))


SQL = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j as (select p.page_id, host, path, max_by(rh || rp, length(rh || rp)) as rule, max_by(rv, length(rh || rp)) as rv
  from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select page_id, host, path, rule, coalesce(rv, case when regexp_matches(host,
  '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') then 'block' else 'allow' end) as verdict from j
"""
