"""Text quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts takes STATISTICS from each and writes them; all that follows reads that small table. The random
features approximate a Gaussian kernel. Each partition of the labelled rows sums its share of the normal equations, the
shares are added row by row, and the driver solves a system whose size depends on the number of features alone. The sums
are kept by PARTS of the rows, so the same pass gives the weights of all rows and those without each part. Each row is
scored by the weights without its own part, all these scores are binned, and the pools of adjacent violators over the
bins give calibrated probabilities: every labelled row counts in the weights and in the calibration.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, fold, kept_rows, materialize, numbered

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
BINS = 1000
PARTS = 5
SEED = 20
CUT = 0.3
#: The statistics, in order.
STATISTICS = [
    "log_words", "mean_word", "sd_word", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "doubled_words", "upper", "digits",
    "stops", "marks", "symbols", "space", "line_ends", "distinct_lines", "log_line", "packed", "other_script",
]
_UPPER, _DIGITS, _STOPS, _MARKS = bytes(range(65, 91)), b"0123456789", b".,;:", b"!?"
_SYMBOLS, _SPACE = b"#$%&*|<>{}[]=@^~\\/_+", b" \t\n\x0b\x0c\r"


def statistics(text: str | None) -> list[float]:
    """Of a whole text; an empty or null text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw, words, lines = text.encode(), text.split(), text.splitlines()
    n, size = max(1, len(words)), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    part = lambda chars: (size - len(raw.translate(None, chars))) / size
    return [
        np.log1p(len(words)), min(lengths.mean(), 30.0), min(lengths.std(), 30.0), (lengths <= 2).mean(), (lengths >= 12).mean(),
        len(set(words)) / n, Counter(words).most_common(1)[0][1] / n if words else 0.0, len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(eq, words, words[1:])) / n, part(_UPPER), part(_DIGITS), part(_STOPS), part(_MARKS), part(_SYMBOLS), part(_SPACE),
        raw.count(b"\n") / size, len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), len(zlib.compress(raw, 1)) / size, size / len(text) - 1,
    ]


def _statistics_pass(batches):
    for batch in batches:
        rows = [statistics(x) for x in batch["text"].to_pylist()]
        flat = np.asarray(rows, np.float32).reshape(-1)
        stats = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], stats], names=["row", "doc_id", "stats"])


class Model:
    """Standardisation, features, weights and calibration; a few thousand numbers."""

    def __init__(self, mean, sd, features=FEATURES, width=WIDTH, seed=SEED):
        rnd = np.random.default_rng(seed)
        self.mean, self.sd = np.asarray(mean), np.maximum(np.asarray(sd), 1e-9)
        self.turn = rnd.normal(0, 1 / width, (len(self.mean), features))
        self.phase = rnd.uniform(0, 2 * np.pi, features)
        self.weights, self.edges, self.levels = np.zeros(features + 1), np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated level, and a thousandth of the raw score to rank within a level."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.edges, self.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: list[float], hits: list[float], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels by pooling adjacent violators; x ascending."""
    pools: list[list[float]] = []
    for at, h, c in zip(x, hits, n):
        pools.append([h, c, at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            h2, c2, _, end = pools.pop()
            pools[-1][0] += h2
            pools[-1][1] += c2
            pools[-1][3] = end
    ends = [(e, p[0] / p[1]) for p in pools for e in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    return np.array([e for e, _ in ends]), np.array([v for _, v in ends])


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


def _normal_equations(model: Model):
    """Each task's share of the normal equations: of each of their rows the sums by part, one behind the other."""

    def step(batches):
        size = len(model.weights)
        total = np.zeros((size, PARTS, size + 1))
        for batch in batches:
            z, label, of = model.features(_stacked(batch)), batch["label"].to_numpy(zero_copy_only=False), batch["of"].to_numpy(zero_copy_only=False)
            for k in range(PARTS):
                own = z[of == k]
                total[:, k, :size] += own.T @ own
                total[:, k, size] += own.T @ label[of == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total.reshape(size, -1)), pa.list_(pa.float64()))], names=["row", "sums"])

    return step


def _added(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [group["row"].iloc[0]], "sums": [np.sum(np.stack(group["sums"].to_list()), axis=0)]})


def _solved(sums: np.ndarray) -> np.ndarray:
    size = len(sums)
    return np.linalg.solve(sums[:, :size] + RIDGE * max(1.0, sums[-1, size - 1]) * np.eye(size), sums[:, size])


def fit(stats: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """stats: doc_id, stats. labels: doc_id, label; a doc_id labelled repeatedly counts once, with the mean. All labelled rows count."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    of = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    rows = materialize(stats.join(known, "doc_id").select("stats", "label", of.alias("of")), "labelled")
    each = [f(F.get("stats", F.lit(i))).alias(f"{k}{i}") for i in range(len(STATISTICS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *each).first()
    if not found["n"]:
        return Model([0.0] * len(STATISTICS), [1.0] * len(STATISTICS), seed=seed)
    model = Model([found[f"m{i}"] for i in range(len(STATISTICS))], [found[f"s{i}"] for i in range(len(STATISTICS))], seed=seed)
    spark = stats.sparkSession
    few = rows.coalesce(4 * spark.sparkContext.defaultParallelism)
    shares = arrow_pass(few, _normal_equations(model), "row int, sums array<double>")
    size = len(model.weights)
    total = np.zeros((size, PARTS, size + 1))
    for r in shares.groupBy("row").applyInPandas(_added, "row int, sums array<double>").collect():
        total[r["row"]] = np.reshape(r["sums"], (PARTS, size + 1))
    whole = total.sum(axis=1)
    model.weights = _solved(whole)
    without = np.stack([_solved(whole - total[:, k]) for k in range(PARTS)], axis=1)

    def raw(batches):
        for batch in batches:
            unseen = (model.features(_stacked(batch)) @ without)[np.arange(batch.num_rows), batch["of"].to_numpy(zero_copy_only=False)]
            at = np.floor(np.clip(unseen, -0.5, 1.5) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch["label"]], names=["bin", "label"])

    bins = sorted(arrow_pass(rows, raw, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).collect())
    model.edges, model.levels = isotonic([(b["bin"] + 0.5) / BINS for b in bins], [b["hits"] for b in bins], [b["n"] for b in bins])
    return model


def _scored(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str = "quality", cut: float = CUT, row: str | None = None, hold_out: bool = True) -> DataFrame:
    stats = materialize(arrow_pass(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(row) if row else F.lit(None)).cast("long").alias("row")), _statistics_pass, "row long, doc_id long, stats array<float>"), "stats")
    seen = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    if hold_out:
        seen = seen.where(fold("doc_id", 5) != 0)
    model = fit(stats, seen)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(model.score(_stacked(batch)))], names=["row", "doc_id", "score"])

    found = arrow_pass(stats, scored, "row long, doc_id long, score double")
    return found.select("row", "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Labels of rows whose crc32(doc_id) mod 5 is 0 are never read. Null and empty texts are scored like any other, from
    zero statistics; null labels are skipped; without any label every score is about 0.5. Repeated rows get equal
    scores; rows without an id are scored and not learned from; other columns are not read.
    """
    return _scored(docs, labels, doc_id, text, label, cut).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text is predicted good, all their columns, whatever ids rows have. All labels are learned from."""
    own, row = numbered(docs, "documents")
    return kept_rows(own, row, _scored(own, labels, doc_id, text, row=row, hold_out=False).where("predicted = 0"), keep=False)
