"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's vocabulary; how many documents hold each word is counted over the whole
corpus. A distributed randomised SVD finds the latent space: each partition multiplies its passages with a thin block and
back, the products are added up in pieces, and the driver only orthonormalises a block of terms x RANK. The space is fit
on the benchmark and on all passages of all different texts. Texts are split into words once, which are written as the
benchmark's numbers of them; counts, space and search read these. A passage of frequent words adds its pairs of words to
a matrix of the task, which meets the block once; other passages meet it themselves, with the same result.
Every document is read whole: running sums of word vectors give the vector of each window, windows are
compared with benchmark passages of their length by cosine, and what is near enough is checked by the longest common
subsequence of words with the item, and by its answer, the last sentence, where that alone does not decide.

A window is compared with all items while they are few. Beyond DENSE passages an index of words names those that can pass:
a stretch that holds half of an item's words in order holds one of the rarest of them, one more than half, so each item
is listed under these alone and the result is the same.

One group of items goes to every executor, about MOST_ITEMS items and MOST_WORDS words at most; a larger benchmark is
searched group by group.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, kept_rows, materialize, numbered, sent

RANK, SPARE, POWERS = 96, 8, 2
PASSAGE = 32
#: So many of the most frequent words have their pairs added up, in a matrix of this width; words that are read at a time.
PAIRED, STRETCH = 4096, 1 << 16
#: Window lengths; an item is compared in the shortest that holds it, longer items in pieces of the longest.
WINDOWS = (32, 64, 128)
LIKELY = 0.35
#: Shares of an item's words, in order, that decide; between them the answer needs ANSWER.
SAME, RELATED, ANSWER = 0.7, 0.5, 0.8
MOST_ITEMS, MOST_WORDS = 20_000, 1_000_000
DENSE = 1024
PIECE = 8192
SEED = 9
_FLAT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Letters and digits and what is beyond ASCII, lower-cased, between all else."""
    return text.lower().encode().translate(_FLAT).split() if text else []


def lcs(masks: dict[int, int], size: int, found: list[int]) -> int:
    """Length of the longest common subsequence; masks: for each word its places in the item as bits."""
    full = (1 << size) - 1
    rest = full
    for w in found:
        m = masks.get(w)
        if m is not None:
            hit = rest & m
            rest = ((rest + hit) | (rest - hit)) & full
    return size - rest.bit_count()


def _masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Benchmark:
    """The items as word ids with what their checks need, and the terms' weights and latent vectors."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, words_of(t)) for i, t in items]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.terms = max(1, len(self.ids))
        self.kind = np.int16 if self.terms < 1 << 15 else np.int32
        self.checks, self.pairs, self.singles = [], {}, {}
        for n, ((_, text), (_, ws)) in enumerate(zip(items, self.items)):
            own = [self.ids[w] for w in ws]
            parts = [p for p in re.split("[.!?]", text or "") if words_of(p)]
            answer = [self.ids[w] for w in words_of(parts[-1])] if parts else []
            self.checks.append((_masks(own), len(own), _masks(answer), len(answer)))
            if len(own) == 1:
                self.singles.setdefault(own[0], []).append(n)
            elif len(own) == 2:
                self.pairs.setdefault(tuple(own), []).append(n)

    def known(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))

    def weigh(self, docs: int, holding: dict[int, int]) -> None:
        got = np.zeros(self.terms)
        for k, n in holding.items():
            got[k] = n
        self.idf = np.log((1 + docs) / (1 + np.minimum(got, docs))) + 0.01

    def settle(self, basis: np.ndarray, spread: np.ndarray) -> None:
        """Latent directions of words, scaled by the space's spread and as long as their idf, so that words which the space
        hardly holds still count; pieces of items as unit vectors for each window length."""
        turned = basis / spread
        vectors = self.idf[:, None] * turned / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12)
        self.vectors = vectors.astype(np.float32)
        self.stray = float((self.vectors**2).sum(1).mean()) if self.ids else 1.0
        self.queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, (_, ws) in enumerate(self.items):
            own = self.known(ws)
            if len(own) < 3:
                continue
            size = next((w for w in WINDOWS if w >= len(own)), WINDOWS[-1])
            for at in range(0, len(own), size):
                v = self.vectors[own[at : at + size]].sum(0)
                if (norm := float(np.linalg.norm(v))) > 0:
                    held.setdefault(size, []).append((n, v / norm))
        self.listed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, rows in held.items():
            owner = np.array([n for n, _ in rows])
            self.queries[size] = (owner, np.stack([v for _, v in rows]).astype(np.float32))
            if len(rows) > DENSE:
                self.listed[size] = self._postings(owner)

    def _postings(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, from where on its passages stand in the second array: those of items that have it among their rarest."""
        word, passage = [], []
        for q, n in enumerate(owner):
            own = self.known(self.items[n][1])
            rare = own[np.lexsort((own, -self.idf[own]))][: len(own) - math.ceil(RELATED * len(own)) + 1]
            distinct = np.unique(rare)
            word.append(distinct)
            passage.append(np.full(len(distinct), q))
        word, passage = np.concatenate(word), np.concatenate(passage)
        order = np.lexsort((passage, word))
        return np.searchsorted(word[order], np.arange(self.terms + 1)), passage[order]

    def _near(self, size: int, window: np.ndarray, norm: np.ndarray, starts: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs (window, passage) whose cosine is LIKELY or more and that can pass the check."""
        owner, queries = self.queries[size]
        if size not in self.listed:
            return np.argwhere(window @ queries.T >= LIKELY * norm[:, None])
        begin, passage = self.listed[size]
        word = part[at]
        times = begin[word + 1] - begin[word]
        hit = np.repeat(np.arange(len(at)), times)
        q = passage[np.repeat(begin[word], times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]
        length = np.array([c[1] for c in self.checks])[owner[q]]
        reach = np.maximum(size // 2, length - size // 2)
        low, high = np.searchsorted(starts, at[hit] - size - reach, side="right"), np.searchsorted(starts, at[hit] + reach, side="right")
        spread = np.maximum(high - low, 0)
        w = np.repeat(low, spread) + np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
        pairs = np.unique(w * len(owner) + np.repeat(q, spread))
        w, q = pairs // len(owner), pairs % len(owner)
        near = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(w), 100_000):
            a, b = w[k : k + 100_000], q[k : k + 100_000]
            ok = np.einsum("ij,ij->i", window[a], queries[b]) >= LIKELY * norm[a]
            near.append(np.stack([a[ok], b[ok]], 1))
        return np.concatenate(near)

    def leaks(self, words: list[bytes] | np.ndarray) -> dict[int, float]:
        """item number: the largest share of its words found in order, of a whole document's words or their numbers."""
        ids = words if isinstance(words, np.ndarray) else self.known(words)
        out: dict[int, float] = {}
        if len(ids) == 1:
            out.update(dict.fromkeys(self.singles.get(int(ids[0]), []), 1.0))
        if self.pairs:
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            for a, b in set(zip(ids[both].tolist(), ids[both + 1].tolist())):
                out.update(dict.fromkeys(self.pairs.get((a, b), []), 1.0))
        for begin in range(0, max(1, len(ids)), PIECE):
            start = max(0, begin - WINDOWS[-1])
            part = ids[start : begin + PIECE + WINDOWS[-1]]
            at = np.flatnonzero(part >= 0)
            if not len(at):
                continue
            total = np.zeros((len(at) + 1, self.vectors.shape[1]), np.float32)
            np.cumsum(self.vectors[part[at]], axis=0, out=total[1:])
            for size, (owner, _) in self.queries.items():
                starts = np.arange(0, max(1, len(part) - size // 2), size // 2)
                lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + size)
                some = np.flatnonzero(hi - lo >= 3)
                if not len(some):
                    continue
                lo, hi, starts = lo[some], hi[some], starts[some]
                window = total[hi] - total[lo]
                strays = np.minimum(starts + size, len(part)) - starts - (hi - lo)
                norm = np.sqrt(np.einsum("ij,ij->i", window, window) + self.stray * strays)
                for w, q in self._near(size, window, norm, starts, part, at):
                    n = int(owner[q])
                    if out.get(n, 0.0) >= 1.0:
                        continue
                    masks, m, last, m_last = self.checks[n]
                    reach = max(size // 2, m - size // 2)
                    seen = ids[max(0, start + starts[w] - reach) : start + starts[w] + size + reach].tolist()
                    share = lcs(masks, m, seen) / m
                    if share >= RELATED and share > out.get(n, 0.0):
                        if share >= SAME or m_last and lcs(last, m_last, seen) >= ANSWER * m_last and m_last < m:
                            out[n] = share
        return out


def _as_numbers(shipped):
    """doc_id, copy, words: a row's words as the benchmark's numbers of them, -1 for all others."""

    def step(batches):
        bench = shipped.value
        for batch in batches:
            words = pa.array([bench.known(words_of(text)).astype(bench.kind).tobytes() for text in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["copy"], words], names=["doc_id", "copy", "words"])

    return step


def _holding(terms: int, kind: type):
    """term, n: documents of the task that hold each of the benchmark's words; their number at -1."""

    def step(batches):
        total, docs = np.zeros(terms + 1, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for words in batch["words"].to_pylist():
                total[np.unique(np.frombuffer(words, kind))] += 1  # -1 is the last place
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], docs), pa.int64())], names=["term", "n"])

    return step


def _stretches(batch: pa.RecordBatch, bench: Benchmark):
    """Numbers of words, the passage of each, and each passage's weight, about STRETCH words at a time."""

    def passages() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in held])
        many = -(-n // PASSAGE)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.concatenate(held).astype(np.int64), np.repeat(np.cumsum(many) - many, n) + place // PASSAGE, np.repeat(weights, many)

    written = "words" in batch.schema.names
    held, weights, size = [], [], 0
    for words, weight in zip(batch["words" if written else "text"].to_pylist(), batch["weight"].to_pylist()):
        ids = np.frombuffer(words, bench.kind) if written else bench.known(words_of(words))
        for at in range(0, len(ids), STRETCH):
            held.append(ids[at : at + STRETCH])
            weights.append(weight)
            size += len(held[-1])
            if size >= STRETCH:
                yield passages()
                held, weights, size = [], [], 0
    if held:
        yield passages()


def _add_pairs(pairs: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Adds a a^T of each passage a, one of each two words' places; entries by passage."""
    size = np.bincount(row)[row]
    order = np.argsort(size, kind="stable")
    term, value, size = term[order], value[order], size[order]
    flat = pairs.reshape(-1)
    for m in np.unique(size):
        begin, end = np.searchsorted(size, [m, m + 1])
        t, v = term[begin:end].reshape(-1, m).T.copy(), value[begin:end].reshape(-1, m).T.copy()
        one, two = np.triu_indices(m)
        np.add.at(flat, (t[one] * len(pairs) + t[two]).reshape(-1), (v[one] * v[two]).reshape(-1))


def _add_products(total: np.ndarray, block: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Adds a a^T block of each passage a; entries by passage."""
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for k in range(0, len(starts), 256):
        begin, end = starts[k], starts[k + 256] if k + 256 < len(starts) else len(row)
        t, v, cut = term[begin:end], value[begin:end, None], starts[k : k + 256] - begin
        met = np.add.reduceat(v * block[t], cut, axis=0)
        out = np.repeat(met, np.diff(np.append(cut, end - begin)), axis=0) * v
        order = np.argsort(t, kind="stable")
        t = t[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total[t[first]] += np.add.reduceat(out[order], first, axis=0)


def _products(shipped, block: np.ndarray):
    """Each task's share of A^T A block, A the unit TF-IDF passages of its texts, in pieces of rows."""

    def step(batches):
        bench, total = shipped.value, np.zeros(block.shape)
        often = np.argsort(bench.idf, kind="stable")[:PAIRED]
        rank = np.full(bench.terms, -1)
        rank[often] = np.arange(len(often))
        pairs = np.zeros((len(often), len(often)))
        for batch in batches:
            for ids, row, weight in _stretches(batch, bench):
                known = ids >= 0
                cell, times = np.unique(row[known] * bench.terms + ids[known], return_counts=True)
                if not len(cell):
                    continue
                row, term = cell // bench.terms, cell % bench.terms
                value = times * bench.idf[term]
                value *= np.sqrt(weight / np.maximum(np.bincount(row, value**2, len(weight)), 1e-300))[row]
                rare = (np.bincount(row, rank[term] < 0) > 0)[row]
                if not rare.all():
                    _add_pairs(pairs, row[~rare], rank[term[~rare]], value[~rare])
                if rare.any():
                    _add_products(total, block, row[rare], term[rare], value[rare])
        total[often] += pairs @ block[often] + pairs.T @ block[often] - pairs.diagonal()[:, None] * block[often]
        rows = range(0, len(total), 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([total[r : r + 64].reshape(-1) for r in rows], pa.list_(pa.float64()))], names=["piece", "part"])

    return step


def _added(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "part": [np.sum(np.stack(group["part"].to_list()), axis=0)]})


def _svd(some: DataFrame, shipped, terms: int, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of the passages of some (words or text, weight), by randomised subspace iteration."""
    few = some.coalesce(4 * some.sparkSession.sparkContext.defaultParallelism)

    def product(block: np.ndarray) -> np.ndarray:
        kind, out = "piece int, part array<double>", np.zeros(block.shape)
        for r in arrow_pass(few, _products(shipped, block), kind).groupBy("piece").applyInPandas(_added, kind).collect():
            out[r["piece"] : r["piece"] + 64] = np.reshape(r["part"], (-1, block.shape[1]))
        return out

    basis = np.random.default_rng(seed).normal(size=(terms, min(terms, rank + SPARE)))
    for _ in range(POWERS):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    order = np.argsort(-values)[:rank]
    values = np.maximum(values[order], 0)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    return (basis @ turn[:, order])[:, keep], np.sqrt(values[keep])


_FOUND = "doc_id long, contaminated boolean, item_ids array<long>, score double, item_scores array<double>"


def _search(own: DataFrame, items: DataFrame, rank: int) -> DataFrame:
    """_FOUND of own (doc_id, text) for one group of items (item, words)."""
    spark = own.sparkSession
    bench = Benchmark(sorted((r[0], r[1] or "") for r in items.collect()))
    kind, numbers = "doc_id long, copy long, words binary", _as_numbers(sent(spark, bench))
    read = materialize(arrow_pass(own.select("doc_id", "text", F.xxhash64("text").alias("copy")), numbers, kind), "words")
    found = {r["term"]: r["n"] for r in arrow_pass(read.select("words"), _holding(bench.terms, bench.kind), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(-1, 0)
    bench.weigh(n, found)
    shipped = sent(spark, bench)
    every = read.select("copy", "words").distinct().select("words", F.lit(0).alias("item"))
    listed = arrow_pass(items.select(F.col("item").alias("doc_id"), F.col("words").alias("text"), F.lit(0).cast("long").alias("copy")), numbers, kind)
    some = materialize(every.unionByName(listed.select("words", F.lit(1).alias("item"))), "passages")
    size = {r["item"]: r["size"] or 0 for r in some.groupBy("item").agg(F.sum(F.length("words")).alias("size")).collect()}
    # the items weigh as much as the corpus's passages, else the space has no room for their rare words
    weight = F.when(F.col("item") == 1, F.lit(max(1.0, size.get(0, 0) / max(1, size.get(1, 0))))).otherwise(1.0)
    bench.settle(*_svd(some.select("words", weight.alias("weight")), shipped, bench.terms, rank, SEED))
    settled = sent(spark, bench)

    def search(batches):
        bench = settled.value
        for batch in batches:
            got = []
            for words in batch["words"].to_pylist():
                best: dict[int, float] = {}
                for n, share in bench.leaks(np.frombuffer(words, bench.kind).astype(np.int64)).items():
                    best[bench.items[n][0]] = max(share, best.get(bench.items[n][0], 0.0))
                got.append(sorted(best.items()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([bool(g) for g in got]), pa.array([[i for i, _ in g] for g in got], pa.list_(pa.int64())), pa.array([max((x for _, x in g), default=0.0) for g in got], pa.float64()),
                 pa.array([[x for _, x in g] for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "contaminated", "item_ids", "score", "item_scores"],
            )

    return arrow_pass(read.select("doc_id", "words"), search, _FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), score, item_scores (the largest share of each item's words found in order): one row per row of docs.

    Checks see a document as far around a window as the item is long. An item of two words is found where they follow
    each other, one of a single word in a document of that word alone. Null and empty texts hold nothing; items without
    words or id are never found; repeated rows get equal results; an empty benchmark or table finds nothing. Other columns
    are not read.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("words")).where(F.col("item").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.split("words", r"\s+"))), F.lit(0)).alias("words")).first()
    groups = max(1, math.ceil(size["n"] / MOST_ITEMS), math.ceil(size["words"] / MOST_WORDS))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if groups == 1:
        return _search(own, items, rank)
    rows = materialize(own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "documents")
    found = None
    for g in range(groups):
        part = _search(rows.select(F.col("rid").alias("doc_id"), "text"), items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), rank)
        part = materialize(part.where("contaminated").select(F.col("doc_id").alias("rid"), F.inline(F.arrays_zip("item_ids", "item_scores"))), "leaks")
        found = part if found is None else found.unionByName(part)
    each = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("item_ids", "item_scores"))).alias("all"))
    all_of = lambda c, kind: F.coalesce(F.col("all")[c], F.array().cast(kind))
    whole = rows.select("rid", "doc_id").join(each, "rid", "left")
    return whole.select(
        "doc_id", F.col("all").isNotNull().alias("contaminated"), all_of("item_ids", "array<long>").alias("item_ids"), F.coalesce(F.array_max(F.col("all")["item_scores"]), F.lit(0.0)).alias("score"),
        all_of("item_scores", "array<double>").alias("item_scores"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, all their columns, whatever ids rows have."""
    own, row = numbered(docs, "documents")
    return kept_rows(own, row, find_leaks(own, benchmark, row, text).where("contaminated").select(F.col("doc_id").alias("row")), keep=False)
