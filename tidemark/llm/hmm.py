"""A hidden Markov language model, trained by Baum-Welch over partitions and asked by the scaled forward recursion.

Tokens are words and one end per text. Each token has a class: the most frequent words, about OWN of them, have one each,
the end has one, and every other word shares one of SHAPES classes by its last bytes. Hidden states emit classes, and
within a class a word has the share (its count + 1) / (counts of the class + its distinct words + 1), so unseen words have
some probability and every text has one. A text's likelihood is then the forward recursion over its classes, times the
shares of its words. Counts of words live in a table that grows with the corpus: tokens without a class of their own meet
their counts in a join.

States start as kinds of segments, by a mixture over a few of them; rounds of Baum-Welch over all segments follow until
the likelihood hardly grows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, fold, frequent, materialize, row_base, sent

STATES = 8
OWN = 60_000
SHAPES = 256
SEGMENT = 256
#: The first states come from a mixture over about this many segments; then come rounds over all of them, until one gains
#: less than ENOUGH of the log likelihood, MOST_ROUNDS at most.
WARM_SEGMENTS, WARM_ROUNDS, MOST_ROUNDS = 2000, 20, 4
ENOUGH = 5e-3
#: A state's counts are joined by so many of the whole corpus's, dealt by frequency.
PRIOR = 5000.0
SMOOTH = 0.1
SEED = 10
_HELD = 400_000
_CHUNK = 1024


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split() if text else []


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


def _count(batches):
    """word, n of each task's texts, in parts; the number of texts stands at the null word."""
    held: Counter = Counter()
    texts = 0

    def out():
        keys, values = list(held), list(held.values())
        for k in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000], pa.binary()), pa.array(values[k : k + 50_000], pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        texts += batch.num_rows
        for text in _raw(batch["text"]):
            held.update(tokens(text))
            if len(held) > _HELD:
                yield from out()
    yield from out()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])


class Vocabulary:
    """The frequent words with their counts, and what all words add up to."""

    def __init__(self, frequent: list[tuple[bytes, int]], texts: int, total: int, distinct: int, shapes: dict[int, tuple[int, int]]):
        self.counts = dict(frequent)
        self.own = {w: i for i, (w, _) in enumerate(frequent)}
        self.end, self.classes = len(self.own), len(self.own) + 1 + SHAPES
        self.texts, self.total, self.distinct = texts, total, distinct
        sizes = np.array([sum(shapes.get(s, (0, 0))) + 1 for s in range(SHAPES)], np.float64)
        self.class_logs = np.concatenate([np.zeros(self.end + 1), -np.log10(sizes)])
        share = np.concatenate([[n + 1 for _, n in frequent], [texts + 1], sizes])
        self.share = share / share.sum()

    def encode(self, words: list[bytes], shapes: dict[bytes, int]) -> np.ndarray:
        get, base, out = self.own.get, self.end + 1, []
        for w in words:
            k = get(w)
            if k is None:
                k = shapes.get(w)
                if k is None:
                    if len(shapes) > 200_000:
                        shapes.clear()
                    k = shapes[w] = base + _shape(w)
            out.append(k)
        out.append(self.end)
        return np.array(out, np.uint32)


def vocabulary(counts: DataFrame, own: int = OWN) -> Vocabulary:
    held = [(bytes(r["word"]), r["n"]) for r in frequent(counts.where("word is not null"), own, "word").collect()]
    held.sort(key=lambda x: (-x[1], x[0]))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.expr("if(word is null, n, 0)")).alias("texts")).first()
    known = sent(counts.sparkSession, {w for w, _ in held})

    def shapes(batches):
        n, types, mine = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64), known.value
        for batch in batches:
            for w, c in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                if w is not None and w not in mine:
                    s = _shape(w)
                    n[s] += c
                    types[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(n), pa.array(types)], names=["shape", "n", "types"])

    rows = arrow_pass(counts, shapes, "shape int, n long, types long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    return Vocabulary(held, whole["texts"] or 0, whole["total"] or 0, whole["distinct"], {r["shape"]: (r["n"], r["types"]) for r in rows})


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, classes: int, states: int = STATES, seed: int = SEED) -> Hmm:
        rnd = np.random.default_rng(seed)
        share = lambda *shape: (x := rnd.uniform(0.5, 1.5, shape)) / x.sum(-1, keepdims=True)
        return cls(share(states), share(states, states), share(states, classes))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray | None = None) -> Hmm:
        """share: how all classes are spread over the corpus, which every state's counts are drawn to."""
        even = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
        seen = even(emit) if share is None else (emit + PRIOR * share) / (emit.sum(-1, keepdims=True) + PRIOR)
        return cls(even(start), even(move), seen)

    @classmethod
    def of_segments(cls, rows: list[np.ndarray], classes: int, share: np.ndarray, states: int = STATES, rounds: int = WARM_ROUNDS, seed: int = SEED) -> Hmm:
        """States that each stand for a kind of segment: a mixture, begun with segments that are unlike each other."""
        rnd, n = np.random.default_rng(seed), len(rows)
        place = np.repeat(np.arange(n), [len(r) for r in rows])
        flat = np.concatenate(rows).astype(np.int64)
        emit = np.tile(share, (states, 1))
        far = np.zeros(n)
        for s in range(states):
            pick = rows[int(np.argmax(far)) if s else int(rnd.integers(n))].astype(np.int64)
            emit[s] = (np.bincount(pick, minlength=classes) + PRIOR * share) / (len(pick) + PRIOR)
            # how badly the states so far account for a segment, by token
            fit = np.stack([np.bincount(place, weights=np.log(emit[k] / share)[flat], minlength=n) for k in range(s + 1)]).max(0)
            far = -fit / np.sqrt(np.bincount(place, minlength=n) + 1.0)
        weight = np.full(states, 1 / states)
        for _ in range(rounds):
            logs = np.stack([np.bincount(place, weights=np.log(emit[k])[flat], minlength=n) for k in range(states)], 1) + np.log(weight)
            part = np.exp(logs - logs.max(1, keepdims=True))
            part /= part.sum(1, keepdims=True)
            weight = (part.sum(0) + 1) / (n + states)
            for s in range(states):
                got = np.bincount(flat, weights=part[place, s], minlength=classes)
                emit[s] = (got + PRIOR * share) / (got.sum() + PRIOR)
        move = 0.1 * np.tile(weight, (states, 1)) + 0.9 * np.eye(states)
        return cls(weight / weight.sum(), move, emit)

    def expected(self, rows: list[tuple[bool, np.ndarray]]) -> tuple[np.ndarray, float]:
        """Expected counts over segments, as states x (1 start + states + classes), by forward and backward recursion, and
        the log10 likelihood.

        A segment that does not begin a text begins with the last token of the one before: the step from there counts,
        the token itself does not count again.
        """
        k, classes = self.emit.shape
        out, likely = np.zeros((k, 1 + k + classes)), 0.0
        rows = sorted(rows, key=lambda r: -len(r[1]))
        by_class = np.ascontiguousarray(self.emit.T)
        middle = self.stationary()
        codes_of, weights_of = [], []
        steps_seen = np.zeros((k, k))
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            sizes = np.array([len(r[1]) for r in part])
            first = np.array([r[0] for r in part])
            n, steps = len(part), int(sizes[0])
            codes = np.zeros((steps, n), np.int64)
            for i, (_, c) in enumerate(part):
                codes[: len(c), i] = c
            seen = by_class[codes]
            live = np.array([np.searchsorted(-sizes, -t, side="left") for t in range(steps)])  # rows longer than t
            forward, scale = np.zeros((steps, n, k)), np.ones((steps, n))
            now = np.where(first[:, None], self.start, middle) * seen[0]
            for t in range(steps):
                m = live[t]
                if t:
                    now = (forward[t - 1, :m] @ self.move) * seen[t, :m]
                scale[t, :m] = now[:m].sum(1)
                forward[t, :m] = now[:m] / scale[t, :m, None]
            back = np.ones((n, k))
            backs = np.zeros((steps, n, k))
            for t in range(steps - 1, -1, -1):
                m = live[t]
                if t + 1 < steps and (later := live[t + 1]):
                    weighed = backs[t + 1, :later] * seen[t + 1, :later] / scale[t + 1, :later, None]
                    steps_seen += forward[t, :later].T @ weighed
                    back[:later] = weighed @ self.move.T
                backs[t, :m] = back[:m]
            held = forward * backs
            out[:, 0] += held[0][first].sum(0)
            inside = np.arange(steps)[:, None] < sizes
            inside[0] &= first
            logs = np.log10(scale)
            likely += float(logs[1:].sum() + logs[0][first].sum())
            codes_of.append(codes[inside])
            weights_of.append(held[inside])
        out[:, 1 : 1 + k] = self.move * steps_seen
        if codes_of:
            flat, weights = np.concatenate(codes_of), np.concatenate(weights_of)
            for s in range(k):
                out[s, 1 + k :] += np.bincount(flat, weights=weights[:, s], minlength=classes)
        return out, likely

    def stationary(self) -> np.ndarray:
        return np.linalg.matrix_power(self.move, 64)[0]

    def updated(self, counts: np.ndarray, share: np.ndarray | None = None) -> Hmm:
        k = len(self.start)
        return Hmm.of_counts(counts[:, 0], counts[:, 1 : 1 + k], counts[:, 1 + k :], share)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of whole texts, each step of all texts at once; longer texts go on when shorter ones have ended."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        codes = np.concatenate([texts[i] for i in order]).astype(np.int64) if order else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
        by_class, total = np.ascontiguousarray(self.emit.T), np.zeros(len(order))
        now = np.tile(self.start, (len(order), 1))
        live = len(order)
        for t in range(int(sizes[0]) if order else 0):
            while sizes[live - 1] <= t:
                live -= 1
            if t:
                now = now[:live] @ self.move
            now = now * by_class[codes[starts[:live] + t]]
            scale = now.sum(1)
            now /= scale[:, None]
            total[:live] += np.log10(scale)
        out = np.zeros(len(order))
        out[order] = total
        return out


def _sum_parts(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"state": [group["state"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "part": [np.sum(np.stack(group["part"].to_list()), axis=0)]})


def _round(segments: DataFrame, model: Hmm) -> tuple[np.ndarray, float]:
    """Expected counts and log10 likelihood of all segments: each partition's, added up chunk by chunk."""
    known = sent(segments.sparkSession, model)

    def step(batches):
        total, likely = None, 0.0
        for batch in batches:
            rows = [(f, np.frombuffer(c, np.uint32)) for f, c in zip(batch["first"].to_pylist(), batch["codes"].to_pylist())]
            for k in range(0, len(rows), 4096):
                part, more = known.value.expected(rows[k : k + 4096])
                total = part if total is None else total + part
                likely += more
        if total is not None:
            parts = [(s, c, total[s, c : c + _CHUNK]) for s in range(len(total)) for c in range(0, total.shape[1], _CHUNK)]
            parts.append((-1, 0, np.array([likely])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.list_(pa.float64()))], names=["state", "chunk", "part"]
            )

    few = segments.coalesce(4 * segments.sparkSession.sparkContext.defaultParallelism)
    kind, likely = "state int, chunk int, part array<double>", 0.0
    counts = np.zeros((len(model.start), 1 + len(model.start) + model.emit.shape[1]))
    for r in arrow_pass(few, step, kind).groupBy("state", "chunk").applyInPandas(_sum_parts, kind).collect():
        if r["state"] < 0:
            likely = r["part"][0]
        else:
            counts[r["state"], r["chunk"] : r["chunk"] + len(r["part"])] = r["part"]
    return counts, likely


def _segments(known):
    """Class codes of each text in pieces of SEGMENT tokens, each after the first with the token before it; first marks those that begin a text."""

    def step(batches):
        shapes: dict[bytes, int] = {}
        for batch in batches:
            first, codes = [], []
            for text in _raw(batch["text"]):
                whole = known.value.encode(tokens(text), shapes)
                for k in range(0, len(whole), SEGMENT):
                    first.append(k == 0)
                    codes.append(whole[max(0, k - 1) : k + SEGMENT].tobytes())
            for k in range(0, len(codes), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(first[k : k + 20_000]), pa.array(codes[k : k + 20_000], pa.binary())], names=["first", "codes"])

    return step


def train(docs: DataFrame, states: int = STATES, rounds: int = MOST_ROUNDS, seed: int = SEED) -> tuple[DataFrame, Vocabulary, Hmm]:
    """docs: text. The table of counts (word, n; the end at null), the vocabulary, and the model; all texts count.

    Rounds end when one gains less than ENOUGH of the log likelihood over the one before. Nothing to learn from gives a
    flat model.
    """
    counts = materialize(arrow_pass(docs.select("text"), _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    words = vocabulary(counts)
    segments = materialize(arrow_pass(docs.select("text"), _segments(sent(docs.sparkSession, words)), "first boolean, codes binary"), "segments")
    n = segments.count()
    if not n:
        return counts, words, Hmm.random(words.classes, states, seed)
    # the few that the first states come from, dealt by a hash of place and content, so that repeated texts are not dealt as one
    dealt = F.pmod(F.xxhash64("codes", F.monotonically_increasing_id()), F.lit(1_000_000))
    some = segments.where(dealt < math.ceil(min(1.0, WARM_SEGMENTS / n) * 1_000_000)).select("codes").collect()
    rows = [np.frombuffer(bytes(r["codes"]), np.uint32) for r in sorted(some)]
    model = Hmm.of_segments(rows, words.classes, words.share, states, seed=seed) if rows else Hmm.random(words.classes, states, seed)
    last = None
    for _ in range(rounds):
        found, likely = _round(segments, model)
        model = model.updated(found, words.share)
        if last is not None and likely - last < ENOUGH * abs(last):
            break
        last = likely
    return counts, words, model


def score_texts(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Hmm) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of docs (doc_id, text)."""
    known_model = sent(docs.sparkSession, (words, model))
    kind = "rid long, doc_id long, n_tokens long, n_known long, base double, path double, rare array<struct<word:binary,n:long>>"

    def step(batches):
        rid, shapes = row_base(), {}
        vocab, hmm = known_model.value
        known, log_end = vocab.counts.get, math.log10(vocab.texts + 1)
        for batch in batches:
            codes, cols = [], [[] for _ in range(4)]
            for text in _raw(batch["text"]):
                found = tokens(text)
                codes.append(vocab.encode(found, shapes))
                n_known, base, rare = int(vocab.texts > 0), log_end, []
                for w, n in Counter(found).items():
                    c = known(w)
                    if c is None:
                        rare.append({"word": w, "n": n})
                    else:
                        n_known += n
                        base += n * math.log10(c + 1)
                for col, v in zip(cols, (len(found) + 1, n_known, base, rare)):
                    col.append(v)
            path = hmm.log10(codes) + np.array([vocab.class_logs[c].sum() for c in codes])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rid, rid + n), pa.int64()), batch["doc_id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(path),
                 pa.array(cols[3], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["rid", "doc_id", "n_tokens", "n_known", "base", "path", "rare"],
            )
            rid += n

    rows = materialize(arrow_pass(docs, step, kind), "scored")
    rare = rows.select("rid", F.explode("rare").alias("rare")).select("rid", "rare.word", F.col("rare.n").alias("times"))
    found = rare.join(counts.where("word is not null"), "word")
    more = found.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
    whole = rows.drop("rare").join(more, "rid", "left")
    level = math.log10(words.total + words.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + more - F.col("n_tokens") * level).alias("base_score"), (F.col("path") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Learns from rows whose crc32(doc_id) mod 7 is not 2. A null or empty text is one end. base_score is the add-one
    unigram log10 probability, score that of the hidden Markov model. With nothing to learn from, unseen words and a
    flat model give finite scores. Repeated rows get equal scores; other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts, words, model = train(own.where(fold("doc_id", 7) != 2))
    found = score_texts(own, counts, words, model)
    return found.select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
