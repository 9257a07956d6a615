"""Language identification: known words by their log frequency in each language, unseen words by shorter and shorter n-grams.

Words are counted over all training rows, and n-grams over the counted words. A word that no training row has is unseen,
and is read from left to right by the longest n-gram known at each place, down to single characters. The model holds the
most frequent WORDS words and GRAMS n-grams, a size that does not grow with the corpus; all others meet their counts in
joins, and results don't depend on what is held: logs are whole numbers of 1 / SCALE, so their sums have no order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, arrow_pass, fold, frequent, materialize, row_base, sent

WORDS = 100_000
GRAMS = 60_000
LONGEST = 5
SMOOTH = 0.1
SCALE = 1 << 24
_HELD = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; empty where no character is a letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _flushed(held: dict[str, Counter], name: str):
    for lang, counts in held.items():
        keys, values = list(counts), list(counts.values())
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(values[k : k + 50_000], pa.int64())], names=["lang", name, "n"])


def _count_words(batches):
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            held[lang].update(words_of(text))
            if sum(map(len, held.values())) > _HELD:
                yield from _flushed(held, "word")
                held.clear()
    yield from _flushed(held, "word")


def _count_grams(batches):
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word, n in zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), batch["n"].to_pylist()):
            own = held[lang]
            for size in range(1, LONGEST + 1):
                for i in range(len(word) - size + 1):
                    own[word[i : i + size]] += n
            if sum(map(len, held.values())) > _HELD:
                yield from _flushed(held, "gram")
                held.clear()
    yield from _flushed(held, "gram")


def _most(counts: DataFrame, key: str, most: int) -> list:
    """lang, key, n of the most frequent keys: at most most times the number of languages."""
    top = frequent(counts.groupBy(key).agg(F.sum("n").alias("n")), most, key).select(key)
    return counts.join(top, key).collect()


def _fixed(logs: np.ndarray) -> np.ndarray:
    return np.rint(logs * SCALE).astype(np.int64)


class Model:
    """What all words and n-grams add up to, and the rows of those that are held: log frequencies by language, in 1 / SCALE."""

    def __init__(self, langs: list[str], words: list, grams: list, totals: dict[str, int], distinct: int | None = None, by_size: dict[int, list[int]] | None = None, pieces: int | None = None):
        self.langs, self.at = langs, {lang: i for i, lang in enumerate(langs)}
        held_words = self._held([(r["word"], r["lang"], r["n"]) for r in words])
        held_grams = self._held([(r["gram"], r["lang"], r["n"]) for r in grams])
        if by_size is None:
            by_size = {size: sum(v for g, v in held_grams.items() if len(g) == size) for size in {len(g) for g in held_grams}}
        nothing = np.zeros(len(langs))
        self.word_total = np.array([totals[x] for x in langs], np.float64) + SMOOTH * max(1, len(held_words) if distinct is None else distinct)
        some = SMOOTH * max(1, len(held_grams) if pieces is None else pieces)
        self.gram_totals = [np.asarray(by_size.get(size, nothing), np.float64) + some for size in range(LONGEST + 1)]
        self.words, self.word_logs = self._table(held_words, self.word_row)
        self.grams, self.gram_logs = self._table(held_grams, self.gram_row)

    def _held(self, rows) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for key, lang, n in rows:
            if key not in out:
                out[key] = np.zeros(len(self.langs))
            out[key][self.at[lang]] += n
        return out

    def counts(self, found: pa.ListArray) -> np.ndarray:
        """A row for each list of (lang, n), a column for each language."""
        flat, out = found.flatten(), np.zeros((len(found), len(self.langs)))
        lang = pc.index_in(flat.field("lang"), value_set=pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False)
        np.add.at(out, (pc.list_parent_indices(found).to_numpy(zero_copy_only=False), lang), flat.field("n").to_numpy(zero_copy_only=False))
        return out

    def _table(self, held, row):
        index = {key: k for k, key in enumerate(sorted(held))}
        return index, np.stack([row(key, held[key]) for key in index]) if index else np.zeros((0, len(self.langs)), np.int64)

    def word_row(self, word: str, counts: np.ndarray) -> np.ndarray:
        return _fixed(np.log((counts + SMOOTH) / self.word_total))

    def gram_row(self, gram: str, counts: np.ndarray) -> np.ndarray:
        return _fixed(np.log((counts + SMOOTH) / self.gram_totals[len(gram)]))

    def not_held(self, word: str) -> list[str]:
        """The word's n-grams that are not held, each once."""
        return [g for g in {word[i : i + size] for size in range(1, LONGEST + 1) for i in range(len(word) - size + 1)} if g not in self.grams]

    def unseen(self, word: str, more: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """The sum over its pieces, held or in more; characters that no training word has count alike for all languages."""
        out, i, get, more = np.zeros(len(self.langs), np.int64), 0, self.grams.get, more or {}
        while i < len(word):
            for size in range(min(LONGEST, len(word) - i), 0, -1):
                piece = word[i : i + size]
                row = self.gram_logs[k] if (k := get(piece)) is not None else more.get(piece)
                if row is not None:
                    out = out + row
                    i += size
                    break
            else:
                i += 1
        return out

    def held(self, words: list[str]) -> tuple[np.ndarray, list[dict]]:
        """The sum over the words that are held, and the others with how often they occur."""
        counts, get = Counter(words), self.words.get
        at = np.fromiter((get(w, -1) for w in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        known = at >= 0
        total = n[known] @ self.word_logs[at[known]] if known.any() else np.zeros(len(self.langs), np.int64)
        return total, [{"word": w, "n": c} for (w, c), k in zip(counts.items(), known) if not k]

    def decide(self, total: np.ndarray, n_words: int) -> tuple[str, float]:
        if not n_words or not self.langs:
            return "und", 0.0
        # evidence counts with the root of its words, so that long texts don't all score 1
        p = np.exp((total - total.max()) / SCALE / np.sqrt(n_words))
        return self.langs[int(total.argmax())], float(p.max() / p.sum())


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> tuple[Model, DataFrame, DataFrame]:
    """docs: text, lang, both of training rows only. The model, and the tables of all words' and all n-grams' counts; every row counts."""
    counted = arrow_pass(docs.where("lang is not null and text is not null").select("lang", "text"), _count_words, "lang string, word string, n long")
    counts = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    pieces = arrow_pass(counts, _count_grams, "lang string, gram string, n long")
    pieces = materialize(pieces.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(totals)
    by_size: dict[int, list[int]] = {}
    for r in pieces.groupBy(F.length("gram").alias("size"), "lang").agg(F.sum("n").alias("n")).collect():
        by_size.setdefault(r["size"], [0] * len(langs))[langs.index(r["lang"])] = r["n"]
    different = lambda df, key: df.select(key).distinct().count()
    return Model(langs, _most(counts, "word", words), _most(pieces, "gram", grams), totals, different(counts, "word"), by_size, different(pieces, "gram")), counts, pieces


def _vectors(asked: DataFrame, known: Sent, counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """word, logs of each word in asked (word, each once), none of them held: by its counts, or unseen in training, by its n-grams."""

    def looked_up(batches):
        model = known.value
        for batch in batches:
            found = batch["found"]
            seen = pc.list_value_length(found).to_numpy(zero_copy_only=False) > 0
            rows = model.word_row("", model.counts(found))
            logs = [row if known else None for row, known in zip(rows, seen)]
            grams = [[] if known else model.not_held(word) for word, known in zip(batch["word"].to_pylist(), seen)]
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(logs, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.string()))], names=["word", "logs", "grams"])

    def spelt(batches):
        model = known.value
        for batch in batches:
            logs = []
            for word, found in zip(batch["word"].to_pylist(), batch["found"].to_pylist()):
                more = model._held([(f["gram"], f["lang"], f["n"]) for f in found])
                logs.append(model.unseen(word, {g: model.gram_row(g, v) for g, v in more.items()}))
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(logs, pa.list_(pa.int64()))], names=["word", "logs"])

    there = lambda *names: F.collect_list(F.when(F.col("n").isNotNull(), F.struct(*names))).alias("found")
    words = asked.join(counts, "word", "left").groupBy("word").agg(there("lang", "n"))
    words = materialize(arrow_pass(words, looked_up, "word string, logs array<long>, grams array<string>"), "looked")
    grams = words.where("logs is null").select("word", F.explode_outer("grams").alias("gram"))
    grams = grams.join(pieces, "gram", "left").groupBy("word").agg(there("gram", "lang", "n"))
    return words.where("logs is not null").select("word", "logs").unionByName(arrow_pass(grams, spelt, "word string, logs array<long>"))


def identify(docs: DataFrame, model: Model, counts: DataFrame, pieces: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; `und` and 0 where the text is null, empty or has no letter, or nothing was learned."""
    known = sent(docs.sparkSession, model)

    def step(batches):
        rid = row_base()
        own = known.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):  # few texts' words at once
                batch = whole.slice(k, 500)
                n, sizes, totals, rest = batch.num_rows, [], [], []
                for text in batch["text"].to_pylist():
                    words = words_of(text) if own.langs else []
                    total, more = own.held(words)
                    sizes.append(len(words))
                    totals.append(total)
                    rest.append(more)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(rid, rid + n), pa.int64()), batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(totals, pa.list_(pa.int64())),
                     pa.array(rest, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))],
                    names=["rid", "doc_id", "n_words", "total", "rest"],
                )
                rid += n

    def decided(batches):
        model = known.value
        for batch in batches:
            found = []
            for n, total, more in zip(batch["n_words"].to_pylist(), batch["total"].to_pylist(), batch["more"].to_pylist()):
                found.append(model.decide(np.array(total, np.int64) + (np.array(more, np.int64) if more else 0), n))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(arrow_pass(own, step, "rid long, doc_id long, n_words long, total array<long>, rest array<struct<word:string,n:long>>"), "rows")
    rest = rows.select("rid", F.explode("rest").alias("rest")).select("rid", "rest.word", F.col("rest.n").alias("times"))
    vectors = materialize(_vectors(rest.select("word").distinct(), known, counts, pieces), "vectors")
    sums = F.array(*[F.sum(F.col("times") * F.get("logs", F.lit(i))) for i in range(len(model.langs))]).cast("array<long>")
    whole = rows.drop("rest").join(rest.join(vectors, "word").groupBy("rid").agg(sums.alias("more")), "rid", "left")
    return arrow_pass(whole.select("doc_id", "n_words", "total", "more"), decided, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs.

    Learns from the text and lang of rows whose crc32(doc_id) mod 4 is not 2 and whose lang is not null. Ties go to the
    language first by code point. Repeated rows get equal results; other columns are not read.
    """
    seen = docs.where(fold(doc_id, 4) != 2).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = identify(docs, *train(seen), doc_id, text)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
