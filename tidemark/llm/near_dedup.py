"""Near duplicates by DartMinHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Each shingle owns a region, as wide as its weight, along an unbounded rank axis. Into each unit of rank a hashed, Poisson
number of darts falls, the same in every document; a dart has a rank and one of COORDINATES. A document looks at so many
ranks that about COORDINATES * (ln COORDINATES + 2) darts hit its shingles, however many those are, and keeps the
earliest in each coordinate: two documents agree in a coordinate with the probability of their weighted similarity.
Where a coordinate stays empty, the document looks further.

Signatures are joined on BANDS of coordinates. A bucket sends each member to its first only; links come from agreement,
checked on whole shingle sets unless the agreement leaves no doubt. Components of links are contracted, and a bucket
whose members still are in different components is compared pair by pair, in blocks, so no pair of a bucket is left out
and a bucket of near copies costs no more than its size. Pairs at 0.8 meet in no bucket with a probability of 5e-6.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, join_hot, kept_rows, materialize, numbered, row_base
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Agreement of signatures differs from similarity by 0.026 at most, one standard deviation: SURE and MAYBE are four from
#: 0.8. A pair just below 0.8 passes unseen at 0.9 with 2e-5, one at 0.75 with 2e-9; a pair at 0.8 agrees in less than 0.69
#: with 3e-5. Sets are compared as 32-bit hashes: of two sets of n shingles n * n / 2**32 agree by chance, 0.1 at 20,000.
SURE, MAYBE = 0.9, 0.69
BLOCK = 256
_CHUNK_BYTES, _CHUNK_DOCS = 1 << 20, 200
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the polynomial hash's base and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


def _words(joined: bytes, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and a hash of each, read in stretches that end between words: a long text takes memory by its words."""
    where, made, at = [], [], 0
    while at < len(joined):
        end = min(len(joined), at + _CHUNK_BYTES)
        while end < len(joined) and not _SPACE[joined[end]]:
            end = min(len(joined), end + 4096) if not _SPACE[np.frombuffer(joined, np.uint8, min(4096, len(joined) - end), end)].any() else end + int(np.argmax(_SPACE[np.frombuffer(joined, np.uint8, min(4096, len(joined) - end), end)]))
        raw = np.frombuffer(joined, np.uint8, end - at, at)
        space = np.concatenate([[True], _SPACE[raw], [True]])
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        up, down = powers.upto(len(raw) + 1)
        total = np.concatenate([[_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], dtype=np.uint64)])
        where.append(starts + at)
        made.append(mix((total[ends] - total[starts]) * down[starts]))
        at = end
    return (np.concatenate(where), np.concatenate(made)) if where else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingles(texts: list[bytes], powers: _Powers, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash, count of the distinct shingles, by doc and then hash. A text of fewer words is one shingle, of none none."""
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    starts, words = _words(b" ".join(texts), powers)
    doc = np.searchsorted(ends_of, starts, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    n = np.diff(np.append(first, len(doc)))
    made = np.zeros(len(words), np.uint64)
    at = np.arange(len(words))
    inside = at - first[doc] + size <= n[doc]
    short = (n[doc] < size) & (at == first[doc])
    for j in range(size):
        k = np.minimum(at + j, max(0, len(words) - 1))
        there = (at + j < len(words)) & (doc[k] == doc) if len(words) else inside
        made += np.where(there, words[k] * mix(np.full(1, j + 1, np.uint64)) if len(words) else 0, 0).astype(np.uint64)
    use = inside | short
    doc, made = doc[use], mix(made[use])
    order = np.lexsort((made, doc))
    doc, made = doc[order], made[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (made[1:] != made[:-1])
    begin = np.flatnonzero(new)
    return doc[new], made[new], np.diff(np.append(begin, len(doc)))


_POISSON = np.floor(np.cumsum([math.exp(-1) / math.factorial(n) for n in range(13)]) * 2.0**32).astype(np.uint64)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """docs x k signature of weighted sets; rows without elements are all 2**64 - 1. Weights of a document sum to 0.01 or more."""
    layers = np.ceil(weight).astype(np.int64)
    each = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(each)) - np.repeat(np.cumsum(layers) - layers, layers)
    doc, share = doc[each], np.minimum(weight[each] - layer, 1.0)
    seed = mix(element[each].astype(np.uint64) + mix(layer.astype(np.uint64) + _U(1)))
    out = np.full(docs * k, _EMPTY)
    total = np.bincount(doc, weights=share, minlength=docs)
    has = total > 0
    if has.any() and total[has].min() < 0.01:
        raise ValueError("the weights of a document sum to less than 0.01")
    begin, end = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    end[has] = np.ceil(k * (math.log(k) + 2) / total[has]).astype(np.int64)
    while True:
        cells = (end - begin)[doc]
        pair = np.repeat(np.arange(len(doc)), cells)
        cell = np.arange(len(pair)) - np.repeat(np.cumsum(cells) - cells, cells) + begin[doc][pair]
        thrown = mix(seed[pair] + (cell.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
        darts = np.searchsorted(_POISSON, thrown >> _U(32), side="right")
        which = np.repeat(np.arange(len(pair)), darts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        one = mix(thrown[which] + (nth.astype(np.uint64) + _U(1)) * _BASE)
        two = mix(one + _U(1))
        pair = pair[which]
        if (share < 1).any():  # a dart beyond the weight misses
            hits = (two >> _U(40)).astype(np.float64) / 2.0**24 < share[pair]
            which, one, two, pair = which[hits], one[hits], two[hits], pair[hits]
        packed = (cell[which].astype(np.uint64) << _U(44)) | ((one >> _U(20)) & _U(0xFFFFFFFFFFF))
        np.minimum.at(out, doc[pair] * k + (two % _U(k)).astype(np.int64), packed)
        wait = (out.reshape(docs, k) == _EMPTY).any(1) & has
        if not wait.any():
            return out.reshape(docs, k)
        begin, end = np.where(wait, end, 0), np.where(wait, 2 * end, 0)


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band; it tells bands apart."""
    parts = mix(signature).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64)), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * _BASE + parts[:, :, r])
    return key.view(np.int64)


_TABLE = "rid long, doc_id long, text_id binary, bands array<long>, signature binary, shingles binary"


def _signatures(weighted: bool, given: bool):
    def step(batches):
        rid, powers = row_base(), _Powers()

        def signed(texts: list[bytes], ids: pa.Array, rows: pa.Array):
            doc, hashed, count = shingles(texts, powers)
            sig = dart_minhash(doc, hashed, count.astype(np.float64) if weighted else np.ones(len(doc)), len(texts))
            some = np.bincount(doc, minlength=len(texts)) > 0
            keys, short = bands(sig), mix(sig).astype(np.uint16)
            small = (hashed >> _U(32)).astype(np.uint32)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            return pa.RecordBatch.from_arrays(
                [
                    rows, ids, pa.array([hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts], pa.binary()),
                    pa.array([k if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary()),
                    pa.array([np.unique(small[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["rid", "doc_id", "text_id", "bands", "signature", "shingles"],
            )

        for batch in batches:
            texts = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < _CHUNK_DOCS and (end == at or size + len(texts[end]) <= _CHUNK_BYTES):
                    size += len(texts[end])
                    end += 1
                rows = batch["row"].slice(at, end - at) if given else pa.array(np.arange(rid, rid + end - at))
                yield signed(texts[at:end], batch["doc_id"].slice(at, end - at), rows)
                rid += end - at
                at = end

    return step


def _agreement(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        rate = (a == b).mean(1)
        keep = pa.array(rate >= MAYBE)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep), pa.array(rate[rate >= MAYBE])], names=["a", "b", "rate"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Of sets of distinct shingles, by the exact quotient."""
    both = len(np.intersect1d(x, y))
    return both >= SIMILAR * (len(x) + len(y) - both) - 1e-9


def _exact(batches):
    for batch in batches:
        keep = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist())]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def _with(pairs: DataFrame, table: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    for end, name in zip(("a", "b"), names):
        own = table.select(F.col("rid").alias("_rid"), F.col(column).alias(name))
        pairs = pairs.join(own, pairs[end] == own["_rid"]).drop("_rid")
    return pairs


def _links(rated: DataFrame, table: DataFrame, weighted: bool) -> DataFrame:
    """Of rated pairs those that are similar. Weighted similarity has no second look."""
    if weighted:
        return rated.where(F.col("rate") >= SIMILAR).select("a", "b")
    doubtful = _with(rated.where(F.col("rate") < SURE).select("a", "b"), table, "shingles", ("set_a", "set_b"))
    return rated.where(F.col("rate") >= SURE).select("a", "b").unionByName(arrow_pass(doubtful, _exact, "a long, b long"))


def _between(weighted: bool):
    """Links from a block of texts that ask to a block of texts, in other components; a pair counts in the first band it shares."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        band = int(group["band"].iloc[0])
        sig = np.frombuffer(b"".join(group["signature"]), np.uint16).reshape(-1, COORDINATES)
        keys = np.stack(group["bands"].to_list())
        asks, outside, comp, rid = (group[c].to_numpy() for c in ("asks", "outside", "component", "rid"))
        sets = {}

        def whole(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(group["shingles"].iloc[i], np.uint32)
            return sets[i]

        asked, out = np.flatnonzero(~asks), []
        for x in np.flatnonzero(asks):
            other = asked[(comp[asked] != comp[x]) & (~outside[asked] | (rid[asked] > rid[x]))]
            rate = (sig[other] == sig[x]).mean(1)
            other, rate = other[rate >= MAYBE], rate[rate >= MAYBE]
            first = (keys[other] == keys[x]).argmax(1) == band
            for y, r in zip(other[first], rate[first]):
                if r >= SIMILAR if weighted else r >= SURE or similar(whole(x), whole(y)):
                    out.append((min(rid[x], rid[y]), max(rid[x], rid[y])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def _decided(docs: DataFrame, doc_id: str, text: str, weighted: bool = False, row: str | None = None) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(row).alias("row")] if row else []))
    table = materialize(arrow_pass(own, _signatures(weighted, row is not None), _TABLE), "signatures")
    texts = materialize(table.groupBy("text_id").agg(F.min_by("bands", "rid").alias("bands"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("rows")), "texts")
    keyed = texts.select("rid", F.posexplode("bands").alias("band", "key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, "key"), "shared")
    # a bucket's first is the text that meets most others, in all its buckets: of near copies of one text that text itself
    central = shared.groupBy("rid").agg(F.sum("n").alias("meets"))
    heads = shared.join(central, "rid").groupBy("key").agg(F.max(F.struct("meets", (-F.col("rid")).alias("rid"))).alias("best"))
    starred = materialize(shared.join(heads.select("key", (-F.col("best.rid")).alias("head")), "key"), "stars")
    pairs = starred.where("rid <> head").select(F.least("head", "rid").alias("a"), F.greatest("head", "rid").alias("b")).distinct()
    rated = materialize(arrow_pass(_with(pairs, table, "signature", ("sig_a", "sig_b")), _agreement, "a long, b long, rate double"), "rated")
    links = materialize(_links(rated, table, weighted), "links")
    found = components(links)

    # buckets in which others than the first are still apart
    others = starred.where("n > 2 and rid <> head").select("key", "band", "rid")
    others = materialize(others.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("key", "band", "rid", F.coalesce("component", "rid").alias("component")), "others")
    each = others.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "component"))
    apart = each.groupBy("key").agg(F.sum("n").alias("n"), most.alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    apart = apart.select("key", F.col("main.component").alias("main"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("main.n")).alias("few"))
    member = others.join(apart, "key").withColumn("outside", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["key", "band", "rid", "component", "outside"]
    left = member.where("outside").select(*names, block("few").alias("i"), upto("all").alias("j"), F.lit(True).alias("asks"))
    right = member.select(*names, upto("few").alias("i"), block("all").alias("j"), F.lit(False).alias("asks"))
    dealt = left.unionByName(right).join(table.select("rid", "signature", "shingles", "bands"), "rid")
    late = materialize(dealt.groupBy("key", "i", "j").applyInPandas(_between(weighted), "a long, b long").distinct(), "links")
    if late.limit(1).count():
        found = components(links.unionByName(late))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    member = join_hot(table.select("rid", "doc_id", "text_id"), texts.select("text_id", F.col("rid").alias("node"), "rows"), ["text_id"], "rows").drop("text_id")
    member = materialize(member.join(found, "node", "left").select("rid", "doc_id", F.coalesce("component", "node").alias("component")), "classes")
    classes = materialize(member.groupBy("component").agg(first, F.count(F.lit(1)).alias("rows")), "firsts")
    return join_hot(member, classes, ["component"], "rows").select("rid", "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """doc_id, class_id, kept: one row per row of docs; class_id is the least doc_id of the class, kept marks its one row that stays.

    Words are what white space separates, as they are. Texts with the same words are copies; texts without words, null
    ones too, are copies of each other. A text of fewer than five words is one shingle. Null ids come last, and of rows
    that are repeated whole one stays. weighted: shingles count as often as they occur, and similarity is judged by
    signatures alone. An empty table gives an empty result; other columns are not read.
    """
    return _decided(docs, doc_id, text, weighted).drop("rid")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns: one row of each class, whatever ids rows have."""
    own, row = numbered(docs, "documents")
    return kept_rows(own, row, _decided(own, doc_id, text, row=row).where("kept").select(F.col("rid").alias("row")))
