"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of a fixed number of bytes. The distinct blocks are dealt by content,
sorted, and named by their integer place in that order; then adjacent pairs of names are themselves sorted and named,
level by level, until each document has one name. Two documents have the same (number of blocks, name) if and only if
their texts are the same: names stand for contents, never for hashes.

Text is shuffled once, and only the blocks that are distinct within a task. Occurrences find the name of their block by
a 16-byte digest. Should two different blocks ever share a digest, the names are looked up by content instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, hot_from, join_hot, kept_rows, materialize, numbered, partitions, row_base

BLOCK_BYTES = 512
_GONE = b" \t\n\x0b\x0c\r"
#: A task forgets which blocks it has sent once they take this many bytes; that only costs traffic.
_SEEN_BYTES = 48 << 20
_ROWS = "rid long, doc_id long, n_chars long, text_sha256 string, blocks array<binary>"


def digest16(block: bytes) -> bytes:
    return hashlib.blake2b(block, digest_size=16).digest()


def _squeezed(column: pa.Array) -> list[bytes]:
    return [(x or b"").translate(None, _GONE) for x in column.cast(pa.binary()).to_pylist()]


def _cut(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _rows(digest: Callable[[bytes], bytes], size: int, by_content: bool, given: bool):
    """One row per document with the digest of each block, or its content where digests don't tell blocks apart."""

    def step(batches):
        rid = row_base()
        for batch in batches:
            sha, blocks, texts = [], [], _squeezed(batch["text"])
            for text in texts:
                sha.append(hashlib.sha256(text).hexdigest())
                blocks.append([b if by_content else digest(b) for b in _cut(text, size)])
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch["row"] if given else pa.array(range(rid, rid + n), pa.int64()), batch["doc_id"], batch["n_chars"], pa.array(sha, pa.string()), pa.array(blocks, pa.list_(pa.binary()))],
                names=["rid", "doc_id", "n_chars", "text_sha256", "blocks"],
            )
            rid += n

    return step


def _contents(digest: Callable[[bytes], bytes], size: int):
    """The blocks of a task's documents, each once as far as the task remembers."""

    def step(batches):
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            out: list[bytes] = []
            for text in _squeezed(batch["text"]):
                for block in _cut(text, size):
                    if block not in seen:
                        seen.add(block)
                        held += len(block) + 64
                        out.append(block)
                if held > _SEEN_BYTES:
                    seen.clear()
                    held = 0
            for k in range(0, len(out), 20_000):
                part = out[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([digest(b) for b in part], pa.binary()), pa.array(part, pa.binary())], names=["digest", "block"])

    return step


def _named(distinct: DataFrame, keys: list[str], keep: list[str], name: str, tag: str) -> DataFrame:
    """Integer names of rows that are one of a key and dealt by it: sorted within each part; a name is the part's number and the place in it."""
    return materialize(distinct.sortWithinPartitions(*keys).select(*keep, F.monotonically_increasing_id().alias(name)), tag)


def _named_blocks(contents: DataFrame, tag: str) -> DataFrame:
    """digest, name of each different block; texts are dealt once, and not sorted before."""
    dealt = contents.repartition(partitions(contents.sparkSession), "block").dropDuplicates(["block"])
    return _named(dealt, ["block"], ["digest"], "name", tag)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[bytes], bytes] = digest16, row: str | None = None) -> DataFrame:
    """rid, doc_id, n_chars, text_sha256, n_blocks, identity: texts are equal where (n_blocks, identity) is.

    A null text is an empty one, and an empty text has one empty block. rid numbers the rows of docs, so repeated rows
    and repeated or null ids stay apart; row is a column that does so already.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), *([F.col(row).alias("row")] if row else []))
    names = _named_blocks(arrow_pass(source.select("text"), _contents(digest, block_bytes), "digest binary, block binary"), "blocks")
    shared = names.groupBy("digest").count().where("count > 1").limit(1).count() > 0
    if shared:
        content = arrow_pass(source.select("text"), _contents(lambda b: b, block_bytes), "digest binary, block binary")
        names = _named_blocks(content, "blocks")
    rows = materialize(arrow_pass(source, _rows(digest, block_bytes, shared, row is not None), _ROWS), "rows")
    found = rows.select("rid", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("place", "digest"))
    size = rows.agg(F.max(F.size("blocks")).alias("most"), F.sum(F.size("blocks")).alias("all")).first()
    most, total = size["most"] or 1, size["all"] or 0
    often = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from(total))
    names = names.join(F.broadcast(often), "digest", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    done = None
    level = join_hot(found, names, ["digest"], "n", total).select("rid", F.col("place").cast("long").alias("place"), "name", "n_blocks")
    level = materialize(level, "level0")
    while most > 1:
        whole = level.where("n_blocks <= 1").select("rid", "name")
        done = whole if done is None else done.unionByName(whole)
        pairs = level.where("n_blocks > 1").groupBy("rid", F.expr("place div 2").alias("place")).agg(
            F.max(F.expr("if(place % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(place % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
            F.first(F.expr("(n_blocks + 1) div 2")).cast("int").alias("n_blocks"),
        )
        pairs = materialize(pairs, "pairs")
        names = _named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], ["a", "b", "n"], "name", "names")
        level = materialize(join_hot(pairs, names, ["a", "b"], "n").select("rid", "place", "name", "n_blocks"), "level")
        most = (most + 1) // 2
    whole = level.select("rid", "name")
    done = whole if done is None else done.unionByName(whole)
    head = rows.select("rid", "doc_id", "n_chars", "text_sha256", F.size("blocks").alias("n_blocks"))
    return head.join(done.withColumnRenamed("name", "identity"), "rid")


def _decided(docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES, digest: Callable[[bytes], bytes] = digest16, row: str | None = None) -> DataFrame:
    named = materialize(identities(docs, doc_id, text, block_bytes, digest, row), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = named.groupBy("n_blocks", "identity").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.withColumn("n", F.col("group_size")), "groups")
    return join_hot(named, groups, ["n_blocks", "identity"], "n").select(
        "rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[bytes], bytes] = digest16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when the same after deleting white space; null counts as empty. Of equal texts the row with the
    most code points stays, then the smallest doc_id, null last, then any one of rows that are repeated whole.
    An empty table gives an empty result; other columns of docs are not read.
    """
    return _decided(docs, doc_id, text, block_bytes, digest).drop("rid")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns: one row of equal texts, whatever ids rows have."""
    own, row = numbered(docs, "documents")
    return kept_rows(own, row, _decided(own, doc_id, text, row=row).where("kept").select(F.col("rid").alias("row")))


SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as squeezed from documents
)
select doc_id,
  first_value(doc_id) over (partition by squeezed order by length(raw) desc, doc_id) as keep_id,
  count(*) over (partition by squeezed) as group_size,
  doc_id = first_value(doc_id) over (partition by squeezed order by length(raw) desc, doc_id) as kept,
  sha256(squeezed) as text_sha256
from t
"""
