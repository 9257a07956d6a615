"""Chat formatting as a prefix tree: conversations that begin alike share their first turns.

A node is a turn after certain turns; its identity is a digest of all of them, so nodes are found without building any
tree in one place. Conversations are put in the order of their paths, a node belongs to the first of them that has it,
and nodes in the order of (conversation, depth) are the depth-first walk. Each is emitted once, with where it starts in
that walk, the position its characters have in a conversation, and the stretches of the walk that hold its ancestors,
to which it may attend. Conversations are streamed through sorted partitions, never held; shared turns are merged
before they are shuffled.

Template: "<turn:ROLE>\\n", text, "\\n</turn>\\n". In roles and texts a backslash goes before \\, < and >, so no text can
open or close a turn.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_pass, hot_from, join_hot, materialize, partitions

TRAINED = "assistant"
_CONTROL = re.compile(r"([\\<>])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text is in it."""
    head, body = f"<turn:{escape(role)}>\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    found = _SEGMENT.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


_TURNS = "conv_id long, depth int, node binary, parent binary, position long, segment string, loss_from int, loss_to int, path binary"


def _chain(batches):
    """Turns of conversations that come sorted; the last of each has its path, all its nodes."""
    names = [x.split()[0] for x in _TURNS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    conv, node, depth, position, path, begun = None, None, 0, 0, bytearray(), False
    out: list[list] = []

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for own, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
            if not begun or own != conv:
                if out:
                    out[-1][-1] = bytes(path)
                conv, node, depth, position, path, begun = own, None, 0, 0, bytearray(), True
            if len(out) > 2000:
                yield sent(out[:-1])
                out = out[-1:]
            formatted, a, b = segment(role, text)
            parent, node = node, hashlib.blake2b((node or b"") + formatted.encode(), digest_size=16).digest()
            path += node
            trained = role == TRAINED
            out.append([own, depth, node, parent, position, formatted, a if trained else 0, b if trained else 0, None])
            depth, position = depth + 1, position + len(formatted)
    if out:
        out[-1][-1] = bytes(path)
        yield sent(out)


def _ancestors(batches):
    """rank, node: the merged stretches of the walk that hold the turns before; for a node's own conversation only."""
    rank, held = None, []
    for batch in batches:
        nodes, found = [], []
        for own, node, start, end, mine in zip(*(batch[c].to_pylist() for c in ("rank", "node", "start", "end", "mine"))):
            if own != rank:
                rank, held = own, []
            if mine:
                nodes.append(node)
                found.append([{"start": a, "end": b} for a, b in held])
            if held and held[-1][1] == start:
                held[-1] = (held[-1][0], end)
            else:
                held.append((start, end))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["node", "ancestors"])


def prefix_tree(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """nodes: node, parent, depth, start, end, position, segment, loss_from, loss_to, ancestors; turns: conv_id, depth, node.

    start and end are places in the walk, in code points; position is that of the node's first character within any of
    its conversations; loss_from and loss_to mark what of the segment is trained on, nothing but assistants' texts.
    Null texts and roles are empty; a null conv_id is a conversation of its own; turns that tie go by role, then text;
    repeated rows are repeated turns. An empty table gives empty results. Other columns are not read.
    """
    spark = conversations.sparkSession
    clean = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = clean.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = materialize(arrow_pass(dealt.select("conv_id", "role", "text"), _chain, _TURNS), "turns")
    paths = turns.where("path is not null").groupBy("path").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"))
    ranked = paths.repartitionByRange(partitions(spark), "path").sortWithinPartitions("path").select(F.col("first.conv_id").alias("first_id"), F.monotonically_increasing_id().alias("rank"))
    ranked = materialize(ranked, "paths")
    walked = turns.drop("path").join(ranked, F.col("conv_id").eqNullSafe(F.col("first_id"))).drop("conv_id", "first_id")
    own = F.struct("rank", "depth", "parent", "position", "segment", "loss_from", "loss_to")
    walked = materialize(walked, "walked")
    nodes = walked.groupBy("node").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("paths")).select("node", "own.*", "paths")
    nodes = nodes.repartitionByRange(partitions(spark), "rank", "depth").withColumn("part", F.spark_partition_id()).withColumn("size", F.length("segment").cast("long"))
    nodes = materialize(nodes, "nodes")
    done, before = 0, []
    for part, size in sorted((r["part"], r["size"]) for r in nodes.groupBy("part").agg(F.sum("size").alias("size")).collect()):
        before.append((part, done))
        done += size
    offsets = spark.createDataFrame(before, "part int, before long")
    inside = Window.partitionBy("part").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = nodes.join(offsets, "part").withColumn("end", F.col("before") + F.sum("size").over(inside)).withColumn("start", F.col("end") - F.col("size"))
    placed = materialize(placed.drop("part", "before", "size"), "placed")
    steps = join_hot(walked.select("rank", "depth", "node"), placed.select("node", "start", "end", F.col("rank").alias("owner"), "paths"), ["node"], "paths")
    steps = steps.select("rank", "depth", "node", "start", "end", (F.col("owner") == F.col("rank")).alias("mine"))
    steps = steps.repartition(partitions(spark), "rank").sortWithinPartitions("rank", "depth").drop("depth")
    above = arrow_pass(steps, _ancestors, "node binary, ancestors array<struct<start:long,end:long>>")
    whole = placed.join(above, "node").select("node", "parent", "depth", "start", "end", "position", "segment", "loss_from", "loss_to", "ancestors")
    return materialize(whole, "tree"), turns.select("conv_id", "depth", "node")


def walk(nodes: DataFrame) -> DataFrame:
    """The training stream: all nodes in depth-first order."""
    return nodes.repartitionByRange(partitions(nodes.sparkSession), "start").sortWithinPartitions("start")


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    conv, begun, rows = None, False, []
    n = trained = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    sent = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        for own, formatted, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to"))):
            if not begun or own != conv:
                if begun:
                    rows.append((conv, n, turns.hexdigest(), trained, loss.hexdigest(), chars))
                    if len(rows) > 5000:
                        yield sent()
                        rows.clear()
                conv, begun, n, trained, chars, turns, loss = own, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            under = unescape(formatted[a:b])
            loss.update(under.encode())
            n, trained, chars = n + 1, trained + len(under), chars + len(formatted)
    if begun:
        rows.append((conv, n, turns.hexdigest(), trained, loss.hexdigest(), chars))
    if rows:
        yield sent()


def read_back(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation, from the tree: what its segments hold and what of them is trained on."""
    rows = turns.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    hot = rows.where(F.col("rows") > hot_from(turns.count()))
    known = nodes.select("node", "segment", "loss_from", "loss_to").join(F.broadcast(hot), "node", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    found = join_hot(turns, known, ["node"], "rows", turns.count())
    dealt = found.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "depth")
    return arrow_pass(dealt.select("conv_id", "segment", "loss_from", "loss_to"), _read_back, _READ)


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(17 + length(regexp_replace(role, '[\\<>]', 'xx', 'g')) + length(regexp_replace(text, '[\\<>]', 'xx', 'g')))::bigint as formatted_chars
from c group by conv_id
"""
