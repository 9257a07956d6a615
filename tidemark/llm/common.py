"""What the operators share: the shared folder, tables that cut lineage, row identities, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: The white space of all word rules here: space, tab, LF, VT, FF, CR.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


class Sent:
    """A broadcast of something made of this package's classes; they travel with it, so workers need no copy of the package."""

    def __init__(self, broadcast):
        self._broadcast = broadcast

    @property
    def value(self):
        held = self._broadcast
        if "opened" not in held.__dict__:  # a worker keeps its broadcasts, and what was made of them, from task to task
            held.opened = cloudpickle.loads(held.value)
            if TaskContext.get():  # a worker needs the bytes no more
                held.__dict__.pop("_value", None)
        return held.opened


def sent(spark: SparkSession, value) -> Sent:
    return Sent(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


#: Tables that this process has written, in order.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and losing executors costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables written so far; what comes on top while an operator is called is what its result reads."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no result still to be worked out reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as -1, so it is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(-1))


def arrow_pass(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(step, schema)


def row_base() -> int:
    """First row identity of the running task. Identities are stable only once written, so they never outlive one pass unwritten."""
    return TaskContext.get().partitionId() << 40


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table with an identity of each row, so that decisions come back to rows and not to their ids; and that column's name."""
    row = fresh(df, "_row")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row


def kept_rows(own: DataFrame, row: str, rows: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of numbered own whose identity is in rows (row), or with keep False is not, without it."""
    return own.join(rows.select(F.col("row").alias(row)), row, "left_semi" if keep else "left_anti").drop(row)


def frequent(counts: DataFrame, most: int, key: str) -> DataFrame:
    """Of a key column and n (each key once) the most frequent, about most of them.

    A histogram of log counts gives the cut, so neither tasks nor the driver hold more than the bins and the result. Of the
    bin that would pass the bound a share is taken by a hash of the key, nine tenths of what still fits.
    """
    place = F.floor(F.log2("n") * 64).cast("int")
    bins = sorted(((r["bin"], r["keys"]) for r in counts.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("keys")).collect()), reverse=True)
    kept, held = F.lit(False), 0
    for at, keys in bins:
        if held + keys > most:
            share = int(0.9 * (most - held) / keys * (1 << 20))
            return counts.where((place > at) | (place == at) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share))
        held, kept = held + keys, place >= at
    return counts.where(kept)


def fresh(df: DataFrame, name: str) -> str:
    """name, or where df has a column that differs from it in case at most, one that it has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key is hot that has more than one in MOST_HOT of all rows, so there are fewer than MOST_HOT hot keys.
MOST_HOT = 2000


def hot_from(total: int) -> int:
    """Of total rows: a key of more rows than this is hot."""
    return max(256, total // MOST_HOT)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """rows joined with a table of one row per key, without a task that gets all rows of a frequent key; n goes.

    n is the table's column of how many rows have the key, as far as it is hot. Hot keys are broadcast, all others meet by
    a shuffle. rows and table are read repeatedly, so they should be written ones.
    """
    if total is None:
        total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) > hot_from(total))
    few = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= hot_from(total)), keys)
    return few.unionByName(rest).drop(n)
