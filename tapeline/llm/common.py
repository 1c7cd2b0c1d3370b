"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else. ASCII texts take the JVM's fast path, the rest a character map."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the cluster's checkpoint folder.

    Only where the session names none and runs on one machine, a temporary folder is set; elsewhere that is an error, since other
    machines' files would be missed without notice.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tapeline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows as a Parquet table in the shared folder and read them again.

    The table survives lost executors, is compressed and column-pruned on reading. It stays until ``discard`` removes it or whoever
    owns the shared folder clears it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """With the id, it tells rows apart. Null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, dropped: DataFrame, key: Column, repeated: DataFrame | None = None) -> DataFrame:
    """Documents but for those whose (doc_id, ``key``) is among ``dropped`` (doc_id, text_key); null is an id like any other.

    Of rows that share a pair in ``repeated`` (doc_id, text_key) one stays, the one that hashes least as JSON. Columns may have any name and
    any type. Both are tables on disk: Spark broadcasts them where their size allows it and else joins by key, and adaptive execution splits a frequent pair.
    """
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]

    def join(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = listed.select(F.col("doc_id").alias("_listed_id"), F.col("text_key").alias("_listed_key"))
        return rows.join(listed, (key == listed["_listed_key"]) & rows["doc_id"].eqNullSafe(listed["_listed_id"]), how).select(*(rows[c] for c in names))

    out = join(docs, dropped, "left_anti")
    if repeated is None or repeated.isEmpty():
        return out
    once = join(docs, repeated, "left_semi").groupBy(F.col("doc_id").alias("_id"), key.alias("_key"))
    row = F.struct(*(F.col(c) for c in names))
    once = once.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return join(out, repeated, "left_anti").unionByName(once)


def through_python(rows: DataFrame, run, rest: str, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """mapInPandas with the columns ``ids`` as text on the way, so that null beside large numbers doesn't turn them into floats."""
    kinds = {c: rows.schema[c].dataType for c in ids}
    out = rows.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(run, ", ".join([*(f"{c} string" for c in ids), rest]))
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into training and held-out rows. 0 for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


#: Bits of the largest bitmap of listed keys that is broadcast (16 MB), and bits a key.
MOST_BITS, KEY_BITS = 1 << 27, 16


def maybe_listed(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """The rows whose bigint ``key`` can be among ``listed`` (a table), and about a sixteenth of the others: to filter wide rows before
    they are shuffled for the join that decides. The bitmap has a fixed largest size; with over 32 million keys it would let most rows pass
    and all are returned."""
    n = listed.count()
    bits = 1 << max(10, (n * KEY_BITS - 1).bit_length())
    if bits > MOST_BITS * 4:
        return rows
    bits = min(bits, MOST_BITS)
    at = F.col(listed_key).bitwiseAND(F.lit(bits - 1))
    words = listed.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({listed_key} & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        return pd.Series((shared.value[(k & (bits - 1)) >> 6] >> (k & 63)) & 1 == 1)

    return rows.filter(hit(key))


#: Rows and bytes of a batch between the JVM and Python where whole texts go.
TEXT_ROWS, BATCH_ROWS = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_BYTES, BATCH_BYTES, DEFAULT_BYTES = "1m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def text_batches(spark: SparkSession) -> None:
    """Where the session has Spark's defaults, end an Arrow batch after ``TEXT_ROWS`` rows or ``TEXT_BYTES`` from now on: 10,000 whole texts fill some
    30 MB several times over, on both sides of every task, and longer ones more. Other values that the session has set stand. No result depends on it."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        spark.conf.set(BATCH_BYTES, TEXT_BYTES)


def texts_of(df: DataFrame, id_col: str, text_col: str, ends: DataFrame) -> DataFrame:
    """The rows of ``ends`` (a table of node, id, text_key and more) with t, their text, for id and text_key: where rows repeat an id and its text, more
    than one a node. Few other texts are shuffled."""
    rows = df.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("t"))
    rows = maybe_listed(rows, "_key", ends, "text_key")
    return ends.join(rows, (rows["_key"] == ends["text_key"]) & rows["_id"].eqNullSafe(ends["id"])).drop("_id", "_key", "id", "text_key")
