"""Exact duplicates: group by a 128-bit content hash, keep one stable row, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lower_ascii, maybe_listed, text_key, without_rows, written

#: Members of a group that one task compares with the group's text.
SALT_ROWS = 256


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hashed: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. ``keep`` is ``min`` or ``max``: which id of a group stays.
    Rows are grouped by the first 128 bits of the SHA-256. Members of groups of two or more are then compared byte by byte with the
    text of the row that stays; a row that differs (a hash collision) leaves the group and is grouped by its whole text.
    ``hashed`` replaces the 128-bit key (tests force collisions with it). text_key is a 64-bit hash of the lower-cased text.

    Exactly one row of a group is kept. Of rows that repeat the id that stays and its text, that is any one; an id's second text is
    a row of its own. A null id never stays unless all ids of the group are null. Other columns are ignored, whatever their names.
    An empty table gives an empty result.

    Scale: only (id, key, digest) is shuffled for the grouping, with map-side combining. Texts move once for rows whose key repeats, and for the
    few others that a bitmap of repeated keys lets pass. A group with very many copies is salted by its size before the comparison.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(F.col(id_col).alias("id"), text.alias("t"))
    sha = F.sha2(F.col("t"), 256)
    key = F.unhex(F.substring(sha, 1, 32)) if hashed is None else hashed
    keyed = base.select("id", key.alias("key"), sha.alias("sha"), F.xxhash64("t").alias("tk"))
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()), "dedup-keys")  # the number is stored, so it stays
    first = {"min": F.min(F.struct(F.col("id").isNull(), "id", "sha", "row")), "max": F.max(F.struct(F.col("id").isNotNull(), "id", "sha", "row"))}[keep]
    # a table, so that both sides of the joins below are plain shuffles and adaptive execution can split a key with very many rows
    groups = keyed.groupBy("key").agg(first.alias("k"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("key", F.col("k.id").alias("keep"), F.col("k.sha").alias("keep_sha"), F.col("k.row").alias("keep_row"), "n"), "dedup-groups")
    repeated = groups.filter("n > 1")

    salts = F.ceil(F.col("n") / SALT_ROWS)
    members = maybe_listed(base.withColumns({"key": key, "kk": F.xxhash64(key)}), "kk", repeated.select(F.xxhash64("key").alias("kk")), "kk").drop("kk")
    members = written(members.join(repeated, "key"), "dedup-members")  # texts are shuffled once
    text_of = members.filter(F.col("id").eqNullSafe(F.col("keep"))).filter(sha == F.col("keep_sha")).groupBy("key", "n").agg(F.min("t").alias("kept_t"))
    text_of = text_of.select("key", "kept_t", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"))
    members = members.select("key", "t", F.pmod(F.xxhash64("id", "t"), salts).cast("int").alias("salt"))
    differs = members.join(text_of, ["key", "salt"]).filter("t <> kept_t")
    strays = written(differs.select("key", sha.alias("sha")).distinct(), "dedup-strays")
    apart = keyed.join(strays, ["key", "sha"]).groupBy("key", "sha").agg(first.alias("k"), F.count(F.lit(1)).alias("n2"))
    apart = written(apart.select("key", "sha", F.col("k.id").alias("keep2"), F.col("k.row").alias("row2"), "n2"), "dedup-apart")
    lost = apart.groupBy("key").agg(F.sum("n2").alias("gone"))

    sized = groups.join(lost, "key", "left").select("key", "keep", "keep_row", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"))
    out = keyed.join(sized, "key").join(apart, ["key", "sha"], "left")
    moved = F.col("row2").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.when(moved, F.col("keep2")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n2", "n").alias("group_size"),
        (F.col("row") == F.coalesce("row2", "keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("tk").alias("text_key"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max").drop("text_key")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z), exactly one: the one with the smallest id, a null id last.

    Rows that repeat an id and a text leave one row, an id's texts are judged each by itself, and null texts are empty ones.
    """
    found = exact_dedup(docs).filter("not kept").select("doc_id", "text_key", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"))
    found = written(found, "dedup-dropped")
    return without_rows(docs, found.filter("not again"), text_key(lower_ascii(F.col("text"))), found.filter("again").select("doc_id", "text_key").distinct())
