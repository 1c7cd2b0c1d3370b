"""Frames over a symbol's rows, and chunks with a halo for symbols of any length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol(order: str = "seq"):
    return Window.partitionBy("symbol").orderBy(order)


def rolling(agg: Column, counted: Column, n: int, order: str = "seq") -> Column:
    """An aggregate over the last n rows; null until n values that aren't null stand in the frame."""
    frame = by_symbol(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(counted).over(frame) == n, agg.over(frame))


def in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a group in one partition, in order, groups one after the other: a task streams them, whatever a group's length or number."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def first_rows(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows of a batch begin a group of ``in_order``, and the keys of its last row; ``last``: those of the batch before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = tuple(batch.column(k)[0].as_py() for k in keys) != last
    return new, tuple(batch.column(k)[-1].as_py() for k in keys)


def group_pieces(new: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the pieces into which ``first_rows`` cuts a batch; the first may go on with the group of the batch before."""
    at = sorted({0, *np.flatnonzero(new).tolist()})
    return list(zip(at, [*at[1:], len(new)], strict=True))


def running() -> tuple[int, int]:
    return Window.unboundedPreceding, Window.currentRow


def with_halo(df: DataFrame, chunk: int, before: int = 0, after: int = 0, seq: str = "seq") -> DataFrame:
    """Deal each symbol's rows (numbered from 1 by ``seq``) to chunks of ``chunk`` rows; rows near an edge go to the neighbours too.

    Adds ``chunk`` and ``own`` (the row's own chunk). Grouping by (symbol, chunk) then bounds a group by chunk + before + after
    rows, however long a symbol is.
    """
    assert chunk >= max(before, after)
    at = F.col(seq) - 1
    own = F.floor(at / chunk)
    chunks = F.array(own, F.when(at % chunk >= chunk - before, own + 1) if before else F.lit(None), F.when((at % chunk < after) & (own > 0), own - 1) if after else F.lit(None))
    out = df.select("*", own.alias("_own"), F.explode(F.array_compact(chunks.cast("array<bigint>"))).alias("chunk"))
    return out.withColumn("own", F.col("chunk") == F.col("_own")).drop("_own")


def in_chunks(df: DataFrame, operator, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """An operator that windows by ``symbol``, run on chunks of long symbols side by side: each chunk with its halo is a symbol of its own
    for the operator, and only a chunk's own rows are kept. ``before`` and ``after``: how many rows the operator looks back and ahead."""
    parts = with_halo(df, chunk, before, after).withColumn("symbol", F.struct("symbol", "chunk")).drop("chunk")
    return operator(parts).filter("own").drop("own").withColumn("symbol", F.col("symbol.symbol"))


def sequenced(df: DataFrame, order: list[str], part: Column) -> DataFrame:
    """Adds seq: a row's number in its symbol by ``order``, from 1. ``part`` grows with the order (a day, say): rows are numbered within
    (symbol, part), and what stands before a part is a sum over parts, so a symbol isn't one task."""
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("symbol", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.withColumn("_before", F.sum("_n").over(by_symbol("_part")) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("symbol", "_part").orderBy(*order))
    return rows.withColumn("_k", number).join(offset, ["symbol", "_part"]).withColumn("seq", F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def scanned(df: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, prevs: dict[str, Column] | None = None, order: str = "seq", chunk: int = 50_000) -> DataFrame:
    """Adds running sums, maxima and last values that aren't null, up to and with each row, and values of the row before (``prevs``), of groups of any length.

    A scan in two levels: each chunk of ``chunk`` numbers of ``order`` (an integer) gives its sum, maximum and last value; only these meet in
    a frame by ``keys``; rows then add what stands before their chunk to a frame inside it. Null where there is no value so far. The
    columns' expressions may not hold windows.
    """
    sums, tops, lasts, prevs = sums or {}, tops or {}, lasts or {}, prevs or {}
    rows = df.withColumns({"_chunk": F.floor(F.col(order) / chunk), **{f"_x_{k}": c for k, c in (sums | tops | lasts | prevs).items()}})
    x = lambda k: F.col(f"_x_{k}")
    ends = {f"_e_{k}": F.sum(x(k)) for k in sums} | {f"_e_{k}": F.max(x(k)) for k in tops}
    ends |= {f"_e_{k}": F.max_by(F.when(x(k).isNotNull(), x(k)), F.when(x(k).isNotNull(), F.col(order))) for k in [*lasts, *prevs]}
    by = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_c")).agg(*(c.alias(k) for k, c in ends.items()))
    up = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(tops, F.max), **dict.fromkeys([*lasts, *prevs], lambda c: F.last(c, ignorenulls=True))}
    before = by.select(*(f"_k{i}" for i in range(len(keys))), "_c", *(f(f"_e_{k}").over(up).alias(f"_b_{k}") for k, f in kinds.items()))
    met = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(before, met)
    near = Window.partitionBy(*keys, "_chunk").orderBy(order)
    inside = near.rowsBetween(*running())
    b = lambda k: F.col(f"_b_{k}")
    out = {k: F.coalesce(F.sum(x(k)).over(inside) + b(k), F.sum(x(k)).over(inside), b(k)) for k in sums}
    out |= {k: F.coalesce(F.lag(x(k)).over(near), b(k)) for k in prevs}
    out |= {k: F.greatest(F.max(x(k)).over(inside), b(k)) for k in tops}
    out |= {k: F.coalesce(F.last(x(k), ignorenulls=True).over(inside), b(k)) for k in lasts}
    return rows.withColumns(out).drop("_chunk", "_c", *(f"_k{i}" for i in range(len(keys))), *(f"_{a}_{k}" for a in "xb" for k in kinds))


def nth_row(df: DataFrame, nth: Callable[[Column], Column], part: Column) -> DataFrame:
    """symbol, n (rows), nth_seq and nth_ts of the row number nth(n) (from 0, by seq) of each symbol; null where there is none.

    ``part`` grows with seq (a day, say). Rows are counted by (symbol, part); the part in which the row lies is found in these counts,
    and only that part's rows are numbered. No frame spans a symbol.
    """
    rows = df.select("symbol", "seq", "ts", part.alias("_part"))
    sizes = rows.groupBy("symbol", "_part").agg(F.count(F.lit(1)).alias("k")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_part", "k"))).alias("_sizes"), F.sum("k").alias("n"))
    want = nth(F.col("n")).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    found = F.aggregate("_sizes", start, lambda a, s: F.struct(F.when((a["at"] < 0) & (a["before"] + s["k"] <= want), a["before"] + s["k"]).otherwise(a["before"]).alias("before"), F.when((a["at"] < 0) & (a["before"] + s["k"] > want), a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i")))
    places = sizes.select("symbol", "n", (want - found["before"]).alias("_left"), F.when(found["at"] >= 0, F.get("_sizes", found["at"])["_part"]).alias("_in"))
    some = rows.join(places.select(F.col("symbol").alias("_s"), "_in", "_left"), (F.col("symbol") == F.col("_s")) & (F.col("_part") == F.col("_in")))
    numbered = some.withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "_part").orderBy("seq")) - 1)
    hit = numbered.filter("_k = _left").select("symbol", F.col("seq").alias("nth_seq"), F.col("ts").alias("nth_ts"))
    return places.select("symbol", "n").join(hit, "symbol", "left")
