"""SimHash near-duplicates: fingerprints, links within a few bits by pivot distances, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, lower_ascii, written

WORDS, BITS = 4, 4
#: Parts of a fingerprint, in bits: four differing bits leave two of six parts alike, or four of eight. From LARGE fingerprints on the
#: eight are taken, whose buckets have 32 bits instead of some 21.
PARTS, FINE, LARGE = (11, 11, 11, 11, 10, 10), (8,) * 8, 1 << 31
#: Fingerprints of a bucket that one task compares with as many; runs up to SHORT are compared row by row.
CHUNK, SHORT = 4096, 16
PIVOTS = 16


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(w: str, words: int = WORDS) -> Column:
    """XXH64 (seed 42) of every run of ``words`` words of column ``w``, repeats included; of all words if there are fewer; none without
    a word. ``w`` is a column of its own: each shingle looks its words up in it."""
    gram = F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, words)))))
    n = F.size(w)
    whole = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= words, F.slice(gram, F.lit(1), n - (words - 1))).otherwise(whole)


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint for each list of hashes: bits set in over half of them. Two bits are counted at a time."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        x, starts, half = values.view(np.uint64), offsets[:-1][full] - offsets[0], n[full].astype(np.uint64)
        for b in range(32):
            both = np.add.reduceat((x >> np.uint64(b)) & np.uint64(0x100000001), starts)
            for shift in (0, 32):
                count = (both >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
                out[full] |= (count * np.uint64(2) > half).astype(np.uint64) << np.uint64(b + shift)
    return out.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, fp (64 bits in a bigint). Null and empty texts, and those without a word, have 0. One row per row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                h = part.column(1)
                offsets = h.offsets.to_numpy()
                values = h.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority(values, offsets))], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), split_words(F.col(text_col)).alias("w")).select("id", shingle_hashes("w", words).alias("h"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to the pivots (columns)."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ pivots[None, :]).astype(np.int8)


def reference_fingerprints(n: int = PIVOTS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def near(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) link: the largest coordinate difference discards, the distance itself verifies."""
    left = np.flatnonzero((np.abs(table[a] - table[b]) <= bits).all(axis=1))
    u = fp.view(np.uint64)
    good = np.bitwise_count(u[a[left]] ^ u[b[left]]) <= bits
    out = np.zeros(len(a), bool)
    out[left[good]] = True
    return out


def spanning(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the first of its component. Rows are sorted by their distance to the first pivot, so that a
    fingerprint's partners lie in a window of that order; each is expanded once, against those not reached yet."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    left = np.arange(len(fp))
    src, dst = [], []
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            d = table[left, 0]
            lo, hi = np.searchsorted(d, table[x, 0] - bits), np.searchsorted(d, table[x, 0] + bits, "right")
            hit = near(fp, table, np.full(hi - lo, x), left[lo:hi], bits)
            if hit.any():
                got = left[lo:hi][hit]
                src.append(got)
                dst.append(np.full(len(got), root))
                todo += got.tolist()
                left = np.concatenate([left[:lo], left[lo:hi][~hit], left[hi:]])
    if not src:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return fp[np.concatenate(src)], fp[np.concatenate(dst)]


def with_pivots(nodes: DataFrame, pivots: np.ndarray | None = None) -> DataFrame:
    """Adds the pivot distances of ``fp``, a byte each."""
    pivots = reference_fingerprints() if pivots is None else pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(batch.schema.get_field_index("fp")).to_numpy()
            far = pa.array([row.tobytes() for row in pivot_table(fp, pivots)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, far], names=[*batch.schema.names, "pivots"])

    return nodes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", pivots binary")


def links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK, parts: tuple[int, ...] | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all links within ``bits`` (at most 4).

    ``nodes`` (a table) has fp and its pivot distances. Fingerprints that agree in as many parts as ``bits`` leave alike share a bucket;
    any link shares one. Inside buckets pairs are discarded by pivot distances and the others verified. Instead of all links, each part of a bucket gives a forest that connects
    the same fingerprints, so a group of n near copies gives some n edges. A bucket of over ``chunk`` fingerprints is dealt to
    pairs of chunks, each a group of its own with at most about twice as many rows, so no task holds a whole large bucket.
    """
    parts = parts or (PARTS if nodes.count() < LARGE else FINE)
    assert bits < len(parts) and sum(parts) == 64
    at = np.cumsum((0, *parts))
    masks = [sum(((1 << parts[p]) - 1) << int(at[p]) for p in alike) for alike in combinations(range(len(parts)), len(parts) - bits)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks))))
    keyed = nodes.select("fp", "pivots", key.alias("key")).select("fp", "pivots", "key.*")
    shared = keyed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    rows = keyed.join(shared, ["band", "part"]).withColumn("c", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    rows = rows.select("fp", "pivots", "band", "part", "c", other.alias("o")).withColumns({"lo": F.least("c", "o"), "hi": F.greatest("c", "o")})
    group = ["band", "part", "lo", "hi"]
    rows = rows.select(*group, "fp", "pivots").repartition(*group).sortWithinPartitions(*group, "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            same = (frame[group].to_numpy(np.int64)[1:] == frame[group].to_numpy(np.int64)[:-1]).all(axis=1)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            rest = frame.iloc[starts[-1] :]
            if starts[-1]:
                yield edges(frame.iloc[: starts[-1]], starts)
        if rest is not None and len(rest):
            yield edges(rest, np.array([0, len(rest)]))

    def edges(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Edges of whole groups; starts: where they begin, and the end."""
        fp = frame["fp"].to_numpy(np.int64)
        table = np.frombuffer(b"".join(frame["pivots"]), np.int8).reshape(len(fp), -1)
        sizes = np.diff(starts)
        member = np.repeat(np.arange(len(sizes)), sizes)
        short = sizes[member] <= SHORT
        u, v = [], []
        for step in range(1, min(SHORT, max(sizes, default=0))):
            a = np.flatnonzero(short[:-step] & (member[:-step] == member[step:]))
            hit = a[near(fp, table, a, a + step, bits)]
            u.append(fp[hit + step])
            v.append(fp[hit])
        for k in np.flatnonzero(sizes > SHORT):
            a, b = spanning(fp[starts[k] : starts[k + 1]], table[starts[k] : starts[k + 1]], bits)
            u.append(a)
            v.append(b)
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)} if u else {"u": [], "v": []}, dtype=np.int64).drop_duplicates()

    return rows.mapInPandas(run, "u bigint, v bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node with an edge, by alternating large and small stars.

    Each round is a shuffle of the edges and is written to the shared folder; the number of rounds is logarithmic. A node with very
    many edges is pre-aggregated, and adaptive execution splits its join.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = e.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, last = written(ordered, "edges"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, last, now = now, mark, written(star(star(now, True), False), "edges")
        discard(before)
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """id, fp, component_id: the smallest id reachable over links of at most ``bits`` differing bits.

    Equal fingerprints become one node first, so copies are never paired. Null and empty texts have fingerprint 0 and link like any
    other. Rows that repeat an id are in the same way nodes' members: an id with two texts may be in two components. An empty
    table gives an empty result.
    """
    docs = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = written(with_pivots(docs.groupBy("fp").agg(F.min("id").alias("least"))), "nodes")
    roots = components(links(nodes, bits))
    placed = nodes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # tables, so that the join with a root that very many fingerprints have is a plain shuffle and can be split
    placed = written(placed, "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return docs.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
