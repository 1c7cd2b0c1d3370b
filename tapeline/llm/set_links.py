"""Components of similar sets of 64-bit hashes: forests of candidates inside buckets, links verified on the whole sets inside clusters.

Nothing here lists all pairs of a group: a bucket gives a forest that connects the same sets, and a cluster (a component of these
forests) is dealt to pieces of bounded size, each compared with one common piece first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .simhash import components

#: Sets of a bucket that one task compares with as many; runs up to SHORT are compared row by row.
CHUNK, SHORT = 1024, 16
#: Sets and shingles of a cluster's piece.
PIECE, PIECE_VALUES = 512, 1 << 21
#: Two sets link if they share so much of their union.
SHARE = (4, 5)


def set_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart and don't depend on the order of their values; starts: where the (non-empty) sets begin."""
    out = []
    for a, b in ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xD6E8FEB86659FD93, 0x94D049BB133111EB)):
        x = (values.view(np.uint64) ^ np.uint64(b)) * np.uint64(a)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(b)
        out.append(np.add.reduceat(x ^ (x >> np.uint64(29)), starts).view(np.int64))
    return out[0], out[1]


def parity_bitmaps(values: np.ndarray, of: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Odd sketches: row i has bit (value mod bits) set if an odd number of the values of set i fall there; as 64-bit words."""
    at = of * bits + ((values.view(np.uint64) >> np.uint64(17)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ between bitmaps. Every value that only one of two sets has flips one bit, so this is at most the size of the
    difference of what was folded in."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def may_share(pop: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m values whose parity bitmaps differ in ``pop`` bits can share ``SHARE``: none that does is lost.

    Sets that share p/q of their union differ in at most (q - p) / (q + p) of the sum of their sizes.
    """
    p, q = SHARE
    return ((p + q) * pop <= (q - p) * (n + m)) & (q * np.minimum(n, m) >= p * np.maximum(n, m))


def pieces(batches: Iterator[pa.RecordBatch], column: int, values: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``values`` values in their list column."""
    for batch in batches:
        offsets = batch.column(column).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets[1:], offsets[at] + values, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and offsets from 0."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), offsets - offsets[0]


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first ``n_keys`` columns (bigint) come as batches that end where a group ends, with the groups' starts and the end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        if rest and tuple(keys[:, 0]) != tuple(rest[-1].column(i)[-1].as_py() for i in range(n_keys)):
            yield _grouped(rest, n_keys)
            rest = []
        last = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield _grouped([*rest, batch.slice(0, cut)], n_keys)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield _grouped(rest, n_keys)


def _grouped(parts: list[pa.RecordBatch], n_keys: int) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
    keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
    return batch, np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])


def words_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def forest(starts: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of edges that connect, inside each group, the rows that ``test`` connects.

    Short groups are compared pair by pair, all groups at once. In a longer one each row is expanded once, against the rows not reached
    yet, so that a group of n alike rows takes some n comparisons and gives n - 1 edges.
    """
    sizes = np.diff(starts)
    member = np.repeat(np.arange(len(sizes)), sizes)
    short = sizes[member] <= SHORT
    src, dst = [], []
    for step in range(1, min(SHORT, int(sizes.max(initial=0)))):
        a = np.flatnonzero(short[:-step] & (member[:-step] == member[step:]))
        a = a[test(a, a + step)] if len(a) else a
        src.append(a)
        dst.append(a + step)
    for k in np.flatnonzero(sizes > SHORT):
        left = np.arange(starts[k], starts[k + 1])
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = test(np.full(len(left), x), left)
                got, left = left[hit], left[~hit]
                src.append(np.full(len(got), x))
                dst.append(got)
                todo += got.tolist()
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.empty(0, np.int64), np.empty(0, np.int64))


def edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def bucket_forest(keyed: DataFrame, nodes: DataFrame, features: list[str], test_of: Callable[[pa.RecordBatch], Callable], chunk: int = CHUNK, short: int = SHORT) -> DataFrame:
    """Edges (u, v) between nodes that share a bucket and pass a test; their components are those of all such pairs.

    ``keyed``: bucket, node. ``nodes``: node and the ``features`` that ``test_of`` reads from a batch (columns 0 to 2 are others) to give the test of row
    numbers. Buckets of at most ``short`` nodes give their pairs as numbers, each pair once over all buckets, before any feature
    moves. In larger ones each node brings its features; one of over ``chunk`` nodes is dealt to pairs of chunks.
    """
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = written(keyed.join(shared, "bucket"), "shared-buckets")

    group = rows.filter(F.col("k") <= short).groupBy("bucket").agg(F.collect_list("node").alias("x"))  # at most ``short`` each
    later = lambda x, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))
    pairs = group.select(F.explode(F.flatten(F.transform("x", later))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(f).alias(f"{f}_{c}") for f in features))
    pairs = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", *(f"{f}_{c}" for c in "uv" for f in features))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.num_rows, len(features)
            u, v = batch.column(0), batch.column(1)
            both = [pa.concat_arrays([u, v])] * 3 + [pa.concat_arrays([batch.column(2 + i), batch.column(2 + m + i)]) for i in range(m)]
            keep = test_of(pa.RecordBatch.from_arrays(both, names=["a", "b", "c", *features]))(np.arange(n), np.arange(n) + n) if n else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep))

    few = pairs.mapInArrow(tested, "u bigint, v bigint")

    chunks = F.ceil(F.col("k") / chunk).cast("int")
    large = rows.filter(F.col("k") > short).withColumn("c", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    place = (F.least("c", "o").cast("bigint") * (1 << 24) + F.greatest("c", "o")).alias("place")
    large = large.select("bucket", place, "node").join(nodes.select("node", *features), "node").select("bucket", "place", "node", *features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, 2):
            a, b = forest(starts, test_of(batch))
            node = batch.column(2).to_numpy()
            yield edge_batch(node[a], node[b])

    many = large.repartition("bucket", "place").sortWithinPartitions("bucket", "place", "node").mapInArrow(run, "u bigint, v bigint")
    out = written(few.unionByName(many).distinct(), "candidates")
    discard(rows)
    return out


class Sets:
    """Sets of a batch, as flat values with offsets, and their parity bitmaps."""

    def __init__(self, lists: pa.ListArray, bits: int = 2048):
        self.values, self.offsets = flat(lists)
        self.n = np.diff(self.offsets)
        words = [parity_bitmaps(self.values[self.offsets[i] : self.offsets[j]], np.repeat(np.arange(j - i), self.n[i:j]), j - i, bits) for i in range(0, len(self.n), 256) for j in [min(i + 256, len(self.n))]]
        self.bitmaps = np.concatenate(words) if words else np.empty((0, bits // 64), np.uint64)
        self.sorted: dict[int, np.ndarray] = {}

    def links(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows share ``SHARE``: bitmaps discard, the sets decide."""
        p, q = SHARE
        out = may_share(differing(self.bitmaps[a], self.bitmaps[b]), self.n[a], self.n[b])
        left = np.flatnonzero(out)
        for x in np.unique(a[left]):
            some = left[a[left] == x]
            mine = np.sort(self.values[self.offsets[x] : self.offsets[x + 1]])
            for at in range(0, len(some), 256):  # few sets at a time: long ones are many values
                part = some[at : at + 256]
                sizes = self.n[b[part]]
                ends = np.cumsum(sizes)
                where = np.arange(ends[-1]) + np.repeat(self.offsets[b[part]] - (ends - sizes), sizes)
                v = self.values[where]
                found = mine[np.searchsorted(mine, v).clip(max=len(mine) - 1)] == v
                both = np.add.reduceat(found.astype(np.int64), ends - sizes)
                out[part] = (p + q) * both >= p * (len(mine) + sizes)
        return out


def linked_components(edges: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame], piece: int = PIECE) -> DataFrame:
    """node, root (the smallest node) of every node with a link: pairs inside a component of the candidate ``edges`` that share ``SHARE``.

    ``sizes``: node, n (values of its set). ``sets`` takes a table with a column node and adds s, the distinct non-empty values of each, to its rows. A cluster of
    sets is dealt to pieces of about ``piece`` sets (fewer if they are long). Each piece is compared within itself and with the cluster's first piece.
    A link that this leaves out joins two components, so one of its ends is outside the cluster's largest component: those sets are then
    compared with every piece. A group of n sets that mostly link is so compared in about 2 n / piece groups, not n^2 / piece^2.
    Sets are placed before they are made, so that they move once.
    """
    clusters = components(edges).withColumnRenamed("root", "cluster").join(sizes.select("node", "n"), "node")
    clusters = written(clusters, "clusters")
    many = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / piece), F.ceil(F.sum("n") / PIECE_VALUES)).cast("int").alias("k"))
    many = written(many, "cluster-pieces")
    placed = written(clusters.join(many, "cluster").withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")), "cluster-places")
    groups = F.when(F.col("c") > 0, F.array("c")).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    first = sets(placed.select("node", "cluster", "k", "c")).withColumn("g", F.explode(groups)).select("cluster", F.col("g").cast("bigint").alias("g"), (F.col("c") > 0).cast("bigint").alias("late"), "node", "s")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in bounded(whole_groups(batches, 2)):
            node = batch.column(3).to_numpy()
            a, b = forest(starts, Sets(batch.column(4)).links)
            yield edge_batch(node[a], node[b])

    found = first.repartition("cluster", "g").sortWithinPartitions("cluster", "g", "late", "node").mapInArrow(inside, "u bigint, v bigint")
    found = written(found.distinct(), "links")
    roots = components(found)

    large = many.filter("k > 1").select("cluster", "k")
    if large.isEmpty():
        discard(clusters, placed, many)
        return roots
    now = placed.select("cluster", "k", "c", "node").join(large.select("cluster"), "cluster", "left_semi").join(roots, "node", "left")
    now = written(now.select("cluster", "k", "c", "node", F.coalesce("root", "node").alias("root")), "rooted")
    counts = now.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"))
    top = counts.groupBy("cluster").agg(F.max_by("root", F.struct("m", "root")).alias("top"), (F.sum("m") - F.max("m")).alias("out"))
    now = now.join(written(top.filter("out > 0"), "largest"), "cluster").withColumn("parts", F.least(F.col("k"), F.ceil(F.col("out") / piece).cast("int")))
    now = sets(written(now.select("node", "cluster", "root", "top", "k", "c", "parts"), "outside"))
    # what stands outside is dealt by its own number, the rest by the cluster's pieces
    out = F.array(F.struct(F.lit(1).alias("side"), F.array("c").alias("i"), F.sequence(F.lit(0), F.col("parts") - 1).alias("j")))
    mine = F.struct(F.lit(0).alias("side"), F.sequence(F.lit(0), F.col("k") - 1).alias("i"), F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("j"))
    both = now.withColumn("x", F.explode(F.when(F.col("root") != F.col("top"), F.array_append(out, mine)).otherwise(out)))
    both = both.select("cluster", "node", "root", "s", "x.side", F.explode("x.i").alias("i"), F.col("x.j").alias("js")).select("*", F.explode("js").alias("j"))
    both = both.select("cluster", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("side").cast("bigint").alias("side"), "node", "root", "s")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in bounded(whole_groups(batches, 3)):
            side, node, root = (batch.column(i).to_numpy() for i in (3, 4, 5))
            s, u, v = Sets(batch.column(6)), [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                for x in range(lo, mid):
                    other = np.arange(mid, hi)[root[mid:hi] != root[x]]
                    got = other[s.links(np.full(len(other), x), other)] if len(other) else other
                    got = got[np.unique(root[got], return_index=True)[1]]  # one link a component is enough
                    u.append(np.full(len(got), node[x]))
                    v.append(node[got])
            yield edge_batch(np.concatenate(u) if u else np.empty(0, np.int64), np.concatenate(v) if v else np.empty(0, np.int64))

    late = both.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "node").mapInArrow(between, "u bigint, v bigint")
    late = written(late.distinct(), "late-links")
    if not late.isEmpty():
        roots = components(found.unionByName(late))
    discard(clusters, placed, many)
    return roots


def bounded(groups: Iterator[tuple[pa.RecordBatch, np.ndarray]], values: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The same groups in batches of about ``values`` values in their last column, or one group."""
    for batch, starts in groups:
        offsets = batch.column(batch.num_columns - 1).offsets.to_numpy()[starts].astype(np.int64)
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + values, "right")) - 1)
            yield batch.slice(starts[at], starts[to] - starts[at]), starts[at : to + 1] - starts[at]
            at = to
