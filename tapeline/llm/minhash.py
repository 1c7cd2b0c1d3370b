"""MinHash near-duplicates: banded minima give candidates, odd sketches estimate how similar they are, the sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, text_key, texts_of, written
from .set_links import SHARE, bucket_forest, differing, flat, linked_components, parity_bitmaps, pieces, set_keys, words_of
from .simhash import shingle_hashes, split_words

WORDS = 2
#: Bands and minima of a band. Two sets that share 0.8 of their union agree in no band once in 2 * 10^7 pairs: (1 - 0.8^4)^32; at 0.9 once in 10^14.
BANDS, ROWS = 32, 4
#: Minima that a sketch folds in, and its bits.
SAMPLES, BITS = 1024, 2048
#: Standard deviations by which a pair of sampled sets may differ more than sets that share ``SHARE``.
DEVIATIONS = 6


def permutations(n: int = BANDS * ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def band_hashes(values: np.ndarray, starts: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's minima for each (non-empty) set: shape (sets, bands)."""
    x = values.view(np.uint64)
    out = np.zeros((len(starts), BANDS), np.uint64)
    step = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(x, masks[k], out=step)
        np.multiply(step, factors[k], out=step)
        band = out[:, k // ROWS]
        np.multiply(band ^ np.minimum.reduceat(step, starts), np.uint64(0x9E3779B97F4A7C15), out=band)
        band ^= band >> np.uint64(29)
    return out.view(np.int64)


def odd_sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitmaps of each set's ``SAMPLES`` smallest values (all, of a smaller set) folded to parities."""
    n = np.diff(offsets)
    of = np.repeat(np.arange(len(n)), n)
    keep = np.ones(len(values), bool)
    for i in np.flatnonzero(n > SAMPLES):
        mine = values[offsets[i] : offsets[i + 1]].view(np.uint64)
        keep[offsets[i] : offsets[i + 1]] = mine <= np.partition(mine, SAMPLES - 1)[SAMPLES - 1]
    return parity_bitmaps(values[keep], of[keep], len(n), BITS)


def estimated_difference(pop: np.ndarray) -> np.ndarray:
    """Values in which two samples differ, estimated from the bits in which their sketches do."""
    return -BITS / 2 * np.log1p(-2 * np.minimum(pop, BITS / 2 - 1) / BITS)


def estimated_similarity(pop: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of two sets of n and m values by their sketches' differing bits."""
    d, a, b = estimated_difference(pop), np.minimum(n, SAMPLES), np.minimum(m, SAMPLES)
    both = np.maximum(0, (a + b - d) / 2) / np.maximum(a, b)  # share of the larger sample that is in both
    common = both * np.maximum(n, m)
    return np.clip(common / (n + m - common), 0, 1)


def may_link(pop: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m values whose sketches differ in ``pop`` bits can share ``SHARE``.

    Differing bits are at most the samples' differing values. Of sets folded in whole none that shares enough is discarded. Of sampled
    ones a pair stays up to ``DEVIATIONS`` standard deviations beyond what ``SHARE`` means (one in 10^9).
    """
    p, q = SHARE
    lo, hi = np.minimum(n, m), np.maximum(n, m)
    most = (q - p) / (p + q) * (n + m) + np.where(lo <= SAMPLES, np.maximum(0, hi - SAMPLES), 0)
    apart = 1 - p / (p + q) * (n + m) / hi  # share of the larger set that the other lacks, at most
    sampled = 2 * SAMPLES * apart + DEVIATIONS * 2 * np.sqrt(SAMPLES * np.maximum(apart * (1 - apart), 0.01))
    return (q * lo >= p * hi) & (pop <= np.where(lo > SAMPLES, sampled, most))


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, text_key, k1 and k2 (128 bits of the set), n (its size), sketch, bands of every row. Bands are empty where the set is."""
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), split_words(F.col(text_col)).alias("w"))
    sets = rows.select("id", "text_key", F.array_distinct(shingle_hashes("w", words)).alias("s"))
    masks, factors = permutations()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2, 50_000):
            values, offsets = flat(part.column(2))
            n = np.diff(offsets)
            full, starts = n > 0, offsets[:-1][n > 0]
            k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands = np.empty((0, BANDS), np.int64)
            if len(starts):
                k1[full], k2[full] = set_keys(values, starts)
                bands = band_hashes(values, starts, masks, factors)
            sketch = pa.array([row.tobytes() for row in odd_sketches(values, offsets)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * BANDS)).astype(np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int32)), sketch, lists], names=["id", "text_key", "k1", "k2", "n", "sketch", "bands"])

    return sets.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, text_key bigint, k1 bigint, k2 bigint, n int, sketch binary, bands array<bigint>")


def sketch_test(batch: pa.RecordBatch):
    n, words = batch.column(3).to_numpy().astype(np.int64), words_of(batch.column(4))
    return lambda a, b: may_link(differing(words[a], words[b]), n[a], n[b])


def set_of(w: str, words: int) -> Column:
    return F.array_distinct(shingle_hashes(w, words))


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id reachable over pairs of texts whose sets of shingles share ``SHARE`` or more.

    Equal sets are one node first, told apart by 128 bits. Nodes whose MinHash bands agree are compared by odd sketches, and the components
    of what they leave are verified on the whole sets of shingles (``linked_components``). A link is lost only where no band agrees.

    Null and empty texts and texts without a word have an empty set, which links with nothing: they are components of their own. A null
    id is a component's id only where it has no other. Repeated rows are equal sets. Other columns are ignored, whatever their names; an
    empty table gives an empty result.

    Scale: a row's bands (512 bytes) are shuffled, texts only of sets that have a candidate, and a cluster of any size is dealt to pieces.
    """
    rows = written(signatures(df, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = rows.filter("n > 0")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_key", "row"))
    nodes = full.groupBy("k1", "k2").agg(least.alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("k1", "k2", F.col("least.row").alias("node"), F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key"), "n", "sketch", "bands"), "set-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("i", "band")).select(F.xxhash64("i", "band").alias("bucket"), "node")

    def sets(wanted: DataFrame) -> DataFrame:
        ends = written(wanted.join(nodes.select("node", "id", "text_key"), "node"), "ends")
        return texts_of(df, id_col, text_col, ends).withColumn("w", split_words(F.col("t"))).drop("t").withColumn("s", set_of("w", words)).drop("w")

    candidates = bucket_forest(keyed, nodes, ["n", "sketch"], sketch_test)
    roots = linked_components(candidates, nodes, sets)
    placed = written(nodes.join(roots, "node", "left").select("k1", "k2", "id", F.coalesce("root", "node").alias("root")), "placed")
    # a table, so that both sides of the join are plain shuffles and adaptive execution can split a component with very many sets
    of = written(placed.groupBy("root").agg(F.min("id").alias("component_id")), "least")  # min passes over nulls
    of = written(placed.join(of, "root").select("k1", "k2", "component_id"), "set-components")
    out = full.join(of, ["k1", "k2"]).select("id", "n", "component_id").unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    discard(candidates)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: All pairs by their common shingles.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
g AS (SELECT s.s, min(doc_id) AS node, len(s.s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) AS s WHERE len(s.s) > 0 GROUP BY s.s),
e AS (SELECT node, n, unnest(s) AS h FROM g),
rare AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1),
f AS (SELECT node, n, h FROM e WHERE h IN (SELECT h FROM rare)),
links AS (SELECT a.node AS u, b.node AS v FROM f AS a JOIN f AS b ON a.h = b.h AND a.node < b.node AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.node, b.node, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
two AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT node AS u, node AS v FROM g UNION SELECT r.u, b.v FROM reach AS r JOIN two AS b ON r.v = b.u),
c AS (SELECT u AS node, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN g ON list_sort(s.s) = g.s LEFT JOIN c ON c.node = g.node
"""
