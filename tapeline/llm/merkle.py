"""Merkle manifest of a table: a log of tree nodes in postorder, from which closed-form positions read the siblings of a proof."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .set_links import whole_groups

#: Levels of a block: a builder holds at most 2^LEVELS leaves and their parents.
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EVERY = 7


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    return F.sha2(F.concat(*(F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in (f.cast("string") for f in fields))), 256)


def position(level, index, n):
    """Place in the postorder log of the node ``index`` of ``level`` in a tree of n leaves.

    Before the last leaf m below the node there are m leaves and the parents that they complete: m - popcount(m). The nodes that leaf m
    completes follow it, one a level.
    """
    m = np.minimum((index + 1) << level, n) - 1
    return 2 * m - np.bitwise_count(m).astype(np.int64) + level


def height(n: int) -> int:
    """Levels above the leaves in a tree of n leaves."""
    return (int(n) - 1).bit_length()


def height_of(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def parents(digests: list[str]) -> list[str]:
    return [sha256("".join(digests[i : i + 2]).encode()).hexdigest() for i in range(0, len(digests), 2)]


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds index (from 0, by ``order``, nulls first) and n (rows) within ``key``. ``rows`` is a table.

    Rows are sorted by range, so a key of any size is many tasks; equal rows are told apart by a random number. Only the counts by
    (task, key) meet in a window.
    """
    by = [key, *order, "_any"]
    spread = rows.withColumn("_any", F.rand(11)).repartitionByRange(*(F.col(c).asc_nulls_first() for c in by)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by))
    spread = written(spread.drop("_any").withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    counts = spread.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_of")).agg(F.count(F.lit(1)).alias("_k"), F.min("_at").alias("_lo"))
    of = Window.partitionBy("_key")
    counts = counts.withColumns({"_before": F.sum("_k").over(of.orderBy("_of")) - F.col("_k"), "n": F.sum("_k").over(of)})
    out = spread.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_of")))
    return out.withColumn("index", F.col("_at") - F.col("_lo") + F.col("_before")).drop("_key", "_of", "_k", "_lo", "_before", "_task", "_at")


def append_log(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of (tree, level, index, position, n, digest), one for each ``levels`` levels: all nodes of the trees whose leaves are (tree, index, n, digest).

    A parent is the hash of two consecutive nodes, or of the last one alone. A builder gets a block of 2^levels nodes that starts at a
    multiple of that, and writes its nodes in the order in which they are completed. The nodes above a block are the next table's
    work, which has as many rows fewer. Together the tables are a log whose positions have no gap.
    """

    def builder(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, starts in whole_groups(batches, 2):
                tree, index, n, digest = (batch.column(i) for i in (0, 2, 3, 4))
                tree, index, n, digest = tree.to_numpy(), index.to_numpy(), n.to_numpy(), digest.to_pylist()
                cols: list[list] = [[], [], [], [], []]
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    now, first, top = digest[lo:hi], int(index[lo]), height(n[lo])
                    for level in range(base, min(base + levels, top) + 1):
                        for c, x in zip(cols, (np.full(len(now), tree[lo]), np.full(len(now), level), first + np.arange(len(now)), np.full(len(now), n[lo]), now), strict=True):
                            c.extend(x)
                        now, first = parents(now), first >> 1
                tree, level, index, n = (np.array(c, np.int64) for c in cols[:4])
                at = position(level, index, n)
                order = np.lexsort((at, tree))
                yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (tree, level, index, at, n)] + [pa.array(cols[4]).take(pa.array(order))], names=["tree", "level", "index", "position", "n", "digest"])

        return run

    logs, now, base = [], leaves, 0
    while True:
        rows = now.select("tree", F.shiftright("index", levels).alias("block"), "index", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
        rows = written(rows.mapInArrow(builder(base), "tree bigint, level bigint, index bigint, position bigint, n bigint, digest string"), "log")
        base += levels
        logs.append(rows.filter(F.col("level") < base))
        now = rows.filter(F.col("level") == base)
        if now.isEmpty():
            return logs


def siblings(index: int, n: int, base: int, levels: int) -> list[tuple[int, int]]:
    """(side, position) of the siblings of a node of level ``base``, for ``levels`` levels: side 1 if it stands left, 2 right, 0 if there is none."""
    out = []
    for level in range(base, min(base + levels, height(n))):
        other, last = index ^ 1, (n - 1) >> level
        out.append((0, -1) if other > last else (1 if other < index else 2, int(position(np.int64(level), np.int64(other), np.int64(n)))))
        index >>= 1
    return out


def folded(digest: str, path: str) -> str:
    """The root that a digest and the siblings of its path give; a path has a side and, but for side 0, a digest for each level."""
    at = 0
    while at < len(path):
        side, other = path[at], path[at + 1 : at + 65]
        digest = sha256({"0": digest, "1": other + digest, "2": digest + other}[side].encode()).hexdigest() if side != "0" else sha256(digest.encode()).hexdigest()
        at += 1 if side == "0" else 65
    return digest


def only_siblings(path: str) -> str:
    at, out = 0, []
    while at < len(path):
        out.append(path[at + 1 : at + 65] if path[at] != "0" else "")
        at += 1 if path[at] == "0" else 65
    return "".join(out)


def paths(logs: list[DataFrame], above: DataFrame, claims: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """The paths of all leaves to the root: (tree, index, path); with ``claims`` (tree, index, id, digest, changed) instead one row a claim:
    tree, id, digest, proof (hash of the siblings), root (what ``changed``, or else the digest, folds to).

    ``above`` (tree, n, path) continues each tree's path. The log's tables are read from the top down. A task gets a block of the log and the path
    of the block's own root, and reads each sibling at its position.
    """
    kind = "bigint" if claims is None else claims.schema["id"].dataType.simpleString()

    def run_of(base: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, starts in whole_groups(batches, 2):
                what, at, n = (batch.column(i).to_numpy() for i in (2, 3, 5))
                index, digest, changed = (batch.column(i) for i in (4, 6, 7))
                index, digest, changed = index.to_numpy(), digest.to_pylist(), changed.to_pylist()
                rows, out = [], [[], []]
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    up, size = digest[lo], int(n[lo])
                    a, b = lo + np.searchsorted(what[lo:hi], [1, 2])
                    for x in range(b, hi):
                        sides = siblings(int(index[x]), size, base, levels)
                        where = a + np.searchsorted(at[a:b], [p for _, p in sides])
                        path = "".join(str(s) + (digest[w] if s else "") for (s, _), w in zip(sides, where, strict=True)) + up
                        rows.append(x)
                        if last:
                            out[0].append(sha256(only_siblings(path).encode()).hexdigest())
                            out[1].append(folded(changed[x] or digest[x], path))
                        else:
                            out[0].append(path)
                took = batch.take(pa.array(np.array(rows, np.int64)))
                if last:
                    yield pa.RecordBatch.from_arrays([took.column(0), took.column(8), took.column(6), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["tree", "id", "digest", "proof", "root"])
                else:
                    yield pa.RecordBatch.from_arrays([took.column(0), took.column(4), took.column(5), pa.array(out[0], pa.string())], names=["tree", "index", "n", "path"])

        return run

    def part(rows: DataFrame, block, what: int, at, index, digest, changed=None, id_=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select("tree", block.cast("bigint").alias("block"), F.lit(what).cast("bigint").alias("what"), at.cast("bigint").alias("at"), index.cast("bigint").alias("index"), "n", digest.alias("digest"), (none if changed is None else changed).alias("changed"), (F.lit(None).cast(kind) if id_ is None else id_).alias("id"))

    top = F.floor(height_of(F.col("n")) / levels)  # the table with the tree's root
    found: DataFrame | None = None
    zero = F.lit(0)
    for p in range(len(logs) - 1, -1, -1):
        base = p * levels
        ups = above.filter(top == p).select("tree", F.lit(0).cast("bigint").alias("index"), "n", "path")
        ups = ups if found is None else ups.unionByName(found)
        nodes = part(logs[p], F.expr(f"shiftright(index, cast({base + levels} - level as int))"), 1, F.col("position"), F.col("index"), F.col("digest"))
        if p or claims is None:
            asked = part(logs[p].filter(F.col("level") == base), F.shiftright("index", levels), 2, F.col("index"), F.col("index"), F.col("digest"))
        else:
            asked = part(claims, F.shiftright("index", levels), 2, F.col("index"), F.col("index"), F.col("digest"), F.col("changed"), F.col("id"))
        rows = part(ups, F.col("index"), 0, zero, zero, F.col("path")).unionByName(nodes).unionByName(asked)
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "what", "at")
        last = not p and claims is not None
        found = rows.mapInArrow(run_of(base, last), f"tree bigint, id {kind}, digest string, proof string, root string" if last else "tree bigint, index bigint, n bigint, path string")
        found = found if last else written(found, "paths")
    return found


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is the digest of the row's ``fields``. Leaves of a group form a tree by ascending id (null first, then by leaf); the groups'
    roots, by group (null first, bytewise), form another. ``changed`` is the digest of a row as it is found now, null where it is
    unchanged: folded_root is what it and the siblings of the log give.

    Repeated rows are leaves of their own. A single row is its group's root, a single group's root the root. Other columns are ignored,
    whatever their names; an empty table gives an empty result.

    Scale: texts are read once. Digests are sorted by range, so a group of any size is many blocks; a block has at most 2^levels leaves.
    """
    columns = [F.col(c) for c in fields]
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), digest_of(*columns).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    rows = ranked(written(rows, "leaves"), "g", "id", "digest")
    rows = written(rows.withColumnRenamed("n", "size"), "numbered")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).withColumn("all", F.lit(0).cast("bigint"))
    groups = ranked(written(groups, "groups"), "all", "g").select("g", F.col("index").alias("tree"), "size", F.col("n").alias("trees"))
    groups = written(groups, "trees")
    claims = rows.join(groups.select(F.col("g").alias("_g"), "tree"), F.col("g").eqNullSafe(F.col("_g"))).select("tree", "index", F.col("size").alias("n"), "id", "digest", "changed")
    claims = written(claims, "claims")

    logs = append_log(claims, levels)
    union = logs[0]
    for more in logs[1:]:
        union = union.unionByName(more)
    subroots = union.filter(F.col("level") == height_of(F.col("n"))).select("tree", F.col("digest").alias("subroot"))
    subroots = written(subroots.join(groups.select("tree", "size", "trees"), "tree"), "subroots")
    over = append_log(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.col("trees").alias("n"), F.col("subroot").alias("digest")), levels)
    root = over[-1].filter(F.col("level") == height_of(F.col("n"))).select("digest").first()
    ends = over[0].select("tree", "n").limit(1).withColumn("path", F.lit(""))  # the root's own path
    of_tree = paths(over, ends, levels=levels).select(F.col("index").alias("tree"), "path")
    above = written(of_tree.join(subroots, "tree").select("tree", F.col("size").alias("n"), "path"), "above")
    found = paths(logs, above, claims, levels).join(subroots.select("tree", "subroot"), "tree")
    whole = F.lit(root[0] if root else "")
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", whole.alias("root"), F.col("proof").alias("proof_sha256"), F.col("root").alias("folded_root"), (F.col("root") == whole).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0
    tampered = digest_of(*(F.col(c).cast("bigint") + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    return manifest(documents(spark, sf_dir), changed=F.when(hit & F.col("n_chars").isNotNull(), tampered))


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: A list of nodes a level; crc32 bit by bit (-1 stands for a shift). A step is the sibling's side and digest.
ORACLE = f"""
WITH RECURSIVE c AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc FROM documents),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql("n_chars + 1")} END AS changed FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
lv AS (SELECT tree, 0 AS level, list(leaf ORDER BY i) AS l FROM r GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(1, (len(l) + 1) // 2 + 1), lambda k: sha256(l[2 * k - 1] || coalesce(l[2 * k], ''))) FROM lv WHERE len(l) > 1),
sub AS (SELECT tree, l[1] AS subroot FROM lv WHERE len(l) = 1),
up AS (SELECT 0 AS level, list(subroot ORDER BY tree) AS l FROM sub
  UNION ALL SELECT level + 1, list_transform(range(1, (len(l) + 1) // 2 + 1), lambda k: sha256(l[2 * k - 1] || coalesce(l[2 * k], ''))) FROM up WHERE len(l) > 1),
seen AS (SELECT r.tree, r.i, lv.level, lv.l, r.i >> lv.level AS k FROM r JOIN lv ON r.tree = lv.tree AND len(lv.l) > 1
  UNION ALL SELECT r.tree, r.i, 1000 + up.level, up.l, (r.tree - 1) >> up.level FROM r JOIN up ON len(up.l) > 1),
steps AS (SELECT tree, i, list(CASE WHEN k % 2 = 1 THEN 'L' || l[k] ELSE coalesce('R' || l[k + 2], '-') END ORDER BY level) AS s FROM seen GROUP BY tree, i),
f AS (SELECT r.*, coalesce(s, []) AS s FROM r LEFT JOIN steps USING (tree, i)),
o AS (SELECT doc_id, leaf, subroot, (SELECT l[1] FROM up WHERE len(l) = 1) AS root, sha256(array_to_string(list_transform(s, lambda x: substr(x, 2)), '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(changed, leaf)], s), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN substr(x, 2) || a WHEN 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root FROM f JOIN sub USING (tree))
SELECT *, folded_root = root AS verified FROM o
"""
