"""A trie of conversation prefixes: compacted nodes hashed at two-fattest depths, fat binary search, insertion in batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Shares of the sequences, in sixteenths, that the batches hold: small ones first, so that later ones expand only what is new.
BATCHES = (1, 3, 12)
#: Hash of the empty sequence.
ROOT = md5(b"").digest()
NODE = "parent_depth int, parent binary, depth int, node binary, hashes array<binary>, words array<int>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (turn hash h and words w of its text, in order) of every conversation. Texts stay behind."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("int")
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn"), digest.alias("h"), words.alias("w")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 20, then c's own after its first h; h is crc32(c) % 4."""
    own = written(turns_of(conversations), "turns")
    keep = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = own.filter(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    rows = own.withColumn("h", keep).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    tail = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, tail).alias("turns"))


def prefixes(sequences: DataFrame) -> DataFrame:
    """conv_id, hashes (128 bits of each prefix, the empty one left out), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                last, chain = ROOT, []
                for x in turns:
                    last = md5(last + x).digest()
                    chain.append(last)
                out.append(chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), batch.column(2)], names=["conv_id", "hashes", "words"])

    rows = sequences.select("conv_id", F.col("turns.h").alias("h"), F.col("turns.w").alias("words"))
    return rows.mapInArrow(run, f"conv_id {sequences.schema['conv_id'].dataType.simpleString()}, hashes array<binary>, words array<int>")


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    low = F.length(F.bin(a.bitwiseXOR(b))) - 1  # the highest bit in which they differ
    return F.call_function("shiftleft", F.call_function("shiftright", b, low), low).cast("int")


def hash_at(depth: Column, hashes: str = "hashes") -> Column:
    """Hash of the prefix of that depth (the root's at 0); null beyond the end."""
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.get(F.col(hashes), depth - 1))


def exits(queries: DataFrame, trie: DataFrame, deepest: int) -> DataFrame:
    """Adds at, the depth of the deepest node whose whole string is a prefix of the query, to sequences (hashes).

    Fat binary search: a query asks for a node hashed at the two-fattest depth of its interval. If there is one whose string the query
    begins with, the search goes on below it; if the string differs, the query leaves the trie on that node's edge; if there is none,
    above. Each step is one equi-join; their number is the logarithm of the longest sequence.
    """
    handles = trie.filter("depth > 0").select(fattest(F.col("parent_depth"), F.col("depth")).alias("f"), F.col("parent_depth").alias("up"), F.col("depth").alias("e"), F.col("node").alias("eh"), "hashes")
    handles = written(handles.select("f", F.get("hashes", F.col("f") - F.col("up") - 1).alias("key"), "up", "e", "eh"), "handles")
    now = queries.withColumns({"at": F.lit(0), "to": F.size("hashes")})
    for _ in range(max(1, deepest.bit_length()) + 1):
        asked = now.withColumn("ask", F.when(F.col("at") < F.col("to"), fattest(F.col("at"), F.col("to")))).withColumn("key", hash_at(F.col("ask")))
        met = asked.join(handles, (asked["ask"] == handles["f"]) & (asked["key"] == handles["key"]), "left")
        whole = hash_at(F.col("e")) == F.col("eh")
        at = F.when(F.col("e").isNull(), F.col("at")).when(whole, F.col("e")).otherwise(F.col("up"))
        to = F.when(F.col("ask").isNull(), F.col("to")).when(F.col("e").isNull(), F.col("ask") - 1).when(whole, F.greatest("to", "e")).otherwise(F.col("up"))
        now = met.select(*queries.columns, at.cast("int").alias("at"), to.cast("int").alias("to"))
    return now.drop("to")


def inserted(trie: DataFrame | None, batch: DataFrame, deepest: int) -> DataFrame:
    """The trie with a batch of distinct sequences (hashes, words).

    Each sequence's exit point is located. Edges that sequences leave, or end on, in the middle are split there. What lies below the exit
    points is new: its prefixes are grouped by hash, and those that branch or end become nodes.
    """
    spark = batch.sparkSession
    if trie is None:
        located = batch.withColumns({"at": F.lit(0), "on": F.lit(None).cast("binary"), "leave": F.lit(0)})
        kept = spark.createDataFrame([(-1, None, 0, bytearray(ROOT), [], [])], NODE)
    else:
        below = trie.filter("depth > 0").select(F.get("hashes", F.lit(0)).alias("step"), F.col("node").alias("on"), F.col("hashes").alias("edge"))
        found = exits(batch, trie, deepest).withColumn("next", hash_at(F.col("at") + 1))
        found = found.join(below, found["next"] == below["step"], "left")
        rest = F.slice("hashes", F.col("at") + 1, F.size("edge"))
        alike = F.size(F.filter(F.arrays_zip(rest.alias("a"), F.col("edge").alias("b")), lambda x: x["a"] == x["b"]))  # hashes of prefixes: none is alike after a difference
        located = found.withColumn("leave", F.col("at") + F.when(F.col("on").isNull(), 0).otherwise(alike)).drop("next", "step", "edge")
        kept = trie
    located = written(located.select("hashes", "words", "on", "leave"), "located")
    cuts = located.filter("on IS NOT NULL").groupBy("on").agg(F.collect_set("leave").alias("cuts"))
    old = kept.join(cuts, kept["node"] == cuts["on"], "left").withColumn("ends", F.array_sort(F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth")))))
    old = old.select("parent_depth", "parent", "hashes", "words", F.posexplode("ends").alias("k", "depth"), "ends", F.col("parent_depth").alias("start"))
    since = F.when(F.col("k") == 0, F.col("start")).otherwise(F.get("ends", F.col("k") - 1))
    part = lambda c: F.when(F.col("depth") > 0, F.slice(c, F.col("since") - F.col("start") + 1, F.col("depth") - F.col("since"))).otherwise(F.col(c))
    old = old.withColumn("since", since).select(
        F.col("since").alias("parent_depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.get("hashes", F.col("since") - F.col("start") - 1)).alias("parent"), "depth",
        F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.get("hashes", F.col("depth") - F.col("start") - 1)).alias("node"), part("hashes").alias("hashes"), part("words").alias("words"),
    )

    fresh = located.filter(F.size("hashes") > F.col("leave")).withColumn("tip", F.try_element_at("hashes", F.lit(-1)))
    steps = fresh.select("tip", "leave", F.explode(F.sequence(F.col("leave") + 1, F.size("hashes"))).alias("d"), "hashes")
    steps = steps.select("tip", "leave", "d", F.get("hashes", F.col("d") - 1).alias("h"), F.get("hashes", F.col("d")).alias("next"))
    seen = steps.groupBy("h").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.max(F.col("next").isNull()).alias("ends"), F.min("tip").alias("tip"))
    nodes = seen.filter("ends OR lo <> hi").select("h", F.col("tip").alias("owner"))
    depths = steps.select("tip", "d", "h").join(nodes, "h").groupBy("tip").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("tip") == F.col("owner")).alias("own")))).alias("nodes"))
    new = fresh.join(depths, "tip").select("hashes", "words", "leave", "nodes", F.posexplode("nodes").alias("k", "x")).filter("x.own")
    new = new.withColumn("since", F.when(F.col("k") == 0, F.col("leave")).otherwise(F.get("nodes", F.col("k") - 1)["d"])).withColumn("depth", F.col("x.d"))
    cut = lambda c: F.slice(c, F.col("since") + 1, F.col("depth") - F.col("since"))
    new = new.select(F.col("since").alias("parent_depth"), hash_at(F.col("since")).alias("parent"), "depth", hash_at(F.col("depth")).alias("node"), cut("hashes").alias("hashes"), cut("words").alias("words"))
    return written(old.unionByName(new), "trie")


def build(sequences: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The compacted trie of distinct sequences (a table of hashes, words): a row (``NODE``) for each node that branches or ends a sequence, and the root."""
    deepest = sequences.agg(F.max(F.size("hashes"))).first()[0] or 0
    place = F.pmod(F.xxhash64("hashes"), F.lit(sum(batches)))
    trie, at = None, 0
    for share in batches:
        trie = inserted(trie, sequences.filter((place >= at) & (place < at + share)).select("hashes", "words"), deepest)
        at += share
    return trie


def id_lists(rows: DataFrame) -> DataFrame:
    """tip, ends_sha256: hash of the ascending ids of each tip, as decimals between commas.

    Ids are sorted by range and joined into pieces side by side, so that the one task that must hash a list in order reads pieces,
    as a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tips, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[], [], []]
            for tip, i in zip(tips, ids, strict=True):
                if out[0] and out[0][-1] == tip:
                    out[2][-1].append(str(i))
                else:
                    for c, x in zip(out, (tip, i, [str(i)]), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], batch.column(1).type), pa.array([",".join(x) for x in out[2]], pa.string())], names=["tip", "first", "part"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for tip, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if tip == last:
                    state.update(b"," + part.encode())
                    continue
                if state:
                    out[0].append(last)
                    out[1].append(state.hexdigest())
                last, state = tip, sha256(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["tip", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["tip", "ends_sha256"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = rows.select("tip", "conv_id").repartitionByRange("tip", "conv_id").sortWithinPartitions("tip", "conv_id").mapInArrow(join, f"tip binary, first {kind}, part string")
    return parts.repartition("tip").sortWithinPartitions("tip", "first").mapInArrow(hashed, "tip binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """A row for each node of the trie of sequences (conv_id, turns), edges expanded: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one path first. The root has depth 0 and no parent, even where no sequence is empty. A sequence without turns is a
    member of the root alone. No sequences give no rows.

    Scale: turns travel as 128-bit hashes. Batches are located by equi-joins; nothing is collected by node but the split points of an
    edge. Counts and sums below a node are map-side sums over the distinct sequences' nodes.
    """
    each = prefixes(sequences).withColumn("tip", F.coalesce(F.try_element_at("hashes", F.lit(-1)), F.lit(ROOT)))
    each = written(each, "prefixes")
    distinct = each.groupBy("tip").agg(F.count(F.lit(1)).alias("k"), F.min("conv_id").alias("least"), F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    distinct = written(distinct, "sequences")
    trie = build(distinct.filter("size(hashes) > 0"), batches)
    if distinct.isEmpty():
        trie = trie.filter("false")

    # nodes on each sequence's path; the root is on all and needs no join
    steps = distinct.select("tip", "k", "least", F.posexplode("hashes").alias("i", "h")).join(trie.filter("depth > 0").select(F.col("node").alias("h")), "h")
    steps = steps.select("tip", "k", "least", (F.col("i") + 1).alias("d"), F.col("h").alias("node")).unionByName(distinct.select("tip", "k", "least", F.lit(0).alias("d"), F.lit(ROOT).alias("node")))
    steps = written(steps, "steps")
    members = steps.groupBy("node").agg(F.sum("k").alias("n_convs"), F.min("least").alias("conv_id"), F.min_by("tip", "least").alias("owner"))
    children = trie.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(members.join(children, "node", "left").fillna(0, ["n_children"]), "members")

    # a sequence owns the end of its path from the last node on that a smaller conversation has
    path = steps.join(nodes.select("node", "owner", "n_children"), "node").groupBy("tip").agg(
        F.max(F.when(F.col("owner") != F.col("tip"), F.col("d")).otherwise(-1)).alias("shared"), F.max(F.when(F.col("node") == F.col("tip"), F.col("n_children") == 0)).alias("leaf"), F.collect_list(F.struct("d", "node")).alias("path"))
    path = distinct.join(path, "tip").select("k", "words", "shared", "leaf", F.explode("path").alias("x")).select("k", "words", "shared", "leaf", "x.d", "x.node")
    after = lambda c: F.aggregate(F.slice("words", c + 1, F.greatest(F.size("words") - c, F.lit(0))), F.lit(0).cast("bigint"), lambda a, w: a + w)
    sums = path.groupBy("node").agg(F.sum(F.col("k") * after(F.col("d")) - after(F.greatest("d", "shared"))).alias("below"), F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"))
    ended = id_lists(each)

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_id"))
    full = trie.join(nodes, "node").join(sums, "node").join(ended.withColumnRenamed("tip", "node"), "node", "left").join(parents, "parent", "left")
    out = full.withColumn("j", F.explode(F.when(F.col("depth") > 0, F.sequence(F.col("parent_depth") + 1, F.col("depth"))).otherwise(F.array(F.lit(0)))))
    end, first = F.col("j") == F.col("depth"), F.col("j") == F.col("parent_depth") + 1
    i = F.col("j") - F.col("parent_depth")
    edge = F.when(F.col("depth") > 0, F.aggregate(F.slice("words", i, F.size("words") - i + 1), F.lit(0).cast("bigint"), lambda a, w: a + w)).otherwise(0)
    empty = F.lit(sha256(b"").hexdigest())
    return out.select(
        "conv_id", F.col("j").cast("bigint").alias("depth"), F.when(F.col("j") == 0, None).when(first, F.col("parent_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * edge).alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a conv_id belong to no conversation. Turns with one number are ordered by role and text."""
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = r"""
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 4 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
s AS (SELECT o.conv_id AS c, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT c, d, l[1:d] AS k, len(l) AS m, CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(l[d].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS w FROM s, unnest(range(0, len(l) + 1)) AS u(d)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = m), '') AS ends FROM p GROUP BY k, d),
ch AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.k = ch.k AND n.d = ch.d),
a AS (SELECT k[1:u.a] AS k, u.a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM f, unnest(range(0, d + 1)) AS u(a) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a ON f.k = a.k AND f.d = a.d LEFT JOIN n AS up ON f.d > 0 AND up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]
"""
