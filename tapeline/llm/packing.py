"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, text_batches, through_python, written

CAPACITY, END = 1024, 2
#: Longer pieces are large: they are grouped. Each bound is tried, and the plan with the fewest sequences taken. All are below half a sequence, so large pieces always meet in configurations.
SMALL = (64, 128, 160, 192, 224, 256, 320, 384)
GROUPS = 64  # of large pieces, hence sizes in a configuration
#: Strings that are one token wherever they stand in a text, as the vocabulary's JSON file lists them.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that one window ranks.
RANK_ROWS = 512


@lru_cache(maxsize=2)
def encoder(name: str) -> tiktoken.Encoding:
    """The byte-level BPE vocabulary as ranks: the same ids as its JSON file gives, several times as fast."""
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id, piece, start, length, ids_crc32: the token ids of each text and an end id, cut into at most 1024."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(encoder(vocabulary).encode, allowed_special="all")
        for frame in frames:
            out = []
            for ident, text in zip(frame["id"].array, frame["t"], strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                out += [(ident, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids)))]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return through_python(rows, run, "piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Runs of bins with equal contents: (count, first sequence, fill, [(length, first rank)])."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.next = capacity, defaultdict(list), 0

    def open(self, count: int) -> tuple:
        self.next += count
        return count, self.next - count, 0, []

    def put(self, run: tuple) -> None:
        self.by_room[self.capacity - run[2]].append(run)

    @staticmethod
    def split(run: tuple, count: int) -> tuple[tuple, tuple]:
        """The first ``count`` bins of a run, and the others."""
        n, seq, fill, items = run
        return (count, seq, fill, items), (n - count, seq + count, fill, [(s, r + count) for s, r in items])

    @staticmethod
    def add(run: tuple, length: int, rank: int) -> tuple:
        return run[0], run[1], run[2] + length, [*run[3], (length, rank)]


def group_lengths(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Linear grouping: lengths in falling order are dealt to groups of equal cardinality; each length's group is its largest length."""
    total, seen, out, top = sum(counts.values()), 0, {}, {}
    for s in sorted(counts, reverse=True):
        g = seen * groups // total
        out[s] = top.setdefault(g, s)
        seen += counts[s]
    return out


def fullest(demand: dict[int, int], capacity: int) -> dict[int, int]:
    """The configuration of sizes with the largest total up to ``capacity`` that has the largest size: subset sums, no size more often than demanded."""
    top = max(demand)
    best = np.full(capacity - top + 1, -1, np.int32)  # size used last to reach a total
    best[0] = 0
    for s in sorted((x for x in demand if x <= capacity - top), reverse=True):
        for _ in range(min(demand[s] - (s == top), (capacity - top) // s)):
            to = np.flatnonzero(best[: len(best) - s] >= 0) + s
            to = to[(best[to] < 0)]
            if not len(to):
                break
            best[to] = s
        if best[-1] >= 0:
            break
    at, used = int(np.flatnonzero(best >= 0)[-1]), defaultdict(int)
    used[top] += 1
    while at:
        used[int(best[at])] += 1
        at -= int(best[at])
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: tuple[int, ...] = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over the bounds ``small``."""
    return min((group_and_fit(counts, capacity, s, groups) for s in small), key=lambda runs: max((r[3] + r[2] for r in runs), default=0))


def group_and_fit(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of runs of pieces, from how many pieces have each length.

    Large lengths are dealt to few groups of equal cardinality; a group's size, to which all its lengths are rounded up, is the largest
    length that it still has. The fullest configuration of these sizes with the largest one is taken for as many bins as the largest
    lengths of its groups last. Actual lengths take the places of the sizes: the largest of the group, in the last place the largest
    of any group that fits. What is left is rounded up anew. Then the small lengths, largest first, go where the least room is left.
    Everything works on counts, at most ``capacity`` of them, so neither time nor the plan's size grows with the number of pieces.
    """
    bins, ranks = Bins(capacity), dict.fromkeys(counts, 0)
    alone = capacity - min(counts, default=0)  # nothing goes beside a longer piece
    for s in (x for x in counts if x > alone):
        bins.put(bins.add(bins.open(counts[s]), s, 0))
    large = {s: n for s, n in counts.items() if small < s <= alone}
    group_of = group_lengths(large, groups)

    def fill(run: tuple, length: int) -> tuple[tuple, tuple]:
        part, rest = bins.split(run, min(large[length], run[0]))
        part = bins.add(part, length, ranks[length])
        ranks[length] += part[0]
        large[length] -= part[0]
        if not large[length]:
            del large[length]
        return part, rest

    while large:
        members = defaultdict(list)
        for s in sorted(large, reverse=True):
            members[group_of[s]].append(s)
        use = fullest({x[0]: sum(large[s] for s in x) for x in members.values()}, capacity)
        runs = [bins.open(max(1, min(large[s] // k for s, k in use.items())))]
        places = [s for s, k in sorted(use.items(), reverse=True) for _ in range(k)]
        for at, s in enumerate(places):
            last, filled = at == len(places) - 1, []
            for run in runs:
                while run[0]:
                    fits = capacity - run[2]
                    part, run = fill(run, max(x for x in large if (x <= fits if last else group_of[x] == group_of[s])))
                    filled.append(part)
            runs = filled
        for run in runs:
            bins.put(run)
    for s in sorted((x for x in counts if x <= min(small, alone)), reverse=True):
        left = counts[s]
        while left:
            room = min((r for r, x in bins.by_room.items() if r >= s and x), default=None)
            run = bins.by_room[room].pop() if room else bins.open(-(-left // (capacity // s)))
            n = min(left, run[0])
            part, rest = bins.split(run, n)
            if rest[0]:
                bins.put(rest)
            bins.put(bins.add(part, s, ranks[s]))
            ranks[s] += n
            left -= n
    out = []
    for runs in bins.by_room.values():
        for n, seq, _, items in runs:
            offset = 0
            for s, r in items:
                out.append((s, r, n, seq, offset))
                offset += s
    return sorted(out)


def pack(df: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """The rows of ``df`` (a table on disk with ``length``, from 1 to ``capacity``) with sequence_id and offset.

    The driver sees only how many pieces have each length. Pieces of a length are numbered within hashed buckets of about 500,
    so no length, however common, is one task's; a length has as many buckets as its count asks for. Each number has its place in
    the plan, a list of some thousand runs that every task looks up. Rows that repeat are packed as often as they occur; an
    empty table gives an empty result.
    """
    counts = {int(r["length"]): r["n"] for r in df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    buckets = F.element_at(F.lit([-(-counts.get(n, 1) // RANK_ROWS) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(*order), buckets))
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1)
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    ranked = ranked.join(sizes.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    span = max(counts.values(), default=0) + 1
    starts = runs[:, 0] * span + runs[:, 1]

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = (frame["before"] + frame["k"]).to_numpy(np.int64)
            run = runs[np.searchsorted(starts, frame["length"].to_numpy(np.int64) * span + rank, "right") - 1]
            out = frame.drop(columns=["bucket", "before", "k"])
            yield out.assign(sequence_id=run[:, 3] + rank - run[:, 1], offset=run[:, 4])

    ids = tuple(f.name for f in df.schema if f.name != "length")
    return through_python(ranked.select(*ids, "length", "bucket", "before", "k"), look_up, "length bigint, sequence_id bigint, offset bigint", ids).select(*df.columns, "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty: their end id is packed."""
    return pack(written(pieces(docs), "pieces")).withColumnRenamed("id", "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. Null and empty texts are one end id; rows that repeat are packed as often as they occur; a null
    id stays null; no documents give no pieces."""
    text_batches(spark)
    return pack_documents(docs)
