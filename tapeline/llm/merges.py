"""BPE encoding with seeded merge-dropout, in vectors, for SentencePiece vocabularies."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, through_python

SPACE = "▁"
#: Share of candidate merges that are skipped, and the key of the hash.
DROPOUT, SEED = 0.1, 42
#: Characters whose agendas run side by side.
CHARS = 150_000
LATE = np.int64((1 << 31) - 1)  # order of a pair that doesn't merge
#: Words of more characters have a heap of their own instead of a place in the vectors.
LONG = 512
WORD64 = (1 << 64) - 1


def mix_int(x: int) -> int:
    """``mix`` of one integer."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD64
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a BPE model with byte fallback, as arrays."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_ids = np.zeros(256, np.int64)
        usable = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                usable[p] = i
        raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw = raw
        self.char = np.full(0x110000, -1, np.int64)  # id of a character, -1: bytes
        for p, i in usable.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.char[ord(SPACE)]
        self.char[ord(SPACE)] = -1  # the sign itself is spelled in bytes, so that it comes back
        pairs = {}
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = usable.get(p[:k]), usable.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        #: Ids by falling score, and each id's place there.
        self.by_rank = np.array(sorted(range(n), key=lambda i: (-sp.get_score(i), i)), np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.by_rank] = np.arange(n)
        self.bits = max(16, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        left = np.array(list(pairs), np.int64)
        value = np.array(list(pairs.values()), np.int64)
        at = self._slot(left)
        while len(left):  # open addressing, all keys at once
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]
            placed = self.keys[at] == left
            self.values[at[placed]] = value[placed]
            left, value, at = left[~placed], value[~placed], (at[~placed] + 1) & (1 << self.bits) - 1
        self.pairs = pairs
        self.breaks_after_space = not any(SPACE in p.lstrip(SPACE) for p in usable)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs merge to, -1 without one."""
        key = a << 32 | b
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            got = self.keys[at]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (got >= 0)
            todo, at = todo[on], (at[on] + 1) & (1 << self.bits) - 1
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(texts: list[str], keys: np.ndarray, vocab: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each text has). keys: a 64-bit key for each text.

    A text begins with a space that decoding removes, as the model's own encoder has it. It falls into words (a space and what
    follows it) that no piece crosses. Every word has an agenda of candidate merges, best rank first and then leftmost; all words
    take their first candidate at once. A candidate is skipped if the hash of (seed, text's key, its place in the text, the piece
    it would make) falls below ``dropout``; skipped ones return only as parts of new pairs. Each word's merges are those that its
    agenda alone would make, so neither the batch nor the partition matters. Without dropout the ids are the model's own.
    """
    coded = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), "<u4") if t else np.empty(0, "<u4") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    codes = np.concatenate(coded) if coded else np.empty(0, "<u4")
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sym = vocab.char[codes]
    # a word starts where a space follows another character, and with each text
    space = codes == 32
    starts = np.ones(len(codes), bool)
    if len(codes):
        starts[1:] = (space[1:] & ~space[:-1] & vocab.breaks_after_space) | (text[1:] != text[:-1])
    other = np.flatnonzero(sym < 0)  # characters without a piece: bytes, never merged
    done_place, done_sym = [], []
    limit = np.uint64(min(int(dropout * 2.0**64), (1 << 64) - 1))
    key = mix(mix(np.asarray(keys, np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))

    # symbols of all unfinished words: piece, place in the batch, whether it ends its word, and the order of the merge with the next
    s, at = sym.copy(), np.arange(len(codes))
    first = np.flatnonzero(starts) if len(codes) else np.empty(0, np.int64)
    for w in np.flatnonzero(np.diff(np.append(first, len(codes))) > LONG):
        a = int(first[w])
        b = int(first[w + 1]) if w + 1 < len(first) else len(codes)
        where, got = merge_word(vocab, s[a:b].tolist(), int(place[a]), int(key[text[a]]), int(limit) if dropout > 0 else 0)
        done_place.append(a + where)
        done_sym.append(got)
    if done_place:
        short = np.repeat(np.diff(np.append(first, len(codes))) <= LONG, np.diff(np.append(first, len(codes))))
        s, at, starts = s[short], at[short], starts[short]
    end = np.append(starts[1:], True) if len(s) else np.empty(0, bool)
    first = np.flatnonzero(starts) if len(s) else np.empty(0, np.int64)
    turn = next_merge(vocab, s, np.arange(len(s)), end)
    while len(s):
        best = np.minimum.reduceat(turn << 32 | np.arange(len(s)), first)  # the smallest rank of each word, then the leftmost
        has = best >> 32 < LATE
        i = best[has] & (1 << 32) - 1
        new = vocab.by_rank[turn[i]]
        keep = np.ones(len(s), bool)
        if len(i) < len(first):  # words without candidates are finished
            over = np.repeat(~has, np.diff(np.append(first, len(s))))
            done_place.append(at[over])
            done_sym.append(s[over])
            keep[over] = False
        if dropout > 0:
            where = at[i]
            h = mix(key[text[where]] + mix((place[where].astype(np.uint64) << np.uint64(20)) ^ new.astype(np.uint64)))
            skip = h < limit
            turn[i[skip]] = LATE
            i, new = i[~skip], new[~skip]
        s[i] = new
        end[i] = end[i + 1]
        keep[i + 1] = False
        where = np.cumsum(keep) - 1
        s, at, end, turn, first = s[keep], at[keep], end[keep], turn[keep], where[first[has]]
        left = where[i]
        before = left[left > 0] - 1
        touched = np.concatenate([left, before[~end[before]]])
        turn[touched] = next_merge(vocab, s, touched, end)
    place_all = np.concatenate(done_place) if done_place else np.empty(0, np.int64)
    sym_all = np.concatenate(done_sym) if done_sym else np.empty(0, np.int64)
    sort = np.argsort(place_all, kind="stable")
    place_all, sym_all = place_all[sort], sym_all[sort]
    counts = np.ones(len(sym_all), np.int64)
    if len(other):
        spelled = {c: vocab.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in np.unique(codes[other]).tolist()}
        bad = np.flatnonzero(sym_all < 0)
        parts = [spelled[c] for c in codes[place_all[bad]].tolist()]
        counts[bad] = [len(p) for p in parts]
        out = np.repeat(sym_all, counts)
        begin = np.cumsum(counts) - counts
        out[np.concatenate([np.arange(b, b + len(p)) for b, p in zip(begin[bad].tolist(), parts, strict=True)])] = np.concatenate(parts)
    else:
        out = sym_all
    return out, np.bincount(text[place_all], counts, len(texts)).astype(np.int64) if len(texts) else np.empty(0, np.int64)


def merge_word(vocab: Vocabulary, s: list[int], begin: int, key: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pieces) of one word's agenda, as a heap of (order, place): time grows with its length times the logarithm of it."""
    n, pairs, order = len(s), vocab.pairs, vocab.order.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int, j: int) -> int:
        made = pairs.get(s[i] << 32 | s[j], -1) if s[i] >= 0 and s[j] >= 0 else -1
        return order[made] if made >= 0 else -1

    turn = [rank(i, i + 1) for i in range(n - 1)] + [-1]
    heap = [t << 32 | i for i, t in enumerate(turn) if t >= 0]
    heapq.heapify(heap)
    names = vocab.by_rank.tolist()
    while heap:
        top = heapq.heappop(heap)
        i, t = top & 0xFFFFFFFF, top >> 32
        if turn[i] != t:  # its pair is another one by now
            continue
        new = names[t]
        if limit and mix_int((key + mix_int((begin + i) << 20 ^ new)) & WORD64) < limit:
            turn[i] = -1
            continue
        j = after[i]
        s[i], s[j], turn[j] = new, -2, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                turn[a] = r = rank(a, b)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | a)
            elif a >= 0:
                turn[a] = -1
    got = np.array(s, np.int64)
    where = np.flatnonzero(got != -2)
    return where, got[where]


def next_merge(vocab: Vocabulary, s: np.ndarray, i: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of what the symbols at ``i`` and the next ones of their words merge to; LATE if they don't."""
    out = np.full(len(i), LATE)
    ok = ~end[i]
    a, b = s[i[ok]], s[i[ok] + 1]
    both = (a >= 0) & (b >= 0)
    ok[ok] = both
    got = vocab.merged(a[both], b[both])
    out[ok] = np.where(got >= 0, vocab.order[got], LATE)
    return out


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; any segmentation of a text gives it back."""
    raw = b"".join(map(vocab.raw.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def parts(frame: pd.DataFrame, chars: int = CHARS) -> Iterator[pd.DataFrame]:
    size = frame["t"].map(len).to_numpy()
    for _, rows in frame.groupby(np.cumsum(size) // chars, sort=False):
        yield rows


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """id, ids (array of int) of every row's whole text; null is an empty text and has no ids.

    The key of a text is a hash of its id and its length in characters, so a run can be repeated and documents differ from each
    other; rows that repeat have equal ids. Other columns are ignored. The model's path is a parameter; every worker reads it.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for frame in frames:
            for p in parts(frame):
                ids, counts = encode(p["t"].tolist(), p["key"].to_numpy(np.int64).view(np.uint64), vocab, dropout, seed)
                yield pd.DataFrame({"id": p["id"].array, "ids": np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(F.col(id_col), F.length(text)).alias("key"))
    return through_python(rows, run, "ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id, ids' count, crc32 of the ids (little-endian unsigned 32-bit), text. No ids give an empty text; rows map to rows one by one."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for f in frames:
            for at in range(0, len(f), 512):
                p = f.iloc[at : at + 512]
                ids = [np.asarray(x, "<u4") for x in p["ids"]]
                yield pd.DataFrame({"id": p["id"].array, "n_ids": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "text": [decode(x, vocab) for x in ids]})

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return through_python(rows, run, "n_ids bigint, ids_crc32 bigint, text string").withColumnRenamed("id", id_col)


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, and the SHA-256 and length of the text that the ids decode to."""
    back = decode_documents(encode_documents(documents(spark, sf_dir)))
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("decoded_chars"))
