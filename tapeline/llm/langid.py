"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket, documents, text_batches

#: n-grams of a profile; their longest length.
PROFILE, LONGEST = 300, 3
#: Sharpness of the score: how fast a language's weight falls with its distance.
SHARPNESS = 40.0
#: Symbols for what isn't a letter; characters of texts that are counted at once; distances that are held at once.
EDGE, CHARS, CELLS = 1, 100_000, 1_000_000
UND = "und"
#: A document is rejected when no language's profile is nearer than this share of the largest distance.
FAR = 0.97

_symbols = np.full(0x110000, -1, np.int32)  # by code point: itself if it is a letter, else EDGE; -1: not looked up yet


def symbols(codes: np.ndarray) -> np.ndarray:
    got = _symbols[codes]
    if (got < 0).any():
        for c in np.unique(codes[got < 0]).tolist():
            _symbols[c] = c if chr(c).isalpha() else EDGE
        got = _symbols[codes]
    return got


def gram_counts(texts: list[str], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count) of the n-grams of lower-cased texts, sorted by owner and gram. owners: a small number for each text.

    A gram is up to three symbols of 21 bits. Letters stand for themselves, a run of other characters is one edge; grams of two and
    three symbols may begin or end with an edge.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(owners, np.fromiter(map(len, low), np.int64, len(low)) + 1)
    sym = symbols(codes)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != EDGE) | (sym[:-1] != EDGE) | (owner[1:] != owner[:-1])
    sym, owner = sym[keep], owner[keep]
    seen = np.zeros(max(EDGE, int(sym.max(initial=0))) + 1, bool)
    seen[sym] = seen[EDGE] = True
    alphabet = np.flatnonzero(seen)
    dense = np.zeros(len(seen), np.int64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)  # EDGE is the smallest: 1
    x = np.concatenate([[1], dense[sym]])  # an edge before the first text
    owner = np.concatenate([owner[:1], owner])
    bits = int(len(alphabet)).bit_length()
    own = owner.astype(np.int64) << 3 * bits
    letter = x > 1
    same = owner[1:] == owner[:-1]
    before = np.where(same, x[:-1], 1)  # what precedes a text is an edge
    one = (own + x)[letter]
    two = (own[1:] + (before << bits) + x[1:])[letter[1:] | (before > 1)]
    before2 = np.where(same[:-1], x[:-2], 1)
    three = (own[2:] + (before2 << 2 * bits) + (x[1:-1] << bits) + x[2:])[letter[1:-1] & same[1:]]
    keys = np.concatenate([one, two, three])
    top = (int(owners.max(initial=0)) + 1) << 3 * bits
    if top <= 2 * len(keys):
        n = np.bincount(keys, minlength=0)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        keys = np.sort(keys.astype(np.uint32) if top <= 1 << 32 else keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        found = keys[first].astype(np.int64)
    mask = (1 << bits) - 1
    to = np.concatenate([[0], alphabet]).astype(np.int64)
    gram = to[(found >> 2 * bits) & mask] << 42 | to[(found >> bits) & mask] << 21 | to[found & mask]
    return found >> 3 * bits, gram, n


def batches(frames: Iterator[pd.DataFrame], column: str, most: int = 1024) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``CHARS`` characters of text and at most ``most`` rows."""
    for frame in frames:
        size = frame[column].map(len).to_numpy()
        part = np.cumsum(size) // CHARS + np.arange(len(size)) // most * (1 << 32)
        for _, rows in frame.groupby(part, sort=False):
            yield rows


def learn_profiles(rows: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, n, rank (from 0) of each language's ``size`` most frequent n-grams; rows: (lang, text), all of them counted.

    Each task counts in vectors and gives one row per language and gram for every batch; Spark sums them. Ties are
    ordered by gram. The result has at most ``size`` rows a language.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, "text"):
            names, codes = np.unique(part["lang"].to_numpy(object).astype(str), return_inverse=True)
            owner, gram, n = gram_counts(part["text"].tolist(), codes)
            yield pd.DataFrame({"lang": names[owner], "gram": gram, "n": n})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return summed.withColumn("rank", rank).filter(F.col("rank") < size)


class Profiles:
    """Ranks of n-grams in every language's profile: for each gram, the languages that have it and its rank there.

    ``size`` entries a language, however many languages there are.
    """

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        gram = np.array([r[1] for r in rows], np.int64)
        order = np.argsort(gram, kind="stable")
        self.grams, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(rows))
        self.lang = np.array([at[r[0]] for r in rows], np.int32)[order]
        self.rank = np.array([r[2] for r in rows], np.int32)[order]

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language, as a share of the largest one; and whether it has a letter."""
        owner, gram, n = gram_counts(texts, np.arange(len(texts)))
        order = np.lexsort((gram, -n, owner))
        owner, gram = owner[order], gram[order]
        begin = np.searchsorted(owner, np.arange(len(texts)))
        place = np.arange(len(owner)) - begin[owner]
        top = place < self.size
        owner, gram, place = owner[top], gram[top], place[top]
        size = np.bincount(owner, minlength=len(texts))
        at = np.searchsorted(self.grams, gram).clip(max=max(0, len(self.grams) - 1))
        known = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        owner, place, at = owner[known], place[known], at[known]
        k = self.first[at + 1] - self.first[at]  # profiles that hold the gram
        each = np.repeat(np.arange(len(at)), k)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k) + self.first[at][each]
        saved = self.size - np.abs(self.rank[entry] - place[each])  # a gram that a profile lacks costs ``size``
        cell = owner[each] * len(self.langs) + self.lang[entry]
        total = np.bincount(cell, saved, len(texts) * len(self.langs)).reshape(len(texts), -1)
        return (size[:, None] * self.size - total) / np.maximum(1, size * self.size)[:, None], size > 0


def tagger(profiles: Profiles):
    """A function of a text column (without nulls) to lang_pred, score and distance."""

    @F.pandas_udf("lang_pred string, score double, distance double")
    def tag(texts: pd.Series) -> pd.DataFrame:
        out = []
        for part in batches(iter([texts.to_frame("t")]), "t", min(1024, max(1, CELLS // max(1, len(profiles.langs))))):
            pred, score, dist = np.full(len(part), UND, object), np.zeros(len(part)), np.ones(len(part))
            if profiles.langs:
                d, letters = profiles.distances(part["t"].tolist())
                best = d.argmin(axis=1)
                low = d[np.arange(len(d)), best]
                share = 1 / np.exp(-SHARPNESS * (d - low[:, None])).sum(axis=1)
                pred[letters] = np.array(profiles.langs, object)[best[letters]]
                score[letters], dist[letters] = share[letters], low[letters]
            out.append(pd.DataFrame({"lang_pred": pred, "score": score, "distance": dist}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "distance": []})

    return tag


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, distance of every row. Null texts and texts without a letter are ``und`` with score 0 and distance 1,
    and so is everything if no language was learned. The score is the nearest language's share of weights that fall with distance.
    Equal distances go to the first language in order of name. Only the text is looked at; other columns are ignored."""
    tag = tagger(profiles)
    return df.select(id_col, tag(F.coalesce(F.col(text_col), F.lit(""))).alias("_tag")).select(id_col, "_tag.*")


def fit(docs: DataFrame, id_col: str = "doc_id") -> Profiles:
    """Profiles of the languages in ``lang``, learned from the rows outside the held-out quarter (crc32 of the id mod 4 is 2).

    Null texts and languages teach nothing. There may be any number of languages; the driver holds a profile of each.
    """
    rows = docs.filter((bucket(F.col(id_col), 4) != 2) | F.col(id_col).isNull()).filter("lang is not null and text is not null")
    return Profiles([tuple(r) for r in learn_profiles(rows).select("lang", "gram", "rank").collect()])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = (bucket(F.col("doc_id"), 4) == 2).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "distance")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those that have no letter (null and empty texts too) or resemble none of the learned languages.

    Where no document names a language, nothing was learned and all documents with a letter stay. Ids play no part but in ``fit``.
    """
    text_batches(spark)
    profiles = fit(docs)
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    tag = tagger(profiles)(F.coalesce("text", F.lit("")))
    return docs.filter((tag["lang_pred"] != UND) & (tag["distance"] < FAR))  # row by row: nothing is shuffled
