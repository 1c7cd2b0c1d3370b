"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, discard, documents, maybe_listed, text_batches, text_key, through_python, written
from .simhash import shingle_hashes, split_words

#: Most texts with a vote, and as many without one, that the classifier is fitted on.
SAMPLE = 30_000
#: Lexicon: share of toxic texts among those with a token; expected number of tokens that chance puts in, and into the voters of weak tokens; letters of a beginning.
PRECISION, CHANCE, WEAK_CHANCE, BEGINNING = 0.9, 0.01, 3, 5
#: Marks weak tokens; no token has it.
WEAK = "?"
#: How much the labelled rates weigh beside those that each round finds in the votes. Without any, rates drift from the true ones.
ANCHOR = 0.5
STRIPES = 10  # voters that the words are dealt to, and as many for beginnings
THRESHOLD = 0.7
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

# Common insults of four languages.
SEEDS = """idiot moron stupid scum loser trash worthless pathetic disgusting clown imbecile
dumm dummkopf trottel abschaum versager widerlich
imbécile connard crétin salaud débile
imbécil estúpido basura asqueroso inútil""".split()

#: Pattern voters: a name and what makes the text a match.
PATTERNS = {
    "seeds": re.compile(rf"(?<!\w)(?:{'|'.join(SEEDS)})(?!\w)"),
    "masked": re.compile(r"[a-z][*@#$%]{1,4}[a-z]"),
    "leet": re.compile(r"(?<![a-z0-9])[a-z]+[013457]+[a-z]+(?![a-z0-9])"),
    "stretched": re.compile(r"([a-z])\1{3}"),
    "address": re.compile(r"(?<!\w)you(?:r| are|'re) (?:a |an |all |such )?\w+"),
    "shouting": re.compile(r"!{2,}"),
    "spelled": re.compile(r"(?<!\w)(?:[a-z][ .\-]){4,}[a-z](?!\w)"),
}
N_VOTERS = 2 * STRIPES + len(PATTERNS) + 2  # weak words and weak beginnings are the last two


def stripe(token: str) -> int:
    return zlib.crc32(token.encode()) % STRIPES


def distinct_words(rows: DataFrame) -> DataFrame:
    """The rows with ``words``, the distinct words (of letters) of the lower-cased text, space-joined, and ``sig``, its smallest hash of four
    words in a row, instead of the text: fewer bytes where rows meet their labels. Rows without a text go."""
    words = F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))), " ")
    rows = rows.filter("text is not null").withColumns({"words": words, "w": split_words(F.col("text"))})
    return rows.withColumn("sig", F.coalesce(F.array_min(shingle_hashes("w", 4)), F.lit(0).cast("bigint"))).drop("w", "text")


def tokens_column():
    """The distinct words and beginnings of words, marked by ``*``, of ``words``."""
    w = F.array_remove(F.split("words", " "), "")
    long = F.filter(w, lambda x: F.length(x) > BEGINNING)
    return F.concat(w, F.array_distinct(F.transform(long, lambda x: F.concat(F.substring(x, 1, BEGINNING), F.lit("*")))))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows to learn from, one each; conflicting labels count as toxic. Rows whose crc32 of doc_id mod 3 is 1 are held out."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(bucket(F.col("doc_id"), 3) != 1)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Tokens that stand in toxic texts far more often than chance lets expect; labelled: (toxic, words, sig) by ``distinct_words``, all of them counted.

    Texts whose smallest hashes of four words in a row are equal count once, so that near copies of a text don't make its words toxic; other
    texts hardly share four words. A token needs at least ``PRECISION`` of its texts toxic, and evidence (count times divergence from the
    base rate) that leaves ``CHANCE`` tokens expected by chance among all tokens. Tokens with less evidence, of which ``WEAK_CHANCE`` are expected by
    chance, are marked ``WEAK``: they vote apart, so that the label model gives them an accuracy of their own.
    """
    rows = written(labelled.select("toxic", tokens_column().alias("tokens"), "sig"), "toxic-labelled")
    sigs = written(rows.groupBy("toxic", "sig").agg(F.count(F.lit(1)).alias("n")), "toxic-sigs")
    sizes = {r["toxic"]: r["count"] for r in sigs.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        discard(rows, sigs)
        return []
    repeated = written(sigs.filter("n > 1").select(F.xxhash64("toxic", "sig").alias("key")), "toxic-repeated")
    again = maybe_listed(rows.withColumn("key", F.xxhash64("toxic", "sig")), "key", repeated, "key")

    def text_counts(k: int, name: str, among: DataFrame | None = None) -> DataFrame:
        """token and in how many texts it stands: all of them, added up before they move, without what repeated hashes count too often.
        With ``among``, a bitmap leaves out most tokens that are not there before any is counted."""

        def each(of: DataFrame) -> DataFrame:
            out = of.filter(F.col("toxic") == k).select("sig", F.explode("tokens").alias("token"))
            if among is None:
                return out
            keys = among.select(F.xxhash64("token").alias("key"))
            return maybe_listed(out.withColumn("key", F.xxhash64("token")), "key", keys, "key").drop("key")

        every = each(rows).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        more = each(again).groupBy("sig", "token").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
        more = more.groupBy("token").agg(F.sum("more").alias("more"))
        return every.join(more, "token", "left").select("token", (F.col("n") - F.coalesce("more", F.lit(0))).alias(name))

    found = written(text_counts(1, "k"), "toxic-tokens")
    many = found.filter("k >= 4")
    both = many.join(text_counts(0, "c", many), "token", "left").withColumn("n", F.col("k") + F.coalesce("c", F.lit(0)))
    base, n = bad / (bad + good), max(found.count(), 1)
    need, least = math.log(n / CHANCE), math.log(n / WEAK_CHANCE)
    q = F.col("k") / F.col("n")
    gain = F.col("k") * F.log(q / base) + F.when(q < 1, (F.col("n") - F.col("k")) * F.log((1 - q) / (1 - base))).otherwise(0.0)
    best = both.filter((F.col("k") / (F.col("n") + 0.1) >= PRECISION) & (gain >= least))
    best = best.select(F.when(gain >= need, F.col("token")).otherwise(F.concat(F.lit(WEAK), "token")).alias("token"))
    out = sorted(r["token"] for r in best.collect())
    discard(rows, sigs, repeated, found)
    return out


class Voters:
    """Which voters vote "toxic" on a text, as bits; and a few amounts for the classifier."""

    AMOUNTS = ("found", "share", "length")

    def __init__(self, lexicon: list[str]) -> None:
        place = lambda t, first, weak: weak if t.startswith(WEAK) else first + stripe(t)
        self.words = {t.removeprefix(WEAK): place(t, 0, N_VOTERS - 2) for t in lexicon if not t.endswith("*")}
        self.beginnings = {t[:-1].removeprefix(WEAK): place(t, STRIPES, N_VOTERS - 1) for t in lexicon if t.endswith("*")}

    def __call__(self, text: str) -> tuple[int, int, int, int]:
        """votes, words found, words with a found beginning, words."""
        low = text.lower()
        all_words = re.findall(WORD, low)
        words = set(all_words)
        hits = words & self.words.keys()
        begin = {w[:BEGINNING] for w in words if len(w) > BEGINNING} & self.beginnings.keys()
        votes = 0
        for w in hits:
            votes |= 1 << self.words[w]
        for b in begin:
            votes |= 1 << self.beginnings[b]
        for k, p in enumerate(PATTERNS.values()):
            if p.search(low):
                votes |= 1 << 2 * STRIPES + k
        return votes, len(hits), len(begin), len(all_words)


def vote(df: DataFrame, lexicon: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, votes (a bit for each voter), hits, begins, words of every row; null is an empty text."""
    voters = Voters(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [voters(t or "") for t in f["t"]]
            yield pd.concat([f[["id", "text_key"]].reset_index(drop=True), pd.DataFrame(got, columns=["votes", "hits", "begins", "words"], dtype=np.int64)], axis=1)

    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    return through_python(rows, run, "text_key bigint, votes bigint, hits bigint, begins bigint, words bigint")


def vote_rows(docs: DataFrame, lexicon: list[str], text_col: str = "text") -> DataFrame:
    """row (all columns of docs), text_key, votes, hits, begins, words of every row, so that a decision needs no join with the texts."""
    voters = Voters(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()  # a null row can't be: the struct is made of columns
            got = np.array([voters(t or "") for t in texts], np.int64).reshape(len(texts), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, k]) for k in range(4))], names=["row", "text_key", "votes", "hits", "begins", "words"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.col(text_col)).alias("text_key"))
    return rows.mapInArrow(run, T.StructType([*rows.schema, *(T.StructField(c, T.LongType()) for c in ("votes", "hits", "begins", "words"))]))


def unpack(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(N_VOTERS)) & 1


class LabelModel:
    """P(voter votes | class) of each voter, the voters' positive correlations among toxic texts, and the share of toxic texts."""

    def __init__(self, prior: float, toxic: np.ndarray, clean: np.ndarray, corr: np.ndarray | None = None) -> None:
        clip = lambda x: np.clip(x, 1e-5, 1 - 1e-5)
        self.prior, self.toxic, self.clean = float(np.clip(prior, 1e-4, 0.5)), clip(toxic), clip(clean)
        self.corr = np.zeros((len(toxic), len(toxic))) if corr is None else corr
        self.useful = (self.toxic > self.clean).astype(float)

    @property
    def weight(self) -> np.ndarray:
        """Of each voter if all others vote as well; 0 for one that votes more often on clean than on toxic texts."""
        return self.useful / (1 + self.corr.sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes). A vote's evidence is shared with the correlated voters that vote too, so a lone vote counts in full."""
        h = unpack(votes).astype(float)
        on, off = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        z = math.log(self.prior / (1 - self.prior)) + (h * self.useful / (1 + h @ self.corr)) @ on + (1 - h) @ (off * self.weight)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_label_model(votes: DataFrame, labelled: DataFrame, rounds: int = 20) -> LabelModel:
    """Expectation maximisation over the votes of all texts (column ``votes``), grouped by pattern, each round one aggregation.

    Correlations and the share of toxic texts come from the votes alone, accuracies for two thirds; the rates in ``labelled`` (votes,
    toxic) start it, and so name the classes, and weigh ``ANCHOR`` to 1 in each round. In each round the posterior of every pattern gives the voters' rates in either class and,
    from the pairs' joint rates among toxic texts, their correlations there. A voter's weight is one over one plus its positive
    correlations with those that vote too, so voters that repeat each other count once. Voters that vote more often on clean than on
    toxic texts have weight 0. It ends when no rate moves by over a thousandth of itself.
    """
    m = N_VOTERS
    at = labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(f"shiftright(votes, {j}) & 1")).alias(f"s{j}") for j in range(m)))
    rates = {r["toxic"]: ((np.array([r[f"s{j}"] for j in range(m)]) + 0.1) / (r["n"] + 1.0), r["n"]) for r in at.collect()}
    if 0 not in rates or 1 not in rates:
        return LabelModel(0.01, np.full(m, 0.01), np.full(m, 0.01))
    (toxic, n1), (clean, n0) = rates[1], rates[0]
    model = LabelModel(n1 / (n1 + n0), toxic, clean)
    patterns = written(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    upper = [(i, j) for i in range(m) for j in range(i, m)]

    for _ in range(rounds):

        def expect(frames: Iterator[pd.DataFrame], model: LabelModel = model) -> Iterator[pd.DataFrame]:
            for f in frames:
                v, n = f["votes"].to_numpy(np.int64), f["n"].to_numpy(float)
                h, p = unpack(v).astype(float), model.posterior(v)
                pair = (h * (p * n)[:, None]).T @ h
                value = np.concatenate([[n.sum(), (p * n).sum()], (h * n[:, None]).sum(axis=0), [pair[i, j] for i, j in upper]])
                yield pd.DataFrame({"k": np.arange(len(value)), "x": value})

        summed = patterns.mapInPandas(expect, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        x = np.zeros(2 + m + len(upper))
        for r in summed:
            x[r["k"]] = r["x"]
        if not x[0]:
            break
        both = np.zeros((m, m))
        for (i, j), value in zip(upper, x[2 + m :], strict=True):
            both[i, j] = both[j, i] = value
        new = model_of(x[0], x[1], x[2 : 2 + m], both)
        mixed = lambda found, known: (found + ANCHOR * known) / (1 + ANCHOR)
        last, model = model, LabelModel(new.prior, mixed(new.toxic, toxic), mixed(new.clean, clean), new.corr)
        if np.allclose(last.toxic, model.toxic, rtol=1e-3, atol=1e-6) and np.allclose(last.clean, model.clean, rtol=1e-3, atol=1e-6):
            break
    discard(patterns)
    return model


def model_of(n: float, toxic: float, each: np.ndarray, both: np.ndarray) -> LabelModel:
    """The model of n texts, of which ``toxic`` are expected to be toxic: each voter's votes, and the pairs' votes on toxic ones."""
    one = max(toxic, 1e-9)
    mean = both.diagonal() / one
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = (both / one - np.outer(mean, mean)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return LabelModel(toxic / n, (both.diagonal() + 0.1) / (one + 1), (each - both.diagonal() + 0.1) / (n - one + 1), np.maximum(corr, 0))


def features(f: pd.DataFrame) -> np.ndarray:
    """Votes and amounts, one row a text."""
    words = np.maximum(f["words"].to_numpy(float), 1)
    found = f["hits"].to_numpy(float) + f["begins"].to_numpy(float)
    more = np.stack([np.log1p(found), np.log1p(100 * found / words), np.log(words) / 10, np.ones(len(f))], axis=1)
    return np.concatenate([unpack(f["votes"].to_numpy(np.int64)).astype(float), more], axis=1)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's steps; classes weigh alike."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    row = y / share + (1 - y) / (1 - share)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (row * (p - y)) / len(y) + keep * w / 10
        hess = (x * (row * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(y) + np.diag(keep / 10)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_texts(votes: DataFrame, size: int) -> pd.DataFrame:
    """At most ``size`` rows with a vote and as many without one, in the order of a hash of the text; equal rows are there once."""
    rows = votes.select("text_key", "votes", "hits", "begins", "words").withColumn("_h", F.pmod("text_key", F.lit(1 << 30)))
    n = votes.agg(F.count(F.when(F.col("votes") != 0, 1)).alias("some"), F.count(F.when(F.col("votes") == 0, 1)).alias("none")).first()

    def pick(k: int, cond) -> DataFrame:
        share = min(1.0, 1.2 * size / max(1, k))  # all but a few of the rows that the limit drops never reach its sort
        return rows.filter(cond & (F.col("_h") < int(share * (1 << 30)))).distinct().orderBy("_h", "text_key").limit(size)

    return pick(n["some"], F.col("votes") != 0).unionByName(pick(n["none"], F.col("votes") == 0)).drop("_h").toPandas()


def lexicon_of(rows: DataFrame, train: DataFrame) -> list[str]:
    """The lexicon of the labelled rows (doc_id, text); a bitmap keeps rows without a label from
    moving, held-out rows among them, and of the others their words move, not the texts."""
    rows = rows.filter(bucket(F.col("doc_id"), 3) != 1).withColumn("kk", F.xxhash64("doc_id"))
    rows = maybe_listed(rows, "kk", train.select(F.xxhash64("doc_id").alias("kk")), "kk")
    return learn_lexicon(distinct_words(rows.select("doc_id", "text")).join(train, "doc_id").select("toxic", "words", "sig"))


def learn(votes: DataFrame, train: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The classifier's weights from the votes (doc_id, text_key, votes, ...) of all texts; None without labels of both classes."""
    model = fit_label_model(votes, votes.select("votes", "doc_id").join(train, "doc_id"))
    known = sample_texts(votes, sample)
    if train.select("toxic").distinct().count() < 2 or not len(known):
        return None
    return fit_linear(features(known), model.posterior(known["votes"].to_numpy(np.int64)))


def scores(f: pd.DataFrame, w: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(f)) if w is None else 1 / (1 + np.exp(-np.clip(features(f) @ w, -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.7), text_key of every row, from its text alone.

    Null and empty texts are scored like any text without a vote. Without labels of both classes every score is 0. Rows that repeat
    have equal scores. If an id has several texts, its label counts for each of them. Other columns are ignored.

    Scale: the lexicon's counts cover all labelled texts and the label model's all texts; the classifier is fitted on the posteriors of
    at most ``sample`` texts with votes and as many without. Every text is read once for its votes; what follows reads a table of numbers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = written(training_labels(labels), "toxic-labels")
    votes = written(vote(rows, lexicon_of(rows, train), "doc_id"), "votes")
    w = learn(votes.withColumnRenamed("id", "doc_id"), train, sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            score = scores(f, w)
            yield pd.DataFrame({"id": f["id"].array, "text_key": f["text_key"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return through_python(votes, run, "text_key bigint, score double, predicted int").withColumnRenamed("id", id_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those predicted toxic. Each row is judged by its own text: rows without an id or with another's id stay if clean."""
    text_batches(spark)
    train = written(training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), "toxic-labels")
    votes = written(vote_rows(docs, lexicon_of(docs.select("doc_id", "text"), train)), "votes")
    w = learn(votes.withColumn("doc_id", F.col("row.doc_id")), train)

    @F.pandas_udf("double")
    def score(votes: pd.Series, hits: pd.Series, begins: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series(scores(pd.DataFrame({"votes": votes, "hits": hits, "begins": begins, "words": words}), w))

    return votes.filter(score("votes", "hits", "begins", "words") < THRESHOLD).select("row.*")
