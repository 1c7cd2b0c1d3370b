"""Pooled training sets, a boosted three-class model with calibration, scores, signals and bet sizes."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import written
from ..functions.windows import by_symbol, in_chunks

CLASSES = (0, 1, 2)


def training_set(df: DataFrame, features: list[str], min_rows: int = 20) -> DataFrame:
    """Rows of all symbols that have at least ``min_rows``: symbol, seq, features, cls."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    return df.withColumn("_n", n).filter(F.col("_n") >= min_rows).select("symbol", "seq", *features, "cls")


def split_random(df: DataFrame, bucket: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds part: test (20 of 100 buckets), calibration (16) or train (64), by a hash of (symbol, seq), so a run can be repeated."""
    b = F.pmod(F.xxhash64("symbol", "seq", F.lit(seed)), F.lit(100)) if bucket is None else bucket
    return df.withColumn("part", F.when(b < 20, "test").when(b < 36, "calibration").otherwise("train"))


def label_spans(df: DataFrame, horizon: int = 15, chunk: int = 50_000) -> DataFrame:
    """Adds until: the time of the last row that a row's label looks at, ``horizon`` rows ahead or the symbol's last."""
    ahead = lambda rows: rows.withColumn("until", F.last("ts").over(by_symbol().rowsBetween(0, horizon)))
    return in_chunks(df, ahead, max(chunk, horizon), after=horizon)


def purged_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """symbol, seq, fold, part of rows (symbol, seq, ts, until), for each fold: its rows are test, and the others train unless their label
    looks into the test span or the span lies in theirs.

    Folds are spans of whole days with about equally many rows over all symbols. Spans are a row a fold, so the anti-join is with a
    constant number of rows; nothing is ordered but the counts by day.
    """
    df = written(df.select("symbol", "seq", "ts", "until"), "labelled-rows")  # read for the days, the spans, the tests and the trains
    days = df.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    days = days.withColumn("one", F.lit(1)).withColumn("before", F.coalesce(F.sum("k").over(W.partitionBy("one").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    n = F.sum("k").over(W.partitionBy("one"))
    days = written(days.select("day", F.floor(F.col("before") * folds / n).cast("int").alias("fold")), "days")
    rows = df.withColumn("day", F.to_date("ts")).join(days, "day").select("symbol", "seq", "ts", "until", "fold")
    spans = written(rows.groupBy("fold").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), "spans")
    test = rows.select("symbol", "seq", "fold", F.lit("test").alias("part"))
    each = rows.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("of <> fold")
    spans = F.broadcast(spans.withColumnRenamed("fold", "of_"))  # ``folds`` rows
    train = each.join(spans, (F.col("of") == F.col("of_")) & (F.col("ts") <= F.col("hi")) & (F.col("until") >= F.col("lo")), "left_anti")
    some = spans.select(F.col("of_").alias("of"))
    train = train.join(some, "of", "left_semi").select("symbol", "seq", F.col("of").alias("fold"), F.lit("train").alias("part"))
    return test.unionByName(train)


def _rest(df: DataFrame, cls: int) -> DataFrame:
    return df.withColumn("_y", (F.col("cls") == cls).cast("double"))


class Classifier:
    """One boosted model and one sigmoid a class."""

    def __init__(self, features: list[str], trees: list, sigmoids: list) -> None:
        self.features, self.trees, self.sigmoids = features, trees, sigmoids

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probs (array over classes 0, 1, 2): calibrated margins, scaled to sum 1."""
        out = VectorAssembler(inputCols=self.features, outputCol="_x").transform(df)
        for k in CLASSES:
            out = _margin(self.trees[k], out, k)
            a, b = self.sigmoids[k]
            out = out.withColumn(f"_q{k}", 1 / (1 + F.exp(-(F.lit(a) * F.col(f"_m{k}") + F.lit(b)))))
        total = sum((F.col(f"_q{k}") for k in CLASSES), F.lit(0.0))  # above 0, whatever the margins
        out = out.withColumn("probs", F.array(*(F.col(f"_q{k}") / total for k in CLASSES)))
        return out.drop("_x", *(f"_{c}{k}" for c in "mq" for k in CLASSES))


    def save(self, path: str, matrices: DataFrame | None = None) -> None:
        """Write the trees, the sigmoids and (if given) the matrices that scale and rotate the features, as one folder that must not exist."""
        for k in CLASSES:
            self.trees[k].save(f"{path}/trees-{k}")
        spark = SparkSession.active()
        rows = [(k, *self.sigmoids[k], self.features) for k in CLASSES]
        if matrices is not None:
            matrices.write.parquet(f"{path}/matrices")
        spark.createDataFrame(rows, "cls int, a double, b double, features array<string>").coalesce(1).write.parquet(f"{path}/sigmoids")  # last: a folder that has it is whole

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[Classifier, DataFrame | None]:
        """The classifier and the matrices that ``save`` wrote; None where it had none."""
        rows = sorted(spark.read.parquet(f"{path}/sigmoids").collect(), key=lambda r: r["cls"])
        trees = [GBTClassificationModel.load(f"{path}/trees-{k}") for k in CLASSES]
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/matrices")
        fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        matrices = spark.read.parquet(f"{path}/matrices") if fs.exists(there) else None
        return Classifier(rows[0]["features"], trees, [(r["a"], r["b"]) for r in rows]), matrices


def _margin(tree, df: DataFrame, k: int) -> DataFrame:
    out = tree.setFeaturesCol("_x").setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_b{k}").transform(df)
    return out.withColumn(f"_m{k}", vector_to_array(f"_r{k}")[1]).drop(f"_p{k}", f"_r{k}", f"_b{k}")


def fit_classifier(df: DataFrame, features: list[str], trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42) -> Classifier:
    """Boosted trees one against the rest on part train, sigmoids on part calibration. Spark ML sums histograms; no rows are shuffled."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df).select("_x", "cls", "part").cache()
    models, sigmoids = [], []
    for k in CLASSES:
        gbt = GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
        model = gbt.fit(_rest(rows.filter("part = 'train'"), k))
        held = _margin(model, _rest(rows.filter("part = 'calibration'"), k), k)
        platt = LogisticRegression(labelCol="_y", featuresCol="_z").fit(VectorAssembler(inputCols=[f"_m{k}"], outputCol="_z").transform(held))
        models.append(model)
        sigmoids.append((float(platt.coefficients[0]), float(platt.intercept)))
    rows.unpersist()
    return Classifier(features, models, sigmoids)


def fit_per_symbol(df: DataFrame, features: list[str], symbols: list, **params) -> dict:
    """A model of its own for each of a few named symbols."""
    return {s: fit_classifier(df.filter(F.col("symbol") == s), features, **params) for s in symbols}


def score(df: DataFrame) -> DataFrame:
    """Adds prediction (first class with the largest of probs), prob and signal (class - 1)."""
    top = F.array_max("probs")
    out = df.withColumns({"prob": top, "prediction": (F.array_position("probs", top) - 1).cast("int")})
    return out.withColumn("signal", F.col("prediction") - 1)


def latest_signals(df: DataFrame) -> DataFrame:
    """symbol, seq, action, conviction of each symbol's newest row of scored rows."""
    last = df.groupBy("symbol").agg(F.max_by(F.struct("seq", "signal", "prob"), "seq").alias("r")).select("symbol", "r.*")
    action = F.when(F.col("signal") > 0, "LONG").when(F.col("signal") < 0, "SHORT").otherwise("HOLD")
    return last.select("symbol", "seq", action.alias("action"), F.col("prob").alias("conviction"))


def size_bets(df: DataFrame, steps: int = 10, long_only: bool = False) -> DataFrame:
    """Adds act: bet clipped to [0, 1], rounded half-even to 1/steps, times signal; shorts are 0 with ``long_only``."""
    size = F.bround(F.greatest(F.least(F.col("bet"), F.lit(1.0)), F.lit(0.0)) * steps) / steps
    sign = F.greatest("signal", F.lit(0)) if long_only else F.col("signal")
    return df.withColumn("act", size * sign)


def bet_size_from_prob(p: Column) -> Column:
    """2 Phi(z) - 1 with z = (p - 1/2) / sqrt(p (1 - p)), by the rational form 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    z = (p - 0.5) / F.sqrt(p * (1 - p))
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t  # fixed values
    return F.signum(z) * (1 - poly * F.exp(-x * x))


def classification_report(df: DataFrame) -> DataFrame:
    """One row a class (and 'macro', 'weighted', 'accuracy') of rows (cls, prediction): precision, recall, f1, support."""
    cells = df.groupBy("cls", "prediction").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.lit(k) for k in CLASSES))).alias("k")
    by = cells.select("*", each).groupBy("k").agg(
        F.sum(F.when((F.col("cls") == F.col("k")) & (F.col("prediction") == F.col("k")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("prediction") == F.col("k"), F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("cls") == F.col("k"), F.col("n")).otherwise(0)).alias("support"),
    )
    over = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    by = by.withColumns({"precision": over(F.col("tp"), F.col("pp")), "recall": over(F.col("tp"), F.col("support"))})
    by = by.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    m = ("precision", "recall", "f1")
    rows = by.select(F.col("k").cast("string").alias("name"), *m, "support")
    macro = by.agg(*(F.avg(c).alias(c) for c in m), F.sum("support").alias("support")).select(F.lit("macro").alias("name"), *m, "support")
    weighted = by.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in m), F.sum("support").alias("s")).select(F.lit("weighted").alias("name"), *m, F.col("s").alias("support"))
    acc = by.agg((F.sum("tp") / F.sum("support")).alias("a"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("name"), *(F.col("a").alias(c) for c in m), "support")
    return rows.unionByName(macro).unionByName(weighted).unionByName(acc)
