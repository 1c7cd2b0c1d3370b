"""What Python tasks of the pipeline hold at once."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tapeline.llm import common, langid


def test_text_batches_end_after_a_megabyte(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    kept = {k: spark.conf.get(k) for k in (common.BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        for k in kept:
            spark.conf.unset(k)
        common.text_batches(spark)
        texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        got = texts.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in got) == 400 and max(r.bytes for r in got) < 1_100_000


def test_grams_of_many_texts_take_little_memory():
    rng = random.Random(5)
    frame = pd.DataFrame({"t": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß, .", k=3000)) for _ in range(300)]})
    most, got = 0, Counter()
    for part in langid.batches(iter([frame]), "t"):
        tracemalloc.start()
        owner, gram, n = langid.gram_counts(part["t"].tolist(), np.arange(len(part)))
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for g, k in zip(gram.tolist(), n.tolist(), strict=True):
            got[g] += k
    _, gram, n = langid.gram_counts(frame["t"].tolist(), np.zeros(len(frame), np.int64))
    assert got == dict(zip(gram.tolist(), n.tolist(), strict=True))  # all of them, however they are cut
    assert most < 30_000_000
