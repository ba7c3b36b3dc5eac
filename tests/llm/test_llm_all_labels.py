"""Training of the toxicity net takes every labelled row, however many there are."""

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loghelm.llm import toxicity
from loghelm.llm.words import BUCKETS


def test_all_labelled_rows_count(spark, monkeypatch):
    """9,000 clean and 5,000 toxic rows, in six shards: counts, net and thresholds are of all of them."""
    ids = spark.range(14_000, numPartitions=6).select(F.col("id").alias("doc_id"), (F.col("id") < 5000).cast("int").alias("toxic"))
    word = F.when(F.col("toxic") == 1, F.array(F.lit("vile"), F.lit("nasty"))).otherwise(F.array(F.lit("calm"), F.lit("kind")))
    docs = ids.select("doc_id", F.concat_ws(" ", F.lit("some"), word[(F.col("doc_id") % 2).cast("int")], F.concat(F.lit("w"), "doc_id")).alias("text"))
    taken, real = [], toxicity.begin_from_counts
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    monkeypatch.setattr(toxicity, "begin_from_counts", lambda net, seen, texts: taken.append((seen, texts)) or real(net, seen, texts))
    got = toxicity.op1_toxicity(docs, ids).toPandas()
    assert len(got) == 14_000 and set(got["predicted"] - (got["doc_id"] < 5000)) == {0}
    seen, texts = taken[0]
    learnable = sum(crc32(str(i).encode()) % 5 != 0 for i in range(14_000))
    assert 0.78 * learnable < texts.sum() < 0.82 * learnable and texts[1] > 3000 and texts[0] > 5000
    assert seen[:, crc32(b"some") & (BUCKETS - 1)].tolist() == texts.tolist()
    again = toxicity.op1_toxicity(docs.repartition(3), ids.repartition(5)).toPandas()
    assert (got.sort_values("doc_id")["score"].to_numpy() == again.sort_values("doc_id")["score"].to_numpy()).all()


def test_threshold_of_steps_is_that_of_the_rows():
    rng = np.random.default_rng(4)
    truth = (rng.random(5000) < 0.2).astype(float)
    logits = rng.normal(size=5000) + 2 * truth
    found = pd.DataFrame({"step": np.floor(logits * toxicity.STEPS).astype(int), "hits": truth, "rows": 1, "low": logits, "high": logits})
    assert abs(toxicity._threshold_of_steps(found) - toxicity._threshold(logits, truth, (1.0, 1.0))) < 0.05
