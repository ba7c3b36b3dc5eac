"""Columns of the caller that clash with names of operators, results or each other, and edge cases of the pipeline's stages."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loghelm.llm import decontaminate, exact_dedup, html_text, labelled, language_model, mixing, near_duplicates, secrets, sharding, substring_dedup

OWN = [
    "node", "Node", "_hash", "hash", "same", "_source", "parts", "sums", "place", "row", "_row", "id1", "ID2", "edges2", "unit", "block", "hits_", "c0", "c1",
    "band", "state", "learnt", "id", "label", "bucket", "rank", "order", "text_hash_", "item_id", "earlier", "bytes", "first", "n", "_hits", "_quality", "score_",
]
ROWS = [(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, None, None), (None, "one two", "t"), (None, "one two", "t"), (4, "", "t")]

OPERATORS = {
    "exact": (lambda d, b: exact_dedup.exact_classes(d), ["keep_id", "group_size", "kept", "text_sha256"]),
    "mixing": (lambda d, b: mixing.mix_sources(d, epochs=3.0), ["copy", "copies", "mix_rate"]),
    "near": (lambda d, b: near_duplicates.near_duplicate_classes(d), near_duplicates.RESULTS),
    "near kept": (lambda d, b: near_duplicates.keep_one_of_each_class(d), []),
    "passages": (lambda d, b: substring_dedup.repeated_passages(d), ["n_words", "n_removed", "edges", "kept_sha256"]),
    "sharding": (lambda d, b: sharding.shard_documents(d, 2), ["text_hash", "shard", "slot"]),
    "benchmark": (lambda d, b: decontaminate.find_benchmark(d, b), ["hits"]),
    "decontaminate": (lambda d, b: decontaminate.decontaminate(d, b), []),
    "secrets": (lambda d, b: secrets.find_credentials(d), ["spans"]),
    "language model": (lambda d, b: language_model.language_model_scores(d, F.col("doc_id").isNotNull()), ["n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "classifier": (lambda d, b: labelled.score_texts(d, lambda texts: __import__("numpy").zeros(len(texts))), ["score"]),
    "html": (lambda d, b: html_text.extract_main_text(d, "text", "main"), ["main"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, name):
    operator, results = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(2)
    taken = {r.lower() for r in results} | {"doc_id", "text", "source"}
    upper = [r.upper() for r in results]
    own = [c for c in OWN if c.lower() not in taken and not (name in ("secrets", "classifier", "html") and c == "Node")]
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in own], *[F.lit("replaced").alias(c) for c in upper])
    out = operator(docs, spark.createDataFrame([(1, "one two three four")], "item_id long, text string").withColumn("block", F.lit(0)))
    kept = [c for c in docs.columns if c not in upper]
    assert [c for c in out.columns if c in kept] == kept and sorted(c.lower() for c in out.columns if c not in kept) == sorted(results)
    rows = out.collect()
    assert len(rows) == len(ROWS) or name in ("mixing", "near kept")
    for row in rows:
        values = row.asDict() if len(set(out.columns)) == len(out.columns) else {}
        assert all(values[c] == f"own {c}" for c in own)


def test_repeated_and_null_ids_are_spread(spark):
    """Rows with one id, or none, and one text don't meet in one task."""
    docs = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(mixed) == 8 and max(r["count"] for r in mixed) < 1000
    placed = sharding.shard_documents(docs, 8).collect()
    assert sorted(Counter(r.shard for r in placed).values()) == [500] * 8
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(500)) for s in range(8))


def test_no_table_is_left(spark):
    before = [t.name for t in spark.catalog.listTables()]
    substring_dedup.repeated_passages(spark.createDataFrame(ROWS, "doc_id long, text string, source string")).collect()
    assert [t.name for t in spark.catalog.listTables()] == before


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    """Quality labels all rows alike here, so the first stage keeps all or none; the others have the results they state."""
    good = [(i, f"the river {i} is wide and the road to the sea is long and old", f"s{i % 2}") for i in range(30)]
    good[5] = (5, "an item of the benchmark that nobody else has ever written down anywhere", "s1")
    rows = good + [(None, None, None), (None, "", "s1"), (40, good[3][1], "s1"), (40, good[3][1], "s1"), (41, "word " * 30_000, None)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    docs = spark.createDataFrame([(*r, None, None) for r in rows], schema).withColumn("_quality", F.lit("own")).withColumn("COPY", F.lit("own"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, good[5][1]), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns[: len(docs.columns)] == docs.columns
    for name in ("near duplicates", "decontamination", "mixing", "sharding"):
        out = stages[name](spark, docs, str(tmp_path)).collect()
        assert {(r["_quality"], r["COPY"]) for r in out} == {("own", "own")}
        ids = Counter(r.doc_id for r in out)
        if name == "near duplicates":
            assert ids == Counter([*range(30), None, 41])
        if name == "decontamination":
            assert ids == Counter(r[0] for r in rows if r[0] != 5)
        if name == "mixing":
            assert set(ids) <= {r[0] for r in rows}
        if name == "sharding":
            assert ids == Counter(r[0] for r in rows)
    assert {len(stages["quality"](spark, docs, str(tmp_path)).collect())} <= {0, len(rows)}
