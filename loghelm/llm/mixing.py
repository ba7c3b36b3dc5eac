"""Mixing sources to target weights by Poisson replication.

A source with the rate r gets each of its documents Poisson(r) times, r being its target share of the bytes over its own
share. The count inverts the Poisson distribution at a number that a hash of seed, id and text decides, so a rerun or a
lost executor gives the same counts. Rates above ``PART`` are the sum of independent parts, which keeps exp(-r)
representable at any rate. Copies are dealt over all partitions by their own hash and sorted by it inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, materialize, parallelism, unit_interval

#: Largest mean inverted at once.
PART = 16.0
#: Terms of a distribution with a mean of up to PART; what lies beyond has a probability under 1e-30.
TERMS = 96
#: Up to so many sources the list of rates (under 1 KB each) is sent to all executors.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """One row per source: source, bytes, rate. Null is a source of its own.

    weights: target shares by source name, sources that it leaves out get none. Without them the share of a source is
    its bytes to the power ``temperature``. epochs: bytes of the result over bytes of the input.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(1)
    by_source = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    if weights is None:
        target: Column = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        target = F.lit(0.0)
        for name, weight in sorted(weights.items()):
            target = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(target)
    by_source = materialize(by_source.select("source", "bytes", target.alias("target")), "mix-sources")
    total = by_source.agg(F.sum("bytes").alias("bytes"), F.sum("target").alias("target")).first()
    share = F.col("bytes") / F.lit(float(total["bytes"] or 1))
    wanted = F.col("target") / F.lit(float(total["target"] or 1))
    return by_source.select("source", "bytes", (F.lit(float(epochs)) * wanted / share).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)), start,
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums"),
        ),
        lambda acc: acc["sums"],
    )


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """``docs`` replicated to the target weights, with copy (0, 1, ..) and mix_rate, shuffled globally.

    Null texts count as empty (one byte, as every document has one for its end), a null source is a source of its own,
    rows with equal id and text get equal counts, and an empty table stays empty. Columns named copy, copies or mix_rate,
    in any case, are replaced. Rows that repeat, null ids included, are dealt out by their place in the input besides.
    """
    spark = docs.sparkSession
    own = Columns(docs, "copy", "copies", "mix_rate")
    docs = own.frame.withColumn("row", F.monotonically_increasing_id())
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART)), F.lit(1)).cast("int")
    rates = source_rates(docs.select(own["source"].alias("source"), own["text"].alias("text")), weights, temperature, epochs).select(
        "source", F.col("rate").alias("mix_rate"), parts.alias("parts"), _cumulative(F.col("rate") / parts).alias("sums")
    )
    content = F.md5(F.coalesce(own["text"], F.lit("")))
    ident = F.coalesce(own["doc_id"].cast("string"), F.lit("null"))
    # A row of rates is under 1 KB. Longer lists of sources are joined by shuffle.
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.join(rates, own["source"].eqNullSafe(F.col("source")))

    # As many bounds as lie at or below the number are passed: an inverted distribution.
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: unit_interval(F.lit(seed), ident, content, part))
    passed = lambda acc, number: acc + F.size(F.filter(F.col("sums"), lambda bound: bound <= number))
    counted = rated.withColumn("copies", F.aggregate(numbers, F.lit(0), passed))
    each = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    out = counted.withColumn("copy", F.explode(each))
    place = F.xxhash64(F.lit(seed), ident, content, F.col("copy"), F.col("row"))
    out = out.withColumn("place", place).repartition(parallelism(spark), "place").sortWithinPartitions("place")
    return own.restored(out, "copy", "copies", "mix_rate")


def op3_mix_sources(documents: DataFrame) -> DataFrame:
    """Every copy of the mixture with its size; the text itself stays in ``documents``."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("bytes")
    mixed = mix_sources(documents.select("doc_id", "text", "source", size))
    return mixed.select("doc_id", "copy", "copies", "source", "bytes", F.round("mix_rate", 6).alias("mix_rate"))


OP3_SQL = """
WITH s AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS bytes FROM documents GROUP BY source
), r AS (
  SELECT source, (pow(bytes, 0.7) / sum(pow(bytes, 0.7)) OVER ()) / (bytes / sum(bytes) OVER ()) AS rate FROM s
), t AS (
  SELECT source, rate, k,
         sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS bound
  FROM r, range(0, 96) x(k)
), d AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':1'), 1, 13))::BIGINT
           / 4503599627370496.0 AS u
  FROM documents
), c AS (
  SELECT d.doc_id, d.source, d.bytes, any_value(t.rate) AS rate, count(*) FILTER (t.bound <= d.u)::INTEGER AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.doc_id, d.source, d.bytes
)
SELECT doc_id, k::INTEGER AS copy, copies, source, bytes, round(rate, 6) AS mix_rate
FROM c, range(0, 96) y(k) WHERE k < copies
"""
