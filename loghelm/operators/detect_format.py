"""Which format a file is in, from the share of sample lines each format can parse."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghelm.operators.parse import FORMATS, UNKNOWN_FORMAT, parse_flags, strip

SAMPLE_LINES = 100
COMBINED = {"apache_access", "nginx_access"}
# Fixed value: a request time with a decimal point at the end of a combined line.
SECONDS_LATENCY = r'"\s+\d+\.\d+\s*$'


def sample_lines(lines: DataFrame, file: str, position: str, n: int = SAMPLE_LINES) -> DataFrame:
    """The first ``n`` non-blank lines per file. Spark limits before it shuffles."""
    order = Window.partitionBy(file).orderBy(position)
    return (
        lines.where(strip(F.col("value")) != "")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def detect_formats(samples: DataFrame, file: str) -> DataFrame:
    """One row per file: ``format``, ``confidence``.

    The highest share wins and ties go to the earlier format, except that combined lines
    whose latency has a decimal point are nginx (seconds), not Apache (microseconds).
    """
    lines = samples.select(file, strip(F.col("value")).alias("_line")).where(F.col("_line") != "")
    shares = parse_flags(lines, "_line").groupBy(file).agg(
        *[F.avg(F.col(n).cast("double")).alias(n) for n in FORMATS],
        F.count_if(F.col("_line").rlike(SECONDS_LATENCY)).alias("_in_seconds"),
    )
    best = F.greatest(*[F.col(n) for n in FORMATS])
    return shares.select(
        file, _first_best(best).alias("format"), best.alias("confidence")
    )


def _first_best(best: Column) -> Column:
    choice = F.when(best == 0.0, UNKNOWN_FORMAT)
    choice = choice.when(
        (F.col("nginx_access") == best) & (F.col("apache_access") == best) & (F.col("_in_seconds") > 0),
        "nginx_access",
    )
    for name in FORMATS:
        choice = choice.when(F.col(name) == best, name)
    return choice
