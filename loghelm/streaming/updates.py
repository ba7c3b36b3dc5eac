"""Tables that a stream updates: a folder for each batch of changed rows, and a base into which older ones are merged.

``<path>/batch=N`` holds the rows that batch N changed. ``<path>/_base/upto=N`` holds the newest row of each key of all
batches up to N, and counts once its write has been committed (the ``_SUCCESS`` mark, written last), so the step from
one base to the next is atomic in any store. What a base replaces is deleted when the next but one base is there: a
query that was planned before the step still finds its files. Reads take the newest base and the batches after it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMPACT_EVERY = 50  # batches after the base that a stream merges into a new one


def write_updates(
    result: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = False,
    keys: list[str] | None = None, compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Write each batch of changed rows as its own folder, so a repeated batch replaces itself.

    With ``keys`` the stream compacts as well, whenever ``compact_every`` batches lie after the base. The batch being
    written is never among them: it can come again, those before it can't.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if keys:
            tail = [n for n in _after_base(batch.sparkSession, path) if n < number]
            if len(tail) >= compact_every:
                compact_updates(batch.sparkSession, path, keys, max(tail))

    writer = result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key: out of the base and the batches after it. Null keys are keys like others."""
    return _newest(_rows(spark, path, None), keys).drop("batch")


def compact_updates(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Merge the base and the batches up to ``upto`` into the next base. Batches after ``upto`` may be written meanwhile.

    A compaction that is cut off leaves no mark, so the base before it stays in use and the next one replaces the rest.
    """
    before = _bases(spark, path)
    if before and before[-1] >= upto:
        return
    _newest(_rows(spark, path, upto), keys).write.mode("overwrite").parquet(f"{path}/_base/upto={upto}")
    if before:
        stale = [f"{path}/batch={n}" for n in _numbers(spark, f"{path}/batch=*") if n <= before[-1]]
        stale += [f"{path}/_base/upto={n}" for n in _numbers(spark, f"{path}/_base/upto=*") if n < before[-1]]
        for folder in stale:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")


def _rows(spark: SparkSession, path: str, upto: int | None) -> DataFrame:
    """All rows that decide, with the number of their batch; at least one batch has been written."""
    bases = _bases(spark, path)
    tail = [n for n in _after_base(spark, path) if upto is None or n <= upto]
    parts = [spark.read.parquet(f"{path}/_base/upto={bases[-1]}")] if bases else []
    if tail:
        changed = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in tail])
        parts.append(changed.withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise FileNotFoundError(f"no batch of a stream in {path}")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _after_base(spark: SparkSession, path: str) -> list[int]:
    bases = _bases(spark, path)
    return [n for n in _numbers(spark, f"{path}/batch=*/_SUCCESS") if not bases or n > bases[-1]]


def _bases(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, f"{path}/_base/upto=*/_SUCCESS")


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    """The numbers of the folders ``name=number`` that a pattern finds, ascending; compaction keeps them few."""
    wanted = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = wanted.getFileSystem(spark._jsc.hadoopConfiguration())
    # The last part that has a number: a mark lies inside its folder.
    folders = [status.getPath().toString().removesuffix("/_SUCCESS") for status in system.globStatus(wanted) or []]
    return sorted(int(folder.rsplit("=", 1)[1]) for folder in folders)
