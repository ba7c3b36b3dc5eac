"""Ingest of files into the partitioned log table, and the registry of datasets.

The registry is append-only: a row per imported file and a row per deletion. The latest
row of an id decides. An upload id is the hash of the file's checksum and the write
replaces that dataset's folder, so an ingest that is cut off can simply be run again.
Below a dataset's folder the log lies by UTC day, and a range of dates reads its days only.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loghelm.functions.urls import percent_decode
from loghelm.operators.detect_format import detect_formats, sample_lines
from loghelm.operators.parse import entries, parse, parse_stats

from loghelm.schema import DATASET_SCHEMA, LOG_DAY, LOG_SCHEMA, REJECT_SCHEMA, conform, utc_day
from loghelm.session import materialized
from loghelm.sources.lines import checksums, empty_files, file_heads, plain_path, spread_lines, stream_files, with_checksums

FILES_PER_BATCH = 10_000  # bounds the file list that one job carries
STORED_SCHEMA = T.StructType(LOG_SCHEMA.fields + [T.StructField(LOG_DAY, T.DateType())])
# Columns that single values are looked up by. Their Bloom filters are written where a column chunk has no whole dictionary
# (which serves the same end), in the smallest of several sizes that fits what the chunk holds.
LOOKED_UP = ["ip", "normalized_url"]
BLOOM_FILTERS = {
    "parquet.bloom.filter.adaptive.enabled": "true",
    **{f"parquet.bloom.filter.enabled#{column}": "true" for column in LOOKED_UP},
}
REGISTRY_SCHEMA = T.StructType(DATASET_SCHEMA.fields + [T.StructField("deleted", T.BooleanType())])


@dataclass(frozen=True)
class LogStore:
    """Where the log table and the registry live: a folder all executors can reach."""

    spark: SparkSession
    root: str

    @property
    def entries_path(self) -> str:
        return f"{self.root}/log_entries"

    @property
    def registry_path(self) -> str:
        return f"{self.root}/datasets"

    @property
    def rejects_path(self) -> str:
        return f"{self.root}/rejected"

    def append(self, rows: DataFrame) -> None:
        """Add log rows, by dataset and day. Sorted by time inside files, so Parquet statistics prune on it."""
        _by_day(rows).write.mode("append").options(**BLOOM_FILTERS).partitionBy("upload_id", LOG_DAY).parquet(self.entries_path)

    def replace_datasets(self, rows: DataFrame, ids: list[int]) -> None:
        """Write the datasets ``ids``, whose entries are ``rows``, each replacing what it held before.

        What an earlier write left goes first, as its days may differ (another ``as_of``). A write that is cut off after
        that has to be repeated, as an ingest is: datasets are registered once they are written.
        """
        self._drop_folders(self.entries_path, ids)
        self._replace(_by_day(rows), self.entries_path, "upload_id", LOG_DAY)

    def _replace(self, rows: DataFrame, path: str, *by: str) -> None:
        options = {"partitionOverwriteMode": "dynamic", **BLOOM_FILTERS}
        rows.write.mode("overwrite").options(**options).partitionBy(*by).parquet(path)

    def _drop_folders(self, path: str, ids: list[int]) -> None:
        """Drop those folders of the datasets that exist (few do); one listing finds them."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upload_id={{{','.join(str(int(i)) for i in ids)}}}")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in system.globStatus(pattern) or []:
            system.delete(found.getPath(), True)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def log(self) -> DataFrame:
        """All log rows and their day, on which filters with a range of dates prune."""
        if not self._exists(self.entries_path):
            return self.spark.createDataFrame([], STORED_SCHEMA)
        return self.spark.read.schema(STORED_SCHEMA).parquet(self.entries_path)

    def rejects(self) -> DataFrame:
        """Rejected lines: dataset, file and line."""
        if not self._exists(self.rejects_path):
            return self.spark.createDataFrame([], REJECT_SCHEMA)
        return self.spark.read.schema(REJECT_SCHEMA).parquet(self.rejects_path)

    def datasets(self) -> DataFrame:
        """Datasets that are not deleted, newest first."""
        return self._current().orderBy(F.col("uploaded_at").desc(), "id")

    def _current(self) -> DataFrame:
        if not self._exists(self.registry_path):
            return self.spark.createDataFrame([], DATASET_SCHEMA)
        rows = self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.registry_path)
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "uploaded_at").alias("_r"))
        return latest.select("_r.*").where(~F.col("deleted")).drop("deleted")

    def dataset(self, dataset_id: int) -> DataFrame:
        return self._current().where(F.col("id") == dataset_id)

    def register(self, rows: DataFrame, deleted: bool = False) -> None:
        stamped = rows.withColumn("uploaded_at", F.current_timestamp()).withColumn("deleted", F.lit(deleted))
        conform(stamped, REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(self.registry_path)

    def delete(self, dataset_id: int) -> None:
        """Drop the partition of a dataset and mark it deleted."""
        self._drop(f"{self.entries_path}/upload_id={int(dataset_id)}")
        self._drop(f"{self.rejects_path}/upload_id={int(dataset_id)}")
        self.register(self.dataset(dataset_id), deleted=True)

    def reset(self) -> None:
        for path in (self.entries_path, self.rejects_path, self.registry_path):
            self._drop(path)

    def _drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def inventory(self) -> DataFrame:
        return inventory(self.log(), self._current())

    def ingest_file(self, path: str, as_of: str, format_name: str | None = None) -> DataFrame:
        """Detect, parse and store one file (or folder); returns its registry row(s)."""
        found = checksums(self.spark, path)
        new = files_to_import(found, self._current())
        return self._ingest(new, as_of, format_name)

    def ingest_folder(self, folder: str, as_of: str) -> DataFrame:
        """Import every new file below a folder and count what happened to the files.

        Returns one row: discovered, imported, skipped (known or repeated content) and
        unsupported (nothing to detect a format from, empty files among them).
        """
        empty = empty_files(self.spark, folder)
        found = materialized(checksums(self.spark, folder), "file-list")
        discovered = found.count() + empty
        new = files_to_import(found, self._current()).persist()
        try:
            attempted = new.count()
            imported = self._ingest(new, as_of).count()
        finally:
            new.unpersist()
        row = Row(
            files_discovered=discovered, files_imported=imported,
            files_skipped=discovered - empty - attempted, files_unsupported=attempted - imported + empty,
            status="SUCCESS" if imported else "COMPLETED_NO_IMPORTS",
        )
        schema = "files_discovered long, files_imported long, files_skipped long, files_unsupported long, status string"
        return self.spark.createDataFrame([row], schema)

    def ingest_stream(
        self, folder: str, as_of: str, checkpoint: str, files_per_trigger: int = FILES_PER_BATCH, available_now: bool = False
    ) -> StreamingQuery:
        """Import files as they arrive below a folder, each by its own format, as ``ingest_folder`` does for those there.

        A file whose content the registry knows, or that another one of the same trigger has, is skipped. Entries, rejected
        lines and the registry's counts are those of the file's dataset, whose id its content decides. So a trigger that
        is repeated after a failure replaces what it had written, and skips what it had registered.
        """

        def save(batch: DataFrame, number: int) -> None:
            store = LogStore(batch.sparkSession, self.root)
            found = materialized(with_checksums(batch), "stream-files")
            store._ingest(files_to_import(found, store._current()), as_of)

        writer = stream_files(self.spark, folder, files_per_trigger).writeStream.foreachBatch(save)
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _ingest(self, files: DataFrame, as_of: str, format_name: str | None = None) -> DataFrame:
        samples = sample_lines(file_heads(files), "path", "position")
        formats = detect_formats(samples, "path")
        if format_name:
            formats = formats.withColumn("format", F.lit(format_name))
        planned = files.join(formats, "path").withColumn("upload_id", F.xxhash64("checksum"))
        planned = materialized(planned, "ingest-plan")
        self._refuse_collisions(planned)
        for batch in _file_batches(planned):
            self._ingest_batch(batch, as_of)
        return self._current().join(planned.select(F.col("upload_id").alias("id")), "id", "left_semi")

    def _refuse_collisions(self, planned: DataFrame) -> None:
        """Raise when two contents have one id: the second would replace the first."""
        known = self._current().select(F.col("id").alias("upload_id"), "checksum")
        both = planned.select("upload_id", "checksum").unionByName(known)
        clash = both.groupBy("upload_id").agg(F.count_distinct("checksum").alias("n")).where("n > 1").first()
        if clash:
            raise ValueError(f"two files with different content have the dataset id {clash.upload_id}")

    def _ingest_batch(self, batch: list[Row], as_of: str) -> None:
        """Parse the files once; store their entries, their rejected lines, and what was counted."""
        # At most FILES_PER_BATCH rows, so broadcasting them is bounded.
        known = self.spark.createDataFrame(
            batch,
            "path string, length long, modificationTime timestamp, checksum string, "
            "format string, confidence double, upload_id long",
        )
        flagged = None
        for name in sorted({row.format for row in batch}):
            paths = [plain_path(row.path) for row in batch if row.format == name]
            rows = parse(spread_lines(self.spark, paths), name, as_of)
            flagged = rows if flagged is None else flagged.unionByName(rows)
        ids = F.broadcast(known.select("path", "upload_id"))
        flagged = flagged.join(ids, "path").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.replace_datasets(entries(flagged), [row.upload_id for row in batch])
            rejected = flagged.where(~F.col("parsed")).select("upload_id", "path", F.col("value").alias("line"))
            self._replace(conform(rejected, REJECT_SCHEMA), self.rejects_path, "upload_id")
            self._register_files(known, parse_stats(flagged, ["upload_id"]))
        finally:
            flagged.unpersist()

    def _register_files(self, known: DataFrame, stats: DataFrame) -> None:
        none = F.lit(0).cast("bigint")
        registry = known.join(stats, "upload_id", "left").select(
            F.col("upload_id").alias("id"),
            percent_decode(F.element_at(F.split("path", "/"), -1)).alias("filename"),
            "format", F.coalesce("parsed_lines", none).alias("total_entries"),
            F.col("format").alias("parser_used"), "confidence",
            percent_decode(F.col("path")).alias("original_path"),
            F.col("length").alias("file_size"), "checksum",
            F.col("modificationTime").alias("last_modified"),
            F.coalesce("parsed_lines", none).alias("parsed_lines"),
            F.coalesce("rejected_lines", none).alias("rejected_lines"),
        )
        self.register(registry)


def _by_day(rows: DataFrame) -> DataFrame:
    """Log rows with their day, the rows of a day and dataset together, so that a day gets few files.

    The hint leaves the size of partitions to the adaptive plan: it splits a day with many rows and merges small ones.
    """
    dated = conform(rows).withColumn(LOG_DAY, utc_day(F.col("timestamp")))
    return dated.hint("rebalance", "upload_id", LOG_DAY).sortWithinPartitions("upload_id", LOG_DAY, "timestamp")


def _file_batches(planned: DataFrame) -> Iterator[list[Row]]:
    """The file list in batches. Like any file listing it passes the driver, no data does."""
    columns = ["path", "length", "modificationTime", "checksum", "format", "confidence", "upload_id"]
    yield from map(list, batched(planned.select(columns).toLocalIterator(), FILES_PER_BATCH))


def files_to_import(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """One file (the first path) per checksum that the registry does not know.

    Copies are folded by an aggregate that combines on the map side, so any number of
    copies of one file is no hot key.
    """
    rest = [c for c in files.columns if c not in ("path", "checksum")]
    first = files.groupBy("checksum").agg(F.min(F.struct("path", *rest)).alias("_f"))
    known = datasets.where(F.col("checksum").isNotNull()).select("checksum")
    return first.select("checksum", "_f.*").join(known, "checksum", "left_anti").select(*files.columns)


def scan_counts(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """What a folder scan would do: files discovered, to import and to skip."""
    seen = files.select(F.lit(1).alias("found"), F.lit(0).alias("taken"))
    taken = files_to_import(files, datasets).select(F.lit(0).alias("found"), F.lit(1).alias("taken"))
    return seen.unionByName(taken).agg(
        F.count_if(F.col("found") == 1).alias("files_discovered"),
        F.count_if(F.col("taken") == 1).alias("files_imported"),
        F.sum(F.col("found") - F.col("taken")).alias("files_skipped"),
    )


def inventory(log: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per dataset: rows, first and last time, distinct addresses, and the registry row."""
    facts = log.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_distinct("ip").alias("unique_ips"),
    )
    return facts.join(datasets.withColumnRenamed("id", "upload_id"), "upload_id", "left")
