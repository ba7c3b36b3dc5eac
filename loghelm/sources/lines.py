"""Reading raw log files as lines."""

import hashlib
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 8192  # fixed value: how much of a file format detection looks at
CHUNK_BYTES = 1 << 20


def plain_path(uri: str) -> str:
    """What ``spark.read`` takes for a value of a ``path`` column, which is URI-encoded."""
    return unquote(uri)


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``value, path`` for plain, ``.gz`` and ``.bz2`` files. A missing path raises.

    Bytes that are no UTF-8 are left out of a line (and with them replacement characters, in such lines only).
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    clean = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(clean)
    return reader.text(paths).select(value.alias("value"), F.col("_metadata.file_path").alias("path"))


# Extensions of codecs whose files only one task can read.
UNSPLITTABLE = (".gz", ".zst", ".snappy", ".deflate", ".lz4")


def spread_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``read_lines`` of files, with the lines of those that one task has to decompress dealt out again.

    The exchange has no key and lies before anything else is done to a line, so what follows uses all tasks however large
    such a file is; the adaptive plan cuts its output to the advised size, so small files are not torn apart.
    """
    whole = [path for path in paths if path.lower().endswith(UNSPLITTABLE)]
    rest = [path for path in paths if not path.lower().endswith(UNSPLITTABLE)]
    parts = [read_lines(spark, whole).hint("rebalance")] if whole else []
    parts += [read_lines(spark, rest)] if rest else []
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("path", F.col("_metadata.file_path"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime`` of every file below a folder; reads no content.

    Spark lists no empty files; ``empty_files`` counts them.
    """
    return _files(spark, folder).select("path", "length", "modificationTime")


def empty_files(spark: SparkSession, folder: str) -> int:
    """How many files below a folder hold nothing. Hidden ones (``_x``, ``.x``) don't count."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    empty = 0
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0 and status.getPath().getName()[0] not in "_.":
            empty += 1
    return empty


def _opened(path: str, compression: str | None):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=compression)


def _digests(batches):
    """SHA-256 of each file's bytes, read in chunks."""
    for batch in batches:
        sums = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _opened(path, None) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield batch.assign(checksum=sums)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime, checksum`` of every file below a folder.

    The checksum is the SHA-256 of the file's bytes at every size; a task holds one chunk.
    """
    return with_checksums(list_files(spark, folder))


def with_checksums(files: DataFrame) -> DataFrame:
    """``path, length, modificationTime`` with the checksum of each file."""
    return files.mapInPandas(_digests, "path string, length long, modificationTime timestamp, checksum string")


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    """``path, length, modificationTime`` of files as they arrive below a folder; reads no content."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime")


def _head(stream) -> bytes:
    """The first bytes and on to the end of the line that they cut."""
    data = bytearray()
    while chunk := stream.read(HEAD_BYTES):
        data += chunk
        if cut := re.search(rb"[\r\n]", data[HEAD_BYTES:] if len(data) > HEAD_BYTES else b""):
            return bytes(data[: HEAD_BYTES + cut.start()])
    return bytes(data)


def _heads(batches):
    """Lines of the first bytes of each file, decompressed by file extension."""
    for batch in batches:
        rows = []
        for path in batch["path"]:
            with _opened(path, "detect") as stream:
                text = _head(stream).decode("utf-8", errors="ignore")
            # Where Spark ends a line, and nowhere else.
            lines = re.split(r"\r\n|\n|\r", text)
            rows += [(path, i, line) for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines)]
        yield pd.DataFrame(rows, columns=["path", "position", "value"])


def file_heads(files: DataFrame) -> DataFrame:
    """``path, position, value``: the first lines of each file, a few KB per file.

    Only the head is read, so detection does not scan the data a second time.
    """
    return files.select("path").mapInPandas(_heads, "path string, position long, value string")
