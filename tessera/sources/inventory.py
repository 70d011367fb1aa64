"""File inventories and their checks."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package


#: Files above so many bytes are read as a stream of lines, dealt to at most so many tasks.
WHOLE_BYTES = 32 * 2**20
STREAMS = 64
#: Names that the reader of lines would unpack.
PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$", re.I)
#: The reader of lines drops it at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Path relative to ``path``, size and sha-256 of every file that is not empty.  Action: the larger files are listed.

    A file of up to ``whole_bytes`` is one binary value.  A larger one comes as lines, which one
    task hashes in order; so memory does not grow with a file, though one task reads
    all of it, as a SHA-256 is one sequential digest.  A single line, or a larger file whose name says
    that it is packed, is one value still, of 2 GiB at most.
    """
    files = spark.read.format("binaryFile")
    f = files.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    hashed = lambda x: x.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = [r.path for r in f.where(F.col("length") > whole_bytes).select("path").orderBy("path").collect()]
    streams, packed = [p for p in large if not PACKED.search(p)], [p for p in large if PACKED.search(p)]
    # the reader leaves out the content of files that are longer
    parts = [hashed(f.where(F.col("length") <= whole_bytes))]
    parts += [hashed(files.load([_literal(p) for p in packed]))] if packed else []
    parts += [_streamed(spark, streams[k::STREAMS]) for k in range(min(STREAMS, len(streams)))]
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z]+:(?://[^/]*)?(?=/)", "")
    plain = F.regexp_replace("path", r"^[a-z]+:(?://[^/]*)?(?=/)", "")
    name = F.substring(plain, F.char_length(root) + 2, F.char_length(plain)).alias("path")
    return reduce(DataFrame.unionByName, parts).select(name, "bytes", "sha256")


def _literal(path: str) -> str:
    """The path with what a pattern would read otherwise escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _streamed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Hashes of the files by one task, which reads the parts of a file one after the other."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text([_literal(p) for p in paths]).select(
        "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    return lines.coalesce(1).mapInArrow(_digests, "path string, bytes bigint, sha256 string")


def _digests(batches):
    """Hash of each file from its lines, all ended; the end of the last one and a byte order mark follow from the size."""
    files = {}
    for b in batches:
        path, start, size, line = b.columns
        keys = [path, start]
        other = np.zeros(b.num_rows, dtype=bool)
        for c in keys:
            other[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = [*dict.fromkeys([0, *np.flatnonzero(other).tolist()]), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            state = files.setdefault(path[lo].as_py(), {"size": size[lo].as_py(), "read": 0, "start": 0, "plain": hashlib.sha256(), "marked": hashlib.sha256(BYTE_ORDER_MARK)})
            if start[lo].as_py() < state["start"]:
                raise ValueError(f"{path[lo]}: parts out of order")
            wide = pa.types.is_large_binary(line.type)
            ends = np.frombuffer(line.buffers()[1], np.int64 if wide else np.int32)[line.offset + lo : line.offset + hi + 1]
            data = memoryview(line.buffers()[2])[ends[0] : ends[-1]]
            for h in (state["plain"], state["marked"]):
                h.update(b"\n" if state["read"] else b"")
                h.update(data[:-1])
            state |= {"start": start[lo].as_py(), "read": state["read"] + len(data)}
    for path, state in files.items():
        more = state["size"] - state["read"]
        # the last line: ended or not, without or with a mark before the first
        if more not in (0, -1, 3, 2):
            raise ValueError(f"{path}: {state['read']} bytes read of {state['size']}")
        digest = state["plain"] if more <= 0 else state["marked"]
        digest.update(b"\n" if more in (0, 3) else b"")
        yield pa.RecordBatch.from_pydict({"path": [unquote(path)], "bytes": [state["size"]], "sha256": [digest.hexdigest()]})


def check_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """First failing reason per expected file: missing, size or hash."""
    a = actual.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    status = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "bytes_mismatch")
        .when(F.col("_s") != F.col("sha256"), "sha256_mismatch").otherwise("ok"))
    return expected.join(a, "path", "left").select("path", status.alias("status"))


def landing_progress(landed: DataFrame, expected: DataFrame, unit: str = "month") -> DataFrame:
    """Files and rows per country against the plan, which gives the number of files per country and ``unit``.

    ``landed`` is a file scan; the file name comes from its metadata column.  A country is done when
    every unit has its files: more files of one unit don't make up for another.
    """
    n = landed.select("country", unit, F.col("_metadata.file_path").alias("f")).groupBy("country", unit).agg(
        F.count_distinct("f").alias("files"), F.count(F.lit(1)).alias("n_rows"))
    return expected.join(n, ["country", unit], "left").fillna({"files": 0, "n_rows": 0}).groupBy("country").agg(
        F.sum("planned_files").alias("planned_files"), F.sum("files").alias("files"), F.sum("n_rows").alias("n_rows"),
        F.bool_and(F.col("files") >= F.col("planned_files")).alias("done"))
