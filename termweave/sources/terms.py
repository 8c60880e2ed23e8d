"""Reading and writing dictionaries: text, JSON, CSV and Parquet, plain or compressed.

A folder or file name chooses the format unless one is given: .json(.gz) a JSON array of texts or of objects, .csv,
.parquet, all else one term a line. Empty lines are skipped; compressed files are known by their ending.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.plans.shared import ship

FORMATS = ("text", "json", "csv", "parquet")


#: Endings and the formats they stand for.
ENDINGS = {"json": "json", "csv": "csv", "parquet": "parquet", "bin": "parquet", "paths": "parquet"}


def detect_format(path: str) -> str:
    """By the ending of the name."""
    name = path.rstrip("/").lower()
    for ending in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(ending)
    return ENDINGS.get(name.rsplit(".", 1)[-1], "text")


def detect_content(spark: SparkSession, path: str) -> str:
    """By the first bytes of the first file that has any; where there is none, by the ending.

    Parquet has its magic number, JSON an opening bracket; one line with a header named term is CSV.
    """
    import bz2
    import zlib

    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString() for f in fs.listStatus(where) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"))
    if not files:
        return detect_format(path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(files[0]))
    try:
        head = bytes(stream.readNBytes(4096))
    finally:
        stream.close()
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 4096)
    elif head[:3] == b"BZh":
        head = bz2.BZ2Decompressor().decompress(head)
    text = head.decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    if text[:1] in ("[", "{"):
        return "json"
    first = text.split("\n", 1)[0].strip().split(",")
    return "csv" if "term" in first else "text"


def read_terms(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(term) or (term, value), distinct terms."""
    fmt = fmt or detect_content(spark, path)
    if fmt == "text":
        got = spark.read.text(path).select(F.col("value").alias("term")).where("term <> ''")
    elif fmt == "json":
        got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("term"))
    elif fmt == "csv":
        got = spark.read.csv(path, header=True)
    elif fmt == "parquet":
        got = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    return got.dropDuplicates(["term"])


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON array of all terms of a task."""
    terms = [t for b in batches for t in b.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(sorted(terms), ensure_ascii=False)])], names=["value"])


def write_terms(terms: DataFrame, path: str, fmt: str | None = None, compression: str | None = None) -> None:
    """Write a folder; Parquet is sorted within files, so that prefix scans skip row groups.

    JSON is one array a file, of the terms that one task holds; read_terms takes all files of a folder together.
    """
    fmt = fmt or detect_format(path)
    options = {"compression": compression} if compression else {}
    if fmt == "text":
        terms.select("term").write.mode("overwrite").options(**options).text(path)
    elif fmt == "json":
        ship(terms.sparkSession)
        terms.select("term").mapInArrow(_as_array, "value string").write.mode("overwrite").options(**options).text(path)
    elif fmt == "csv":
        terms.write.mode("overwrite").options(header=True, **options).csv(path)
    elif fmt == "parquet":
        terms.sortWithinPartitions("term").write.mode("overwrite").options(**options).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str | None = None) -> None:
    write_terms(read_terms(spark, source, source_format), target, target_format)
