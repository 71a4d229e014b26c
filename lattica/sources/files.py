"""Scans and sinks: packed JSON lines, all-string tables, review sheets, provenance."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, member, line of every line of every member of zip archives. An archive is one task and is read as a stream,
    so it may be larger than a row can be; only the names of the archives go through Spark."""

    def work(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                uri = re.sub("^file:/(?!//)", "file:///", name)
                source, inner = fs.FileSystem.from_uri(uri)
                with source.open_input_file(inner) as data, zipfile.ZipFile(data) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as stream:
                            lines = []
                            for raw in stream:
                                lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield _lines(name, member, lines)
                                    lines = []
                            if lines:
                                yield _lines(name, member, lines)

    found = spark.read.format("binaryFile").load(path).select("path")
    return found.mapInArrow(work, "path string, member string, line string")


def _lines(name: str, member: str, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([member] * n), pa.array(lines)], names=["path", "member", "line"])


def json_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that do not parse)."""
    parsed = lines.withColumn("_j", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.col("_j").isNotNull() & F.col("_j._bad").isNull())
    bad = parsed.where(F.col("_j").isNull() | F.col("_j._bad").isNotNull())
    names = [f.name for f in good.schema["_j"].dataType.fields if f.name != "_bad"]
    return good.select(*(F.col("_j")[n].alias(n) for n in names)), bad.select("line")


def string_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited table with every cell a string and empty cells kept as empty."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path).fillna("")


def packed_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited table inside zip archives, every cell a string and the header row of each member its names.

    All members must have one header; it is read from the first line of one of them.
    """
    lines = packed_lines(spark, path).where(F.length("line") > 0)
    head = lines.first()
    if head is None:
        raise ValueError(f"no line in {path}")
    names = head.line.split(sep)
    cells = F.split("line", "\\Q" + sep + "\\E", -1)
    rows = lines.where(F.col("line") != head.line)
    return rows.select(*(F.coalesce(F.get(cells, i), F.lit("")).alias(n) for i, n in enumerate(names)))


def json_table(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """Rows of the array under key ``array`` of JSON documents that span lines, in order of place."""
    whole = spark.read.option("multiLine", True).schema(f"`{array}` array<struct<{schema}>>").json(path)
    return whole.select(F.posexplode(array).alias("place", "_row")).select("place", "_row.*")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a list, one per line, in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def write_rows(df: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """Parquet files of at most ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)


def verified_links(links: DataFrame, ids: str, most: int) -> DataFrame:
    """Links whose page names their id among at most ``most`` ids. ``links``: id, and the array ``ids``."""
    return links.where(F.array_contains(ids, F.col("id")) & (F.size(F.array_distinct(ids)) <= most))


def require_known(config: dict[str, str], known: dict[str, set[str]]) -> None:
    """Fails where a configured rule is none of those there are."""
    bad = {k: v for k, v in config.items() if v not in known.get(k, set())}
    if bad:
        raise ValueError(f"unknown rules: {bad}")


def estimated_bytes(df: DataFrame) -> int:
    """Bytes the optimiser expects the plan to give, for a cap before it runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Report:
    """Numbers of a report by (file, dotted path, style), each recorded as it is printed."""

    STYLES = {"str": str, "int": lambda v: f"{int(v):,}", "d3": lambda v: f"{float(v):.3f}", "pct": lambda v: f"{100 * float(v):.1f}%"}

    def __init__(self, folder: str):
        self.folder, self.read, self.records = Path(folder), {}, []

    def value(self, file: str, path: str):
        if file not in self.read:
            self.read[file] = json.loads((self.folder / f"{file}.json").read_text())
        found = self.read[file]
        for part in path.split("."):
            found = found[int(part)] if isinstance(found, list) else found[part]
        return found

    def text(self, file: str, path: str, style: str = "str") -> str:
        found = self.value(file, path)
        shown = self.STYLES[style](found)
        self.records.append((file, path, json.dumps(found), shown))
        return shown

    def table(self, spark: SparkSession) -> DataFrame:
        """The numbers printed so far: file, path, value, text."""
        return spark.createDataFrame(self.records, "file string, path string, value string, text string")


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheet with a header, all strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path).fillna("")
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file with a header; sheets are small by nature."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def check_inventory(expected: dict[str, tuple[int, str]], folder: str) -> list[str]:
    """Names whose size or digest differs from (bytes, sha256), or that are missing."""
    out = []
    for name, (size, digest) in sorted(expected.items()):
        p = Path(folder, name)
        if not p.exists() or p.stat().st_size != size or sha256_of(str(p)) != digest:
            out.append(name)
    return out


def write_metrics(path: str, step: str, metrics: dict, inputs: dict[str, str] | None = None) -> None:
    """Metrics with provenance as JSON: the step, the time, digests of the input files."""
    meta = {"step": step, "created": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), "inputs": {k: sha256_of(v) for k, v in (inputs or {}).items()}}
    Path(path).write_text(json.dumps({"meta": meta, **metrics}, indent=1, sort_keys=True))


def update_metrics(path: str, key: str, value) -> None:
    """Replace one key of a JSON file, keeping the others."""
    p = Path(path)
    data = json.loads(p.read_text()) if p.exists() else {}
    data[key] = value
    p.write_text(json.dumps(data, indent=1, sort_keys=True))
