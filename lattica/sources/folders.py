"""The folder that driver and executors share, and files in it through pyarrow's file systems."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without it a temporary folder of this process, on a cluster an error."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        holder = tempfile.TemporaryDirectory(prefix="lattica-", ignore_cleanup_errors=True)
        atexit.register(holder.cleanup)
        _local_root = f"file://{holder.name}"
    return _local_root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def opened(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    uri = re.sub("^file:/(?!//)", "file:///", path)
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+://", uri) else (fs.LocalFileSystem(), path)


def names_in(path: str, pattern: str = ".*") -> list[str]:
    """Names of files and folders right below ``path``, sorted; none where it does not exist."""
    from pyarrow import fs

    system, inner = opened(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name for f in found if re.fullmatch(pattern, f.base_name))


def put(path: str, data: bytes) -> None:
    """Write a file so that it is there whole or not at all."""
    system, inner = opened(path)
    folder, name = inner.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, inner)


def get(path: str) -> bytes:
    system, inner = opened(path)
    with system.open_input_stream(inner) as data:
        return data.read()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
