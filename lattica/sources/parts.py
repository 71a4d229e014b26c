"""Work done in parts on several machines: every part is committed with a manifest, and merged only when all is there.

A manifest names part and number of parts, the settings of the run, the rows and an order-free digest of them. It is
written last, so a part without one does not count. Committing the same part again changes nothing; other rows under the number of a
committed part are refused at the merge, like parts of other settings, torn parts and keys that two parts hold. Keys of
the frame that no part holds come out as a table, so a lost part is named by its number and its keys.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import get, names_in, put

DIGEST = "decimal(38,0)"


def part_of(parts: int, *key: Column) -> Column:
    """The part (from 0) a key belongs to."""
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def digest(df: DataFrame) -> list[Column]:
    """Aggregates n and digest of all rows, whatever their order."""
    cells = [F.to_json(F.struct(c)).alias(c) for c in sorted(df.columns)]
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*cells).cast(DIGEST)), F.lit(0).cast(DIGEST)).alias("digest")]


def commit_part(rows: DataFrame, folder: str, part: int, parts: int, settings: dict) -> dict:
    """Write a part and then its manifest, which is returned; a part of the same rows and settings that is there already is left alone."""
    if not 0 <= part < parts:
        raise ValueError(f"part {part} of {parts}")
    seen = rows.agg(*digest(rows)).first()
    manifest = {"part": part, "of": parts, "settings": settings, "rows": seen.n, "digest": str(seen.digest), "schema": rows.schema.jsonValue()}
    name = f"{part:05d}-{seen.n}-{abs(int(seen.digest)):x}"
    if f"{name}.json" not in names_in(f"{folder}/manifests"):
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{name}")
        put(f"{folder}/manifests/{name}.json", json.dumps(manifest, sort_keys=True).encode())
    elif json.loads(get(f"{folder}/manifests/{name}.json"))["settings"] != settings:
        raise ValueError(f"part {part} was committed under other settings")
    return manifest


def manifests(folder: str) -> dict[str, dict]:
    """Name -> manifest of every committed part."""
    return {n[:-5]: json.loads(get(f"{folder}/manifests/{n}")) for n in names_in(f"{folder}/manifests", r"\d+-.*\.json")}


def checked(found: dict[str, dict]) -> None:
    """Fails where parts are lost, doubled or of different settings; ``found`` as ``manifests`` gives it."""
    if not found:
        raise ValueError("no part is committed")
    first = next(iter(found.values()))
    same = lambda m: (m["of"], m["settings"], sorted(f["name"] for f in m["schema"]["fields"]))
    other = sorted(m["part"] for m in found.values() if same(m) != same(first))
    if other:
        raise ValueError(f"parts {other} differ in settings, number of parts or columns from part {first['part']}")
    numbers = sorted(m["part"] for m in found.values())
    doubled = sorted({n for n in numbers if numbers.count(n) > 1})
    if doubled:
        raise ValueError(f"parts {doubled} are committed twice, with different rows")
    lost = sorted(set(range(first["of"])) - set(numbers))
    if lost:
        raise ValueError(f"parts {lost} of {first['of']} are missing")


def merged(spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """The rows of all parts, after all checks: complete, of one run, whole, and no key twice."""
    found = manifests(folder)
    checked(found)
    names = sorted(found)
    rows = spark.read.parquet(*(f"{folder}/rows/{n}" for n in names)).withColumn("_part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    columns = [c for c in rows.columns if c != "_part"]
    whole = {r["_part"]: (r.n, str(r.digest)) for r in rows.groupBy("_part").agg(*digest(rows.select(columns))).collect()}  # one row per part
    torn = [found[n]["part"] for n in names if whole.get(n, (0, "0")) != (found[n]["rows"], found[n]["digest"])]
    if torn:
        raise ValueError(f"parts {torn} do not hold the rows of their manifests")
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key).limit(5).collect()
    if twice:
        raise ValueError(f"keys in more than one row: {[tuple(r) for r in twice]}")
    return rows.select(columns)


def missing(frame: DataFrame, rows: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """Keys of ``frame`` without a row, and, where keys were dealt by ``part_of``, the part each should be in."""
    lost = frame.select(*key).distinct().join(rows.select(*key), key, "left_anti")
    return lost if parts is None else lost.withColumn("part", part_of(parts, *map(F.col, key)))


def label_table(frame: DataFrame, outputs: DataFrame, key: list[str], group: list[str], positive: Column, minimum: int) -> DataFrame:
    """Per group: n_papers, n_classified, n_positive and label (``minimum`` positives or more).

    ``frame``: key and group; ``outputs``: key and what ``positive`` reads. A group that is not positive must have all of its rows
    classified; where one has not, the label would only be the lack of an answer, and the job fails and names some.
    """
    met = frame.join(outputs.withColumn("_there", F.lit(True)), key, "left")
    table = met.groupBy(*group).agg(F.count("*").alias("n_papers"), F.count("_there").alias("n_classified"), F.count_if(F.col("_there") & positive).alias("n_positive"))
    table = table.withColumn("label", F.col("n_positive") >= minimum)
    unsure = table.where(~F.col("label") & (F.col("n_classified") < F.col("n_papers"))).select(*group).limit(5).collect()
    if unsure:
        raise ValueError(f"groups with unclassified rows and no label of their own: {[tuple(r) for r in unsure]}")
    return table
