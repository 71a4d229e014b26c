"""Answers of slow, rate-limited services as a table, through a Python data source that resumes.

Distinct keys are dealt by hash into parts, one file each, and a part is one task. A task opens its own connection,
asks key after key at its share of the allowed rate and waits as long as the service says (or twice as long each time). Every
``every`` answers it commits a segment to the store, a folder that all executors share; a segment is there whole or not at
all. So a killed task, or a whole run started anew, asks only what no segment holds; keys added later join those known.

    def connect(part):                    # once a task, on an executor
        session = open_session()
        return lambda key: session.get(key)  # text, or raises Later or Missing

    answers = ask_all(keys, "name", store, connect, parts=16, rate=10.0)   # key, value, tries

The value of a key that the service does not know (``Missing``) is null, and is kept like any other. Null keys are not asked.
"""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .folders import names_in, new_folder, opened

ANSWERS = pa.schema([("key", pa.string()), ("value", pa.string()), ("tries", pa.int32())])


class Later(Exception):
    """The service asks to come back, after ``seconds`` if it says so."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


class Missing(Exception):
    """The service has nothing under this key."""


def deal(keys: DataFrame, column: str, folder: str, parts: int) -> None:
    """The distinct non-null keys as one sorted Parquet file per part."""
    named = keys.select(F.col(column).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    placed = named.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    placed.repartition(parts, "part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(folder)


def _table(folder: str, column: str | None = None):
    """Rows of all Parquet files of a folder, in order of their names, as one table (or the values of a column)."""
    system, inner = opened(folder)
    tables = [pq.read_table(f"{inner}/{n}", filesystem=system, partitioning=None) for n in names_in(folder, r"[^_.].*\.parquet")]
    whole = pa.concat_tables(tables) if tables else None
    return whole if column is None else ([] if whole is None else whole.column(column).to_pylist())


def committed(store: str, part: int) -> dict[str, tuple[str | None, int]]:
    """key -> (value, tries) of all segments of a part; of a key that two attempts committed the first counts."""
    found = _table(f"{store}/part={part}")
    known: dict[str, tuple[str | None, int]] = {}
    for key, value, tries in zip(*(found.column(c).to_pylist() for c in ANSWERS.names)) if found is not None else ():
        known.setdefault(key, (value, tries))
    return known


def commit(store: str, part: int, at: int, rows: list[tuple[str, str | None, int]]) -> None:
    """One segment, moved to its place when it is complete. ``at`` is the number of answers before it."""
    system, inner = opened(f"{store}/part={part}")
    system.create_dir(inner, recursive=True)
    name = f"{at:012d}-{uuid.uuid4().hex}.parquet"
    table = pa.table([list(c) for c in zip(*rows)], schema=ANSWERS)
    pq.write_table(table, f"{inner}/_{name}", filesystem=system)
    system.move(f"{inner}/_{name}", f"{inner}/{name}")


def patient(ask, key: str, tries: int, wait: float, sleep=time.sleep) -> tuple[str | None, int]:
    """(answer, times asked) of one key; ``Later`` after ``tries`` times goes on."""
    for n in range(1, tries + 1):
        try:
            return ask(key), n
        except Missing:
            return None, n
        except Later as later:
            if n == tries:
                raise
            sleep(wait * 2 ** (n - 1) if later.seconds is None else later.seconds)
    raise ValueError("tries must be positive")


class _Part(InputPartition):
    def __init__(self, part: int):
        super().__init__(part)
        self.part = part


def responses(connect, name: str = "lattica_responses") -> type[DataSource]:
    """A data source over ``connect``, for ``spark.dataSource.register``; options: keys, store, tries, wait, every, rate, slots."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.keys, self.store = options["keys"], options["store"]
            self.tries, self.wait, self.every = int(options.get("tries", 6)), float(options.get("wait", 1.0)), int(options.get("every", 100))
            # what is set here reaches the tasks; what partitions() might set would not
            self.parts = [int(n.split("=")[1]) for n in names_in(self.keys, r"part=\d+")]
            self.rate, self.slots = float(options.get("rate", 0)), int(options.get("slots", 0)) or len(self.parts)

        def partitions(self):
            return [_Part(part) for part in self.parts] or [_Part(-1)]

        def read(self, partition):
            part = partition.part
            keys = _table(f"{self.keys}/part={part}", "key") if part >= 0 else []
            known = committed(self.store, part) if keys else {}
            held, ask, turn, pause = [], None, 0.0, self.slots / self.rate if self.rate else 0.0
            for key in keys:
                if key in known:
                    yield (key, *known[key])
                    continue
                ask = ask or connect(part)
                time.sleep(max(0.0, turn - time.monotonic()))
                turn = time.monotonic() + pause
                held.append((key, *patient(ask, key, self.tries, self.wait)))
                if len(held) == self.every:
                    commit(self.store, part, len(known), held)
                    known.update((k, (v, n)) for k, v, n in held)
                    yield from held
                    held = []
            if held:
                commit(self.store, part, len(known), held)
                yield from held

    class Responses(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "key string, value string, tries int"

        def reader(self, schema):
            return Reader(self.options)

    return Responses


def ask_all(keys: DataFrame, column: str, store: str, connect, parts: int = 16, rate: float | None = None, slots: int | None = None, **options) -> DataFrame:
    """(key, value, tries) of all distinct keys. ``rate`` bounds the requests a second of ``slots`` tasks at once (all parts by default).

    The keys are dealt by their hash, so a store resumes with the number of ``parts`` it began with.
    """
    spark = keys.sparkSession
    folder = new_folder(spark, "keys")
    deal(keys, column, folder, parts)
    spark.dataSource.register(responses(connect))
    given = {"keys": folder, "store": store, **options} | ({"rate": rate} if rate else {}) | ({"slots": slots} if slots else {})
    return spark.read.format("lattica_responses").options(**{k: str(v) for k, v in given.items()}).load()
