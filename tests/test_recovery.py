"""Resumed answers, merged parts, rebuild comparison and capped plans: what is lost, doubled, equal or too large."""

import json
import os
import random
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators import rebuild as R
from lattica.plans import registry
from lattica.sources import guard, parts
from lattica.sources.folders import names_in
from lattica.sources.responses import Later, Missing, ask_all, committed, patient


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def service(log, dies_at=None):
    """An asked key is logged; the worker process dies at ``dies_at`` as long as there is no file ``log``.dead."""

    def connect(part):
        def ask(key):
            with open(f"{log}.{part}", "a") as out:
                out.write(key + "\n")
            if key == dies_at and not os.path.exists(f"{log}.dead"):
                open(f"{log}.dead", "w").close()
                os._exit(1)
            if key.endswith("9"):
                raise Missing
            return json.dumps({"k": key})

        return ask

    return connect


def asked(tmp_path):
    return sorted(line for f in tmp_path.glob("log.[0-9]") for line in f.read_text().split())


def test_answers_resume_after_a_killed_task(spark, tmp_path):
    keys = spark.createDataFrame([(f"{i:03d}",) for i in range(60)] + [("000",), (None,)], "name string")
    store, connect = f"{tmp_path}/store", service(f"{tmp_path}/log", dies_at="041")
    with pytest.raises(Exception):
        ask_all(keys, "name", store, connect, parts=2, every=4).collect()
    before = asked(tmp_path)
    held = {k for part in range(2) for k in committed(store, part)}
    assert "041" in before and "041" not in held and held <= set(before)
    rows = {r.key: (r.value, r.tries) for r in ask_all(keys, "name", store, connect, parts=2, every=4).collect()}
    assert rows == {f"{i:03d}": (None if i % 10 == 9 else json.dumps({"k": f"{i:03d}"}), 1) for i in range(60)}
    again = asked(tmp_path)
    assert all(again.count(k) == 1 for k in held)  # what a segment held was not asked again
    assert sum(again.count(k) - 1 for k in set(again)) <= 2 * 4  # at most one open segment a part was lost
    more = keys.unionAll(spark.createDataFrame([("100",)], "name string"))
    assert ask_all(more, "name", store, connect, parts=2, every=4).count() == 61
    assert len(asked(tmp_path)) == len(again) + 1


def test_answers_wait_for_the_service(spark, tmp_path):
    waits, left = [], [Later(), Later(7.0), Later()]

    def ask(key):
        if left:
            raise left.pop(0)
        return "x"

    assert patient(ask, "k", 4, 0.5, waits.append) == ("x", 4) and waits == [0.5, 7.0, 2.0]
    with pytest.raises(Later):
        patient(lambda key: (_ for _ in ()).throw(Later()), "k", 3, 0.0, waits.append)
    keys = spark.range(12).withColumnRenamed("id", "n")
    began = time.monotonic()
    assert ask_all(keys, "n", f"{tmp_path}/s", lambda part: lambda key: key, parts=1, rate=3.0).count() == 12
    assert time.monotonic() - began >= 11 / 3
    assert ask_all(keys.where("false"), "n", f"{tmp_path}/s", lambda part: lambda key: key, parts=2).count() == 0


def test_parts_are_complete_or_refused(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"g{i % 4}", i % 8 == 0) for i in range(40)], "id int, grp string, hit boolean")
    dealt = frame.select("id", "hit", parts.part_of(3, F.col("id")).alias("p"))
    rows = lambda p: dealt.where(F.col("p") == p).drop("p")
    folder, run = str(tmp_path / "a"), {"model": "m"}
    with pytest.raises(ValueError, match="no part"):
        parts.merged(spark, folder, ["id"])
    parts.commit_part(rows(0), folder, 0, 3, run)
    parts.commit_part(rows(2), folder, 2, 3, run)
    with pytest.raises(ValueError, match=r"parts \[1\] of 3 are missing"):
        parts.merged(spark, folder, ["id"])
    one = parts.commit_part(rows(1), folder, 1, 3, run)
    assert parts.commit_part(rows(1).repartition(3), folder, 1, 3, run) == one and len(parts.manifests(folder)) == 3
    assert plain(parts.merged(spark, folder, ["id"]).collect()) == plain(frame.select("id", "hit").collect())
    with pytest.raises(ValueError, match="other settings"):
        parts.commit_part(rows(1), folder, 1, 3, {"model": "n"})
    parts.commit_part(rows(1).where("id <> 1").limit(3), folder, 1, 3, run)
    with pytest.raises(ValueError, match=r"parts \[1\] are committed twice"):
        parts.merged(spark, folder, ["id"])


def test_parts_of_other_runs_torn_parts_and_double_keys(spark, tmp_path):
    rows = lambda lo, hi: spark.range(lo, hi)
    other = str(tmp_path / "b")
    parts.commit_part(rows(0, 5), other, 0, 2, {"model": "m"})
    parts.commit_part(rows(5, 9), other, 1, 2, {"model": "n"})
    with pytest.raises(ValueError, match=r"parts \[1\] differ in settings"):
        parts.merged(spark, other, ["id"])
    torn = str(tmp_path / "c")
    for p in range(2):
        parts.commit_part(rows(5 * p, 5 * p + 5).repartition(2), torn, p, 2, {})
    next(Path(torn, "rows").glob("00001-*/part-00001*.parquet")).unlink()
    with pytest.raises(ValueError, match=r"parts \[1\] do not hold"):
        parts.merged(spark, torn, ["id"])
    double = str(tmp_path / "d")
    parts.commit_part(rows(0, 6), double, 0, 2, {})
    parts.commit_part(rows(5, 9), double, 1, 2, {})
    with pytest.raises(ValueError, match=r"more than one row: \[\(5,\)\]"):
        parts.merged(spark, double, ["id"])


def test_missing_keys_and_unclassified_groups(spark):
    frame = spark.createDataFrame([(i, i % 3) for i in range(12)], "id int, g int")
    done = frame.where("id NOT IN (4, 5)").select("id", (F.col("id") % 2 == 0).alias("yes"))
    lost = parts.missing(frame, done, ["id"], 4).collect()
    assert sorted(r.id for r in lost) == [4, 5] and all(0 <= r.part < 4 for r in lost)
    label = lambda minimum: parts.label_table(frame, done, ["id"], ["g"], F.col("yes"), minimum)
    assert plain(label(1).collect()) == [(0, 4, 4, 2, True), (1, 4, 3, 1, True), (2, 4, 3, 2, True)]
    with pytest.raises(ValueError, match=r"\(1,\)"):
        label(2)


def random_rows(rng, n):
    kinds = [None, "a", "b", ""]
    return [(i if i % 9 else None, rng.choice("xy") + str(i), rng.choice(kinds), rng.choice([None, 1.5, 2.0]), rng.choice([None, [1], [1, 2]])) for i in range(n)]


def test_differences_against_plain_python(spark):
    rng, schema = random.Random(1), "k int, l string, s string, d double, v array<int>"
    old = random_rows(rng, 60)
    new = [list(r) for r in old if rng.random() > 0.1]
    for r in new:
        if rng.random() < 0.3:
            r[2] = rng.choice([None, "a", "c", ""])
    new += [[500 + i, "z", "a", None, [3]] for i in range(3)]
    new = [tuple(r) for r in new]
    text = lambda x: None if x is None else json.dumps(x, separators=(",", ":")) if isinstance(x, list) else str(x)
    a, b = {r[:2]: r[2:] for r in old}, {r[:2]: r[2:] for r in new}
    want = []
    for key in {*a, *b}:
        kind = "added" if key not in a else "removed" if key not in b else "changed"
        for i, c in enumerate("sdv"):
            x, y = (text(t[key][i]) if key in t else None for t in (a, b))
            if kind != "changed" or x != y:
                want.append((*key, kind, c, x, y))
    got = R.cell_differences(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k", "l"])
    assert plain(got.collect()) == plain(want) and len(want) > 20


def test_differences_edges(spark):
    one, two = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "a", 5)], "k int, x string, y int")
    assert plain(R.cell_differences(one, two, ["k"]).collect()) == [(1, "changed", "y", None, "5")]
    assert R.cell_differences(one.where("false"), one.where("false"), ["k"]).count() == 0
    assert R.cell_differences(one.select("k"), one.select("k"), ["k"]).count() == 0
    with pytest.raises(ValueError, match="old table holds twice"):
        R.cell_differences(one.unionAll(one), one, ["k"])


def test_equal_buckets_are_neither_read_nor_joined(spark, tmp_path):
    path, rows = str(tmp_path / "stage"), spark.range(500).select("id", (F.col("id") * 3).alias("x"))
    R.commit_stage(rows, path, ["id"], 32)
    assert R.changed_buckets(spark, path, rows.repartition(7), ["id"], 32) == []
    rebuilt = rows.where("id <> 17").withColumn("x", F.when(F.col("id") == 40, 1).otherwise(F.col("x")))
    changed = R.changed_buckets(spark, path, rebuilt, ["id"], 32)
    assert 1 <= len(changed) <= 2
    for name in names_in(f"{path}/rows", r"_bucket=\d+"):  # reading any other bucket would fail now
        if int(name.split("=")[1]) not in changed:
            for f in Path(path, "rows", name).glob("*.parquet"):
                f.write_bytes(b"not a parquet file")
    got = R.compare_with_committed(spark, path, rebuilt, ["id"], 32)
    assert plain(got.collect()) == [(17, "removed", "x", "51", None), (40, "changed", "x", "120", "1")]
    shutil.rmtree(path)


def test_guard_passes_and_refuses(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    size = os.path.getsize(f"{sf}/orders.parquet")
    narrow = orders.where("o_orderkey > 100").select("o_orderkey", "o_custkey")
    (scan,) = guard.scans(narrow)
    assert set(scan.columns) == {"o_orderkey", "o_custkey"} and any("GreaterThan(o_orderkey,100)" in f for f in scan.pushed)
    assert 0 < scan.bytes < guard.expected_bytes(orders) <= size
    assert guard.capped(narrow, size, {"orders.parquet": ["o_orderkey"]}) is narrow
    with pytest.raises(guard.TooLarge, match="would read"):
        guard.capped(narrow, scan.bytes - 1)
    with pytest.raises(guard.TooLarge, match="o_custkey"):
        guard.capped(narrow, size, {"orders.parquet": ["o_custkey"]})
    twice = narrow.join(orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    assert len(guard.scans(twice)) == 2


def test_guard_prunes_partitions(spark, tmp_path):
    spark.range(1000).withColumn("p", F.col("id") % 4).write.partitionBy("p").parquet(str(tmp_path / "t"))
    whole = spark.read.parquet(str(tmp_path / "t"))
    part = guard.expected_bytes(whole.where("p = 1"))
    assert 0 < part < guard.expected_bytes(whole) / 3


def test_filters_of_queries_reach_the_reader(spark, sf):
    window = registry.queries()["f01_closed_window"](spark, sf)
    assert any(sum("o_orderdate" in f for f in s.pushed) >= 2 for s in guard.scans(window)), guard.scans(window)
    listed = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_orderkey").isin(3, 5, 7)).select("l_orderkey", "l_linenumber")
    (scan,) = guard.scans(listed)
    assert "In(l_orderkey, [3,5,7])" in scan.pushed and scan.columns == ("l_orderkey", "l_linenumber")
