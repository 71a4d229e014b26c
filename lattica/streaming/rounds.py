"""Asking a classifier about groups of records until one answers yes, over a stream, with state per group.

The state of a group is whether it is closed, and survives restarts in the stream's checkpoint. Records of open groups are asked in
order, those of closed ones not at all, so a stream asks what the batch form (``operators.relational.until_first_hit``) keeps, as long as a group's
records arrive in order; within a micro-batch they are sorted. Groups with a hit in an earlier micro-batch cost nothing but a look-up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType


def ask_open_groups(records: DataFrame, group: list[str], order: list[str], ask: Callable, hit: str = "hit") -> DataFrame:
    """The records asked, with ``hit``, the answer of ``ask`` (a dict of the record's columns -> bool); one yes closes the group."""
    names = records.columns
    schema = StructType([*records.schema.fields, StructField(hit, BooleanType())])

    def work(key, frames, state):
        import pandas as pd

        closed = state.exists and state.get[0]
        if closed:
            for _ in frames:
                pass
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")  # a group's part of one micro-batch
        asked = []
        for record in rows.to_dict("records"):
            closed = bool(ask(record))
            asked.append({**record, hit: closed})
            if closed:
                break
        state.update((closed,))
        yield pd.DataFrame(asked, columns=[*names, hit])

    return records.groupBy(*group).applyInPandasWithState(work, schema, "closed boolean", "append", "NoTimeout")
