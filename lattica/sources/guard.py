"""What a plan will read, known before it runs, and refused above a bound."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Scan:
    """One file scan of a plan: its root paths, the columns read, the filters the reader got, and the bytes expected of it."""

    paths: tuple[str, ...]
    columns: tuple[str, ...]
    pushed: tuple[str, ...]
    bytes: int


class TooLarge(ValueError):
    """A plan that would read more than allowed."""


def _each(sequence):
    return [sequence.apply(i) for i in range(sequence.size())]


def _leaves(node):
    """File scans below a physical node, those of subqueries and cached tables included."""
    if node.getClass().getSimpleName() == "FileSourceScanExec":
        yield node
    for child in [*_each(node.children()), *_each(node.innerChildren())]:
        if hasattr(child, "children") and "Exec" in child.getClass().getSimpleName():
            yield from _leaves(child)


def scans(df: DataFrame) -> list[Scan]:
    """The file scans of the plan of ``df``, after column pruning, partition pruning and push-down."""
    out = []
    for node in _leaves(df._jdf.queryExecution().sparkPlan()):
        relation = node.relation()
        filters = node.partitionFilters()
        listed = relation.location().listFiles(filters, node.dataFilters())
        size = sum(f.getLen() for folder in _each(listed) for f in _each(folder.files()))
        width = lambda kind: sum(kind.apply(i).dataType().defaultSize() for i in range(kind.size()))
        whole = relation.dataSchema()
        share = width(node.requiredSchema()) / max(1, width(whole))
        pushed = node.metadata().get("PushedFilters")
        text = pushed.get() if pushed.isDefined() else "[]"
        read = node.requiredSchema()
        out.append(
            Scan(
                tuple(str(p) for p in _each(relation.location().rootPaths())),
                tuple(read.apply(i).name() for i in range(read.size())),
                tuple(re.findall(r"(?:[^,(\[\]]|\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\])+", text[1:-1].strip()) if text != "[]" else ()),
                int(size * min(1.0, share)),
            )
        )
    return out


def expected_bytes(df: DataFrame) -> int:
    """Bytes of the files, by the share of the columns read, that the plan's scans will touch."""
    return sum(s.bytes for s in scans(df))


def capped(df: DataFrame, most_bytes: int, must_filter: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` itself, if its plan reads at most ``most_bytes`` and hands the readers the filters it should; else an error, before any task.

    ``must_filter``: end of a root path -> columns of which a filter must reach the reader of every scan of that table.
    """
    found = scans(df)
    total = sum(s.bytes for s in found)
    if total > most_bytes:
        most = max(found, key=lambda s: s.bytes)
        raise TooLarge(f"the plan would read {total} bytes, {most_bytes} are allowed; most, {most.bytes}, from {most.paths[0]} ({', '.join(most.columns)})")
    for end, columns in (must_filter or {}).items():
        for s in found:
            if any(p.rstrip("/").endswith(end) for p in s.paths):
                bare = [c for c in columns if not any(re.search(rf"\b{re.escape(c)}\b", f) for f in s.pushed)]
                if bare:
                    raise TooLarge(f"no filter on {bare} reaches the reader of {s.paths[0]}; it got {list(s.pushed)}")
    return df
