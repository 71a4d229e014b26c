"""Classes of patent assignees from a type code and a name, as column expressions.

The code is the last digit without the prefix of a partial interest. Individuals are told by it alone. Organisations
and governments look at the name: academic words win, unless a company suffix stands beside them (ambiguous);
a suffix makes a company; an ambiguous word alone leaves it ambiguous; the rest is what the code says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORGANISATION, INDIVIDUAL, GOVERNMENT = ("2", "3"), ("4", "5"), ("6", "7", "8", "9")


def type_code(value: Column, prefix: str = "1") -> Column:
    """One digit, or null where the code is missing, longer, or the prefix alone."""
    text = F.regexp_replace(F.trim(value.cast("string")), "\\.0$", "")
    return F.nullif(F.regexp_extract(text, f"^{prefix}?([^{prefix}])$", 1), F.lit(""))


def holds_word(name: Column, words: list[str]) -> Column:
    """Whether one of ``words`` stands in ``name`` as a whole word, case ignored."""
    some = "|".join("\\Q" + w + "\\E" for w in words)
    return F.coalesce(name, F.lit("")).rlike(f"(?i)(?<!\\w)(?:{some})(?!\\w)") if words else F.lit(False)


def assignee_class(code: Column, name: Column, academic: list[str], ambiguous: list[str], suffixes: list[str]) -> Column:
    """company, academic, government, individual, ambiguous or unknown."""
    school, company, unclear = (holds_word(name, words) for words in (academic, suffixes, ambiguous))
    government, named = code.isin(*GOVERNMENT), code.isin(*ORGANISATION, *GOVERNMENT)
    return (
        F.when(code.isin(*INDIVIDUAL), "individual")
        .when(~F.coalesce(named, F.lit(False)), "unknown")
        .when(school, F.when(company, "ambiguous").otherwise("academic"))
        .when(company, "company")
        .when(unclear, "ambiguous")
        .when(government, "government")
        .otherwise("company")
    )
