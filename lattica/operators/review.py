"""Review sheets, classifier outputs and rule checks as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_sheet(sheet: DataFrame, original: DataFrame, key: str, fixed: list[str], allowed: dict[str, list[str]], rules: dict[str, Column] | None = None) -> DataFrame:
    """key, problem for every row that is missing, extra, repeated, changed in a fixed column, out of a column's values, or
    against a rule between columns (``rules``: name and the condition that must hold)."""
    once = sheet.groupBy(key).agg(F.count("*").alias("n"))
    problems = once.where("n > 1").select(key, F.lit("repeated").alias("problem"))
    problems = problems.unionAll(original.join(sheet, key, "left_anti").select(key, F.lit("missing")))
    problems = problems.unionAll(sheet.join(original, key, "left_anti").select(key, F.lit("extra")))
    both = sheet.alias("s").join(original.select(key, *(F.col(c).alias(f"_o_{c}") for c in fixed)), key)
    for c in fixed:
        problems = problems.unionAll(both.where(~F.col(c).eqNullSafe(F.col(f"_o_{c}"))).select(key, F.lit(f"changed {c}")))
    for c, values in allowed.items():
        problems = problems.unionAll(sheet.where(~F.coalesce(F.col(c).isin(values), F.lit(False))).select(key, F.lit(f"value of {c}")))
    for name, holds in (rules or {}).items():
        problems = problems.unionAll(sheet.where(~F.coalesce(holds, F.lit(False))).select(key, F.lit(name)))
    return problems


def parsed_answer(text: Column, schema: str) -> Column:
    """The struct of the first JSON object in a free text, null where none parses."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)(\\{.*\\})", 1)
    parsed = F.from_json(found, schema)
    return F.when((found != "") & F.exists(F.array(*(parsed[n.split()[0]].isNotNull() for n in schema.split(", "))), lambda x: x), parsed)


def agreement(rows: DataFrame, human: str, rule: str, by: list[str], least: float) -> DataFrame:
    """Per group of ``by``: the 2x2 counts of two yes/no judgements, the human share of yes with its interval, and whether its lower
    end reaches ``least``."""
    from ..functions.scalar import wilson

    yes, flag = F.col(human), F.col(rule)
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(yes & flag).alias("both_yes"), F.count_if(yes & ~flag).alias("human_only"), F.count_if(~yes & flag).alias("rule_only"), F.count_if(~yes & ~flag).alias("neither"))
    k = F.col("both_yes") + F.col("human_only")
    lower, upper = wilson(k, F.col("n"))
    return n.withColumns({"share": k / F.col("n"), "lower": lower, "upper": upper}).withColumn("passes", F.col("lower") >= least)


def records(rows: DataFrame, key: list[str], terms: list[str], text: list[str]) -> DataFrame:
    """Nested inputs of a classifier: per key the text fields as one struct and the distinct terms as a sorted array of structs."""
    return rows.groupBy(*key).agg(F.first(F.struct(*text)).alias("text"), F.array_sort(F.collect_set(F.struct(*terms))).alias("terms"))


def relation_of_roles(roles: Column) -> Column:
    """Combination if at least two parts are used together, comparison if all are baselines, else other."""
    used = F.size(F.filter(roles, lambda r: r == "used"))
    return F.when(used >= 2, "combination").when((F.size(roles) > 0) & F.forall(roles, lambda r: r == "baseline"), "comparison").otherwise("other")


def label_table(outputs: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """n_classified, n_combination and the label of each group; a negative needs every row classified, else null."""
    n = F.count_if(F.col("relation") == "combination")
    done = F.count("relation")
    return outputs.groupBy(*keys).agg(done.alias("n_classified"), n.alias("n_combination"), F.when(n >= minimum, True).when(done == F.count("*"), False).alias("label"))


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def bundle(rows: DataFrame, key: list[str], source: str, order: list[Column], k: int, fields: list[str]) -> DataFrame:
    """Per key an array of the best ``k`` rows of a source as structs, in order."""
    from .relational import top_per_group
    from pyspark.sql.window import Window

    top = top_per_group(rows, key, order, k).withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    packed = F.array_sort(F.collect_list(F.struct("_i", *fields)))
    return top.groupBy(*key).agg(F.transform(packed, lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias(source))


def bundles(candidates: DataFrame, sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Every candidate with the arrays of its sources (see ``bundle``); empty where a source has nothing for it."""
    out = candidates
    for source in sources:
        out = out.join(source, key, "left")
    names = [c for s in sources for c in s.columns if c not in key]
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in names})
