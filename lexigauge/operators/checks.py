"""Validation as relations: every check returns the rows that break it, so an empty result means that a table is sound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_columns(table: DataFrame, needed: Sequence[str]) -> list[str]:
    """Columns that a table lacks, in the order asked for."""
    return [c for c in needed if c not in table.columns]


def issues(*parts: DataFrame) -> DataFrame:
    """Union of findings (issue, key as text): a dataset is valid if there is none."""
    return reduce(DataFrame.unionByName, parts)


def issue(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The keys of ``rows`` as findings of one kind."""
    return rows.select(F.lit(name).alias("issue"), F.col(key).cast("string").alias("key"))


def repeated(table: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have."""
    return table.groupBy(key).count().where("count > 1").select(key)


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Distinct keys of ``rows`` without a parent row."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(parents.select(F.col(parent).alias(key)).distinct(), key, "left_anti")


def off_distribution(table: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """by, n, expected: values whose count is not the expected one (either may be null)."""
    found = table.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return found.join(expected, by, "full").where(~F.col("n").eqNullSafe(F.col("expected")))


def winner_faults(rows: DataFrame, group: str, label: str, candidate: str, block: str) -> DataFrame:
    """group, fault: groups with a repeated candidate, without exactly one winner, or spread over several blocks."""
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(candidate).alias("candidates"), F.sum(label).alias("winners"), F.countDistinct(block).alias("blocks"))
    kinds = F.array_compact(F.array(F.when(F.col("n") > F.col("candidates"), "repeated_candidate"), F.when(F.col("winners") == 0, "no_winner").when(F.col("winners") > 1, "several_winners"), F.when(F.col("blocks") > 1, "several_blocks")))
    return sums.select(group, F.explode(kinds).alias("fault"))


def differences(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, repeats counted, that only one of two tables has, with side (a or b)."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def probability_faults(scores: DataFrame, group: str, p: str, slack: float = 1e-5) -> DataFrame:
    """group, fault: probabilities that are missing, not finite or outside 0 to 1, and groups that do not add up to one."""
    x = F.col(p)
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    sums = scores.groupBy(group).agg(F.sum(bad.cast("int")).alias("bad"), F.sum(x).alias("total"))
    kinds = F.array_compact(F.array(F.when(F.col("bad") > 0, "not_a_probability"), F.when((F.col("bad") == 0) & (F.abs(F.col("total") - 1) > slack), "does_not_add_up")))
    return sums.select(group, F.explode(kinds).alias("fault"))


def softmax(scores: DataFrame, group: str, x: str) -> DataFrame:
    """``scores`` with p: the softmax of x within a group."""
    every = Window.partitionBy(group)
    rows = scores.withColumn("_peak", F.max(x).over(every))
    rows = rows.withColumn("_total", F.sum(F.exp(F.col(x) - F.col("_peak"))).over(every))
    return rows.withColumn("p", F.exp(F.col(x) - F.col("_peak")) / F.col("_total")).drop("_peak", "_total")


def softmax_loss(scores: DataFrame, group: str, x: str, label: str, times: str | None = None) -> DataFrame:
    """group, loss: the negative log of the winner's softmax; groups without exactly one winner are absent.

    ``times``: a column that says how many losers a row stands for.
    """
    n = F.col(times) if times else F.lit(1)
    sums = scores.withColumn("_peak", F.max(x).over(Window.partitionBy(group))).groupBy(group).agg(F.max("_peak").alias("m"), F.sum(F.exp(F.col(x) - F.col("_peak")) * n).alias("t"), F.sum(F.when(F.col(label) == 1, F.col(x))).alias("w"), F.sum(label).alias("n"))
    return sums.where("n = 1").select(group, F.round(F.ln("t") + F.col("m") - F.col("w"), 6).alias("loss"))


def decoded(table: DataFrame, key: str, column: str, kind: str, levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """(key, value) of a JSON column and (column, key, problem) of what could not be read.

    Up to ``levels`` levels: text that is JSON text inside a JSON string is read again. Problems: ``not_json`` and
    ``not_<kind>``, where the JSON is no object (``map``) or no array.
    """
    body = F.col(column)
    for _ in range(levels - 1):
        inner = F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")
        body = F.when(F.ltrim(body).startswith('"'), inner).otherwise(body)
    rows = table.select(key, F.col(column).alias("_raw"), F.trim(body).alias("_body"))
    typed = F.from_json("_body", "map<string,string>" if kind == "map" else "array<string>")
    whole = F.get_json_object(F.concat(F.lit('{"v":'), F.col("_body"), F.lit("}")), "$.v")
    opens = F.col("_body").startswith("{" if kind == "map" else "[")
    rows = rows.withColumns({"value": typed, "_is": whole.isNotNull(), "_opens": opens})
    problem = F.when(~F.col("_is"), "not_json").when(~F.col("_opens"), f"not_{kind}")
    bad = rows.where("_raw is not null and (not _is or not _opens)").select(F.lit(column).alias("column"), key, problem.alias("problem"))
    return rows.where("_is and _opens").select(key, "value"), bad


def flattened(table: DataFrame, column: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """``table`` with column__field for every (field, type) of a decoded map, lists as column__field__items."""
    value = lambda f: F.try_element_at(F.col(column), F.lit(f))
    one = {f"{column}__{f}__items" if t.startswith("array") else f"{column}__{f}": F.from_json(value(f), t) if t.startswith("array") else value(f).try_cast(t) for f, t in fields}
    return table.withColumns(one).drop(column)


def schema_faults(table: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, rule: the named predicates that a row fails; one that is null fails."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return table.select(key, F.explode(broken).alias("rule"))


def json_faults(table: DataFrame, key: str, column: str, schema: T.StructType | str, required: Sequence[str], enums: dict[str, Sequence[str]], least: dict[str, float]) -> DataFrame:
    """key, rule of a JSON object column: unreadable, missing or unknown fields, values outside an enumeration or too small."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    known = F.array(*[F.lit(f.name) for f in kind.fields])
    rows = table.select(key, F.col(column).alias("_raw"), F.from_json(F.col(column), kind).alias("v"), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("_keys"))
    rules = [("unreadable", F.json_object_keys("_raw").isNotNull())]
    rules += [(f"missing:{f}", F.col(f"v.{f}").isNotNull()) for f in required]
    rules += [(f"enum:{f}", F.col(f"v.{f}").isNull() | F.col(f"v.{f}").isin(*values)) for f, values in enums.items()]
    rules += [(f"minimum:{f}", F.col(f"v.{f}").isNull() | (F.col(f"v.{f}") >= n)) for f, n in least.items()]
    rules += [("additional", F.size(F.array_except("_keys", known)) == 0)]
    return schema_faults(rows, key, rules)


def null_rule(table: DataFrame, key: str, condition: Column, column: str) -> DataFrame:
    """Keys where ``column`` is null although ``condition`` holds, or not null although it does not."""
    return table.where(F.coalesce(condition, F.lit(False)) == F.col(column).isNull()).select(key)


def same_record(notes: DataFrame, sources: DataFrame, key: str, record: str) -> DataFrame:
    """Notes with fault: those whose source is unknown, or belongs to another record than they say."""
    both = notes.join(sources.select(key, F.col(record).alias("_record")), key, "left")
    fault = F.when(F.col("_record").isNull(), "unknown_source").when(F.col("_record") != F.col(record), "other_record")
    return both.select(*notes.columns, fault.alias("fault")).where("fault is not null")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], faults: bool = False) -> DataFrame:
    """1:1 left join that must match every row: the joined rows, or with ``faults`` the keys that have none or several."""
    times = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    if faults:
        found = left.join(times, [*on], "left").where("_n is null or _n > 1")
        return found.select(*on, F.when(F.col("_n").isNull(), "unmatched").otherwise("several").alias("fault"))
    others = [c for c in right.columns if c not in on]
    once = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in others]).where("_n = 1").drop("_n")
    joined = left.join(once.withColumn("_there", F.lit(True)), [*on], "left")
    return joined.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("a row has no match, or several"))).otherwise(F.lit(True))).drop("_there")


def clean_nulls(table: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, so that what is written is valid JSON."""
    odd = lambda c: F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    return table.withColumns({f.name: F.when(~odd(F.col(f.name)), F.col(f.name)) for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
