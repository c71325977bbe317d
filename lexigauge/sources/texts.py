"""Answers and results as texts: the given conversations stand in for recorded ones, and words of them for brand names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.sources.corpus import table

#: (brand, form): invented names that occur in the given texts; two forms of one brand, two short ones.
REGISTRY = (
    ("Thtion", "thtion"), ("Retion", "retion"), ("Antion", "antion"), ("Ertion", "ertion"), ("Ontion", "ontion"), ("Hetion", "hetion"),
    ("Enkeit", "enkeit"), ("Enkeit", "enheit"), ("Erlich", "erlich"), ("Nmente", "nmente"), ("Que", "Que"), ("Der", "Der"),
)
TARGET = "Thtion"
#: brand -> stem of its own domain.
OWN = {"Thtion": "site3", "Erlich": "site5"}


def answer_texts(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, arm, text of every answer: assistants' turns."""
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("arm"), "text")


def result_texts(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, position, host, text of every result: users' turns are what a conversation has found."""
    rows = table(spark, folder, "conversations").where("role = 'user'")
    return rows.select(F.col("conv_id").alias("record_id"), F.col("turn").cast("int").alias("position"), F.concat(F.lit("site"), (F.col("conv_id") % 7).cast("string"), F.lit(".example.com")).alias("host"), "text")


# ---- the same for DuckDB --------------------------------------------------------------------------------------------
WORD, PIECE = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
ANSWERS_SQL = "answer_texts as (select concat_ws('-', conv_id, turn) as record_id, concat('turn', turn) as arm, text from conversations where role = 'assistant')"
RESULTS_SQL = "result_texts as (select conv_id as record_id, cast(turn as integer) as position, concat('site', conv_id % 7, '.example.com') as host, text from conversations where role = 'user')"
KEY_SQL = "regexp_replace(lower(translate(translate({0}, '™®©', ''), 'İIı', 'iii')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
TEXT_KEY_SQL = "concat(' ', trim(regexp_replace(lower(translate(coalesce({0}, ''), 'İIı', 'iii')), '[^0-9a-zçğöşü]+', ' ', 'g')), ' ')"


def brand_sql(word: str) -> str:
    """Brand of one word: short names as they are spelt, others whatever their case."""
    long = " ".join(f"when '{f}' then '{b}'" for b, f in REGISTRY if len(f) >= 4)
    short = " ".join(f"when '{f}' then '{b}'" for b, f in REGISTRY if len(f) < 4)
    return f"coalesce(case {word} {short} end, case lower({word}) {long} end)"


def names_sql(text: str) -> str:
    """Brands of a text in order, one for each place."""
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{WORD}'), lambda x: {brand_sql('x')}), lambda b: b is not null)"


def distinct_sql(items: str) -> str:
    """Order-preserving distinct of a list column."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def mentioned_sql(text: str) -> str:
    """Brands that a text mentions, in order of the registry."""
    squashed = f"replace({TEXT_KEY_SQL.format(text)}, ' ', '')"
    tests: dict[str, list[str]] = {}
    for b, f in REGISTRY:
        tests.setdefault(b, []).append(f"contains({squashed}, '{f}')" if len(f) >= 4 else f"regexp_matches(coalesce({text}, ''), '(^|[^\\p{{L}}\\p{{N}}_]){f}($|[^\\p{{L}}\\p{{N}}_])')")
    return "list_filter([" + ", ".join(f"case when {' or '.join(t)} then '{b}' end" for b, t in tests.items()) + "], lambda b: b is not null)"


def texts_oracle(select: str, *more: str) -> str:
    """DuckDB text of ``select`` over the text tables."""
    return "with " + ", ".join([ANSWERS_SQL, RESULTS_SQL, *more]) + "\n" + select
