"""Text functions: keys, lexicon rates, structure features, sentence types, rule screens, name spans and masks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English lexicon, version 1 (fixed values).
LEXICON = {
    "authority": ["audited", "audit", "independent", "certified", "verified", "peer reviewed", "court proven", "no logs policy", "transparency report", "open source", "published", "lab tested", "clinically tested", "dermatologist", "benchmark", "benchmarked"],
    "social_proof": ["most popular", "widely used", "millions of users", "industry standard", "market leader", "best selling", "top rated", "award winning", "editors choice", "recommended by", "trusted by"],
    "specificity": ["per month", "gbps", "mbps", "servers in", "countries", "money back", "free tier", "uptime", "latency", "encryption", "aes 256", "wireguard", "concentration", "spf"],
    "hedging": ["may", "might", "could", "depends", "generally", "typically", "in some cases", "your mileage", "not for everyone"],
    "superlative": ["best", "fastest", "cheapest", "top", "leading", "ultimate", "number one", "greatest"],
}
#: Wins of each sentence type out of 60 appearances, for two assistants (fixed values).
WINS = {"technical": (21, 40), "price": (21, 30), "statistics": (22, 13), "cited_test": (19, 2), "social_proof": (14, 2), "certificate": (4, 14), "authority": (8, 16), "expert_quote": (6, 9), "superlative": (12, 8), "emotional": (2, 2)}


def comparison_key(text: Column) -> Column:
    """Letters and digits only, trade marks removed, every i of Turkish folded, lower case."""
    folded = F.lower(F.translate(F.translate(text, "™®©", ""), "İIı", "iii"))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")


def text_key(text: Column) -> Column:
    """Lower case, runs of other characters than a-z, 0-9 and Turkish letters as one space, a space at both ends."""
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "İIı", "iii"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, "[^0-9a-zçğöşü]+", " ")), F.lit(" "))


def turkish_casefold(text: Column) -> Column:
    """Lower case with I as ı and İ as i."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def ascii_key(text: Column) -> Column:
    """a-z and 0-9 only, common accents stripped."""
    return F.regexp_replace(F.translate(F.lower(F.translate(text, "Iİ", "ii")), "çğıöşüâîûàáäãåéèêëíìïóòôõúùñß", "cgiosuaiuaaaaaeeeeiiioooouuns"), "[^a-z0-9]", "")


def lexicon_counts(key: Column, lexicon: dict[str, list[str]] = LEXICON) -> list[Column]:
    """Non-overlapping occurrences of each group's terms in a ``text_key``."""
    return [sum((((F.length(key) - F.length(F.replace(key, F.lit(f" {t} "), F.lit("")))) / F.lit(len(t) + 2)).cast("long") for t in terms), F.lit(0).cast("long")).alias(f"lex_{group}") for group, terms in lexicon.items()]


def structure(text: Column) -> list[Column]:
    """Shape of an answer: length, headers, tables, lists, years, share of digits."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    return [
        F.length(body).cast("long").alias("chars"),
        F.size(words).cast("long").alias("words"),
        body.rlike(r"(?m)^#{1,6} ").alias("has_headers"),
        (F.regexp_count(body, F.lit(r"(?m)^\|.*\|$")) >= 2).alias("has_table"),
        body.rlike(r"(?m)^[ \t]*[0-9]+[.)] ").alias("has_numbered"),
        body.rlike(r"(?m)^[ \t]*[-*] ").alias("has_bullets"),
        body.rlike(r"\b(19|20)[0-9]{2}\b").alias("has_year"),
        F.round(F.try_divide(F.length(F.regexp_replace(body, "[^0-9]", "")).cast("double"), F.length(body).cast("double")), 6).alias("digit_share"),
    ]


#: Terms of search queries that ask to compare, that name brands, that ask for what is current (fixed values).
COMPARISON = ("karşılaştır", "versus", " vs ", "hangisi", "en iyi", "compare", "best")
BRAND_TERMS = ("vpn", "nordvpn", "expressvpn", "proton", "mullvad", "surfshark", "marka", "brand", "kozmetik")
CURRENT = ("güncel", "şu anda", "bugün", "son", "current", "latest", "now")


def search_trace(calls: Column, found: Column, comparison: tuple[str, ...] = COMPARISON, brands: tuple[str, ...] = BRAND_TERMS, current: tuple[str, ...] = CURRENT) -> list[Column]:
    """What an answer has searched for: numbers of searches, rounds and results, and what its queries contain.

    ``calls``: array of struct(round, query), empty and null queries count as searches but ask nothing; ``found``: array
    of the numbers of results that the searches have returned. Null arrays are empty.
    """
    each = F.transform(calls, lambda x: F.struct(x["round"].cast("int").alias("round"), x["query"].alias("query")))
    each = F.coalesce(each, F.array().cast("array<struct<round:int,query:string>>"))
    asked = F.filter(F.transform(each, lambda x: x["query"]), lambda q: q.isNotNull() & (q != ""))
    padded = F.transform(asked, lambda q: F.concat(F.lit(" "), F.lower(q), F.lit(" ")))
    has = lambda terms: F.exists(padded, lambda q: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(q, t)))
    return [
        F.size(each).cast("long").alias("num_searches"),
        F.size(F.array_distinct(F.transform(each, lambda x: F.coalesce(x["round"], F.lit(0))))).cast("long").alias("num_search_rounds"),
        F.aggregate(F.coalesce(found, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0))).alias("num_search_results_returned"),
        F.exists(asked, lambda q: q.rlike(r"\b(19|20)[0-9]{2}\b")).alias("query_contains_year"),
        has(comparison).alias("query_contains_comparison_terms"), has(brands).alias("query_contains_brand_names"), has(current).alias("query_contains_currentness_terms"),
    ]


def sentences(text: Column) -> Column:
    """Parts after . ! ? ; and white space, and lines; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def verdicts(spark: SparkSession) -> DataFrame:
    """Sentence type -> shares and verdict: strong if both assistants reach 0.3, mixed if one does, else weak."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in WINS.items()], "type string, a long, b long")
    x, y = F.round(F.col("a") / F.lit(60.0), 6), F.round(F.col("b") / F.lit(60.0), 6)
    return rows.select("type", x.alias("first_share"), y.alias("second_share"), F.when((x >= 0.3) & (y >= 0.3), "strong").when((x >= 0.3) | (y >= 0.3), "mixed").otherwise("weak").alias("verdict"))


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ratio: Ratcliff-Obershelp similarity of two strings."""
    import difflib

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", ratio(a, b))


def snippet_features(text: Column, snippets: Column, lexicon: dict[str, list[str]] = LEXICON) -> list[Column]:
    """Of the joined snippets of a candidate: occurrences of each group per snippet, words per snippet, share of digits,
    whether a year is named; all zero without a snippet."""
    n = F.greatest(snippets, F.lit(1)).cast("double")
    key, body = text_key(text), F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(F.trim(key), " "), lambda w: w != ""))
    digits = F.try_divide(F.length(F.regexp_replace(body, "[^0-9]", "")).cast("double"), F.length(body).cast("double"))
    rates = [F.round(x / n, 6).alias(f"{group}_rate") for group, x in zip(lexicon, lexicon_counts(key, lexicon), strict=True)]
    return [*rates, F.round(words / n, 6).alias("words_per_snippet"), F.round(F.coalesce(digits, F.lit(0.0)), 6).alias("digit_share"), body.rlike(r"(?-U)(^|[^0-9A-Za-z_])(19|20)[0-9]{2}([^0-9A-Za-z_]|$)").cast("long").alias("has_year")]


def alias_pairs(names: DataFrame, least: float) -> DataFrame:
    """a, b, ratio: pairs of distinct names (column name, a < b) whose similarity is ``least`` or more, under 1.

    No pair is missed: the ratio is at most twice the letters in common over all letters. So lengths lie within a band, and
    of the letters of a, rarest first and repeats numbered, two of the first n - ceil(c) + 2 are among those of b, where c
    is what a must share with the shortest name of its band (2 at least, for names of several letters). Names meet on pairs
    of such letters; only those that pass the bound on their common letters are compared.
    """
    share = least / 2
    each = names.select("name", F.length("name").alias("n"), F.posexplode(F.filter(F.split("name", ""), lambda ch: ch != "")).alias("i", "ch"))
    from pyspark.sql import Window

    copy = F.row_number().over(Window.partitionBy("name", "ch").orderBy("i"))
    each = each.select("name", "n", F.concat("ch", copy.cast("string")).alias("letter"))
    often = each.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    sets = each.join(often, "letter").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("often", "letter"))).alias("s")).select("name", "n", F.transform("s", lambda x: x["letter"]).alias("letters"))
    # a shares c of its n letters at least with a name of any length in its band: the shortest has n * share / (1 - share)
    c = F.ceil(F.lit(share) * (F.col("n") + F.col("n") * share / (1 - share)) - 1e-9)
    first = sets.where("n > 1").select("name", "n", "letters", F.slice("letters", 1, (F.col("n") - c + 2).cast("int")).alias("p"))
    two = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda b: F.concat_ws(" ", a, b))))
    short = first.select("name", "n", "letters", F.explode(two).alias("letter"))
    x, y = short.alias("x"), short.alias("y")
    band = (F.col("x.n") * share <= F.col("y.n") * (1 - share) + 1e-9) & (F.col("y.n") * share <= F.col("x.n") * (1 - share) + 1e-9)
    both = x.join(y, (F.col("x.letter") == F.col("y.letter")) & (F.col("x.name") < F.col("y.name")) & band)
    common = F.size(F.array_intersect("x.letters", "y.letters"))
    near = both.where(common >= F.lit(share) * (F.col("x.n") + F.col("y.n")) - 1e-9).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    return similarity(near, "a", "b").where((F.col("ratio") >= least) & (F.col("ratio") < 1))


#: SQL functions of one text: name and body; t is the text.
SQL = {
    "turkish_casefold": "lower(translate(t, 'Iİ', 'ıi'))",
    "comparison_key": r"regexp_replace(lower(translate(translate(t, '™®©', ''), 'İIı', 'iii')), '[^\\p{L}\\p{N}]', '')",
    "text_key": "concat(' ', trim(regexp_replace(lower(translate(coalesce(t, ''), 'İIı', 'iii')), '[^0-9a-zçğöşü]+', ' ')), ' ')",
    "ascii_key": "regexp_replace(translate(lower(translate(t, 'Iİ', 'ii')), 'çğıöşüâîûàáäãåéèêëíìïóòôõúùñß', 'cgiosuaiuaaaaaeeeeiiioooouuns'), '[^a-z0-9]', '')",
    "collapsed": r"regexp_replace(lower(translate(t, 'İ', 'i')), '\\s+', ' ')",
    "slug": "regexp_replace(regexp_replace(lower(translate(t, 'İIı', 'iii')), '[^a-z0-9]+', '-'), '^-|-$', '')",
    "brand_key": r"trim(regexp_replace(lower(translate(translate(t, '™®©', ''), 'Iİ', 'ıi')), '[^\\p{L}\\p{N}]+', ' '))",
    "url_host": "nullif(regexp_extract(lower(t), '^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '')",
    "url_domain": "lower(substring_index(regexp_replace(coalesce(t, ''), '^https?://', ''), '/', 1))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the text functions callable from SQL as temporary SQL functions of the session; returns their names."""
    for name, body in SQL.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns string return {body}")
    return list(SQL)
