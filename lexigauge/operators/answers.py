"""Reading answers: which brands they name and recommend, which results and snippets speak of a brand."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions import names as nm
from lexigauge.functions.names import Registry
from lexigauge.operators.rates import ratio


def outcomes(answers: DataFrame, registry: Registry, recommends: str, alternative: str, target: str | None = None, read: str = "text") -> DataFrame:
    """``answers`` (any keys, text) with named, n_named, first_named, first_brand, pick_method.

    Lines with a pipe (tables) are not read for the pick. The first sentence that recommends, names no alternative and
    exactly one brand decides (``sentence``), else the first bold part with exactly one (``bold``), else the first brand
    named (``first_mention``), else none. With ``target`` also first, mentioned (0 or 1) and rank (null if not named).
    The pick is read from the column ``read`` (see ``spelt``), what is named from text.
    """
    text, whole = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col(read), F.lit(""))
    prose = F.array_join(F.filter(F.split(whole, "\r?\n"), lambda line: ~line.contains("|")), "\n")
    one = lambda parts: F.filter(F.transform(parts, lambda s: F.array_distinct(nm.names_in(s, registry))), lambda b: F.size(b) == 1)
    said = F.filter(F.regexp_extract_all("prose", F.lit(r"[^.!?\n]+"), F.lit(0)), lambda s: s.rlike(recommends) & ~s.rlike(alternative))
    bold = F.regexp_extract_all("prose", F.lit(r"(?s)\*\*(.+?)\*\*"), F.lit(1))
    rows = answers.withColumns({"prose": prose, "named": F.array_distinct(nm.names_in(text, registry))})
    rows = rows.withColumns({"by_sentence": F.get(F.get(one(said), F.lit(0)), F.lit(0)), "by_bold": F.get(F.get(one(bold), F.lit(0)), F.lit(0)), "first_named": F.get("named", F.lit(0))})
    if read != "text":
        rows = rows.withColumn("by_mention", F.get(nm.names_in(whole, registry), F.lit(0)))
    mention = F.col("first_named" if read == "text" else "by_mention")
    method = F.when(F.col("by_sentence").isNotNull(), "sentence").when(F.col("by_bold").isNotNull(), "bold").when(mention.isNotNull(), "first_mention").otherwise("none")
    rows = rows.withColumns({"n_named": F.size("named").cast("long"), "first_brand": F.coalesce(F.col("by_sentence"), F.col("by_bold"), mention), "pick_method": method}).drop("prose", "by_sentence", "by_bold", "by_mention")
    if target is None:
        return rows
    place = F.array_position("named", F.lit(target))
    return rows.withColumns({"first": F.coalesce((F.col("first_brand") == target).cast("long"), F.lit(0).cast("long")), "mentioned": (place > 0).cast("long"), "rank": F.when(place > 0, place)})


def misspelt(words: DataFrame, registry: Registry) -> DataFrame:
    """word, place: the rows of ``words`` (word, lower case, distinct) one letter off a word of the form at that place of the
    registry.

    One letter is missing, too many, another one, or two neighbours are swapped; both words have five letters or more (six
    where they are of one length) and begin alike. Every form's words are indexed by what is left of them without each of
    their letters; a word meets the index by equi-join on the same, so no pair of words is made that shares none.
    """
    index = []
    for place, (_, form) in enumerate(registry):
        for w in {x.lower() for x in re.findall(r"\w+", form) if len(x) >= 5}:
            index += [(w, -1, "", w, place), *((w[:i] + w[i + 1 :], i, w[i], w, place) for i in range(len(w)))]
    schema = "rest string, at int, gone string, known string, place int"
    known = words.sparkSession.createDataFrame(index, schema)  # a bounded dimension, as the registry
    lengths = [len(k[3]) for k in index] or [0]
    apt = words.where(F.length("word").between(max(5, min(lengths) - 1), max(lengths) + 1)).where(F.substring("word", 1, 1).isin(sorted({k[3][0] for k in index})))
    cut = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(F.concat(F.substring(F.col("word"), F.lit(1), i), F.substring(F.col("word"), i + 2, F.length("word"))).alias("rest"), i.alias("own"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("left")))
    rests = apt.select("word", F.inline(F.concat(F.array(F.struct(F.col("word").alias("rest"), F.lit(-1).alias("own"), F.lit("").alias("left"))), cut)))
    swapped = (F.abs(F.col("own") - F.col("at")) == 1) & (F.col("left") == F.col("gone"))
    both = (F.col("own") >= 0) & (F.col("at") >= 0) & ((F.col("own") == F.col("at")) | swapped) & (F.length("word") >= 6)
    one = (F.col("own") >= 0) != (F.col("at") >= 0)
    near = rests.join(known, "rest").where((F.col("word") != F.col("known")) & (F.substring("word", 1, 1) == F.substring("known", 1, 1)) & (both | one))
    return near.select("word", "place").distinct()


def spelt(answers: DataFrame, registry: Registry, key: str = "record_id") -> DataFrame:
    """``answers`` with spelt: the text in which a misspelt name of a brand that the text nowhere spells right is followed
    by that brand's form. ``key`` tells answers apart; null texts are empty."""
    word = r"[\p{L}\p{N}_]+"
    text = F.coalesce(F.col("text"), F.lit(""))
    said = answers.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.lower))).alias("word"))
    close = said.join(misspelt(said.select("word").distinct(), registry), "word")
    brands, forms = (F.array(*[F.lit(r[k]) for r in registry]) for k in (0, 1))
    found = close.groupBy(key).agg(F.collect_set(F.struct("word", "place")).alias("_close"))
    rows = answers.join(found, key, "left").withColumn("_named", F.array_distinct(nm.names_in(text, registry)))
    absent = F.array_sort(F.filter("_close", lambda c: ~F.array_contains(F.col("_named"), F.get(brands, c["place"]))))
    added = lambda piece: F.transform(F.filter("_absent", lambda c: c["word"] == F.lower(piece)), lambda c: F.get(forms, c["place"]))
    pieces = F.regexp_extract_all(text, F.lit(f"{word}|[^\\p{{L}}\\p{{N}}_]+"), F.lit(0))
    fixed = F.array_join(F.transform(pieces, lambda p: F.concat_ws(" ", p, added(p))), "")
    rows = rows.withColumn("_absent", absent)
    return rows.withColumn("spelt", F.when(F.size("_absent") > 0, fixed).otherwise(text)).drop("_close", "_named", "_absent")


def result_mentions(results: DataFrame, registry: Registry) -> DataFrame:
    """Result x brand rows (keys of ``results``, brand) of the brands that a result's text mentions.

    Each text is read once against the whole registry, so the join costs no pair of result and brand that is not one.
    """
    return results.select(*[c for c in results.columns if c != "text"], F.explode(nm.mentioned(F.col("text"), registry)).alias("brand"))


def snippets(results: DataFrame, registry: Registry) -> DataFrame:
    """record_id, brand, n_snippets, snippet: texts that mention a brand, in order of position; brands that no result of an
    answer mentions have an empty snippet.

    ``results``: record_id, position, text. An answer has a few results, which bounds its group.
    """
    brands = sorted({b for b, _ in registry})
    hits = results.select("record_id", "position", "text", F.explode(nm.mentioned(F.col("text"), registry)).alias("brand"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ")
    found = hits.groupBy("record_id", "brand").agg(F.count(F.lit(1)).alias("n_snippets"), joined.alias("snippet"))
    grid = results.select("record_id").distinct().select("record_id", F.explode(F.array(*[F.lit(b) for b in brands])).alias("brand"))
    return grid.join(found, ["record_id", "brand"], "left").select("record_id", "brand", F.coalesce("n_snippets", F.lit(0).cast("long")).alias("n_snippets"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def retrieval_presence(results: DataFrame, registry: Registry, own: dict[str, str]) -> DataFrame:
    """record_id, brand, first_position, n_results: results that name a brand or lie on its own domain (brand -> stem)."""
    stems = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
    brands = F.array_distinct(F.concat(nm.names_in(F.col("text"), registry), F.filter(F.map_keys(stems), lambda b: F.contains(F.coalesce("host", F.lit("")), F.element_at(stems, b)))))
    rows = results.select("record_id", "position", F.explode(brands).alias("brand"))
    return rows.groupBy("record_id", "brand").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_results"))


def observations(answers: DataFrame, registry: Registry, presence: DataFrame, target: str) -> DataFrame:
    """One row per answer (record_id, text): mentioned, first, position among the named, present, first_result, n_results."""
    named = F.array_distinct(nm.names_in(F.col("text"), registry))
    place = F.array_position("named", F.lit(target))
    rows = answers.select("record_id", named.alias("named")).join(presence.where(F.col("brand") == target), "record_id", "left")
    return rows.select(
        "record_id", (place > 0).cast("long").alias("mentioned"), (place == 1).cast("long").alias("first"), F.when(place > 0, place).alias("position"),
        F.col("brand").isNotNull().cast("long").alias("present"), F.col("first_position").alias("first_result"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
    )


def named_rates(outcome: DataFrame, by: str) -> DataFrame:
    """Per group and brand: answers, share that name it, share that pick it."""
    total = outcome.groupBy(by).agg(F.count(F.lit(1)).alias("answers"))
    named = outcome.select(by, F.explode("named").alias("brand")).groupBy(by, "brand").agg(F.count(F.lit(1)).alias("mentions"))
    picked = outcome.where("first_brand is not null").groupBy(by, F.col("first_brand").alias("brand")).agg(F.count(F.lit(1)).alias("picks"))
    rows = named.join(picked, [by, "brand"], "full").join(total, by)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(by, "brand", "answers", zero("mentions").alias("mentions"), zero("picks").alias("picks"), ratio(zero("mentions"), F.col("answers")).alias("mention_share"), ratio(zero("picks"), F.col("answers")).alias("pick_share"))


def top_picked(rates: DataFrame, by: str, target: str, k: int = 5) -> DataFrame:
    """The rivals of ``target`` that are picked most, ``k`` per group, names breaking ties."""
    order = Window.partitionBy(by).orderBy(F.desc("picks"), "brand")
    return rates.where((F.col("brand") != target) & (F.col("picks") > 0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "brand", "picks", "rank")


def echo(answers: DataFrame, by: str, claim: str, warns: str) -> DataFrame:
    """Per arm: answers, how many echo a claim, how many of these warn of it (null without any), how many warn at all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = answers.select(by, text.rlike(claim).cast("int").alias("e"), text.rlike(warns).cast("int").alias("w"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("answers"), F.avg("e").alias("e"), F.avg(F.when(F.col("e") == 1, F.col("w"))).alias("ew"), F.avg("w").alias("w"))
    return out.select(by, "answers", F.round("e", 6).alias("echo_rate"), F.round("ew", 6).alias("warn_given_echo"), F.round("w", 6).alias("warn_rate"))


def edited(names: Column, add: Column, drop: Column) -> Column:
    """A list of names with a user's corrections: dropped ones out, added ones behind, each key once, order kept."""
    key = lambda x: nm.comparison_key(x)
    gone = F.transform(drop, key)
    kept = F.filter(F.concat(names, add), lambda n: ~F.array_contains(gone, key(n)))
    keys = F.transform(kept, key)
    return F.filter(kept, lambda n, i: F.array_position(keys, key(n)) == i + 1)
