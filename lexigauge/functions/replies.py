"""What models reply, read and checked: brand profiles and questions, as expressions over JSON texts.

Nothing that a reply says is taken on trust: aliases and sentences must stand in the source text, questions must ask for a
choice or name the brand. A reply that cannot be used is a row with its fault.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.functions.names import collapsed

PROFILE = "brand string, aliases array<string>, sector string, language string, products array<struct<name:string,category:string,sentences:array<string>>>"
QUESTIONS = "discovery array<string>, named array<string>"
#: Parts of questions that ask for a choice (fixed values).
CHOICE = ("hangi", "hangisi", "öner", "oner", "en iyi", "en uygun", "tavsiye", "karşılaştır", "which", "best", "recommend")
#: Languages that a profile may have; the first stands for any other (fixed values).
LANGUAGES = ("tr", "en")


def json_body(reply: Column) -> Column:
    """A reply without the fence of backticks and the word json around its JSON."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), "^`+|`+$", ""))
    return F.trim(F.regexp_replace(bare, "^json", ""))


def name_key(text: Column) -> Column:
    """Letters and digits only, lower case, common accents and dots off: different spellings of a name are equal."""
    plain = F.translate(F.lower(F.translate(text, "İIı", "iii")), "çğöşüâîûàáäãåéèêëíìïóòôõúùñ", "cgosuaiuaaaaaeeeeiiioooouun")
    return F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")


def _texts(items: Column) -> Column:
    """Trimmed, distinct, non-empty texts of an array; a null one is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def parse_profile(rows: DataFrame, reply: str, text: str, most_aliases: int = 4, most_products: int = 5, most_sentences: int = 2) -> DataFrame:
    """``rows`` without ``reply``, with brand, aliases, sector, language, products (name, category, sentences) and fault.

    Aliases are other spellings of the name that stand in ``text``, not the name with a suffix. Products without a name or
    a category drop out, and of their sentences those that do not stand in the text, whatever white space and case. fault:
    ``not JSON`` or ``no brand or sector``, else null; such rows have no profile.
    """
    body = json_body(F.col(reply))
    known = F.json_object_keys(body).isNotNull()
    found = rows.withColumns({"_p": F.when(known, F.from_json(body, PROFILE)), "_source": F.trim(collapsed(F.coalesce(text, F.lit("")))), "_key": name_key(F.coalesce(text, F.lit("")))})
    brand, sector = F.trim(F.coalesce("_p.brand", F.lit(""))), F.trim(F.coalesce("_p.sector", F.lit("")))
    fault = F.when(~F.coalesce(known, F.lit(False)), "not JSON").when((brand == "") | (sector == ""), "no brand or sector")

    def spelling(alias: Column) -> Column:
        low = F.lower(alias)
        return (low != F.lower(brand)) & ~alias.rlike("['’]") & ~F.startswith(low, F.concat(F.lower(brand), F.lit(" "))) & F.contains(F.col("_key"), name_key(alias))

    aliases = F.slice(F.filter(_texts(F.col("_p.aliases")), spelling), 1, most_aliases)
    stands = lambda s: F.contains(F.col("_source"), F.trim(collapsed(s)))
    said = lambda items: F.slice(F.filter(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), stands), 1, most_sentences)
    clean = F.transform("_p.products", lambda p: F.struct(F.trim(F.coalesce(p["name"], F.lit(""))).alias("name"), F.trim(F.coalesce(p["category"], F.lit(""))).alias("category"), said(p["sentences"]).alias("sentences")))
    products = F.slice(F.filter(F.coalesce(clean, F.array().cast("array<struct<name:string,category:string,sentences:array<string>>>")), lambda p: (p["name"] != "") & (p["category"] != "")), 1, most_products)
    language = F.lower(F.trim(F.coalesce("_p.language", F.lit(LANGUAGES[0]))))
    fine = lambda c: F.when(fault.isNull(), c)
    columns = [F.col(c) for c in rows.columns if c != reply]
    return found.select(*columns, fine(brand).alias("brand"), fine(aliases).alias("aliases"), fine(sector).alias("sector"), fine(F.when(language.isin(*LANGUAGES), language).otherwise(LANGUAGES[0])).alias("language"), fine(products).alias("products"), fault.alias("fault"))


def parse_questions(rows: DataFrame, reply: str, names: str, products: str, most_discovery: int = 3, most_named: int = 2, cues: Sequence[str] = CHOICE) -> DataFrame:
    """``rows`` without ``reply``, with discovery, named and fault.

    ``names`` and ``products`` are arrays of the brand's and its products' names. Discovery questions name neither and ask
    for a choice, named ones name one of them. fault: ``not JSON`` or ``no discovery question``; such rows have no questions.
    """
    body = json_body(F.col(reply))
    known = F.coalesce(F.json_object_keys(body).isNotNull(), F.lit(False))
    both = F.concat(F.coalesce(F.col(names), F.array().cast("array<string>")), F.coalesce(F.col(products), F.array().cast("array<string>")))
    found = rows.withColumns({"_q": F.when(known, F.from_json(body, QUESTIONS)), "_keys": F.filter(F.transform(both, lambda x: name_key(F.coalesce(x, F.lit("")))), lambda x: x != "")})
    names_it = lambda q: F.exists("_keys", lambda k: F.contains(name_key(q), k))
    asks = lambda q: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(F.lower(F.translate(q, "İ", "i")), c))
    discovery = F.slice(F.filter(_texts(F.col("_q.discovery")), lambda q: ~names_it(q) & asks(q)), 1, most_discovery)
    named = F.slice(F.filter(_texts(F.col("_q.named")), names_it), 1, most_named)
    fault = F.when(~known, "not JSON").when(F.size(discovery) == 0, "no discovery question")
    fine = lambda c: F.when(fault.isNull(), c)
    return found.select(*[F.col(c) for c in rows.columns if c != reply], fine(discovery).alias("discovery"), fine(named).alias("named"), fault.alias("fault"))
