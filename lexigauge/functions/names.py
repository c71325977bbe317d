"""Names in texts: keys, resolution, mentions, spans, masks, and the small guards around them.

A registry is a list of (brand, form) rows. It is a bounded dimension of a category (dozens of rows), so it becomes one
alternation of a regular expression and one map literal of the plan; nothing here needs Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.functions.text import ascii_key, comparison_key, text_key

#: A name of fewer letters than this is ambiguous: it counts only as a whole word, spelt with a capital.
SHORT = 4
_EDGE = r"[\p{L}\p{N}_]"

Registry = Sequence[tuple[str, str]]


def plain_key(form: str) -> str:
    """``comparison_key`` of a registered form."""
    return re.sub(r"[\W_]", "", re.sub("[™®©]", "", form).translate(str.maketrans("İIı", "iii")).lower())


def pattern(forms: Sequence[str]) -> str:
    """Word-bounded alternation of forms, longest first; parts of a form may be apart by marks; case counts in short forms."""
    one = [(r"[\W_]*".join(map(re.escape, re.findall(r"[^\W_]+", f))), len(plain_key(f)) < SHORT) for f in sorted(set(forms), key=lambda f: (-len(f), f))]
    return f"(?<!{_EDGE})(?:" + "|".join(p if exact else f"(?i:{p})" for p, exact in one if p) + f")(?!{_EDGE})"


def _map(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(set(pairs)) for x in pair])


def names_in(text: Column, registry: Registry) -> Column:
    """Array of the brands that a text names, one for each place, in order; leftmost and longest forms first."""
    brands = _map([(plain_key(f), b) for b, f in registry])
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern([f for _, f in registry])), F.lit(0))
    return F.transform(found, lambda m: F.element_at(brands, comparison_key(m)))


def masked(text: Column, registry: Registry, target: str) -> Column:
    """The target's names as [TARGET_BRAND], others as [OTHER_BRAND_n], numbered by first appearance."""
    forms: dict[str, list[str]] = {}
    for brand, form in registry:
        forms.setdefault(brand, []).append(form)
    patterns, lengths = _map([(b, pattern(f)) for b, f in forms.items()]), F.create_map(*[F.lit(x) for b, f in forms.items() for x in (b, max(map(len, f)))])
    seen = F.array_distinct(names_in(text, registry))
    others = F.array_remove(seen, F.lit(target))
    mark = lambda b: F.when(b == target, F.lit("[TARGET_BRAND]")).otherwise(F.concat(F.lit("[OTHER_BRAND_"), F.array_position(others, b).cast("string"), F.lit("]")))
    # longer forms go first, so that no shorter one breaks them
    order = F.array_sort(seen, lambda x, y: F.element_at(lengths, y) - F.element_at(lengths, x))
    return F.aggregate(order, F.coalesce(text, F.lit("")), lambda done, b: F.regexp_replace(done, F.element_at(patterns, b), mark(b)))


def blanked(text: Column, registry: Registry) -> Column:
    """Every form of four letters or more, longest first, as [BRAND], inside words too."""
    forms = sorted({f for _, f in registry if len(f) >= SHORT}, key=lambda f: (-len(f), f))
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?iu)" + "|".join(map(re.escape, forms)), "[BRAND]")


def mentioned(text: Column, registry: Registry) -> Column:
    """Brands that a text mentions, in order of the registry: long forms anywhere in the text without its spaces and
    marks, short ones as whole capitalised words.

    The text is brought to its key once: as the variable of a function it cannot be written out again into every test.
    """
    squashed = F.replace(text_key(text), F.lit(" "), F.lit(""))
    forms: dict[str, list[str]] = {}
    for brand, form in registry:
        forms.setdefault(brand, []).append(plain_key(form))

    def hit(squashed: Column, keys: list[str]) -> Column:
        long, short = [k for k in keys if len(k) >= SHORT], [k for k in keys if len(k) < SHORT]
        tests = [F.contains(squashed, F.lit(k)) for k in long] + [F.coalesce(text, F.lit("")).rlike(f"(?<!{_EDGE}){re.escape(k[:1].upper() + k[1:])}(?!{_EDGE})") for k in short]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return F.get(F.transform(F.array(squashed), lambda k: F.array_compact(F.array(*[F.when(hit(k, keys), F.lit(brand)) for brand, keys in forms.items()]))), F.lit(0))


def form_conflicts(forms: DataFrame) -> DataFrame:
    """key, brands, forms: spellings that several brands of a registry (brand, form) claim under one key; keys without a
    letter or digit are nobody's. Brands and forms are those of the registry, so their lists are as small as it is."""
    keyed = forms.select("brand", "form", comparison_key(F.col("form")).alias("key")).where("key <> ''")
    sets = keyed.groupBy("key").agg(F.array_sort(F.collect_set("brand")).alias("b"), F.array_sort(F.collect_set("form")).alias("f"))
    return sets.where(F.size("b") > 1).select("key", F.array_join("b", ", ").alias("brands"), F.array_join("f", ", ").alias("forms"))


def resolve(name: Column, registry: Registry, excluded: Sequence[str] = ()) -> Column:
    """The brand of a name by its key; null for unknown, empty and excluded names."""
    known = _map([(plain_key(f), b) for b, f in registry if plain_key(f) not in {plain_key(x) for x in excluded}])
    return F.try_element_at(known, comparison_key(F.coalesce(name, F.lit(""))))


def resolve_all(names: Column, registry: Registry, excluded: Sequence[str] = ()) -> Column:
    """Brands of an array of names in order, each once; unknown names drop out; a null array gives an empty one."""
    found = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: resolve(n, registry, excluded))
    return F.array_distinct(F.array_compact(found))


def occurs(name: Column, text: Column) -> Column:
    """Whether the words of a name stand in a text as whole words, in order."""
    return F.contains(text_key(text), text_key(name)) & (F.trim(text_key(name)) != "")


def collapsed(text: Column) -> Column:
    """Lower case with İ as i, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.translate(text, "İ", "i")), r"\s+", " ")


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "İIı", "iii")), "[^a-z0-9]+", "-"), "^-|-$", "")


def brand_key(text: Column, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """Lower case with Turkish letters told apart, trade marks gone, marks as one space; then an alias by whole key."""
    key = F.trim(F.regexp_replace(F.lower(F.translate(F.translate(text, "™®©", ""), "Iİ", "ıi")), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.try_element_at(_map(aliases), key), key) if aliases else key


def plain(text: Column) -> Column:
    """Without control and format characters other than line ends and tabs."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def final_text(text: Column) -> Column:
    """Without closed <think> blocks, trimmed; null if a block is left open or closed without having been opened."""
    rest = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    return F.when(~rest.contains("<think>") & ~rest.contains("</think>"), F.regexp_replace(rest, r"^\s+|\s+$", ""))


def redacted(text: Column, limit: int = 1000) -> Column:
    """Secrets as [REDACTED]: values of keys, bearer tokens, prefixed keys; at most ``limit`` characters, for logs."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)[\w.\-]{8,}", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2[REDACTED]")
    return F.substring(F.regexp_replace(out, r"\b(sk|pk|key)-[A-Za-z0-9_\-]{8,}", "[REDACTED]"), 1, limit)


def fair_input(text: Column, most: int = 120) -> Column:
    """Whether a user's text has 1 to ``most`` characters and no control characters."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.trim(t)).between(1, most) & ~t.rlike(r"[\p{Cc}\p{Cf}]")


def asks_choice(text: Column, cues: Sequence[str]) -> Column:
    """Whether a question asks which one to take: it has one of the cues."""
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(collapsed(F.coalesce(text, F.lit(""))), c))


def names_match_label(name: Column, label: Column) -> Column:
    """Whether a name and the label of a site are one: equal keys, or one of four letters or more inside the other."""
    a, b = ascii_key(name), ascii_key(label)
    within = lambda x, y: (F.length(x) >= SHORT) & F.contains(y, x)
    return (a != "") & (b != "") & ((a == b) | within(a, b) | within(b, a))


def quote_window(text: Column, words: Column, at: Column, size: int = 18) -> Column:
    """The ``size`` words of a text around word number ``at`` (from 0)."""
    start = F.greatest(at - size // 2, F.lit(0))
    return F.array_join(F.slice(words, start + 1, size), " ")


def first_theme(text: Column, themes: Sequence[tuple[str, str]]) -> Column:
    """The first of (name, pattern) whose pattern a text has, else ``other``."""
    out = F.lit("other")
    for name, p in reversed(themes):
        out = F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)).otherwise(out)
    return out


def close_words(pairs: DataFrame, word: str, target: str, least: float = 0.83) -> DataFrame:
    """Pairs of words of five letters or more that begin alike and are similar: a letter off."""
    from lexigauge.functions.text import similarity

    a, b = F.lower(word), F.lower(target)
    near = pairs.where((F.least(F.length(a), F.length(b)) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)))
    return similarity(near.withColumns({"_a": a, "_b": b}), "_a", "_b").where(F.col("ratio") >= least).drop("_a", "_b", "ratio")
