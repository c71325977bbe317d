"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm.common import light
from lexigauge.llm.labelled_urls import ALLOWED, BLOCKED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are literals of the plan; more are a table that is joined by host.
MOST_RULES = 500


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Training:
    """Parameters. ``sample`` bounds the labelled urls that the fit takes."""

    sample: int = 4000
    buckets: int = 1 << 14
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 200
    rate: float = 0.1
    decay: float = 1e-4


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits columns host and path: struct of name and verdict, or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (with host and path) and found: the longest rule that fits, as ``rule_of`` gives it.

    Beyond MOST_RULES rules each distinct (host, path) meets the rules of its host and of its parent domains.
    """
    if len(rules) <= MOST_RULES:
        return rows.withColumn("found", rule_of(rules))
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "domain string, start string, name string, verdict string")
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = rows.select("host", "path").distinct().select("host", "path", F.explode(domains).alias("domain")).join(table, "domain").where(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("name", "verdict"), F.struct(F.length("name").alias("n"), "name")).alias("found"))
    return rows.join(best, ["host", "path"], "left")


def grams(host: str, path: str, t: Training) -> np.ndarray:
    """Distinct hashed character n-grams of host and of path; the two have separate hashes."""
    found = set()
    for seed, part in ((1, f"^{host}$"), (2, f"^{path}$")):
        raw = part.encode()
        for n in t.sizes:
            found.update(zlib.crc32(raw[i : i + n], seed) % t.buckets for i in range(max(1, len(raw) - n + 1)))
    return np.fromiter(found, np.int64, len(found))


def _logit(w: np.ndarray, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, w[index], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + w[-1]


def _flat(pairs: list[tuple[str, str]], t: Training) -> tuple[np.ndarray, np.ndarray]:
    each = [grams(h, p, t) for h, p in pairs]
    return np.concatenate(each) if each else np.zeros(0, np.int64), np.repeat(np.arange(len(each)), [len(g) for g in each])


def train(pairs: list[tuple[str, str]], allowed: np.ndarray, t: Training) -> np.ndarray:
    """Weights (the last is the bias) of the probability that a url is allowed; both classes weigh the same."""
    w, n = np.zeros(t.buckets + 1), len(pairs)
    if not n or allowed.all() or not allowed.any():
        w[-1] = 0.0 if not n else 4.0 if allowed.all() else -4.0
        return w
    index, row = _flat(pairs, t)
    size = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    weight = np.where(allowed, 0.5 / allowed.sum(), 0.5 / (~allowed).sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, t.steps + 1):
        off = (1 / (1 + np.exp(-np.clip(_logit(w, index, row, n), -30, 30))) - allowed) * weight
        grad = np.append(np.bincount(index, (off / size)[row], t.buckets), off.sum()) + np.append(t.decay * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, allowed) that comes with this package."""
    return spark.createDataFrame([*((u, True) for u in ALLOWED.split()), *((u, False) for u in BLOCKED.split())], "url string, allowed boolean")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame, t: Training | None = None) -> DataFrame:
    """Return page_id, host, path, rule (name of the longest fitting rule or null), verdict (allow or block), score double.

    ``pages``: page_id, url; ``labelled``: url, allowed (at most ``t.sample`` rows reach the driver, those of smallest
    hash). Where no rule fits, the model decides: score is its probability of allow (null where a rule decides), 0.5 and
    more is allow. Null urls and urls without ``://`` have empty host and path and go to the model. Without labels
    every score is 0.5. Repeated rows are judged alike; other columns are neither read nor returned. An empty table
    gives an empty result.
    """
    t = t or Training()
    table = labelled.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("allowed")).where("allowed is not null").orderBy(F.xxhash64("host", "path"), "host", "path", "allowed").limit(t.sample).collect()
    weights = train([(r.host, r.path) for r in table], np.array([r.allowed for r in table], bool), t).astype(np.float32)
    model = pages.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(float)
        for batch in batches:
            row = batch.column(0)
            open_ = np.flatnonzero(row.field("rule").is_null().to_numpy(zero_copy_only=False))
            hosts, paths = row.field("host").to_pylist(), row.field("path").to_pylist()
            index, of = _flat([(hosts[i], paths[i]) for i in open_], t)
            out = np.full(batch.num_rows, np.nan)
            out[open_] = 1 / (1 + np.exp(-np.clip(_logit(w, index, of, len(open_)), -30, 30)))
            yield pa.RecordBatch.from_arrays([row, pa.array(out, from_pandas=True)], names=["row", "score"])

    rows = with_rule(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    packed = rows.select(F.struct("page_id", "host", "path", F.col("found.name").alias("rule"), F.col("found.verdict").alias("verdict")).alias("row"))
    found = packed.mapInArrow(light(score), f"row {packed.schema['row'].dataType.simpleString()}, score double")
    verdict = F.coalesce("row.verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return found.select("row.page_id", "row.host", "row.path", "row.rule", verdict.alias("verdict"), "score")
