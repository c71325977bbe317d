"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear model over binned text features by minimising the non-negative
unbiased risk: pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)). The class prior pi is estimated from how
a model of one half ranks the other half of both samples: the best ratio of unlabelled to positive mass above a score.
The other half also sets where texts begin to be good, by the same risk with the zero-one loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import light, small_batches
from lexigauge.llm.textstats import CLASSES, TextStats

FEATURES = (*(f"share_{c}" for c in CLASSES), "log_words", "word_length", "distinct", "repeat", "symbols", "dup_lines", "line_words", "top_word", "adjacent", "caps_words", "long_words", "no_letter", "end_mark", "odd_end", "head_other", "head_upper")


@dataclass(frozen=True)
class Training:
    """Parameters. ``sample`` bounds the positives and the unlabelled texts that the fit takes (each)."""

    sample: int = 20_000
    bins: int = 16
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-3
    cost: float = 3.0  # what losing a trusted positive weighs against keeping a text that is none
    least: int = 20  # with fewer positives or unlabelled texts there is no model: every text scores 0.5


def features(text: str | None) -> np.ndarray:
    """Shares and shapes of a whole text; zeros for an empty one. Labels, language, source and id play no part."""
    s = TextStats(text)
    out = np.zeros(len(FEATURES))
    if not s.n_words:
        return out
    shown = np.array([len(w) for w in s.distinct])
    n = np.bincount(s.ids, minlength=len(shown))
    kind = np.array([(w.isupper() and len(w) > 1, w.isdigit() or not any(c >= 65 for c in w), w[-1:] in b".,;:!?", not (w[-1] >= 65 or w[-1:].isdigit() or w[-1:] in b".,;:!?)\"'")) for w in s.distinct], float)
    out[: len(CLASSES)] = s.classes / s.n_chars
    out[len(CLASSES) :] = (
        np.log1p(s.n_words), s.word_chars / s.n_words, len(s.distinct) / s.n_words, s.n_repeat_words / s.n_words, s.n_symbols / s.n_words, s.n_dup_lines / s.n_lines, np.log1p(s.n_words / s.n_lines),
        n.max() / s.n_words, np.count_nonzero(s.ids[1:] == s.ids[:-1]) / s.n_words, kind[:, 0] @ n / s.n_words, n[shown > 12].sum() / s.n_words, kind[:, 1] @ n / s.n_words, kind[:, 2] @ n / s.n_words, kind[:, 3] @ n / s.n_words,
        len(s.distinct) / np.sqrt(2 * s.n_words), s.classes[1] / max(1, s.classes[0] + s.classes[1]),
    )
    return out


@dataclass
class Model:
    """Bin edges of every feature, a weight of every bin, the estimated prior."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[binned(x, self.edges)].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Index of the bin of every value, all features in one row of weights."""
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * width for j in range(x.shape[1])], 1)


def _fit(p: np.ndarray, u: np.ndarray, size: int, prior: float, t: Training) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk with the logistic loss, by Adam over the whole sample.

    Where the negative part of the risk falls below zero, its gradient is ascended instead, as the non-negative estimator
    demands.
    """
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, t.steps + 1):
        zp, zu = w[p].sum(1) + bias, w[u].sum(1) + bias
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gn = su / len(u), -prior * sp / len(p)
        gp = -prior * (1 - sp) / len(p)
        if negative < 0:
            gu, gn, gp = -gu, -gn, 0 * gp
        grad = np.bincount(p.ravel(), np.repeat(gp + gn, p.shape[1]), size + 1) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), size + 1)
        grad[size] = (gp + gn).sum() + gu.sum()
        grad[:size] += t.decay * w / size
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:size], bias - move[size]
    return w, float(bias)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, z: float = 3.0) -> float:
    """Share of positives among the unlabelled, from scores: u(c) / p(c) at the cut c of the smallest upper bound.

    u(c) and p(c) are the shares of unlabelled and positive scores of at least c. The bound adds ``z`` standard errors of
    the one and takes them off the other.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    qp, qu = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    high = (qu + z * np.sqrt(qu * (1 - qu) / len(u)) + z / len(u)) / np.maximum(qp - z * np.sqrt(qp * (1 - qp) / len(p)) - z / len(p), 1e-9)
    best = np.argmin(high)
    return float(np.clip(qu[best] / qp[best], 0.05, 0.99))


def cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, cost: float) -> float:
    """The score from which texts are good: it minimises the unbiased zero-one risk, a lost positive weighing ``cost``.

    Of cuts that lose no further positive the highest is taken. Both samples must be ones that the scores were not fitted to.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    risk = cost * prior * np.searchsorted(p, cuts) / len(p) - np.searchsorted(u, cuts) / len(u)
    best = np.argmin(risk)
    below = u[u < cuts[best]]
    return float((cuts[best] + below[-1]) / 2) if len(below) else float(cuts[best]) - 1.0


def train(p: np.ndarray, u: np.ndarray, t: Training) -> Model | None:
    """Model of features of positives ``p`` and unlabelled texts ``u``; None if there are too few.

    Each half of both samples is fitted, and the other half gives the prior, the refit its risk needs, and the cut; the
    model is the mean of both, in units of their spread, so that it is zero where texts begin to be good.
    """
    if len(p) < t.least or len(u) < t.least:
        return None
    both = np.concatenate([p, u])
    edges = np.quantile(both, np.linspace(0, 1, t.bins + 1)[1:-1], axis=0).T.copy()
    # a tail that few texts reach is where junk lies: finer edges at both ends, and just above the smallest value
    tails = np.quantile(both, [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998], axis=0).T
    edges = np.sort(np.concatenate([edges, tails, both.min(0)[:, None] + 1e-9], 1), 1)
    bp, bu, size = binned(p, edges), binned(u, edges), len(FEATURES) * (edges.shape[1] + 1)
    first = [_fit(bp[k::2], bu[k::2], size, 0.5, t) for k in (0, 1)]
    prior = float(np.mean([estimate_prior(w[bp[1 - k :: 2]].sum(1) + c, w[bu[1 - k :: 2]].sum(1) + c) for k, (w, c) in enumerate(first)]))
    weights, bias = np.zeros(size), 0.0
    for k in (0, 1):
        w, c = _fit(bp[k::2], bu[k::2], size, prior, t)
        zp, zu = w[bp[1 - k :: 2]].sum(1) + c, w[bu[1 - k :: 2]].sum(1) + c
        spread = max(float(zu.std()), 1e-6) / 4
        weights, bias = weights + w / spread / 2, bias + (c - cut(zp, zu, prior, t.cost)) / spread / 2
    return Model(edges, weights, bias, prior)


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the id as text leaves 1 modulo 3: never learnt from. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _featured(rows: DataFrame) -> DataFrame:
    """Columns row (struct) and text become row and x."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], names=["row", "x"])

    return rows.mapInArrow(light(of), f"row {rows.schema['row'].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, t: Training, text: str = "text") -> Model | None:
    """Train on at most ``t.sample`` trusted positives (label quality = 1) and as many unlabelled texts.

    Both samples are the rows of smallest hash of their ids among those not held out, so they do not depend on how the
    tables are partitioned. Only these two bounded lists of ids and their features reach the driver.
    """
    order = F.xxhash64(F.lit("fit"), "doc_id")
    free = docs.where(~held_out()).select("doc_id")
    # labels may cover other documents than these: only positives that are there count
    good = labels.where(~held_out()).where("quality = 1").select("doc_id").distinct().join(free.distinct(), "doc_id", "left_semi")
    pick = lambda rows: [r.doc_id for r in rows.orderBy(order, "doc_id").limit(t.sample).collect()]
    positive, unlabelled = set(pick(good)), set(pick(free.distinct()))
    if not positive or not unlabelled:
        return None
    ids = docs.sparkSession.createDataFrame([(i,) for i in positive | unlabelled], docs.select("doc_id").schema)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    # ids may repeat; the fit takes one row of each
    rows = _featured(rows.select(F.struct("doc_id").alias("row"), "text")).select("row.doc_id", "x").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    p, u = (np.array([r.doc_id in s for r in rows], bool) for s in (positive, unlabelled))
    return train(x[p], x[u], t)


def scored(docs: DataFrame, labels: DataFrame, keep: Sequence[str], t: Training | None = None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as row (struct of ``keep``) and score."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, t or Training(), text))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            score = np.full(len(x), 0.5) if model.value is None else model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"))
    return packed.mapInArrow(light(of), f"row {packed.schema['row'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, t: Training | None = None) -> DataFrame:
    """Return doc_id, held_out boolean, score double (0 to 1), predicted int (score >= 0.5): one row per input row.

    ``docs``: doc_id, text; ``labels``: doc_id, quality. Null and empty texts are scored as texts without words. Repeated
    rows score alike; of repeated ids the fit takes one row. Null ids are held out. Without enough labels every score is
    0.5. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    found = scored(docs, labels, ["doc_id"], t).select("row.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, t: Training | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good ones, with all their columns, null ids and repeats included."""
    return scored(docs, labels, docs.columns, t).where("score >= 0.5").select("row.*")
