"""Counts, rules, classifier, tokens: against plain Python, with nulls, empties, repeats, clashing columns, empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
LONG = "word " * 30000 + "x" * 3000
ROWS = [(1, None), (2, ""), (3, "  \n "), (4, "a b c a b c a b c\nline\nline\n \nline"), (4, "a b c a b c a b c\nline\nline\n \nline"), (None, "ab  c\n\nd ▁ e<s> \\x"), (6, LONG), (7, "Ünïcode 字字 don't 123 #*$%&|<>")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "n", "k") for i, t in ROWS], "doc_id long, text string, lang string, n_tokens string, row string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts(spark, docs, empty):
    import sentencepiece

    from lexigauge.llm.token_counts import token_counts

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in ROWS)
    assert got == want
    assert token_counts(empty, path).count() == 0


def test_bpe_round_trip(docs, empty):
    import tiktoken

    from lexigauge.llm.bpe import bpe_decode, bpe_encode, vocabulary

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})
    ids = bpe_encode(docs, path, P.PATTERN)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in ids.collect()) == sorted((i or 0, lib.encode_ordinary(t or "")) for i, t in ROWS)
    back = bpe_decode(ids, path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in ROWS)
    digests = bpe_decode(ids, path, digests=True).collect()
    assert {r.decoded_sha256 for r in digests} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert bpe_decode(bpe_encode(empty, path, P.PATTERN), path).count() == 0


def test_bpe_long_rows():
    import tiktoken

    from lexigauge.llm.bpe import Encoder, vocabulary

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (65, 200, 1500)] + ["a" * 999, "ab" * 300]
    assert Encoder(path, P.PATTERN).encode_batch(texts) == [np.array(lib.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_quality_counts(docs, empty):
    from lexigauge.llm.quality_rules import quality_rules

    def want(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in lines
                lines.add(x)
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))

    got = quality_rules(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((i or 0, *want(t)) for i, t in ROWS)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules(empty).count() == 0


def test_quality_verdict(spark):
    from lexigauge.llm.quality_rules import quality_rules

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 1]) > 0.99
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 0]) < 0.1


def test_classifier_held_out(spark, docs, empty):
    from lexigauge.llm.pu_classifier import quality_scores

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    few = quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in few} == {0.5} and len(few) == len(ROWS)
    assert quality_scores(empty, labels).count() == 0


def test_rare_languages_are_not_judged_by_others(spark):
    """Clean texts of a language without enough words for a reference stay."""
    from lexigauge.llm.quality_rules import quality_rules

    rnd = np.random.default_rng(3)

    def text(lang, n=120):
        common = [f"{lang}{i}" for i in range(30)]
        return " ".join(rnd.choice(common) if rnd.random() < 0.7 else f"{lang}x{rnd.integers(10**6)}" for _ in range(n))

    rows = [(i, text("big"), "big") for i in range(100)] + [(1000 + i, text("rare"), "rare") for i in range(10)]
    rows += [(2000 + i, text("rare"), "big") for i in range(3)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[1000 + i].kept and got[1000 + i].word_distance is None for i in range(10))
    assert all(got[i].kept and got[i].word_distance is not None for i in range(100)) and not any(got[2000 + i].kept for i in range(3))


def test_classifier_parts_against_plain_loops():
    """Risk gradient, prior and cut of the classifier against their definitions, term by term."""
    from lexigauge.llm import pu_classifier as pu

    rng = np.random.default_rng(4)
    p, u, prior = rng.integers(0, 6, (40, 2)) + [0, 6], rng.integers(0, 6, (70, 2)) + [0, 6], 0.6

    def risk(w):
        soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
        z = lambda row: sum(w[j] for j in row) + w[-1]
        negative = sum(soft(z(r)) for r in u) / len(u) - prior * sum(soft(z(r)) for r in p) / len(p)
        return prior * sum(soft(-z(r)) for r in p) / len(p) + max(0.0, negative) + 0.5 * pu.Training().decay * sum(x * x for x in w[:-1]) / (len(w) - 1)

    w, bias = pu._fit(p, u, 12, prior, pu.Training())
    assert risk([*w, bias]) < risk([0.0] * 13)
    # a first short step goes against the gradient of that risk, weight by weight
    small, at = pu.Training(steps=1, rate=1e-3), [0.0] * 13
    first = [*(x := pu._fit(p, u, 12, prior, small))[0], x[1]]
    for j in range(13):
        up, down = list(at), list(at)
        up[j], down[j] = 1e-5, -1e-5
        slope = (risk(up) - risk(down)) / 2e-5
        assert abs(slope) < 1e-7 or (first[j] < 0) == (slope > 0)
    good, bad = rng.normal(2, 1, 300), rng.normal(-4, 1, 300)
    mix = np.concatenate([rng.normal(2, 1, 700), bad])
    assert abs(pu.estimate_prior(good, mix) - 0.7) < 0.05
    at = pu.cut(good, mix, 0.7, 3.0)
    cost = lambda c: 3.0 * 0.7 * sum(x < c for x in good) / len(good) - sum(x < c for x in mix) / len(mix)
    assert cost(at) <= min(cost(c) for c in good) + 1e-12 and 0.95 < np.mean(bad < at) and np.mean(good >= at) > 0.97


def test_classifier_rejects_bad_texts(spark):
    """Held-out labelled documents: most bad texts go, hardly a good one; labels of other documents change nothing."""
    from lexigauge.llm.pu_classifier import quality_scores

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    other = spark.range(10**6, 10**6 + 30_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    rows = quality_scores(docs, labels.select("doc_id", "quality", "toxic").unionByName(other)).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(r.predicted == 0 for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted == 1 for r in good) >= 0.97 * len(good)
