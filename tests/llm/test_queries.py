"""The registered queries over whole tables against the libraries and plain Python, and rows that no table should hold."""

import hashlib
import itertools
import zlib

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    from lexigauge.llm.queries import queries

    return queries()[name](spark, FOLDER).collect()


def test_op5_as_the_library(spark, documents):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), len(model.encode(t))) for i, t in documents.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in run(spark, "op5_token_counts")} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in run(spark, "op5_token_counts"))


def test_op6_as_the_library(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in documents.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op6_byte_bpe")} == want


def test_op6_one_pass_as_two(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from lexigauge.llm.bpe import bpe_decode, bpe_digests, bpe_encode

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, None, 1), (1, "a" * 9000 + " é🙂", 2), (None, "x y", 3), (2, "", 4), (2, "", 4), (3, "ab" * 300, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    one, two = bpe_digests(docs, path, tokenizers.PATTERN), bpe_decode(bpe_encode(docs, path, tokenizers.PATTERN), path, digests=True)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == len(rows)
    assert bpe_digests(docs.where("false"), path, tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_op8_by_all_pairs(spark, documents, hot, monkeypatch):
    from lexigauge.llm import simhash

    monkeypatch.setattr(simhash, "HOT", hot)
    xxhash = pytest.importorskip("xxhash")
    marks = {}
    for i, t in documents.items():
        w = t.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        marks[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(marks), 2):
        if (marks[a] ^ marks[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash")}
    assert got == {i: (f"{m:016x}", find(i)) for i, m in marks.items()}


def test_op10_holds_its_law(spark, documents):
    rows = run(spark, "op10_sharding")
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in documents.items()}
    shards, of = {}, {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
        of.setdefault(documents[r.doc_id], set()).add(r.shard)
    assert set(shards) <= set(range(40)) and all(len(s) == 1 for s in of.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) and {r.law for r in s} == {"bytes"} and {r.grown_shard for r in s} == {None} for s in shards.values())
    groups = {}
    for t in documents.values():
        groups[hashlib.sha256(t.encode()).digest()] = groups.get(hashlib.sha256(t.encode()).digest(), 0) + len(t.encode()) + 16
    order, most = [groups[k] for k in sorted(groups)], max(sum(r.size for r in s) for s in shards.values())

    def needed(capacity):
        n, now = 1, 0
        for g in order:
            n, now = (n + 1, g) if now + g > capacity else (n, now + g)
        return n

    assert needed(most) <= 40 and (most == max(order) or needed(most - 1) > 40)


def test_op1_covers_the_table(spark, documents):
    rows = run(spark, "op1_quality_classifier")
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


#: Nulls in every column, empty and blank texts, one very long text, ties, repeated rows, an id with two texts.
LONG = " ".join(f"long{k % 5000} word{k}" for k in range(60_000))
ODD = [
    (1, "some words here", "en", "s", 15), (1, "some words here", "en", "s", 15), (1, "other words", "en", "s", 11), (2, None, None, None, None), (3, "", "", "", 0),
    (4, " \n\t ", "xx", "s", 3), (5, LONG, "en", "s", len(LONG)), (6, LONG + " tail", "en", None, None), (None, "null id", "en", "s", 7), (None, None, None, None, None),
]


def test_stages_on_odd_rows(spark):
    """Each filter of the pipeline over rows that no table should hold: columns kept, results as the docstrings say."""
    pytest.importorskip("public_tokenizers")
    from lexigauge.llm.decontamination import drop_contaminated
    from lexigauge.llm.pu_classifier import keep_predicted
    from lexigauge.llm.quality_rules import keep_good
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words here"), (None, None), (2, ""), (3, "null id")], "item_id long, text string")
    key = lambda r: (str(r.doc_id), r.text or "", r.n_chars or 0)
    got = lambda frame: sorted(map(key, frame.collect()))
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {5, 6}
    # too few labels for a model: everything stays
    assert got(keep_predicted(docs, labels)) == sorted(key(r) for r in docs.collect())
    single = drop_near_duplicates(docs)
    assert single.columns == docs.columns
    ids = [r.doc_id for r in single.collect()]
    # both texts of 1 stay, its repeated row once; 2, 3 and 4 have no words; 6 is a copy of 5
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 5] and ids.count(None) == 2
    assert sorted(r.text for r in single.collect() if r.doc_id == 1) == ["other words", "some words here"]
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "5", "6", "None", "None"]
    none = docs.where("false")
    for frame in (keep_good(none), keep_predicted(none, labels), drop_near_duplicates(none), drop_contaminated(none, bench), drop_contaminated(none, bench.where("false"))):
        assert frame.count() == 0 and frame.columns == docs.columns
    assert drop_contaminated(docs, bench.where("false")).count() == len(ODD)


def test_operators_on_odd_rows(spark):
    """One row out per row in, whatever ids and texts are; clashing column names are neither read nor returned."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from lexigauge.llm.pu_classifier import quality_scores
    from lexigauge.llm.quality_rules import quality_rules
    from lexigauge.llm.sharding import assign_shards
    from lexigauge.llm.simhash import simhash_components
    from lexigauge.llm.token_counts import token_counts

    docs = spark.createDataFrame([(*r, 7, "x", 1.5) for r in ODD], "doc_id long, text string, lang string, source string, n_chars int, shard int, fingerprint string, score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = tokenizers.path("piece_bpe_32k.model")
    for frame in (quality_scores(docs, labels), quality_rules(docs), simhash_components(docs), assign_shards(docs), token_counts(docs, model)):
        assert frame.count() == len(ODD)
    for frame in (quality_scores(docs.where("false"), labels), quality_rules(docs.where("false")), simhash_components(docs.where("false")), assign_shards(docs.where("false")), token_counts(docs.where("false"), model)):
        assert frame.count() == 0
