"""Contributions, orders, permutations, joint intervals and misspelt names: against plain Python on small tables."""

import itertools
import math
import random

import numpy as np
import pytest

REGISTRY = (("Alpha", "Alphamax"), ("Beta", "Betamix"), ("Alto", "Alphamix"), ("Short", "Abc"), ("Five", "Fiver"))


def value(tree, x, known, node=0):
    """Expected value of a tree when only the features in ``known`` are given."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        go = left if tree.goes_left(node, np.array([x[tree.feature[node]]]))[0] else right
        return value(tree, x, known, go)
    return (tree.cover[left] * value(tree, x, known, left) + tree.cover[right] * value(tree, x, known, right)) / tree.cover[node]


def by_subsets(tree, x):
    """Shapley values by enumerating every coalition."""
    n, out = len(x), []
    for i in range(n):
        rest, total = [j for j in range(n) if j != i], 0.0
        for k in range(n):
            for s in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value(tree, x, {*s, i}) - value(tree, x, set(s)))
        out.append(total)
    return out


def random_tree(rnd, depth, features):
    from lexigauge.operators.contributions import Tree

    t = Tree([], [], [], [], [], [], {})

    def grow(level, cover):
        node = len(t.feature)
        leaf = level == depth or cover < 2 or rnd.random() < 0.2
        for column, v in ((t.feature, -1 if leaf else rnd.randrange(features)), (t.threshold, rnd.random()), (t.left, -1), (t.right, -1), (t.value, rnd.gauss(0, 1)), (t.cover, float(cover))):
            column.append(v)
        if not leaf:
            if rnd.random() < 0.2:
                t.groups[node] = frozenset(x for x in (0.0, 0.25, 0.5) if rnd.random() < 0.5)
            part = rnd.randrange(1, cover)
            t.left[node] = grow(level + 1, part)
            t.right[node] = grow(level + 1, cover - part)
        return node

    grow(0, 1000)
    return t


def test_contributions_by_enumeration():
    from lexigauge.operators.contributions import shapley

    rnd = random.Random(1)
    for depth in (0, 1, 2, 3, 5):
        for _ in range(6):
            tree = random_tree(rnd, depth, 4)
            x = np.array([[rnd.choice([0.0, 0.25, 0.5, rnd.random()]) for _ in range(4)] for _ in range(7)])
            got = shapley(tree, x)
            for row, parts in zip(x, got, strict=True):
                assert np.allclose(parts, by_subsets(tree, row))
                assert math.isclose(tree.expected() + parts.sum(), value(tree, row, {0, 1, 2, 3}), abs_tol=1e-9)


@pytest.fixture(scope="module")
def candidates(spark):
    """Three categories of answers whose winner is mostly the first result; one category has a model of its own."""
    rnd, rows = random.Random(2), []
    for k, cat in enumerate("abc"):
        for q, r, b in itertools.product(range(6), range(5), range(5)):
            top = int(b == (q + r) % 5)
            features = [min(1.0, max(0.0, top * 0.4 + rnd.random() * 0.5)), rnd.random(), round(rnd.random(), 1), float(rnd.random() < 0.3), top * 0.5 + rnd.random() * 0.5, *[round(rnd.random(), 2) for _ in range(5)]]
            rows.append((f"{cat}{q}{r}", f"b{b}", cat, f"{cat}{q}", f"m{q % 2}" if cat != "c" else "own", top, *features))
    from lexigauge.operators.models import FEATURES

    schema = "record_id string, brand string, category string, query_id string, model_id string, y_top int, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema).cache()


def test_model_contributions_add_up(spark, candidates):
    """In log odds, with a category split as a set; and a model that has never seen a category scores it."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from lexigauge.operators import contributions as co
    from lexigauge.operators import models as mo

    model = mo.fit(candidates.where("category <> 'c'"), "trees", categories=("model_id",))
    keys = ["record_id", "brand"]
    found, names = co.model_contributions(model, candidates, keys)
    assert names == [*mo.FEATURES, "model_id_index"]
    odds = model.transform(candidates.withColumn("y", F.lit(0.0)).withColumn("w", F.lit(1.0))).select(*keys, vector_to_array("probability").alias("p"))
    got = {(r.record_id, r.brand): r.expected + sum(r.parts) for r in found.collect()}
    want = {(r.record_id, r.brand): math.log(r.p[1] / r.p[0]) for r in odds.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)
    long = co.by_feature(found, names, keys)
    assert long.where("feature = 'expected_value'").count() == len(got)
    total = co.shares(long.withColumn("all", F.lit(1)), ["all"]).agg(F.sum("share")).first()[0]
    assert math.isclose(total, 1.0, abs_tol=1e-4)
    assert found.where("false").count() == 0


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_a_fold_with_a_category_of_its_own(spark, candidates, family):
    from lexigauge.operators import models as mo

    folds = spark.createDataFrame([(f"{c}{q}", int(c == "c")) for c in "abc" for q in range(6)], "query_id string, fold int")
    scores = mo.out_of_fold(candidates, folds, 2, family, ("model_id",)).collect()
    assert len(scores) == candidates.count() and all(0 <= r.score <= 1 for r in scores)


def test_permutations_are_whole(spark, candidates):
    from lexigauge.operators import models as mo

    before = {}
    for r in candidates.collect():
        before.setdefault(r.category, {})[(r.record_id, r.brand)] = r.volume_rank_pct
    moved, places = 0, []
    for seed in range(3):
        after = {}
        for r in mo.permuted(candidates, "volume_rank_pct", seed).collect():
            after.setdefault(r.category, {})[(r.record_id, r.brand)] = r.volume_rank_pct
        assert after.keys() == before.keys()
        for c, own in before.items():
            assert sorted(own.values()) == sorted(after[c].values()) and own.keys() == after[c].keys()
            moved += sum(own[k] != after[c][k] for k in own)
    # where a value goes does not depend on where it was
    marked = candidates.withColumn("volume_rank_pct", candidates.volume_share * 0 + (candidates.record_id == "a00").cast("double"))
    for seed in range(30):
        places += [r.record_id for r in mo.permuted(marked, "volume_rank_pct", seed).where("volume_rank_pct = 1").collect()]
    assert moved > 400 and len(set(places)) > 25


def test_out_of_domain_drops(candidates):
    from lexigauge.operators import models as mo

    got = {(r.category, r.feature): r.drop for r in mo.out_of_domain_drops(candidates, ["volume_share", "share_forum"], 2).collect()}
    assert len(got) == 6 and all(got[c, "volume_share"] > got[c, "share_forum"] for c in "abc")


def rank(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_rank_correlation(spark):
    from lexigauge.operators.ordering import numbered, rank_correlation

    rnd, rows = random.Random(4), []
    for g in "ab":
        rows += [(g, float(x := rnd.randrange(6)), float(x + rnd.randrange(5)), k) for k in range(60)]
    rows += [("c", 1.0, float(k), k) for k in range(5)] + [("d", None, 1.0, 0), ("d", 1.0, 2.0, 1)]
    table = spark.createDataFrame(rows, "g string, x double, y double, k int").repartition(5)
    got = {r.g: (r.n, r.correlation) for r in rank_correlation(table, ["g"], "x", "y").collect()}
    for g in "ab":
        x, y = zip(*[(r[1], r[2]) for r in rows if r[0] == g], strict=True)
        assert got[g][0] == 60 and math.isclose(got[g][1], np.corrcoef(rank(x), rank(y))[0, 1], abs_tol=1e-6)
    assert got["c"] == (5, None) and got["d"] == (1, None)
    places = {}
    for r in numbered(table.where("x is not null"), ["g"], ["x", "y", "k"]).collect():
        places.setdefault(r.g, []).append(((r.x, r.y, r.k), r.place))
    for own in places.values():
        assert [p for _, p in sorted(own)] == list(range(len(own)))


def test_joint_deltas(spark, candidates):
    """Against a plain loop over draws, with continuous scores and ties."""
    from pyspark.sql import functions as F

    from lexigauge.operators import resampling as rs

    rows = candidates.withColumns({"a": F.round("volume_share", 1), "b": F.col("position_rank_pct")})
    got = {r.category: r.asDict() for r in rs.joint_deltas(rows, "a", "b", draws=50).collect()}
    table = [r.asDict() for r in rows.collect()]
    times = {(r.category, r.query_id, r.draw): r.times for r in rs.weights(rows, ["category"], "query_id", 50).collect()}

    def precision(own, s, w):
        p = sum(w(r) * r["y_top"] for r in own)
        n, out = sum(w(r) for r in own), 0.0
        for v in {r[s] for r in own}:
            up = [r for r in own if r[s] >= v]
            hits = sum(w(r) * r["y_top"] for r in own if r[s] == v)
            out += hits * sum(w(r) * r["y_top"] for r in up) / max(1, sum(w(r) for r in up))
        return out / p if 0 < p < n else None

    def lists(own, s, w):
        answers = {}
        for r in own:
            answers.setdefault(r["record_id"], []).append(r)
        top = gain = total = 0.0
        for a in answers.values():
            a.sort(key=lambda r: (-r[s], r["brand"]))
            total += w(a[0])
            top += w(a[0]) * a[0]["y_top"]
            gain += w(a[0]) * sum(r["y_top"] / math.log2(k + 2) for k, r in enumerate(a[:3]))
        return top / total, gain / total

    for c in "abc":
        own = [r for r in table if r["category"] == c]

        def deltas(w, own=own):
            (ta, ga), (tb, gb) = lists(own, "a", w), lists(own, "b", w)
            return precision(own, "a", w) - precision(own, "b", w), ta - tb, ga - gb

        point = deltas(lambda r: 1)
        drawn = [deltas(lambda r, k=k, c=c: times.get((c, r["query_id"], k), 0)) for k in range(50)]
        for i, name in enumerate(("precision", "top1", "ndcg")):
            low, high = np.percentile([x[i] for x in drawn], [2.5, 97.5])
            for key, want in (("delta", point[i]), ("low", low), ("high", high)):
                assert math.isclose(got[c][f"{name}_{key}"], want, abs_tol=2e-6), (c, name, key)
        assert got[c]["blocks"] == 6
    one = rs.joint_deltas(rows.where("query_id = 'a0'"), "a", "b", draws=5).first()
    assert one.blocks == 1 and one.precision_low is None and one.top1_delta is not None
    assert rs.joint_deltas(rows.where("false"), "a", "b", draws=5).count() == 0


def off(a, b):
    """One letter more, less or another, or two neighbours swapped."""
    if len(a) == len(b):
        d = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_misspelt_words_by_all_pairs(spark):
    from lexigauge.operators.answers import misspelt

    rnd, words = random.Random(5), {"alphamax", "five", "fiver", "fivers", "abcd", "é", "a" * 200}
    for _ in range(600):
        w = list(rnd.choice(["alphamax", "alphamix", "betamix", "fiver"]))
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(w))
            w[i : i + rnd.randrange(3)] = rnd.choice(["", "x", "ma", "é", "".join(reversed(w[i : i + 2]))])
        words.add("".join(w))
    forms = [f.lower() for _, f in REGISTRY]
    want = {(w, k) for w in words for k, f in enumerate(forms) if min(len(w), len(f)) >= 5 and w[:1] == f[:1] and off(w, f) and (len(w) != len(f) or len(w) >= 6)}
    got = {(r.word, r.place) for r in misspelt(spark.createDataFrame([(w,) for w in words], "word string"), REGISTRY).collect()}
    assert got == want and len(want) > 60


def test_misspelt_names_decide(spark):
    from lexigauge.operators.answers import outcomes, spelt

    texts = {
        "1": "Both are fine. I recommend Betamxi here.", "2": "I recommend Betamix. Not alpamax.", "3": "**Alphamx** | it\n**Btamix**", "4": None, "5": "Betamix or Betamax: I recommend Fivre", "6": "",
    }
    rows = spelt(spark.createDataFrame(list(texts.items()), "record_id string, text string"), REGISTRY)
    got = {r.record_id: (r.named, r.first_brand, r.pick_method) for r in outcomes(rows, REGISTRY, "(?i)recommend", "(?i)alternative", read="spelt").collect()}
    assert got["1"] == ([], "Beta", "sentence") and got["2"] == (["Beta"], "Beta", "sentence")
    assert got["3"] == ([], "Beta", "bold")  # the line with a pipe is a table
    assert got["4"] == ([], None, "none") and got["6"] == ([], None, "none")
    assert got["5"] == (["Beta"], "Beta", "sentence")  # Fivre has five letters, and two of them are swapped: too far off
