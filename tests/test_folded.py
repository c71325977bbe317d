"""Candidates without evidence are one row of an answer, and that changes no result."""

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_folded_is_the_whole_panel(spark):
    """Rows of seen brands are those of the panel; what is left of each answer is one row of as many candidates as lack."""
    from lexigauge.sources import corpus as c
    from pyspark.sql import functions as F

    whole, few = c.pairs(spark, FOLDER, sizes=True).cache(), c.folded(spark, FOLDER, sizes=True).cache()
    seen = few.where("brand is not null")
    assert seen.where("m <> 1").isEmpty() and seen.drop("m").exceptAll(whole).isEmpty()
    rest = few.where("brand is null")
    assert rest.count() == whole.select("record_id").distinct().count() and few.agg(F.sum("m")).first()[0] == whole.count()
    empty = whole.select(*whole.columns).join(seen.select("record_id", "brand"), ["record_id", "brand"], "left_anti").drop("brand").groupBy(*[x for x in whole.columns if x != "brand"]).count()
    assert {tuple(r) for r in empty.collect()} == {tuple(r) for r in rest.where("m > 0").select(*[x for x in whole.columns if x != "brand"], "m").collect()}
    assert 2 * few.count() < whole.count()


def test_tallied_counts_every_candidate(spark):
    from lexigauge.operators.panel import tallied
    from lexigauge.sources import corpus as c

    keys, evidence = ["category", "condition"], ["y_top", "best_position"]
    got = tallied(c.folded(spark, FOLDER), c.registry(spark, FOLDER), keys, evidence).groupBy(*keys, "brand", *evidence).sum("m")
    want = c.pairs(spark, FOLDER).groupBy(*keys, "brand", *evidence).count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_relative_features_of_weighted_rows(spark):
    from lexigauge.operators.panel import panel_filter, relative
    from lexigauge.sources import corpus as c

    features = ["volume_share", "volume_vs_leader", "volume_rank_pct", "is_top_retrieved", "position_rank_pct", "share_forum"]
    few = relative(panel_filter(c.folded(spark, FOLDER, sizes=True)).where("m > 0"), keep=("m",), times="m").groupBy("record_id", "y_top", *features).sum("m")
    whole = relative(panel_filter(c.pairs(spark, FOLDER, sizes=True))).groupBy("record_id", "y_top", *features).count()
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in whole.collect()}


@pytest.mark.parametrize("name", ["winner_rank_share", "softmax_loss", "concordance_effect", "paired_delta_point", "rank_correlations", "top1_ci", "stability_class", "gaps", "diagnose", "four_priors", "named_and_masked"])
def test_no_candidate_without_evidence_is_made(spark, monkeypatch, name):
    """The named queries never cross answers with the registry."""
    from lexigauge.plans.catalogue import QUERIES
    from lexigauge.sources import corpus as c

    def crossed(*_, **__):
        raise AssertionError("the whole panel is made")

    monkeypatch.setattr(c, "pairs", crossed)
    QUERIES[name](spark, FOLDER)


def test_signals_share_one_pass(spark, monkeypatch):
    """The stability of several signals makes the panel once, and each has the concordance that it has alone."""
    from lexigauge.operators import effects as ef
    from lexigauge.plans import catalogue as ca

    kept = ca._few(spark, FOLDER).cache()
    both = ef.concordances(kept, ["n_official", "n_forum"], "m")
    for f in ("n_official", "n_forum"):
        assert {tuple(r) for r in both.where(f"signal = '{f}'").drop("signal").collect()} == {tuple(r) for r in ef.concordance(kept, f, times="m").collect()}
    made = []
    monkeypatch.setattr(ca, "_few", lambda *_: made.append(1) or kept)
    ca.QUERIES["stability_class"](spark, FOLDER)
    assert len(made) == 1
