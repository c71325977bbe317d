"""Jobs end to end on the smallest tables."""

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_workspace_folds_baselines_release(spark, tmp_path):
    from lexigauge.plans import jobs
    from lexigauge.sources import corpus as c

    out = f"file://{tmp_path}/w"
    manifests = jobs.prepare(spark, FOLDER, out)
    pairs = spark.read.parquet(f"{out}/pairs/data")
    assert manifests["pairs"]["rows"] == pairs.count() == c.pairs(spark, FOLDER).count()
    assert sum(manifests["pairs"]["counts"]["category"].values()) == manifests["pairs"]["rows"]
    assert jobs.faults(spark, out).count() == 0
    part = next(p for p in sorted((tmp_path / "w/evidence/data").iterdir()) if p.suffix == ".parquet")
    part.unlink()
    assert [(r.part, r.fault) for r in jobs.faults(spark, out).collect()] == [("evidence", "missing")]

    folds = jobs.freeze_folds(c.responses(spark, FOLDER), f"{out}/folds", 2)
    again = jobs.load_folds(spark, f"{out}/folds")
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.freeze_folds(c.responses(spark, FOLDER), f"{out}/folds", 2)

    rows = jobs.design(pairs, c.results(spark, FOLDER)).where("category in ('BUILDING', 'MACHINERY')").cache()
    scores = jobs.baselines(rows, again, 2, f"{out}/scores")
    before = (tmp_path / "w/scores/logistic/_SUCCESS").stat().st_mtime_ns
    assert jobs.baselines(rows, again, 2, f"{out}/scores").count() == scores.count() == rows.count()
    assert (tmp_path / "w/scores/logistic/_SUCCESS").stat().st_mtime_ns == before
    table = {r.category: r for r in jobs.score_table(scores).collect()}
    assert set(table) == {"BUILDING", "MACHINERY"} and all(0 <= r.roc_auc <= 1 and r.pairs > 0 for r in table.values())

    jobs.train_release(rows, out)
    assert jobs.status(spark, out) == {"model": True, "pairs": True, "evidence": True, "folds": True}
    ranked = jobs.predict(spark, out, rows)
    assert ranked.count() == rows.count() and ranked.where("rank = 1").count() == rows.select("record_id").distinct().count()
