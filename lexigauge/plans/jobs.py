"""Jobs: workspaces with manifests, frozen folds, resumable baselines, a release that is trained once and predicts later.

Every job writes below one folder that all executors share, never over what is there, and can be verified or resumed.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators import metrics as me
from lexigauge.operators import models as mo
from lexigauge.operators import panel as pa
from lexigauge.sources import corpus as c
from lexigauge.sources import export as ex

VERSION = "1"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def prepare(spark: SparkSession, folder: str, out: str) -> dict[str, dict]:
    """Build the workspace of a corpus: the candidate panel and the evidence rows, each exported with its manifest."""
    panel, found = c.pairs(spark, folder), c.results(spark, folder)
    evidence = found.join(c.responses(spark, folder).select("record_id", "category", "query_id", "condition"), "record_id").where("condition = 'search_on'")
    return {"pairs": ex.export(panel, f"{out}/pairs", ["category", "condition"], VERSION), "evidence": ex.export(evidence, f"{out}/evidence", ["category", "kind"], VERSION)}


def faults(spark: SparkSession, out: str, parts: tuple[str, ...] = ("pairs", "evidence")) -> DataFrame:
    """part, path, fault: what differs from the manifests of a workspace."""
    found = [ex.verify(spark, f"{out}/{p}").withColumn("part", F.lit(p)) for p in parts]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.select("part", "path", "fault")


def freeze_folds(responses: DataFrame, path: str, n: int) -> DataFrame:
    """Deal queries into folds and write them; later runs load the same ones."""
    pa.folds(responses, n).coalesce(1).write.mode("errorifexists").json(path)
    return load_folds(responses.sparkSession, path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    """Frozen folds; a query in several folds is an error."""
    rows = spark.read.schema("category string, query_id string, fold int").json(path)
    if not pa.fold_leaks(rows).isEmpty():
        raise ValueError("a query is in several folds")
    return rows


def design(panel: DataFrame, results: DataFrame) -> DataFrame:
    """Rows that models are trained on: the panel's relative features with its keys and label."""
    kept = pa.panel_filter(panel)
    features = pa.relative(kept, results.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_results")))
    return features.join(kept.select("record_id", "brand", "category", "query_id"), ["record_id", "brand"])


def baselines(rows: DataFrame, folds: DataFrame, n: int, out: str, families: tuple[str, ...] = ("logistic",)) -> DataFrame:
    """Out-of-fold scores of each family below ``out``; a family that is finished is not run again.

    Spark marks a finished folder with _SUCCESS; one without it is of a run that was lost, and is written anew.
    """
    spark, parts = rows.sparkSession, []
    for family in families:
        path = f"{out}/{family}"
        if not exists(spark, f"{path}/_SUCCESS"):
            mo.out_of_fold(rows, folds, n, family).write.mode("overwrite").parquet(path)
        parts.append(spark.read.parquet(path).withColumn("family", F.lit(family)))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return done


def score_table(scores: DataFrame) -> DataFrame:
    """family, category and all metrics, from saved scores: no model is fitted again."""
    names = [r.family for r in scores.select("family").distinct().orderBy("family").collect()]  # a handful
    parts = [me.summary(scores.where(F.col("family") == n)).withColumn("family", F.lit(n)) for n in names]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def train_release(rows: DataFrame, out: str, family: str = "logistic") -> None:
    """Fit on all rows and save the model, once."""
    mo.fit(rows, family).write().save(f"{out}/model")


def status(spark: SparkSession, out: str) -> dict[str, bool]:
    """Which parts of a release are there."""
    return {part: exists(spark, f"{out}/{part}") for part in ("model", "pairs", "evidence", "folds")}


def predict(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """Scores of new candidate rows by the saved model, in the order in which they are returned."""
    from lexigauge.operators.profile import final_ranking

    scored = mo.score(PipelineModel.load(f"{out}/model"), rows)
    return final_ranking(scored)
