"""Live requests to rankings: the same function for a table of requests and for the micro-batches of a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.functions.names import Registry
from lexigauge.operators import live as lv
from lexigauge.operators import models as mo
from lexigauge.operators import panel as pa
from lexigauge.operators.profile import final_ranking
from lexigauge.sources.corpus import KINDS

REQUEST = "record_id string, results array<struct<position:int,kind:string,text:string>>"


def live_features(requests: DataFrame, registry: Registry) -> DataFrame:
    """Candidate rows of requests with all relative features that models are trained on: record_id, brand and these.

    ``requests``: record_id, results (array of struct position, kind, text). A request without results, or with a null
    array, has no candidates; brands that no result names have features of 0.
    """
    found = requests.select("record_id", F.explode("results").alias("r")).select("record_id", "r.*")
    panel = lv.live_panel(found, registry, "")
    brands = found.select("record_id", "kind", F.explode(F.array_distinct(lv.nm.names_in(F.col("text"), registry))).alias("brand"))
    kinds = brands.groupBy("record_id", "brand").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    rows = panel.join(kinds, ["record_id", "brand"], "left").na.fill(0, [f"n_{k}" for k in KINDS])
    rows = rows.select("record_id", "brand", F.lit(0).cast("long").alias("y_top"), "n_results_mentioning", "in_search_results", F.when(F.col("in_search_results") == 1, F.col("best_position")).otherwise(0).alias("best_position"), *[f"n_{k}" for k in KINDS])
    return pa.relative(rows, found.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_results")))


def rank_requests(requests: DataFrame, registry: Registry, model: PipelineModel) -> DataFrame:
    """record_id, brand, score, rank: the candidates of every request by a trained model."""
    rows = live_features(requests, registry).withColumns({"category": F.lit("live"), "query_id": F.col("record_id").cast("string")})
    return final_ranking(mo.score(model, rows))


def ranking_stream(requests: DataFrame, registry: Registry, model_path: str, out: str, checkpoint: str):  # noqa: ANN201
    """A stream of requests ranked by a saved model into ``out``, a folder per batch that a repeat writes over."""
    model = PipelineModel.load(model_path)

    def batch(rows: DataFrame, number: int) -> None:
        rank_requests(rows, registry, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
