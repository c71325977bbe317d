"""Sources and sinks: pinned Parquet, track loads, raw JSON trees, the export with its manifest, and their verification."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.functions.urls import bare_host


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to ``folder``), bytes, sha256 of every file below a folder; tasks read the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index(F.col("path"), folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Parquet whose data files are those of ``manifest`` (path, sha256); anything else is an error."""
    found = file_hashes(spark, folder).where("path like '%.parquet'").select("path", "sha256")
    off = found.exceptAll(manifest.select("path", "sha256")).unionByName(manifest.select("path", "sha256").exceptAll(found))
    if not off.isEmpty():
        raise ValueError("files differ from their manifest: " + ", ".join(sorted({r.path for r in off.limit(5).collect()})))
    return spark.read.parquet(folder)


def export(rows: DataFrame, folder: str, dimensions: list[str], version: str) -> dict:
    """Write rows as Parquet below ``folder`` and return their manifest: version, rows, columns, counts per value of each
    dimension, and the file hashes; the manifest is written beside the data."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{folder}/data")
    back = spark.read.parquet(f"{folder}/data")
    sets = back.groupingSets([[F.col(c)] for c in dimensions], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    counts: dict[str, dict[str, int]] = {c: {} for c in dimensions}
    for r in sets.collect():
        at = next(i for i in range(len(dimensions)) if not r.g >> (len(dimensions) - 1 - i) & 1)
        counts[dimensions[at]][str(r[dimensions[at]])] = r.n
    files = {r.path: r.sha256 for r in file_hashes(spark, f"{folder}/data").where("path like '%.parquet'").collect()}
    manifest = {"version": version, "rows": back.count(), "columns": back.columns, "counts": counts, "files": files}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """path, fault of an export: files that are missing, unexpected or changed since its manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    wanted = spark.createDataFrame(sorted(manifest["files"].items()), "path string, wanted string")
    both = file_hashes(spark, f"{folder}/data").where("path like '%.parquet'").join(wanted, "path", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("sha256") != F.col("wanted"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def json_tree(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with path, unreadable files with path) of a tree of JSON files, one object each."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    read = raw.select("path", F.from_json("value", schema).alias("v"), (F.json_object_keys("value").isNotNull()).alias("ok"))
    return read.where("ok").select("path", "v.*"), read.where("not ok").select("path")


def track(rows: DataFrame, language: str, core: str | None = None) -> DataFrame:
    """One track of answers with language: flat columns as they are, or read from a JSON column ``core``."""
    if core is None:
        return rows.withColumn("language", F.lit(language))
    schema = "query_id string, model_id string, condition string, confidence string"
    return rows.withColumn("_core", F.from_json(core, schema)).select(*[c for c in rows.columns if c != core], "_core.*").withColumn("language", F.lit(language))


def tracks(*parts: DataFrame) -> DataFrame:
    """Union of tracks by name; a column that a track lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def judged_rows(raw: DataFrame, judged: DataFrame, on: list[str]) -> DataFrame:
    """Raw answers with their judgement, by the parts of their path; answers without one are left out."""
    return raw.join(judged, on)


#: Columns of an exported answer, in order; ? marks those that may be null (fixed values).
COLUMNS = (
    "record_id string, experiment_id string, model_id string, provider string, condition string, category string, language string, query_id string, query_text string, run_index bigint, temperature double,"
    " final_response string, tool_calls string, search_results string, core string, domain string, search_aware string?, deterministic string, judge_model string, judge_prompt_version string"
)


def export_rows(raw: DataFrame, judged: DataFrame, planned: DataFrame, key: str = "record_id") -> DataFrame:
    """Answers with their judgements in the fixed schema of an export, in order of their key.

    Only planned answers whose judgement is of their present content are exported: ``judged`` has content_hash as judged,
    ``raw`` as it is. A column that is missing in both, and a null where the schema allows none, is an error.
    """
    fields = [f.strip().rsplit(" ", 1) for f in COLUMNS.split(",")]
    judged = judged.withColumnRenamed("content_hash", "_judged")
    rows = raw.join(planned.select(key).distinct(), key, "left_semi").join(judged, key).where(F.col("content_hash").eqNullSafe(F.col("_judged")))
    absent = [name for name, _ in fields if name not in rows.columns]
    if absent:
        raise ValueError("an export lacks " + ", ".join(absent))
    fault = lambda name: F.raise_error(F.lit(f"an exported answer has no {name}"))
    one = lambda name, kind: F.col(name).cast(kind[:-1]) if kind.endswith("?") else F.coalesce(F.col(name).cast(kind), fault(name).cast(kind))
    return rows.select(*[one(name, kind).alias(name) for name, kind in fields]).orderBy(key)


def tool_calls(calls: Column) -> Column:
    """Calls (array of struct with round, function, arguments.query) as exported JSON; a null array is an empty one."""
    kept = F.transform(calls, lambda x: F.struct(x["round"].alias("round"), x["function"].alias("function"), x["arguments"]["query"].alias("query")))
    return F.coalesce(F.to_json(kept, {"ignoreNullFields": "false"}), F.lit("[]"))


def sealed(spark: SparkSession, path: str, sha256: str | None, schema: str) -> DataFrame:
    """The rows of a small JSON file that must be the one that was sealed: another SHA-256 is an error."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if sha256 is not None and found != sha256:
        raise ValueError(f"{path} has changed since it was sealed: sha256 {found}")
    return spark.read.schema(schema).json(path)


def search_results(found: DataFrame) -> DataFrame:
    """Results as they are exported: record_id, position, link, domain, title."""
    return found.select("record_id", "position", "link", bare_host(F.col("link")).alias("domain"), F.trim(F.coalesce("title", F.lit(""))).alias("title"))


def result_lines(found: DataFrame) -> DataFrame:
    """record_id, block: an answer's results as the text that a model is shown, in order of position."""
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("link", F.lit("")))
    rows = found.select("record_id", "position", line.alias("line"))
    return rows.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("block"))
