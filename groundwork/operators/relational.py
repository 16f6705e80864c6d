"""Dashboard queries over documents, runs, outputs and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .grounding import norm_number


def list_documents(docs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """J1. Newest first; the limit (1 to 200) and offset are the feature."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    return docs.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def get_document(docs: DataFrame, knowledge: DataFrame, doc_id: int, preview: int = 1500) -> DataFrame:
    """J2. One document with its knowledge, if any, and the start of its text. No row: not found."""
    one = docs.where(F.col("doc_id") == doc_id).withColumn("preview", F.substring("text", 1, preview)).drop("text")
    return one.join(knowledge, "doc_id", "left")


def list_runs(runs: DataFrame, docs: DataFrame, outputs: DataFrame, doc_id: int | None = None, limit: int = 50) -> DataFrame:
    """J3. Runs with their document's title, output count and mean grounding (0 without outputs), newest first."""
    rows = runs if doc_id is None else runs.where(F.col("doc_id") == doc_id)
    rows = rows.join(docs.select("doc_id", "title"), "doc_id").orderBy(F.desc("created_at"), "run_id").limit(limit)
    sums = outputs.groupBy("run_id").agg(F.count(F.lit(1)).alias("output_count"), F.round(F.avg("grounding_score"), 4).alias("mean_grounding"))
    return rows.join(sums, "run_id", "left").select("run_id", "doc_id", "title", "status", "created_at", F.coalesce("output_count", F.lit(0)).alias("output_count"), F.coalesce("mean_grounding", F.lit(0.0)).alias("mean_grounding"))


def run_detail(runs: DataFrame, docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """J4. Each run with its document and its outputs by format."""
    lists = outputs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("format", "grounding_score", "review_state"))).alias("outputs"))
    return runs.join(docs.select("doc_id", "title"), "doc_id", "left").join(lists, "run_id", "left")


def compare_formats(outputs: DataFrame, numbers: Column, most: int = 40) -> DataFrame:
    """J5. ``run_id, format, shared, divergent, only_here`` of the numbers of each format (the first 40
    in order): in all formats of the run, not in all, and in this one alone."""
    own = F.array_distinct(F.transform(numbers, norm_number))
    none = F.array(F.lit(None).cast("string"))
    # all keys begin with the run: its outputs are dealt once, and what is counted stands in the run's row
    rows = outputs.where("run_id is not null").select("run_id", "format", F.when(F.size(own) > 0, own).otherwise(none).alias("n")).repartition("run_id")
    lists = rows.groupBy("run_id", "format").agg(F.slice(F.sort_array(F.flatten(F.collect_list("n"))), 1, most).alias("n"))
    lists = lists.select("run_id", "format", F.filter("n", lambda v: v.isNotNull()).alias("n"))
    runs = lists.groupBy("run_id").agg(F.collect_list(F.struct("format", "n")).alias("f"), F.flatten(F.collect_list("n")).alias("_all"), F.count("format").alias("formats"))

    def compared(x: Column) -> Column:
        held = F.transform(x["n"], lambda v: F.struct(v.alias("v"), F.size(F.filter("_all", lambda y: y == v)).alias("held")))
        pick = lambda h, where: F.transform(F.filter(h, where), lambda s: s["v"])
        return let(held, lambda h: F.struct(
            x["format"].alias("format"), pick(h, lambda s: s["held"] == F.col("formats")).alias("shared"), pick(h, lambda s: s["held"] < F.col("formats")).alias("divergent"),
            pick(h, lambda s: (s["held"] == 1) & (F.col("formats") > 1)).alias("only_here"),
        ))

    return runs.select("run_id", F.inline(F.transform("f", compared)))


def stats(docs: DataFrame, runs: DataFrame, outputs: DataFrame, audit: DataFrame) -> DataFrame:
    """J6. ``name, value``: counts, runs by status, completed runs, mean grounding."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    out = count(docs, "documents").unionByName(count(runs, "runs")).unionByName(count(outputs, "outputs")).unionByName(count(audit, "audit_events"))
    out = out.unionByName(runs.groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("status:"), "status").alias("name"), "value"))
    out = out.unionByName(count(runs.where(F.col("status").isin("completed", "completed_with_warnings")), "completed"))
    return out.unionByName(outputs.agg(F.round(F.coalesce(F.avg("grounding_score"), F.lit(0.0)), 4).alias("value")).select(F.lit("mean_grounding").alias("name"), "value"))


def list_audit(audit: DataFrame, limit: int = 100, run_id: int | None = None, doc_id: int | None = None) -> DataFrame:
    """J7. Newest first; at most 500, which is the feature."""
    rows = audit
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    return rows.orderBy(F.desc("created_at"), F.desc("event_id")).limit(min(limit, 500))


def search_documents(docs: DataFrame, needle: str, columns: tuple[str, ...] = ("title", "filename", "source_kind")) -> DataFrame:
    """J8. Case-insensitive contains over any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return docs.where(hit)


def total_bytes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """J9."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("bytes"))
