"""Content hashes, hash chains, manifests, reviews and permission queries.

Audit tables carry ``chain_id, seq, action, actor, actor_role, doc_id, run_id, summary, detail,
created_at, prev_hash, entry_hash``; chains are independent of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import rules

GENESIS = "0" * 64
PAYLOAD = ("action", "actor", "actor_role", "detail", "doc_id", "run_id", "seq", "summary", "timestamp")


def sha256(col: Column) -> Column:
    """I1."""
    return F.sha2(col.cast("binary"), 256)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """I1. ``file_hash, copies, first_id`` of contents that occur more than once."""
    rows = docs.groupBy(sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("file_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))
    return rows.where("copies > 1")


def canonical_json(fields: dict[str, Column]) -> Column:
    """I2. Keys in order, no spaces, nulls kept, UTF-8 as it is."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def short_hash(col: Column, n: int = 12) -> Column:
    return F.substring(col, 1, n)


def make_id(prefix: str, content: Column) -> Column:
    """I3. An id from the content's hash, the same on every run."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(short_hash(sha256(content))))


def _timestamp(col: Column) -> Column:
    return F.concat(F.date_format(F.date_trunc("second", col), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def payload(rows: DataFrame) -> Column:
    """The canonical JSON of the nine hashed fields."""
    have = {k: (F.col(k) if k in rows.columns else F.lit(None).cast("string")) for k in PAYLOAD if k != "timestamp"}
    return canonical_json(have | {"timestamp": _timestamp(F.col("created_at"))})


def payload_ends(rows: DataFrame) -> tuple[Column, Column]:
    """The payload before and after the value of ``seq``, for folds that number events themselves."""
    have = {k: (F.col(k) if k in rows.columns else F.lit(None).cast("string")) for k in PAYLOAD if k not in ("seq", "timestamp")} | {"timestamp": _timestamp(F.col("created_at"))}
    front, back = (canonical_json({k: c for k, c in have.items() if (k < "seq") == early}) for early in (True, False))
    return F.concat(F.regexp_replace(front, r"\}$", ""), F.lit(',"seq":')), F.concat(F.lit(","), F.regexp_replace(back, r"^\{", ""))


def append_chain(events: DataFrame, heads: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """I4. Give events of each chain ``seq, prev_hash, entry_hash``: entry = sha256(prev | payload),
    after the chain's head in ``heads`` (``chain_id, seq, entry_hash``) or from the genesis hash.

    Chains are folded in parallel; one chain is sequential by definition."""
    order = order or ["created_at", "event_id"]
    rank = Window.partitionBy("chain_id").orderBy(*order)
    rows = events.withColumn("seq", F.row_number().over(rank).cast("long"))
    if heads is None:
        rows = rows.withColumn("_head", F.lit(GENESIS))
    else:
        last = heads.select("chain_id", F.col("seq").alias("_at"), F.col("entry_hash").alias("_head"))
        rows = rows.join(last, "chain_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_at", F.lit(0))).withColumn("_head", F.coalesce("_head", F.lit(GENESIS))).drop("_at")
    # a task reads its chains in order, batch by batch, and holds one head
    rows = rows.withColumn("_payload", payload(rows)).repartition("chain_id").sortWithinPartitions("chain_id", "seq")
    keep = ["chain_id", *(c for c in rows.columns if c not in ("_head", "_payload", "chain_id"))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head = object(), GENESIS
        for b in batches:
            before, after = [], []
            for c, first, body in zip(*(b.column(k).to_pylist() for k in ("chain_id", "_head", "_payload")), strict=True):
                if c != chain:
                    chain, head = c, first
                before.append(head)
                head = hashlib.sha256(f"{head}|{body}".encode()).hexdigest()
                after.append(head)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*keep, "prev_hash", "entry_hash"])

    return rows.mapInArrow(fold, StructType([*(rows.schema[k] for k in keep), StructField("prev_hash", StringType()), StructField("entry_hash", StringType())]))


#: Sequence numbers of one verification task.
SEGMENT = 1 << 14


def verify_chain(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """I5. ``chain_id, valid, length, head_hash, broken_at_seq, message``: each entry's predecessor and its recomputed
    hash are checked row by row, so no fold is needed.

    A chain is cut into segments of sequence numbers, each sorted by itself; the first entry of a segment is checked
    against the last of the segment before it, from a table of one row per segment. No task holds a whole chain."""
    rows = events.withColumn("_payload", payload(events)).withColumn("_part", F.floor(F.col("seq") / segment))
    rows = rows.select("chain_id", "seq", "prev_hash", "entry_hash", "_part", F.sha2(F.concat("prev_hash", F.lit("|"), "_payload"), 256).alias("_own"))
    key = ["chain_id", "_part"]
    ends = rows.groupBy(*key).agg(F.max_by("entry_hash", "seq").alias("_last"))
    before = ends.select(*key, F.lag("_last").over(Window.partitionBy("chain_id").orderBy("_part")).alias("_border"), F.lit(True).alias("_known"))
    by = Window.partitionBy(*key).orderBy("seq")
    within = rows.withColumn("_lag", F.lag("entry_hash").over(by)).withColumn("_n", F.row_number().over(by))
    # only a segment's first entry meets the table of borders; chains are told apart null-safe
    met = before.select(F.col("chain_id").alias("_c"), F.col("_part").alias("_p"), "_border", "_known")
    joined = within.join(met, F.col("chain_id").eqNullSafe(F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    first = (F.col("_n") == 1) & F.col("_border").isNull()
    previous = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.coalesce("_border", F.lit(GENESIS)))
    message = (
        F.when(F.col("prev_hash") != previous, F.format_string("Link lost at entry %d: it does not name the hash of the entry before it.", "seq"))
        .when(F.col("_own") != F.col("entry_hash"), F.format_string("Entry %d was changed after it had been appended.", "seq"))
        .when(first & (F.col("seq") != 1), F.lit("The chain's first entries are gone: it does not begin with number 1."))
    )
    checked = joined.select("chain_id", "seq", "entry_hash", message.alias("m"))
    bad = F.when(F.col("m").isNotNull(), F.col("seq"))
    out = checked.groupBy("chain_id").agg(F.count(F.lit(1)).alias("length"), F.max_by("entry_hash", "seq").alias("head_hash"), F.min(bad).alias("broken_at_seq"), F.min_by("m", bad).alias("m"))
    good = F.format_string("The hashes of all %d entries agree.", "length")
    return out.select("chain_id", F.col("broken_at_seq").isNull().alias("valid"), "length", "head_hash", "broken_at_seq", F.coalesce("m", good).alias("message"))


def chain_heads(events: DataFrame) -> DataFrame:
    """I6. ``chain_id, seq, entry_hash, next_seq``."""
    return events.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"), (F.max("seq") + 1).alias("next_seq"))


def root_hash(heads: DataFrame, digits: int = 3) -> DataFrame:
    """``chains, root_hash``: one hash over the heads of all chains (``chain_id, entry_hash``), as the order of
    chains is no part of it: sha256 over the sorted hashes of ranges (16 ** ``digits``, by the md5 of the
    chain), each the sha256 over its sorted heads."""
    leaf = heads.select(F.substring(F.md5(F.col("chain_id").cast("string").cast("binary")), 1, digits).alias("part"), F.concat_ws(":", F.col("chain_id").cast("string"), "entry_hash").alias("leaf"))
    parts = leaf.groupBy("part").agg(F.count(F.lit(1)).alias("n"), sha256(F.array_join(F.array_sort(F.collect_list("leaf")), "|")).alias("h"))
    return parts.agg(F.sum("n").alias("chains"), sha256(F.array_join(F.array_sort(F.collect_list("h")), "|")).alias("root_hash"))


def manifests(runs: DataFrame, outputs: DataFrame, model: str = "extractive-v1", prompt: str = "p1", pipeline: str = "1") -> DataFrame:
    """I7. ``run_id, manifest, manifest_hash``: source, engine and the run's outputs by format.
    ``runs`` has ``run_id, title, source_kind, source_hash, created_at``."""
    item = F.struct("format", "grounding_score", F.col("output_hash").alias("hash"), "review_state")
    lists = outputs.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("outputs"))
    rows = runs.join(lists, "run_id", "left")
    fields = {
        "algorithm": F.lit("sha256"),
        "created_at": _timestamp(F.col("created_at")),
        "engine": F.struct(F.lit(model).alias("model_version"), F.lit(pipeline).alias("pipeline_version"), F.lit(prompt).alias("prompt_version")),
        "outputs": F.coalesce("outputs", F.array().cast(lists.schema["outputs"].dataType)),
        "source": F.struct(F.col("source_hash").alias("hash"), F.col("source_kind").alias("kind"), F.col("title").alias("title")),
        "transformation_id": F.col("run_id").cast("string"),
    }
    rows = rows.select("run_id", canonical_json(fields).alias("manifest"))
    return rows.withColumn("manifest_hash", sha256(F.col("manifest")))


def apply_edits(outputs: DataFrame, edits: DataFrame) -> DataFrame:
    """I8. The latest edit of each output becomes its edited body: new hash and size, version up by the
    number of edits, review reset; the grounding is marked stale."""
    last = edits.groupBy("output_id").agg(F.max_by("body", "ts").alias("new_body"), F.count(F.lit(1)).alias("n"))
    rows = outputs.join(last, "output_id", "left")
    edited = F.col("n").isNotNull()
    pick = lambda new, old: F.when(edited, new).otherwise(F.col(old))
    return rows.select(
        "output_id", "run_id", "format", "body", pick(F.col("new_body"), "edited_body").alias("edited_body"), F.col("output_hash").alias("previous_hash"),
        pick(sha256(F.coalesce("new_body", F.lit(""))), "output_hash").alias("output_hash"), pick(F.length("new_body"), "char_count").alias("char_count"),
        (F.col("version") + F.coalesce("n", F.lit(0))).alias("version"), pick(F.lit("pending_review"), "review_state").alias("review_state"),
        F.when(~edited, F.col("reviewed_by")).alias("reviewed_by"), edited.alias("grounding_stale"),
    )


def apply_reviews(outputs: DataFrame, reviews: DataFrame) -> DataFrame:
    """I9. The latest review sets state, reviewer, note and time; ``audit_action`` names the event to append."""
    last = reviews.groupBy("output_id").agg(F.max_by(F.struct("state", "actor", "note", "ts"), "ts").alias("r"))
    rows = outputs.drop("reviewed_by", "review_note", "reviewed_at").join(last, "output_id", "left")
    return rows.select(
        *[c for c in rows.columns if c not in ("r", "review_state")], F.coalesce("r.state", "review_state").alias("review_state"), F.col("r.actor").alias("reviewed_by"),
        F.col("r.note").alias("review_note"), F.col("r.ts").alias("reviewed_at"), F.concat(F.lit("output."), "r.state").alias("audit_action"),
    )


def regenerate(outputs: DataFrame, chosen: DataFrame, fresh: DataFrame) -> DataFrame:
    """I10. Outputs in ``chosen`` (``output_id``) take body and title of ``fresh`` (by run and format):
    new hash, version up by one, review reset. Others stay."""
    new = fresh.select("run_id", "format", F.col("body").alias("_body"), F.col("title").alias("_title"))
    rows = outputs.join(chosen.select("output_id", F.lit(True).alias("_again")), "output_id", "left").join(new, ["run_id", "format"], "left")
    again = F.coalesce("_again", F.lit(False)) & F.col("_body").isNotNull()
    pick = lambda new, old: F.when(again, new).otherwise(F.col(old)).alias(old)
    changed = {
        "title": F.col("_title"), "body": F.col("_body"), "output_hash": sha256(F.col("_body")), "char_count": F.length("_body"), "version": F.col("version") + 1,
        "review_state": F.lit("pending_review"), "edited_body": F.lit(None).cast("string"), "reviewed_by": F.lit(None).cast("string"),
    }
    return rows.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in outputs.columns])


def effective_body() -> Column:
    return F.coalesce("edited_body", "body")


def verify_outputs(outputs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """I11. ``output_id, intact, verdict`` and, with ``runs`` (``run_id, source_text, source_hash``), whether
    the source still has its hash."""
    rows = outputs.withColumn("intact", sha256(F.coalesce(effective_body(), F.lit(""))) == F.col("output_hash"))
    out = ["output_id", "intact", F.when(F.col("intact"), "intact").otherwise("modified").alias("verdict")]
    if runs is not None:
        rows = rows.join(runs.select("run_id", (sha256(F.coalesce("source_text", F.lit(""))) == F.col("source_hash")).alias("source_intact")), "run_id", "left")
        out.append("source_intact")
    return rows.select(*out)


def grants(spark) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in rules.GRANTS.items() for p in ps], "actor_role string, permission string")


def permission_violations(events: DataFrame, needed: Column) -> DataFrame:
    """I12. Events whose role is unknown or lacks the permission that the action needs."""
    rows = events.withColumn("permission", needed).where("permission is not null")
    return rows.join(F.broadcast(grants(events.sparkSession)), ["actor_role", "permission"], "left_anti")


def self_approvals(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """I13. Approved outputs whose reviewer requested the run."""
    rows = outputs.where("review_state = 'approved'").join(runs.select("run_id", "requested_by"), "run_id")
    return rows.where("reviewed_by = requested_by").select("output_id", "run_id", "reviewed_by")
