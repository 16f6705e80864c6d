"""Corpus-wide summaries: risk by language and source, grounding of foreign text, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, normalise_ws
from ..sources.tables import written
from .chunking import chunks
from .grounding import MOST_CLAIMS, claim_support, grounding_report, judge_claims, numbers_of
from .security import found_categories, injection_score, resolve_pii, risk_by_presence

#: Parts into which the documents of one term are split.
SALTS = 16


def risk_summary(docs: DataFrame, group: str = "lang", text_col: str = "text") -> DataFrame:
    """L1. Documents and mean injection score by group and risk level, with subtotals (null keys)."""
    rows = docs.select(F.col(group).alias("grp"), normalise_ws(text_col).alias("body"))
    rows = rows.select("grp", risk_by_presence(F.col("body")).alias("risk_level"), injection_score(F.col("body")).alias("score"))
    return rows.rollup("grp", "risk_level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"))


def pii_type_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """L1. Documents by category of personal data."""
    rows = docs.select(normalise_ws(text_col).alias("body"))
    return rows.select(F.explode(found_categories(resolve_pii(F.col("body")))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("documents"))


def foreign_candidates(claims: DataFrame, docs: DataFrame, min_share: float = 0.5, k: int = 3) -> DataFrame:
    """L5. For each foreign text (``item_id, text``) its ``k`` best documents by the share of all its terms
    that they hold (at least ``min_share``): ``item_id, rank, doc_id, shared, n_terms, support``.

    A document with the share holds at least ``h`` of an item's ``n - need + h`` rarest terms; ``h`` is half of the
    terms needed, so that the most frequent quarter is looked up for candidates only. Terms are joined by salted keys."""
    pair = ["item_id", "doc_id"]
    terms = claims.select("item_id", F.explode(F.array_distinct(content_tokens("text"))).alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(content_tokens("text"))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    held = written(held)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by = Window.partitionBy("item_id")
    found = terms.join(df, "term", "left").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy(F.coalesce("df", F.lit(0)), "term")))
    found = found.withColumn("need", F.greatest(F.lit(1), F.ceil((min_share - 5e-7) * F.col("n")))).withColumn("h", F.ceil(F.col("need") / 2))
    rare = found.where((F.col("r") <= F.col("n") - F.col("need") + F.col("h")) & F.col("df").isNotNull()).select("item_id", "h", "term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = rare.join(held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), ["term", "salt"])
    near = hits.groupBy(*pair).agg(F.count(F.lit(1)).alias("hits"), F.first("h").alias("h")).where("hits >= h").select(*pair)
    wanted = terms.groupBy("item_id").agg(F.collect_list("term").alias("item_terms"))
    near = written(near)
    fetched = held.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    both = near.join(wanted, "item_id").join(fetched.groupBy("doc_id").agg(F.collect_list("term").alias("doc_terms")), "doc_id")
    scored = both.select(*pair, F.size(F.array_intersect("item_terms", "doc_terms")).cast("long").alias("shared"), F.size("item_terms").cast("long").alias("n_terms"))
    scored = scored.withColumn("support", F.round(F.col("shared") / F.col("n_terms"), 6)).where(F.col("support") >= min_share)
    order = Window.partitionBy("item_id").orderBy(F.desc("support"), "doc_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "shared", "n_terms", "support")


def ground_foreign(claims: DataFrame, docs: DataFrame, min_share: float = 0.5, k: int = 3) -> DataFrame:
    """L5. ``foreign_candidates`` with G6 over the chunks of each document: ``claim_support, verbatim``."""
    best = written(foreign_candidates(claims, docs, min_share, k))
    run = F.concat_ws("-", "item_id", "doc_id").alias("run_id")
    body = claims.select("item_id", normalise_ws("text").alias("claim"))
    rows = best.join(body, "item_id").select(F.col("item_id").alias("output_id"), run, F.lit(0).alias("claim_no"), "claim")
    parts = chunks(docs.select("doc_id", "text").join(best.select("doc_id").distinct(), "doc_id", "left_semi"))
    evidence = best.select("item_id", "doc_id").join(parts, "doc_id").select(run, "ordinal", "text")
    judged = claim_support(rows, evidence).select("run_id", F.col("support").alias("claim_support"), "verbatim")
    return best.withColumn("run_id", run).join(judged, "run_id").drop("run_id")


def foreign_verdicts(claims: DataFrame, docs: DataFrame, min_share: float = 0.5, k: int = 3) -> DataFrame:
    """L5, G5 to G10 for foreign texts (``item_id, text``): their first 60 claims and numbers against the chunks of the candidate
    documents. ``item_id, candidates, grounding_score, verdict, claims_total, claims_supported, invented_numbers`` and
    ``held_elsewhere``: documents of the corpus, candidates or not, that hold an invented number.

    Only candidates' texts are cut into chunks. Numbers of the corpus are posted only if an item asks for them, and counted
    before they are dealt by number, so that a number that most documents hold is no hot key."""
    best = written(foreign_candidates(claims, docs, min_share, k).select("item_id", "doc_id"))
    parts = chunks(docs.select("doc_id", "text").join(best.select("doc_id").distinct(), "doc_id", "left_semi"))
    evidence = written(best.join(parts, "doc_id").select(F.col("item_id").alias("run_id"), (F.col("doc_id") * 100_000 + F.col("ordinal")).alias("ordinal"), "text"))
    outputs = claims.select(F.col("item_id").alias("output_id"), F.col("item_id").alias("run_id"), F.col("text").alias("body"))
    report = written(grounding_report(outputs, judge_claims(outputs, evidence, most=MOST_CLAIMS)))
    asked = report.select("output_id", F.explode("invented_numbers").alias("number"))
    wanted = asked.select("number").distinct()
    posted = docs.select(F.explode(F.array_distinct(numbers_of(F.col("text")))).alias("number")).join(F.broadcast(wanted) if wanted.count() < 100_000 else wanted, "number", "left_semi")
    holders = posted.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    elsewhere = asked.join(holders, "number").groupBy("output_id").agg(F.sum("n").alias("held_elsewhere"))
    counted = best.groupBy(F.col("item_id").alias("output_id")).agg(F.count(F.lit(1)).alias("candidates"))
    rows = report.join(counted, "output_id", "left").join(elsewhere, "output_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("output_id").alias("item_id"), zero("candidates"), "grounding_score", "verdict", "claims_total", "claims_supported", "invented_numbers", zero("held_elsewhere"))
