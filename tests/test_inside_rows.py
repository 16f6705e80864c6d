"""Steps that work inside a row or a task: their plans deal nothing, and work nothing out twice."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import compose, grounding, knowledge, relational, retrieval, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_subject_works_out_its_text_once(spark):
    docs = spark.createDataFrame([(1, "A b c\nwords")], "doc_id long, text string")
    one = plan(docs.select(T.normalise_ws("text").alias("x"))).count("regexp_replace")
    assert plan(docs.select(knowledge.subject(T.normalise_ws("text")).alias("x"))).count("\\x7f") == plan(docs.select(T.normalise_ws("text").alias("x"))).count("\\x7f") > 0 < one
    rows = ["", "   ", "one two", "- Report on the harbour\nx", "ends here with stop.\nthree words here", "word " * 60, "\n" * 14 + "far line of words", "a b c d"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1).select(knowledge.subject(T.normalise_ws("text"))).collect()]
    assert got == ["Untitled source", "Untitled source", "one two", "Report on the harbour", "three words here", ("word " * 24).strip()[:119] + "…", "far line of words", "a b c d"]


def test_indicators_behind_gates(spark):
    text = "cve-2024-12345 CWE-79 mitre att&ck T1059.001 10.0.0.1/8 " + "ab" * 32 + " " + "0c" * 20
    got = spark.createDataFrame([(text,), ("nothing",), ("",)], "t string").select(knowledge.indicators(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["cve-2024-12345", "CWE-79", "10.0.0.1/8", "ab" * 32, "0c" * 20, "mitre att&ck", "T1059.001"], [], []]


def test_claims_meet_evidence_without_buckets_or_terms_as_rows(spark):
    claims = spark.createDataFrame([(1, 1, 1, "harbour traffic grew"), (2, 1, 1, "12 34"), (3, 2, 1, "no evidence here"), (4, 1, 1, "zebra quartz")], "output_id long, run_id long, claim_no int, claim string")
    evidence = spark.createDataFrame([(1, 0, "In May harbour traffic grew quickly"), (1, 1, "harbour"), (1, 2, "")], "run_id long, ordinal int, text string")
    rows = grounding.claim_support(claims, evidence)
    assert "Generate" not in plan(rows)
    got = {r.output_id: (round(r.support, 4), r.verbatim) for r in rows.collect()}
    assert got[1] == (1.0, True) and got[2] == (0.0, False) and got[3] == (0.0, False) and not got[4][1] and got[4][0] < 0.2


def test_keyword_scores_equal_brute_force(spark):
    pick = random.Random(4)
    words = [f"term{k}" for k in range(12)]
    chunks = [(d, k, " ".join(pick.choices(words[:9], k=pick.randrange(0, 8)))) for d in range(30) for k in range(pick.randrange(1, 6))]
    asked = [(100 + d, d, " ".join(pick.choices(words, k=pick.randrange(0, 5)))) for d in range(32)]
    rows = retrieval.keyword_scores(spark.createDataFrame(asked, "run_id long, doc_id long, query string"), spark.createDataFrame(chunks, "doc_id long, ordinal int, text string"))
    assert "Generate" not in plan(rows)
    want = {}
    for run, d, q in asked:
        units = {k: set(t.split()) for x, k, t in chunks if x == d}
        idf = {t: 1 + len(units) / (1 + sum(t in u for u in units.values())) for u in units.values() for t in u}
        rate = {t: idf.get(t, max(idf.values(), default=1.0)) for t in set(q.split())}
        want |= {(run, d, k): pytest.approx(min(1.0, sum(rate[t] for t in rate if t in u) / sum(rate.values()))) for k, u in units.items() if u & set(rate)}
    assert {(r.run_id, r.doc_id, r.ordinal): r.keyword_score for r in rows.collect()} == want


def test_picks_and_cosines_inside_the_row(spark):
    texts = ["harbour traffic grew", "harbour traffic grew", "the storm closed ports", "", "traffic", "ports grew"]
    pool = spark.createDataFrame([(1, 5, k + 1, k, None, t, round(0.9 - 0.01 * k, 2)) for k, t in enumerate(texts)], "run_id long, doc_id long, place int, ordinal int, heading string, text string, score double")
    rows = retrieval.mmr(pool, 4)
    assert "Join" not in plan(rows)
    weights = {}
    for r in vectors.hash_embed(pool, ["ordinal"]).collect():
        weights.setdefault(r.ordinal, {})[r.bucket] = r.w
    dot = lambda a, b: sum(w * weights.get(b, {}).get(k, 0.0) for k, w in weights.get(a, {}).items())
    left, want = list(range(6)), []
    while len(want) < 4:
        want.append(max(left, key=lambda i: (0.65 * round(0.9 - 0.01 * i, 2) - 0.35 * max((dot(i, p) for p in want), default=0.0), -i)))
        left.remove(want[-1])
    assert [(r.pick, r.ordinal, r.text) for r in rows.orderBy("pick").collect()] == [(k + 1, i, texts[i]) for k, i in enumerate(want)]
    pairs = spark.createDataFrame([(a, b, texts[a], texts[b]) for a in range(6) for b in range(6)], "a int, b int, one string, other string")
    assert all(math.isclose(r.c, dot(r.a, r.b), abs_tol=1e-9) for r in vectors.text_cosines(pairs, ["a", "b"], "one", "other", "c").collect())


def test_sections_are_composed_inside_the_row(spark):
    text = "Storm report\n\nThe storm closed 12 ports on 3 May 2021. Officials confirmed that 4500 people left the coast."
    k = knowledge.build_knowledge(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    k = spark.createDataFrame(k.collect(), k.schema)
    runs = spark.createDataFrame([(7, 1, ["x_post", "advisory", "x_post", "unknown"], "brief", "")], "run_id long, doc_id long, requested_formats array<string>, detail string, source_title string")
    rows = compose.compose(runs, k)
    assert "Aggregate" not in plan(rows)
    got = {r.format: r for r in rows.collect()}
    assert set(got) == {"x_post", "advisory"} and [s.key for s in got["x_post"].section_map] == ["post", "post"]
    assert [s.key for s in got["advisory"].section_map] == [s[0] for s in compose.SECTIONS["advisory"]]
    assert all(s.char_count > 0 for r in got.values() for s in r.section_map) and "12 ports" in got["advisory"].body


def test_rated_without_any_terms():
    none = pa.array([[]], pa.list_(pa.string()))
    row, unit, score = retrieval._rated(none, pa.array([[[]]], pa.list_(pa.list_(pa.string()))))
    assert len(row) == len(unit) == len(score) == 0


def test_formats_are_compared_inside_the_run(spark):
    rows = [(1, "a", ["1,200", "5", "5"]), (1, "b", ["1200"]), (1, "b", ["7"]), (1, "c", []), (2, "a", None), (3, "a", [f"{k:03d}" for k in range(50)]), (None, "a", ["1"])]
    got = relational.compare_formats(spark.createDataFrame(rows, "run_id long, format string, numbers array<string>"), F.col("numbers"))
    assert "Window" not in plan(got) and "Join" not in plan(got)
    assert {(r.run_id, r.format): (r.shared, r.divergent, r.only_here) for r in got.collect()} == {
        (1, "a"): ([], ["1200", "5"], ["5"]), (1, "b"): ([], ["1200", "7"], ["7"]), (1, "c"): ([], [], []), (2, "a"): ([], [], []), (3, "a"): ([f"{k:03d}" for k in range(40)], [], []),
    }


def test_entities_signals_and_risks_inside_the_row(spark):
    text = "Acme Corp met The Border Agency. Then Acme Corp paid.\n\nNASA saw a severe outage; the Border Agency did not. We recommend that NASA and Zeta act. Beta lost."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Plain words only here.")], "doc_id long, text string")
    rows = knowledge.build_knowledge(docs)
    assert not any(x in plan(rows) for x in ("Aggregate", "Join", "Generate", "Window", "Repartition"))
    got = {r.doc_id: r for r in rows.collect()}
    assert [(e["name"], e["mentions"]) for e in got[1].entities] == [("Acme Corp", 2), ("Border Agency", 2), ("Nasa", 2)]
    assert list(got[1].section_signals) == ["recommendation", "timeline"] and len(got[1].risk_markers) == 1
    assert got[2].entities is got[2].section_signals is None and got[4].risk_markers == []
    mentions = knowledge.entity_mentions(docs)
    assert "Aggregate" not in plan(mentions) and "Join" not in plan(mentions) and "Filter" not in plan(mentions)
    assert {(r.name, r.mentions, r.sent_no) for r in mentions.collect() if r.doc_id == 1} == {("Acme Corp", 2, 0), ("Border Agency", 2, 0), ("NASA", 2, 2), ("Zeta", 1, 3), ("Beta", 1, 4)}


def test_counted_runs(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), ([],), (["x"],)], "x array<string>").select(T.counted(F.col("x"), lambda v: v, lambda v, n: F.struct(v.alias("v"), n.alias("n"))).alias("x"))
    assert [[tuple(s) for s in r.x] for r in rows.collect()] == [[("a", 2), ("b", 1), ("c", 3)], [], [("x", 1)]]
