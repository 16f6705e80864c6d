import hashlib
import math
import random
import re
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.functions import rules
from groundwork.operators import chunking, compose, corpus, grounding, knowledge, provenance, relational, retrieval, vectors
from groundwork.operators import runs as pipeline
from groundwork.plans import registry
from groundwork.sources import files

TEXT = "Coastal Storm Report\n" + " ".join(f"Station {k} recorded {k}{k}1 millimetres of rain and was closed for {k} hours." for k in range(1, 60)) + "\nRecommended Actions\n- Operators should inspect the gauges.\nEnd."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunks(spark):
    rows = chunking.chunks(docs(spark, TEXT, None, "short")).orderBy("doc_id", "ordinal").collect()
    own = [r for r in rows if r.doc_id == 0]
    assert [r.ordinal for r in own] == list(range(len(own))) and len(own) > 3
    assert all(len(r.text) <= 1100 * 1.3 and r.char_end - r.char_start == len(r.text) for r in own)
    assert [r.char_start for r in own] == sorted(r.char_start for r in own)
    whole = " ".join(r.text for r in own)
    assert all(f"Station {k} recorded" in whole for k in range(1, 60))
    assert own[0].heading == "Coastal Storm Report" and own[-1].heading == "Recommended Actions"
    assert [r.text for r in rows if r.doc_id == 2] == ["short"] and not [r for r in rows if r.doc_id == 1]


def test_vectors(spark):
    units = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha beta alpha"), (3, ""), (4, "omega")], "id long, text string")
    rows = vectors.hash_embed(units, ["id"]).collect()
    norm = {k: sum(r.w**2 for r in rows if r.id == k) for k in (1, 2, 4)}
    assert all(abs(v - 1) < 1e-4 for v in norm.values()) and not [r for r in rows if r.id == 3]
    assert sorted((r.bucket, r.w) for r in rows if r.id == 1) == sorted((r.bucket, r.w) for r in rows if r.id == 2)


def test_retrieval(spark):
    c = chunking.chunks(docs(spark, TEXT))
    q = spark.createDataFrame([(7, 0, "inspect the gauges")], "run_id long, doc_id long, query string")
    picks = retrieval.retrieve(q, c).orderBy("pick").collect()
    assert "inspect the gauges" in picks[0].text and len({r.ordinal for r in picks}) == len(picks) <= 6
    context = retrieval.build_context(retrieval.candidate_pool(retrieval.hybrid_scores(q, c)), "place", 1500).first().context
    assert context.startswith("[chunk ") and len(context) <= 1500


def test_knowledge_and_composition(spark):
    d = docs(spark, TEXT, "", "Acme Corp met Acme Corp. Rates rose 12 percent in the second quarter of the year.")
    k = knowledge.build_knowledge(d)
    got = {r.doc_id: r for r in k.collect()}
    assert got[0].subject == "Coastal Storm Report" and got[0].summary and len(got[0].key_facts) == 16
    assert got[1].summary == "" and got[1].topics == []
    assert [e["name"] for e in got[2].entities] == ["Acme Corp"] and got[2].entities[0]["mentions"] == 2
    runs = d.select(F.col("doc_id").alias("run_id"), "doc_id", F.array(*map(F.lit, compose.FORMATS)).alias("requested_formats"), F.lit("balanced").alias("detail"), F.lit("").alias("source_title"))
    outs = compose.compose(runs, k).collect()
    assert len(outs) == 27 and all(o.body for o in outs)
    for o in outs:
        assert len(o.body) <= compose.FORMATS[o.format][1]
    detail = spark.createDataFrame([(n, x) for n in (1, 3, 5) for x in ("brief", "balanced", "comprehensive")], "n int, d string").select(compose.scale_limit(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in detail] == [1, 1, 2, 2, 3, 4, 3, 5, 8]


def test_grounding(spark):
    evidence = spark.createDataFrame([(1, 0, "The harbour handled 412,000 containers in May and traffic grew quickly.")], "run_id long, ordinal int, text string")
    bodies = {
        10: "The harbour handled 412,000 containers in May", 11: "The harbour handled 900,000 containers in May", 12: "Penguins enjoy cold oceans beneath bright stars", 13: "Stat: 412,000", 14: "Stat: 77,000 (as stated in source)",
        15: "Confidence: Medium", 16: "", 17: "- bulleted harbour claim here",
    }
    outs = spark.createDataFrame([(k, 1, b) for k, b in bodies.items()], "output_id long, run_id long, body string")
    judged = grounding.judge_claims(outs, evidence)
    got = {r.output_id: r for r in grounding.grounding_report(outs, judged).collect()}
    assert {k: r.verdict for k, r in got.items()} == {10: "grounded", 11: "ungrounded", 12: "ungrounded", 13: "grounded", 14: "ungrounded", 15: "ungrounded", 16: "empty", 17: "ungrounded"} or got[15].verdict in ("ungrounded", "no_claims")
    assert got[11].invented_numbers == ["900000"] and got[14].invented_numbers == ["77000"] and got[10].source_grounded


def test_chain(spark):
    rows = [(c, k, "view", f"u{c}", "viewer", "s", None, datetime(2024, 1, 1, 0, k)) for c in (1, 2) for k in range(6)]
    events = spark.createDataFrame(rows, "chain_id long, event_id long, action string, actor string, actor_role string, summary string, detail string, created_at timestamp")
    chain = provenance.append_chain(events)
    assert all(r.valid for r in provenance.verify_chain(chain).collect())
    more = provenance.append_chain(events.where("event_id > 3").withColumn("event_id", F.col("event_id") + 10), provenance.chain_heads(chain))
    assert all(r.valid and r.length == 8 for r in provenance.verify_chain(chain.unionByName(more)).collect())
    for k in range(1, 7):
        bad = chain.withColumn("summary", F.when((F.col("chain_id") == 1) & (F.col("seq") == k), "x").otherwise(F.col("summary")))
        got = {r.chain_id: r for r in provenance.verify_chain(bad).collect()}
        assert got[1].broken_at_seq == k and got[2].valid
    cut = {r.chain_id: r for r in provenance.verify_chain(chain.where("not (chain_id = 1 and seq = 3)")).collect()}
    assert cut[1].broken_at_seq == 4 and "before it" in cut[1].message


def test_reviews(spark):
    outs = spark.createDataFrame([(1, 5, "a", "body", None, "h", 4, 1, "approved", "ann")], "output_id long, run_id long, format string, body string, edited_body string, output_hash string, char_count int, version int, review_state string, reviewed_by string")
    edits = spark.createDataFrame([(1, "first", 1), (1, "second", 2)], "output_id long, body string, ts int")
    r = provenance.apply_edits(outs, edits).first()
    assert (r.edited_body, r.version, r.review_state, r.reviewed_by, r.grounding_stale) == ("second", 3, "pending_review", None, True)
    runs = spark.createDataFrame([(5, "ann")], "run_id long, requested_by string")
    assert provenance.self_approvals(outs, runs).count() == 1
    events = spark.createDataFrame([(1, "viewer"), (2, "admin"), (3, "ghost")], "event_id long, actor_role string")
    assert {x.event_id for x in provenance.permission_violations(events, F.lit("output:approve")).collect()} == {1, 3}


def test_compare(spark):
    rows = spark.createDataFrame([(1, "a", ["1,200", "5"]), (1, "b", ["1200"]), (1, "c", ["1200", "9"])], "run_id long, format string, numbers array<string>")
    got = {r.format: r for r in relational.compare_formats(rows, F.col("numbers")).collect()}
    assert all(r.shared == ["1200"] for r in got.values()) and got["a"].only_here == ["5"] and got["b"].divergent == []


def test_sources(spark, tmp_path):
    urls = {"http://10.1.2.3/": False, "http://localhost/x": False, "http://169.254.169.254/": False, "http://[::1]/": False, "ftp://a.org/": False, "https://": False, "https://example.org/a?b": True, "http://user@172.20.0.1:80/": False, "http://8.8.8.8/": True}
    got = {r.url: r.allowed for r in files.classify_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == urls
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.txt").write_bytes("naïve €".encode("cp1252"))
    assert {r.text for r in files.read_text_files(spark, str(tmp_path)).collect()} == {"naïve", "naïve €"}
    lines = ["WEBVTT", "", "1", "00:01 --> 00:02", "<i>Hello</i> there", "2", "00:03 --> 00:04", "again"]
    subs = spark.createDataFrame([(1, k, v) for k, v in enumerate(lines)], "file_id long, line_no int, value string")
    assert files.subtitles_to_text(subs).first().text == "Hello there\nagain"
    rows = spark.createDataFrame([("x/a.txt", None, 5, "hello"), ("b.bin", None, 5, "x"), ("c.md", "T", 0, ""), ("d.csv", None, 99_999_999, "a")], "filename string, title string, byte_size long, text string")
    good, bad = files.route_intake(rows)
    assert [(r.filename, r.title, r.source_kind) for r in good.collect()] == [("x/a.txt", "a", "text")]
    assert {r.filename: r.reasons for r in bad.collect()} == {"b.bin": ["unsupported type"], "c.md": ["empty file"], "d.csv": ["file too large"]}
    page = "<html><head><title>T</title></head><body><nav>menu</nav><main><p>Fish &amp; chips</p>x<form>f</form></main></body></html>"
    assert spark.range(1).select(files.html_to_text(F.lit(page))).first()[0] == "Fish & chips"
    js = spark.createDataFrame([('{ "b" : 1 }',), ("not json",)], "j string").select(files.normalise_json(F.col("j"))).collect()
    assert js[0][0] == '{"b":1}' and js[1][0] == "not json"


def test_ground_foreign_counts_frequent_terms(spark):
    claims = spark.createDataFrame([(1, "velvet harbour lantern whisper granite meadow"), (2, "copper thunder orchard pebble")], "item_id long, text string")
    texts = ["The velvet harbour lantern whisper granite meadow stands."] * 8 + ["velvet harbour", "copper thunder orchard", "nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.item_id, r["rank"]): r for r in corpus.ground_foreign(claims, docs).collect()}
    assert {k: (r.doc_id, r.shared, r.n_terms, r.support) for k, r in got.items()} == {(1, 1): (0, 6, 6, 1.0), (1, 2): (1, 6, 6, 1.0), (1, 3): (2, 6, 6, 1.0), (2, 1): (9, 3, 4, 0.75)}
    assert got[1, 1].verbatim and got[1, 1].claim_support == 1.0 and not got[2, 1].verbatim and 0 < got[2, 1].claim_support < 1


def test_ground_foreign_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"term{int(rng.random() ** 2 * 40):02d}"
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 14)))) for k in range(20)]
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(120)]
    got = corpus.ground_foreign(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = set()
    for i, t in items:
        own = set(t.split())
        best = sorted((-round(len(own & set(d.split())) / len(own), 6), k) for k, d in texts)[:3]
        want |= {(i, r + 1, k, -s) for r, (s, k) in enumerate(best) if -s >= 0.5}
    assert {(r.item_id, r["rank"], r.doc_id, r.support) for r in got} == want


def test_evidence_is_every_turn_that_is_no_answer(spark, tmp_path):
    rows = [(1, t, role, f"text {t}") for t, role in enumerate(["user", "user", "assistant", "assistant", "user", "system"])] + [(1, 6, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.ordinal for r in registry._evidence_of_turns(spark, str(tmp_path)).collect()} == {0, 1, 4, 5, 6}


def test_knn_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [1.0, k / 10.0]) for k in range(8)]
    bad = [(20 + k, v) for k, v in enumerate([[nan, 1.0], [nan, nan], [1.0, nan], [inf, 1.0], [-inf, 0.0], [None, 1.0], None, [], [0.0, 0.0]])] + [(100, [1.0, nan])]
    other = [(40, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.5]), (41, [1.0])]
    base = spark.createDataFrame(good + bad + other, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.neighbour_id) for r in vectors.knn(base, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (50, 1, 40)]


def test_knn_in_lots_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for k in range(300)]  # many ties
    near = {}
    for q, v in rows[::10]:
        cos = lambda w, v=v: round(sum(a * b for a, b in zip(v, w, strict=True)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 6)
        near[q] = sorted((-cos(w), k) for k, w in rows if k != q)[:4]
    for queries in (7, 8192):
        got = {}
        for r in vectors.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), 4, 10, queries=queries).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], -r["score"]))
        assert {q: [s for _, s in sorted(x)] for q, x in got.items()} == {q: [s for s, _ in x] for q, x in near.items()}


def test_long_chain_is_folded_without_a_list(spark):
    n = 25_000
    events = spark.range(n).selectExpr("if(id % 50 = 0, 2L, 1L) as chain_id", "id as event_id", "'a' as action", "timestamp_seconds(1700000000 + id) as created_at")
    chain = provenance.append_chain(events)
    assert "collect_list" not in chain._jdf.queryExecution().toString()
    rows = chain.select("chain_id", "seq", "event_id", "prev_hash", "entry_hash", provenance.payload(chain).alias("p")).orderBy("chain_id", "seq").collect()
    assert len(rows) == n and [r.event_id for r in rows if r.chain_id == 2] == list(range(0, n, 50))
    chain_id, head = None, None
    for r in rows:
        head = head if r.chain_id == chain_id else provenance.GENESIS
        assert r.prev_hash == head
        chain_id, head = r.chain_id, hashlib.sha256(f"{head}|{r.p}".encode()).hexdigest()
        assert r.entry_hash == head


def test_runs_from_request_to_verdict(spark):
    """Composed outputs come from the source, leaks are redacted, and regeneration touches the chosen only."""
    text = "Storm report\n\nThe storm closed 12 ports on 3 May 2021. Officials confirmed that 4500 people left the coast. Mail ann@example.org for details of the closure.\n\nWe recommend that crews inspect every pier before ships return."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    knowing, chunked = knowledge.build_knowledge(docs), chunking.chunks(docs)
    asked = docs.select(F.col("doc_id").alias("run_id"), "doc_id", F.array(F.lit("executive_summary"), F.lit("advisory")).alias("requested_formats"), F.lit("balanced").alias("detail"), F.lit("").alias("source_title"), F.lit("Summarise").alias("user_instruction"))
    got = {(r["run_id"], r["format"]): r for r in pipeline.checked_outputs(asked, knowing, chunked).collect()}
    assert set(got) == {(i, f) for i in (1, 2) for f in ("executive_summary", "advisory")}
    assert "storm closed 12 ports" in got[1, "executive_summary"]["body"] and got[1, "executive_summary"]["claims_supported"] > 0
    assert all("ann@example.org" not in r["body"] for r in got.values())
    old = spark.createDataFrame([(f"{i}-{f}", i, f, "t", "stale", "h", 5, 1, "approved", None, "bob", 0.1) for i, f in got], "output_id string, run_id long, format string, title string, body string, output_hash string, char_count int, version int, review_state string, edited_body string, reviewed_by string, grounding_score double")
    rows = {r["output_id"]: r for r in pipeline.regenerate_runs(old, old.where("output_id = '1-advisory'").select("output_id"), asked, knowing, chunked).collect()}
    assert len(rows) == 4 and rows["1-advisory"]["body"] == got[1, "advisory"]["body"] and rows["1-advisory"]["version"] == 2
    assert rows["1-advisory"]["review_state"] == "pending_review" and rows["1-advisory"]["grounding_score"] == got[1, "advisory"]["grounding_score"]
    assert all((r["body"], r["version"], r["grounding_score"]) == ("stale", 1, 0.1) for k, r in rows.items() if k != "1-advisory")


def test_weights_of_a_batch_equal_those_of_each_document(spark):
    pick = random.Random(9)
    words = [[pick.randrange(0, 60) for _ in range(pick.randrange(0, 7))] for _ in range(40)]
    terms = [[sorted({pick.choice("abcdefghijklmnop") for _ in range(pick.randrange(0, 9))}) for _ in own] for own in words]
    cut, scores, best = knowledge._weighed(pa.array(words, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.list_(pa.string()))), 5)
    for d, (lengths, sents) in enumerate(zip(words, terms, strict=True)):
        idf = {t: 1 + len(sents) / (1 + sum(t in s for s in sents)) for s in sents for t in s}
        mass, own = {}, []
        for k, (n, held) in enumerate(zip(lengths, sents, strict=True)):
            own.append(round(sum(idf[t] for t in held) / math.sqrt(len(held) or 1) * (1.0 if 8 <= n <= 45 else 0.72) * (1.22 if k == 0 else 1.10 if k < 3 else 1.0), 9))
            for t in held:
                mass[t] = mass.get(t, 0.0) + own[-1] * idf[t] / max(idf.values())
        assert abs(scores[cut[d] : cut[d + 1]] - own).max(initial=0) < 2e-9
        assert best[d].as_py() == [t for _, t in sorted((-round(m, 6), t) for t, m in mass.items())[:5]]


def test_hashed_vectors_are_made_without_a_shuffle(spark):
    texts = ["ab cd ab_cd the ab", None, "12", "The the of", "x_y_z x_y z", "one two three one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    made = vectors.hash_embed(rows, ["id"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in made.collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["w"]
    want = {}
    for k, text in enumerate(texts):
        words = [w.lower() for w in re.findall(rules.TOKEN, text or "")]
        sums = Counter()
        for f, n in Counter(words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]).items():
            for lead, half in (("", 1), ("x", 0.5)):
                h = hashlib.md5((lead + f).encode()).hexdigest()
                w = (1 + math.log(n)) * (0.45 if f in rules.STOP_WORDS else 1) * (0.6 if "_" in f else 1) * half
                sums[int(h[:8], 16) % vectors.DIMS] += w if h[8] >= "8" else -w
        norm = math.sqrt(sum(x * x for x in sums.values()))
        if sums:
            want[k] = {b: pytest.approx(x / norm, abs=1.1e-6) for b, x in sums.items()}
    assert got == want
