import hashlib

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.operators import grounding, knowledge, vectors
from groundwork.plans import oracles, registry


def test_all_claims_are_checked(spark):
    body = "\n".join(f"Harbour {k} handled many containers in May" for k in range(75))
    outs = spark.createDataFrame([(1, 1, body)], "output_id long, run_id long, body string")
    evidence = spark.createDataFrame([(1, 0, body)], "run_id long, ordinal int, text string")
    judged = grounding.judge_claims(outs, evidence)
    assert judged.count() == 75 and grounding.claim_support(grounding.claims(outs), evidence).where("verbatim").count() == 75
    assert grounding.grounding_report(outs, judged).first().claims_total == 75
    assert grounding.claims(outs, most=grounding.MOST_CLAIMS).agg(F.max("claim_no")).first()[0] == 60
    sql = oracles.sql()
    assert not any("claim_no <= 60" in sql[q] for q in ("g6_g7_claim_support", "g9_judged_claims", "g10_g11_report"))


def test_weights_round_halves_as_sql_does():
    # 1023 of 1025 sentences hold the term: 1 + 1025 / 1024 ends in 5 at the tenth decimal
    held = [["common"]] * 1023 + [[], []]
    _, scores, _ = knowledge._weighed(pa.array([[10] * 1025], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.list_(pa.string()))), 12)
    asked = "SELECT round(sum(x) * 1.0::DOUBLE, 9) FROM (SELECT 1 + 1025 / (1 + 1023) AS x)"
    assert scores[500] == duckdb.sql(asked).fetchall()[0][0] == 2.000976563


def both(spark, tmp_path, query, texts):
    """Rows of a query over documents of these texts, by Spark and by its SQL."""
    rows = [(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    asked = con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracles.sql()[query]})").fetchall()
    return sorted(map(tuple, found.collect()), key=str), sorted(asked, key=str)


def test_intake_keeps_whole_texts(spark, tmp_path):
    long = "Ten words. " * 200_000
    got, wanted = both(spark, tmp_path, "a8_route_intake", ["a b", "", " \n", "\x0b", "one\x0btwo", "x", "", long, long, "a\tb\r\nc"])
    assert got == wanted and ("in/8.txt", "8", "text", 2_200_000, 400_000, "") in got
    bad = registry.files.route_intake(spark.createDataFrame([("a.txt", None, None, None)], "filename string, title string, byte_size long, text string"))[1]
    assert bad.first().reasons == ["no text found"]


def test_an_address_before_an_account_number_is_no_card(spark, tmp_path):
    # 33 and 1059743005346 together pass the Luhn check, neither does alone
    got, wanted = both(spark, tmp_path, "l1_risk_summary", ["host 10.20.30.33 1059743005346 x", "pay 4111111111111111 now", "calm", None])
    assert got == wanted and ("en", "medium", 1, 0.0) in got and ("en", "critical", 1, 0.0) in got


def test_features_are_hashed_as_md5_does():
    names = ["a_b", "x", "Wort", "é" * 27, "q" * 54, "q" * 55, "z" * 56, "z" * 200, *(f"w{k}_v{k % 7}" for k in range(5000))]
    for lead in (b"", b"x"):
        bucket, sign = vectors._hashes(pa.array(["cut off", *names])[1:], lead, 512)
        digests = [hashlib.md5(lead + n.encode()).hexdigest() for n in names]
        assert bucket.tolist() == [int(d[:8], 16) % 512 for d in digests]
        assert sign.tolist() == [1.0 if d[8] >= "8" else -1.0 for d in digests]


def test_no_feature_is_a_call_of_its_own(monkeypatch):
    calls = []
    monkeypatch.setattr(vectors.hashlib, "md5", lambda *a, **k: calls.append(a) or hashlib.new("md5", a[0]))
    row, bucket, x = vectors.vectors_of(pa.array([["ab", "cd", "ab"], [], None, ["ab"]], pa.list_(pa.string())))
    assert not calls and set(row.tolist()) == {0, 3} and len(bucket) == len(x)
