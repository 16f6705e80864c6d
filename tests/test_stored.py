import os
from datetime import datetime, timedelta

import pytest
from providers import broken, letters, mute
from pyspark.sql import functions as F

from groundwork.operators import provenance, vectors
from groundwork.sources import exports, stored

EVENTS = "chain_id long, event_id long, action string, actor string, actor_role string, summary string, detail string, created_at timestamp"


def events(spark, ids, chain=1):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(chain, k, "view", "ann", "viewer", f"event {k}", None, start + timedelta(minutes=k)) for k in ids], EVENTS)


def parts(path):
    """Data files by partition folder."""
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.startswith("part-")) for d in os.listdir(path) if "=" in d}


def test_exports_appear_on_commit_only(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"{i}-brief/..md" if i == 3 else f"{i}-brief.md", f"---\nrun: {i}\n---\n\né {i}") for i in range(5)] + [("..", None), ("a_b", "1"), ("a/b", "2")]
    df = spark.createDataFrame(rows, "filename string, content string").repartition(3)
    for _ in range(2):  # written again: the same files
        exports.write_exports(df, out)
        got = {n: open(os.path.join(out, n), encoding="utf-8").read() for n in os.listdir(out)}
        assert got == {exports.safe_name(n): c or "" for n, c in rows} and len(got) == len(rows)
    with pytest.raises(Exception, match="no room left"):
        exports.write_exports(df.withColumn("content", F.lit("new")).withColumn("filename", F.concat(F.lit("new-"), "filename")), out, fail_after="1")
    assert {n: open(os.path.join(out, n), encoding="utf-8").read() for n in os.listdir(out)} == got
    exports.write_exports(df.limit(0), out)
    assert sorted(os.listdir(out)) == sorted(got)


def test_a_repeated_task_leaves_one_file(tmp_path):
    writer = exports.ExportWriter(str(tmp_path))
    rows = [{"filename": "x.md", "content": "text"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.folder != kept.folder and not (tmp_path / "x.md").exists()
    writer.commit([kept, None])
    assert os.listdir(tmp_path) == ["x.md"]


def test_retention_rewrites_touched_partitions_only(spark, tmp_path):
    path, day = str(tmp_path / "t"), datetime(2024, 1, 1)
    rows = [(k, day + timedelta(days=k) if k else None, k // 10) for k in range(60)]
    stored.store(spark.createDataFrame(rows, "id long, created_at timestamp, part int"), path, "part")
    before = parts(path)
    now = F.lit("2024-02-05").cast("timestamp")  # day 35; 12 days back: day 23
    assert stored.retain(spark, path, "part", now, 12) == 3
    after = parts(path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, *range(23, 60)]
    assert {k: v for k, v in after.items() if k in ("part=3", "part=4", "part=5")} == {k: v for k, v in before.items() if k in ("part=3", "part=4", "part=5")}
    assert "part=1" not in after and after["part=2"] != before["part=2"]
    assert stored.retain(spark, path, "part", now, 12) == 0


def test_two_appends_are_one_chain_and_a_stale_head_is_refused(spark, tmp_path):
    log = stored.AuditLog(spark, str(tmp_path / "audit"))
    assert log.events() is None and log.append(events(spark, range(4)).unionByName(events(spark, range(2), 7))) == 1
    assert log.append(events(spark, range(4, 9))) == 2
    (one, seven) = sorted(provenance.verify_chain(log.events()).collect())
    assert one["valid"] and one["length"] == 9 and seven["valid"] and seven["length"] == 2
    with pytest.raises(stored.StaleHead):
        log.append(events(spark, [99]), at=1)
    assert log.events().count() == 11 and sorted(os.listdir(tmp_path / "audit" / "events")) == sorted(log.commits())
    assert log.append(events(spark, [99], 3), at=2) == 3


def test_deleted_documents_leave_a_tombstone_in_the_chain(spark, tmp_path):
    folder, log = str(tmp_path), stored.AuditLog(spark, str(tmp_path / "audit"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("f").alias("file_hash"), F.lit("t").alias("text_hash"), stored.bucket("id", 16).alias("part"))
    runs = spark.range(600).select(F.col("id").alias("run_id"), (F.col("id") % 200).alias("doc_id")).withColumn("part", stored.bucket("doc_id", 16))
    stored.store(docs, f"{folder}/documents", "part")
    stored.store(runs, f"{folder}/runs", "part")
    before = parts(f"{folder}/documents")
    log.append(events(spark, range(3), 0))
    ids = spark.createDataFrame([(5,), (17,)], "doc_id long")
    touched = stored.delete_stored(spark, folder, ["runs"], ids, F.lit("2024-06-01").cast("timestamp"), log)
    assert touched["documents"] in (1, 2) and sum(parts(f"{folder}/documents").get(k) != v for k, v in before.items()) == touched["documents"]
    assert spark.read.parquet(f"{folder}/documents").count() == 198 and spark.read.parquet(f"{folder}/runs").count() == 594
    (row,) = provenance.verify_chain(log.events()).collect()
    told = log.events().where("action = 'document.deleted'").collect()
    assert row["valid"] and row["length"] == 5 and {r["doc_id"] for r in told} == {"5", "17"} and all('"runs":3' in r["detail"] for r in told)


@pytest.mark.parametrize("segment", [3, 1 << 14])
def test_verification_by_segments(spark, segment):
    chain = provenance.append_chain(events(spark, range(20)).unionByName(events(spark, range(8), None)))
    verify = lambda df: {r["chain_id"]: (r["valid"], r["length"], r["broken_at_seq"]) for r in provenance.verify_chain(df, segment).collect()}
    assert verify(chain) == {1: (True, 20, None), None: (True, 8, None)}
    many = chain.where("chain_id = 1").crossJoin(spark.range(1, 21).withColumnRenamed("id", "k"))  # a damaged copy for each entry
    altered = many.withColumn("summary", F.when(F.expr("seq = k"), "x").otherwise(F.col("summary"))).withColumn("chain_id", F.col("k"))
    cut = many.where("seq <> k").withColumn("chain_id", F.col("k") + 100)
    got = verify(altered.unionByName(cut).drop("k"))
    assert got == {k: (False, 20, k) for k in range(1, 21)} | {100 + k: (False, 19, k + 1) for k in range(1, 20)} | {120: (True, 19, None)}
    assert verify(chain.where("chain_id is null or seq > 7"))[1] == (False, 13, 8)
    assert verify(chain.limit(0)) == {}


def test_providers_fall_back_in_order(spark, tmp_path, monkeypatch):
    units = spark.createDataFrame([(k, "abc" * (k % 5) if k % 7 else None) for k in range(300)], "id long, text string").repartition(4)
    toy = vectors.Provider("letters", letters)
    bad = [vectors.Provider("broken", broken), vectors.Provider("mute", mute)]
    rows = vectors.embed_table(units, ["id"], provider=[*bad, toy]).collect()
    assert {r["id"] for r in rows} == {k for k in range(300) if k % 5 and k % 7}
    assert {(r["bucket"], r["w"]) for r in rows} == {(b, 0.57735) for b in range(3)}
    assert vectors.embed_table(units, ["id"], provider=bad).collect() == vectors.hash_embed(units, ["id"]).collect()


def test_a_provider_is_set_up_once_a_worker(tmp_path, monkeypatch):
    path = tmp_path / "setups"
    monkeypatch.setenv("PROVIDER_SETUPS", str(path))
    monkeypatch.setattr(vectors, "_loaded", {})
    toy = vectors.Provider("letters", letters)
    for _ in range(5):
        assert vectors._encode(toy, ["ab"] * 200).shape == (200, 26)
    assert path.read_text().split() == [str(os.getpid())]
