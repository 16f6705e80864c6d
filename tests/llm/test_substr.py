import hashlib
import random
import re

from pyspark.sql import functions as F

from groundwork.llm import shared
from groundwork.llm.substr import substring_dedup


def brute(rows, width):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = []
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "béta", "c", "δ", "epsilon", "x9"]) + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 25))]
        rows.append((i * 3, rng.choice([" ", "\n", "  ", "\t"]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b " * 400), (1004, "a b " * 300), (1005, rows[5][1]), (1006, rows[5][1]), (1007, "a\x1cb c " * 30)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, starts string, prints int")
    for width, gram, batches in ((10, 3, 3), (10, 3, 1), (50, 8, 3), (5, 5, 4)):
        got = substring_dedup(df, width=width, gram=gram, batches=batches, keep_text=True)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, width)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).collect() == []


def test_id_filter_lets_all_members_pass(spark):
    ids = spark.range(0, 4000, 2).select((F.col("id") + (1 << 60)).alias("k"))
    rows = spark.range(-4000, 4000).withColumn("k", F.when(F.col("id") != 7, F.col("id") + (1 << 60)))
    passed = [r["k"] for r in rows.where(shared.id_filter(ids, "k")("k")).collect()]
    members = {(1 << 60) + k for k in range(0, 4000, 2)}
    assert members <= set(passed) and None not in passed and len(passed) < 2010
    few = [r["k"] for r in rows.where(shared.id_filter(ids, "k", 10)("k")).collect()]  # a full bitmap spares nothing, and loses nothing
    assert members <= set(few)
    assert rows.where(shared.id_filter(ids.limit(0), "k")("k")).count() == 0
