import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_jaccard import brute as near_groups  # noqa: E402
from .test_pii import brute as spans_of  # noqa: E402


def masked(text):
    mask = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    out, at = [], 0
    for kind, a, b in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mask[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages but language ID (whose predictions are taken as they are) by brute force."""
    from tokenizers import Tokenizer

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, "x", 0), (9001, "", "en", "x", 0), (9002, "12 34", "en", None, 5), (9003, "mail me@you.org now", None, "x", None)], source.schema)
    source.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}

    kept = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    kept = {i: t for t, i in last.items()}
    kept = {i: kept[i] for i, _, c in near_groups(sorted(kept.items())) if i == c}
    kept = {i: masked(t) for i, t in kept.items()}
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*ref.encode(t, add_special_tokens=False).ids, 2] for i, t in kept.items()}

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == want.keys()
    pieces = Counter(r["doc_id"] for r in rows)
    for r in rows:
        ids = want[r["doc_id"]]
        assert pieces[r["doc_id"]] == -(-len(ids) // 1024)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for seq in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == seq), key=lambda r: r["offset"])
        assert own[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:]))
        assert own[-1]["offset"] + own[-1]["length"] <= 1024


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.collect() == []


def test_stages_with_repeats_nulls_and_clashing_columns(spark):
    """Repeated rows, equal and null ids with other texts, long texts, and columns that the stages use themselves."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text here", "en"), (1, "one text here", "en"), (1, "another text", "fr"), (None, "one text here", "en"), (None, "no id", None), (None, "no id", "de")]
    rows += [(2, near, "en"), (2, near + " x", "en"), (3, near + " y", "en"), (4, None, "en"), (5, "", "en"), (6, "123", "en"), (7, "é long " * 40000, "fr"), (8, "mail a@b.cd now", "en"), (8, "mail a@b.cd now", "de")]
    docs = spark.createDataFrame([(i, t, x, "s", 1, "zz", 0.5, 7, "k") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, _key long, spans string")
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    kept = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    after = stages["language_id"](spark, docs, "")
    assert after.columns == corpus_pipeline.COLUMNS and texts(after) == sorted(kept, key=str)
    after = stages["exact_dedup"](spark, docs, "")
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    want = sorted(((max((x for x in ids if x is not None), default=None), t) for t, ids in by.items()), key=str)
    assert [(i, t or "") for i, t in texts(after)] == want
    after = stages["near_dedup"](spark, after.withColumn("_key", F.lit(1)), "")
    assert [t for _, t in texts(after) if t and t.startswith("w0")] in ([near], [near + " x"], [near + " y"])
    assert len(texts(after)) == len(want) - 2
    after = stages["mask_pii"](spark, docs, "")
    assert after.count() == len(rows) and texts(after.where("doc_id = 8")) == [(8, "mail [EMAIL] now")] * 2
    packed = stages["packing"](spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _, _ in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
