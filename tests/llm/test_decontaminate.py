import hashlib
import re

from groundwork.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, size=dc.WINDOW):
    """Every window of every item against every place of every document."""
    out = []
    for doc_id, text in docs:
        words, hit, items = words_of(text), set(), set()
        for item, item_text in bench:
            own = words_of(item_text)
            n = min(size, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= {str(item)} - {"None"}
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


BENCH = [
    (1, "The quick brown Fox jumps over the lazy dog, and then it sleeps in the warm sun."),
    (2, "short item"),
    (10, "Été à la plage avec trois amis et un grand chien noir qui nage"),
    (3, None),
    (4, " ... "),
    (2, "short item"),
    (None, "nameless words of an item whose id is missing altogether here now"),
]
DOCS = [
    (1, "Intro. the QUICK brown-fox jumps; over the lazy dog and then it sleeps, the end"),
    (2, "a short, item here and a SHORT item there short"),
    (3, None),
    (4, ""),
    (5, "ÉTÉ à la plage avec trois amis et un grand chien noir"),
    (6, "été? Été à la plage avec trois amis et un grand; chien noir qui nage"),
    (7, "the quick brown fox jumps over the lazy cat"),
    (8, "x " * 3000 + "short item " + "y " * 3000),
    (1, "short item"),
    (None, "nameless words of an item whose id is missing altogether here now"),
]


def test_report_equals_brute_force_in_any_number_of_lots(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    want = brute(DOCS, BENCH)
    for lot_bytes in (dc.LOT_BYTES, 400):
        assert sorted(map(tuple, dc.report(docs, bench, lot_bytes=lot_bytes).collect()), key=str) == want
    assert {r[0]: r[2] for r in want}[6] > 0 and sum(r[5] for r in want) == 7


def test_report_equals_brute_force_on_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, bench)


def test_spans_and_documents_are_removed(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs.where("doc_id <> 1"), bench).collect()}
    assert cut[2] == "a  here and a  there short" and cut[3] is None and cut[6] == "été? " and cut[7] == dict(DOCS)[7]
    kept = dc.decontaminate(docs, bench, remove="documents")
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7]


def test_empty_tables_and_clashing_columns(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert dc.report(docs.limit(0), bench).collect() == []
    rows = dc.report(docs.selectExpr("*", "1 as hits", "'x' as items", "2 as words"), bench.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r["contaminated"] for r in rows) and rows[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_two_windows_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dc, "run_hash", lambda values, starts, ends: (starts * 0).astype("uint64"))
    table = dc.Table([("aa bb", "1"), ("cc dd", "2"), ("cc d", "3")])
    words = dc.Words.of(pa.array(["x cc dd y", "c cdd"]))
    assert [(n, a.tolist(), [table.items[table.item[table.item_first[k]]] for k in w]) for n, a, w in table.hits(words) if len(a)] == [(2, [1], ["2"])]
