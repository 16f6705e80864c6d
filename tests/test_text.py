import random
import re

from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.plans import registry

REPORT = """Incident Note 44
Confidential
1. 61 percent of logins came
from three networks. Analysts blocked them.

Key Findings
- The portal lost 4,200 requests
  on 3 May 2024.
[EMAIL_REDACTED]
We rotated the keys. Next audit follows."""


def one(spark, text, *columns):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(*columns).first()


def test_normalise(spark):
    got = one(spark, " a  b\r\n\r\n\r\n\r\nhyphen-\nated \x07 ﬁn ", T.normalise_ws("text"))[0]
    assert got == "a b\n\nhyphenated fin"
    assert one(spark, "ｆｕｌｌ ½", T.normalise_ws("text", full=True))[0] == "full 1⁄2"
    assert one(spark, None, T.normalise_ws("text"))[0] == ""


def test_sentences(spark):
    got = one(spark, REPORT, T.sentence_array(T.normalise_ws("text")))[0]
    assert got == [
        "Incident Note 44", "Confidential", "61 percent of logins came from three networks.", "Analysts blocked them.", "Key Findings",
        "The portal lost 4,200 requests on 3 May 2024.", "[EMAIL_REDACTED]", "We rotated the keys.", "Next audit follows.",
    ]


def test_headings(spark):
    lines = ["# Title here", "1. Introduction", "1. Rotate the token now and then please", "SECTION 4 Scope", "ALL CAPS LINE", "Slide 3", "Executive Summary", "Not a heading because it ends.", "x" * 130, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select(T.heading_of(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["Title here", "Introduction", None, "SECTION 4 Scope", "ALL CAPS LINE", "Slide 3", "Executive Summary", None, None, None]


def test_small_functions(spark):
    got = one(spark, "The Quick-fox  aaaaaaa jumps, over", T.tokens("text"), T.content_tokens("text"), T.word_count("text"), T.estimate_tokens("text"), T.strip_repeats("text"), T.truncate_words(F.col("text"), 3), T.snippet(F.col("text"), 10))
    assert got[0] == ["the", "quick-fox", "aaaaaaa", "jumps", "over"] and got[1] == ["quick-fox", "aaaaaaa", "jumps"]
    assert (got[2], got[3]) == (5, 9) and got[4] == "The Quick-fox  aaa jumps, over"
    assert got[5] == "The Quick-fox aaaaaaa…" and got[6] == "The Quick…"


def test_idf_and_cosine(spark):
    units = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "alpha"), (2, 0, "gamma")], "doc_id long, sent_no int, t string")
    got = {(r.doc_id, r.term): r.idf for r in T.idf(units, "doc_id", "sent_no", "t").collect()}
    assert got == {(1, "alpha"): 1 + 2 / 3, (1, "beta"): 2.0, (2, "gamma"): 1.5}
    row = spark.range(1).select(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0))), T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert abs(row[0] - 0.5**0.5) < 1e-12 and row[1] == 0


def test_idf_inside_the_row(spark):
    rows = spark.createDataFrame([(1, ["alpha beta", "alpha alpha"]), (2, ["gamma"]), (3, []), (4, ["the of"])], "doc_id long, x array<string>")
    listed = rows.select("doc_id", F.inline(T.idf_list(F.col("x"))))
    assert "Aggregate" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.term): (r.df, r.idf) for r in listed.collect()} == {(1, "alpha"): (2, 1 + 2 / 3), (1, "beta"): (1, 2.0), (2, "gamma"): (1, 1.5)}


def test_capitals_keep_their_length(spark):
    texts = ["ßheit am fluss", "ßaal", "ﬁeld", "ÜBER DEN FLUSS", "straße", "ABCß", "ab c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.heading_case(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["ẞheit am fluss", "ẞaal", "ﬁeld", "Über Den Fluss", "Straße", "ABCß", "Ab c"]


def test_snippet_of_a_null_text_is_null(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "two  words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.snippet, r.words) for r in registry.queries()["b12_b14_shaping"](spark, str(tmp_path)).collect()}
    assert rows == {1: (None, None), 2: ("two words", "two  words")}


def test_two_places_round_the_binary_value(spark):
    values = [k / 1000 for k in range(-1100, 1101)] + [0.125, 0.375, 0.6149995, 0.004999, 1e-9, 7.995, 12.345]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", T.two_places(F.col("v"))).collect()
    assert {r[0]: r[1] for r in rows if values[r[0]] < 8} == {k: f"{v:.2f}" for k, v in enumerate(values) if v < 8}


def test_normalising_equals_its_rules_one_by_one(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice(["a", "B", "é", " ", " ", "\t", "\n", "\n", "\r", "-", "\x07", "\x0b", "\xa0", "…", "ﬁ", "！"]) for _ in range(pick.randrange(0, 40))) for _ in range(600)]

    def plain(t):
        t = re.sub("\r\n?", "\n", t).translate({0xA0: " ", 0x2026: "...", 0xFB01: "fi", 0xFF01: "!"})
        t = re.sub(r"([^\W])-\n([^\W])", r"\1\2", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t))
        return re.sub("\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", re.sub("[ \t]+", " ", t))).strip(" \n")

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.normalise_ws("t")).collect()
    assert {r[0]: r[1] for r in rows} == {k: plain(t) for k, t in enumerate(texts)}
