import base64
import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from groundwork.llm import ann, bpe, dedup, html, langid, pack, shard

DOCS = "/root/testdata/sf0.001/documents.parquet"
CLASH = "digest string, block int, class string, size int"
ODD = [None, "", " ", "same", "same", "same", "naïve 漢字 😀\n\n\tit's we'll 'd''s 12½ ٣", "x" * 5000, "ab" * 3000, "word " * 4000]


def odd_docs(spark, extra=()):
    rows = [(i * 2, t, "d", 1, "c", 9) for i, t in enumerate([*ODD, *extra])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- exact dedup


def test_exact_dedup(spark):
    rows = odd_docs(spark, ["rare"] * 40 + ["hot"] * 300)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for heavy in (4, 1024):
        got = {r["doc_id"]: r for r in dedup.exact_dedup(rows, heavy=heavy, counters=2 * heavy).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            same = [k for k, x in texts.items() if x == t]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert dedup.exact_dedup(empty(spark)).collect() == []


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None), (3, ""), (4, "x" * 3_000_000)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_dedup(rows).collect()), key=str)
    want = [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, None), (None, None, 1, None), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)]
    assert got == sorted(want, key=str)


def test_frequent_digests_hold_every_heavy_hitter(spark):
    """Bounded counters over a stream with far more digests than counters."""
    names = [f"hot{k % 3}" if k % 5 else f"d{k}" for k in range(20000)]
    rows = spark.createDataFrame([(n,) for n in names], "text string").select(dedup.digest_of(F.col("text")).alias("digest")).repartition(7)
    hot = {r["n"] for r in spark.createDataFrame([(f"hot{k}",) for k in range(3)], "text string").select(dedup.short_name(dedup.digest_of(F.col("text"))).alias("n")).collect()}
    found = [r["name"] for r in dedup.frequent_digests(rows, heavy=8, counters=64).collect()]
    assert hot <= set(found) and len(found) <= 8
    assert dedup.frequent_digests(rows.limit(0)).collect() == []


# ---- byte-level BPE


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ref = library("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(odd_docs(spark).selectExpr("doc_id + 100000 as doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bpe.encode_documents(docs, path).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        ids = ref.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        ends = np.cumsum([len(ref.decode_single_token_bytes(i)) for i in ids])
        assert r["offsets"] == [0, *ends.tolist()][: len(ids)]
    assert bpe.encode_documents(empty(spark), path).collect() == []


def test_bpe_random_strings():
    ref, enc = library("byte_bpe_50k.tiktoken"), bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    bits = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'t", "'re", "'x", "!", "--", "漢", "😀", "　", "́", "\xa0", "''", "'d's", "\x85", "\x1c", "x" * 50, "zq" * 150]
    for _ in range(200):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        ids, at = enc.encode(texts)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == ref.encode_ordinary(t), repr(t)
            assert enc.decode(ids[at[k] : at[k + 1]]).tobytes() == t.encode()


# ---- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(odd_docs(spark).selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = pack.pack_documents(docs, pack.default_ranks()).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        ids = [*ref.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1
    assert pack.pack_documents(empty(spark), pack.default_ranks()).collect() == []


def test_packing_with_added_tokens(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n it's", "no <|endoftext| here", None, "é 漢<|endoftext|>" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pack.pack_documents(docs, pack.default_ranks(), keep_ids=True).collect()}
    assert got == {i: [*ref.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_vocabulary_of_the_json_equals_the_ranks():
    """``byte_bpe_50k.json`` holds the same tokens, ids and order of merges as the rank file that is read."""
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    with open(pack.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    read = lambda token: bytes(byte[c] for c in token)
    assert {read(t): i for t, i in model["vocab"].items() if i in set(ranks.values())} == ranks
    merged = [read("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    assert [ranks[m] for m in merged] == sorted(ranks[m] for m in merged)


def test_index_of_sums():
    rng = random.Random(2)
    for _ in range(30):
        left = {n: rng.randint(1, 3) for n in rng.sample(range(1, 60), rng.randint(1, 12))}
        index = pack.SumIndex(left, 80)
        for _ in range(30):
            total, used = rng.randint(1, 80), [rng.choice(list(left))] if left and rng.random() < 0.5 else []
            have = lambda more: all(left.get(n, 0) >= more.count(n) + used.count(n) for n in more)
            size = next((k for k in (1, 2, 3) for m in combinations_with_replacement(sorted(left), k) if sum(m) == total and have(m)), None)
            got = index.find(total, used)
            assert (size is None and got is None) or (len(got) == size and sum(got) == total and have(tuple(got)))
            if left and rng.random() < 0.3:
                del left[rng.choice(list(left))]


def test_packing_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (1, "other")]
    got = pack.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), pack.default_ranks()).collect()
    assert len(got) == 5 and sorted(r["offset"] for r in got)[0] == 0
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5 and sum(r["length"] for r in got) == max(r["offset"] + r["length"] for r in got)


def test_patterns_use_up_the_counts():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        used = {}
        for lengths, times in pack.plan_patterns(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts


# ---- language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(test) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in test} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_language_scores_equal_an_unfolded_kernel(spark):
    """The folded matrix gives what kernels, whitening and regression give one by one."""
    rows = [r for r in spark.read.parquet(DOCS).where("text is not null and lang is not null").orderBy("doc_id").limit(60).collect()]
    sets, _ = langid.gram_sets([r["text"][:3000] for r in rows])
    samples = [(r["lang"], s) for r, s in zip(rows[:40], sets[:40], strict=True)]
    model = langid.fit(samples, landmarks=6)

    def kernel(x, z):
        return sum(len(set(a.tolist()) & set(b.tolist())) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for a, b in zip(x, z, strict=True)) / len(langid.ORDERS)

    names = sorted({n for n, _ in samples})
    marks = [s for n in names for s in [x for m, x in samples if m == n][:6]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    features = lambda xs: np.array([[kernel(x, z) for z in marks] for x in xs]) @ vectors[:, good] / np.sqrt(values[good])
    phi = features([s for _, s in samples])
    share = np.array([1 / sum(n == m for m, _ in samples) for n, _ in samples])
    target = np.array([[1.0 if n == name else -1.0 for name in names] for n, _ in samples])
    center, bias = phi.mean(axis=0), target.mean(axis=0)
    x, y = (phi - center) * np.sqrt(share)[:, None], (target - bias) * np.sqrt(share)[:, None]
    weights = np.linalg.solve(x.T @ x + langid.RIDGE * np.eye(x.shape[1]) / x.shape[1], x.T @ y)
    want = bias + (features(sets[40:]) - center) @ weights
    assert model.languages == names
    assert np.abs(model.scores(sets[40:]) - want).max() < 1e-3


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(k * 4, "wort " * 9 if k % 2 else "mot " * 9, "de" if k % 2 else "fr") for k in range(40)] + [(1000 + k * 4, "dirty", f"x{k}") for k in range(50)]
    model = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) <= 3 and {"de", "fr"} <= set(model.languages)


def test_language_odd_rows(spark):
    rows = odd_docs(spark).selectExpr("doc_id", "text", "case when text = 'same' then 'en' end as lang", "digest", "size")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows).collect()}
    assert got[0] == got[2] == got[4] == "und" and got[6] == "en"
    assert langid.identify(empty(spark)).collect() == []


# ---- sharding


def test_sharding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).selectExpr("doc_id + 100000 as doc_id", "text"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = shard.shard_documents(docs).collect()
    assert {r["doc_id"] for r in got} == texts.keys() and len(got) == len(texts)
    home, slots, load = {}, {}, [0] * 40
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        assert home.setdefault(t, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for t in texts.values():
        groups[t] = groups.get(t, 0) + len(t) + 16
    plain = [0] * 40
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert max(load) - min(load) <= max(plain) - min(plain) + 16
    assert shard.shard_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [12, 5, None])
def test_sharding_in_classes(spark, bits):
    """With few bits most sizes are inexact: the loads are as near as the small groups allow."""
    rng = random.Random(1)
    rows = [(i, f"{i}:" + "z" * int(rng.paretovariate(1) * 30)) for i in range(2000)]
    rows += [(5000 + k // 2, "copied " * 50) for k in range(40)] + [(None, "no id"), (None, None)]
    load, home, slots = [0] * 7, {}, {}
    for r in shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 7, significant=bits).collect():
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        home.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(load) - min(load) <= (150 if bits == 5 else 60)
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())


def test_size_classes_order_like_sizes(spark):
    # 12 bits: classes of 512 sizes at 2 ** 20
    sizes = [*range(1, 9000, 7), 2**20 + 1, 2**20 + 511, 2**20 + 512, 2**40, 2**40 + 2**29]
    got = [r["c"] for r in spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k long, total long").select("k", shard.size_class("total").alias("c")).orderBy("k").collect()]
    assert got == sorted(got) and got[:100] == sizes[:100] and got[-5] == got[-4] < got[-3] < got[-2] < got[-1]


# ---- nearest neighbours


def brute_neighbours(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            s = sorted(((-float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())), i) for i, y in ok.items() if i != q and len(y) == len(x)))
            out[q] = s[:k]
    return out


def test_neighbours(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 50, 5)
    found = {}
    for r in ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all(sorted(x[0] for x in f) == [1, 2, 3, 4, 5] for f in found.values())
    recall = np.mean([len({v for _, v, _ in found[q]} & {i for _, i in want[q]}) / 5 for q in want])
    assert recall >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (11, [-1.0, 0.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, dims int")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 9))
    assert got[0] == {1: (1, 1.0), 2: (2, 1.0), 3: (50, round(0.5**0.5, 9)), 4: (8, 0.0), 5: (11, -1.0)}
    assert set(got) == {0, 50}
    assert ann.search(df.where("vec_id < 0")).collect() == []


def test_forest_descends_and_ascends():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((700, 16))
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    forest = ann.Forest(unit, 8)
    queries = np.concatenate([unit[:5], rng.standard_normal((20, 16))])
    code, own = ann.codes(queries, forest.normals), ann.codes(unit, forest.normals)
    common = np.array([[[ann.BITS - int(int(a) ^ int(b)).bit_length() for b in own[t]] for a in code[t]] for t in range(8)])
    assert (forest.descend(code) == common.max(axis=2)).all()
    low, high = forest.search(queries, 0.05)
    want = 8 * max(1, 0.05 * 700**ann.GROWTH)
    for q in range(len(queries)):
        level = next(x for x in range(ann.BITS, -1, -1) if x == 0 or (common[:, q] >= x).sum() >= want)
        assert set(forest.candidates(low[:, q], high[:, q])) == set(np.flatnonzero((common[:, q] >= level).any(axis=0)))


def test_share_of_candidates_falls_with_size():
    """The work of a query grows slower than the block, at a recall of 0.9 or more."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (1000, 4000, 16000):
        vectors = rng.standard_normal((n, 64))
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        block = ann.Block(np.arange(n), vectors, 5)
        asked = np.arange(0, n, n // 60)
        q, v, _ = block.nearest(asked, vectors[asked])
        found = {(a, b) for a, b in zip(q.tolist(), v.tolist(), strict=True)}
        near = np.argsort(-(unit[asked] @ unit.T), axis=1)[:, 1:6]
        assert np.mean([(a, b) in found for a, row in zip(asked.tolist(), near.tolist(), strict=True) for b in row]) >= 0.9
        shares.append(block.ranked / n / len(asked))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3, shares


def test_neighbours_over_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]
    rows += [(7, [9.0] * 6), (None, [1.0] * 6)]  # an id twice: its smallest vector counts
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {}
    for i, v in rows[:-1]:
        own[i] = min(v, own.get(i, v))
    want = brute_neighbours(list(own.items()), 50, 5)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], set()).add((r["rank"], r["vec_id"]))
    hits = [len(got[q] & {(k + 1, i) for k, (_, i) in enumerate(near)}) for q, near in want.items()]
    assert got.keys() == want.keys() and sum(hits) >= 0.9 * 5 * len(want)
    assert got[300] == {(k + 1, 301 + k) for k in range(5)}  # ties go to the smaller id


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="home"><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy</div>
<article><h1>A  title &lt;b&gt;</h1><p><b>Fish &amp; chips<br><p>Two&nbsp;words, <i>joi</i>ned</p><form>f</form><div class="cookie-notice">We use</div><ul><li>one<li>two</ul></article>
<aside>side</aside><section id="comments"><article class="comment"><p>first!</p></article></section><footer>&copy; x</footer></body></html>"""


def test_page_blocks():
    assert html.page_blocks(PAGE) == (["A title <b>", "Fish & chips", "Two words, joined", "one", "two"], True)
    assert html.page_blocks("") == ([], False)
    assert html.page_blocks("plain &am; text <") == (["plain &am; text <"], False)
    assert html.page_blocks("<body><article><p>cut here &am")[0] == ["cut here &am"]
    assert html.page_blocks("<p>" * 20000 + "x" + "<b " * 3000)[0] == ["x"]
    assert html.page_blocks("<main><p>in</p></main><p>out")[0] == ["in"]


def test_marked_names():
    for value in ("ad", "ad-slot-1", "cookie-notice", "site-footer", "share-buttons", "x comments", "related-posts", "top_ads"):
        assert html.is_marked(value, True) and html.is_marked(value, False), value
    for value in ("share-price", "search-results", "notice-period", "social-policy", "main-content", "article-list", "add", "comment-policy-text"):
        assert not html.is_marked(value, True) and not html.is_marked(value, False), value
    own = '<article><header><nav>menu</nav><h1>Title</h1><p>by line</p></header><div class="share-price">12</div><footer>f</footer></article>'
    assert html.page_blocks(own)[0] == ["Title", "12"]


@pytest.mark.parametrize("depth", [1, 3, 5, 8, 13])
def test_suffix_order(depth):
    rng = np.random.default_rng(depth)
    words, page = rng.integers(0, 3, 400).astype(np.uint32), np.sort(rng.integers(0, 9, 400))
    order, common = html.suffix_order(words, page, depth)
    suffix = lambda i: tuple(words[i : i + depth][page[i : i + depth] == page[i]])
    assert sorted(order.tolist()) == list(range(400))
    seen = [suffix(i) for i in order]
    assert seen == sorted(seen)
    for a, b, n in zip(seen, seen[1:], common[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    place, pages = html.repeats(words, page, depth)
    runs = {}
    for i in range(400):
        if len(suffix(i)) == depth:
            runs.setdefault(suffix(i), []).append(page[i])
    assert {suffix(i): n for i, n in zip(place.tolist(), pages.tolist(), strict=True)} == {k: len(set(v)) for k, v in runs.items() if len(v) > 1}


def brute_extract(pages):
    """The rule of extract with plain dictionaries, for hosts of one lot or many."""
    found = {i: html.all_blocks(h or "") for i, (_, h) in pages.items()}
    stream = {i: tuple(w for t, *_ in b for w in t.split()) for i, b in found.items()}
    out = {}
    for i, (host, _) in pages.items():
        others = {stream[k]: {t for t, *_ in found[k]} for k, (h, _) in pages.items() if h == host and stream[k]}
        count = lambda run: sum(any(s[k : k + html.RUN] == run for k in range(len(s))) for s in others)
        s, level = stream[i], []
        for k in range(len(s)):
            n = count(s[k : k + html.RUN]) if k + html.RUN <= len(s) else 0
            level.append(sum(n >= least and n >= share * len(others) for share, least in html.LEVELS))
        hit = lambda at, least: any(level[j] >= least for j in range(max(0, at - html.RUN + 1), at + 1))
        best = max((z for _, c, z, _ in found[i] if not c), default=0)
        own, at = [], 0
        prose = {}
        for t, c, z, p in found[i]:
            n = len(t.split())
            if not c and z >= best:
                prose[len(own)] = p
                own.append((t, range(at, at + n)))
            at += n
        gone = set()
        for least in (2,) if best else (1, 2):
            run = {k for k, (_, r) in enumerate(own) if sum(hit(j, least) for j in r) >= html.COVER * len(r)}
            held = {k for k, (t, _) in enumerate(own) if not best and least == 1 and sum(t in texts for texts in others.values()) > 1}
            words = sum(len(r) if k in held else sum(hit(j, least) for j in r) for k, (_, r) in enumerate(own))
            if words < html.COVER * sum(len(r) for _, r in own):
                core = {k for k, (_, r) in enumerate(own) if k not in run | held and len(r) >= html.RUN}
                core = set(range(min(core), max(core) + 1)) if core else core
                while more := {k for k in range(len(own)) if prose[k] and k not in core and {k - 1, k + 1} & core}:
                    core |= more
                gone = run | (held - core)
                break
        out[i] = ("\n".join(t for k, (t, _) in enumerate(own) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("lot", [1024, 9])
def test_extract_equals_brute_force_on_mixed_hosts(spark, monkeypatch, lot):
    monkeypatch.setattr(html, "LOT_PAGES", lot)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(n))
    rows = []
    for h in range(6):
        menu, foot, quote = say(7), say(9), say(30)
        for k in range((2, 3, 12, 40, 27, 1)[h]):
            main = f"<p>{say(25)}</p><p>{quote if k % 4 == 0 else say(12)}</p><p>{say(3)}</p>"
            body = f"<article>{main}</article>" if h == 4 else f"<div>{main}</div>"
            rows.append((f"https://u@Host{h}.example:80/{k}", f"<div>{menu}</div><nav>{menu} x</nav>{body}<div class='ad'>{foot}</div><div>{foot}</div>"))
        rows.append(rows[-1])  # a copy
    rows += [("//host2.example/rel", rows[8][1]), ("http://[::1]/", rows[0][1]), (None, rows[0][1]), ("http://host0.example", None)]
    data = [(i // 2, u, x, "clash", 1, 2) for i, (u, x) in enumerate(rows)]
    got = html.extract(spark.createDataFrame(data, "page_id long, url string, html string, host string, lots int, salt int")).collect()
    from urllib.parse import urlsplit

    hosts = [(urlsplit(u or "").hostname or "").lower() if "[" not in (u or "") else "[::1]" for u, _ in rows]
    want = brute_extract({i: (hosts[i], x) for i, (_, x) in enumerate(rows)})
    key = lambda i: (i // 2, rows[i][0] or "", *want[i])
    assert sorted((r["page_id"], r["url"] or "", r["text"], r["n_removed"]) for r in got) == sorted(map(key, want))
    assert sum(r["n_removed"] for r in got) > 100


def test_extract(spark):
    frame = "<div>Home News Sport Weather today</div><p>unique {0} words that stand alone {0}</p><div>All rights reserved by the one owner</div>"
    rows = [(i, f"http://plain.example/{i}", frame.format(i)) for i in range(12)] + [(100, "http://a.example/", PAGE), (101, None, None), (102, "::bad", ""), (103, "http://a.example/", PAGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i]["text"] == f"unique {i} words that stand alone {i}"
    for i in (100, 103):
        assert got[i]["text"] == "A title <b>\nFish & chips\nTwo words, joined\none\ntwo" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[101]["text"] == got[102]["text"] == "" and got[101]["url"] is None
    assert html.extract(df.where("page_id < 0")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_extract_keeps_articles_whole(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_extract_keeps_copies(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    page = lambda k, note="": f"<div>Home News Sport Weather today</div><p>{text(k)}</p><div>{note}</div>"
    rows = [(0, "http://two.example/a", page(0)), (1, "http://two.example/b", page(0))]
    # 4 exact and 4 near copies among 20 pages: the menu goes, the copied text stays
    rows += [(10 + k, f"http://m.example/{k}", page(max(k, 7) if k < 12 else 50, f"seen {k}" if 16 <= k else "")) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text(0) in got[i] for i in (0, 1))
    for k in range(20):
        assert got[10 + k].split("\n")[0] == text(max(k, 7) if k < 12 else 50)
    marked = '<article><h2 id="search">How to search</h2><p class="search">one</p><section id="related-work"><p>two</p></section><div id="menu">three</div><div class="share">four</div><p hidden>five</p></article>'
    assert html.page_blocks(marked)[0] == ["How to search", "one", "two", "three"]


def test_page_blocks_lose_nothing():
    """Quotes inside unquoted values and after values, formulas; comments and adverts by id."""
    assert html.page_blocks("<article><p title=it's>one</p><p>two</p><p title=\"q\">three don't</p></article>")[0] == ["one", "two", "three don't"]
    assert html.page_blocks('<article><p><a href="x"">link text</a> more</p></article>')[0] == ["link text more"]
    assert html.page_blocks("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>")[0] == ["so x=1"]
    for chrome in ('<section id="comments"><p>no</p></section>', '<div id="disqus_thread">no</div>', '<div class="comments-thread">no</div>', '<div class="adbox">no</div>'):
        assert html.page_blocks(f"<article><p>yes</p>{chrome}<p>and</p></article>")[0] == ["yes", "and"]


@pytest.mark.parametrize("piece", ["<b>x|</i>y", "<p>x|<dt></dt>", '<i class="ad">|</i>', "<section>|<li></li>", "<header><article>|<h1>x</h1>", '<p a="|'])
def test_long_malformed_pages_take_linear_time(piece):
    import time

    def took(n):
        start = time.process_time()
        html.page_blocks("".join(x * n for x in piece.split("|")))
        return time.process_time() - start

    took(100)
    small, large = min(took(4000) for _ in range(3)), min(took(16000) for _ in range(3))
    assert large < 8 * small + 0.05


def test_repeats_decide_where_markup_says_nothing(spark):
    """The given pages with plain divs and no attributes: what recurs around the articles goes, the articles stay."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    bare = lambda x: re.sub(r"<(/?)(?:article|nav|aside|header|footer|main|section)\b", r"<\1div", re.sub(r"<([a-z][a-z0-9]*)\s[^<>]*>", r"<\1>", x or ""))
    rows = [(r["page_id"], r["url"], bare(r["html"])) for r in pages]
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    of_host, texts = {}, {}
    for i, url, x in rows:
        texts[i] = [t for t, *_ in html.all_blocks(x)]
        for t in set(texts[i]):
            of_host.setdefault((url.split("/")[2], t), set()).add(i)
    repeated = left = main = lost = 0
    for r in pages:
        i, want = r["page_id"], html.page_blocks(r["html"] or "")[0]
        around = Counter(texts[i]) - Counter(want)
        again = Counter({t: n for t, n in around.items() if len(of_host[r["url"].split("/")[2], t]) > 1})
        have = Counter(got[i])
        repeated += again.total()
        left += ((have - Counter(want)) & again).total()
        main += len(want)
        lost += (Counter(want) - have).total()
    assert repeated > 8000 and left <= 0.1 * repeated and lost <= 0.01 * main, (repeated, left, main, lost)


def test_extract_keeps_copied_articles(spark):
    rows = [(k, f"http://c.example/{k}", "<article><p>" + " ".join(f"w{i}" for i in range(60)) + f"</p><p>{'one' if k % 2 else 'two'}</p></article>") for k in range(12)]
    assert all("w59" in r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
