import hashlib
import os
from collections import Counter

import public_tokenizers as tokens
import pytest

from groundwork.llm import alignment as al

RANKS, MODEL = (os.fspath(tokens.path(n)) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def byte_of():
    """Byte-level characters back to bytes: printable ones stand for themselves, the rest follow from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.fspath(tokens.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL), byte_of()


def brute(docs, libraries):
    """The libraries' tokens, every pair of ranges compared."""
    lib_a, lib_b, back = libraries
    rows, pairs = [], Counter()
    for doc_id, text in docs:
        want = (" " + (text or "")).encode()
        a, b = lib_a.encode(" " + (text or ""), add_special_tokens=False), lib_b.encode(text or "")
        bytes_a = [bytes(back[c] for c in lib_a.id_to_token(i)) for i in a.ids]
        bytes_b = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, parts in ((a.ids, bytes_a), (b, bytes_b)):
            end, own = 0, []
            for i, x in zip(ids, parts, strict=True):
                own.append((end, end + len(x), i))
                end += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
        pairs.update(links)
        groups, start = [], 0
        for end in sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}):
            groups.append("|".join(",".join(str(i) for s, e, i in own if start <= s and e <= end) for own in spans))
            start = end
        rows.append((doc_id, spans[0], spans[1], groups, links))
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in rows:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), digest))
    return sorted(out, key=str)


DOCS = [
    (1, "Hello world, the unbelievable internationalisation of 12345 naïve façades!"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "   three  spaces\tand\ttabs \n\n  lines\r\n end  "),
    (6, "日本語 のテキスト 🤖🤖 and émigré — ½ ﬁ Ａ"),
    (7, "<|endoftext|> and <s> </s> <unk> <0x41> ▁ marks ▁▁"),
    (8, "\x00 control \x01\x7f"),
    (9, "word " * 3000),
    (1, "Hello world, the unbelievable internationalisation of 12345 naïve façades!"),
    (None, "no id"),
    (10, "averyveryverylongwordwithoutanyspaces" * 40),
]


def test_alignment_equals_brute_force(spark, libraries):
    df, want = spark.createDataFrame(DOCS, "doc_id long, text string"), brute(DOCS, libraries)
    for table_rows in (al.TABLE_ROWS, 5):
        assert sorted(map(tuple, al.align(df, RANKS, MODEL, table_rows).collect()), key=str) == want
    none = [r for r in want if r[0] in (2, 3, 7)]
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in none) and sum(r[1] > 0 for r in want) >= 8


def test_alignment_equals_brute_force_on_given_tables(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2500").select("doc_id", "text")
    assert sorted(map(tuple, al.align(df, RANKS, MODEL).collect()), key=str) == brute([tuple(r) for r in df.collect()], libraries)


def test_windows_are_worked_out_once():
    work = al.Aligner(al.encoder(RANKS), al.pieces(MODEL))
    for _ in range(3):
        work.batch(*al.tokenised(work.enc, work.own, ["the same few words, the same few words"] * 20))
    assert work.worked_out == len(work.keys) < 12


def test_a_full_memo_starts_again(monkeypatch):
    monkeypatch.setattr(al, "_MEMO", 3)
    work = al.Aligner(al.encoder(RANKS), al.pieces(MODEL))
    lots = [["some words here", "other words there"], ["some more words", ""], ["some words here"]]
    texts = []
    for lot in lots:
        number, first = work.batch(*al.tokenised(work.enc, work.own, lot))
        text, size = work.part("text", number)
        cut = [0, *size.cumsum().tolist()]
        texts += [text.tobytes()[cut[a] : cut[b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert texts[0] == texts[4] and texts[3] == b"" and texts[0].endswith(b";")


def test_empty_table_clashing_columns_and_groups(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert al.align(df.limit(0), RANKS, MODEL).collect() == []
    wide = df.where("doc_id = 9").selectExpr("*", "1 as row", "2 as a", "'x' as n", "3 as links")
    assert al.align(wide, RANKS, MODEL).collect() == al.align(df.where("doc_id = 9"), RANKS, MODEL).collect()
    (row,) = al.aligned(df.where("doc_id = 10"), RANKS, MODEL, keep_groups=True).collect()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and sum(row["n"]) == row["n_links"]
