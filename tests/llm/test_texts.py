"""Operators on documents against plain versions and exact round trips."""

import os
import random
import re

import pytest

from lodestone.llm import bpe, chunking, leakage

VOCABULARY = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
TEXTS = ["Hello, world! don't  stop\n\n\n x", "", None, "ＷＩＤＥ 日本語のテキスト。次。", "a" * 5000, "   ", "\r\n\t mixed\r", "naïve café ½ ٣ ​ ﻿", "x_y=12345;" * 50, "😀😀 ok ퟿"]


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder()


@needs_vocabulary
def test_encoding_equals_plain_merging_and_decodes(coder):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(1)
    tokens = list(coder.ranks)
    for _ in range(3000):
        data = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4)))
        assert coder.encode_piece(data) == plain._encode_single_piece(data)
        if len(data) < 12:
            assert coder.encode_piece(data) == coder.merged(data)
    for _ in range(3000):
        t = "".join(r.choice([chr(r.randrange(1, 0x250)), r.choice(" 's\n\tab1_."), chr(r.randrange(0x3040, 0x30FF))]) for _ in range(r.randint(1, 12)))
        assert coder.encode(t) == plain.encode_ordinary(t) and coder.decode(coder.encode(t)) == t and coder.count(t) == len(coder.encode(t))


@needs_vocabulary
def test_ids_of_a_table(spark, coder):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'z' as lang")
    got = bpe.token_ids(df)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == sorted((i, tuple(coder.encode(t or ""))) for i, t in rows)
    assert {r.doc_id: r.text for r in bpe.decoded(got).collect()} == {i: t or "" for i, t in rows}
    assert bpe.token_ids(df.limit(0)).collect() == []


def item_words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def test_leaks_equal_a_plain_search(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}o" for i in range(300)] + ["the", "of", "Straße", "données"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 14, 30])))) for i in range(30)]
    docs = []
    for i in range(120):
        w = r.choices(vocabulary, k=r.randint(0, 80))
        if i % 2:
            source = r.choice(items)[1].split()
            n = r.choice([9, 11, 12, 13, 20])
            a = r.randrange(max(1, len(source) - n))
            part = source[a : a + n]
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part] if i % 3 else part
        docs.append((i, r.choice([" ", "\n", "_", " -- "]).join(w)))
    docs += [(500, None), (501, ""), (502, " ".join(["of"] * 20_000) + " " + items[1][1]), (0, docs[0][1])]
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items for w in [item_words(t)]}
    want = set()
    for d, t in docs:
        w = item_words(t)
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, g in grams.items() if g & have}
    found = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame([*items, (99, None)], "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.where("exact_words >= 12").collect()}
    assert got == want and len(want) > 10
    assert leakage.leaked_passages(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_small_edits_are_within_the_budget():
    item = "the quick parser refuses every third token when a hidden counter drops below nine and stops the worker at once"
    f = leakage.Passages([(1, item)])
    edited = item.replace("hidden", "hiden").replace("counter", "countter")
    assert [x[1] for x in f.search([leakage.plain("before it " + edited + " after")[:].encode()])] == [1]
    assert f.search([leakage.plain(" ".join(reversed(item.split()))).encode()]) == []


@needs_vocabulary
@pytest.mark.parametrize("limit,overlap", [(64, 8), (2048, 128)])
def test_pieces_keep_the_limit_and_the_text(coder, limit, overlap):
    r = random.Random(4)
    texts = ["\n".join("Line %d. It says: so, and more; \tthen ends." % i for i in range(limit)), "word " * (limit * 3), "x" * (limit * 40), "日本語。" * limit, "".join(r.choice("ab \n.") for _ in range(limit * 12)), "\n\n\n".join("Par %d" % i * 9 for i in range(limit)), "=-" * limit * 4]
    for t in texts:
        pieces = chunking.split_text(coder, t, limit, overlap)
        assert bool(pieces) == (coder.count(t) > limit)
        if not pieces:
            continue
        assert "".join(t[m:e] for _, m, e, _ in pieces) == t
        for k, (s, m, e, n) in enumerate(pieces):
            assert n == coder.count(t[s:e]) <= limit and s <= m < e
            assert k == 0 or s >= pieces[k - 1][0] and coder.count(t[s:m]) <= overlap + 2


@needs_vocabulary
def test_cuts_fall_on_lines_where_there_are_any(coder):
    t = "\n".join(f"step {i} of the long plan is to check {i * 7} items" for i in range(900))
    pieces = chunking.split_text(coder, t)
    assert len(pieces) > 3 and all(t[m - 1] == "\n" for _, m, _, _ in pieces[1:]) and all(90 <= coder.count(t[s:m]) <= 128 for s, m, _, _ in pieces[1:])


@needs_vocabulary
def test_documents_table(spark, coder):
    rows = [(1, "word " * 3000), (2, "short"), (3, None), (4, ""), (5, "é" * 3000), (1, "word " * 3000)]
    got = chunking.split_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece_no")).collect()
    assert {r.doc_id for r in got} == {d for d, t in rows if t and coder.count(t) > 2048}
    assert len([r for r in got if r.doc_id == 1 and r.piece_no == 1]) == 2


@needs_vocabulary
def test_padding_of_any_kind_is_split_in_linear_time(coder):
    import time

    for t in (" " * 200_000 + "x", "word " * 3000 + " " * 200_000 + "y", "." * 200_000 + "x ", "\n \t" * 60_000 + "x", "so it goes, " * 20_000):
        begun = time.time()
        pieces = chunking.split_text(coder, t)
        assert time.time() - begun < 10
        assert "".join(t[m:e] for _, m, e, _ in pieces) == t and all(n <= 2048 for *_, n in pieces)
        assert all(64 <= coder.count(t[s:m]) <= 130 for s, m, _, _ in pieces[1:])


def fewest(text, window):
    """Edits of the part of the text that is nearest to the window."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[-1] + 1))
    return min(row)


def test_edited_passages_equal_a_plain_search_for_short_and_long_words(monkeypatch):
    r = random.Random(8)
    short, long = list("abcdefghij"), ["parser", "token", "counter", "worker", "hidden", "drops", "ledger"]
    items = [(i, " ".join(r.choices(short if i % 3 == 0 else long, k=r.randint(12, 16)))) for i in range(9)]
    docs = []
    for i in range(60):
        t = list(r.choice(items)[1])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["z"], [t[k], "y"]])
        docs.append(leakage.plain(" ".join(r.choices(long, k=5)) + " " + "".join(t) + " " + " ".join(r.choices(short, k=5))))
    want = {}
    for d, t in enumerate(docs):
        for i, x in items:
            x = leakage.plain(x)
            n = min(fewest(t, x[a:b]) for a, b in leakage._windows(x, 12))
            if n <= 2:
                want[d, i] = n
    f = leakage.Passages(items)
    assert len(f.filters) > 1
    got = {(d, i): e for d, i, _, e in f.search([t.encode() for t in docs])}
    assert got == want and len(set(want.values())) == 3
    monkeypatch.setattr(leakage, "MOST_HITS", 50)
    assert {(d, i): e for d, i, _, e in leakage.Passages(items).search([t.encode() for t in docs])} == want
    one = [" ".join(docs).encode()]
    small = leakage.Passages(items).search(one)
    monkeypatch.setattr(leakage, "MOST_HITS", 1 << 22)
    assert small == leakage.Passages(items).search(one)
