import itertools
import random

import pytest

from rillfold.llm import tokens as tk

RUNS = ["a" * 9000, "".join(random.Random(1).choices("abcdefgh", k=9001)), "中文字符" * 2500, " " * 9000, "=" * 7001, "é" * 5000, "'" + "s" * 6000, "\n" * 5000 + "x", "0123456789" * 800]


@pytest.fixture(scope="module")
def enc():
    return tk.encoder("byte_bpe_50k")


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_tree_equals_whole(name):
    e = tk.encoder(name)
    for leaf in (64, 257, 2048):
        for text in RUNS:
            assert tk.encode(e, f"ab {text} it's", leaf * 2) == e.encode_ordinary(f"ab {text} it's")


def test_join_at_every_place(enc):
    piece = ("internationalisation" * 3 + "aaaaaaabbbb").encode()
    whole = enc._encode_single_piece(piece)
    for k in range(len(piece) + 1):
        assert tk.join(enc, enc._encode_single_piece(piece[:k]) if k else [], enc._encode_single_piece(piece[k:]) if k < len(piece) else []) == whole


def test_parts_are_the_text_and_split_where_the_pattern_does(enc):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["a", "bc", " ", "  ", "\n", "\t", "1", "22", "'s", "'", "é", "中", "--", "\x1c", " ", "z" * 40], k=120))
        pieces = list(tk.parts(text, 25))
        assert "".join(p for p, _ in pieces) == text
        if all(n < 0 for _, n in pieces):
            assert [x for p, _ in pieces for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


BEFORE = ["\n\n", "\n\n\n\n", "a\n\n", "a\n\n\n\n", "a \n", "a\t\t", "a\r\n\r\n", "a  ", "a\x1c\n", "a\u3000\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_every_blank_around_every_long_run(name):
    """Tree and parts against the tokenizer, for all blanks before and after all kinds of long runs."""
    e = tk.encoder(name)
    blanks = ["", " ", "  ", "\n", "\n\n", "\n\n\n\n", " \n", "\n ", "\t\t ", "\r\n\r\n", "\u00a0\u00a0", "\u3000\n", "\x85\x85", "\x1c\x1d", "   \n\n  "]
    longs = ["A" * 100, "=" * 100, "7" * 100, "é" * 100, " " * 100, "\n" * 100, "漢" * 100, "ab" * 50, "'" * 100, "a\u0301" * 50, "🙂" * 100]
    for head, before, long, after, tail in itertools.product(["", "x", "5."], blanks, longs, blanks, ["", "y", "'s z"]):
        text = head + before + long + after + tail
        want = e.encode_ordinary(text)
        assert tk.encode(e, text, 64) == want, text
        ids = []
        for stretch, run in itertools.groupby(tk.parts(text, 40), key=lambda r: r[1]):
            level = [tk.encode(e, p, 64) if stretch < 0 else tk.encode_tree(e, p.encode(), 32) for p, _ in run]
            while stretch >= 0 and len(level) > 1:
                level = [tk.join(e, level[k], level[k + 1] if k + 1 < len(level) else []) for k in range(0, len(level), 2)]
            ids += itertools.chain.from_iterable(level)
        assert ids == want, text


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_blanks_before_a_long_stretch(name):
    e = tk.encoder(name)
    for before in BEFORE:
        for run in ("=" * 5000, "x" * 5000, "7" * 5000, " " * 5000, "=" * 5000 + "\n\n" + "x" * 5000):
            text = f"{before}{run}\n\nend"
            assert tk.encode(e, text) == e.encode_ordinary(text), (before, run[:1])
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(["a", " ", "\n", "\n\n", "\t", "'s", "\x1c", "=" * 40, "z" * 40, "7" * 40, " " * 40], k=40))
        assert tk.encode(e, text, 32) == e.encode_ordinary(text)


def test_parts_after_blanks(spark):
    texts = [f"{before}{run}\n\nend" for before in BEFORE for run in ("=" * 3000, "x" * 3000 + "\n\n" + "=" * 3000)]
    assert all("".join(p for p, _ in tk.parts(t, 1000)) == t for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = tk.encoder("byte_bpe_50k")
    got = {r.doc_id: r.ids for r in tk.token_ids(docs, unsplit=256, part_chars=1000).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_rows(spark, enc):
    texts = [None, "", " ", "plain words", "<|endoftext|> is text", "x" * 30000, *RUNS, "one two\n" * 4000, "plain words"]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for kw in ({}, {"unsplit": 256, "part_chars": 1000}):
        got = {r.doc_id: r.ids for r in tk.token_ids(docs, **kw).collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
        hinted = docs.selectExpr("*", "case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then length(text) else 0 end as n_chars")  # wrong lengths cost no exactness
        assert {r.doc_id: r.ids for r in tk.token_ids(hinted, **kw).collect()} == got
    assert tk.token_ids(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "y " * 3000), (1, "y " * 3000)], "doc_id bigint, text string")
    assert [r.ids for r in tk.token_ids(twice, part_chars=500).collect()] == [enc.encode_ordinary("y " * 3000)] * 2
