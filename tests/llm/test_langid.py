import random

import pytest

from rillfold.llm import langid as li
from rillfold.llm import prose

PATCH = """From 36731e2b118ed1d10b872eff434c2e09040f3563 Mon Sep 17 00:00:00 2001
From: Some One <some.one@lab.invalid>
Date: 06 Feb 2024 03:32:24 +0000
Subject: [PATCH v2] feat(x): Close the reader twice

Please look at `readRow` again,
it is never closed.

> Wir sollten das nicht tun.

Signed-off-by: Some One <some.one@lab.invalid>
---
 2 files changed

diff --git a/net/a.py b/net/a.py
--- a/net/a.py
+++ b/net/a.py
@@ -1,2 +1,3 @@ def reader
-    # Old words of a comment
+    # New words of a comment
+    # that goes on
 x = readRow()
+#!/bin/sh
diff --git a/b.bin b/b.bin
GIT binary patch
literal 5
# zcmWFz
--
2.47.5
"""


def test_blocks():
    assert prose.blocks(PATCH) == [("message", "Close the reader twice"), ("message", "Please look at `readRow` again, it is never closed."), ("quote", "Wir sollten das nicht tun."), ("comment", "Old words of a comment New words of a comment that goes on")]
    assert prose.blocks(PATCH.replace("\n", "\r\n")) == prose.blocks(PATCH)
    for text in (None, "", " \n\t"):
        assert prose.blocks(text) == []
    for subject in ("Merge branch 'x' into y", 'Revert "all of it"', "Bump a from 1.2 to 1.3", "chore(deps): update a to v2", "[ci skip] release 1.2.3", "Auto-generated: nightly sync 5 [skip ci]"):
        assert prose.blocks(f"{subject}\n\nmore words from the tool\n\ndiff --git a/x b/x\n+// people wrote this\n") == [("comment", "people wrote this")]
    assert prose.letters(prose.without_names("`a` fooBar foo_bar Foo.bar() src/a/b.c 12 me@x.org")) == 0


def test_bots_by_any_header_line():
    rest = "\n\nthese are words of a tool\n\ndiff --git a/x b/x\n+// people wrote this\n"
    long = "commit 0123456789\nMerge: " + "0123456 " * 100
    for head in (f"{long}\nAuthor: renovate[bot] <x@y.invalid>\nDate: 1\n\nNew words", "From: a-bot <x@y.invalid>\nSubject: New words", "Subject: New words\nFrom: a-bot <x@y.invalid>", f"Subject: New words\nCommit: {'x' * 700}\nFrom: a-bot <x@y.invalid>"):
        assert prose.blocks(head + rest) == [("comment", "people wrote this")]
    # What a message says of a bot doesn't make it a tool's.
    assert [k for k, _ in prose.blocks("Author: Some One <x@y.invalid>\n\nNew words\n\nsee Author: a-bot there" + rest)] == ["message", "message", "message", "comment"]


@pytest.fixture(scope="module")
def model():
    return li.train([])


def test_seeds_alone_tell_languages(model):
    held = {
        "en": "The reader waits until the other process has been stopped because there is no lock.", "de": "Der Leser wartet, bis der andere Prozess beendet ist, weil es keine Sperre gibt und wir sie nicht brauchen.",
        "ru": "Читатель ждёт, пока другой процесс не будет остановлен, потому что это было слишком медленно.", "uk": "Читач чекає, доки інший процес не буде зупинено, бо це було надто повільно.",
        "ja": "他の処理が終わるまで待ってください。", "zh": "请等待其他进程结束，因为它没有锁。", "fr": "Nous ne devons pas attendre que les autres fonctions soient fermées, car elles sont trop lentes.",
    }
    said, sure = model.predict(list(held.values()))
    assert said == list(held) and (sure > 0.5).all()


def test_held_out_accuracy():
    rng = random.Random(4)
    words = {x: [w for w in li.SEEDS[x].split() if w.isalpha()] for x in ("de", "en", "nl", "es", "fr", "it", "pt", "pl", "ru", "uk")}
    make = lambda x: " ".join(rng.choices(words[x], k=9)) + "."
    # A tenth of the labels is wrong.
    rows = [(i, x if rng.random() > 0.1 else rng.choice(list(words)), make(x)) for i, x in enumerate(sorted(words) * 40)]
    model = li.train(rows)
    test = [(x, make(x)) for x in sorted(words) for _ in range(20)]
    said, _ = model.predict([s for _, s in test])
    assert sum(a == b for a, (b, _) in zip(said, test)) / len(test) > 0.97


def test_rows(spark, model):
    en, de = li.SEEDS["en"], li.SEEDS["de"]
    docs = spark.createDataFrame(
        [(1, en, "en", 1), (2, en, "German", 1), (3, en, None, 1), (4, en, "??", 1), (5, f"{en}\n\n{de}", "en", 1), (6, None, "en", 1), (7, "", None, 1), (8, "fix ci", "de", 1), (9, " \n", None, 1), (2, en, "German", 1), (10, f"{de} " * 400, "de", 1)],
        "doc_id bigint, text string, lang string, languages int",
    )
    labels = spark.createDataFrame([("en", "en"), ("de", "German"), ("de", "de"), (None, "zz"), ("fr", None)], "lang_code string, label string")
    got = {tuple(r) for r in li.wrong_labels(docs, labels, model=model).collect()}
    assert got == {(2, "en"), (3, "en"), (4, "en"), (5, "en"), (5, "de")}
    parts = {r.doc_id: r.segments for r in li.detect(docs, labels, model=model).collect()}
    assert [s.language for s in parts[5]] == ["en", "de"] and all(0 <= s.confidence <= 1 for s in parts[5]) and parts[6] == []
    assert li.wrong_labels(docs.limit(0), labels).count() == 0
    assert {r.language for r in li.wrong_labels(docs, labels.limit(0), model=model).where("doc_id = 1").collect()} == {"en"}


def _said(*rows):
    """What `decide` makes of `(block, sentence, language, confidence)` rows."""
    found, segments = li.decide([(b, "message", s) for b, s, _, _ in rows], [x for _, _, x, _ in rows], [p for *_, p in rows])
    return set(found), [x for _, x, _, _ in segments]


def test_short_sentences_of_another_script_count():
    pt, en = (1, "Esta alteração acrescenta um teste para o analisador.", "pt", 0.99), (1, li.SEEDS["en"], "en", 0.99)
    assert _said((0, "简化日志的处理并消除 个警告", "zh", 1.0), pt) == ({"pt", "zh"}, ["zh", "pt"])
    assert _said((0, "ログを消す", "ja", 0.9), en) == ({"en", "ja"}, ["ja", "en"])
    assert _said((0, "Новый тест", "ru", 0.9), en) == ({"en", "ru"}, ["ru", "en"])
    assert _said((0, "修正了参数的错误顺序", "zh", 0.9), (1, li.SEEDS["ja"], "ja", 0.99)) == ({"ja", "zh"}, ["zh", "ja"])
    # One letter, a doubtful sentence, or a Latin name are no other language.
    assert _said((0, "𝔁", "zh", 0.9), en)[0] == _said((0, "简化日志的处理", "zh", 0.6), en)[0] == {"en"}
    assert _said((0, "endoftext", "nl", 1.0), (1, li.SEEDS["zh"], "zh", 0.99))[0] == {"zh"}


def test_short_chinese_subject(spark, model):
    pt = li.SEEDS["pt"]
    docs = spark.createDataFrame([(1, f"修正了参数的错误顺序。\n\n{pt}", "pt")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([("pt", "pt")], "lang_code string, label string")
    assert {r.language for r in li.wrong_labels(docs, labels, model=model).collect()} == {"pt", "zh"}


def test_families_from_a_table_and_a_model_kept(spark, tmp_path):
    rows = spark.createDataFrame([("de", "west"), ("en", "west"), ("ru", "east"), ("ru", "east"), (None, "east")], "lang_code string, family string")
    lang = li.Languages.read(rows)
    assert lang.all == ["de", "en", "ru"] and lang.pairs == [("de", "en")]
    model = li.train([], lang=lang)
    model.save(spark, str(tmp_path / "model"))
    again = li.Model.load(spark, str(tmp_path / "model"))
    some = ["Diese Funktion wurde nicht geprüft.", "This function was never checked.", "Эта функция не проверялась."]
    assert again.predict(some)[0] == model.predict(some)[0] == ["de", "en", "ru"] and again.languages == lang
    labels = spark.createDataFrame([("deutsch", "de"), ("suomi", "fi")], "label string, lang_code string")
    docs = spark.createDataFrame([(1, "x", "deutsch")], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="fi"):
        li.wrong_labels(docs, labels)
    with pytest.raises(ValueError, match="fi"):
        li.labelled_sample(docs, labels, 10)
