"""Texts are cleaned in small slices, and plain ASCII texts by cheaper rules with the same results."""

import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from marketloom.functions import textclean
from marketloom.operators import text as T

TEXTS = [
    "That is  this.\tthat\n\n\n\nThan From [+12 Chars] thatx xthat that", "  That​  thiſ \t fromé Éthat That 　\x85", "&lt;b&gt;The&amp;  end", "a < b", "a <i>b</i>", "", " \t ", "K K finaﬁ", "The The Thé",
    "x [+7chars] \t\t y [ + 1 chars]", None, " a b ", "\ta\t b \t", "THAT_that that-That 1that",
]


def old_normalize(t):
    t = textclean.clean(t or "")
    for p, by in ((r"[​-‏﻿]", ""), ("[ \t]+", " "), ("\n{3,}", "\n\n"), (r"(?ai)\[\+\d+[ \t\n\x0b\f\r]*chars\]", ""), (r"^\s+|\s+$", "")):
        t = re.sub(p, by, t)
    return t


def test_normalize_and_counts_as_before(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in df.select("i", T.normalize("t").alias("n")).collect():
        assert r.n == old_normalize(TEXTS[r.i]), TEXTS[r.i]
    for p in (r"\bthat\b", r"\bthis\b", r"\bfrom\b", "tion", r"\bthat", r"that\b"):
        got = df.select(T._count(F.col("t"), p).alias("n"), F.regexp_count("t", F.lit("(?iU)" + p)).alias("m")).collect()
        assert all(r.n == r.m for r in got), p
    for ps in ([r"\bthat\b", r"\bThis\b"], [r"\bthe\b", r"\bthé\b", "tion", r"\bk\b"], [r"\bthat\b", r"\bthat\b"], [r"\bthat xthat\b", r"\bthat\b"]):
        before = sum((F.regexp_count("t", F.lit("(?iU)" + p)) for p in ps), F.lit(0))
        got = df.where("t IS NOT NULL").select(T.topic_hits("t", {"x": ps})[0]["hits"].alias("n"), before.alias("m")).collect()
        assert all(r.n == r.m for r in got), ps
    assert len(T._plain([r"\bthat\b", r"\bthis\b"])) == 1  # one pass over a text
    words = df.select(T.capitalised_words("t").alias("a"), F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?U)\b[A-Z][a-z]+\b"), F.lit(0))).alias("b"))
    assert all(r.a == r.b for r in words.collect())


def test_cleaning_holds_a_slice():
    """Never the cleaned texts of a whole batch."""
    texts = ["<p>é</p>"] * 1000 + [None]
    out = list(textclean.cleaned(iter([pa.array(texts)])))
    assert max(map(len, out)) <= textclean.SLICE
    assert [t for a in out for t in a.to_pylist()] == [" é "] * 1000 + [None]


def test_stable_characters_stay_as_they_are():
    """Every character that does not send a text to Python is kept by NFKC, alone and in any company."""
    stable = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not re.search(textclean.MAY_CHANGE, chr(c))]
    assert len(stable) > 30_000 and {"\u00e9", "\u00df", "\u0159", "\u0436", "\u4e2d", "\ud55c"} <= set(stable)
    # Marks and the vowels and finals of Hangul are all that can join a letter before them.
    assert all(unicodedata.normalize("NFKC", c) == c and unicodedata.category(c)[0] != "M" and not unicodedata.combining(c) and not "\u1100" <= c <= "\u11ff" for c in stable)
    random.Random(3).shuffle(stable)
    assert textclean.clean("".join(stable)) == "".join(stable)


def test_only_texts_that_can_change_go_to_python(spark, monkeypatch):
    """Before, every text outside ASCII went to Python in batches of 10,000."""
    stay = ["caf\u00e9 na\u00efve \u00fcber stra\u00dfe \u00bfqu\u00e9?", "\u0416\u0438\u0437\u043d\u044c \u2014 \u4e2d\u6587 \ud55c\uad6d\uc5b4", "plain > text;", "", None, "\u00e9" * 70_000]
    go = ["\ufb01ne", "e\u0301", "a\u00a0b", "caf\u00e9 &amp;", "<b>\u00e9</b>", "a & b", "\u1112\u1161", "\U0001d400", "\U0001f600 \u00e9", "x\u0338", "\u212b", "\u2026", "\u0085\u200b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stay + go)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", textclean.unescape_nfkc(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else textclean.clean(t) for i, t in enumerate(stay + go)}
    monkeypatch.setattr(textclean, "_cleaned", lambda c: F.when(c.isNotNull(), F.lit("python")))
    sent = {r.i for r in df.select("i", textclean.unescape_nfkc(F.col("t")).alias("c")).where("c = 'python'").collect()}
    assert sent == set(range(len(stay), len(stay + go)))
