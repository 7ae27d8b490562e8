import random
import time

import numpy as np
from pyspark.sql import functions as F

from dossierkit.llm import scans
from dossierkit.llm.scans import broken_lines, defects, furniture, glyphs, repair, repaired

PAGE = (
    "Notes on Ralkin batch    1\nThe revenue was reviewed after the annual deli-\nvery of the container, and the\nwitness agreed with the\n\n- 1 -\n"
    "Notes on Ra1kin batch    2\n\nfindings of the mid-\nyear audit. 2658  6128\n7883\n\n   A second paragraph begins here -\nit ends soon.\n- 2 -"
)


def test_furniture_and_breaks():
    skip = furniture(PAGE)
    assert skip == {0: "running_head", 5: "page_number", 6: "running_head", 14: "page_number"}
    assert broken_lines(PAGE, skip) == [(1, 2), (8, 9)]
    assert furniture("") == {} and furniture("  \n ") == {}
    mail = "Hi Ann,\n\nSee below.\n\nBest,\nBob Bell\n\n> From: Ann\n> Best,\n> Bob Bell"
    assert furniture(mail) == {}
    assert furniture("One line\nmore text 711\nand more of it.") == {}


def test_words_alike_up_to_glyphs_are_spelled_alike(spark):
    pairs = [("eritirely", "entirely"), ("deliverecl", "delivered"), ("pa†ient5", "patients"), ("aga!nst", "against"), ("de!ivery", "delivery"), ("cornrnurn", "commum"), ("rninirnurn" * 9, "minimum" * 9)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(glyphs(F.col("a")) != glyphs(F.col("b"))).count() == 0


def test_long_words_take_no_time():
    began = time.time()
    for word in ("wirtschaftsprüfungsgesellschaft2003", "x" * 100_000 + "2003", "a1" * 50_000 + "é", "†ſ" * 50_000 + "00"):
        assert not scans._looks_misread(word)
    assert scans._looks_misread("wirtschaftsprüfungsgese1lschaft") and time.time() - began < 2


def test_pages_of_many_digits_and_long_heads():
    head = "Notes on the deposition of the former regional sales manager taken in the county court before the clerk of the court in person"
    page = "\n".join(f"{head} / {'copy' if p else 'C0py'}\n{'abcd'[p] * 9} was said on that day.\nNothing {'efgh'[p] * 9} was heard then.\n{10998 + p}" for p in range(4))
    skip = furniture(page)
    assert [skip[4 * p] for p in range(4)] == ["running_head"] * 4 and [skip[4 * p + 3] for p in range(4)] == ["page_number"] * 4 and len(skip) == 8


def test_first_and_last_line_alike_are_heads():
    words = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo", "lima", "mike", "oscar", "papa"]
    body = "\n".join(f"{w} went on with it for a while" if i % 2 else f"then {w} gave it up and left town" for i, w in enumerate(words))
    assert furniture(f"Notes on Ralkin batch two\n{body}\nN0tes on Ralkin bat(h tw0") == {0: "running_head", 13: "running_head"}


def _bears(n):
    rows = [(f"l{i}", "we could hear the witness speak in court today and they hear the judge speak in court") for i in range(n)]
    rows += [(f"b{i}", "a large brown bear slept near old trees and another brown bear slept near old trees") for i in range(n)]
    # "clerlc" is no slip of glyphs; "pear" and "fear" are other letters
    return rows + [("x", "they could hcar the witness speak\nand a large brown hcar slept near old trees")]


def test_neighbours_choose_among_forms(spark, monkeypatch):
    df = spark.createDataFrame(_bears(30), "name string, text string")
    assert repaired(df).where("name = 'x'").first()["text"] == "they could hear the witness speak and a large brown bear slept near old trees"
    monkeypatch.setattr(scans, "index_vectors", lambda seeds: np.zeros((*seeds.shape, scans.DIMENSIONS), np.int8))
    assert repaired(df).where("name = 'x'").first()["text"] != "they could hear the witness speak and a large brown bear slept near old trees"


def test_a_rare_word_of_its_own_stays(spark):
    rows = [(f"l{i}", "we could hear the witness speak in court today and they hear the judge speak in court") for i in range(120)]
    rows += [(f"b{i}", "a large brown bear slept near old trees") for i in range(8)]
    rows += [("z", "and they bear the judge speak in court")]
    df = spark.createDataFrame(rows, "name string, text string")
    assert {tuple(r) for r in defects(df).collect()} == {("z", 1, "misread")}


def test_repair():
    text = repair(PAGE, {(0, "rcview"): "review"})
    assert text == (
        "The revenue was reviewed after the annual delivery of the container, and the witness agreed with the findings of the midyear audit. 2658 6128 7883\n\n"
        "A second paragraph begins here - it ends soon."
    )
    assert repair("", {}) == ""
    assert repair("the year-end call and the year-\nend audit of a long-\nstanding, half-year-\nold re-\nport", {}) == "the year-end call and the year-end audit of a longstanding, half-year-old report"


def test_corpus(spark):
    clean = "the delivery of the container was entirely approved before the annual audit of the hospital records\n"
    rows = [(f"c{i}", clean * 3, 1) for i in range(20)]
    rows += [("bad", "the dclivery of the container\nwas eritirely approved be-\nf0re the annual aud-\nit of the hospital", 1), ("bad", "x", 2), ("none", None, 1), ("blank", " \n ", 1), ("typo", "the delivxry of the container", 1)]
    df = spark.createDataFrame(rows, "name string, text string, defect int")
    got = {tuple(r) for r in defects(df.union(df)).collect()}
    assert got == {("bad", 1, "misread"), ("bad", 2, "misread"), ("bad", 3, "misread"), ("bad", 2, "split_word"), ("bad", 3, "split_word")}
    text = {r["name"]: r["text"] for r in repaired(df).where("name <> 'bad'").collect()}
    assert text["none"] is None and text["blank"] == " \n " and text["typo"] == "the delivxry of the container"
    bad = [r["text"] for r in repaired(df).where("name = 'bad'").collect()]
    assert "the delivery of the container was entirely approved before the annual audit of the hospital" in bad
    assert defects(df.limit(0)).count() == 0


def test_exclamation_mark_for_i(spark):
    clean = "the witness spoke against the index of the patient records\n"
    rows = [(f"c{i}", clean * 3) for i in range(20)] + [("bad", "the witness spoke aga!nst it\nand the !ndex was\nof the pat!-\nent and aga-\n!nst it. Stop! Go on!")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = {tuple(r) for r in defects(df).collect()}
    assert got == {("bad", 1, "misread"), ("bad", 2, "misread"), ("bad", 3, "split_word"), ("bad", 3, "misread"), ("bad", 4, "split_word"), ("bad", 5, "misread")}
    text = repaired(df).where("name = 'bad'").first()["text"]
    assert text == "the witness spoke against it and the index was of the patient and against it. Stop! Go on!"


def test_words_are_those_of_the_pattern():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab1_†|!!! \n\f-.'áſ\xa0²­İΣ") for _ in range(300)) for _ in range(300)]
    assert all(scans.words_of(t) == scans._TOKEN.findall(t) for t in texts)


def test_a_mail_is_looked_for_only_where_it_decides(monkeypatch):
    """A text without pages and with no two lines alike has no heads, whether it looks like a mail or not."""
    looked = []

    class Pattern:
        def search(self, text):
            looked.append(text)

    monkeypatch.setattr(scans, "_MAILISH", Pattern())
    assert scans.furniture("Some first line here\nanother text below it\npart  3\nthe end of all\n") == {}
    assert not looked
