import time

import numpy as np

from dossierkit.llm.emails import inherited_words, not_written, read_lines, unwritten_lines, written_text

BODY = "The review hospital and the lengthy revenue were carefully extended on the following Monday.\nA measurable discount in Daltree was submitted by the finance team last week."
REPLY = "We have looked at the figures for the second quarter and can't confirm any of them so far."


def test_marks_headers_signature_and_disclaimer():
    text = (
        "Hi Ann,\n\nThe plan is fine.\n> 62 mg doses stay on the old schedule.\nTo: everyone who asked, the answer is no.\n\nKind regards, BB\nBob Bell\n\n"
        "This message and any attachment may be privileged;\nplease destroy all copies.\n\nOn 3 May 2020 10:00, Ann Lee wrote:\n> Dear Bob,\n>\n> what plan?\n\nThis one, see the table."
    )
    gone = not_written(text)
    lines = text.split("\n")
    kept = [x for i, x in enumerate(lines, 1) if i not in gone and x]
    assert kept == ["Hi Ann,", "The plan is fine.", "> 62 mg doses stay on the old schedule.", "To: everyone who asked, the answer is no.", "This one, see the table."]
    assert not_written("") == [] and not_written("  \n\r\n") == []


def test_runs_must_keep_the_ancestors_order():
    at, doc = np.array([0, 5, 10, 30, 40]), np.array([1, 1, 1, 1, 2])
    covered = inherited_words(60, at, doc, np.array([0, 5, 10, 500, 3]))
    assert covered[:16].all() and not covered[16:].any()


def _frames(spark):
    texts = [
        ("a", "a.ocr", f"{BODY}\n\nBest,\nAnn", 1),
        ("b", "b.ocr", f"{REPLY}\n\n(earlier note below)\n{BODY.replace(' the ', chr(10) + 'the ')}", 1),
        ("c", "c.ocr", f"{REPLY.replace('second', 'third').replace('can', 'will')} It was sent to the office of the auditors in May.\n\n{BODY}", 1),
        ("d", "d.ocr", BODY, 1),
        ("e", "e.ocr", None, 1),
        ("m", "m.ocr", f"{BODY}\n\nBest,\nAnn", 1),
    ]
    meta = [(k, f"2020-01-0{i}T00:00:00Z" if k != "c" else None, "2020 January 20" if k == "c" else None, None if k == "m" else "t") for i, k in enumerate("abcdem", 1)]
    a = spark.createDataFrame(texts, "id string, name string, text string, at int")
    m = spark.createDataFrame(meta, "id string, ddmudate string, date_sent string, conversation string").selectExpr("*", "timestamp '2020-02-01' as ingested_at", "'x' as text")
    return a, m


def test_inherited_lines_of_a_conversation(spark):
    a, m = _frames(spark)
    got = {}
    for r in unwritten_lines(a.union(a), m.union(m)).collect():
        got.setdefault(r["name"], set()).add(r["line_no"])
    n = len(read_lines(a.where("name = 'b.ocr'").first()["text"]))
    assert got == {"a.ocr": {4, 5}, "b.ocr": set(range(3, n + 1)), "c.ocr": {3, 4}}
    text = {r["name"]: r["text"] for r in written_text(a, m).collect()}
    assert text["a.ocr"] == BODY and text["b.ocr"] == REPLY and set(text) == {"a.ocr", "b.ocr", "c.ocr", "d.ocr", "e.ocr"} and text["e.ocr"] is None
    assert unwritten_lines(a.limit(0), m).count() == 0


def test_unseen_introductions_are_learnt(spark):
    """Wordings that no list holds: told by what stands below them, and then known where the quoted message is missing."""
    facts = [f"{a} {b} reports that the {c} was moved to the {d} before the auditors could see any of it, which nobody had planned for" for a, b, c, d in
             [("Nearly", "everyone", "archive", "cellar"), ("Only", "Carver", "ledger", "attic"), ("Surely", "accounting", "printer", "garage"), ("Perhaps", "Golbeck", "pallet", "harbour"), ("Finally", "legal", "folder", "kitchen")]]
    rows, meta = [], []
    for i, f in enumerate(facts):
        rows += [(f"a{i}", f"a{i}.ocr", f), (f"b{i}", f"b{i}.ocr", f"{REPLY}\n\nHereunder the words of Person{chr(65 + i)} Smith of 1{i} May\n{f}")]
        meta += [(f"a{i}", "2020-01-01T00:00:00Z", f"t{i}"), (f"b{i}", "2020-01-02T00:00:00Z", f"t{i}")]
    lone = f"{REPLY}\n\nHereunder the words of Ann Smith of 7 June\nWe never got the figures of the harbour office."
    rows.append(("c", "c.ocr", lone))
    meta.append(("c", "2020-01-03T00:00:00Z", "other"))
    a = spark.createDataFrame(rows, "id string, name string, text string")
    m = spark.createDataFrame(meta, "id string, ddmudate string, conversation string").selectExpr("*", "cast(null as string) as date_sent", "timestamp '2020-02-01' as ingested_at")
    got = {}
    for r in unwritten_lines(a, m).collect():
        got.setdefault(r["name"], set()).add(r["line_no"])
    assert got == {**{f"b{i}.ocr": {3, 4} for i in range(5)}, "c.ocr": {3, 4}}


def test_equal_times_are_told_by_the_depth_of_quotes(spark):
    rows = [("a", "a.ocr", BODY), ("b", "b.ocr", f"{REPLY}\n\n" + "\n".join(f"> {x}" for x in BODY.split("\n"))), ("c", "c.ocr", f"Fine by me, as I told you on the phone this week.\n{BODY}\nAnd one more thing that I would like to say here.")]
    a = spark.createDataFrame(rows, "id string, name string, text string")
    m = spark.createDataFrame([(k, "t") for k in "abc"], "id string, conversation string").selectExpr("*", "cast(null as string) as ddmudate", "cast(null as string) as date_sent", "timestamp '2020-02-01' as ingested_at")
    got = {}
    for r in unwritten_lines(a, m).collect():
        got.setdefault(r["name"], set()).add(r["line_no"])
    assert "a.ocr" not in got and got["b.ocr"] == {3, 4}


def test_long_lines_take_no_time():
    began = time.time()
    for text in ("regards " + "a" * 50_000 + "!", "-" * 50_000 + "x", "1" + " " * 50_000 + "x", "Quoting (" + "1" * 50_000, "wrote " * 20_000 + ":x", "To: " + "Ann Lee, " * 9000 + "\nFrom: x\n\ntext"):
        not_written(text)
    assert time.time() - began < 5
    assert not_written("To: " + "Ann Lee, " * 200 + "\nFrom: Bob\n\nthe old text") == [1, 2, 4]
