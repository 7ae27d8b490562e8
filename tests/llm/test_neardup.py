import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import xxhash

from dossierkit.llm import neardup
from dossierkit.llm.neardup import TEXT, TITLE, NearDuplicates, all_pairs, clusters, compare, kmers, near_duplicates, tokens

WORD = re.compile(r"[^\W_]+")


def _sets(field, text):
    if field == "text":
        w = WORD.findall(text.lower())
        return set(zip(w, w[1:], w[2:]))
    t = re.sub(r"\s+", " ", text.strip().lower())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _brute(rows):
    out = set()
    for f, thr in (("text", 0.6), ("title", 0.7)):
        items = sorted({(k, t) for g, k, t in rows if g == f and t is not None and k is not None})
        for i, (a, s) in enumerate(items):
            for b, t in items[i + 1 :]:
                x, y = _sets(f, s), _sets(f, t)
                if a != b and x and y and len(x & y) / len(x | y) >= thr:
                    out.add((f, min(a, b), max(a, b)))
    return out


def _rows():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 20, 200]))]
        for v in range(5):
            copy = [w if rnd.random() > 0.03 * v else rnd.choice(words) for w in base]
            sep = rnd.choice([" ", "\r\n", ", "])
            rows.append(("text", f"{g}-{v}", sep.join(copy)))
            rows.append(("title", f"{g}-{v}", "  ".join(copy[:8]).upper()))
    rows += [("text", "n", None), ("text", "e", ""), ("text", "s", "one two"), ("title", "e", ""), ("title", "e2", " "), (("text"), None, "w1 w2 w3")]
    return rows + rows[:20]


def test_same_pairs_as_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "field string, key string, text string, rep int")
    found = near_duplicates(df, {"text": TEXT, "title": TITLE})
    got = {tuple(r) for r in all_pairs(found).collect()}
    want = _brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want)
    assert all_pairs(near_duplicates(df.limit(0), {"text": TEXT, "title": TITLE})).count() == 0


def test_large_class_is_a_star_and_keeps_its_links(spark):
    base = " ".join(f"x{i}" for i in range(50))
    rows = [("text", f"k{i:03d}", base) for i in range(60)] + [("text", "z", base + " extra words here")]
    df = spark.createDataFrame(rows, "field string, key string, text string")
    got = {tuple(r) for r in all_pairs(near_duplicates(df, {"text": TEXT})).collect()}
    assert got == {("text", "k000", f"k{i:03d}") for i in range(1, 60)} | {("text", "k000", "z")}


def test_alignment_follows_moved_blocks():
    known = {}
    a, b = [" ".join(f"{p}{i}" for i in range(300)) for p in "ab"]
    one = kmers(tokens(f"{a} {b}", TEXT, known), 3)
    two = kmers(tokens(f"{b} {a}", TEXT, known), 3)
    assert compare(one, two)[1] > 0.95
    assert compare(one, kmers(tokens("c d e f", TEXT, known), 3)) == (0, 0)


def test_fields_of_one_unit_keep_their_own_sketches(spark):
    base = " ".join(f"y{i}" for i in range(60))
    rows = [(f, f"{f}{v}", base + f" tail{v} of it") for f in ("a", "b") for v in range(2)] + [(f, f"{f}0c", base + " tail0 of it") for f in "ab"]
    found = all_pairs(near_duplicates(spark.createDataFrame(rows, "field string, key string, text string"), {"a": TEXT, "b": TEXT}))
    assert {tuple(r) for r in found.collect()} == {(f, x, y) for f in "ab" for x, y in ((f"{f}0", f"{f}0c"), (f"{f}0", f"{f}1"), (f"{f}0c", f"{f}1"))}


def test_hot_sketches_lose_nothing(spark, monkeypatch):
    """Records that share a letterhead meet under two sketches; the pairs are those found without a limit, and those of brute force."""
    rnd = random.Random(3)
    head = " ".join(f"h{i}" for i in range(25))
    rows = []
    for g in range(40):
        body = [f"g{g}w{rnd.randrange(60)}" for _ in range(50)]
        for v in range(3):
            rows.append(("text", f"{g}-{v}", head + " " + " ".join(w if rnd.random() > 0.04 * v else f"v{rnd.randrange(99)}" for w in body)))
    df = spark.createDataFrame(rows, "field string, key string, text string")
    whole = {tuple(r) for r in all_pairs(near_duplicates(df, {"text": TEXT})).collect()}
    monkeypatch.setattr(neardup, "HOT", 20)
    assert neardup._hot_buckets(spark.createDataFrame([([7, i],) for i in range(30)], "sketches array<long>")).collect()[0]["bucket"] == 7
    assert {tuple(r) for r in all_pairs(near_duplicates(df, {"text": TEXT})).collect()} == whole == _brute(rows)


def test_hot_sketches_of_rules_that_ask_for_one_lose_nothing(spark, monkeypatch):
    """Pairs whose only common sketch is hot: under a letterhead that few share otherwise, and in a group of which all are alike."""
    rnd = random.Random(5)
    head = " ".join(f"h{i}" for i in range(40))
    rows = [("text", f"a{g:02d}", " ".join([*[f"t{i}" for i in range(90)], f"end{g}", f"of{g}"])) for g in range(30)]
    for g in range(30):
        body = [f"g{g}w{rnd.randrange(60)}" for _ in range(30)]
        for v in range(2):
            rows.append(("text", f"b{g:02d}-{v}", " ".join([head, *body, *[f"v{rnd.randrange(99)}"] * v])))
    df = spark.createDataFrame(rows, "field string, key string, text string")
    want = _brute(rows)
    monkeypatch.setattr(neardup, "HOT", 5)
    rule = replace(TEXT, sketches=1, agree=1)
    sketched = [neardup.sketches_of(kmers(tokens(t, rule, {}), 3), np.arange(len(t.split()) - 2), rule, xxhash.xxh32_intdigest("text"))[0] for _, _, t in rows]
    hot = {k for (_, k, _), s in zip(rows, sketched, strict=True) if sketched.count(s) > 5}
    got = {tuple(r) for r in all_pairs(near_duplicates(df, {"text": rule})).collect()}
    assert got <= want and {p for p in want if {p[1], p[2]} <= hot} <= got and len(hot) > 20
    assert {tuple(r) for r in all_pairs(near_duplicates(df, {"text": replace(TEXT, agree=1), "title": TITLE})).collect()} == want


def test_repeats_and_few_kmers(spark):
    rows = [("text", "one", "a b c d e f g h"), ("text", "three", " ".join(["a b c d e f g h"] * 9))]
    rows += [("title", f"s{i}", t) for i, t in enumerate(("abcde", "abcdef", "abcdefg", "bcdefgh", "xyzabc", "xyzabcd"))]
    df = spark.createDataFrame(rows, "field string, key string, text string")
    rule = {"text": TEXT, "title": TITLE}
    assert {tuple(r) for r in all_pairs(near_duplicates(df, rule)).collect()} == _brute(rows)


def test_words_of_ascii_are_those_of_the_pattern():
    rnd = random.Random(6)
    for letters in ("aB1_ -\n\x1c\x00.'", "aB1_ é漢\xa0İ-"):
        for _ in range(100):
            text = "".join(rnd.choice(letters) for _ in range(80))
            assert tokens(text, TEXT, {}).tolist() == [xxhash.xxh3_64_intdigest(w) for w in WORD.findall(text.lower())]


def test_order_decides_where_a_rule_asks_for_it():
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 5] for i in range(0, 400, 5)]
    mixed = [w for b in random.Random(1).sample(blocks, len(blocks)) for w in b]
    texts = {"a": " ".join(words), "b": " ".join(mixed), "c": " ".join(words[:390])}
    pairs = pa.RecordBatch.from_pydict({"f": ["text"] * 2, "ka": ["a"] * 2, "kb": ["b", "c"], "ta": [texts["a"]] * 2, "tb": [texts["b"], texts["c"]]})
    loose = replace(TEXT, threshold=0.3)
    for rule, want in ((loose, ["b", "c"]), (replace(loose, aligned=0.7), ["c"])):
        assert next(neardup._verify_rows({"text": rule})(iter([pairs]))).column(2).to_pylist() == want


def test_clusters_are_what_pairs_connect(spark):
    rows = [("f", f"k{i:02d}", f"k{i + 1:02d}", 1.0, 1.0) for i in range(30)] + [("f", "x", "y", 1.0, 1.0), ("g", "k00", "x", 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "field string, rep_a string, rep_b string, likeness double, aligned double")
    got = {(r["field"], r["rep"]): r["cluster"] for r in clusters(NearDuplicates(pairs, pairs)).collect()}
    assert got == {**{("f", f"k{i:02d}"): "k00" for i in range(31)}, ("f", "x"): "x", ("f", "y"): "x", ("g", "k00"): "k00", ("g", "x"): "k00"}
    assert clusters(NearDuplicates(pairs, pairs.limit(0))).count() == 0
