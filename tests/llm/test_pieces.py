import random

import numpy as np

from dossierkit.llm.pieces import PieceRule, pieces, split


def _spans(text, rule=None):
    return split(np.frombuffer(text.encode(), np.uint8), rule or PieceRule())


def _prose(seed, words):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["alpha", "beta.", "gäß", "delta\n\n", "eps\n", "zeta"]) for _ in range(words)).strip()


def test_limits_overlap_and_cover():
    rule = PieceRule()
    for seed in range(20):
        raw = _prose(seed, 3000).encode()
        spans = _spans(raw.decode())
        assert spans[0][0] == 0 and spans[-1][1] == len(raw)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b < d and b - c <= rule.overlap
        for a, b in spans:
            assert 0 < b - a <= rule.limit
            raw[a:b].decode()


def test_no_boundary_at_all():
    for text in ("x" * 10_000, "ß" * 5_000, "漢" * 4_000):
        spans = _spans(text)
        assert all(b - a <= 2048 for a, b in spans) and spans[-1][1] == len(text.encode())
        for a, b in spans:
            text.encode()[a:b].decode()


def test_edit_moves_only_neighbouring_cuts():
    text = _prose(7, 20_000)
    raw = text.encode()
    before = {b for _, b in _spans(text)}
    edited = (text[:30_000] + " inserted words " + text[30_000:]).encode()
    shift = len(edited) - len(raw)
    after = {b - shift for _, b in split(np.frombuffer(edited, np.uint8), PieceRule())}
    late = {b for b in before if b > 45_000}
    assert len(late & after) > 0.9 * len(late)


def test_frame(spark):
    rows = [("a", "short", 1), ("b", None, 1), ("c", "  \r\n ", 1), ("d", " " + "word " * 1000, 1), ("d", " " + "word " * 1000, 1), ("e", "", 2), (None, "y" * 3000, 2)]
    df = spark.createDataFrame(rows, "name string, text string, piece int")
    got = pieces(df, "name", "text").distinct().collect()
    assert {r["name"] for r in got if r["n_pieces"] > 1} == {"d", None}
    assert {r["name"] for r in got} == {"a", "d", None}
    first = next(r for r in got if r["name"] == "d" and r["piece_no"] == 0)
    assert first["start_byte"] == 1
    assert pieces(df.limit(0), "name", "text").count() == 0
