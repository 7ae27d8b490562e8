import random
from collections import Counter

from dossierkit.llm.tokens import VOCABULARY, encode, encoder
from dossierkit.llm.packing import PackRule, containers, pack


def _texts():
    rnd = random.Random(3)
    alphabet = ["word", " ", "  ", "\n", "\r\n", "'s", "n't", "é", "漢字", "12", ".", "<|endoftext|>", " ", "²", "ﬁ", "🙂", "a b", "x" * 50]
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 3000))) for _ in range(60)]
    return [*out, "", None, " ", "漢" * 9000, " " * 9000, "it's " * 4000, "a " * 9000, out[0], out[0] + "tail"]


def test_ids_agree_with_direct_encoding(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, seq int")
    enc = encoder(VOCABULARY).encode_ordinary
    got = {r["doc_id"]: r["ids"] for r in encode(df.union(df)).collect()}
    assert got == {i: enc(t) if t else [] for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in encode(df, counts_only=True).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert encode(df.limit(0)).count() == 0


def test_counts_shuffle_no_text(spark):
    """A long text given twice is counted as the tokenizer counts it, and what is shuffled for it holds no text and no join."""
    text = "some words and 漢字 " * 500
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (3, ""), (4, "one"), (4, "two"), (4, "two")], "doc_id long, text string")
    got = encode(df, counts_only=True)
    n = len(encoder(VOCABULARY).encode_ordinary(text))
    assert sorted(map(tuple, got.collect())) == [(1, n), (2, n), (3, 0), (4, 1), (4, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "piece" not in plan and "Join" not in plan


def test_pack_keeps_room_and_conflicts():
    rnd = random.Random(1)
    n = 3000
    sizes = sorted((rnd.randint(0, 2048) for _ in range(n)), reverse=True)
    sources = [rnd.choice(["hot", "hot", "a", "b", None]) for _ in range(n)]
    clusters = [rnd.choice([None, 1, 2, rnd.randint(3, 9000)]) for _ in range(n)]
    used, held, of_source = {}, {}, {}
    few = [x if x in ("hot", None) else f"{x}{i % 700}" for i, x in enumerate(sources)]
    for s, x, c, b in zip(sizes, few, clusters, pack(sizes, few, clusters, PackRule())):
        used[b] = used.get(b, 0) + s
        if s:
            assert c is None or c not in held.setdefault(b, set())
            assert x in ("hot", None) or x not in of_source.setdefault(b, set())
            held.setdefault(b, set()).add(c)
            of_source.setdefault(b, set()).add(x)
    assert max(used.values()) <= 2048
    even = pack([100] * 400, ["hot"] * 400, [None] * 400, PackRule())
    assert max(Counter(even).values()) <= 20 and max(even) + 1 <= 22  # a source of all items spreads evenly
    assert len(set(pack([10] * 50, [None] * 50, [7] * 50, PackRule()))) == 50


def test_near_duplicates_never_share_a_container(spark):
    rnd = random.Random(2)
    rows = []
    for g in range(6):
        words = [f"g{g}w{rnd.randrange(500)}" for _ in range(80)]
        rows += [(20 * g + v, " ".join([*words, f"ending{v}"]), None) for v in range(4)]
    rows += [(500 + i, f"short {i}", None) for i in range(5)] + [(600, "short 1", "s"), (601, None, "s"), (None, "x", "s")]
    got = containers(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    place = {r["doc_id"]: r["container"] for r in got}
    assert set(place) == {k for k, *_ in rows if k is not None}
    assert all(len({place[20 * g + v] for v in range(4)}) == 4 for g in range(6)) and place[501] != place[600]


def test_containers_hold_every_text_once(spark):
    rows = [(i, ("word " * (37 * i % 900)) or None, "s" if i % 3 else None, 0) for i in range(200)] + [(900, "big word " * 4000, "s", 0), (901, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, container int")
    got = containers(df.union(df)).collect()
    enc = encoder(VOCABULARY).encode_ordinary
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {i: len(enc(t)) if t else 0 for i, t, _, _ in rows}
    assert len({(r["doc_id"], r["part_no"]) for r in got}) == len(got)
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
    assert max(used.values()) <= 2048
    assert containers(df.limit(0)).count() == 0
