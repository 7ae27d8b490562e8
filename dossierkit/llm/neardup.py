"""Problem 1: near-duplicate records with small edits.

Order MinHash: each sketch of a record samples the few occurrence-labelled
k-mers of least hash and retains the order in which they stand in the text, so
that two sketches agree with a probability that falls with the edit distance.
Records that agree in enough sketches are candidates; each candidate pair is
verified by the exact likeness of its k-mer sets, and by the share of its common
k-mers that keep their order in a band of diagonals where a rule asks for it.
Records with many repeats are sketched by their distinct k-mers as well, since
likeness counts those, and records of few k-mers by two at a time as well, since
more would rarely all be common.

A sketch shared by more than ``HOT`` records (a letterhead, a disclaimer) is not
paired as it is: its records meet under each further sketch that they share, so
a pair still needs two agreeing sketches, nothing is dropped, and no task gets
the whole group. Where a rule asks for one agreeing sketch only, the records of
such sketches meet under the k-mers of their exact prefixes instead: with k-mers in one
order over all of them, rare ones first, two sets of a likeness over the
threshold have one in common among as many of the first as each may miss.

Exact copies (equal words, or equal normalised titles) collapse into classes
before anything is paired; classes are expanded again at the end.

Defined cases: null texts, null keys and texts with fewer than k tokens are like nothing;
exact duplicate rows count once; a class of at most ``EXPAND`` copies is expanded
into all its pairs, a larger one links each copy with the class's first key, and
its links with other classes go through that key, so no link is lost; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bloom
from ..session import materialise

#: Largest class of exact copies of which all pairs are listed.
EXPAND = 32
#: Records of one sketch beyond which they meet under two sketches.
HOT = 2000
#: Records up to so many k-mers (over the threshold) are sketched by two k-mers besides; those whose distinct k-mers are at most this share of all, by distinct ones.
FEW, REPEATS = 16, 0.9

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SPACE = re.compile(r"\s+")
#: Bytes of ASCII as words see them: letters small, digits, all else blank.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


@dataclass(frozen=True)
class LikenessRule:
    """How one field is compared: k-mers of words or characters, and the sketches that find the pairs."""

    unit: str  # word or char
    k: int
    threshold: float
    sampled: int  # k-mers of a sketch
    sketches: int
    agree: int  # sketches in which a candidate pair agrees, at least
    aligned: float = 0.0  # share of the shorter one's k-mers that are common and keep their order, at least


#: At the threshold itself a pair of records of many k-mers is a candidate with a probability of 0.9997 and 0.9972, above it more.
TEXT = LikenessRule("word", 3, 0.6, 3, 44, 2)
TITLE = LikenessRule("char", 3, 0.7, 5, 44, 2)


class _Parts(dict):
    """Whether a character parts words; blanks are left to ``split``."""

    def __missing__(self, c: str) -> bool:
        v = self[c] = not (c.isalnum() or c.isspace())
        return v


_parts = _Parts()


def words_of(text: str) -> list[str] | list[bytes]:
    """Runs of letters and digits of the text in small letters, as UTF-8 where all is ASCII: a pattern takes more time."""
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    text = text.lower()
    for c in filter(_parts.__getitem__, set(text)):
        text = text.replace(c, " ")
    return text.split()


def tokens(text: str, rule: LikenessRule, known: dict[str | bytes, int]) -> np.ndarray:
    """Token hashes of a text."""
    if rule.unit == "char":
        return np.frombuffer(_SPACE.sub(" ", text.strip().lower()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    words = words_of(text)
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def kmers(t: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers in text order."""
    n = len(t) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ t[i : i + n]) * _M1
        h ^= h >> np.uint64(29)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of the occurrence, so that repeats differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return h
    at = np.arange(len(h))
    rank = np.empty(len(h), np.uint64)
    rank[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return h ^ (rank * _M2)


@lru_cache(maxsize=16)
def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(h: np.ndarray, rule: LikenessRule, seed: int) -> np.ndarray:
    """One hash for each sketch of the labelled k-mers ``h``, which stand in text order."""
    factors = _factors(rule.sketches, seed)
    k = min(rule.sampled, len(h))
    m = h[None, :] * factors[:, None]
    m ^= m >> np.uint64(32)
    m *= _M3
    rows, least = np.arange(rule.sketches), np.empty((rule.sketches, k), np.int64)
    for i in range(k):
        least[:, i] = at = m.argmin(axis=1)
        m[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least.sort(axis=1)  # text order
    out = factors.copy()
    for i in range(k):
        out = (out ^ h[least[:, i]]) * _M1
        out ^= out >> np.uint64(29)
    return out


def sketches_of(h: np.ndarray, first: np.ndarray, rule: LikenessRule, seed: int) -> np.ndarray:
    """All sketches of a record's k-mers ``h``, of which those at ``first`` are the distinct ones."""
    out = [sketch(h if len(first) == len(h) else labelled(h), rule, seed)]
    if len(first) <= REPEATS * len(h):
        out.append(sketch(h[first], rule, seed))
    if 2 <= len(first) <= FEW / rule.threshold:
        out.append(sketch(h[first], replace(rule, sampled=2), seed + 1))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def compare(a: np.ndarray, b: np.ndarray, band: int = 64) -> tuple[float, float]:
    """(likeness, aligned share) of two k-mer sequences.

    The likeness is that of the sets. For the aligned share the common k-mers
    are put on their diagonals, which are gathered in bands; those of a band
    that keep their order are aligned, and a moved block aligns within a band of
    its own. The share is of the k-mers of the shorter sequence.
    """
    if not len(a) or not len(b):
        return 0.0, 0.0
    (x, i), (y, j) = np.unique(a, return_index=True), np.unique(b, return_index=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = y[at] == x
    both = int(common.sum())
    alike = both / (len(x) + len(y) - both)
    if not both:
        return alike, 0.0
    i, j = i[common], j[at[common]]
    lane = (i - j) // band
    order = np.lexsort((i, lane))
    lane, j = lane[order], j[order]
    backward = (lane[1:] == lane[:-1]) & (j[1:] < j[:-1])
    return alike, (both - int(backward.sum())) / min(len(x), len(y))


def _char_likeness(a: str, b: str, k: int) -> float:
    """Likeness of two short texts by their character k-mers; faster on short texts than arrays."""
    a, b = _SPACE.sub(" ", a.strip().lower()), _SPACE.sub(" ", b.strip().lower())
    x = {a[i : i + k] for i in range(len(a) - k + 1)}
    y = {b[i : i + k] for i in range(len(b) - k + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def _sketch_rows(rules: dict[str, LikenessRule]):
    names = ["field", "key", "class_hi", "class_lo", "size", "sketches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | bytes, int] = {}
        seen: set[tuple[str, bytes]] = set()  # classes of a field this task has sketched: copies need no second sketch
        for batch in batches:
            field, key, hi, lo, size, sketches = [], [], [], [], [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for f, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rule = rules[f]
                toks = tokens(t, rule, known)
                h = kmers(toks, rule.k)
                if not len(h):
                    continue
                raw = xxhash.xxh3_128_digest(toks.tobytes())
                digest = np.frombuffer(raw, np.int64)
                field.append(f)
                key.append(k)
                hi.append(int(digest[0]))
                lo.append(int(digest[1]))
                first = np.sort(np.unique(h, return_index=True)[1])
                size.append(len(first))
                sketches.append(np.empty(0, np.int64) if (f, raw) in seen else sketches_of(h, first, rule, xxhash.xxh32_intdigest(f)).view(np.int64))
                seen.add((f, raw))
            ends = np.cumsum([0, *map(len, sketches)])
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(field, pa.string()), pa.array(key, pa.string()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int32()), lists], names)

    return run


def _verify_rows(rules: dict[str, LikenessRule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | bytes, int] = {}
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for f, ka, kb, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rule = rules[f]
                if rule.unit == "char" and _char_likeness(ta, tb, rule.k) < rule.threshold - 1e-12:
                    continue
                x, aligned = compare(kmers(tokens(ta, rule, known), rule.k), kmers(tokens(tb, rule, known), rule.k))
                if x < rule.threshold - 1e-12 or aligned < rule.aligned:
                    continue
                for column, value in zip(rows, (f, ka, kb, x, aligned), strict=True):
                    column.append(value)
            types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["field", "rep_a", "rep_b", "likeness", "aligned"])

    return run


@dataclass(frozen=True)
class NearDuplicates:
    members: DataFrame  # field, key, rep, copies: the class of each record with k-mers
    pairs: DataFrame  # field, rep_a, rep_b, likeness, aligned: pairs of different classes


def _record(field: Column, key: Column) -> Column:
    return F.xxhash64(field, key)


def _hot_buckets(sketched: DataFrame) -> DataFrame | None:
    """(bucket) of the sketches that more than HOT records share; None if there are none.

    Sketches are counted in coarse cells first, so that nothing is shuffled but
    the cells and the few sketches in cells of more than HOT.
    """
    n = sketched.agg(F.sum(F.size("sketches"))).first()[0] or 0
    cells = 1 << max(14, min(24, (n // 1000).bit_length()))
    each = sketched.select(F.explode("sketches").alias("bucket")).withColumn("cell", F.pmod(F.xxhash64("bucket"), F.lit(cells)))
    full = each.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("cell")
    hot = materialise(each.join(full, "cell", "left_semi").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket"), "neardup-hot")
    return None if hot.isEmpty() else hot


def _texts_of(items: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rec, key, text) of about the ``n`` wanted records: a Bloom filter of bounded size holds the others back at the scan."""
    n_blocks = bloom.blocks_for(n)
    texts = items.withColumn("rec", _record(F.col("field"), F.col("key")))
    return bloom.probe(texts, "rec", bloom.build(wanted, "rec", n_blocks), n_blocks, "maybe").where("maybe").select("rec", "key", "text")


def _distinct_kmers(rules: dict[str, LikenessRule]):
    """(rec, size, kmers): the number of distinct k-mers with the field's number below it, and the k-mers."""
    number = {f: i for i, f in enumerate(sorted(rules))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | bytes, int] = {}
        for batch in batches:
            recs, size, sets = [], [], []
            for rec, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.unique(kmers(tokens(t, rules[f], known), rules[f].k))
                if len(h):
                    recs.append(rec)
                    size.append(len(h) * 16 + number[f])
                    sets.append(h.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array(size, pa.int32()), lists], ["rec", "size", "kmers"])

    return run


def _prefixes(rules: dict[str, LikenessRule], counts):  # noqa: ANN001, ANN202
    """The first k-mers of each record, rare ones first: so many that two records over the threshold have one in common."""
    thresholds = [rules[f].threshold for f in sorted(rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.frombuffer(counts.value, np.int64)
        for batch in batches:
            first = []
            for size, h in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = h.values.to_numpy()
                n = len(h) - int(np.ceil(thresholds[size & 15] * len(h) - 1e-9)) + 1
                first.append(h[np.lexsort((h, times[h & (len(times) - 1)]))[:n]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["rec", "size", "kmers"])

    return run


def _met_by_prefix(items: DataFrame, wanted: DataFrame, rules: dict[str, LikenessRule], least: Column) -> DataFrame:
    """(lo_a, lo_b, kind) of the ``wanted`` (rec, field) that can be alike: none that are is left out.

    Any one order of the k-mers is exact; how often they occur is counted in
    cells, so what is common to many records comes last and pairs few.
    """
    wanted = materialise(wanted, "neardup-hot-records")
    texts = _texts_of(items, wanted.select("rec"), wanted.count()).join(wanted, "rec").select("rec", "field", "text")
    sets = materialise(texts.mapInArrow(_distinct_kmers(rules), "rec long, size int, kmers array<long>").distinct(), "neardup-kmers")
    n = sets.agg(F.sum(F.size("kmers"))).first()[0] or 0
    cells = 1 << max(14, min(20, n.bit_length()))
    cell = sets.select(F.explode("kmers").alias("kmer")).groupBy(F.col("kmer").bitwiseAND(cells - 1).cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[cell.column(0).to_numpy()] = cell.column(1).to_numpy()
    counts = items.sparkSession.sparkContext.broadcast(counts.tobytes())
    first = sets.mapInArrow(_prefixes(rules, counts), "rec long, size int, kmers array<long>").select(F.explode("kmers").alias("bucket"), "rec", "size")
    first = first.repartition("bucket")
    return _met(first, first, ["bucket"], least).distinct()


def _met(a: DataFrame, b: DataFrame, on: list[str], least: Column) -> DataFrame:
    """(lo_a, lo_b, shared, kind, hot) of records that meet in a bucket and are of near size."""
    a, b = a.alias("a"), b.alias("b")
    n_a, n_b = F.shiftright("a.size", 4), F.shiftright("b.size", 4)
    kind = F.col("a.size").bitwiseAND(15)
    near_size = (n_a >= F.get(least, kind) * n_b) & (n_b >= F.get(least, kind) * n_a)  # else they can't be alike
    same = F.col("a.rec") < F.col("b.rec")
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & near_size).select(F.col("a.rec").alias("lo_a"), F.col("b.rec").alias("lo_b"), kind.alias("kind"))


def near_duplicates(items: DataFrame, rules: dict[str, LikenessRule]) -> NearDuplicates:
    """Classes of exact copies among ``items`` (field, key, text) and the like pairs between classes."""
    items = items.select("field", F.col("key").cast("string").alias("key"), "text").where(F.col("text").isNotNull() & F.col("key").isNotNull())
    kind = "field string, key string, class_hi long, class_lo long, size int, sketches array<long>"
    sketched = materialise(items.mapInArrow(_sketch_rows(rules), kind), "neardup-sketches")
    of_class = ["field", "class_hi", "class_lo"]
    slim = sketched.select("key", *of_class).distinct()
    classes = slim.groupBy(*of_class).agg(F.min("key").alias("rep"), F.count("*").alias("copies"))

    # One exchange by bucket serves both sides of the self-join; a class that several tasks
    # sketched leaves one row in a bucket. Buckets name a class by half of its hash: should two
    # classes meet in it, both are compared, so nothing is lost.
    fields = sorted(rules)
    if max(r.agree for r in rules.values()) > 2:
        raise ValueError("at most two sketches may be asked to agree")
    number = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    of = [F.col("class_lo").alias("rec"), (F.col("size") * 16 + number[F.col("field")]).alias("size")]
    buckets = sketched.select(F.explode("sketches").alias("bucket"), *of)
    least, agree = (F.array(*[F.lit(getattr(rules[f], x)) for f in fields]) for x in ("threshold", "agree"))
    hot = _hot_buckets(sketched)
    met_hot = by_prefix = None
    if hot is not None:
        by_one = [f for f in fields if rules[f].agree == 1]
        if by_one:
            held = sketched.where(F.col("field").isin(by_one)).select(*of_class, F.explode("sketches").alias("bucket")).join(hot, "bucket", "left_semi")
            held = classes.join(held.select(*of_class).distinct(), of_class, "left_semi").select(_record(F.col("field"), F.col("rep")).alias("rec"), "field").distinct()
            by_prefix = _met_by_prefix(items, held, rules, least)
        whole = sketched.where(~F.col("field").isin(by_one)).select(F.explode("sketches").alias("bucket"), *of, "sketches").join(hot, "bucket", "left_semi")
        two = whole.select("bucket", "rec", "size", F.explode("sketches").alias("other")).where(F.col("other") != F.col("bucket"))
        two = two.repartition("bucket", "other").dropDuplicates(["bucket", "other", "rec"])
        # two agreeing sketches at once: as many as these rules ask for
        met_hot = _met(two, two, ["bucket", "other"], least).select("lo_a", "lo_b").distinct()
        buckets = buckets.join(hot, "bucket", "left_anti")
    buckets = buckets.repartition("bucket").dropDuplicates(["bucket", "rec"])
    met = _met(buckets, buckets, ["bucket"], least).groupBy("lo_a", "lo_b").agg(F.count("*").alias("n"), F.first("kind").alias("kind"))
    met = met.where(F.col("n") >= F.get(agree, F.col("kind"))).select("lo_a", "lo_b")
    if met_hot is not None:
        met = met.unionByName(met_hot).distinct()
    named = classes.select("field", "class_lo", "rep")
    ends = [named.select(F.col("field").alias(f"f_{x}"), F.col("class_lo").alias(f"lo_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    candidates = met.join(ends[0], "lo_a").join(ends[1], "lo_b").where("f_a = f_b")
    candidates = candidates.select(F.col("f_a").alias("field"), *[_record(F.col("f_a"), F.col(f"rep_{x}")).alias(f"rec_{x}") for x in "ab"]).where("rec_a <> rec_b")
    if by_prefix is not None:
        name = F.array(*[F.lit(f) for f in fields])
        candidates = candidates.unionByName(by_prefix.select(F.get(name, F.col("kind")).alias("field"), F.col("lo_a").alias("rec_a"), F.col("lo_b").alias("rec_b")))
        candidates = candidates.select("field", F.least("rec_a", "rec_b").alias("rec_a"), F.greatest("rec_a", "rec_b").alias("rec_b")).distinct()
    candidates = materialise(candidates, "neardup-candidates")

    # Only the texts of candidates move.
    wanted = candidates.select(F.explode(F.array("rec_a", "rec_b")).alias("rec"))
    texts = _texts_of(items, wanted, 2 * candidates.count())
    left, right = texts.alias("l"), texts.alias("r")
    together = (
        candidates.join(left, F.col("rec_a") == F.col("l.rec"))
        .join(right, F.col("rec_b") == F.col("r.rec"))
        .select("field", F.least("l.key", "r.key").alias("ka"), F.greatest("l.key", "r.key").alias("kb"), F.when(F.col("l.key") < F.col("r.key"), F.col("l.text")).otherwise(F.col("r.text")).alias("ta"), F.when(F.col("l.key") < F.col("r.key"), F.col("r.text")).otherwise(F.col("l.text")).alias("tb"))
    )
    pairs = together.mapInArrow(_verify_rows(rules), "field string, rep_a string, rep_b string, likeness double, aligned double").distinct()

    members = slim.join(classes, of_class).select("field", "key", "rep", "copies")
    return NearDuplicates(members, pairs)


def clusters(found: NearDuplicates) -> DataFrame:
    """(field, rep, cluster): the connected classes, each named by its least; classes without links are left out.

    Labels fall to the least of the neighbours', then to their label's own, until
    none falls: rounds grow with the logarithm of a chain's length. Each round is
    written as a table, so a lost executor costs no more than its round.
    """
    links = found.pairs.select("field", F.col("rep_a").alias("rep"), F.col("rep_b").alias("near"))
    links = materialise(links.unionByName(links.select("field", F.col("near").alias("rep"), F.col("rep").alias("near"))).distinct(), "neardup-links")
    labels = links.groupBy("field", "rep").agg(F.least("rep", F.min("near")).alias("cluster"))
    while True:
        labels = materialise(labels, "neardup-labels")
        of = labels.select("field", F.col("rep").alias("near"), F.col("cluster").alias("of_near"))
        near = links.join(of, ["field", "near"]).groupBy("field", "rep").agg(F.min("of_near").alias("least"))
        jump = labels.select("field", F.col("rep").alias("cluster"), F.col("cluster").alias("jump"))
        fallen = labels.join(near, ["field", "rep"]).join(jump, ["field", "cluster"], "left")
        fallen = fallen.select("field", "rep", F.col("cluster").alias("was"), F.least("cluster", "least", F.coalesce("jump", "cluster")).alias("cluster"))
        fallen = materialise(fallen, "neardup-labels")
        if fallen.where("was <> cluster").isEmpty():
            return labels
        labels = fallen.drop("was")


def all_pairs(found: NearDuplicates) -> DataFrame:
    """(field, key_a, key_b) of like records, the classes expanded as the module's text says."""
    copied = found.members.where(F.col("copies") > 1)
    listed = copied.where(F.col("copies") <= EXPAND)
    x, y = listed.alias("x"), listed.alias("y")
    inside = x.join(y, (F.col("x.field") == F.col("y.field")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.key") < F.col("y.key"))).select("x.field", F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
    star = copied.where((F.col("copies") > EXPAND) & (F.col("key") != F.col("rep"))).select("field", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    stand_in = listed.select("field", "rep", "key")
    pairs = found.pairs.select("field", "rep_a", "rep_b")
    for side in ("a", "b"):
        of = stand_in.select("field", F.col("rep").alias(f"rep_{side}"), F.col("key").alias(f"key_{side}"))
        pairs = pairs.join(of, ["field", f"rep_{side}"], "left").withColumn(f"key_{side}", F.coalesce(f"key_{side}", f"rep_{side}"))
    between = pairs.select("field", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).where("key_a <> key_b")
    return inside.unionByName(star).unionByName(between).distinct()
