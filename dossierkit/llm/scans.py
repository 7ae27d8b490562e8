"""Problem 3: noise in text from scanned pages.

Skip-gram vectors (each word's accumulated random-index vectors of its
neighbours, centred) and counts are learnt over all texts. A rare word is linked
to every frequent word that differs from it by glyph confusions only, however
many: both are spelled out in elementary glyphs, and equal spellings join. At
each place of a linked word its neighbours decide: the form whose vector agrees
best with them, weighed with its frequency, is the correction, unless the word's
own vector, learnt from its other places, agrees better still. Running heads and
page numbers are found from the page structure of each text; then words broken
over lines are joined and the lines flow into paragraphs.

Defined cases: null and blank texts have no defects and come out as they are;
lines without a next line of text are not broken; a head must recur at least
once and is one printed line of at most ``HEAD`` letters; a line of a page's
number has at most ``NUMBER`` letters; words of one or two letters, and those of
three without a sign that no word has, are never linked; a text that looks like
a mail has heads only if its pages are numbered or parted; exact duplicate rows
count once; further columns are ignored. Vocabularies are only ever shuffled;
what reaches the workers whole is a Bloom filter sized by the number of misread
words up to a bound, and every word it lets through is checked by an exact join.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Dimensions of the vectors and words on each side that count as neighbours.
DIMENSIONS, REACH = 16, 2
#: A correction is so many times as frequent as the misread word, and occurs so often at least.
TIMES, LEAST = 12, 6
#: What a tenfold frequency weighs against the agreement of vectors, which is at most 1.
FREQUENCY = 0.125
#: Bits of the Bloom filter for each misread word, and the most bits (32 MB, broadcast once an executor).
BLOOM_BITS_A_WORD, MOST_BLOOM_BITS = 16, 1 << 28
#: Letters of a running head, and of a line with nothing but a page's number, at most.
HEAD, NUMBER = 160, 26

# Glyphs as printed and what recognition makes of them.
CONFUSIONS = {
    "e": ["c"], "c": ["e"], "t": ["†"], "a": ["á"], "n": ["ri"], "o": ["0"], "l": ["1", "|", "!"], "i": ["1", "|", "!"], "s": ["5"], "d": ["cl", "c1"], "u": ["ii"], "m": ["rn"], "g": ["9"],
    "f": ["ſ"], "h": ["b"], "b": ["6"], "w": ["vv"],
}
# Letters spelled out in elementary glyphs, so that words alike up to confusions are spelled alike.
ELEMENTS = {"n": "ri", "m": "rri", "d": "ci", "u": "ii", "w": "vv"}
SINGLE = ("e†á0l1|!59ſb6", "ctaoiiiisgfhh")

# an exclamation mark is a letter's glyph only before another letter
_TOKEN = re.compile(r"!?[\w†|]+(?:![\w†|]+)*")
_BREAK = re.compile(r"(?:(?<=\w)|(?<=\w!))([-­‐‑¬])[ \t]*$")
_SIGNS = frozenset("-­‐‑¬")
# begins with the signs, so that the search goes from sign to sign
_JOIN = re.compile(r"[-­‐‑¬](?:(?<=\w[-­‐‑¬])|(?<=\w![-­‐‑¬]))[ \t]*\r?\n\s*(?=!?\w)")
_LONE = re.compile(r"!(?![\w†|])")
# each sign is followed by a letter or ends the word: one way to match, so the time is in proportion to the length
_GLYPH = re.compile(r"[a-zà-ÿ†ſ]*(?:[|!0-9][a-zà-ÿ†ſ]+)*[|!0-9]?")
_PLAIN = re.compile(r"[a-zà-ÿ]")
_SIGN = re.compile(r"[†ſ|!01569]")
_NO_LETTER = re.compile(r"[†ſ|!0-9]")
_MEASURE = re.compile(r"\d+(?:st|nd|rd|th|er|ème|mg|ml|kg|km)|[a-z]{1,3}\d+|\w*\d{2,}")

_N = r"(?P<n>[\dlIO|]{1,6}|[ivxlc]{1,7})"
_NUMBERS = [
    ("bracket", re.compile(rf"\[\s*{_N}\s*\]$", re.IGNORECASE)),
    ("dash", re.compile(rf"[-–—]\s*{_N}\s*[-–—]$", re.IGNORECASE)),
    ("page", re.compile(rf"(?:page|seite|página|pag\.?|pg\.?|p\.|s\.)\s*{_N}(?:\s*(?:of|von|de|sur|/)\s*[\dlIO|]{{1,6}})?$", re.IGNORECASE)),
    ("slash", re.compile(rf"{_N}\s*/\s*[\dlIO|]{{1,6}}$")),
    ("bare", re.compile(r"(?P<n>[\dlIO|]{1,6})$")),
    ("roman", re.compile(r"(?P<n>[ivxlc]{1,7})$")),
]
_MAYBE_NUMBER = re.compile(r"\d|^[^\w]{0,2}[ivxlcIVXLCO|]{1,7}\W{0,2}$|(?:^|\s)[lIO|]{1,4}\W*$|[lIO|]\s*/|^\w+\.?\s*[lIO|]")
_HEAD_WORD = re.compile(r"[^\W\d_]{3,}")
_EDGE = frozenset("0123456789lI|")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_HEAD_NUMBER = re.compile(r"^(?P<a>[\dlI|]{1,4})\s{2,}(?P<x>\S.*)$|^(?P<y>.*\S)\s{2,}(?P<b>[\dlI|]{1,4})$")
_MAILISH = re.compile(
    r"(?m)^[\s>|:]*(?:From|Von|De|Sent|Subject|Betreff|Objet|Asunto):|^(?:>|\w{2,3}>)|\bwrote:|^-- ?\r?$|\A(?:Hi|Hello|Dear|Hallo|Bonjour|Hola)\b|\A[A-ZÀ-Þ][\w-]+(?:,| -)\r?$|"
    r"^(?:\w+ )?(?:regards|thanks|thx|cheers|sincerely|best|cordialement|saludos cordiales|mit freundlichen grüßen|yours)\b *[,.!]? *(?:\w+\.? *){0,2}\r?$|^\S.*\| \S+@\S+\r?$",
    re.IGNORECASE,
)


class _Parts(dict):
    """Whether a character parts words; blanks are left to ``split``."""

    def __missing__(self, c: str) -> bool:
        v = self[c] = not (c.isalnum() or c in "_†|!" or c.isspace())
        return v


_parts = _Parts()


def words_of(text: str) -> list[str]:
    """What ``_TOKEN`` finds in a text, in less time."""
    for c in filter(_parts.__getitem__, set(text)):
        text = text.replace(c, " ")
    if "!" in text:
        text = _LONE.sub(" ", text)
    return text.split()


def _value(n: str) -> int | None:
    if re.fullmatch(r"[ivxlc]+", n, re.IGNORECASE) and not re.fullmatch(r"l+", n):
        total, before = 0, 0
        for c in reversed(n.lower()):
            v = _ROMAN[c]
            total, before = (total - v, before) if v < before else (total + v, v)
        return total
    n = n.replace("l", "1").replace("I", "1").replace("|", "1").replace("O", "0")
    return int(n) if n.isdigit() else None


def _similar(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 0.75 * max(len(a), len(b)) or len(a) < 5:
        return False
    x, y = set(_HEAD_WORD.findall(a)), set(_HEAD_WORD.findall(b))
    if 4 * len(x & y) < min(len(x), len(y)):
        return False  # some words of a head are read right
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


class _Alike:
    """Lines by their words: finds the first of those added that is similar to another line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.same: dict[str, int] = {}
        self.by_word: dict[str, list[int]] = defaultdict(list)

    def add(self, line: str) -> None:
        k = len(self.lines)
        self.lines.append(line)
        self.same.setdefault(line, k)
        for w in set(_HEAD_WORD.findall(line)) or {""}:
            self.by_word[w].append(k)

    def find(self, line: str) -> int | None:
        if line in self.same:
            return self.same[line]
        if len(self.by_word) <= 8 and not any(w in line for w in self.by_word):
            return None  # no word in common
        seen: set[int] = set()
        for w in set(_HEAD_WORD.findall(line)) or {""}:
            seen.update(self.by_word.get(w, ()))
        return next((k for k in sorted(seen) if _similar(self.lines[k], line)), None)


def furniture(text: str) -> dict[int, str]:
    """Line index (from 0) of each running head and page number."""
    raw = text.split("\n")
    lines = [x.strip() for x in (text.replace("\f", " ").split("\n") if "\f" in text else raw)]
    full = [i for i, x in enumerate(lines) if x]
    if not full:
        return {}
    if "\f" not in text and not any(len(x) <= NUMBER and _MAYBE_NUMBER.search(x) for x in lines) and not any("  " in x and (x[0] in _EDGE or x[-1] in _EDGE) for x in lines):
        # nothing can number a page: only lines that recur, or the first and the last, can be heads
        seen = [" ".join(x.split()) if "  " in x or "\t" in x or not x.isascii() else x for x in text.lower().split("\n") if x]
        if len(set(seen)) == len(seen) and not (max(len(seen[0]), len(seen[-1])) <= HEAD and _similar(seen[0], seen[-1])):
            return {}
    rank = {i: k for k, i in enumerate(full)}
    feeds = {i for i, x in enumerate(raw) if "\f" in x}
    out: dict[int, str] = {}
    by_style: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i in full:
        if len(lines[i]) <= NUMBER and _MAYBE_NUMBER.search(lines[i]):
            for style, form in _NUMBERS:
                m = form.match(lines[i])
                v = _value(m["n"]) if m else None
                if v is not None and 0 < v < 1_000_000:
                    by_style[style].append((i, v))
                    break

    def edge(i: int) -> bool:
        return rank[i] in (0, len(full) - 1) or i in feeds or (rank[i] + 1 < len(full) and full[rank[i] + 1] in feeds)

    for style in ("bracket", "dash", "page", "slash"):
        for i, _ in by_style[style]:
            out[i] = "page_number"
    heads: dict[int, str] = {}
    numbered: set[int] = set()
    for i in full:
        x = lines[i]
        if i in out or not 4 <= len(x) <= HEAD:
            continue
        m = _HEAD_NUMBER.match(x) if "  " in x and (x[0] in _EDGE or x[-1] in _EDGE) else None
        if m:
            numbered.add(i)
            x = m["x"] or m["y"]
        if x[:4].isalpha() or sum(map(str.isalpha, x)) >= 4:
            heads[i] = x.lower()
    if not by_style and not feeds and not numbered:
        # no page shows: only lines that recur, or the first and the last, can seed a head
        seen = [" ".join(h.split()) for h in heads.values() if len(h) >= 4]
        first, last = heads.get(full[0], ""), heads.get(full[-1], "")
        if len(set(seen)) == len(seen) and not (len(first) >= 4 and len(last) >= 4 and _similar(" ".join(first.split()), " ".join(last.split()))):
            return {}
    mail: list[bool] = []

    def mailish() -> bool:  # looked for once, where it decides
        if not mail:
            mail.append(bool(_MAILISH.search(text)))
        return mail[0]

    for style in ("bare", "roman"):
        found = by_style[style]
        # the longest run of numbers that go up by one, in the order of the lines
        longest: dict[int, tuple[int, int]] = {}  # number -> (length of the run that ends with it, place)
        before: dict[int, int] = {}
        for k, (_, v) in enumerate(found):
            length, at = longest.get(v - 1, (0, -1))
            before[k] = at
            if length + 1 > longest.get(v, (0, -1))[0]:
                longest[v] = (length + 1, k)
        at = max(longest.values(), key=lambda x: (x[0], -x[1]), default=(0, -1))[1]
        best: list[tuple[int, int]] = []
        while at >= 0:
            best.append(found[at])
            at = before[at]
        best.reverse()
        if len(best) == 1 and not (edge(best[0][0]) and best[0][1] < 1000 and len(full) > 3):
            best = []
        if len(best) == 1 and mailish():
            best = []
        for i, _ in best:
            out[i] = "page_number"
            heads.pop(i, None)

    def by_page(i: int) -> bool:
        k = rank[i]
        return edge(i) or any(0 <= k + d < len(full) and out.get(full[k + d]) == "page_number" for d in (-1, 1)) or any(
            0 <= k + d < len(full) and full[k + d] in out and 0 <= k + 2 * d < len(full) and out.get(full[k + 2 * d]) == "page_number" for d in (-1, 1)
        )

    normal = {i: " ".join(h.split()) for i, h in heads.items() if len(h) >= 4}
    times = Counter(normal.values())
    pages = bool(out) or bool(feeds) or any(times[normal[i]] > 1 for i in numbered if i in normal)
    seeds = [i for i in normal if times[normal[i]] > 1 or i in numbered or by_page(i)]
    groups: list[list[int]] = []
    alike = _Alike()
    for i in seeds:
        k = alike.find(normal[i])
        if k is None:
            alike.add(normal[i])
            groups.append([i])
        else:
            groups[k].append(i)
    if not pages and (all(len(g) < 2 for g in groups) or mailish()):
        return out
    for g in groups:
        if len(g) < 2:
            continue
        placed = [i for i in g if by_page(i) or i in numbered]
        # a line that merely repeats in running text is no head: it stands at a page's edge, or alone
        if not (placed and (pages or not mailish() and len(full) > 10) or max(len(lines[i]) for i in g) <= 80 and g[-1] - g[0] >= 6 and not mailish()):
            continue
        for i in g:
            out[i] = "running_head"
    if any(k == "running_head" for k in out.values()):
        known = _Alike()
        for h in sorted({normal[i] for i, k in out.items() if k == "running_head" and i in normal}):
            known.add(h)
        for i in normal:
            if i not in out and known.find(normal[i]) is not None:
                out[i] = "running_head"
    return out


def broken_lines(text: str, skip: dict[int, str]) -> list[tuple[int, int]]:
    """(line, next line of text) of each line whose last word goes on there."""
    lines = (text.replace("\f", " ") if "\f" in text else text).split("\n")
    if not any(x.rstrip()[-1:] in _SIGNS for x in lines if x):
        return []
    lines = [x.rstrip() for x in lines]
    full = [i for i, x in enumerate(lines) if x and i not in skip]
    out = []
    for i, j in zip(full, full[1:], strict=False):
        if lines[i][-1] in _SIGNS and _BREAK.search(lines[i]):
            mark = re.match(r"\s*(?:(?:[A-Z]{2,3}>|[>|:])\s*)*", lines[j])
            head = lines[j][mark.end() :] if re.match(r"\s*(?:[A-Z]{2,3}>|[>|:])", lines[i]) else lines[j].lstrip()
            if head[:1].isalnum() or head[:1] in "†|" or (head[:1] == "!" and head[1:2].isalpha()):
                out.append((i, j))
    return out


def index_vectors(seeds: np.ndarray) -> np.ndarray:
    """The random index vector, of 1 and -1, of each seed; zeros for the seed 0."""
    bits = ((seeds[..., None] >> np.arange(DIMENSIONS, dtype=np.uint32)) & np.uint32(1)).astype(np.int8) * np.int8(2) - np.int8(1)
    bits[seeds == 0] = 0
    return bits


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and accumulated neighbour vectors of the words of each batch."""
    names = ["word", "n", *[f"v{i}" for i in range(DIMENSIONS)]]
    for batch in batches:
        ids: dict[str, int] = defaultdict(count(1).__next__)
        stream: list[int] = []
        for text in batch.column(0).to_pylist():
            stream.extend(map(ids.__getitem__, words_of(_JOIN.sub("", text).lower())))
            stream += [0] * REACH
        if not ids:
            continue
        t = np.array(stream, np.int32)
        words = list(ids)
        seeds = np.array([0, *[xxhash.xxh32_intdigest(w) for w in words]], np.uint32)
        bits = index_vectors(seeds)
        near = np.zeros((len(t), DIMENSIONS), np.int8)
        for d in range(1, REACH + 1):
            near[d:] += bits[t[:-d]]
            near[:-d] += bits[t[d:]]
        order = np.argsort(t, kind="stable")
        starts = np.searchsorted(t[order], np.arange(1, len(words) + 1))
        sums = np.add.reduceat(near[order], starts, axis=0, dtype=np.int32)
        n = np.bincount(t, minlength=len(words) + 1)[1:]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64)), *[pa.array(sums[:, i].astype(np.float32)) for i in range(DIMENSIONS)]], names)


def glyphs(word: Column) -> Column:
    """A word in elementary glyphs: equal for words that differ by glyph confusions only."""
    out = F.translate(word, *SINGLE)
    for letter, elements in ELEMENTS.items():
        out = F.replace(out, F.lit(letter), F.lit(elements))
    return out


@dataclass(frozen=True)
class Corrections:
    words: DataFrame  # word, n, own array<float>, forms array<struct<form, m, vector array<float>>>: all it can have been
    mean: tuple[float, ...]  # mean vector of all neighbours


def corrections(texts: DataFrame) -> Corrections:
    """The linked words of the corpus with the frequent words that each can have been."""
    vectors = [f"v{i}" for i in range(DIMENSIONS)]
    counted = texts.select("text").mapInArrow(_vocabulary, "word string, n long, " + ", ".join(f"{v} float" for v in vectors))
    vocabulary = materialise(counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(v).cast("float").alias(v) for v in vectors]), "scan-words")
    total = vocabulary.agg(F.sum("n").alias("n"), F.max("n").alias("top"), *[F.sum(v).alias(v) for v in vectors]).first()
    mean = tuple((total[v] or 0.0) / (total["n"] or 1) for v in vectors)
    signs = F.col("word").rlike("[†ſ|!0-9]")
    linkable = (signs & (F.length("word") >= 3) & F.col("word").rlike("[a-zà-ÿ†ſ].*[a-zà-ÿ†ſ]")) | (~signs & (F.length("word") >= 4))
    # rare: no word at all is so many times as frequent
    rare = vocabulary.where((F.col("n") * TIMES <= (total["top"] or 0)) & linkable)
    rare = rare.select("word", "n", F.array(*vectors).alias("own"), glyphs(F.col("word")).alias("g"))
    often = vocabulary.where((F.col("n") >= LEAST) & F.col("word").rlike(r"^[\p{L}&&[^ſ]]{2,}$"))
    often = often.select(F.col("word").alias("form"), F.col("n").alias("m"), F.array(*vectors).alias("vector"), glyphs(F.col("word")).alias("g"))
    pairs = rare.join(often, "g").where((F.col("word") != F.col("form")) & (F.col("m") >= F.col("n") * TIMES))
    linked = pairs.groupBy("word").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("form", "m", "vector"))).alias("forms"))
    return Corrections(linked, mean)


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float(x @ y) / (float(np.sqrt((x @ x) * (y @ y))) + 1e-9)


def form_here(word: str, n: int, own: np.ndarray, forms: list[tuple[str, int, np.ndarray]], near: np.ndarray, mean: np.ndarray) -> str | None:
    """What a linked word should be among the neighbours ``near`` (their index vectors, added up), None if it is right itself."""
    best, choice = -9.0, None
    at = near - mean
    for form, m, vector in forms:
        score = _cosine(at, vector - m * mean) + FREQUENCY * np.log(m)
        if score > best:
            best, choice = score, form
    # a word of several places may be one of its own; a sign that no word has never is
    if n >= LEAST and not _NO_LETTER.search(word) and _cosine(at, own - near - (n - 1) * mean) + FREQUENCY * np.log(n) > best:
        return None
    return choice


def _decide(mean: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(mean)
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for word, n, own, forms, near in zip(rows["word"], rows["n"], rows["own"], rows["forms"], rows["near"], strict=True):
                choices = [(f["form"], f["m"], np.array(f["vector"])) for f in forms]
                out.append(form_here(word, n, np.array(own), choices, np.frombuffer(near, np.int8).astype(float), centre))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACE), pa.array(out, pa.string())], [*_PLACE, "form"])

    return run


def _bloom_positions(word: Column, bits: int) -> list:
    h = F.xxhash64(word)
    return [F.pmod(h, F.lit(bits)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(bits)).cast("int")]


def misread_filter(words: DataFrame) -> bytes:
    """Bloom filter of the linked words; the driver sees only its cells, never the words."""
    want = BLOOM_BITS_A_WORD * max(words.count(), 64)
    bits = min(MOST_BLOOM_BITS, 1 << (want - 1).bit_length())
    at = words.select(F.explode(F.array(*_bloom_positions(F.col("word"), bits))).alias("at"))
    set_ = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63)))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(set_.alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out.tobytes()


def _in_filter(cells: np.ndarray, word: str) -> bool:
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    h = h - (1 << 64) if h >> 63 else h
    bits = 64 * len(cells)
    return all(int(cells[p >> 6]) >> (p & 63) & 1 for p in (h % bits, (h >> 24) % bits))


def line_words(text: str, skip: dict[int, str], breaks: list[tuple[int, int]], code) -> Iterator[tuple[int, str, int, list[str]]]:  # noqa: ANN001
    """(line, word, letters of it on this line, neighbours) of the words in the text lines that ``code`` gives a number.

    A broken word comes once, whole, with its first line. Each distinct word of
    the text is looked at once, and lines are gone through only if one is found.
    """
    lines = [x.replace("\f", " ").rstrip("\r").lower() for x in text.split("\n")]
    whole: dict[int, tuple[str, int]] = {}  # line -> the broken word that begins at its end, and its letters there
    for i, j in breaks:
        cut = _BREAK.sub("", lines[i])
        first, rest = _TOKEN.findall(cut), _TOKEN.search(lines[j])
        if first and rest:
            left = first[-1] + "!" * cut.endswith("!")
            whole[i] = left + rest[0], len(left)
    wanted = set(filter(code, {*words_of(text.lower()), *(w for w, _ in whole.values())}))
    if not wanted:
        return
    goes_on = {j for i, j in breaks if i in whole}
    stream: list[str] = []
    places: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        if i in skip:
            continue
        found = _TOKEN.findall(line)
        found = found[i in goes_on : len(found) - (i in whole)]
        stream += found
        places += [(i, len(w)) for w in found]
        if i in whole:
            stream.append(whole[i][0])
            places.append((i, whole[i][1]))
    for k, w in enumerate(stream):
        if w in wanted:
            yield places[k][0], w, places[k][1], [*stream[max(0, k - REACH) : k], *stream[k + 1 : k + 1 + REACH]]


def _looks_misread(word: str) -> bool:
    """Signs inside a word that no word has."""
    if len(word) < 4 or not _SIGN.search(word) or not _GLYPH.fullmatch(word) or len(_PLAIN.findall(word)) < 3:
        return False
    return len(_NO_LETTER.findall(word)) <= 3 and not _MEASURE.fullmatch(word)


_PLACE = ["name", "line_no", "next_no", "word", "here", "defect"]


def _page_rows(filter_cells):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(filter_cells.value, np.int64)

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > 500_000:
                    self.clear()
                k = self[word] = 2 if _looks_misread(word) else 1 if len(word) >= 3 and _in_filter(cells, word) else 0
                return k

        code = Codes().__getitem__
        nobody = [0] * (2 * REACH)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]

            def row(*values) -> None:  # noqa: ANN002
                for column, value in zip(rows, values, strict=True):  # noqa: B023
                    column.append(value)

            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                skip = furniture(text)
                breaks = broken_lines(text, skip)
                for i, kind in skip.items():
                    row(name, i + 1, None, None, None, kind, nobody)
                after = dict(breaks)
                for i, _ in breaks:
                    row(name, i + 1, None, None, None, "split_word", nobody)
                for i, word, here, near in line_words(text, skip, breaks, code):
                    seeds = [*map(xxhash.xxh32_intdigest, near), *nobody[len(near) :]]
                    row(name, i + 1, after[i] + 1 if here < len(word) else None, word, here, "misread" if code(word) == 2 else "maybe", seeds)
            near = index_vectors(np.array(rows.pop(), np.uint32).reshape(-1, 2 * REACH)).sum(axis=1, dtype=np.int8)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            packed = pa.Array.from_buffers(pa.binary(DIMENSIONS), len(near), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types, strict=True)), packed], [*_PLACE, "near"])

    return run


def _first_difference(word: Column, form: Column) -> Column:
    """Position, from 0, of the first letter in which a misread word and its correction differ."""
    n = F.least(F.length(word), F.length(form))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)) != F.substring(form, i, F.lit(1)))
    return F.coalesce(F.get(at, F.lit(0)) - 1, n)


def _scanned(artifact_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defect rows with words, corrections and the line on which each word begins, texts)."""
    texts = artifact_text.where(F.col("text").rlike(r"\S")).select("name", "text")
    found = corrections(texts)
    words = materialise(found.words, "scan-fixes")
    cells = texts.sparkSession.sparkContext.broadcast(misread_filter(words))
    kind = "name string, line_no long, next_no long, word string, here int, defect string, near binary"
    rows = materialise(texts.mapInArrow(_page_rows(cells), kind), "scan-rows")
    none = F.lit(None).cast("string")
    plain = rows.where("word IS NULL").select("name", "line_no", "defect", none.alias("word"), none.alias("form"), F.col("line_no").alias("starts"))
    tried = rows.where("word IS NOT NULL").join(words, "word", "left")
    # where there is nothing to choose, the neighbours decide nothing
    open_ = (F.size("forms") > 1) | ((F.col("n") >= LEAST) & ~F.col("word").rlike("[†ſ|!0-9]"))
    single = tried.where(F.col("forms").isNull() | ~open_).select(*_PLACE, F.col("forms")[0]["form"].alias("form"))
    kind = "name string, line_no long, next_no long, word string, here int, defect string, form string"
    chosen = tried.where(open_).select(*_PLACE, "near", "n", "own", "forms").mapInArrow(_decide(found.mean), kind)
    tried = single.unionByName(chosen).where(F.col("form").isNotNull() | (F.col("defect") == "misread"))
    # of a broken word, the line on which the wrong letter stands has the defect
    sign = F.regexp_instr("word", F.lit("[†ſ|!0-9]")) - 1
    at = F.when(F.col("form").isNotNull(), _first_difference(F.col("word"), F.col("form"))).otherwise(sign)
    line = F.when(F.col("next_no").isNotNull() & (at >= F.col("here")), F.col("next_no")).otherwise(F.col("line_no"))
    placed = tried.select("name", line.alias("line_no"), F.lit("misread").alias("defect"), "word", "form", F.col("line_no").alias("starts"))
    return plain.unionByName(placed), texts


def defects(artifact_text: DataFrame) -> DataFrame:
    """(name, line_no, defect) of every line with a defect of scanning."""
    return _scanned(artifact_text)[0].select("name", "line_no", "defect").distinct()


def _as_written(word: str, form: str) -> str:
    return form.upper() if word.isupper() and len(word) > 1 else form[:1].upper() + form[1:] if word[:1].isupper() else form


def repair(text: str, fixes: dict[tuple[int, str], str]) -> str:
    """Continuous paragraphs: furniture dropped, broken words joined, misread words corrected, lines flowing.

    ``fixes`` holds the correction of each misread word by the line, from 0, on which it begins.
    """
    skip = furniture(text)
    breaks = dict(broken_lines(text, skip))
    low = text.lower()
    lines = [x.replace("\f", " ").rstrip("\r") for x in text.split("\n")]
    lines_fixed = {i for i, _ in fixes}
    paragraphs: list[list[str]] = []
    now: list[str] = []  # the paragraph's words and joined pieces
    joined, gap, taken = False, False, False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        body = line.strip()
        if not body:
            gap = True
            continue
        # a blank line or an indent begins a paragraph, but not within a sentence that a page break cut
        fresh = (gap or line[:2].isspace()) and not joined and (not now or now[-1][-1:] in ".?!:;" or not body[0].islower())
        if now and fresh:
            paragraphs.append(now)
            now = []
        gap, glued, joined = False, joined, i in breaks
        rest = _TOKEN.search(body) if glued else None
        if taken and rest:
            body = body[rest.end() :]  # the corrected word stands whole on the line before
        start = 0 if taken or not rest else rest.end()
        taken = False
        if joined:
            sign = _BREAK.search(body)
            cut = _BREAK.sub("", body)
            left, right = list(_TOKEN.finditer(cut)), _TOKEN.findall(lines[breaks[i]].lower())[:1]
            # a compound keeps its hyphen if it has another, or stands unbroken elsewhere in the text
            compound = sign and sign[1] == "-" and (cut.rsplit(None, 1)[-1].count("-") > 0 or bool(left and right) and f"{left[-1][0].lower()}-{right[0]}" in low)
            form = fixes.get((i, cut[left[-1].start() :].lower() + right[0])) if left and right and not compound and left[-1].start() >= start else None
            if form:
                taken = True
                whole = cut[left[-1].start() :] + right[0]
                body = cut[: left[-1].start()] + _as_written(whole, form)
            else:
                body = body if compound else cut
        if i in lines_fixed:
            body = body[:start] + _TOKEN.sub(lambda m: _as_written(m[0], fixes.get((i, m[0].lower()), m[0])) if (i, m[0].lower()) in fixes else m[0], body[start:])  # noqa: B023
        now.append(body if glued or not now else " " + body)
    if now:
        paragraphs.append(now)
    return "\n\n".join(re.sub(r"\s+", " ", "".join(p)) for p in paragraphs)


def repaired(artifact_text: DataFrame) -> DataFrame:
    """(name, text) of every text, repaired."""
    rows, texts = _scanned(artifact_text)
    fixes = rows.where("form IS NOT NULL").groupBy("name").agg(F.collect_set(F.struct("starts", "word", "form")).alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [repair(t, {(f["starts"] - 1, f["word"]): f["form"] for f in x or []}) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["name", "text"])

    done = texts.join(fixes, "name", "left").select("name", "text", "fixes").mapInArrow(run, "name string, text string")
    return done.unionByName(artifact_text.where(F.col("text").isNull() | ~F.col("text").rlike(r"\S")).select("name", "text")).distinct()
