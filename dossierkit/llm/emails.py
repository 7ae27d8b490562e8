"""Problem 2: quoted history, signatures and disclaimers in emails.

A conversation bounds a thread; within it, who quotes whom comes from the texts.
Each message's words are cut into shingles of which a rolling window keeps the
least (so every stretch of some words holds one), and one aggregation over
(conversation, shingle) finds the message that had a shingle first: the earliest
by its time, and of several at one time (or of none) the one that quotes it
least deep. Within a message the shingles that an ancestor had are aligned with
it: runs that keep the ancestor's order are inherited spans. The lines right
above a span, whatever their wording, introduce it. How the lines above spans
are worded is counted over all messages, and wordings that mostly introduce are
taken for introductions where the quoted message itself is not in the corpus, as
are the headers of mail programs. Closing formulas, contact lines and
disclaimers end what the sender wrote.

Defined cases: null and blank texts have no lines to remove; a message all of
whose lines are inherited without any mark is a copy of its own, not a quote;
messages without a time come last; an introduction is of ``INTRO`` lines at most;
exact duplicate rows count once; further columns are ignored. A conversation is
never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bloom
from ..session import materialise

#: Lines of an introduction, at most.
INTRO = 6
#: A wording introduces if it stands above inherited spans so often at least, and in such a share of its places.
LEAST_ABOVE, SHARE_ABOVE = 3, 0.5
#: The time of messages that have none, in microseconds: after all others.
NO_TIME = 1 << 56
#: Words of a shingle, and shingles of a window of which one is kept.
SHINGLE, WINDOW = 6, 6

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[ \t]*(?:[A-Z]{2,3}>|>|[:|](?=[ \t>:|]|$))")

# What introduces, heads, closes and disclaims in the four languages.
_HEADER = re.compile(
    r"\s*\*?(?:From|Sent|Date|To|Cc|Bcc|Subject|Reply-To|Von|Gesendet|Datum|An|Betreff|Kopie|De|Envoyé|Date|À|A|Objet|Enviado|Enviado el|Fecha|Para|Asunto|CC|Importance)\s?:\*?(?:\s|$)",
    re.IGNORECASE,
)
_DIVIDER = re.compile(
    r"\s*[(\[]?[-=_*~ ]*+(?:begin forwarded message|forwarded message|original message|ursprüngliche nachricht|weitergeleitete nachricht|"
    r"anfang der weitergeleiteten nachricht|message d'origine|message d’origine|message transféré|message original|mensaje original|mensaje reenviado)\b",
    re.IGNORECASE,
)
_DIVIDER_SHAPE = re.compile(r"\s*[-=(*_\[].*[-=)*_:\]]\s*$|[^.?!]*:\s*$")
_INTRO_END = re.compile(r"\b(?:wrote|said|schrieb|a écrit|écrit|escribió|écrivait|writes)\b.*:\s*$", re.IGNORECASE)
_INTRO_START = re.compile(r"\s*(?:On|Am|Le|El)\s.*\d")
_INTRO_VERB = re.compile(r"\b(wrote|schrieb|écrit|escribió|said)\b")
_DATED = re.compile(r"\d|<")
_QUOTING = re.compile(r"\s*Quoting \((?=[^)]*\d)[^)]*+\).{0,120}:\s*$")
_CLOSING = re.compile(
    r"\s*(?:(?:kind|best|warm|many|with|warmest|kindest)\s+(?:thanks\s+and\s+)?regards|many thanks(?: and regards)?|regards|best wishes|best|sincerely(?: yours)?|yours(?: (?:sincerely|truly|faithfully|ever))?|cheers|thanks(?: again)?|thank you|thx|"
    r"respectfully|cordially|all the best|take care|mit (?:freundlichen|besten|herzlichen) gr(?:ü|ue)(?:ß|ss)en|(?:viele|beste|herzliche|liebe|freundliche) gr(?:ü|ue)(?:ß|ss)e|mfg|hochachtungsvoll|"
    r"(?:bien )?cordialement|bien à vous|salutations(?: distinguées)?|sincères salutations|amicalement|(?:un )?(?:cordial saludo|saludo)s?|saludos(?: cordiales)?|atentamente|cordialmente|un abrazo)"
    r"\s*[,.!]?\s*(?P<name>(?:[-–]\s*)?(?:[A-ZÀ-Ý][\w.'’-]*+(?:\s+|$)){0,4})$",
    re.IGNORECASE,
)
_SENT_FROM = re.compile(
    r"\s*(?:sent (?:from|via|using|on) (?:my|a|an|the)? ?(?:mobile|handheld|hand-held|phone|smartphone|tablet|iphone|ipad|android|blackberry|device|app)\b|von unterwegs gesendet|(?:gesendet )?von meinem \w+|"
    r"envoyé (?:de|depuis) mon|enviado desde mi|get (?:the|our) \w+ app|get outlook)[^.]*\.?\s*$",
    re.IGNORECASE,
)
_GREETING = re.compile(r"\s*(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|bonjour|bonsoir|salut|ch[eè]re?s?|hola|buen[oa]s (?:días|tardes|noches)|estimad[oa]s?|querid[oa]s?)\b", re.IGNORECASE)
_DASHES = re.compile(r"\s*--\s*$")
_RULE = re.compile(r"\s*([-=_*~#])\1{4,}\s*$")
_CARD = re.compile(r"\s*\*[^*|]+\*\s*\||.*\|\s*<?[\w.+-]+@[\w.-]+>?\s*$")
_PHONE = re.compile(r"\s*(?:(?:T|Tel|Tél|Phone|ph|M|Mobile|Fax|Office|Cell|Direct)\b[.:]?\s*)?[+(]?\d[\d\s().-]{7,}+(?:\|.*)?$", re.IGNORECASE)
_DISCLAIMER = re.compile(
    r"\s*\[?(?:this (?:message|e-?mail|communication|transmission)\b.*(?:privileg|confiden|exempt|intended)|this message and any attachment|this communication may|the contents of this e-?mail|the information (?:above|contained)|"
    r"notice:|confidentiality\b|confidential(?:ity)? notice|disclaimer\b|views expressed here|ce message est|ce courriel|diese (?:nachricht|e-?mail) ist|este (?:mensaje|correo) )",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Line:
    depth: int  # quote marks before the text
    body: str  # text behind the marks
    first: int  # number of the line's first word in the message
    words: int


def read_lines(text: str) -> list[Line]:
    """Lines of a message with their marks taken off; words are numbered through the bodies."""
    out, at = [], 0
    for raw in text.split("\n"):
        depth, pos = 0, 0
        raw = raw.rstrip("\r")
        while (m := _MARK.match(raw, pos)) and m.end() > pos:
            depth, pos = depth + 1, m.end()
        body = raw[pos:].strip()
        n = len(_WORD.findall(body))
        out.append(Line(depth, body, at, n))
        at += n
    return out


def shingles(lines: list[Line], salt: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of the shingles kept; the salt is the conversation's."""
    words = []
    for line in lines:
        for w in _WORD.findall(line.body.lower()):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            words.append(h)
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    t = np.array(words, np.uint64)
    h = np.full(n, salt, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if n <= WINDOW:
        keep = np.array([int(np.argmin(h))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        keep = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
    return keep, h[keep]


def inherited_words(n_words: int, at: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> np.ndarray:
    """Words covered by aligned runs: shingles found in one ancestor, in its order and about as far apart as there."""
    covered = np.zeros(n_words + 1, np.int32)
    start = last = None
    count = 0

    def close() -> None:
        if count >= 2:
            covered[at[start]] += 1
            covered[min(at[last] + SHINGLE, n_words)] -= 1

    for i in range(len(at)):
        joins = last is not None and source[i] == source[last] and 0 < source_at[i] - source_at[last] <= 60 and abs((source_at[i] - source_at[last]) - (at[i] - at[last])) <= 20
        if not joins:
            close()
            start, count = i, 0
        count += 1
        last = i
    close()
    return np.cumsum(covered[:-1]) > 0


def _intro(lines: list[Line], i: int) -> int:
    """Number of lines, from line i, of an introduction in a mail program's words to a quote that follows; 0 if there is none."""
    body = lines[i].body
    if _DIVIDER.match(body) and _DIVIDER_SHAPE.match(body):
        return 1
    if body.endswith(":") and (_INTRO_END.search(body) or _QUOTING.match(body)):
        return 1
    joined, quoting = body, body.startswith("Quoting (")
    for n in range(2, INTRO + 1):
        if i + n > len(lines) or not lines[i + n - 1].body or lines[i + n - 1].depth != lines[i].depth:
            break
        joined += " " + lines[i + n - 1].body
        if not joined.endswith(":"):
            continue
        if quoting and _QUOTING.match(joined):
            return n
        if (_INTRO_START.match(body) or _DATED.search(joined)) and _INTRO_VERB.search(joined) and _INTRO_END.search(joined):
            return n
    return 0


def _may_head(lines: list[Line], i: int) -> bool:
    """Whether a line has the shape of one that heads something: a divider, an ending colon, or words that are no sentence and no greeting, few or begun afresh."""
    line, body = lines[i], lines[i].body
    if not line.words or _GREETING.match(body) or _CLOSING.match(body) or _HEADER.match(body):
        return False
    return bool(_DIVIDER_SHAPE.match(body)) and line.words <= 16 or line.words <= (6 if i and lines[i - 1].body else 16) and body[-1] not in ".?!,;"


def wording(line: Line) -> int:
    """A line's wording without what differs from message to message: names, numbers and addresses."""
    kept = ["#" if any(map(str.isdigit, w)) or "@" in w else "N" if w[:1].isupper() and k else w.lower() for k, w in enumerate(re.findall(r"[^\s,.:;()<>\[\]=*_~-]+", line.body))]
    if kept and line.body.lstrip("(=-*[_~ ")[:1].isupper() and len(kept) > 1 and kept[1] == "N":
        kept[0] = "N"  # a name comes first
    ends = line.body[0] + line.body[-1]
    mark = "".join(c for c in ends if not c.isalnum())
    return xxhash.xxh3_64_intdigest(f"{mark} {' '.join(kept)}".encode()) >> 1


def headed(lines: list[Line], i: int, took: np.ndarray) -> bool | None:
    """Whether the lines below line i, at its own depth or deeper, begin with an inherited span; None if nothing is below."""
    n = len(lines)
    j = i + 1
    while j < n and not lines[j].body:
        j += 1
    if j >= n:
        return None
    if lines[j].depth < lines[i].depth:
        return False
    for _ in range(2):  # a greeting may come first
        k = j
        while k < n and lines[k].body and lines[k].depth == lines[j].depth:
            k += 1
        long = [x for x in range(j, k) if lines[x].words >= 3]
        if long and not (len(long) == 1 and _GREETING.match(lines[long[0]].body)):
            return sum(map(bool, took[long])) * 2 >= len(long)
        while k < n and not lines[k].body:
            k += 1
        if k >= n:
            return False
        j = k
    return False


def heads(lines: list[Line], inherited: np.ndarray | None) -> list[tuple[int, int, bool]]:
    """(line, wording, whether an inherited span is below) of the unmarked lines that may introduce something."""
    took = _taken(lines, inherited)
    out = []
    for i, line in enumerate(lines):
        if line.body and not line.depth and not took[i] and _may_head(lines, i):
            below = headed(lines, i, took)
            if below is not None:
                out.append((i, wording(line), below))
    return out


def _taken(lines: list[Line], inherited: np.ndarray | None) -> np.ndarray:
    """Lines at least half of whose words lie in inherited spans."""
    took = np.zeros(len(lines), bool)
    if inherited is not None:
        for i, line in enumerate(lines):
            if line.words and line.first + line.words <= len(inherited):
                took[i] = inherited[line.first : line.first + line.words].mean() >= 0.5
    return took


def _header(lines: list[Line], i: int) -> int:
    """Number of lines, from line i, of a header block; 0 if there is none."""
    n = i
    hits = 0
    while n < len(lines) and lines[n].depth == lines[i].depth and lines[n].body:
        if _HEADER.match(lines[n].body):
            hits += 1
        elif hits == 0 or len(lines[n].body) > 100 or n - i > 8 or not _HEADER.match(lines[n - 1].body):
            break  # a long field may run over one more line
        n += 1
    return n - i if hits >= 2 else 0


def not_written(text: str, inherited: np.ndarray | None = None, introduces: set[int] | None = None) -> list[int]:
    """Numbers, from 1, of the lines that the sender did not newly write.

    ``introduces`` holds the lines, from 0, whose wording introduces elsewhere.
    """
    lines = read_lines(text)
    n = len(lines)
    took = _taken(lines, inherited)
    above = {i for i, _, below in heads(lines, inherited) if below} | (introduces or set())

    blank = [not ln.body and not ln.depth for ln in lines]
    marked = [ln.depth > 0 for ln in lines]
    # a mark that stands alone before a number, or in a table, is the sender's own
    for i in range(n):
        if marked[i] and not took[i]:
            alone = not (i and marked[i - 1]) and not (i + 1 < n and marked[i + 1])
            if alone and (re.match(r"\d", lines[i].body) or lines[i].body.endswith("|")):
                marked[i] = False

    # what a mail program broke off a marked line stands without its mark, with no blank line between
    for i in range(1, n):
        if not marked[i] and not blank[i] and marked[i - 1] and lines[i - 1].body and lines[i].words <= 4:
            marked[i] = len(lines[i - 1].body) > 25 and len(lines[i].body) < 45 and not _intro(lines, i) and not _is(_CLOSING, lines[i].body) and (lines[i].words <= 2 or i + 1 < n and marked[i + 1])

    out = [bool(m) for m in marked]
    quoted_below = [False] * n  # lines of a quote that bears no marks
    i = 0
    while i < n:
        if blank[i] or marked[i]:
            i += 1
            continue
        intro = _intro(lines, i) or int(i in above)
        if not intro and _DIVIDER_SHAPE.match(lines[i].body) and lines[i].words:
            j = i + 1
            while j < n and blank[j]:
                j += 1
            intro = int(j < n and not marked[j] and bool(_header(lines, j)))  # whatever its words, it divides
        head = _header(lines, i + intro) if i + intro < n else 0
        if not intro and not head and _RULE.match(lines[i].body):
            j = i + 1
            while j < n and blank[j]:
                j += 1
            if j < n and not marked[j] and _header(lines, j):
                out[i] = True
            i += 1
            continue
        if intro and not head:
            j = i + intro
            while j < n and blank[j]:
                j += 1
            head_at = j
            head = _header(lines, j) if j < n and not marked[j] else 0
        else:
            head_at = i + intro
        if not intro and not head:
            i += 1
            continue
        end = i + intro
        for k in range(i, end):
            out[k] = True
        if head:
            for k in range(head_at, head_at + head):
                out[k] = True
            end = head_at + head
        j = end
        while j < n and blank[j]:
            j += 1
        if j < n and not marked[j]:
            # what follows without marks is the quote, up to the next marks at most;
            # where an ancestor confirms part of it, paragraphs that it lacks are answers
            stop = j
            while stop < n and not marked[stop]:
                stop += 1
            body = [k for k in range(j, stop) if not blank[k]]
            confirmed = any(took[k] for k in body)
            for k in body:
                quoted_below[k] = True
            if confirmed:
                _release_answers(lines, blank, took, quoted_below, j, stop)
            i = j if _header(lines, j) or _intro(lines, j) else end
            i = max(i, end)
            continue
        i = max(end, i + 1)

    for i in range(n):
        if quoted_below[i]:
            out[i] = True

    # unmarked, unannounced spans of ancestors; a message that is nothing else is a copy, not a quote
    own = [i for i in range(n) if not out[i] and not blank[i]]
    if own and any(not took[i] for i in own if lines[i].words >= 4):
        for i in own:
            if took[i] and lines[i].words >= 3:
                out[i] = True
        _fill_short(lines, blank, took, out)

    _signatures(lines, blank, out)
    for x, y in _paragraphs(blank, 0, n):
        start = x + 1 if _RULE.match(lines[x].body) and x + 1 < y else x
        if not lines[start].depth and _DISCLAIMER.match(lines[start].body) and out[start]:
            for k in range(x, y):
                out[k] = True
    full = [i for i in range(n) if not blank[i]]
    for k, i in enumerate(full):
        if not out[i] and _RULE.match(lines[i].body) and (k and out[full[k - 1]] or k + 1 < len(full) and out[full[k + 1]]):
            out[i] = True
    return [i + 1 for i in range(n) if out[i] and not blank[i]]


def _is(form: re.Pattern, body: str) -> bool:
    return form.match(body) is not None


def _paragraphs(blank: list[bool], a: int, b: int) -> list[tuple[int, int]]:
    out, start = [], None
    for k in range(a, b):
        if blank[k]:
            if start is not None:
                out.append((start, k))
                start = None
        elif start is None:
            start = k
    if start is not None:
        out.append((start, b))
    return out


def _release_answers(lines: list[Line], blank: list[bool], took: np.ndarray, quoted: list[bool], a: int, b: int) -> None:
    """Paragraphs of running text that no ancestor holds, in a quote that ancestors confirm, are the sender's answers."""
    paragraphs = _paragraphs(blank, a, b)
    held = [any(took[k] for k in range(x, y)) for x, y in paragraphs]
    for p, (x, y) in enumerate(paragraphs):
        words = sum(lines[k].words for k in range(x, y))
        if held[p] or words < 8 or _DISCLAIMER.match(lines[x].body) or _is(_CLOSING, lines[x].body) or _header(lines, x) or _intro(lines, x):
            continue
        if _is(_CARD, lines[x].body) or any(_is(_PHONE, lines[k].body) for k in range(x, y)):
            continue
        if any(held[p + 1 :]) or any(held[:p]):
            for k in range(x, y):
                quoted[k] = False


def _fill_short(lines: list[Line], blank: list[bool], took: np.ndarray, out: list[bool]) -> None:
    """Short last lines of paragraphs, between inherited ones, are too short to align: they go with their paragraph."""
    for x, y in _paragraphs(blank, 0, len(lines)):
        inner = [k for k in range(x, y)]
        if sum(bool(took[k]) for k in inner) * 2 > len(inner):
            for k in inner:
                out[k] = True


def _signatures(lines: list[Line], blank: list[bool], out: list[bool]) -> None:
    """Mark closing formulas, contacts and disclaimers of the stretches that the sender wrote."""
    n = len(lines)
    i = 0
    while i < n:
        if out[i]:
            i += 1
            continue
        j = i
        while j < n and not out[j]:
            j += 1
        _close_stretch(lines, blank, out, i, j)
        i = j


def _close_stretch(lines: list[Line], blank: list[bool], out: list[bool], a: int, b: int) -> None:
    k = a
    before = a - 1
    while before >= 0 and blank[before]:
        before -= 1
    if before >= 0 and not lines[before].depth and _is(_CLOSING, lines[before].body):
        end = _signature_end(lines, blank, before, b)  # the formula went with an inherited span
        for x in range(a, end):
            out[x] = True
        k = max(end, a)
    while k < b:
        body = lines[k].body
        if blank[k]:
            k += 1
            continue
        start = None
        fresh = k == a or blank[k - 1] or out[k - 1]
        if _is(_CLOSING, body):
            start = k
        elif _is(_SENT_FROM, body) or _is(_DASHES, body) and _short_tail(lines, blank, k + 1, b):
            start = k
        elif fresh and (_is(_CARD, body) or _contact_paragraph(lines, blank, k, b)):
            start = k
        if start is not None:
            end = _signature_end(lines, blank, start, b)
            for x in range(start, end):
                out[x] = True
            k = end
            continue
        if fresh and _DISCLAIMER.match(body) or (_RULE.match(body) and k + 1 < b and _DISCLAIMER.match(lines[k + 1].body)):
            if _DISCLAIMER.match(body) and k > a and _RULE.match(lines[k - 1].body):
                out[k - 1] = True
            while k < b and not blank[k]:
                out[k] = True
                k += 1
            j = k
            while j < b and blank[j]:
                j += 1
            if j < b and _RULE.match(lines[j].body):
                out[j] = True
            continue
        k += 1


def _contact_paragraph(lines: list[Line], blank: list[bool], k: int, b: int) -> bool:
    """A short paragraph of names and offices that holds a phone number or an address line."""
    end = k
    while end < b and not blank[end]:
        end += 1
    body = [lines[x].body for x in range(k, end)]
    return 1 <= len(body) <= 7 and max(map(len, body)) <= 70 and any(_is(_PHONE, x) or _is(_CARD, x) for x in body) and not any(x.endswith((".", ";")) and len(x) > 45 for x in body)


def _short_tail(lines: list[Line], blank: list[bool], k: int, b: int) -> bool:
    """Whether a signature may follow: nothing, or lines too short for running text, up to the first blank."""
    first = [lines[x].body for x in range(k, min(b, k + 6)) if not blank[x]][:2]
    return all(len(x) <= 60 for x in first)


def _signature_end(lines: list[Line], blank: list[bool], start: int, b: int) -> int:
    """End of a signature: names and contacts, adverts and disclaimers, until running text begins again."""
    k = start + 1
    while k < b:
        if blank[k]:
            k += 1
            continue
        fresh = blank[k - 1]
        if fresh:
            end = k
            while end < b and not blank[end]:
                end += 1
            body = [lines[x].body for x in range(k, end)]
            inner = [x for x in body if not _RULE.match(x)]
            words = sum(lines[x].words for x in range(k, end))
            if inner and not _DISCLAIMER.match(inner[0]) and not _is(_SENT_FROM, inner[0]) and not _contact_paragraph(lines, blank, k, b):
                running = words > 14 or any(x.endswith((".", "?")) and len(x.split()) > 5 for x in inner)
                if running:
                    return k
            k = end
        else:
            k += 1
    return b


def _time_of() -> F.Column:
    """When a message was sent: its date, or the earlier of the day it says and the time it came in; microseconds."""
    sent = F.coalesce(*[F.try_to_timestamp(F.col("date_sent"), F.lit(p)) for p in ("yyyy MMMM dd", "MM/dd/yy", "yyyy-MM-dd")])
    at = F.coalesce(F.try_to_timestamp(F.col("ddmudate")), F.least(F.date_add(sent, 1).cast("timestamp"), F.col("ingested_at").cast("timestamp")))
    return F.least(F.coalesce(F.unix_micros(at), F.lit(NO_TIME)), F.lit(NO_TIME))


def _tag(name: str) -> int:
    """Tells the texts of one document apart, in the upper half of positions."""
    return (xxhash.xxh32_intdigest(name) >> 1) << 32


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, rank, doc, pos): the rank orders the uses of a shingle by time, then by depth of quotes."""
    known: dict[str, int] = {}
    for batch in batches:
        keys, docs, ranks, ats = [], [], [], []
        for doc, name, at, c, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = read_lines(text)
            pos, h = shingles(lines, xxhash.xxh3_64_intdigest(c), known)
            if len(pos):
                keys.append(h.view(np.int64))
                ats.append(pos.astype(np.int64) + _tag(name))
                docs.append(np.full(len(pos), doc, np.int64))
                depth = np.repeat([min(x.depth, 63) for x in lines], [x.words for x in lines])[pos]
                ranks.append((at << 6) + depth.astype(np.int64))
        cat = (lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([cat(keys), cat(ranks), cat(docs), cat(ats)], ["shingle", "rank", "doc", "pos"])


def _spans(name: str, text: str, found: list[dict] | None) -> np.ndarray | None:
    """Which words of a message lie in inherited spans, by the shingles found in ancestors."""
    tag, low = _tag(name), (1 << 32) - 1
    hits = sorted({(f["pos"] - tag, (f["doc"], f["src"] >> 32), f["src"] & low) for f in found or () if f["pos"] & ~low == tag})
    if not hits:
        return None
    lines = read_lines(text)
    number = {s: i for i, s in enumerate(dict.fromkeys(x[1] for x in hits))}
    return inherited_words(lines[-1].first + lines[-1].words, np.array([x[0] for x in hits]), np.array([number[x[1]] for x in hits]), np.array([x[2] for x in hits]))


_FOUND = "array<struct<pos: long, doc: long, src: long>>"
_PASS = f"kind string, name string, doc long, line int, wording long, below boolean, text string, found {_FOUND}"


def _first_pass(with_text: bool):
    """Each message's lines that are not its sender's (``gone``), what may head something (``head``), and the message itself if such a line has no inherited span below (``open``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            opened: list[int] = []

            def row(*values) -> None:  # noqa: ANN002
                for column, value in zip(rows, values, strict=True):  # noqa: B023
                    column.append(value)

            for at, (name, doc, text, found) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                inherited = _spans(name, text, found)
                may = heads(read_lines(text), inherited)
                for i, words, below in may:
                    row("head", None, doc, i, words, below)
                if with_text or not all(below for *_, below in may):
                    opened.append(at)
                if not with_text:
                    for i in not_written(text, inherited):
                        row("gone", name, doc, i, None, None)
            n = len(rows[0])
            take = pa.array([None] * n + opened, pa.int64())
            for at in opened:
                row("open", batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), None, None, None)
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2).take(take), batch.column(3).take(take)], ["kind", "name", "doc", "line", "wording", "below", "text", "found"])

    return run


def _line_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers = [], []
            for m, text, found, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone = not_written(text, _spans(m, text, found), set(known or ()))
                if with_text:
                    drop = set(gone)
                    kept = [x for i, x in enumerate(text.split("\n"), 1) if i not in drop]
                    names.append(m)
                    numbers.append(re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", "\n".join(kept)).strip())
                else:
                    names += [m] * len(gone)
                    numbers += gone
            second = pa.array(numbers, pa.string() if with_text else pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), second], ["name", "text" if with_text else "line_no"])

    return run


def _classified(artifact_text: DataFrame, doc_meta: DataFrame, with_text: bool) -> DataFrame:
    sent = doc_meta.where(F.col("conversation").isNotNull()).groupBy("id").agg(F.min("conversation").alias("conversation"), F.min(_time_of()).alias("at"))
    sent = materialise(sent, "mail-sent")
    # only the texts of emails move: a Bloom filter of bounded size holds the others back at the scan
    n_blocks = bloom.blocks_for(sent.count())
    texts = bloom.probe(artifact_text.select("id", "name", "text"), "id", bloom.build(sent, "id", n_blocks), n_blocks, "mail").where("mail").drop("mail")
    # one plan at every size, and one partitioning for the texts: by document, in this join and in that with what is found
    sent = sent.select(F.xxhash64("id").alias("doc"), "at", "conversation").hint("merge")
    emails = texts.select(F.xxhash64("id").alias("doc"), "name", "text").join(sent, "doc").select("name", "doc", "at", "conversation", "text")
    emails, empty = emails.where(F.col("text").isNotNull()), emails.where(F.col("text").isNull())
    kind = "shingle long, rank long, doc long, pos long"
    uses = materialise(emails.select("doc", "name", "at", "conversation", "text").mapInArrow(_shingle_rows, kind), "mail-shingles")
    # partial aggregation first; a shingle of a third of all messages meets in one row a map task
    first = uses.groupBy("shingle").agg(F.min(F.struct("rank", "doc", "pos")).alias("e"), F.count("*").alias("n")).where(F.col("n") > 1)
    first = first.select("shingle", F.col("e.rank").alias("earliest"), F.col("e.doc").alias("src_doc"), F.col("e.pos").alias("src"))
    hits = uses.join(first.hint("merge"), "shingle").where((F.col("doc") != F.col("src_doc")) & (F.col("earliest") < F.col("rank")))
    found = hits.groupBy("doc").agg(F.collect_list(F.struct("pos", F.col("src_doc").alias("doc"), "src")).alias("found"))
    passed = emails.select("name", "doc", "text").join(found.hint("merge"), "doc", "left").select("name", "doc", "text", "found")
    passed = materialise(passed.mapInArrow(_first_pass(with_text), _PASS), "mail-lines")

    # what stands above inherited spans, and how often its wording does
    above = passed.where("kind = 'head'").select("doc", "line", "wording", "below")
    counts = above.groupBy("wording").agg(F.count_if("below").alias("n"), F.count("*").alias("all"))
    known = counts.where((F.col("n") >= LEAST_ABOVE) & (F.col("n") >= F.col("all") * SHARE_ABOVE)).select("wording")
    learnt = above.where(~F.col("below")).join(known, "wording", "left_semi").groupBy("doc").agg(F.collect_set("line").alias("known"))
    again = passed.where("kind = 'open'").select("name", "doc", "text", "found")
    if with_text:
        out = again.join(learnt, "doc", "left").select("name", "text", "found", "known").mapInArrow(_line_rows(True), "name string, text string")
        return out.unionByName(empty.select("name", "text"))
    # the few messages with lines of learnt wordings are gone through again
    out = again.join(learnt, "doc").select("name", "text", "found", "known").mapInArrow(_line_rows(False), "name string, line_no long")
    rest = passed.where("kind = 'gone'").join(learnt.select("doc"), "doc", "left_anti")
    return out.unionByName(rest.select("name", F.col("line").cast("long").alias("line_no")))


def unwritten_lines(artifact_text: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(name, line_no) of the lines of emails that their sender did not newly write."""
    return _classified(artifact_text, doc_meta, False).distinct()


def written_text(artifact_text: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(name, text) of emails, reduced to what their sender newly wrote; a null text stays null."""
    return _classified(artifact_text, doc_meta, True).distinct()
