"""Problem 9: personal information inside free text.

Mail addresses, phone numbers, identity numbers and postal addresses are found
by their form and the words before them. Names are found by how strongly terms
reveal a person: over the whole corpus, each capitalised term's co-occurrence
with protected contexts (after a title or a given name of the seed list) is
counted, and from the counts follows its disclosure, the pointwise mutual
information between the term and a person being named. A term that mostly stands
right before disclosing ones, of several kinds, is learnt as a given name, so
the seed list need not hold it. Every run of capitalised words with a title, a
given name or a term over the thresholds is judged; what is found is replaced by
placeholders, all else stays.

Defined cases: null and empty texts have no spans and come out as they are;
where forms overlap, the earlier of mail address, identity number, postal
address, phone number, name counts; exact duplicate rows count once; positions
count code points; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Least shares of protected contexts at which a term reveals a person by itself, and beside a given name.
LEAST_SHARE, BESIDE_SHARE = 0.1, 0.008
#: Information (bits) below which a term reveals nobody by itself.
LEAST_BITS = 0.5
#: A term is a given name if this share of its places is before disclosing terms, of so many kinds at least.
GIVEN_SHARE, GIVEN_KINDS = 0.4, 4
#: A term that stands before given names so often, against its places before disclosing terms, addresses people instead.
ADDRESS_SHARE = 0.1

# Titles, and common given names of the four languages as a seed.
TITLES = "mr mrs ms miss dr prof hon sir herr herrn frau mme madame monsieur mlle sr sra srta señor señora don doña d.ª".split()
GIVEN = """
abigail albert alexander alice andrew ann anna anne anthony arthur barbara benjamin brian carol catherine charles christine christopher claire daniel david deborah
donald dorothy edward elizabeth emily emma eric frank frederick george geraldine gregory harold helen henry hugh ingrid jack james jane jennifer jessica john
jonathan joseph joshua julia karen katherine kenneth kevin laura lawrence leonard linda louise margaret maria mark martin mary matthew michael nancy nathaniel
nicholas oliver olga patricia patrick paul penelope peter philip quentin rebecca richard robert ronald samuel sandra sarah simon sophie stephen steven susan theodore
thomas timothy victoria vincent virginia walter william yvonne zachary
annegret beate bernd brigitte claus dieter dirk ernst franz friedrich fritz gisela günther hans heike heinrich helga horst ilse jürgen karl käthe klaus matthias
monika sabine stefan torsten ulrich ursula uwe werner wolfgang
benoît camille céline chloé étienne françoise gaëlle gérard guillaume hélène jacques jean laurent luc marcel mireille nathalie odile pascal philippe pierre renée
sylvain thérèse thierry yves
álvaro ana antonio begoña carlos carmen concepción diego elena fernando francisco gonzalo inés íñigo javier joaquín josé juan lucía luis manuel marta miguel nuria
pablo pedro pilar rafael ramón rocío rosa teresa tomás
""".split()
ORGANISATION = """inc llc corp corporation gmbh ag ltd limited lp l.p plc sa company co council pharma laboratories logistics therapeutics analytics packaging distribution biosciences
consulting communications wholesale holdings clinic hospital university institute office department group street road rd avenue ave lane ln drive dr blvd boulevard court ct row hill close
place square suite file area trial""".split()
_TITLES, _GIVEN, _ORG = set(TITLES), set(GIVEN), set(ORGANISATION)

_AT = re.compile(r"\s*[\[(]\s*(?:at|arobase|arroba)\s*[\])]\s*|\s+(?:at|arobase|arroba)\s+", re.IGNORECASE)
_DOT = r"(?:\s*[\[(]\s*(?:dot|punkt|point|punto)\s*[\])]\s*|\s+(?:dot|punkt|point|punto)\s+|\.)"
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*?(?:\s*[\[(]\s*(?:dot|punkt|point|punto)\s*[\])]\s*|\s+(?:dot|punkt|point|punto)\s+)[A-Za-z]{{2,}}\b(?:{_DOT}(?:[a-z]{{2,3}})\b(?=\W*$))?", re.IGNORECASE)
_DOT_WORD = re.compile(r"\bdot\b|\bDOT\b|\bpunkt\b|\bpunto\b|\bpoint\b")
_LOCAL = re.compile(rf"[\w+-]+(?:{_DOT}[\w+-]+)*$", re.IGNORECASE)
_MAIL_LOCAL = re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*$")
_MAIL_DOMAIN = re.compile(r"(?:[\w-]+\.)+[A-Za-z]{2,}")
#: Five digits or more, no more than three signs apart: every form of a number holds such a stretch, and begins at most 6 letters before one.
_DIGITS_AT = re.compile(r"\d(?:[\s().+/-]{0,3}\d){4,}")

_EXT = r"(?:,?\s+(?:ext\.?|extension|x|Durchwahl|poste|extensión)\s?\d{1,5}|,?\s?x\d{1,5})?"
_NANP = re.compile(r"(?<![\w.+/-])(?<!\d\s)(?:\+?1[\s.-])?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}(?![\w-]*\d)" + _EXT)
_ABROAD = re.compile(r"(?<![\w+])\+\d{1,3}(?:[\s./-]?\(0\))?(?:[\s./-]?\(?\d{1,8}\)?){2,7}")
_HOME = re.compile(r"(?<![\w+/.-])\(?0\d{1,4}\)?[\s./-]\d(?:[\s./-]?\d){5,12}(?!\d)")
_TAIL = re.compile(_EXT)
# Digits of a national number behind some country codes.
_DIGITS = {"1": 10, "44": 10, "33": 9, "34": 9, "49": 11, "43": 11, "41": 9, "32": 9, "31": 9, "39": 10}

_ID_FORMS = re.compile(
    r"(?<![\w./-])(?:\d{3}([-.\s])\d{2}\1\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]{2}[\s-]?\d{7}|[a-z]{2}-?\d{7}|\d\s\d\d\s\d\d\s\d[\dAB]\s\d{3}\s\d{3}(?:\s\d\d)?|\d\d/\d{3}/\d{3}/\d{3}|"
    r"\d{3}-?\d{2}-?\d{4}|\d{11}|\d{13}(?:\d\d)?)(?![\w/-])(?!\.\d)"
)
_ID_NOT = re.compile(r"(?:batch|lot|lote|invoice|facture|factura|rechnung|charge|order|ref|counts|item|serial|case|po|part|model|art)\b\.?\s*(?:no|nr|num|n[°º]|#)?\.?\s*:?\s*$", re.IGNORECASE)
_ID_CUE = re.compile(
    r"(?:\bid\b|ssn|ident|sécurité sociale|seguridad social|social security|passport|pasaporte|passeport|reisepass|ausweis|steuer|\bdni\b|\bnie\b|\bnif\b|quoted|licen[cs]e|führerschein|versicherung|insurance|\bnhs\b|taxpayer)",
    re.IGNORECASE,
)

_TOWN = r"[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){0,2}"
_TOWN1 = r"[A-ZÀ-Þ][\w'’-]+"
_STREET = r"(?:[A-ZÀ-Þ][\w'’-]+\s){1,3}(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Ct|Court|Ln|Lane|Dr|Drive|Way|Pl|Place|Row|Hill|Close|Terrace|Square|Crescent|Gardens|Hwy|Pkwy)\b\.?"
_ADDRESSES = [
    re.compile(rf"(?:P\.\s?O\.\s+Box\s+\d+|(?<![\w-])\d{{1,5}}\s{_STREET})(?:,?\s(?:Apt|Suite|Unit|Ste|Floor|Fl)\.?\s[\w-]+)?,\s{_TOWN},\s[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?"),
    re.compile(rf"(?:Flat\s\w+,\s)?(?<![\w-])\d{{1,4}}[a-z]?\s{_STREET},\s{_TOWN},?\s[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}}\b"),
    re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ]\w*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer)\s\d{{1,4}}(?:\s?[a-z])?|Postfach\s\d+),\s\d{{5}}\s{_TOWN1}"),
    re.compile(
        rf"(?<![\w-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|bd|boulevard|impasse|allée|chemin|place|quai|cours|route|square|passage)\s(?:(?:de la|des|du|de)\s|de l['’]|d['’])?"
        rf"[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)?,\s\d{{5}}\s{_TOWN1}"
    ),
    re.compile(
        rf"(?<!\w)(?:Calle|C/|Plaza|Avenida|Avda\.|Paseo|Camino|Ronda|Travesía)\s(?:(?:de la|de los|de las|del|de)\s)?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)?,?\s\d{{1,4}}"
        rf"(?:,\s(?:\d+\.?[ºª°]?(?:\s\w{{1,3}})?|bajo|ático|entresuelo|principal)(?:\s[A-Z])?)?,\s\d{{5}}\s{_TOWN1}"
    ),
]
_ADDRESS_AT = re.compile(r"\b(?:[A-Z]{2}\s\d{5}|\d[A-Z]{2}|\d{5}\s[A-ZÀ-Þ])")

_WORD = r"[A-ZÀ-ÖØ-Þ][\w’']*(?:-[A-ZÀ-ÖØ-Þ][\w’']*)*"
_INITIALS = r"[A-ZÀ-ÖØ-Þ]\.(?:[ ]?[A-ZÀ-ÖØ-Þ]\.)*"
_RUN = re.compile(rf"(?<![\w@.-])(?:{_INITIALS}|{_WORD}\.?)(?:,?(?:[ \t]|[ \t]?\r?\n)(?:{_INITIALS}|{_WORD}\.?))*")
_TOKEN = re.compile(rf"{_INITIALS}(?!\w)|{_WORD}")
_FRENCH = re.compile(r"\b(?:de|à|par|avec|pour|et|que|chez|prévenir|selon|cher)\s+$")
_SUFFIX = re.compile(r"['’][sS]$|['’]$")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _cut_to(number: str, most: int) -> str:
    """``number`` up to the last whole group of digits within ``most`` digits."""
    groups = list(re.finditer(r"\d+\)?", number))
    total, end = 0, len(number)
    for g in groups:
        total += _digits(g[0])
        if total > most:
            break
        end = g.end()
    return number[:end]


def number_spans(text: str, windowed: bool = True) -> list[tuple[int, int, str]]:
    """Spans of mail addresses, identity numbers, postal addresses and phone numbers; none overlap.

    Numbers are looked for around stretches of digits only (``windowed``), which
    changes nothing but the time.
    """
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    at = text.find("@")
    while at >= 0:
        local, domain = _MAIL_LOCAL.search(text, max(0, at - 80), at), _MAIL_DOMAIN.match(text, at + 1)
        if local and domain:
            add(local.start(), domain.end(), "email")
        at = text.find("@", at + 1)
    if _DOT_WORD.search(text):
        for m in _AT.finditer(text):
            d = _DOMAIN.match(text, m.end())
            if d:
                local = _LOCAL.search(text, max(0, m.start() - 120), m.start())
                if local:
                    add(local.start(), d.end(), "email")
    windows: list[list[int]] = [] if windowed else [[0, len(text)]]
    for m in _DIGITS_AT.finditer(text) if windowed else ():
        a, b = max(0, m.start() - 6), min(len(text), m.end() + 30)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    for a, b in windows:
        for m in _ID_FORMS.finditer(text, a, b):
            before = text[max(0, m.start() - 45) : m.start()]
            if _ID_NOT.search(before):
                continue
            if re.fullmatch(r"\d{3}-?\d{2}-?\d{4}|\d+|[a-z]{2}-?\d{7}", m[0]) and not _ID_CUE.search(before) and not re.fullmatch(r"\d{3}-\d{2}-\d{4}", m[0]):
                continue
            add(m.start(), m.end(), "id_number")
    if not windowed or _ADDRESS_AT.search(text):  # every form ends with a postal code and a town
        for form in _ADDRESSES:
            for m in form.finditer(text):
                add(m.start(), m.end(), "address")
    for a, b in windows:
        for m in _ABROAD.finditer(text, a, b):
            s = m[0]
            for code in (s[1:2], s[1:3], s[1:4]):
                if code in _DIGITS:
                    s = _cut_to(s, len(code) + _DIGITS[code] + ("(0)" in s))
                    break
            else:
                s = _cut_to(s, 14)
            if _digits(s) >= 9:
                end = m.start() + len(s)
                add(m.start(), _TAIL.match(text, end).end(), "phone")
        for m in _NANP.finditer(text, a, b):
            add(m.start(), m.end(), "phone")
        for m in _HOME.finditer(text, a, b):
            s = m[0]
            plain = re.sub(r"\D", "", s)
            s = _cut_to(s, 14 if plain.startswith("00") else 11)
            if _digits(s) >= 9 and not re.match(r"\d\d[./]\d\d[./]\d{4}", s) and s.count("(") == s.count(")"):
                end = m.start() + len(s)
                add(m.start(), _TAIL.match(text, end).end(), "phone")
    return sorted(found)


def _parts(token: str) -> list[str]:
    return [p for p in re.split(r"[-]", _SUFFIX.sub("", token).lower()) if len(p) > 1]


def runs(text: str, single: Counter | None = None) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of capitalised words and initials: (word, start, end). Words that stand alone are only counted, in ``single``, if it is given."""
    for m in _RUN.finditer(text):
        run = m[0]
        if single is not None and run.isalpha():
            single[run] += 1
            continue
        out: list[tuple[str, int, int]] = []
        for t in _TOKEN.finditer(text, m.start(), m.end()):
            word, a, b = t[0], t.start(), t.end()
            if out and "." in text[out[-1][2] : a] and len(out[-1][0]) > 2 and out[-1][0].lower() not in _TITLES:
                yield out  # a sentence ends here
                out = []
            if word == "M." and not out and _FRENCH.search(text, max(0, a - 14), a) or word == "M." and out and out[-1][0].lower() in ("selon", "cher", "avec", "pour"):
                word = "Monsieur"  # else it is an initial
            out.append((word, a, b))
        if out:
            yield out


def _protected(tokens: list[tuple[str, int, int]]) -> list[int]:
    """0 or 1 for each word of a run: whether it stands in a protected context, after a title or a given name."""
    out = []
    for i in range(len(tokens)):
        before = [tokens[j][0].lower().rstrip(".") for j in range(max(0, i - 2), i)]
        near = before and (before[-1] in _TITLES or before[-1] in _GIVEN or (len(before) > 1 and len(before[-1].replace(".", "")) <= 2 and before[-2] in _GIVEN | _TITLES))
        out.append(1 if near else 0)
    return out


def _is_candidate(text: str, tokens: list[tuple[str, int, int]]) -> bool:
    low = [t.lower().rstrip(".") for t, _, _ in tokens]
    if any(x in _GIVEN or x in _TITLES for x in low[:-1]) or low[-1] in _GIVEN:
        return True
    return any("." in t for t, _, _ in tokens[:-1])


def name_spans(tokens: list[str], starts: list[int], ends: list[int], commas: list[bool], shares: dict[str, float], learnt: set[str] | frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Names in a run of capitalised words; ``shares`` holds the words that reveal a person, ``learnt`` given names besides the seeds."""
    low = [_SUFFIX.sub("", t).lower().rstrip(".") for t in tokens]
    n = len(tokens)
    initial = ["." in t or len(t) == 1 for t in tokens]
    given = [x in _GIVEN or x in learnt or all(p in _GIVEN or p in learnt for p in x.split("-")) for x in low]
    title = [x in _TITLES and not initial[i] for i, x in enumerate(low)]
    share = [0.0 if initial[i] or low[i] in _ORG else max((shares.get(p, 0.0) for p in _parts(t)), default=0.0) for i, t in enumerate(tokens)]
    sure = [x >= LEAST_SHARE for x in share]
    known = [x > 0 and len(low[i]) > 2 for i, x in enumerate(share)]  # names that are places or words too: enough behind a given name
    out: list[tuple[int, int]] = []
    i = 0

    def end_of(k: int) -> int:
        return ends[k] - (len(tokens[k]) - len(_SUFFIX.sub("", tokens[k])))

    def clear(k: int) -> bool:
        return k >= n or commas[k - 1] or low[k] not in _ORG

    while i < n:
        if title[i] and i + 1 < n and not commas[i]:
            j = i + 1
            while j < n and (given[j] or initial[j]) and not title[j] and not (commas[j] and not given[j]):
                j += 1
                if commas[j - 1]:
                    break
            last = j - 1
            while j < n and (sure[j] or known[j] and last > i and (given[last] or initial[last])) and not commas[j - 1] and j - i <= 5:
                last, j = j, j + 1
            if last == i and i + 1 < n and not title[i + 1]:
                last, j = i + 1, i + 2  # a surname of which the corpus knows no more
            if last == i + 1 and sure[i + 1] and j < n and commas[i + 1] and given[j]:
                last, j = j, j + 1
                if j < n and initial[j] and not commas[j - 1]:
                    last, j = j, j + 1
            if last > i and not all(initial[i + 1 : last + 1]) and clear(j):
                out.append((starts[i + 1], end_of(last)))
                i = last + 1
                continue
            i += 1
            continue
        if given[i] or initial[i]:
            j = i + 1
            while j < n and (initial[j] or given[j]) and not commas[j - 1] and not title[j]:
                j += 1
            first = i
            if not commas[j - 1] and j < n and known[j]:
                last, j = j, j + 1
                while j < n and sure[j] and not commas[j - 1] and j - first <= 5 and not given[j]:
                    last, j = j, j + 1
                if clear(j):
                    out.append((starts[first], end_of(last)))
                    i = last + 1
                    continue
            i = max(i + 1, j - 1 if j - 1 > i else i + 1)
            continue
        if known[i] and commas[i] and i + 1 < n and given[i + 1] and not (i + 2 < n and sure[i + 2] and not commas[i + 1]):
            last = i + 1
            if last + 1 < n and initial[last + 1] and not commas[last]:
                last += 1
            out.append((starts[i], end_of(last)))
            i = last + 1
            continue
        i += 1
    return out


_KINDS = "kind string, doc_id long, pii_type string, start_pos int, end_pos int, tokens array<string>, starts array<int>, ends array<int>, commas array<boolean>, term string, beside string, n long, c long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: spans by form, candidate runs, and counts of terms, added up in each batch."""
    names = [x.split()[0] for x in _KINDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        columns: list[list] = [[] for _ in names]

        def row(*values) -> None:  # noqa: ANN002, B023
            for column, value in zip(columns, values, strict=True):  # noqa: B023
                column.append(value)

        seen: Counter = Counter()
        single: Counter = Counter()
        protected: Counter = Counter()
        pairs: Counter = Counter()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = number_spans(text)
            for a, b, kind in spans:
                row("span", doc, kind, a, b, None, None, None, None, None, None, None, None)
            for tokens in runs(text, single):
                if len(tokens) == 1:
                    single[tokens[0][0]] += 1
                    if tokens[0][0].lower() not in _TITLES:
                        continue
                for (t, _, _), near in zip(tokens, _protected(tokens), strict=True):
                    single[t] += len(tokens) > 1
                    if near:
                        protected.update(_parts(t))
                for x, y in zip(tokens, tokens[1:], strict=False):
                    if len(x[0]) > 2 < len(y[0]) and "," not in text[x[2] : y[1]]:
                        pairs[x[0], y[0]] += 1
                known = _is_candidate(text, tokens)
                if known or len(tokens) > 1:
                    a, b = tokens[0][1], tokens[-1][2]
                    free = [t for t in tokens if all(t[2] <= x or t[1] >= y for x, y, _ in spans if x < b and y > a)]
                    if free:
                        commas = ["," in text[x[2] : y[1]] for x, y in zip(free, free[1:], strict=False)] + [False]
                        row("run" if known else "open", doc, None, None, None, [t for t, _, _ in free], [x for _, x, _ in free], [x for _, _, x in free], commas, None, None, None, None)
        for word, count in single.items():
            for p in _parts(word):
                seen[p] += count
        for term, count in seen.items():
            row("term", None, None, None, None, None, None, None, None, term, None, count, protected[term])
        before: Counter = Counter()
        for (x, y), count in pairs.items():
            for p in _parts(y):
                before[_SUFFIX.sub("", x).lower(), p] += count
        for (x, y), count in before.items():
            row("pair", None, None, None, None, None, None, None, None, x, y, count, None)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, a_pos, b_pos = [], [], []
        for doc, tokens, starts, ends, commas, shares, learnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a, b in name_spans(tokens, starts, ends, commas, dict(shares or {}), set(learnt or ())):
                docs.append(doc)
                a_pos.append(a)
                b_pos.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(["person"] * len(docs), pa.string()), pa.array(a_pos, pa.int64()), pa.array(b_pos, pa.int64())], ["doc_id", "pii_type", "start_pos", "end_pos"]
        )


def disclosing_terms(terms: DataFrame) -> DataFrame:
    """(term, share, bits) of the terms that reveal a person, from (term, n, c) counts over the corpus."""
    total = terms.groupBy("term").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    sums = terms.agg(F.sum("n"), F.sum("c")).first()
    base = (sums[1] or 0) / (sums[0] or 1) or 1.0
    share = F.col("c") / F.col("n")
    bits = F.log2(share / F.lit(base))
    # in a corpus of little but names the base is high, and the threshold in bits follows it
    weak = bits < min(LEAST_BITS, -math.log2(base) / 2)
    capped = F.when(weak, F.least(share, F.lit(LEAST_SHARE * 0.99))).otherwise(share)
    return total.where(F.col("c") > 0).select("term", capped.alias("share"), bits.alias("bits")).where(F.col("share") >= BESIDE_SHARE)


def given_names(pairs: DataFrame, terms: DataFrame, strong: DataFrame) -> DataFrame:
    """(term) that mostly stand right before disclosing terms of several kinds, from (term, beside, n) and (term, n) counts."""
    sure = strong.where(F.col("share") >= LEAST_SHARE).select(F.col("term").alias("beside"))
    pairs = pairs.groupBy("term", "beside").agg(F.sum("n").alias("n"))
    before = pairs.join(sure, "beside").groupBy("term").agg(F.sum("n").alias("before"), F.count("*").alias("kinds"))
    # what addresses people ("Dear") stands before given names as well
    address = pairs.where(F.col("beside").isin(*GIVEN)).groupBy("term").agg(F.sum("n").alias("address"))
    before = before.join(address, "term", "left").where(F.coalesce("address", F.lit(0)) <= F.col("before") * ADDRESS_SHARE)
    total = terms.groupBy("term").agg(F.sum("n").alias("all"))
    named = before.where((F.col("kinds") >= GIVEN_KINDS) & ~F.col("term").isin(*TITLES, *ORGANISATION)).join(total, "term").where(F.col("before") >= F.col("all") * GIVEN_SHARE)
    return named.select("term")


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of the personal information in ``text``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    scanned = materialise(texts.mapInArrow(_scan, _KINDS), "pii-scan")
    spans = scanned.where("kind = 'span'").select("doc_id", "pii_type", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))
    terms = scanned.where("kind = 'term'").select("term", "n", "c")
    strong = materialise(disclosing_terms(terms).select("term", "share"), "pii-terms")
    learnt = given_names(scanned.where("kind = 'pair'").select("term", "beside", "n"), terms, strong)
    told = strong.join(learnt.withColumn("given", F.lit(True)), "term", "full").select("term", "share", F.coalesce("given", F.lit(False)).alias("given"))

    candidates = scanned.where("kind IN ('run', 'open')").select("kind", "doc_id", "tokens", "starts", "ends", "commas").distinct()
    words = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.split(F.regexp_replace(F.lower(t), "['’]s?$", ""), "-"))))
    used = candidates.select("doc_id", F.col("starts").alias("run"), F.explode(words).alias("term"))
    # the terms are unique, so a hot word multiplies nothing; AQE splits its rows
    known = F.collect_set(F.when(F.col("share").isNotNull(), F.struct("term", "share")))
    found = used.join(told, "term").groupBy("doc_id", "run").agg(F.map_from_entries(known).alias("shares"), F.collect_set(F.when(F.col("given"), F.col("term"))).alias("learnt"))
    joined = candidates.withColumnRenamed("starts", "run").join(found, ["doc_id", "run"], "left").where((F.col("kind") == "run") | F.col("shares").isNotNull())
    persons = joined.select("doc_id", "tokens", "run", "ends", "commas", "shares", "learnt").mapInArrow(_decide, "doc_id long, pii_type string, start_pos long, end_pos long")
    return spans.unionByName(persons).distinct()


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of personal information replaced by its type in brackets."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct()
    spans = find(documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if found:
                    parts, at = [], 0
                    for s in found:
                        if s["start_pos"] < at:
                            continue
                        parts += [text[at : s["start_pos"]], f"[{s['pii_type'].upper()}]"]
                        at = s["end_pos"]
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
