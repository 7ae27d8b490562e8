"""Problem 6: variant spellings of names typed by people.

Every distinct spelling becomes a vector of weighted character n-grams of its
parts (titles, mail addresses and house names put aside, nicknames spelled
out). A sparse similarity join, block by block against the registry, finds every
entry of at least ``LEAST_COSINE``, however many; of these, those remain that a
comparison part by part finds compatible. Short forms of given names are a seed
list, and those that spellings with a mail address show for its owner are learnt
besides. Spellings with one compatible party form that party's cluster; a
spelling that several parties could mean goes to the cluster of greatest average
linkage, and one whose linkage with its cluster is under ``LEAST_LINKAGE`` to
none.

Defined cases: null, empty and blank elements are not names; names of any length
are compared; a spelling that no registry entry is compatible with means none;
an exact tie of clusters goes to the smaller party_id; exact duplicate rows and
repeated elements count once; an empty registry links nothing; further columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Least cosine of a spelling with a registry entry, and with the members of its cluster on average.
LEAST_COSINE, LEAST_LINKAGE = 0.08, 0.08
#: Dimensions that n-grams are hashed to (their weights are 1 MB), registry entries of a block, and spellings of a block.
DIMENSIONS, ENTRIES, SPELLINGS = 1 << 18, 2048, 512
#: Spellings that must show a short form of a given name.
LEAST_SHOWN = 2

# Titles, degrees, legal forms, and given names with their usual short forms.
TITLES = "dr prof hon mr mrs ms miss sir dame herr frau mme mlle professor doctor".split()
DEGREES = "esq md phd jr sr jd llm mba cpa rn pharmd ii iii iv".split()
LEGAL = "inc llc corp gmbh lp ltd co plc sa ag llp incorporated corporation company limited the and of".split()
SHORT_FORMS = """
abigail: abby abbie gail; albert: al bert; alexander: alex sandy; alfred: al fred; amanda: mandy; andrew: andy drew;
anthony: tony ant; arthur: art; barbara: barb babs; benjamin: ben benny benji; catherine: cathy cate kate; charles: charlie chuck chas;
christine: chris chrissy tina; christopher: chris kit; cynthia: cindy; daniel: dan danny; david: dave davy; deborah: deb debbie debby;
donald: don donny; dorothy: dot dottie dolly; douglas: doug; edward: ed eddie ned ted; eleanor: ellie nell nora;
elizabeth: liz beth betsy betty lizzie eliza lisa; eugene: gene; florence: flo; frances: fran; francis: frank; françoise: fran;
frederick: fred freddie freddy rick; gabriel: gabe; geraldine: gerri gerry geri; gerald: gerry jerry; gregory: greg; harold: harry hal;
henry: harry hank; hugh: hughie; ingrid: inga; jacqueline: jackie; jacob: jake; james: jim jimmy jamie; janet: jan; jeffrey: jeff;
jennifer: jen jenny; jessica: jess; john: jack johnny; jonathan: jon; joseph: joe joey jo; josephine: jo josie; joshua: josh; judith: judy;
jürgen: juergen; katherine: kate kathy katie kay kathie kit; kenneth: ken kenny; lawrence: larry laurie; leonard: len lenny leo; margaret: maggie peggy meg marge;
martin: marty; matthew: matt; michael: mike mick mickey; nancy: nan; nathaniel: nate nathan nat; nicholas: nick; nuria: nuri; oliver: ollie olly;
olga: olya; pamela: pam; patricia: pat trish patty tricia; patrick: pat paddy; penelope: penny pen; peter: pete; philip: phil; quentin: quent;
rebecca: becky becca; renée: rena; richard: dick rick rich richie; robert: bob rob bobby robbie; ronald: ron; samuel: sam sammy; samantha: sam;
sandra: sandy; sarah: sally; stephen: steve stevie; susan: sue susie suzy; theodore: ted teddy theo; thomas: tom tommy; timothy: tim timmy;
ulrich: uli ulli; valerie: val; victor: vic; victoria: vicky tori vickie vicki; vincent: vince; virginia: ginny ginger; walter: walt wally;
william: bill will billy willie; yvonne: eve; zachary: zach zack zak
"""


def plain(s: str) -> str:
    """Lower case without diacritics."""
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss")).lower()
    return "".join(c for c in s if not unicodedata.combining(c))


_FORMAL: dict[str, set[str]] = {}
for _line in SHORT_FORMS.replace("\n", " ").split(";"):
    _name, _, _short = _line.partition(":")
    for _s in plain(_short).split():
        _FORMAL.setdefault(_s, set()).add(plain(_name.strip()))
_SHORT: dict[str, set[str]] = {}
for _s, _names in _FORMAL.items():
    for _name in _names:
        _SHORT.setdefault(_name, set()).add(_s)

_TITLE = re.compile(rf"^(?:(?:{'|'.join(TITLES)})\b\.?\s*)+")
_DEGREE = re.compile(rf"(?<![\s,])[\s,]+(?:{'|'.join(DEGREES)})\b\.?\s*$")
_BRACKET = re.compile(r"[(\[]([^)\]]*)[)\]]")
_MAIL = re.compile(r"<?(?<![\w.+'-])([\w.+'-]+)@([\w.-]+\w)>?")
_PART = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Written:
    """The parts of a spelling."""

    parts: tuple[str, ...]  # name parts, given names first where a comma tells
    surname_first: bool  # a comma told
    house: str  # bracketed organisation
    mail: tuple[str, str] | None


def parse(written: str) -> Written:
    s = plain(written).strip()
    mail, house = None, ""
    m = _MAIL.search(s)
    if m:
        mail = (m[1], m[2])
        s = (s[: m.start()] + " " + s[m.end() :]).strip()
    b = _BRACKET.search(s)
    if b:
        house = b[1].strip()
        s = _BRACKET.sub(" ", s).strip()
    s = _TITLE.sub("", s)
    while (cut := _DEGREE.sub("", s)) != s:
        s = cut
    told = False
    if "," in s:
        a, _, rest = s.partition(",")
        if _PART.findall(rest) and not all(p in LEGAL or len(p) == 1 and "." in rest and _PART.findall(rest) == ["l", "p"] for p in _PART.findall(rest)):
            s, told = f"{rest} {a}", True
        else:
            s = f"{a} {rest}"
    parts = tuple(_PART.findall(s))
    if not parts and mail:
        parts = tuple(p for p in _PART.findall(mail[0]))
    return Written(parts, told, house, mail)


def grams(parts: tuple[str, ...]) -> list[str]:
    """Character trigrams of the parts, their first letters, and those with the last; short forms also as the names they stand for."""
    out = []
    for p in parts:
        if p in LEGAL:
            continue
        for q in {p, *_FORMAL.get(p, ())}:
            out.append(f"{q[0]}.")
            if len(q) > 1:
                padded = f"^{q}$"
                out += [f"{q[0]}..{q[-1]}", *(padded[i : i + 3] for i in range(len(padded) - 2))]
    return out


def counted(written: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of a spelling's n-grams."""
    at = np.array([xxhash.xxh32_intdigest(g) % DIMENSIONS for g in grams(parse(written).parts)], np.int64)
    return np.unique(at, return_counts=True)


def vector(written: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, weights) of a spelling, of length 1."""
    at, n = counted(written)
    w = np.sqrt(n) * idf[at]
    return at, w / (np.sqrt((w * w).sum()) or 1.0)


def edits(a: str, b: str) -> int:
    """Edit distance with neighbour swaps; 9 where it is over 2 for sure."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 9
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def _given(written: str, given: str, shown: tuple[str, ...] = ()) -> int:
    """Edits between a written given name or initial and a registered one; 9 if they differ."""
    if len(written) == 1:
        return 0 if written == given[0] else 9
    forms = {given, *_SHORT.get(given, ()), *shown}
    if written in forms:
        return 0
    best = min(edits(written, f) for f in forms if len(f) > 2 or f == given)
    # a short form of one name, or another known name, is not a slip of this one
    return best if best <= 1 and written not in _FORMAL and written not in _SHORT else 9


def person_edits(w: Written, name: str, domain: str, org: str, shown: tuple[str, ...] = ()) -> int:
    """Edits by which a spelling departs from a registered person; 9 if it doesn't mean them. ``shown`` holds learnt short forms of the given name."""
    given, *middle, last = _PART.findall(plain(name))
    if w.mail:
        local = tuple(_PART.findall(w.mail[0]))
        if w.mail[1] != domain:
            return 9
        if local != (given, last) and (len(local) != 2 or edits(".".join(local), f"{given}.{last}") > 1):
            return 9
        if tuple(sorted(w.parts)) == tuple(sorted(local)):
            return 0
    if len(w.parts) < 2:
        return 9
    orders = [w.parts]
    if not w.surname_first and not w.mail:
        orders.append(w.parts[1:] + w.parts[:1])
    best = 9
    for *first, surname in orders:
        s = edits(surname, last)
        if s > 1 or len(first) > 3:
            continue
        g = _given(first[0], given, shown)
        if g + s > 1:
            continue
        inner = [x for x in first[1:] if x not in DEGREES]
        if inner and (not middle or len(inner) > len(middle) or any((x[0] if len(y) == 1 else x) != (y if len(x) > 1 else y[0]) for x, y in zip(inner, middle, strict=False))):
            continue
        best = min(best, s + g)
    if best < 9 and w.house and org:
        house = _PART.findall(w.house)
        head = _PART.findall(plain(org))[:1]
        if house and head and edits(house[0], head[0]) > 1:
            return 9
    return best


def _cut_short(p: str, word: str) -> bool:
    """Whether ``p`` is ``word`` with letters left out after the first ("pkg", "labs")."""
    rest = iter(word[1:])
    return 3 <= len(p) < len(word) and p[0] == word[0] and all(c in rest for c in p[1:])


def organisation_edits(w: Written, name: str, domain: str) -> int:
    """The same for a registered organisation: its head, then any of its words, cut short or not, in order."""
    want = [p for p in _PART.findall(plain(name)) if p not in LEGAL and len(p) > 1]
    got = [p for p in (w.parts if not w.surname_first else w.parts[-1:] + w.parts[:-1]) if p not in LEGAL and len(p) > 1]
    if w.mail or not got or not want:
        return 9
    total = edits(got[0], want[0])
    if total > 1:
        return 9
    at = 1
    for p in got[1:]:
        for i in range(at, len(want)):
            d = 0 if _cut_short(p, want[i]) else edits(p, want[i])
            if d + total <= 1:
                total += d
                at = i + 1
                break
        else:
            return 9
    return total


def _dimension_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted(k)[0] for k in batch.column(0).to_pylist()]
        at, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["at", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        parts = [names[i : i + SPELLINGS] for i in range(0, len(names), SPELLINGS)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.string()))], ["spellings"])


class _Entries:
    """A block of the registry: its entries by the dimensions of their vectors."""

    def __init__(self, entries: list[dict], idf: np.ndarray) -> None:
        self.entries = entries
        of: dict[int, list] = {}
        for i, e in enumerate(entries):
            for d, w in zip(*vector(e["party_name"], idf), strict=True):
                of.setdefault(int(d), []).append((i, w))
        self.of = {d: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for d, x in of.items()}

    def near(self, at: np.ndarray, w: np.ndarray) -> Iterator[tuple[dict, float]]:
        cosine = np.zeros(len(self.entries))
        for d, x in zip(at.tolist(), w.tolist(), strict=True):
            found = self.of.get(d)
            if found is not None:
                cosine[found[0]] += x * found[1]
        for i in np.flatnonzero(cosine >= LEAST_COSINE):
            yield self.entries[i], float(cosine[i])


def _match(idf):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, block, known = idf.value, None, None
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for spellings, number, entries in zip(*batch.columns, strict=True):
                if number.as_py() != block:
                    block, known = number.as_py(), _Entries(entries.as_py(), weights)
                for written in spellings.as_py():
                    w = parse(written)
                    for e, cosine in known.near(*vector(written, weights)):
                        if e["party_kind"] == "person":
                            d = person_edits(w, e["party_name"], e["mail_domain"] or "", e["org"] or "", tuple(e["shown"] or ()))
                        else:
                            d = organisation_edits(w, e["party_name"], e["mail_domain"] or "")
                        if d < 9:
                            for column, value in zip(rows, (written, e["party_id"], cosine, d), strict=True):
                                column.append(value)
            types = [pa.string(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["written", "party_id", "cosine", "edits"])

    return run


def _weight_rows(idf):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(k, idf.value) for k in batch.column(0).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32())
            flat = [np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(2)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in zip(flat, (pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["written", "at", "w"])

    return run


def _shown_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before a surname in spellings with a mail address of given name, dot and surname."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for written in batch.column(0).to_pylist():
            w = parse(written)
            local = _PART.findall(w.mail[0]) if w.mail else ()
            if len(local) == 2 and len(w.parts) >= 2 and len(w.parts[0]) > 1 and w.parts[-1] == local[1] and edits(w.parts[0], local[0]) > 1:
                for column, value in zip(rows, (w.mail[1], *local, w.parts[0]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], ["mail_domain", "given", "last", "short"])


def _person_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_PART.findall(plain(n)) for n in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] if x else None for x in parts], pa.string()), pa.array([x[-1] if x else None for x in parts], pa.string())], ["party_id", "mail_domain", "given", "last"])


def short_forms(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(party_id, shown): short forms of each person's given name, learnt from spellings beside mail addresses of any registered person of that name."""
    people = registry.where("party_kind = 'person'").select("party_id", "party_name", F.lower("mail_domain").alias("mail_domain")).mapInArrow(_person_rows, "party_id long, mail_domain string, given string, last string")
    beside = names.where(F.contains("written", F.lit("@"))).mapInArrow(_shown_rows, "mail_domain string, given string, last string, short string")
    shown = beside.join(people.select("mail_domain", "given", "last").distinct(), ["mail_domain", "given", "last"])
    learnt = shown.groupBy("given", "short").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SHOWN)
    return people.join(learnt, "given").groupBy("party_id").agg(F.sort_array(F.collect_set("short")).alias("shown"))


def link_names(written: DataFrame, registry: DataFrame) -> DataFrame:
    """(written, party_id, edits, linkage) of the distinct spellings in ``written`` (column ``written``) that mean a party."""
    spark = written.sparkSession
    names = materialise(written.where(F.trim("written") != "").select("written").distinct(), "names")
    registry = registry.where(F.col("party_name").isNotNull()).dropDuplicates(["party_id"])
    corpus = names.unionByName(registry.select(F.col("party_name").alias("written")))
    df = corpus.mapInArrow(_dimension_rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # DIMENSIONS rows at most
    total = names.count() + (n_entries := registry.count())
    weights = np.full(DIMENSIONS, np.log(1.0 + total))
    weights[df.column(0).to_numpy()] = np.log(1.0 + total / df.column(1).to_numpy())  # what all names share still counts
    idf = spark.sparkContext.broadcast(weights)

    orgs = registry.select(F.col("party_id").alias("org_party_id"), F.col("party_name").alias("org"))
    whole = registry.join(orgs, "org_party_id", "left").join(short_forms(names, registry), "party_id", "left")
    number = F.pmod(F.xxhash64("party_id"), F.lit(max(1, -(-n_entries // ENTRIES)))).alias("number")
    entry = F.struct("party_id", "party_name", "party_kind", "mail_domain", "org", "shown")
    blocks = whole.select(number, entry.alias("e")).groupBy("number").agg(F.sort_array(F.collect_list("e")).alias("entries"))
    # the registry is the stated set that all spellings are compared with, block by block
    # few bytes but much work: over all cores, however small the table is
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = names.repartition(cores).mapInArrow(_packed, "spellings array<string>")
    met = packed.join(blocks).select("spellings", "number", "entries")
    fits = met.mapInArrow(_match(idf), "written string, party_id long, cosine double, edits int")
    least = Window.partitionBy("written")
    fits = fits.withColumn("least", F.min("edits").over(least)).where(F.col("edits") == F.col("least")).withColumn("choices", F.count("*").over(least)).drop("least")
    fits = materialise(fits, "name-fits")

    # average linkage: the mean of the cosines with all members is the dot product with their mean vector
    vectors = fits.select("written").distinct().mapInArrow(_weight_rows(idf), "written string, at array<int>, w array<double>")
    of_fits = materialise(fits.join(vectors, "written").select("written", "party_id", "edits", "choices", F.explode(F.arrays_zip("at", "w")).alias("x")).select("written", "party_id", "edits", "choices", "x.at", "x.w"), "name-weights")
    sure = of_fits.where(F.col("choices") == 1)
    size = fits.where(F.col("choices") == 1).groupBy("party_id").agg(F.count("*").alias("size"))
    centre = sure.groupBy("party_id", "at").agg(F.sum("w").alias("c")).join(size, "party_id").select("party_id", "at", (F.col("c") / F.col("size")).alias("c"))
    linked = of_fits.join(centre, ["party_id", "at"], "left").groupBy("written", "party_id", "edits", "choices").agg(F.sum(F.col("w") * F.coalesce("c", F.lit(0.0))).alias("linkage"))
    first = F.row_number().over(Window.partitionBy("written").orderBy(F.desc("linkage"), "party_id"))
    chosen = linked.withColumn("rank", first).where((F.col("rank") == 1) & (F.col("linkage") >= LEAST_LINKAGE))
    return chosen.select("written", "party_id", "edits", "linkage")


FIELDS = ("authors", "recipients", "custodian")


def link_fields(doc_meta: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, field, written_name, party_id) of each element of the name fields that means a party."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("names")) for f in FIELDS])
    listed = (
        doc_meta.select("id", F.explode(pairs).alias("e")).select("id", F.col("e.field").alias("field"), F.explode("e.names").alias("written"))
        .where(F.trim("written") != "").distinct()
    )
    links = link_names(listed, registry)
    return listed.join(links, "written").select("id", "field", F.col("written").alias("written_name"), "party_id")
