import time

from dossierkit.llm import names
from dossierkit.llm.names import link_fields, organisation_edits, parse, person_edits

REGISTRY = [
    (1, "Joseph F. Golane", "person", 9, "deldal.invalid"),
    (2, "Penelope T. Golane", "person", 8, "walden.invalid"),
    (3, "Jürgen A. Laning", "person", 8, "walden.invalid"),
    (8, "Walden Olkin Regional Council", "organisation", None, "walden.invalid"),
    (9, "Deldal Packaging, Inc.", "organisation", None, "deldal.invalid"),
]
MEANT = {
    "Golane, Joe": 1, "J.F. GOLANE": 1, "golane joseph": 1, "Hon. Joseph  F Golane, Esq.": 1, "joseph.golane@deldal.invalid": 1,
    "Goalne, P.": 2, "Penny Golane": 2, "Golane, Penn <penelope.golane@walden.invalid>": 2, "Golane, Penelope (Walden)": 2, "Penellope T Golane, MD": 2,
    "JURGEN.LANING@WALDEN.INVALID": 3, "Laning, Jürgen A ": 3, "The Walden Council": 8, "deldal pkg.": 9, "DELDAL": 9, "Deldall Packaging Inc": 9,
}
NONE = ["Hugh Golane", "H. Golane", "Golane", "hugh.golane@deldal.invalid", "joseph.golane@other.test", "Deldal Holdings", "", " ", "Council", "J. Lanning-Smythe"]


def test_spellings(spark):
    rows = [(f"d{i}", [w, None, w], [], None, "x") for i, w in enumerate([*MEANT, *NONE])]
    schema = "id string, authors array<string>, recipients array<string>, custodian array<string>, party_id string"
    docs = spark.createDataFrame(rows, schema)
    registry = spark.createDataFrame(REGISTRY, "party_id long, party_name string, party_kind string, org_party_id long, mail_domain string")
    found = link_fields(docs.union(docs), registry).collect()
    assert {r["written_name"]: r["party_id"] for r in found} == MEANT
    assert len(found) == len(MEANT) and {r["field"] for r in found} == {"authors"}
    assert link_fields(docs, registry.limit(0)).count() == 0
    assert link_fields(docs.limit(0), registry).count() == 0


def test_parts():
    assert parse("Dr. Ann  B Lee, Esq., MD").parts == ("ann", "b", "lee")
    assert parse("Lee, Ann (House)").house == "house"
    assert person_edits(parse("Ann X. Lee"), "Ann B. Lee", "d.test", "") == 9
    assert organisation_edits(parse("Lee Labs"), "Lee Laboratories GmbH", "d.test") == 0


def _link(spark, written, registry):
    docs = spark.createDataFrame([(f"d{i}", [w], [], None) for i, w in enumerate(written)], "id string, authors array<string>, recipients array<string>, custodian array<string>")
    reg = spark.createDataFrame(registry, "party_id long, party_name string, party_kind string, org_party_id long, mail_domain string")
    return {r["written_name"]: r["party_id"] for r in link_fields(docs, reg).collect()}


def test_short_forms_are_learnt(spark):
    """A short form that no list holds, shown beside the mail address of its owner, is known for others of that name too."""
    registry = [(1, "Zbigniew K. Tamsel", "person", None, "one.test"), (2, "Zbigniew A. Corrall", "person", None, "two.test"), (3, "Hugh B. Tamsel", "person", None, "one.test")]
    shown = ["Zbyszek Tamsel <zbigniew.tamsel@one.test>", "Tamsel, Zbyszek (zbigniew.tamsel@one.test)"]
    assert _link(spark, ["Zbyszek Corrall"], registry) == {}
    got = _link(spark, [*shown, "Zbyszek Corrall", "Tamsel, Zbyszek", "Zbyszek Other"], registry)
    assert got["Zbyszek Corrall"] == 2 and got["Tamsel, Zbyszek"] == 1 and "Zbyszek Other" not in got and set(got.values()) == {1, 2}


def test_average_linkage_groups(spark, monkeypatch):
    """Of two parties that fit alike, the one whose cluster a spelling is nearer to; under the threshold none."""
    registry = [(1, "John A. Carholt", "person", None, "a.test"), (2, "Jane B. Carholt", "person", None, "b.test")]
    jane = ["Jane Carholt", "Carholt, Jane B.", "Jane B Carholt"]
    got = _link(spark, [*jane, *(f"{x} Carrholt" for x in ("Jane", "Jane B.")), "J. Carrholt", "John Carholt"], registry)
    assert got["J. Carrholt"] == 2 and got["John Carholt"] == 1
    monkeypatch.setattr(names, "LEAST_LINKAGE", 0.99)
    assert "J. Carrholt" not in _link(spark, [*jane, "J. Carrholt", "John Carholt"], registry)


def test_every_entry_over_the_threshold_is_compared(spark, monkeypatch):
    """More namesakes than any fixed number of nearest entries, over several blocks of the registry."""
    monkeypatch.setattr(names, "ENTRIES", 16)
    letters = "abcdefghijklmnopqrstuvwxyz"
    registry = [(i, f"Q{a}{b}rin {a.upper()}. Golane", "person", None, f"d{i}.test") for i, (a, b) in enumerate((a, b) for a in letters[:10] for b in letters[:10])]
    got = _link(spark, [f"Golane, {name.split()[0]}" for _, name, *_ in registry], registry)
    assert got == {f"Golane, {name.split()[0]}": i for i, name, *_ in registry}


def test_initials_and_long_elements(spark):
    registry = [(1, "Ann B. Lee", "person", None, "a.test"), (2, "Bo C. Ng", "person", None, "b.test")]
    began = time.time()
    for w in ("A" * 200_000, "a " * 100_000 + "@x.test", " ," * 100_000 + "x", "<" * 100_000):
        parse(w)
    assert time.time() - began < 5
    assert _link(spark, ["A.B.L.", "J.", "L", "A. Lee", "Ann Lee" + " " * 3000, "x" * 5000], registry) == {"A. Lee": 1, "Ann Lee" + " " * 3000: 1}
