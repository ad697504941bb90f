import itertools

import numpy as np
import pytest

from veritide.llm import pii

NAMES = ["Harold Pemberton-Vance", "Dana Ruiz", "Zoë van der Berg", "Sam O'Neil"]
FRAMES = ["{}", "{} | Finance", "I spoke with {} about it.", "My name is {} and I run the desk.", "Best regards, {}", "It was {}'s seat that vanished.", "The Bank File and the Board Summary never reach {}."]
PLAIN = ["The Board Summary hides the Consent Flag.", "Das neue Postfach sendet zweimal die Freigabe der Kasse.", "Please send it before Friday.", "The Silver Birch Choir Association grant will close in May.", "Thanks for the Report."]


@pytest.fixture(scope="module")
def model(spark):
    texts = [(f.format(n),) for f in FRAMES for n in NAMES for _ in range(3)] + [(p,) for p in PLAIN * 12]
    return pii.fit(spark.createDataFrame(texts, "text string"), spark.createDataFrame([(n,) for n in NAMES], "name string"))


CASES = [
    ("Write to <a.b+c@x.example.org>, or to d (at) y.example, e[at]z[dot]test, f at q dot example dot com, g​.h＠w.test.", [("EMAIL", t) for t in ("a.b+c@x.example.org", "d (at) y.example", "e[at]z[dot]test", "f at q dot example dot com", "g​.h＠w.test")]),
    ("Ping @chapters-desk or look in the ops@ folder at 5.", []),
    *[(f"Call {p} now", [("PHONE", p)]) for p in ("+1 612 555 0147", "(612) 555-0147", "612.555.0147", "612‑555‑0147", "1-612-555-0147", "6125550147", "+44 20 7946 0730", "+49 (0)30 23125 576", "030/23125533", "01 99 00 10 48", "(01632) 960117", "(02) 5550 1075", "020 7946 0681", "0049 30 23125 417", "+1 326 555 0199")],
    ("Row 555 of 52164, column 0147. Ratio 415.555.2. Case 000071870 and call 7712139121398, order 652818715, at 2026-09-20T15:00:00Z, build 20260114, batch 999-19-9369X, SKU QX 57 12, INV-2026-18891.", []),
    ("SSN: 948-46-4467; my social is 957 39 2127; DNI 92756090-B; NI number QQ 05 89 41 C; passport no. AL7124405; DL# K819-6331-3029.", [("ID", t) for t in ("948-46-4467", "957 39 2127", "92756090-B", "QQ 05 89 41 C", "AL7124405", "K819-6331-3029")]),
    ("At 4821 Larkspur Lane, Apt 3.", [("ADDRESS", "4821 Larkspur Lane")]), ("Flat 26, 160 Pear Orchard Court, T.", [("ADDRESS", "Flat 26, 160 Pear Orchard Court")]), ("At 108 rue des Tilleuls, 84113 V.", [("ADDRESS", "108 rue des Tilleuls")]),
    ("An Calle del Olmo 16, 4.º B.", [("ADDRESS", "Calle del Olmo 16")]), ("Anschrift: Alte Mühlenstr. 93, 46882 N.", [("ADDRESS", "Alte Mühlenstr. 93")]), ("zu Glockengasse 158a, dann", [("ADDRESS", "Glockengasse 158a")]), ("We use 504 seats on the Street Fair and Way Finding plans.", []),
    ("I spoke with Dana Ruiz about it.", [("NAME", "Dana Ruiz")]), ("I spoke with Ruiz, Dana about it.", [("NAME", "Ruiz, Dana")]), ("dana ruiz", [("NAME", "dana ruiz")]), ("Dr. Ruiz signed.", [("NAME", "Ruiz")]), ("ZOË VAN DER BERG | Finance", [("NAME", "ZOË VAN DER BERG")]), ("Dana K. Ruiz (she/her)", [("NAME", "Dana K. Ruiz")]),
    ("Dana's phone", [("NAME", "Dana")]), ("Sam O'Neil <d.ruiz@x.test>", [("NAME", "Sam O'Neil"), ("EMAIL", "d.ruiz@x.test")]), ("I spoke with Dana Quillmark about it.", [("NAME", "Dana Quillmark")]), ("The Silver Birch Choir Association grant will close in May.", []), ("Room 3B", []), ("", []), (" \n", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_items(model, text, want):
    assert [(k, text[a:b]) for a, b, k in pii.Field(model)(text)] == want


def test_unregistered_people_are_found_in_new_sentences(model):
    scan = pii.Field(model)
    found = sum(any(k == "NAME" for _, _, k in scan(f"I spoke with Dana {s} about it.")) for s in ("Ashgrove", "Tolmarsh", "Berrywick", "Oldcastle"))
    assert found == 4


def test_messages_equal_enumeration_on_a_chain():
    """On a tree message passing is exact: beliefs against the sum over all labellings."""
    rng = np.random.default_rng(1)
    unary, edge = rng.normal(size=(3, len(pii.LABELS))), rng.normal(size=(4, len(pii.LABELS), len(pii.LABELS)))
    edges = np.array([(0, 1, pii.NEXT), (1, 2, pii.EQUAL)])
    got = pii.beliefs(unary, edges, edge, 60)
    weight = lambda l: np.exp(sum(unary[i, x] for i, x in enumerate(l)) + sum(edge[t, l[a], l[b]] for a, b, t in edges))
    every = list(itertools.product(range(len(pii.LABELS)), repeat=3))
    for i in range(3):
        want = np.array([sum(weight(l) for l in every if l[i] == k) for k in range(len(pii.LABELS))])
        p = np.exp(got[i] - got[i].max())
        assert p / p.sum() == pytest.approx(want / want.sum(), abs=0.01)


def test_a_clear_mention_settles_a_doubtful_one(model):
    scan = pii.Field(model)
    text = "Reach Quillmark soon. I spoke with Dana Quillmark about it. Dr. Quillmark agreed."
    assert [text[a:b] for a, b, _ in scan(text)][-1] == "Quillmark" and len(scan(text)) >= 2


def test_redaction_and_frames(spark, model):
    df = spark.createDataFrame([(1, "x", "I spoke with Dana Ruiz about a@b.example."), (1, "x", "I spoke with Dana Ruiz about a@b.example."), (2, None, None), (3, "y", ""), (4, "z", "filler text " * 20000 + "a@b.example")], "src long, entity text, text string".replace("entity text", "start string"))
    red = {r.src: r.redacted for r in pii.redact(df, model).collect()}
    assert red[1] == "I spoke with [NAME] about [EMAIL]." and red[2] is None and red[3] == "" and red[4].endswith("[EMAIL]")
    got = sorted(tuple(r)[:3] for r in pii.find(df, model).select("src", "entity_type", "start_char").collect())
    assert got == [(1, "EMAIL", 29), (1, "EMAIL", 29), (1, "NAME", 13), (1, "NAME", 13), (4, "EMAIL", 240000)]
    assert pii.find(df.limit(0), model).count() == 0


def test_scrubbed_text_has_no_items_left(model):
    scan = pii.Field(model)
    for text, _ in CASES:
        for a, b, k in reversed(scan(text)):
            text = f"{text[:a]}[{k}]{text[b:]}"
        assert scan(text) == []


def test_empty_register(spark):
    none = spark.createDataFrame([], "name string")
    m = pii.fit(spark.createDataFrame([("Some text.",)], "text string"), none)
    assert [k for _, _, k in pii.Field(m)("Call 612-555-0147")] == ["PHONE"]
    m = pii.fit(none.toDF("text"), none)
    assert [k for _, _, k in pii.Field(m)("Call 612-555-0147")] == ["PHONE"]


def test_a_register_beyond_the_bound_gives_the_same_items(spark):
    """Words looked up by a join instead of a broadcast."""
    rows = [(i, f.format(n)) for i, (f, n) in enumerate(itertools.product(FRAMES, NAMES))] + [(i + 100, p) for i, p in enumerate(PLAIN * 3)] + [(900, None), (901, ""), (902, PLAIN[0])]
    df, names = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string")
    small, large = pii.fit(df, names), pii.fit(df, names, max_register=1)
    assert "names" in large and not large["register"]["given"]
    assert np.allclose(small["weights"], large["weights"])
    got = [sorted(tuple(r) for r in pii.find(df, m).collect()) for m in (small, large)]
    assert got[0] == got[1] and len(got[0]) >= len(FRAMES) * len(NAMES)
    assert sorted((r.k, r.redacted) for r in pii.redact(df, large).collect() if r.redacted) == sorted((r.k, r.redacted) for r in pii.redact(df, small).collect() if r.redacted)


@pytest.fixture(scope="module")
def corpus(spark, data):
    from veritide.sources.tables import table

    d = data.replace("sf0.001", "sf0.01")
    texts = [r.text for r in pii.texts(table(spark, d, "raw_cases", "row_no", "comments"), table(spark, d, "gong_call", "doc_no", "participants")).collect() if r.text.strip()]
    names = [r[0] for r in spark.read.parquet(f"{d}/pii_names.parquet").collect()]
    return texts[::2], texts[1::2], names


def test_people_are_found_with_the_register_withheld(corpus):
    """Held-out texts, no word of the register known when scanning: at least 0.9 of the names are still found."""
    fit, held, names = corpus
    m = pii.train(fit, pii.read_register(names))
    blind = m | {"register": {"given": set(), "surname": set(), "full": set()}}
    items = lambda model: {(i, a, k) for i, hits in enumerate(pii.Field(model).spans(held)) for a, _, k in hits}
    want, got = items(m), items(blind)
    names_of = lambda s: {x for x in s if x[2] == "NAME"}
    assert len(names_of(want) & names_of(got)) >= 0.9 * len(names_of(want)) and len(names_of(want) & names_of(got)) >= 0.9 * len(names_of(got))
    assert want - names_of(want) == got - names_of(got)


def test_edges_raise_recall_on_unregistered_people(corpus):
    """Ablation: a person named clearly once and doubtfully far off; without edges the doubtful mention is lost more often."""
    fit, _, names = corpus
    m = pii.train(fit, pii.read_register(names))
    people = ["Quillmark", "Tolmarsh", "Berrywick", "Oldcastle", "Fernhollow", "Ashgrove", "Ravenshaw", "Thistlewood"]
    doubt = ["{} rejected the form.", "The list went to {} again.", "{} closes the month early.", "Forms by {} are late."]
    texts = [f"I spoke with Dana {p} about it. " + "The waitlist rule hides the late fee. " * 8 + d.format(p) for p in people for d in doubt]

    def recall(edges: bool) -> float:
        f = pii.Field(m)
        if not edges:
            f.edge = np.zeros_like(f.edge)
        return sum(any(a > 60 and t[a:b] in people for a, b, k in hits if k == "NAME") for t, hits in zip(texts, f.spans(texts))) / len(texts)

    with_edges, without = recall(True), recall(False)
    assert with_edges > without, (with_edges, without)


def test_a_number_written_again_keeps_its_type(model):
    """Skip edges between equal numbers: the second mention has no label of its own."""
    scan = pii.Field(model)
    text = "SSN: 948-46-4467 is on file. " + "The import stops. " * 10 + "We found 948464467 twice."
    assert [k for *_, k in scan(text)] == ["ID", "ID"] and scan("We found 948464467 twice.") == []
