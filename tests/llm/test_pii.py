"""Personal data in text."""

from __future__ import annotations

import pytest

from fluxloom.llm import pii, registry

GIVEN = ["Anna", "Hugo", "Paul", "Lena", "Peter", "Marta", "Eva", "Karl"]
FAMILY = [h + t for h in ("Tarn", "Vel", "Bren", "Osk") for t in ("hurst", "wick", "dorf", "vold")]
PHONES = ["07700 900 {}", "+44 7700 900{}", "(412) 555-0{}", "1-412-555-0{}"]


def corpus():
    """Sentences whose wording tells what is personal in them, and sentences with look-alikes."""
    out = []
    for k in range(240):
        g, f, n = GIVEN[k % 8], FAMILY[(k * 5) % 16], k
        out.append(f"I spoke with Mr {g} {f} twice. The filter broke in {n % 9} days.")
        out.append(f"Order {1000 + n}-{690304 + n} came in two boxes. Regards, {g} {f}")
        out.append(f"Part no. {130 + n}-{10 + n % 80}-{5000 + n} fits the zip too. Call me on {PHONES[k % 4].format(100 + n)} after six.")
        out.append(f"They even asked for my SSN {900 + n % 90}-{10 + n % 80}-{1000 + n} to process a refund. Checked on {n % 27 + 1}.1.2021.")
        out.append(f"Return address: {n + 1} Mill Race Lane, Tarnfield, QX {10000 + n}. Write to {g.lower()}.{f.lower()}@mail.example if you want.")
        out.append(f"The Toen {g} edition has a bigger lid. Der Filter riecht. signed: {f}, {g}")
    return out


@pytest.fixture(scope="module")
def model():
    return pii.fit(corpus())


CASES = [
    ("I spoke with Mr Anna Velwick twice.", [("person", "Anna Velwick")]),
    ("thanks to anna velwick, and to H. Brendorf!", [("person", "anna velwick"), ("person", "H. Brendorf")]),
    ("— Oskvold, Marta", [("person", "Oskvold, Marta")]),
    ("Regards, Eva von Tarnhurst", [("person", "Eva von Tarnhurst")]),
    ("The Toen Anna edition has a bigger lid.", []),
    ("mail peter.velwick at example dot com for it", [("email", "peter.velwick at example dot com")]),
    ("Contact: A_B@POST.TEST, or v_d[at]post.test.", [("email", "A_B@POST.TEST"), ("email", "v_d[at]post.test")]),
    ("Call me on (412) 555-0192 or +44 7700 900521.", [("phone", "(412) 555-0192"), ("phone", "+44 7700 900521")]),
    ("They even asked for my SSN 944-55-2330 to", [("id_number", "944-55-2330")]),
    ("Part no. 144-55-2330 fits the zip too.", []),
    ("Order 4946-690304 came in two boxes.", []),
    ("Return address: 85a Cinder Road, Lower Drayle, XQ1 4ZZ", [("address", "85a Cinder Road, Lower Drayle, XQ1 4ZZ")]),
    ("I live at 100 mill race ave, ostmere 98342, no parcel came.", [("address", "100 mill race ave, ostmere 98342")]),
    ("Ich wohne in der Alte Mühlgasse 144a, 00943 Quillstedt.", [("address", "Alte Mühlgasse 144a, 00943 Quillstedt")]),
    ("J'habite 182 bis avenue du Vieux Puits, 00856 Sarmette.", [("address", "182 bis avenue du Vieux Puits, 00856 Sarmette")]),
    ("Vivo en Calle del Olmar 230, 3º B, 00340 Villarco.", [("address", "Calle del Olmar 230, 3º B, 00340 Villarco")]),
    ("", []),
    ("★ 😀 \n\n", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_segments(model, text, want):
    got = pii.best_segments(text, model)
    assert [(k, text[s:e]) for s, e, k in got] == want


def test_positions_are_code_points(model):
    text = "😀😀 Regards, Anna Velwick"
    assert pii.best_segments(text, model) == [(12, 24, "person")]


def test_segments_never_overlap(model):
    for text in corpus()[:300]:
        spans = pii.best_segments(text, model)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_held_out_accuracy():
    texts = corpus()
    model = pii.fit(texts[:900])
    hits = wrong = missed = 0
    for text in texts[900:]:
        for group in pii._clusters(pii.candidates(text, model)):
            group = sorted(group, key=lambda c: c[1])
            gold = pii._label(text, group, model)
            if gold is None:
                continue
            want = {c[:3] for c, g in zip(group, gold) if g}
            got = {s for s in pii.best_segments(text, model) if any(s[0] >= c[0] and s[1] <= c[1] for c in group)}
            hits, wrong, missed = hits + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert hits > 300 and wrong + missed < 0.02 * hits


def test_operator_and_redaction(spark, model):
    docs = spark.createDataFrame([(1, "I spoke with Mr Anna Velwick twice.", "x"), (2, None, "x"), (3, "", "x"), (4, "Regards, Hugo Oskdorf " + "ok " * 30_000, "x"), (1, "I spoke with Mr Anna Velwick twice.", "x")], "doc_id long, text string, kind string")
    got = [tuple(r) for r in pii.find_personal_data(docs, model).collect()]
    assert sorted(got) == [(1, "person", 16, 28), (1, "person", 16, 28), (4, "person", 9, 21)]
    clean = {r["doc_id"]: (r["text"], r["n_found"]) for r in pii.redact(docs, model).collect()}
    assert clean[1] == ("I spoke with Mr [PERSON] twice.", 1) and clean[2] == (None, 0) and clean[3] == ("", 0)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_names_of_unsampled_and_long_texts_are_known(spark):
    texts = corpus()[:60] + ["I spoke with Mr Anna Quillmere twice. " + "ok " * 2000, "thanks to anna quillmere, and good night"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = pii.train_model(docs, sample_docs=20)
    assert "quillmere" in model.family and {f.lower() for f in FAMILY[:12:5]} <= model.family and (model.given, model.family) == pii._name_lists(*pii._cued_names(texts))
    found = {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in pii.find_personal_data(docs, sample_docs=20).collect() if r["kind"] == "person"}
    assert (61, 10, 24) in found


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0
