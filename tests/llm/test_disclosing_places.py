"""Disclosing terms are marked wherever they stand, however short."""

from hitloom.llm import pii


def test_every_place_of_a_term_is_marked(spark, documents):
    far = " ".join(["the weather is fine and many talk about it today"] * 3)
    texts = [f"Zorbulon wrote from jo@x.org about weather again {far}" for _ in range(12)]
    texts[0] += " ZORBULON too"
    texts += ["Zorbulon is here today", "nothing here"] + [f"{far} again {i}" for i in range(200)]
    rows = {r.doc_id: r.text for r in pii.redact(documents(*texts)).collect()}
    assert all("zorbulon" not in t.lower() for t in rows.values())
    assert rows[12] == "[term] is here today" and rows[13] == "nothing here"


def test_short_names_and_digits_disclose(spark, documents):
    texts = [f"Li K9 jo@x.org and the weather of day {i}" for i in range(12)] + [f"and the weather of day {i} is fine" for i in range(200)] + ["Li met K9"]
    rows = {r.doc_id: r.text for r in pii.redact(documents(*texts)).collect()}
    assert rows[212] == "[term] met [term]" and rows[0] == "[term] [term] [email] and the weather of day 0"


def test_places_lie_outside_of_spans():
    text = "jo mail jo@x.org and org by jo"
    found = pii.places(text, pii.base_spans(text), lambda h: True)
    assert [text[a:b] for _, a, b in found] == ["jo", "mail", "and", "org", "by", "jo"]


def test_letters_that_grow_in_lower_case(spark, documents):
    """A dotted capital I is two characters in lower case; the word is one nonetheless."""
    texts = [f"İzmirli wrote jo@x.org and the weather of day {i}" for i in range(6)] + [f"and the weather of day {i} is fine" for i in range(200)] + ["there was İzmirli"]
    rows = {r.doc_id: r.text for r in pii.redact(documents(*texts)).collect()}
    assert rows[206] == "there was [term]" and all(rows[i].startswith("[term] [term] [email]") for i in range(6))
