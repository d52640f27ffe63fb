import random
import re

import pytest
from edge_cases import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from panelcast.llm.pii import (
    KINDS,
    Selection,
    as_text,
    find_spans,
    look_through,
    redact,
    wide_matches,
)

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(
            int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d))
            for i, d in enumerate(reversed(digits))
        )
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (KINDS.index(k), m.start(), m.end())
        for k, pattern in BASE.items()
        for m in re.finditer(pattern, text)
        if passes(k, m[0])
    ]


def test_base_spans():
    rng = random.Random(5)
    parts = ["a", "@", "b.c", "1", "12", "255", "256", ".", "+", "-", " ", "(", ")", "4111", "1111"]
    parts += ["_", "%", "\n", "é", "0001", "00000000000000255"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert look_through(text)[0] == sorted(brute(text)), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000])
def test_hostile_texts(text):
    look_through(text)


@pytest.fixture
def corpus(spark):
    """Phones with and without their plus, numbers that are none, and clean texts."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        number = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        wrong = f"{rng.randint(300, 999)}.{rng.randint(0, 255)}.{rng.randint(256, 999)}.7"
        text = [f"call +1 {number} now", f"version {wrong} of it", "nothing in here, really"][i % 3]
        rows.append((i, text))
    rows += [(1000, "call (415) 555-2671 now"), (1001, "mail me@example.com, not us")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_candidates_add_to_the_base(corpus, scratch):
    spanned, base, added = find_spans(corpus, scratch)
    rows = spanned.select("*", as_text(F.col(added)).alias("more")).collect()
    for row in rows:
        found = [(s["kind"], s["start"], s["stop"]) for s in row[base]]
        assert found == sorted(brute(row["text"]))
    more = {r["doc_id"]: r["more"] for r in rows if r["more"]}
    assert more == {1000: "phone:5:19"}


def test_too_few_labels_are_refused(corpus, scratch):
    with pytest.raises(ValueError):
        find_spans(corpus, scratch, Selection(least_labelled=10_000))


def brute_runs(text):
    """Every sequence of whole digit groups of 7 to 19 digits, over all pairs of places."""
    out = set()
    for run in re.finditer(r"[0-9]+(?:[ ().\-/_]{1,3}[0-9]+)*", text):
        groups = [m.span() for m in re.finditer("[0-9]+", run[0])]
        for i, (start, _) in enumerate(groups):
            for _, stop in groups[i:]:
                n = sum(c.isdigit() for c in run[0][start:stop])
                at = run.start() + start
                opened = at > 0 and text[at - 1] == "(" and ")" in run[0][start:stop]
                if 7 <= n <= 15:
                    out.add((3, at - opened, run.start() + stop))
                if 13 <= n <= 19 and not run[0][start:stop].isdigit():
                    out.add((2, at, run.start() + stop))
    return out


def test_any_number_of_groups_is_proposed():
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice("0123456789 .-(x)") for _ in range(rng.randint(5, 60)))
        assert set(wide_matches(text)) == brute_runs(text)
    for n in range(7, 20):
        digits = " ".join("1" * n)
        assert any(k[1:] == (5, 5 + len(digits)) for k in wide_matches(f"call {digits} now"))


def test_long_names_and_many_groups(spark, scratch):
    """No part of an address stays because it is long, no part of a number because of its groups."""
    name = "a" * 80
    rows = [(f"mail {name} at host dot com now",), ("call 00 33 1 23 45 67 89 now",)]
    done = redact(spark.createDataFrame(rows, "text string"), scratch)
    assert sorted(r["text"] for r in done.collect()) == ["call [PHONE] now", "mail [EMAIL] now"]


def test_a_text_gets_the_same_spans_in_any_corpus(spark, corpus, scratch):
    alone = spark.createDataFrame([(1000, "call (415) 555-2671 now")], "doc_id long, text string")
    spanned, _, added = find_spans(alone, scratch)
    assert [r["more"] for r in spanned.select(as_text(F.col(added)).alias("more")).collect()] == [
        "phone:5:19"
    ]


def test_wide_forms_are_found_and_numbers_are_not(spark, scratch):
    found = {
        "call us: 415-555-2671 today": "phone:9:21",
        "phone 415.555.2671 or write": "phone:6:18",
        "call 1-800-555-0199, free": "phone:5:19",
        "server 2001:db8::1 is up": "ip:7:18",
        "write to me at host dot com, please": "email:9:27",
        "mail info ( at ) firma.de now": "email:5:25",
        "contact: Anna[AT]example[DOT]org": "email:9:32",
        "card 4111.1111.1111.1111 was paid": "card:5:24",
    }
    none = ["on 2020-01-15 it", "from 1990-1995 on", "version 4.15.300.7 of", "at 12:30:45 sharp"]
    none += ["he looked at example.com and", "std::vector and a::b", "id 00:1a:2b:3c:4d:5e"]
    rows = [(t,) for t in [*found, *none]]
    spanned, _, added = find_spans(spark.createDataFrame(rows, "text string"), scratch)
    more = {r["text"]: r["m"] for r in spanned.select("text", as_text(F.col(added)).alias("m")).collect()}
    assert more == {**found, **dict.fromkeys(none, "")}


def test_redacted(corpus, scratch):
    rows = {r["doc_id"]: r["text"] for r in redact(corpus, scratch).collect()}
    assert rows[0] == "call [PHONE] now" and rows[1000] == "call [PHONE] now"
    assert rows[1001] == "mail [EMAIL], not us" and rows[2] == "nothing in here, really"


def test_edges(edge_docs, no_docs, scratch):
    done = redact(edge_docs, scratch)
    assert done.columns == edge_docs.columns
    texts = lambda frame: sorted(r["text"] or "" for r in frame.collect())
    assert texts(done) == texts(edge_docs)
    assert redact(no_docs, scratch).count() == 0
