import re
from collections import defaultdict

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from edge_cases import edge_docs, no_docs  # noqa: F401

from panelcast.llm.oracle import OP3
from panelcast.llm.quality import Rules, clean, judge


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def judged(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = judge(docs).select("doc_id", "judged.*").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["doc_id"])]


pieces = st.lists(st.sampled_from(["a", "b", "c d e f g h i j", " ", "\n", "\t", "#", "é", "|", "."]))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(pieces.map("".join), min_size=20, max_size=40))
def test_counts(spark, texts):
    for text, row in zip(texts, judged(spark, texts)):
        assert {k: row[k] for k in brute(text)} == brute(text)


PROSE = " ".join(f"word{i}" for i in range(40)) + "."


def test_lines_that_fail(spark):
    lines = [
        PROSE,
        "Home | News | Sport | Contact | Imprint | Search",
        "as%%% that*** thing$$$ here###",
        "BUY!! NOW!! CHEAP!! PILLS!!",
        "All rights reserved.",
        " ".join(f"unmarked{i}" for i in range(30)),
        "A short heading",
        "Licensed under the Apache License, Version 2.0.",
    ]
    assert [r["n_failed_lines"] for r in judged(spark, lines)] == [0, 1, 1, 1, 1, 1, 0, 0]


def test_long_lines_of_other_scripts_and_verse_stay(spark):
    def line(word, end, comma=""):
        return " ".join(f"{word}{i}{comma if i % 9 == 8 else ''}" for i in range(40)) + end

    lines = [line("शब्द", "।"), line("শব্দ", "।"), line("لفظ", "۔"), line("لفظ", "؟")]
    lines += [line("文字", "！"), line("文字", "？"), line("ቃል", "።"), line("verse", "", ",")]
    lines += [line("لفظ", "", "،"), " ".join(["again, and"] * 20), line("unmarked", "")]
    assert [r["n_failed_lines"] for r in judged(spark, lines)] == [0] * 9 + [1, 1]
    rows = judged(spark, [x + "\n" + line("other", "।") for x in lines[:9]])
    assert all(r["kept"] for r in rows)


def test_menus_by_their_separators(spark):
    names = ["Home", "News", "Sport", "Contact", "Imprint"]
    lines = [f" {mark} ".join(names) for mark in "»›·/•→|"] + ["• Home • News • Sport"]
    prose = ["« Oui » , « Non » , « Peut » et « Rien »", "paral·lel col·legi il·lusió", "a · b · c · d"]
    prose += ["read and/or write, yes/no, in/out, on/off", "»Ja« und »Nein« und »Doch« und »Nie«"]
    prose += ["• one bullet before a line of words"]
    found = [r["n_failed_lines"] for r in judged(spark, lines + prose)]
    assert found == [1] * len(lines) + [0] * len(prose)


marks = "»›→▸▶❯•‣∙⋅·/|«‹"
line_pieces = st.lists(
    st.sampled_from(
        [*marks, *(f" {m} " for m in marks), "a", "é b", "文字", " ", "  ", "\x0b", "\t", "\n", "#", "!!"]
        + ["。", "۔", "،", ", ", ".", "word " * 31, PROSE, "x1 x2 x3 " * 11, " ".join("abcdefghijklmnopq"), "Terms of Use"]
    ),
    max_size=14,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line_pieces.map("".join), min_size=60, max_size=80))
def test_the_statement_states_the_rules(spark, texts):
    """Whole texts and the lines of menus, verse and scripts above, judged by the SQL as well."""
    names = ["Home", "News", "Sport", "Contact", "Imprint"]
    texts = texts + [f" {m} ".join(names) for m in marks] + [m.join(names) for m in marks]
    texts += ["paral·lel col·legi il·lusió a·b·c·d", "« Oui » , « Non » , « Peut » et « Rien »", "/ a / / b / c"]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    told = connection.execute(OP3).df().sort_values("doc_id").to_dict("records")
    for text, row, expected in zip(texts, judged(spark, texts), told, strict=True):
        assert {k: row[k] for k in expected} == expected, text


def test_document_that_loses_too_much_goes(spark):
    junk = "Home | News | Sport | Contact | Imprint | Search\n"
    docs = spark.createDataFrame(
        [(1, PROSE + "\n" + junk), (2, PROSE + "\n" + junk * 9)], "doc_id long, text string"
    )
    kept = clean(docs).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(1, PROSE + "\n")]


def test_edges(edge_docs, no_docs):
    done = clean(edge_docs, Rules(repeat_percent=100))
    assert done.columns == edge_docs.columns
    assert sorted(r["doc_id"] or 0 for r in done.collect()) == [0, 1, 1, 2, 5]
    assert judge(edge_docs).count() == edge_docs.count()
    assert judge(no_docs).count() == 0
