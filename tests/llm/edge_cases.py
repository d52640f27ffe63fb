import pytest

# Columns that the operators use themselves, of other types.
NAMES = "uid fp found judged size u own b of_uid chosen first_id first_fp found_ least root node".split()
NAMES += "base_spans added_spans candidates spans kind ids token_ids copy strict soft uid_ fp_".split()
CLASHES = ", ".join(f"{name} string" for name in NAMES)


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    long_text = "long words go on and on in many lines.\n" * 3000
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    words += "fifteen sixteen seventeen eighteen nineteen twenty."
    rows = [
        (1, words, "en", "a", len(words)),
        (1, words, "en", "a", len(words)),
        (2, words, "en", "b", len(words)),
        (3, "", "en", "a", 0),
        (4, None, "en", "a", None),
        (5, long_text, None, None, len(long_text)),
        (6, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (None, words + " more", "en", "b", None),
        (None, None, None, None, None),
    ]
    extra = tuple(f"own {name}" for name in NAMES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
