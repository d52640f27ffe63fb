import pytest
from pyspark.sql import functions as F
from edge_cases import edge_docs, no_docs  # noqa: F401

from panelcast.llm import mixing
from panelcast.llm.mixing import mix, mixed_rows, targets


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **share}
        capped |= over


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1000, "b": 1, "c": 2, "d": 50, None: 7},
        {"a": 5, "b": 0, "é": 900, "z": 3, "Z": 40},
        {"a": 0},
    ],
)
def test_targets(spark, scratch, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in targets(frame, scratch).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def many(spark, n=6000):
    """A third of the rows in one source."""
    source = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))
    )
    text = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int")), " ")
    return spark.range(n).select(
        F.col("id").alias("doc_id"), source.alias("source"), text.alias("text")
    )


@pytest.mark.parametrize("width", [1, 8, 128])
def test_close_to_the_targets(spark, scratch, width, monkeypatch):
    monkeypatch.setattr(mixing, "WIDTH", width)
    rows = mix(many(spark), scratch).collect()
    taken, target, expected = {}, {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        expected.setdefault(r["source"], r["source_size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert target == pytest.approx(brute_targets(expected))
    for source in target:
        # The sample does not exceed what is missing, and is filled up.
        assert 0 <= target[source] - taken[source] <= 2
    again = mix(many(spark).repartition(5), scratch).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def brute_copies(rows, target, source_size):
    """Copies of the ``(u, doc_id, size)`` rows of one source, sorted and filled one by one."""
    whole = int(target / source_size)
    missing = target - whole * source_size
    digits = {r: len(f"{r[2]:b}") for r in rows if r[2]}
    certain = set()
    while True:
        free = [r for r in digits if r not in certain]
        rest = missing - sum(r[2] for r in certain)
        level = rest / sum(digits[r] * r[2] for r in free) if free else 0.0
        over = {r for r in free if level * digits[r] > 1}
        if not over:
            break
        certain |= over
    odds = {}
    for r in digits:
        p = 1.0 if r in certain else min(1.0, level * digits[r])
        odds[r] = 0.0 if p >= 1 else (r[0] / (1 - r[0])) / (p / (1 - p)) if p > 0 else float("inf")
    ranked = sorted((r for r in digits if odds[r] < float("inf")), key=lambda r: (odds[r], r[1], r[2]))
    taken, left = set(), missing
    for at, r in enumerate(ranked):
        if r[2] > left:
            ranked = ranked[at:]
            break
        taken.add(r)
        left -= r[2]
    above = float("inf")
    for _ in range(3):
        fits = [r for r in ranked if r not in taken and r[2] <= left and r[2] < above]
        if fits:
            longest = max(r[2] for r in fits)
            first = next(r for r in fits if r[2] == longest)
            taken.add(first)
            left, above = left - longest, longest
    return {r[1]: whole + (r in taken) for r in rows}


def lopsided(spark):
    """Sizes over four orders of magnitude, sources of some dozen documents."""
    source = F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))
    count = (F.pow(F.lit(10.0), (F.col("id") * 37 % 100) / 33.0) + F.col("id") % 3).cast("int")
    text = F.array_join(F.array_repeat(F.lit("w"), count), " ")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), source.alias("source"), text.alias("text"))
    return docs.union(spark.createDataFrame([(900, None, "a b c"), (901, "s0", "")], docs.schema))


@pytest.mark.parametrize("build", [many, lopsided])
def test_against_sorting(spark, scratch, build):
    docs = build(spark)
    u = {
        r["doc_id"]: r["u"]
        for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), "mix").alias("u")).collect()
    }
    found, sources = {}, {}
    for r in mix(docs, scratch).collect():
        found[r["doc_id"]] = r["copies"]
        key = (r["source"], r["target"], r["source_size"])
        sources.setdefault(key, []).append((u[r["doc_id"]], r["doc_id"], r["size"]))
    expected = {}
    for (_, target, source_size), rows in sources.items():
        expected.update(brute_copies(rows, target, source_size))
    assert found == expected


def test_longer_documents_are_likelier(spark, scratch):
    """Observed inclusion follows the odds: digits of the size, in proportion."""
    size = F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.lit(200))
    docs = spark.range(8000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 < 2, F.lit("a")).otherwise(F.lit("b")).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), size), " ").alias("text"),
    )
    share = {
        r["size"]: r["share"]
        for r in mix(docs, scratch)
        .filter("source = 'a'")
        .groupBy("size")
        .agg(F.avg("copies").alias("share"))
        .collect()
    }
    # Source a, of weight 1 beside 2, gives two thirds of its words.
    assert share[200] == pytest.approx(0.669, abs=0.01)
    assert share[200] / share[3] == pytest.approx(8 / 2, rel=0.15)


def test_rows_follow_the_copies(spark, scratch):
    docs = many(spark, 600)
    copies = {r["doc_id"]: r["copies"] for r in mix(docs, scratch).collect()}
    found = {}
    for r in mixed_rows(docs, scratch).collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {k: v for k, v in copies.items() if v}


def test_words_are_counted_once_a_text(spark, scratch, capsys):
    """The plan that writes the texts splits them in one place, however often sizes are mentioned."""
    mixed_rows(many(spark, 600), scratch).explain()
    plan = capsys.readouterr().out
    assert "Generate explode" in plan and plan.count("split(") == 1


def test_edges(edge_docs, no_docs, scratch):
    rows = mix(edge_docs, scratch).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["source"] for r in rows} == {"a", "b", None}
    mixed = mixed_rows(edge_docs, scratch)
    assert mixed.columns == edge_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mix(no_docs, scratch).count() == mixed_rows(no_docs, scratch).count() == 0
