import random
import re

import numpy as np
import xxhash
from edge_cases import edge_docs, no_docs  # noqa: F401

from panelcast.llm.components import component_roots
from panelcast.llm.simhash_dedup import drop_near_copies, fingerprint_digits, near_groups, near_links


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle, seed=42)
        for b in range(64):
            votes[b] += value >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_groups(values, links):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def near_pairs(values, bits=2):
    array = np.array(values, dtype=np.int64).view(np.uint64)
    for i, v in enumerate(array):
        for j in np.nonzero(np.bitwise_count(array[i + 1 :] ^ v) <= bits)[0]:
            yield values[i], values[i + 1 + int(j)]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_links_connect_what_brute_force_connects(spark, scratch):
    """Chains, a crowd of over 256 values that agree outside two bytes, and values at three bits."""
    rng = random.Random(1)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            values.add(v)
    values |= {0xABCD << 24 | rng.getrandbits(16) for _ in range(900)}
    values = sorted(signed(v) for v in values)
    links = near_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    rows = [(r["u"], r["v"]) for r in links.collect()]
    assert set(map(tuple, map(sorted, rows))) <= set(map(tuple, map(sorted, near_pairs(values))))
    assert len(rows) < 28 * len(values)
    expected = brute_groups(values, near_pairs(values))
    assert brute_groups(values, rows) == expected
    roots = {r["node"]: r["root"] for r in component_roots(links, scratch).collect()}
    assert {v: roots.get(v, v) for v in values} == expected


def test_groups(spark, scratch, edge_docs, no_docs):
    rows = near_groups(edge_docs, scratch).withColumn("hex", fingerprint_digits("fp")).collect()
    texts = [r["text"] for r in edge_docs.collect()]
    assert sorted(r["hex"] for r in rows) == sorted(
        format(brute_fingerprint(t), "016x") for t in texts
    )
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[1] == by_id[2] == {1}
    # Texts without words are one group, in which a null id does not count.
    assert by_id[3] == by_id[4] == by_id[6] == {3} and 3 in by_id[None]
    assert near_groups(no_docs, scratch).count() == 0


def test_one_of_each_group_stays(edge_docs, no_docs, scratch):
    kept = drop_near_copies(edge_docs, scratch)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["component_id"] for r in near_groups(edge_docs, scratch).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == groups
    assert drop_near_copies(no_docs, scratch).count() == 0


def test_groups_with_the_same_or_no_id_keep_a_document_each(spark, scratch):
    texts = [
        "a quick brown fox jumps over the lazy dog",
        "rain fell on the quiet harbour all through the night",
        "seven tall ships sailed west before the winter storms came",
        "the library opens at nine and closes late on fridays",
        "bread rises slowly in a cold kitchen near the window",
    ]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2])]
    rows += [(7, texts[3]), (7, texts[4]), (8, texts[4]), (9, texts[0])]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    assert sorted((r["text"], r["doc_id"]) for r in kept.collect()) == sorted(
        zip(texts, [9, None, None, 7, 7])
    )


def test_a_chain_is_one_component(spark, scratch):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (5, 4), (1001, 1002)]
    roots = component_roots(spark.createDataFrame(edges, "u long, v long"), scratch)
    found = {r["node"]: r["root"] for r in roots.collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 1002: 1001}


def test_texts_pass_one_shuffle_on_the_way_to_what_stays(spark, scratch):
    """Which row stays is found among narrow rows; the texts are joined once, never aggregated."""
    text = "one two three four five"
    rows = [(7, text, "a", "x"), (7, text, "a", "x"), (9, text, "b", "y"), (8, "six seven", "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, first_place string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = drop_near_copies(docs, scratch)
        plan = kept._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert sum("text#" in columns for columns in shuffled) == 1
        assert not re.search(r"first\w*\(text#", plan)
        assert sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
