import hashlib
import random
import re
import zlib

import pytest

from panelcast.llm import conversations
from panelcast.llm.conversations import Repair, damage

BARE = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = BARE.findall(text)[-1:]
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("fine" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """The least cost, audit and repaired lines, by trying all edits."""
    marks, best = faults(rows), None

    def go(i, out, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(role[:1] or "?" for role, _ in out)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, [f"{r}:{t}" for r, t in out])
        if not re.fullmatch(r"s?(ua)*u?", initials) or audit.endswith("III"):
            return
        for role in ("user", "assistant"):
            go(i, [*out, (role, "")], cost + 5, audit + "I")
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, out, cost + 2, audit + "D")
            extra = 5 if marks[i] == "truncated" else 0
            if marks[i] in ("fine", "truncated"):
                go(i + 1, [*out, (role, text)], cost + extra, audit + "K")
                for new in ("user", "assistant"):
                    go(i + 1, [*out, (new, text)], cost + extra + 1, audit + "R")

    # The cost of deleting everything bounds the search from the start.
    best = (2 * len(rows), "D" * len(rows), [])
    go(0, [], 0, "")
    return best


def expected(original):
    out = {}
    for conv in {r[0] for r in original}:
        rows = [r for r in damaged(original) if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks, (cost, audit, lines) = faults(rows), brute(rows)
        turns = {r[1] for r in rows} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(repair):
    rows = repair.digests().collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def random_rows(seed, n_conversations):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "What?", "cut", " ", "", None, "Dots. ", "x.y"]
    rows = []
    for conv in [None, *range(n_conversations)]:
        for turn in range(rng.randint(1, 5)):
            place = rng.choice([turn, turn, turn, None, 3])
            rows.append((conv, place, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("bits", [0, 1, 6])
def test_as_brute_force(spark, scratch, monkeypatch, bits):
    """The same however few rows a block holds."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = random_rows(bits, 40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(Repair(damage(frame), frame, scratch)) == expected(rows)


def test_one_long_conversation(spark, scratch, monkeypatch):
    """Most rows are of one conversation, a third of them alike: they spread over partitions."""
    rows = []
    for turn in range(600):
        rows.append((7, turn, ("user", "assistant")[turn % 2], f"Text {turn}."))
    rows += [(7, 600, "user", "Again.")] * 300
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    frame = spark.createDataFrame(rows, SCHEMA)
    try:
        whole = found(Repair(frame, frame, scratch))[7]
        repair = Repair(frame, frame, scratch)
        kept = [r for r in repair.rows().orderBy("slot").collect() if r["edit"] != "D"]
        monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
        assert found(Repair(frame, frame, scratch))[7] == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    gaps, blank, duplicate, truncated, illegal, cost, audit, digest = whole
    assert (gaps, blank, duplicate, truncated, illegal) == (0, 0, 299, 0, 299)
    assert cost == 299 * 2 + 2 and audit == "K" * 600 + "D" * 300
    assert hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in kept).encode()).hexdigest() == digest


def test_edges(spark, scratch):
    wide = ", codes string, pos long, audits string, goals string, kind int, salt long, mark int"
    rows = [(1, 0, "user", "Long. " * 50_000), (1, 1, "assistant", "Yes."), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3, 4) for r in rows], SCHEMA + wide)
    assert found(Repair(damage(frame), frame, scratch)) == expected(rows)
    assert Repair(damage(frame.limit(0)), frame.limit(0), scratch).digests().count() == 0
    # Conversations without rows are still answered; ids may be text.
    texts = spark.createDataFrame([("a", 0, "user", "Hi.")], SCHEMA.replace("long", "string", 1))
    ids = spark.createDataFrame([("a",), ("b",)], "conv_id string")
    nothing = hashlib.sha256(b"").hexdigest()
    repair = Repair(texts, ids, scratch)
    assert found(repair) == {
        "a": (0, 0, 0, 0, 0, 2, "D", nothing),
        "b": (0, 0, 0, 0, 0, 0, "", nothing),
    }
    assert [tuple(r) for r in repair.rows().collect()] == [("a", 0, "D", "user", "Hi.")]
