import base64
import hashlib
import random

import pyarrow as pa
import pytest

from panelcast.llm import warc


def archive(data, starts=None):
    found = warc.Archive(pa.BufferReader(data), starts)
    found.size = len(data)
    return found


def records(n, rng):
    return [
        warc.record_bytes(i, f"http://x/{i}", rng.randbytes(rng.randint(0, 300)), None)
        for i in range(n)
    ]


def damaged(parts, rng):
    """Parts of which some are changed, cut or preceded by junk, and the numbers of the whole ones."""
    out, whole = [], []
    for i, part in enumerate(parts):
        how = rng.choice(["flip", "cut", "junk", "", "", ""])
        if how == "flip":
            at = rng.randrange(len(part))
            part = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1 :]
        elif how == "cut":
            part = part[: rng.randrange(len(part))]
        elif how == "junk":
            out.append(rng.choice([b"\x1f\x8b\x08junk", b"WARC/1.1\r\nWARC/1.1\r\n\r\n"]))
        if how in ("", "junk"):
            whole.append(i)
        out.append(part)
    return b"".join(out), whole


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(40))
def test_salvage(packed, seed):
    rng = random.Random(seed)
    parts = [warc.member(r) if packed else r for r in records(12, rng)]
    data, whole = damaged(parts, rng)
    found = list(archive(data).salvage(0, len(data)))
    assert set(whole) <= {r["page_id"] for k, _, _, r in found if k == "record"}
    # Records and gaps cover every byte once.
    at = 0
    for _, offset, length, _ in found:
        assert offset == at
        at += length
    assert at == len(data)


@pytest.mark.parametrize("seed", range(20))
def test_known_starts(seed):
    """Ranges of any size give the whole records and the gaps between them, and nothing that a
    payload holds, though payloads are archives themselves."""
    rng = random.Random(seed)
    parts, starts, whole, size = [], [], [], 0
    for i in range(12):
        inner = b"".join(warc.member(r) for r in records(rng.randint(0, 8), rng))
        part = warc.member(warc.record_bytes(900 + i, "http://x", inner, None))
        starts.append(size)
        if rng.random() < 0.25:
            at = rng.randrange(len(part))
            part = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1 :]
        else:
            whole.append(900 + i)
        parts.append(part)
        size += len(part)
    data = b"".join(parts)
    one = [x[:3] for x in archive(data, starts).salvage(0, size)]
    pages = [r["page_id"] for k, _, _, r in archive(data, starts).salvage(0, size) if k == "record"]
    assert set(whole) <= set(pages) <= set(range(900, 912))
    assert sum(length for _, _, length in one) == size
    for step in (64, 1000, 10_000):
        apart = [
            x[:3] for s in range(0, size, step) for x in archive(data, starts).salvage(s, s + step)
        ]
        assert sorted(apart, key=lambda x: x[1]) == one


def test_payloads_that_are_archives(spark, scratch):
    """Random bytes are stored as they are, so whole members lie in the bytes of the archive."""
    rng = random.Random(1)
    payloads = [
        b"".join(
            warc.member(warc.record_bytes(900 + i, "u", rng.randbytes(6000), None)) for i in range(8)
        )
        for _ in range(3)
    ]
    rows = [(i, "http://h", bytearray(p), None) for i, p in enumerate(payloads)]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, payload binary, refers_to long"
    ).coalesce(1)
    manifest = scratch.save(warc.write_archives(pages, scratch.folder("warc")), "manifest")
    assert manifest.first()["n_records"] == len(manifest.first()["starts"]) == 3
    for split in (1000, 10_000, 1 << 24):
        read = warc.read_archives(manifest, split_bytes=split).collect()
        assert sorted((r["kind"], r["page_id"]) for r in read) == [("record", i) for i in range(3)]
    foreign = warc.read_archives(manifest.drop("starts"), split_bytes=10_000).collect()
    assert sorted((r["kind"], r["page_id"]) for r in foreign) == [("record", i) for i in range(3)]


def brute(pages, least):
    first = {}
    for page_id, html in pages:
        if page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    rows = []
    for page_id, html in pages:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        own = len(html) < least or first.get(html, page_id) == page_id
        kind = "response" if own else "revisit"
        rows.append((page_id, len(html), digest, kind, None if own else first[html]))
    return sorted(rows, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, scratch, least):
    """Copies, empty and null payloads, payloads like archives, null ids, repeated rows, small files."""
    like = "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    texts = ["<p>é</p>", "", None, like, "x\r\n\r\ny", "abc", "abc", "<p>é</p>", "z" * 100_000]
    rows = [(i, f"http://h/{i}", t, "x") for i, t in enumerate(texts * 20)]
    rows += [rows[3], (None, None, "abc", None), (None, "u\r\nX: y", "only here", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sum string")
    written = warc.write_archives(
        warc.with_revisits(pages.repartition(3), least), scratch.folder("warc"), archive_bytes=3000
    )
    manifest = scratch.save(written, "manifest")
    assert manifest.count() > 3
    read = warc.read_archives(manifest, split_bytes=500).collect()
    assert {r["kind"] for r in read} == {"record"}
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = sorted((tuple(r[n] for n in names) for r in read), key=str)
    assert found == brute([(i, (h or "").encode()) for i, _, h, _ in rows], least)
    stored = {bytes(r["payload"]) for r in read if r["record_type"] == "response"}
    assert stored == {(t or "").encode() for _, _, t, _ in rows}


def test_empty(spark, scratch):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    written = warc.write_archives(warc.with_revisits(pages), scratch.folder("warc"))
    manifest = scratch.save(written, "manifest")
    assert warc.read_archives(manifest).count() == 0


def test_gaps_are_logged(spark, tmp_path):
    rng = random.Random(4)
    parts = [warc.member(r) for r in records(3, rng)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"noise" + parts[1] + parts[2][:-9])
    size = (tmp_path / "a.warc.gz").stat().st_size
    manifest = spark.createDataFrame(
        [(f"file://{tmp_path}/a.warc.gz", size)], "path string, n_bytes long"
    )
    rows = warc.read_archives(manifest, split_bytes=64).orderBy("offset").collect()
    assert [(r["kind"], r["page_id"]) for r in rows] == [
        ("record", 0), ("gap", None), ("record", 1), ("gap", None),
    ]
    assert rows[1]["length"] == 5 and rows[3]["length"] == len(parts[2]) - 9
