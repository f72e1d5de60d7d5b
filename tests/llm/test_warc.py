"""WARC archives: round trip, revisits, and what is salvaged from damaged archives."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from featureline.llm import warc

PAGES = "page_id long, url string, html string, record_type string, offset long"
WHOLE = warc.page_record(7, "http://a/b c", b"x" * 90, None, "2000-01-01T00:00:00Z") + b"\r\n\r\n"


def given(n: int = 60) -> list:
    rng = random.Random(4)
    made = ["".join(rng.choice("ab<>é\n\r\0 WARC/1.1") for _ in range(rng.randint(0, 300))) for _ in range(n)]
    made += ["WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", "", None, made[0], made[0], made[1], "y" * 300_000, "y" * 300_000]
    return [(900 - k, None if k % 7 == 0 else f"http://h/{k}\n é", t, "clash", 5) for k, t in enumerate(made)]


def expected(rows: list, least: int) -> dict:
    first: dict = {}
    for id, _, html, *_ in rows:
        first[html or ""] = min(id, first.get(html or "", id))
    out = {}
    for id, _, html, *_ in rows:
        raw, f = (html or "").encode(), first[html or ""]
        again = f != id and len(raw) >= least
        out[id] = (len(raw), warc.digest_text(raw), "revisit" if again else "response", f if again else None)
    return out


@pytest.mark.parametrize("compress,least", [(True, 0), (False, 0), (True, 200)])
def test_round_trip(spark, folder, compress, least):
    rows = given()
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"{folder}/a", compress=compress, min_bytes=least,
                        records_per_archive=7)
    read = warc.read_archives(spark, f"{folder}/a").withColumns({"id": warc.row_id("record_id"), "refers": warc.row_id("refers_to")}).collect()
    assert not [r for r in read if r.problem] and len(read) == len(rows)
    assert {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers) for r in read} == expected(rows, least)
    texts, urls = {r[0]: r[2] or "" for r in rows}, {r[0]: r[1] for r in rows}
    for r in read:
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == texts[r.id]
        assert r.target_uri == (urls[r.id] and urls[r.id].replace("\n", "%0A").replace(" ", "%20"))
    assert len({r.archive for r in read}) >= len(rows) // 7


def test_nulls_repeated_rows_and_empty_tables(spark, folder):
    rows = [(None, "u", "same", "", 0), (3, "u", "same", "", 0), (2, "v", "same", "", 0), (2, "v", "same", "", 0),
            (None, None, "alone", "", 0), (None, None, "alone", "", 0)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{folder}/a")
    read = warc.read_archives(spark, f"{folder}/a").select("record_type", warc.row_id("record_id"), warc.row_id("refers_to")).collect()
    assert sorted(map(tuple, read), key=str) == sorted([("revisit", None, 2), ("revisit", 3, 2), ("response", 2, None), ("response", 2, None),
                                                        ("response", None, None), ("response", None, None)], key=str)
    warc.write_archives(spark.createDataFrame([], PAGES), f"{folder}/b")
    assert warc.read_archives(spark, f"{folder}/b").count() == 0


def test_large_members_end_with_a_zero_byte():
    for data in (b"", b"x" * (1 << 24), b"y" * ((1 << 24) - 1), bytes(1 << 25)):
        packed = warc.member(data, 1)
        assert packed[-1] == 0
        assert b"".join(iter_members(packed)) == data
    record = warc.page_record(1, None, b"z" * (1 << 24), None, "d") + b"\r\n\r\n"
    found = list(warc.salvage(warc.member(record, 1) + warc.member(WHOLE)))
    assert [r["payload_bytes"] for r in found] == [1 << 24, 90]


def iter_members(data: bytes):
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data)
        data = unpack.unused_data


def archive(n: int, packed) -> tuple[bytes, list[int]]:
    rng = random.Random(n)
    parts = [warc.page_record(k, f"http://x/{k}", rng.randbytes(rng.randint(0, 400)), None, "d") + b"\r\n\r\n" for k in range(n)]
    parts = [warc.member(p) if packed(k) else p for k, p in enumerate(parts)]
    return b"".join(parts), [sum(map(len, parts[:k])) for k in range(n + 1)]


@pytest.mark.parametrize("packed", [lambda k: True, lambda k: False, lambda k: k % 3 == 0])
@pytest.mark.parametrize("seed", range(12))
def test_salvage_after_damage(packed, seed):
    """Whatever is changed, cut out or put in: records outside the damage are read, and gaps with records cover the archive."""
    data, at = archive(25, packed)
    rng = random.Random(seed)
    a = rng.randrange(len(data))
    b = min(len(data), a + rng.choice([1, 30, 700]))
    kind = seed % 3
    if kind == 0:
        broken, moved = data[:a] + bytes(x ^ 0x55 for x in data[a:b]) + data[b:], 0
    elif kind == 1:
        broken, moved = data[:a] + data[b:], a - b
    else:
        b, extra = a, rng.randbytes(50) + b"\x1f\x8b\x08" + b"WARC/1.1\r\nX: y\r\n" + rng.randbytes(50)
        broken, moved = data[:a] + extra + data[a:], len(extra)
    found = list(warc.salvage(broken))
    whole = [k for k in range(25) if at[k + 1] <= a or at[k] >= b]
    got = {r["record_id"]: r["offset"] for r in found if "problem" not in r}
    assert {f"urn:row:{k}": at[k] + (moved if at[k] >= b else 0) for k in whole}.items() <= got.items()
    pos = 0
    for r in found:
        assert r["offset"] == pos
        pos += r["length"]
    assert pos == len(broken)
    if packed(1):  # a plain record's header lines have no checksum
        assert any("problem" in r for r in found) or kind == 1 and a in at and b in at


def test_each_check_has_its_name():
    bad = {"cut off": WHOLE[:-20], "no record end": WHOLE.replace(b"x\r\n\r\n", b"x\r\nyy"), "block digest": WHOLE.replace(b"xxx", b"xyx"),
           "no length": WHOLE.replace(b"\r\nContent-Length: 1", b"\r\nContent-Length: a"), "member check": warc.member(WHOLE)[:-4] + b"aaa\0",
           "header line without a name": WHOLE.replace(b"WARC-Type:", b"WARC-Type"), "no version line": b"?" + WHOLE[1:],
           "member cut off": warc.member(WHOLE)[:-9], "headers without end": WHOLE[:40],
           "payload digest": WHOLE.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")}
    for problem, data in bad.items():
        assert [r.get("problem") for r in warc.salvage(data + WHOLE)] == ([problem, None] if problem not in ("cut off", "headers without end")
                                                                         else [r.get("problem") for r in warc.salvage(data + WHOLE)]), problem
        assert next(warc.salvage(data))["problem"] == problem
    assert list(warc.salvage(b"")) == []


def test_long_rubbish_is_searched_once():
    data = (b"\x1f\x8b\x08" + bytes(50)) * 40_000 + b"WARC/1.0\n" * 40_000
    found = list(warc.salvage(data + WHOLE))
    assert [r.get("problem") is None for r in found] == [False, True] and found[0]["length"] == len(data)


def test_gaps_of_written_archives(spark, folder):
    warc.write_archives(spark.createDataFrame(given(), PAGES).coalesce(1), f"{folder}/a")
    whole = spark.read.format("binaryFile").load(f"{folder}/a").select("content").first().content
    with open(f"{folder}/broken", "wb") as f:
        f.write(whole[:5000] + b"??" + whole[5000:])
    read = warc.read_archives(spark, f"{folder}/broken")
    log = warc.gaps(read).collect()
    assert len(log) == 1 and log[0].problem == "member check" and log[0].offset <= 5000 < log[0].offset + log[0].length
    assert warc.records(read).count() == len(given()) - 1
    assert warc.records(read).where(F.col("record_type") == "response").count() > 0
