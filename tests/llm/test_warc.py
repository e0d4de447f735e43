import gzip
import random

import pytest

from assay.llm import warc
from assay.sources.results import shared_folder


def page(i, body):
    return warc.record(f"urn:page:{i}", "response", f"http://x/{i}", body, warc.hashlib.sha256(body).hexdigest(), len(body))


def read(data):
    good, gaps = [], []
    for start, size, what in warc.salvaged(data):
        if isinstance(what, str):
            gaps.append((start, size, what))
        else:
            good.append(warc.payload_of(what[1]))
    return good, gaps


BODIES = [b"", b"a", b"WARC/1.1\r\nWARC-Type: none\r\n\r\n", b"\x1f\x8b\x08junk" * 9, bytes(range(256)) * 40]


@pytest.mark.parametrize("pack", [lambda r: r, warc.member, lambda r: gzip.compress(r) + b"\0"])
def test_whole_archives_have_no_gaps(pack):
    good, gaps = read(b"".join(pack(page(i, b)) for i, b in enumerate(BODIES)))
    assert good == BODIES and gaps == []


@pytest.mark.parametrize("pack", [lambda r: r, warc.member])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "head"])
def test_records_after_a_broken_one_are_recovered(pack, harm):
    rng = random.Random(harm)
    bodies = [rng.randbytes(300) for _ in range(9)]
    parts = [pack(page(i, b)) for i, b in enumerate(bodies)]
    before = sum(map(len, parts[:4]))
    broken = {
        "flip": lambda p: p[:-60] + bytes([p[-60] ^ 1]) + p[-59:],
        "cut": lambda p: p[: len(p) // 2],
        "junk": lambda p: b"junk WARC/1.1\r\n" + p,
        "head": lambda p: p[20:],
    }[harm](parts[4])
    data = b"".join([*parts[:4], broken, *parts[5:]])
    good, gaps = read(data)
    want = bodies if harm == "junk" else bodies[:4] + bodies[5:]
    assert good == want
    assert sum(size for _, size, _ in gaps) >= 1 and gaps[0][0] == before
    assert all(before <= start < before + len(broken) for start, _, _ in gaps)


def test_gaps_and_records_cover_a_file_of_noise():
    noise = random.Random(1).randbytes(5000)
    good, gaps = read(noise)
    assert good == [] and sum(size for _, size, _ in gaps) == len(noise.lstrip(b"\0"))
    assert read(b"") == ([], [])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")


def test_pages_come_back_and_repeats_are_revisits(spark):
    long, short = "é\n" * 60, "s" * 99
    rows = [(3, "http://a/%41\r\nX: y", long), (1, "u", long), (2, None, long), (4, "u", short), (5, "u", short), (6, "u", None)]
    rows += [(1, "u", long), (None, "u", long), (7, "", "w" * 100), (8, "u", "z" * 3_000_000)]
    got = {(r.record_id, r.url): r for r in warc.round_trip(table(spark, rows)).collect()}
    assert len(got) == len(rows) - 1 and all(r.gap_reason is None for r in got.values())
    kinds = {n: (r.record_type, r.refers_to) for (n, _), r in got.items()}
    assert kinds["urn:page:1"] == ("response", None)
    for name in ("urn:page:2", "urn:page:3", "urn:page:None"):
        assert kinds[name] == ("revisit", "urn:page:1")
    assert all(kinds[f"urn:page:{i}"] == ("response", None) for i in range(4, 9))
    first = got["urn:page:3", "http://a/%41\r\nX: y"]
    assert first.payload is None and first.payload_bytes == len(long.encode())
    assert bytes(got["urn:page:1", "u"].payload) == long.encode()
    assert got["urn:page:6", "u"].payload_bytes == 0
    assert ("urn:page:2", None) in got and ("urn:page:7", "") in got


def test_gaps_are_rows_of_their_own(spark):
    folder = shared_folder(spark)
    warc.write_archives(warc.planned(table(spark, [(i, "u", f"page {i}") for i in range(5)])), folder)
    data = page(99, b"late")
    spread = spark.createDataFrame([(b"no archive" + data,)], "value binary").selectExpr("cast(value as string)")
    spread.write.mode("append").text(folder)
    rows = warc.read_archives(spark, folder).collect()
    gaps = [r for r in rows if r.gap_reason]
    assert len(rows) - len(gaps) == 6 and {r.record_id for r in rows} >= {"urn:page:99"}
    assert any((r.start, r.size) == (0, len(b"no archive")) for r in gaps)


def test_no_pages(spark):
    assert warc.round_trip(table(spark, [])).collect() == []
