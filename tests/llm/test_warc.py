"""WARC archives (operator 2): round trip, revisits, and magic inside payloads."""

import hashlib

import pytest

from postlens.llm import common, warc

DDL = "page_id long, url string, html string, size long, offset string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
LONG = "<p>" + "é" * 60 + "</p>"


def rows():
    out = [(i, f"http://x/{i}%20\r\n{i}", f"<html>{i}</html>" * (i % 40), 1, "x") for i in range(60)]
    out += [(1000 + i, None, LONG, 1, "x") for i in range(30)] + [(999, "u", LONG, 1, "x"), (999, "u", LONG, 1, "x")]
    out += [(2000 + i, "u", "short", 1, "x") for i in range(3)] + [(3000, "u", None, 1, "x"), (3001, "u", "", 1, "x")]
    out += [(4000 + i, "u", "a" * i + FAKE * (i + 1) + "WARC/1.1\r\n", 1, "x") for i in range(6)]
    out += [(None, "n", "null id " * 30, 1, "x"), (None, "n", "null id " * 30, 1, "x"), (5000, "u", "x" * 9000, 1, "x")]
    # a payload whose fake record points exactly at the true next boundary
    out += [(6000, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", 1, "x"), (6001, "u", "\r\n\r\nWARC/1.1\r\n", 1, "x")]
    return out


def expected(data):
    first = {}
    for p, _, h, *_ in data:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, u, h, *_ in data:
        b = (h or "").encode()
        again = len(b) >= 100 and (h in first) and p != first[h]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None,
                    u or "", b"" if again else b))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [64, 700, 1_000_000])
def test_round_trip(spark, range_bytes):
    data = rows()
    out = common.run_dir(spark, "t2") + "/warc"
    warc.write_warc(spark.createDataFrame(data, DDL).repartition(3), out)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_warc(spark, out, range_bytes, with_payload=True).collect()]
    assert sorted(got, key=repr) == expected(data)


def test_rejects_candidates_in_payloads(spark):
    out = common.run_dir(spark, "t2") + "/warc"
    warc.write_warc(spark.createDataFrame(rows(), DDL).coalesce(1), out)
    ranges = warc.file_ranges(spark, out, 500)
    links = warc.chain_links(ranges, 500)
    entries = warc.range_entries(ranges, 500)
    assert links.count() > entries.count()
    assert warc.read_warc(spark, out, 500).count() == len(rows())


def test_empty_table(spark):
    out = common.run_dir(spark, "t2") + "/warc"
    warc.write_warc(spark.createDataFrame([], DDL), out)
    assert warc.read_warc(spark, out).collect() == []


def test_long_headers(spark):
    data = [(i, "data:text/html," + "%41" * (30_000 * (i % 3)) + "WARC/1.1", f"<p>{i}</p>" * 30, 1, "x") for i in range(12)]
    data += [(100, "u", "a: WARC/1.1\r\n" * 2000, 1, "x"), (101, "u", "a: WARC/1.1\r\nContent-Length: 5\r\n" * 500 + "\r\n12345\r\n\r\n", 1, "x")]
    out = common.run_dir(spark, "t2") + "/warc"
    warc.write_warc(spark.createDataFrame(data, DDL).coalesce(1), out)
    for range_bytes in (50_000, 10_000_000):
        got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_warc(spark, out, range_bytes, with_payload=True).collect()]
        assert sorted(got, key=repr) == expected(data)


@pytest.mark.parametrize("range_bytes", [500, 1_000_000])
def test_truncated_file_is_an_error(spark, range_bytes):
    out = common.run_dir(spark, "t2") + "/warc"
    warc.write_warc(spark.createDataFrame(rows(), DDL).coalesce(1), out)
    whole = bytes(spark.read.format("binaryFile").load(out).where("length > 0").first().content)
    for cut in (1, len(whole) // 2):
        part = f"{common.run_dir(spark, 't2')}.warc"
        fs, path = common.file_system(part)
        with fs.open_output_stream(path) as f:
            f.write(whole[:-cut])
        with pytest.raises(ValueError, match="do not reach"):
            warc.read_warc(spark, part, range_bytes)
