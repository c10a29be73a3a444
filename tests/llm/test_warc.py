"""Round trips through archives, and archives that are broken or written by others."""

import gzip
import hashlib
import random

import pytest

from kindred.llm import warc as W


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, payload in data:
        ids = [x for x, p in data if p == payload and x is not None]
        own = len(payload) < W.REVISIT_BYTES or not ids or i == max(ids)
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "response" if own else "revisit", None if own else max(ids)))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices(["a", "<p>", "\n", "\r\n", "\r\n\r\n", "é", "日", "WARC/1.1\r\n", "0\r\n"], k=n))
    same = text(900)
    rows = [(i, f"http://a/{i}\r\nx", text(rng.choice([0, 1, 50, 3000, 9000]))) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://b", "x"), (103, "http://b", "x")] + [(200 + i, "http://c", same) for i in range(30)]
    rows += [(200, "http://c", same), (None, "http://c", same), (None, None, "y"), (7, "u", "second payload of an id"), (300, "z", "line\n"), (301, "z", "\r"), (302, "z", "x" * 300_000)]
    for segment in (500, W.SEGMENT_BYTES):
        got = sorted((tuple(r) for r in W.round_trip(pages(spark, rows), segment_bytes=segment).collect()), key=str)
        assert got == brute(rows)


def test_repeated_rows_have_records_of_their_own(spark, tmp_path):
    long = "p" * 1500
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, "a", ""), (None, "a", None), (None, "b", None), (5, "u", long), (5, "u", long), (5, "v", long), (4, "u", long), (4, "u", long)]
    got = sorted((tuple(r) for r in W.round_trip(pages(spark, rows)).collect()), key=str)
    assert got == brute(rows) and len(got) == len(rows)
    W.write_archives(pages(spark, rows), str(tmp_path / "w"))
    records = W.read_records(spark, str(tmp_path / "w")).collect()
    assert len({r.record_id for r in records}) == len(rows)
    ids = {r.record_id for r in records if r.type == "response"}
    assert {r.refers_to for r in records if r.type == "revisit"} <= ids


def test_an_archive_that_spark_splits(spark, tmp_path):
    blocks = [bytes([97 + i % 26]) * (i * 37 % 5000) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\n" * (i % 3) for i in range(300)]
    data = b"".join(record("resource", f"r{i}", b) for i, b in enumerate(blocks))
    (tmp_path / "one.warc").write_bytes(data)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(data.replace(b"<r", b"<z")))
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "20000")
        assert spark.read.text(str(tmp_path / "one.warc")).rdd.getNumPartitions() > 10
        got = W.read_records(spark, str(tmp_path)).collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert all(r.error is None for r in got)
    assert {r.record_id: bytes(r.block) for r in got} == {f"{x}{i}": b for i, b in enumerate(blocks) for x in "rz"} and len(got) == 600


def test_empty_table(spark):
    assert W.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 20_000, bytes(range(256)) * 50])
def test_chunked_framing(payload):
    assert W.dechunked(W.chunked(payload, 1000)) == payload


def test_foreign_framing_and_broken_framing():
    assert W.dechunked(b"3;name=v\r\nabc\r\n0A \r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    for broken in (b"", b"3\r\nab", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            W.dechunked(broken)


def record(kind, name, block, *fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_reassembly_out_of_order_and_its_checks(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + W.chunked(b"payload \xff\n" * 400, 333)
    cuts = [block[i : i + 1000] for i in range(0, len(block), 1000)]

    def parts(name, total):
        out = [record("response", name, cuts[0], "WARC-Segment-Number: 1")]
        for n, c in enumerate(cuts[1:], 2):
            last = [f"WARC-Segment-Total-Length: {total}"] if n == len(cuts) else []
            out.append(record("continuation", f"{name}:{n}", c, f"WARC-Segment-Origin-ID: <{name}>", f"WARC-Segment-Number: {n}", *last))
        return out

    good, short, lacking = parts("good", len(block)), parts("short", len(block) - 1), parts("lacking", len(block))
    first = [good[2], short[0], lacking[0], record("warcinfo", "info", b"software: x\r\n"), *good[3:], *short[2:]]
    second = [good[0], good[1], good[1], short[1], *lacking[2:], record("response", "odd", b"not http")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(first)))
    (tmp_path / "b.warc").write_bytes(b"".join(second) + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <cut>\r\nContent-Length: 99\r\n\r\nhalf")
    got = {r.record_id: r for r in W.payloads(W.reassemble(W.read_records(spark, str(tmp_path)))).collect()}
    assert bytes(got["good"].payload) == b"payload \xff\n" * 400 and got["good"].error is None
    assert got["short"].error == "the total length differs" and got["lacking"].error == "segments are missing"
    assert got["odd"].error == "not an HTTP message" and "ends inside" in got["cut"].error
    assert got["info"].type == "warcinfo" and got["info"].payload is None and got["info"].error is None


def test_parser_on_any_split_of_lines():
    data = record("response", "a", b"\n\r\n\n") + record("resource", "b", b"") + record("response", "c", b"x\r\n\r\nWARC/1.1", "Folded: one", " two")
    parser, found = W.Parser(), []
    for line in data.split(b"\n")[:-1]:
        r = parser.feed(line)
        found += [r] if r else []
    assert [(r["record_id"], r["block"]) for r in found] == [("a", b"\n\r\n\n"), ("b", b""), ("c", b"x\r\n\r\nWARC/1.1")]
    assert parser.close() is None
