import base64
import hashlib

from inkwell.llm import warc


def brute(rows, least=0):
    first = {}
    for i, body, *_ in rows:
        first[body or ""] = min(first.get(body or "", i), i)
    out = []
    for i, body, *_ in rows:
        raw = (body or "").encode()
        revisit = len(raw) >= least and first[body or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[body or ""] if revisit else None))
    return sorted(out)


def test_round_trip(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "a", "a", tricky, tricky * 2, "é" * 9000, "<p>" + "long 😀 \r\n\r\n" * 20_000, "<p>" + "long 😀 \r\n\r\n" * 20_000, "\r\n\r\n", "end\r\n", *["hot"] * 300]
    rows = [(100 - k, b, "x", None) for k, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, html string, id string, body int").repartition(3)
    got = warc.round_trip(pages).collect()
    assert all(r.intact for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_oversized_payloads_of_repeated_and_null_ids(spark):
    big = [c * 400_000 for c in ("a", "é", "\r\n\r\n", "😀")]
    rows = [(1, big[0]), (1, big[1]), (None, big[2]), (None, big[3]), (2, big[0]), (3, big[3]), (3, big[3])]
    pages = spark.createDataFrame([(i, b, "https://e.org/a b\r\nX: 1", "k") for i, b in rows], "page_id long, html string, url string, sha string").repartition(2)
    got = warc.round_trip(pages, uri_col="url").collect()
    digest = lambda b: base64.b32encode(hashlib.sha1(b.encode()).digest()).decode()
    first = {b: min((i for i, c in rows if c == b and i is not None), default=None) for _, b in rows}
    want = [(i, len(b.encode()), digest(b), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in rows]
    key = lambda r: tuple((x is None, x) if x is None or isinstance(x, int) else (False, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.intact for r in got)


def test_archives_have_what_the_format_asks_for(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "x" * 300_000, "https://e.org/1"), (2, "b", None)], "page_id long, html string, url string")
    warc.write(pages, f"file://{tmp_path}/w", uri_col="url")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    heads = [x for x in raw.split(b"\r\n\r\n") if x.startswith(b"WARC/1.1")]
    assert len(heads) == 4 and all(h.count(name) == 1 for h in heads for name in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"WARC-Target-URI", b"Content-Length"))
    assert len({x for h in heads for x in h.split(b"\r\n") if x.startswith(b"WARC-Record-ID")}) == 4
    assert b"https://e.org/1" in raw and b"urn:page:2" in raw


def test_revisits_keep_their_url(spark, tmp_path):
    """A revisit states its own URL and that of the record it refers to; of repeated ids the smallest URL."""
    import gzip

    pages = spark.createDataFrame([(4, "b", "https://e.org/4"), (2, "b", "https://e.org/2"), (9, "b", None), (7, "c", "https://e.org/7")] + [(100 + k, "hot", f"https://e.org/hot{k}") for k in range(30)], "page_id long, html string, url string")
    warc.write(pages, f"file://{tmp_path}/w", uri_col="url")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz"))).decode()
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in raw.split("\r\n\r\n") if h.startswith("WARC/1.1")]
    found = {h["X-Page-ID"]: (h["WARC-Type"], h["WARC-Target-URI"], h.get("WARC-Refers-To-Target-URI")) for h in heads}
    assert found["2"] == ("response", "https://e.org/2", None) and found["7"] == ("response", "https://e.org/7", None)
    assert found["4"] == ("revisit", "https://e.org/4", "https://e.org/2") and found["9"] == ("revisit", "urn:page:9", "https://e.org/2")
    assert {found[str(100 + k)] for k in range(1, 30)} == {("revisit", f"https://e.org/hot{k}", "https://e.org/hot0") for k in range(1, 30)}
    assert all(h["Content-Type"].startswith("text/html") for h in heads if h["WARC-Type"] == "response")
