import hashlib

from foldstore.llm import warc
from foldstore.llm.runtime import scratch

BIG = "<p>" + "payload " * 40_000 + "</p>"
PAGES = [(3, "http://a/é b\r\n", BIG), (1, "http://b", BIG), (2, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (6, "http://e", ""), (7, "http://f", "x" * 100), (8, "http://g", "x" * 100), (8, "http://g", "x" * 100), (9, "http://h", "y" * 99), (10, "http://h", "y" * 99), (None, "http://i", "z" * 300), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 30)]


def expected():
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = first.get(b) if i is not None and first.get(b, i) < i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == expected()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_carry_running_digests(spark):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    root = scratch(spark, "warc-test")
    table = warc.read_chunks(spark, warc.write(warc.decide(pages), root, roll=1000), root, chunk=1000, data=True)
    rows = table.where("record_type = 'response'").orderBy("chunk_no").collect()
    whole = BIG.encode()
    assert [r.chunk_no for r in rows] == list(range(len(rows))) and len(rows) == -(-len(whole) // 1000)
    at = 0
    for r in rows:
        assert bytes(r.data) == whole[at : at + 1000]
        at += len(r.data)
        assert (r.bytes_so_far, r.sha256_so_far, r.last) == (at, hashlib.sha256(whole[:at]).hexdigest(), at == len(whole))
    assert table.where("record_type = 'revisit'").select("refers_to", "declared_bytes").first()[:] == (1, len(whole))
