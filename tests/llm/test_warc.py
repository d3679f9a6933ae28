import gzip
import hashlib
import random

from strandline.llm import warc as m


def test_surt():
    assert m.surt("http://www.Example.com:80/a?b#c") == "com,example)/a?b"
    assert m.surt("https://m.x.org:8443") == "org,x,m:8443)/" and m.surt(None) == "" and m.surt("no url") == "no url"
    assert m.surt("http://[bad/") and "\n" not in m.surt("http://a.b/\x1f\n")


def test_record_round_trip():
    for refers, again in ((None, False), (7, True), (None, True)):
        r = m.parse_record(m.record(3, "http://a/\r\nx", b"<p>\r\n\r\n</p>", "d", refers, again))
        assert (r["page"], r["refers"], r["payload_bytes"], r["type"]) == (3, refers, 11, "revisit" if again else "response")
        assert r["payload"] == (b"" if again else b"<p>\r\n\r\n</p>") and r["url"] == "http://a/%0D%0Ax"


def test_archive_index_and_read(spark):
    r = random.Random(1)
    big = ["é" * 50, "x" * 99, "y" * 100, "", None]
    rows = [(i, r.choice(["http://a.com/", "http://b.a.com/q", f"http://s{i % 9}.org/{i % 4}?z", None, "http://a.com/!"]), r.choice([*big, f"<p>{i}" * 30]), i) for i in range(400)]
    rows += [rows[0], (None, "http://a.com/", "q", 0), (-5, "http://a.com/", "y" * 100, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    rows += [(-5, "http://a.com/", "y" * 100, 1)] * 2 + [(-5, "http://b.com/", "y" * 100, 1), (None, "u", "y" * 100, 1)] + [(None, "v", "n" * 200, i) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    want, met = [], {}
    for i, u, h, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        b = (h or "").encode()
        again = len(b) >= 100 and b in met
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(met.setdefault(b, i) if again else None)))
        met.setdefault(b, i)
    got = [(str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in m.digest(df).collect()]
    assert sorted(got) == sorted(want)
    c = m.Captures(df, lines=7)
    assert c.directory.agg({"n": "sum"}).first()[0] == len(rows)
    q = spark.createDataFrame([("http://a.com/",), ("https://www.a.com",), ("http://none.com/",), ("http://s3.org/3?z",)], "url string")
    found = c.lookup(q)
    keys = {m.surt(x.url) for x in q.collect()}
    assert sorted(str(x.id) for x in found.collect()) == sorted(str(i) for i, u, *_ in rows if m.surt(u) in keys)
    back = c.read(found).collect()
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(bytes(x.payload) == (texts[x.id] if x.kind == "response" else b"") for x in back if x.id is not None)
    place = found.first()
    with open(place.file.removeprefix("file://"), "rb") as f:
        f.seek(place.offset)
        assert gzip.decompress(f.read(place.length)).startswith(b"WARC/1.1")
    assert m.digest(df.limit(0)).count() == 0


def test_null_ids_of_one_url_over_several_shards(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [(None, "http://hot.com/", f"p{i}") for i in range(600)] + [(i, f"http://s{i}.org/", "q") for i in range(20)] + [(7, "http://hot.com/", "r")]
        c = m.Captures(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), lines=7)
        assert c.directory.where("first = last").select("shard").distinct().count() > 2
        assert c.lookup(spark.createDataFrame([("http://hot.com/",)], "url string")).count() == 601
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
