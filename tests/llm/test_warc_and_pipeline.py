"""Archives: exact round trip and merged order. Pipeline: each stage's decision."""

import glob
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import warc


def pages():
    rng = random.Random(4)
    bodies = ["<p>" + "é" * 600 + "</p>", "x" * 999, "y" * 1000, "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 50, "", None, "\r\n\r\n" * 400]
    urls = ["http://www.a.org/x", "http://a.org/x", "https://b.net/", None, "no scheme", "http://A.org:80/Y?q"]
    again = [(79, "http://a.org/x", bodies[2], "2024-01-01T00:00:00Z", "x")] * 2 + [(78, "http://a.org/x", bodies[2], None, "x")] * 2
    return again + [(i, rng.choice(urls), rng.choice(bodies) if i < 78 else f"own {i} " * 200, rng.choice(["2024-01-01T00:00:00Z", "2023-05-05T00:00:00Z", None]), "x") for i in range(120)] + [(3, "http://a.org/x", "twice", "2024-01-01T00:00:00Z", "x"), (None, "http://n.org/", "no id", None, "x")]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, warc_date string, record_type string")
    return warc.archive(df, block_bytes=400, blocks_per_archive=2, rows_per_range=17).collect()


def test_round_trip(index):
    largest = {}
    rows = [r for r in pages() if r[0] is not None]
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            largest[raw] = max(i, largest.get(raw, -1))
    expected = sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if largest.get((h or "").encode(), i) != i else "response", largest.get((h or "").encode()) if largest.get((h or "").encode(), i) != i else -1) for i, _, h, *_ in rows)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in index) == expected


def test_histories_are_globally_ordered(index):
    by = {}
    for r in index:
        by.setdefault(r.url_key, []).append(r)
    assert "org,a)/x" in by and "" in by
    for own in by.values():
        own.sort(key=lambda r: r.history_no)
        assert [r.history_no for r in own] == list(range(len(own)))
        keys = [(r.warc_date, r.page_id) for r in own]
        assert keys == sorted(keys)
    ends = {}
    for r in index:
        key = (r.url_key, r.warc_date, r.page_id)
        lo, hi = ends.get(r.range_no, (key, key))
        ends[r.range_no] = (min(lo, key), max(hi, key))
    spans = [ends[k] for k in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_repeated_originals_dont_multiply_revisits(spark):
    rows = [(9, "http://a.org/", "y" * 2000, "d"), (9, "http://a.org/", "y" * 2000, "d"), (3, "http://a.org/", "y" * 2000, "d"), (4, "http://a.org/", "y" * 2000, "d"), (9, "http://a.org/", "z" * 2000, "d"), (5, None, "z" * 2000, "d")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, warc_date string")).collect()
    sha = {c: hashlib.sha1(c.encode() * 2000).hexdigest() for c in "yz"}
    expected = [(3, "revisit", 9, sha["y"]), (4, "revisit", 9, sha["y"]), (5, "revisit", 9, sha["z"]), (9, "response", -1, sha["y"]), (9, "response", -1, sha["y"]), (9, "response", -1, sha["z"])]
    assert sorted((r.page_id, r.record_type, r.refers_to or -1, r.payload_digest) for r in got) == sorted(expected)
    assert all(r.payload_bytes == 2000 for r in got)


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    body = random.Random(6).randbytes(17 << 19).hex()  # beyond 16 MiB: its length doesn't end in a zero byte
    rows = [(1, "http://a.org/", "one", "d"), (2, "http://a.org/", body, "d"), (3, "http://a.org/", "three", "d"), (4, "http://a.org/", "", "d")]
    path = str(tmp_path / "archives")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, warc_date string").coalesce(1), path, block_bytes=50, blocks_per_archive=2)
    files = {f.rsplit("/", 1)[-1]: open(f, "rb").read() for f in glob.glob(f"{path}/part-*")}
    index = warc.read(spark, path).collect()
    assert len(files) > 1 and sorted(r.page_id for r in index) == [1, 2, 3, 4]
    for r in index:
        content = files[r.archive][r.record_offset : r.record_offset + r.record_bytes]
        unpacker = zlib.decompressobj(31)
        record = unpacker.decompress(content)
        assert unpacker.eof and not unpacker.unused_data
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(rows[r.page_id - 1][2].encode() + b"\r\n\r\n")


def test_runs_are_sorted_where_they_are_read(index):
    assert len({r.archive for r in index}) > 5 and len({r.range_no for r in index}) > 3


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted((rng.randint(0, 9), n) for n in range(rng.randint(0, 6))) for _ in range(k)]
        runs = [[(key, None) for key, _ in r] for r in runs]
        assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.members(b"junk", "a"))
    with pytest.raises(ValueError):
        list(warc.members(warc.member(b"abc")[:-3], "a"))
    with pytest.raises(ValueError):
        warc.parse(b"junk", "a", 0, 4)
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:0>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:x\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", "a", 0, 9)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, warc_date string")
    assert warc.archive(df).count() == 0


def test_pipeline_stages(spark, tmp_path, tokenizers):
    rng = random.Random(2)
    words = ["river", "stone", "people", "walking", "under", "water", "winter", "house", "tree", "nothing", "the", "of", "and", "with"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "exactly which of these winter rivers carried the heaviest stones under the old house last year"
    own = prose(200)
    texts = [own, own.upper(), prose(80) + " " + item + " " + prose(20), prose(60) + " token=abcdefghijklmnopqrst " + prose(10), "12345 !!", None, prose(3000), prose(40)]
    docs = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(sorted(r.doc_id for r in table.collect()))
    assert kept == [[0, 1, 2, 3, 6, 7], [0, 2, 3, 6, 7], [0, 3, 6, 7], [0, 3, 6, 7]]
    redacted = table.where("doc_id = 3").first()
    assert "[SECRET]" in redacted.text and "abcdefghijklmnop" not in redacted.text and redacted.n_chars == len(redacted.text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {0, 3, 6, 7}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
