import hashlib
import random
import struct
import zlib

import zstandard
from pyspark.sql import functions as F

from tapeline.llm import matroska as mk
from tapeline.llm import warc


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 64, 65, 1023, 1024, 1025, 8191, 8192, 8193, 33_000, 120_000):
        size, payload = mk.padded("".join(rng.choice("abc ") for _ in range(n)))
        assert size == n and len(payload) % 64 == 0 and len(payload) >= 64
        data = mk.mux(payload)
        m = mk.demux(data)
        assert m.error is None and mk.payload_of(data, m) == payload and m.tracks == [(1, 2, "A_PCM/INT/LIT")] and m.duration == len(payload)
        assert [data[at : at + 4] for _, _, at in m.cues] == [b"\x1f\x43\xb6\x75"] * m.clusters
        assert [p[1] for p in m.packets] == list(range(0, len(payload), mk.FRAME))
        assert m.frame_ns == {1: mk.FRAME * 10**9 // mk.SAMPLE_RATE} and m.scale * mk.SAMPLE_RATE == 10**9


def test_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"bb", b"c" * 700, b"d" * 5]
    xiph = b"\x03" + b"\xff\x2d" + b"\x02" + b"\xff\xff\xbe" + b"".join(frames)
    fixed = b"\x02" + b"xyXYzz"
    head = lambda flags, ticks=5: b"\x81" + struct.pack(">hB", ticks, flags)
    blocks = mk.element(mk.SIMPLE_BLOCK, head(0x82) + xiph) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, head(0x04, -3) + fixed) + mk.number(0xFB, 1)) + mk.laced_block(frames, 9)
    cluster = (0x1F43B675).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.number(mk.CLUSTER_TIME, 100) + blocks
    data = (0x18538067).to_bytes(4, "big") + b"\xff" + cluster + cluster
    m = mk.demux(data)
    assert m.error is None and m.clusters == 2
    first = [p for p in m.packets if p[5] == 0]
    assert [p[4] for p in first] == [300, 2, 700, 5, 2, 2, 2, 300, 2, 700, 5] and [p[1] for p in first[:5]] == [105, 105, 105, 105, 97] and [p[2] for p in first[3:5]] == [True, False]
    assert mk.payload_of(data, m).startswith(b"".join(frames) + b"xyXYzz" + b"".join(frames))


def test_damage_is_reported():
    data = mk.mux(mk.padded("x" * 5000)[1])
    for cut in (10, 200, 3000):
        m = mk.demux(data[:cut])
        assert m.error and mk.payload_of(data, m) in data
    assert mk.demux(None).packets == [] and mk.demux(b"\0\0").error


def test_media_columns(spark):
    rows = [(1, "abc", "k"), (1, "abc", "k"), (2, None, "k"), (3, "", None), (4, "é" * 70_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in mk.media_digests(df).collect()}
    for i, text in ((1, "abc"), (2, ""), (3, ""), (4, "é" * 70_000)):
        n, payload = mk.padded(text)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    table = mk.packet_table(mk.write_media(df.drop("feature"))).select("doc_id", "n_packets", F.explode("packets").alias("p"))
    assert table.where("doc_id = 4").agg(F.sum("p.size")).first()[0] == got[4]["payload_bytes"]
    parts = mk.packet_table(mk.write_media(df.drop("feature"))).where("doc_id = 4").first()
    assert [(t["track"], t["codec"], t["frame_ns"]) for t in parts["tracks"]] == [(1, "A_PCM/INT/LIT", 128_000_000)] and len(parts["cues"]) == parts["n_cues"] == parts["n_clusters"]
    assert mk.media_digests(df.limit(0)).count() == 0 and mk.packet_table(spark.createDataFrame([(1, None)], "i int, media binary")).first()["n_packets"] == 0


def test_archive_bytes():
    rng = random.Random(2)
    records = [warc.record_bytes(i, "http://a.example/é?q=1 2", f"<html><body>{'word %d ' % i * rng.randint(1, 80)}</body></html>".encode(), None, "2026-01-01T00:00:00Z") for i in range(200)]
    content = warc.build_archive(records)
    assert content[:4] == struct.pack("<I", warc.SKIPPABLE) and len(content) < sum(map(len, records)) / 2
    found = list(warc.frames(content))
    assert [raw for _, _, raw in found] == records and found[-1][0] + found[-1][1] == len(content)
    few = warc.build_archive(records[:3])
    assert few[:4] == struct.pack("<I", warc.SKIPPABLE) and [raw for _, _, raw in warc.frames(few)] == records[:3]
    big = warc.record_bytes(1, None, bytes(rng.randbytes(300_000)), None, "d")
    assert [raw for _, _, raw in warc.frames(warc.build_archive([big, big]))] == [big, big]
    for some in ([records[0]], [big], [big] * 40, [records[0]] * 300):
        made = warc.build_archive(some)
        assert made[:4] == struct.pack("<I", warc.SKIPPABLE) and [raw for _, _, raw in warc.frames(made)] == some
        # by the library alone: the leading frame's content is the dictionary, the next frames are records
        size = struct.unpack_from("<I", made, 4)[0]
        d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(made[8 : 8 + size]))
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(made[8 + size :], max_output_size=len(some[0])) == some[0]


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/x", "same", 0), (5, "http://a/y", "same", 0), (3, None, "same", 0), (7, "http://b/\n\r z", None, 0), (8, "", "", 0), (9, "http://c", "é" * 200_000, 0), (10, "http://d", "other", 0), (10, "http://d", "other", 0), (None, "http://e", "same", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long").repartition(3)
    arch = warc.write_archives(warc.with_revisits(df.drop("refers_to"), "page_id", "html"))
    got = sorted((r["id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(arch).collect())
    digest = lambda s: warc.base32_sha1(s.encode())
    assert got == sorted([(-1, "revisit", 5, 4, digest("same")), (1, "revisit", 5, 4, digest("same")), (3, "revisit", 5, 4, digest("same")), (5, "response", None, 4, digest("same")), (7, "revisit", 8, 0, digest("")), (8, "response", None, 0, digest("")), (9, "response", None, 400_000, digest("é" * 200_000)), (10, "response", None, 5, digest("other")), (10, "response", None, 5, digest("other"))], key=lambda r: (r[0], r[1]))
    larger = warc.with_revisits(df.drop("refers_to"), "page_id", "html", least=5)
    assert larger.where("refers_to is not null").count() == 0
    assert warc.read_archives(warc.write_archives(warc.with_revisits(df.limit(0).drop("refers_to"), "page_id", "html"))).count() == 0
    warc.save_archives(arch, str(tmp_path / "w"))
    assert sum(len(list(warc.frames(f.read_bytes()))) for f in (tmp_path / "w").glob("*.warc.zst")) == len(rows)


def test_archives_bound_what_is_read(spark, tmp_path):
    """A few rows of Parquet at a time; payloads are read once for their digests and once for the records."""
    name, folder = "spark.sql.parquet.columnarReaderBatchSize", str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", None)], "page_id long, url string, html string").write.parquet(folder)
    pages = spark.read.parquet(folder)
    spark.conf.unset(name)
    found = warc.with_revisits(pages, "page_id", "html")
    assert int(spark.conf.get(name)) <= 512
    spark.conf.unset(name)
    warc.write_archives(found)
    assert int(spark.conf.get(name)) <= 512
    scans = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x and "html" in x]
    assert len(scans) == 1
    assert sorted((r["page_id"], r["refers_to"]) for r in found.collect()) == [(1, 2), (2, None), (3, None)]
