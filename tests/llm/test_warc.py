import hashlib
from types import SimpleNamespace

import pytest
import zstandard

from quillstone.llm import warc


def brute(rows):
    out, first = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and p in first and i != first[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    long = "<p>é" * 60
    rows = [(5, "http://a/\nb", long), (3, None, long), (3, None, long), (9, "x", None), (10, "y", ""), (11, "z", "short"), (12, "z", "short"), (None, "n", long), (None, "m", "q" * 100), (20, "u", "WARC/1.1\r\n\r\n" * 30)]
    rows += [(100 + i, f"http://h/{i}", f"{i} " * 400) for i in range(60)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.stored(warc.write(pages, f"file://{tmp_path}", frame=2000, bundle=4000), "t")
    assert sorted((tuple(r) for r in warc.read(index, f"file://{tmp_path}").collect()), key=str) == brute(rows)
    assert index.select("bundle").distinct().count() >= 3
    got = {r.page_id: r.payload for r in warc.lookup(index.where("page_id in (5, 107, 12)"), f"file://{tmp_path}").collect()}
    assert bytes(got[107]) == ("7 " * 400).encode() and bytes(got[12]) == b"short" and got[5] is None
    full = {r.page_id: bytes(r.payload) for r in warc.lookup(index.where("page_id in (5, 107, 3) or page_id is null"), f"file://{tmp_path}", index).collect() if r.page_id}
    assert full == {5: long.encode(), 3: long.encode(), 107: ("7 " * 400).encode()}
    for path in tmp_path.glob("*.warc.zst"):  # a plain Zstandard reader takes the bundle as it is
        assert zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read().startswith(b"WARC/1.1")
    assert warc.read(warc.stored(warc.write(pages.limit(0), f"file://{tmp_path}/e"), "t"), f"file://{tmp_path}/e").count() == 0


def test_a_revisit_without_its_response_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "x" * 200)], "page_id long, url string, html string").coalesce(1)
    index = warc.stored(warc.write(pages, folder, frame=1, bundle=1), "t")
    assert warc.read(index, folder).count() == 2
    kinds = {r.page_id: r.record_type for r in warc.records(index, folder).collect()}
    assert kinds == {1: "response", 2: "revisit"}
    with pytest.raises(Exception, match="no response of this payload"):
        warc.read(index.where("page_id = 2"), folder).collect()


def test_names_of_object_stores(monkeypatch):
    seen = []
    known = SimpleNamespace(from_uri=lambda uri: seen.append(uri) or (None, ""))
    monkeypatch.setattr(warc, "fs", SimpleNamespace(FileSystem=known, LocalFileSystem=warc.fs.LocalFileSystem))
    warc.file_system("s3a://bucket/x:y")
    warc.file_system("hdfs://host/x")
    assert seen == ["s3://bucket/x:y", "hdfs://host/x"]
    assert warc.file_system("/tmp/x")[1] == warc.file_system("file:///tmp/x")[1] == "/tmp/x"
