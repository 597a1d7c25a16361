"""Folders as sources, and the kept tables."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from turnlake.operators import keeping, leakscan
from turnlake.plans.keeping import scan
from turnlake.sources import files
from turnlake.sources.tables import read


def test_traffic(spark, tmp_path):
    meta = {"id": "a", "timestamp": "2024-01-01T00:00:00Z", "session_id": "s", "audit_id": "u", "phase": "request_in", "bytes": 9, "saved_bytes": 3, "truncated": True, "file_path": "old"}
    (tmp_path / "x.meta.json").write_text(json.dumps(meta))
    (tmp_path / "x.body").write_text("abc")
    (tmp_path / "gone.meta.json").write_text(json.dumps(meta | {"id": "b"}))
    (tmp_path / "20240102T030405_response_out_0123abcd.body").write_text("hello")
    (tmp_path / "20249902T030405_response_out_0123abcd.body").write_text("no such month")
    (tmp_path / "note.body").write_text("no time")
    (tmp_path / "bad.meta.json").write_text("{")
    got = sorted((r.phase, r.bytes, r.saved_bytes, r.truncated, str(r.timestamp), r.file_path.rsplit("/", 1)[1]) for r in files.traffic(spark, str(tmp_path)).collect())
    assert got == [("request_in", 9, 3, True, "2024-01-01 00:00:00", "x.body"), ("response_out", 5, 5, False, "2024-01-02 03:04:05", "20240102T030405_response_out_0123abcd.body")]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.TXT", "b.pdf", "c.env", ".env", "none", "sub/d.txt"):
        (tmp_path / n).write_text(n)
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.corpus_files(spark, str(tmp_path), True, ["txt"])) == ["a.TXT", "c.env", "d.txt"]
    assert names(files.corpus_files(spark, str(tmp_path), False, ["Txt", "pdf"])) == ["a.TXT", "b.pdf", "c.env"]
    assert names(files.corpus_files(spark, str(tmp_path / "none"), False, ["txt"])) == ["none"]
    assert names(files.corpus_files(spark, str(tmp_path / "missing"), False, ["txt"])) == []


def test_office_text():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<a><b> one </b><b>two</b><c/></a>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", "<a>three<b>")
        z.writestr("ppt/theme.xml", "<a>no</a>")
    assert files.office_text(held.getvalue(), "pptx") == "one two\nthree\n"
    assert files.office_text(held.getvalue(), "docx") is None
    assert files.office_text(b"nonsense", "docx") is None and files.office_text(None, "pptx") is None


def test_spill(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.json").write_text(json.dumps({"audit_id": f"a{n}"}))
    assert files.spill_state(spark, str(src)).first().pending == 3
    q = files.spilled(spark, str(src), "audit_id string", per_batch=1).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.audit_id for r in spark.read.parquet(str(out)).collect()) == ["a0", "a1", "a2"]


def test_small_files(spark, tmp_path):
    at = str(tmp_path / "m")
    assert keeping.get_metadata(spark, at, "k") is None and keeping.once_a_day(spark, at, "k", "d1")
    assert not keeping.once_a_day(spark, at, "k", "d1") and keeping.get_metadata(spark, at, "k") == "d1"
    keeping.put_metadata(spark, at, "k", 'é"')
    assert keeping.get_metadata(spark, at, "k") == 'é"'


def test_generations(spark, tmp_path):
    at = str(tmp_path / "i")
    rows = lambda **t: spark.createDataFrame([(k, len(v), v) for k, v in t.items()], "path string, size int, text string")
    a, b = "a" * 70, "".join(chr(97 + k % 23) for k in range(80))
    assert keeping.generation(spark, at) == 0
    assert keeping.build_index(rows(p=a, q=b), at) == 1 and keeping.build_index(rows(p=a, r=b + "x"), at) == 2
    got = {r.path: r["count"] for r in keeping.index(spark, at).groupBy("path").count().collect()}
    assert got == {"p": 38, "r": 49}
    docs = spark.createDataFrame([(1, "zz " + b[5:75]), (2, None), (3, "short"), (4, "b" * 90)], "doc_id long, text string")
    assert [tuple(r) for r in keeping.candidates(docs, "doc_id", keeping.index(spark, at)).collect()] == [(1, "r")]
    assert keeping.build_index(rows(p=a).limit(0), at) == 3 and keeping.index(spark, at).count() == 0


def test_indexed_scan_is_whole(spark, sf_dir):
    want = leakscan.shared_fragments(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark").withColumn("p", F.col("item_id").cast("string")), "p").select("doc_id", "item_id").distinct()
    assert sorted(map(tuple, scan(spark, sf_dir).collect())) == sorted(map(tuple, want.collect()))
