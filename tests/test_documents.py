"""Whole JSON documents: a file per row, and files read some folders at a time."""

import bz2
import gzip
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.plans import stores
from logweir.plans.registry import QUERIES
from logweir.session import on_disk
from logweir.sources.files import scan_json_documents


def store_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")


def files_below(path):
    return sorted(f.read_bytes() for f in Path(path).glob("folder=*/*"))


@pytest.mark.skipif(not Path("/proc/self/stat").exists(), reason="counts the JVM's processes by /proc")
def test_writing_files_starts_no_process_for_each(spark, tmp_path):
    """The page faults of the processes that the JVM started and waited for: some 100 for each ``chmod`` of a file."""
    store_documents(spark, tmp_path, [(n, f"text {n}") for n in range(300)])
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    faults = lambda: int(Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()[8])
    before = faults()
    stores.documents_as_files(spark, str(tmp_path), f"{tmp_path}/files")
    assert faults() - before < 300 and len(files_below(tmp_path / "files")) == 300


def test_all_folders_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(n, None if n == 3 else f"text {n}\n") for n in range(90)] + [(1, "again"), (None, "none")]
    store_documents(spark, tmp_path, rows)
    monkeypatch.setattr(stores, "FOLDER_FILES", 10)
    monkeypatch.setattr(stores, "LISTED_FOLDERS", 3)
    listed, scan = [], stores.scan_json_documents
    monkeypatch.setattr(stores, "scan_json_documents", lambda spark, path, *rest: listed.append(path) or scan(spark, path, *rest))
    got = QUERIES["scan_json_documents"](spark, str(tmp_path)).select("doc_id", "message_md5").collect()
    want = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.md5(F.coalesce("text", F.lit("")))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert [len(folders) for folders in listed] == [3, 3, 3, 1] and len({f for some in listed for f in some}) == 10


@pytest.mark.parametrize("parts", [8, 1])
def test_rows_are_dealt_anew_only_where_few_tasks_read_them(spark, tmp_path, monkeypatch, parts):
    """Spread rows are written by the tasks that read them, in folders of the same size; one task's rows are shared out."""
    rows = spark.range(0, 400, 1, parts).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "FOLDER_FILES", 15)
    dealt, repartition = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda df, *by: dealt.append(by) or repartition(df, *by))
    stores.documents_as_files(spark, str(tmp_path), f"{tmp_path}/files")
    folders = list((tmp_path / "files").glob("folder=*"))
    assert len(files_below(tmp_path / "files")) == len(set(files_below(tmp_path / "files"))) == 400
    if parts == 8:
        assert dealt == [] and {f.name for f in folders} == {f"folder={p}-{n}" for p in range(8) for n in range(4)}
    else:
        assert dealt == [(27,)] and {f.name for f in folders} == {f"folder={p}-0" for p in range(27)}


def test_no_documents(spark, tmp_path):
    store_documents(spark, tmp_path, [])
    assert QUERIES["scan_json_documents"](spark, str(tmp_path)).collect() == []


def test_files_read_as_the_text_source_reads_them(spark, tmp_path):
    """Packed files are unpacked; hidden and empty ones are left out; bytes that are no UTF-8 stay as they are."""
    body = b'{"message":"\xc3\xa9"}\r\n\n'
    for name, data in {
        "a.json": body, "b": b"\xff\xfe{", "c.json.gz": gzip.compress(body), "d.bz2": bz2.compress(b"packed"), "e.GZ": gzip.compress(b"x"),
        "f.gz.json": b"plain", "gz": b"plain", "e m%20p.json": b" ", "empty.json": b"", "_hidden.json": body, ".dot.json": body,
    }.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "x.json").write_bytes(body)
    size = F.col("_metadata.file_size")
    columns = lambda df: sorted(map(tuple, df.select(F.hex("raw_event"), "file", "bytes", "size_ok").collect()))
    want = columns(spark.read.text(str(tmp_path), wholetext=True).select(
        F.col("value").alias("raw_event"), F.col("_metadata.file_path").alias("file"), size.alias("bytes"), (size <= 10).alias("size_ok")))
    got = scan_json_documents(spark, str(tmp_path), max_bytes=10)
    assert columns(got) == want and len(want) == 8
    assert dict(got.dtypes) == {"raw_event": "string", "file": "string", "bytes": "bigint", "size_ok": "boolean"}
    several = scan_json_documents(spark, [f"{tmp_path}/below", f"{tmp_path}/a.json", f"{tmp_path}/c.json.gz"])
    assert [r["raw_event"].encode() for r in several.collect()] == [body] * 3
    # The text source takes some 3 ms for each of its files: it gets the packed ones alone.
    assert "FileScan binaryFile" in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_that_runs_twice_leaves_its_folder_as_it_is(tmp_path, monkeypatch):
    """Also one that died halfway leaves nothing where it is read."""
    def run(attempt, batches):
        task = SimpleNamespace(taskAttemptId=lambda: attempt, partitionId=lambda: 4)
        monkeypatch.setattr(stores, "TaskContext", SimpleNamespace(get=lambda: task))
        return [b.column(0).to_pylist() for b in stores._as_files(str(tmp_path), 2)(batches)]

    batch = lambda *texts: pa.record_batch([pa.array(texts)], ["value"])

    def broken():
        yield batch("a")
        raise ConnectionError("gone")

    with pytest.raises(ConnectionError):
        run(7, broken())
    assert not list(tmp_path.glob("folder=*"))
    assert run(8, [batch("a", "é"), batch("b\n")]) == run(9, [batch("a", "é"), batch("b\n")]) == [[3]]
    assert files_below(tmp_path) == [b"a\n", b"b\n\n", "é\n".encode()]
    assert sorted((f.parent.name, f.name) for f in tmp_path.glob("folder=*/*")) == [
        ("folder=4-0", "part-00000.txt"), ("folder=4-0", "part-00001.txt"), ("folder=4-1", "part-00000.txt")]
    assert [f.name for f in (tmp_path / "_temporary").iterdir()] == ["7"]
    assert run(10, [batch()]) == [[0]]


def test_a_store_without_local_paths_gets_the_same_files(spark, tmp_path):
    """Where Python cannot open the path, Spark writes the files."""
    (tmp_path / "store").mkdir()
    store_documents(spark, tmp_path, [(n, f"text {n}") for n in range(25)] + [(None, None)])
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.documents.link./store", f"file://{tmp_path}/store")
    far = "viewfs://documents/store/files"
    assert on_disk(spark, far) is None and on_disk(spark, f"file://{tmp_path}/files") == f"{tmp_path}/files"
    stores.documents_as_files(spark, str(tmp_path), far)
    stores.documents_as_files(spark, str(tmp_path), f"{tmp_path}/files")
    assert files_below(tmp_path / "files") == [f.read_bytes() for f in sorted(
        (f for f in (tmp_path / "store" / "files").glob("folder=*/[!.]*")), key=lambda f: f.read_bytes())]
    assert sorted(f.name for f in (tmp_path / "files").iterdir()) == ["_SUCCESS", "folder=0-0"]
    with pytest.raises(FileExistsError):
        stores.documents_as_files(spark, str(tmp_path), f"{tmp_path}/files")
