import pytest
from pyspark.errors import PySparkException

from scriptorium.operators import pii, quality
from scriptorium.sources import files, sinks
from scriptorium.streaming import folder


@pytest.fixture
def texts(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_bytes("甲说。乙说。".encode("gb18030"))
    (d / "b.TXT").write_bytes("丙说。".encode("utf-8-sig"))
    (d / "c.md").write_text("丁。")
    (d / "e.txt").write_bytes(b"")
    return d


def test_files_by_suffix_and_encoding(spark, texts):
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["encoding"]) for r in files.decoded(files.read_files(spark, str(texts))).collect()}
    assert got == {"a.txt": ("甲说。乙说。", "gb18030"), "b.TXT": ("丙说。", "utf-8-sig")}  # an empty file has no row


def test_records_round_trip(spark, tmp_path):
    rows = [(1, 'with "quotes"', "two\nlines"), (2, "tab\tinside", "")]
    d = spark.createDataFrame(rows, "id int, title string, abstract string")
    sinks.write_records(d, str(tmp_path / "t"), ["id", "title", "abstract"])
    got = files.read_records(spark, str(tmp_path / "t")).orderBy("id").collect()
    assert [(int(r["id"]), r["title"], r["abstract"] or "") for r in got] == rows
    (tmp_path / "bad.tsv").write_text("id\tname\n1\tx\n")
    with pytest.raises(ValueError):
        files.read_records(spark, str(tmp_path / "bad.tsv"))


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("93\n155, 180，119 93\n")
    assert sorted(r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == [93, 119, 155, 180]
    (tmp_path / "odd.txt").write_text("1 x\n")
    with pytest.raises(PySparkException):
        files.read_ids(spark, str(tmp_path / "odd.txt")).collect()


def test_term_list(spark):
    d = spark.createDataFrame([("甲",), ("# 注",), ("",), (" 乙 ",)], "value string")
    assert [r["term"] for r in pii.term_list(d).collect()] == ["甲", "乙"]


def test_skip(spark):
    f = spark.sql("SELECT * FROM VALUES ('a', timestamp'2020-01-01'), ('b', timestamp'2020-01-03'), ('c', timestamp'2020-01-01') AS t(path, mtime)")
    o = spark.sql("SELECT * FROM VALUES ('a', timestamp'2020-01-01'), ('b', timestamp'2020-01-02') AS t(path, out_mtime)")
    assert {r["path"]: r["skip"] for r in files.incremental_skip(f, o).collect()} == {"a": True, "b": False, "c": False}
    assert not any(r["skip"] for r in files.incremental_skip(f, o, force=True).collect())


def test_watched_folder(spark, texts, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")

    def count():
        folder.watch(spark, str(texts), quality.doc_stats, out, seen).awaitTermination(120)
        return spark.read.parquet(out).count()

    first = count()
    (texts / "new.txt").write_text("戊说。")
    assert (first, count()) == (2, 3)  # a.txt and c.md, then the new one only
