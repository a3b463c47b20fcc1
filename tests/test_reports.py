import io
import json
import re
import zipfile
from xml.dom import minidom

import pytest

from scriptorium.operators import bib, cites, manuscript, pii, reports
from scriptorium.sources import files, sinks

PAPER = """> 题目：《示例》
> 作者：某某
> 页眉：示例刊

## 摘 要
摘要一。

## 一、甲
甲**重**点[^1]，乙[^9]。

| a | b |
|---|:--|
| 1 |

## 参考文献
[1] 张三. 甲[J].
续行
[^1]: 某书。
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_redundancy_report(spark):
    s = "甲制度的核心功能在于对市场主体的行为进行事前规范。"
    d = docs(spark, f"## 一\n{s}\n" * 3 + s.replace("事前", "事先"), None, "")
    got = {r["doc_id"]: json.loads(r["report"]) for r in reports.redundancy_report(d).collect()}
    assert set(got) == {1, 3} and got[1]["sentence_count"] == 4 and got[1]["sections"][0] == {"name": "一", "chars": 24}
    assert got[1]["near_duplicates"] == [{"score": 0.958, "a": s, "b": s.replace("事前", "事先")}] and len(got[1]["repeated_chunks"]) == 10
    assert got[3]["char_count"] == 0 and got[3]["near_duplicates"] == got[3]["repeated_chunks"] == []


def test_trace_report(spark):
    got = {r["doc_id"]: json.loads(r["report"]) for r in reports.trace_report(docs(spark, '综上所述，本文"甲"学界普遍认为乙。\n## 1 题', "", None)).collect()}
    assert set(got) == {1, 2} and got[1]["formulaic"] == {"综上所述": 1} and got[1]["benwen"] == {"abstract": 0, "body": 1}
    assert got[1]["severe"] == ["straight_quotes:2"] and got[1]["warn"] == ["vague:1", "formulaic:1", "arabic_heads:1"]
    assert got[1]["heading_system"]["阿拉伯一级(1 )"] == 1 and got[2]["severe"] == [] and got[2].get("uniformity") is None


def test_punctuation_reports(spark):
    d = docs(spark, "甲,乙,丙.丁\"引\"...don't '某'。。。2023—2026", "好。", None)
    assert [tuple(r)[1:] for r in reports.punct_report(d).orderBy("doc_id").collect()] == [(2, 2, 2, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0, 0)]
    r = reports.normalized(d, years=True).orderBy("doc_id").first()
    assert tuple(r)[1:] == (2, 2, 2, 3, 1, "甲，乙，丙。丁“引”……don't ‘某’……2023-2026")


def test_listing_and_references(spark):
    rows = [(7, "J", "甲; 乙", "题", "刊", "2020", "", "3", "1-2", "k", "", "摘" * 401, "f"), (3, None, None, None, None, None, None, None, None, None, None, None, None)]
    b = spark.createDataFrame(rows, "id long, type string, authors string, title string, journal string, year string, volume string, issue string, pages string, keywords string, doi string, abstract string, source_file string")
    got = {r["ord"]: r["text"] for r in reports.listing(b).collect()}
    assert set(got) == {0, 1, 4, 8} and "- 记录数：2\n- 含摘要：1\n- 年份范围：2020 — 2020" in got[0] and "- 刊（1 篇）" in got[1]
    assert got[8].startswith("### [7] 题\n\n- 作者：甲; 乙\n- 出处：刊 2020(3)：1-2\n") and got[8].endswith("摘…\n") and "- 作者：—" in got[4]
    lines = [(r["num"], r["line"][:8]) for r in reports.reference_list(b, start=5).orderBy("num").collect()]
    assert lines == [(5, "[5] . [J"), (6, "[6] 甲, 乙")]
    head = reports.reference_file(b, "题录.tsv").orderBy("num").first()
    assert head["num"] == 0 and "共 2 条" in head["text"]
    assert reports.reference_list(b.limit(0)).collect() == [] and [r["ord"] for r in reports.listing(b.limit(0)).orderBy("ord").collect()] == [0, 1]


def test_numbers_have_no_gaps_over_partitions(spark):
    b = spark.range(0, 2000, 2).withColumnRenamed("id", "id").repartition(7)
    got = [(r["id"], r["num"]) for r in bib.numbered(b, 10).collect()]
    assert sorted(got) == [(2 * i, i + 10) for i in range(1000)]


def test_records_keep_their_file_and_cut_abstracts(spark):
    e = spark.createDataFrame([(1, "a.txt", "RT J\nA1 甲\nT1 题\nAB 一二三四\n\n 五六")], "export_id long, source_file string, text string")
    r = bib.records(e, abstract_limit=6).first()
    assert (r["source_file"], r["abstract"], r["authors"]) == ("a.txt", "一二三四 五", "甲")
    full = spark.createDataFrame([(1, "T", "甲;乙", "题", "刊", "2020", "1", "2", "3-4", "k", "10.1/x", "摘要")], "id long, type string, authors string, title string, journal string, year string, volume string, issue string, pages string, keywords string, doi string, abstract string")
    for fmt in ("refworks", "endnote"):
        r = bib.records(bib.as_exports(full, fmt=fmt), fmt).first()
        assert [r[f] for f in bib.FIELDS] == ["T", "甲; 乙", "题", "刊", "2020", "1", "2", "3-4", "k", "10.1/x", "摘要"]


def test_packet_and_paged_text(spark, tmp_path):
    got = {(r["doc_id"], r["file"]): r["text"] for r in reports.packet(docs(spark, PAPER, None), 2).collect()}
    assert set(got) == {(1, "审稿稿_M2.md"), (1, "审稿任务说明_M2.md")} and got[1, "审稿稿_M2.md"].startswith("# 示例\n\n")
    assert "审稿稿_M2.md" in got[1, "审稿任务说明_M2.md"]
    pages = spark.createDataFrame([(1, 2, "乙" * 90), (1, 1, "甲" * 90), (2, 1, None)], "doc_id long, page_no int, text string")
    texts = {r["file"]: (r["text"], r["scanned"]) for r in reports.paged_text(pages).collect()}
    assert texts["1.txt"] == ("\n===== PAGE 1 =====\n" + "甲" * 90 + "\n===== PAGE 2 =====\n" + "乙" * 90, False) and texts["2.txt"][1]
    run = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "doc_id long, skip boolean")
    assert tuple(reports.run_counters(run, files.scan_detect(pages)).first()) == (1, 1, 1, 1)


def test_texts_are_written_and_never_overwritten(spark, tmp_path):
    d = docs(spark, "甲\r\n乙\n", "丙", None)
    sinks.write_version(d, str(tmp_path / "t"), 1)
    read = lambda n: b"".join(p.read_bytes() for p in (tmp_path / "t" / "version=1" / f"doc_id={n}").glob("*.txt"))
    assert read(1) == "甲\r\n乙\n".encode() and read(2) == "丙\n".encode() and not list((tmp_path / "t" / "version=1").glob("doc_id=3"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_version(d, str(tmp_path / "t"), 1)
    sinks.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "n int, text string"), str(tmp_path / "l"), "n")
    assert "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part*"))) == "a\nb\n"
    sinks.write_reports(reports.trace_report(docs(spark, "甲")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["doc_id"] == 1


def test_records_open_with_a_byte_order_mark(spark, tmp_path):
    sinks.write_records(spark.createDataFrame([(1, "题")], "id int, title string"), str(tmp_path / "b"), ["id", "title"])
    parts = [p.read_bytes() for p in (tmp_path / "b").glob("*.csv")]
    assert max(parts, key=len) == "﻿id\ttitle\r\n1\t题\r\n".encode()
    (tmp_path / "none.tsv").write_text("id\ttitle\n")
    with pytest.raises(ValueError, match="no record"):
        files.read_records(spark, str(tmp_path / "none.tsv"))


def test_missing_paths_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("甲")
    with pytest.warns(UserWarning, match="no such path"):
        assert files.read_files(spark, [str(tmp_path), str(tmp_path / "nowhere")]).count() == 1


def test_word_files_hold_tables_notes_and_a_running_head(spark):
    d = docs(spark, PAPER, None)
    r = files.as_docx(manuscript.layout(d, "footnote"), cites.footnote_resolve(d)).first()
    z = zipfile.ZipFile(io.BytesIO(r["content"]))
    for name in z.namelist():
        minidom.parseString(z.read(name))
    body, notes, head = (z.read(f"word/{n}.xml").decode() for n in ("document", "footnotes", "header1"))
    assert body.count("<w:tr>") == 2 and body.count("<w:tc>") == 4 and "<w:b/>" in body and '<w:footnoteReference w:id="1"/>' in body
    assert "[^9]" in body and "某书。" in notes and "示例刊" in head and "张三" not in body and "示例</w:t>" in body
    plain = zipfile.ZipFile(io.BytesIO(files.as_docx(manuscript.layout(d)).first()["content"]))
    text = re.sub("<[^>]+>", "", plain.read("word/document.xml").decode())
    assert "张三. 甲[J]. 续行" in text and "[^1]" not in text and "word/footnotes.xml" not in plain.namelist()


def test_pdf_pages_by_a_given_function(spark):
    f = spark.createDataFrame([("a", b"x|y"), ("b", b"")], "path string, content binary")

    def extract(content):
        if not content:
            raise ValueError
        return content.decode().split("|")

    assert sorted(map(tuple, files.pdf_pages(f, extract).collect()), key=str) == [("a", 1, "x"), ("a", 2, "y"), ("b", None, None)]


def test_kinds_of_files_and_surnames(spark):
    f = spark.createDataFrame([("a/x.PDF",), ("a/README",), ("b.md",), ("c.xyz",), (".bashrc",)], "path string")
    assert {r["path"]: r["kind"] for r in pii.file_kinds(f).collect()} == {"a/x.PDF": "binary", "a/README": "text", "b.md": "text", "c.xyz": "other", ".bashrc": "text"}
    got = [r["fragment"] for r in pii.hits(docs(spark, "姓名: 卞和\n作者：某某", None, "")).collect()]
    assert got == ["姓名: 卞和"]
    assert tuple(reports.pii_verdict(docs(spark, "a.b@mail5.test.org\n海山研究院")).first()) == (1, 1, 1, 1)
