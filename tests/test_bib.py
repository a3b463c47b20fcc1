from pyspark.sql import functions as F

from scriptorium.operators import bib, unpack
from scriptorium.sources import files

REFWORKS = """RT Journal Article
A1 张三
A1 李四
T1 示例制度研究
JF 示例法学
YR 2022
vo 
IS 6
OP 115-127
K1 示例;制度
AB 第一行摘要
第二行摘要
is a lost line
第四行摘要
RT Journal Article
A1 张三
T1 《示例制度》研究
JF 示例法学
YR 2023
RT Dissertation
A1 王五
YR 2020
"""
ENDNOTE = "%0 Journal Article\n%A 张三\n%+ 示例大学\n%T 示例制度研究\n%J 示例法学\n%D 2022\n%N 6\n%P 115-127\n%R 10.0000/x\n%X 摘要一\n续行\n"
ROW = "id int, type string, authors string, title string, journal string, year string, volume string, issue string, pages string, doi string, abstract string, source_file string"


def exports(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "export_id long, text string")


def test_refworks(spark):
    e = exports(spark, REFWORKS)
    assert bib.detect_format(e).first()["fmt"] == "refworks"
    got = bib.records(e).orderBy("rec").collect()
    assert len(got) == 2
    r = got[0]
    assert (r["authors"], r["title"], r["volume"], r["abstract"]) == ("张三; 李四", "示例制度研究", "", "第一行摘要 第二行摘要")
    d = bib.records(e).withColumns({"id": F.col("rec")})
    assert [(x["id"], x["copies"]) for x in bib.dedupe(d).collect()] == [(1, 2)]


def test_endnote(spark):
    e = exports(spark, ENDNOTE, "\n\n", None)
    assert [r["fmt"] for r in bib.detect_format(e).collect()] == ["endnote"]
    r = bib.records(e, "endnote").first()
    assert (r["doi"], r["abstract"], r["volume"]) == ("10.0000/x", "摘要一 续行", "")


def test_styles(spark):
    rows = [
        (1, "Journal Article", "张三; 李四", "示例制度研究", "示例法学", "2022", "", "6", "115-127", "", "", ""),
        (2, "Journal Article", "甲;乙；丙; 丁", "T", "J", "2020", None, None, " 88 — 112 ", "", "", ""),
        (3, "Journal Article", "", "T", "J", "2020", "", "", "", "", "", ""),
        (4, "Dissertation", "甲", "T", "", "2020", "", "", "", "", "", ""),
        (5, "Book", "甲", "T.", "J", "2020", "", "", "", "", "", ""),
        (6, None, None, None, None, None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, ROW)
    gbt = {r["id"]: r["entry"] for r in bib.format_gbt(d).collect()}
    assert gbt[1] == "张三, 李四. 示例制度研究[J]. 示例法学, 2022(6): 115-127."
    assert gbt[2] == "甲, 乙, 丙, 等. T[J]. J, 2020: 88-112."
    assert gbt[3].startswith(". T[J]") and gbt[4] == "甲. T[D]. 2020." and gbt[5] == "甲. T[M]. J, 2020."
    law = {r["id"]: r["entry"] for r in bib.format_law(d).collect()}
    assert law[1] == "张三、李四：《示例制度研究》《示例法学》2022年第6期、第115—127页。"
    assert [r["id"] for r in bib.missing_pages(d).orderBy("id").collect()] == [3, 6]


def test_entries_hold_no_doi(spark):
    schema = "id long, type string, authors string, title string, journal string, year string, volume string, issue string, pages string"
    rows = [(1, "J", "A  B", "T\t t doi： 10.1/x y", "J　J", "2020", "", "", ""), (2, "J", "", "Uhttp://dx.doi.org/10.1/z  v", "K", "2021", "", "", "")]
    d = spark.createDataFrame(rows, schema)
    assert [r["entry"] for r in bib.format_gbt(d).orderBy("id").collect()] == ["A B. T t y[J]. J J, 2020.", ". U v[J]. K, 2021."]
    assert [r["entry"] for r in bib.format_law(d).orderBy("id").collect()] == ["A B：《T t y》《J J》2020年。", "《U v》《K》2021年。"]
    assert bib.format_gbt(d, keep_doi=True).orderBy("id").first()["entry"] == "A  B. T\t t doi： 10.1/x y[J]. J　J, 2020."


def packed(spark, authors, keywords):
    d = spark.createDataFrame([(i, a, k) for i, (a, k) in enumerate(zip(authors, keywords, strict=True))], "id long, authors string, keywords string")
    got = {}
    for r in unpack.unpack(d, ["authors", "keywords"]).orderBy("id", "field_name", "pos").collect():
        got.setdefault((r["id"], r["field_name"]), []).append(r["value"])
    return got


def test_packed_fields(spark):
    known = [("张三; 李四", "甲权; 乙权; fair use"), ('"Ash, Tove"; "Berg, Bo"', "甲权；丙权"), ("Tove Ash; Bo L. Berg", "opt-out;甲权")] * 5
    cases = [
        ("Ash, Tove", "甲权 乙权 丙权"),
        ("Ash, Tove and Berg, Bo L.", '"notice, stay-down",甲权'),
        ("Tove Ash, Bo Berg and Cy Dahl", ';甲权;; "所谓""避风港""规则" ;甲权;'),
        ("尤 沅", "B2B/B2C$$甲·乙（丙）"),
        ("Ash, Tove;;Berg, Bo", "甲权|乙权;丙权"),
        (None, ""),
        (" \t", "a" * 50_000 + ";b"),
    ]
    got = packed(spark, *zip(*known, *[(a, k) for a, k in cases], strict=True))
    n = len(known)
    assert (n, "authors") not in got and got[n, "keywords"] == ["甲权", "乙权", "丙权"]
    assert got[n + 1, "authors"] == ["Ash, Tove", "Berg, Bo L."] and got[n + 1, "keywords"] == ["notice, stay-down", "甲权"]
    assert got[n + 2, "authors"] == ["Tove Ash", "Bo Berg", "Cy Dahl"] and got[n + 2, "keywords"] == ["甲权", '所谓"避风港"规则', "甲权"]
    assert (n + 3, "authors") not in got and got[n + 3, "keywords"] == ["B2B/B2C", "甲·乙（丙）"]
    assert got[n + 4, "authors"] == ["Ash, Tove", "Berg, Bo"] and got[n + 4, "keywords"] == ["甲权", "乙权", "丙权"]
    assert not {k for k in got if k[0] == n + 5}
    assert [len(v) for v in got[n + 6, "keywords"]] == [50_000, 1]


def test_rare_values_have_codes_beside_many_frequent_ones(spark):
    frequent = [chr(0x4E00 + i % 200) + chr(0x6000 + i // 200) for i in range(20_000)]
    lists = [";".join(frequent[i : i + 1000]) for i in range(0, 20_000, 1000)] * 3
    quoted = ['"甲乙 丙丁"; 天地', '"甲乙 丙丁"; 天地']
    got = packed(spark, [None] * (len(lists) + 4), lists + quoted + ["甲乙 丙丁", "甲乙 天地"])
    n = len(lists) + len(quoted)
    # known as one value, though 20,000 others are more frequent; the other field holds two
    assert (n, "keywords") not in got and got[n + 1, "keywords"] == ["甲乙", "天地"]


def test_packed_fields_of_an_empty_table(spark):
    assert packed(spark, [], []) == {}


def test_decoding():
    assert files.decode("甲".encode("utf-8-sig")) == ("甲", "utf-8-sig")
    assert files.decode(bytes([0xD6, 0xD0])) == ("中", "gb18030")
    assert files.decode(b"\xff") == ("�", "unknown(replaced)")
    assert files.decode(None) == (None, None)


def test_scan_detection(spark):
    d = spark.createDataFrame([(1, 1, ""), (2, 1, "字" * 100)], "doc_id long, page_no int, text string")
    assert {r["doc_id"]: (r["chars"], r["scanned"]) for r in files.scan_detect(d).collect()} == {1: (18, True), 2: (119, False)}
