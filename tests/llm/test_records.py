from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import encoding, lookalike, loose, survivors, terms

CHINESE = "论数据授权的法理与边界：以平台为例"


@pytest.mark.parametrize("codec", ["latin-1", "cp1251", "mac_roman", "gb18030", "cp932"])
def test_utf8_misread(codec):
    for text in (CHINESE, "商标、标准与合规：展开之维"):
        bad = text.encode().decode(codec, "replace")
        found, restored, how = encoding.examine(bad)
        assert found, how
        if "�" not in bad:
            assert restored == text


def test_partly_and_twice_misread():
    part = "平台" + "责任与清算".encode().decode("latin-1") + "之维"
    assert encoding.examine(part)[:2] == (True, "平台责任与清算之维")
    twice = CHINESE.encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.examine(twice)[:2] == (True, CHINESE)
    assert encoding.examine("VerhÃ¤ltnismÃ¤ÃŸigkeit")[:2] == (True, "Verhältnismäßigkeit")
    assert encoding.examine("数据处罚的逻辑".encode("gbk").decode("latin-1"))[:2] == (True, "数据处罚的逻辑")
    assert encoding.examine("商标流转何以概括".encode("gbk").decode("cp950", "replace"))[0]
    assert encoding.examine("平台".encode("gbk").decode("utf-8", "replace"))[0]


@pytest.mark.parametrize("text", [None, "", "plain", CHINESE, "Суд and νόμος: scope", "Über die Größe, déjà vu, À L’ÉPREUVE", "崟琤珩、吕堇屿", "孔筠荞；谢纾旻", "«Ça» Ñandú", "Ａ１", "Рёв 1999"])
def test_well_read_text_is_left_alone(text):
    assert encoding.examine(text) == (False, None, None)


def test_garbled_fields(spark):
    rows = [(1, "Ã©tÃ©", None, "x"), (2, "ok", "", "x"), (3, None, CHINESE.encode().decode("latin-1"), "x")]
    d = spark.createDataFrame(rows, "id long, title string, abstract string, field_name string")
    got = {(r["id"], r["field_name"]): r["restored"] for r in encoding.garbled(d, ["title", "abstract"]).collect()}
    assert got == {(1, "title"): "été", (3, "abstract"): CHINESE}
    assert encoding.garbled(d.limit(0), ["title"]).collect() == []


@pytest.mark.parametrize(
    ("value", "form"),
    [("ＡＩ与数据", "AI与数据"), ("АI时代", "AI时代"), ("Суд and νόμος", "Суд and νόμος"), ("a​b­c", "abc"), ("a\xa0b　c", "a b c"), ("理⽤", "理用"), ("é", "é"), ("2O01年", "2001年"), ("CO2", "CO2"), ("“题”——：", "“题”——："), ("", "")],
)
def test_titles_have_one_form(spark, value, form):
    d = spark.createDataFrame([("title", value), ("title", value)], "field_name string, value string")
    assert [(r["canonical"], r["n"]) for r in lookalike.canonical(d).collect()] == [(form, 2)]


@pytest.mark.parametrize(("value", "form"), [("１２–１５", "12-15"), ("l34-l4I", "134-141"), ("S１2-S2O", "S12-S20"), ("pp.1~2", "pp.1~2"), ("—", "—"), ("lo-2o", "10-20"), ("A03", "A03")])
def test_pages_have_one_form(spark, value, form):
    d = spark.createDataFrame([("pages", value)], "field_name string, value string")
    assert lookalike.canonical(d).first()["canonical"] == form


def test_odd_fields(spark):
    d = spark.createDataFrame([(1, "ＡＩ", None), (2, "AI", "1-2"), (3, None, "1−2"), (4, "é", ""), (5, "é", None)], "id long, title string, pages string")
    assert sorted((r["id"], r["field_name"]) for r in lookalike.odd_fields(d, ["title", "pages"]).collect()) == [(1, "title"), (3, "pages"), (4, "title")]


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, authors string, source_file string")


def test_loose_copies(spark):
    rows = [
        (1, "Advertising registry: failure", "Varovic, Noor and Ash, Bo", "A-1.txt"),
        (2, "\tadvertising  registry failure.", "Bo Ash; NOOR VAROVIC", "(a) 1.TXT"),
        (3, "Advertising registry: failure", None, "A-1.txt"),
        (4, "Advertising registry: failure", " ", "A-1.txt"),
        (5, "Verhältnismäßigkeit", "蒋 珩;卫崟", "f"),
        (6, "VERHÄLTNISMÄSSIGKEIT", "卫崟，蒋珩", "F"),
        (7, None, None, None), (8, "", "", ""), (9, "x", "y", "z"), (10, "x", "y2", "z"),
    ]
    d = records(spark, rows)
    assert sorted((r["id_a"], r["id_b"]) for r in loose.pairs(d).collect()) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert {r["id"]: r["copies"] for r in loose.collapse(d).collect()} == {1: 2, 3: 2, 5: 2, 7: 2, 9: 1, 10: 1}
    assert loose.pairs(records(spark, [])).collect() == []


def test_a_hot_class_gives_every_pair(spark):
    n = 1300
    d = spark.range(n).select("id", F.lit("T").alias("title"), F.when(F.col("id") % 2 == 0, "a b").otherwise("B, A").alias("authors"), F.lit("f").alias("source_file"))
    assert loose.pairs(d).distinct().count() == loose.pairs(d).count() == n * (n - 1) // 2


def test_terms_by_brute_force(spark):
    import random

    random.seed(3)
    lists = [[random.choice("abcdefghij" if random.random() < 0.1 else "ab") + str(random.randint(0, 3)) for _ in range(random.randint(0, 6))] for _ in range(400)]
    d = spark.createDataFrame([(i, "k", x) for i, x in enumerate(lists)] + [(999, "j", ["hot"])] * 3 + [(1000, "j", None)], "id long, field_name string, values array<string>")
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["records"]) for r in terms.count_terms(d).collect()}
    occ, rec = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    assert got == {("k", t): (n, rec[t]) for t, n in occ.items()} | {("j", "hot"): (3, 3)}
    marks = {r["term"]: r["mark"] for r in terms.marked_terms(d, 404, rare=2, common=0.1).where("field_name = 'k'").collect()}
    assert marks == {t: "rare" if n <= 2 else "common" if n > 40.4 else None for t, n in rec.items()}
    assert terms.count_terms(d.limit(0)).collect() == []


def test_terms_counted_the_light_way_too(spark, monkeypatch):
    d = spark.createDataFrame([(i, "k", [f"t{i % 7}", "x"]) for i in range(100)], "id long, field_name string, values array<string>")
    want = sorted(terms.count_terms(d).collect())
    monkeypatch.setattr(terms, "HEAVY", 1)
    assert sorted(terms.count_terms(d).collect()) == want


def grouped(spark):
    t = datetime(2020, 1, 1)
    long = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳。"
    bib = [(1, "1-9", "10.1/ab.2020.1", long + "后文。", "3", "f1"), (2, "1-", "10.1/", long, None, "f2"), (3, "1-8", "10.1/ab.2020.2", "N/A", "无", "f3"), (4, "2-3", "n/a", None, "7", "nowhere"), (5, "—", " ", "", "null", "f1")]
    files = [("f1", "A", 1, t, t), ("f2", "B", 5, t, t), ("f3", "C", 5, t, datetime(2021, 1, 1)), ("f3", "C", 2, t, t)]
    members = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 4), (3, 5), (4, 404)]
    return (
        spark.createDataFrame(members, "group_id long, id long"),
        spark.createDataFrame(bib, "id long, pages string, doi string, abstract string, volume string, source_file string"),
        spark.createDataFrame(files, "source_file string, site string, trust int, exported_at timestamp, loaded_at timestamp"),
        ["pages", "doi", "abstract", "volume"],
    )


def test_survivors(spark):
    got = {(r["group_id"], r["field_name"]): r["id"] for r in survivors.survivors(*grouped(spark)).collect()}
    assert got == {(1, "pages"): 3, (1, "doi"): 3, (1, "abstract"): 1, (1, "volume"): 1, (2, "pages"): 4, (2, "volume"): 4}


def test_truth_discovery(spark):
    members, bib, files, fields = grouped(spark)
    got = {(r["group_id"], r["field_name"]): r["value"] for r in survivors.truths(members, bib, files, fields).collect()}
    assert got[1, "volume"] == "3" and got[2, "pages"] == "2-3" and (3, "pages") not in got
    assert survivors.truths(members.limit(0), bib, files, fields).collect() == []


def test_truths_of_fields_cut_short(spark):
    t = datetime(2020, 1, 1)
    bib = [(1, "1-", "10.1/", "甲乙...", "3", "f1"), (2, "1-", "10.1/", "甲乙丙。", None, "f2"), (3, "1-9", "10.1/", None, None, "f1"), (4, "4-", None, None, "?", "f1")]
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "group_id long, id long")
    records = spark.createDataFrame(bib, "id long, pages string, doi string, abstract string, volume string, source_file string")
    files = spark.createDataFrame([("f1", "A", 1, t, t), ("f2", "B", 5, t, t)], "source_file string, site string, trust int, exported_at timestamp, loaded_at timestamp")
    fields = ["pages", "doi", "abstract", "volume"]
    got = {(r["group_id"], r["field_name"]): (r["value"], r["votes"]) for r in survivors.truths(members, records, files, fields).collect()}
    # a whole value goes before any number of those cut short; a field with nothing else keeps them
    assert got == {(1, "pages"): ("1-9", 1), (1, "doi"): ("10.1/", 3), (1, "abstract"): ("甲乙丙。", 1), (1, "volume"): ("3", 1), (2, "pages"): ("4-", 1)}
    assert set(got) == {(r["group_id"], r["field_name"]) for r in survivors.survivors(members, records, files, fields).collect()}


def test_short_abstracts_that_go_on(spark):
    whole, cut = "甲乙丙丁。戊己庚。", "甲乙丙丁。"
    columns = "id long, source_file string, pages string, doi string, abstract string, volume string"
    records = spark.createDataFrame([(1, "a", None, None, cut, None), (2, "b", None, None, whole, None), (3, "a", None, None, cut, None), (4, "b", None, None, "子丑。", None), (5, "a", None, None, "子。", None)], columns)
    files = spark.createDataFrame([("a", 5, "2020", "2020", "s"), ("b", 1, "2020", "2020", "t")], "source_file string, trust int, exported_at string, loaded_at string, site string").selectExpr("source_file", "trust", "timestamp(exported_at || '-01-01') AS exported_at", "loaded_at", "site")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (3, 5)], "group_id long, id long")
    got = {r["group_id"]: r["id"] for r in survivors.survivors(members, records, files, ["abstract"]).collect()}
    assert got == {1: 2, 2: 3, 3: 5}


def test_members_of_hot_ways_of_writing(spark):
    rows = [(i, "Title" if i % 3 else "title!", "A; B", "f") for i in range(1500)] + [(i, f"t{i}", None, "f") for i in range(1500, 1600)] + [(2000, "t1500", None, "f"), (2001, "t1501", "", "f")]
    d = spark.createDataFrame(rows, "id long, title string, authors string, source_file string")
    got = {r["id"]: (r["class_id"], r["copies"]) for r in loose.members(d).collect()}
    assert len(got) == 1504 and got[7] == (0, 1500) and got[2000] == (1500, 2) and got[2001] == (1501, 2)


@pytest.mark.parametrize("title", ["Реестр and νόμος: ｄesign of labour escrow", "SaаЅ时代商标程序的完善", "La fidélité\xa0et la équité", "“任意性合规”：\xad\xad食品法", "Реес\u200dтр and νόμος"])
def test_foreign_words_and_look_alikes_are_not_garbled(title):
    assert encoding.examine(title) == (False, None, None)


def test_a_latin_letter_read_as_a_wide_character():
    assert encoding.examine("M眉ller")[1] == "Müller" and encoding.examine("基于web的")[0] is False


def test_composed_letters_are_the_canonical_ones(spark):
    d = spark.createDataFrame([(1, "b\u01a1", None), (2, "bo\u031b", None), (3, "Vie\u0323\u0302t", "I-9"), (4, "Vi\u1ec7t", "3-II"), (5, "\uff45\u0301", "A1-A2")], "id long, title string, pages string")
    got = sorted((r["id"], r["field_name"]) for r in lookalike.odd_fields(d, ["title", "pages"]).collect())
    assert got == [(2, "title"), (3, "pages"), (3, "title"), (4, "pages"), (5, "title")]
