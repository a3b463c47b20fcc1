import pytest

from scriptorium.operators import cites

TEXT = """## 一、甲
甲说[3]。乙说[1-2]。丙说[3,5]。

## 二、乙
丁说[1]。

## 参考文献

[1] 张三. 甲[J]. 刊, 2020(1): 1-5.
[2] 李四. 乙[J]. 刊, 2021(2): 6-9.
[3] 王五. 丙[J]. 刊, 2022(3): 10-12.
[4] 张三.甲[J].刊,2020(1):1-5.
[7] 赵六. 丁[J]. 刊, 2023(4): 13-15.
[7] 钱七. 戊[J]. 刊, 2024(5): 16-18.
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "无列表[1]")], "doc_id long, text string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_occurrences_are_in_order_and_ranges_expand(docs):
    assert [r[2] for r in rows(cites.citations(docs), "occ", "pos", "num")] == [3, 1, 2, 3, 5, 1]


def test_cited_against_listed(docs):
    assert rows(cites.cite_missing(docs), "num") == [(5,)]
    assert rows(cites.cite_extra(docs), "num") == [(4,), (7,)]
    assert rows(cites.cite_gaps(docs), "first", "last") == [(5, 6)]
    assert rows(cites.cite_dup_numbers(docs), "num", "n") == [(7, 2)]
    assert rows(cites.cite_zombies(docs), "first_num", "num") == [(1, 4)]
    assert rows(cites.cite_order_mismatch(docs), "num") == [(1,), (2,), (3,), (5,)]


def test_renumbering(docs):
    got = {r["old"]: r["new"] for r in cites.renumber_map(docs).collect()}
    assert got == {3: 1, 1: 2, 2: 3, 5: 4, 7: 5}
    body = cites.renumber_body(docs).first()["body"]
    assert "甲说[1]。乙说[2][3]。丙说[1][4]。" in body and "丁说[2]。" in body
    lines = {r["new"]: r["line"] for r in cites.renumber_refs(docs).collect()}
    assert lines[4] == "[4] [待补：原编号 5 的文献条目缺失]" and lines[5].startswith("[5] 赵六")


def test_renumbered_twice_is_renumbered_once(spark, docs):
    text = cites.renumber_body(docs).first()["body"] + "## 参考文献\n\n" + "\n".join(r["line"] for r in cites.renumber_refs(docs).orderBy("new").collect())
    again = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert all(r["old"] == r["new"] for r in cites.renumber_map(again).collect())
    assert not cites.cite_missing(again).collect()


@pytest.mark.parametrize(("raw", "shown"), [("1,2,3,5", "1-3, 5"), ("1,2", "1, 2"), ("9-2", "9"), ("1-400", "1"), ("1-3,5", "1-3, 5")])
def test_ranges(spark, raw, shown):
    d = spark.createDataFrame([(1, f"甲[{raw}]\n## 参考文献")], "doc_id long, text string")
    assert cites.compress_ranges(d).first()["shown"] == shown


def test_notes(spark):
    d = spark.createDataFrame([(1, "甲[^1]。乙[^3]。\n\n[^1]: 某书。\n[^2]: 某文。")], "doc_id long, text string")
    assert rows(cites.footnote_missing(d), "num") == [(3,)]
    assert rows(cites.footnote_unused(d), "num") == [(2,)]
    assert rows(cites.footnote_resolve(d), "num", "definition") == [(1, "某书。")]
    assert cites.mode_detect(d).first()["mode"] == "footnote"


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    for operator in (cites.citations, cites.ref_entries, cites.renumber_map, cites.renumber_body, cites.cite_summary, cites.footnotes):
        assert operator(d).collect() == []


def test_strict_renumbering_is_refused(docs):
    r = cites.renumber(docs).first()
    assert (r["status"], r["missing"], r["body"], r["refs"]) == (1, 1, None, None)
    r = cites.renumber(docs, allow_missing=True, keep_uncited=False).first()
    assert (r["status"], r["changed"]) == (0, 4) and r["refs"].endswith("缺失]\n") and "赵六" not in r["refs"]
    r = cites.renumber(docs, allow_missing=True, merge=False).first()
    assert "[5] 张三" in r["refs"] and "[6] 赵六" in r["refs"]


def test_runs_of_new_numbers(spark):
    text = "甲[1-3]乙[5,1]。\n## 参考文献\n\n[1] a\n[2] b\n[3] c\n[5] e"
    d = spark.createDataFrame([(1, text), (2, "无引用\n## 参考文献\n[1] a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["status"], r["body"]) for r in cites.renumber(d, compress=True).collect()}
    assert got == {1: (0, "甲[1-3]乙[1][4]。\n"), 2: (2, None)}


def test_verdicts(spark, docs):
    r = cites.cite_verdict(docs).first()
    assert (r["missing"], r["extra"], r["gaps"], r["repeated"], r["zombies"], r["mismatch"], r["status"]) == (1, 2, 2, 1, 1, 4, 1)
    assert (r["cited_shown"], r["mismatch_shown"]) == ("[1] [2] [3] [5]", "[3] [1] [2] [5]")
    d = spark.createDataFrame([(1, "甲[^1]。乙[^3]。\n\n[^1]: 某书。\n[^2]: 某文。"), (2, "甲[^1]\n[^1]: 书"), (3, "无"), (4, None)], "doc_id long, text string")
    assert rows(cites.footnote_verdict(d), "doc_id", "missing", "unused", "gaps", "status") == [(1, 1, 1, 0, 1), (2, 0, 0, 0, 0)]


def test_high_numbers_cost_no_more_than_low_ones(spark):
    d = spark.createDataFrame([(1, "甲[999999999999]\n## 参考文献\n[999999999999] a\n[99999999999999999999] b")], "doc_id long, text string")
    assert rows(cites.cite_gaps(d), "first", "last") == [(1, 999999999998)]


def test_citations_in_the_list_say_nothing_of_the_mode(spark):
    d = spark.createDataFrame([(1, "甲[^1]\n[^1]: 书\n## 参考文献\n[1] a"), (2, "甲[1]\n[^1]: 书\n## 参考文献\n[1] a"), (3, "")], "doc_id long, text string")
    assert rows(cites.mode_detect(d), "doc_id", "mode") == [(1, "footnote"), (2, "journal"), (3, "error")]
