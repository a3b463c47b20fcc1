from difflib import SequenceMatcher

import pytest

from scriptorium.operators import lines, quality, trace

A = "甲制度的核心功能在于对市场主体的行为进行事前的规范与引导"
B = "甲制度的核心作用在于对市场主体的行为进行事先的规范与引导"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_sentences_keep_their_stops(spark):
    got = [r["sentence"] for r in lines.sentences(docs(spark, "甲。乙！丙\n# 题\n> 引\n丁；", None, "")).orderBy("line_no", "sent_no").collect()]
    assert got == ["甲。", "乙！", "丙", "丁；"]


def test_stats_of_empty_and_null_texts(spark):
    got = {r["doc_id"]: (r["n_sentences"], r["n_chars"]) for r in quality.doc_stats(docs(spark, "甲乙[1]。", None, "", " \t\n")).collect()}
    assert got == {1: (1, 2), 3: (0, 0), 4: (0, 0)}


def test_quantiles_follow_the_index_rule(spark):
    text = "\n".join("字" * n + "。" for n in (3, 5, 8, 13, 21, 34, 55, 89, 144, 233))
    r = quality.sentence_quantiles(docs(spark, text)).first()
    assert (r["q50"], r["q75"], r["q90"], r["longest"], r["over_100"]) == (34, 89, 233, 233, 2)


def test_near_sentences(spark):
    d = docs(spark, f"{A}。\n{B}。\n{A}。")
    assert SequenceMatcher(None, A, B).ratio() >= 0.65
    got = {(r["line_no"], r["copies"]): r["links"] for r in quality.near_dup_ratio(d, 0.65).collect()}
    assert got == {(1, 2): 1, (2, 1): 1}
    assert {r["links"] for r in quality.near_dup_jaccard(d, 0.78).collect()} == {1}
    assert {r["links"] for r in quality.near_dup_jaccard(d, 0.79).collect()} == {0}


def test_prefix_filter_loses_no_pair(spark):
    import random

    random.seed(7)
    words = ["".join(random.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄", k=24)) for _ in range(60)]
    got = sum(r["links"] for r in quality.near_dup_jaccard(docs(spark, "。\n".join(words)), 0.7).collect())
    sets = [set(w) for w in dict.fromkeys(words)]
    want = sum(len(a & b) / len(a | b) >= 0.7 for a in sets for b in sets if a is not b)
    assert got == want > 0


def test_ngrams(spark):
    got = quality.repeated_ngrams(docs(spark, "一二三四五六七八九十甲乙。\n" * 3)).orderBy("rank").collect()
    assert [(r["gram"], r["hits"]) for r in got] == [("一二三四五六七八九十", 3), ("二三四五六七八九十甲", 3), ("三四五六七八九十甲乙", 3)]


def test_version_curve(spark):
    sizes = [9871, 12716, 13712, 5837]
    rows = [(i, "字" * n, "P", i, None) for i, n in enumerate(sizes)] + [(9, "字", "Q", 1, None), (10, "字", None, 1, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, project string, version int, saved_at timestamp")
    got = [(r["change"], r["collapsed"]) for r in quality.version_curve(d).where("project = 'P'").orderBy("version").collect()]
    assert [round(c, 1) if c is not None else None for c, _ in got] == [None, 28.8, 7.8, -57.4]
    assert [x for _, x in got] == [False, False, False, True]


def test_uniformity(spark):
    r = trace.uniformity(docs(spark, "\n".join("字" * n for n in (31, 35, 33, 120, 40)))).first()
    assert (round(r["mean"], 1), round(r["sd"], 3), round(r["cv"], 4)) == (51.8, 34.231, 0.6608)


def test_density_and_vague(spark):
    d = docs(spark, "值得注意的是甲，与此同时乙，进一步丙", "学界普遍认为甲", "学界普遍认为甲，学界普遍乙")
    assert [(r["doc_id"], r["total"]) for r in trace.lexicon_density(d).collect()] == [(1, 3)]
    got = sorted((r["doc_id"], r["phrase"], r["hits"]) for r in trace.vague_attribution(d).collect())
    assert [g for g in got if g[0] == 2] == [(2, "学界普遍认为", 1)]
    assert (3, "学界普遍", 2) in got and (3, "学界普遍认为", 1) in got


def test_abstract_and_self_reference(spark):
    r = trace.self_reference(docs(spark, "# 题\n## 摘 要\n本文甲\n## 一\n本文乙，笔者认为")).first()
    assert (r["in_abstract"], r["in_rest"], r["first_person"]) == (1, 1, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("甲,乙,丙.丁\"引\"...don't '某'。。。2023—2026", "甲，乙，丙。丁“引”……don't ‘某’……2023-2026"),
        ('"甲\n"乙"', "“甲\n“乙”"),
        (None, None),
        ("", ""),
    ],
)
def test_punctuation(spark, text, want):
    from pyspark.sql import functions as F

    d = docs(spark, text)
    assert d.select(trace.normalize_doc(F.col("text"), True)).first()[0] == want


def test_near_pairs_equal_brute_force_across_blocks(spark, monkeypatch):
    import random

    random.seed(11)
    base = ["".join(random.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄", k=random.randint(20, 60))) for _ in range(20)]
    texts = base + ["".join(c for c in t if random.random() > 0.15) + t[:3] for t in base] + base[:3]
    monkeypatch.setattr(quality, "BLOCK", 16)
    d = docs(spark, "。\n".join(texts), None, "")
    got = {(r["line_a"], r["line_b"]): (r["overlap"], r["score"]) for r in quality.near_pairs(d, 0.65, "top", 10_000).collect()}
    first = {t: i + 1 for i, t in reversed(list(enumerate(texts)))}
    norm = [t for t in first if len(t) >= 20]
    norm.sort(key=first.get)
    want = {}
    for i, a in enumerate(norm):
        for b in norm[i + 1 :]:
            overlap = len(set(a) & set(b)) / len(set(a) | set(b))
            score = max(overlap, SequenceMatcher(None, a, b).ratio()) if overlap >= 0.65 - 0.25 else 0
            if score >= 0.65:
                want[first[a], first[b]] = (overlap, score)
    assert got == want and len(want) > 10
    links = sum(r["links"] for r in quality.near_dup_ratio(d).collect())
    assert links == 2 * len(want) and {r["copies"] for r in quality.near_dup_ratio(d).collect()} == {1, 2}
    top = [round(s, 6) for _, s in sorted(want.values(), key=lambda v: -v[1])][:15]
    assert sorted((r["score"] for r in quality.top_near_pairs(d).collect()), reverse=True) == top


@pytest.mark.parametrize(("a", "b"), [("abcabcab" * 30, "bcabca" * 40), ("", ""), ("甲", ""), ("甲乙丙丁", "丙丁甲乙"), ("ababab", "bababa")])
def test_matching_ratio_is_that_of_the_standard_library(a, b):
    assert quality.matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_five_checks(spark):
    s = "甲制度的核心功能在于对市场主体的行为进行事前规范。"
    d = docs(spark, f"{s}\n" * 4, "短。", "事实上，甲。实际上，乙。事实上，丙。", "字" * 151 + "。", None)
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.health_verdict(d).collect()}
    assert got == {1: (6, 0, 0, 0, 10, 1), 2: (0, 0, 0, 0, 0, 0), 3: (0, 0, 0, 1, 0, 1), 4: (0, 1, 0, 0, 1, 1)}


def test_longest_and_baseline(spark):
    d = docs(spark, "\n".join("字" * n + "。" for n in (160, 600, 160)))
    got = [(r["kind"], r["rank"], r["chars"], r["line_no"]) for r in quality.longest(d).orderBy("kind", "rank").collect()]
    assert got == [("paragraph", 1, 600, 2), ("sentence", 1, 600, 2), ("sentence", 2, 160, 1), ("sentence", 3, 160, 3)]
    r = quality.doc_stats(docs(spark, "字" * 60 + "。"), 50.0).first()
    assert (r["deviation"], r["near"]) == (20.0, True)


def test_bars_round_halves_to_even(spark):
    d = docs(spark, "前\n## 一\n" + "字" * 500 + "\n## 二\n" + "字" * 300)
    assert [(r["section"], r["title"], r["bar"]) for r in quality.section_stats(d).orderBy("section").collect()] == [(0, "（前言）", "█"), (1, "一", "██"), (2, "二", "██")]


LISTED = "\n".join("字" * n for n in (31, 35, 33, 120, 40))
REFERENCES = "\n## 参考文献\n" + "\n".join(f'[{i}] 张三. "甲"[J]. 刊, 2020: 1-9. 这一条目写得足够长以便算作段落而且没有别的意思' for i in range(1, 41))


def test_the_reference_list_is_not_scanned(spark):
    d = docs(spark, LISTED + "\n", LISTED + REFERENCES)
    for operator in (trace.uniformity, trace.punct_profile, trace.self_reference, trace.trace_verdict, trace.heading_system):
        one, two = (tuple(r)[1:] for r in operator(d).orderBy("doc_id").collect())
        assert one == two
    assert trace.trace_verdict(d).first()["findings"] == ""


def test_an_abstract_of_several_lines_is_one_paragraph(spark):
    d = docs(spark, "题\n## 摘 要\n值得注意的是甲。\n与此同时乙，\n进一步丙。\n## 一\n正文", "# 摘要\n本文")
    assert [(r["doc_id"], r["line_no"], r["total"]) for r in trace.lexicon_density(d).collect()] == [(1, 0, 3)]
    assert [(r["abstract"], r["rest"]) for r in trace.abstract_split(d).orderBy("doc_id").collect()] == [("值得注意的是甲。\n与此同时乙，\n进一步丙。", "题\n## 一\n正文"), ("本文", "")]
    assert [r["line_no"] for r in trace.scan(d.where("doc_id = 1")).selectExpr("explode(paras) AS p").select("p.line_no").collect()] == [0, 1, 7]
    got = {r["doc_id"]: (r["severe"], r["warnings"], r["findings"], r["status"]) for r in trace.trace_verdict(d).collect()}
    assert got == {1: (1, 0, "dense:1", 1), 2: (1, 0, "abstract_self:1", 1)}


def test_headings_of_both_kinds(spark):
    r = trace.heading_system(docs(spark, "## 1 甲\n## 一、乙\n### 2.1 丙\n### （二）丁")).first()
    assert tuple(r)[1:] == (1, 1, 1, 1, True)
