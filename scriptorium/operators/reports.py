"""Reports, listings and packets as rows that are ready to be written: see ``sources.sinks``.

Each has one row for each document or line, so that any number of them is written at once. Null texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, literal_count, matches, strip, uncited
from scriptorium.operators import bib as records
from scriptorium.operators import cites, manuscript, pii, quality, trace
from scriptorium.operators.lines import body, sentence_array
from scriptorium.sources.files import scan_detect


def redundancy_report(docs: DataFrame, least: float = 0.65, long: int = 150, bloated: int = 500) -> DataFrame:
    """(doc_id, report): the redundancy check of each document with a text, as JSON."""
    b = body(F.col("text"))
    here = docs.where("text IS NOT NULL").select("doc_id", sentence_array(b).alias("s"), quality.section_array(b).alias("sections"), quality.bloated_array(b, bloated).alias("bloated"), quality.filler_array(b, 3).alias("filler"))
    near = quality.top_near_pairs(docs, least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "line_a", "sent_a", "line_b", "sent_b"))).alias("near"))  # at most 15
    chunks = quality.repeated_ngrams(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "gram", "hits"))).alias("chunks"))  # at most 10
    d = here.join(near, "doc_id", "left").join(chunks, "doc_id", "left")
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x["chars"])

    def sentence(line: Column, number: Column) -> Column:
        return F.get(F.filter("s", lambda x: (x["line_no"] == line) & (x["sent_no"] == number)), F.lit(0))["sentence"]

    def by_size(items: Column, text: str, most: int = 0) -> Column:
        keyed = F.array_sort(F.transform(items, lambda x, i: F.struct((-x["chars"]).alias("m"), i.alias("i"), x[text].alias("text"))))
        return F.transform(keyed, lambda x: F.struct((-x["m"]).alias("chars"), (F.left(x["text"], F.lit(most)) if most else x["text"]).alias("text")))

    pair = lambda x: F.struct(F.round(x["score"], 3).alias("score"), sentence(x["line_a"], x["sent_a"]).alias("a"), sentence(x["line_b"], x["sent_b"]).alias("b"))
    n = F.size("s")
    out = F.struct(
        total.alias("char_count"),
        n.alias("sentence_count"),
        F.round(total / F.greatest(F.lit(1), n), 1).alias("avg_sentence_len"),
        F.transform("sections", lambda x: F.struct(x["title"].alias("name"), x["chars"].alias("chars"))).alias("sections"),
        F.coalesce(F.transform("near", pair), F.array()).alias("near_duplicates"),
        by_size(F.filter("s", lambda x: x["chars"] > long), "sentence").alias("long_sentences"),
        by_size(F.col("bloated"), "text", 200).alias("bloated_paragraphs"),
        F.transform(F.slice("filler", 1, 12), lambda x: F.struct(x["label"].alias("phrase"), x["hits"].alias("count"))).alias("filler_phrases"),
        F.coalesce(F.transform("chunks", lambda x: F.struct(x["gram"].alias("chunk"), x["hits"].alias("count"))), F.array()).alias("repeated_chunks"),
    )
    return d.select("doc_id", F.to_json(out).alias("report"))


#: How the report of the trace scan names what it counts.
HEADING_NAMES = {"arabic_1": "阿拉伯一级(1 )", "arabic_2": "阿拉伯二级(1.1)", "chinese_1": "中文一级(一、)", "chinese_2": "中文二级(（一）)"}
PUNCT_NAMES = {"straight_quotes": "半角直双引号", "half_commas": "中文语境半角逗号", "half_stops": "中文语境半角句号", "dots": "半角省略号(...)"}


def trace_report(docs: DataFrame, density: int = 3) -> DataFrame:
    """(doc_id, report): the trace scan of each text, as JSON; severe and warn list marks with their counts."""
    d = trace.scanned_facts(docs)
    counts = lambda t, ws: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(w).alias("k"), literal_count(t, w).alias("n")) for w in ws]), lambda x: x["n"] > 0))
    dense = F.transform(trace.dense_paragraphs(F.col("paras"), density), lambda x: F.struct(x["line_no"].alias("line"), x["total"].alias("count"), x["chars"].alias("length")))
    vague = F.transform(let(F.col("clean"), trace.vague_array), lambda x: F.struct(x["w"].alias("phrase"), (-x["minus"]).alias("count")))
    tally = lambda h: F.transform(F.array_distinct(h), lambda p: F.struct(p.alias("phrase"), F.size(F.filter(h, lambda q: q == p)).alias("count")))
    infl = F.transform(F.filter(let(F.col("clean"), trace.inflated_array), lambda x: F.size(x["hits"]) > 0), lambda x: F.struct(x["category"].alias("category"), let(x["hits"], tally).alias("phrases")))
    even = F.when(F.col("e.paragraphs") >= 5, F.struct(F.round("e.mean", 1).alias("mean"), F.round("e.sd", 1).alias("sd"), F.round(F.col("e.sd") / F.col("e.mean"), 3).alias("cv")))
    parts = [
        F.size("paras").alias("paragraph_count"),
        dense.alias("density_hits"),
        vague.alias("vague_attribution"),
        F.struct(F.col("in_abstract").alias("abstract"), F.col("in_rest").alias("body")).alias("benwen"),
        F.col("first_person"),
        infl.alias("inflation"),
        counts(F.col("clean"), R.FORMULAIC).alias("formulaic"),
        counts(F.col("clean"), R.FILLER).alias("filler"),
        F.struct(F.col("dashes").alias("dash"), F.col("ellipses").alias("ellipsis"), "chars").alias("punct"),
        even.alias("uniformity"),
        F.struct(*[F.col(n).alias(label) for n, label in HEADING_NAMES.items()]).alias("heading_system"),
        F.struct(*[F.col(n).alias(label) for n, label in PUNCT_NAMES.items()]).alias("punct_cn"),
    ]
    found = lambda names: F.array_compact(F.array(*[F.when(F.col(f"m.{n}") > 0, F.concat(F.lit(f"{n}:"), F.col(f"m.{n}").cast("string"))) for n in names]))
    d = d.withColumn("m", F.struct(*[c.alias(n) for n, c in trace.mark_counts(density).items()]))
    return d.select("doc_id", F.to_json(F.struct(*parts, found(trace.SEVERE).alias("severe"), found(trace.WARNINGS).alias("warn"))).alias("report"))


def punct_report(docs: DataFrame) -> DataFrame:
    """(doc_id, double_quotes, single_quotes, commas, stops, dots, year_dashes, status): what the punctuation fixes would find in each text."""
    t, wide = F.col("text"), f"[{R.CJK_KANA}]"
    counts = {
        "double_quotes": literal_count(t, '"'),
        "single_quotes": matches(t, f"(?<={wide})'|'(?={wide})"),
        "commas": matches(t, f"(?<={wide}),(?={wide})"),
        "stops": matches(t, rf"(?<={wide})\.(?={wide})"),
        "dots": matches(t, r"\.{3,}"),
        "year_dashes": matches(t, rf"[0-9]{{4}}[{R.WS}]*[—–][{R.WS}]*[0-9]{{4}}"),
    }
    out = docs.where(t.isNotNull()).select("doc_id", *[c.alias(n) for n, c in counts.items()])
    return out.withColumn("status", (sum((F.col(n) for n in counts), F.lit(0)) > 0).cast("int"))


def normalized(docs: DataFrame, years: bool = False) -> DataFrame:
    """(doc_id, double_quotes, single_quotes, ellipses, marks, year_ranges, text): each text with its punctuation fixed, and how much of each kind was."""
    wide = f"[{R.CJK_KANA}]"
    out = docs.where("text IS NOT NULL").select("doc_id", F.col("text").alias("t"), literal_count(F.col("text"), '"').alias("double_quotes"))
    out = out.withColumn("t", trace.fix_double_quotes(F.col("t")))
    out = out.withColumns({"single_quotes": matches(F.col("t"), f"(?<={wide})'|'(?={wide})"), "t": trace.fix_single_quotes(F.col("t"))})
    out = out.withColumns({"ellipses": matches(F.col("t"), r"\.{3,}|。{2,}"), "t": trace.fix_ellipsis(F.col("t"))})
    fixed = out.withColumn("u", trace.fix_cjk_punct(F.col("t")))
    # Each fix puts one character for another, so what was fixed is what differs in number.
    kept = lambda c: F.length(F.regexp_replace(c, "[，。；：？！]", ""))
    out = fixed.select("doc_id", "double_quotes", "single_quotes", "ellipses", (kept(F.col("t")) - kept(F.col("u"))).alias("marks"), F.col("u").alias("t"))
    years_n = matches(F.col("t"), rf"[0-9]{{4}}[{R.WS}]*[—–][{R.WS}]*[0-9]{{4}}") if years else F.lit(0)
    text = trace.fix_year_range(F.col("t")) if years else F.col("t")
    return out.select("doc_id", "double_quotes", "single_quotes", "ellipses", "marks", years_n.alias("year_ranges"), text.alias("text"))


def pii_verdict(docs: DataFrame) -> DataFrame:
    """(doc_id, high, medium, status) of each text: its hits by severity; status 1 if there is any."""
    one = pii.hits(docs).select("doc_id", "severity").unionByName(pii.institutions(docs).select("doc_id", F.lit("中").alias("severity")))
    one = one.groupBy("doc_id").agg(F.count_if(F.col("severity") == "高").alias("high"), F.count_if(F.col("severity") == "中").alias("medium"))
    out = docs.where("text IS NOT NULL").select("doc_id").join(one, "doc_id", "left").fillna(0, ["high", "medium"])
    return out.withColumn("status", (F.col("high") + F.col("medium") > 0).cast("int"))


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, report): the hits of each text that has any, by line, as JSON."""
    found = pii.hits(docs).unionByName(pii.institutions(docs).select("doc_id", F.lit("单位信息").alias("category"), F.lit("中").alias("severity"), F.lit("疑似具体机构名").alias("description"), F.col("line_no").alias("line"), "fragment"))
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "category", "severity", "description", "fragment"))).alias("hits"))
    of = lambda s: F.size(F.filter("hits", lambda h: h["severity"] == s))
    return rows.select("doc_id", F.to_json(F.struct(of("高").alias("high"), of("中").alias("medium"), "hits")).alias("report"))


#: The names of the two styles in the head of a list.
STYLE_NAMES = {"gbt": "GB/T 7714 顺序编码制", "law": "法学引注手册体例"}


def reference_list(bib: DataFrame, style: str = "gbt", start: int = 1, keep_doi: bool = False) -> DataFrame:
    """(num, line): the list of references, numbered from start on in the order of ids."""
    entries = (records.format_gbt if style == "gbt" else records.format_law)(bib, keep_doi)
    out = records.numbered(entries, start)
    return out.select("num", F.concat(F.lit("["), F.col("num").cast("string"), F.lit("] "), "entry").alias("line"))


def reference_file(bib: DataFrame, source: str, style: str = "gbt", start: int = 1, keep_doi: bool = False, header: bool = True) -> DataFrame:
    """(num, text): the lines of a file of references; the head, which tells style, source and number, comes as start - 1."""
    rows = reference_list(bib, style, start, keep_doi).select("num", F.col("line").alias("text"))
    if not header:
        return rows
    head = bib.agg(F.count("*").alias("n")).select(F.lit(start - 1).cast("bigint").alias("num"), F.concat(F.lit(f"# 参考文献（{STYLE_NAMES[style]}）\n\n> 题录：`{source}`，共 "), F.col("n").cast("string"), F.lit(" 条\n")).alias("text"))
    return rows.unionByName(head)


def listing(bib: DataFrame, top: int = 10, abstract: int = 400) -> DataFrame:
    """(ord, text): a Markdown listing of records: head and most frequent journals as 0 and 1, then each record as its id + 1."""
    value = lambda f: F.coalesce(F.col(f), F.lit(""))
    some = lambda before, f, after="": F.when(value(f) != "", F.concat(F.lit(before), value(f), F.lit(after))).otherwise("")
    dash = lambda f: F.when(value(f) != "", value(f)).otherwise("—")
    cut_short = F.concat(F.left("abstract", F.lit(abstract)), F.when(F.length("abstract") > abstract, "…").otherwise(""))
    lines = [
        F.concat(F.lit("### ["), F.col("id").cast("string"), F.lit("] "), value("title"), F.lit("\n")),
        F.concat(F.lit("- 作者："), dash("authors")),
        F.concat(F.lit("- 出处："), dash("journal"), F.lit(" "), value("year"), some("，", "volume"), some("(", "issue", ")"), some("：", "pages")),
        F.when(value("keywords") != "", F.concat(F.lit("- 关键词："), value("keywords"))),
        F.when(value("abstract") != "", F.concat(F.lit("- 摘要："), cut_short)),
    ]
    rows = bib.select((F.col("id") + 1).cast("bigint").alias("ord"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))
    s = records.summary(bib)
    years = F.when(F.col("first_year").isNotNull(), F.concat(F.lit("- 年份范围："), "first_year", F.lit(" — "), "last_year"))
    head = F.concat_ws("\n", F.lit("# 题录清单\n"), F.concat(F.lit("- 记录数："), F.col("records").cast("string")), F.concat(F.lit("- 含摘要："), F.coalesce("with_abstract", F.lit(0)).cast("string")), years, F.concat(F.lit("- 来源文件："), "source_files", F.lit("\n")))
    best = records.top_journals(bib, top).withColumn("r", F.monotonically_increasing_id())  # in order, and in one part
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "journal", "n"))), lambda x: F.concat(F.lit("- "), x["journal"], F.lit("（"), x["n"].cast("string"), F.lit(" 篇）"))), "\n")
    journals = best.agg(shown.alias("t")).select(F.lit(1).cast("bigint").alias("ord"), F.when(F.col("t") != "", F.concat(F.lit("## 载文量前十期刊\n\n"), "t", F.lit("\n\n---\n\n## 题录明细\n"))).otherwise("## 题录明细\n").alias("text"))
    return s.select(F.lit(0).cast("bigint").alias("ord"), head.alias("text")).unionByName(journals).unionByName(rows)


#: What reviewers are asked, in words of our own: round, manuscript and further material are put in.
INSTRUCTIONS = """# 审稿任务说明（第 {round_no} 轮）

材料：`{manuscript}`{extra}。只凭这些材料审稿，不索要写作意图、修改记录和此前意见。

1. 核对事实：地名、机构、年份、案例、职务，以及每组数据的主体、时点与口径。
2. 核对引注：起止页码、发布日期、网址，正文编号与文末列表逐一对应。
3. 评价选题、论证、创新、文献与表达，先给总体评价与打分，再按优先级逐条列出问题。
4. 每条写明位置、原文、问题、可直接替换的修改文字与依据；不改动稿件本身。
5. 结果写入 `审稿意见_M{round_no}.md`，与稿件放在一起。
"""


def packet(docs: DataFrame, round_no: int = 1, extra: str | None = None, anonymize: bool = True, strip_todo: bool = False) -> DataFrame:
    """(doc_id, file, text): for each manuscript the cleaned text and what reviewers are asked, under their file names."""
    manuscript_name, task_name = f"审稿稿_M{round_no}.md", f"审稿任务说明_M{round_no}.md"
    task = INSTRUCTIONS.format(round_no=round_no, manuscript=manuscript_name, extra=f"、`{extra}`" if extra else "")
    clean = manuscript.packet_clean(docs, anonymize, strip_todo)
    two = F.array(F.struct(F.lit(manuscript_name).alias("file"), F.col("text").alias("text")), F.struct(F.lit(task_name).alias("file"), F.lit(task).alias("text")))
    return each(clean, ["doc_id"], two).select("doc_id", "x.file", "x.text")


def paged_text(pages: DataFrame, markers: bool = True) -> DataFrame:
    """(doc_id, file, text, scanned): the pages of each document in order, each after its marker line; scanned ones are written, too."""
    t = F.coalesce("text", F.lit(""))
    page = F.concat(F.lit("\n===== PAGE "), F.col("page_no").cast("string"), F.lit(" =====\n"), t) if markers else t
    rows = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page.alias("t")))), lambda x: x["t"]), "").alias("text"))
    scans = scan_detect(pages, markers=markers).select("doc_id", "scanned")
    return rows.join(scans, "doc_id").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "text", "scanned")


def run_counters(files: DataFrame, scans: DataFrame) -> DataFrame:
    """(ok, skipped, need_ocr, failed), one row: files (doc_id, skip) of a run, against the scans (doc_id, scanned) that came out of it.

    A file that was neither skipped nor came out has failed.
    """
    d = files.join(scans.select("doc_id", "scanned"), "doc_id", "left")
    skip, out = F.col("skip"), F.col("scanned")
    return d.agg(F.count_if(~skip & ~out).alias("ok"), F.count_if(skip).alias("skipped"), F.count_if(~skip & out).alias("need_ocr"), F.count_if(~skip & out.isNull()).alias("failed"))


def renumbered(docs: DataFrame, compress: bool = False, allow_missing: bool = False, keep_uncited: bool = True, merge: bool = True) -> DataFrame:
    """(doc_id, status, text): each manuscript under new numbers, whole; text is null where it is refused."""
    out = cites.renumber(docs, keep_uncited, merge, compress, allow_missing)
    return out.select("doc_id", "status", F.concat("body", "refs").alias("text"))
