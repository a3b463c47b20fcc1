"""Manuscripts as typed blocks, and their cleaning for reviewers.

Null texts have no rows. Blank lines before the header block don't end it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import matches, strip
from scriptorium.operators.lines import lines

META = rf"^>[{R.WS}]*({'|'.join(R.META_KEYS)})[{R.WS}]*[:：][{R.WS}]*([^\n]*)\z"
LAYOUT_META = rf"^>[{R.WS}]*({'|'.join(R.LAYOUT_KEYS)})[{R.WS}]*[:：][{R.WS}]*([^\n]+)\z"
KEYWORDS = rf"^\*{{0,2}}关键词\*{{0,2}}[{R.WS}]*[:：]"
REFS_LINE = rf"^#{{1,3}}[{R.WS}]*参考文献[{R.WS}]*\z"
#: Font, size in points, first-line indent and bold of each kind of block.
STYLES = [
    ("title", "黑体", 16.0, False, False), ("subtitle", "黑体", 14.0, False, False), ("author", "楷体", 12.0, False, False), ("running_head", "楷体", 9.0, False, False),
    ("abstract", "楷体", 12.0, True, False), ("keywords", "楷体", 12.0, False, False), ("h1", "黑体", 15.0, False, False), ("h2", "黑体", 12.0, False, False),
    ("quote", "楷体", 12.0, True, False), ("table", "宋体", 9.0, False, False), ("p", "宋体", 12.0, True, False), ("ref", "宋体", 10.5, False, False),
]
#: What lines of the header block are printed as.
META_KINDS = {"题目": "title", "副标题": "subtitle", "作者": "author", "页眉": "running_head"}


def unwrap(c: Column) -> Column:
    """A title without the marks that enclose it whole."""
    s = strip(c)
    inner = s.substr(F.lit(2), F.length(s) - 2)
    return F.when(s.startswith("《") & s.endswith("》") & (F.length(s) > 2) & ~F.contains(inner, F.lit("》")), strip(inner)).otherwise(s)


def blocks(docs: DataFrame, with_keys: bool = False) -> DataFrame:
    """(doc_id, line_no, kind, text[, key]): each line of a manuscript that isn't blank or a rule, and what it is.

    Kinds: meta, title, note, abstract, keywords, ref (a numbered entry), ref_more (its continuation), h1, h2,
    quote, table, p. The header block lasts until the first line of another kind.
    """
    rows = lines(docs).withColumn("s", strip(F.col("line"))).where("s <> ''")
    note, s = F.col("line").rlike(R.NOTE_HEAD), F.col("s")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    head = note | s.startswith(">") | s.startswith("# ")
    rows = rows.withColumn("in_head", F.sum((~head).cast("int")).over(w) == 0)
    rows = rows.withColumn("nth_title", F.sum((F.col("in_head") & s.startswith("# ")).cast("int")).over(w))
    rows = rows.withColumn("in_refs", F.sum(s.rlike(REFS_LINE).cast("int")).over(w) > 0)
    opens = s.rlike(R.ABSTRACT_LINE) & ~F.col("in_refs")
    closes = s.rlike(rf"^#{{1,3}}[{R.WS}]") | s.startswith("**关键词")
    rows = rows.withColumn("state", F.last(F.when(opens, F.lit("abstract")).when(closes, F.lit("body")), ignorenulls=True).over(w))
    rows = rows.withColumn("entries", F.coalesce(F.sum((F.col("in_refs") & s.rlike(r"^\[[0-9]+\]")).cast("int")).over(before), F.lit(0)))
    kind = (
        F.when(note, "note")
        .when(F.col("in_head") & s.rlike(LAYOUT_META), "meta")
        .when(F.col("in_head") & s.startswith(">"), None)
        .when(F.col("in_head") & s.startswith("# ") & (F.col("nth_title") == 1), "title")
        .when(s.rlike(REFS_LINE), None)
        .when(F.col("in_refs") & s.rlike(r"^\[[0-9]+\]"), "ref")
        .when(F.col("in_refs"), F.when(~s.startswith("#") & (F.col("entries") > 0), "ref_more"))
        .when(opens, None)
        .when(s.rlike(KEYWORDS), "keywords")
        .when(F.col("state") == "abstract", "abstract")
        .when(s.isin("---", "***", "___"), None)
        .when(s.startswith("## "), "h1")
        .when(s.startswith("### "), "h2")
        .when(s.startswith("> "), "quote")
        .when(s.startswith("|") & s.endswith("|"), "table")
        .otherwise("p")
    )
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    k = F.col("kind")
    text = (
        F.when(k == "meta", unwrap(F.regexp_extract("s", LAYOUT_META, 2)))
        .when(k == "title", unwrap(F.expr("substring(s, 3)")))
        .when(k == "note", strip(F.regexp_replace("s", rf"{R.NOTE_HEAD}[{R.WS}]*", "")))
        .when(k == "ref", strip(F.regexp_replace("s", r"^\[[0-9]+\]", "")))
        .when(k == "keywords", strip(F.regexp_replace("s", KEYWORDS, "")))
        .when(k == "h1", strip(F.expr("substring(s, 4)")))
        .when(k == "h2", strip(F.expr("substring(s, 5)")))
        .when(k == "quote", strip(F.expr("substring(s, 3)")))
        .otherwise(s)
    )
    keys = [F.when(k == "meta", F.regexp_extract("s", LAYOUT_META, 1)).alias("key")] if with_keys else []
    return rows.select("doc_id", "line_no", "kind", text.alias("text"), *keys)


def table_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, col, cell): cells of table rows; ruler rows are dropped, short rows padded to the widest."""
    inner = F.regexp_replace("text", r"^\|+|\|+\z", "")
    rows = blocks(docs).where("kind = 'table'").select("doc_id", "line_no", F.transform(F.split(inner, r"\|"), strip).alias("cells"))
    rows = rows.where(~F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?\z")))
    # A table is a run of neighbouring lines.
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("new", (F.col("line_no") - F.coalesce(F.lag("line_no").over(w), F.lit(-9)) > 2).cast("int"))
    rows = rows.withColumn("tab", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("wide", F.max(F.size("cells")).over(Window.partitionBy("doc_id", "tab")))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("wide") - F.size("cells")))
    return rows.select("doc_id", "line_no", F.posexplode(padded).alias("col", "cell")).withColumn("col", F.col("col") + 1)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, run, kind, text): paragraphs as runs of bold text, note marks and plain text."""
    pattern = r"\*\*[^\n]+?\*\*|\[\^[0-9]+\]|«FN[0-9]+»"
    p = blocks(docs).where("kind = 'p'")
    marks = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.when(m.startswith("**"), "bold").otherwise("note").alias("kind"), F.when(m.startswith("**"), m.substr(F.lit(3), F.length(m) - 4)).otherwise(m).alias("text")))
    plain = F.transform(F.split("text", pattern), lambda t: F.struct(F.lit("plain").alias("kind"), t.alias("text")))
    p = p.withColumns({"m": marks, "t": plain})
    both = F.flatten(F.transform("t", lambda t, i: F.when(F.get("m", i).isNotNull(), F.array(t, F.get("m", i))).otherwise(F.array(t))))
    out = p.select("doc_id", "line_no", F.posexplode(F.filter(both, lambda x: x["text"] != "")).alias("run", "x"))
    return out.select("doc_id", "line_no", (F.col("run") + 1).alias("run"), "x.kind", "x.text")


def layout(docs: DataFrame, profile: str = "journal", keep_refs: bool = False) -> DataFrame:
    """(doc_id, line_no, kind, font, size, indent, bold, text): blocks with their style.

    Lines of the header block are printed by what they name; a title there comes before one in the text. Continued
    entries are part of the entry before them. The journal profile prints references; the footnote profile only if
    keep_refs is set.
    """
    styles = docs.sparkSession.createDataFrame(STYLES, "kind string, font string, size double, indent boolean, bold boolean")
    b = blocks(docs, with_keys=True)
    names = F.create_map(*[F.lit(x) for pair in META_KINDS.items() for x in pair])
    kind = F.when(F.col("kind") == "meta", F.try_element_at(names, F.col("key"))).when(F.col("kind") == "ref_more", "ref").otherwise(F.col("kind"))
    per_doc = Window.partitionBy("doc_id").orderBy("line_no")
    named = F.max(F.coalesce((F.col("kind") == "meta") & (F.col("key") == "题目"), F.lit(False))).over(Window.partitionBy("doc_id"))
    entry = F.sum((F.col("kind") == "ref").cast("int")).over(per_doc)
    b = b.withColumns({"named": named, "entry": F.when(F.col("kind").isin("ref", "ref_more"), entry), "out": kind}).where("out IS NOT NULL AND NOT (kind = 'title' AND named)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    key = F.coalesce(F.when(F.col("entry").isNotNull(), -F.col("entry")), F.col("line_no").cast("bigint"))
    b = b.groupBy("doc_id", key.alias("k"), F.col("out").alias("kind")).agg(F.min("line_no").alias("line_no"), whole.alias("text"))
    out = b.join(F.broadcast(styles), "kind")  # one row for each kind
    if profile == "footnote" and not keep_refs:
        out = out.where("kind <> 'ref'")
    return out.select("doc_id", "line_no", "kind", "font", "size", "indent", "bold", "text")


def packet_clean(docs: DataFrame, anonymize: bool = True, strip_todo: bool = False) -> DataFrame:
    """(doc_id, title, comments, status_lines, placeholders, todos, text): manuscripts as reviewers get them."""
    rows = lines(docs).withColumn("s", strip(F.col("line")))
    s = F.col("s")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.sum(s.startswith("## ").cast("int")).over(w) == 0)
    meta, h1 = F.col("head") & s.rlike(META), F.col("head") & s.startswith("# ")
    internal = s.rlike(rf"^#[{R.WS}]*论文正文[^\n]*\z")
    drop = F.col("head") & (s.startswith(">") | internal | s.startswith("# "))
    title = F.max_by(F.regexp_extract("s", META, 2), F.when(meta & (F.regexp_extract("s", META, 1) == "题目"), F.col("line_no")))
    first = F.min_by(F.expr("substring(s, 3)"), F.when(h1 & ~internal, F.col("line_no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~drop, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = rows.groupBy("doc_id").agg(F.coalesce(F.nullif(unwrap(title), F.lit("")), F.nullif(unwrap(first), F.lit(""))).alias("title"), body.alias("b"))
    out = out.withColumns({"comments": matches(F.col("b"), R.COMMENT), "b": F.regexp_replace("b", R.COMMENT, "")})
    status = rf"(?md)^[{R.WS}]*(?:状态|写作状态)[{R.WS}]*[:：][^\n]*$"
    out = out.withColumns({"status_lines": matches(F.col("b"), status), "b": F.regexp_replace("b", status, "")})
    out = out.withColumn("b", F.when(F.col("title").isNotNull(), F.concat(F.lit("# "), "title", F.lit("\n\n"), F.regexp_replace("b", rf"^[{R.WS}]+", ""))).otherwise(F.col("b")))
    out = out.withColumns({"placeholders": matches(F.col("b"), R.PLACEHOLDER), "todos": matches(F.col("b"), R.TODO)})
    if strip_todo:
        out = out.withColumn("b", F.regexp_replace("b", R.TODO, ""))
    if anonymize:
        for pattern in (r"（?作者信息[:：][^）\n]*）?", rf"(?md)^>[{R.WS}]*(?:{'|'.join(R.META_KEYS)})[{R.WS}]*[:：][^\n]*$", rf"(?md)^[{R.WS}]*[*\-#]*[{R.WS}]*\[?作者姓名[^\n]*$"):
            out = out.withColumn("b", F.regexp_replace("b", pattern, ""))
    text = F.concat(strip(F.regexp_replace("b", r"\n{3,}", "\n\n")), F.lit("\n"))
    return out.select("doc_id", "title", "comments", "status_lines", "placeholders", "todos", text.alias("text"))
