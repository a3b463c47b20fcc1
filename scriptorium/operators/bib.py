"""Bibliographic exports, records and reference lists.

Missing values are empty in formatted output. Records are taken in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, strip
from scriptorium.session import cut

# The fields of a record.
FIELDS = ["type", "authors", "title", "journal", "year", "volume", "issue", "pages", "keywords", "doi", "abstract"]
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
ENDNOTE_FIELD = r"^(%[A-Z0-9@!?+*$&])"


def _keys(exports: DataFrame) -> list[str]:
    return ["export_id", "source_file"] if "source_file" in exports.columns else ["export_id"]


def export_lines(exports: DataFrame) -> DataFrame:
    """(export_id[, source_file], line_no, line) of each line of (export_id[, source_file], text) that isn't blank, stripped."""
    out = each(exports, _keys(exports), F.transform(F.split("text", LINE_END), strip), "line", "line_no")
    return out.select(*_keys(exports), "line_no", "line").where("line <> ''")


def detect_format(exports: DataFrame) -> DataFrame:
    """(export_id, fmt): endnote, refworks or unknown, by the first line that isn't blank."""
    first = F.get(F.filter(F.transform(F.split("text", LINE_END), strip), lambda x: x != ""), F.lit(0))
    fmt = lambda l: F.when(l.rlike("^%[0AT]"), "endnote").when(l.rlike("^(?:RT|A1|T1) "), "refworks").otherwise("unknown")
    return each(exports, ["export_id"], let(first, lambda l: F.when(l.isNotNull(), F.array(fmt(l)))), "fmt")


def field_lines(exports: DataFrame, fmt: str = "refworks") -> DataFrame:
    """(export_id[, source_file], rec, line_no, code, value): field lines, later lines joined to the one before them.

    Lines before the first record are dropped. A line that begins like a field counts as one, even within an
    abstract; its code decides whether it is kept later on.
    """
    rows, keys = export_lines(exports), _keys(exports)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    if fmt == "refworks":
        bare = F.col("line").isin(list(R.REFWORKS)) | F.lower("line").isin(R.REFWORKS_OTHER)
        code = F.when(bare, F.col("line")).otherwise(F.regexp_extract("line", rf"^([A-Za-z][A-Za-z0-9]?)[{R.WS}]+", 1))
        known = code.isin(list(R.REFWORKS)) | F.lower(code).isin(R.REFWORKS_OTHER)
        code, start = F.when(known, code), F.col("line").startswith("RT ")
        value = F.regexp_replace("line", rf"^[A-Za-z][A-Za-z0-9]?(?:[{R.WS}]+|\z)", "")
    else:
        code = F.nullif(F.regexp_extract("line", ENDNOTE_FIELD, 1), F.lit(""))
        start, value = F.col("line").startswith("%0"), F.regexp_replace("line", rf"{ENDNOTE_FIELD}[{R.WS}]*", "")
    rows = rows.withColumns({"code": code, "rec": F.sum(start.cast("int")).over(w), "value": F.when(code.isNotNull(), value).otherwise(F.col("line"))})
    rows = rows.where("rec > 0").withColumn("f", F.sum(F.col("code").isNotNull().cast("int")).over(w)).where("f > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), " ")
    out = rows.groupBy(*keys, "rec", "f").agg(F.min("line_no").alias("line_no"), F.max("code").alias("code"), text.alias("value"))
    return out.select(*keys, "rec", "line_no", "code", strip(F.col("value")).alias("value"))


def records(exports: DataFrame, fmt: str = "refworks", abstract_limit: int = 0) -> DataFrame:
    """(export_id, rec, the fields[, source_file]): the first value of each field; authors joined, abstracts collapsed.

    Records without a title are dropped; codes without a field are, too. Abstracts are cut to abstract_limit
    characters, if that isn't 0.
    """
    table, keys = R.REFWORKS if fmt == "refworks" else R.ENDNOTE, _keys(exports)
    lookup = {**{k.lower(): v for k, v in table.items()}, **table}
    name = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    rows = field_lines(exports, fmt).withColumn("field", F.coalesce(F.try_element_at(name, F.col("code")), F.try_element_at(name, F.lower("code")))).where("field IS NOT NULL")

    def joined(field: str, sep: str) -> Column:
        some = F.array_sort(F.collect_list(F.when((F.col("field") == field) & (F.col("value") != ""), F.struct("line_no", "value"))))
        return F.array_join(F.transform(some, lambda x: x["value"]), sep)

    values = []
    for f in FIELDS:
        if f == "authors":
            v = joined(f, "; ")
        elif f == "abstract":
            v = strip(F.regexp_replace(joined(f, " "), f"[{R.WS}]+", " "))
            v = F.left(v, F.lit(abstract_limit)) if abstract_limit > 0 else v
        else:
            v = F.coalesce(F.min_by("value", F.when(F.col("field") == f, F.col("line_no"))), F.lit(""))
        values.append(v.alias(f))
    out = rows.groupBy("export_id", *keys[1:], "rec").agg(*values).where("title <> ''")
    return out.select("export_id", "rec", *FIELDS, *keys[1:])


def numbered(bib: DataFrame, start: int = 1, order: str = "id") -> DataFrame:
    """bib with num: places in the order of a column, from start on, without gaps.

    Rows are sorted across all partitions; a row for each of them tells how many come before it.
    """
    placed = cut(bib.orderBy(order)).withColumn("_part", F.spark_partition_id())
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = {}, start
    for part, n in sizes:
        before[part], total = total, total + n
    offset = F.create_map(*[F.lit(x) for pair in (before or {0: start}).items() for x in pair])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("num", (F.element_at(offset, F.col("_part")) + place).cast("bigint")).drop("_part")


def title_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), R.TITLE_ASIDE, ""))


def dedupe(bib: DataFrame) -> DataFrame:
    """(id, copies): the first record of each normalized title and first author, and how many it stands for."""
    first = F.coalesce(strip(F.get(F.split(F.coalesce("authors", F.lit("")), ";"), F.lit(0))), F.lit(""))
    return bib.groupBy(title_key(F.col("title")).alias("t"), first.alias("a")).agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


def summary(bib: DataFrame) -> DataFrame:
    """One row: records, records with an abstract, first and last year (as text), number of sources, and the sources, sorted.

    There is a source for each file, so that the list is as short as a list of files.
    """
    year = F.when(F.coalesce("year", F.lit("")) != "", F.col("year"))
    some = (F.coalesce("abstract", F.lit("")) != "").cast("int")
    return bib.agg(F.count("*").alias("records"), F.sum(some).alias("with_abstract"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct("source_file").alias("sources"), F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("source_files"))


def top_journals(bib: DataFrame, k: int = 10) -> DataFrame:
    """(journal, n): the most frequent journals; equal ones in the order of their first record."""
    out = bib.where("journal IS NOT NULL AND journal <> ''").groupBy("journal").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return out.orderBy(F.desc("n"), "first_id").limit(k).select("journal", "n")


def keep(bib: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is in ids."""
    return bib.join(ids.select("id").distinct(), "id", "left_semi")


def missing(bib: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that no record has."""
    return ids.select("id").distinct().join(bib.select("id"), "id", "left_anti")


def _names() -> Column:
    return F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), "[;；]"), strip), lambda a: a != "")


def _value(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def pages(c: Column) -> Column:
    """A page range without white space, its dashes hyphens."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{R.WS}]+", ""), "－—–", "---")


def type_code() -> Column:
    """D, N, C, M or J, by words in the type."""
    t = F.lower(F.coalesce("type", F.lit("")))
    return F.when(t.rlike("dissertation|thesis|学位"), "D").when(t.rlike("newspaper|报纸"), "N").when(t.rlike("conference|会议|proceedings"), "C").when(t.rlike("book|专著|monograph"), "M").otherwise("J")


def clean_doi(c: Column) -> Column:
    """Without DOIs and links to them, runs of white space a blank each."""
    c = F.regexp_replace(c, rf"(?iu)[{R.WS}]*DOI[{R.WS}]*[:：][{R.WS}]*[^{R.WS}]+", "")
    c = F.regexp_replace(c, rf"(?iu)[{R.WS}]*https?://(?:dx\.)?doi\.org/[^{R.WS}]+", "")
    return strip(F.regexp_replace(c, f"[{R.WS}]+", " "))


def format_gbt(bib: DataFrame, keep_doi: bool = False) -> DataFrame:
    """(id, entry) in the numeric style: at most three authors, type code, volume, issue and pages."""
    some = lambda before, v, after="": F.when(v != "", F.concat(F.lit(before), v, F.lit(after))).otherwise("")
    n = _names()
    a = F.when(F.size(n) <= 3, F.array_join(n, ", ")).otherwise(F.concat(F.array_join(F.slice(n, 1, 3), ", "), F.lit(", 等")))
    title, code = F.regexp_replace(_value("title"), r"[.。]+\z", ""), type_code()
    tail = (
        F.when(code == "J", F.concat(F.lit(" "), _value("journal"), F.lit(", "), _value("year"), some(", ", _value("volume")), some("(", _value("issue"), ")"), some(": ", pages(F.col("pages")))))
        .when(code.isin("D", "C"), F.concat(F.lit(" "), _value("year")))
        .otherwise(F.concat(F.lit(" "), _value("journal"), F.lit(", "), _value("year")))
    )
    entry = F.concat(a, F.lit(". "), title, F.lit("["), code, F.lit("]."), tail, F.lit("."))
    return bib.select("id", (entry if keep_doi else clean_doi(entry)).alias("entry"))


def format_law(bib: DataFrame, keep_doi: bool = False) -> DataFrame:
    """(id, entry) in the style of law journals."""
    some = lambda before, v, after: F.when(v != "", F.concat(F.lit(before), v, F.lit(after))).otherwise("")
    a, code, year, journal = F.array_join(_names(), "、"), type_code(), _value("year"), _value("journal")
    title = F.concat(F.lit("《"), F.regexp_replace(_value("title"), r"[.。]+\z", ""), F.lit("》"))
    tail = (
        F.when(code == "J", F.concat(F.lit("《"), journal, F.lit("》"), year, F.lit("年"), some("第", _value("issue"), "期"), some("、第", F.replace(pages(F.col("pages")), F.lit("-"), F.lit("—")), "页")))
        .when(code == "D", F.concat(F.lit("，"), year, F.lit("年学位论文")))
        .when(code == "N", F.concat(F.lit("，《"), journal, F.lit("》"), year, F.lit("年")))
        .otherwise(F.concat(F.lit("，"), journal, year, F.lit("年版")))
    )
    entry = F.concat(some("", a, "："), title, tail, F.lit("。"))
    return bib.select("id", (entry if keep_doi else clean_doi(entry)).alias("entry"))


def missing_pages(bib: DataFrame) -> DataFrame:
    """(id, no_pages, no_journal) of each journal article that lacks either."""
    no_pages, no_journal = pages(F.col("pages")) == "", _value("journal") == ""
    return bib.where(type_code() == "J").select("id", no_pages.alias("no_pages"), no_journal.alias("no_journal")).where("no_pages OR no_journal")


#: Codes of the fields in the order in which the two formats write them.
WRITTEN = {
    "refworks": [("RT", "type"), ("A1", "authors"), ("T1", "title"), ("JF", "journal"), ("YR", "year"), ("vo", "volume"), ("IS", "issue"), ("OP", "pages"), ("K1", "keywords"), ("DO", "doi"), ("AB", "abstract")],
    "endnote": [("%0", "type"), ("%A", "authors"), ("%T", "title"), ("%J", "journal"), ("%D", "year"), ("%V", "volume"), ("%N", "issue"), ("%P", "pages"), ("%K", "keywords"), ("%R", "doi"), ("%X", "abstract")],
}


def as_exports(bib: DataFrame, per_file: int = 20, fmt: str = "refworks") -> DataFrame:
    """(export_id, source_file, text): records written as tagged exports, so many to a file; a line for each author.

    A record without a type is written as Generic, for a record opens with its type.
    """

    def written(code: str, f: str) -> Column:
        value = F.coalesce(F.col(f), F.lit(""))
        if f == "authors":
            return F.array_join(F.transform(F.split(value, ";"), lambda a: F.concat(F.lit(f"{code} "), a)), "\n")
        return F.concat(F.lit(f"{code} "), F.when(strip(value) == "", "Generic").otherwise(value) if f == "type" else value)

    lines_ = [written(code, f) for code, f in WRITTEN[fmt]]
    rows = bib.select(F.floor((F.col("id") - 1) / per_file).alias("export_id"), "id", F.concat_ws("\n", *lines_).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy("export_id").agg(body.alias("text")).select("export_id", F.format_string("export-%d.txt", "export_id").alias("source_file"), "text")
