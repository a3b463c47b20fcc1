"""Personal data in texts: rules, institutions, own terms, file hygiene.

A hit has its line, counted from 1; line 0 is the file as such. Fragments are cut to 80 characters for display, after
all tests. Null texts have no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import strip
from scriptorium.operators.lines import lines

# Kinds of files that carry data of their author.
DENSE = {".pdf": "高", ".caj": "高", ".doc": "中", ".docx": "中"}


def _python(pattern: str) -> str:
    """A pattern of the rules as the standard library writes it."""
    p = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))) if int(m[1], 16) < 0x80 else chr(int(m[1], 16)), pattern)
    return p.replace(r"[\p{L}\p{N}_", r"[\w").replace(r"\p{L}\p{N}_", r"\w").replace(r"\z", r"\Z")


#: Rules by name that only texts with one of these characters or words can match: a cheap test before the rule itself.
_HINTS = [r"@", r"1[3-9][0-9]{9}", r"[0-9]{17}", r"[0-9]{8}", r":[\\/](?:Users|用户)", r"[A-Za-z]:[\\/]", r"/(?:home|Users)/", r"(?:大学|学院|研究院)", r"作者|姓名|著作人|执笔人", r"《", r"[A-Z]{2}", r"[A-Z]{2}"]


def hits(docs: DataFrame, allow: list[str] = (), surnames: str = R.SURNAMES) -> DataFrame:
    """(doc_id, category, severity, description, line, fragment): what the rules find, with its line.

    A text goes to a rule only if it holds what the rule can't match without, which is tested where it is read; most
    texts thus never leave the scan, and the rest come with the numbers of the rules that are to be run. Rules may
    cross lines, so lines are counted from offsets.
    """
    rules = [(c, s, d, re.compile(_python(p))) for c, s, d, p in R.PII_RULES]
    redacted = re.compile(_python(R.REDACTED))
    field = re.compile(r"^(?:作者|姓名|著作人|执笔人)\s*[:：]\s*")
    columns = ["doc_id", "category", "severity", "description", "line", "fragment"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, due in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for category, severity, description, rule in (rules[k] for k in due):
                    at, line = 0, 1
                    for m in rule.finditer(text):
                        fragment = m.group().strip()
                        if not fragment or redacted.search(fragment) or any(a and a in fragment for a in allow):
                            continue
                        if description == "作者字段后的人名" and field.sub("", fragment)[:1] not in surnames:
                            continue
                        line, at = line + text.count("\n", at, m.start()), m.start()
                        rows.append((i, category, severity, description, line, fragment[:80]))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    due = F.array_compact(F.array(*[F.when(F.col("text").rlike(h), F.lit(k)) for k, h in enumerate(_HINTS)]))
    suspects = docs.select("doc_id", "text", due.alias("due")).where(F.col("text").rlike("|".join(dict.fromkeys(_HINTS))))
    return suspects.mapInArrow(run, "doc_id bigint, category string, severity string, description string, line int, fragment string")


def institutions(docs: DataFrame, allow: list[str] = ()) -> DataFrame:
    """(doc_id, line_no, fragment): names of institutions, unless their line looks like a citation."""
    found = F.explode(F.regexp_extract_all("line", F.lit(R.INSTITUTION), F.lit(0))).alias("fragment")
    rows = lines(docs).select("doc_id", "line_no", "line", found)
    big, learn = F.instr("fragment", "大"), F.instr("fragment", "学")
    # Without either sign all but the last character is the head.
    upto = F.when(big > 0, big - 1).when(learn > 0, learn - 1).otherwise(F.length("fragment") - 1)
    rows = rows.withColumn("head", F.substring(F.col("fragment"), F.lit(1), upto))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(c), w))
    fine = (F.col("head") != "") & ~F.col("fragment").rlike(R.REDACTED) & ~has("head", R.NO_INSTITUTION)
    cited = has("line", R.CITATION_SIGNS) & ~F.contains("line", F.lit("作者")) & ~F.contains("line", F.lit("单位"))
    if allow:
        fine = fine & ~has("fragment", list(allow))
    return rows.where(fine & ~cited).select("doc_id", "line_no", "fragment")


def term_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, line_no, term, hits): own terms, literally; blank ones are skipped."""
    terms = [t for t in terms if t.strip()]
    counts = F.array(*[F.struct(F.lit(t).alias("term"), ((F.length("line") - F.length(F.replace("line", F.lit(t), F.lit("")))) / len(t)).cast("int").alias("hits")) for t in terms])
    out = lines(docs).select("doc_id", "line_no", F.explode(F.filter(counts, lambda x: x["hits"] > 0)).alias("x"))
    return out.select("doc_id", "line_no", "x.term", "x.hits")


#: Kinds of files that are read as text, and kinds that aren't.
TEXT_KINDS = [".md", ".markdown", ".txt", ".py", ".json", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".html", ".htm", ".js", ".ts", ".css", ".sh", ".bat", ".ps1", ".csv", ".tsv", ""]
BINARY_KINDS = [".pdf", ".caj", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".png", ".jpg", ".jpeg", ".gif", ".zip", ".7z", ".rar", ".pyc", ".exe", ".dll"]


def _extension() -> Column:
    return F.lower(F.regexp_extract("path", r"[^./\\](\.[^./\\]*)$", 1))


def file_kinds(files: DataFrame) -> DataFrame:
    """(path, kind) of each file: text, binary, or other; only texts are scanned."""
    ext = _extension()
    return files.select("path", F.when(ext.isin(BINARY_KINDS), "binary").when(ext.isin(TEXT_KINDS), "text").otherwise("other").alias("kind"))


def file_hygiene(files: DataFrame) -> DataFrame:
    """(path, severity) of each file whose kind carries data of its author."""
    ext = _extension()
    table = F.create_map(*[F.lit(x) for pair in DENSE.items() for x in pair])
    return files.select("path", F.try_element_at(table, ext).alias("severity")).where("severity IS NOT NULL")


def severity(docs: DataFrame) -> DataFrame:
    """(severity, n): hits of all rules by severity, with names of institutions."""
    one = hits(docs).select("severity").unionByName(institutions(docs).select(F.lit("中").alias("severity")))
    return one.groupBy("severity").agg(F.count("*").alias("n"))


def term_list(lines_df: DataFrame) -> DataFrame:
    """(term): the lines of a list of terms, without blank ones and comments."""
    t = strip(F.col("value"))
    return lines_df.where((t != "") & ~t.startswith("#")).select(t.alias("term"))
