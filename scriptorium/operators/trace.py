"""Marks of mechanical writing, and punctuation.

What is scanned ends at the heading of the reference list. The abstract is what stands between its heading and the
next one; it counts as a paragraph of its own, number 0, with its white space collapsed. Other line numbers are those
of the whole text. A text is one row, and every mark is computed within it: nothing is shuffled. Null texts have no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, literal_count, matches, strip, uncited
from scriptorium.operators.lines import paragraph_array

LINE = "(?md)"


def scanned(text: Column) -> Column:
    """The text before the heading of its reference list, or all of it."""
    return F.get(F.split(text, f"{LINE}^{R.REFS_HEAD}$", 2), F.lit(0))


def split_abstract(text: Column) -> Column:
    """(before, abstract, after): what stands before the heading of the abstract, up to the next heading, and from there on."""
    around = F.split(text, f"{LINE}^{R.ABSTRACT_HEAD}$", 2)
    inner = let(around, lambda a: F.struct(F.get(a, F.lit(0)).alias("before"), F.split(F.coalesce(F.get(a, F.lit(1)), F.lit("")), rf"{LINE}(?=^#{{1,6}}[{R.WS}])", 2).alias("x")))
    part = lambda v, i: F.coalesce(F.get(v["x"], F.lit(i)), F.lit(""))
    return let(inner, lambda v: F.struct(v["before"].alias("before"), part(v, 0).alias("abstract"), part(v, 1).alias("after")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, abstract, rest, paras) of each text: what is scanned, its abstract and the rest of it, and its paragraphs.

    paras holds (line_no, text): the abstract first, as line 0, if it isn't blank.
    """
    d = docs.where("text IS NOT NULL").select("doc_id", scanned(F.col("text")).alias("text"))
    d = d.select("doc_id", "text", split_abstract(F.col("text")).alias("s"))
    d = d.select("doc_id", "text", F.col("s.before").alias("before"), F.col("s.abstract").alias("abstract"), F.col("s.after").alias("after"))
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    upto = ends(F.col("before"))
    shift = F.when(F.col("after") != "", ends(F.col("text")) - ends(F.col("after")) - upto).otherwise(0)
    rest = F.concat("before", "after")
    paras = let(F.struct(upto.alias("u"), shift.alias("s")), lambda k: F.transform(paragraph_array(rest), lambda p: F.struct(F.when(p["line_no"] > k["u"], p["line_no"] + k["s"]).otherwise(p["line_no"]).alias("line_no"), p["text"].alias("text"))))
    whole = strip(F.regexp_replace("abstract", f"[{R.WS}]+", " "))
    first = F.when(whole != "", F.array(F.struct(F.lit(0).alias("line_no"), whole.alias("text")))).otherwise(F.array().cast("array<struct<line_no:int,text:string>>"))
    return d.select("doc_id", "text", "abstract", rest.alias("rest"), F.concat(first, paras).alias("paras"))


def _all_text() -> Column:
    return F.concat("abstract", F.lit("\n"), "rest")


def abstract_split(docs: DataFrame) -> DataFrame:
    """(doc_id, abstract, rest) of what is scanned of each text; the first abstract ends at the next heading."""
    return scan(docs).select("doc_id", strip(F.col("abstract")).alias("abstract"), "rest")


def dense_paragraphs(paras: Column, least: int) -> Column:
    """(line_no, total, chars) of each paragraph with so many phrases of the lexicon."""
    total = lambda t: sum((literal_count(t, w) for w in R.AI_WORDS), F.lit(0))
    one = lambda p: let(uncited(p["text"]), lambda t: F.struct(p["line_no"].alias("line_no"), total(t).alias("total"), F.length(t).alias("chars")))
    # Most paragraphs hold no phrase, which one test tells.
    some = F.filter(paras, lambda p: p["text"].rlike("|".join(R.AI_WORDS)))
    return F.filter(F.transform(some, one), lambda x: x["total"] >= least)


def lexicon_density(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, line_no, total, chars) of each paragraph with so many phrases of the lexicon."""
    return each(scan(docs), ["doc_id"], dense_paragraphs(F.col("paras"), least)).select("doc_id", "x.line_no", "x.total", "x.chars")


def vague_array(clean: Column) -> Column:
    """(minus, i, w): attributions without a source, by hits, then in the order of the lexicon."""
    counts = F.array(*[F.struct((-literal_count(clean, w)).alias("minus"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(R.VAGUE)])
    ranked = F.array_sort(F.filter(counts, lambda x: x["minus"] < 0))
    kind = "array<struct<minus:int,i:int,w:string>>"
    taken = F.aggregate(ranked, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: F.contains(k["w"], x["w"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(clean.rlike("|".join(R.VAGUE)), taken).otherwise(F.array().cast(kind))


def _cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, clean): abstract and rest, without citations."""
    return scan(docs).select("doc_id", uncited(_all_text()).alias("clean"))


def vague_attribution(docs: DataFrame) -> DataFrame:
    """(doc_id, phrase, hits): attributions without a source.

    Phrases are taken by hits, then in the order of the lexicon; one that is part of a phrase taken before is left
    out.
    """
    out = each(_cleaned(docs), ["doc_id"], let(F.col("clean"), vague_array))
    return out.select("doc_id", F.col("x.w").alias("phrase"), (-F.col("x.minus")).alias("hits"))


def inflated_array(clean: Column) -> Column:
    """(category, hits): what the patterns of each category match."""
    rows = []
    for category, patterns in R.INFLATION.items():
        hits = F.flatten(F.array(*[F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for p in patterns]))
        rows.append(F.struct(F.lit(category).alias("category"), hits.alias("hits")))
    return F.array(*rows)


def inflation_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, category, phrase, hits): inflated claims, by what was matched."""
    rows = each(_cleaned(docs), ["doc_id"], let(F.col("clean"), inflated_array)).select("doc_id", "x.category", "x.hits")
    phrases = F.transform(F.array_distinct("hits"), lambda p: F.struct(p.alias("phrase"), F.size(F.filter("hits", lambda h: h == p)).cast("bigint").alias("hits")))
    return each(rows, ["doc_id", "category"], phrases, "p").select("doc_id", "category", "p.phrase", "p.hits")


def lexicon_hits(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc_id, phrase, hits) of each phrase that abstract and rest have, citations left aside."""
    counts = lambda t: F.array(*[F.struct(F.lit(p).alias("phrase"), literal_count(t, p).alias("hits")) for p in phrases])
    some = F.when(F.col("clean").rlike("|".join(phrases)), let(F.col("clean"), counts))
    return each(_cleaned(docs), ["doc_id"], F.filter(some, lambda x: x["hits"] > 0)).select("doc_id", "x.phrase", "x.hits")


def self_reference(docs: DataFrame) -> DataFrame:
    """(doc_id, in_abstract, in_rest, first_person): how often a text names itself or its author."""
    return scan(docs).select("doc_id", *_self())


def _self() -> list[Column]:
    first = matches(F.concat("abstract", "rest"), R.FIRST_PERSON)
    return [literal_count(F.col("abstract"), "本文").alias("in_abstract"), literal_count(uncited(F.col("rest")), "本文").alias("in_rest"), first.alias("first_person")]


def _heads() -> list[Column]:
    return [matches(F.col("text"), LINE + p).alias(n) for n, p in R.HEADINGS.items()]


def heading_system(docs: DataFrame) -> DataFrame:
    """(doc_id, arabic_1, arabic_2, chinese_1, chinese_2, mixed): numbered headings of each kind."""
    out = scan(docs).select("doc_id", *_heads())
    return out.withColumn("mixed", (F.col("arabic_1") + F.col("arabic_2") > 0) & (F.col("chinese_1") + F.col("chinese_2") > 0))


def _punct() -> list[Column]:
    t, raw = uncited(_all_text()), _all_text()
    both = lambda mark: matches(raw, f"(?<=[{R.CJK}]){mark}(?=[{R.CJK}])")
    return [
        literal_count(t, "——").alias("dashes"), literal_count(t, "……").alias("ellipses"), F.length(t).alias("chars"),
        literal_count(raw, '"').alias("straight_quotes"), both(",").alias("half_commas"), both(r"\.").alias("half_stops"), matches(raw, r"\.{3,}").alias("dots"),
    ]


def punct_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, dashes, ellipses, chars, straight_quotes, half_commas, half_stops, dots) of what is scanned of each text."""
    return scan(docs).select("doc_id", *_punct())


def _evenness(paras: Column, shortest: int) -> Column:
    """(paragraphs, mean, sd) of the lengths of paragraphs that aren't too short."""
    sizes = F.filter(F.transform(paras, lambda p: F.length(uncited(p["text"]))), lambda n: n >= shortest)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, n: acc + n)
    with_mean = let(sizes, lambda v: F.struct(v.alias("v"), F.size(v).cast("bigint").alias("n"), (total(v) / F.greatest(F.size(v), F.lit(1))).alias("mean")))

    def spread(x: Column) -> Column:
        squares = F.aggregate(x["v"], F.lit(0.0), lambda acc, n: acc + (n - x["mean"]) * (n - x["mean"]))
        return F.struct(x["n"].alias("paragraphs"), x["mean"].alias("mean"), F.sqrt(squares / F.greatest(x["n"], F.lit(1))).alias("sd"))

    return let(with_mean, spread)


def uniformity(docs: DataFrame, shortest: int = 30, least: int = 5) -> DataFrame:
    """(doc_id, paragraphs, mean, sd, cv) of the lengths of paragraphs, where there are enough of them."""
    enough = let(_evenness(F.col("paras"), shortest), lambda e: F.when(e["paragraphs"] >= least, F.array(e)))
    return each(scan(docs), ["doc_id"], enough).select("doc_id", "x.*").withColumn("cv", F.col("sd") / F.col("mean"))


#: Marks of a text and what each counts; severe ones first.
SEVERE = ("abstract_self", "first_person", "dense", "straight_quotes")
WARNINGS = ("vague", "inflation", "formulaic", "filler", "rest_self", "dashes", "half_width", "arabic_heads", "even")


def scanned_facts(docs: DataFrame) -> DataFrame:
    """scan, with clean (abstract and rest without citations) and all counts of a text that need no threshold."""
    d = scan(docs).select("doc_id", "text", "abstract", "rest", "paras", uncited(_all_text()).alias("clean"))
    return d.select("*", *_self(), *_punct(), *_heads(), _evenness(F.col("paras"), 30).alias("e"))


def mark_counts(density: int = 3) -> dict[str, Column]:
    """How often a text of scanned_facts shows each of the thirteen marks, 0 where it passes."""
    words = lambda ws: F.when(F.col("clean").rlike("|".join(ws)), sum((literal_count(F.col("clean"), w) for w in ws), F.lit(0))).otherwise(0)
    vague = F.aggregate(let(F.col("clean"), vague_array), F.lit(0), lambda acc, x: acc - x["minus"])
    infl = F.aggregate(let(F.col("clean"), inflated_array), F.lit(0), lambda acc, x: acc + F.size(x["hits"]))
    half, arabic = F.col("half_commas") + F.col("half_stops") + F.col("dots"), F.col("arabic_1") + F.col("arabic_2")
    dashes = F.when(F.col("dashes") / F.greatest(F.lit(1.0), F.col("chars") / 1000) > 8, F.col("dashes")).otherwise(0)
    even = (F.col("e.paragraphs") >= 5) & (F.col("e.sd") / F.col("e.mean") < 0.35)
    return {
        "abstract_self": F.col("in_abstract"), "first_person": F.col("first_person"), "dense": F.size(dense_paragraphs(F.col("paras"), density)), "straight_quotes": F.col("straight_quotes"),
        "vague": vague, "inflation": infl, "formulaic": words(R.FORMULAIC), "filler": words(R.FILLER), "rest_self": F.when(F.col("in_rest") > 3, F.col("in_rest")).otherwise(0),
        "dashes": dashes, "half_width": half, "arabic_heads": arabic, "even": F.coalesce(even, F.lit(False)).cast("int"),
    }


def trace_marks(docs: DataFrame, density: int = 3) -> DataFrame:
    """(doc_id, and a count for each mark): how often each text shows each of the thirteen marks, 0 where it passes."""
    return scanned_facts(docs).select("doc_id", *[c.cast("bigint").alias(n) for n, c in mark_counts(density).items()])


def trace_verdict(docs: DataFrame) -> DataFrame:
    """(doc_id, severe, warnings, findings, status): how many marks of each weight a text shows, which, and how often.

    findings lists them as mark:count, severe ones first; status is 1 if there is any.
    """
    shown = lambda ns: sum(((F.col(n) > 0).cast("int") for n in ns), F.lit(0))
    text = F.concat_ws(",", *[F.when(F.col(n) > 0, F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))) for n in (*SEVERE, *WARNINGS)])
    out = trace_marks(docs).select("doc_id", shown(SEVERE).alias("severe"), shown(WARNINGS).alias("warnings"), text.alias("findings"))
    return out.withColumn("status", (F.col("severe") + F.col("warnings") > 0).cast("int"))


def fix_double_quotes(c: Column) -> Column:
    """Straight double quotes made curly, by turns within each line."""
    line = lambda x: F.array_join(F.transform(F.split(x, '"'), lambda p, i: F.when(i == 0, p).when(i % 2 == 1, F.concat(F.lit("“"), p)).otherwise(F.concat(F.lit("”"), p))), "")
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


@F.arrow_udf(StringType())
def fix_single_quotes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Straight single quotes beside a wide character made curly, by turns within each line."""
    import re

    wide = "[一-鿿㐀-䶿぀-ヿ々〇]"
    mark = re.compile(f"(?<={wide})'|'(?={wide})")

    def fixed(text: str | None) -> str | None:
        if text is None or "'" not in text:
            return text
        out = []
        for line in text.split("\n"):
            turn = [False]

            def curly(_: re.Match, turn: list = turn) -> str:
                turn[0] = not turn[0]
                return "‘" if turn[0] else "’"

            out.append(mark.sub(curly, line))
        return "\n".join(out)

    for batch in batches:
        yield pa.array([fixed(x) for x in batch.to_pylist()], pa.string())


def fix_ellipsis(c: Column) -> Column:
    """Three and more full stops, or two and more wide ones, made an ellipsis."""
    return F.regexp_replace(c, r"\.{3,}|。{2,}", "……")


def fix_cjk_punct(c: Column) -> Column:
    """Half-width marks between two wide characters made full-width, one kind after another."""
    for mark, wide in ((",", "，"), (r"\.", "。"), (";", "；"), (":", "："), (r"\?", "？"), ("!", "！")):
        c = F.regexp_replace(c, f"(?<=[{R.CJK_KANA}]){mark}(?=[{R.CJK_KANA}])", wide)
    return c


def fix_year_range(c: Column) -> Column:
    """A dash between two years made a hyphen."""
    return F.regexp_replace(c, rf"([0-9]{{4}})[{R.WS}]*[—–][{R.WS}]*([0-9]{{4}})", "$1-$2")


def normalize_doc(c: Column, years: bool = False) -> Column:
    """All fixes, in order: double quotes, single quotes, ellipses, marks, and year ranges if wanted."""
    c = fix_cjk_punct(fix_ellipsis(fix_single_quotes(fix_double_quotes(c))))
    return fix_year_range(c) if years else c
