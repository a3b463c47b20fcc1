"""Queries p1 to p9 over whole tables, with production parameters."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.llm import bpe, encoding, lookalike, loose, mixture, survivors, terms
from scriptorium.llm import pieces as cutting
from scriptorium.operators import unpack
from scriptorium.session import cut, spread, table


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies: $TOKENIZER_DIR, the installed package, or /opt/tokenizers."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return str(Path(folder) / name)
    spec = importlib.util.find_spec("public_tokenizers")
    folder = next(iter(spec.submodule_search_locations)) if spec else "/opt/tokenizers"
    return str(Path(folder) / name)


@cache
def _vocabulary(app: str, path: str):
    return bpe.vocabulary(SparkSession.getActiveSession(), path)


def _shared(spark: SparkSession):
    return _vocabulary(spark.sparkContext.applicationId, tokenizer_path())


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "bib"), "id")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bib = _bib(spark, sf_dir)
    keywords = unpack.with_values(unpack.long_fields(bib, ["keywords"]))
    journal = unpack.long_fields(bib, ["journal"]).select("id", "field_name", F.array(F.btrim("field", F.lit(unpack.BLANKS))).alias("values"))
    values = cut(keywords.unionByName(journal))
    return terms.marked_terms(values, bib.count())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")


GROUPED = ["pages", "doi", "abstract", "volume"]


def _grouped(spark: SparkSession, sf_dir: str) -> tuple:
    return table(spark, sf_dir, "dup_member"), _bib(spark, sf_dir), table(spark, sf_dir, "export_file"), GROUPED


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(*_grouped(spark, sf_dir)).select("group_id", "field_name", "id")


def p3_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.truths(*_grouped(spark, sf_dir))


READABLE = ["title", "abstract", "authors"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(_bib(spark, sf_dir), READABLE).select("id", "field_name")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(_bib(spark, sf_dir), READABLE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loose.pairs(_bib(spark, sf_dir))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loose.collapse(_bib(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lookalike.odd_fields(_bib(spark, sf_dir), ["title", "pages"])
    title = F.when(F.col("field_name") == "title", F.col("value"))  # misread titles are p4's
    return odd.where(~encoding.is_garbled(title)).select("id", "field_name")


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    bib = _bib(spark, sf_dir)
    return lookalike.canonical(bib.select(F.lit("title").alias("field_name"), F.col("title").alias("value")).unionByName(bib.select(F.lit("pages").alias("field_name"), F.col("pages").alias("value"))))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(_docs(spark, sf_dir), _shared(spark))


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    counts = cut(bpe.token_counts(docs, _shared(spark)))  # three short columns, read again for the rates and the report
    return counts, cut(mixture.rates(counts, table(spark, sf_dir, "mix_target")))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rate_table = _rates(spark, sf_dir)
    return mixture.draw(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), rate_table)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, rate_table = _rates(spark, sf_dir)
    return mixture.report(mixture.draw(counts, rate_table), rate_table)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.split_ids(_docs(spark, sf_dir), _shared(spark))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pieces(_docs(spark, sf_dir), _shared(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_truths, p4_found, p4_restored, p5_found, p5_collapsed, p6_found, p6_canonical, p7_ids, p8_mixture, p8_shares, p9_found, p9_pieces)}


ASIDE = rf"[{R.WS}\p{{P}}\p{{Z}}\p{{Cc}}|$+<>=^`~]+"


def _fold(x: str) -> str:
    return f"replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ς', 'σ')"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _p3_sql() -> str:
    says_nothing = "lower(trim(v, ' \t')) IN ('', '无', '不详', '未知', '暂缺', 'n/a', 'null', 'none', '-', '/', '—')"
    cut_short = r"""CASE f WHEN 'pages' THEN regexp_matches(v, '-\s*\?*$') WHEN 'doi' THEN NOT regexp_matches(v, '10\.[0-9]+/[a-z]+\.[0-9]{4}\.[0-9]+$')
 WHEN 'abstract' THEN NOT regexp_matches(v, '[。！？.!?]$') OR v LIKE '%...' OR EXISTS (SELECT 1 FROM c o WHERE o.g = c.g AND o.f = 'abstract' AND length(o.v) > length(c.v) AND starts_with(o.v, c.v)) ELSE false END"""
    values = ", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in GROUPED)
    return f"""WITH x AS (SELECT source_file, arg_max(trust, loaded_at) AS trust, arg_max(exported_at, loaded_at) AS e FROM export_file GROUP BY 1),
 u AS (SELECT g, id, trust, e, t.f, t.v FROM (SELECT m.group_id AS g, b.id, trust, e, unnest([{values}]) AS t FROM (SELECT DISTINCT group_id, id FROM dup_member) m JOIN bib b USING (id) LEFT JOIN x USING (source_file))),
 c AS MATERIALIZED (SELECT * FROM u WHERE v IS NOT NULL AND NOT {says_nothing})
 SELECT g AS group_id, f AS field_name, id FROM (SELECT *, row_number() OVER (PARTITION BY g, f ORDER BY ({cut_short})::INT, trust DESC NULLS LAST, e DESC, id) AS r FROM c) WHERE r = 1"""


def _p5_keys() -> str:
    joined = _sub(_sub(_fold("authors"), r"(\p{Han})[ \x{a0}\x{3000}]+(\p{Han})", r"\1\2"), r"(\p{Han})[ \x{a0}\x{3000}]+(\p{Han})", r"\1\2")
    names = f"array_to_string(list_sort(list_filter(string_split({_sub(joined, ASIDE, ' ')}, ' '), lambda p: p NOT IN ('', 'and'))), ' ')"
    return f"{_sub(_fold('title'), ASIDE, '')} AS t, {names} AS a, {_sub(_fold('source_file'), ASIDE, '')} AS f"


def _p5_sql() -> str:
    return f"WITH k AS (SELECT id, {_p5_keys()} FROM bib) SELECT x.id AS id_a, y.id AS id_b FROM k x JOIN k y USING (t, a, f) WHERE x.id < y.id"


def _p5_classes() -> str:
    shown = ", ".join(f"first({c} ORDER BY id) AS {c}" for c in loose.KEYS)
    return f"SELECT min(id) AS id, {shown}, count(*) AS copies, count(DISTINCT coalesce(title, chr(1)) || chr(0) || coalesce(authors, chr(1)) || chr(0) || coalesce(source_file, chr(1))) AS writings FROM (SELECT *, {_p5_keys()} FROM bib) GROUP BY t, a, f"


def oracle_sql() -> dict[str, str]:
    """The problems whose results SQL can state."""
    return {"p3_found": _p3_sql(), "p5_found": _p5_sql(), "p5_collapsed": _p5_classes()}
