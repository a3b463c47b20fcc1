"""The queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.operators import bib, cites, lines, manuscript, pii, quality, reports, trace, unpack
from scriptorium.plans import oracle, seeds
from scriptorium.session import spread, table
from scriptorium.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def _docs(operator: Callable[[DataFrame], DataFrame], *shown) -> Query:
    """A query that applies an operator to the documents, and shows columns of its result.

    Columns are given by name or as functions, for no session need exist when queries are listed.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(spread(table(spark, sf_dir, "documents"), "doc_id"))
        return out.select(*[c() if callable(c) else c for c in shown]) if shown else out

    return run


def _bib(operator: Callable[[DataFrame], DataFrame], *shown) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(spread(table(spark, sf_dir, "bib"), "id"))
        return out.select(*[c() if callable(c) else c for c in shown]) if shown else out

    return run


def _exports(operator: Callable[[DataFrame], DataFrame], *shown) -> Query:
    return _bib(lambda b: operator(bib.as_exports(b)), *shown)


def _cited_ids(keep: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Records against the ids that manuscripts cite."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, "cite_occ").where("bib_id IS NOT NULL").select((F.col("bib_id") + 3).alias("id"))
        return keep(table(spark, sf_dir, "bib"), ids).select("id")

    return run


def _chars(name: str) -> Callable[[], F.Column]:
    return lambda: F.length(name).alias(f"{name}_chars")


def _digest(name: str) -> Callable[[], F.Column]:
    return lambda: F.md5(F.encode(name, "utf-8")).alias("digest")


def _seeded(operator: Callable[[DataFrame], DataFrame], *shown) -> Query:
    """A query over all documents, each with the marks of seeds.SEEDS before and after its text, which the tables lack."""
    return _docs(lambda d: operator(seeds.seeded(d)), *shown)


def _rounded(name: str) -> Callable[[], F.Column]:
    return lambda: F.round(name, 6).alias(name)


def _fixed(fix: Callable[[F.Column], F.Column], query: Callable = _docs) -> Query:
    """Documents that a fix changes, with the length of the text and a digest of it."""

    def run(docs: DataFrame) -> DataFrame:
        out = docs.where("text IS NOT NULL").select("doc_id", "text", fix(F.col("text")).alias("fixed"))
        return out.where("fixed <> text").select("doc_id", F.length("fixed").alias("chars"), F.md5(F.encode("fixed", "utf-8")).alias("digest"))

    return query(run)


def _paged(docs: DataFrame) -> DataFrame:
    """Documents as files of one page for each 2,000 characters."""
    n = F.ceil(F.length("text") / 2000.0).cast("int")
    page = F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("page_no")
    return docs.where("text IS NOT NULL").select("doc_id", "text", page).select("doc_id", "page_no", F.expr("substring(text, (page_no - 1) * 2000 + 1, 2000)").alias("text"))


def _skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("saved_at").alias("mtime"))
    done = table(spark, sf_dir, "cite_occ").select(F.col("doc_id").cast("string").alias("path"), F.col("extracted_at").alias("out_mtime"))
    return files.incremental_skip(rows, done)


def _listings(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "export_file").select(F.col("source_file").alias("path")).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".pdf", ".docx", ".md", ".CAJ"])), (F.col("doc_id") % 4 + 1).cast("int"))).alias("path"))))


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = bib.as_exports(table(spark, sf_dir, "bib"))
    return bib.detect_format(exports)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    due = _skip(spark, sf_dir).select(F.col("path").cast("bigint").alias("doc_id"), "skip")
    return reports.run_counters(due, files.scan_detect(_paged(docs)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack.unpack(spread(table(spark, sf_dir, "bib"), "id"), ["authors", "keywords"])


TERMS = ["平台请求权", "duty of care", "终稿", " "]


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        # lines and statistics
        "paragraphs": _docs(lines.paragraphs, "doc_id", "line_no", _chars("text")),
        "sentences": _docs(lines.sentences, "doc_id", "line_no", "sent_no", _chars("sentence")),
        "sentence_normalize": _docs(quality.measured_sentences, "doc_id", "line_no", "sent_no", "chars", _digest("norm")),
        "doc_stats": _docs(quality.doc_stats),
        "doc_stats_baseline": _docs(lambda d: quality.doc_stats(d, 47.0), "doc_id", "n_sentences", "n_chars", *map(_rounded, ("avg_chars", "deviation")), "near"),
        "sentence_quantiles": _docs(quality.sentence_quantiles),
        "section_stats": _docs(quality.section_stats),
        "long_sentences": _docs(quality.long_sentences),
        "bloated_paragraphs": _docs(quality.bloated_paragraphs),
        "repeated_ngrams": _docs(quality.repeated_ngrams),
        "filler_hits": _seeded(quality.filler_hits),
        "version_curve": _docs(quality.version_curve),
        "health_verdict": _docs(quality.health_verdict),
        "near_dup_jaccard": _docs(quality.near_dup_jaccard),
        "near_dup_ratio": _docs(quality.near_dup_ratio),
        "near_dup_top": _docs(quality.top_near_pairs),
        "longest": _docs(quality.longest),
        # citations
        "doc_split": _docs(cites.doc_split),
        "mode_detect": _docs(cites.mode_detect),
        "citations": _docs(cites.groups),
        "citation_expand": _docs(cites.citations),
        "ref_entries": _docs(cites.ref_entries),
        "cite_missing": _docs(cites.cite_missing),
        "cite_extra": _docs(cites.cite_extra),
        "cite_gaps": _docs(cites.cite_gaps),
        "cite_dup_numbers": _seeded(cites.cite_dup_numbers),
        "cite_zombies": _seeded(cites.cite_zombies),
        "cite_first_order": _docs(cites.cite_first_order),
        "cite_order_mismatch": _docs(cites.cite_order_mismatch),
        "cite_summary": _docs(cites.cite_summary),
        "cite_verdict": _seeded(cites.cite_verdict),
        "cite_canonical": _docs(cites.cite_canonical),
        "renumber_map": _docs(cites.renumber_map),
        "renumber_refs": _docs(cites.renumber_refs),
        "renumber_body": _docs(cites.renumber_body, "doc_id", _chars("body"), _digest("body")),
        "renumber_strict": _seeded(lambda d: cites.renumber(d, compress=True), "doc_id", "status", "missing", "changed", _digest("body"), lambda: F.md5(F.encode("refs", "utf-8")).alias("refs_digest")),
        "compress_ranges": _docs(cites.compress_ranges),
        "footnotes": _docs(cites.footnotes),
        "footnote_missing": _docs(cites.footnote_missing),
        "footnote_unused": _docs(cites.footnote_unused),
        "footnote_verdict": _docs(cites.footnote_verdict),
        "footnote_resolve": _docs(cites.footnote_resolve),
        # bibliography
        "bib_detect_format": _formats,
        "bib_field_lines": _exports(bib.field_lines, "export_id", "source_file", "rec", "line_no", "code", _digest("value")),
        "bib_records": _exports(bib.records),
        "bib_records_endnote": _bib(lambda b: bib.records(bib.as_exports(b, fmt="endnote"), "endnote")),
        "bib_dedupe": _bib(bib.dedupe),
        "bib_summary": _bib(bib.summary),
        "bib_top_journals": _bib(bib.top_journals),
        "bib_filter": _cited_ids(bib.keep),
        "bib_filter_missing": _cited_ids(bib.missing),
        "bib_format_gbt": _bib(bib.format_gbt),
        "bib_format_law": _bib(bib.format_law),
        "bib_missing_pages": _bib(bib.missing_pages),
        # traces
        "abstract_split": _docs(trace.abstract_split, "doc_id", _digest("abstract"), _chars("rest")),
        "lexicon_hits": _seeded(lambda d: trace.lexicon_hits(d, [*R.AI_WORDS, *R.FILLER, *R.FORMULAIC])),
        "lexicon_density": _seeded(trace.lexicon_density),
        "vague_attribution": _seeded(trace.vague_attribution),
        "inflation_hits": _seeded(trace.inflation_hits),
        "self_reference": _docs(trace.self_reference),
        "heading_system": _docs(trace.heading_system),
        "punct_profile": _docs(trace.punct_profile),
        "uniformity": _docs(trace.uniformity, "doc_id", "paragraphs", *map(_rounded, ("mean", "sd", "cv"))),
        "trace_verdict": _docs(trace.trace_verdict),
        "trace_verdict_seeded": _seeded(trace.trace_verdict),
        # punctuation
        "fix_double_quotes": _fixed(trace.fix_double_quotes, _seeded),
        "fix_single_quotes": _fixed(trace.fix_single_quotes, _seeded),
        "fix_ellipsis": _fixed(trace.fix_ellipsis, _seeded),
        "fix_cjk_punct": _fixed(trace.fix_cjk_punct),
        "fix_year_range": _fixed(trace.fix_year_range),
        "normalize_doc": _fixed(lambda c: trace.normalize_doc(c, True), _seeded),
        # personal data
        "pii_hits": _seeded(pii.hits),
        "pii_allowed": _seeded(lambda d: pii.hits(d, allow=["mail5", "王某"])),
        "pii_institutions": _seeded(pii.institutions),
        "pii_terms": _docs(lambda d: pii.term_hits(d, TERMS)),
        "pii_file_hygiene": _listings(pii.file_hygiene),
        "pii_severity": _seeded(pii.severity),
        # manuscripts and files
        "md_blocks": _docs(manuscript.blocks, "doc_id", "line_no", "kind", _digest("text")),
        "md_table_cells": _docs(manuscript.table_cells),
        "md_runs": _docs(manuscript.runs, "doc_id", "line_no", "run", "kind", _digest("text")),
        "layout_blocks": _docs(manuscript.layout, "doc_id", "line_no", "kind", "font", "size", "indent", "bold", _digest("text")),
        "packet_clean": _docs(manuscript.packet_clean, "doc_id", "title", "comments", "status_lines", "placeholders", "todos", _digest("text")),
        "docx": _docs(lambda d: files.as_docx(manuscript.layout(d, "footnote"), cites.footnote_resolve(d)), "doc_id", "file", lambda: F.length("content").alias("size")),
        "pii_file_kinds": _listings(pii.file_kinds),
        # reports and listings
        "redundancy_report": _seeded(reports.redundancy_report),
        "trace_report": _seeded(reports.trace_report),
        "punct_report": _seeded(reports.punct_report),
        "normalized": _seeded(lambda d: reports.normalized(d, True), "doc_id", "double_quotes", "single_quotes", "ellipses", "marks", "year_ranges", _digest("text")),
        "pii_verdict": _seeded(reports.pii_verdict),
        "pii_report": _seeded(reports.pii_report),
        "bib_reference_list": _bib(lambda b: reports.reference_list(b, "law", 101)),
        "bib_listing": _bib(reports.listing, "ord", _digest("text")),
        "packet": _docs(reports.packet, "doc_id", "file", _digest("text")),
        "paged_text": _docs(lambda d: reports.paged_text(_paged(d)), "doc_id", "file", "scanned", _digest("text")),
        "run_counters": _run,
        "scan_detect": _docs(lambda d: files.scan_detect(_paged(d))),
        "incremental_skip": _skip,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
