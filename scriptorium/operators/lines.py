"""Documents as lines, paragraphs, sentences and sections.

Null texts have no lines; an empty text has one empty line. Line numbers count from 1 in the text as stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, measured, strip


def lines(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """(doc_id, line_no, line) of each line of each text."""
    c = F.col(text) if isinstance(text, str) else text
    return each(docs, ["doc_id"], F.split(c, "\n"), "line", "line_no").select("doc_id", "line_no", "line")


def body(c: Column, heading: str = R.REFS_HEADING) -> Column:
    """The text before the heading of the reference list, or all of it."""
    at = F.instr(c, heading)
    return F.when(at == 0, c).otherwise(F.substring(c, F.lit(1), at - 1))


def references(c: Column, heading: str = R.REFS_HEADING) -> Column:
    """The text from the heading of the reference list on, or null."""
    at = F.instr(c, heading)
    return F.when(at > 0, c.substr(at, F.length(c)))


def _kept_array(text: Column, keep: Callable[[Column], Column]) -> Column:
    """(line_no, text): stripped lines that keep accepts, given as fields line and s (stripped).

    Lines are stripped and tested within the array, once each.
    """
    each = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), strip(x).alias("s")))
    return F.transform(F.filter(each, keep), lambda x: F.struct(x["line_no"].alias("line_no"), x["s"].alias("text")))


def _rows(docs: DataFrame, array: Column) -> DataFrame:
    return each(docs, ["doc_id"], array).select("doc_id", "x.*")


def paragraph_array(text: Column) -> Column:
    """(line_no, text): lines that are no heading, quotation, table, fence, rule or note."""

    def keep(x: Column) -> Column:
        t, line = x["s"], x["line"]
        fine = (t != "") & ~t.rlike(R.HEADING_LINE) & ~t.rlike(R.NOISE_NO_HEADING) & ~line.rlike(R.NOTE_LINE)
        return fine & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) < 2)

    return _kept_array(text, keep)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines that are no heading, quotation, table, fence, rule or note."""
    return _rows(docs, paragraph_array(F.col("text")))


def prose_array(text: Column) -> Column:
    """(line_no, text): stripped lines of a body that hold sentences."""
    return _kept_array(text, lambda x: (x["s"] != "") & ~x["s"].rlike(R.NOISE) & ~x["line"].rlike(R.NOTE_LINE))


def prose(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): stripped lines of the body that hold sentences."""
    return _rows(docs, prose_array(body(F.col("text")))).withColumnRenamed("text", "line")


def sentence_array(text: Column) -> Column:
    """(line_no, sent_no, sentence, norm, chars): prose of a body cut after each wide stop, which stays with its sentence.

    norm is what is measured of a sentence, and chars its length.
    """
    parts = lambda t: F.filter(F.transform(F.split(t, "(?<=[。！？；])"), strip), lambda x: x != "")

    def one(line_no: Column, p: Column, i: Column) -> Column:
        return let(measured(p), lambda m: F.struct(line_no.alias("line_no"), (i + 1).alias("sent_no"), p.alias("sentence"), m.alias("norm"), F.length(m).alias("chars")))

    return F.flatten(F.transform(prose_array(text), lambda x: F.transform(parts(x["text"]), lambda p, i: one(x["line_no"], p, i))))


def measured_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, sent_no, sentence, norm, chars) of each sentence of each body, as in sentence_array."""
    return _rows(docs, sentence_array(body(F.col("text"))))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, sent_no, sentence): prose cut after each wide stop, which stays with its sentence."""
    return measured_sentences(docs).select("doc_id", "line_no", "sent_no", "sentence")
