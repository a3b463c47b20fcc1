"""Text that looks alike but is made of other characters, brought to one form.

Each value is first mapped, character by character, to what it looks like: full-width and mathematical letters and
digits, compatibility ideographs and radicals to the plain ones, spaces of any kind to the blank, invisible
characters to nothing, combining accents to precomposed letters, and letters of another script inside a Latin word
to Latin ones. A word that is wholly of its own script stays as it is. Distinct values are then grouped in SQL by the
mapped form under an accent-sensitive Unicode collation, for which canonically equivalent spellings are equal. The
canonical member of a class is the one that is written as it looks, the first in code point order among several; a
class in which every member is written otherwise has the form they look like. It is joined back to every row. In page
ranges, dashes become hyphens, and letters that stand for digits become digits.

The tables are built from the Unicode database, not listed. Punctuation of titles is left alone. Null values have
no canonical form; empty values keep theirs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Cyrillic, Greek, Armenian and IPA letters, and the Latin letters they look like.
LIKE_FROM = "АВСЕНІЈКМОРЅТХУԚԜасеіјорѕухһԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινυαρϲոսօցհɡıɑ"
LIKE_TO = "ABCEHIJKMOPSTXYQWaceijopsyxhdqwvABEZHIKMNOPTYXoivuapcnuoghgia"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
#: Most values have no character beyond these and need no mapping: ASCII, unified ideographs, Latin letters with
#: accents, and punctuation.
UNUSUAL = r"[^\x00-\x7f\x{4e00}-\x{9fff}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{130}\x{132}-\x{17e}\x{2010}-\x{2027}\x{3001}-\x{3011}\x{ff0c}\x{ff08}\x{ff09}\x{ff1a}\x{ff1b}\x{ff1f}\x{ff01}\x{b7}]"
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"
YEAR = r"(?<![A-Za-z0-9])(?=[lIoO]{0,2}[0-9])(?=[0-9]*[lIoO])[0-9lIoO]{4}(?![A-Za-z0-9])"
#: A number of a page range in which letters stand for digits; it has a digit, or is made of such letters alone.
NUMBER = r"(?<![A-Za-z0-9])I+(?=-[0-9])|(?<=[0-9]-)I+(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:(?=[lIoO]*[0-9])[0-9lIoO]+|[lIoO]*[oOl][lIoO]*)(?![A-Za-z0-9])|(?<=\b[A-Z])(?=[lIoO]*[0-9])[0-9lIoO]+(?![A-Za-z0-9])"
DASHES = "‐‑‒–—―−﹘﹣－⁃⸺"


@cache
def _plain_table() -> tuple[str, str]:
    """Single characters that differ from ordinary ones in width, style or code only, and those."""
    before, after = [], []
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]:
        c = chr(code)
        kind = unicodedata.category(c)
        to = " " if kind == "Zs" else unicodedata.normalize("NFKC", c)
        if to == c or len(to) != 1:
            continue
        letter = kind[0] in "LN" or 0x2E80 <= code < 0x2FE0  # radicals count as symbols
        alike = to == " " or to.isalnum()
        tag = unicodedata.decomposition(c).split(" ")[0]
        if alike and (letter or kind == "Zs") and tag not in ("<super>", "<sub>", "<circle>", "<vertical>", "<square>", "<fraction>"):
            before.append(c)
            after.append(to)
    return "".join(before), "".join(after)


def _let(v: Column, body: Callable[[Column], Column]) -> Column:
    """body(v), with v computed once however often the body names it."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


@F.arrow_udf(StringType())
def _precomposed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Combining marks put on their letters; Spark has no function for it. Null where there are none, as nearly everywhere."""
    for batch in batches:
        yield pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in batch.to_pylist()], pa.string())


def _latin_words(v: Column) -> Column:
    """Look-alike letters to Latin ones, in each word that they share with Latin letters or digits, or fill alone."""
    like = f"[{LIKE_FROM}]"
    word = r"[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"
    words = F.regexp_extract_all(v, F.lit(word), F.lit(0))
    between = F.split(v, word)
    mixed = lambda w: (w.rlike(like) & w.rlike("[A-Za-z0-9]")) | w.rlike(f"^{like}{{1,}}$")
    fixed = F.transform(words, lambda w: F.when(mixed(w), F.translate(w, LIKE_FROM, LIKE_TO)).otherwise(w))
    pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(fixed, i), F.lit(""))))
    return F.when(v.rlike(like), F.array_join(pieces, "")).otherwise(v)


def _widths(v: Column) -> Column:
    """v without invisible characters, and with letters and spaces of the ordinary width and style."""
    before, after = _plain_table()
    out = _let(F.regexp_replace(v, f"[{INVISIBLE}]", ""), lambda x: F.translate(x, before, after))
    for joined in LIGATURES:
        out = F.replace(out, F.lit(joined), F.lit(unicodedata.normalize("NFKC", joined)))
    return F.when(v.rlike(UNUSUAL), out).otherwise(v)


def _letters(v: Column) -> Column:
    """v with letters of another script within Latin words, and letters within years, as what they look like."""
    plain = F.when(v.rlike(f"[{LIKE_FROM}]"), _let(v, _latin_words)).otherwise(v)
    # A letter within a number of four digits stands for a digit.
    return _let(plain, lambda x: F.when(x.rlike("[0-9][lIoO]|[lIoO][0-9]") & x.rlike(YEAR), _digits_of(x, YEAR)).otherwise(x))


def _digits_of(v: Column, number: str) -> Column:
    """v with l, I, o and O in each match of number turned into digits."""
    digits = F.transform(F.regexp_extract_all(v, F.lit(number), F.lit(0)), lambda n: F.translate(n, "lIoO", "1100"))
    return _let(digits, lambda d: F.array_join(F.transform(F.split(v, number), lambda b, i: F.concat(b, F.coalesce(F.get(d, i), F.lit("")))), ""))


def _page_digits(v: Column) -> Column:
    """A page range with hyphens, and with digits for letters that stand for them."""
    return _digits_of(F.translate(v, DASHES + "Ƽ", "-" * len(DASHES) + "5"), NUMBER)


def looks(df: DataFrame) -> DataFrame:
    """(field_name, value, ...) with mapped: what each value looks like, in ordinary characters."""
    marked = F.col("_w").rlike("[\u0300-\u036f]")
    out = df.withColumn("_w", _widths(F.col("value")))
    out = out.withColumn("_c", F.coalesce(_precomposed(F.when(marked, F.col("_w"))), F.col("_w")))
    nothing = F.col("value").rlike(r"^[\s\u00a0\u3000]*[-/—–]*[\s\u00a0\u3000]*$")
    pages = F.when(nothing, F.col("value")).otherwise(_let(_letters(F.col("_c")), _page_digits))
    return out.withColumn("mapped", F.when(F.col("field_name") == "pages", pages).otherwise(_letters(F.col("_c")))).drop("_w", "_c")


def canonical(values: DataFrame) -> DataFrame:
    """(field_name, value, canonical, n) of each distinct value of (field_name, value)."""
    distinct = values.where("value IS NOT NULL").groupBy("field_name", "value").agg(F.count("*").alias("n"))
    mapped = looks(distinct)
    return values.sparkSession.sql(
        """
        SELECT field_name, value, n, coalesce(min(CASE WHEN value = mapped THEN value END) OVER alike, min(mapped) OVER alike) AS canonical
        FROM {mapped} WINDOW alike AS (PARTITION BY field_name, mapped COLLATE UNICODE)
        """,
        mapped=mapped,
    )


def odd_fields(records: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name, value) of each field that isn't written in its canonical form."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields]))
    rows = records.select(F.col(f"`{id_col}`").alias("id"), each.alias("_e")).select("id", "_e.field_name", "_e.value").where("value IS NOT NULL")
    odd = canonical(rows).where("value <> canonical").select("field_name", "value")
    return rows.join(odd, ["field_name", "value"]).select("id", "field_name", "value")
