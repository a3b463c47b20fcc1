"""Several values packed in one field: choosing the dialect of each field by minimum description length.

A dialect says which marks part values. Semicolons, bars, tabs, enumeration and wide commas and ``$$`` always do,
outside of enclosing double quotes; the comma, the word *and*, and a blank beside a wide character may or may not,
which gives eight dialects. A field that all of them parse alike needs no choice. Those fields make a code book:
how often each value, and each shape of a value, occurs in its column over the whole corpus. The other fields take
the dialect under which the codes of their values, in bits, are shortest.

The book holds every value that occurs twice or more, and every shape. It stays a distributed table and is joined to
the values that a field may hold; only the ``HOT`` most frequent values and shapes of each column are at hand in every
task instead, so that no join is skewed by them. What a field's parse is doesn't depend on ``HOT``.

Null, empty and blank fields hold no value. Empty values between marks are skipped; repeats stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import log2
from operator import and_ as and_op

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import let
from scriptorium.session import cut

BLANKS = " \t"
HARD = ";；|、，"
WHOLE = r'^"[^"]*+(?:""[^"]*+)*+"$'
WIDE = r"⺀-鿿豈-﫿（）“”《》"
#: (comma, and, blank) of each dialect; the first marks are the plainest.
DIALECTS = [(c, a, b) for b in (False, True) for a in (False, True) for c in (False, True)]
#: Values, and shapes, of each column that are broadcast instead of joined; results don't depend on it.
HOT = 2_000
#: Longer values and shapes are known by their digest.
LONG = 64
#: Bits of a spelled character, of a mark between two values, and of a shape never seen.
SPELLED, MARK, UNSEEN = 5.0, 3.0, 17.0


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _unquoted(v: Column) -> Column:
    inner = F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.rlike(v, F.lit(WHOLE)), _trim(inner)).otherwise(v)


def _split_plain(values: Column, mark: str) -> Column:
    """The values, those not enclosed in quotes split at a mark."""
    return F.flatten(F.transform(values, lambda v: F.when(F.rlike(_trim(v), F.lit(WHOLE)), F.array(v)).otherwise(F.split(_trim(v), mark))))


def parse(field: Column, comma: bool, and_: bool, blank: bool) -> Column:
    """The values of a field under one dialect, in order, quotes removed."""
    marks = HARD + ("," if comma else "")
    stop = rf"(?:[{marks}\t]|\$\$|\z)"
    quoted = r'"[^"]*+(?:""[^"]*+)*+"(?=[ \t]*+' + stop + ")"
    plain = rf"(?:[^{marks}\t$]++|\$(?!\$))*+"
    values = F.regexp_extract_all(field, F.lit(rf"[ ]*+({quoted}|{plain})[ \t]*?{stop}"), F.lit(1))
    parts = []
    if and_:
        parts.append(r"(?i)[ ]++and[ ]++")
    if blank:
        parts.append(rf'(?<=[{WIDE}"])[ ]++|[ ]++(?=[{WIDE}"])')
    for mark in parts:
        values = _split_plain(values, mark)
    return F.filter(F.transform(values, lambda v: _unquoted(_trim(v))), lambda v: v != "")


def shape(v: Column) -> Column:
    """What a value looks like: ! an initial, @ a word, # wide characters, % a single one, 0 digits."""
    v = F.regexp_replace(v, r"(?<!\p{L})[\p{L}&&[^\p{IsHan}]]\.", "!")
    v = F.regexp_replace(v, r"[\p{L}&&[^\p{IsHan}]][\p{L}\p{M}'’\-&&[^\p{IsHan}]]*+", "@")
    v = F.regexp_replace(v, rf"[{WIDE}·《》]{{2,}}+", "#")
    v = F.regexp_replace(v, rf"[{WIDE}]", "%")
    return F.regexp_replace(v, r"[0-9]++", "0")


def long_fields(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name, field): a row for each field that isn't null or blank."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("field")) for f in fields]))
    return df.select(F.col(f"`{id_col}`").alias("id"), each.alias("_e")).select("id", "_e.field_name", "_e.field").where(_trim(F.col("field")) != "")


def _open(field: Column) -> Column:
    """Whether the dialects may differ on a field."""
    return F.rlike(field, F.lit(rf'(?i),|[ ]and[ ]|[{WIDE}"][ ]+[^ {HARD}|\t$]|[^ {HARD}|\t$][ ]+[{WIDE}"]'))


def code_book(fields: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(field_name, key, n) of each repeated value and each shape, and the number of values of each column.

    Counted are the fields on which all dialects agree. A key is a value, or "\\0" + a shape; long ones are digested,
    so that a key has at most LONG characters, whatever the values are.
    """
    plain = fields.where(~_open(F.col("field"))).select("field_name", F.explode_outer(parse(F.col("field"), False, False, False)).alias("v")).where("v IS NOT NULL")
    quoted = fields.where(F.contains(F.col("field"), F.lit('"')) & _open(F.col("field")))  # what quotes enclose is one value in every dialect
    pattern = rf'(?:^|[{HARD},\t])[ ]*"([^"]*)"(?=[ ]*(?:[{HARD},\t]|\z))'
    inside = quoted.select("field_name", F.explode_outer(F.regexp_extract_all("field", F.lit(pattern), F.lit(1))).alias("v")).where("v IS NOT NULL")
    counts = cut(plain.unionByName(inside).groupBy("field_name", "v").agg(F.count("*").alias("n")))  # read three times
    shapes = counts.groupBy("field_name", _shape_key(shape(F.col("v"))).alias("key")).agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in counts.groupBy("field_name").agg(F.sum("n")).collect()}
    return cut(counts.where("n > 1").select("field_name", _key(F.col("v")).alias("key"), "n").unionByName(shapes)), totals


def _key(c: Column) -> Column:
    return F.when(F.length(c) > LONG, F.concat(F.left(c, F.lit(1)), F.md5(F.encode(c, "utf-8")))).otherwise(c)


def _shape_key(s: Column) -> Column:
    return _key(F.concat(F.lit("\0"), s))


def _plain_key(text: str) -> str:
    """The same, of a value or a shape at hand."""
    return text[0] + hashlib.md5(text.encode()).hexdigest() if len(text) > LONG else text


def _hot(book: DataFrame, columns: Iterable[str]) -> dict[tuple[str, str], int]:
    """n by (column, key) of the most frequent values and shapes of each column, at most 2 * HOT for each."""
    out: dict[tuple[str, str], int] = {}
    for column in columns:
        for of_shape in (False, True):
            part = book.where((F.col("field_name") == column) & (F.startswith(F.col("key"), F.lit("\0")) == of_shape))
            for r in part.orderBy(F.desc("n"), "key").limit(HOT).collect():
                out[column, r["key"]] = r["n"]
    return out


def _bits(total: int, known: Callable[[str], int | None], value: str, look: str) -> float:
    n, of_shape = known(_plain_key(value)), known(_plain_key("\0" + look))
    spelled = (UNSEEN if of_shape is None else -log2(of_shape / total)) + SPELLED * len(value)
    return spelled if n is None else min(-log2(n / total), spelled)


def _chosen(fields: DataFrame) -> DataFrame:
    """(id, field_name, values) of the fields on which dialects may differ: those of the cheapest one."""
    spark = fields.sparkSession
    book, totals = code_book(fields)
    hot = _hot(book, totals)
    at_hand = spark.sparkContext.broadcast((hot, totals))

    @F.arrow_udf("array<string>")
    def cheapest(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        often, total = at_hand.value
        for columns, parses, joined in batches:
            out = []
            for column, candidates, found in zip(columns.to_pylist(), parses.to_pylist(), joined.to_pylist(), strict=True):
                here = {x["key"]: x["n"] for x in found or ()}
                best, least = None, float("inf")
                for values in candidates:
                    bits = MARK * len(values) + sum(_bits(total.get(column, 1), lambda k: often.get((column, k), here.get(k)), v["v"], v["s"]) for v in values)
                    if bits < least:
                        best, least = values, bits
                out.append(None if best is None else [v["v"] for v in best])
            yield pa.array(out, pa.list_(pa.string()))

    field = F.col("field")
    may = {"comma": F.contains(field, F.lit(",")), "and": F.rlike(field, F.lit("(?i)[ ]and[ ]")), "blank": F.rlike(field, F.lit(rf'[{WIDE}"][ ]|[ ][{WIDE}"]'))}
    candidates = []
    for comma, and_, blank in DIALECTS:  # a mark that a field lacks can't part it
        values = F.transform(parse(field, comma, and_, blank), lambda v: F.struct(v.alias("v"), shape(v).alias("s")))
        needed = [may[k] for k, on in (("comma", comma), ("and", and_), ("blank", blank)) if on]
        candidates.append(F.when(reduce(and_op, needed), values) if needed else values)
    rows = cut(fields.where(_open(field)).select("id", "field_name", F.array_compact(F.array(*candidates)).alias("candidates")))  # parsed once, read twice
    each = F.array_distinct(F.flatten("candidates"))
    keys = F.array_distinct(F.concat(F.transform(each, lambda x: _key(x["v"])), F.transform(each, lambda x: _shape_key(x["s"]))))
    hot_keys = F.broadcast(spark.createDataFrame(list(hot), "field_name string, key string"))
    rest = rows.select("id", "field_name", F.explode(keys).alias("key")).join(hot_keys, ["field_name", "key"], "left_anti")
    found = rest.join(book, ["field_name", "key"]).groupBy("id", "field_name").agg(F.collect_list(F.struct("key", "n")).alias("found"))
    return rows.join(found, ["id", "field_name"], "left").select("id", "field_name", cheapest("field_name", "candidates", "found").alias("values"))


def with_values(fields: DataFrame) -> DataFrame:
    """(id, field_name, values): the values of each field of ``long_fields``, under its cheapest dialect.

    Ids are unique in each column.
    """
    plain = fields.where(~_open(F.col("field"))).select("id", "field_name", parse(F.col("field"), False, False, False).alias("values"))
    return plain.unionByName(_chosen(fields))


def unpack(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name, pos, value) of each value of each field that holds two or more; pos counts from 1."""
    # Sizes are tested within the array, and the outer explode needs no test of its own: fields are parsed once.
    several = let(F.col("values"), lambda v: F.when(F.size(v) >= 2, v))
    rows = with_values(long_fields(df, fields, id_col)).select("id", "field_name", F.posexplode_outer(several).alias("pos", "value"))
    return rows.where("pos IS NOT NULL").withColumn("pos", F.col("pos") + 1)
