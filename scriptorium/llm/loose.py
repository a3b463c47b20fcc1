"""Records that differ only in white space, letter case, punctuation or field order.

Byte-identical rows are collapsed first, with their counts. Only the distinct survivors are brought to canonical
text, and these are grouped again on that whole text, the counts summed. A hot group thus travels as one row for
each way of writing it.

Where members are wanted, texts are named by the 256-bit digest of the whole of them, so that what is grouped and
joined after the first collapse is short. Ways of writing that hold a thousandth of all records or more are at most a
thousand; records come to these by broadcast, so that no key of the join back is hot. Where pairs are wanted, a class is
cut into blocks of ``BLOCK`` members: one side of a pair goes to its own block, the other to each block, so that no
task holds a large class.

Canonical text: letters and digits in lower case. Names lose their order, and the order of their parts; the word
*and* and a blank inside a name of wide characters are left aside. Missing names equal only missing names.
Null and empty titles equal each other, likewise null and empty file names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut

KEYS = ["title", "authors", "source_file"]
CANON = ["_title", "_authors", "_file"]
BLOCK = 512
NOTHING = r"(?i)^[\s　]*(?:n/?a|null|none|无|不详|未知|暂缺|[-/—]+)?[\s　]*$"
ASIDE = r"(?U)[\s\p{P}\p{Z}\p{Cc}|$+<>=^`~]+"


def _folded(c: Column) -> Column:
    """c without letter case: the sharp s is two letters in capitals, and the sigma has two small forms."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def _plain(c: Column) -> Column:
    return F.regexp_replace(_folded(F.coalesce(c, F.lit(""))), ASIDE, "")


def _names(c: Column) -> Column:
    one = F.regexp_replace(_folded(c), r"(?<=\p{IsHan})[ 　 ]+(?=\p{IsHan})", "")
    parts = F.filter(F.split(one, ASIDE), lambda p: (p != "") & (p != "and"))
    return F.when(F.coalesce(c, F.lit("")).rlike(NOTHING), F.lit("")).otherwise(F.concat(F.lit("="), F.array_join(F.sort_array(parts), " ")))


def canonical(df: DataFrame) -> DataFrame:
    """df with the canonical text of its three key columns."""
    return df.withColumns({"_title": _plain(F.col("title")), "_authors": _names(F.col("authors")), "_file": _plain(F.col("source_file"))})


def _survivors(records: DataFrame) -> DataFrame:
    raw = records.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return canonical(raw)


def collapse(records: DataFrame) -> DataFrame:
    """One row for each class: the smallest id, its title, authors and source_file, and the number of copies."""
    least = F.min_by(F.struct(*KEYS), "first_id").alias("r")
    classes = _survivors(records).groupBy(*CANON).agg(F.min("first_id").alias("id"), F.sum("n").alias("copies"), F.count("*").alias("writings"), least)
    return classes.select("id", *[F.col(f"r.{k}").alias(k) for k in KEYS], "copies", "writings")


def _digest(columns: list[str]) -> Column:
    """Names the texts of columns together, null apart from empty; each is led by its length."""
    text = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.encode(F.concat(*text), "utf-8"), 256))


def members(records: DataFrame) -> DataFrame:
    """(id, class_id, copies) of each record that has a copy."""
    ways = cut(_survivors(records).select(_digest(KEYS).alias("way"), _digest(CANON).alias("class"), "n", "first_id"))  # read three times
    classes = ways.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("copies")).where("copies > 1")
    of_way = ways.join(classes, "class").select("way", "n", "class_id", "copies")
    total = ways.agg(F.sum("n")).first()[0] or 0  # one row
    hot = F.col("n") * 1000 >= total
    rows = records.select("id", _digest(KEYS).alias("way"))
    if ways.where(hot).limit(1).count() == 0:
        return rows.join(of_way, "way").select("id", "class_id", "copies")
    few = F.broadcast(of_way.where(hot).select("way", "class_id", "copies"))  # at most a thousand rows
    found = rows.join(few, "way", "left")
    rest = found.where("class_id IS NULL").select("id", "way").join(of_way.where(~hot), "way")
    return found.where("class_id IS NOT NULL").select("id", "class_id", "copies").unionByName(rest.select("id", "class_id", "copies"))


def pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b) of each two records of a class, the smaller id first."""
    m = members(records)
    blocks = F.ceil(F.col("copies") / BLOCK).cast("int")
    a = m.select(F.col("id").alias("id_a"), "class_id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    b = m.select(F.col("id").alias("id_b"), "class_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return a.join(b, ["class_id", "block"]).where("id_a < id_b").select("id_a", "id_b")
