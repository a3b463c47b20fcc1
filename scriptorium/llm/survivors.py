"""The best representative of each group of duplicate records, field by field.

Claims are the members' values of each field. ``truths`` is iterative truth discovery: the reliability of a source
and the support of a value are estimated in turn, each from the other, until the reliabilities change by less than
``TOLERANCE``; only the table of sources, one row for each site, comes to the driver in between, and the votes are
joined to it by broadcast. The value of highest support wins its field.

``survivors`` is the operator in the form that stated priorities need. A vote then carries the priority of its
record: a whole value before one cut short, the trust of its export file, the later export, the smaller id. Such
votes dominate one another, so that no number of weaker ones outweighs a stronger, and the highest-supported value
is that of the record of highest priority. Plain truth discovery, in which many poor sources may outvote a good one,
can't return that choice; it stands beside it as a query of its own.

A value that says nothing (null, empty, or a way of writing none or unknown) makes no claim, and a field without a
claim has no row. Repeated member rows count once. Members without a record are left out; records whose file isn't
listed have the lowest trust. A file listed again keeps its latest listing.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut

NOTHING = r"(?i)^[\s　]*(?:n/?a|none|null|nil|nan|unknown|missing|not available|无|不详|未知|暂缺|暂无|缺|空|[?？.。…/\\_—–-]+)?[\s　]*$"
ROUNDS, TOLERANCE = 100, 1e-4
#: Characters by which a group's abstracts are spread when those that continue one another are looked for.
PREFIX = 16
#: What the end of a value looks like that was cut short, for each field.
CUT = {
    "pages": r"[-~–—‐‑‒−－][\s?？.…]*$|[?？…]+\s*$",
    "doi": r"^(?i)(?:doi:\s*)?10\.[0-9]+(?:/(?:[^./\s]+\.)?)?$|[?？…]+$",
    "abstract": r"(?:…|\.\.\.|\[更多\]|\[more\])\s*$",
    "volume": r"[?？…-]+\s*$",
}
STOPPED = r"[。．.!！?？…”’\"'）)\]】》»:：;；]\s*$"


def _cut_short(field: Column, value: Column) -> Column:
    short = F.lit(False)
    for name, pattern in CUT.items():
        ends = value.rlike(pattern)
        if name == "abstract":
            ends = ends | ~value.rlike(STOPPED)
        short = short | ((field == name) & ends)
    return short


def claims(members: DataFrame, records: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """(group_id, field_name, value, id, whole, trust, exported_at, site) of each value that says something."""
    listed = files.groupBy("source_file").agg(F.max_by(F.struct("trust", "exported_at", "site"), "loaded_at").alias("f"))
    rows = members.select("group_id", "id").distinct().join(records.select("id", "source_file", *fields), "id")
    rows = rows.join(listed, "source_file", "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields]))
    out = rows.select("group_id", "id", F.coalesce("f.trust", F.lit(-(1 << 30))).alias("trust"), "f.exported_at", F.coalesce("f.site", F.lit("")).alias("site"), each.alias("e"))
    out = out.select("group_id", "e.field_name", "e.value", "id", "trust", "exported_at", "site")
    out = out.where(F.col("value").isNotNull() & ~F.col("value").rlike(NOTHING))
    return out.withColumn("whole", ~_cut_short(F.col("field_name"), F.col("value")))


def _begun(c: DataFrame) -> DataFrame:
    """(group_id, value) of each abstract of fewer than PREFIX characters with which a longer one of its group begins.

    Only groups that have so short an abstract are looked at, and of their abstracts only the first characters.
    """
    a = c.where("field_name = 'abstract'").select("group_id", F.left("value", F.lit(PREFIX)).alias("p")).distinct()
    short = a.where(F.length("p") < PREFIX)
    longer = a.join(short.select("group_id").distinct(), "group_id", "left_semi")
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 1), lambda k: F.left(F.col("p"), k))).alias("p")
    begins = longer.where(F.length("p") > 1).select("group_id", begins).distinct()
    return short.join(begins, ["group_id", "p"], "left_semi").select("group_id", F.col("p").alias("value"))


def survivors(members: DataFrame, records: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """(group_id, field_name, id, value, trust, votes) of the surviving value of each field of each group.

    Votes are combined for each value, then for each field, both before they are shuffled, so that a group of any
    size travels as few rows. An abstract that another one of its group continues was cut short, too; such a pair has
    its first characters in common, so that a group is spread over them; abstracts shorter than that are looked up
    among the beginnings of the others.
    """
    c = cut(claims(members, records, files, fields))  # read for the values, and for their beginnings
    when = F.coalesce(F.col("exported_at"), F.timestamp_micros(F.lit(0)))
    vote = F.struct(F.col("trust").alias("trust"), when.alias("exported_at"), (-F.col("id")).alias("minus_id"))
    values = c.groupBy("group_id", "field_name", "value").agg(F.max(vote).alias("v"), F.count("*").alias("n"), F.max("whole").alias("whole"))
    near = Window.partitionBy("group_id", "field_name", F.left("value", F.lit(PREFIX))).orderBy("value")
    values = values.withColumn("next", F.lead("value").over(near))
    short = (F.col("field_name") == "abstract") & (F.length("value") < PREFIX)
    begun = _begun(c).select(F.col("group_id").alias("_g"), F.col("value").alias("begun"))
    values = values.join(begun, short & (F.col("group_id") == F.col("_g")) & (F.col("value") == F.col("begun")), "left").drop("_g")
    goes_on = (F.length("value") >= PREFIX) & F.startswith(F.col("next"), F.col("value"))
    continued = (F.col("field_name") == "abstract") & (goes_on | F.col("begun").isNotNull())
    whole = (F.col("whole") & ~F.coalesce(continued, F.lit(False))).cast("int")
    strength = F.struct(whole.alias("whole"), F.col("v"))
    top = values.groupBy("group_id", "field_name").agg(F.max_by(F.struct("value", "v"), strength).alias("best"), F.sum("n").alias("votes"))
    return top.select("group_id", "field_name", (-F.col("best.v.minus_id")).alias("id"), "best.value", "best.v.trust", "votes")


def truths(members: DataFrame, records: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """(group_id, field_name, value, support, votes): the value of highest support under learnt reliabilities.

    Values cut short stand only where a field has no whole one, so that every field with a claim has its row.
    """
    spark = members.sparkSession
    of_field = Window.partitionBy("group_id", "field_name")
    c = claims(members, records, files, fields).groupBy("group_id", "field_name", "value", "site", "whole").agg(F.count("*").alias("n"))
    c = c.withColumn("some", F.max("whole").over(of_field)).where("whole = some").drop("whole", "some")
    c = cut(c)  # read again in each round
    weight = {r[0]: 1.0 for r in c.select("site").distinct().collect()}  # one row for each site

    def supported() -> DataFrame:
        sites = spark.createDataFrame(list(weight.items()) or [("", 1.0)], "site string, w double")
        votes = c.join(F.broadcast(sites), "site").groupBy("group_id", "field_name", "value")
        s = votes.agg(F.sum(F.col("w") * F.col("n")).alias("s"), F.sum("n").alias("votes"))
        return s.withColumn("support", F.col("s") / F.sum("s").over(of_field))

    for _ in range(ROUNDS):
        agreed = c.join(supported(), ["group_id", "field_name", "value"]).groupBy("site").agg((F.sum(F.col("support") * F.col("n")) / F.sum("n")).alias("r"))
        new = {r["site"]: max(r["r"], 1e-6) for r in agreed.collect()}
        top = max(new.values(), default=1.0)
        new = {k: v / top for k, v in new.items()}
        moved = max((abs(new[k] - weight[k]) for k in new), default=0.0)
        weight = new
        if moved < TOLERANCE:
            break
    else:
        warnings.warn(f"reliabilities still moved by {moved:.2g} after {ROUNDS} rounds", stacklevel=2)
    best = F.max_by(F.struct("value", "support", "votes"), F.struct("support", "votes", "value")).alias("b")
    return supported().groupBy("group_id", "field_name").agg(best).select("group_id", "field_name", "b.value", F.round("b.support", 6).alias("support"), "b.votes")
