"""Mixing sources to target weights in tokens.

The tokens of each source that has a target are summed, and each gets a repetition rate: what its share of the wanted
total needs, but at most its cap. A document is then emitted floor(rate) times, and once more with a probability equal
to the rest of the rate, decided by a hash of its id and the seed: the same documents are drawn on every run and on
every cluster, and no source is held in one place. Documents are drawn where they are read, whole text and all; nothing
of them is shuffled. The rates are a table of one row for each target, and broadcast while these are at most ``FEW``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets up to which their table is broadcast.
FEW = 10_000


def _small(df: DataFrame, targets: int) -> DataFrame:
    return F.broadcast(df) if targets <= FEW else df


def rates(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, rate) of each target.

    counts: doc_id, source, n_tokens. total_tokens: the size of the mixture, by default that of all documents.
    A source without tokens has rate 0; null sources belong to no target. Repeated target rows count once.
    """
    if total_tokens is None:
        total_tokens = counts.agg(F.sum("n_tokens")).first()[0] or 0  # one row
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    here = counts.join(_small(wanted.select("source"), wanted.count()), "source", "left_semi")
    per_source = here.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    sized = wanted.join(per_source, "source", "left")
    cap = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("double")
    need = F.coalesce("target_share", F.lit(0.0)) * F.lit(float(total_tokens)) / F.col("tokens")
    rate = F.when(F.col("tokens") > 0, F.greatest(F.least(need, cap), F.lit(0.0))).otherwise(0.0)
    return sized.select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        rate.alias("rate"),
    )


def uniform(key: str, seed: int) -> F.Column:
    """A number in [0, 1) from a hash of the key, the same wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / F.lit(float(1 << 53))


def draw(docs: DataFrame, rate_table: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The columns of docs, and copy: each drawn copy of a document, numbered from 1.

    docs has id_col and source; rate_table has one row for each target. Documents of no target are not drawn. A column
    that is called copy already is replaced.
    """
    docs = docs.drop("copy", "_rate", "_copies")
    r = _small(rate_table.select("source", F.col("rate").alias("_rate")), rate_table.count())
    copies = F.floor("_rate") + F.when(uniform(id_col, seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    drawn = docs.join(r, "source").withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def report(drawn: DataFrame, rate_table: DataFrame) -> DataFrame:
    """One row for each target: what it should reach and what it reached, in tokens.

    drawn: source, n_tokens, copy of each drawn copy.
    """
    got = drawn.groupBy("source").agg(
        F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("drawn_copies"), F.max("copy").alias("most_copies")
    )
    total = drawn.agg(F.sum("n_tokens")).first()[0] or 0  # one row
    out = rate_table.join(got, "source", "left")
    zero = F.lit(0).cast("bigint")
    share = F.coalesce(F.col("drawn_tokens"), zero) / F.lit(float(max(1, total)))
    return out.select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.round("rate", 6).alias("rate"),
        F.coalesce("drawn_copies", zero).alias("drawn_copies"), F.coalesce("drawn_tokens", zero).alias("drawn_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), share.alias("actual_share"),
    )
