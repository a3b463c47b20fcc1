"""Frequency of every distinct term, by heavy-light aggregation.

The heavy terms are found by a mergeable frequent-items sketch over all rows. They get numbers and are broadcast:
at most ``HEAVY`` rows. Each task adds up their occurrences in an exact array of counters and emits one row for
each heavy term it met, so that a term which a third of all records hold moves as a few rows. Only the other terms
are shuffled, after partial aggregation, and both tables of counts are united. A term that the sketch misses is
merely counted the other way; no count is approximate.

Empty, blank and null fields have no term. Occurrences count repeats within a record, records do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY, TRACKED = 256, 8192
SEPARATOR = "\u001f"


def occurrences(values: DataFrame) -> DataFrame:
    """(field_name, term, first) of each value in (id, field_name, values); first: 1 once per record and term."""
    ordered = values.select("field_name", F.array_sort("values").alias("v"))
    flagged = F.expr("transform(v, (x, i) -> struct(x AS term, CASE WHEN i = 0 OR v[i - 1] <> x THEN 1 ELSE 0 END AS first))")
    return ordered.select("field_name", F.explode(flagged).alias("t")).select("field_name", "t.term", "t.first")


def heavy_terms(rows: DataFrame) -> list[tuple[str, str]]:
    """At most HEAVY pairs (field_name, term) that occur most often, by a sketch."""
    key = F.concat("field_name", F.lit(SEPARATOR), "term")
    top = rows.select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {HEAVY}, {TRACKED})").alias("top")).first()["top"]
    return [tuple(r["item"].split(SEPARATOR, 1)) for r in top or []]


def count_terms(values: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records) of every distinct term of (id, field_name, values)."""
    rows = occurrences(values)
    pairs = heavy_terms(rows)
    spark = values.sparkSession
    numbered = spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(pairs)], "field_name string, term string, heavy int")
    marked = rows.join(F.broadcast(numbered), ["field_name", "term"], "left")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            total += np.bincount(at, minlength=len(total))
            once += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=len(once)).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met]), pa.array(once[met])], ["heavy", "occurrences", "records"])

    local = marked.where("heavy IS NOT NULL").select("heavy", "first").mapInArrow(tally, "heavy int, occurrences bigint, records bigint")
    heavy = local.groupBy("heavy").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    heavy = heavy.join(F.broadcast(numbered), "heavy").select("field_name", "term", "occurrences", "records")
    light = marked.where("heavy IS NULL").groupBy("field_name", "term")
    return heavy.unionByName(light.agg(F.count("*").alias("occurrences"), F.sum("first").cast("bigint").alias("records")))


def marked_terms(values: DataFrame, n_records: int, rare: int = 2, common: float = 0.02) -> DataFrame:
    """The counts, and mark: rare (in at most so many records), common (in more than that share of all), or null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n_records, "common")
    return count_terms(values).withColumn("mark", mark)
