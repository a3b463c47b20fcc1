"""Statistics and repetition checks of manuscripts, for all documents at once.

Documents without text have no rows; documents without sentences have zeros where a check gives one row for each.
Ties are broken by position in the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, matches, measured, strip
from scriptorium.operators.lines import body, measured_sentences, prose_array, sentence_array
from scriptorium.session import cut


def _sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, s) of each document with a text: its measured sentences, in one row."""
    return docs.where("text IS NOT NULL").select("doc_id", sentence_array(body(F.col("text"))).alias("s"))


def doc_stats(docs: DataFrame, baseline: float | None = None) -> DataFrame:
    """(doc_id, n_sentences, n_chars, avg_chars) of each document with a text.

    With a baseline of the mean length also deviation, in per cent of it, and near: whether it is at most 20.
    """
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x["chars"])
    out = _sentences(docs).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), chars.alias("n_chars"))
    out = out.withColumn("avg_chars", F.col("n_chars") / F.greatest(F.lit(1), F.col("n_sentences")))
    if baseline is None:
        return out
    off = (F.col("avg_chars") - F.lit(float(baseline))) / F.lit(float(baseline)) * F.lit(100.0)
    return out.withColumns({"deviation": off, "near": F.abs(off) <= 20})


def sentence_quantiles(docs: DataFrame) -> DataFrame:
    """(doc_id, q50, q75, q90, longest, over_100, share_100): the element at index min(n - 1, int(n * q)) of sorted lengths.

    over_100 counts sentences of more than 100 characters, share_100 is their share. Documents without a sentence have
    no row.
    """
    def facts(l: Column) -> Column:
        n = F.size(l)
        at = lambda q: F.get(l, F.least(n - 1, F.floor(n * F.lit(q)).cast("int")))
        over = F.size(F.filter(l, lambda c: c > 100)).cast("bigint")
        return F.when(n > 0, F.array(F.struct(at(0.5).alias("q50"), at(0.75).alias("q75"), at(0.9).alias("q90"), F.array_max(l).alias("longest"), over.alias("over_100"), (over / n).alias("share_100"))))

    sizes = F.array_sort(F.transform("s", lambda x: x["chars"]))
    return each(_sentences(docs), ["doc_id"], let(sizes, facts)).select("doc_id", "x.*")


def long_sentences(docs: DataFrame, most: int = 150) -> DataFrame:
    """(doc_id, line_no, sent_no, chars) of each sentence longer than most."""
    return measured_sentences(docs).where(F.col("chars") > most).select("doc_id", "line_no", "sent_no", "chars")


def bloated_array(text: Column, most: int) -> Column:
    """(line_no, chars, text) of each paragraph of a body longer than most."""
    each = F.transform(prose_array(text), lambda x: F.struct(x["line_no"].alias("line_no"), F.length(measured(x["text"])).alias("chars"), x["text"].alias("text")))
    return F.filter(each, lambda x: x["chars"] > most)


def bloated_paragraphs(docs: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, line_no, chars) of each paragraph longer than most."""
    return each(docs, ["doc_id"], bloated_array(body(F.col("text")), most)).select("doc_id", "x.line_no", "x.chars")


def longest(docs: DataFrame, sentences: int = 10, paragraphs: int = 8, long: int = 150, bloated: int = 500) -> DataFrame:
    """(doc_id, kind, rank, chars, line_no): the longest of the too long sentences and paragraphs, equal ones in order."""
    d = docs.where("text IS NOT NULL").select("doc_id", body(F.col("text")).alias("b"))

    def top(items: Column, k: int) -> Column:
        keyed = F.transform(items, lambda x, i: F.struct((-x["chars"]).alias("m"), i.alias("i"), x["line_no"].alias("line_no")))
        return F.slice(F.array_sort(keyed), 1, k)

    def named(kind: str, items: Column, k: int) -> Column:
        return F.transform(top(items, k), lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("rank"), (-x["m"]).alias("chars"), x["line_no"].alias("line_no")))

    too_long = F.filter(sentence_array(F.col("b")), lambda x: x["chars"] > long)
    both = F.concat(named("sentence", too_long, sentences), named("paragraph", bloated_array(F.col("b"), bloated), paragraphs))
    return each(d, ["doc_id"], both).select("doc_id", "x.*")


def section_array(text: Column) -> Column:
    """(section, title, chars) of each section of a body with a paragraph; （前言） is what comes before the first."""
    flat = f"{R.WS}".replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")  # without the line end
    parts = F.split(text, rf"(?md)(?=^[{flat}]*## [{flat}]*[^{R.WS}])")

    def measure(part: Column, i: Column) -> Column:
        lines_ = F.transform(F.split(part, "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("s")))
        keep = lambda x: (x["s"] != "") & ~x["s"].rlike(R.NOISE) & ~x["line"].rlike(R.NOTE_LINE)
        chars = F.transform(F.filter(lines_, keep), lambda x: F.length(measured(x["s"])).cast("bigint"))
        return F.struct(i.alias("i"), F.get(lines_, F.lit(0))["s"].alias("first"), F.when(F.size(chars) > 0, F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, n: acc + n)).alias("chars"))

    def number(v: Column) -> Column:
        opened = F.get(v, F.lit(0))["first"].startswith("## ").cast("int")
        return F.transform(v, lambda p: F.struct((p["i"] + opened).cast("bigint").alias("section"), F.when(p["first"].startswith("## "), strip(p["first"].substr(F.lit(4), F.length(p["first"])))).otherwise("（前言）").alias("title"), p["chars"].alias("chars")))

    return F.filter(let(F.transform(parts, measure), number), lambda p: p["chars"].isNotNull())


def section_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, section, title, chars, bar) of each section with a paragraph; a bar has a mark for each 200 characters."""
    out = each(docs, ["doc_id"], section_array(body(F.col("text")))).select("doc_id", "x.*")
    return out.withColumn("bar", bar(F.col("chars") / 200.0))


def bar(marks: Column) -> Column:
    """A bar of so many marks, at least one; halves are rounded to even."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(1), F.bround(marks, 0).cast("int")))


def filler_array(text: Column, least: int) -> Column:
    """(label, hits) of each filler phrase that a body has at least so often, notes left aside; the most frequent first."""
    counts = lambda b: F.array(*[F.struct((-matches(b, p)).alias("m"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (p, label) in enumerate(R.FILLER_PATTERNS)])
    some = let(without_notes(text), lambda b: F.when(b.rlike("|".join(p for p, _ in R.FILLER_PATTERNS)), counts(b)))
    ranked = F.array_sort(F.filter(some, lambda x: -x["m"] >= least))
    return F.coalesce(F.transform(ranked, lambda x: F.struct(x["label"].alias("label"), (-x["m"]).alias("hits"))), F.array().cast("array<struct<label:string,hits:int>>"))


def filler_hits(docs: DataFrame, least: int = 3, top: int = 12) -> DataFrame:
    """(doc_id, rank, label, hits) of the top filler phrases that a body has at least so often; equal ones in the order of the patterns."""
    return each(docs, ["doc_id"], F.slice(filler_array(body(F.col("text")), least), 1, top), "x", "rank").select("doc_id", "rank", "x.label", "x.hits")


def without_notes(text: Column) -> Column:
    """A body without the lines that define notes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(R.NOTE_LINE)), "\n")


def repeated_ngrams(docs: DataFrame, size: int = 10, least: int = 3, top: int = 10) -> DataFrame:
    """(doc_id, rank, gram, hits): the top strings of size characters that sentences of a document repeat."""
    s = measured_sentences(docs).where(F.col("chars") >= size)
    grams = s.select("doc_id", "line_no", "sent_no", "norm", F.explode(F.sequence(F.lit(1), F.col("chars") - (size - 1))).alias("k"))
    grams = grams.select("doc_id", F.substring("norm", F.col("k"), F.lit(size)).alias("gram"), F.struct("line_no", "sent_no", "k").alias("at"))
    hits = grams.groupBy("doc_id", "gram").agg(F.count("*").alias("hits"), F.min("at").alias("at")).where(F.col("hits") >= least)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "at"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "gram", "hits")


#: Sentences of a document that are compared in one task; more are cut into blocks, and pairs of blocks are spread.
BLOCK = 1024
_CLASS = pa.struct([("line_no", pa.int32()), ("sent_no", pa.int32()), ("norm", pa.string()), ("copies", pa.int64())])


def _block_pairs(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, i, j, a, b): each two blocks of different sentences of a document, i <= j; b is null where i = j.

    Sentences of one content are one class, at their first place. A document of at most BLOCK classes is one row.
    """
    long_enough = F.filter("s", lambda x: x["chars"] >= least_chars)
    rows = _sentences(docs).select("doc_id", F.transform(long_enough, lambda x: F.struct(x["line_no"].alias("line_no"), x["sent_no"].alias("sent_no"), x["norm"].alias("norm"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(_CLASS), pa.list_(_CLASS)), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "i", "j", "a", "b"])

        for batch in batches:
            for doc, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                classes: dict[str, dict] = {}
                for x in places:
                    classes.setdefault(x["norm"], {**x, "copies": 0})["copies"] += 1
                items = list(classes.values())
                blocks = [items[k : k + BLOCK] for k in range(0, len(items), BLOCK)]
                for j, right in enumerate(blocks):
                    for i, left in enumerate(blocks[: j + 1]):
                        rows.append((doc, i, j, left, right if i < j else None))
                        held += len(left) + len(right)
                        if held > 4 * BLOCK:
                            yield batch_of()
                            rows.clear()
                            held = 0
        if rows:
            yield batch_of()

    kind = "array<struct<line_no:int,sent_no:int,norm:string,copies:bigint>>"
    return rows.mapInArrow(run, f"doc_id bigint, i int, j int, a {kind}, b {kind}")


def _counts(texts: list[str], at: dict[str, int]) -> np.ndarray:
    """How often each text holds each character."""
    out = np.zeros((len(texts), len(at)), np.float32)
    for r, text in enumerate(texts):
        codes, n = np.unique([at[c] for c in text], return_counts=True)
        out[r, codes] = n
    return out


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """Start in a, start in b, and length of the longest string that both hold: the earliest in a, then in b."""
    at = size = 0
    for i in range(len(a)):
        if i + size >= len(a):
            break
        while i + size < len(a) and a[i : i + size + 1] in b:
            at, size = i, size + 1
    return at, b.find(a[at : at + size]), size


def matching_ratio(a: str, b: str) -> float:
    """The matching-blocks ratio: twice what recursively longest common strings cover, over the length of both.

    Texts of 200 characters and more leave frequent characters aside, as the standard library does, which is asked then.
    """
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    covered, open_ = 0, [(a, b)]
    while open_:
        x, y = open_.pop()
        i, j, size = _longest(x, y)
        if size:
            covered += size
            open_ += [(x[:i], y[:j]), (x[i + size :], y[j + size :])]
    return 2.0 * covered / (len(a) + len(b)) if a or b else 1.0


def _near(texts_a: list[str], texts_b: list[str] | None, least: float, margin: float, mode: str, top: int) -> Iterator[tuple[int, int, float, float]]:
    """(row of a, row of b, overlap, score) of each two texts of at least that score; within a if there is no b.

    Overlaps of all pairs of a block are one product of matrices. A ratio is computed only where the overlap is at
    least least - margin and the characters that two texts have in common, with their counts, allow a higher score.
    Modes: overlap computes none; links only those that decide whether two texts are near; top those that may be
    among the top scores of the block, of which it gives no others.
    """
    same = texts_b is None
    texts_b = texts_a if same else texts_b
    at = {c: k for k, c in enumerate(sorted(set().union(*texts_a, *texts_b)))}
    ca = _counts(texts_a, at)
    cb = ca if same else _counts(texts_b, at)
    sa, sb = (ca > 0).astype(np.float32), (cb > 0).astype(np.float32)
    common = (sa @ sb.T).astype(np.float64)
    overlap = common / (sa.sum(1, dtype=np.float64)[:, None] + sb.sum(1, dtype=np.float64)[None] - common)
    chosen = (overlap >= (least if mode == "overlap" else least - margin)) & (common > 0)
    x, y = np.nonzero(np.triu(chosen, 1) if same else chosen)
    o = overlap[x, y]
    if mode == "overlap":
        yield from zip(x.tolist(), y.tolist(), o.tolist(), o.tolist(), strict=True)
        return
    shared = np.concatenate([np.minimum(ca[x[k : k + 2048]], cb[y[k : k + 2048]]).sum(1) for k in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
    bound = np.maximum(o, 2.0 * shared / (ca.sum(1)[x] + cb.sum(1)[y]))
    if mode == "links":
        sure = o >= least
        yield from zip(x[sure].tolist(), y[sure].tolist(), o[sure].tolist(), o[sure].tolist(), strict=True)
        order = np.flatnonzero(~sure & (bound >= least - 1e-6))
    else:
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= least - 1e-6]
    best: list[float] = []
    for p, q, v, most in zip(x[order].tolist(), y[order].tolist(), o[order].tolist(), bound[order].tolist(), strict=True):
        if mode == "top" and len(best) == top and most < best[0] - 1e-6:
            break
        score = max(v, matching_ratio(texts_a[p], texts_b[q])) if most > v else v
        if score >= least:
            heapq.heappush(best, score)
            if len(best) > top:
                heapq.heappop(best)
            yield p, q, v, score


def near_pairs(docs: DataFrame, least: float = 0.65, mode: str = "links", top: int = 15, least_chars: int = 20, margin: float = 0.25) -> DataFrame:
    """(doc_id, line_a, sent_a, line_b, sent_b, copies_a, copies_b, chars_a, chars_b, overlap, score).

    Each two different sentences of a document whose score is at least that: the overlap of their sets of characters,
    (mode overlap), or the higher of it and the matching-blocks ratio, the earlier text first. Pairs whose overlap is
    below least - margin aren't near, whatever their ratio: that is part of the definition. Mode links computes a
    ratio only where the overlap doesn't decide; mode top has the exact scores of the top pairs of each two blocks, and
    may leave out others. Sentences are given at
    their first place; of a sentence with copies those are counted, not paired. No pair is lost: a document's
    sentences are compared in blocks, and pairs of blocks are spread over all tasks by the one shuffle there is.
    """
    fields = ["line_a", "sent_a", "line_b", "sent_b", "copies_a", "copies_b", "chars_a", "chars_b", "overlap", "score"]
    types = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, left, right in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                a, b = left, left if right is None else right
                rows = []
                for x, y, overlap, score in _near([c["norm"] for c in a], None if right is None else [c["norm"] for c in b], least, margin, mode, top):
                    p, q = a[x], b[y]
                    rows.append((p["line_no"], p["sent_no"], q["line_no"], q["sent_no"], p["copies"], q["copies"], len(p["norm"]), len(q["norm"]), overlap, score))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), *columns], ["doc_id", *fields])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many however few the bytes: the work isn't in them
    spread = _block_pairs(docs, least_chars).repartition(parts, "doc_id", "i", "j")
    kinds = ["int"] * 4 + ["bigint"] * 2 + ["int"] * 2 + ["double"] * 2
    return spread.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} {k}" for f, k in zip(fields, kinds, strict=True)))


def top_near_pairs(docs: DataFrame, least: float = 0.65, top: int = 15) -> DataFrame:
    """(doc_id, rank, line_a, sent_a, line_b, sent_b, score): the pairs of highest score of each document; equal ones in order."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_a", "sent_a", "line_b", "sent_b"))
    out = near_pairs(docs, least, "top", top).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("doc_id", "rank", "line_a", "sent_a", "line_b", "sent_b", F.round("score", 6).alias("score"))


def sentence_classes(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """(doc_id, line_no, sent_no, copies): each different sentence of a document that is long enough, at its first place."""
    s = measured_sentences(docs).where(F.col("chars") >= least_chars)
    out = s.groupBy("doc_id", F.xxhash64("norm").alias("h"), "norm").agg(F.min(F.struct("line_no", "sent_no")).alias("at"), F.count("*").alias("copies"))
    return out.select("doc_id", "at.line_no", "at.sent_no", "copies")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line_no, sent_no, copies, links): each different sentence, and how many others are near it."""
    end = lambda x: F.struct(F.col(f"line_{x}").alias("line_no"), F.col(f"sent_{x}").alias("sent_no"), F.lit(0).cast("bigint").alias("copies"), F.lit(1).cast("bigint").alias("links"))
    ends = pairs.select("doc_id", F.explode(F.array(end("a"), end("b"))).alias("x")).select("doc_id", "x.*")
    rows = sentence_classes(docs).withColumn("links", F.lit(0).cast("bigint")).unionByName(ends)
    return rows.groupBy("doc_id", "line_no", "sent_no").agg(F.sum("copies").alias("copies"), F.sum("links").alias("links"))


def near_dup_jaccard(docs: DataFrame, least: float = 0.65) -> DataFrame:
    """(doc_id, line_no, sent_no, copies, links): each different sentence, and how many others overlap with it so far."""
    return _links(docs, near_pairs(docs, least, "overlap"))


def near_dup_ratio(docs: DataFrame, least: float = 0.65) -> DataFrame:
    """As near_dup_jaccard, by the higher of the overlap and the matching-blocks ratio, the earlier text first."""
    return _links(docs, near_pairs(docs, least))


def version_curve(docs: DataFrame, collapse: float = -40.0) -> DataFrame:
    """(project, version, doc_id, n_chars, change, collapsed): each document against the one before in its project.

    Documents of a project are ordered by version, time and id. They are sorted across all partitions, so that a
    large project is spread; the last row of each partition, one for each, is what the next one needs of it.
    """
    keys = ["project", "version", "saved_at", "doc_id"]
    rows = docs.where("project IS NOT NULL").select(*keys).join(doc_stats(docs).select("doc_id", "n_chars"), "doc_id").select(*keys, "n_chars")
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("part", F.spark_partition_id())
    last = placed.groupBy("part").agg(F.max_by(F.struct("project", "n_chars"), F.struct(*keys)).alias("l"))
    ends = sorted((r["part"], r["l"]["project"], r["l"]["n_chars"]) for r in last.collect())  # a row for each partition

    def previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = chars = None
        fresh = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if fresh:
                before = [e for e in ends if e[0] < batch.column("part")[0].as_py()]
                if before:
                    _, project, chars = before[-1]
                fresh = False
            projects, sizes = batch.column("project"), batch.column("n_chars")
            same = pc.equal(projects, pa.concat_arrays([pa.array([project], pa.string()), projects.slice(0, n - 1)]))
            shifted = pa.concat_arrays([pa.array([chars], pa.int64()), sizes.slice(0, n - 1)])
            out = pc.if_else(same, shifted, pa.scalar(None, pa.int64()))
            project, chars = projects[n - 1].as_py(), sizes[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.select(["project", "version", "doc_id", "n_chars"]).columns, out], ["project", "version", "doc_id", "n_chars", "before"])

    out = placed.mapInArrow(previous, "project string, version int, doc_id bigint, n_chars bigint, before bigint")
    change = (F.col("n_chars") - F.col("before")) / F.greatest(F.lit(1), F.col("before")) * F.lit(100.0)
    return out.select("project", "version", "doc_id", "n_chars", F.round(change, 6).alias("change"), F.coalesce(change <= collapse, F.lit(False)).alias("collapsed"))


def health_verdict(docs: DataFrame, least: float = 0.65, long: int = 150, bloated: int = 500) -> DataFrame:
    """(doc_id, near_dups, long_sentences, bloated, filler, chunks, status) of each document with a text.

    near_dups counts pairs of sentences, copies included, up to the 15 that a report shows, for which the top pairs of
    each two blocks are enough; filler up to 12 and chunks
    up to 10 likewise. Status is 1 if there is any of the five.
    """
    b = body(F.col("text"))
    size = lambda c: F.size(c).cast("bigint")
    here = docs.where("text IS NOT NULL").select(
        "doc_id", size(F.filter(sentence_array(b), lambda x: x["chars"] > long)).alias("long_sentences"), size(bloated_array(b, bloated)).alias("bloated"), size(F.slice(filler_array(b, 3), 1, 12)).alias("filler")
    )
    linked = near_pairs(docs, least, "top").select("doc_id", (F.col("copies_a") * F.col("copies_b")).alias("k"))
    copied = sentence_classes(docs).where("copies > 1").select("doc_id", F.expr("copies * (copies - 1) div 2").alias("k"))
    near = linked.unionByName(copied).groupBy("doc_id").agg(F.least(F.sum("k"), F.lit(15)).alias("near_dups"))
    chunks = repeated_ngrams(docs).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    out = here.join(near, "doc_id", "left").join(chunks, "doc_id", "left").fillna(0, ["near_dups", "chunks"])
    names = ["near_dups", "long_sentences", "bloated", "filler", "chunks"]
    return out.select("doc_id", *names, (sum((F.col(n) for n in names), F.lit(0)) > 0).cast("int").alias("status"))
