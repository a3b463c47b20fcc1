"""Citations against reference lists, and notes against their definitions.

A manuscript is its body before the heading of the reference list, and the list. It is one row, so citations and
entries are parsed into arrays once and compared within the row: nothing is shuffled. Positions count from 1. Texts
without such a heading have no list and are left out of the checks of lists. Numbers beyond 64 bits are no citations;
gaps come as ranges, so that a high number in a list costs no more than a low one. Null texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules as R
from scriptorium.functions.text import each, let, strip
from scriptorium.operators.lines import body, lines, references


def _manuscripts(docs: DataFrame) -> DataFrame:
    return docs.where(F.instr("text", R.REFS_HEADING) > 0)


def doc_split(docs: DataFrame) -> DataFrame:
    """(doc_id, body_chars, list_chars) of each manuscript."""
    t = F.col("text")
    return _manuscripts(docs).select("doc_id", F.length(body(t)).alias("body_chars"), F.length(references(t)).alias("list_chars"))


def mode_detect(docs: DataFrame) -> DataFrame:
    """(doc_id, mode): how a document cites: notes, list, or neither (error)."""
    t = F.col("text")
    notes, cited, head = t.rlike(r"(?md)^\[\^[0-9]+\]:"), body(t).rlike(R.CITATION), F.instr(t, R.REFS_HEADING) > 0
    mode = F.when(notes & ~cited, "footnote").when(head & cited, "journal").when(notes, "footnote").when(head, "journal").otherwise("error")
    return docs.where(t.isNotNull()).select("doc_id", mode.alias("mode"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, occ, raw): each citation mark of the body, in order."""
    found = F.regexp_extract_all(body(F.col("text")), F.lit(R.CITATION), F.lit(1))
    return each(_manuscripts(docs), ["doc_id"], found, "raw", "occ").select("doc_id", "occ", "raw")


def _number(digits: Column) -> Column:
    return digits.try_cast("bigint")


def expand(raw: Column) -> Column:
    """The numbers that a mark stands for: ranges of less than 200 in full, others by their first number."""
    parts = F.filter(F.transform(F.split(raw, "[,，]"), strip), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "[-–—]"), lambda x: _number(strip(x)))

    def numbers(e: Column) -> Column:
        a, b = F.get(e, F.lit(0)), F.get(e, F.lit(1))
        return F.when(a.isNull(), F.array().cast("array<bigint>")).when((a <= b) & (b - a < 200), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))

    return F.flatten(F.transform(F.transform(parts, ends), numbers))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, occ, pos, num): each number cited, in order."""
    return each(groups(docs), ["doc_id", "occ"], expand(F.col("raw")), "num", "pos").select("doc_id", "occ", "pos", "num")


def _entries(refs: Column) -> Column:
    """Entries (num, ord, entry) of a list, in order; lines without a number continue the one before."""
    found = F.struct(F.regexp_extract_all(refs, F.lit(R.ENTRY), F.lit(1)).alias("n"), F.regexp_extract_all(refs, F.lit(R.ENTRY), F.lit(2)).alias("t"))
    plain = lambda t: strip(F.regexp_replace(t, f"[{R.WS}]+", " "))
    each = let(found, lambda f: F.transform(f["n"], lambda n, i: F.struct(_number(n).alias("num"), (i + 1).alias("ord"), plain(F.get(f["t"], i)).alias("entry"))))
    return F.filter(each, lambda e: e["num"].isNotNull() & (e["entry"] != ""))


def _canonical(entries: Column, merge: bool = True) -> Column:
    """(num, ord, entry, key, canonical) of the first entry of each number, by number.

    canonical is the lowest number with the same content, which key tells from others.
    """
    all_nums = F.struct(entries.alias("e"), F.transform(entries, lambda e: e["num"]).alias("n"))
    first = let(all_nums, lambda v: F.array_sort(F.filter(v["e"], lambda e, i: F.array_position(v["n"], e["num"]) == i + 1)))
    key = lambda e: F.lower(F.regexp_replace(e["entry"], R.ENTRY_ASIDE, ""))
    keyed = let(first, lambda f: F.struct(f.alias("f"), F.transform(f, key).alias("k")))

    def put(v: Column, e: Column, i: Column) -> Column:
        k = F.get(v["k"], i)
        lowest = F.get(v["f"], (F.array_position(v["k"], k) - 1).cast("int"))["num"] if merge else e["num"]
        return F.struct(e["num"].alias("num"), e["ord"].alias("ord"), e["entry"].alias("entry"), k.alias("key"), lowest.alias("canonical"))

    return let(keyed, lambda v: F.transform(v["f"], lambda e, i: put(v, e, i)))


def _parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, body, cited, entries): the body, the numbers of each citation mark, and the entries of the list."""
    t = F.col("text")
    cited = F.transform(F.regexp_extract_all(body(t), F.lit(R.CITATION), F.lit(1)), expand)
    return _manuscripts(docs).select("doc_id", body(t).alias("body"), cited.alias("cited"), _entries(references(t)).alias("entries"))


def _used() -> Column:
    """The numbers cited, in the order of their first citation."""
    return F.array_distinct(F.flatten("cited"))


def _listed() -> Column:
    """The numbers listed, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["num"])))


def ref_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, num, ord, entry): the entries of each list; lines without a number continue the one before."""
    return each(_parsed(docs), ["doc_id"], F.col("entries"), "e").select("doc_id", "e.num", "e.ord", "e.entry")


def cite_missing(docs: DataFrame) -> DataFrame:
    """(doc_id, num) of each number cited but not listed."""
    return each(_parsed(docs), ["doc_id"], F.array_except(_used(), _listed()), "num")


def cite_extra(docs: DataFrame) -> DataFrame:
    """(doc_id, num) of each number listed but not cited."""
    return each(_parsed(docs), ["doc_id"], F.array_except(_listed(), _used()), "num")


def _gaps(nums: Column) -> Column:
    """Ranges (first, last) that sorted numbers lack, from 1 on."""
    each = let(nums, lambda s: F.transform(s, lambda n, i: F.struct((F.coalesce(F.get(s, i - 1), F.lit(0)) + 1).alias("first"), (n - 1).alias("last"))))
    return F.filter(each, lambda g: g["first"] <= g["last"])


def cite_gaps(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): each range of numbers up to the highest of a list that it lacks."""
    return each(_parsed(docs), ["doc_id"], _gaps(_listed()), "g").select("doc_id", "g.first", "g.last")


def _repeated(entries: Column) -> Column:
    """(num, n) of each number listed more than once, by number."""
    again = let(F.array_sort(F.transform(entries, lambda e: e["num"])), lambda s: F.filter(s, lambda n, i: (i > 0) & (F.get(s, i - 1) == n)))
    return let(again, lambda a: F.transform(F.array_distinct(a), lambda n: F.struct(n.alias("num"), (F.size(F.filter(a, lambda x: x == n)) + 1).cast("bigint").alias("n"))))


def cite_dup_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, num, n) of each number listed more than once."""
    return each(_parsed(docs), ["doc_id"], _repeated(F.col("entries")), "x").select("doc_id", "x.num", "x.n")


def first_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, num, entry, key, canonical): the first entry of each number, what tells it from others, and the lowest number with the same."""
    return each(_parsed(docs), ["doc_id"], _canonical(F.col("entries")), "e").select("doc_id", "e.num", "e.entry", "e.key", "e.canonical")


def cite_canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, num, canonical): each number listed, and the lowest number with the same entry."""
    return first_entries(docs).select("doc_id", "num", "canonical")


def cite_zombies(docs: DataFrame) -> DataFrame:
    """(doc_id, first_num, num) of each entry that repeats an earlier one under another number."""
    return cite_canonical(docs).where("canonical <> num").select("doc_id", F.col("canonical").alias("first_num"), "num")


def cite_first_order(docs: DataFrame) -> DataFrame:
    """(doc_id, num, place): the numbers cited, in the order in which they first appear."""
    return each(_parsed(docs), ["doc_id"], _used(), "num", "place").select("doc_id", "num", "place")


def cite_order_mismatch(docs: DataFrame) -> DataFrame:
    """(doc_id, num, place) of each number that isn't cited in its turn."""
    return cite_first_order(docs).where("num <> place")


def cite_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, occurrences, cited, entries, lowest, highest) of each manuscript."""
    size = lambda c: F.size(c).cast("bigint")
    out = _parsed(docs).select("doc_id", size(F.flatten("cited")).alias("occurrences"), size(_used()).alias("cited"), _listed().alias("l"))
    return out.select("doc_id", "occurrences", "cited", size(F.col("l")).alias("entries"), F.array_min("l").alias("lowest"), F.array_max("l").alias("highest"))


def shown_numbers(nums: Column, most: int = 40) -> Column:
    """Numbers in brackets, the first most of them, and how many there are if that isn't all."""
    some = F.concat(F.lit("["), F.array_join(F.slice(nums, 1, most), "] ["), F.lit("]"))
    more = F.when(F.size(nums) > most, F.concat(F.lit(" … 共 "), F.size(nums).cast("string"), F.lit(" 个"))).otherwise("")
    return F.when(F.size(nums) == 0, "（空）").otherwise(F.concat(some, more))


def cite_verdict(docs: DataFrame) -> DataFrame:
    """(doc_id, missing, extra, gaps, repeated, zombies, mismatch, cited_shown, listed_shown, mismatch_shown, status).

    Counts of what the checks of a manuscript find, and the numbers as a report shows them; status 1 if there is any.
    """
    d = _parsed(docs).select("doc_id", _used().alias("used"), _listed().alias("listed"), "entries", _canonical(F.col("entries")).alias("canon"))
    wrong = let(F.col("used"), lambda u: F.filter(u, lambda n, i: n != i + 1))
    size = lambda c: F.size(c).cast("bigint")
    gaps = F.aggregate(_gaps(F.col("listed")), F.lit(0).cast("bigint"), lambda acc, g: acc + g["last"] - g["first"] + 1)
    counts = {
        "missing": size(F.array_except("used", "listed")),
        "extra": size(F.array_except("listed", "used")),
        "gaps": gaps,
        "repeated": size(_repeated(F.col("entries"))),
        "zombies": size(F.filter("canon", lambda e: e["canonical"] != e["num"])),
        "mismatch": size(wrong),
    }
    shown = [shown_numbers(F.array_sort("used")).alias("cited_shown"), shown_numbers(F.col("listed")).alias("listed_shown"), shown_numbers(wrong, 8).alias("mismatch_shown")]
    out = d.select("doc_id", *[c.alias(n) for n, c in counts.items()], *shown)
    return out.withColumn("status", (sum((F.col(n) for n in counts), F.lit(0)) > 0).cast("int"))


def _plan(docs: DataFrame, keep_uncited: bool = True, merge: bool = True) -> DataFrame:
    """(doc_id, body, cited, canon, nums, listed, used, order): all that a new numbering needs, one row for each manuscript.

    order holds the numbers that stay, in their new order: those cited first in turn, the others after them; it has
    numbers cited but not listed, and of entries with one content only the first.
    """
    d = _parsed(docs).select("doc_id", "body", "cited", _canonical(F.col("entries"), merge).alias("canon"))
    d = d.select("*", F.transform("canon", lambda e: e["num"]).alias("nums"), F.array_sort(F.array_distinct(F.transform("canon", lambda e: e["canonical"]))).alias("listed"))
    both = F.struct(_used().alias("u"), F.col("nums").alias("n"), F.col("canon").alias("c"))
    used = let(both, lambda v: F.array_distinct(F.transform(v["u"], lambda n: _canon_of(n, v["n"], v["c"]))))
    d = d.select("*", used.alias("used"))
    order = F.concat("used", F.array_except("listed", "used")) if keep_uncited else F.col("used")
    return d.select("*", order.alias("order"))


def _canon_of(n: Column, nums: Column, canon: Column) -> Column:
    return F.coalesce(F.get(canon, (F.array_position(nums, n) - 1).cast("int"))["canonical"], n)


def renumber_map(docs: DataFrame, keep_uncited: bool = True) -> DataFrame:
    """(doc_id, old, new, listed): new numbers in the order of first citation, uncited entries after them.

    Entries of one content share the number of the first; a number cited but not listed keeps a place.
    """
    out = each(_plan(docs, keep_uncited), ["doc_id", "listed"], F.col("order"), "old", "new")
    return out.select("doc_id", "old", "new", F.array_contains("listed", F.col("old")).alias("listed"))


def _list_lines(order: Column, nums: Column, canon: Column) -> Column:
    """The lines of the list in its new order; a missing entry has a placeholder."""

    def line(v: Column, old: Column, i: Column) -> Column:
        entry = F.get(v["c"], (F.array_position(v["n"], old) - 1).cast("int"))["entry"]
        text = F.coalesce(entry, F.concat(F.lit(R.MISSING_ENTRY[0]), old.cast("string"), F.lit(R.MISSING_ENTRY[1])))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text)

    return let(F.struct(order.alias("o"), nums.alias("n"), canon.alias("c")), lambda v: F.transform(v["o"], lambda old, i: line(v, old, i)))


def renumber_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, new, line): the reference list under new numbers; a missing entry has a placeholder."""
    return each(_plan(docs), ["doc_id"], _list_lines(F.col("order"), F.col("nums"), F.col("canon")), "line", "new").select("doc_id", "new", "line")


def _ranges(nums: Column) -> Column:
    """Sorted numbers with runs of three and more written as ranges."""
    # A number opens a run if the one before it isn't there, and closes one if the next isn't.
    opens = let(nums, lambda s: F.filter(s, lambda n, i: F.coalesce(F.get(s, i - 1) != n - 1, F.lit(True))))
    closes = let(nums, lambda s: F.filter(s, lambda n, i: F.coalesce(F.get(s, i + 1) != n + 1, F.lit(True))))

    def text(a: Column, b: Column) -> Column:
        one, two = a.cast("string"), b.cast("string")
        return F.when(b - a >= 2, F.array(F.concat_ws("-", one, two))).when(a == b, F.array(one)).otherwise(F.array(one, two))

    return let(F.struct(opens.alias("a"), closes.alias("b")), lambda v: F.flatten(F.transform(v["a"], lambda a, i: text(a, F.get(v["b"], i)))))


def compress_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, occ, shown): each mark with its numbers sorted and runs of three and more written as ranges."""
    nums = F.array_sort(F.array_distinct(expand(F.col("raw"))))
    return groups(docs).select("doc_id", "occ", F.array_join(_ranges(nums), ", ").alias("shown"))


def renumber(docs: DataFrame, keep_uncited: bool = True, merge: bool = True, compress: bool = False, allow_missing: bool = False) -> DataFrame:
    """(doc_id, status, missing, changed, body, refs): each manuscript under new numbers.

    Marks are rewritten as their new numbers, sorted, one bracket each, or with runs as ranges (compress). Status is 0
    where it is rewritten, 1 where it is refused because entries are missing (unless allow_missing puts placeholders),
    and 2 where nothing is cited; body and refs are null unless it is 0. changed counts numbers that become others.
    """
    p = _plan(docs, keep_uncited, merge)
    nums = F.struct(F.col("cited").alias("m"), F.col("nums").alias("n"), F.col("canon").alias("c"), F.col("order").alias("o"))
    new = lambda v, n: F.array_position(v["o"], _canon_of(n, v["n"], v["c"]))
    brackets = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(_ranges(x) if compress else x, "]["), F.lit("]"))).otherwise("")
    marks = let(nums, lambda v: F.transform(v["m"], lambda g: let(F.array_sort(F.array_distinct(F.transform(g, lambda n: new(v, n)))), brackets)))
    missing = F.size(F.array_except("used", "listed"))
    changed = let(F.struct(F.col("used").alias("u"), F.col("order").alias("o")), lambda v: F.size(F.filter(v["u"], lambda n: F.array_position(v["o"], n) != n)))
    status = F.when(F.size("cited") == 0, 2).when((missing > 0) & F.lit(not allow_missing), 1).otherwise(0)
    put = lambda v: F.transform(v["p"], lambda t, i: F.concat(t, F.coalesce(F.get(v["m"], i), F.lit(""))))
    text = F.array_join(let(F.struct(F.split("body", R.CITATION).alias("p"), marks.alias("m")), put), "")
    refs = F.array_join(F.concat(F.array(F.lit(R.REFS_HEADING), F.lit("")), _list_lines(F.col("order"), F.col("nums"), F.col("canon"))), "\n")
    fine = lambda c: F.when(F.col("status") == 0, c)
    out = p.withColumn("status", status)
    return out.select("doc_id", "status", missing.alias("missing"), changed.alias("changed"), fine(text).alias("body"), fine(F.concat(refs, F.lit("\n"))).alias("refs"))


def renumber_body(docs: DataFrame) -> DataFrame:
    """(doc_id, body): the body of each manuscript that cites, its marks rewritten; missing entries have placeholders."""
    out = renumber(docs, allow_missing=True)
    return each(out, ["doc_id"], F.array(F.col("body")), "body").select("doc_id", "body")


def _notes(text: Column) -> tuple[Column, Column]:
    """The numbers of all references to notes, and of all definitions; the head of a definition is no reference."""
    head = f"(?md){R.NOTE_HEAD}"
    numbers = lambda c, p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), _number)
    return numbers(F.regexp_replace(text, head, ""), R.NOTE_MARK), numbers(text, head)


def footnotes(docs: DataFrame) -> DataFrame:
    """(doc_id, num, refs, defs): how often each note is referred to and defined."""
    refs, defs = _notes(F.col("text"))
    flagged = lambda c, r, d: F.transform(c, lambda n: F.struct(n.alias("num"), F.lit(r).alias("r"), F.lit(d).alias("d")))
    rows = each(docs, ["doc_id"], F.concat(flagged(refs, 1, 0), flagged(defs, 0, 1))).select("doc_id", "x.*")
    return rows.where("num IS NOT NULL").groupBy("doc_id", "num").agg(F.sum("r").alias("refs"), F.sum("d").alias("defs"))


def footnote_verdict(docs: DataFrame) -> DataFrame:
    """(doc_id, missing, unused, gaps, status) of each text with a note: how many are undefined, unused and left out."""
    refs, defs = (F.array_sort(F.array_distinct(F.array_compact(c))) for c in _notes(F.col("text")))
    d = docs.where(F.col("text").rlike(R.NOTE_ANY)).select("doc_id", refs.alias("refs"), defs.alias("defs"))
    size = lambda c: F.size(c).cast("bigint")
    gaps = F.aggregate(_gaps(F.col("defs")), F.lit(0).cast("bigint"), lambda acc, g: acc + g["last"] - g["first"] + 1)
    out = d.select("doc_id", size(F.array_except("refs", "defs")).alias("missing"), size(F.array_except("defs", "refs")).alias("unused"), gaps.alias("gaps"))
    return out.withColumn("status", (F.col("missing") + F.col("unused") + F.col("gaps") > 0).cast("int"))


def footnote_missing(docs: DataFrame) -> DataFrame:
    """(doc_id, num) of each note referred to but not defined."""
    return footnotes(docs).where("refs > 0 AND defs = 0").select("doc_id", "num")


def footnote_unused(docs: DataFrame) -> DataFrame:
    """(doc_id, num) of each note defined but not referred to."""
    return footnotes(docs).where("refs = 0 AND defs > 0").select("doc_id", "num")


def footnote_resolve(docs: DataFrame) -> DataFrame:
    """(doc_id, num, definition, refs): each note referred to, with the first line of its last definition."""
    text = strip(F.regexp_replace("line", rf"{R.NOTE_HEAD}[{R.WS}]*", ""))
    num = _number(F.nullif(F.regexp_extract("line", R.NOTE_HEAD, 1), F.lit("")))
    d = lines(docs).select("doc_id", "line_no", num.alias("num"), text.alias("t")).where("num IS NOT NULL")
    d = d.groupBy("doc_id", "num").agg(F.max_by("t", "line_no").alias("definition"))
    return footnotes(docs).where("refs > 0").join(d, ["doc_id", "num"]).select("doc_id", "num", "definition", "refs")
