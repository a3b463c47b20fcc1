"""Files as tables, and tables as files."""

from __future__ import annotations

import importlib
import importlib.util
import io
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried.
LADDER = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5")


def decode(content: bytes | None, ladder: tuple[str, ...] = LADDER, on_error: str = "replace") -> tuple[str | None, str | None]:
    """Text, and the first encoding of the ladder that reads all bytes; else UTF-8 with bad bytes replaced or left out."""
    if content is None:
        return None, None
    for name in ladder:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", on_error), "unknown(replaced)"


def decoded(files: DataFrame, ladder: tuple[str, ...] = LADDER, on_error: str = "replace") -> DataFrame:
    """files, with text and encoding of its content. Line ends stay as they are."""

    @F.arrow_udf("struct<text:string,encoding:string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pairs = [decode(x, ladder, on_error) for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["text", "encoding"])

    return files.withColumn("_d", read("content")).select(*files.columns, "_d.text", "_d.encoding")


#: Folders whose files are no documents.
PRUNED = r"/(?:\.git|__pycache__|node_modules|\.?venv|\.idea|\.vscode)/"


def read_files(spark: SparkSession, paths: str | list[str], suffix: str = ".txt", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files of folders with a suffix, in any case.

    Paths that aren't there are named in a warning and left out, likewise files that vanish while they are read. Empty
    files have no row.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for p in [paths] if isinstance(paths, str) else paths:
        path = hadoop.Path(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
        else:
            warnings.warn(f"no such path: {p}", stacklevel=2)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    if not there:
        return spark.createDataFrame([], schema)
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(there).dropDuplicates(["path"]).where(~F.col("path").rlike(PRUNED))


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, text): the pages of each file of (path, content), by extract or the first PDF library at hand.

    A file that can't be read has one row without a page. Without a library, extract must be given.
    """
    extract = extract or _pdf_library()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, i, t) for i, t in enumerate(extract(content), 1)]
                except Exception:  # noqa: BLE001  whatever a library raises on a broken file
                    rows.append((path, None, None))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 3, (pa.string(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "page_no", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, text string")


def _pdf_library() -> Callable[[bytes], list[str]]:
    for name in ("pymupdf", "fitz"):
        if importlib.util.find_spec(name):
            return lambda content: [p.get_text(sort=False) for p in importlib.import_module(name).open(stream=content, filetype="pdf")]
    if importlib.util.find_spec("pypdf"):
        return lambda content: [p.extract_text() or "" for p in importlib.import_module("pypdf").PdfReader(io.BytesIO(content)).pages]
    raise ImportError("no PDF library here: give extract, a function of the bytes of a file to the texts of its pages")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of records with a header line; it must have a title."""
    out = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    out = out.toDF(*[c.lstrip("\ufeff") for c in out.columns])
    if "title" not in out.columns:
        raise ValueError(f"{path} has no column title")
    if out.isEmpty():
        raise ValueError(f"{path} holds no record")
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the numbers of a list, set apart by white space or commas; anything else is an error."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"[\s,，]+")).alias("w")).where("w <> ''")
    return words.select(F.col("w").cast("int").alias("id")).distinct()


def scan_detect(pages: DataFrame, least: int = 80, markers: bool = True) -> DataFrame:
    """(doc_id, pages, chars, scanned): paged texts with so few characters a page that they must be images.

    With markers, the marker line that each page is written with counts as well.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if markers:
        text = F.concat(F.lit("===== PAGE "), F.col("page_no").cast("string"), F.lit(" =====\n"), text)
    per_doc = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))).alias("chars"))
    return per_doc.withColumn("scanned", F.col("chars") / F.col("pages") < least)


def incremental_skip(files: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """(path, skip): files whose output is at least as new as they are need no work."""
    newest = outputs.groupBy("path").agg(F.max("out_mtime").alias("out_mtime"))
    skip = F.coalesce(F.col("out_mtime") >= F.col("mtime"), F.lit(False)) & F.lit(not force)
    return files.join(newest, "path", "left").select("path", skip.alias("skip"))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml."
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_INLINE = re.compile(r"\*\*(.+?)\*\*|\[\^([0-9]+)\]")


def _run(text: str, font: str, size: float, bold: bool) -> str:
    half = round(2 * size)
    fonts = f'<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman" w:eastAsia="{font}"/>'
    return f'<w:r><w:rPr>{fonts}{"<w:b/>" * bold}<w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""


def _runs(text: str, font: str, size: float, bold: bool, notes: dict[int, str] | None) -> str:
    """Bold spans and references to notes as runs of their own; references drop out where notes aren't printed."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(_run(text[at : m.start()], font, size, bold))
        if m[1] is not None:
            out.append(_run(m[1], font, size, True))
        elif notes is not None:
            known = int(m[2]) in notes
            out.append(f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="{int(m[2])}"/></w:r>' if known else _run(m[0], font, size, bold))
        at = m.end()
    return "".join(out) + _run(text[at:], font, size, bold)


def _table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    edge = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    cell = lambda t: f"<w:tc><w:p>{_run(t, '宋体', 9, False)}</w:p></w:tc>"
    body = "".join("<w:tr>" + "".join(cell(r[i] if i < len(r) else "") for i in range(wide)) + "</w:tr>" for r in rows)
    return f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid>{'<w:gridCol/>' * wide}</w:tblGrid>{body}</w:tbl>"


def _note(number: int, text: str) -> str:
    mark = '<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteRef/></w:r>'
    return f'<w:footnote w:id="{number}"><w:p>{mark}{_run(" " + text, "宋体", 9, False)}</w:p></w:footnote>'


_STYLE_OF = {"title": "Title", "h1": "Heading1", "h2": "Heading2"}
_RULER = re.compile(r":?-{2,}:?")


def docx(blocks: list[dict], notes: dict[int, str] | None = None, running_head: str = "") -> bytes:
    """A word-processing file of blocks: kind, text, font, size in points, bold and indent of each, in order.

    Neighbouring rows of kind table make a table, ruler rows left out. With notes, references to them become
    footnotes; a running head stands above each page.
    """
    body: list[str] = []
    held: list[list[str]] = []
    for b in [*blocks, None]:
        if b is not None and b["kind"] == "table":
            cells = [c.strip() for c in b["text"].strip("|").split("|")]
            if not all(_RULER.fullmatch(c or "-") for c in cells):
                held.append(cells)
            continue
        if held:
            body.append(_table(held))
            held = []
        if b is None:
            break
        style = f'<w:pStyle w:val="{_STYLE_OF[b["kind"]]}"/>' if b["kind"] in _STYLE_OF else ""
        indent = f'<w:ind w:firstLine="{round(b["size"] * 40)}"/>' if b["indent"] else ""
        body.append(f'<w:p><w:pPr>{style}{indent}</w:pPr>{_runs(b["text"], b["font"], b["size"], b["bold"], notes if b["kind"] == "p" else None)}</w:p>')
    parts = {"document": ("document.main", "officeDocument")}
    section = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:bottom="1440" w:left="1797" w:right="1797"/></w:sectPr>'
    files, links = {}, []
    if running_head:
        section = section.replace("<w:sectPr>", '<w:sectPr><w:headerReference w:type="default" r:id="r2"/>')
        files["header1"] = f'<w:hdr {_NS}><w:p><w:pPr><w:jc w:val="center"/></w:pPr>{_run(running_head, "楷体", 9, False)}</w:p></w:hdr>'
        parts["header1"] = ("header", "header")
        links.append(("r2", "header"))
    if notes:
        edges = "".join(f'<w:footnote w:type="{kind}" w:id="{n}"><w:p><w:r><w:{kind}/></w:r></w:p></w:footnote>' for kind, n in (("separator", -1), ("continuationSeparator", 0)))
        files["footnotes"] = f'<w:footnotes {_NS}>{edges}{"".join(_note(n, t) for n, t in sorted(notes.items()) if n > 0)}</w:footnotes>'
        parts["footnotes"] = ("footnotes", "footnotes")
        links.append(("r3", "footnotes"))
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Title", "Title"), ("Heading1", "heading 1"), ("Heading2", "heading 2")))
    files["styles"] = f"<w:styles {_NS}>{headings}</w:styles>"
    parts["styles"] = ("styles", "styles")
    links.append(("r4", "styles"))
    files["document"] = f'<w:document {_NS} xmlns:r="{_LINK}"><w:body>{"".join(body)}{section}</w:body></w:document>'
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_KIND}{k}+xml"/>' for n, (k, _) in parts.items())
    package = "http://schemas.openxmlformats.org/package/2006"
    link = lambda i, kind, target: f'<Relationship Id="{i}" Type="{_LINK}/{kind}" Target="{target}"/>'
    target = {"header": "header1.xml", "footnotes": "footnotes.xml", "styles": "styles.xml"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)  # noqa: E731  without a date: equal input, equal file
        put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        put("_rels/.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships">{link("r1", "officeDocument", "word/document.xml")}</Relationships>')
        put("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships">{"".join(link(i, k, target[k]) for i, k in links)}</Relationships>')
        for name, xml in files.items():
            put(f"word/{name}.xml", _HEAD + xml)
    return out.getvalue()


def as_docx(layout: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(doc_id, file, content): a word-processing file for each document of a layout.

    notes: doc_id, num, definition. A block of kind running_head is printed above each page. A document is put together
    in one task, as one file must be.
    """

    @F.arrow_udf("binary")
    def build(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for blocks, defined in batches:
            out = []
            for rows, n in zip(blocks.to_pylist(), defined.to_pylist(), strict=True):
                head = next((r["text"] for r in rows if r["kind"] == "running_head"), "")
                out.append(docx([r for r in rows if r["kind"] != "running_head"], None if n is None else {x["num"]: x["definition"] for x in n}, head))
            yield pa.array(out, pa.binary())

    rows = layout.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "text", "font", "size", "indent", "bold"))).alias("rows"))
    if notes is None:
        rows = rows.withColumn("notes", F.lit(None).cast("array<struct<num:bigint,definition:string>>"))
    else:
        defined = notes.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("num").cast("bigint").alias("num"), "definition")).alias("notes"))
        rows = rows.join(defined, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("file"), build("rows", "notes").alias("content"))
