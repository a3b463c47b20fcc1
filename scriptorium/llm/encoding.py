"""Text read in the wrong encoding: found by the bytes it came from, and restored where nothing was lost.

For each way in which a text can have been misread, its characters are mapped back to the bytes of the encoding it
was read in. A byte-structure automaton (a regular expression over those bytes) finds the maximal spans that are
well-formed in the encoding the text was written in, and only these spans are decoded again. A span counts if the
decoded characters are commoner than those it was made from: ASCII, Latin letters with accents, Cyrillic, Greek,
CJK punctuation, or one of the 3,755 characters of level 1 of GB 2312.

Where bytes were lost, marks remain: U+FFFD, C1 controls, private-use and half-width kana characters, or the
characters that U+FFFD itself turns into. Such a field is garbled even if no span can be decoded.

Null and empty fields are not garbled. A text garbled twice is restored step by step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A sequence of UTF-8 for one character beyond ASCII, over bytes written as the characters U+0000 to U+00FF.
UTF8 = "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})"
LEVEL_1 = "".join(bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF))
#: Characters of well-read text, beyond ASCII: punctuation of CJK and of the Latin script, accented letters.
USUAL = "　-】〔〕！-／：-？～‐-…‹›«»°±·×÷€£§À-ÖØ-öø-žȘ-țΆ-ώЁА-яёІіЇїЄєҐґ"
COMMON = re.compile(f"[\x09\x0a\x0d\x20-\x7e{USUAL}{LEVEL_1}]")
RARE = re.compile(f"[^\x09\x0a\x0d\x20-\x7e{USUAL}{LEVEL_1}]")
LOST = re.compile("[�-\x80-\x9f｡-ﾟ]|锟斤|斤拷|锟.{0,6}拷|ï¿½")
HIGH = re.compile("[^\x00-\x7f]")


def _back(codec: str) -> dict[int, str]:
    """Character of a single-byte encoding -> its byte, as a character. Bytes it lacks stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


#: Encodings of one byte that text may have been read in.
NARROW = {name: _back(name) for name in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "koi8-r")}
#: Encodings of several bytes that text may have been read in, each with the one it was written in.
BROAD = ("gb18030", "cp950", "cp932")
RUN = re.compile(f"{UTF8}(?:[\x20-\x7e]?{UTF8})+")
#: A character of the Latin script within a word that became a wide one.
INSIDE = re.compile("(?<=[A-Za-z])[\u4e00-\u9fff](?=[a-z])|\\b[\u4e00-\u9fff](?=[a-z]{2})")
#: The dash of GBK between two numbers, read as Big5.
DASH_AS_BIG5 = re.compile("(?<=[0-9])〞(?=[0-9])")
TWO_BYTES = re.compile("[\x80-\u07ff]{2,}")
NOT_ASCII = re.compile("[^\x00-\x7f]{2,}")
#: Letters that none of the languages here is written in, nor made to look like; GBK read as UTF-8 holds them, or lost bytes.
EXOTIC = re.compile("[\u0180-\u019f\u01a2-\u01ae\u01b1-\u0217\u021c-\u0250\u0252-\u0260\u0262-\u02af\u0590-\u07ff]")
UTF8_SPAN = re.compile(f"{UTF8}+")
#: GBK that opens with a level 1 character, as text and names do, and has no ASCII byte.
GBK_SPAN = re.compile("[\xa1-\xa3\xb0-\xd7][\xa1-\xfe](?:[\xa1-\xfe]{2})*")
#: A name in GBK with second bytes that are ASCII, from one edge of a word to the other.
GBK_NAME = re.compile("(?<![A-Za-z\xa1-\xff])[\xb0-\xf7][\xa1-\xfe](?:[\x81-\xfe][\x40-\x7e\x80-\xfe]){1,3}(?![A-Za-z\x80-\xff])")
HAN = re.compile("[\u4e00-\u9fff]")
NARROW_HIGH = re.compile("[^\x00-\x7f\u2e80-\u9fff\uff00-\uffef]")
CYRILLIC = re.compile("^[Ѐ-ӿ]+$")
#: Characters that Chinese, or any one of the languages here, doesn't mix with wide text.
STRANGE = re.compile("[\u301d-\u301f\u3041-\u30ff\u3105-\u312f\u02c7-\u02d9\u0370-\u03ff\u2190-\u22ff\u2460-\u25ff\uff61-\uff9f\ufe30-\ufe6b\ue000-\uf8ff]")
_LEVEL = frozenset(LEVEL_1 + "，。：；？！、“”（）《》—·")


class _Narrow(dict):
    """A translation table that sends what the encoding lacks to a character that is no byte."""

    def __missing__(self, key: int) -> str:
        return chr(key) if key < 0x80 else "Ā"


TABLES = {name: _Narrow(table) for name, table in NARROW.items()}


def _worth(after: str) -> int:
    """How usual decoded characters are, all told."""
    return sum(2 if c in _LEVEL else 1 for c in after) - 3 * len(RARE.findall(after))


def _narrow(text: str) -> tuple[str, str] | None:
    """The text with the spans decoded that were read as single bytes, and the encoding they were read in."""
    best = None
    for name, table in TABLES.items():
        data = text.translate(table)
        for target, spans in (("utf-8", UTF8_SPAN), ("gbk", GBK_SPAN), ("gbk", GBK_NAME)) if name in ("cp1252", "latin-1") else (("utf-8", UTF8_SPAN),):
            out, at, worth, covered = [], 0, 0, 0
            for m in spans.finditer(data):
                before, after = text[m.start() : m.end()], m.group().encode("latin-1").decode(target, "replace")
                if target == "utf-8":
                    # Letters that stand side by side in their own right decode to nothing usual.
                    if len(RARE.findall(HAN.sub("", after))) * 3 > len(after) * 2 or (len(after) == 1 and RARE.search(HAN.sub("", after))):
                        continue
                    if len(after) == 1 and len(before) == 2 and (name in ("cp437", "koi8-r") or CYRILLIC.match(before) and before[1].isalpha() and before[1] not in "џђѓњќћљјѕ"):
                        continue
                elif "\ufffd" in after or (len(before) < 4 and not (HAN.search(text) and after in _LEVEL)) or (spans is GBK_NAME and not all(map(HAN.match, after))):
                    continue
                out += [text[at : m.start()], after]
                at, worth, covered = m.end(), worth + max(1, _worth(after) + 2 * len(after)), covered + len(before)
            if target == "utf-8" and covered * 5 >= 4 * len(NARROW_HIGH.findall(text)):
                worth += 10_000  # UTF-8 is well-formed by chance far more seldom than GBK
            if worth and (best is None or worth > best[0]):
                best = worth, "".join(out) + text[at:], f"{target} read as {name}"
    return best and best[1:]


def _told(before: str, after: str, whole: bool) -> bool:
    """Whether decoded characters tell that their span was misread; whole: it goes from one edge of a word to another.

    Only characters of three bytes and more tell something: two bytes of well-read text are well-formed too often.
    """
    wide = [c for c in after if c > "\u07ff"]
    rare = sum(RARE.match(c) is not None for c in wide)
    odd = sum(RARE.match(c) is not None for c in before)
    level = sum(c in _LEVEL for c in wide)
    if len(wide) >= 3 and len(wide) * 2 > len(after):
        return rare * 3 <= len(wide) * 2 and (level > 0 or odd > 0)
    return whole and level > 0 and odd > 0 and len(wide) == len(after) > 1


def _gbk_as_big5(text: str) -> tuple[str, str] | None:
    """The text with the span decoded that gains most; both encodings have two bytes a character."""
    out, at, found = [], 0, False
    for m in NOT_ASCII.finditer(text):
        if not HAN.search(m.group()):  # nearly all characters of Big5 are Chinese: a Russian or Greek word is what it is
            continue
        pairs = []
        for c in m.group():
            raw = c.encode("cp950", "ignore")
            d = raw.decode("gbk", "replace") if len(raw) == 2 else "\ufffd"
            good, usual = d in _LEVEL, c in _LEVEL
            pairs.append((d, (0.5 if usual else 2) if good else (-2 if usual else -1)))
        best, span, worth, begin = 0.0, (0, 0), 0.0, 0
        for i, (_, w) in enumerate(pairs):
            if worth <= 0:
                worth, begin = 0.0, i
            worth += w
            if worth > best:
                best, span = worth, (begin, i + 1)
        i, j = span
        if best >= (3 if STRANGE.search(m.group()[i:j]) else 8):
            out += [text[at : m.start() + i], "".join(d for d, _ in pairs[i:j])]
            at, found = m.start() + j, True
    return (DASH_AS_BIG5.sub("—", "".join(out) + text[at:]), "gbk read as cp950") if found else None


def _broad(text: str) -> tuple[str, str] | None:
    """The text with the spans decoded that were read in an encoding of several bytes, and that encoding."""
    best = None
    for codec in BROAD:
        line = text.encode(codec, "replace").decode("latin-1")
        if not RUN.search(line):
            continue
        starts = [i for i, c in enumerate(text) for _ in c.encode(codec, "replace")] + [len(text)]
        out, at, got = [], 0, 0
        for m in RUN.finditer(line):
            after = m.group().encode("latin-1").decode("utf-8")
            first, last = starts[m.start()], starts[m.end() - 1] + 1
            aligned = (m.start() == 0 or starts[m.start() - 1] < first) and starts[m.end()] == last
            whole = aligned and not any(c.isalpha() for c in text[max(0, first - 1) : first] + text[last : last + 1])
            if first < at or not _told(text[first:last], after, whole):
                continue
            out += [text[at:first], after]
            at, got = last, got + sum(c > "\x7f" for c in after)
        if got and (best is None or got > best[0]):
            best = got, "".join(out) + text[at:], f"utf-8 read as {codec}"
    if best is None and INSIDE.search(text):
        now = INSIDE.sub(_latin, text)
        best = (1, now, "utf-8 read as gb18030") if now != text else None
    if best is None and TWO_BYTES.search(text):
        now = TWO_BYTES.sub(_gbk_as_utf8, text)
        best = (1, now, "gbk read as utf-8") if now != text else None
    return (best and best[1:]) or (_gbk_as_big5(text) if STRANGE.search(text) or len(RARE.findall(text)) >= 4 else None)


def _gbk_as_utf8(m: re.Match) -> str:
    """The wide characters whose bytes happened to be well-formed UTF-8 of two bytes each, if they were."""
    if not EXOTIC.search(m.group()) and "\ufffd" not in m.string:
        return m.group()
    try:
        now = m.group().encode("utf-8").decode("gbk")
    except UnicodeError:
        return m.group()
    return now if RARE.search(m.group()) and now[0] in _LEVEL and all(HAN.match(c) or c in _LEVEL for c in now) else m.group()


def _latin(m: re.Match) -> str:
    """The accented letter that a wide character within a Latin word was made of, if it was."""
    try:
        c = m.group().encode("gbk").decode("utf-8")
    except UnicodeError:
        return m.group()
    return c if len(c) == 1 and c.isalpha() and c < "\u0250" else m.group()


def examine(text: str | None, depth: int = 3) -> tuple[bool, str | None, str | None]:
    """Whether a text is garbled, the text restored (None if bytes were lost), and how it was misread."""
    if not text or not HIGH.search(text):
        return False, None, None
    lost = LOST.search(text) is not None
    if not lost and not RARE.search(text) and not SUSPECT.search(text) and not INSIDE.search(text):
        return False, None, None
    now, how = text, None
    for _ in range(depth):
        fixed = (SUSPECT.search(now) and _narrow(now)) or ((RARE.search(now) or INSIDE.search(now)) and _broad(now)) or None
        if not fixed or fixed[0] == now:
            break
        now, how = fixed[0], how or fixed[1]
    if how is None and DASH_AS_BIG5.search(text):  # tells, but not how far the span goes
        return True, None, "gbk read as cp950"
    if how is None:
        return lost, None, "bytes lost" if lost else None
    return True, None if LOST.search(now) else now, how


#: Characters of the usual kind that misread text is made of as well.
SUSPECT = re.compile("[\xb0-\xf7][\xa1-ÿ][\x81-ÿ][\x40-\x7e]|[\u4e00-\u9fff][\xb0-\xf7][\xa1-ÿ]|[\xb0-\xf7][\xa1-ÿ][\u4e00-\u9fff]|[а-п][\x80-¿Ѐ-ЏЁЄЅІЇЈѐ-џґҐ‚-›€№™]{2}|[Â-ßà-ï][\x80-¿‐-⁊€ŒœŠšŸŽžƒˆ˜™]|[\xa1-ÿ]{4}|[РСГДЕВ][\x80-¿А-џ€‚„…†‡‰‹‘’“”•–—™›№ґҐ]|[Ё-п]{2}[\x80-¿Ѐ-Џѐ-џґҐ€‚„…†‡‰‹‘’“”•–—™›№]|[ÃÂ√∂≈Ê-ÔËÈÁÍÎÏÌÓ‰ÂÊ][^\x00-\x7f]")


def is_garbled(text: Column) -> Column:
    """Whether a text is garbled, as a column."""

    @F.arrow_udf(BooleanType())
    def flag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([examine(x)[0] for x in batch.to_pylist()], pa.bool_())

    return flag(text)


def garbled(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(id, field_name, text, restored, misread) of each garbled field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for j, name in enumerate(fields, 1):
                for i, text in enumerate(batch.column(j).to_pylist()):
                    bad, restored, how = examine(text)
                    if bad:
                        rows.append((i, name, text, restored, how))
            at, *columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], ["id", "field_name", "text", "restored", "misread"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *fields).mapInArrow(run, f"id {kind}, field_name string, text string, restored string, misread string")
