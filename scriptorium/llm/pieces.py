"""Splitting oversized texts at natural boundaries, by pointer doubling.

Every place at which a text may be cut without changing the tokens on either side is a boundary, with the tokens
before it and a level: heading, paragraph, entry, sentence, line end, or none. Each boundary is joined to its
farthest legal successor: the end of the piece that would begin there, and the boundary at which the next piece
would begin, at most ``overlap`` tokens before that end. Squaring the successor table again and again marks all
starts that the greedy cut from the front would visit, in a number of steps that is the logarithm of the number of
pieces; the tables of all texts of a batch are squared together.

Levels: a piece ends at the farthest heading in reach if that fills it at least half, else at the farthest
paragraph that does, and so on down to sentences; else at the farthest of any of these; else at a line end; and
only where a text has none of them at the farthest place at all. The next piece begins at the earliest boundary of
these within the overlap that leads beyond that end, or at the end itself. Null, empty and short texts give no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from scriptorium.llm.bpe import SPACE, Encoded, Vocabulary, chunks

LEVELS = ("any", "line", "sentence", "entry", "paragraph", "heading", "end")
ANY, LINE, SENTENCE, ENTRY, PARAGRAPH, HEADING, END = range(7)
LINE_ENDS = [0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]
WIDE_STOPS, NARROW_STOPS = "。！？；…｡", ".!?;"
CLOSERS = "”’」』）》〉】)]\"'»"
#: What opens an entry of a list, a table or a dialogue, after which no line is a mere wrapped line.
ENTRY_MARKS = "[-*•|>·①②③④⑤⑥⑦⑧⑨⑩（("
#: Pieces this near the limit, or cut inside an unbroken string, are counted again on their own.
NEAR = 8


def _codes(text: str) -> list[int]:
    return [ord(c) for c in text]


def _levels(e: Encoded, table: np.ndarray) -> np.ndarray:
    """The level of each piece start of the chunk, for a cut before it."""
    points, n = e.points, len(e.points)
    start = np.searchsorted(e.first, e.starts)  # as code points
    level = np.zeros(len(start), np.int8)
    if not n:
        return level
    blank = table[points] == SPACE
    index = np.arange(n + 1)
    solid = np.minimum.accumulate(np.where(np.append(blank, False), n, index)[::-1])[::-1]  # the next that isn't blank

    def mark(q: np.ndarray, value: np.ndarray | int) -> None:
        value = np.broadcast_to(value, q.shape)
        inside = q < n
        q, value = q[inside], value[inside]
        at = np.searchsorted(start, q, side="right") - 1
        fits = (start[at] == q) | ((start[at] == q - 1) & (points[np.maximum(q - 1, 0)] == 0x20))
        np.maximum.at(level, at[fits], value[fits].astype(np.int8))

    stop = np.isin(points, _codes(WIDE_STOPS + NARROW_STOPS))
    closer = np.isin(points, _codes(CLOSERS)) & ~stop
    under = np.maximum.accumulate(np.where(closer, -1, index[:n]))  # what the closing marks follow
    ended = (under >= 0) & stop[np.maximum(under, 0)]
    after = np.append(points[1:], 0)
    more = np.append(stop[1:] | closer[1:], False)
    spaced = np.append(blank[1:], True)
    wide = np.isin(points[np.maximum(under, 0)], _codes(WIDE_STOPS))
    mark(solid[np.flatnonzero(ended & ~more & (wide | spaced)) + 1], SENTENCE)

    line_end = np.isin(points, LINE_ENDS)
    last = np.flatnonzero(line_end & ~((points == 0x0D) & (after == 0x0A)))
    q = solid[last + 1]
    keep = q < n
    q = q[keep]
    if len(q):
        q, lines = np.unique(q, return_counts=True)
        c = points[q]
        c1 = points[np.minimum(q + 1, n - 1)]
        digit = (c >= 0x30) & (c <= 0x39)
        numbered = digit & np.isin(points[np.minimum(solid[q + 1], n - 1)], _codes("0123456789.．、)）"))
        article = (c == ord("第")) | (np.isin(c, _codes("问答")) & (c1 == ord("：")))
        value = np.full(len(q), LINE)
        value[np.isin(c, _codes(ENTRY_MARKS)) | numbered | article] = ENTRY
        indented = (q >= 2) & (points[np.maximum(q - 1, 0)] == 0x3000) & (points[np.maximum(q - 2, 0)] == 0x3000)
        value[(lines > 1) | indented] = PARAGRAPH
        value[(c == 0x23) & np.isin(c1, [0x23, 0x20])] = HEADING
        mark(q, value)
    return level


class _Boundaries:
    """All boundaries of a chunk, in order: byte, tokens before, level, text, and whether tokens may differ."""

    def __init__(self, e: Encoded, v: Vocabulary):
        byte, cost, level = e.starts, e.before[:-1], _levels(e, v.table)
        exact = np.ones(len(byte), bool)
        long = np.flatnonzero(np.diff(e.before) > 32)  # unbroken strings: they may be cut between their tokens
        if len(long):
            extra_byte, extra_cost = [], []
            for i in long:
                at = e.starts[i] + np.cumsum(v.width[e.ids[e.before[i] : e.before[i + 1]]])[:-1]
                ok = (e.data[at] & 0xC0) != 0x80
                extra_byte.append(at[ok])
                extra_cost.append((e.before[i] + np.arange(1, len(at) + 1))[ok])
            more = np.concatenate(extra_byte)
            byte, cost = np.append(byte, more), np.append(cost, np.concatenate(extra_cost))
            level, exact = np.append(level, np.zeros(len(more), np.int8)), np.append(exact, np.zeros(len(more), bool))
            order = np.argsort(byte, kind="stable")
            byte, cost, level, exact = byte[order], cost[order], level[order], exact[order]
        self.byte, self.cost = np.append(byte, len(e.data)), np.append(cost, len(e.ids))
        self.level, self.exact = np.append(level, END), np.append(exact, True)
        #: The boundary at which each text begins; each end of a text is a boundary of the highest level.
        self.of_text = np.searchsorted(self.byte, e.bounds)
        self.level[self.of_text[1:]] = END


def _cut(b: _Boundaries, big: np.ndarray, limit: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts numbered big, of limit tokens each: text, first and last boundary."""
    first, stop = b.of_text[big], b.of_text[big + 1]
    size = stop - first
    begin = np.cumsum(size) - size
    nodes = np.repeat(first - begin, size) + np.arange(size.sum())  # every boundary at which a piece could begin
    text_end, most = np.repeat(stop, size), np.repeat(limit, size)
    reach = b.cost[nodes] + most
    end = np.full(len(nodes), -1)
    whole = b.cost[text_end] <= reach
    end[whole] = text_end[whole]

    def farthest(level: int, where: np.ndarray, least: np.ndarray) -> None:
        at = np.flatnonzero(b.level >= level)
        found = at[np.maximum(np.searchsorted(b.cost[at], reach[where], side="right") - 1, 0)]
        ok = (b.cost[found] <= reach[where]) & (b.cost[found] - b.cost[nodes[where]] >= least) & (found > nodes[where])
        end[where[ok]] = found[ok]

    for level in (HEADING, PARAGRAPH, ENTRY, SENTENCE):
        where = np.flatnonzero(end < 0)
        farthest(level, where, most[where] // 2)
    for level in (SENTENCE, LINE, ANY):
        where = np.flatnonzero(end < 0)
        farthest(level, where, np.ones(len(where), np.int64))
    if (end < 0).any():
        raise ValueError("a single character has more tokens than a piece may have")
    follow = end.copy()
    for natural in (True, False):
        where = np.flatnonzero((end < text_end) & ((b.level[end] >= LINE) == natural))
        at = np.flatnonzero(b.level >= (LINE if natural else ANY))
        low = np.maximum(b.cost[end[where]] - overlap, b.cost[nodes[where]] + 1)
        follow[where] = np.minimum(at[np.searchsorted(b.cost[at], low)], end[where])
    # A piece that would end where the one before it ends adds nothing: the next one begins at that end.
    shift = np.repeat(first - begin, size)
    where = np.flatnonzero(end < text_end)
    stuck = where[end[follow[where] - shift[where]] <= end[where]]
    follow[stuck] = end[stuck]
    # Successors as places in nodes; the last piece of a text leads to itself.
    done = end == text_end
    jump = np.where(done, np.arange(len(nodes)), follow - shift)
    marked = np.zeros(len(nodes), bool)
    marked[begin] = True
    while True:
        marked[jump[marked]] = True
        twice = jump[jump]
        if (twice == jump).all():
            break
        jump = twice
    taken = np.flatnonzero(marked)
    return np.repeat(big, size)[taken], nodes[taken], end[taken]


def split_chunk(v: Vocabulary, e: Encoded, limit: int, overlap: int) -> list[np.ndarray]:
    """Text, number, first and last byte, tokens and level of the end, of each piece of texts above the limit."""
    big = np.flatnonzero(np.diff(e.offsets) > limit)
    if not len(big):
        return [np.zeros(0, np.int64)] * 6
    b = _Boundaries(e, v)
    allowed = np.full(len(big), limit)
    while True:
        text, first, last = _cut(b, big, allowed, overlap)
        tokens = b.cost[last] - b.cost[first]
        check = np.flatnonzero((tokens > limit - NEAR) | ~b.exact[first] | ~b.exact[last])
        if not len(check):
            break
        spans = [e.data[b.byte[first[i]] : b.byte[last[i]]] for i in check]
        counted = np.diff(v.encode(np.concatenate(spans), np.append(0, np.cumsum([len(s) for s in spans]))).offsets)
        over = np.unique(text[check[counted > limit]])
        if not len(over):
            break
        allowed[np.searchsorted(big, over)] -= NEAR  # these texts are cut again, a little shorter
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return [text, number, b.byte[first], b.byte[last], tokens, b.level[last]]


def pieces(docs: DataFrame, shared: Broadcast, limit: int = 2048, overlap: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, first_char, end_char, n_tokens, cut, text) of each text of more than limit tokens.

    Pieces are numbered from 0 and cover the text without a gap; first_char and end_char count code points from 0;
    n_tokens counts the tokens of the whole text that fall into the piece; cut names the level of its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                e = v.encode(data, bounds)
                text, number, a, z, tokens, level = split_chunk(v, e, limit, overlap)
                if not len(text):
                    continue
                raw = data.tobytes()
                base = e.text_at[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(text)),
                        pa.array(number, pa.int32()),
                        pa.array(np.searchsorted(e.first, a) - base, pa.int64()),
                        pa.array(np.searchsorted(e.first, z) - base, pa.int64()),
                        pa.array(tokens, pa.int32()),
                        pa.array([LEVELS[x] for x in level], pa.string()),
                        pa.array([raw[i:j].decode("utf-8") for i, j in zip(a, z, strict=True)], pa.string()),
                    ],
                    [id_col, "piece", "first_char", "end_char", "n_tokens", "cut", "text"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, first_char bigint, end_char bigint, n_tokens int, cut string, text string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def split_ids(docs: DataFrame, shared: Broadcast, limit: int = 2048, overlap: int = 128, id_col: str = "doc_id") -> DataFrame:
    """(id_col) of each text that was cut: one row for its first piece."""
    return pieces(docs, shared, limit, overlap, id_col).where("piece = 0").select(id_col)
