"""Byte-level BPE over whole corpora, by a two-tier lookup.

A batch of texts is laid out as one byte array and worked on with array operations:

1. pre-tokens are found from the Unicode classes of neighbouring code points (the public split pattern of this
   vocabulary, see ``PATTERN``), and cut further wherever two neighbouring bytes stand side by side in no token of
   the vocabulary. No merge can ever cross such a place, so the cut changes no id;
2. tier one: a minimal perfect hash maps each piece that is itself a token to its id; the bytes are compared, so
   that a wrong hit is impossible;
3. tier two: each distinct remaining piece is merged once, by a heap of candidate pairs over linked bytes.

Texts are never cut short. Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import heapq

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of text worked on at once; bounds the memory of a worker whatever the number of rows in a batch.
CHUNK_BYTES = 1 << 18
#: Merged pieces remembered by a worker, and the longest of them.
MEMO_PIECES, MEMO_BYTES = 1 << 17, 96

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of the hash base and of its inverse, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 64)
            ones = np.ones(1, np.uint64)
            cls.up = np.concatenate([ones, np.cumprod(np.full(size, _BASE))])
            cls.down = np.concatenate([ones, np.cumprod(np.full(size, _BACK))])
        return cls.up, cls.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each i, whether a[at[i]:][:length[i]] equals b[bt[i]:][:length[i]]."""
    if not len(at):
        return np.zeros(0, bool)
    ends = np.cumsum(length)
    within = np.arange(ends[-1]) - np.repeat(ends - length, length)
    differs = a[np.repeat(at, length) + within] != b[np.repeat(bt, length) + within]
    return np.add.reduceat(differs, ends - length, dtype=np.int64) == 0


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: as many slots as strings, one seed per bucket.

    Buckets are placed from the fullest to the emptiest, each by the first seed that sends its keys to free slots;
    buckets of one key take a remaining slot directly, written as a negative seed.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.data = np.frombuffer(b"".join(keys), np.uint8)
        length = np.array([len(k) for k in keys], np.int64)
        ends = np.cumsum(length)
        hashes = span_hashes(self.data, ends - length, ends)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys have one hash")
        self.seeds = np.zeros(max(1, n // 4), np.int64)
        bucket = (hashes % np.uint64(len(self.seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        slot_of, free = np.empty(n, np.int64), np.ones(n, bool)
        single = []
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                single.append(group[0])
                continue
            tried, width = 0, 16
            while True:  # several seeds at once, a row of slots for each
                seeds = np.arange(tried, tried + width, dtype=np.int64)[:, None]
                rows = self._slots(hashes[group][None, :], seeds, n)
                ranked = np.sort(rows, axis=1)
                fits = np.flatnonzero(free[rows].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
                if len(fits):
                    seed, slots = tried + fits[0], rows[fits[0]]
                    break
                tried, width = tried + width, min(width * 4, 4096)
            slot_of[group], free[slots], self.seeds[bucket[group[0]]] = slots, False, seed
        for key, slot in zip(single, np.flatnonzero(free), strict=True):
            slot_of[key], self.seeds[bucket[key]] = slot, -1 - slot
        self.key = np.empty(n, np.int64)
        self.key[slot_of] = np.arange(n)
        self.start, self.length = (ends - length)[self.key], length[self.key]
        self.hash = hashes[self.key]

    @staticmethod
    def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        return (_mixed(hashes + seeds.astype(np.uint64) * _BASE) % np.uint64(n)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of the key that equals each span, or -1."""
        seeds = self.seeds[(hashes % np.uint64(len(self.seeds))).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, self._slots(hashes, np.maximum(seeds, 0), len(self.key)))
        found = np.flatnonzero((self.hash[slots] == hashes) & (self.length[slots] == ends - starts))
        at = slots[found]
        right = same_bytes(data, starts[found], self.data, self.start[at], self.length[at])
        out = np.full(len(starts), -1, np.int64)
        out[found[right]] = self.key[at[right]]
        return out


class Vocabulary:
    """A byte-level vocabulary read from a file of base64 tokens and their ranks; the rank is the id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]
        self.ids = np.array([rank for _, rank in pairs], np.int32)
        self.ranks = dict(pairs)
        self.width = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.width[self.ids] = [len(token) for token, _ in pairs]
        self.perfect = PerfectHash([token for token, _ in pairs])
        #: Whether two bytes stand side by side in some token; elsewhere no merge can happen.
        self.joined = np.zeros(1 << 16, bool)
        for token, _ in pairs:
            for a, b in zip(token, token[1:], strict=False):
                self.joined[a << 8 | b] = True
        self.classes = _class_runs()
        self._memo: dict[bytes, list[int]] = {}
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """The class of each code point."""
        if self._table is None:
            self._table = np.repeat(self.classes[1], self.classes[0])
        return self._table

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}, "_table": None}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token: the pair of lowest rank is merged first, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))  # the end of the part that begins here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, end = heapq.heappop(heap)
            if not alive[left] or after[left] != right or right >= n or not alive[right] or after[right] != end:
                continue  # one of the two parts has changed since
            alive[right] = False
            after[left] = end
            if end < n:
                before[end] = left
                stop = after[end]
                rank = ranks.get(piece[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end, stop))
            start = before[left]
            if start >= 0:
                rank = ranks.get(piece[start:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, left, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def _merged(self, piece: bytes) -> list[int]:
        if len(piece) > MEMO_BYTES:
            return self.merge(piece)
        known = self._memo.get(piece)
        if known is None:
            if len(self._memo) >= MEMO_PIECES:
                self._memo.clear()
            known = self._memo[piece] = self.merge(piece)
        return known

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> Encoded:
        """Ids of the texts whose UTF-8 bytes stand in data between neighbouring bounds."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point's bytes begin
        text_at = np.searchsorted(first, bounds)
        starts = np.append(first, len(data))[_pretokens(points, self.table, text_at)]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.joined[data[:-1].astype(np.int64) << 8 | data[1:]]
            cut[:-1] &= (data & 0xC0) != 0x80
        cut[starts] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, ends)
        key = self.perfect.find(data, starts, ends, hashes)
        count = np.ones(len(starts), np.int64)
        missed = np.flatnonzero(key < 0)
        parts = np.zeros(0, np.int32)
        if len(missed):
            _, one, group = np.unique(hashes[missed], return_index=True, return_inverse=True)
            length = ends[missed] - starts[missed]
            like = missed[one][group]
            alike = length == ends[like] - starts[like]
            alike[alike] = same_bytes(data, starts[missed[alike]], data, starts[like[alike]], length[alike])
            if not alike.all():  # two different pieces with one hash: each such piece stands for itself
                odd = np.flatnonzero(~alike)
                group[odd] = len(one) + np.arange(len(odd))
                one = np.append(one, odd)
            raw = data.tobytes()
            lists = [self._merged(raw[starts[i] : ends[i]]) for i in missed[one]]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.array([x for ids in lists for x in ids], np.int32)
            offset = np.cumsum(sizes) - sizes
            count[missed] = sizes[group]
            total = np.cumsum(count[missed])
            within = np.arange(total[-1]) - np.repeat(total - count[missed], count[missed])
            parts = flat[np.repeat(offset[group], count[missed]) + within]
        ids = np.empty(int(count.sum()), np.int32)
        before = np.cumsum(count) - count
        hit = np.flatnonzero(key >= 0)
        ids[before[hit]] = self.ids[key[hit]]
        if len(missed):
            here = np.ones(len(ids), bool)
            here[before[hit]] = False
            ids[here] = parts
        return Encoded(data, points, first, text_at, starts, np.append(before, len(ids)), ids, bounds)


class Encoded:
    """The ids of a chunk of texts, and where the pieces of text lie that they were made from."""

    def __init__(self, data, points, first, text_at, starts, before, ids, bounds):
        self.data, self.points, self.first, self.text_at = data, points, first, text_at
        self.starts, self.before, self.ids, self.bounds = starts, before, ids, bounds
        #: Index of the first id of each text, and after the last.
        self.offsets = before[np.searchsorted(starts, bounds)]


def _class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Lengths and classes of the runs of code points of one class."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    change = np.append(np.flatnonzero(np.diff(table)) + 1, len(table))
    return np.diff(np.append(0, change)), table[change - 1]


def _pretokens(points: np.ndarray, table: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Code points at which a pre-token begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[points]
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[text_at] = True
    run = np.flatnonzero(begins[:n])
    stop = np.append(run[1:], n)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[text_at] = True
    space = (kind[run] == SPACE) & ~last_of_text[stop]  # runs of white space before something else
    begins[stop[space] - 1] = True  # the last one stands alone,
    joins = space & (points[stop - 1] == 0x20)
    begins[stop[joins]] = False  # or opens the next pre-token
    joined = np.zeros(n + 1, bool)
    joined[stop[joins]] = True
    quote = run[(kind[run] == OTHER) & (stop - run == 1) & (points[run] == 0x27) & ~joined[run]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~last_of_text[quote + 1]]
    if len(quote):
        next_run = np.append(stop, n)[np.searchsorted(run, quote + 1)]  # end of the letters that follow
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        second = points[np.minimum(quote + 2, n - 1)]
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (points[quote + 1] == ord(a)) & (second == ord(b))
        pair &= quote + 2 < next_run
        size = np.where(one, 1, np.where(pair, 2, 0))
        begins[quote[size > 0] + 1] = False
        begins[(quote + 1 + size)[size > 0]] = True
    return np.flatnonzero(begins[:n])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold about so many bytes: first row, row after the last, bytes, bounds."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, on every executor: some 5 MB, fixed by the file and not by the corpus."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def token_ids(docs: DataFrame, shared: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the ids of each text, in order, without special tokens. Null and empty texts: []."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                e = shared.value.encode(data, bounds)
                ids = pa.ListArray.from_arrays(pa.array(e.offsets, pa.int32()), pa.array(e.ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, shared: Broadcast, text_col: str = "text") -> DataFrame:
    """The columns of docs but text_col, and n_tokens (0 for null and empty texts)."""
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(keep)
            for at, to, data, bounds in chunks(batch.column(text_col)):
                n = np.diff(shared.value.encode(data, bounds).offsets)
                yield pa.RecordBatch.from_arrays([*rest.slice(at, to - at).columns, pa.array(n, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, n_tokens bigint")
