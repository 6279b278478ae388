"""Best-fit packing of tokenised documents into sequences by the linear grouping scheme.

Tokenising runs once over whole texts, in Arrow batches. Only a histogram of piece lengths (at most
`capacity` counts, however many documents there are) reaches the driver. There the lengths above
`small` are cut into groups of equal cardinality, each rounded up to its longest; the few-size
problem is solved over configurations (a linear programme by column generation, rounded down); the
actual lengths take the rounded places; all that is left, small ones last, is placed by best fit in
decreasing order. The plan counts how often each configuration of actual lengths occurs, and hands
out ranges of ranks within each length, which the pieces look up by a join.

Defined results: a null or empty text is the end token alone; repeated rows are packed each for
itself; an empty table gives an empty result; other columns are ignored; ties go by rank within a
length, in the order of the written pieces. Texts of any length are cut into `capacity`-token pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.hashing import words
from tidewater.session import Scratch, kept

CAPACITY, SMALL, GROUPS = 2048, 200, 60
#: Words that a Python worker remembers, parts of words besides, and bytes of text that it takes at a time.
MOST_CACHED, CELL_BITS, MOST_PARTS, BATCH_BYTES = 1 << 19, 21, 1 << 15, 1 << 19


class WordTokenizer:
    """Ids of texts by a tokenizer whose words never cross white space, computed once per distinct word.

    The tokenizer's own model makes all ids. A word of letters up to U+024F is normalised and split
    here by the tokenizer's declared rules; any other goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        self.bytes = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(odd)}}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.part: dict[str, list[int]] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count, self.n = np.zeros(MOST_CACHED + 1, np.int64), np.zeros(MOST_CACHED + 1, np.int64), 0
        self.keys, self.slots = np.zeros(1 << CELL_BITS, np.uint64), np.zeros(1 << CELL_BITS, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of word hashes, -1 where unknown: two cells are probed."""
        out = np.full(len(hashes), -1, np.int64)
        for shift in (0, CELL_BITS):
            cell = (hashes >> np.uint64(shift)) & np.uint64((1 << CELL_BITS) - 1)
            cell = cell.astype(np.int64)
            out = np.where((self.keys[cell] == hashes) & (hashes != 0), self.slots[cell], out)
        return out

    def _word(self, word: str) -> list[int]:
        if any(c > "ɏ" or c in "\x1c\x1d\x1e\x1f\x85\xa0" for c in word):
            return self.whole.encode(word, add_special_tokens=False).ids
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
        out: list[int] = []
        for x in [low] if low.isascii() and low.isalpha() else self.split(low):
            ids = self.part.get(x)
            if ids is None:
                mapped = x if x.isascii() and x.isprintable() else "".join(self.bytes[b] for b in x.encode())
                if len(self.part) >= MOST_PARTS:
                    self.part.clear()
                ids = self.part[x] = [t.id for t in self.model.tokenize(mapped)]
            out += ids
        return out

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Remember words in either of their cells (a third word of a cell replaces the second's entry); their slots."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.used + int(n.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        got = np.fromiter((x for one in ids for x in one), np.uint32, int(n.sum()))
        self.flat[self.used : self.used + len(got)] = got
        slots = np.arange(self.n, self.n + len(ids))
        self.first[slots], self.count[slots] = self.used + np.cumsum(n) - n, n
        self.used, self.n = self.used + len(got), self.n + len(ids)
        low, high = ((hashes >> np.uint64(shift)).astype(np.int64) & ((1 << CELL_BITS) - 1) for shift in (0, CELL_BITS))
        free = self.keys[low] == 0
        cell = np.where(free, low, high)
        self.keys[cell], self.slots[cell] = hashes, slots
        return slots

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        parts = []
        for i, raw in enumerate(texts):
            if b"<|" in raw and any(s in raw.decode().lower() for s in self.special):
                out[i] = np.array(self.whole.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
            else:
                parts.append((i, *words(raw)))
        if parts:
            hashes = np.concatenate([h for *_, h in parts])
            mine = self._find(hashes)
            missing = np.flatnonzero(mine < 0)
            if len(missing):
                new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
                if self.n + len(new) > MOST_CACHED:
                    if len(new) > MOST_CACHED:
                        half = len(texts) // 2
                        return self.encode(texts[:half]) + self.encode(texts[half:]) if half else [np.array(self.whole.encode(texts[0].decode(), add_special_tokens=False).ids, np.uint32)]
                    self._reset()
                    return self.encode(texts)
                ends = np.cumsum([len(h) for *_, h in parts])
                at = missing[at]
                doc = np.searchsorted(ends, at, "right")
                starts, stops = (np.concatenate([x[c] for x in parts])[at].tolist() for c in (1, 2))
                ids = [self._word(texts[parts[d][0]][a:b].decode()) for d, a, b in zip(doc.tolist(), starts, stops)]
                mine[missing] = self._add(new, ids)[back]
            n = self.count[mine]
            stop = np.cumsum(n)
            ids = self.flat[np.repeat(self.first[mine] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
            bound = np.concatenate(([0], stop))[np.cumsum([0, *(len(h) for *_, h in parts)])]
            for (i, *_), a, b in zip(parts, bound[:-1], bound[1:]):
                out[i] = ids[a:b]
        return out  # type: ignore[return-value]


def tokenizer(path: str) -> WordTokenizer:
    return kept(f"tokenizer {path}", lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc, task, k, ids): pieces of all documents; k ranks a task's pieces of one length."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, task, rank = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in it:
            size = np.cumsum([len(x.as_py() or "") for x in batch.column(1)]) if batch.num_rows else np.zeros(0)
            at = 0
            while at < batch.num_rows:
                base = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, base + BATCH_BYTES, "right")))
                rows = defaultdict(list)
                part = batch.slice(at, to - at)
                at = to
                for key, ids in zip(part.column(0).to_pylist(), tok.encode([(x.as_py() or "").encode() for x in part.column(1)])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for i in range(0, len(ids), capacity):
                        one = ids[i : i + capacity]
                        raw = one.tobytes()
                        for name, x in (("id", key), ("piece", i // capacity), ("start", i), ("length", len(one)), ("crc", zlib.crc32(raw)), ("task", task), ("k", int(rank[len(one)])), ("ids", raw if with_ids else None)):
                            rows[name].append(x)
                        rank[len(one)] += 1
                types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(rows.values(), types)], list(rows))

    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return each.mapInArrow(cut, f"id {dict(each.dtypes)['id']}, piece int, start long, length long, crc long, task int, k long, ids binary")


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 500) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear programme takes each: column generation with a knapsack by layers."""
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(np.maximum(1, capacity // s)).astype(float)
    index = np.arange(capacity + 1)[None, :] - s[:, None]
    valid = index >= 0
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        x, y = inverse @ d, inverse.sum(axis=0)
        best, chosen = np.zeros(capacity + 1), []
        for _ in range(capacity // int(s.min())):
            with_one = np.where(valid, best[np.maximum(index, 0)] + y[:, None], -1.0)
            g = with_one.argmax(axis=0)
            top = with_one[g, np.arange(capacity + 1)]
            better = top > best + 1e-12
            chosen.append(np.where(better, g, -1))
            best = np.where(better, top, best)
            if not better.any():
                break
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(len(s)), capacity
        for g in reversed(chosen):
            if g[c] >= 0:
                column[g[c]] += 1
                c -= s[g[c]]
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    x = np.linalg.solve(basis, d)
    return [(basis[:, j].astype(int), float(max(0.0, x[j]))) for j in range(len(s))]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, count, first sequence, offset) ranges and the number of sequences."""
    types: list[tuple[tuple[int, ...], int]] = []
    left = {n: c for n, c in histogram.items() if c}
    if left.get(capacity):
        types.append(((capacity,), left.pop(capacity)))
    large = sorted((n for n in left if n > small), reverse=True)
    card = max(1, -(-sum(left[n] for n in large) // groups))
    pools: dict[int, list[list[int]]] = {}
    room, top = 0, 0
    for n in large:
        c = left[n]
        while c:
            if not room:
                top, room = n, card
            take = min(room, c)
            pools.setdefault(top, []).append([n, take])
            room, c = room - take, c - take
    tops = list(pools)

    def draw(top: int, count: int) -> list[list[int]]:
        got = []
        while count and pools[top]:
            n, c = pools[top][0]
            take = min(c, count)
            got.append([n, take])
            count -= take
            left[n] -= take
            if take == c:
                pools[top].pop(0)
            else:
                pools[top][0][1] -= take
        return got + ([[0, count]] if count else [])

    open_by: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for column, times in configurations(tops, [sum(c for _, c in pools[t]) for t in tops], capacity) if tops else []:
        times = int(times + 1e-9)
        if not times:
            continue
        slots = [draw(tops[g], times) for g in np.flatnonzero(column) for _ in range(column[g])]
        while times:
            run = min(x[0][1] for x in slots)
            lengths = tuple(x[0][0] for x in slots if x[0][0])
            if lengths:
                open_by[capacity - sum(lengths)].append((lengths, run))
            times -= run
            for x in slots:
                x[0][1] -= run
                if not x[0][1]:
                    x.pop(0)
    residuals = np.zeros(capacity + 1, dtype=bool)
    residuals[[r for r in open_by if open_by[r]]] = True
    for n in sorted((n for n in left if left[n]), reverse=True):
        c = left[n]
        while c:
            fit = np.flatnonzero(residuals[n:])
            if not len(fit):
                each = capacity // n
                for k, times in ((each, c // each), (c % each, 1)):
                    if k and times:
                        open_by[capacity - k * n].append(((n,) * k, times))
                        residuals[capacity - k * n] = True
                break
            r = n + int(fit[0])
            lengths, times = open_by[r].pop()
            take = min(times, c)
            c -= take
            if times > take:
                open_by[r].append((lengths, times - take))
            residuals[r] = bool(open_by[r])
            open_by[r - n].append(((*lengths, n), take))
            residuals[r - n] = True
    types += [x for xs in open_by.values() for x in xs]
    rank: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for lengths, times in types:
        offset = 0
        for n in lengths:
            out.append((n, rank[n], times, base, offset))
            rank[n] += times
            offset += n
        base += times
    return out, base


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, crc, sequence, offset (and its ids, if asked for)."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, path, id_col, text_col, capacity, with_ids=with_ids), "pieces")
    tally = scratch.keep(cut.groupBy("task", "length").agg((F.max("k") + 1).alias("n")), "tally")
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("task", "length", "before")
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges, _ = plan(histogram, capacity)
    rows = np.array(ranges or [(0, 0, 0, 0, 0)], np.int64)  # as Arrow: rows of Python objects would start Python workers of another kind on the executors
    spans = docs.sparkSession.createDataFrame(pa.table(list(rows.T), ["length", "first", "times", "base", "offset"]))
    by_length = spans.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "times", "base", "offset"))).alias("spans"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("k"))
    hit = F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["times"]))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("at", hit)
    return placed.select("id", "piece", "start", "length", "crc", (F.col("at.base") + F.col("rank") - F.col("at.first")).alias("sequence"), F.col("at.offset").alias("offset"), *(["ids"] if with_ids else []))
