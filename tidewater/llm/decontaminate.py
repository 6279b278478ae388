"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are compared on plain words (runs of ASCII letters, digits and
characters beyond ASCII, A-Z lower-cased). Runs of LEAST words of the items are the seeds; a document
that has a seed is tiled against the items that share it: again and again the longest match of
unmarked words is marked, in both texts, until none of LEAST words is left. Runs of one length are
compared by their Karp-Rabin hashes. The share of an item's words that tiles cover finds passages even
where their parts were moved.

Items come to the tasks in blocks of at most BLOCK_WORDS words; every block meets all documents.

Defined results: null and empty texts, and items of fewer than LEAST words, match nothing; repeated
documents and items, also under one id, are each reported; empty tables give an empty result; other
columns are ignored or, by drop_matches, carried along; ties between matches go to the one that starts
first in the item, then in the document. Documents are read whole. Words of equal 64-bit hashes are
taken for equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.hashing import PLAIN, powers, shingles, words

LEAST, LEAST_COVERAGE, BLOCK_WORDS, SIEVE = 5, 0.5, 2_000_000, 1 << 22


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words, from running sums modulo 2**64."""
    k = len(hashes) - n + 1
    power, inverse = powers(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return (total[n:] - total[:k]) * inverse[:k]


def _near_seeds(item: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's words that lie in a window of the item, and which of them follows the one before."""
    seeds = np.sort(shingles(item, least))
    s = shingles(text, least)
    hit = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)] == s)
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, hit, 1)
    np.add.at(inside, hit + least, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return at, np.diff(at, prepend=-2) == 1


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the tiles of two arrays of word hashes.

    Only the stretches of the text that hold a seed are looked at. The length of the longest match of
    unmarked words is found by halving, since a match of n words holds one of n - 1; all matches of
    that length are marked in order. Memory is a few numbers for each word, however often words repeat.
    """
    if min(len(item), len(text)) < least:
        return []
    where, follows = _near_seeds(item, text, least)
    if not len(where):
        return []
    # Stretches stand in one array with a marked place between them, so that no match runs over their ends.
    slot = np.arange(len(where)) + np.cumsum(~follows) - 1
    near, place = np.zeros(slot[-1] + 1, np.uint64), np.zeros(slot[-1] + 1, np.int64)
    near[slot], place[slot] = text[where], where
    marked = [np.zeros(len(item), bool), np.ones(len(near), bool)]
    marked[1][slot] = False
    sides = (item, near)

    def free(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes of each side's unmarked runs of n words."""
        out = []
        for x, m in zip(sides, marked):
            total = np.concatenate(([0], np.cumsum(m)))
            at = np.flatnonzero(total[n:] == total[: len(total) - n])
            out.append((at, _windows(x, n)[at]))
        return out

    def common(n: int) -> bool:
        if n > min(map(len, sides)):
            return False
        (_, a), (_, b) = free(n)
        a = np.sort(a)
        return bool(len(a) and len(b) and (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).any())

    out, most = [], min(len(item), len(near))
    while common(least):
        low, high = least, most + 1  # low has a match, high has none
        step = low
        while low + step < high:  # short matches are the rule: double the length first
            if common(low + step):
                low, step = low + step, step * 2
            else:
                high = low + step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if common(mid) else (low, mid)
        (pa_, a), (pt, b) = free(low)
        by = np.argsort(b, kind="stable")
        first = np.searchsorted(b[by], a, "left")
        upto = np.searchsorted(b[by], a, "right")
        next_: dict[int, int] = {}
        for k in np.flatnonzero(first < upto):
            i = int(pa_[k])
            if marked[0][i : i + low].any():
                continue
            at = next_.get(int(first[k]), int(first[k]))
            while at < upto[k]:
                j = int(pt[by[at]])
                if not marked[1][j : j + low].any() and (item[i : i + low] == near[j : j + low]).all():
                    marked[0][i : i + low] = marked[1][j : j + low] = True
                    out.append((i, int(place[j]), low))
                    at += 1
                    break
                at += 1
            next_[int(first[k])] = at
        most = low
    return out


def _finder(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, least: int, least_coverage: float) -> Iterator[Callable[[str | None], list[tuple]]]:
    """For each block of items a function of a text: (item, tiles, covered words, coverage) of the items it holds."""
    plain = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (2 * BLOCK_WORDS)))  # a word and its gap are two characters at least
    for k in range(blocks):
        rows = plain.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        names, tokens = [r["item"] for r in rows], [words(r["text"].encode(), PLAIN)[2] for r in rows]
        seeds = [shingles(x, least) if len(x) >= least else x[:0] for x in tokens]
        flat = np.concatenate([*seeds, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        order = np.argsort(flat, kind="stable")
        shared = docs.sparkSession.sparkContext.broadcast((names, tokens, flat[order], owner[order]))  # a block
        sieve: list[np.ndarray] = []

        def find(x: str | None, shared=shared, sieve=sieve) -> list[tuple]:
            names, tokens, flat, owner = shared.value
            if not sieve:
                sieve.append(np.zeros(SIEVE, dtype=bool))
                sieve[0][(flat & np.uint64(SIEVE - 1)).astype(np.int64)] = True
            w = words(x.encode(), PLAIN)[2] if x else ()
            if len(w) < least:
                return []
            s = shingles(w, least)
            s = np.unique(s[sieve[0][(s & np.uint64(SIEVE - 1)).astype(np.int64)]])
            low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = (high - low)[low < high]
            if not len(n):
                return []
            at = np.repeat(low[low < high], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = []
            for o in np.unique(owner[at]):
                tiles = tile(tokens[o], w, least)
                covered = sum(t[2] for t in tiles)
                if covered >= least_coverage * len(tokens[o]):
                    found.append((names[o], len(tiles), covered, covered / len(tokens[o])))
            return found

        yield find


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """(id, item, n_tiles, covered, coverage) of the pairs that reach the coverage."""
    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item = items.select(F.col(item_col).alias("item"))
    schema = f"id {dict(each.dtypes)['id']}, item {dict(item.dtypes)['item']}, n_tiles int, covered int, coverage double"
    item_type = item.limit(0).toArrow().schema.field(0).type
    out = None
    for find in _finder(docs, items, item_col, item_text_col, least, least_coverage):

        def search(it: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in it:
                found = [(i, *one) for i, x in zip(*batch.columns) for one in find(x.as_py())]
                types = (batch.schema.field(0).type, item_type, pa.int32(), pa.int32(), pa.float64())
                found = [(x[0].as_py(), *x[1:]) for x in found]
                yield pa.record_batch([pa.array([x[c] for x in found], t) for c, t in enumerate(types)], ["id", "item", "n_tiles", "covered", "coverage"])

        one = each.mapInArrow(search, schema)
        out = one if out is None else out.union(one)
    return out


def drop_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; each row is judged by its own text."""
    at = docs.columns.index(text_col)
    for find in _finder(docs, items, item_col, item_text_col, least, least_coverage):

        def keep(it: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in it:
                yield batch.filter(pa.array([not find(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
