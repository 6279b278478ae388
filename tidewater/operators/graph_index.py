"""A hierarchical navigable small-world graph over unit vectors in numpy, searched for many queries at once."""

from __future__ import annotations

import math

import numpy as np

M, WIDTH_BUILD, STEP, WHOLE = 16, 64, 192, 64
#: While a graph has no more nodes, comparing a new node with all of them takes less time than a walk.
COMPARED = 1 << 15


def _spread(keys: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integer keys, from which levels are drawn."""
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Graph:
    """Nodes are in order of falling level, so that layer k is made of the first size[k] of them."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        draw = (_spread(keys) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-300)) / math.log(M)).astype(np.int64), 12)
        self.order = np.lexsort((keys, -level))
        self.x, self.level = np.ascontiguousarray(x[self.order]), level[self.order]
        self.size = [int((self.level >= k).sum()) for k in range(int(self.level[0]) + 1)]
        self.most = [2 * M if k == 0 else M for k in range(len(self.size))]
        self.near = [np.full((n, m + M), -1, np.int32) for n, m in zip(self.size, self.most)]
        self.count = [np.zeros(n, np.int32) for n in self.size]
        at = 1
        while at < len(self.x):
            to = min(len(self.x), at + max(1, min(256, at)))
            self._insert(at, to)
            at = to

    @classmethod
    def restored(cls, x: np.ndarray, level: np.ndarray, near: list[bytes]) -> Graph:
        """A graph from its vectors in node order, levels and neighbour lists, for searching only."""
        g = cls.__new__(cls)
        g.x, g.level = x, level
        g.size = [int((level >= k).sum()) for k in range(len(near))]
        g.near = [np.frombuffer(a, np.int32).reshape(n, -1) for a, n in zip(near, g.size)]
        return g

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the `width` best nodes below `limit` that each query's walk meets."""
        near, n = self.near[layer], len(q)
        ids, score = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
        done, seen = np.zeros((n, width), dtype=bool), np.zeros((n, limit), dtype=bool)
        ids[:, 0], score[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start])
        seen[np.arange(n), start] = True
        met = np.empty((n, limit), np.int32)  # where a node was met last, to drop what is met twice in a step
        live, steps = np.arange(n), max(1, width // 16)  # so many nodes of each beam are followed at once
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -np.inf, score[live])
            j = np.argpartition(-open_, steps - 1, axis=1)[:, :steps] if steps < width else np.broadcast_to(np.arange(width), open_.shape)
            good = np.take_along_axis(open_, j, axis=1) > -np.inf
            go = good.any(axis=1)
            live, j, good = live[go], j[go], good[go]
            if not len(live):
                break
            done[live[:, None], j] |= good
            nb = np.where(good[:, :, None], near[np.maximum(ids[live[:, None], j], 0)], -1).reshape(len(live), -1).astype(np.int64)
            new = (nb >= 0) & (nb < limit)
            nb = np.where(new, nb, 0)
            new &= ~seen[live[:, None], nb]
            rows, cols = np.nonzero(new)
            at, number = (live[rows], nb[rows, cols]), np.arange(len(rows), dtype=np.int32)
            met[at] = number
            once = met[at] == number
            rows, cols = rows[once], cols[once]
            seen[live[rows], nb[rows, cols]] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            s[rows, cols] = np.einsum("nd,nd->n", q[live[rows]], self.x[nb[rows, cols]])
            new = s > -np.inf
            all_s = np.concatenate([score[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(new, nb, -1)], axis=1)
            all_d = np.concatenate([done[live], np.zeros(nb.shape, dtype=bool)], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            score[live], ids[live], done[live] = (np.take_along_axis(x, top, axis=1) for x in (all_s, all_i, all_d))
        return ids, score

    def nearest(self, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the k best nodes that a walk of the given width finds, best first."""
        width = max(k, width)
        ids, score = self.beam(q, self._enter(q, 0, len(self.x)), 0, width, len(self.x))
        by = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, by, axis=1), np.take_along_axis(score, by, axis=1)

    def _enter(self, q: np.ndarray, layer: int, limit: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for k in range(len(self.size) - 1, layer, -1):
            ids, score = self.beam(q, at, k, 1, min(limit, self.size[k]))
            at = ids[:, 0]
        return at

    def _compared(self, q: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the WIDTH_BUILD nearest of the first `limit` nodes, all of them compared."""
        s = q @ self.x[:limit].T
        blocks = limit // 32
        if blocks <= WIDTH_BUILD:
            ids, score = np.broadcast_to(np.arange(limit), s.shape), s
        else:  # so many blocks have a node of this score or more, so the nearest have it too
            best = s[:, : blocks * 32].reshape(len(q), blocks, 32).max(axis=2)
            r, c = np.nonzero(s >= np.partition(best, blocks - WIDTH_BUILD, axis=1)[:, blocks - WIDTH_BUILD, None])
            n = np.bincount(r, minlength=len(q))
            at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            ids, score = np.full((len(q), n.max()), -1, np.int64), np.full((len(q), n.max()), -np.inf, np.float32)
            ids[r, at], score[r, at] = c, s[r, c]
        if ids.shape[1] <= WIDTH_BUILD:
            return ids, score
        top = np.argpartition(-score, WIDTH_BUILD - 1, axis=1)[:, :WIDTH_BUILD]
        return np.take_along_axis(ids, top, axis=1), np.take_along_axis(score, top, axis=1)

    def _select(self, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """The heuristic: take a candidate only if it is nearer to the base than to all taken; then fill up."""
        by = np.argsort(-score, kind="stable")
        score, ids = score[by], ids[by]
        if len(ids) <= most:
            return ids
        x = self.x[ids]
        g = x @ x.T
        worst = np.full(len(ids), -np.inf, np.float32)
        taken = []
        for i in range(len(ids)):
            if worst[i] < score[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                np.maximum(worst, g[i], out=worst)
        if len(taken) < most:
            rest = np.ones(len(ids), dtype=bool)
            rest[taken] = False
            taken += np.flatnonzero(rest)[: most - len(taken)].tolist()
        return ids[taken]

    def _insert(self, at: int, to: int) -> None:
        q = self.x[at:to]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        start = np.zeros(len(q), np.int64)
        for k in range(len(self.size) - 1, -1, -1):
            limit = min(at, self.size[k])
            mine = int((self.level[at:to] >= k).sum())
            if at > COMPARED and mine < len(q):
                ids, _ = self.beam(q[mine:], start[mine:], k, 1, limit)
                start[mine:] = ids[:, 0]
            if not mine:
                continue
            if at > COMPARED:
                ids, score = self.beam(q[:mine], start[:mine], k, WIDTH_BUILD, limit)
                start[:mine] = ids[np.arange(mine), score.argmax(axis=1)]
            else:
                ids, score = self._compared(q[:mine], limit)
            for i in range(mine):
                some = ids[i] >= 0
                peers = np.argsort(-inner[i, :mine])[:M] if mine > 1 else np.empty(0, np.int64)
                peers = peers[inner[i, peers] > -np.inf]
                near = self._select(np.concatenate([score[i][some], inner[i, peers]]), np.concatenate([ids[i][some], peers + at]), M)
                self._join(k, at + i, near)
                n = self.count[k][near]
                free = (near < at) & (n < self.near[k].shape[1])  # of another batch, so the link is new, and there is room
                self.near[k][near[free], n[free]] = at + i
                self.count[k][near[free]] += 1
                for p in near[~free]:
                    self._join(k, int(p), np.array([at + i]))

    def _join(self, k: int, node: int, more: np.ndarray) -> None:
        n = self.count[k][node]
        have = self.near[k][node, :n]
        more = more[~np.isin(more, have)] if len(more) > 1 else more[[more[0] not in have]] if len(more) else more
        if n + len(more) > self.near[k].shape[1]:
            every = np.concatenate([have, more]).astype(np.int64)
            every = self._select(self.x[every] @ self.x[node], every, self.most[k])
            self.near[k][node] = -1
            n, more = 0, every
        self.near[k][node, n : n + len(more)] = more
        self.count[k][node] = n + len(more)

    def search(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of a score of `least` or more.

        A walk whose beam holds nothing else is repeated with one four times as wide; where that would
        meet about as many nodes as there are, the query is compared with all of them instead.
        """
        n = len(self.x)
        found, todo, walked = [], np.arange(len(q)), False
        while len(todo):
            width = min(width, n)
            again = []
            whole = walked and width * WHOLE >= n
            step = max(1, min(STEP, (1 << 26) // max(1, n)))
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                if whole:
                    rows, cols = np.nonzero(q[part] @ self.x.T >= least)
                    found.append((part[rows], cols))
                    continue
                ids, score = self.beam(q[part], self._enter(q[part], 0, n), 0, width, n)
                full = (score >= least).all(axis=1) & (width < n)
                again.append(part[full])
                rows, cols = np.nonzero((score >= least) & (ids >= 0) & ~full[:, None])
                found.append((part[rows], ids[rows, cols]))
            todo, width, walked = np.concatenate(again) if again else todo[:0], width * 4, True
        return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
