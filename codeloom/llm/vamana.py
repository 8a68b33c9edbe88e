"""A robust-pruned directed graph over one shard of unit vectors, in numpy.

A drawn sample of entry nodes, about ``ENTRIES`` times the root of the shard's size, is linked
first; the others enter in growing batches. For each, a greedy beam search from its nearest
entries proposes neighbours; pruning keeps a near one and drops those that are closer, by the
factor ``alpha``, to one already kept, so edges stay diverse; reverse edges are added and pruned
alike. A search walks the graph with a beam of ``width`` candidates, many queries at a time.

Similarities are computed only to entries and to nodes that a walk meets; ``Graph.evaluations``
counts them (it grows like the power 1.5 of the size, from the entries; the rest is linear).
"""

from __future__ import annotations

import math

import numpy as np

DEGREE, WIDTH, ALPHA, ENTRIES, STARTS = 16, 16, 1.2, 8.0, 8
#: Queries walked at a time, which bounds the gathered vectors (under 20 MB).
BLOCK = 2000


def _ordered(sims: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` greatest of each row, greatest first."""
    if count < sims.shape[1]:
        some = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


class Graph:
    """``vectors`` (unit, float32), ``links`` (neighbours of each, -1: none), ``entries``; ``evaluations`` counts similarities."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None, entries: np.ndarray | None = None, degree: int = DEGREE):
        self.vectors, self.degree, self.evaluations = np.ascontiguousarray(vectors, np.float32), degree, 0
        if links is not None:
            self.links, self.entries = links, entries
            return
        n = len(vectors)
        self.links = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(5).permutation(n).astype(np.int32)
        done = min(n, math.ceil(ENTRIES * math.sqrt(n)) + 1)
        self.entries = order[:done]
        if done > 1:
            sims = self.vectors[self.entries] @ self.vectors[self.entries].T
            self.evaluations += sims.size
            np.fill_diagonal(sims, -3.0)
            near = _ordered(sims, min(WIDTH, done - 1))
            self._link(self.entries, self.entries[near], np.take_along_axis(sims, near, 1))
        while done < n:
            batch = order[done : done + max(64, done)]
            ids, sims = self.search(self.vectors[batch], WIDTH, WIDTH)
            self._link(batch, ids, sims)
            done += len(batch)

    def _similar(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.evaluations += nodes.size
        return np.einsum("qnd,qd->qn", self.vectors[nodes], queries)

    def search(self, queries: np.ndarray, k: int, width: int = WIDTH, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the k best nodes met per query, best first; -1 where fewer were met.

        starts: nodes per query from which to walk besides the nearest entries (-1: none).
        """
        width = max(width, k)
        found = [self._walk(queries[at : at + BLOCK], width, None if starts is None else starts[at : at + BLOCK]) for at in range(0, len(queries), BLOCK)]
        if not found:
            return np.empty((0, k), np.int32), np.empty((0, k), np.float32)
        return np.concatenate([ids[:, :k] for ids, _ in found]), np.concatenate([sims[:, :k] for _, sims in found])

    def _walk(self, queries: np.ndarray, width: int, starts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(queries))
        near = queries @ self.vectors[self.entries].T
        self.evaluations += near.size
        best = _ordered(near, min(STARTS, near.shape[1]))
        nodes, value = self.entries[best], np.take_along_axis(near, best, 1)
        if starts is not None:
            more = self._similar(queries, starts)
            more[(starts < 0) | (starts[:, :, None] == nodes[:, None, :]).any(2)] = -2.0
            nodes, value = np.concatenate([nodes, starts], 1), np.concatenate([value, more], 1)
        ids = np.full((len(queries), width), -1, np.int32)
        sims = np.full((len(queries), width), -2.0, np.float32)
        order = _ordered(value, min(width, value.shape[1]))
        ids[:, : order.shape[1]] = np.take_along_axis(nodes, order, 1)
        sims[:, : order.shape[1]] = np.take_along_axis(value, order, 1)
        open_ = sims > -2.0
        active = rows
        while active.size:
            slot = np.argmax(open_[active], axis=1)  # beams are kept sorted: the first open one is the best
            live = open_[active, slot]
            active, slot = active[live], slot[live]
            if not active.size:
                break
            open_[active, slot] = False
            near = self.links[ids[active, slot]]
            value = self._similar(queries[active], near)
            value[(near < 0) | (value <= sims[active, -1][:, None])] = -2.0
            better = (value > -2.0).any(1)
            at, near, value = active[better], near[better], value[better]
            value[(near[:, :, None] == ids[at][:, None, :]).any(2)] = -2.0
            all_sims = np.concatenate([sims[at], value], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[at] = np.take_along_axis(all_sims, order, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], near], 1), order, 1)
            open_[at] = np.take_along_axis(np.concatenate([open_[at], value > -2.0], 1), order, 1)
        ids[sims <= -2.0] = -1
        return ids, sims

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Diverse neighbours of each node among its candidates (-1: none) with their similarities, nearest first."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for at in range(0, len(nodes), BLOCK):
            some = slice(at, at + BLOCK)
            order = np.argsort(-base[some], axis=1, kind="stable")
            near, sims = np.take_along_axis(candidates[some], order, 1), np.take_along_axis(base[some], order, 1)
            alive = (near >= 0) & (near != nodes[some, None])
            alive[:, 1:] &= near[:, 1:] != near[:, :-1]
            alive &= sims > -2.0
            held = self.vectors[near]
            between = held @ held.transpose(0, 2, 1)
            self.evaluations += between.size // 2
            # alpha * distance to the kept one > distance to the node, in squares of unit vectors
            limit = 1.0 - (1.0 - sims) / (ALPHA * ALPHA)
            rows = np.arange(len(near))
            for k in range(self.degree):
                pick = np.argmax(alive, axis=1)
                has = alive[rows, pick]
                if not has.any():
                    break
                out[at + rows[has], k] = near[rows[has], pick[has]]
                alive &= between[rows, pick] < limit
                alive[rows, pick] = False
        return out

    def _link(self, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        self.links[batch] = self._prune(batch, ids, sims)
        targets = self.links[batch].ravel()
        sources = np.repeat(batch, self.degree)[targets >= 0]
        targets = targets[targets >= 0]
        if not len(targets):
            return
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        heads, first, counts = np.unique(targets, return_index=True, return_counts=True)
        rank = np.arange(len(targets)) - np.repeat(first, counts)
        kept = rank < 2 * self.degree
        extra = np.full((len(heads), min(2 * self.degree, int(counts.max()))), -1, np.int32)
        extra[np.repeat(np.arange(len(heads)), counts)[kept], rank[kept]] = sources[kept]
        merged = np.concatenate([self.links[heads], extra], 1)
        merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
        full = (merged >= 0).sum(1) > self.degree
        if full.any():
            some = merged[full]
            base = self._similar(self.vectors[heads[full]], some)
            base[some < 0] = -2.0
            self.links[heads[full]] = self._prune(heads[full], some, base)
        self.links[heads[~full]] = merged[~full][:, : self.degree]

    def neighbours(self, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the k best others met per node: a last search, from its links, meets nodes of its own batch."""
        ids, sims = self.search(self.vectors, k + 1, width, self.links)
        sims[ids == np.arange(len(ids))[:, None]] = -2.0
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -2.0, ids, -1), sims
