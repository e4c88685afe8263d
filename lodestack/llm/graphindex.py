"""Hierarchical navigable small-world graphs in flat arrays, built and searched in numpy blocks.

No Spark here: one :class:`Graph` is what one shard of vectors becomes inside a Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Layer:
    """Nodes of one level; ``links[i]`` holds positions in the bottom level, padded with -1."""

    nodes: np.ndarray
    links: np.ndarray


@dataclass
class Graph:
    vectors: np.ndarray
    layers: list[Layer]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, largest first, ties by column."""
    if scores.shape[1] > k:
        part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        part.sort(axis=1)
    else:
        part = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def _diverse(vectors: np.ndarray, near: np.ndarray, near_scores: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates those closer to the row than to any kept one, then the closest of the rest."""
    picked = vectors[near]
    between = picked @ picked.transpose(0, 2, 1)
    n, width = near.shape
    kept = np.zeros((n, width), bool)
    closest = np.full((n, width), -2.0, np.float32)
    for j in range(width):
        good = (near_scores[:, j] > closest[:, j]) & (kept.sum(1) < degree)
        kept[:, j] = good
        closest = np.where(good[:, None], np.maximum(closest, between[:, j]), closest)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(near, order, 1)


def _level(vectors: np.ndarray, nodes: np.ndarray, degree: int, reach: int, block: int) -> Layer:
    """Links of one level: diverse near nodes of each node, and the links back to it, best first."""
    own = vectors[nodes]
    n = len(nodes)
    if n < 2:
        return Layer(nodes, np.full((n, 1), -1, np.int32))
    width = min(reach, n - 1)
    forward = np.empty((n, min(degree, width)), np.int64)
    for at in range(0, n, block):
        scores = own[at : at + block] @ own.T
        rows = np.arange(len(scores))
        scores[rows, at + rows] = -np.inf
        near = _best(scores, width)
        forward[at : at + block] = _diverse(own, near, np.take_along_axis(scores, near, 1), degree)
    a = np.repeat(np.arange(n), forward.shape[1])
    b = forward.ravel()
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    score = np.einsum("ij,ij->i", own[a], own[b])
    order = np.lexsort((b, -score, a))
    a, b = a[order], b[order]
    slot = np.arange(len(a)) - np.searchsorted(a, a)
    links = np.full((n, 2 * degree), -1, np.int32)
    fits = slot < 2 * degree
    links[a[fits], slot[fits]] = nodes[b[fits]]
    return Layer(nodes, links)


def build(vectors: np.ndarray, degree: int = 10, reach: int = 24, top: int = 512, seed: int = 7, block: int = 256) -> Graph:
    """A graph over unit vectors (float32, one row each).

    Each node rises to the next level with probability 1/degree. Levels are made until one has at
    most ``top`` nodes. The candidates of a node's links come from blocked products inside the
    shard, whose size is bounded, instead of one search for each insertion.
    """
    n = len(vectors)
    draw = np.random.default_rng(seed).random(n)
    nodes, layers, share = np.arange(n), [], 1.0
    while True:
        layers.append(_level(vectors, nodes, degree, reach, block))
        if len(nodes) <= top:
            return Graph(vectors, layers)
        share /= degree
        nodes = np.flatnonzero(draw < share)
        if not len(nodes):
            nodes = np.array([int(draw.argmin())])


def search(graph: Graph, queries: np.ndarray, k: int, width: int = 32, step: int = 4, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities), k of each query, best first; -1 and -inf where the shard has fewer."""
    n = len(graph.vectors)
    ids = np.full((len(queries), k), -1, np.int64)
    sims = np.full((len(queries), k), -np.inf, np.float32)
    if not n or not len(queries):
        return ids, sims
    top = graph.layers[-1]
    for at in range(0, len(queries), block):
        q = np.ascontiguousarray(queries[at : at + block])
        scores = q @ graph.vectors[top.nodes].T
        first = _best(scores, min(max(width if len(graph.layers) == 1 else step * 2, k), len(top.nodes)))
        found, score = top.nodes[first], np.take_along_axis(scores, first, 1)
        for layer in reversed(graph.layers[:-1]):
            found, score = _beam(graph.vectors, layer, q, found, score, max(width, k), step)
        keep = min(k, found.shape[1])
        ids[at : at + block, :keep] = found[:, :keep]
        sims[at : at + block, :keep] = score[:, :keep]
    ids[~np.isfinite(sims)] = -1
    return ids, sims


def _beam(vectors: np.ndarray, layer: Layer, q: np.ndarray, found: np.ndarray, score: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once, ``step`` expansions of each in a round."""
    n, m = len(vectors), len(q)
    row_of = None if len(layer.nodes) == n else np.full(n, -1, np.int64)
    if row_of is not None:
        row_of[layer.nodes] = np.arange(len(layer.nodes))
    seen = np.zeros(m * n, bool)
    seen[(np.arange(m)[:, None] * n + found).ravel()] = True
    ids = np.full((m, width), 0, np.int64)
    sims = np.full((m, width), -np.inf, np.float32)
    start = min(width, found.shape[1])
    ids[:, :start], sims[:, :start] = found[:, :start], score[:, :start]
    open_ = np.isfinite(sims)
    live = np.arange(m)
    while len(live):
        wait = np.where(open_[live], sims[live], -np.inf)
        pick = np.argpartition(-wait, min(step, width) - 1, axis=1)[:, :step] if width > step else np.broadcast_to(np.arange(width), wait.shape)
        ready = np.isfinite(np.take_along_axis(wait, pick, 1))
        go = ready.any(1)
        live, pick, ready = live[go], pick[go], ready[go]
        if not len(live):
            break
        mine = ids[live]
        centre = np.take_along_axis(mine, pick, 1)
        open_[live[:, None], pick] = False
        rows = centre if row_of is None else row_of[centre]
        near = layer.links[rows]
        near[~ready] = -1
        near = near.reshape(len(live), -1)
        flat = live[:, None] * n + near
        fresh = near >= 0
        fresh &= ~seen[np.where(fresh, flat, 0)]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        keys, once = np.unique(flat[r, c], return_index=True)
        seen[keys] = True
        r = r[once]
        target = keys % n
        value = np.einsum("ij,ij->i", q[live[r]], vectors[target])
        worst = sims[live].min(1)
        better = value > worst[r]
        r, target, value = r[better], target[better], value[better]
        if not len(r):
            continue
        slot = np.arange(len(r)) - np.searchsorted(r, r)
        extra = int(slot.max()) + 1
        more_ids = np.zeros((len(live), extra), np.int64)
        more = np.full((len(live), extra), -np.inf, np.float32)
        more_ids[r, slot], more[r, slot] = target, value
        all_ids = np.concatenate([mine, more_ids], 1)
        all_sims = np.concatenate([sims[live], more], 1)
        all_open = np.concatenate([open_[live], np.isfinite(more)], 1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        open_[live] = np.take_along_axis(all_open, keep, 1)
    order = np.lexsort((ids, -sims), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
