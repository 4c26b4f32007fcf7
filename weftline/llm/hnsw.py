"""Hierarchical navigable small-world graphs over a shard's vectors, as flat neighbour arrays."""

from __future__ import annotations

import io
from dataclasses import dataclass, fields

import numpy as np

#: Neighbours of a node at level 0 and above, how many of those at level 0 lead to nodes of higher levels, places beyond
#: them for links to nodes that no other link reaches, and candidates a node.
NEAR, UPPER, FAR, JOINS, WIDE = 32, 16, 8, 4, 48
#: A node is also in the next level with this chance, and if none of so many nearest ones is.
RISE, COVER = 1 / 16, 16
#: Candidates of a walk through an upper level, and how many of them a walk through the next level begins with.
UPPER_BEAM, HANDED = 24, 4


@dataclass
class Graph:
    """vectors in order of level, highest first, so level l holds nodes 0 to size[l] - 1; near[l] holds size[l] rows of
    neighbours one after the other, -1 where there are fewer."""

    vectors: np.ndarray
    size: np.ndarray
    near: np.ndarray

    def level(self, n: int) -> np.ndarray:
        widths = [(UPPER if i else NEAR) + JOINS for i in range(n + 1)]
        start, width = sum(int(self.size[i]) * widths[i] for i in range(n)), widths[n]
        return self.near[start : start + int(self.size[n]) * width].reshape(-1, width)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return dict(z)


def graph_arrays(g: Graph) -> dict[str, np.ndarray]:
    return {f.name: getattr(g, f.name) for f in fields(g)}


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def _nearest(v: np.ndarray, among: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the first `among` vectors to each vector, itself left out."""
    n, k = len(v), min(k, among)
    ids, ds = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for at in range(0, n, 512):
        d = _distances(v[at : at + 512], v[:among])
        own = np.arange(at, min(at + 512, n))
        d[own[own < among] - at, own[own < among]] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < among else np.tile(np.arange(among), (len(d), 1))
        pd = np.take_along_axis(d, part, 1)
        order = np.argsort(pd, axis=1, kind="stable")
        ids[at : at + 512], ds[at : at + 512] = np.take_along_axis(part, order, 1), np.take_along_axis(pd, order, 1)
    ids[~np.isfinite(ds)] = -1
    return ids, ds


def _diverse(v: np.ndarray, nodes: np.ndarray, ids: np.ndarray, ds: np.ndarray, width: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those nearer to it than to any chosen before; then the nearest others."""
    out = np.full((len(ids), width), -1, np.int32)
    for at in range(0, len(ids), 256):
        c, d = ids[at : at + 256], ds[at : at + 256]
        x = v[np.maximum(c, 0)]
        sq = (x * x).sum(2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.einsum("nid,njd->nij", x, x, optimize=True)
        chosen = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            clear = ~(chosen & (between[:, j, :] < d[:, j : j + 1])).any(1)
            chosen[:, j] = clear & (c[:, j] >= 0) & (chosen.sum(1) < width)
        rank = np.where(c < 0, 2 * c.shape[1], np.where(chosen, 0, c.shape[1])) + np.arange(c.shape[1])
        order = np.argsort(rank, axis=1)[:, :width]
        picked = np.take_along_axis(c, order, 1)
        out[at : at + 256, : picked.shape[1]] = picked
    return out


def _linked(v: np.ndarray, n: int, width: int, candidates: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One level: the first n vectors, linked both ways, at most `width` neighbours each."""
    x = v[:n]
    ids, ds = _nearest(x, n, WIDE) if candidates is None else candidates
    kept = _diverse(x, np.arange(n), ids, ds, width)
    src = np.repeat(np.arange(n), width)
    dst = kept.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    pair = np.unique(np.concatenate([src * n + dst, dst.astype(np.int64) * n + src]))
    src, dst = pair // n, pair % n
    d = ((x[src] - x[dst]) ** 2).sum(1)
    order = np.lexsort((d, src))
    src, dst, d = src[order], dst[order], d[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    most = 2 * width
    inside = place < most
    both, bd = np.full((n, most), -1, np.int32), np.full((n, most), np.inf, np.float32)
    both[src[inside], place[inside]], bd[src[inside], place[inside]] = dst[inside], d[inside]
    return _diverse(x, np.arange(n), both, bd, width)


def _raised(v: np.ndarray, level: np.ndarray, ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Levels so raised that each node of a level has one of the next among its COVER nearest there: a tight group of
    more than COVER is never without a node of the next level. ids are the nearest nodes at level 0."""
    level, n = level.copy(), 0
    while True:
        members = np.flatnonzero(level >= n)
        if len(members) <= WIDE:
            return level
        near = ids[:, :COVER] if n == 0 else _nearest(v[members], len(members), COVER)[0]
        above = level[members] > n
        covered = above | (above[np.maximum(near, 0)] & (near >= 0)).any(1)
        for i in rng.permutation(np.flatnonzero(~covered)):
            if not above[near[i]].any():
                above[i] = True
        level[members[above]] = np.maximum(level[members[above]], n + 1)
        n += 1


def _joined(near: np.ndarray, first: int, v: np.ndarray) -> np.ndarray:
    """near with JOINS more places, filled so that every node can be reached from the first ones: of the nodes that
    cannot, the one nearest to a reached one is linked from there, and all that it leads to is reached, and so on."""
    near = np.pad(near, ((0, 0), (0, JOINS)), constant_values=-1)
    reached = np.zeros(len(near), bool)
    reached[:first] = True
    front = np.arange(first)
    while True:
        while len(front):
            onward = np.unique(near[front])
            front = onward[(onward >= 0) & ~reached[np.maximum(onward, 0)]]
            reached[front] = True
        if reached.all():
            return near
        free = np.flatnonzero(reached & (near[:, -1] < 0))
        lost = np.flatnonzero(~reached)[:512]
        d = _distances(v[lost], v[free])
        at = int(d.min(1).argmin())
        host = free[int(d[at].argmin())]
        near[host, int(np.flatnonzero(near[host, -JOINS:] < 0)[0]) - JOINS] = lost[at]
        front = lost[at : at + 1]
        reached[front] = True


def build(vectors: np.ndarray, seed: int = 42) -> tuple[Graph, np.ndarray]:
    """The graph, and the order in which it holds the vectors.

    Nodes draw their highest level at random and are raised where their surroundings have none of the next level. In
    each level a node is linked to diverse near nodes of that level, and back; at level 0 some places are kept for the
    nearest nodes of level 1. What no link reaches from the level above is linked to, so every node can be found.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n)) / np.log(1 / RISE)).astype(int), 6)
    raw = np.ascontiguousarray(vectors, np.float32)
    ids, ds = _nearest(raw, n, WIDE) if n else (np.empty((0, 0), np.int32), np.empty((0, 0), np.float32))
    level = _raised(raw, level, ids, rng)
    order = np.argsort(-level, kind="stable")
    v, level = raw[order], level[order]
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    ids = np.where(ids[order] >= 0, place[np.maximum(ids[order], 0)], -1) if n else ids
    size = np.array([int((level >= i).sum()) for i in range(int(level.max(initial=0)) + 1)])
    rows = []
    for i, m in enumerate(size):
        near = _linked(v, int(m), UPPER if i else NEAR, None if i else (ids, ds[order]))
        above = int(size[i + 1]) if i + 1 < len(size) else 1
        if i == 0 and len(size) > 1:
            far, _ = _nearest(v, above, FAR)
            near[:, NEAR - far.shape[1] :] = np.where(far >= 0, far, near[:, NEAR - far.shape[1] :])
        rows.append(_joined(near, min(above, int(m)), v[: int(m)]).reshape(-1))
    return Graph(v, size, np.concatenate(rows) if rows else np.empty(0, np.int32)), order


def _walk(v: np.ndarray, near: np.ndarray, q: np.ndarray, ids: np.ndarray, ds: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes of one level that walks from the given ones meet, nearest first."""
    m, step = len(q), 2
    beam = max(beam, ids.shape[1])
    extra = ((0, 0), (0, beam - ids.shape[1]))
    ids, ds = np.pad(ids, extra, constant_values=-1), np.pad(ds, extra, constant_values=np.inf)
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, len(near)), bool)
    r, col = np.nonzero(ids >= 0)
    seen[r, ids[r, col]] = True
    walking = np.arange(m)
    while len(walking):
        w_ids, w_ds, w_done = ids[walking], ds[walking], done[walking]
        waiting = np.where((w_ids >= 0) & ~w_done, w_ds, np.inf)
        pick = np.argpartition(waiting, step - 1, axis=1)[:, :step] if beam > step else np.arange(beam)[None, :].repeat(len(walking), 0)
        ready = np.isfinite(np.take_along_axis(waiting, pick, 1))
        alive = ready.any(1)
        walking, pick, ready = walking[alive], pick[alive], ready[alive]
        if not len(walking):
            break
        w_ids, w_ds, w_done = w_ids[alive], w_ds[alive], w_done[alive]
        from_nodes = np.take_along_axis(w_ids, pick, 1)
        np.put_along_axis(w_done, pick, np.take_along_axis(w_done, pick, 1) | ready, 1)
        c = np.where(ready[:, :, None], near[np.maximum(from_nodes, 0)], -1).reshape(len(walking), -1)
        rows = np.repeat(np.arange(len(walking)), c.shape[1]).reshape(c.shape)
        fresh = (c >= 0) & ~seen[walking[rows], np.maximum(c, 0)]
        r, col = np.nonzero(fresh)
        seen[walking[r], c[r, col]] = True
        order = np.lexsort((c[r, col], r))  # a node reached twice in one step counts once
        r, col = r[order], col[order]
        node = c[r, col]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (node[1:] != node[:-1])
        r, col, node = r[first], col[first], node[first]
        d = np.full(c.shape, np.inf, np.float32)
        d[r, col] = ((v[node] - q[walking[r]]) ** 2).sum(1)
        all_ids, all_ds = np.concatenate([w_ids, c], 1), np.concatenate([w_ds, d], 1)
        all_done = np.concatenate([w_done, np.zeros(c.shape, bool)], 1)
        keep = np.argpartition(all_ds, beam - 1, axis=1)[:, :beam]
        ds[walking] = np.take_along_axis(all_ds, keep, 1)
        ids[walking] = np.where(np.isfinite(ds[walking]), np.take_along_axis(all_ids, keep, 1), -1)
        done[walking] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(ds, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(ds, order, 1)


def search(g: Graph, queries: np.ndarray, k: int, beam: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and squared distances of about the k nearest to each query, nearest first; -1 where there are fewer.

    All queries walk together, with a beam through every level; a walk begins with the nearest that the level above met.
    """
    q, n, v = np.ascontiguousarray(queries, np.float32), len(g.vectors), g.vectors
    m, beam = len(q), max(beam, k)
    if not n or not m:
        return np.full((m, k), -1, np.int64), np.full((m, k), np.inf, np.float32)
    ids, ds = np.zeros((m, 1), np.int64), ((q - v[0]) ** 2).sum(1)[:, None]
    for level in range(len(g.size) - 1, -1, -1):
        ids, ds = _walk(v, g.level(level), q, ids[:, :HANDED], ds[:, :HANDED], UPPER_BEAM if level else beam)
    out, od = ids[:, :k], ds[:, :k]
    if out.shape[1] < k:
        pad = k - out.shape[1]
        out, od = np.pad(out, ((0, 0), (0, pad)), constant_values=-1), np.pad(od, ((0, 0), (0, pad)), constant_values=np.inf)
    return out, od
