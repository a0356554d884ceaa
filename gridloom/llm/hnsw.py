"""Hierarchical navigable small-world graph over rows of a matrix, searched for many queries in step."""

from __future__ import annotations

import numpy as np

#: Links made by each new node; a node keeps up to twice as many.
LINKS = 16
#: Each layer has one node in so many of the layer below.
THINNING = 16
#: Largest layer that is searched by comparing all its nodes.
TOP = 64


class Graph:
    """Nodes are numbered by insertion; ``order`` gives the matrix row of each. Distances are squared Euclidean."""

    def __init__(self, rows: np.ndarray, links: int = LINKS, beam: int = 48, seed: int = 5) -> None:
        n = len(rows)
        self.order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.attach(rows)
        sizes = [n]
        while sizes[-1] > TOP:
            sizes.append(-(-sizes[-1] // THINNING))
        self.layers: list[np.ndarray] = []  # from the top down; neighbours of each node, -1 where there are fewer
        self.top = sizes[-1]
        for size in sizes[-2::-1]:
            self._grow(size, links, beam)

    def __getstate__(self) -> dict:
        """Without the vectors, which whoever keeps the graph has anyway."""
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "norm")}

    def attach(self, rows: np.ndarray) -> "Graph":
        """The graph over the rows it was built on."""
        self.x = np.ascontiguousarray(rows[self.order], dtype=np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        return self

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each query (row of q) to its nodes (row of nodes)."""
        return np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + self.norm[nodes] - 2 * np.matmul(self.x[nodes], q[:, :, None])[:, :, 0])

    def _all(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Squared distances of all queries to the nodes a to b - 1."""
        return np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + self.norm[a:b] - 2 * q @ self.x[a:b].T)

    def _grow(self, size: int, links: int, beam: int) -> None:
        """Insert the first ``size`` nodes as the next layer, in chunks that at most double it."""
        near = np.full((size, 2 * links), -1, np.int32)
        far = np.full((size, 2 * links), np.inf, np.float32)
        self.layers.append(near)
        done = 0
        while done < size:
            end = min(size, done + max(TOP, min(done, 512)))
            q = self.x[done:end]
            own = self._all(q, done, end)
            np.fill_diagonal(own, np.inf)
            k = min(links, end - done)
            inside = np.argpartition(own, k - 1, axis=1)[:, :k]
            nodes, dist = inside + done, np.take_along_axis(own, inside, 1)
            if done:
                found, away = self._search(q, beam, done)
                nodes, dist = np.hstack([found, nodes]), np.hstack([away, dist])
            pick = self._spread(nodes, dist, links)
            src = np.repeat(np.arange(done, end), pick.sum(1))
            dst, d = nodes[pick], dist[pick]
            keep = np.isfinite(d)
            self._link(near, far, np.concatenate([src[keep], dst[keep]]), np.concatenate([dst[keep], src[keep]]), np.concatenate([d[keep], d[keep]]))
            done = end

    def _spread(self, nodes: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
        """Mask of up to ``links`` candidates, nearest first, that are nearer to the new node than to those already taken."""
        order = np.argsort(dist, axis=1)
        taken = np.zeros(nodes.shape, bool)
        rows = np.arange(len(nodes))
        closest = np.full(nodes.shape, np.inf, np.float32)  # to a taken one
        for r in range(nodes.shape[1]):
            at = order[:, r]
            use = (dist[rows, at] <= closest[rows, at]) & (taken.sum(1) < links) & np.isfinite(dist[rows, at])
            taken[rows[use], at[use]] = True
            new = nodes[rows[use], at[use]]
            closest[use] = np.minimum(closest[use], self._far(self.x[new], np.maximum(nodes[use], 0)))
        for r in range(links):  # room left goes to the nearest of the others
            at = order[:, r] if r < nodes.shape[1] else order[:, -1]
            use = (taken.sum(1) < links) & np.isfinite(dist[rows, at])
            taken[rows[use], at[use]] = True
        return taken

    def _link(self, near: np.ndarray, far: np.ndarray, src: np.ndarray, dst: np.ndarray, d: np.ndarray) -> None:
        """Add links; a full node keeps its nearest, and every second place for what came first."""
        touched = np.unique(src)
        old = near[touched] >= 0
        s = np.concatenate([np.repeat(touched, old.sum(1)), src])
        t = np.concatenate([near[touched][old], dst])
        w = np.concatenate([far[touched][old], d])
        order = np.lexsort((t, s))
        s, t, w = s[order], t[order], w[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
        s, t, w = s[new], t[new], w[new]
        order = np.lexsort((w, s))
        s, t, w = s[order], t[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        keep = rank < near.shape[1]
        near[touched], far[touched] = -1, np.inf
        near[s[keep], rank[keep]], far[s[keep], rank[keep]] = t[keep], w[keep]

    def _search(self, q: np.ndarray, beam: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances), each query's beam in no order; -1 and inf where it isn't full."""
        top = min(self.top, size or self.top)
        d = self._all(q, 0, top)
        k = min(8 if self.layers else beam, top)
        nodes = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, nodes, 1)
        for i, near in enumerate(self.layers):
            last = i == len(self.layers) - 1
            nodes, dist = self._walk(q, near, nodes, dist, beam if last else 16)
        return nodes, dist

    def _walk(self, q: np.ndarray, near: np.ndarray, nodes: np.ndarray, dist: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(q)
        held = np.full((count, beam), -1, np.int64)
        away = np.full((count, beam), np.inf, np.float32)
        k = min(beam, nodes.shape[1])
        best = np.argsort(dist, axis=1)[:, :k]
        held[:, :k], away[:, :k] = np.take_along_axis(nodes, best, 1), np.take_along_axis(dist, best, 1)
        away[held < 0] = np.inf
        seen = np.zeros((count, len(near)), bool)
        rows, cols = np.nonzero(held >= 0)
        seen[rows, held[rows, cols]] = True
        fresh = held >= 0
        wide = max(1, min(8, beam // 16))  # nodes opened by each query in a step
        active = np.arange(count)
        while len(active):
            d = np.where(fresh[active], away[active], np.inf)
            at = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < beam else np.argsort(d, axis=1)
            good = np.isfinite(np.take_along_axis(d, at, 1))
            some = good.any(1)
            active, at, good = active[some], at[some], good[some]
            if not len(active):
                break
            fresh[active[:, None], at] = False
            new = np.where(good[:, :, None], near[np.maximum(held[active[:, None], at], 0)], -1).reshape(len(active), -1)
            known = (new < 0) | seen[active[:, None], np.maximum(new, 0)]
            new = np.where(known, -1, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            width = max(1, int((new >= 0).sum(1).max()))
            new = -np.sort(-new, axis=1)[:, :width]
            real = new >= 0
            r, c = np.nonzero(real)
            seen[active[r], new[r, c]] = True
            dn = np.where(real, self._far(q[active], np.maximum(new, 0)), np.inf).astype(np.float32)
            all_n, all_d = np.hstack([held[active], new]), np.hstack([away[active], dn])
            all_f = np.hstack([fresh[active], real])
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            held[active], away[active], fresh[active] = (np.take_along_axis(v, keep, 1) for v in (all_n, all_d, all_f))
            held[~np.isfinite(away)] = -1
        return held, away

    def search(self, queries: np.ndarray, beam: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(matrix rows, squared distances) of each query's beam, nearest first; -1 and inf where it isn't full."""
        out_n, out_d = [], []
        beam = min(beam, len(self.x))
        for a in range(0, len(queries), block):
            q = np.ascontiguousarray(queries[a : a + block], dtype=np.float32)
            nodes, dist = self._search(q, beam)
            best = np.argsort(dist, axis=1)[:, :beam]
            nodes, dist = np.take_along_axis(nodes, best, 1), np.take_along_axis(dist, best, 1)
            out_n.append(np.where(nodes >= 0, self.order[np.maximum(nodes, 0)], -1))
            out_d.append(dist)
        return np.vstack(out_n), np.vstack(out_d)
