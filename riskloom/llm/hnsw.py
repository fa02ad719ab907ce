"""A hierarchical navigable small-world graph in numpy: batched insertion and batched beam search."""

from __future__ import annotations

import numpy as np

from riskloom.llm.shingles import mix

NONE = -1


class Hnsw:
    """Graph over unit vectors ``x`` (float32). Layer ``l`` holds the nodes of level ``l`` and more; layer 0 holds all."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, m: int = 16, ef_build: int = 64, batch: int = 256):
        self.x, self.m = np.ascontiguousarray(x, np.float32), m
        n = len(x)
        draw = (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 6)
        self.links = [np.full((n, 2 * m if lay == 0 else m), NONE, np.int32) for lay in range(int(self.level.max(initial=0)) + 1)]
        self.entry = 0
        at = 0
        while at < n:
            end = min(n, at + max(1, min(batch, at)))
            self._insert(at, end, ef_build)
            at = end
        self._bridge()

    def _bridge(self, slots: int = 16) -> None:
        """Give every node a way in: pruning can cut the last link to it, or the last one into a tight group.

        A node that none of its own neighbours links to gets a link from the nearest of them with a free slot. Then nodes that cannot
        be reached on layer 0 are linked from the nearest reachable node with a free slot, round after round.
        """
        n, base = len(self.x), self.links[0]
        extra, used = np.full((n, slots), NONE, np.int32), np.zeros(n, int)
        known = np.zeros(n, bool)
        for j in range(base.shape[1]):
            known |= (base[:, j] >= 0) & (base[base[:, j]] == np.arange(n)[:, None]).any(1)
        for node in np.flatnonzero(~known):
            near = base[node][base[node] >= 0]
            near = near[np.argsort(-(self.x[near] @ self.x[node]), kind="stable")]
            if len(free := near[used[near] < slots]):
                extra[free[0], used[free[0]]] = node
                used[free[0]] += 1
        while n:
            seen, new = np.zeros(n, bool), np.array([self.entry])
            seen[new] = True
            while len(new):
                ahead = np.unique(np.concatenate([self.links[0][new], extra[new]], 1))
                new = ahead[(ahead >= 0)]
                new = new[~seen[new]]
                seen[new] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            for at in range(0, len(lost), 256):
                part = lost[at:at + 256]
                for node, near in zip(part, self.search(self.x[part], 64)[0]):
                    free = near[(near >= 0) & seen[near] & (used[near] < slots)]
                    host = free[0] if len(free) else np.flatnonzero(seen & (used < slots))[0]
                    extra[host, used[host]] = node
                    used[host] += 1
        width = int(used.max(initial=0))
        self.links[0] = np.concatenate([self.links[0], extra[:, :width]], 1)

    def _insert(self, at: int, end: int, ef: int) -> None:
        new = np.arange(at, end)
        q = self.x[new]
        top = int(self.level[self.entry]) if at else NONE
        near = np.full((len(new), 1), self.entry, np.int64)
        among = q @ q.T
        among[np.triu_indices(len(new))] = -2  # a node sees the earlier ones of its batch
        for layer in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= layer)
            found = np.full((len(new), 0), NONE, np.int64)
            if layer <= top:
                found = self.beam(q, near, ef if layer == 0 else 8, layer)[0]
                near = np.where(found[:, :4] >= 0, found[:, :4], near[:, :1])
            if len(mine):
                peers = np.where(self.level[new][None, :] >= layer, among, -2)[mine]
                k = min(16, len(new))
                best = np.argpartition(-peers, k - 1, 1)[:, :k]
                peer = np.where(np.take_along_axis(peers, best, 1) > -2, new[best], NONE)
                self._connect(new[mine], np.concatenate([found[mine], peer], 1), layer)
        tall = new[np.argmax(self.level[new])]
        if not at or self.level[tall] > self.level[self.entry]:
            self.entry = int(tall)

    def _select(self, base: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` neighbours of each base node: diverse ones first, the nearest of the others after."""
        sim = np.where(cand >= 0, np.einsum("bkd,bd->bk", self.x[cand], self.x[base]), -2)
        order = np.argsort(-sim, 1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        twice = np.zeros(cand.shape, bool)
        by_id = np.argsort(cand, 1, kind="stable")
        ranked = np.take_along_axis(cand, by_id, 1)
        np.put_along_axis(twice, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        ok = (cand >= 0) & ~twice & (cand != base[:, None])
        vec = self.x[cand]
        cross = vec @ vec.transpose(0, 2, 1)
        worst = np.full(cand.shape, -2, np.float32)  # largest similarity to a chosen one
        chosen = np.zeros(cand.shape, bool)
        for k in range(cand.shape[1]):
            take = ok[:, k] & (sim[:, k] > worst[:, k]) & (chosen.sum(1) < width)
            chosen[:, k] = take
            worst = np.where(take[:, None], np.maximum(worst, cross[:, k]), worst)
        rank = np.where(chosen, 0, np.where(ok, 1, 2))
        first = np.argsort(rank, 1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(cand, first, 1), NONE)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=NONE)

    def _connect(self, nodes: np.ndarray, cand: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        width = links.shape[1]
        links[nodes] = self._select(nodes, cand, width)
        source, target = np.repeat(nodes, width), links[nodes].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sim = np.einsum("kd,kd->k", self.x[source], self.x[target])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        uniq, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        extra = np.full((len(uniq), min(int(count.max()), width)), NONE, np.int64)
        near = place < extra.shape[1]
        extra[np.repeat(np.arange(len(uniq)), count)[near], place[near]] = source[near]
        free = (links[uniq] < 0).sum(1) >= count  # room for all: append
        for rows, full in ((np.flatnonzero(~free), True), (np.flatnonzero(free), False)):
            if len(rows):
                both = np.concatenate([links[uniq[rows]].astype(np.int64), extra[rows]], 1)
                if full:
                    links[uniq[rows]] = self._select(uniq[rows], both, width)
                else:
                    links[uniq[rows]] = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :width]

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``ef`` best nodes met for each query, best first; missing ones are -1."""
        b, links = len(q), self.links[layer]
        wide = max(4, ef // 16)  # nodes opened in one step
        seen = np.zeros((b, len(self.x)), bool)
        ids, sims = np.full((b, ef), NONE, np.int64), np.full((b, ef), -2, np.float32)
        done = np.ones((b, ef), bool)
        first = np.sort(entry[:, :ef], 1)
        first[:, 1:][first[:, 1:] == first[:, :-1]] = NONE
        k = first.shape[1]
        ids[:, :k] = first
        sims[:, :k] = np.where(first >= 0, np.einsum("bkd,bd->bk", self.x[first], q), -2)
        done[:, :k] = first < 0
        rows, cols = np.nonzero(first >= 0)
        seen[rows, first[rows, cols]] = True
        live = np.arange(b)
        while len(live):
            rank = np.where(done[live], -3, sims[live])
            pick = np.argsort(-rank, 1, kind="stable")[:, :wide] if ef > wide else np.argmax(rank, 1)[:, None]
            good = np.take_along_axis(rank, pick, 1) > -3
            live, pick, good = (z[good.any(1)] for z in (live, pick, good))
            if not len(live):
                break
            done[live[:, None], pick] |= good
            node = np.where(good, ids[live[:, None], pick], NONE)
            near = np.where(node[:, :, None] >= 0, links[node], NONE).reshape(len(live), -1).astype(np.int64)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
            near[(near >= 0) & seen[live[:, None], near]] = NONE
            rows, cols = np.nonzero(near >= 0)
            seen[live[rows], near[rows, cols]] = True
            got = np.full(near.shape, -2, np.float32)
            got[rows, cols] = np.einsum("kd,kd->k", self.x[near[rows, cols]], q[live[rows]])
            all_sim = np.concatenate([sims[live], got], 1)
            keep = np.argpartition(-all_sim, ef - 1, 1)[:, :ef]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
            sims[live] = np.take_along_axis(all_sim, keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), keep, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            found = self.beam(q, near, 8, layer)[0]
            near = np.where(found >= 0, found, near[:, :1])
        return self.beam(q, near, ef, 0)

    def pack(self) -> bytes:
        widths = [a.shape[1] for a in self.links]
        return np.concatenate([[self.entry, len(self.links)], widths, *[a.ravel() for a in self.links]]).astype("<i4").tobytes()

    @classmethod
    def unpack(cls, x: np.ndarray, packed: bytes, m: int = 16) -> Hnsw:
        self = cls.__new__(cls)
        raw = np.frombuffer(packed, "<i4")
        self.x, self.m, self.entry, n = np.ascontiguousarray(x, np.float32), m, int(raw[0]), len(x)
        layers = int(raw[1])
        ends = np.cumsum([2 + layers, *(int(w) * n for w in raw[2:2 + layers])])
        self.links = [raw[s:e].reshape(n, -1) for s, e in zip(ends[:-1], ends[1:])]
        return self


def within(graph: Hnsw, q: np.ndarray, least: float, ef: int, audit: np.ndarray, recall: float, slack: float = 0.03,
           own: np.ndarray | None = None, probes: int = 32, scan_small: bool = True):
    """Per query, the nodes of similarity ``least`` and more (a little slack below it, for an exact check to follow).

    Queries whose beam is full of nodes near the threshold widen it together: their beams become one, which takes in the neighbours
    of every member that is near the threshold for one of them, until nothing is added. The queries ``audit`` are compared with all
    nodes of the graph but the query's own node ``own`` (-1: none). While the mean of their recall, over those with a true neighbour, is below
    ``recall``, all beams start twice as wide. With fewer than 1 / (1 - recall) of them, none that misses all its neighbours passes, however
    many links a large group has. So that the audit has something to find also where queries have no neighbour here, ``probes`` vectors made
    from nodes of the graph, halfway to the threshold from them, are asked and audited too. An audit without a true neighbour shows nothing and
    widens nothing. A graph that a quarter of the beam covers is compared whole; without ``scan_small`` only after a failed audit.
    Returns (list of id arrays, recall of the audit, beam width, whether the graph was compared whole).
    """
    n, asked = len(graph.x), len(q)
    if 4 * ef < n:
        made = _probes(graph.x, least, probes)
        q, audit = np.concatenate([q, made]), np.append(audit, asked + np.arange(len(made)))
        own = None if own is None else np.append(own, np.full(len(made), NONE))
    truth = graph.x @ q[audit].T >= least
    if own is not None:
        held = np.flatnonzero(own[audit] >= 0)
        truth[own[audit][held], held] = False
    there, start = truth.sum(0), ef
    while True:
        out: list = [None] * len(q)
        width, full = min(ef, n), []
        if 4 * ef >= n and (scan_small or ef > start):  # the widest beam holds every node
            return [np.flatnonzero(graph.x @ v >= least) for v in q[:asked]], 1.0, ef, True
        step = max(1, min(256, (64 << 20) // max(1, n)))
        for at in range(0, len(q), step):
            ids, sims = graph.search(q[at:at + step], width)
            for k in range(len(ids)):
                out[at + k] = ids[k][sims[k] >= least]
            if width < n:
                full += [(at + k, ids[k]) for k in np.flatnonzero(sims[:, -1] >= least - slack)]
        if full:
            who = np.array([i for i, _ in full])
            shared = _widened(graph, q[who], np.unique(np.concatenate([ids[ids >= 0] for _, ids in full])), least - slack)
            for at in range(0, len(who), step):
                part = who[at:at + step]
                near = graph.x[shared] @ q[part].T >= least
                for k, i in enumerate(part):
                    out[i] = shared[near[:, k]]
        each = [truth[out[i], k].sum() / there[k] for k, i in enumerate(audit) if there[k]]
        got = float(np.mean(each)) if each else 1.0
        if got >= recall:
            return out[:asked], got, ef, False
        ef *= 2


def _probes(x: np.ndarray, least: float, count: int) -> np.ndarray:
    """Unit vectors near up to ``count`` rows of ``x``, each at the cosine halfway between ``least`` and 1."""
    draw = np.random.default_rng(len(x))
    base = x[draw.permutation(len(x))[:count]].astype(np.float64)
    off = draw.normal(0, 1, base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-9)
    c = (1 + least) / 2
    out = c * base + np.sqrt(1 - c * c) * off
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def _widened(graph: Hnsw, q: np.ndarray, members: np.ndarray, least: float) -> np.ndarray:
    """``members`` and all that is reached from them, along links or against them, over nodes of similarity ``least`` to a query."""
    links = graph.links[0]
    seen = np.zeros(len(graph.x), bool)
    seen[members] = True
    new = members
    while len(new):
        near = new[np.concatenate([(graph.x[new[at:at + 4096]] @ q.T >= least).any(1) for at in range(0, len(new), 4096)])]
        pointed = np.zeros(len(seen) + 1, bool)  # the last place is that of missing links
        pointed[near] = True
        ahead = np.unique(np.concatenate([links[near].ravel(), np.flatnonzero(pointed[links].any(1))]))
        new = ahead[ahead >= 0]
        new = new[~seen[new]]
        seen[new] = True
    return np.flatnonzero(seen)
