"""A hierarchical navigable small-world graph in numpy: built and searched for many nodes at once, kept in flat arrays.

Level ``l`` links the nodes whose own level is ``l`` or more.  Levels are built from the top: a batch of nodes descends to
its entry points through the finished levels above, holds a beam over what its level has so far, and links to a spread
choice of what it found; the nodes it links to link back and thin their links the same way.  Batches double, so a node
always finds at least half of the others before it.
"""

from __future__ import annotations

import numpy as np

VISITED = 64 << 20  # bytes of the table of visited nodes
AT_ONCE = 512  # nodes of a batch


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled by the largest norm, and one more component that makes each of unit length: the order by inner product
    with any vector that has zero there stays."""
    y = x / np.abs(x).max()
    y /= np.sqrt((y**2).sum(1).max())
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1.0 - (y**2).sum(1)))[:, None]], 1).astype(np.float32)


def beam(x, links, queries, entries, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nearness) of ``width`` places a query, best first, -1 where there are fewer; ``links`` has -1 for none."""
    n, many = len(queries), max(1, min(AT_ONCE, VISITED // len(links)))
    found, near = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    for a in range(0, n, many):
        found[a : a + many], near[a : a + many] = _beam(x, links, queries[a : a + many], entries[a : a + many], width)
    return found, near


def _beam(x, links, q, entries, width):
    n, step = len(q), 4  # so many nodes are opened at once
    seen = np.zeros((n, len(links)), bool)
    node, sim = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    node[:, 0], open_[:, 0] = entries, True
    sim[:, 0] = np.einsum("nd,nd->n", x[entries], q)
    seen[np.arange(n), entries] = True
    live = np.arange(n)
    while len(live):
        s = np.where(open_[live], sim[live], -np.inf)
        best = np.argpartition(-s, min(step, width - 1), axis=1)[:, :step] if width > step else np.tile(np.arange(width), (len(live), 1))
        good = np.take_along_axis(s, best, 1) > -np.inf
        some = good.any(1)
        live, best, good = live[some], best[some], good[some]
        if not len(live):
            break
        row = live[:, None]
        at = np.where(good, node[row, best], -1)
        open_[row, best] = False
        new = np.where(at[..., None] >= 0, links[at], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new = np.where(seen[row, new], -1, new)  # -1 reads some node's mark, which does not matter
        r, c = np.nonzero(new >= 0)
        hit = new[r, c]
        seen[live[r], hit] = True
        score = np.full(new.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("nd,nd->n", x[hit], q[live[r]])
        all_node, all_sim = np.concatenate([node[live], new], 1), np.concatenate([sim[live], score], 1)
        all_open = np.concatenate([open_[live], new >= 0], 1)
        top = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        node[live], sim[live], open_[live] = (np.take_along_axis(v, top, 1) for v in (all_node, all_sim, all_open))
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)


def spread(x, nodes, sims, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) ``most`` at most: those nearer to the row's own node than to any
    chosen before, then the best of the others."""
    n, width = nodes.shape
    chosen = np.zeros((n, width), bool)
    for a in range(0, n, 128):
        own, near = nodes[a : a + 128], sims[a : a + 128]
        v = x[own]
        between = v @ v.transpose(0, 2, 1)
        kept, taken = chosen[a : a + 128], np.zeros(len(own), int)
        for j in range(width):
            fits = (own[:, j] >= 0) & (taken < most) & ~((between[:, j] > near[:, j, None]) & kept).any(1)
            kept[:, j] = fits
            taken += fits
    rank = np.where(chosen, 0, np.where(nodes >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(nodes, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _level(x, members, entry_of, links, most: int, width: int) -> None:
    """Links of one level, written into ``links`` (a row a node of ``x``)."""
    done = 0
    while done < len(members):
        size = min(max(done, AT_ONCE // 2), AT_ONCE, len(members) - done)
        own, before = members[done : done + size], members[:done]
        near_own = x[own] @ x[own].T
        np.fill_diagonal(near_own, -np.inf)
        nodes, sims = np.where(np.isfinite(near_own), own[None, :], -1), near_own  # of the batch itself
        if done:
            if done <= 2 * AT_ONCE:
                sim = x[own] @ x[before].T
                found = np.broadcast_to(before, sim.shape)
            else:
                found, sim = beam(x, links, x[own], entry_of(own, before[0]), width)
            nodes, sims = np.concatenate([nodes, found], 1), np.concatenate([sims, sim], 1)
        k = min(width, nodes.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
        nodes, sims = np.take_along_axis(nodes, top, 1).astype(np.int32), np.take_along_axis(sims, top, 1)
        nodes[~np.isfinite(sims)] = -1
        mine = spread(x, nodes, sims, most if len(members) <= most else LINKS)  # a small level is linked wholly
        links[own, : mine.shape[1]] = mine
        _back(x, links, own, mine, most)
        done += size


def _back(x, links, own, mine, most: int) -> None:
    """The nodes linked to link back; where that is more than ``most``, they thin their links."""
    to, source = mine.reshape(-1), np.repeat(own, mine.shape[1])
    source, to = source[to >= 0], to[to >= 0]
    if not len(to):
        return
    sim = np.einsum("nd,nd->n", x[to], x[source])
    order = np.lexsort((-sim, to))
    to, source = to[order], source[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    room = place < most  # the nearest of a hub's new links
    added = np.full((len(target), int(min(count.max(), most))), -1, np.int32)
    added[np.repeat(np.arange(len(target)), count)[room], place[room]] = source[room]
    held = links[target]
    both = np.concatenate([held, np.where((added[:, :, None] == held[:, None, :]).any(2), -1, added)], 1)
    sims = np.where(both >= 0, np.einsum("ncd,nd->nc", x[both], x[target]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
    full = (both[:, most:] >= 0).any(1)
    links[target[~full]] = both[~full, :most]
    if full.any():
        links[target[full]] = spread(x, both[full], sims[full], most)


LINKS = 16  # of a new node, and of any node at the upper levels; twice as many at level 0


def build(x: np.ndarray, width: int = 96, seed: int = 7) -> tuple[list[np.ndarray], int]:
    """Links by level, lowest first, a row of ``x`` each (-1: none), and the entry node.  ``x`` has unit rows."""
    n = len(x)
    level = np.minimum(20, -np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    tables: list[np.ndarray] = []
    entry = int(np.argmax(level))

    def descend(nodes, start):
        at = np.full(len(nodes), start, np.int32)
        for links in tables:
            at = beam(x, links, x[nodes], at, 1)[0][:, 0]
        return at

    for l in range(int(level.max()), -1, -1):
        members = np.flatnonzero(level >= l)
        members = np.concatenate([[entry], members[members != entry]])
        links = np.full((n, LINKS if l else 2 * LINKS), -1, np.int32)
        higher = level > l

        def entry_of(own, start, higher=higher):
            return np.where(higher[own], start, descend(own, entry)) if tables else np.full(len(own), start)

        _level(x, members, entry_of, links, links.shape[1], width)
        tables.append(links)
    return tables[::-1], entry


def search(x, tables, entry: int, queries, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nearness), best first."""
    at = np.full(len(queries), entry, np.int32)
    for links in tables[:0:-1]:
        at = beam(x, links, queries, at, 1)[0][:, 0]
    return beam(x, tables[0], queries, at, min(width, len(x)))
