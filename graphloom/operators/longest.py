"""The longest simple paths from the vertices of one strong component, by linear programs with cuts, branched on."""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-7
LOOSE = 1e-3
#: An end that no path has.
NEVER = -1_000_000
#: Larger programs (40 MB) are refused.
MOST_CELLS = 5_000_000
MOST_PIVOTS = 1_000_000


class Chains:
    """A strong component without its chains: ``nodes`` have several edges in or out, ``arcs`` are chains between them.

    ``ahead[v]`` has the successors inside of vertex ``v``, ``beyond[v]`` the longest way that leaves at once."""

    def __init__(self, ahead: list[list[int]], beyond: list[int]) -> None:
        n = len(ahead)
        into = np.bincount([w for ws in ahead for w in ws], minlength=n)
        self.nodes = [v for v in range(n) if into[v] != 1 or len(ahead[v]) != 1] or [0]
        self.beyond = beyond
        at = {v: i for i, v in enumerate(self.nodes)}
        self.chains: list[tuple[int, list[int], int]] = []  # from a node, vertices between, to a node
        for v in self.nodes:
            for w in ahead[v]:
                between = []
                while w not in at:
                    between.append(w)
                    w = ahead[w][0]
                self.chains.append((at[v], between, at[w]))
        longest: dict[tuple[int, int], int] = {}
        for a, between, b in self.chains:
            if a != b:
                longest[a, b] = max(longest.get((a, b), 0), len(between) + 1)
        self.arcs = [(a, b, w) for (a, b), w in longest.items()]
        self.ends = [self.end(a) for a in range(len(self.nodes))]

    def end(self, a: int, skip: int = -1, most: int = 0) -> int:
        """The most that a path can have from node ``a`` on without another node; of chain ``skip`` the first ``most`` vertices."""
        out = [self.beyond[self.nodes[a]]]
        for k, (c, between, _) in enumerate(self.chains):
            if c == a:
                out += [j + 1 + self.beyond[v] for j, v in enumerate(between[:most] if k == skip else between)]
        return max(out)


class Program:
    """The longest path from node ``start``: ``x`` of each arc, in a condensed tableau of rows ``A x <= b``.

    A node is left at most as often as it is entered and entered once at most; what is entered and not left is the end.
    Cuts: a set of nodes without the start is entered at least as often as each of its members."""

    def __init__(self, n: int, arcs: list[tuple[int, int, int]], ends: list[int], start: int, pool: list | None = None) -> None:
        self.n, self.start, self.ends = n, start, ends
        self.arcs = [a for a in arcs if a[1] != start]
        self.pool = pool if pool is not None else []
        m = len(self.arcs)
        if 2 * n * m > MOST_CELLS:
            raise RuntimeError(f"longest simple paths of a component of {n} vertices with {m} ways between them need a linear program of over {MOST_CELLS} cells")
        self.src = np.array([a[0] for a in self.arcs], dtype=np.int64)
        self.dst = np.array([a[1] for a in self.arcs], dtype=np.int64)
        self.w = [a[2] for a in self.arcs]
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.into: list[list[int]] = [[] for _ in range(n)]
        for k, (a, b, _) in enumerate(self.arcs):
            self.out[a].append(k)
            self.into[b].append(k)
        t = np.zeros((2 * n, m + 1))
        t[self.src, np.arange(m)] += 1
        t[self.dst, np.arange(m)] -= 1
        t[n + self.dst, np.arange(m)] = 1
        t[start, m] = 1
        t[n:, m] = 1
        self.noise = np.random.default_rng(0)
        t[:, m] += self.noise.uniform(1e-7, 2e-7, 2 * n)  # against stalling: looser by that much only
        e = np.array(ends, dtype=float)
        cost = np.array(self.w, dtype=float) + e[self.dst] - e[self.src]
        self.cost = np.append(cost, -e[start])  # the value is minus the last entry
        self.t = t
        self.basic = np.arange(m, m + 2 * n)  # the variable of a row: arcs, then slacks
        self.free = np.arange(m)  # the variable of a column
        self.m, self.made, self.pivots = m, 2 * n, 0

    def pivot(self, r: int, c: int) -> None:
        t, p = self.t, self.t[r, c]
        row = t[r] / p
        col = t[:, c].copy()
        col[r] = 0
        k = self.cost[c]
        hit = np.flatnonzero(np.abs(col) > 1e-12)
        if len(hit):
            t[hit] -= np.outer(col[hit], row)
            t[hit, c] = -col[hit] / p
        self.cost -= k * row
        self.cost[c] = -k / p
        t[r] = row
        t[r, c] = 1 / p
        self.basic[r], self.free[c] = self.free[c], self.basic[r]
        self.pivots += 1
        if self.pivots > MOST_PIVOTS:
            raise RuntimeError(f"a linear program of longest simple paths took over {MOST_PIVOTS} pivots")

    def primal(self) -> None:
        while True:
            c = int(np.argmax(self.cost[:-1]))
            if self.cost[c] <= EPS:
                return
            col = self.t[:, c]
            up = np.flatnonzero(col > 1e-9)
            ratio = self.t[up, -1] / col[up]
            self.pivot(int(up[np.argmin(ratio)]), c)

    def dual(self, floor: float) -> bool:
        """Makes rows hold again; False if none can or the value falls under ``floor``."""
        while True:
            r = int(np.argmin(self.t[:, -1]))
            if self.t[r, -1] >= -EPS:
                return True
            if self.value() < floor:
                return False
            row = self.t[r, :-1]
            down = np.flatnonzero(row < -1e-9)
            if not len(down):
                return False
            ratio = self.cost[down] / row[down]
            near = down[ratio <= ratio.min() + 1e-10]
            self.pivot(r, int(near[np.argmin(row[near])]))

    def value(self) -> float:
        return -self.cost[-1]

    def add(self, coefs: dict[int, float], most: float) -> None:
        """The row ``coefs x <= most``."""
        row = np.zeros(self.m + 1)
        row[-1] = most + self.noise.uniform(1e-7, 2e-7)
        place = {int(v): (True, i) for i, v in enumerate(self.basic) if v < self.m} | {int(v): (False, i) for i, v in enumerate(self.free) if v < self.m}
        for k, f in coefs.items():
            held, i = place[k]
            if held:
                row -= f * self.t[i]
            else:
                row[i] += f
        self.t = np.vstack([self.t, row])
        self.basic = np.append(self.basic, self.m + self.made)
        self.made += 1

    def x(self) -> np.ndarray:
        out = np.zeros(self.m)
        real = self.basic < self.m
        out[self.basic[real]] = self.t[real, -1]
        return out

    def copy(self) -> Program:
        out = object.__new__(Program)
        out.__dict__ |= self.__dict__
        out.t, out.cost, out.basic, out.free = self.t.copy(), self.cost.copy(), self.basic.copy(), self.free.copy()
        return out

    def cut(self, inside: set[int], v: int) -> None:
        coefs = {k: 1.0 for k in self.into[v] if self.src[k] in inside}
        for u in inside:
            if u != v:
                for k in self.into[u]:
                    if self.src[k] not in inside:
                        coefs[k] = -1.0
        self.add(coefs, 0)

    def walk(self, x: np.ndarray) -> tuple[int, list[int]]:
        """A path along large ``x``: its length and nodes."""
        seen, now, long, nodes = {self.start}, self.start, 0, [self.start]
        best, kept = self.ends[now], [now]
        while True:
            to = [k for k in self.out[now] if int(self.dst[k]) not in seen]
            if not to:
                return best, kept
            k = max(to, key=lambda k: x[k])
            now = int(self.dst[k])
            long += self.w[k]
            seen.add(now)
            nodes.append(now)
            if long + self.ends[now] > best:
                best, kept = long + self.ends[now], nodes[:]

    def separate(self, x: np.ndarray) -> int:
        """Adds rows that ``x`` breaks; how many."""
        n, y = 0, np.bincount(self.dst, weights=x, minlength=self.n)
        use = x > 1e-6
        ways = np.bincount(self.dst[use], minlength=self.n)
        ahead = [[int(self.dst[k]) for k in ks if use[k]] for ks in self.out]
        seen, todo = {self.start}, [self.start]
        while todo:
            for w in ahead[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        left = {v for v in range(self.n) if y[v] > LOOSE} - seen
        behind: dict[int, list[int]] = {v: [] for v in left}
        for v in left:
            for w in ahead[v]:
                if w in left:
                    behind[w].append(v)
        while left:  # whatever can reach a vertex and isn't reached
            v = max(left, key=lambda u: y[u])
            group, todo = {v}, [v]
            while todo:
                for u in behind[todo.pop()]:
                    if u in left and u not in group:
                        group.add(u)
                        todo.append(u)
            self.cut(group, v)
            self.pool.append((frozenset(group), v))
            n += 1
            left -= group
        if n:
            return n
        # A node with one way in that is used is entered as often as that way: it goes with the node behind.
        behind_of = {int(self.dst[k]): int(self.src[k]) for k in np.flatnonzero(use)}
        root: dict[int, int] = {}
        for v in range(self.n):
            trail = []
            while v not in root and v != self.start and ways[v] == 1 and v not in trail:
                trail.append(v)
                v = behind_of[v]
            top = root.setdefault(v, v)
            root |= dict.fromkeys(trail, top)
        room: dict[tuple[int, int], float] = {}
        near: dict[int, set[int]] = {v: set() for v in root.values()}
        for k in np.flatnonzero(use):
            a, b = root[int(self.src[k])], root[int(self.dst[k])]
            if a != b:
                room[a, b] = room.get((a, b), 0.0) + float(x[k])
                room.setdefault((b, a), 0.0)
                near[a].add(b)
                near[b].add(a)
        known: set[frozenset] = set()
        for v in np.argsort(-y):
            v = int(v)
            if y[v] <= LOOSE:
                break
            if v == self.start or ways[v] < 2:
                continue
            tops = self.least(dict(room), near, v, y[v])
            group = tops and frozenset(u for u, top in root.items() if top in tops)
            if group and group not in known:
                known.add(group)
                self.cut(group, v)
                self.pool.append((group, v))
                n += 1
        return n

    def least(self, room: dict[tuple[int, int], float], near: dict[int, set[int]], v: int, need: float) -> set[int] | None:
        """Nodes around ``v`` that are entered less often than ``need``, by a flow from the start."""
        flow = 0.0
        while True:
            back = {v: v}
            todo = [v]
            for b in todo:
                for a in near[b]:
                    if a not in back and room[a, b] > 1e-9:
                        back[a] = b
                        todo.append(a)
                if self.start in back:
                    break
            if self.start not in back:
                return set(back) if flow < need - LOOSE else None
            path = [self.start]
            while path[-1] != v:
                path.append(back[path[-1]])
            push = min(room[a, b] for a, b in zip(path, path[1:], strict=False))
            for a, b in zip(path, path[1:], strict=False):
                room[a, b] -= push
                room[b, a] += push
            flow += push
            if flow >= need - LOOSE:
                return None


def solve(program: Program, known: int = -1, max_parts: int = 100_000) -> tuple[int, list[int], int]:
    """The length of the longest path, its nodes and the number of programs."""
    best, kept, parts = known, [], 0
    if not program.m:
        return max(known, program.ends[program.start]), [program.start], 0
    program.primal()
    for group, v in list(program.pool):
        if program.start not in group:
            program.cut(set(group), v)
    todo = [(math.inf, program)]
    while todo:
        bound, p = todo.pop()
        if bound < best + 1 - 1e-4:
            continue
        parts += 1
        if parts > max_parts:
            raise RuntimeError(f"longest simple paths took over {max_parts} linear programs")
        while True:
            if not p.dual(best + 1 - 1e-4) or p.value() < best + 1 - 1e-4:
                break
            x = p.x()
            long, nodes = p.walk(x)
            if long > best:
                best, kept = long, nodes
                continue
            if p.separate(x):
                continue
            off = np.abs(x - np.round(x))
            k = int(np.argmax(off))
            if off[k] < LOOSE:
                raise RuntimeError("a program's arcs are no path")
            up, down = p.copy(), p
            down.add({k: 1.0}, 0)
            up.add({k: -1.0}, -1)
            todo.append((p.value(), down))
            todo.append((p.value(), up))
            break
    return best, kept, parts


def depths(chains: Chains, targets: list[int], max_parts: int = 100_000) -> dict[int, int]:
    """The longest simple path from each of the nodes ``targets`` and from each vertex of the chains that lead to them."""
    out: dict[int, int] = {}
    pool: list = []
    n = len(chains.nodes)
    for b in targets:
        long, nodes, _ = solve(Program(n, chains.arcs, chains.ends, b, pool), max_parts=max_parts)
        out[chains.nodes[b]] = long
        for k, (a, between, to) in enumerate(chains.chains):
            if to != b:
                continue
            other = None  # the longest path from b that doesn't end at a
            for i, v in enumerate(between):
                # From v to b and on; what follows has no use of this chain but to end in it before v.
                end = chains.end(a, k, i)
                most = long
                if nodes[-1] == a and end < chains.ends[a]:
                    if other is None:
                        ends = [NEVER if c == a else e for c, e in enumerate(chains.ends)]
                        other = solve(Program(n, chains.arcs, ends, b, pool), NEVER if a == b else -1, max_parts=max_parts)[0]
                    most = max(other, long - chains.ends[a] + end)
                out[v] = max([len(between) - i + most, *(j + chains.beyond[u] for j, u in enumerate(between[i:]))])
    return out
