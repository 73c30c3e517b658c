"""Growing many binary trees over binned blocks: distributed tops, small nodes finished by one task.

Every record carries two sums' worth of evidence for each tree it is used by
(boosting: first and second derivative; forest: its count by class). Trees
grow from the root by levels:

* a large node is split from the (node, tried feature, bin) sums of all blocks,
  one pass a level for all trees, which also counts the children's records;
* a node with at most ``LOCAL`` records (``MANY`` times as many where there are
  enough trees to keep all tasks busy) is finished by one task: its records are
  shuffled to it once and its whole subtree grows in memory. A few shallow
  boosting trees of a large table have passes only, so their records stay.

Both use the same split rule on the same bins, so where the line lies does not
change the trees. The driver sees sums and finished trees, never records; where
only the gains of the features are wanted, the trees stay in their tasks, and
where there are too many nodes, what the tasks grew goes to the shared folder.
Small nodes make most of the levels, so the passes a tree costs grow with the
logarithm of the table over ``LOCAL``, not with its depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from loanlens.operators.trees import Binned, Block, mixed

LOCAL = 1 << 16         # records of a node that one task finishes
MANY = 16               # times as many, at most, in a fit of many trees
SPREAD = 64             # tasks' worth of nodes that such a fit keeps
SENT = 1 << 23          # bytes of one level's sums, up to which shallow trees have passes only, and of all tasks' sums sent at once
TASK = 1 << 17          # records of small nodes to a task
JOINT = 32              # bins of features that are counted together
BATCH = 1 << 18         # records of small nodes grown together

_UP, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Rule:
    """How nodes split; arrays have one entry a tree.

    "newton": the evidence is (g, h) in units of 1 / ``unit``, the gain that of
    the second-order objective with ``l2``, ``least`` the smallest h of a
    child. "gini": the evidence is the number of records of class 0 and 1,
    weighted by ``weight``; ``least`` the smallest number of records.
    """
    kind: str
    depth: np.ndarray
    least: np.ndarray
    l2: np.ndarray
    weight: np.ndarray
    key: np.ndarray             # of each root, for feature subsets
    features: int = 0           # features tried at a node (0: all)
    unit: float = 1.0

    def part(self, at: np.ndarray) -> "Rule":
        return Rule(self.kind, self.depth[at], self.least[at], self.l2[at], self.weight[at], self.key[at], self.features, self.unit)

    def gains(self, la, lb, a, b, root) -> np.ndarray:
        """Gain of a split after each bin; -1 where it is not allowed. Sums are (nodes, bins), totals (nodes, 1)."""
        ra, rb = a - la, b - lb
        least = self.least[root][:, None]
        if self.kind == "newton":
            lam, u = self.l2[root][:, None], self.unit
            la, lb, ra, rb, a, b = la / u, lb / u, ra / u, rb / u, a / u, b / u
            out = la * la / (lb + lam) + ra * ra / (rb + lam) - a * a / (b + lam)
            bad = (lb < least) | (rb < least)
        else:
            bad = (la + lb < least) | (ra + rb < least)
            w0, w1 = self.weight[root, 0][:, None], self.weight[root, 1][:, None]
            la, ra, a, lb, rb, b = la * w0, ra * w0, a * w0, lb * w1, rb * w1, b * w1
            tiny = 1e-300
            out = (la * la + lb * lb) / (la + lb + tiny) + (ra * ra + rb * rb) / (ra + rb + tiny) - (a * a + b * b) / (a + b + tiny)
        out[bad] = -1.0
        out[:, -1] = -1.0       # nothing lies right of the last bin
        return out

    def picks(self, key: np.ndarray, dim: int) -> "np.ndarray | None":
        """(nodes, features) features tried at nodes with these keys; None for all."""
        if not self.features or self.features >= dim:
            return None
        h = mixed(key[:, None] ^ mixed(np.arange(1, dim + 1, dtype=np.uint64) * _UP))
        return np.sort(np.argpartition(h, self.features - 1, axis=1)[:, :self.features], axis=1)    # no ties: ``mixed`` is one to one


class Best:
    """The best split of each node so far; ties stay with the first."""

    def __init__(self, nodes: int):
        self.gain = np.full(nodes, 1e-6)
        self.feature, self.cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        self.la, self.lb, self.records = np.zeros(nodes), np.zeros(nodes), np.zeros(nodes, np.int64)

    def consider(self, rule: Rule, root, feature, ha, hb, a, b, records=None) -> None:
        la, lb = np.cumsum(ha, axis=1), np.cumsum(hb, axis=1)
        gain = rule.gains(la, lb, a[:, None], b[:, None], root)
        at, k = np.argmax(gain, axis=1), np.arange(len(a))
        better = gain[k, at] > self.gain
        k, at = k[better], at[better]
        if records is not None:     # on the left
            self.records[k] = np.cumsum(records[k], axis=1)[np.arange(len(k)), at]
        self.gain[k], self.cut[k] = gain[k, at], at
        self.feature[k] = feature[k] if isinstance(feature, np.ndarray) else feature
        self.la[k], self.lb[k] = la[k, at], lb[k, at]

    def consider_cells(self, rule: Rule, root, feature, node, cut, ha, hb, a, b, start) -> None:
        """As :meth:`consider` for the filled bins of nodes only, in order of node and bin: an empty bin splits like the
        one before it. ``start`` holds the sums of all nodes before each node."""
        first = np.flatnonzero(np.diff(node, prepend=-1))
        owner = node[first]
        la, lb = np.cumsum(ha), np.cumsum(hb)
        la, lb = la - start[0][node], lb - start[1][node]
        w = rule.weight[root]
        w0, w1, pa, pb = w[:, 0], w[:, 1], a * w[:, 0], b * w[:, 1]
        tiny = 1e-300
        whole = (pa * pa + pb * pb) / (pa + pb + tiny)
        ra, rb = a[node] - la, b[node] - lb
        least = rule.least[root][node]
        bad = (la + lb < least) | (ra + rb < least)
        w0, w1 = w0[node], w1[node]
        pa, pb, qa, qb = la * w0, lb * w1, ra * w0, rb * w1
        gain = (pa * pa + pb * pb) / (pa + pb + tiny) + (qa * qa + qb * qb) / (qa + qb + tiny) - whole[node]
        gain[bad] = -1.0
        most = np.full(len(a), -1.0)
        most[owner] = np.maximum.reduceat(gain, first) if len(first) else 0.0
        better = most > self.gain
        hit = np.flatnonzero((gain == most[node]) & better[node])[::-1]
        place = np.zeros(len(a), np.int64)
        place[node[hit]] = hit          # the first one of a node is written last
        k = np.flatnonzero(better)
        at = place[k]
        self.gain[k], self.cut[k], self.feature[k] = gain[at], cut[at], feature[k]
        self.la[k], self.lb[k] = la[at], lb[at]


@dataclass
class Nodes:
    """Nodes of many trees; the first ones are the roots. Children lie side by side at ``left``, feature -1 marks a leaf."""
    root: np.ndarray
    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray

    @classmethod
    def leaves(cls, root, key, a, b) -> "Nodes":
        n = len(root)
        return cls(root, key, a, b, np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def add(self, more: "Nodes") -> None:
        for f in self.__dataclass_fields__:
            setattr(self, f, np.concatenate([getattr(self, f), getattr(more, f)]))

    def split(self, at: np.ndarray, best: Best, which: np.ndarray) -> None:
        """Split the nodes ``at`` by ``best[which]`` and add their children as leaves."""
        n = len(self.root)
        self.feature[at], self.cut[at], self.gain[at] = best.feature[which], best.cut[which], best.gain[which]
        self.left[at] = n + 2 * np.arange(len(at))
        la, lb = best.la[which], best.lb[which]
        pair = lambda x, y: np.stack([x, y], 1).ravel()
        key = self.key[at]
        self.add(Nodes.leaves(np.repeat(self.root[at], 2), pair(mixed(key * _UP), mixed(key * _UP + _SIDE)),
                              pair(la, self.a[at] - la), pair(lb, self.b[at] - lb)))

    def walk(self, x: np.ndarray, root: np.ndarray, levels: "int | None" = None) -> np.ndarray:
        """(roots, records) node that each record reaches from each root, after ``levels`` steps at most."""
        n = x.shape[1]
        out, flat = np.repeat(root, n), x.ravel()
        live, record, step = np.arange(len(out)), np.tile(np.arange(n), len(root)), 0
        node = out.copy()
        while levels is None or step < levels:
            f = self.feature.take(node)
            inner = np.flatnonzero(f >= 0)
            if len(inner) < len(f):
                live, record, node, f = live[inner], record[inner], node[inner], f[inner]
            if not len(live):
                break
            right = flat.take(f.astype(np.int64) * n + record) > self.cut.take(node)
            node = self.left.take(node).astype(np.int64) + right
            out[live] = node
            step += 1
        return out.reshape(len(root), n)


#: Types of finished nodes, which the driver gathers.
NARROW = {"root": np.int32, "a": np.float64, "b": np.float64, "feature": np.int32, "cut": np.int16, "left": np.int32, "gain": np.float32}


#: Sums of both classes in one double: 2 ** 26 is above the copies of a task's records, so both stay exact.
_BOTH = float(1 << 26)
#: A block's sum of second derivatives lies under it, with up to 2 ** 14 times as much for the number of records.
_COUNT = float(1 << 38)


def grow_local(x: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray, depth: np.ndarray,
               rule: Rule, bins: np.ndarray) -> Nodes:
    """Trees of records (records x features); ``root`` numbers the trees, whose depths left are ``depth``."""
    n, dim = len(keys), len(bins)
    nodes = Nodes.leaves(np.arange(n), keys, np.bincount(root, a, n), np.bincount(root, b, n))
    front, slot, record = np.arange(n), root, np.arange(len(root))
    level, above, gini = 0, None, rule.kind == "gini"
    flat = x.ravel()
    by_feature = None if gini else np.ascontiguousarray(x.T)
    a, b = (a + b * _BOTH, np.zeros(0)) if gini else (a, b)     # a: both counts
    while len(front):
        tree = nodes.root[front]
        open_ = depth[tree] > level
        if gini:
            open_ &= (nodes.a[front] > 0) & (nodes.b[front] > 0)
        if above is not None:       # children come in pairs of one tree
            above = [(ha[open_[::2]], hb[open_[::2]]) for ha, hb in above]
        front, slot, record, a, b = _narrow(front, open_, slot, record, a, b)
        if not len(front):
            break
        k, tree = len(front), nodes.root[front]
        best = Best(k)
        if gini:
            _tried(best, rule, tree, nodes, front, flat, dim, bins, slot, record, a)
        else:
            sums = _all_sums(by_feature, bins, slot, record, a, b, k, above)
            for i, (ha, hb) in enumerate(sums):
                best.consider(rule, tree, i, ha, hb, nodes.a[front], nodes.b[front])
        found = best.feature >= 0
        which = np.flatnonzero(found)
        if not gini:
            above = [(ha[which], hb[which]) for ha, hb in sums]
        before = len(nodes.root)
        nodes.split(front[which], best, which)
        right = flat.take(record * dim + np.maximum(best.feature, 0).take(slot)) > best.cut.take(slot)
        rank = np.cumsum(found) - 1
        keep = np.flatnonzero(found.take(slot))
        slot, record, a = (2 * rank.take(slot) + right)[keep], record[keep], a[keep]
        b = b if gini else b[keep]
        front = before + np.arange(2 * len(which))
        level += 1
    return nodes


def _tried(best: Best, rule: Rule, tree, nodes: Nodes, front, flat, dim: int, bins, slot, record, both) -> None:
    """Consider the features tried at each node of a level, by the filled bins alone: deep nodes have few records."""
    k, wide = len(front), int(bins.max(initial=1))
    a, b = nodes.a[front], nodes.b[front]
    start = [np.cumsum(v) - v for v in (a, b)]
    picks = rule.picks(nodes.key[front], dim)
    if picks is None:
        picks = np.tile(np.arange(dim), (k, 1))
    row, at = record * dim, slot * wide
    for i in range(picks.shape[1]):
        feature = np.ascontiguousarray(picks[:, i])
        sums = np.bincount(at + flat.take(row + feature.take(slot)), both, k * wide)
        cell = np.flatnonzero(sums)
        node = cell // wide
        h = sums[cell]
        hb = np.floor(h / _BOTH)
        best.consider_cells(rule, tree, feature, node, cell - node * wide, h - hb * _BOTH, hb, a, b, start)


def _all_sums(x, bins, slot, record, a, b, k: int, above) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, bins) sums of a and b for each feature; of two children one is summed, the other is the rest of ``above``."""
    if above is not None:
        size = np.bincount(slot, minlength=k)
        small = np.zeros(k, bool)
        least = 2 * np.arange(k // 2) + (size[::2] > size[1::2])
        small[least] = True
        mine = small[slot]
        slot, record, a, b = slot[mine] >> 1, record[mine], a[mine], b[mine]
    out, rows = [], k if above is None else k // 2
    for i, w in enumerate(bins.tolist()):
        cell = slot * w + x[i][record]
        pair = []
        for j, v in enumerate((a, b)):
            h = np.bincount(cell, v, rows * w).reshape(rows, w)
            if above is not None:
                both = np.empty((k, w))
                both[least], both[least ^ 1] = h, above[i][j] - h
                h = both
            pair.append(h)
        out.append(tuple(pair))
    return out


def _narrow(front, open_, slot, record, a, b):
    """Only the open nodes of a level and their records."""
    if open_.all():
        return front, slot, record, a, b
    rank, keep = np.cumsum(open_) - 1, np.flatnonzero(open_.take(slot))
    return front[open_], rank.take(slot[keep]), record[keep], a[keep], b[keep] if len(b) else b


#: (block, roots) -> (used, a, b) of each root and record of a block: (roots x records) arrays.
Evidence = Callable[[Block, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _limit(rule: Rule, size: np.ndarray) -> int:
    """Records up to which a node is finished by one task; 0 for passes only."""
    if rule.kind == "newton" and size.max(initial=0) > 4 * LOCAL:
        return 0
    return max(LOCAL, min(MANY * LOCAL, int(size.sum()) // SPREAD))


def grow(blocks, binned: Binned, n_roots: int, evidence: Evidence, rule: Rule, records: np.ndarray, after=None,
         only_gains: bool = False, kept: "Callable | None" = None) -> "Nodes | np.ndarray | tuple[Nodes, np.ndarray]":
    """Trees of ``n_roots`` roots over an RDD of blocks; ``records`` is a bound of each root's records.

    ``after`` is called when the passes over ``blocks`` are done. With
    ``only_gains`` the result is the (roots, features) sums of the nodes' gains.
    ``kept`` takes the pieces that the tasks grow, as an RDD of (numbers, nodes), the tree of each number, and the
    leaves of the top as such pieces; the result is the top's nodes and the number under each of its leaves.
    """
    bins, roots = binned.bins, np.arange(n_roots)
    nodes = Nodes.leaves(roots, rule.key.copy(), np.zeros(n_roots), np.zeros(n_roots))
    size, level, limit = records.astype(np.int64), 0, _limit(rule, records)
    front, above = roots, None
    while True:
        open_ = front[rule.depth[nodes.root[front]] > level]
        if limit == 0 and len(open_) * int(bins.sum()) * 24 > SENT:
            limit = LOCAL
        front = open_[size[open_] > limit]              # large nodes, split by a pass over all blocks
        if level and rule.kind == "gini":
            front = front[(nodes.a[front] > 0) & (nodes.b[front] > 0)]
        if not len(front):
            break
        top, slots, picks = nodes, front, rule.picks(nodes.key[front], len(bins))
        columns = _columns(bins, picks)
        pairs = picks is None and above is not None and len(front) == 2 * len(above)
        if pairs:       # of two children one is summed, the other is the rest of their parent: sums are exact
            least = 2 * np.arange(len(above)) + (size[front[::2]] > size[front[1::2]])
            slots = front[least]
        one = len(slots) * (columns[-1][1] + columns[-1][2]) * 24
        sums = _summed(blocks, lambda blk: _bin_sums(blk, evidence, top, slots, columns), one * binned.parts <= SENT)
        if pairs:
            summed, sums = sums, np.empty((len(front), *sums.shape[1:]))
            sums[least], sums[least ^ 1] = summed, above - summed
        _, lo, w = columns[0]
        totals = sums[:, lo:lo + w].sum(axis=1)
        if not level:
            nodes.a[front], nodes.b[front] = totals[:, 0], totals[:, 1]
        best, tree = Best(len(front)), nodes.root[front]
        for feature, lo, w in columns:
            ha, hb, n = (sums[:, lo:lo + w, i] for i in range(3))
            best.consider(rule, tree, feature, ha, hb, nodes.a[front], nodes.b[front], n)
        which, before, level = np.flatnonzero(best.feature >= 0), len(nodes.root), level + 1
        nodes.split(front[which], best, which)
        left = best.records[which]
        size = np.concatenate([size, np.stack([left, totals[which, 2].astype(np.int64) - left], 1).ravel()])
        front, above = before + np.arange(2 * len(which)), sums[which]
    return _finish(blocks, binned, evidence, rule, nodes, roots, size, limit, after, only_gains, kept)


def _finish(blocks, binned: Binned, evidence: Evidence, rule: Rule, nodes: Nodes, roots, size, limit: int, after, only_gains: bool,
            kept: "Callable | None" = None):
    """Grow the small open nodes, each in one task."""
    bins, dim = binned.bins, len(binned.edges)
    level = _levels(nodes)
    whole = len(nodes.root) == len(roots)       # no pass
    open_ = np.flatnonzero((nodes.feature < 0) & (size <= limit) & ((rule.depth[nodes.root] > level) | (level == 0)))
    if rule.kind == "gini":
        open_ = open_[(level[open_] == 0) | (nodes.a[open_] > 0) & (nodes.b[open_] > 0)]
    tree, keys, left = nodes.root[open_], nodes.key[open_], rule.depth[nodes.root[open_]] - level[open_]
    number = np.full(len(nodes.root), -1)
    number[open_] = np.arange(len(open_))
    top, part = None if whole else nodes, rule.part(tree)
    tasks = max(1, min(len(open_), -(-int(size[open_].sum()) // TASK)))

    def send(block: Block) -> Iterator[tuple[int, tuple]]:
        step = max(1, (1 << 18) // max(1, len(block.y)))
        x = squeezed(np.ascontiguousarray(block.x.T), bins)
        for lo in range(0, len(roots), step):
            some = roots[lo:lo + step]
            used, a, b = evidence(block, some)
            for i, r in enumerate(some.tolist()):
                at = np.flatnonzero(used[i])
                if top is None:
                    if len(at) and number[r] >= 0:
                        yield int(number[r]), (x[at], a[i, at], b[i, at])
                    continue
                node = number[top.walk(block.x[:, at], some[i:i + 1])[0]]
                at, node = at[node >= 0], node[node >= 0]
                for number_, mine in by_number(node):
                    mine = at[mine]
                    yield number_, (x[mine], a[i, mine], b[i, mine])

    def build(items) -> Iterator[tuple[list[int], Nodes]]:
        groups: dict[int, list[tuple]] = {}         # about ``TASK`` records
        for number_, part_ in items:
            groups.setdefault(number_, []).append(part_)
        held, records = [], 0
        for number_, parts in sorted(groups.items()):
            held.append((number_, parts))
            records += sum(len(p[1]) for p in parts)
            if records >= BATCH:
                yield _batch(held)
                held, records = [], 0
        if held:
            yield _batch(held)

    def _batch(held):
        ids = np.array([h[0] for h in held])
        parts = [(i, p) for i, (_, ps) in enumerate(held) for p in ps]
        x = widened(np.concatenate([p[0] for _, p in parts]), bins)
        a, b = (np.concatenate([p[k] for _, p in parts]).astype(np.float64) for k in (1, 2))
        root = np.repeat([i for i, _ in parts], [len(p[1]) for _, p in parts])
        sub = grow_local(x, root, a, b, keys[ids], left[ids], part.part(ids), bins)
        return ids.tolist(), Nodes(key=None, **{f: getattr(sub, f).astype(t) for f, t in NARROW.items()})

    def gains(items) -> Iterator[np.ndarray]:
        total = np.zeros((len(roots), dim))
        for ids, sub in build(items):
            total += _gains(sub, tree[np.array(ids)], len(roots), dim)
        yield total

    sent = blocks.flatMap(send).partitionBy(tasks, int).mapPartitions(gains if only_gains else build) if len(open_) else None
    if kept is not None:
        return nodes, _kept(blocks, sent, nodes, number, tree, kept)
    if only_gains:
        out = _gains(nodes, roots, len(roots), dim)
        out = out if sent is None else out + sent.treeReduce(lambda p, q: p + q)
    else:
        out = _attached(nodes, open_, [] if sent is None else sent.collect())       # the trees
    if after is not None:
        after()
    return out


def _kept(blocks, sent, nodes: Nodes, number: np.ndarray, tree: np.ndarray, kept: Callable) -> np.ndarray:
    """Hand over the pieces; the numbers of all leaves of the top, which are pieces of one node where no task goes on."""
    closed = np.flatnonzero((nodes.feature < 0) & (number < 0))
    numbers = len(tree) + np.arange(len(closed))
    out = number.copy()         # the tasks' own stay as they are
    out[closed] = numbers
    leaf = Nodes.leaves(np.arange(len(closed)), None, nodes.a[closed], nodes.b[closed])
    kept(blocks.context.emptyRDD() if sent is None else sent, np.concatenate([tree, nodes.root[closed]]),
         [(numbers.tolist(), leaf)] if len(closed) else [])
    return out


def squeezed(x: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Records (records x features) with a bit for each feature of two bins, behind the others: they are sent once a tree."""
    two = bins <= 2
    return np.concatenate([x[:, ~two], np.packbits(x[:, two], axis=1)], axis=1)


def widened(x: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The records of :func:`squeezed`."""
    two = bins <= 2
    out, n = np.empty((len(x), len(bins)), np.uint8), np.count_nonzero(~two)
    out[:, ~two] = x[:, :n]
    if two.any():
        out[:, two] = np.unpackbits(x[:, n:], axis=1, count=np.count_nonzero(two))
    return out


def by_number(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places where it is), rising; all numbers are 0 or more."""
    order = np.argsort(number, kind="stable")
    number = number[order]
    edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(number[lo]), order[lo:hi]


def _gains(nodes: Nodes, tree: np.ndarray, n: int, dim: int) -> np.ndarray:
    """(trees, features) sums of the nodes' gains; ``tree`` numbers the tree of each root of ``nodes``."""
    at = np.flatnonzero(nodes.feature >= 0)
    cell = tree[nodes.root[at]] * dim + nodes.feature[at]
    return np.bincount(cell, nodes.gain[at].astype(NARROW["gain"]), n * dim).reshape(n, dim)


def _attached(nodes: Nodes, open_: np.ndarray, grown: list[tuple[list[int], Nodes]]) -> Nodes:
    """The nodes with finished trees (roots 0, 1, ...) in the place of the leaves ``open_``, in narrow types and without keys."""
    out = {f: [getattr(nodes, f).astype(t)] for f, t in NARROW.items()}
    base = len(nodes.root)
    while grown:
        ids, sub = grown.pop()
        at, k = open_[np.array(ids)], len(ids)
        left = np.where(sub.feature >= 0, sub.left - k + base, 0)
        for f in ("a", "b", "feature", "cut", "gain"):
            out[f][0][at] = getattr(sub, f)[:k]
            out[f].append(getattr(sub, f)[k:])
        out["left"][0][at] = left[:k]
        out["left"].append(left[k:].astype(np.int32))
        out["root"].append(nodes.root[at][sub.root[k:]].astype(np.int32))
        base += len(sub.root) - k
    return Nodes(key=None, **{f: np.concatenate(parts) for f, parts in out.items()})


def _levels(nodes: Nodes) -> np.ndarray:
    out = np.zeros(len(nodes.root), np.int64)
    for k in np.flatnonzero(nodes.feature >= 0).tolist():       # parents come before their children
        out[nodes.left[k]:nodes.left[k] + 2] = out[k] + 1
    return out


def _summed(blocks, sums, few: bool) -> np.ndarray:
    """Sum over all blocks; ``few``: the tasks' sums go straight to the driver."""
    def part(it):
        total = None
        for b in it:
            s = sums(b)
            total = s if total is None else total + s
        if total is not None:
            yield total
    parts = blocks.mapPartitions(part)
    return parts.reduce(lambda p, q: p + q) if few else parts.treeReduce(lambda p, q: p + q)


def _columns(bins: np.ndarray, picks: "np.ndarray | None") -> list[tuple]:
    """(feature, first cell, cells) of a node's sums: every feature, or the ones tried at each node."""
    if picks is None:
        return [(j, int(lo), int(w)) for j, (lo, w) in enumerate(zip(np.cumsum(bins) - bins, bins, strict=True))]
    wide = int(bins.max(initial=1))
    return [(np.ascontiguousarray(picks[:, i]), i * wide, wide) for i in range(picks.shape[1])]


def _together(columns: list[tuple]) -> list[list[tuple]]:
    """Columns in groups that are counted at once, by their joint bins, and summed out: features of two values mostly."""
    out: list[list[tuple]] = []
    cells, open_ = JOINT + 1, None
    for c in columns:
        if isinstance(c[0], np.ndarray) or c[2] * 2 > JOINT:
            out.append([c])
            continue
        cells *= c[2]
        if cells > JOINT:
            cells, open_ = c[2], []
            out.append(open_)
        open_.append(c)
    return out


def _bin_sums(block: Block, evidence: Evidence, top: Nodes, front: np.ndarray, columns: list[tuple]) -> np.ndarray:
    """(front nodes, cells of ``columns``, 3): sums of a and b and the number of records."""
    slot = np.full(len(top.root), -1)
    slot[front] = np.arange(len(front))
    root = top.root[front]              # rising: a level's nodes follow their trees
    first = np.flatnonzero(np.diff(root, prepend=-1))
    last = np.append(first[1:], len(root))
    out = np.zeros((len(front), columns[-1][1] + columns[-1][2], 3))
    flat, n, groups = block.x.ravel(), len(block.y), _together(columns)
    for r, lo, hi in zip(root[first].tolist(), first.tolist(), last.tolist(), strict=True):
        used, a, b = evidence(block, np.array([r]))
        at = np.flatnonzero(used[0])
        s = slot[top.walk(block.x[:, at], np.array([r]))[0]]
        at, s = at[s >= 0], s[s >= 0] - lo
        a, b = a[0, at], b[0, at]
        # copies of records: the three sums of at most 2 ** 14 records fit in one double
        packed = a.astype(np.float64) * 2.0 ** 15 + b * 2.0 ** 33 + 1.0 if a.dtype == np.uint8 and n <= 1 << 14 else None
        # second derivatives are not negative: their sum and the number of records fit in one double as well
        counted = b + _COUNT if packed is None and n <= 1 << 14 and int(b.max(initial=0)) * n < _COUNT else None
        if packed is None:
            a, b = a.astype(np.float64), b.astype(np.float64)

        def sums(code: np.ndarray, w: int) -> np.ndarray:
            """(nodes, w, 3) sums of the records by code."""
            cell, cells = s * w + code, (hi - lo) * w
            if counted is not None:
                h = np.bincount(cell, counted, cells)
                records = np.floor(h / _COUNT)
                found = np.bincount(cell, a, cells), h - records * _COUNT, records
            elif packed is None:
                found = tuple(np.bincount(cell, v, cells) for v in (a, b, None))
            else:
                h = np.bincount(cell, packed, cells).astype(np.int64)
                found = h >> 15 & 0x3FFFF, h >> 33, h & 0x7FFF
            return np.stack(found, axis=-1).reshape(hi - lo, w, 3)

        for group in groups:
            if len(group) == 1:
                feature, to, w = group[0]
                f = feature[lo:hi].take(s) * n if isinstance(feature, np.ndarray) else feature * n
                out[lo:hi, to:to + w] += sums(flat.take(f + at), w)
                continue
            code, wide = 0, [w for _, _, w in group]
            for feature, _, w in group:
                code = code * w + block.x[feature]      # less than ``JOINT``
            h = sums(code.take(at), int(np.prod(wide))).reshape(hi - lo, *wide, 3)
            for i, (_, to, w) in enumerate(group):
                out[lo:hi, to:to + w] += h.sum(axis=tuple(j + 1 for j in range(len(wide)) if j != i))
    return out
