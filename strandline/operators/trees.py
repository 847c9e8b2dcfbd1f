"""Extremely randomised regression trees, for many independent training sets (`fold`) at once.

At each node every feature gets one cut point, drawn between its least and largest value among the node's rows, and the cut of largest reduction of variance is taken that leaves at least
`leaf` rows on either side; without one the node is a leaf, as it is if all its targets are equal. Every row is in every tree. A row that is asked about descends
along with the training rows, so no tree is ever stored, and its prediction is the mean over the leaves it reaches.

A node is a hash of its path and its draws are hashes of the node, so trees don't depend on how rows are dealt out, and a task that is run again grows the same trees. As long as
a node has over LOCAL rows, levels are grown by two aggregations over (fold, tree, node) for all trees at once: ranges of the features, then counts and sums on one side of each cut. Nodes of
at most LOCAL rows are finished in one task each, or, where no fold has more rows than that, some trees of a fold in one task, level by level in arrays.

Where each fold leaves out one owner of rows, `left_out` grows a tree for all folds together: a node is one for all folds whose rows are the same but for their own, its counts and sums
less an owner's are those of the owner's fold, folds part where they choose other cuts, and a fold is only followed to where its own rows go. So a tree costs what its rows cost, not rows
times folds.

Defined results: gains are compared to nine digits, the first feature of equal ones is taken; folds without training rows predict null; features must not be null; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import dropped, stored

#: Rows of a node that one task grows, and of all nodes that it holds at a time.
LOCAL, HELD = 1_000_000, 400_000
#: Trees of a task, and parts that tasks are dealt into.
CHUNK, PARTS = 4, 256
# Constants of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of longs with a seed each, as Spark's xxhash64 chains it over columns."""
    h = seed + P5 + np.uint64(8)
    h = rotated(h ^ rotated(x * P2, 31) * P1, 27) * P1 + P4
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def long_hash(*parts: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of long columns."""
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for x in parts:
            h = hashed(np.asarray(x, np.int64).astype(np.uint64), h)
    return h.astype(np.int64)


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 of hashes."""
    return (h.astype(np.uint64) >> np.uint64(11)) * 2.0**-53


def stepped(y: np.ndarray) -> np.ndarray:
    """Targets in steps of which all sums are exact, so that gains of cuts with the same rows on either side are equal in any order of adding."""
    size = np.abs(y).sum()
    step = 2.0 ** (np.ceil(np.log2(size)) - 51) if size > 0 else 1.0
    return np.round(y / step) * step


def grown(x: np.ndarray, y: np.ndarray, train: np.ndarray, nodes: np.ndarray, leaf: int) -> np.ndarray:
    """The mean over the subtrees below `nodes` of the leaves that each row with train = False reaches; all rows lie in all nodes."""
    out, features = np.zeros(len(x)), x.shape[1]
    own, asked = np.flatnonzero(train), np.flatnonzero(~train)
    if not len(own):
        return np.full(len(x), np.nan)
    y = stepped(np.where(train, y, 0.0))
    row, group = np.tile(own, len(nodes)), np.repeat(np.arange(len(nodes)), len(own))
    t_row, t_group = np.tile(asked, len(nodes)), np.repeat(np.arange(len(nodes)), len(asked))
    weight = 1 / len(nodes)
    while len(row):
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        n = np.diff(np.append(starts, len(row)))
        over = lambda f, v: f.reduceat(v, starts)  # noqa: B023, E731
        target = y[row]
        total = over(np.add, target)
        open_ = (n >= 2 * leaf) & (over(np.minimum, target) < over(np.maximum, target))
        gain, feature, cut = np.full(len(n), -np.inf), np.zeros(len(n), int), np.zeros(len(n))
        for j in range(features):
            v = x[row, j]
            low, high = over(np.minimum, v), over(np.maximum, v)
            at = low + uniform(long_hash(nodes, j)) * (high - low)
            left = v <= at[group]
            k, s = over(np.add, left.astype(np.int64)), over(np.add, np.where(left, target, 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.round(s * s / k + (total - s) ** 2 / (n - k), 9)
            better = open_ & (low < high) & (k >= leaf) & (n - k >= leaf) & (np.nan_to_num(g, nan=-np.inf) > gain)
            gain[better], feature[better], cut[better] = g[better], j, at[better]
        split = np.isfinite(gain)
        done = ~split[t_group]
        np.add.at(out, t_row[done], weight * (total / n)[t_group[done]])
        child = np.cumsum(split) - 1  # the number of a node that is split, among these
        sides = []
        for r, g in ((row, group), (t_row, t_group)):
            stay = split[g]
            r, g = r[stay], g[stay]
            sides.append((r, 2 * child[g] + (x[r, feature[g]] > cut[g])))
        nodes = long_hash(np.repeat(nodes[split], 2), np.tile([-1, -2], split.sum()))
        (row, group), (t_row, t_group) = sides
        order = np.argsort(group, kind="stable")
        row, group = row[order], group[order]
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ranges one after the other, and the range of each."""
    who = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes), who


def left_out(u: np.ndarray, c: np.ndarray, asked: np.ndarray, owner: np.ndarray, kind: np.ndarray, y: np.ndarray, roots: np.ndarray, leaf: int) -> np.ndarray:
    """The sum over the trees of `roots` of what each row of an owner in `asked` is predicted from all other owners' rows; the features of a row are u[owner] and, in the fold without
    owner o, c[o, kind]. Rows are in order of owners, at most one of an owner and kind; an owner that is asked about has a row of each kind."""
    out, most = np.zeros(len(y)), max(1, HELD // max(1, len(y)))
    y = stepped(y)
    held = [(np.tile(np.arange(len(y)), len(r)), np.repeat(np.arange(len(r)), len(y)), np.tile(asked[owner], len(r)), r) for r in (roots[i : i + most] for i in range(0, len(roots), most))]
    while held:
        row, group, own, nodes = held.pop()
        if not len(row):
            continue
        if len(row) > HELD and len(nodes) > 1:
            middle = max(1, group[len(row) // 2])
            low = group < middle
            held += [(row[low], group[low], own[low], nodes[:middle]), (row[~low], group[~low] - middle, own[~low], nodes[middle:])]
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            held.append(left_out_level(u, c, owner, kind, y, leaf, row, group, own, nodes, out))
    return out


def left_out_level(u, c, owner, kind, y, leaf, row, group, own, nodes, out):
    """One level of `left_out`: adds up the leaves, and returns rows, nodes' numbers, whether the row's fold is followed there, and the nodes of the next level."""
    d, kinds = u.shape[1], c.shape[1]
    who, target = owner[row], y[row]
    starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (who[1:] != who[:-1]))))
    size = np.diff(np.append(starts, len(row)))  # of entries, one for each owner in a node
    e_owner, e_group, total = who[starts], group[starts], np.add.reduceat(target, starts)
    first = np.flatnonzero(np.concatenate(([True], e_group[1:] != e_group[:-1])))
    entries = np.diff(np.append(first, len(starts)))
    g_n, g_s = np.add.reduceat(size, first), np.add.reduceat(total, first)
    mine = np.flatnonzero(own[starts])  # the entries whose fold is followed: pairs of a fold and a node
    at, fold = e_group[mine], e_owner[mine]
    n, s_all = g_n[at] - size[mine], g_s[at] - total[mine]

    def least(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value of each pair's node without its own entry, and of each node."""
        one = np.minimum.reduceat(v, first)
        where = np.minimum.reduceat(np.where(v == one[e_group], np.arange(len(v)), len(v)), first)
        rest = v.copy()
        rest[where] = np.inf
        return np.where(where[at] == mine, np.minimum.reduceat(rest, first)[at], one[at]), one

    open_ = (n >= 2 * leaf) & (least(np.minimum.reduceat(target, starts))[0] < -least(-np.maximum.reduceat(target, starts))[0])
    gain, feature, cut = np.full(len(mine), -np.inf), np.zeros(len(mine), int), np.zeros(len(mine))

    def tried(j, cuts, wide, k, s):
        g = np.round(s * s / k + (s_all - s) ** 2 / (n - k), 9)
        better = open_ & wide & (k >= leaf) & (n - k >= leaf) & (np.nan_to_num(g, nan=-np.inf) > gain)
        gain[better], feature[better], cut[better] = g[better], j, cuts[better]

    for j in range(d):
        v = u[e_owner, j]
        (low, low_all), (high, high_all) = least(v), (-x for x in least(-v))
        if not (wide := low < high).any():
            continue
        part = uniform(long_hash(nodes, j))
        cuts, whole = low + part[at] * (high - low), low_all + part * (high_all - low_all)
        left = v <= whole[e_group]
        k, s = np.add.reduceat(np.where(left, size, 0), first)[at], np.add.reduceat(np.where(left, total, 0.0), first)[at]
        other = np.flatnonzero(open_ & wide & (cuts != whole[at]))  # the node's range is another without the owner
        place, pair = ragged(first[at[other]], entries[at[other]])
        inside = v[place] <= cuts[other][pair]
        k[other] = np.bincount(pair, np.where(inside, size[place], 0), len(other)).astype(k.dtype)
        s[other] = np.bincount(pair, np.where(inside, total[place], 0.0), len(other))
        self_ = v[mine] <= cuts
        tried(j, cuts, wide, k - np.where(self_, size[mine], 0), s - np.where(self_, total[mine], 0.0))
    pair_of = np.full(len(starts), -1)
    pair_of[mine] = np.arange(len(mine))
    pair_of = np.repeat(pair_of, size)
    own = pair_of >= 0
    of = lambda number, some, count, w=None: np.bincount(number[some] * kinds + kind[row[some]], None if w is None else w[some], count * kinds).reshape(count, kinds)
    every = np.ones(len(row), bool)
    k_n, k_s = of(group, every, len(nodes))[at] - of(pair_of, own, len(mine)), of(group, every, len(nodes), target)[at] - of(pair_of, own, len(mine), target)
    for f in range(c.shape[2]):
        v, there = c[fold, :, f], k_n > 0
        low, high = np.where(there, v, np.inf).min(1), np.where(there, v, -np.inf).max(1)
        cuts = low + uniform(long_hash(nodes, d + f))[at] * (high - low)
        left = v <= cuts[:, None]
        tried(d + f, cuts, low < high, (left * k_n).sum(1), (left * k_s).sum(1))
    split = np.isfinite(gain)
    done = own & ~split[pair_of]
    np.add.at(out, row[done], (s_all / n)[pair_of[done]])
    parted = np.flatnonzero(split)
    # Folds of a node stay together where they cut the same way: at the same value, or between the same kinds.
    code = cut[parted].view(np.int64).copy()
    by_kind = np.flatnonzero(feature[parted] >= d)
    if len(by_kind):
        p = parted[by_kind]
        sides = np.packbits(c[fold[p], :, feature[p] - d] <= cut[p][:, None], axis=1)
        code[by_kind] = np.unique(sides, axis=0, return_inverse=True)[1].reshape(-1)
    _, chosen, number = np.unique(np.stack((at[parted], feature[parted], code), 1), axis=0, return_index=True, return_inverse=True)
    chosen = parted[chosen]
    choice = np.full(len(mine), -1)
    choice[parted] = number.reshape(-1)
    row_first = starts[first]
    place, q = ragged(row_first[at[chosen]], g_n[at[chosen]])
    r, j = row[place], feature[chosen][q]
    value, kinded = np.empty(len(r)), j >= d
    value[~kinded] = u[owner[r[~kinded]], j[~kinded]]
    value[kinded] = c[fold[chosen][q[kinded]], kind[r[kinded]], j[kinded] - d]
    follows = own[place] & (choice[pair_of[place]] == q)
    child = 2 * q + (value > cut[chosen][q])
    kept = np.bincount(child[follows], minlength=2 * len(chosen)) > 0
    stay = np.flatnonzero(kept[child])
    stay = stay[np.argsort(child[stay], kind="stable")]
    children = long_hash(np.repeat(nodes[at[chosen]], 2), np.tile([-1, -2], len(chosen)))[kept]
    return r[stay], (np.cumsum(kept) - 1)[child[stay]], follows[stay], children


def extra_trees(rows: DataFrame, features: int, trees: int = 500, leaf: int = 3, seed: int = 17) -> DataFrame:
    """(fold, key, predicted) of rows (fold, key, train, x array<double>, y): the rows with train = false, predicted from those of their fold with train = true."""
    kinds = dict(rows.dtypes)
    shape = f"fold {kinds['fold']}, key {kinds['key']}, predicted double"
    rows = rows.select("fold", F.when(~F.col("train"), F.col("key")).alias("key"), "train", "x", F.col("y").cast("double").alias("y"))  # training rows need no key

    def finish(root):
        def run(part: pa.Table) -> pa.Table:
            train, y = part["train"].to_numpy(), np.nan_to_num(part["y"].to_numpy())
            x = part["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(train), features)
            nodes = root(part)
            most = max(1, HELD // len(train))
            found = sum(grown(x, y, train, nodes[i : i + most], leaf) * len(nodes[i : i + most]) for i in range(0, len(nodes), most))
            asked = part.filter(pa.array(~train))
            return pa.table({"fold": asked["fold"], "key": asked["key"], "predicted": found[~train], "n": np.full(len(asked), len(nodes), np.int32)})

        return run

    largest = rows.where("train").groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    if largest <= LOCAL:  # some trees of a fold are one task's
        chunk = max(1, min(trees, 16))
        dealt = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // chunk) - 1))))
        roots = lambda part: long_hash(seed, np.arange(c := part["c"][0].as_py() * chunk, min(trees, c + chunk)))
        found = dealt.repartition(PARTS, "fold", "c").groupBy("fold", "c").applyInArrow(finish(roots), shape + ", n int")
        return found.groupBy("fold", "key").agg((F.sum(F.col("predicted")) / F.sum(F.col("n"))).alias("predicted"))
    state = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.xxhash64(F.lit(seed).cast("long"), F.col("tree").cast("long")))
    at, done, held = ["fold", "tree", "node"], [], []
    while True:
        size = state.where("train").groupBy(*at).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.min("y").alias("y0"), F.max("y").alias("y1"), *[f(F.col("x")[j]).alias(f"{a}_{j}") for j in range(features) for a, f in (("lo", F.min), ("hi", F.max))])
        number = lambda j: F.shiftrightunsigned(F.xxhash64(F.col("node"), F.lit(j).cast("long")), 11) * F.lit(2.0**-53)
        cuts = F.array(*[F.col(f"lo_{j}") + number(j) * (F.col(f"hi_{j}") - F.col(f"lo_{j}")) for j in range(features)])
        wide = F.array(*[F.col(f"lo_{j}") < F.col(f"hi_{j}") for j in range(features)])
        big = F.col("n") > LOCAL
        nodes = size.select(*at, "n", "s", big.alias("big"), (big & (F.col("y0") < F.col("y1"))).alias("open"), cuts.alias("cuts"), wide.alias("wide"))
        met = stored(state.join(nodes, at), "state")
        held.append(met)
        small = met.where("not big").groupBy(*at).applyInArrow(finish(lambda part: part["node"].to_numpy()[:1]), shape + ", n int")
        done.append(small.drop("n"))
        left = [(F.col("x")[j] <= F.col("cuts")[j]) for j in range(features)]
        sums = met.where("open and train").groupBy(*at).agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("cuts").alias("cuts"), F.first("wide").alias("wide"), *[F.sum(left[j].cast("long")).alias(f"k_{j}") for j in range(features)], *[F.sum(F.when(left[j], F.col("y")).otherwise(0.0)).alias(f"s_{j}") for j in range(features)])

        def gain(j):
            k, s, n = F.col(f"k_{j}"), F.col(f"s_{j}"), F.col("n")
            g = F.round(s * s / k + (F.col("s") - s) * (F.col("s") - s) / (n - k), 9)
            return F.when(F.col("wide")[j] & (k >= leaf) & (n - k >= leaf), F.struct(g.alias("g"), F.lit(-j).alias("j"), F.col("cuts")[j].alias("cut")))

        best = sums.select(*at, F.array_max(F.filter(F.array(*[gain(j) for j in range(features)]), lambda z: z.isNotNull())).alias("b")).where("b is not null").select(*at, (-F.col("b.j")).alias("feature"), "b.cut")
        best = stored(best, "splits")
        held.append(best)
        top = met.where("big").join(best, at, "left")
        done.append(top.where("feature is null and not train").select("fold", "key", (F.col("s") / F.col("n")).alias("predicted")))
        right = F.col("x")[F.col("feature")] > F.col("cut")
        state = top.where("feature is not null").select("fold", "key", "train", "x", "y", "tree", F.xxhash64(F.col("node"), F.when(right, F.lit(-2)).otherwise(F.lit(-1)).cast("long")).alias("node"))
        if best.isEmpty():
            break
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.union(d)
    out = stored(leaves.groupBy("fold", "key").agg((F.sum("predicted") / F.lit(trees)).alias("predicted")), "leaves")
    for t in held:
        dropped(t)
    return out
