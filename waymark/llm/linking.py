"""Links between similar sets, and what they connect, without all pairs of a group.

Candidates come as memberships in nodes: two members of a node may be similar. The task that
has the members of a node compares the sketches of all of them. If few pairs of the node may
be similar, they are compared whole one by one. Else it is searched in two steps. Every member is
compared with a few pivots; that connects most of a group of copies by a few times as many pairs
as it has members. Then, of the members that are not connected yet, all pairs are compared as
blocks of whole sets, of which a task gives only the links that connect something new. A node too
large for that is branched further, after its pivots, and its children are searched in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, release, store, together

#: Members of a node whose sketches one task compares, all with all. Larger nodes branch.
LIMIT = 4096
#: The pairs of a node that may be similar are compared one by one if there are at most so many
#: for each member.
PASSING_PER_MEMBER = 16
#: In a node that branches, the sketches of unconnected pairs are compared if there are at most so
#: many for each member.
PAIRS_PER_MEMBER = 512
#: Members of a block, and elements of their sets, on average at most.
BLOCK, ELEMENTS = 512, 1 << 20
#: Rows of members that a task takes up at a time, about, and sketches that it compares with
#: all others of a node at a time.
TAKEN, ROWS_AT_ONCE = 1 << 16, 256
#: Rows of members that Spark hands over at a time.
BATCH = 1 << 14
#: A branch selects as many minwise values together as make children of so many members
#: likely, but no more than STEPS.
CHILD, STEPS = 128, 8
#: Children in which two members of the least similarity meet again, on average: they
#: meet in one at least with a probability of 1 - exp(-MEETINGS).
MEETINGS = 2.0
#: Elements whose occurrences are multiplied at a time.
COLUMNS = 2048
#: Members of a node that all the others are compared with.
PIVOTS = 4
#: Pairs of nodes of at most so many members are made side by side.
SMALL = 32


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b: long): root is the smallest node that can be
    reached. Large-star and small-star steps alternate until nothing changes; each is
    a grouping by minimum and a join, so a hub's neighbours never meet in one row."""
    e = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = store(e, "cc-edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = store(
            both.where(F.col("v") > F.col("u")).join(low, "u").select(
                F.col("v").alias("u"), F.col("m").alias("v")
            ),
            "cc-large",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where(F.col("u") != F.col("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, e = e, store(small.distinct(), "cc-small")
        release(old, large)
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    seen = e.select(F.col("u").alias("x"), "v").unionByName(
        e.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v"))
    )
    wrong = seen.groupBy("x").agg(
        F.min("v").alias("least"), F.max("v").alias("most"),
        F.max(F.col("v").isNull()).alias("ends"),
    ).where(
        (F.col("least") != F.col("most")) | (F.col("ends") & F.col("least").isNotNull())
    )
    return wrong.isEmpty()


#: Low bits of the minwise values in a sketch, and values in each of its two numbers.
LANE_BITS, LANES = 4, 16


def sketches(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each row of `tokens` (rows x 2 * LANES minwise values): the low
    bits of the values side by side."""
    low = tokens & np.uint64((1 << LANE_BITS) - 1)
    places = np.arange(LANES, dtype=np.uint64) * np.uint64(LANE_BITS)
    pack = lambda x: np.bitwise_or.reduce(x << places, axis=1).view(np.int64)
    return pack(low[:, :LANES]), pack(low[:, LANES : 2 * LANES])


def _differing(a: Column, b: Column) -> Column:
    """Lanes in which two numbers differ."""
    x = a.bitwiseXOR(b)
    for step in (2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def compatible(a: Column, b: Column, percent: int, differ: int) -> Column:
    """Whether two infos (n, s1, s2) may be similar: the sizes allow it, and the sketches
    differ in `differ` places at most."""
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return sizes & (_differing(a["s1"], b["s1"]) + _differing(a["s2"], b["s2"]) <= differ)


def allowed(percent: int, lost: float = 1e-5) -> int:
    """Lanes of 2 * LANES in which similar sets differ at most, but for a share of `lost`
    of them: each differs with a probability of (1 - similarity) * (1 - 2 ** -LANE_BITS)."""
    n, p = 2 * LANES, (1 - percent / 100) * (1 - 2.0**-LANE_BITS)
    tail, k = 0.0, n
    while k > 0:
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > lost:
            break
        k -= 1
    return k


def draws(level: int, percent: int, values: int) -> Column:
    """The places, among so many minwise values, that each child of a node (node, steps)
    selects: arrays of `steps` places, as many as let similar members meet MEETINGS times."""
    expected = F.lit(MEETINGS) * F.pow(F.lit(100 / percent), F.col("steps"))
    chance = F.pmod(F.xxhash64("node", F.lit(f"{level}:more")), F.lit(10_000)) / 10_000
    children = F.floor(expected + chance).cast("int")
    place = lambda i, j: F.pmod(F.xxhash64("node", F.lit(level), i, j), F.lit(values)).cast("int")
    return F.transform(
        F.sequence(F.lit(1), children),
        lambda i: F.transform(F.sequence(F.lit(1), F.col("steps")), lambda j: place(i, j)),
    )


def _far(x: np.ndarray) -> np.ndarray:
    """Lanes in which two numbers differ, of x their exclusive or."""
    x = x | (x >> np.uint64(2))
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111))


class _Members:
    """Members of nodes, rows side by side: node, id, n, s1, s2."""

    def __init__(self, columns: list[np.ndarray], percent: int, differ: int) -> None:
        self.node, self.id, self.n, self.s1, self.s2 = columns
        self.percent, self.differ = percent, differ

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows (a, b) may be similar, as `compatible` has it."""
        far = _far(self.s1[a] ^ self.s1[b]) + _far(self.s2[a] ^ self.s2[b])
        low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        return (far <= self.differ) & (low * 100 >= high * self.percent)

    def side_by_side(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows of one node that may be similar; `end` is that of a row's node,
        or 0 for rows to leave out."""
        a = np.flatnonzero(end > np.arange(len(end)) + 1)
        one, two, step = [a[:0]], [a[:0]], 1
        while len(a):
            good = a[self.similar(a, a + step)]
            one.append(good)
            two.append(good + step)
            step += 1
            a = a[a + step < end[a]]
        return np.concatenate(one), np.concatenate(two)

    def near(self, first: int, end: int) -> np.ndarray:
        """Which members of one node may be similar, as a square of booleans."""
        m, s1 = end - first, self.s1[first:end]
        out = np.zeros((m, m), dtype=bool)
        for i in range(0, m, ROWS_AT_ONCE):
            a, b = np.nonzero(_far(s1[i : i + ROWS_AT_ONCE, None] ^ s1[None, i:]) <= self.differ)
            later = b > a
            a, b = a[later] + i, b[later] + i
            good = self.similar(a + first, b + first)
            out[a[good], b[good]] = True
        return out | out.T


def _pivots(near: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of every member with those of the few most met pivots that it may be similar to. One
    that is near none of them is paired with its most met neighbour."""
    degree = near.sum(axis=1)
    left, one, two = degree > 0, [], []
    for _ in range(pivots):
        pivot = int(np.argmax(near[:, left].sum(axis=1)))
        others = np.flatnonzero(near[pivot])
        one.append(np.full(len(others), pivot))
        two.append(others)
        left[others] = left[pivot] = False
        if not left.any():
            break
    alone = np.flatnonzero(left)
    one.append(alone)
    two.append(np.array([np.argmax(near[i] * degree) for i in alone], dtype=np.int64))
    return np.concatenate(one), np.concatenate(two)


#: What a row of `_compared` is: a pair of ids, or node and id of a member of a node of many pairs,
#: of which the pairs with pivots are given, or of a node of more than LIMIT members.
PAIR, MANY, LARGE = 0, 1, 2


def _compared(members: DataFrame, percent: int, differ: int) -> DataFrame:
    """kind, a, b: what the nodes of `members` (node, id, n, s1, s2) hold, by their sketches.
    The table is stored."""
    limit, passing, pivots, small = LIMIT, PASSING_PER_MEMBER, PIVOTS, SMALL
    columns = ("node", "id", "n", "s1", "s2")

    def compare(taken: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        # Most nodes have one row only.
        same = taken[0][1:] == taken[0][:-1]
        met = np.append(same, False) | np.append(False, same)
        taken = [c[met] for c in taken]
        order = np.lexsort((taken[1], taken[0]))
        node, number = taken[0][order], taken[1][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (number[1:] != number[:-1])
        x = [c[order[new]] for c in taken]
        starts = np.append(True, x[0][1:] != x[0][:-1])[: len(x[0])]
        size = np.diff(np.append(np.flatnonzero(starts), len(starts)))
        met = np.repeat(size > 1, size)
        large = np.repeat(size > limit, size)
        yield LARGE, x[0][large], x[1][large]
        x, size = [c[met & ~large] for c in x], size[(size > 1) & (size <= limit)]
        all_ = _Members([*x[:3], *(c.view(np.uint64) for c in x[3:])], percent, differ)
        end = np.cumsum(size)
        one, two = all_.side_by_side(np.repeat(np.where(size <= small, end, 0), size))
        owner = np.repeat(np.arange(len(size)), size)
        many = np.bincount(owner[one], minlength=len(size)) > passing * size
        few = ~many[owner[one]]
        yield PAIR, all_.id[one[few]], all_.id[two[few]]
        for i in np.flatnonzero(many | (size > small)).tolist():
            ids = all_.id[end[i] - size[i] : end[i]]
            near = all_.near(end[i] - size[i], end[i])
            if np.count_nonzero(near) <= 2 * passing * size[i]:
                one, two = np.nonzero(np.triu(near))
            else:
                one, two = _pivots(near, pivots)
                some = ids[near.any(axis=1)]
                yield MANY, np.full(len(some), all_.node[end[i] - 1]), some
            yield PAIR, ids[one], ids[two]

    def finished(
        taken: list[np.ndarray], going: int | None
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        # The rest of a large node that was going on comes first.
        more = int((taken[0] == going).sum()) if going is not None else 0
        yield LARGE, taken[0][:more], taken[1][:more]
        if more < len(taken[0]):
            yield from compare([c[more:] for c in taken])

    def made(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, a, b in found:
            if not len(a):
                continue
            # A pair has the smaller id first.
            a, b = (np.minimum(a, b), np.maximum(a, b)) if kind == PAIR else (a, b)
            kinds = np.full(len(a), kind, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kinds, a, b)], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nodes come one after another; the last of the rows at hand may go on.
        held: list[list[np.ndarray]] = []
        rows, going = 0, None  # the node of more than `limit` members that is going on
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in columns])
                rows += batch.num_rows
            if rows < TAKEN:
                continue
            taken = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = taken[0][-1]
            cut = int(np.flatnonzero(taken[0] == last)[0])
            done, rest = [c[:cut] for c in taken], [c[cut:] for c in taken]
            yield from made(finished(done, going))
            _, first = np.unique(rest[1], return_index=True)
            if going == last or len(first) > limit:
                going = last
                yield from made([(LARGE, rest[0], rest[1])])
                held, rows = [], 0
            else:
                going, held, rows = None, [[c[first] for c in rest]], len(first)
        if held:
            yield from made(finished([np.concatenate(c) for c in zip(*held, strict=True)], going))

    ordered = for_python(members.select(*columns)).repartition("node").sortWithinPartitions("node")
    # These rows are short: Python may be handed more of them at a time than of texts.
    conf, name = members.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH))
    try:
        return store(ordered.mapInArrow(run, "kind int, a long, b long"), "link-found")
    finally:
        conf.set(name, before)


def link(
    members: DataFrame,
    infos: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    whole: Callable[[DataFrame], DataFrame],
    decode: Callable[[list], list[np.ndarray]],
    branch: Callable[[DataFrame, int], DataFrame],
    percent: int,
    levels: int,
) -> DataFrame:
    """node, root of every linked id: components of the similar ids that meet in nodes.

    members: node, id, n, s1, s2. infos: id, n, s1, s2 (`sketches`). `verify` keeps the similar
    of distinct pairs (a, b). `whole` gives id, body, weight (about the elements) of ids (id),
    and `decode` makes the sets of bodies, as arrays of numbers that agree within one call.
    `branch` gives the memberships in the children of nodes (node, id, steps) at a level, by
    the places of `draws`; past
    `levels` all unconnected pairs of a node are compared, however many. Similar means a
    Jaccard similarity of `percent` or more.
    """
    level, differ = 1, allowed(percent)
    search = _Search(verify)
    while True:
        found = _compared(members, percent, differ)
        of = lambda kind: found.where(F.col("kind") == kind).select(
            F.col("a").alias("node"), F.col("b").alias("id")
        )
        pairs = found.where(F.col("kind") == PAIR).select("a", "b")
        larger = not of(LARGE).isEmpty()
        if larger:
            large, star, share = _by_pivots(of(LARGE).distinct(), infos, percent, differ)
            pairs = pairs.unionByName(star)
        search.add(pairs)
        _compare_many(search, of(MANY), whole, decode, percent)
        if not larger:
            release(found)
            return search.known()
        work = _left(search, large, share, level >= levels)
        release(found, large)
        sparse = work.where(F.col("way") == "pairs")
        one, two = sparse.alias("x"), sparse.where(F.col("part") != F.col("main")).alias("y")
        # One of a pair is outside the node's main part; if both are, the pair is met once.
        pairs = one.join(
            two,
            (F.col("x.node") == F.col("y.node"))
            & (F.col("x.part") != F.col("y.part"))
            & ((F.col("x.part") == F.col("x.main")) | (F.col("x.id") < F.col("y.id")))
            & compatible(F.col("x.info"), F.col("y.info"), percent, differ),
        ).select(
            F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
        )
        search.add(pairs)
        dense = work.where(F.col("way") == "blocks").select("node", "id", "part", "main")
        if not dense.isEmpty():
            search.join(_by_blocks(dense, whole(dense.select("id")), decode, percent))
        many = work.where(F.col("way") == "branch")
        if level >= levels or many.isEmpty():
            release(work)
            return search.known()
        before = [members] if level > 1 else []
        members = store(
            branch(many.select("node", "id", "steps"), level).distinct().join(infos, "id"), "link-members"
        )
        release(work, *before)
        level += 1


def _compare_many(
    search: _Search, many: DataFrame, whole: Callable[[DataFrame], DataFrame],
    decode: Callable[[list], list[np.ndarray]], percent: int,
) -> None:
    """Compare what the pivots left unconnected in the nodes of `many` (node, id)."""
    if many.isEmpty():
        return
    work = _placed(search, many)
    left = _mains(work).where(F.col("open") > 0).select("node", "main")
    work = store(work.join(left, "node").select("node", "id", "part", "main"), "link-open")
    if not work.isEmpty():
        search.join(_by_blocks(work, whole(work.select("id")), decode, percent))
    release(work)


def _placed(search: _Search, members: DataFrame) -> DataFrame:
    """`members`, with the part that connects each by now."""
    known = search.known().withColumnRenamed("node", "id")
    return members.join(known, "id", "left").withColumn("part", F.coalesce("root", "id"))


def _mains(placed: DataFrame) -> DataFrame:
    """node, size, main (largest part), open (unconnected pairs) of nodes."""
    parts = placed.groupBy("node", "part").agg(F.count(F.lit(1)).alias("k"))
    return parts.groupBy("node").agg(
        F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("squares"),
        F.max_by("part", F.struct("k", "part")).alias("main"),
    ).withColumn("open", (F.col("size") * F.col("size") - F.col("squares")) / 2)


def _by_pivots(
    large: DataFrame, infos: DataFrame, percent: int, differ: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The members of large nodes with their infos, the pairs with pivots that may be similar, and,
    of each node, the share of such pairs and how far they are apart."""
    info = F.struct("n", "s1", "s2").alias("info")
    # What most members resemble is met in many large nodes: it makes a good pivot.
    size = large.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    fame = large.join(size, "node").groupBy("id").agg(F.sum("size").alias("fame"))
    crowd = large.join(infos.join(fame, "id").select("id", info, "fame"), "id")
    crowd = store(crowd.select("node", "id", "fame", "info"), "link-crowd")
    pivots = crowd.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("turn")).agg(
        F.max(F.struct("fame", "id", "info")).alias("p")
    ).select("node", F.col("p.id").alias("pivot"), F.col("p.info").alias("pivot_info"))
    near = crowd.select("node", "id", "info").join(pivots, "node").where(
        F.col("id") != F.col("pivot")
    ).withColumn("near", compatible(F.col("info"), F.col("pivot_info"), percent, differ))
    apart = (
        _differing(F.col("info.s1"), F.col("pivot_info.s1"))
        + _differing(F.col("info.s2"), F.col("pivot_info.s2"))
    ) / (2 * LANES * (1 - 2.0**-LANE_BITS))
    share = near.groupBy("node").agg(
        F.avg(F.col("near").cast("double")).alias("share"), F.avg(apart).alias("apart")
    )
    star = near.where("near").select(
        F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")
    )
    return crowd, star, share


def _left(search: _Search, crowd: DataFrame, share: DataFrame, last: bool) -> DataFrame:
    """What is left in each large node that its pivots have not connected, and the way to go on."""
    placed = _placed(search, crowd)
    passing = F.col("open") * F.col("share")
    sparse = (F.col("open") <= F.col("size") * PAIRS_PER_MEMBER) & (
        passing <= F.col("size") * PASSING_PER_MEMBER
    )
    # Of members with a similarity of s, a share of sqrt(s) can agree in one value.
    alike = F.least(F.greatest(1 - F.col("apart"), F.lit(0.01)), F.lit(0.95))
    steps = F.ceil(F.log(F.col("size") / CHILD) / (-0.5 * F.log(alike)))
    left = _mains(placed).where(F.col("open") > 0).join(share, "node").withColumn(
        "way", F.when(sparse, "pairs").when(F.lit(last), "blocks").otherwise("branch")
    ).withColumn(
        "steps", F.least(F.greatest(steps, F.lit(1)), F.lit(STEPS)).cast("int")
    )
    return store(
        placed.join(left.select("node", "main", "way", "steps"), "node").select(
            "node", "id", "part", "main", "way", "steps", "info"
        ),
        "link-open",
    )


def _by_blocks(
    work: DataFrame, sets: DataFrame, decode: Callable[[list], list[np.ndarray]], percent: int
) -> DataFrame:
    """a, b of links between parts of the nodes of `work` (node, id, part, main), as many as
    connect what any links connect. A member goes to one block of its node; pairs of blocks
    are compared, but for those of the main part, which is connected."""
    sized = work.join(sets.select("id", "weight"), "id").withColumn(
        "inner", F.col("part") == F.col("main")
    )
    of = lambda inner: F.ceil(
        F.greatest(
            F.count_if(inner) / BLOCK, F.sum(F.when(inner, F.col("weight"))) / ELEMENTS, F.lit(1)
        )
    )
    blocks = sized.groupBy("node").agg(
        of(F.col("inner")).alias("inner_blocks"), of(~F.col("inner")).alias("outer_blocks")
    )
    draw = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), F.col(n))
    # The blocks of the main part have negative numbers and meet only the others.
    block = F.when(F.col("inner"), -1 - draw("inner_blocks")).otherwise(draw("outer_blocks"))
    first = F.when(F.col("inner"), F.lit(0)).otherwise(-F.col("inner_blocks"))
    dealt = sized.join(blocks, "node").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(first, F.col("outer_blocks") - 1))
    )
    dealt = dealt.select(
        "id", "node", "part", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") <= F.col("other")).alias("x"), (F.col("block") >= F.col("other")).alias("y"),
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _connecting(rows, decode, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return for_python(dealt).join(sets.select("id", "body"), "id").groupBy(
        "node", "low", "high"
    ).applyInPandas(run, "a long, b long")


def _connecting(
    rows: pd.DataFrame, decode: Callable[[list], list[np.ndarray]], percent: int
) -> list[tuple[int, int]]:
    """Links between a row of x and a row of y that connect the parts of the rows."""
    sets = decode(rows["body"].tolist())
    size = np.array([len(s) for s in sets])
    x, y = np.flatnonzero(rows["x"]), np.flatnonzero(rows["y"])
    if not len(x) or not len(y):
        return []
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # An element of one set only is in no intersection.
    place, meets = np.cumsum(count > 1) - 1, (count > 1)[number]
    owner, number = np.repeat(np.arange(len(sets)), size)[meets], place[number[meets]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros((len(x), len(y)), dtype=np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(number, (start, start + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[low:high], number[low:high] - start] = 1
        shared += has[x] @ has[y].T
    shared = shared.astype(np.int64)
    part, codes = np.unique(rows["part"], return_inverse=True)
    similar = 100 * shared >= percent * (size[x][:, None] + size[y] - shared)
    similar &= codes[x][:, None] != codes[y]
    ids, above, found = rows["id"].to_numpy(), list(range(len(part))), []

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for i, j in zip(*(k.tolist() for k in np.nonzero(similar)), strict=True):
        one, two = top(codes[x[i]]), top(codes[y[j]])
        if one != two:
            above[one] = two
            found.append((int(ids[x[i]]), int(ids[y[j]])))
    return found


class _Search:
    """The pairs compared so far and the components of the links among them."""

    def __init__(self, verify: Callable[[DataFrame], DataFrame]) -> None:
        self.verify = verify
        self.seen: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.parts: DataFrame | None = None

    def add(self, pairs: DataFrame, *done: DataFrame) -> None:
        """Compare pairs; stored tables that nothing but they are made of, `done`, go before."""
        pairs = pairs.distinct()
        if self.seen:
            pairs = pairs.join(together(self.seen), ["a", "b"], "left_anti")
        pairs = store(pairs, "link-pairs")
        release(*done)
        if self.seen and pairs.isEmpty():
            release(pairs)
            return
        self.seen.append(pairs)
        self.join(self.verify(pairs))

    def join(self, links: DataFrame) -> None:
        good = store(links, "link-good")
        first = not self.links and self.parts is None
        if first or not good.isEmpty():
            self.links.append(good)

    def known(self) -> DataFrame:
        """node, root of all linked ids."""
        if self.links or self.parts is None:
            edges = together(self.links)
            if self.parts is not None:
                edges = edges.unionByName(
                    self.parts.select(F.col("root").alias("a"), F.col("node").alias("b"))
                )
            self.parts = store(components(edges), "link-known")
            self.links = []
        return self.parts
