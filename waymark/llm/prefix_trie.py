"""The trie of the turns that conversations begin with, by truncation peeling.

A conversation is a sequence of turns (role, text). A node of depth d is a sequence of d
turns that some conversation begins with; the root is the empty one. Nodes are found from
the deepest up: at depth d, conversations that end there are merged with the nodes that
survived from depth d + 1 without their last turn, so that one grouping both discovers the
nodes of a depth and adds up what lies below them. Equal conversations are merged first and
then peeled as one. Turns at the end of a sequence that no other sequence shares make a chain
of nodes with one member each (or the copies of that sequence): these are given at once, and
the sequence joins the peeling where others may share it. So there are as many rounds as
different sequences agree on turns, not as the longest has turns, and each shuffles one row
per node and task.

A turn is known by 128 bits of hash of its role and text, not by the text, which is read once
and never shuffled. A conversation is one row from then on, of 24 bytes a turn.

Defined results. Rows without a conv_id belong to no conversation. Null roles and texts are
empty ones. Turns go by their number, null first; equal numbers by a hash of the turn, so
repeated rows are repeated turns. Only the four columns named are read. An empty table has
no conversation and gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.skew import skew_join

from .common import for_python, store

#: Ids in a piece of a long list whose digest is taken.
PIECE = 4096
NO_END = hashlib.sha256(b"").hexdigest()


def sequences(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, path) with path an array of (a, b, bytes) by turn: the hash of the turn
    and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    own = F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "a", "b", "bytes",
    )))
    path = F.transform("own", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes")))
    return turns.groupBy("conv_id").agg(own.alias("own")).select("conv_id", path.alias("path"))


def rebuilt(sequences: DataFrame, every: int = 5, longest: int = 8) -> DataFrame:
    """Conversations that begin alike: of each conversation c the first h turns are those
    of conversation c - c % `every`, with h = crc32(c as text) % (`longest` + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    own = sequences.select(
        "conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("first")
    )
    heads = sequences.select(F.col("conv_id").alias("first"), F.slice("path", 1, longest).alias("head"))
    head = F.coalesce("head", F.slice("path", 1, 0))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return own.join(heads, "first", "left").select(
        "conv_id", F.concat(F.slice(head, 1, F.col("h")), rest).alias("path")
    )


def _key(path: Column) -> list[Column]:
    """128 bits of hash of a path, the empty one included."""
    return [F.xxhash64(F.lit(i), F.size(path), path).alias(f"k{i}") for i in (1, 2)]


def _digest(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str]]:
    """The sha256 of the pieces of each unit, joined by commas; units come one by one."""
    unit, state = None, None
    for of, piece in pieces:
        if of != unit:
            if state is not None:
                yield unit, state.hexdigest()
            unit, state = of, hashlib.sha256(piece)
        else:
            state.update(b"," + piece)
    if state is not None:
        yield unit, state.hexdigest()


def id_digests(members: DataFrame) -> DataFrame:
    """(unit, ends_sha256) of (unit, conv_id): sha256 of its ids in ascending order, joined
    by commas. The ids of a unit are ordered and written in pieces by many tasks; the task
    that takes the digest, which must go through the list in order, reads the pieces one
    by one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [i for i in range(len(ids)) if not i or units[i] != units[i - 1]]
            cuts = sorted({*cuts, *range(0, len(ids), PIECE), len(ids)})
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([units[i] for i, _ in spans], pa.int64()),
                 pa.array([ids[i] for i, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, ids[i:j])) for i, j in spans], pa.string())],
                names=["unit", "first", "piece"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (u, p.encode())
            for batch in batches
            for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        )
        for unit, digest in _digest(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit], pa.int64()), pa.array([digest])], names=["unit", "ends_sha256"]
            )

    ordered = members.repartitionByRange("unit", "conv_id").sortWithinPartitions("unit", "conv_id")
    written = for_python(ordered.select("unit", "conv_id"), PIECE).mapInArrow(
        pieces, "unit bigint, first bigint, piece string"
    )
    together = written.repartition("unit").sortWithinPartitions("unit", "first")
    return together.select("unit", "piece").mapInArrow(digests, "unit bigint, ends_sha256 string")


def _shared_depth(units: DataFrame) -> DataFrame:
    """(unit, alone): the smallest power of two so that no other sequence begins with
    these first turns of the unit. Units that always have company are left out."""
    powers = F.expr("transform(sequence(0, length(bin(size(path))) - 1), k -> shiftleft(1, k))")
    probes = units.where(F.size("path") > 0).select("unit", "path", F.explode(powers).alias("depth"))
    probes = probes.select("unit", "depth", *_key(F.slice("path", 1, F.col("depth"))))
    counts = probes.groupBy("depth", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")
    )
    return counts.where("n = 1").groupBy("unit").agg(F.min("depth").alias("alone"))


def _tails(units: DataFrame) -> DataFrame:
    """The nodes below the depth `joins` of each unit, of which it is the only sequence."""
    steps = units.where(F.col("joins") < F.size("path")).select(
        "unit", "n", "joins", F.size("path").alias("length"),
        F.posexplode(F.expr("slice(path, joins + 1, size(path) - joins)")).alias("i", "turn"),
    )
    depth = F.col("joins") + F.col("i") + 1
    row = [
        "unit", "n", depth.alias("depth"), (depth < F.col("length")).cast("bigint").alias("n_children"),
        F.when(depth == F.col("length"), F.col("unit")).alias("ended"),
    ]
    single = steps.where("n = 1").select(*row, F.lit(0).cast("bigint").alias("saved"))
    # Only copies save anything: the sum of the turns from here to the end.
    order = F.expr("sum(turn.bytes) over (partition by unit order by i desc)")
    copies = steps.where("n > 1").select(*row, ((F.col("n") - 1) * order).alias("saved"))
    return single.unionByName(copies).select(
        F.col("unit").alias("conv_id"), "depth", F.col("unit").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.lit(1).cast("bigint").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ended", F.col("n").alias("n_ended"),
    )


def trie(sequences: DataFrame) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id (that of the node
    without the last turn; null for the root), n_convs, n_children, n_leaves (childless nodes in
    its subtree, itself included), saved_tokens (over its subtree, members but one times the
    bytes of the node's last text), ends_sha256 (of the ids of the members that end here)."""
    own = store(sequences.select("conv_id", "path", *_key(F.col("path"))), "trie-sequences")
    units = own.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("unit"), F.count(F.lit(1)).alias("n")
    )
    copied = store(units.where("n > 1"), "trie-copied")
    digests = store(
        id_digests(skew_join(own.select("k1", "k2", "conv_id"), copied.drop("n"), ["k1", "k2"], ["conv_id"])),
        "trie-digests",
    )
    # The path of a unit is that of its smallest member.
    units = own.select(F.col("conv_id").alias("unit"), "path").join(units.select("unit", "n"), "unit")
    units = store(units, "trie-units")
    alone = F.coalesce("alone", F.size("path"))
    units = store(
        units.join(_shared_depth(units), "unit", "left").select("unit", "n", "path", alone.alias("joins")),
        "trie-joins",
    )
    below = F.expr(
        "(n - 1) * aggregate(slice(path, joins + 1, size(path) - joins), 0L, (s, t) -> s + t.bytes)"
    )
    more = F.col("joins") < F.size("path")
    starts = store(
        units.select(
            F.col("joins").alias("depth"), F.slice("path", 1, F.col("joins")).alias("path"),
            F.col("unit").alias("conv_id"), F.col("n").alias("n_convs"),
            more.cast("bigint").alias("n_children"), more.cast("bigint").alias("leaves"),
            below.alias("below"), F.when(~more, F.col("unit")).alias("ended"),
            F.when(~more, F.col("n")).alias("n_ended"),
        ),
        "trie-starts",
    )
    deepest = starts.agg(F.max("depth")).first()[0]
    nodes, level = [], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = starts.where(F.col("depth") == depth).drop("depth")
        if level is not None:
            rows = rows.unionByName(level.select(
                F.slice("path", 1, depth).alias("path"), "conv_id", "n_convs",
                F.lit(1).cast("bigint").alias("n_children"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("below"), F.lit(None).cast("bigint").alias("ended"),
                F.lit(None).cast("bigint").alias("n_ended"),
            ))
        merged = rows.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("leaves").alias("leaves"),
            F.sum("below").alias("below"), F.max("ended").alias("ended"), F.max("n_ended").alias("n_ended"),
        )
        size = F.coalesce(F.try_element_at("path", F.lit(-1))["bytes"], F.lit(0))
        level = store(
            merged.select(
                "path", "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children",
                F.greatest("leaves", F.lit(1)).alias("n_leaves"),
                (F.col("below") + (F.col("n_convs") - 1) * size).alias("saved_tokens"),
                "ended", "n_ended", *_key(F.col("path")),
            ),
            f"trie-{depth}",
        )
        nodes.append(level)
    out = [_tails(units)]
    for parents, children in zip(nodes[1:], nodes[:-1], strict=True):
        parent = F.slice("path", 1, F.col("depth") - 1)
        named = children.drop("k1", "k2").select("*", *_key(parent)).drop("path")
        out.append(skew_join(
            named, parents.select("k1", "k2", F.col("conv_id").alias("parent_conv_id")),
            ["k1", "k2"], ["conv_id"],
        ))
    if nodes:
        out.append(nodes[-1].withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    columns = [
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
        "n_children", "n_leaves", "saved_tokens", "ended", "n_ended",
    ]
    found = out[0].select(columns)
    for part in out[1:]:
        found = found.unionByName(part.select(columns))
    single = F.sha2(F.col("ended").cast("string"), 256)
    ends = F.when(F.col("ended").isNull(), F.lit(NO_END)).when(F.col("n_ended") == 1, single)
    found = found.join(digests.withColumnRenamed("unit", "ended"), "ended", "left")
    return found.select(
        *[c for c in columns[:1]], "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce(ends, "ends_sha256").alias("ends_sha256"),
    )
