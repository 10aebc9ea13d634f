"""Prefix trie of conversations: subtree sums from a distributed ranking of its Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import stored
from gradelake.operators.scale import group_index

#: Turns of a conversation that are summed together, and turn numbers that are ordered together.
PART, TURNS = 4096, 256
#: Nodes whose arcs are linked in one task.
BLOCK = 1 << 16
#: Topmost turns that decide which nodes share a task; results do not depend on it.
NEAR = 4
#: Ids that are joined into one piece of a digest's text.
PIECE = 1 << 14

_ROOT = 0
_NODE = ["a", "b"]
_FACTS = {
    "conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint",
    "n_children": "bigint", "ends_sha256": "string",
}
_TOUR = ("is_segment boolean, a bigint, b bigint, k tinyint, leaves bigint, saved bigint, "
         "a2 bigint, b2 bigint, k2 tinyint, leaves2 bigint, saved2 bigint, "
         + ", ".join(f"{c} {kind}" for c, kind in _FACTS.items()))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), said (digest of role and text), n_words of rows of conv_id, turn, role, text.

    Turns go by number, none first; rows of one number by role, then by a digest of both.
    A null role or text counts as empty. Rows without conv_id belong to no conversation and
    are left out. Texts do not leave their task: only digests are shuffled, and a
    conversation of very many turns is numbered in parts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_words"))
    part = F.coalesce(F.floor(F.col("turn") / TURNS).cast("bigint"), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    numbered = group_index(told, ["conv_id"], order, part, index="pos")
    return numbered.select("conv_id", "pos", "said", "n_words")


def _steps(turns: DataFrame) -> DataFrame:
    """Every turn as a step from the node of the turns before it (pa, pb) to its own (a, b).

    A node's id is the sum without carry of 128 random bits per (place, turn) of its path, so
    prefixes are running sums and long conversations are summed by parts.
    """
    marked = turns.select(
        "conv_id", "pos", "n_words", F.expr(f"pos DIV {PART}").alias("part"),
        F.xxhash64(F.lit(1), "pos", "said").alias("ta"), F.xxhash64(F.lit(2), "pos", "said").alias("tb"))
    tops = [f"t{i}" for i in range(1, NEAR + 1)]
    parts = marked.groupBy("conv_id", "part").agg(
        F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"), F.max("pos").alias("end"),
        *[F.bit_xor(F.when(F.col("pos") < i + 1, F.col("ta"))).alias(t) for i, t in enumerate(tops)])
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    until = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ahead = parts.select(
        "conv_id", "part", F.coalesce(F.bit_xor("xa").over(earlier), F.lit(0)).alias("xa"),
        F.coalesce(F.bit_xor("xb").over(earlier), F.lit(0)).alias("xb"),
        F.max("end").over(conversation).alias("end"), *[F.first(t).over(until).alias(t) for t in tops])
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("ra", F.bit_xor("ta").over(running)).withColumn("rb", F.bit_xor("tb").over(running))
    placed = summed.join(ahead, ["conv_id", "part"]).withColumn(
        "a", F.col("ra").bitwiseXOR(F.col("xa"))).withColumn("b", F.col("rb").bitwiseXOR(F.col("xb")))
    depth = F.col("pos") + 1
    return placed.select(
        "conv_id", depth.alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("tb")).alias("pb"), "n_words", (F.col("pos") == F.col("end")).alias("is_last"),
        *[F.when(depth > i, F.col(t)).alias(t) for i, t in enumerate(tops)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a node and a conv_id as pieces of text: up to so many ids of a node, joined by commas."""
    node, ids, done = None, [], []

    def close():
        if ids:
            done.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch():
        out = pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            names=["a", "b", "first", "ids"])
        done.clear()
        return out

    for rows in batches:
        for a, b, conv in zip(*(rows.column(i).to_pylist() for i in range(3))):
            if (a, b) != node or len(ids) >= PIECE:
                close()
                node = a, b
            ids.append(conv)
            if len(done) >= 4096:
                yield batch()
    close()
    if done:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order; one piece is held at a time."""
    node, sha = None, None
    for rows in batches:
        done = []
        for a, b, ids in zip(*(rows.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) == node:
                sha.update(b"," + ids.encode())
            else:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield _digest_rows(done)
    if node:
        yield _digest_rows([(*node, sha.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    a, b, text = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text)], names=["a", "b", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of nodes in which conversations end.

    The ids are sorted over all tasks and joined in pieces, so a node in which very many end
    is no group in memory; only the digest itself, which has no parts, reads a node's pieces
    one after the other.
    """
    order = ["a", "b", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "a bigint, b bigint, first bigint, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(
        _digests, "a bigint, b bigint, ends_sha256 string")


def _tree(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with their parent's conv_id, children, first child (fa, fb) and next sibling (sa, sb).

    Siblings go by id. They are put in order by ranges of the id, and only the ranges' first
    children are ordered per parent, at most 4096, so a node of very many children is
    spread like any other.
    """
    kids = nodes.withColumn("range", F.when(F.col("pa").isNotNull(), F.shiftright("a", 52)))
    inside = Window.partitionBy("pa", "pb", "range").orderBy("a", "b")
    chained = kids.withColumn("later", F.lead(F.struct("a", "b")).over(inside))
    ranges = kids.where("pa IS NOT NULL").groupBy("pa", "pb", "range").agg(
        F.min(F.struct("a", "b")).alias("first"), F.count(F.lit(1)).alias("n"))
    parent = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    family = ranges.withColumn(
        "then", F.lead("first").over(Window.partitionBy("pa", "pb").orderBy("range"))
    ).join(parent, ["pa", "pb"]).drop("n", "first")
    below = ranges.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.sum("n").alias("n_children"), F.min("first").alias("down"))
    side = F.coalesce("later", "then")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        chained.join(family, ["pa", "pb", "range"], "left").join(below, _NODE, "left").join(ends, _NODE, "left")
        .select(
            "a", "b", "pa", "pb", side["a"].alias("sa"), side["b"].alias("sb"),
            F.col("down.a").alias("fa"), F.col("down.b").alias("fb"),
            ((F.col("n_convs") - 1) * F.col("n_words")).alias("saving"),
            *[f"t{i}" for i in range(1, NEAR + 1)], "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of a task's nodes as segments of the tour, and nodes with their arcs' places in them.

    Arc 2i enters node i and arc 2i + 1 leaves it. A segment is named by its first arc: the
    node and 0 or 1. Sums at an arc are those of the arcs before it in its segment.
    """
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    column = {c: rows.column(c).to_pylist() for c in ("pa", "pb", "sa", "sb", "fa", "fb", "saving", "n_children")}
    ids = list(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()))
    place = {node: i for i, node in enumerate(ids)}
    follow, away, entered = [-1] * (2 * len(ids)), {}, bytearray(2 * len(ids))

    def lead(arc: int, node: tuple[int, int], kind: int) -> None:
        i = place.get(node)
        if i is None:
            away[arc] = (*node, kind)
        else:
            follow[arc] = 2 * i + kind
            entered[2 * i + kind] = 1

    for i, node in enumerate(ids):
        if column["fa"][i] is None:
            lead(2 * i, node, 1)
        else:
            lead(2 * i, (column["fa"][i], column["fb"][i]), 0)
        if column["sa"][i] is not None:
            lead(2 * i + 1, (column["sa"][i], column["sb"][i]), 0)
        elif column["pa"][i] is not None:
            lead(2 * i + 1, (column["pa"][i], column["pb"][i]), 1)
    segment, leaves, saved = [0] * len(follow), [0] * len(follow), [0] * len(follow)
    found = []
    for head in range(len(follow)):
        if entered[head]:
            continue
        arc, n_leaves, n_saved = head, 0, 0
        while arc >= 0:
            segment[arc], leaves[arc], saved[arc] = head, n_leaves, n_saved
            if not arc & 1:
                n_leaves += not column["n_children"][arc >> 1]
                n_saved += column["saving"][arc >> 1]
            last, arc = arc, follow[arc]
        found.append((*ids[head >> 1], head & 1, n_leaves, n_saved, *away.get(last, (None,) * 3), None, None))
    own = [(*ids[s >> 1], s & 1, leaves[2 * i], saved[2 * i], *ids[e >> 1], e & 1, leaves[2 * i + 1], saved[2 * i + 1])
           for i, (s, e) in enumerate(zip(segment[::2], segment[1::2]))]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()] * 2
    names = ["is_segment", "a", "b", "k", "leaves", "saved", "a2", "b2", "k2", "leaves2", "saved2", *_FACTS]
    facts = [rows.column(c).combine_chunks() for c in _FACTS]
    none = [pa.nulls(len(found), f.type) for f in facts]
    for is_segment, made, rest in ((True, found, none), (False, own, facts)):
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*made), kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([is_segment] * len(made)), *arrays, *rest], names=names)


def _ranked(segments: DataFrame) -> DataFrame:
    """a, b, k, leaves, saved: what the tour still holds from the start of each segment on.

    Each step doubles how far a segment sees; as many steps as the logarithm of their number.
    """
    current = segments
    while not current.where("a2 IS NOT NULL").isEmpty():
        ahead = current.select(*[F.col(c).alias(f"n_{c}") for c in current.columns])
        found = (F.col("a2") == F.col("n_a")) & (F.col("b2") == F.col("n_b")) & (F.col("k2") == F.col("n_k"))
        current = stored(current.join(ahead, found, "left").select(
            "a", "b", "k",
            *[(F.col(c) + F.coalesce(f"n_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
            *[F.col(f"n_{c}").alias(c) for c in ("a2", "b2", "k2")]))
    return current.select("a", "b", "k", "leaves", "saved")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, with sums over their subtrees.

    ``turns`` has conv_id, pos (from 0, without gaps), said (what was said, as a digest) and
    n_words; ``members`` has each conv_id once, those without turns too. Every distinct
    sequence of first turns is a node, from the root without turns: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without children in
    its subtree), saved_tokens (over its subtree, the words of a node's last turn times its
    members but one) and ends_sha256 (of the ids of the members that end there).

    Each node gives the tour an entering and a leaving arc. Tasks hold ranges of nodes that
    lie near each other in the trie and link their arcs to segments; the segments, a few
    per task, are ranked by pointer doubling, and a subtree's sums are the differences of the
    prefix sums at its two arcs. Where both lie in one segment the task knows them already.
    A popular turn or a node of many children is spread over tasks like any other. No
    members give no rows, without a root. Other columns are not read.
    """
    steps = stored(_steps(turns.select("conv_id", "pos", "said", "n_words")))
    everyone = members.select("conv_id")
    tops = [f"t{i}" for i in range(1, NEAR + 1)]
    started = steps.where("depth = 1").select("conv_id")
    silent = everyone.join(started, "conv_id", "left_anti").select(
        F.lit(_ROOT).cast("bigint").alias("a"), F.lit(_ROOT).cast("bigint").alias("b"), "conv_id")
    root = everyone.select(
        "conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "a", "b", "n_words")],
        *[F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb", *tops)])
    path = ["depth", "pa", "pb", "n_words", *tops]
    nodes = stored(
        steps.drop("is_last").unionByName(root).groupBy(*_NODE)
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in path]))
    ends = _ends(steps.where("is_last").select("a", "b", "conv_id").unionByName(silent))
    tree = stored(_tree(nodes, ends))
    tasks = max(1, -(-tree.count() // BLOCK))
    linked = stored(tree.repartitionByRange(tasks, *tops, *_NODE).mapInArrow(_link, _TOUR))
    ranked = _ranked(linked.where("is_segment").select("a", "b", "k", "leaves", "saved", "a2", "b2", "k2"))
    placed = linked.where("NOT is_segment")
    together = (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("k") == F.col("k2"))
    facts = list(_FACTS)
    local = placed.where(together).select(
        *facts, *[(F.col(f"{c}2") - F.col(c)).alias(c) for c in ("leaves", "saved")])
    entry = ranked.select("a", "b", "k", F.col("leaves").alias("leaves_in"), F.col("saved").alias("saved_in"))
    leave = ranked.select(
        *[F.col(c).alias(f"{c}2") for c in ("a", "b", "k")],
        F.col("leaves").alias("leaves_out"), F.col("saved").alias("saved_out"))
    across = placed.where(~together).join(entry, ["a", "b", "k"]).join(leave, ["a2", "b2", "k2"]).select(
        *facts, *[(F.col(f"{c}_in") - F.col(c) - F.col(f"{c}_out") + F.col(f"{c}2")).alias(c) for c in ("leaves", "saved")])
    return local.unionByName(across).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256")
