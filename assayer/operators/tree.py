"""Trees given by parent references: containment checks, roots, levels.

Ancestors are found by doubling: after n rounds a row knows its ancestor 2^n steps up, so
the rounds are the logarithm of the depth, and one more if there are cycles. Each joins only the rows that haven't reached
their root, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import join_hot, stored
from .ordering import numbered


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root, depth and in_cycle of every row; keys are unique.

    root is the last node that is reached: one whose parent is null or isn't there. A node
    that belongs to a cycle or leads into one has in_cycle and no root. A tree may be of any
    depth. A round ends the nodes of a range of depths, and no depth is missing below a
    deeper one: once a round ends none, all that are left lead into a cycle.
    """
    known = nodes.select(F.col(key).alias("node"), F.col(parent).alias("up"))
    children = known.where("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("copies"))
    there = known.select(F.col("node").alias("up"), F.col("node").alias("there")).join(children, "up", "left")
    total = known.count()
    step = join_hot(known, there, "up", F.col("copies"), total, "left").select("node", F.col("there").alias("up"))
    state = stored(step.select("node", "up", F.coalesce("up", "node").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "ancestors")
    reach, ended = 1, []
    moving = state.where("up is not null")
    ended.append(state.where("up is null"))
    while reach < total and (left := moving.count()):
        # Every node that one still moving points to is in some round's table.
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        often = moving.groupBy("up").agg(F.count(F.lit(1)).alias("copies"))
        moved = join_hot(moving, above.join(often, "up"), "up", F.col("copies"), left)
        # depth2 is how far the ancestor has come itself, up to as many steps as this round looks.
        moved = stored(moved.select("node", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth")), "ancestors")
        if moved.where("up is null").isEmpty():
            break
        ended.append(moved.where("up is null"))
        moving = moved.where("up is not null")
        done = ended[0]
        for t in ended[1:]:
            done = done.union(t)
        state = done.union(moving)
        reach *= 2
    out = state.select(F.col("node").alias(key), F.when(F.col("up").isNull(), F.col("top")).alias("root"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("in_cycle"))
    return out


def containment_issues(nodes: DataFrame, key: str, parent: str, no_parent: object = 0) -> DataFrame:
    """key, code and parent of every containment fault.

    self_parent: a row contains itself; missing_parent: its parent isn't there;
    containment_cycle: it is in a cycle or leads into one, itself containing itself
    included. ``no_parent`` marks rows at the top.
    """
    held = nodes.select(key, F.when(F.col(parent) != F.lit(no_parent), F.col(parent)).alias(parent))
    up = held.select(F.col(key).alias("__up"))
    alone = held.where(F.col(key) == F.col(parent)).select(key, F.lit("self_parent").alias("code"), parent)
    missing = held.where(F.col(parent).isNotNull()).join(up, F.col(parent) == F.col("__up"), "left_anti").select(key, F.lit("missing_parent").alias("code"), parent)
    cyclic = ancestors(held, key, parent).where("in_cycle").select(F.col(key).alias("__key"))
    cycle = held.join(cyclic, F.col(key) == F.col("__key"), "left_semi").select(key, F.lit("containment_cycle").alias("code"), parent)
    return alone.union(missing).union(cycle)


def valid_edges(nodes: DataFrame, key: str, parent: str, no_parent: object = 0) -> DataFrame:
    """(parent, key) of the rows without a fault."""
    faulty = containment_issues(nodes, key, parent, no_parent).select(F.col(key).alias("__key"))
    held = nodes.where(F.col(parent) != F.lit(no_parent))
    return held.join(faulty, F.col(key) == F.col("__key"), "left_anti").select(parent, key)


def breadth_first(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """key, depth and position (from 1) of every node in breadth-first order: roots by ``order``, then their children, and so on.

    Children stand in the order of their parents and then by ``order``, which is unique. A node whose parent is
    null or isn't there is a root; those that lead into a cycle are left out. The orders on a node's way from its root
    are gathered by doubling and sorted by length and then by value, over all tasks.
    """
    known = nodes.select(F.col(key).alias("node"), F.col(parent).alias("up"), F.array(F.col(order)).alias("way"))
    there = known.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    state = stored(known.join(there, "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up"), "way"), "ways")
    done, moving = state.where("up is null"), state.where("up is not null")
    while not moving.isEmpty():
        above = done.union(moving).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"))
        step = stored(moving.join(above, "up").select("node", F.col("up2").alias("up"), F.concat("way2", "way").alias("way")), "ways")
        ended = step.where("up is null")
        if ended.isEmpty():
            break
        done, moving = done.union(ended), step.where("up is not null")
    placed = numbered(done.select(F.col("node").alias(key), (F.size("way") - 1).alias("depth"), "way"), ["depth", "way"], "position")
    return placed.select(key, "depth", "position")
