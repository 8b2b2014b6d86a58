"""Nested datatypes: the order in which they can be built, their layout, and paths through them.

Types are rows in a scope (a project) and name each other, so they form a graph in which a
type has many users. Every operator goes through it a level or a step at a time, with joins on
scope and name; each round is written to the shared folder. There are as many rounds as
types are nested, which a definition's author bounds, whatever the number of types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .parameters import scalar_value

# Bytes of the atomic types.
ATOMIC = {"BOOL": 1, "SINT": 1, "USINT": 1, "INT": 2, "UINT": 2, "DINT": 4, "UDINT": 4, "REAL": 4, "LINT": 8, "ULINT": 8, "LREAL": 8}
#: A flag array is packed into words of so many bits.
WORD_BITS = 32
#: Rows that are sent to all tasks at most.
FEW = 20_000


def dependency_levels(types: DataFrame, references: DataFrame, keys: Sequence[str], name: str = "name", needs: str = "needs") -> tuple[DataFrame, DataFrame]:
    """Levels of definitions that need each other, and the references to what isn't defined.

    types: keys and ``name`` of each definition; references: keys, ``name`` and ``needs``. The first
    table has keys, ``name``, level and state: level 0 needs nothing that is defined, any other
    is one above the highest that it needs. Those that are never free of open references
    have no level and the state ``cyclic``: they are in a cycle, or need what is. The second has
    the keys, name and needs of references to no definition; what a name repeats counts once.
    """
    defined = types.select(*keys, name).distinct()
    given = defined.select(*keys, F.col(name).alias(needs)).hint("merge")
    asked = references.select(*keys, name, needs).where(F.col(needs).isNotNull()).distinct()
    missing = asked.join(given, [*keys, needs], "left_anti").select(*keys, name, needs)
    known = stored(asked.join(given, [*keys, needs], "left_semi").join(defined.hint("merge"), [*keys, name], "left_semi").select(*keys, name, needs), "known-references")
    # Each reference is met once, in the round after what it needs has its level; a name
    # has its own when all its references were met. "open" has the names some of which were.
    known = stored(known.join(known.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("wants")).hint("merge"), [*keys, name]), "references")
    new = stored(defined.join(known.select(*keys, name).distinct().hint("merge"), [*keys, name], "left_anti"), "leveled")
    partly, levels, level = None, None, 0
    while size := new.count():
        one = new.select(*keys, name, F.lit(level).alias("level"))
        levels = one if levels is None else levels.union(one)
        met = known.join(_sized(new.select(*keys, F.col(name).alias(needs)), size), [*keys, needs]).groupBy(*keys, name, "wants").agg(F.count(F.lit(1)).alias("met"))
        if partly is not None:
            met = partly.union(met).groupBy(*keys, name, "wants").agg(F.sum("met").alias("met"))
        counted = stored(met, "met-references")
        new, partly, level = counted.where("met = wants").select(*keys, name), counted.where("met < wants"), level + 1
    found = defined.withColumn("level", F.lit(None).cast("int")) if levels is None else defined.join(levels.hint("merge"), [*keys, name], "left").select(*keys, name, "level")
    return found.withColumn("state", F.when(F.col("level").isNull(), "cyclic").otherwise("ordered")), missing


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be sent to all tasks if it has few rows, else to be shuffled: files are small beside what they hold in memory."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _atomic_size(kind: Column) -> Column:
    out = F.lit(None).cast("long")
    for size in sorted(set(ATOMIC.values())):
        out = F.when(F.upper(kind).isin(*[k for k, v in ATOMIC.items() if v == size]), F.lit(size).cast("long")).otherwise(out)
    return out


def _up_to(at: Column, align: Column) -> Column:
    return F.ceil(at / align).cast("long") * align


MEMBER = "data_type, ordinal, name, member_type, dimension, target, bit_number"


def layout(members: DataFrame, keys: Sequence[str], aligned: bool = True) -> tuple[DataFrame, DataFrame]:
    """Where each member lies in its type, and each type's size.

    members: keys, data_type, ordinal, name, member_type, dimension (null or 0: not an array),
    target and bit_number. First table: members with byte_offset, element_size, elements and
    fault. A member with a target lies over that one, at its bit, and takes no room. A flag
    array takes whole words. With ``aligned`` a member begins at a multiple of its own
    alignment (an atomic type's size, a nested type's largest one) and a type ends at a
    multiple of its largest; else members follow each other without room between. Types that
    aren't defined take no room: fault says ``unknown_type``, and ``unknown_target`` of an overlay.
    Second table: keys, data_type, level, size, align and state. Types in cycles, and those that
    hold one, have state ``cyclic`` and no size, and their members no offsets.

    A type's members are folded in one row: a definition is short, however many there are.
    """
    rows = stored(members.select(*keys, *MEMBER.split(", ")), "members")
    types = rows.select(*keys, F.col("data_type").alias("name")).distinct()
    levels, _ = dependency_levels(types, rows.select(*keys, F.col("data_type").alias("name"), F.when(_atomic_size(F.col("member_type")).isNull() & F.col("target").isNull(), F.col("member_type")).alias("needs")), keys)
    levels = stored(levels.withColumnRenamed("name", "data_type"), "levels")
    counts = {r["level"]: r["count"] for r in levels.where("level is not null").groupBy("level").count().collect()}
    leveled = stored(rows.join(levels.where("level is not null").select(*keys, "data_type", "level").hint("merge"), [*keys, "data_type"]), "leveled-members", ["level"])
    sizes, placed, sized = None, None, 0
    kind, one = F.col("member_type"), F.lit(1).cast("long")
    count = F.greatest(F.coalesce("dimension", F.lit(1)), F.lit(1)).cast("long")
    flags = (F.upper(kind) == "BOOL") & (F.coalesce("dimension", F.lit(0)) > 0)
    for level in range(len(counts)):
        own = leveled.where(F.col("level") == level)
        if sizes is None:
            own = own.withColumn("nested_size", F.lit(None).cast("long")).withColumn("nested_align", F.lit(None).cast("long"))
        else:
            nested = sizes.select(*keys, F.col("data_type").alias("member_type"), F.col("size").alias("nested_size"), F.col("align").alias("nested_align"))
            own = own.join(_sized(nested, sized), [*keys, "member_type"], "left")
        sized += counts[level]
        atomic = _atomic_size(kind)
        element = F.coalesce(atomic, "nested_size", F.lit(0).cast("long"))
        room = F.when(F.col("target").isNotNull(), F.lit(0).cast("long")).when(flags, F.ceil(count / WORD_BITS).cast("long") * (WORD_BITS // 8)).otherwise(element * count)
        align = F.when(F.lit(not aligned) | F.col("target").isNotNull(), one).when(flags, F.lit(WORD_BITS // 8).cast("long")).otherwise(F.greatest(F.coalesce(atomic, "nested_align", one), one))
        known = F.coalesce(atomic, "nested_size").isNotNull() | F.col("target").isNotNull()
        # "at" is where the member before ends; places are kept for what lies over them.
        item = F.struct("ordinal", "name", "member_type", "dimension", "target", "bit_number", element.alias("element"), count.alias("elements"), room.alias("room"), align.alias("own_align"), known.alias("known"), flags.alias("flags"))
        listed = own.groupBy(*keys, "data_type", "level").agg(F.array_sort(F.collect_list(item)).alias("items"))
        begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("offsets"))
        folded = F.aggregate("items", begun, lambda acc, m: F.struct((_up_to(acc["at"], m["own_align"]) + m["room"]).alias("at"), F.concat(acc["offsets"], F.array(_up_to(acc["at"], m["own_align"]))).alias("offsets")))
        listed = listed.withColumn("fold", folded).withColumn("align", F.coalesce(F.array_max(F.transform("items", lambda m: m["own_align"])), one))
        listed = stored(listed.select(*keys, "data_type", "level", "items", F.col("fold.offsets").alias("offsets"), _up_to(F.col("fold.at"), F.col("align")).alias("size"), "align"), "layout")
        new = listed.select(*keys, "data_type", "level", "size", "align")
        sizes = new if sizes is None else sizes.union(new)
        host = F.element_at(F.col("offsets"), F.array_position(F.transform("items", lambda m: m["name"]), F.col("m.target")).cast("int"))
        there = F.array_contains(F.transform("items", lambda m: m["name"]), F.col("m.target"))
        each = listed.select(*keys, "data_type", "items", "offsets", F.posexplode("items").alias("i", "m"))
        offset = F.when(F.col("m.target").isNull(), F.col("offsets")[F.col("i")]).when(there, host)
        fault = F.when(~F.col("m.known"), "unknown_type").when(F.col("m.target").isNotNull() & ~there, "unknown_target")
        part = each.select(*keys, "data_type", "m.ordinal", "m.name", "m.member_type", "m.dimension", "m.target", "m.bit_number", offset.alias("byte_offset"), F.col("m.element").alias("element_size"), F.col("m.elements").alias("elements"), F.col("m.flags").alias("packed"), fault.alias("fault"))
        placed = part if placed is None else placed.union(part)
    none = F.lit(None).cast("long")
    bad = rows.join(levels.where("level is null").select(*keys, "data_type").hint("merge"), [*keys, "data_type"], "left_semi")
    bad = bad.select(*keys, *MEMBER.split(", "), none.alias("byte_offset"), none.alias("element_size"), count.alias("elements"), F.coalesce(flags, F.lit(False)).alias("packed"), F.lit("cyclic").alias("fault"))
    cyclic = levels.where("level is null").select(*keys, "data_type", "level", none.alias("size"), none.alias("align"), "state")
    if sizes is None:
        return bad, cyclic
    return placed.union(bad), sizes.withColumn("state", F.lit("ordered")).union(cyclic)


def leaves(placed: DataFrame, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every atomic element of every root: keys, root, path, leaf_type, byte_offset and bit.

    placed: the first table of ``layout``; roots: keys and root (a type). Paths look like
    ``Line[2].Mask``; bit is that of a flag in a packed array or of a member over another one.
    What nested arrays of types hold is as many rows as it has elements. Cyclic types have
    no leaves.
    """
    at = stored(placed.where("byte_offset is not null").withColumn("nested", _atomic_size(F.col("member_type")).isNull() & F.col("target").isNull()), "placed")
    frontier = stored(roots.select(*keys, "root", F.col("root").alias("data_type"), F.lit("").alias("path"), F.lit(0).cast("long").alias("base")).distinct(), "leaf-frontier")
    found = frontier.select(*keys, "root", "path", F.col("data_type").alias("leaf_type"), F.col("base").alias("byte_offset"), F.lit(None).cast("long").alias("bit")).where(F.lit(False))
    array = F.coalesce("dimension", F.lit(0)) > 0
    path = F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "name", F.when(array & F.col("target").isNull(), F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(""))
    shift = F.when(F.col("packed"), F.floor(F.col("i") / 8).cast("long")).otherwise(F.col("i") * F.col("element_size"))
    base = F.col("base") + F.col("byte_offset") + shift
    bit = F.when(F.col("target").isNotNull(), F.col("bit_number").cast("long")).when(F.col("packed"), F.col("i") % 8)

    def inside(members: DataFrame) -> DataFrame:
        return frontier.join(members, [*keys, "data_type"]).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("target").isNull(), F.col("elements") - 1).otherwise(F.lit(0)))))

    # Only places where types are nested are stored; their leaves are joined when they are read. The deeper
    # a place, the more roots share its type: members of few types are sent to all tasks.
    while True:
        wanted = stored(frontier.select(*keys, "data_type").distinct(), "wanted-types")
        types = wanted.count()
        if not types:
            return found
        here = at.hint("merge")
        if types <= FEW:
            few = stored(at.join(F.broadcast(wanted), [*keys, "data_type"], "left_semi"), "wanted-members")
            here = F.broadcast(few) if few.count() <= 10 * FEW else few.hint("merge")
        leaf = inside(here.where("not nested")).select(*keys, "root", path.alias("path"), F.col("member_type").alias("leaf_type"), base.alias("byte_offset"), bit.alias("bit"))
        found = found.union(leaf)
        frontier = stored(inside(here.where("nested and fault is null")).select(*keys, "root", F.col("member_type").alias("data_type"), path.alias("path"), base.alias("base")), "leaf-frontier")


COMPONENT = r"^([^\[\]]+)(?:\[(\d+(?:,\d+)*)\])?$"


def walk_paths(paths: DataFrame, members: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """Where the path of every row leads: ``paths`` plus resolved_type, indices, members, status, stopped_at and beyond.

    paths: keys, ``key`` (unique), data_type (where the path begins) and path, as in
    ``Line[2].Mask``; members: keys, data_type, name, member_type and dimension (numbers with
    commas between). Each round joins one selector of every row that has one left with the
    members of the type it stands on. status: ``resolved``; ``unknown_member`` of a type that is
    defined; ``through_scalar``, where a member's type isn't defined and the path goes on;
    ``not_parsed``; ``unknown_type`` where the first type isn't defined; ``bit`` for a path that
    begins with a number; ``empty`` for none. stopped_at is the selector that failed, members
    those that were passed. indices are all that were read, beyond the selectors whose
    indices don't fit their member's dimensions, which doesn't stop the walk. Of members of one
    name in a type the first by ordinal counts.
    """
    table = members.select(*keys, "data_type", "name", "member_type", F.col("dimension").cast("string").alias("dimension"), *(["ordinal"] if "ordinal" in members.columns else [F.lit(0).alias("ordinal")]))
    table = table.groupBy(*keys, "data_type", "name").agg(F.min_by(F.struct("member_type", "dimension"), F.struct("ordinal", "member_type", "dimension")).alias("m"))
    table = stored(table.select(*keys, "data_type", "name", "m.member_type", "m.dimension"), "path-members")
    defined = table.select(*keys, "data_type").distinct().withColumn("is_defined", F.lit(True))
    texts = "array<string>"
    rows = paths.select(*keys, key, "data_type", F.split(F.coalesce("path", F.lit("")), r"\.").alias("rest"))
    rows = rows.join(defined, [*keys, "data_type"], "left")
    first = F.col("rest")[0]
    status = F.when((F.size("rest") == 1) & (first == ""), "empty").when(first.rlike(r"^\d+$"), "bit").when(F.col("is_defined").isNull(), "unknown_type")
    state = [F.col("data_type").alias("on"), "rest", F.lit(None).cast("string").alias("resolved_type"), F.array().cast("array<bigint>").alias("indices"), F.array().cast(texts).alias("members"), F.array().cast(texts).alias("beyond"), status.alias("status"), F.lit(None).cast("string").alias("stopped_at"), F.lit(False).alias("scalar")]
    moving = stored(rows.select(*keys, key, *state), "paths")
    out = [c for c in moving.columns if c not in ("on", "rest", "scalar")]
    done = moving.where("status is not null").select(out)
    moving = moving.where("status is null")
    while not moving.isEmpty():
        name, read = F.regexp_extract(F.col("rest")[0], COMPONENT, 1), F.regexp_extract(F.col("rest")[0], COMPONENT, 2)
        some = moving.withColumn("name", name).withColumn("read", F.when(read != "", F.transform(F.split(read, ","), lambda x: x.try_cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
        near = table.select(*keys, F.col("data_type").alias("on"), "name", "member_type", "dimension")
        nested = defined.select(*keys, F.col("data_type").alias("member_type"), "is_defined")
        near = near.join(nested, [*keys, "member_type"], "left")
        some = some.join(near, [*keys, "on", "name"], "left")
        stop = F.when(F.col("name") == "", "not_parsed").when(F.col("scalar"), "through_scalar").when(F.col("member_type").isNull(), "unknown_member")
        bounds = F.transform(F.split("dimension", ","), lambda x: F.trim(x).try_cast("bigint"))
        # Null bounds are dimensions that aren't numbers: nothing is said of these.
        fits = (F.size(bounds) == F.size("read")) & F.forall(F.arrays_zip(bounds.alias("b"), F.col("read").alias("r")), lambda z: z["r"] < z["b"])
        judged = F.col("dimension").isNotNull() & (F.size("read") > 0) & F.forall(bounds, lambda b: b.isNotNull())
        over = F.when(stop.isNull() & F.coalesce(judged & ~fits, F.lit(False)), F.array(F.col("rest")[0])).otherwise(F.array().cast(texts))
        rest = F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(1)))
        ended = F.coalesce(stop, F.when(F.size("rest") == 1, F.lit("resolved")))
        step = some.select(
            *keys, key, F.col("member_type").alias("on"), rest.alias("rest"), F.when(ended == "resolved", F.col("member_type")).alias("resolved_type"), F.concat("indices", "read").alias("indices"),
            F.when(stop.isNull(), F.concat("members", F.array("name"))).otherwise(F.col("members")).alias("members"), F.concat("beyond", over).alias("beyond"), ended.alias("status"), F.when(stop.isNotNull(), F.col("rest")[0]).alias("stopped_at"), F.col("is_defined").isNull().alias("scalar"),
        )
        step = stored(step, "paths")
        done = done.union(step.where("status is not null").select(out))
        moving = step.where("status is null")
    return done


def composite_values(nodes: DataFrame, keys: Sequence[str], node: str = "place", parent: str = "parent_place") -> DataFrame:
    """Every node with a lexical value: keys, ``node``, path, data_type, value and what it means by its type.

    nodes: keys, ``node``, ``parent``, name, index, data_type and value; trees of any depth. A node
    without a type has that of the nearest node above that has one. Path and type are
    found by doubling: after n rounds a row knows what 2^n nodes above it say. fault is ``invalid_value`` where
    the text isn't a literal of an atomic type. Nodes that lead into a cycle are left out.
    """
    own = F.concat(F.coalesce("name", F.lit("")), F.coalesce("index", F.lit("")))
    all_nodes = stored(nodes.select(*keys, F.col(node).alias("node"), F.col(parent).alias("up"), own.alias("own"), "data_type", "value"), "value-nodes")
    there = all_nodes.select(*keys, F.col("node").alias("up"), F.lit(True).alias("there"))
    begun = all_nodes.join(there, [*keys, "up"], "left")
    state = stored(begun.select(*keys, "node", F.when(F.col("there"), F.col("up")).alias("up"), F.array_remove(F.array("own"), "").alias("path"), "data_type"), "values")
    done = state.where("up is null")
    moving = state.where("up is not null")
    while not moving.isEmpty():
        above = done.union(moving).select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("data_type").alias("type2"))
        step = moving.join(above, [*keys, "up"]).select(*keys, "node", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"), F.coalesce("data_type", "type2").alias("data_type"))
        step = stored(step, "values")
        ended = step.where("up is null")
        if ended.isEmpty():
            break
        done = done.union(ended)
        moving = step.where("up is not null")
    known = done.select(*keys, "node", F.array_join("path", ".").alias("path"), "data_type")
    valued = all_nodes.where("value is not null").select(*keys, "node", "value").join(known, [*keys, "node"])
    value = scalar_value(F.col("data_type"), F.col("value"))
    text = F.when(F.upper("data_type").isin("STRING", "WSTRING"), F.col("value"))
    atomic = F.upper("data_type").isin(*ATOMIC)
    nothing = F.coalesce(*[v.cast("string") for v in value.values()]).isNull()
    # An index stands right after the name before it.
    path = F.regexp_replace("path", r"\.\[", "[")
    return valued.select(*keys, F.col("node").alias(node), path.alias("path"), "data_type", "value", *[v.alias(k) for k, v in value.items()], text.alias("text"), F.when(atomic & nothing, "invalid_value").alias("fault"))
