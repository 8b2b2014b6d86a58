"""Conversations repaired by an error-correcting Earley parser.

The grammar of roles is ``(s? (u a)+)?``. A turn is kept, given another role, deleted or
put in, each at a cost, and a chart item keeps the least (cost, audit) that leads to it;
of equal costs the audit that comes first in ASCII. Pairs are left-recursive, so every
item begins at the first column: a column holds about a dozen items however long the
conversation is, and nothing but the last column and the first one's open items is kept.

Turns are sorted over all tasks by conversation and place. A conversation that lies in
one task and isn't longer than a block is parsed there. Any other is cut into blocks: each is
parsed from each of the four states in which the one before it can end, a fold over the
blocks picks the cheapest way through them, and then each block writes its own turns. Of
two audits that cost the same and read the same turns neither begins the other, so the
least of the whole is made of the least of the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = " \t\n\x0b\x0c\r"
RULES = (("C", ()), ("C", ("D",)), ("D", ("s", "u", "a")), ("D", ("u", "a")), ("D", ("D", "u", "a")))
#: Terminals that a turn can be given or that can be put in, and their roles.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of a block.
BLOCK = 4096

#: rule, dot, column where it began -> cost, audit
Items = dict[tuple[int, int, int], tuple[int, str]]
#: The items in which a conversation can stand between two turns, by what came last.
STATES = {"start": ((0, 0),), "s": ((2, 1),), "u": ((3, 1), (2, 2), (4, 2)), "a": ((1, 1),)}
#: The items that a block begins with in each of these states.
BEGIN = {"start": ((0, 0), (1, 0)), "s": ((2, 1),), "u": ((3, 1),), "a": ((1, 1), (4, 1))}
ENDS = ("start", "a")


def _relax(column: Items, item: tuple[int, int, int], value: tuple[int, str]) -> bool:
    if item in column and column[item] <= value:
        return False
    column[item] = value
    return True


def _close(column: Items, here: int, waiting: Items) -> Items:
    """``column`` with all that follows without reading a turn: predictions, completions, insertions.

    waiting: the first column, where all items begin.
    """
    todo = list(column)
    while todo:
        item = todo.pop()
        rule, dot, origin = item
        cost, audit = column[item]
        left, right = RULES[rule]
        found = []
        if dot == len(right):
            for r, d, o in list(waiting):
                if d < len(RULES[r][1]) and RULES[r][1][d] == left:
                    found.append(((r, d + 1, o), (cost, audit)))
        elif right[dot] in ROLES:
            found.append(((rule, dot + 1, origin), (cost + INSERT, audit + "I")))
        elif right[dot].isupper():
            found += [((r, 0, here), (cost, audit)) for r, (name, _) in enumerate(RULES) if name == right[dot]]
        todo += [to for to, value in found if _relax(column, to, value)]
    return column


def _first() -> Items:
    column: Items = {(r, d, 0): (0, "") for r, d in BEGIN["start"]}
    return _close(column, 0, column)


def parse(turns: Iterable[tuple[str, bool, bool]], state: str = "start") -> dict[str, tuple[int, str]]:
    """The least (cost, audit) for each state that ``turns`` can end in, begun in ``state``.

    turns: role initial, whether it must be deleted, and whether its text is truncated.
    """
    waiting = _first()
    column = dict(waiting) if state == "start" else _close({(r, d, 0): (0, "") for r, d in BEGIN[state]}, 0, waiting)
    for at, (initial, must, truncated) in enumerate(turns, 1):
        after: Items = {}
        for (rule, dot, origin), (cost, audit) in column.items():
            left, right = RULES[rule]
            terminal = right[dot] if dot < len(right) and right[dot].islower() else None
            if terminal or left == "C" and dot == len(right):
                _relax(after, (rule, dot, origin), (cost + DELETE, audit + "D"))
            if terminal and not must:
                kept = cost + (TRUNCATED if truncated else 0)
                if initial == terminal:
                    _relax(after, (rule, dot + 1, origin), (kept, audit + "K"))
                if terminal in ROLES:
                    _relax(after, (rule, dot + 1, origin), (kept + REROLE, audit + "R"))
        column = _close(after, at, waiting)
    found = {}
    for name, items in STATES.items():
        values = [column[r, d, 0] for r, d in items if (r, d, 0) in column]
        if values:
            found[name] = min(values)
    return found


def applied(audit: str, turns: Iterable[tuple[str, str]], state: str = "start") -> Iterator[str]:
    """The repaired turns as ``role:text``; turns: role and text."""
    rows = iter(turns)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == "u" else "u"]
        state = role[:1]
        yield f"{role}:{text}"


#: What a block says of its turns; those of one conversation add up.
TOTALS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
WAYS = "ways array<struct<began:string,ended:string,cost:bigint,audit:string>>"
LEGAL = ("su", "ua", "au")


class Block:
    """Turns of one conversation that follow each other."""

    def __init__(self) -> None:
        self.turns: list[tuple[str, bool, bool]] = []
        self.texts: list[tuple[str, str]] = []
        self.said = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first_turn": None, "last_turn": None, "first_initial": None, "last_initial": None}

    def add(self, turn: int | None, role: str, text: str, times: int, fault: str | None, blank: bool) -> None:
        """Equal turns in one place: the first of them has ``fault``, the others repeat it."""
        s, initial = self.said, role[:1]
        again = "blank" if blank else "duplicate"
        for one in [fault] + [again] * (times - 1):
            if one:
                s[one] += 1
            if self.turns:
                s["illegal"] += self.turns[-1][0] + initial not in LEGAL
            else:
                s["first_initial"] = initial
            self.turns.append((initial, one in ("blank", "duplicate"), one == "truncated"))
            self.texts.append((role, text))
        s["last_initial"] = initial
        if turn is not None:
            if s["last_turn"] != turn:
                s["turns"] += 1
            s["first_turn"] = turn if s["first_turn"] is None else s["first_turn"]
            s["last_turn"] = turn


def joined(blocks: Iterable[dict]) -> dict:
    """RESULT of a conversation, and ``path``: each block's state and audit. blocks: TOTALS and ways, in order."""
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    best: dict[str, tuple[int, str, tuple]] = {"start": (0, "", ())}
    turns, first, last, initial = 0, None, None, None
    for b in blocks:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            out[k] += b[k]
        if initial is not None and b["first_initial"] is not None:
            out["illegal"] += initial + b["first_initial"] not in LEGAL
        initial = b["last_initial"] if b["last_initial"] is not None else initial
        turns += b["turns"] - (last is not None and b["first_turn"] == last)
        first, last = b["first_turn"] if first is None else first, last if b["last_turn"] is None else b["last_turn"]
        after: dict[str, tuple[int, str, tuple]] = {}
        for way in b["ways"]:
            if way["began"] in best:
                cost, audit, path = best[way["began"]]
                value = (cost + way["cost"], audit + way["audit"], (path, (way["began"], way["audit"])))
                if way["ended"] not in after or after[way["ended"]][:2] > value[:2]:
                    after[way["ended"]] = value
        best = after
    out["gaps"] = last - first + 1 - turns if first is not None else 0
    out["cost"], out["audit"], path = min((best[e] for e in ENDS if e in best), key=lambda v: v[:2])
    out["path"] = []
    while path:
        path, step = path
        out["path"].append(step)
    out["path"].reverse()
    return out


def _ways(block: Block, states: Iterable[str]) -> list[dict]:
    return [{"began": s, "ended": e, "cost": cost, "audit": audit} for s in states for e, (cost, audit) in parse(block.turns, s).items()]


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "fault", "blank")])


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times, fault and blank of the distinct turns of each conversation.

    A null role or text is one space. fault is the turn's first one. Turns that are equal
    in all four are one row, ``times`` of them; a row that isn't the first with its role and
    text is a duplicate. The first is found by a grouping and a join on role, text and
    turn, which no repeated text makes hot.
    """
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    body = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumn("h", F.xxhash64("conv_id", "role", "text")).withColumn("g", F.xxhash64(F.lit(7), "text", "role", "conv_id"))
    firsts = rows.groupBy(F.col("h").alias("fh"), F.col("g").alias("fg")).agg(F.min(F.struct("turn"))["turn"].alias("first"))
    firsts = firsts.withColumn("is_first", F.lit(True))
    named = rows.join(firsts, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & F.col("turn").eqNullSafe(F.col("first")), "left")
    fault = F.when(body == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    return named.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"), (body == "").alias("blank"))


def _placed(rows: DataFrame) -> DataFrame:
    """All turns sorted by conversation, turn (nulls first), role and text, over all tasks."""
    return rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(turns: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    turns: conv_id, turn, role, text. Turns are taken by turn, nulls first, those of one
    turn by role and text. Null roles and texts are one space; an empty role has no initial
    and is never kept as it is; null conv_ids are one conversation. Blank turns and those
    whose role and text came before are deleted. gaps counts the missing numbers between
    the first and last turn. Other columns are ignored, an empty table gives an empty result.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    rows = faulted(turns)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None
        block: Block | None = None
        now, cut = None, False
        out: list[dict] = []

        def end() -> None:
            if cut:
                out.append({"conv_id": now, "long": True})
                return
            result = joined([block.said | {"ways": _ways(block, ["start"])}])
            result.pop("path")
            text = "\n".join(applied(result["audit"], block.texts))
            out.append({"conv_id": now, "long": False, **result, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()})

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return made

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            kinds = [("conv_id", conv_type), ("long", pa.bool_()), *[(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in f"{RESULT}, repaired_sha256 string".split(", ")]]
            schema = pa.schema(kinds)
            for key, turn, role, text, times, fault, blank in _rows(b):
                if block is None or key != now:
                    if block is not None:
                        end()
                    block, now, cut = Block(), key, False
                if cut or len(block.turns) + times > block_turns:
                    block, cut = Block(), True
                    continue
                block.add(turn, role, text, times, fault, blank)
            if len(out) >= 1000:
                yield batch()
        if block is not None:
            end()
        if out:
            yield batch()

    names = [c.split()[0] for c in f"{RESULT}, repaired_sha256 string".split(", ")]
    once = stored(_placed(rows).mapInArrow(parsed, f"conv_id {conv}, long boolean, {RESULT}, repaired_sha256 string"), "repaired")
    whole = once.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces"), F.first(F.struct("long", *names)).alias("r"))
    short = whole.where("pieces = 1 and not r.long").select("conv_id", *[F.col(f"r.{c}").alias(c) for c in names])
    cut_ids = stored(whole.where("pieces > 1 or r.long").select(F.col("conv_id").alias("cut_id")), "repair-cut")
    if cut_ids.isEmpty():
        return short
    cut_turns = turns.join(cut_ids, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi")
    return short.unionByName(_repair_long(faulted(cut_turns), conv, block_turns))


def _repair_long(rows: DataFrame, conv: str, block_turns: int) -> DataFrame:
    """What ``repair`` returns, of conversations that lie in several tasks or are longer than a block.

    Equal turns of one place are dealt to rows of ``block_turns`` at most. One task sees a
    conversation's audits, as they are one value of the result, and reads its repaired
    turns in a stream, as their hash needs them in order; their texts are never gathered.
    """
    pieces = F.sequence(F.lit(0), F.ceil(F.col("times") / block_turns).cast("long") - 1)
    rows = rows.withColumn("piece", F.explode(pieces)).withColumn("fault", F.when(F.col("piece") == 0, F.col("fault")).otherwise(F.when(F.col("blank"), "blank").otherwise("duplicate")))
    rows = rows.withColumn("times", F.least(F.lit(block_turns).cast("long"), F.col("times") - F.col("piece") * block_turns))
    columns = f"conv_id {conv}, turn long, role string, text string, times long, fault string, blank boolean"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, now, place = TaskContext.get().partitionId() << 33, 0, None, 0
        for b in batches:
            blocks, places = [], []
            for key, times in zip(b.column("conv_id").to_pylist(), b.column("times").to_pylist()):
                if (key != now and place) or size + times > block_turns:
                    block, size = block + 1, 0
                now, size, place = key, size + times, place + 1
                blocks.append(block)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*[b.column(c.split()[0]) for c in columns.split(", ")], pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], [*[c.split()[0] for c in columns.split(", ")], "block", "place"])

    ordered = rows.select(*[c.split()[0] for c in columns.split(", ")]).repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32)), "fault").sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == "duplicate")
    blocks = stored(ordered.mapInArrow(numbered, f"{columns}, block long, place long"), "repair-blocks")

    def as_block(table: pa.Table) -> Block:
        block = Block()
        for _, *row in _rows(table.sort_by("place")):
            block.add(*row)
        return block

    def summed(table: pa.Table) -> pa.Table:
        block = as_block(table)
        kinds = [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in TOTALS.split(", ")]
        way = pa.list_(pa.struct([("began", pa.string()), ("ended", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
        schema = pa.schema([("conv_id", table.schema.field("conv_id").type), ("block", pa.int64()), *kinds, ("ways", way)])
        row = block.said | {"conv_id": table.column("conv_id")[0].as_py(), "block": table.column("block")[0].as_py(), "ways": _ways(block, STATES)}
        return pa.Table.from_pylist([row], schema)

    sums = blocks.groupBy("conv_id", "block").applyInArrow(summed, f"conv_id {conv}, block long, {TOTALS}, {WAYS}")

    def folded(table: pa.Table) -> pa.Table:
        parts = table.sort_by("block")
        result = joined(parts.to_pylist())
        path = result.pop("path")
        kinds = [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", ")]
        schema = pa.schema([("conv_id", table.schema.field("conv_id").type), ("block", pa.int64()), ("began", pa.string()), ("part", pa.string()), *kinds])
        none = dict.fromkeys(result)
        rows_ = [{"conv_id": table.column("conv_id")[0].as_py(), "block": block, "began": began, "part": part, **(none if i else result)} for i, (block, (began, part)) in enumerate(zip(parts.column("block").to_pylist(), path))]
        return pa.Table.from_pylist(rows_, schema)

    chosen = stored(sums.groupBy("conv_id").applyInArrow(folded, f"conv_id {conv}, block long, began string, part string, {RESULT}"), "repair-ways")

    def lines(turns: pa.Table, way: pa.Table) -> pa.Table:
        made = list(applied(way.column("part")[0].as_py(), as_block(turns).texts, way.column("began")[0].as_py()))
        kept = turns.slice(0, 1)
        key, block = (pa.chunked_array([pa.array(kept.column(c).to_pylist() * len(made), kept.schema.field(c).type)]) for c in ("conv_id", "block"))
        return pa.table({"conv_id": key, "block": block, "line_no": pa.array(range(len(made)), pa.int64()), "line": pa.array([x.encode("utf-8", "surrogatepass") for x in made], pa.binary())})

    written = blocks.groupBy("conv_id", "block").cogroup(chosen.select("conv_id", "block", "began", "part").groupBy("conv_id", "block")).applyInArrow(lines, f"conv_id {conv}, block long, line_no long, line binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now, kind = None, None, None
        make = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
        for b in batches:
            kind = b.schema.field("conv_id").type
            for key, line in zip(b.column("conv_id").to_pylist(), b.column("line")):
                if digest is None or key != now:
                    if digest is not None:
                        yield make()
                    digest, now = hashlib.sha256(), key
                else:
                    digest.update(b"\n")
                digest.update(line.as_py())
        if digest is not None:
            yield make()

    hashes = written.repartition("conv_id").sortWithinPartitions("conv_id", "block", "line_no").mapInArrow(hashed, f"conv_id {conv}, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    results = chosen.where("cost is not null").drop("block", "began", "part")
    nothing = hashlib.sha256().hexdigest()
    return results.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing))).drop("of")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``turns`` with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the turn, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it and 4
    makes its role user. Nulls are one space in the key, the role and the text.
    """

    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    hurt = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def repaired_damage(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged turns, for every conversation of ``turns``; those without a turn left have zeros."""
    ids = turns.select(F.col("conv_id").alias("of")).distinct()
    found = repair(damage(turns)).withColumnRenamed("conv_id", "found_id")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("of").eqNullSafe(F.col("found_id")), "left").select(F.col("of").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
