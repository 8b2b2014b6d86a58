"""Ladder rungs and structured text: calls, operands and how a call uses them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import radix_literal

# What instructions do with their operands.
READS = ("XIC", "XIO", "EQU", "NEQ", "GRT", "GEQ", "LES", "LEQ")
WRITES_FIRST = ("OTE", "OTL", "OTU")
STATE_FIRST = ("TON", "TOF", "RTO", "CTU", "CTD", "RES", "ONS")
DESTINATION = {"MOV": 1, "ADD": 2, "SUB": 2, "MUL": 2, "DIV": 2}
#: Instructions that can be run elsewhere as they are.
EXECUTABLE = (*READS, *WRITES_FIRST, *STATE_FIRST, *DESTINATION, "JSR", "NOP", "OSR", "AFI")

#: A tag is a name, or a module's data: its name, then slot or connection parts after
#: colons, numbers or names. Subscripts and members follow in any order, as in
#: ``Line[2].Step[1,Next].Mask.7``: a member is a name or a bit's number, and an index may
#: itself have a subscript.
OPERAND = r"([A-Za-z_]\w*(?::(?:\d+|[A-Za-z_]\w*))*(?:\[(?:[^\[\]]|\[[^\[\]]*\])+\]|\.(?:\d+|[A-Za-z_]\w*))*)"
_PART = re.compile(r"\"[^\"]*\"?|'[^']*'?|(?P<name>[^\W\d][\w.$:]*)\s*\(|[()\[\]{},]")


def calls_of(text: str) -> list[dict]:
    """Outermost calls of a rung with their operands: brackets balance, quotes hide.

    A call whose bracket is never closed is skipped, and what is inside it is read.
    """
    out, at = [], 0
    while m := _PART.search(text, at):
        at = m.end()
        if not m["name"]:
            continue
        depth, start, operands, inner = 1, m.end(), [], m.end()
        while depth and (p := _PART.search(text, inner)):
            inner, sign = p.end(), p[0][-1]
            if p["name"] or sign in "([{":
                depth += 1
            elif sign in ")]}":
                depth -= 1
            if (sign == "," and depth == 1) or not depth:
                operands.append(text[start : p.end() - 1].strip())
                start = p.end()
        if not depth:
            at = inner
            out.append({"callee": m["name"], "operands": operands if operands != [""] else []})
    return out


def calls(text: Column) -> Column:
    """array<struct<callee, operands>> of a rung's or a line's outermost calls, in order."""

    @F.pandas_udf("array<struct<callee:string,operands:array<string>>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield some.map(calls_of, na_action=None)

    return found(F.coalesce(text, F.lit("")))


def access(callee: Column, position: Column, direction: Column) -> Column:
    """READ, WRITE, READ_WRITE or UNKNOWN for an operand; := and => say it outright."""
    opcode = F.upper(callee)
    out = F.when(direction == ":=", "READ").when(direction == "=>", "WRITE").when(opcode.isin(*READS), "READ")
    out = out.when(opcode.isin(*WRITES_FIRST) & (position == 0), "WRITE")
    out = out.when(opcode.isin(*STATE_FIRST), F.when(position == 0, "READ_WRITE").otherwise("READ"))
    for name, at in DESTINATION.items():
        out = out.when(opcode == name, F.when(position == at, "WRITE").otherwise("READ"))
    return out.otherwise("UNKNOWN")


def operand_paths(operand: Column) -> Column:
    """Identifiers of an operand with subscript and members, without true and false."""
    return F.filter(F.regexp_extract_all(operand, F.lit(OPERAND), F.lit(1)), lambda w: ~F.lower(w).isin("true", "false"))


def jsr_target(text: Column) -> Column:
    """Routine that a rung of nothing but a JSR calls, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*JSR\(\s*([A-Za-z_]\w*)\s*(?:,[^)]*)?\)\s*;?\s*$", 1), F.lit(""))


def statements(text: Column) -> Column:
    """Statements of structured text: comments go, ; ends one."""
    bare = F.regexp_replace(text, r"(?s)\(\*.*?\*\)|/\*.*?\*/|//[^\n]*", " ")
    return F.filter(F.transform(F.split(bare, ";"), lambda s: F.trim(s)), lambda s: s != "")


def statement_uses(statement: Column) -> Column:
    """array<struct<instruction, position, access, operand>> of one statement.

    An assignment writes its left side and reads its right one; IF, ELSIF and WHILE read
    their condition. Calls are left to ``calls``.
    """
    assign = r"(?s)^(?:.*?\b(?:THEN|ELSE|DO)\b)?\s*([A-Za-z_][\w.:\[\], ]*?)\s*:=\s*(.+)$"
    target, value = F.regexp_extract(statement, assign, 1), F.regexp_extract(statement, assign, 2)
    condition = F.regexp_extract(statement, r"(?is)\b(?:IF|ELSIF|WHILE)\b(.*?)\b(?:THEN|DO)\b", 1)
    kind = F.when(F.upper(statement).rlike(r"\bWHILE\b"), "ST_WHILE").otherwise("ST_IF")

    def use(instruction: Column | str, position: int, how: str, operand: Column) -> Column:
        name = F.lit(instruction) if isinstance(instruction, str) else instruction
        return F.when(operand != "", F.struct(name.alias("instruction"), F.lit(position).alias("position"), F.lit(how).alias("access"), operand.alias("operand")))

    return F.array_compact(F.array(use("ST_ASSIGN", 0, "WRITE", target), use("ST_ASSIGN", 1, "READ", value), use(kind, 0, "READ", condition)))


def literal_assignments(text: Column) -> Column:
    """array<struct<target, indices, value>> of the assignments of a whole-number literal in structured text.

    indices are those of a target with literal subscripts, else empty. Numbers may have a radix.
    """
    pattern = r"(?s)^(?:.*?\b(?:THEN|ELSE|DO)\b)?\s*([A-Za-z_][\w.:\[\], ]*?)\s*:=\s*([+-]?[0-9][0-9A-Fa-f_#xX]*)$"
    part = lambda s, n: F.regexp_extract(s, pattern, n)
    subscripts = lambda t: F.regexp_extract(t, r"\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]$", 1)
    indices = lambda t: F.when(subscripts(t) != "", F.transform(F.split(subscripts(t), r"\s*,\s*"), lambda x: x.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    found = F.transform(statements(text), lambda s: F.struct(part(s, 1).alias("target"), indices(part(s, 1)).alias("indices"), radix_literal(part(s, 2)).alias("value")))
    return F.filter(found, lambda a: (a["target"] != "") & a["value"].isNotNull())


def line_comment(text: Column) -> Column:
    """What follows // on a line, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"//([^\n]*)", 1)), F.lit(""))


def statement_kind(statement: Column) -> Column:
    """assignment, control, call or unknown: what a statement of structured text is."""
    control = F.upper(statement).rlike(r"^(IF|ELSIF|ELSE|WHILE|FOR|CASE|REPEAT|UNTIL|EXIT|RETURN|END_\w+)\b")
    return F.when(control, "control").when(statement.rlike(r"(?s)^[A-Za-z_][\w.:\[\], ]*\s*:="), "assignment").when(statement.rlike(r"(?s)^[A-Za-z_]\w*\s*\(.*\)$"), "call").otherwise("unknown")


# Words that begin a control statement, and those that end one's head.
CONTROL = ("IF", "ELSIF", "ELSE", "CASE", "WHILE", "FOR", "REPEAT", "UNTIL", "EXIT", "RETURN", "END_IF", "END_CASE", "END_WHILE", "END_FOR", "END_REPEAT")
HEAD_ENDS = ("THEN", "DO", "OF")
#: Those that are a statement of their own.
ALONE = ("ELSE", "REPEAT")
_TOKEN = re.compile(r"(?P<comment>\(\*.*?(?:\*\)|$)|/\*.*?(?:\*/|$)|//[^\n]*)|(?P<quoted>'(?:\$.|[^'$])*'?|\"(?:\$.|[^\"$])*\"?)|(?P<word>[^\W\d]\w*)|(?P<assign>:=)|.", re.S)


def scan_statements(text: str) -> list[dict]:
    """kind, text and line of every statement of structured text, in order.

    One pass over the tokens: comments go, quotes hide what is in them, and a statement ends at a
    semicolon, or after the head of a control statement, outside of brackets. kind is control (by
    its first word), assignment (it has := outside of brackets), call (a name and brackets to its end) or unknown.
    """
    out: list[dict] = []
    words: list[str] = []
    depth, line, begun, first, assigns, closed = 0, 1, 0, "", False, False

    def end() -> None:
        nonlocal words, first, assigns, closed, depth
        whole = "".join(words).strip()
        if whole:
            named = re.match(r"[^\W\d][\w.]*\s*\(", whole)
            kind = "control" if first.upper() in CONTROL else "assignment" if assigns else "call" if named and closed else "unknown"
            out.append({"kind": kind, "text": whole, "line": begun})
        words, first, assigns, closed, depth = [], "", False, False, 0

    for m in _TOKEN.finditer(text):
        token, word = m[0], m["word"]
        if m["comment"]:
            if first:
                words.append(" ")
        elif token == ";" and not depth or word and not depth and first and word.upper() in HEAD_ENDS:
            end()
        elif first or not token.isspace():
            if not first:
                begun, first = line, word or token
            words.append(token)
            if token in "([":
                depth += 1
            elif token in ")]":
                depth = max(0, depth - 1)
            assigns |= bool(m["assign"]) and not depth
            if not token.isspace():
                closed = token == ")" and not depth
            if len(words) == 1 and word and word.upper() in ALONE:
                end()
        line += token.count("\n")
    end()
    return out


def scanned_statements(text: Column) -> Column:
    """array<struct<kind, text, line>> of the statements of structured text."""

    @F.pandas_udf("array<struct<kind:string,text:string,line:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield some.map(scan_statements, na_action=None)

    return found(F.coalesce(text, F.lit("")))
