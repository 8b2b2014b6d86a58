"""Reusable instructions of controller projects: definitions, instances, calls and their arguments.

All joins are on equal names without case, against a side with one row a name, so a call
or a tag meets one definition or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder
from ..operators.ordering import first_of
from ..operators.resolve import longest_prefix, resolve_unique
from ..sources import projects

PLACE = ["workspace", "program", "routine", "kind", "number", "at"]
#: What an argument may stand for.
NAMED = r"^\s*([A-Za-z_]\w*)\s*(:=|=>)\s*(.*)$"


def _a(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _flag(name: str) -> Column:
    return F.when(F.lower(_a(name)) == "true", True).when(F.lower(_a(name)) == "false", False)


def definitions(elements: DataFrame) -> DataFrame:
    """One row an Add-On Instruction definition."""
    rows = elements.where("element = 'AddOnInstructionDefinition'")
    flags = [_flag(n).alias(c) for n, c in (("ExecutePrescan", "execute_prescan"), ("ExecutePostscan", "execute_postscan"), ("ExecuteEnableInFalse", "execute_enable_in_false"))]
    return rows.select("workspace", F.col("instruction").alias("name"), _a("Revision").alias("revision"), _a("Vendor").alias("vendor"), *flags)


def parameters(elements: DataFrame) -> DataFrame:
    """One row a parameter of a definition in order; of equal names the first stays.

    required_position counts the required ones from 1 and is null for the others.
    """
    rows = elements.where("element = 'Parameter' and instruction is not null and path like '%/Parameters/Parameter'")
    out = rows.select("workspace", "instruction", F.col("place").alias("ordinal"), _a("Name").alias("name"), F.lower(_a("Usage")).alias("flow"), _a("DataType").alias("data_type"), _a("Dimensions").try_cast("int").alias("dimensions"), F.coalesce(_flag("Required"), F.lit(False)).alias("required"), _a("AliasFor").alias("alias_for"))
    first = first_of(out, ["workspace", "instruction", "name"], ["ordinal"])
    nth = F.sum(F.col("required").cast("int")).over(Window.partitionBy("workspace", "instruction").orderBy("ordinal"))
    return first.withColumn("required_position", F.when(F.col("required"), nth))


def local_tags(elements: DataFrame) -> DataFrame:
    """One row a local tag of a definition; of equal names the first stays."""
    rows = elements.where("element = 'LocalTag' and instruction is not null")
    out = rows.select("workspace", "instruction", F.col("place").alias("ordinal"), _a("Name").alias("name"), _a("DataType").alias("data_type"), _a("Dimensions").try_cast("int").alias("dimensions"))
    return first_of(out, ["workspace", "instruction", "name"], ["ordinal"])


def instances(elements: DataFrame) -> DataFrame:
    """Program tags whose data type is a definition's name: workspace, program, tag, definition, status.

    status is ``resolved``, or ``ambiguous`` where several definitions have the name; the
    definition is null then. Tags of other types aren't listed.
    """
    tags = projects.tags(elements).where("program is not null and data_type is not null").select("workspace", "program", F.col("name").alias("tag"), "data_type")
    known = definitions(elements).select(F.col("name").alias("type_name"), F.col("name").alias("definition"))
    return resolve_unique(tags, known, {"data_type": "type_name"}, "definition", fold_case=True).where("status <> 'missing'").select("workspace", "program", "tag", "definition", "status")


def calls(elements: DataFrame) -> DataFrame:
    """Every outermost call in a program's rungs and lines: PLACE, callee and arguments.

    at is the call's position in its rung or line, from 0.
    """
    rung = projects.rungs(elements).select("workspace", "program", "routine", F.lit("rung").alias("kind"), F.col("rung_number").alias("number"), "text")
    line = projects.text_lines(elements).select("workspace", "program", "routine", F.lit("line").alias("kind"), F.col("line_number").alias("number"), "text")
    both = rung.union(line).where("program is not null")
    return both.select("workspace", "program", "routine", "kind", "number", F.posexplode(ladder.calls(F.col("text"))).alias("at", "call")).select(*PLACE, F.col("call.callee").alias("callee"), F.col("call.operands").alias("arguments"))


def resolved_calls(elements: DataFrame) -> DataFrame:
    """Calls of definitions: PLACE, callee, arguments, definition, definition_workspace, status.

    status is ``resolved``, or ``ambiguous`` where several definitions have the name.
    Calls of anything else aren't listed.
    """
    known = definitions(elements).select(F.col("name").alias("called"), F.struct(F.col("name").alias("definition"), F.col("workspace").alias("home")).alias("hit"))
    found = resolve_unique(calls(elements), known, {"callee": "called"}, "hit", fold_case=True).where("status <> 'missing'")
    return found.select(*PLACE, "callee", "arguments", F.col("hit.definition").alias("definition"), F.col("hit.home").alias("definition_workspace"), "status")


def argument_bindings(elements: DataFrame) -> DataFrame:
    """One row an argument of a resolved call: role, parameter, flow and the tag that it names.

    PLACE, position, argument, definition, role, parameter, flow, tag_key. The first
    argument without a name that is a program tag of the definition's type is the
    instance. A named argument binds the parameter of its name; the others bind the
    required parameters in order. role is ``instance``, ``parameter`` or ``unmatched``. A
    program's tag shadows the controller's.
    """
    call = resolved_calls(elements).where("status = 'resolved'")
    given = call.select(*PLACE, "definition", "definition_workspace", F.posexplode("arguments").alias("position", "argument"))
    named = F.nullif(F.regexp_extract("argument", NAMED, 1), F.lit(""))
    given = given.withColumn("named", named).withColumn("source", F.when(named.isNotNull(), F.trim(F.regexp_extract("argument", NAMED, 3))).otherwise(F.trim("argument")))
    tags = projects.tags(elements)
    own = tags.where("program is not null").groupBy("workspace", "program", F.lower("name").alias("folded")).agg(F.min(F.struct("tag_key", F.lower("data_type").alias("type"))).alias("own"))
    shared = tags.where("program is null").groupBy("workspace", F.lower("name").alias("folded")).agg(F.min("tag_key").alias("shared"))
    given = given.withColumn("folded", F.lower("source")).join(own, ["workspace", "program", "folded"], "left").join(shared, ["workspace", "folded"], "left")
    one_call = Window.partitionBy(*PLACE).orderBy("position")
    is_instance = (F.col("position") == 0) & F.col("named").isNull() & F.coalesce(F.col("own.type") == F.lower("definition"), F.lit(False))
    given = given.withColumn("instance", is_instance)
    given = given.withColumn("turn", F.sum((F.col("named").isNull() & ~F.col("instance")).cast("int")).over(one_call))
    wanted = parameters(elements).select(F.col("workspace").alias("definition_workspace"), F.col("instruction").alias("definition"), F.col("name").alias("parameter"), "flow", "required_position")
    by_name = wanted.select("definition_workspace", "definition", F.lower("parameter").alias("named_key"), F.struct("parameter", "flow").alias("by_name"))
    by_turn = wanted.where("required_position is not null").select("definition_workspace", "definition", F.col("required_position").alias("turn_key"), F.struct("parameter", "flow").alias("by_turn"))
    keyed = given.withColumn("named_key", F.lower("named")).withColumn("turn_key", F.when(F.col("named").isNull() & ~F.col("instance"), F.col("turn")))
    joined = keyed.join(by_name, ["definition_workspace", "definition", "named_key"], "left").join(by_turn, ["definition_workspace", "definition", "turn_key"], "left")
    hit = F.coalesce("by_name", "by_turn")
    role = F.when(F.col("instance"), "instance").when(hit.isNotNull(), "parameter").otherwise("unmatched")
    return joined.select(*PLACE, "position", "argument", "definition", role.alias("role"), hit["parameter"].alias("parameter"), hit["flow"].alias("flow"), F.coalesce("own.tag_key", "shared").alias("tag_key"))


def module_operands(elements: DataFrame) -> DataFrame:
    """Operands of calls that name a module: workspace, operand, module, path and direction.

    An operand is a module's name, or goes on after it with a colon; the longest name wins.
    """
    operand = calls(elements).select("workspace", F.explode("arguments").alias("operand")).where("operand <> ''").distinct()
    rows = operand.withColumn("id", F.concat_ws("\n", "workspace", "operand")).withColumn("text", F.concat(F.col("workspace"), F.lit("\n"), F.lower("operand"), F.lit(":")))
    prefixes = projects.modules(elements).select(F.concat(F.col("workspace"), F.lit("\n"), F.lower("name"), F.lit(":")).alias("prefix"))
    found = longest_prefix(rows, "text", "id", prefixes, "prefix", separator=":").where("prefix is not null")
    name_size = F.length("prefix") - F.length("workspace") - 2
    path = F.nullif(F.substr("operand", name_size + 2), F.lit(""))
    area = F.lower(F.substring_index(path, ".", 1))
    direction = F.when(area == "i", "input").when(area == "o", "output").when(area == "c", "configuration").when(area == "s", "status").otherwise("unknown")
    return found.select("workspace", "operand", F.substring("operand", F.lit(1), name_size).alias("module"), path.alias("path"), direction.alias("direction"))


def software_modules(elements: DataFrame) -> DataFrame:
    """Instances with the calls and the sorted arguments that tie them to modules.

    workspace, program, definition, instance, calls and modules: the grouping of resolved
    calls by instance whose arguments name a module.
    """
    bound = argument_bindings(elements)
    instance = bound.where("role = 'instance'").select(*PLACE, "definition", F.col("tag_key").alias("instance"))
    module = bound.where("role <> 'instance'").select(*PLACE, F.trim(F.regexp_replace("argument", r"^\s*[A-Za-z_]\w*\s*(:=|=>)\s*", "")).alias("operand")).join(module_operands(elements).select("workspace", "operand", "module"), ["workspace", "operand"])
    return instance.join(module, PLACE).groupBy("workspace", "program", "definition", "instance").agg(F.countDistinct("routine", "kind", "number", "at").alias("calls"), F.array_sort(F.collect_set("module")).alias("modules"))


def portability(elements: DataFrame, native: tuple[str, ...] = ladder.EXECUTABLE) -> DataFrame:
    """Definitions and whether their code runs elsewhere: workspace, name, disposition, blocking.

    disposition is ``portable`` where every call inside is one of ``native`` or of another
    definition, ``empty`` without any code, else ``blocked`` by the sorted names in blocking.
    """
    inside = projects.rungs(elements).where("instruction is not null").select("workspace", "instruction", "text").union(projects.text_lines(elements).where("instruction is not null").select("workspace", "instruction", "text"))
    called = inside.withColumn("call", F.explode_outer(ladder.calls(F.col("text")))).select("workspace", F.col("instruction").alias("name"), F.upper("call.callee").alias("callee"))
    own = definitions(elements).select(F.upper("name").alias("callee")).distinct().withColumn("own", F.lit(True))
    foreign = called.join(own, "callee", "left").withColumn("foreign", F.when(~F.col("callee").isin(*native) & F.col("own").isNull(), F.col("callee")))
    counts = foreign.groupBy("workspace", "name").agg(F.array_sort(F.collect_set("foreign")).alias("blocking"))
    out = definitions(elements).select("workspace", "name").join(counts, ["workspace", "name"], "left")
    disposition = F.when(F.col("blocking").isNull(), "empty").when(F.size("blocking") > 0, "blocked").otherwise("portable")
    return out.select("workspace", "name", disposition.alias("disposition"), F.coalesce("blocking", F.array().cast("array<string>")).alias("blocking"))


# Parameters of the two interfaces, their control input first, and of extensions.
INTERFACES = {"EDGE_TRIGGERED": ("Execute", "Done", "Busy", "Error", "ErrorID"), "LEVEL_CONTROLLED": ("Enable", "Valid", "Busy", "Error", "ErrorID")}
EXTENSIONS = ("Abort", "Aborted", "TimeOut", "TimeLimit")
TYPE_PREFIXES = ("", "x", "i", "udi")


def behaviour(given: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, match, missing and extensions: the function block interface of an instruction.

    given: keys, name and flow (input, output, ...) of every parameter. Names compare without
    case, underscores and type prefixes. model is EDGE_TRIGGERED with an Execute parameter,
    LEVEL_CONTROLLED with an Enable one, AMBIGUOUS with both, else NONE; match is COMPLETE
    if no member is missing, the control is an input and the others are outputs.
    """
    plain = F.lower(F.replace("name", F.lit("_"), F.lit("")))
    named = given.groupBy(*keys).agg(F.collect_set(F.struct(plain.alias("name"), F.lower("flow").alias("flow"))).alias("given"))
    has = lambda n, *flow: F.exists("given", lambda g: g["name"].isin(*[p + n.lower() for p in TYPE_PREFIXES]) & (g["flow"].isin(*flow) if flow else F.lit(True)))
    execute, enable = has("Execute"), has("Enable")
    model = F.when(execute & enable, "AMBIGUOUS").when(execute, "EDGE_TRIGGERED").when(enable, "LEVEL_CONTROLLED").otherwise("NONE")
    absent, sound = F.array().cast("array<string>"), F.lit(False)
    for name, members in INTERFACES.items():
        absent = F.when(model == name, F.array_compact(F.array(*[F.when(~has(m), F.lit(m)) for m in members]))).otherwise(absent)
        fits = has(members[0], "input")
        for m in members[1:]:
            fits = fits & has(m, "output")
        sound = F.when(model == name, fits).otherwise(sound)
    match = F.when(model.isin("AMBIGUOUS", "NONE"), model).when(sound, "COMPLETE").otherwise("PARTIAL")
    extra = F.when(model.isin(*INTERFACES), F.array_compact(F.array(*[F.when(has(e), F.lit(e)) for e in EXTENSIONS]))).otherwise(F.array().cast("array<string>"))
    return named.select(*keys, model.alias("model"), match.alias("match"), absent.alias("missing"), extra.alias("extensions"))


def functional_summary(elements: DataFrame) -> DataFrame:
    """Counts of what a project holds: programs, routines, rungs, tags, tasks, definitions, calls and distinct callees."""
    kinds = {"Program": "programs", "Routine": "routines", "Rung": "rungs", "Tag": "tags", "Task": "tasks", "AddOnInstructionDefinition": "definitions"}
    counts = elements.groupBy("workspace").agg(*[F.count_if((F.col("element") == e) & (F.col("instruction").isNull() | F.lit(e == "AddOnInstructionDefinition"))).alias(c) for e, c in kinds.items()])
    called = calls(elements).groupBy("workspace").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(F.upper("callee")).alias("callees"))
    return counts.join(called, "workspace", "left").na.fill(0, ["calls", "callees"])


def corpus_lines(elements: DataFrame) -> DataFrame:
    """n and value: the lines of a Markdown summary of a corpus and its documents, ready for ``write.text`` in order."""
    from .report import markdown

    roots = elements.where("path = '/RSLogix5000Content'").select(F.col("target_type").alias("Target type"), F.try_element_at("attributes", F.lit("TargetName")).alias("Target name"), F.col("workspace").alias("Source"))
    return markdown(roots, "Corpus", ["Source"])
