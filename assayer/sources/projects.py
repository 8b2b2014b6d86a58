"""Controller projects (L5X XML) as tables.

A document is parsed where it is read and becomes one row an element, with the names of
the program, routine and module around it. The tables are selections from those rows, so
unknown elements and attributes stay available in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_of
from .descriptions import _per_file, binary_files

ELEMENT = "workspace string, place long, parent_place long, path string, element string, use string, target_type string, controller string, program string, routine string, instruction string, module string, attributes map<string,string>, text string"

#: Elements whose Name is carried down to what is inside them.
_SCOPES = {"Controller": "controller", "Program": "program", "Routine": "routine", "AddOnInstructionDefinition": "instruction", "Module": "module"}


def _elements(path: str, content: bytes) -> Iterator[dict]:
    root = ElementTree.fromstring(content)
    target = root.attrib.get("TargetType")
    pending, place = [(None, "", {}, root)], 0
    while pending:
        parent, above, scope, e = pending.pop()
        here = f"{above}/{e.tag}"
        if e.tag in _SCOPES and e.attrib.get("Name") is not None:
            scope = scope | {_SCOPES[e.tag]: e.attrib["Name"]}
        yield {"workspace": path, "place": place, "parent_place": parent, "path": here, "element": e.tag, "use": e.attrib.get("Use"), "target_type": target, **{c: scope.get(c) for c in _SCOPES.values()}, "attributes": list(e.attrib.items()), "text": (e.text or "").strip() or None}
        pending.extend((place, here, scope, child) for child in reversed(e))
        place += 1


def read_projects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ELEMENT rows of all L5X files below ``path``."""
    return _per_file(binary_files(spark, path, "l5x"), _elements, ELEMENT)


def invalid_targets(elements: DataFrame) -> DataFrame:
    """Documents that haven't exactly one element with Use="Target"."""
    return elements.groupBy("workspace").agg(F.count_if(F.col("use") == "Target").alias("targets")).where("targets <> 1")


def _a(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _flag(name: str) -> Column:
    return F.when(F.lower(_a(name)) == "true", True).when(F.lower(_a(name)) == "false", False)


def _child_text(elements: DataFrame, element: str) -> DataFrame:
    """workspace, parent_place and joined text of the child elements of a name."""
    own = elements.where(F.col("element") == element).where("text is not null")
    return own.groupBy("workspace", F.col("parent_place").alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "text"))), lambda s: s["text"]), "\n").alias(element.lower()))


def tags(elements: DataFrame) -> DataFrame:
    """One row a tag; program is null for controller scope. Of equal names the first stays."""
    rows = elements.where("element = 'Tag' and path like '%/Tags/Tag' and instruction is null")
    described = rows.join(_child_text(elements, "Description"), ["workspace", "place"], "left")
    out = described.select("workspace", "place", "program", _a("Name").alias("name"), F.coalesce(_a("TagType"), F.lit("Base")).alias("tag_type"), _a("DataType").alias("data_type"), _a("Dimensions").alias("dimensions"), _a("Radix").alias("radix"), _flag("Constant").alias("constant"), _a("AliasFor").alias("alias_for"), _a("ExternalAccess").alias("external_access"), "description")
    key = F.concat_ws(":", F.coalesce(F.concat(F.lit("program:"), "program"), F.lit("controller")), "name")
    first = first_of(out.withColumn("__scope", F.coalesce("program", F.lit(""))), ["workspace", "__scope", "name"], ["place"])
    return first.withColumn("tag_key", key).drop("__scope", "place")


def rungs(elements: DataFrame) -> DataFrame:
    """One row a ladder rung with its text and comment."""
    rows = elements.where("element = 'Rung'").drop("text")
    return rows.join(_child_text(elements, "Text"), ["workspace", "place"], "left").join(_child_text(elements, "Comment"), ["workspace", "place"], "left").select("workspace", "program", "instruction", "routine", _a("Number").try_cast("int").alias("rung_number"), _a("Type").alias("rung_type"), F.col("comment"), "text")


def text_lines(elements: DataFrame) -> DataFrame:
    """One row a line of structured text."""
    rows = elements.where("element = 'Line' and path like '%/STContent/Line'")
    return rows.select("workspace", "program", "instruction", "routine", _a("Number").try_cast("int").alias("line_number"), F.col("place").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))


def modules(elements: DataFrame) -> DataFrame:
    """One row a module: parent, catalog number, identity, slot and electronic key mode."""
    rows = elements.where("element = 'Module' and path like '%/Modules/Module'").withColumnRenamed("place", "at")
    keys = elements.where("element = 'EKey'").select("workspace", F.col("parent_place").alias("at"), _a("State").alias("key_mode"))
    ports = elements.where("element = 'Port'").select("workspace", "module", _a("Address").alias("address"), F.coalesce(_flag("Upstream"), F.lit(False)).alias("upstream"), _a("Type").alias("port_type"))
    slots = ports.where("upstream").groupBy("workspace", "module").agg(F.min("address").alias("address"), F.min("port_type").alias("port_type"))
    numbers = [_a(n).try_cast("int").alias(c) for n, c in (("Vendor", "vendor_id"), ("ProductType", "product_type"), ("ProductCode", "product_code"), ("Major", "major"), ("Minor", "minor"))]
    out = rows.select("workspace", "at", F.col("module").alias("name"), _a("ParentModule").alias("parent_module"), _a("CatalogNumber").alias("catalog"), *numbers, _flag("Inhibited").alias("inhibited"))
    joined = out.join(keys, ["workspace", "at"], "left").join(slots.withColumnRenamed("module", "name"), ["workspace", "name"], "left")
    return joined.withColumn("slot", F.col("address").try_cast("int")).drop("at")


def tasks(elements: DataFrame) -> DataFrame:
    """One row a task with its scheduled programs in order."""
    rows = elements.where("element = 'Task'")
    programs = elements.where("element = 'ScheduledProgram'").select("workspace", "parent_place", "place", _a("Name").alias("name"))
    holders = elements.where("element = 'ScheduledPrograms'").select("workspace", F.col("place").alias("parent_place"), F.col("parent_place").alias("task_place"))
    listed = programs.join(holders, ["workspace", "parent_place"]).groupBy("workspace", F.col("task_place").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "name"))), lambda s: s["name"]).alias("scheduled"))
    return rows.join(listed, ["workspace", "place"], "left").select("workspace", _a("Name").alias("name"), _a("Type").alias("task_type"), *[_a(n).try_cast("int").alias(n.lower()) for n in ("Rate", "Priority", "Watchdog")], F.coalesce("scheduled", F.array().cast("array<string>")).alias("scheduled"))


def datatype_members(elements: DataFrame) -> DataFrame:
    """One row a member of a user-defined type, in order."""
    types = elements.where("element = 'DataType'").select("workspace", F.col("place").alias("type_place"), _a("Name").alias("data_type"))
    holders = elements.where("element = 'Members'").select("workspace", F.col("place").alias("parent_place"), F.col("parent_place").alias("type_place"))
    rows = elements.where("element = 'Member'").select("workspace", "parent_place", "place", _a("Name").alias("name"), _a("DataType").alias("member_type"), _a("Dimension").try_cast("int").alias("dimension"), _a("Target").alias("target"), _a("BitNumber").try_cast("int").alias("bit_number"))
    return rows.join(holders, ["workspace", "parent_place"]).join(types, ["workspace", "type_place"]).select("workspace", "data_type", F.col("place").alias("ordinal"), "name", "member_type", "dimension", "target", "bit_number")


CATALOG = r"^1756-(I|O)(B|F)(\d+)"


def module_capability(catalog: Column, vendor: Column) -> dict[str, Column]:
    """direction, signal and channels of an I/O module by its catalog number (vendor 1 only)."""
    part = lambda n: F.when(vendor == 1, F.nullif(F.regexp_extract(catalog, CATALOG, n), F.lit("")))
    return {"direction": F.when(part(1) == "I", "input").when(part(1) == "O", "output"), "signal": F.when(part(2) == "B", "digital").when(part(2) == "F", "analog"), "channels": part(3).cast("int")}


def external_references(elements: DataFrame) -> DataFrame:
    """kind, name and address of every reference out of the project; is_ipv4 tells the form."""
    from ..functions.text import is_ipv4

    ports = elements.where("element = 'Port' and module is not null").select("workspace", F.lit("module_address").alias("kind"), F.col("module").alias("name"), _a("Address").alias("address"))
    messages = elements.where("element = 'MessageParameters'").select("workspace", F.lit("message_path"), F.coalesce("program", "controller"), _a("ConnectionPath"))
    consumed = elements.where("element = 'ConsumeInfo'").select("workspace", F.lit("producer"), _a("RemoteTag"), _a("Producer"))
    return ports.union(messages).union(consumed).where("address is not null and address <> ''").withColumn("is_ipv4", is_ipv4(F.col("address")))
