"""Engineering reports over controller projects: references, alarms, causes, I/O, coverage.

All take the element rows of any number of projects (``sources.projects``) and keep the
workspace in every key, so a corpus is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladder
from ..functions.hashing import relationship_key
from ..functions.text import has_token, member_of, root_of
from ..operators.aggregate import percent
from ..operators.ordering import numbered
from ..sources import projects

LOCATION = ["workspace", "program", "routine", "rung_number", "line_number"]
ALARM_WORDS, TRIP_WORDS = ("alarm", "alarms", "alm"), ("trip", "trips")


def uses(elements: DataFrame) -> DataFrame:
    """Every operand of every instruction, statement and alias, with its place and access."""
    empty = F.lit(None)
    rung = projects.rungs(elements).where("program is not null")
    line = projects.text_lines(elements).where("program is not null")
    place = lambda rows, number, at: rows.select("workspace", "program", "routine", number.cast("int").alias("rung_number"), at.cast("int").alias("line_number"), "text")
    both = place(rung, F.col("rung_number"), empty).union(place(line, empty, F.col("line_number")))
    called = both.withColumn("call", F.explode(ladder.calls(F.col("text")))).select(*LOCATION, F.col("call.callee").alias("instruction"), F.posexplode("call.operands").alias("position", "operand"))
    named = r"^\s*[A-Za-z_]\w*\s*(:=|=>)\s*(.*)$"
    direction = F.nullif(F.regexp_extract("operand", named, 1), F.lit(""))
    called = called.withColumn("direction", direction).withColumn("operand", F.when(F.col("direction").isNotNull(), F.regexp_extract("operand", named, 2)).otherwise(F.col("operand")))
    called = called.where(~F.upper("instruction").isin("IF", "ELSIF", "WHILE", "AND", "OR", "NOT"))
    called = called.select(*LOCATION, "instruction", "position", ladder.access(F.col("instruction"), F.col("position"), F.col("direction")).alias("access"), "operand", empty.cast("string").alias("source_tag_key"))
    stated = place(line, empty, F.col("line_number")).withColumn("statement", F.explode(ladder.statements(F.col("text")))).withColumn("use", F.explode(ladder.statement_uses(F.col("statement"))))
    stated = stated.select(*LOCATION, "use.instruction", "use.position", "use.access", "use.operand", empty.cast("string").alias("source_tag_key"))
    alias = projects.tags(elements).where("alias_for is not null and alias_for <> ''").select("workspace", F.coalesce("program", F.lit("<controller>")).alias("program"), F.lit("<tag-definition>").alias("routine"), empty.cast("int").alias("rung_number"), empty.cast("int").alias("line_number"), F.lit("ALIAS").alias("instruction"), F.lit(0).alias("position"), F.lit("ALIAS").alias("access"), F.col("alias_for").alias("operand"), F.col("tag_key").alias("source_tag_key"))
    return called.union(stated).union(alias)


def tag_references(elements: DataFrame) -> DataFrame:
    """Uses by identifier with the tag they resolve to; tag_key is null where none does.

    A program's tag shadows the controller's; names compare without case.
    """
    tags = projects.tags(elements)
    found = uses(elements).withColumn("identifier", F.explode(ladder.operand_paths(F.col("operand"))))
    found = found.withColumn("__root", F.lower(root_of(F.col("identifier"))))
    pick = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct("tag_key", "name")).alias("hit"))
    own = pick(tags.where("program is not null").withColumn("__root", F.lower("name")), "workspace", "program", "__root").withColumnRenamed("hit", "own")
    shared = pick(tags.where("program is null").withColumn("__root", F.lower("name")), "workspace", "__root").withColumnRenamed("hit", "shared")
    joined = found.join(own, ["workspace", "program", "__root"], "left").join(shared, ["workspace", "__root"], "left").withColumn("hit", F.coalesce("own", "shared"))
    scope = F.when(F.col("own").isNotNull(), "program").when(F.col("shared").isNotNull(), "controller")
    return joined.select(*LOCATION, "instruction", "position", "access", "operand", "source_tag_key", "identifier", F.col("hit.tag_key").alias("tag_key"), F.col("hit.name").alias("tag_name"), scope.alias("tag_scope"), member_of(F.col("identifier")).alias("member_path"))


def alarm_candidates(elements: DataFrame, references: DataFrame) -> DataFrame:
    """Tags whose name or description says alarm or trip, with where they are read and written."""
    tags = projects.tags(elements)
    says = {k: has_token(F.col("name"), w) | has_token(F.col("description"), w) for k, w in (("alarm", ALARM_WORDS), ("trip", TRIP_WORDS))}
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in says.items()]))
    chosen = tags.withColumn("kinds", kinds).where(F.size("kinds") > 0).select("workspace", "tag_key", "name", "program", "description", "kinds")
    at = F.concat_ws("/", "program", "routine", F.coalesce(F.col("rung_number"), F.col("line_number")).cast("string"))
    when = lambda *how: F.array_sort(F.collect_set(F.when(F.col("access").isin(*how), at)))
    sites = references.where("tag_key is not null").groupBy("workspace", "tag_key").agg(when("READ", "READ_WRITE").alias("readers"), when("WRITE", "READ_WRITE").alias("writers"), F.array_sort(F.collect_set(F.when(F.col("access") == "ALIAS", F.col("source_tag_key")))).alias("aliases"))
    return chosen.join(sites, ["workspace", "tag_key"], "left")


def cause_effects(alarms: DataFrame, references: DataFrame) -> DataFrame:
    """Writes of alarm tags with every other tag read, and every unknown operand, at the same place."""
    writes = references.join(alarms.select("workspace", "tag_key", "kinds"), ["workspace", "tag_key"]).where(F.col("access").isin("WRITE", "READ_WRITE"))
    effect = writes.select(*LOCATION, F.col("tag_key").alias("effect_tag_key"), "kinds", F.col("instruction").alias("write_instruction"), F.col("operand").alias("write_operand")).alias("e")
    status = F.when(F.col("tag_key").isNull(), "unresolved").otherwise("resolved")
    cause = references.where(F.col("tag_key").isNull() | F.col("access").isin("READ", "READ_WRITE")).select(*LOCATION, status.alias("cause_status"), F.coalesce("tag_key", "identifier").alias("cause"), F.when(F.col("tag_key").isNotNull(), F.col("member_path")).alias("cause_member"), F.col("instruction").alias("cause_instruction"), F.col("operand").alias("cause_operand")).distinct().alias("c")
    same = [F.col(f"e.{x}").eqNullSafe(F.col(f"c.{x}")) for x in LOCATION]
    pairs = effect.join(cause, [*same, F.col("cause") != F.col("effect_tag_key")]).select("e.*", *[F.col(f"c.{x}") for x in ("cause_status", "cause", "cause_member", "cause_instruction", "cause_operand")])
    fields: dict[str, Column] = {"program": F.col("program"), "routine": F.col("routine"), "rung": F.col("rung_number"), "line": F.col("line_number"), "effect_tag_key": F.col("effect_tag_key"), "write_instruction": F.col("write_instruction"), "write_operand": F.col("write_operand"), "cause_status": F.col("cause_status"), "cause_operand": F.col("cause_operand"), "cause_instruction": F.col("cause_instruction"), "cause_identity": F.array("cause", "cause_member")}
    return pairs.withColumn("relationship_key", relationship_key(fields)).distinct()


CHANNEL = r"^[^:]+:(\d+):(I|O)\.(?:Data\.(\d+)|Ch(\d+)Data)$"


def channel_states(modules: DataFrame, assigned: DataFrame, keys: list[str], channels: str, tags: str) -> DataFrame:
    """Every channel (0 on) of every module with its tags and status, ``assigned`` or ``spare``.

    modules: keys and ``channels`` (their number) besides others; assigned: keys, channel, ``tags``.
    """
    every = modules.where(F.col(channels) > 0).withColumn("channel", F.explode(F.sequence(F.lit(0), (F.col(channels) - 1).cast("int"))))
    joined = every.join(assigned, [*keys, "channel"], "left")
    return joined.withColumn("status", F.when(F.col(tags).isNull(), "spare").otherwise("assigned"))


def channel_counts(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of channels, and of assigned and spare ones, of every module that has any."""
    return channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("channels"), F.count_if(F.col("status") == "assigned").alias("assigned"), F.count_if(F.col("status") == "spare").alias("spare"))


def io_list(elements: DataFrame) -> DataFrame:
    """A row for every channel of every I/O module with the tags that alias it.

    status is ``assigned`` or ``spare``. The slot alone tells modules apart, as aliases
    don't name a chassis.
    """
    modules = projects.modules(elements).withColumns(projects.module_capability(F.col("catalog"), F.col("vendor_id")))
    group = lambda n: F.nullif(F.regexp_extract("alias_for", CHANNEL, n), F.lit(""))
    aliases = projects.tags(elements).where("alias_for is not null").select("workspace", group(1).cast("int").alias("slot"), F.when(group(2) == "I", "input").when(group(2) == "O", "output").alias("direction"), F.coalesce(group(3), group(4)).cast("int").alias("channel"), "name").where("slot is not null")
    assigned = aliases.groupBy("workspace", "slot", "direction", "channel").agg(F.array_sort(F.collect_set(F.col("name"))).alias("tags"))
    joined = channel_states(modules, assigned, ["workspace", "slot", "direction"], "channels", "tags")
    return joined.select("workspace", F.col("name").alias("module"), "slot", "catalog", "direction", "signal", "channel", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "status")


def module_schedule(elements: DataFrame, channels: DataFrame) -> DataFrame:
    """assigned and spare channels of every module, modules without channels included."""
    counts = channel_counts(channels, ["workspace", "module"]).withColumnRenamed("module", "name").drop("channels")
    return projects.modules(elements).join(counts, ["workspace", "name"], "left").na.fill(0, ["assigned", "spare"])


def value_assessment(value: Column, options: Column, least: Column, most: Column) -> Column:
    """What a parameter's value is: no value, labelled option, below range, above range or in range.

    options: array of the labelled values; numbers compare as decimals.
    """
    labelled = F.exists(options, lambda o: o == value)
    return F.when(value.isNull(), "no value").when(labelled, "labelled option").when(value < least, "below range").when(value > most, "above range").otherwise("in range")


def rung_coverage(elements: DataFrame) -> DataFrame:
    """occurrences, executable and percent of every instruction of the ladder rungs."""
    found = projects.rungs(elements).withColumn("call", F.explode(ladder.calls(F.col("text")))).select("workspace", F.col("call.callee").alias("mnemonic"))
    out = found.groupBy("workspace", "mnemonic").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.upper("mnemonic").isin(*ladder.EXECUTABLE)).alias("executable"))
    return out.withColumn("percent", percent(F.col("executable"), F.col("occurrences")))


def produced_consumed(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consumed tags joined with the one tag that another controller produces for them, and the rest.

    Controllers and tags compare without case. A consumed tag without a remote tag, or
    with no or several matches, is in the second table with match_count.
    """
    a = lambda n: F.try_element_at("attributes", F.lit(n))
    owner = elements.where("element = 'Tag'").select("workspace", F.col("place").alias("parent_place"), a("Name").alias("tag"))
    info = lambda e: elements.where(F.col("element") == e).join(owner, ["workspace", "parent_place"])
    produced = info("ProduceInfo").select(F.lower("controller").alias("__producer"), F.lower("tag").alias("__remote"), F.col("workspace").alias("producer_workspace"), F.col("tag").alias("produced_tag"), a("ProduceCount").try_cast("int").alias("produce_count"))
    consumed = info("ConsumeInfo").select("workspace", "controller", "tag", a("Producer").alias("producer"), a("RemoteTag").alias("remote_tag"), a("RemoteFile").try_cast("int").alias("remote_file"), a("RPI").try_cast("double").alias("rpi"))
    one = produced.groupBy("__producer", "__remote").agg(F.count(F.lit(1)).alias("match_count"), F.first(F.struct("producer_workspace", "produced_tag", "produce_count")).alias("hit"))
    joined = consumed.join(one, (F.lower("producer") == F.col("__producer")) & (F.lower("remote_tag") == F.col("__remote")), "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return joined.where("match_count = 1").select(*consumed.columns, "hit.*"), joined.where("match_count <> 1").select(*consumed.columns, "match_count")


def workspace_of_components(elements: DataFrame) -> DataFrame:
    """workspace, target_type, context and assigned_to of every document that isn't a controller.

    A component belongs to the controller document that has its context controller's
    name; with none or several it stays by itself.
    """
    roots = elements.where("element = 'Controller'").select("workspace", "target_type", F.col("controller").alias("context"))
    homes = roots.where("target_type = 'Controller'").groupBy("context").agg(F.min("workspace").alias("home"), F.count(F.lit(1)).alias("homes"))
    return roots.where("target_type <> 'Controller'").join(homes, "context", "left").select("workspace", "target_type", "context", F.when(F.col("homes") == 1, F.col("home")).alias("assigned_to"))


def reports(elements: DataFrame) -> dict[str, DataFrame]:
    references = tag_references(elements)
    alarms = alarm_candidates(elements, references)
    channels = io_list(elements)
    linked, unlinked = produced_consumed(elements)
    return {
        "tag_references": references.where("tag_key is not null"), "unresolved_references": references.where("tag_key is null"), "alarm_candidates": alarms,
        "cause_effects": cause_effects(alarms, references), "io_list": channels, "module_schedule": module_schedule(elements, channels), "rung_coverage": rung_coverage(elements),
        "produced_consumed": linked, "unresolved_consumed": unlinked, "external_references": projects.external_references(elements), "tasks": projects.tasks(elements), "components": workspace_of_components(elements),
    }


def flat(table: DataFrame) -> DataFrame:
    """Arrays as text, for files that hold no arrays; columns and rows in a fixed order."""
    out = [F.concat_ws("; ", c).alias(c) if kind.startswith("array<string") else F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in table.dtypes]
    return table.select(*out)


def write_reports(elements: DataFrame, folder: str) -> None:
    """One folder of CSV files and one of JSON lines for every report."""
    for name, table in reports(elements).items():
        flat(table).write.mode("overwrite").option("header", True).csv(f"{folder}/csv/{name}")
        table.write.mode("overwrite").json(f"{folder}/json/{name}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 and bytes of every file below a report folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and fault (missing, unexpected or changed) of files that differ from a manifest."""
    a, e = actual.select("path", F.col("sha256").alias("sha_a")), expected.select("path", F.col("sha256").alias("sha_e"))
    fault = F.when(F.col("sha_a").isNull(), "missing").when(F.col("sha_e").isNull(), "unexpected").when(F.col("sha_a") != F.col("sha_e"), "changed")
    return e.join(a, "path", "full").select("path", fault.alias("fault")).where("fault is not null")


def markdown(table: DataFrame, title: str, order: list[str]) -> DataFrame:
    """Lines of a Markdown table in a total order, ready for ``write.text``."""
    head = table.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(table.columns) + " |"), (3, "|" + " --- |" * len(table.columns))], "n long, value string")
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in flat(table).columns]
    body = numbered(flat(table), order, "__row").select((F.col("__row") + 3).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return head.union(body).orderBy("n").select("value")

