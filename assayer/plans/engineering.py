"""Engineering texts and graphs over controller projects: units and ranges of channels, text reports, review coverage, communication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladder
from ..operators import rules
from ..operators.ordering import numbered
from ..sources import projects
from . import report, software
from .recordings import _S, _files, _folder, _tables, written_once


def _a(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def unit_key(direction: Column, operand: Column) -> Column:
    """The name by which a channel's unit is looked up: direction and operand in lower case, without the dots before it."""
    return F.lower(F.concat(direction, F.lit("."), F.regexp_replace(operand, r"^\.+", "")))


def _local(slot: Column, direction: Column, operand: Column, otherwise: Column) -> Column:
    return F.when(slot.isNotNull(), F.concat(F.lit("Local:"), slot.cast("string"), F.lit(":"), direction, operand)).otherwise(otherwise)


def module_units(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units that modules' connections state for their channels, and the statements that contradict them.

    First table: workspace, module, slot, key, symbol and source_operand. Of several statements about a channel the first
    counts; one that says the same in another case only changes the spelling, any other is a row of the second table
    (workspace, module, key, symbol, stated).
    """
    rows = elements.where("element = 'EngineeringUnit' and path rlike '/Module/Communications/Connections/Connection/(InputTag|OutputTag)/EngineeringUnits/EngineeringUnit$'")
    direction = F.when(F.col("path").contains("/InputTag/"), "I").otherwise("O")
    given = rows.select("workspace", "module", "place", direction.alias("direction"), _a("Operand").alias("operand"), F.trim("text").alias("symbol")).where("operand <> '' and symbol <> ''")
    given = given.withColumn("key", unit_key(F.col("direction"), F.col("operand")))
    first = given.groupBy("workspace", "module", "key").agg(F.min_by(F.lower("symbol"), "place").alias("first"))
    both = given.join(first, ["workspace", "module", "key"])
    kept = both.where(F.lower("symbol") == F.col("first")).groupBy("workspace", "module", "key").agg(F.max_by(F.struct("symbol", "direction", "operand"), "place").alias("u"))
    slots = projects.modules(elements).select("workspace", F.col("name").alias("module"), "slot")
    out = kept.join(slots, ["workspace", "module"], "left").select("workspace", "module", "slot", "key", "u.symbol", _local(F.col("slot"), F.col("u.direction"), F.col("u.operand"), F.col("u.operand")).alias("source_operand"))
    return out, both.where(F.lower("symbol") != F.col("first")).select("workspace", "module", "key", "symbol", F.col("first").alias("stated"))


CHANNEL_CONFIG = r"(?i)^Ch(\d+)Config$"


def module_ranges(elements: DataFrame) -> DataFrame:
    """workspace, module, slot, key, lower, upper and source_operand of every channel whose decorated configuration states both ends.

    The configuration doesn't say whether a channel is read or written, so there is a row for both. Of several values of one
    name the last counts; a value that isn't a number leaves the channel out. Only the first structure of a payload counts.
    """
    node = lambda e, *c: elements.where(F.col("element") == e).select("workspace", "place", "parent_place", *c)
    data = node("Data", "path", _a("Format").alias("format")).where("format = 'Decorated' and path like '%/Module/Communications/ConfigTag/Data'").select("workspace", F.col("place").alias("data"))
    first = node("Structure").withColumnRenamed("parent_place", "data").join(data, ["workspace", "data"]).groupBy("workspace", "data").agg(F.min("place").alias("structure")).drop("data")
    number = F.regexp_extract(_a("Name"), CHANNEL_CONFIG, 1)
    channels = node("StructureMember", "module", number.alias("number")).where("number <> ''").withColumnRenamed("parent_place", "structure").join(first, ["workspace", "structure"])
    values = node("DataValueMember", _a("Name").alias("name"), _a("Value").alias("value")).where("name in ('LowEngineering', 'HighEngineering') and value is not null")
    last = values.groupBy("workspace", F.col("parent_place").alias("place")).agg(*[F.max_by("value", F.when(F.col("name") == n, F.col("place"))).try_cast("double").alias(c) for n, c in (("LowEngineering", "lower"), ("HighEngineering", "upper"))])
    slots = projects.modules(elements).select("workspace", F.col("name").alias("module"), "slot")
    found = channels.join(last, ["workspace", "place"]).where("lower is not null and upper is not null").join(slots, ["workspace", "module"], "left")
    found = found.groupBy("workspace", "module", "slot", "number").agg(F.max_by(F.struct("lower", "upper"), "place").alias("r"))
    operand = F.concat(F.lit("Ch"), "number", F.lit("Config"))
    each = found.withColumn("direction", F.explode(F.array(F.lit("I"), F.lit("O"))))
    return each.select("workspace", "module", "slot", unit_key(F.col("direction"), F.concat(F.lit("Ch"), "number", F.lit("Data"))).alias("key"), "r.lower", "r.upper", _local(F.col("slot"), F.lit("C."), operand, operand).alias("source_operand"))


# ---- texts

TEXTS = ("controller", "tags", "datatypes", "add_on_instructions", "modules", "tasks", "programs")


def text_lines(elements: DataFrame) -> DataFrame:
    """workspace, file, section, item, n and line of the text reports of every controller project, in order of these.

    Each report has a title, a rule, a count and a line an item, sorted by name.
    """
    tags = projects.tags(elements).withColumn("section", F.when(F.col("program").isNull(), "CONTROLLER TAGS").otherwise(F.concat(F.lit("PROGRAM TAGS: "), "program")))
    say = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    members = projects.datatype_members(elements)
    definitions = software.definitions(elements)
    modules, tasks = projects.modules(elements), projects.tasks(elements)
    programs = elements.where("element = 'Program' and path like '%/Programs/Program'").select("workspace", F.col("program").alias("name")).distinct()
    routines = elements.where("element = 'Routine' and program is not null").select("workspace", F.col("program").alias("name"), F.col("routine")).distinct()
    one = lambda t, file, section, item, line: t.select("workspace", F.lit(file).alias("file"), (F.lit(section) if isinstance(section, str) else section).alias("section"), item.alias("item"), line.alias("line"))
    items = [
        one(tags, "tags", F.col("section"), F.col("name"), say(F.col("name"), F.col("tag_type"), F.col("data_type"))),
        one(members, "datatypes", "DATATYPES", F.concat_ws(".", "data_type", F.format_string("%06d", "ordinal")), say(F.concat_ws(".", "data_type", "name"), F.col("member_type"), F.col("dimension"))),
        one(definitions, "add_on_instructions", "ADD-ON INSTRUCTIONS", F.col("name"), say(F.col("name"), F.col("revision"))),
        one(modules, "modules", "MODULES", F.col("name"), say(F.col("name"), F.col("catalog"), "slot", F.col("slot"))),
        one(tasks, "tasks", "TASKS", F.col("name"), say(F.col("name"), F.col("task_type"), F.concat_ws(",", "scheduled"))),
        one(programs.join(routines, ["workspace", "name"], "left").groupBy("workspace", "name").agg(F.array_sort(F.collect_set("routine")).alias("routines")), "programs", "PROGRAMS", F.col("name"), say(F.col("name"), F.concat_ws(",", "routines"))),
    ]
    body = items[0]
    for more in items[1:]:
        body = body.union(more)
    counts = body.groupBy("workspace", "file", "section").agg(F.count(F.lit(1)).alias("n"))
    controllers = elements.where("element = 'Controller' and target_type = 'Controller'").select("workspace", "controller").distinct()
    per = counts.groupBy("workspace", "file").agg(F.sum("n").alias("n"))
    summary = one(controllers, "controller", "CONTROLLER SUMMARY", F.lit(""), say("Name", F.col("controller"))).union(one(per, "controller", "CONTROLLER SUMMARY", F.col("file"), say(F.col("file"), F.col("n"))))
    body = body.union(summary)
    counts = counts.union(summary.groupBy("workspace", "file", "section").agg(F.count(F.lit(1)).alias("n")))
    heads = counts.select("workspace", "file", "section", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), t.alias("line")) for i, t in enumerate((F.col("section"), F.repeat(F.lit("="), F.lit(80)), F.concat(F.lit("Count: "), F.col("n").cast("string"))))])).alias("h"))
    heads = heads.select("workspace", "file", "section", F.lit("").alias("item"), F.col("h.n").alias("n"), F.col("h.line").alias("line"))
    return heads.union(body.select("workspace", "file", "section", "item", F.lit(3).alias("n"), "line"))


def text_files(elements: DataFrame) -> DataFrame:
    """name and content of every text report; one is a project's, so its lines meet in one row."""
    whole = text_lines(elements).groupBy("workspace", "file").agg(F.array_sort(F.collect_list(F.struct("section", "n", "item", "line"))).alias("lines"))
    content = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    return whole.select(F.concat("workspace", F.lit("-"), "file", F.lit(".txt")).alias("name"), content.alias("content"))


def review_records(candidates: DataFrame, relationships: DataFrame, fields: Sequence[str]) -> DataFrame:
    """record_type, key, reviewed, missing, cause_status and review_status of alarms and relationships, one table.

    candidates: key, reviewed and ``fields``; relationships: key, cause_status and review_status (``unreviewed`` without a review).
    """
    missing = F.concat_ws(";", *[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    none = F.lit("")
    alarms = candidates.select(F.lit("alarm_candidate").alias("record_type"), "key", F.col("reviewed").alias("reviewed"), missing.alias("missing"), none.alias("cause_status"), none.alias("review_status"))
    return alarms.union(relationships.select(F.lit("cause_effect_relationship"), "key", F.col("review_status") != "unreviewed", none, "cause_status", "review_status"))


def review_markdown(records: DataFrame, title: str = "Review coverage") -> DataFrame:
    """Lines of the coverage: counts of each kind, then a table of all records in the order of type and key."""
    counts = records.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("missing") != "").alias("incomplete"))
    rows = {r["record_type"]: r for r in counts.collect()}
    lines = [f"# {title}", ""]
    for kind in ("alarm_candidate", "cause_effect_relationship"):
        r = rows.get(kind)
        lines.append(f"- {kind}: {r['n'] if r else 0}, reviewed {r['reviewed'] if r else 0}, incomplete {r['incomplete'] if r else 0}")
    lines += ["", "| type | key | reviewed | missing | cause | review |", "|" + " --- |" * 6]
    head = records.sparkSession.createDataFrame(list(enumerate(lines)), "n long, value string")
    cells = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in ("record_type", "key", "reviewed", "missing", "cause_status", "review_status")]
    body = numbered(records, ["record_type", "key", "missing"], "__row").select((F.col("__row") + (len(lines) - 1)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return head.union(body)


def communication_lines(nodes: DataFrame, edges: DataFrame, unbound: DataFrame) -> DataFrame:
    """n and value: the lines of a communication graph as one JSON document, in order.

    nodes: workspace, controller; edges: key, source, target, kind and evidence; unbound: key and reason. Records are sorted by their keys and
    numbered over all tasks, so none sees the whole document; written in order of n the lines are its text.
    """
    record = lambda t, kind, key, *c: t.select(F.lit(kind).alias("part"), key.alias("key"), F.to_json(F.struct(*sorted(c)), {"ignoreNullFields": "false"}).alias("json"))
    rows = record(nodes, 1, F.col("workspace"), "workspace", "controller").union(record(edges, 3, F.col("key"), "key", "source", "target", "kind", "evidence")).union(record(unbound, 5, F.col("key"), "key", "reason"))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = numbered(rows, ["part", "key", "json"], "__row")
    first = {1: 1, 3: 2 + counts.get(1, 0), 5: 3 + counts.get(1, 0) + counts.get(3, 0)}
    # Each part's records follow its heading, and the last of a part has no comma.
    before = {1: 0, 3: counts.get(1, 0), 5: counts.get(1, 0) + counts.get(3, 0)}
    shift = F.when(F.col("part") == 1, 1).when(F.col("part") == 3, 2).otherwise(3)
    end = F.when(F.col("part") == 1, before[3]).when(F.col("part") == 3, before[5]).otherwise(before[5] + counts.get(5, 0))
    body = placed.select((F.col("__row") + shift).alias("n"), F.concat(F.lit("    "), "json", F.when(F.col("__row") < end, ",").otherwise("")).alias("value"))
    heads = [(first[1], '{"schema_version": "1.0", "nodes": ['), (first[3], '  ], "edges": ['), (first[5], '  ], "unbound_messages": ['), (first[5] + counts.get(5, 0) + 1, "  ]}")]
    return body.union(rows.sparkSession.createDataFrame(heads, "n long, value string"))


# ---- queries

_N = "CAST(s_suppkey AS STRING)"
_UNITS = [
    (0, "", """CONCAT('<RSLogix5000Content TargetType="Controller"><Controller Use="Target" Name="C', {k}, '"><Modules>')"""),
    (1, "", f"""CONCAT('<Module Name="M', {_N}, '" CatalogNumber="1756-IF8" Vendor="1"><Ports><Port Id="1" Address="', CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE {_N} END, '" Type="ICP" Upstream="true"/></Ports><Communications><ConfigTag><Data Format="',
        CASE WHEN s_suppkey % 5 = 0 THEN 'L5K' ELSE 'Decorated' END, '"><Structure DataType="C"><StructureMember Name="Ch0Config"><DataValueMember Name="LowEngineering" Value="0.5"/><DataValueMember Name="HighEngineering" Value="', {_N}, '"/></StructureMember>',
        '<StructureMember Name="ch12config"><DataValueMember Name="LowEngineering" Value="', CASE WHEN s_suppkey % 3 = 0 THEN 'low' ELSE '1' END, '"/><DataValueMember Name="HighEngineering" Value="2"/></StructureMember><StructureMember Name="Other"/></Structure></Data></ConfigTag>',
        '<Connections><Connection Name="c"><InputTag><EngineeringUnits><EngineeringUnit Operand=".CH0DATA">degC</EngineeringUnit><EngineeringUnit Operand="Ch0Data">', CASE WHEN s_suppkey % 6 = 0 THEN 'bar' ELSE 'DEGC' END,
        '</EngineeringUnit><EngineeringUnit Operand=".Ch1Data"> </EngineeringUnit></EngineeringUnits></InputTag><OutputTag><EngineeringUnits><EngineeringUnit Operand=".Ch0Data">rpm</EngineeringUnit></EngineeringUnits></OutputTag></Connection></Connections></Communications></Module>')"""),
    (9, "", "'</Modules></Controller></RSLogix5000Content>'"),
]


def _unit_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(folder: str) -> None:
        lines = None
        for rank, _, line in _UNITS:
            k = f"CAST({_S} AS STRING)"
            sql = f"SELECT {'DISTINCT' if rank != 1 else ''} {_S} AS k, {rank} AS rank, {'s_suppkey' if rank == 1 else '0L'} AS n, {line.format(k=k)} AS line FROM {{supplier}}"
            one = _tables(spark, sf_dir, sql)
            lines = one if lines is None else lines.union(one)
        _files(lines, ".L5X", folder)

    folder = written_once(spark, sf_dir, "unit-projects", write)
    return projects.read_projects(spark, folder).withColumn("workspace", F.regexp_extract("workspace", r"(?i)([^/]+)\.l5x$", 1))


def channel_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_units(_unit_elements(spark, sf_dir))[0]


def conflicting_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_units(_unit_elements(spark, sf_dir))[1]


def channel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_ranges(_unit_elements(spark, sf_dir))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .controllers import _whole

    return _whole(spark, sf_dir)


def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text reports as written to files and read back."""
    from ..sources.files import write_files

    folder = _folder(spark, "texts")
    write_files(text_files(_projects(spark, sf_dir)), folder)
    rows = spark.read.text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)-(\w+)\.txt$", 1).alias("workspace"), F.regexp_extract(F.input_file_name(), r"([^/]+)-(\w+)\.txt$", 2).alias("file"), "value")
    count = F.regexp_extract("value", r"^Count: (\d+)$", 1)
    return rows.groupBy("workspace", "file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.nullif(count, F.lit("")).cast("long")).alias("counted"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    alarms = c.select(F.col("c_name").alias("key"), (F.col("c_custkey") % 3 == 0).alias("reviewed"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("priority"), F.when(F.col("c_custkey") % 6 == 0, F.col("c_acctbal")).alias("setpoint"))
    o = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    related = o.select(F.col("s_name").alias("key"), F.when(F.col("s_suppkey") % 4 == 0, "unresolved").otherwise("resolved").alias("cause_status"), F.when(F.col("s_suppkey") % 2 == 0, "verified").otherwise("unreviewed").alias("review_status"))
    return review_records(alarms, related, ["priority", "setpoint"])


def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir)


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_markdown(_reviews(spark, sf_dir)).select("n", "value")


def communication_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the controllers' communication graph: who consumes what of whom, and what can't be bound."""
    elements = _projects(spark, sf_dir)
    linked, rest = report.produced_consumed(elements)
    nodes = elements.where("element = 'Controller'").select("workspace", "controller").distinct()
    edges = linked.select(F.concat_ws("|", "workspace", "tag").alias("key"), F.col("workspace").alias("target"), F.col("producer_workspace").alias("source"), F.lit("produced_consumed").alias("kind"), F.col("produced_tag").alias("evidence"))
    unbound = rest.select(F.concat_ws("|", "workspace", "tag").alias("key"), F.when(F.col("match_count") == 0, "no_producer").otherwise("ambiguous_producer").alias("reason"))
    return communication_lines(nodes, edges, unbound)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, "SELECT s_suppkey % 10 AS scope, s_suppkey, element_at(array('cop', 'ABS', 'Own', 'MSG', 'Nobody'), CAST(s_suppkey % 5 + 1 AS INT)) AS callee, CAST(s_suppkey % 4 AS INT) AS arguments FROM {supplier}")


def call_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tables(spark, sf_dir, "SELECT DISTINCT s_suppkey % 10 AS scope, 'OWN' AS name FROM {supplier} WHERE s_suppkey % 10 <> 7")
    return rules.classified_calls(_calls(spark, sf_dir), own, ["scope"]).select("s_suppkey", "kind", "maker", "signature_valid")


def semantic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tables(spark, sf_dir, "SELECT DISTINCT s_suppkey % 10 AS scope, 'OWN' AS name FROM {supplier} WHERE s_suppkey % 10 <> 7")
    return rules.semantic_coverage(rules.classified_calls(_calls(spark, sf_dir), own, ["scope"]), ["scope"])


def conversion_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).select("scope", F.lit("D").alias("name"), "callee", (F.col("callee") != "Nobody").alias("resolved"))
    definitions = calls.select("scope", "name").union(calls.select("scope", F.lit("Empty")))
    return rules.readiness(definitions, calls, ["scope"]).select("scope", "name", "area", "disposition", F.concat_ws(",", "evidence").alias("evidence"), "needed", "blocked_by")


_RUNTIMES = {"small": ["PULSE", "STEP"], "large": ["PULSE", "STEP", "SCAN", "CLICK", "VIEW"]}


def runtime_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.element_at(F.array(*[F.lit(x) for x in ("PULSE", "STEP", "SCAN", "ODD")]), (F.col("event_id") % 4 + 1).cast("int")).alias("capability"))
    return rules.runtime_compatibility(need, "user_id", "capability", _RUNTIMES).select("user_id", "runtime", F.concat_ws(",", "missing").alias("missing"), "compatible")


def service_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = [*rules.MODULE_SERVICES["generic"], "something_else"]
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.element_at(F.array(*[F.lit(i) for i in intents]), (F.col("s_suppkey") % 8 + 1).cast("int")).alias("intent"), F.when(F.col("s_suppkey") % 3 == 0, "ethernet_ip_remote_adapter").when(F.col("s_suppkey") % 3 == 1, "generic").alias("profile"))
    return rules.module_services(asked).select("s_suppkey", "support", "equivalence")


_BEHAVIOURS = {"initialization": ["Sts_Init := 1;", "IF Sts_Stop"], "run": ["Run :="]}


def device_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _tables(spark, sf_dir, "SELECT s_suppkey, CONCAT('// ', s_name, '\n', CASE WHEN s_suppkey % 2 = 0 THEN 'IF Sts_Stop THEN\n' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'x := 1;\n  Sts_Init := 1;' ELSE 'Run := x;' END) AS text FROM {supplier}")
    return rules.described_behaviours(sources, ["s_suppkey"], "text", _BEHAVIOURS)


def statement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    last = F.when(F.col("s_suppkey") % 2 == 0, "\n@@ what").otherwise(" Arr[i] := f(1);")
    text = F.concat(F.lit("(* a; b *) IF x > 1 THEN\n  s := 'a;b'; // t := 1;\nELSE Go(a := 1, b => "), F.col("s_suppkey").cast("string"), F.lit(");\nEND_IF;"), last)
    return rows.select("s_suppkey", F.posexplode(ladder.scanned_statements(text)).alias("at", "s")).select("s_suppkey", "at", "s.kind", "s.text", "s.line")


QUERIES = (statement_scan, channel_units, conflicting_units, channel_ranges, text_reports, review_table, review_lines, communication_document, call_classification, semantic_coverage, conversion_readiness, runtime_fit, service_support, device_description)

_W = "'R' || CAST(s_suppkey // 50 AS VARCHAR)"
_SLOT = "CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey AS INTEGER) END"
_FROM = "CASE WHEN s_suppkey % 4 <> 0 THEN 'Local:' || s_suppkey || ':' ELSE '' END"
_REVIEWS = """r AS (
      SELECT 'alarm_candidate' AS record_type, c_name AS key, c_custkey % 3 = 0 AS reviewed, concat_ws(';', CASE WHEN c_custkey % 3 <> 0 THEN 'priority' END, CASE WHEN c_custkey % 6 <> 0 THEN 'setpoint' END) AS missing, '' AS cause_status, '' AS review_status FROM customer
      UNION ALL SELECT 'cause_effect_relationship', s_name, s_suppkey % 2 = 0, '', CASE WHEN s_suppkey % 4 = 0 THEN 'unresolved' ELSE 'resolved' END, CASE WHEN s_suppkey % 2 = 0 THEN 'verified' ELSE 'unreviewed' END FROM supplier)"""
_CALLED = "c AS (SELECT s_suppkey, s_suppkey % 10 AS scope, s_suppkey % 5 AS f, s_suppkey % 4 AS a FROM supplier)"
_KINDS = f"""{_CALLED}, k AS (
      SELECT *, CASE f WHEN 0 THEN 'memory_copy' WHEN 1 THEN 'absolute_value' WHEN 2 THEN CASE WHEN scope <> 7 THEN 'user_defined_instruction' ELSE 'unknown' END WHEN 3 THEN 'explicit_message' ELSE 'unknown' END AS kind,
        CASE WHEN f IN (0, 3) THEN 'Rockwell Automation' END AS maker, CASE f WHEN 0 THEN a = 3 WHEN 1 THEN a = 1 WHEN 3 THEN a = 1 END AS signature_valid FROM c)"""

SQL = {
    "statement_scan": """
    WITH s AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS odd FROM supplier)
    SELECT s_suppkey, CAST(UNNEST(range(6)) AS INTEGER) AS at, UNNEST(['control', 'assignment', 'control', 'call', 'control', CASE WHEN odd THEN 'unknown' ELSE 'assignment' END]) AS kind,
      UNNEST(['IF x > 1', 's := ''a;b''', 'ELSE', 'Go(a := 1, b => ' || s_suppkey || ')', 'END_IF', CASE WHEN odd THEN '@@ what' ELSE 'Arr[i] := f(1)' END]) AS text, UNNEST([1, 2, 3, 3, 4, CASE WHEN odd THEN 5 ELSE 4 END]) AS line FROM s""",
    "channel_units": f"""
    SELECT {_W} AS workspace, 'M' || s_suppkey AS module, {_SLOT} AS slot, 'i.ch0data' AS key, CASE WHEN s_suppkey % 6 = 0 THEN 'degC' ELSE 'DEGC' END AS symbol,
      CASE WHEN s_suppkey % 4 <> 0 THEN 'Local:' || s_suppkey || ':I' ELSE '' END || CASE WHEN s_suppkey % 6 = 0 THEN '.CH0DATA' ELSE 'Ch0Data' END AS source_operand FROM supplier
    UNION ALL SELECT {_W}, 'M' || s_suppkey, {_SLOT}, 'o.ch0data', 'rpm', CASE WHEN s_suppkey % 4 <> 0 THEN 'Local:' || s_suppkey || ':O' ELSE '' END || '.Ch0Data' FROM supplier""",
    "conflicting_units": f"SELECT {_W} AS workspace, 'M' || s_suppkey AS module, 'i.ch0data' AS key, 'bar' AS symbol, 'degc' AS stated FROM supplier WHERE s_suppkey % 6 = 0",
    "channel_ranges": f"""
    WITH d AS (SELECT *, UNNEST(['i', 'o']) AS d FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT {_W} AS workspace, 'M' || s_suppkey AS module, {_SLOT} AS slot, d || '.ch0data' AS key, CAST(0.5 AS DOUBLE) AS lower, CAST(s_suppkey AS DOUBLE) AS upper, CASE WHEN s_suppkey % 4 <> 0 THEN 'Local:' || s_suppkey || ':C.' ELSE '' END || 'Ch0Config' AS source_operand FROM d
    UNION ALL SELECT {_W}, 'M' || s_suppkey, {_SLOT}, d || '.ch12data', 1.0, 2.0, CASE WHEN s_suppkey % 4 <> 0 THEN 'Local:' || s_suppkey || ':C.' ELSE '' END || 'Ch12Config' FROM d WHERE s_suppkey % 3 <> 0""",
    "text_reports": f"""
    WITH s AS (SELECT *, {_W} AS w FROM supplier),
    n AS (SELECT w, COUNT(*) + 1 + COUNT(*) FILTER (s_suppkey % 5 = 0) + COUNT(*) FILTER (s_suppkey % 4 = 0) + COUNT(*) FILTER (s_suppkey % 6 = 0) AS own, COUNT(*) FILTER (s_suppkey % 7 = 0) + COUNT(*) FILTER (s_suppkey % 9 = 0) AS inside, COUNT(*) FILTER (s_suppkey % 10 = 0) AS modules FROM s GROUP BY 1),
    f AS (SELECT w, UNNEST(['tags', 'datatypes', 'add_on_instructions', 'modules', 'tasks', 'programs', 'controller']) AS file, UNNEST([own + inside, 2, 2, modules, 1, 1, 7]) AS counted, inside FROM n)
    SELECT w AS workspace, file, CAST(counted + 3 + CASE WHEN file = 'tags' AND inside > 0 THEN 3 ELSE 0 END AS BIGINT) AS lines, CAST(counted AS BIGINT) AS counted FROM f""",
    "review_table": f"WITH {_REVIEWS} SELECT * FROM r",
    "review_lines": f"""
    WITH {_REVIEWS}, t AS (SELECT record_type, COUNT(*) AS n, COUNT(*) FILTER (reviewed) AS reviewed, COUNT(*) FILTER (missing <> '') AS incomplete FROM r GROUP BY 1)
    SELECT CAST(0 AS BIGINT) AS n, '# Review coverage' AS value UNION ALL SELECT 1, '' UNION ALL SELECT 4, '' UNION ALL SELECT 5, '| type | key | reviewed | missing | cause | review |' UNION ALL SELECT 6, '| --- | --- | --- | --- | --- | --- |'
    UNION ALL SELECT CASE record_type WHEN 'alarm_candidate' THEN 2 ELSE 3 END, '- ' || record_type || ': ' || n || ', reviewed ' || reviewed || ', incomplete ' || incomplete FROM t
    UNION ALL SELECT 6 + ROW_NUMBER() OVER (ORDER BY record_type, key, missing), '| ' || record_type || ' | ' || key || ' | ' || reviewed || ' | ' || missing || ' | ' || cause_status || ' | ' || review_status || ' |' FROM r""",
    "communication_document": f"""
    WITH s AS (SELECT *, {_W} AS w, s_suppkey // 50 AS k FROM supplier), p AS (SELECT DISTINCT w, k FROM s),
    x AS (
      SELECT 1 AS part, w AS key, '{{"controller":"C' || k || '","workspace":"' || w || '"}}' AS json FROM p
      UNION ALL SELECT 3, s.w || '|Got' || s_suppkey, '{{"evidence":"Given","key":"' || s.w || '|Got' || s_suppkey || '","kind":"produced_consumed","source":"' || p.w || '","target":"' || s.w || '"}}' FROM s JOIN p ON p.k = s.k + 1 WHERE s_suppkey % 6 = 0
      UNION ALL SELECT 5, s.w || '|Got' || s_suppkey, '{{"key":"' || s.w || '|Got' || s_suppkey || '","reason":"no_producer"}}' FROM s WHERE s_suppkey % 6 = 0 AND k + 1 NOT IN (SELECT k FROM p)),
    o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY part, key, json) + (part + 1) // 2 AS n, ROW_NUMBER() OVER (PARTITION BY part ORDER BY key DESC, json DESC) AS back FROM x),
    c AS (SELECT COUNT(*) FILTER (part = 1) AS a, COUNT(*) FILTER (part = 3) AS b, COUNT(*) FILTER (part = 5) AS e FROM x)
    SELECT CAST(n AS BIGINT) AS n, '    ' || json || CASE WHEN back = 1 THEN '' ELSE ',' END AS value FROM o
    UNION ALL SELECT 1, '{{"schema_version": "1.0", "nodes": [' UNION ALL SELECT a + 2, '  ], "edges": [' FROM c UNION ALL SELECT a + b + 3, '  ], "unbound_messages": [' FROM c UNION ALL SELECT a + b + e + 4, '  ]}}' FROM c""",
    "call_classification": f"WITH {_KINDS} SELECT s_suppkey, kind, maker, signature_valid FROM k",
    "semantic_coverage": f"""
    WITH {_KINDS} SELECT scope, COUNT(*) AS calls, COUNT(*) FILTER (kind <> 'unknown') AS known, COUNT(*) FILTER (kind <> 'unknown' AND maker IS NULL) AS portable, COUNT(*) FILTER (signature_valid) AS valid, COUNT(*) FILTER (NOT signature_valid) AS invalid FROM k GROUP BY 1""",
    "conversion_readiness": f"""
    WITH {_CALLED}, g AS (SELECT scope, 'D' AS name, bool_or(f = 0) AS cop, bool_or(f = 3) AS msg, CAST(bool_or(f = 4) AS BIGINT) AS blocked_by FROM c GROUP BY 1 UNION ALL SELECT DISTINCT scope, 'Empty', FALSE, FALSE, 0 FROM c),
    a AS (SELECT g.*, UNNEST(['core logic', 'cyclic datatypes', 'data operations', 'controller objects', 'explicit messages']) AS area, UNNEST(['direct', 'type adaptation', 'type adaptation', 'runtime service', 'runtime service']) AS disposition FROM g),
    e AS (SELECT *, CASE WHEN area IN ('cyclic datatypes', 'data operations') AND cop THEN 'COP' WHEN area = 'explicit messages' AND msg THEN 'MSG' ELSE '' END AS evidence FROM a)
    SELECT scope, name, area, disposition, evidence, area = 'core logic' OR evidence <> '' AS needed, blocked_by FROM e""",
    "runtime_fit": """
    WITH e AS (SELECT DISTINCT user_id, ['PULSE', 'STEP', 'SCAN', 'ODD'][event_id % 4 + 1] AS c FROM events), r AS (SELECT UNNEST(['small', 'large']) AS runtime, UNNEST([['PULSE', 'STEP'], ['PULSE', 'STEP', 'SCAN']]) AS has)
    SELECT user_id, runtime, COALESCE(string_agg(c, ',' ORDER BY c) FILTER (NOT list_contains(has, c)), '') AS missing, COUNT(*) FILTER (NOT list_contains(has, c)) = 0 AS compatible FROM e CROSS JOIN r GROUP BY 1, 2""",
    "service_support": """
    WITH s AS (SELECT s_suppkey, s_suppkey % 8 AS i, s_suppkey % 3 = 0 AS eip FROM supplier)
    SELECT s_suppkey, CASE WHEN i >= 6 THEN 'unavailable' WHEN eip OR i = 1 THEN 'normalized' WHEN i = 4 THEN 'unavailable' ELSE 'bus_specific' END AS support,
      CASE WHEN i >= 6 THEN 'unavailable' WHEN eip AND i = 5 THEN 'hardware_validation_required' WHEN eip OR i = 1 THEN 'approximated' ELSE 'unavailable' END AS equivalence FROM s""",
    "device_description": """
    WITH s AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS stop, s_suppkey % 3 = 0 AS init FROM supplier),
    m AS (SELECT s_suppkey, 'initialization' AS behaviour, 'Sts_Init := 1;' AS marker, CASE WHEN init THEN CASE WHEN stop THEN 4 ELSE 3 END END AS line, stop AND init AS supported FROM s
      UNION ALL SELECT s_suppkey, 'initialization', 'IF Sts_Stop', CASE WHEN stop THEN 2 END, stop AND init FROM s
      UNION ALL SELECT s_suppkey, 'run', 'Run :=', CASE WHEN NOT init THEN CASE WHEN stop THEN 3 ELSE 2 END END, NOT init FROM s)
    SELECT * FROM m""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
