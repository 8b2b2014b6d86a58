"""Queries over controller projects made from the driver's suppliers: tags, rungs, reports, calls.

A project holds a bounded block of suppliers. It is written to the shared folder, read as
L5X and compared with what the table says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence_json import dangling_references, export_model, flatten, inventory
from ..sources import projects
from . import report, software
from .recordings import _S, SUPPLIERS, _files, _folder, _tables, written_once

_N = "CAST(s_suppkey AS STRING)"
_K = f"CAST({_S} AS STRING)"
_NEXT = f"CAST({_S} + 1 AS STRING)"
_SLOT = "CAST(CAST(floor(s_suppkey / 10) * 10 AS BIGINT) AS STRING)"
_CHANNEL = "CAST(CAST(floor(s_suppkey / 5) AS BIGINT) % 8 AS STRING)"


def _each(rank: int, line: str, where: str = "true") -> str:
    """A line for every supplier that meets a condition."""
    return f"SELECT {_S} AS k, {rank} AS rank, s_suppkey AS n, {line} AS line FROM {{supplier}} WHERE {where}"


def _once(rank: int, line: str) -> str:
    """A line for every project."""
    return f"SELECT DISTINCT {_S} AS k, {rank} AS rank, 0L AS n, {line} AS line FROM {{supplier}}"


PROJECT = [
    _once(0, f"""'<RSLogix5000Content TargetName="C' || {_K} || '" TargetType="Controller"><Controller Use="Target" Name="C' || {_K} || '"><DataTypes><DataType Name="T' || {_K} || '"><Members><Member Name="a" DataType="DINT" Dimension="' || {_K} || '"/><Member Name="b" DataType="BIT" Target="Z" BitNumber="3"/></Members></DataType></DataTypes><Modules>'"""),
    _each(1, f"""'<Module Name="M' || {_N} || '" CatalogNumber="1756-IB8" Vendor="1" ProductType="7" ProductCode="' || CAST(s_nationkey AS STRING) || '" Major="2" Minor="1" ParentModule="Local"><EKey State="Exact"/><Ports><Port Id="1" Address="' || {_N} || '" Type="ICP" Upstream="true"/></Ports></Module>'""", "s_suppkey % 10 = 0"),
    _once(2, f"""'</Modules><AddOnInstructionDefinitions><AddOnInstructionDefinition Name="Aoi' || {_K} || '" Revision="1.0" ExecutePrescan="true"><Parameters><Parameter Name="EnableIn" Usage="Input" Required="false"/><Parameter Name="Given" DataType="DINT" Usage="Input" Required="true"/><Parameter Name="Made" DataType="DINT" Usage="Output" Required="true"/></Parameters><LocalTags><LocalTag Name="Kept" DataType="DINT"/></LocalTags><Routines><Routine Name="Logic" Type="RLL"><RLLContent><Rung Number="0"><Text>XIC(Given)OTE(Made);</Text></Rung></RLLContent></Routine></Routines></AddOnInstructionDefinition><AddOnInstructionDefinition Name="Odd' || {_K} || '"><Routines><Routine Name="Logic" Type="RLL"><RLLContent><Rung Number="0"><Text>PID(Loop);</Text></Rung></RLLContent></Routine></Routines></AddOnInstructionDefinition></AddOnInstructionDefinitions><Tags>'"""),
    _each(3, f"""'<Tag Name="S' || {_N} || '" DataType="DINT"/>'"""),
    _each(4, f"""'<Tag Name="In' || {_N} || '" TagType="Alias" AliasFor="Local:' || {_SLOT} || ':I.Data.' || {_CHANNEL} || '"/>'""", "s_suppkey % 5 = 0"),
    _each(5, f"""'<Tag Name="Hi' || {_N} || '_Alm" DataType="BOOL"><Description>high level of ' || s_name || '</Description></Tag>'""", "s_suppkey % 4 = 0"),
    _each(6, f"""'<Tag Name="Got' || {_N} || '" DataType="DINT" TagType="Consumed"><ConsumeInfo Producer="c' || {_NEXT} || '" RemoteTag="GIVEN" RPI="25.0" RemoteFile="0"/></Tag>'""", "s_suppkey % 6 = 0"),
    _once(7, """'<Tag Name="Given" TagType="Produced"><ProduceInfo ProduceCount="2"/></Tag></Tags><Programs><Program Name="Main"><Tags>'"""),
    _each(8, f"""'<Tag Name="s' || {_N} || '" DataType="DINT"/>'""", "s_suppkey % 7 = 0"),
    _each(9, f"""'<Tag Name="I' || {_N} || '" DataType="aoi' || {_K} || '"/>'""", "s_suppkey % 9 = 0"),
    _once(10, """'</Tags><Routines><Routine Name="R" Type="RLL"><RLLContent>'"""),
    _each(11, f"""'<Rung Number="' || {_N} || '" Type="N"><Comment>' || s_name || '</Comment><Text>XIC(S' || {_N} || ')GRT(Gone' || {_N} || '.ACC,100)OTE(Hi' || {_N} || '_Alm);</Text></Rung>'""", "s_suppkey % 2 = 0"),
    _each(12, f"""'<Rung Number="' || {_N} || '" Type="N"><Text>CPT(S' || {_N} || ',SIN(X))MOV(S' || {_N} || ',S' || {_N} || ');</Text></Rung>'""", "s_suppkey % 2 = 1"),
    _each(13, f"""'<Rung Number="' || CAST(s_suppkey + 1000000 AS STRING) || '" Type="N"><Text>AOI' || {_K} || '(I' || {_N} || ',M' || {_SLOT} || ':I.Data,S' || {_N} || ',More);</Text></Rung>'""", "s_suppkey % 9 = 0"),
    _once(14, """'</RLLContent></Routine><Routine Name="T" Type="ST"><STContent>'"""),
    _each(15, f"""'<Line Number="' || {_N} || '">Hi' || {_N} || '_Alm := S' || {_N} || '.DN; // note</Line>'""", "s_suppkey % 8 = 0"),
    _once(16, f"""'</STContent></Routine></Routines></Program></Programs><Tasks><Task Name="Fast" Type="PERIODIC" Rate="' || {_NEXT} || '" Priority="5" Watchdog="500"><ScheduledPrograms><ScheduledProgram Name="Main"/></ScheduledPrograms></Task></Tasks></Controller></RSLogix5000Content>'"""),
]
PART = _once(0, f"""'<RSLogix5000Content TargetName="P" TargetType="Program"><Controller Use="Context" Name="C' || {_K} || '"><Programs Use="Context"><Program Use="Target" Name="P"/></Programs></Controller></RSLogix5000Content>'""")


def projects_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of all projects' files."""

    def write(folder: str) -> None:
        lines = None
        for sql in PROJECT:
            one = _tables(spark, sf_dir, sql)
            lines = one if lines is None else lines.union(one)
        _files(lines, ".L5X", folder)
        _files(_tables(spark, sf_dir, PART), "p.l5x", folder)

    return written_once(spark, sf_dir, "projects", write)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all projects; workspace is R and the number of the block."""
    folder = projects_folder(spark, sf_dir)
    return projects.read_projects(spark, folder).withColumn("workspace", F.regexp_extract("workspace", r"(?i)([^/]+)\.l5x$", 1))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).where("target_type = 'Controller'")


def l5x_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.tags(_whole(spark, sf_dir)).select("workspace", "tag_key", "tag_type", "data_type", "alias_for", "description")


def l5x_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.rungs(_whole(spark, sf_dir)).where("program is not null").select("workspace", "routine", "rung_number", "comment", "text")


def l5x_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.text_lines(_whole(spark, sf_dir)).select("workspace", "routine", "line_number", "text")


def l5x_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = projects.modules(_whole(spark, sf_dir)).withColumns(projects.module_capability(F.col("catalog"), F.col("vendor_id")))
    return modules.select("workspace", "name", "parent_module", "product_code", "key_mode", "slot", "direction", "signal", "channels")


def l5x_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.tasks(_whole(spark, sf_dir)).select("workspace", "name", "task_type", "rate", "priority", F.concat_ws(",", "scheduled").alias("scheduled"))


def l5x_datatypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.datatype_members(_whole(spark, sf_dir)).select("workspace", "data_type", "name", "member_type", "dimension", "bit_number")


def l5x_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by target type and elements, and the controller that each component belongs to."""
    elements = _elements(spark, sf_dir)
    homes = report.workspace_of_components(elements).select("workspace", "assigned_to")
    return elements.where("element = 'RSLogix5000Content'").select("workspace", "target_type").join(homes, "workspace", "left")


def external_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.external_references(_whole(spark, sf_dir)).select("workspace", "kind", "name", "address", "is_ipv4")


def tag_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.tag_references(_whole(spark, sf_dir)).where("tag_key is not null and instruction in ('XIC', 'OTE', 'MOV', 'CPT', 'ST_ASSIGN')")
    return found.groupBy("workspace", "instruction", "access", "tag_key", F.coalesce("member_path", F.lit("")).alias("member")).agg(F.count(F.lit(1)).alias("n"))


def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.tag_references(_whole(spark, sf_dir)).where("tag_key is null and instruction in ('GRT', 'OTE', 'ALIAS')")
    return found.select("workspace", "instruction", "identifier", "source_tag_key")


def alarm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _whole(spark, sf_dir)
    found = report.alarm_candidates(elements, report.tag_references(elements))
    return found.select("workspace", "tag_key", F.concat_ws(",", "kinds").alias("kinds"), F.concat_ws(",", "writers").alias("writers"))


def cause_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _whole(spark, sf_dir)
    references = report.tag_references(elements)
    found = report.cause_effects(report.alarm_candidates(elements, references), references)
    return found.select("workspace", "routine", "effect_tag_key", "write_instruction", "cause", F.coalesce("cause_member", F.lit("")).alias("member"), "cause_status", F.length("relationship_key").cast("long").alias("key_length"))


def io_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.io_list(_whole(spark, sf_dir)).select("workspace", "module", "channel", "status", F.concat_ws(",", "tags").alias("tags"))


def controller_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _whole(spark, sf_dir)
    return report.module_schedule(elements, report.io_list(elements)).select("workspace", "name", "assigned", "spare")


def rung_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rung_coverage(_whole(spark, sf_dir).where("instruction is null")).where("not startswith(mnemonic, 'AOI')")


def produced_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, rest = report.produced_consumed(_whole(spark, sf_dir))
    return linked.select("workspace", "tag", "producer_workspace", "produce_count", "rpi").union(rest.select("workspace", "tag", F.lit(None).cast("string"), F.lit(None).cast("int"), "rpi"))


def report_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two report files, and what is wrong with them against a manifest with another digest, a file too many and one too few."""
    elements = _whole(spark, sf_dir)
    folder = _folder(spark, "reports")
    made = {"tasks": (projects.tasks(elements), ["workspace"]), "io_list": (report.io_list(elements).select("workspace", "module", "channel", "status"), ["workspace", "module", "channel"])}
    for name, (table, order) in made.items():
        report.flat(table).repartitionByRange(1, *order).sortWithinPartitions(*order).write.option("header", True).csv(f"{folder}/csv/{name}")
    listed = report.manifest(spark, folder).where("path like '%.csv'")
    expected = listed.where("path not like '%io_list%'").select("path", F.sha2("sha256", 256).alias("sha256")).union(spark.range(1).select(F.lit("csv/gone/part.csv"), F.lit("-")))
    faults = report.verify_manifest(expected, listed.select("path", "sha256")).join(listed, "path", "left")
    return faults.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("report"), "fault", "sha256", "bytes")


def instruction_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _whole(spark, sf_dir)
    given = software.parameters(elements).groupBy("workspace", F.col("instruction").alias("name")).agg(F.count(F.lit(1)).alias("parameters"), F.count_if("required").alias("required"))
    kept = software.local_tags(elements).groupBy("workspace", F.col("instruction").alias("name")).agg(F.count(F.lit(1)).alias("local_tags"))
    return software.definitions(elements).join(given, ["workspace", "name"], "left").join(kept, ["workspace", "name"], "left").select("workspace", "name", "revision", "execute_prescan", "parameters", "required", "local_tags")


def instruction_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.instances(_whole(spark, sf_dir)).select("workspace", "tag", "definition", "status")


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.resolved_calls(_whole(spark, sf_dir)).select("workspace", "number", "callee", "definition", "definition_workspace", "status")


def argument_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.argument_bindings(_whole(spark, sf_dir)).select("workspace", "number", "position", "role", "parameter", "flow", "tag_key")


def module_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.module_operands(_whole(spark, sf_dir)).select("workspace", "operand", "module", "path", "direction")


def software_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.software_modules(_whole(spark, sf_dir)).select("workspace", "definition", "instance", "calls", F.concat_ws(",", "modules").alias("modules"))


def instruction_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.portability(_whole(spark, sf_dir)).select("workspace", "name", "disposition", F.concat_ws(",", "blocking").alias("blocking"))


def controller_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.functional_summary(_whole(spark, sf_dir))


def corpus_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.corpus_lines(_elements(spark, sf_dir)).where("value like '| P%' or value like '| C%'").select("value")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    block = F.floor(F.col("s_suppkey") / SUPPLIERS).cast("long").alias("model")
    objects = suppliers.select(block, F.col("s_suppkey").alias("identity"), F.lit("m.Supplier").alias("record_type"), (F.col("s_suppkey") % SUPPLIERS).alias("position"), F.col("s_name").alias("name"))
    references = suppliers.select(block, F.col("s_suppkey").alias("source"), F.lit("next").alias("name"), (F.col("s_suppkey") + 1).alias("target"))
    return export_model(objects, references, "model", "identity", ["name"])


def model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = flatten(_models(spark, sf_dir), "model", "document")
    ref = F.get_json_object(F.concat(F.lit('{"v":'), "scalar", F.lit("}")), "$.v")
    return nodes.where("key = '$ref'").select(F.col("doc").cast("long").alias("model"), "pointer", ref.alias("target"))


def model_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward references of the exported models; each points to the object after it."""
    nodes = flatten(_models(spark, sf_dir), "model", "document")
    return dangling_references(nodes).groupBy(F.col("doc").cast("long").alias("model"), "reason").agg(F.count(F.lit(1)).alias("n"))


def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(flatten(_models(spark, sf_dir), "model", "document"))


QUERIES = (
    l5x_tags, l5x_rungs, l5x_text_lines, l5x_modules, l5x_tasks, l5x_datatypes, l5x_corpus, external_references, tag_references, unresolved_references, alarm_candidates,
    cause_effects, io_list, controller_schedule, rung_coverage, produced_consumed, report_manifest, instruction_definitions, instruction_instances, call_resolution,
    argument_binding, module_operands, software_modules, instruction_portability, controller_summary, corpus_markdown, model_export, model_validation, model_records,
)

# The twins: s has the workspace w, the block k and the name n of every supplier.
_BASE = f"s AS (SELECT *, s_suppkey // {SUPPLIERS} AS k, 'R' || CAST(s_suppkey // {SUPPLIERS} AS VARCHAR) AS w, CAST(s_suppkey AS VARCHAR) AS n FROM supplier), p AS (SELECT DISTINCT w, k FROM s)"
_OWN = "CASE WHEN s_suppkey % 7 = 0 THEN 'program:Main:s' || n ELSE 'controller:S' || n END"
_ALARM = "'controller:Hi' || n || '_Alm'"
_CHANNELS = f"""{_BASE},
    a AS (SELECT w, s_suppkey // 10 * 10 AS slot, s_suppkey // 5 % 8 AS channel, string_agg('In' || n, ',' ORDER BY 'In' || n) AS tags FROM s WHERE s_suppkey % 5 = 0 GROUP BY 1, 2, 3),
    c AS (SELECT w, 'M' || n AS module, s_suppkey AS slot, UNNEST(range(8)) AS channel FROM s WHERE s_suppkey % 10 = 0),
    x AS (SELECT c.w AS workspace, module, CAST(c.channel AS INTEGER) AS channel, CASE WHEN tags IS NULL THEN 'spare' ELSE 'assigned' END AS status, COALESCE(tags, '') AS tags FROM c LEFT JOIN a ON c.w = a.w AND c.slot = a.slot AND c.channel = a.channel)"""

SQL = {
    "l5x_tags": f"""WITH {_BASE}
        SELECT w AS workspace, 'controller:S' || n AS tag_key, 'Base' AS tag_type, 'DINT' AS data_type, NULL AS alias_for, NULL AS description FROM s
        UNION ALL SELECT w, 'controller:In' || n, 'Alias', NULL, 'Local:' || CAST(s_suppkey // 10 * 10 AS VARCHAR) || ':I.Data.' || CAST(s_suppkey // 5 % 8 AS VARCHAR), NULL FROM s WHERE s_suppkey % 5 = 0
        UNION ALL SELECT w, {_ALARM}, 'Base', 'BOOL', NULL, 'high level of ' || s_name FROM s WHERE s_suppkey % 4 = 0
        UNION ALL SELECT w, 'controller:Got' || n, 'Consumed', 'DINT', NULL, NULL FROM s WHERE s_suppkey % 6 = 0
        UNION ALL SELECT w, 'controller:Given', 'Produced', NULL, NULL, NULL FROM p
        UNION ALL SELECT w, 'program:Main:s' || n, 'Base', 'DINT', NULL, NULL FROM s WHERE s_suppkey % 7 = 0
        UNION ALL SELECT w, 'program:Main:I' || n, 'Base', 'aoi' || CAST(k AS VARCHAR), NULL, NULL FROM s WHERE s_suppkey % 9 = 0""",
    "l5x_rungs": f"""WITH {_BASE}
        SELECT w AS workspace, 'R' AS routine, s_suppkey AS rung_number, s_name AS comment, 'XIC(S' || n || ')GRT(Gone' || n || '.ACC,100)OTE(Hi' || n || '_Alm);' AS text FROM s WHERE s_suppkey % 2 = 0
        UNION ALL SELECT w, 'R', s_suppkey, NULL, 'CPT(S' || n || ',SIN(X))MOV(S' || n || ',S' || n || ');' FROM s WHERE s_suppkey % 2 = 1
        UNION ALL SELECT w, 'R', s_suppkey + 1000000, NULL, 'AOI' || CAST(k AS VARCHAR) || '(I' || n || ',M' || CAST(s_suppkey // 10 * 10 AS VARCHAR) || ':I.Data,S' || n || ',More);' FROM s WHERE s_suppkey % 9 = 0""",
    "l5x_text_lines": f"WITH {_BASE} SELECT w AS workspace, 'T' AS routine, s_suppkey AS line_number, 'Hi' || n || '_Alm := S' || n || '.DN; // note' AS text FROM s WHERE s_suppkey % 8 = 0",
    "l5x_modules": f"WITH {_BASE} SELECT w AS workspace, 'M' || n AS name, 'Local' AS parent_module, s_nationkey AS product_code, 'Exact' AS key_mode, s_suppkey AS slot, 'input' AS direction, 'digital' AS signal, 8 AS channels FROM s WHERE s_suppkey % 10 = 0",
    "l5x_tasks": f"WITH {_BASE} SELECT w AS workspace, 'Fast' AS name, 'PERIODIC' AS task_type, k + 1 AS rate, 5 AS priority, 'Main' AS scheduled FROM p",
    "l5x_datatypes": f"WITH {_BASE} SELECT w AS workspace, 'T' || CAST(k AS VARCHAR) AS data_type, 'a' AS name, 'DINT' AS member_type, k AS dimension, NULL AS bit_number FROM p UNION ALL SELECT w, 'T' || CAST(k AS VARCHAR), 'b', 'BIT', NULL, 3 FROM p",
    "l5x_corpus": f"WITH {_BASE} SELECT w AS workspace, 'Controller' AS target_type, NULL AS assigned_to FROM p UNION ALL SELECT w || 'p', 'Program', w FROM p",
    "external_references": f"""WITH {_BASE}
        SELECT w AS workspace, 'module_address' AS kind, 'M' || n AS name, n AS address, false AS is_ipv4 FROM s WHERE s_suppkey % 10 = 0
        UNION ALL SELECT w, 'producer', 'GIVEN', 'c' || CAST(k + 1 AS VARCHAR), false FROM s WHERE s_suppkey % 6 = 0""",
    "tag_references": f"""WITH {_BASE},
        u AS (SELECT w AS workspace, 'XIC' AS instruction, 'READ' AS access, {_OWN} AS tag_key, '' AS member FROM s WHERE s_suppkey % 2 = 0
          UNION ALL SELECT w, 'OTE', 'WRITE', {_ALARM}, '' FROM s WHERE s_suppkey % 4 = 0
          UNION ALL SELECT w, 'CPT', 'UNKNOWN', {_OWN}, '' FROM s WHERE s_suppkey % 2 = 1
          UNION ALL SELECT w, 'MOV', UNNEST(['READ', 'WRITE']), {_OWN}, '' FROM s WHERE s_suppkey % 2 = 1
          UNION ALL SELECT w, 'ST_ASSIGN', 'WRITE', {_ALARM}, '' FROM s WHERE s_suppkey % 8 = 0
          UNION ALL SELECT w, 'ST_ASSIGN', 'READ', {_OWN}, '.DN' FROM s WHERE s_suppkey % 8 = 0)
        SELECT *, COUNT(*) AS n FROM u GROUP BY ALL""",
    "unresolved_references": f"""WITH {_BASE}
        SELECT w AS workspace, 'GRT' AS instruction, 'Gone' || n || '.ACC' AS identifier, NULL AS source_tag_key FROM s WHERE s_suppkey % 2 = 0
        UNION ALL SELECT w, 'OTE', 'Hi' || n || '_Alm', NULL FROM s WHERE s_suppkey % 4 = 2
        UNION ALL SELECT w, 'ALIAS', 'Local:' || CAST(s_suppkey // 10 * 10 AS VARCHAR) || ':I.Data.' || CAST(s_suppkey // 5 % 8 AS VARCHAR), 'controller:In' || n FROM s WHERE s_suppkey % 5 = 0""",
    "alarm_candidates": f"""WITH {_BASE}
        SELECT w AS workspace, {_ALARM} AS tag_key, 'alarm' AS kinds, 'Main/R/' || n || CASE WHEN s_suppkey % 8 = 0 THEN ',Main/T/' || n ELSE '' END AS writers FROM s WHERE s_suppkey % 4 = 0""",
    "cause_effects": f"""WITH {_BASE}
        SELECT w AS workspace, 'R' AS routine, {_ALARM} AS effect_tag_key, 'OTE' AS write_instruction, {_OWN} AS cause, '' AS member, 'resolved' AS cause_status, 27 AS key_length FROM s WHERE s_suppkey % 4 = 0
        UNION ALL SELECT w, 'R', {_ALARM}, 'OTE', 'Gone' || n || '.ACC', '', 'unresolved', 27 FROM s WHERE s_suppkey % 4 = 0
        UNION ALL SELECT w, 'T', {_ALARM}, 'ST_ASSIGN', {_OWN}, '.DN', 'resolved', 27 FROM s WHERE s_suppkey % 8 = 0""",
    "io_list": f"WITH {_CHANNELS} SELECT * FROM x",
    "controller_schedule": f"WITH {_CHANNELS} SELECT workspace, module AS name, COUNT(*) FILTER (status = 'assigned') AS assigned, COUNT(*) FILTER (status = 'spare') AS spare FROM x GROUP BY 1, 2",
    "rung_coverage": f"""WITH {_BASE},
        m AS (SELECT w AS workspace, UNNEST(['XIC', 'GRT', 'OTE']) AS mnemonic, 1 AS executable FROM s WHERE s_suppkey % 2 = 0 UNION ALL SELECT w, 'MOV', 1 FROM s WHERE s_suppkey % 2 = 1 UNION ALL SELECT w, 'CPT', 0 FROM s WHERE s_suppkey % 2 = 1)
        SELECT workspace, mnemonic, COUNT(*) AS occurrences, CAST(SUM(executable) AS BIGINT) AS executable, 100.0 * SUM(executable) / COUNT(*) AS percent FROM m GROUP BY 1, 2""",
    "produced_consumed": f"""WITH {_BASE}
        SELECT s.w AS workspace, 'Got' || n AS tag, p.w AS producer_workspace, CASE WHEN p.w IS NOT NULL THEN 2 END AS produce_count, 25.0 AS rpi FROM s LEFT JOIN p ON p.k = s.k + 1 WHERE s_suppkey % 6 = 0""",
    "report_manifest": f"""WITH {_CHANNELS},
        t AS (SELECT 'tasks' AS report, 'changed' AS fault, 'workspace,name,task_type,rate,priority,watchdog,scheduled' || chr(10) || string_agg(w || ',Fast,PERIODIC,' || CAST(k + 1 AS VARCHAR) || ',5,500,Main' || chr(10), '' ORDER BY w) AS body FROM p
          UNION ALL SELECT 'io_list', 'unexpected', 'workspace,module,channel,status' || chr(10) || string_agg(workspace || ',' || module || ',' || CAST(channel AS VARCHAR) || ',' || status || chr(10), '' ORDER BY workspace, module, channel) FROM x)
        SELECT report, fault, sha256(body) AS sha256, CAST(octet_length(encode(body)) AS BIGINT) AS bytes FROM t UNION ALL SELECT 'gone', 'missing', NULL, NULL""",
    "instruction_definitions": f"""WITH {_BASE}
        SELECT w AS workspace, 'Aoi' || CAST(k AS VARCHAR) AS name, '1.0' AS revision, true AS execute_prescan, 3 AS parameters, 2 AS required, 1 AS local_tags FROM p
        UNION ALL SELECT w, 'Odd' || CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM p""",
    "instruction_instances": f"WITH {_BASE} SELECT w AS workspace, 'I' || n AS tag, 'Aoi' || CAST(k AS VARCHAR) AS definition, 'resolved' AS status FROM s WHERE s_suppkey % 9 = 0",
    "call_resolution": f"WITH {_BASE} SELECT w AS workspace, s_suppkey + 1000000 AS number, 'AOI' || CAST(k AS VARCHAR) AS callee, 'Aoi' || CAST(k AS VARCHAR) AS definition, w AS definition_workspace, 'resolved' AS status FROM s WHERE s_suppkey % 9 = 0",
    "argument_binding": f"""WITH {_BASE}
        SELECT w AS workspace, s_suppkey + 1000000 AS number, 0 AS position, 'instance' AS role, NULL AS parameter, NULL AS flow, 'program:Main:I' || n AS tag_key FROM s WHERE s_suppkey % 9 = 0
        UNION ALL SELECT w, s_suppkey + 1000000, 1, 'parameter', 'Given', 'input', NULL FROM s WHERE s_suppkey % 9 = 0
        UNION ALL SELECT w, s_suppkey + 1000000, 2, 'parameter', 'Made', 'output', {_OWN} FROM s WHERE s_suppkey % 9 = 0
        UNION ALL SELECT w, s_suppkey + 1000000, 3, 'unmatched', NULL, NULL, NULL FROM s WHERE s_suppkey % 9 = 0""",
    "module_operands": f"""WITH {_BASE}
        SELECT DISTINCT w AS workspace, 'M' || CAST(s_suppkey // 10 * 10 AS VARCHAR) || ':I.Data' AS operand, 'M' || CAST(s_suppkey // 10 * 10 AS VARCHAR) AS module, 'I.Data' AS path, 'input' AS direction FROM s WHERE s_suppkey % 9 = 0""",
    "software_modules": f"WITH {_BASE} SELECT w AS workspace, 'Aoi' || CAST(k AS VARCHAR) AS definition, 'program:Main:I' || n AS instance, 1 AS calls, 'M' || CAST(s_suppkey // 10 * 10 AS VARCHAR) AS modules FROM s WHERE s_suppkey % 9 = 0",
    "instruction_portability": f"WITH {_BASE} SELECT w AS workspace, 'Aoi' || CAST(k AS VARCHAR) AS name, 'portable' AS disposition, '' AS blocking FROM p UNION ALL SELECT w, 'Odd' || CAST(k AS VARCHAR), 'blocked', 'PID' FROM p",
    "controller_summary": f"""WITH {_BASE}
        SELECT w AS workspace, 1 AS programs, 2 AS routines, COUNT(*) + COUNT(*) FILTER (s_suppkey % 9 = 0) AS rungs, COUNT(*) + 1 + COUNT(*) FILTER (s_suppkey % 5 = 0) + COUNT(*) FILTER (s_suppkey % 4 = 0) + COUNT(*) FILTER (s_suppkey % 6 = 0) + COUNT(*) FILTER (s_suppkey % 7 = 0) + COUNT(*) FILTER (s_suppkey % 9 = 0) AS tags,
          1 AS tasks, 2 AS definitions, 3 * COUNT(*) FILTER (s_suppkey % 2 = 0) + 2 * COUNT(*) FILTER (s_suppkey % 2 = 1) + COUNT(*) FILTER (s_suppkey % 9 = 0) AS calls,
          3 * MAX(CAST(s_suppkey % 2 = 0 AS INTEGER)) + 2 * MAX(CAST(s_suppkey % 2 = 1 AS INTEGER)) + MAX(CAST(s_suppkey % 9 = 0 AS INTEGER)) AS callees FROM s GROUP BY 1""",
    "corpus_markdown": f"""WITH {_BASE}
        SELECT '| Controller | C' || CAST(k AS VARCHAR) || ' | ' || w || ' |' AS value FROM p UNION ALL SELECT '| Program | P | ' || w || 'p |' FROM p""",
    "model_export": f"""WITH {_BASE}
        SELECT k AS model, '/objects/' || CAST(s_suppkey % {SUPPLIERS} AS VARCHAR) || '/references/next/$ref' AS pointer, '#/objects/' || CAST((s_suppkey + 1) % {SUPPLIERS} AS VARCHAR) AS target
        FROM s WHERE s_suppkey % {SUPPLIERS} < {SUPPLIERS - 1} AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)""",
    "model_validation": f"""WITH {_BASE}
        SELECT k AS model, 'forward' AS reason, COUNT(*) AS n FROM s WHERE s_suppkey % {SUPPLIERS} < {SUPPLIERS - 1} AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
    "model_records": "SELECT 'm.Supplier' AS record_type, COUNT(*) AS n FROM supplier",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
