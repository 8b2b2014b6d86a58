"""Queries over rungs, trees, lookups and files that are named one by one, made from the driver's tables, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering, rules, tree
from ..sources import projects
from .recordings import _tables

#: The rungs of a program, by what is left when its number is divided by six.
_PROGRAMS = (
    ("XIC(Up)CTU(C,5,0);", "XIC(C.DN)OTE(Lamp);", "XIC(Clear)RES(C);"),
    ("XIC(A)OTE(B);", "XIC(Up)CTU(C,?,?);", "XIC(Dn)CTD(C,?,?);", "XIC(C.DN)OTE(Lamp);", "XIC(Clear)RES(C);"),
    ("XIC(Dn)CTD(C,1,0);", "XIC(Up)CTU(C,1,0);", "XIC(C.DN)OTE(Lamp)", "XIC(Clear)RES(C)", "XIC(Up)CTU(D,5,0);", "XIC(D.DN)OTE(E);", "XIC(Clear)RES(D);"),
    ("XIC(Up)CTU(C,5,0);", "XIC(Dn)CTD(Other,5,0);", "XIC(C.DN)OTE(Lamp);", "XIC(Clear)RES(C);"),
    ("XIC(Up)CTU(C,5,0);", "XIC(C.DN)OTE(Lamp);", "XIC(Clear)RES(C);", "XIC(Up2)CTU(C,5,0);", "XIC(C.DN)OTE(Lamp2);", "XIC(Clear)RES(C);"),
    ("XIC(Up)CTU(C,5,0);", "XIC(C.DN)OTE(Lamp);", "XIC(A)OTE(B);", "XIC(Clear)RES(C);"),
)


def counter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*[F.array(*[F.lit(t) for t in p]) for p in _PROGRAMS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    rungs = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.posexplode(texts).alias("number", "text"))
    return ordering.counter_groups(rungs, ["c_custkey"], "number", "text")


def module_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree of threes in breadth-first order; siblings stand from the highest number down."""
    n = F.col("p_partkey")
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(n > 0, F.floor((n - 1) / 3)).alias("up"), (-n).alias("order"))
    return tree.breadth_first(nodes, "p_partkey", "up", "order")


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    number = F.when(n % 5 == 0, F.concat(F.lit(" +"), n.cast("string"), F.lit("_0"))).when(n % 5 == 1, "0x1F").when(n % 5 == 2, n.cast("string")).when(n % 5 == 3, "")
    truth = F.when(n % 4 == 0, "true").when(n % 4 == 1, "false").when(n % 4 == 2, "True")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", rules.whole_number(number).alias("n"), rules.flag(truth).alias("f"))
    return rows.select("p_partkey", F.col("n.value").alias("number"), F.col("n.fault").alias("number_fault"), F.col("f.value").alias("flag"), F.col("f.fault").alias("flag_fault"))


def capability_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first of three providers that knows a module's catalog number says of it."""
    n = F.col("s_suppkey")
    catalog = F.when(n % 4 == 0, "1756-IB16").when(n % 4 == 1, "1756-OF8").when(n % 4 == 2, "2080-X").otherwise("none")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("catalog", catalog)
    known = projects.module_capability(F.col("catalog"), F.when(n % 3 != 0, 1))
    by_catalog = F.when(known["direction"].isNotNull(), F.concat_ws(" ", known["direction"], known["signal"], known["channels"].cast("string")))
    answer = rules.first_answer({"catalog": by_catalog, "family": F.when(F.col("catalog").startswith("2080"), "small"), "slot": F.when(n % 6 == 3, "any")})
    return rows.select("s_suppkey", answer.alias("a")).select("s_suppkey", "a.provider", "a.answer")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.nullif("l_returnflag", F.lit("R")).alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return ordering.ordered_distinct(rows, ["l_suppkey"], "flag", "at").select("l_suppkey", F.concat_ws(",", "values").alias("flags"))


def message_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _tables(spark, sf_dir, """
        SELECT s_suppkey, s_suppkey % 4 AS program, element_at(array('MSG', 'msg', 'MOV'), CAST(s_suppkey % 3 + 1 AS INT)) AS callee,
          element_at(array(array('Own'), array('own'), array(' Shared '), array('Own.DN'), array(), array('Own', 'Shared'), array('Gone')), CAST(s_suppkey % 7 + 1 AS INT)) AS arguments FROM {supplier}""")  # fmt: skip
    own = spark.createDataFrame([(0, "Own"), (1, "Own"), (1, "Shared")], "program long, name string")
    shared = spark.createDataFrame([("Shared",), ("Own",)], "name string")
    return rules.message_evidence(calls, own, shared).select("s_suppkey", "tag", "tag_scope", "reason")


def explicit_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controller tags of every second project, whose files are named one by one; a file that is named twice is read once."""
    from .controllers import projects_folder

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.L5X").load(projects_folder(spark, sf_dir)).select("path")
    chosen = [r["path"] for r in files.where(F.regexp_extract("path", r"R(\d+)\.L5X$", 1).cast("long") % 2 == 0).orderBy("path").collect()]
    rows = projects.read_projects(spark, [*chosen, *chosen[:1]])
    block = F.regexp_extract("workspace", r"R(\d+)\.L5X$", 1).cast("long")
    return rows.where("element = 'Tag' and path like '%/Controller/Tags/Tag'").groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("tags"))


QUERIES = (counter_groups, module_levels, coerced_values, capability_providers, ordered_distinct, message_operands, explicit_projects)

SQL = {
    "counter_groups": """
    WITH g AS (SELECT * FROM (VALUES
      (0, 0, 'C', 'Up', NULL, 'Clear', 'Lamp', 'up', 3, 1), (1, 1, 'C', 'Up', 'Dn', 'Clear', 'Lamp', 'up_down', 4, 1), (2, 0, 'C', 'Up', 'Dn', 'Clear', 'Lamp', 'down_up', 4, 1), (2, 4, 'D', 'Up', NULL, 'Clear', 'E', 'up', 3, 1),
      (4, 0, 'C', 'Up', NULL, 'Clear', 'Lamp', 'up', 3, 2), (4, 3, 'C', 'Up2', NULL, 'Clear', 'Lamp2', 'up', 3, 2)) t(m, number, counter, up, down, reset, output, sequence, rungs, groups))
    SELECT c_custkey, number, counter, up, down, reset, output, sequence, rungs, groups FROM customer JOIN g ON c_custkey % 6 = m""",
    "module_levels": """
    WITH RECURSIVE t AS (SELECT p_partkey, 0 AS depth, [-p_partkey] AS way FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, t.depth + 1, t.way || [-p.p_partkey] FROM part p JOIN t ON p.p_partkey > 0 AND (p.p_partkey - 1) // 3 = t.p_partkey)
    SELECT p_partkey, depth, ROW_NUMBER() OVER (ORDER BY depth, way) AS position FROM t""",
    "coerced_values": """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 10 WHEN 2 THEN p_partkey END AS number, CASE WHEN p_partkey % 5 IN (1, 3) THEN 'invalid_integer' END AS number_fault,
      CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE WHEN p_partkey % 4 = 2 THEN 'invalid_boolean' END AS flag_fault FROM part""",
    "capability_providers": """
    WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS c, s_suppkey % 3 <> 0 AS own, s_suppkey % 6 = 3 AS slot FROM supplier)
    SELECT s_suppkey, CASE WHEN own AND c < 2 THEN 'catalog' WHEN c = 2 THEN 'family' WHEN slot THEN 'slot' END AS provider,
      CASE WHEN own AND c = 0 THEN 'input digital 16' WHEN own AND c = 1 THEN 'output analog 8' WHEN c = 2 THEN 'small' WHEN slot THEN 'any' END AS answer FROM s""",
    "ordered_distinct": """
    WITH f AS (SELECT l_suppkey, l_returnflag AS flag, MIN(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
    SELECT l_suppkey, string_agg(flag, ',' ORDER BY pos) AS flags FROM f GROUP BY 1""",
    "message_operands": """
    WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS p, s_suppkey % 7 AS a FROM supplier WHERE s_suppkey % 3 <> 2)
    SELECT s_suppkey, CASE a WHEN 0 THEN 'Own' WHEN 2 THEN 'Shared' END AS tag, CASE a WHEN 0 THEN CASE WHEN p < 2 THEN 'program' ELSE 'controller' END WHEN 2 THEN CASE WHEN p = 1 THEN 'program' ELSE 'controller' END END AS tag_scope,
      CASE WHEN a IN (4, 5) THEN 'arity' WHEN a = 3 THEN 'not_a_name' WHEN a IN (1, 6) THEN 'unknown_tag' END AS reason FROM s""",
    "explicit_projects": """
    SELECT s_suppkey // 50 AS block, COUNT(*) + 1 + COUNT(*) FILTER (s_suppkey % 5 = 0) + COUNT(*) FILTER (s_suppkey % 4 = 0) + COUNT(*) FILTER (s_suppkey % 6 = 0) AS tags FROM supplier WHERE s_suppkey // 50 % 2 = 0 GROUP BY 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
