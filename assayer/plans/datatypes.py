"""Queries over nested datatypes and value trees made from parts and orders, with their twins.

Every part is a type that holds the type of half its number, so types are nested as deep as
the logarithm of the table. Some parts hold each other, some hold a type that nobody defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datatypes

#: Parts whose type is held by the one that it holds: a cycle.
_BACK = "p_partkey % 101 = 7 AND p_partkey > 200"
_MEMBERS = f"""
    SELECT CONCAT('T', p_partkey) AS data_type, 0 AS ordinal, 'Flag' AS name, 'BOOL' AS member_type, CASE WHEN p_partkey % 6 = 1 THEN 40 END AS dimension, CAST(NULL AS STRING) AS target, CAST(NULL AS INT) AS bit_number FROM {{part}} WHERE p_size % 2 = 1
    UNION ALL SELECT CONCAT('T', p_partkey), 1, 'Count', element_at(array('SINT', 'INT', 'DINT', 'LREAL'), CAST(p_partkey % 4 + 1 AS INT)), CASE WHEN p_partkey % 5 = 0 THEN 3 END, NULL, NULL FROM {{part}}
    UNION ALL SELECT CONCAT('T', p_partkey), 2, 'Inner', CONCAT('T', CAST(floor(p_partkey / 2) AS BIGINT)), CASE WHEN p_partkey % 16 = 1 THEN 2 END, NULL, NULL FROM {{part}} WHERE p_partkey > 1
    UNION ALL SELECT CONCAT('T', p_partkey), 3, 'Mask', 'BIT', NULL, CASE WHEN p_partkey % 7 = 0 THEN 'Nowhere' ELSE 'Count' END, CAST(p_partkey % 8 AS INT) FROM {{part}}
    UNION ALL SELECT CONCAT('T', p_partkey), 4, 'Gone', CONCAT('Gone', p_partkey), NULL, NULL, NULL FROM {{part}} WHERE p_partkey % 37 = 5
    UNION ALL SELECT CONCAT('T', p_partkey), 5, 'Tail', 'sint', NULL, NULL, NULL FROM {{part}}
    UNION ALL SELECT CONCAT('T', CAST(floor(p_partkey / 2) AS BIGINT)), 6, CONCAT('Back', p_partkey), CONCAT('T', p_partkey), NULL, NULL, NULL FROM {{part}} WHERE {_BACK}"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT 'R' AS scope, * FROM ({_MEMBERS})", part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    wanted = members.where("name IN ('Inner', 'Gone') OR name LIKE 'Back%'").select("scope", F.col("data_type").alias("name"), F.col("member_type").alias("needs"))
    # A second thing that a type needs: the type of a third of its number.
    third = members.where("ordinal = 5").select("scope", F.col("data_type").alias("name"), F.concat(F.lit("T"), F.floor(F.substring("data_type", 2, 20).cast("long") / 3).cast("string")).alias("needs")).where("name <> 'T0'")
    return datatypes.dependency_levels(members.select("scope", F.col("data_type").alias("name")), wanted.union(third), ["scope"])


def datatype_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)[0].select("name", "level", "state")


def datatype_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)[1].select("name", "needs")


def datatype_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datatypes.layout(_members(spark, sf_dir), ["scope"])[0].select("data_type", "name", "byte_offset", "element_size", "elements", "fault")


def datatype_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datatypes.layout(_members(spark, sf_dir), ["scope"])[1].select("data_type", "level", "size", "align", "state")


def datatype_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    placed, _ = datatypes.layout(members, ["scope"])
    return datatypes.leaves(placed, members.select("scope", F.col("data_type").alias("root")), ["scope"]).select("root", "path", "leaf_type", "byte_offset", "bit")


#: A path of an order: from its part's type through as many nested ones as its number says, to an end that may not be there.
_PATHS = """
    SELECT 'R' AS scope, o_orderkey, CONCAT('T', CASE WHEN o_orderkey % 17 = 3 THEN -1 ELSE n END) AS data_type,
      CONCAT(repeat('Inner.', CAST(deep AS INT)), CASE WHEN o_orderkey % 5 = 0 THEN 'Inner[1].' ELSE '' END,
        element_at(array('Count', 'Tail', 'Nobody', 'Tail.More', 'Mask', 'Count[2', 'Count[2,0]', 'Count[1]'), CAST(o_orderkey % 8 + 1 AS INT))) AS path
    FROM (SELECT o_orderkey, o_custkey % 1000 + 1000 AS n, o_orderkey % 6 AS deep FROM {orders})"""


def datatype_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.sql(_PATHS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    found = datatypes.walk_paths(paths, _members(spark, sf_dir), ["scope"], "o_orderkey")
    return found.select("o_orderkey", "resolved_type", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"), F.size("members").alias("passed"), "status", "stopped_at", F.concat_ws(" ", "beyond").alias("beyond"))


#: A tree of values: each part below the one of half its number; some name their type, some are indices.
_NODES = """
    SELECT 'R' AS scope, p_partkey AS place, CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS parent_place, CASE WHEN p_partkey % 4 <> 3 THEN CONCAT('N', p_partkey) END AS name, CASE WHEN p_partkey % 4 = 3 THEN CONCAT('[', p_partkey, ']') END AS index,
      CASE WHEN p_size % 5 = 0 THEN element_at(array('BOOL', 'DINT', 'REAL', 'STRING', 'T1'), CAST(p_partkey % 5 + 1 AS INT)) END AS data_type, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 2 AS STRING) WHEN p_partkey % 3 = 1 THEN CONCAT(p_partkey, '.5') END AS value
    FROM {part}"""


def composite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.sql(_NODES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return datatypes.composite_values(nodes, ["scope"]).select("place", "path", "data_type", "boolean", "whole", "real", "text", "fault")


QUERIES = (datatype_levels, datatype_missing, datatype_layout, datatype_sizes, datatype_leaves, datatype_paths, composite_values)

#: Types that hold each other, and all that hold one of them: k, as numbers.
_BAD = f"""bad AS (SELECT DISTINCT k FROM (SELECT UNNEST([p_partkey, p_partkey // 2]) AS k FROM part WHERE {_BACK})),
    cyclic AS (SELECT k FROM bad UNION SELECT p_partkey FROM part JOIN cyclic ON p_partkey > 1 AND p_partkey // 2 = k)"""
_UP = "(({at}) + ({by}) - 1) // ({by}) * ({by})"


def _up(at: str, by: str) -> str:
    return _UP.format(at=at, by=by)


#: Sizes from the smallest number up: each type holds the type of half its number, whose size is known by then.
_SIZES = f"""own AS (
      SELECT p_partkey AS k, CASE WHEN p_size % 2 = 1 THEN CASE WHEN p_partkey % 6 = 1 THEN 8 ELSE 1 END ELSE 0 END AS flag, CASE WHEN p_size % 2 = 1 AND p_partkey % 6 = 1 THEN 4 ELSE 1 END AS flag_align,
        [1, 2, 4, 8][p_partkey % 4 + 1] AS atom, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS counts, CASE WHEN p_partkey % 16 = 1 THEN 2 ELSE 1 END AS inners
      FROM part WHERE p_partkey NOT IN (SELECT k FROM cyclic)),
    sized AS (
      SELECT k, CAST({_up('flag', 'atom')} AS BIGINT) AS at_count, CAST(NULL AS BIGINT) AS at_inner, CAST({_up('flag', 'atom')} + atom * counts AS BIGINT) AS at_tail, CAST(GREATEST(flag_align, atom) AS BIGINT) AS align, CAST(0 AS BIGINT) AS inner_size,
        CAST({_up(f"{_up('flag', 'atom')} + atom * counts + 1", 'GREATEST(flag_align, atom)')} AS BIGINT) AS size, 0 AS level FROM own WHERE k <= 1
      UNION ALL
      SELECT o.k, {_up('flag', 'atom')}, {_up(f"{_up('flag', 'atom')} + atom * counts", 's.align')}, {_up(f"{_up('flag', 'atom')} + atom * counts", 's.align')} + s.size * inners, GREATEST(flag_align, atom, s.align), s.size,
        {_up(f"{_up(f'{_up("flag", "atom")} + atom * counts', 's.align')} + s.size * inners + 1", 'GREATEST(flag_align, atom, s.align)')}, s.level + 1
      FROM own o JOIN sized s ON o.k > 1 AND o.k // 2 = s.k)"""

_PLACED = f"""{_BAD}, {_SIZES},
    m AS (
      SELECT p_partkey AS k, 'Flag' AS name, 'BOOL' AS kind, p_partkey % 6 = 1 AS packed, CASE WHEN p_partkey % 6 = 1 THEN 40 ELSE 1 END AS elements, 1 AS size0 FROM part WHERE p_size % 2 = 1
      UNION ALL SELECT p_partkey, 'Count', ['SINT', 'INT', 'DINT', 'LREAL'][p_partkey % 4 + 1], FALSE, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END, [1, 2, 4, 8][p_partkey % 4 + 1] FROM part
      UNION ALL SELECT p_partkey, 'Inner', 'T' || p_partkey // 2, FALSE, CASE WHEN p_partkey % 16 = 1 THEN 2 ELSE 1 END, NULL FROM part WHERE p_partkey > 1
      UNION ALL SELECT p_partkey, 'Mask', 'BIT', FALSE, 1, 0 FROM part
      UNION ALL SELECT p_partkey, 'Gone', 'Gone' || p_partkey, FALSE, 1, 0 FROM part WHERE p_partkey % 37 = 5
      UNION ALL SELECT p_partkey, 'Tail', 'sint', FALSE, 1, 1 FROM part
      UNION ALL SELECT p_partkey // 2, 'Back' || p_partkey, 'T' || p_partkey, FALSE, 1, NULL FROM part WHERE {_BACK}),
    placed AS (
      SELECT m.k, name, kind, packed, elements, s.k IS NULL AS cyclic, CASE WHEN s.k IS NOT NULL THEN COALESCE(size0, inner_size) END AS element_size,
        CASE WHEN name = 'Flag' THEN 0 WHEN name = 'Count' THEN at_count WHEN name = 'Inner' THEN at_inner WHEN name = 'Mask' THEN CASE WHEN m.k % 7 <> 0 THEN at_count END WHEN s.k IS NOT NULL THEN at_tail END + 0 * COALESCE(s.k, NULL) AS byte_offset
      FROM m LEFT JOIN sized s ON m.k = s.k)"""

SQL = {
    "datatype_levels": f"""
    WITH RECURSIVE {_BAD}, r AS (SELECT p_partkey AS k, UNNEST([CASE WHEN p_partkey > 1 THEN p_partkey // 2 END, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END]) AS n FROM part),
    e AS (SELECT DISTINCT k, n FROM r WHERE n IS NOT NULL UNION SELECT p_partkey // 2, p_partkey FROM part WHERE {_BACK}),
    stuck AS (SELECT k FROM bad UNION SELECT e.k FROM e JOIN stuck s ON e.n = s.k),
    w AS (SELECT p_partkey AS k, 0 AS steps FROM part WHERE p_partkey NOT IN (SELECT k FROM stuck) UNION SELECT e.k, steps + 1 FROM w JOIN e ON e.n = w.k WHERE e.k NOT IN (SELECT k FROM stuck))
    SELECT 'T' || p_partkey AS name, MAX(steps) AS level, CASE WHEN MAX(steps) IS NULL THEN 'cyclic' ELSE 'ordered' END AS state FROM part LEFT JOIN w ON k = p_partkey GROUP BY p_partkey""",
    "datatype_missing": "SELECT 'T' || p_partkey AS name, 'Gone' || p_partkey AS needs FROM part WHERE p_partkey % 37 = 5",
    "datatype_sizes": f"""
    WITH RECURSIVE {_BAD}, {_SIZES}
    SELECT 'T' || p_partkey AS data_type, level, size, align, CASE WHEN level IS NULL THEN 'cyclic' ELSE 'ordered' END AS state FROM part LEFT JOIN sized ON k = p_partkey""",
    "datatype_layout": f"""
    WITH RECURSIVE {_PLACED}
    SELECT 'T' || k AS data_type, name, byte_offset, element_size, elements, CASE WHEN cyclic THEN 'cyclic' WHEN name = 'Gone' THEN 'unknown_type' WHEN name = 'Mask' AND k % 7 = 0 THEN 'unknown_target' END AS fault FROM placed""",
    "datatype_leaves": f"""
    WITH RECURSIVE {_PLACED},
    walk AS (
      SELECT k AS root, k, '' AS path, CAST(0 AS BIGINT) AS base FROM sized
      UNION ALL SELECT w.root, w.k // 2, w.path || CASE WHEN w.path = '' THEN '' ELSE '.' END || 'Inner' || CASE WHEN p.elements > 1 THEN '[' || i || ']' ELSE '' END, w.base + p.byte_offset + i * p.element_size
      FROM walk w JOIN placed p ON p.k = w.k AND p.name = 'Inner', UNNEST(range(p.elements)) AS t(i))
    SELECT 'T' || root AS root, w.path || CASE WHEN w.path = '' THEN '' ELSE '.' END || name || CASE WHEN elements > 1 THEN '[' || i || ']' ELSE '' END AS path, kind AS leaf_type,
      w.base + p.byte_offset + CASE WHEN packed THEN i // 8 ELSE i * p.element_size END AS byte_offset, CAST(CASE WHEN name = 'Mask' THEN w.k % 8 WHEN packed THEN i % 8 END AS BIGINT) AS bit
    FROM walk w JOIN placed p ON p.k = w.k AND name IN ('Flag', 'Count', 'Mask', 'Tail') AND p.byte_offset IS NOT NULL, UNNEST(range(p.elements)) AS t(i)""",
    "datatype_paths": """
    WITH o AS (SELECT o_orderkey AS k, o_custkey % 1000 + 1000 AS n, o_orderkey % 6 AS deep, o_orderkey % 5 = 0 AS more, o_orderkey % 8 AS ending FROM orders),
    p AS (SELECT *, CAST(n >> (deep + CAST(more AS INT)) AS BIGINT) AS held, CAST(n >> deep AS BIGINT) AS holder FROM o),
    q AS (
      SELECT *, NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = n) OR k % 17 = 3 AS lost, ['Count', 'Tail', 'Nobody', 'Tail', 'Mask', NULL, 'Count', 'Count'][ending + 1] AS last,
        deep + CAST(more AS INT) + CASE WHEN ending IN (2, 5) THEN 0 ELSE 1 END AS passed FROM p)
    SELECT k AS o_orderkey, CASE WHEN lost THEN NULL WHEN ending IN (0, 6, 7) THEN ['SINT', 'INT', 'DINT', 'LREAL'][held % 4 + 1] WHEN ending = 1 THEN 'sint' WHEN ending = 4 THEN 'BIT' END AS resolved_type,
      CASE WHEN lost THEN '' ELSE concat_ws(',', CASE WHEN more THEN '1' END, CASE ending WHEN 6 THEN '2,0' WHEN 7 THEN '1' END) END AS indices, CASE WHEN lost THEN 0 ELSE passed END AS passed,
      CASE WHEN lost THEN 'unknown_type' WHEN ending = 2 THEN 'unknown_member' WHEN ending = 3 THEN 'through_scalar' WHEN ending = 5 THEN 'not_parsed' ELSE 'resolved' END AS status,
      CASE WHEN lost THEN NULL WHEN ending = 2 THEN 'Nobody' WHEN ending = 3 THEN 'More' WHEN ending = 5 THEN 'Count[2' END AS stopped_at,
      CASE WHEN lost THEN '' ELSE COALESCE(CASE WHEN ending = 6 AND held % 5 = 0 THEN 'Count[2,0]' END, '') END AS beyond
    FROM q""",
    "composite_values": """
    WITH RECURSIVE n AS (
      SELECT p_partkey AS k, p_partkey // 2 AS up, CASE WHEN p_partkey % 4 <> 3 THEN 'N' || p_partkey ELSE '[' || p_partkey || ']' END AS own, p_partkey % 4 = 3 AS is_index,
        CASE WHEN p_size % 5 = 0 THEN ['BOOL', 'DINT', 'REAL', 'STRING', 'T1'][p_partkey % 5 + 1] END AS kind, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 2 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_partkey || '.5' END AS value FROM part),
    t AS (SELECT k, own AS path, kind, value FROM n WHERE k = 0
      UNION ALL SELECT n.k, t.path || CASE WHEN is_index THEN '' ELSE '.' END || own, COALESCE(n.kind, t.kind), n.value FROM n JOIN t ON n.k > 0 AND n.up = t.k),
    v AS (SELECT *, k % 3 = 0 AS plain FROM t WHERE value IS NOT NULL)
    SELECT k AS place, path, kind AS data_type, CASE WHEN kind = 'BOOL' AND plain THEN value = '1' END AS boolean, CASE WHEN kind = 'DINT' AND plain THEN CAST(value AS BIGINT) END AS whole, CASE WHEN kind = 'REAL' THEN CAST(value AS DOUBLE) END AS real,
      CASE WHEN kind = 'STRING' THEN value END AS text, CASE WHEN kind IN ('BOOL', 'DINT') AND NOT plain THEN 'invalid_value' END AS fault FROM v""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
