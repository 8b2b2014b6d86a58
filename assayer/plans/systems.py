"""Queries over documents, archives, stores, gateways, graphs and devices made from the driver's tables, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, gateway, topology
from ..sources import archives, documents, manifest, revisions
from .recordings import _files, _folder, written_once


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if f"{{{n}}}" in sql})


def _lines(spark: SparkSession, sf_dir: str, parts: list[tuple[int, str]], block: int) -> DataFrame:
    """k, rank, n and line: rank 0 and 9 once a block of parts, the others for each part."""
    k = f"CAST(floor(p_partkey / {block}) AS BIGINT)"
    out = None
    for rank, line in parts:
        sql = f"SELECT DISTINCT {k} AS k, {rank} AS rank, 0L AS n, {line.format(k=k)} AS line FROM {{part}}" if rank in (0, 9) else f"SELECT {k} AS k, {rank} AS rank, p_partkey AS n, {line.format(k=k)} AS line FROM {{part}}"
        one = _sql(spark, sf_dir, sql)
        out = one if out is None else out.union(one)
    return out


# ---- documents

_DOCUMENT = [(0, """CONCAT('<?go now?><r xmlns:x="u" k="', {k}, '">')"""), (1, """CONCAT('<x:p odd="a&amp;b &lt;', p_partkey, '" n="', p_size, '">text ', p_partkey, '<b/>tail &amp; ', p_partkey, '<!-- note ', p_partkey, ' --></x:p>')"""), (9, "'</r>'")]


def lossless_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document holds, and whether it is the same when it is written again from its rows."""
    folder = written_once(spark, sf_dir, "documents", lambda f: _files(_lines(spark, sf_dir, _DOCUMENT, 50), ".doc", f))
    rows = documents.read_documents(spark, folder, "doc")
    again = documents.digests_of(documents.written(rows)).withColumnRenamed("digest", "again")
    counts = rows.groupBy("document").agg(F.count_if(F.col("kind") == "element").alias("elements"), F.sum(F.size("attributes")).alias("attributes"), F.count_if(F.col("kind") == "comment").alias("comments"), F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("text_chars"))
    both = documents.document_digests(spark, folder, "doc").join(again, "document", "left").join(counts, "document")
    return both.select(F.regexp_extract("document", r"R(\d+)\.doc$", 1).cast("long").alias("block"), "elements", "attributes", "comments", "text_chars", F.coalesce(F.col("digest") == F.col("again"), F.lit(False)).alias("same"))


def unknown_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = written_once(spark, sf_dir, "documents", lambda f: _files(_lines(spark, sf_dir, _DOCUMENT, 50), ".doc", f))
    found = documents.unknown_content(documents.read_documents(spark, folder, "doc"), {"r": ("k",), "x:p": ("n",)})
    return found.groupBy("element", "attribute").agg(F.count(F.lit(1)).alias("n"))


# ---- archives


_ARCHIVE = [
    (0, """CONCAT('<ExportFile><Single Name="Profile"><Single Name="ProfileName">P', {k}, '</Single></Single><List2 Name="EntryList">')"""),
    (1, """CONCAT('<Single Type="e', p_partkey, '"><Single Name="MetaObject"><Single Name="Name">V', p_partkey, ' &amp; more</Single></Single><Single Name="Object">', CASE WHEN p_partkey % 5 = 0 THEN '<Single Name="Width">1</Single>' ELSE
        CONCAT('<Single Name="Width">', p_size, '</Single><Single Name="VisualElemList"><List Name="VisualElementList">',
          CASE WHEN p_partkey % 2 = 0 THEN CONCAT('<Single><Single Name="VisualElementId">', p_partkey, '</Single><Single Name="VisualElementName">Lamp</Single><Single Name="17">App.On', p_partkey, '</Single><Single Name="18">System.Now App.On', p_partkey, '</Single></Single>') ELSE '' END,
          '<Single><Single Name="VisualElementName">Frame</Single><Single /></Single></List></Single>') END, '</Single></Single>')"""),
    (9, "'</List2></ExportFile>'"),
]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = written_once(spark, sf_dir, "archives", lambda f: _files(_lines(spark, sf_dir, _ARCHIVE, 200), ".export", f))
    return archives.read_archives(spark, folder, split_bytes=5000)


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    return rows.groupBy(F.regexp_extract("file", r"R(\d+)\.export$", 1).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("start").alias("starts"), F.countDistinct("name").alias("names"))


def archive_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.visual_elements(_entries(spark, sf_dir)).select("name", "width", "element_ordinal", "element_id", "element_type", F.try_element_at("properties", F.lit("17")).alias("shown"), F.concat_ws(",", "bindings").alias("bindings"))


# ---- corpora and revisions


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a corpus after files were added and changed, and how many files the second run opened."""
    folder, store = _folder(spark, "corpus"), _folder(spark, "corpus-runs")
    k = "CAST(floor(p_partkey / 100) AS BIGINT)"
    first = _sql(spark, sf_dir, f"SELECT {k} AS k, 1 AS rank, p_partkey AS n, CONCAT(p_partkey, '|', p_size) AS line FROM {{part}} WHERE {k} % 4 <> 3")
    second = _sql(spark, sf_dir, f"SELECT {k} AS k, 1 AS rank, p_partkey AS n, CONCAT(p_partkey, '|', p_size + 1000) AS line FROM {{part}} WHERE {k} % 4 = 3 OR {k} % 4 = 1")

    def rows_of(path: str, content: bytes):  # noqa: ANN202
        for line in content.decode().splitlines():
            number, size = line.split("|")
            yield {"number": int(number), "size": int(size)}

    ddl = "number long, size long"
    _files(first, ".rec", folder)
    manifest.update(spark, folder, "*.rec", store, rows_of, ddl)
    _files(second, ".rec", folder)
    counts = manifest.update(spark, folder, "*.rec", store, rows_of, ddl)
    idle = manifest.update(spark, folder, "*.rec", store, rows_of, ddl)
    found = manifest.corpus(spark, store).groupBy(F.regexp_extract("path", r"R(\d+)\.rec$", 1).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("total"))
    return found.withColumns({"new_files": F.lit(counts.get("new", 0)).cast("long"), "changed_files": F.lit(counts.get("touched", 0)).cast("long"), "opened": F.lit(counts["read"]).cast("long"), "opened_again": F.lit(idle["read"]).cast("long")})


def revision_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of three revisions of the customers' orders; late writers and broken histories are refused."""
    path = _folder(spark, "revisions").removeprefix("file:")
    histories = lambda where: _sql(spark, sf_dir, f"SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS history FROM {{orders}} WHERE {where} GROUP BY o_custkey")
    revisions.save(histories("o_orderkey % 2 = 0 AND o_orderkey < 6000"), path, 0, "o_custkey", "history")
    refused = 0
    for state, expected in ((histories("o_orderkey < 6000"), 0), (histories("o_orderkey % 2 = 1"), 1)):
        try:
            revisions.save(state, path, expected, "o_custkey", "history")
        except (revisions.StaleRevision, revisions.BrokenHistory):
            refused += 1
    last = revisions.save(histories("o_orderkey % 2 = 0"), path, 1, "o_custkey", "history")
    return revisions.load(spark, path).select("o_custkey", F.size("history").alias("orders"), F.lit(last).alias("revision"), F.lit(refused).alias("refused"))


# ---- gateways

#: Configurations of modules 0 to 4; kind 2 doesn't describe module 4.
_CONFIGURATIONS = ("11", "21", "C04180", "5031", "10")
_SLOTS = "SELECT s_suppkey, explode(sequence(0, 3)) AS slot FROM {supplier}"
_ODD, _SHORT, _MORE = "s_suppkey % 35 = 0", "s_suppkey % 11 = 0 AND (s_suppkey + 3) % 5 IN (0, 1, 4)", "s_suppkey % 13 = 0"


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = f"element_at(array({', '.join(repr(c) for c in _CONFIGURATIONS)}), CAST((s_suppkey + i) % 5 + 1 AS INT))"
    slots = _sql(spark, sf_dir, f"SELECT s_suppkey, slot, CONCAT('M', (s_suppkey + slot) % 5) AS module FROM ({_SLOTS})")
    whole = f"array_join(transform(sequence(0, 3), i -> {table}), '')"
    devices = _sql(spark, sf_dir, f"""
        SELECT s_suppkey, CONCAT('K', s_suppkey % 3) AS kind, CASE WHEN {_ODD} THEN CONCAT('12', substring(s, 3)) WHEN {_SHORT} THEN substring(s, 1, length(s) - 2) WHEN {_MORE} THEN CONCAT(s, 'AB') ELSE s END AS stream
        FROM (SELECT s_suppkey, {whole} AS s FROM {{supplier}})""")  # fmt: skip
    modules = spark.createDataFrame([(f"K{k}", f"M{m}", c.lower()) for k in range(3) for m, c in enumerate(_CONFIGURATIONS) if (k, m) != (2, 4)], "kind string, module string, configuration string")
    return gateway.aligned_slots(devices, slots, modules, "s_suppkey", "kind")


def gateway_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)[0]


def gateway_left_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)[1]


_GATEWAYS = """
    SELECT s_suppkey, CONCAT('GW', s_nationkey) AS eds_product, CASE WHEN s_suppkey % 4 = 0 THEN CONCAT('gw', s_nationkey) ELSE 'Other' END AS gsd_model, s_suppkey % 3 <> 0 AS has_eds, s_suppkey % 5 <> 0 AS has_gsd,
      element_at(array('StandaloneMaster', 'Slave', 'Quiet', 'Odd', NULL), CAST(s_suppkey % 5 + 1 AS INT)) AS mode, element_at(array('EtherNetIP', 'ModbusTCPSlave', 'Serial', NULL), CAST(s_suppkey % 4 + 1 AS INT)) AS primary, CONCAT('10.0.0.', s_suppkey % 256) AS address
    FROM {supplier}"""


def gateway_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.endpoints(_sql(spark, sf_dir, _GATEWAYS), "s_suppkey")[0]


def gateway_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.endpoints(_sql(spark, sf_dir, _GATEWAYS), "s_suppkey")[1]


#: Points of orders, a third of them at one station; evidence about stations from suppliers.
_POINTS = "SELECT o_orderkey AS point, CONCAT('R', o_orderkey % 4) AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 5 WHEN o_orderkey % 19 = 1 THEN NULL ELSE o_custkey % 97 END AS station, CASE WHEN o_orderkey % 2 = 0 THEN 'Input' ELSE 'Output' END AS direction, CONCAT('P', o_custkey % 4) AS name, o_custkey % 200 AS offset FROM {orders}"
_STATIONS = "SELECT CONCAT('R', r) AS scope, s_suppkey % 97 AS station, CONCAT(b, s_suppkey % 97) AS base FROM (SELECT s_suppkey, explode(sequence(0, 3)) AS r FROM {supplier}) LATERAL VIEW explode(CASE WHEN s_suppkey % 97 % 13 = 4 THEN array('D', 'E') ELSE array('D') END) AS b"


def point_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = _sql(spark, sf_dir, _STATIONS)
    tags = stations.where("station % 7 <> 3").select("scope", "base", F.concat(F.lit("T"), (F.col("station") % 3).cast("string")).alias("data_type"))
    kinds = [(f"R{r}", f"T{t}", d, f"P{p}") for r in range(4) for t in range(3) for d in ("Input", "Output") for p in range(4) if (t, p) != (2, 3)]
    members = spark.createDataFrame(kinds, "scope string, data_type string, direction string, name string")
    block = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("assembly_at", "first", "length"), b)]) for b in ((1000, 0, 120), (2000, 120, 60))]))
    transfers = stations.select("scope", F.explode(F.array(*[F.concat("base", F.lit(d)) for d in (".Input", ".Output")])).alias("holder"), F.lit(0).alias("x")).select("scope", "holder", block.alias("b")).select("scope", "holder", "b.*")
    return gateway.points_to_tags(_sql(spark, sf_dir, _POINTS), stations, tags, members, transfers).select("point", "status", "tag_path", F.col("assembly_at").cast("long").alias("assembly_at"), "lost_at")


# ---- graphs

_ENDS = """
    SELECT CAST(floor(o_orderkey / 60) AS BIGINT) AS graph, CONCAT('L', o_orderkey) AS link, CONCAT('A', CASE WHEN floor(o_orderkey / 60) % 10 = 3 AND o_orderkey % 60 = 8 THEN 7 ELSE o_orderkey % 40 END) AS source_asset, CONCAT('N', o_orderkey % 40) AS source_node,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN floor(o_orderkey / 60) % 10 = 7 AND o_orderkey % 60 = 2 THEN 9 ELSE CAST(o_orderkey % 4 AS INT) END AS source_index, CONCAT('A', o_custkey % 40) AS target_asset, CONCAT('N', o_custkey % 40) AS target_node
    FROM {orders}"""
_PLACES = "SELECT CAST(floor(o_orderkey / 60) AS BIGINT) AS graph, o_orderkey % 60 AS n FROM {orders} WHERE o_orderkey % 60 < 40"


def _accepted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    places = _sql(spark, sf_dir, _PLACES)
    named = lambda letter, c: F.concat(F.lit(letter), "n").alias(c)
    assets = places.where("not (graph % 10 = 5 and n = 39)").select("graph", named("A", "asset"))
    nodes = places.where("not (graph % 10 = 6 and n = 38)").select("graph", named("N", "node"), named("T", "target"))
    interfaces = places.select("graph", named("T", "target"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index"))
    return topology.accepted_graphs(_sql(spark, sf_dir, _ENDS), assets, nodes, interfaces, "graph")


def accepted_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)[2].select("graph", "link", "source_asset", "target_asset", "source_interface")


def accepted_graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, interfaces, _, _ = _accepted(spark, sf_dir)
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("assets"), F.sum(F.size("nodes")).alias("nodes")).join(interfaces.groupBy("graph").agg(F.count(F.lit(1)).alias("interfaces")), "graph", "left")


def graph_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)[3]


# ---- devices


def _device_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, """
        SELECT s_suppkey AS device, 'definition' AS kind, CASE WHEN s_suppkey % 3 = 0 THEN 'DVC_a' ELSE 'Other' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'unlike' ELSE ' drive A ' END AS value FROM {supplier}
        UNION ALL SELECT s_suppkey, 'module', CONCAT('M', s_suppkey), NULL FROM {supplier} WHERE s_suppkey % 7 <> 0
        UNION ALL SELECT s_suppkey, 'module', CONCAT('L', s_suppkey), NULL FROM {supplier} WHERE s_suppkey % 6 = 0
        UNION ALL SELECT l_suppkey, 'parameter', CONCAT('P', l_partkey), CAST(l_quantity AS STRING) FROM {lineitem}""")  # fmt: skip


_PROVIDERS = [assembly.definition_provider("drive_a", "Dvc_A", "Drive A", "A 100", "Maker"), assembly.AnyModule]


def assembled_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assembled(_device_rows(spark, sf_dir), _PROVIDERS)


QUERIES = (
    lossless_documents, unknown_content, archive_entries, archive_elements, corpus_manifest, revision_store, gateway_slots, gateway_left_bytes, gateway_endpoints, gateway_findings, point_mapping,
    accepted_graph_links, accepted_graph_sizes, graph_refusals, assembled_devices,
)

_SLOT_ROWS = f"""
    raw AS (SELECT s_suppkey, slot, 'M' || (s_suppkey + slot) % 5 AS module, ['11', '21', 'C04180', '5031', '10'][(s_suppkey + slot) % 5 + 1] AS c, [[2, 0], [0, 2], [1, 4], [4, 2], [1, 0]][(s_suppkey + slot) % 5 + 1] AS io FROM supplier, range(4) AS t(slot)),
    cut AS (SELECT *, {_ODD} AND slot = 0 AS odd, NOT ({_ODD}) AND {_SHORT} AND slot = 3 AS short, s_suppkey % 3 = 2 AND module = 'M4' AS lost FROM raw),
    own AS (SELECT *, CASE WHEN odd THEN '12' WHEN short THEN '' ELSE c END AS taken, CASE WHEN short THEN 0 ELSE io[1] END AS inputs0, CASE WHEN short THEN 0 ELSE io[2] END AS outputs FROM cut),
    sums AS (SELECT *, CASE WHEN odd THEN 3 ELSE inputs0 END AS inputs FROM own)"""
_BEFORE = "CAST(COALESCE(SUM({}) OVER (PARTITION BY s_suppkey ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER)"

_GATEWAY_ROWS = """
    g AS (SELECT s_suppkey, s_suppkey % 3 <> 0 AS has_eds, s_suppkey % 5 <> 0 AS has_gsd, ['StandaloneMaster', 'Slave', 'Quiet', 'Odd', NULL][s_suppkey % 5 + 1] AS mode, ['EtherNetIP', 'ModbusTCPSlave', 'Serial', NULL][s_suppkey % 4 + 1] AS first, '10.0.0.' || s_suppkey % 256 AS address, s_nationkey FROM supplier)"""

_GRAPH_ROWS = """
    e AS (
      SELECT o_orderkey // 60 AS graph, 'L' || o_orderkey AS link, CASE WHEN o_orderkey // 60 % 10 = 3 AND o_orderkey % 60 = 8 THEN 7 ELSE o_orderkey % 40 END AS sa, o_orderkey % 40 AS sn,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey // 60 % 10 = 7 AND o_orderkey % 60 = 2 THEN 9 ELSE o_orderkey % 4 END AS i, o_custkey % 40 AS t FROM orders),
    p AS (SELECT DISTINCT o_orderkey // 60 AS graph, o_orderkey % 60 AS n FROM orders WHERE o_orderkey % 60 < 40),
    ends AS (SELECT DISTINCT graph, UNNEST([sa, t]) AS a, UNNEST([sn, t]) AS n FROM e),
    held AS (SELECT ends.graph, a, ends.n, i FROM ends JOIN p ON p.graph = ends.graph AND p.n = ends.n AND NOT (p.graph % 10 = 6 AND p.n = 38), range(4) AS x(i)),
    refused AS (
      SELECT DISTINCT graph, 'unknown_asset' AS reason, 'A' || a AS what FROM ends WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.graph = ends.graph AND p.n = a AND NOT (graph % 10 = 5 AND n = 39))
      UNION SELECT graph, 'unknown_node', 'N' || n FROM ends WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.graph = ends.graph AND p.n = ends.n AND NOT (graph % 10 = 6 AND n = 38))
      UNION SELECT graph, 'claimed_twice', 'N' || n || ':' || i FROM held GROUP BY graph, n, i HAVING COUNT(DISTINCT a) > 1
      UNION SELECT graph, 'unobserved_interface', link FROM e WHERE i IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.graph = e.graph AND h.n = e.sn AND h.i = e.i))"""

SQL = {
    "lossless_documents": """
    SELECT p_partkey // 50 AS block, 1 + 2 * COUNT(*) AS elements, 2 + 2 * COUNT(*) AS attributes, COUNT(*) AS comments, CAST(SUM(12 + 2 * length(CAST(p_partkey AS VARCHAR))) + COUNT(*) + 1 AS BIGINT) AS text_chars, TRUE AS same FROM part GROUP BY 1""",
    "unknown_content": """
    SELECT 'r' AS element, 'xmlns:x' AS attribute, COUNT(DISTINCT p_partkey // 50) AS n FROM part UNION ALL SELECT 'x:p', 'odd', COUNT(*) FROM part UNION ALL SELECT 'b', NULL, COUNT(*) FROM part""",
    "archive_entries": "SELECT p_partkey // 200 AS block, COUNT(*) AS entries, COUNT(*) AS starts, COUNT(*) AS names FROM part GROUP BY 1",
    "archive_elements": """
    WITH p AS (SELECT 'V' || p_partkey || ' & more' AS name, p_size AS width, p_partkey AS k, p_partkey % 2 = 0 AS lamp FROM part WHERE p_partkey % 5 <> 0)
    SELECT name, width, 0 AS element_ordinal, CAST(k AS INTEGER) AS element_id, 'Lamp' AS element_type, 'App.On' || k AS shown, 'App.On' || k AS bindings FROM p WHERE lamp
    UNION ALL SELECT name, width, CASE WHEN lamp THEN 1 ELSE 0 END, NULL, 'Frame', NULL, '' FROM p""",
    "corpus_manifest": """
    WITH b AS (SELECT p_partkey // 100 AS block, COUNT(*) AS rows, CAST(SUM(p_size + CASE WHEN p_partkey // 100 % 4 IN (1, 3) THEN 1000 ELSE 0 END) AS BIGINT) AS total FROM part GROUP BY 1)
    SELECT *, COUNT(*) FILTER (block % 4 = 3) OVER () AS new_files, COUNT(*) FILTER (block % 4 = 1) OVER () AS changed_files, COUNT(*) FILTER (block % 4 IN (1, 3)) OVER () AS opened, CAST(0 AS BIGINT) AS opened_again FROM b""",
    "revision_store": "SELECT o_custkey, CAST(COUNT(*) AS INTEGER) AS orders, 2 AS revision, 2 AS refused FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1",
    "gateway_slots": f"""
    WITH {_SLOT_ROWS}
    SELECT s_suppkey, CAST(slot AS INTEGER) AS slot, module, {_BEFORE.format('length(taken) // 2')} AS at, taken, {_BEFORE.format('inputs')} AS input_at, CAST(inputs AS INTEGER) AS inputs, {_BEFORE.format('outputs')} AS output_at, CAST(outputs AS INTEGER) AS outputs,
      CASE WHEN short THEN 'beyond_end' WHEN lost THEN 'unknown_module' WHEN odd THEN 'mismatch' END AS fault FROM sums""",
    "gateway_left_bytes": f"""
    WITH {_SLOT_ROWS} SELECT s_suppkey, CAST(SUM(length(taken)) // 2 AS INTEGER) AS at, 'AB' AS "left" FROM sums WHERE {_MORE} AND NOT ({_ODD}) AND NOT ({_SHORT}) GROUP BY 1""",
    "gateway_endpoints": f"""
    WITH {_GATEWAY_ROWS}
    SELECT s_suppkey, 'EtherNet/IP' AS interface, 'EtherNet/IP' AS protocol, 'adapter' AS role, COALESCE(first = 'EtherNetIP', FALSE) AS is_primary, CASE WHEN first = 'EtherNetIP' THEN address END AS address FROM g WHERE has_eds OR first = 'EtherNetIP'
    UNION ALL SELECT s_suppkey, 'PROFIBUS DP', 'PROFIBUS DP', CASE mode WHEN 'StandaloneMaster' THEN 'master' ELSE 'slave' END, FALSE, NULL FROM g WHERE has_gsd
    UNION ALL SELECT s_suppkey, 'Modbus TCP', 'Modbus TCP', 'server', TRUE, address FROM g WHERE first = 'ModbusTCPSlave'""",
    "gateway_findings": f"""
    WITH {_GATEWAY_ROWS}
    SELECT s_suppkey, 'model_mismatch' AS code, 'GW' || s_nationkey || '/Other' AS value FROM g WHERE s_suppkey % 4 <> 0
    UNION ALL SELECT s_suppkey, 'mode_unresolved', mode FROM g WHERE mode = 'Odd' AND has_gsd
    UNION ALL SELECT s_suppkey, 'primary_unresolved', first FROM g WHERE (mode IS NOT NULL OR first IS NOT NULL) AND (first IS NULL OR first = 'Serial')""",
    "point_mapping": """
    WITH p AS (SELECT o_orderkey AS point, 'R' || o_orderkey % 4 AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 5 WHEN o_orderkey % 19 = 1 THEN NULL ELSE o_custkey % 97 END AS station, CASE WHEN o_orderkey % 2 = 0 THEN 'Input' ELSE 'Output' END AS d, o_custkey % 4 AS n, o_custkey % 200 AS o FROM orders),
    s AS (SELECT DISTINCT s_suppkey % 97 AS station FROM supplier),
    j AS (SELECT p.*, s.station IS NOT NULL AS there, p.station % 7 <> 3 AS tagged, NOT (p.station % 3 = 2 AND n = 3) AS has, o < 180 AS moved, p.station % 13 = 4 AS twice FROM p LEFT JOIN s ON p.station = s.station)
    SELECT point, CASE WHEN there AND tagged AND has AND moved THEN CASE WHEN twice THEN 'ambiguous' ELSE 'corroborated' END ELSE 'unresolved' END AS status,
      CASE WHEN there AND tagged AND has AND moved AND NOT twice THEN 'D' || station || '.' || d || '.P' || n END AS tag_path,
      CASE WHEN there AND tagged AND has AND moved AND NOT twice THEN CASE WHEN o < 120 THEN 1000 + o ELSE 2000 + o - 120 END END AS assembly_at,
      CASE WHEN NOT there THEN 'station' WHEN NOT tagged THEN 'tag' WHEN NOT has THEN 'member' WHEN NOT moved THEN 'transfer' END AS lost_at FROM j""",
    "accepted_graph_links": f"""
    WITH {_GRAPH_ROWS}
    SELECT graph, link, 'A' || sa AS source_asset, 'A' || t AS target_asset, CASE WHEN i IS NOT NULL THEN 'A' || sa || '|T' || sn || '|' || i END AS source_interface FROM e WHERE graph NOT IN (SELECT graph FROM refused)""",
    "accepted_graph_sizes": f"""
    WITH {_GRAPH_ROWS}, n AS (SELECT graph, COUNT(DISTINCT a) AS assets, COUNT(*) AS nodes FROM ends GROUP BY 1), h AS (SELECT graph, COUNT(*) AS interfaces FROM (SELECT DISTINCT graph, a, n, i FROM held) GROUP BY 1)
    SELECT n.graph, assets, nodes, interfaces FROM n LEFT JOIN h ON n.graph = h.graph WHERE n.graph NOT IN (SELECT graph FROM refused)""",
    "graph_refusals": f"WITH {_GRAPH_ROWS} SELECT graph, reason, what FROM refused",
    "assembled_devices": """
    WITH l AS (SELECT l_suppkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AS drive, s_suppkey % 7 <> 0 AS m, s_suppkey % 6 = 0 AS other FROM supplier)
    SELECT s.k AS device, CASE WHEN drive AND m <> other THEN 'drive_a' ELSE 'any_module' END AS provider, CASE WHEN drive AND m <> other THEN 'A 100' END AS model, CASE WHEN drive AND m <> other THEN 'Maker' END AS maker,
      CASE WHEN other THEN 'L' ELSE 'M' END || s.k AS module, COALESCE(n, 0) AS parameters FROM s LEFT JOIN l ON l.k = s.k WHERE m OR other""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
