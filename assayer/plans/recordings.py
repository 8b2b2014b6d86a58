"""Queries over recordings, descriptions and binary replies made from the driver's tables.

The files are written to the shared folder, read by the sources and compared with what
the tables say. Each file holds a bounded block of rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import name_uuid
from ..functions.text import duration_literal, folded, is_ipv4, mac_from_octets, member_of, root_of
from ..operators import tree
from ..sources import captures, descriptions, snmp
from ..sources.files import write_files
from ..storage import shared_dir

#: Customers and suppliers in a recording.
CUSTOMERS, SUPPLIERS = 500, 50
_C, _S = f"CAST(floor(c_custkey / {CUSTOMERS}) AS BIGINT)", f"CAST(floor(s_suppkey / {SUPPLIERS}) AS BIGINT)"
_I, _P = "CAST(c_custkey + 1 AS STRING)", "CAST(s_suppkey % 8 + 1 AS STRING)"
#: The last two octets of a supplier's address, in decimal and in hex.
_HI, _LO = "CAST(floor(s_suppkey / 256) % 256 AS BIGINT)", "CAST(s_suppkey % 256 AS BIGINT)"
_OCTETS = f"'2.0.0.7.' || CAST({_HI} AS STRING) || '.' || CAST({_LO} AS STRING)"


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("nation", "customer", "supplier", "part", "events")
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if f"{{{n}}}" in sql})


def _files(lines: DataFrame, suffix: str, folder: str) -> None:
    """lines: k (the file), rank, n (the order in it) and line."""
    whole = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "line"))).alias("all"))
    content = F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n"))
    write_files(whole.select(F.concat(F.lit("R"), F.col("k").cast("string"), F.lit(suffix)).alias("name"), content.alias("content")), folder)


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Folders that the files of a table have been written to, by session, table and tag.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the names, sizes and times of the tables' files: another one once a table is written again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def written_once(spark: SparkSession, sf_dir: str, tag: str, write: Callable[[str], None]) -> str:
    """The folder of files that ``write(folder)`` makes, which is called once a session and state of the tables."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir), tag)
    if key not in _WRITTEN:
        folder = _folder(spark, tag)
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


RECORDED = [
    ("SELECT DISTINCT {k} AS k, 0 AS rank, 0L AS n, '1.3.6.1.2.1.1.5.0|4|before' AS line FROM {{customer}}", _C),
    ("SELECT DISTINCT {k}, 1, 0L, '1.3.6.1.2.1.1.5.0|4|R' || CAST({k} AS STRING) FROM {{customer}}", _C),
    (f"SELECT {{k}}, 2, c_custkey, '1.3.6.1.2.1.2.2.1.1.' || {_I} || '|2|' || {_I} FROM {{{{customer}}}}", _C),
    (f"SELECT {{k}}, 3, c_custkey, '1.3.6.1.2.1.2.2.1.2.' || {_I} || '|4|' || c_name || '|' || c_mktsegment FROM {{{{customer}}}}", _C),
    (f"SELECT {{k}}, 4, c_custkey, '1.3.6.1.2.1.2.2.1.5.' || {_I} || '|66|' || CAST(c_custkey % 7 * 1000000 AS STRING) FROM {{{{customer}}}}", _C),
    (f"SELECT {{k}}, 5, c_custkey, '1.3.6.1.2.1.31.1.1.1.1.' || {_I} || '|4|Gi' || {_I} FROM {{{{customer}}}} WHERE c_custkey % 3 <> 0", _C),
    (f"SELECT {{k}}, 6, c_custkey, 'broken ' || {_I} FROM {{{{customer}}}} WHERE c_custkey % 11 = 0", _C),
    (f"SELECT {{k}}, 7, c_custkey, '1.3.6.1.2.1.1.3.' || {_I} || '|67|soon' FROM {{{{customer}}}} WHERE c_custkey % 13 = 0", _C),
    (f"SELECT {{k}}, 8, c_custkey, '1.3.6.1.4.1.' || CAST(c_nationkey + 5 AS STRING) || '.' || {_I} || '|70|18446744073709551615' FROM {{{{customer}}}}", _C),
    (f"SELECT {{k}}, 9, s_suppkey, '1.3.6.1.2.1.17.1.4.1.2.' || {_P} || '|2|' || CAST(s_suppkey % 8 + 101 AS STRING) FROM {{{{supplier}}}} WHERE s_suppkey % 8 <> 4", _S),
    (f"SELECT {{k}}, 10, s_suppkey, '1.3.6.1.2.1.17.4.3.1.1.' || {_OCTETS} || '|4|02000007' FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 11, s_suppkey, '1.3.6.1.2.1.17.4.3.1.2.' || {_OCTETS} || '|2|' || {_P} FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 12, s_suppkey, '1.3.6.1.2.1.17.4.3.1.3.' || {_OCTETS} || '|2|3' FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 13, s_suppkey, '1.0.8802.1.1.2.1.4.1.1.5.9.' || {_P} || '.' || CAST(s_suppkey + 1 AS STRING) || '|4|0a0b0c' FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 14, s_suppkey, '1.0.8802.1.1.2.1.4.1.1.7.9.' || {_P} || '.' || CAST(s_suppkey + 1 AS STRING) || '|4|e' || CAST(s_nationkey AS STRING) FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 15, s_suppkey, '1.0.8802.1.1.2.1.4.1.1.9.9.' || {_P} || '.' || CAST(s_suppkey + 1 AS STRING) || '|4|' || s_name FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 16, s_suppkey, '1.3.6.1.2.1.47.1.1.1.1.4.' || CAST(s_suppkey + 1 AS STRING) || '|2|' || CAST(floor((s_suppkey + 1) / 2) AS STRING) FROM {{{{supplier}}}}", _S),
    (f"SELECT {{k}}, 17, s_suppkey, '1.3.6.1.2.1.47.1.1.1.1.7.' || CAST(s_suppkey + 1 AS STRING) || '|4|' || s_name FROM {{{{supplier}}}}", _S),
]


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the recordings, as read back."""

    def write(folder: str) -> None:
        lines = None
        for sql, k in RECORDED:
            one = _tables(spark, sf_dir, sql.format(k=k))
            lines = one if lines is None else lines.union(one)
        _files(lines, ".snmprec", folder)

    folder = written_once(spark, sf_dir, "recordings", write)
    return snmp.read_snmprec(spark, folder).withColumn("recording", F.regexp_extract("recording", r"([^/]+)\.snmprec", 1))


def snmprec_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recorded(spark, sf_dir)
    return rows.groupBy("recording", F.coalesce("reason", F.lit("none")).alias("reason"), F.coalesce("type_code", F.lit("-")).alias("type_code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("number", F.lit(0))).cast("string").alias("total"), F.countDistinct("line_no").alias("lines"))


def snmp_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snmp.system(snmp.varbinds(_recorded(spark, sf_dir))).select("recording", "name")


def snmp_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snmp.interfaces(snmp.varbinds(_recorded(spark, sf_dir)))
    return found.select("recording", "interface", "name", "description", F.col("speed_bps").cast("long").alias("speed_bps"))


def snmp_forwarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snmp.forwarding(snmp.varbinds(_recorded(spark, sf_dir)))


def snmp_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snmp.neighbours(snmp.varbinds(_recorded(spark, sf_dir))).select("recording", "local_port", "chassis", "port_id", "system_name")


def snmp_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snmp.entities(snmp.varbinds(_recorded(spark, sf_dir))).select("recording", "entity", "contained_in", "name")


def snmp_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = snmp.entities(snmp.varbinds(_recorded(spark, sf_dir))).where("contained_in is not null")
    return tree.valid_edges(held.select("entity", "contained_in"), "entity", "contained_in").select(F.col("contained_in").alias("parent"), F.col("entity").alias("child"))


def snmp_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snmp.measure(_recorded(spark, sf_dir))
    return found.select("recording", "lines", "faults", "oids", F.col("families")["mib-2.interfaces"].alias("interfaces"), F.coalesce(F.col("families")["if-mib"], F.lit(0)).alias("names"))


def snmp_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snmp.to_snmprec(_recorded(spark, sf_dir)).groupBy(F.substring_index("value", "|", 1).alias("oid")).agg(F.count(F.lit(1)).alias("n"))


def snmpwalk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = [
        f"SELECT {_C} AS k, 0 AS rank, c_custkey AS n, 'IF-MIB::ifDescr.' || {_I} || ' = STRING: ' || c_name AS line FROM {{customer}}",
        f"SELECT {_C}, 1, c_custkey, 'iso.3.6.1.2.1.1.3.' || {_I} || ' = Timeticks: (' || CAST(c_custkey * 10 AS STRING) || ') 0:00:00.10' FROM {{customer}}",
        f"SELECT {_C}, 2, c_custkey, 'IF-MIB::ifOperStatus.' || {_I} || ' = INTEGER: up(' || CAST(c_nationkey AS STRING) || ')' FROM {{customer}}",
        f"SELECT {_C}, 3, c_custkey, 'VENDOR-MIB::odd.' || {_I} || ' = STRING: x' FROM {{customer}} WHERE c_custkey % 5 = 0",
        f"SELECT {_C}, 4, c_custkey, 'no value for ' || {_I} FROM {{customer}} WHERE c_custkey % 7 = 0",
        f"SELECT {_C}, 5, c_custkey, 'IF-MIB::ifPhysAddress.' || {_I} || ' = Hex-STRING: 0A 0B ' || hex(c_custkey % 200 + 16) FROM {{customer}}",
    ]
    lines = _tables(spark, sf_dir, " UNION ALL ".join(walked))
    folder = _folder(spark, "walks")
    _files(lines, ".txt", folder)
    rows = snmp.read_snmpwalk(spark, folder)
    return rows.select(F.regexp_extract("recording", r"([^/]+)\.txt", 1).alias("recording"), "oid", "type_code", "value", "reason")


_EDS = "'[Device]\nVendCode = ' || CAST(s_suppkey AS STRING) || '; $ of ' || s_name || '\nProdType = ' || CAST(s_nationkey % 5 AS STRING) || '; ProdCode = 7;\nMajRev = 2; MinRev = 3;\nProdName = \"' || s_name || '; one, two\";\n[Connection Manager]\nConnection1 = 1,2,,,,,,,\n,,,,\"c\",\"\",\"20 0' || CAST(s_suppkey % 5 AS STRING) || ' 24 01 2C 1' || CAST(s_nationkey % 5 AS STRING) || ' 2C 33\";'"


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _tables(spark, sf_dir, "SELECT CAST(s_suppkey AS BIGINT) AS k, 0 AS rank, 0L AS n, " + _EDS.replace("\n", "\\n").replace('"', '\\"') + " AS line FROM {supplier}")
    folder = _folder(spark, "descriptions")
    _files(lines, ".eds", folder)
    return descriptions.read_eds(spark, folder)


def eds_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptions.eds_identity(_described(spark, sf_dir)).drop("source")


def eds_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = descriptions.assembly_candidates(_described(spark, sf_dir))
    return found.select(F.regexp_extract("source", r"R(\d+)\.eds", 1).cast("long").alias("supplier"), "connection", F.concat_ws(",", F.col("connection_points").cast("array<string>")).alias("points"))


def gsd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"'#Profibus_DP\nVendor_Name = \"' || s_name || '\" ; maker\nModule = \"' || s_name || ' io\" 0x1' || CAST(s_nationkey % 5 AS STRING) || ',\\\n0x22\nExt_Length = ' || CAST(s_suppkey AS STRING) || '\nEndModule\nLast = 2'"
    lines = _tables(spark, sf_dir, f"SELECT CAST(s_suppkey AS BIGINT) AS k, 0 AS rank, 0L AS n, {text} AS line FROM {{supplier}}")
    folder = _folder(spark, "descriptions")
    _files(lines, ".gsd", folder)
    rows = descriptions.read_gsd(spark, folder)
    octet = F.conv(F.regexp_extract(F.get("values", F.lit(0)), "0x([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
    cyclic = descriptions.cyclic_identifier(octet)
    return rows.select(F.regexp_extract("source", r"R(\d+)\.gsd", 1).cast("long").alias("supplier"), "section", "name", F.array_join("values", "|").alias("values"), F.when(F.col("name") == "Module", cyclic["direction"]).alias("direction"), F.when(F.col("name") == "Module", cyclic["count"]).cast("long").alias("count"))


def psj_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit('<r n="'), F.col("s_suppkey").cast("string"), F.lit('"><c>'), F.col("s_name"), F.lit("</c></r>"))
    codes = F.transform(F.sequence(F.lit(1), F.length(xml)), lambda i: F.lpad(F.hex(F.ascii(F.substring(xml, i, F.lit(1))).bitwiseXOR(F.lit(descriptions.PSJ_BYTE)).cast("long")), 2, "0"))
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n"), F.base64(F.unhex(F.array_join(codes, ""))).alias("line"))
    folder = _folder(spark, "descriptions")
    _files(lines, ".psj", folder)
    rows = descriptions.read_psj(spark, folder)
    return rows.select(F.regexp_extract("source", r"R(\d+)\.psj", 1).cast("long").alias("supplier"), "path", F.col("attributes")["n"].alias("n"), "text")


def _gateway_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _tables(spark, sf_dir, f"""
        SELECT DISTINCT {_S} AS k, 0 AS rank, 0L AS n, 'mapping_id,source_interface,source_reference,target_interface,target_reference,evidence,unit' AS line FROM {{supplier}}
        UNION ALL SELECT {_S}, 1, s_suppkey, 'M' || CAST(s_suppkey AS STRING) || ',N' || CAST(s_nationkey AS STRING) || ',a,' || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'T' || CAST(s_suppkey % 4 AS STRING) END || ',b,row,bar' FROM {{supplier}}""")
    folder = _folder(spark, "mappings")
    _files(lines, ".csv", folder)
    return descriptions.read_gateway_csv(spark, folder)


def gateway_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _tables(spark, sf_dir, "SELECT 'N' || CAST(n_nationkey AS STRING) AS name FROM {nation} WHERE n_nationkey < 20 UNION ALL SELECT 'T1' UNION ALL SELECT 'T2'")
    applied, rest = descriptions.apply_gateway_mappings(_gateway_rows(spark, sf_dir), names)
    return applied.select("mapping_id", F.lit("applied").alias("state")).union(rest.select("mapping_id", F.lit("unresolved")))


def gateway_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gateway_rows(spark, sf_dir).where(F.size("missing") > 0).select("mapping_id", F.array_join("missing", ",").alias("missing"), F.col("extra")["unit"].alias("unit"))


def _le(n: str, width: int) -> str:
    """Little-endian hex of a number in Spark SQL."""
    return "concat(" + ", ".join(f"lpad(hex(CAST(floor(({n}) / {256**i}) % 256 AS BIGINT)), 2, '0')" for i in range(width)) + ")"


def identity_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = f"unhex(concat({_le('s_nationkey', 2)}, {_le('12', 2)}, {_le('s_suppkey', 2)}, '0203', {_le('96', 2)}, {_le('s_suppkey * 65537', 4)}, {_le('length(s_name)', 1)}, hex(s_name), CASE WHEN s_suppkey % 2 = 0 THEN '03' ELSE '' END))"
    cut = f"CASE WHEN s_suppkey % 10 = 9 THEN substring({payload}, 1, 17) ELSE {payload} END"
    rows = _tables(spark, sf_dir, f"SELECT s_suppkey, {cut} AS payload FROM {{supplier}}")
    fields = captures.identity(F.col("payload"))
    return rows.select("s_suppkey", *[fields[c].alias(c) for c in ("vendor_id", "product_code", "serial_number", "product_name", "state", "fault")])


def symbol_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "CASE WHEN s_suppkey % 3 = 0 THEN 'Program:' ELSE '' END || 'S' || CAST(s_suppkey AS STRING)"
    record = f"concat({_le('s_suppkey', 4)}, {_le(f'length({name})', 2)}, hex({name}), {_le('196', 2)}, {_le('1', 4)}, {_le('2', 4)}, {_le('3', 4)}, {_le('0', 4)}, {_le('0', 4)}, {_le('0', 4)})"
    rows = _tables(spark, sf_dir, f"SELECT {_S} AS page_id, s_suppkey AS n, {record} AS record FROM {{supplier}}")
    pages = rows.groupBy("page_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "record"))), lambda x: x["record"]), "")).alias("payload"))
    return captures.inventory_items(captures.symbol_pages(pages)).select(F.col("page_id").cast("long").alias("page_id"), "instance_id", "capability", "name")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(".Sub[3].X")).otherwise(F.lit("")))
    octets = F.concat_ws(".", F.lit("2"), (F.col("s_suppkey") % 256).cast("string"), F.lit("255"))
    address = F.concat(F.lit("10.0."), (F.col("s_suppkey") % 300).cast("string"), F.lit(".1"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", root_of(path).alias("root"), member_of(path).alias("member"), mac_from_octets(octets).alias("mac"), is_ipv4(address).alias("is_ipv4"), folded(F.concat(F.lit("  A \t b"), F.col("s_name"))).alias("folded"), duration_literal(F.col("s_suppkey") * 10).alias("duration"))


_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def stable_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier of every customer's name."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_name", name_uuid(F.lit(_NAMESPACE), F.col("c_name")).alias("uuid"))


QUERIES = (
    snmprec_scan, snmp_system, snmp_interfaces, snmp_forwarding, snmp_neighbours, snmp_entities, snmp_entity_edges, snmp_measure, snmp_conversion, snmpwalk_scan,
    eds_identity, eds_assemblies, gsd_scan, psj_scan, gateway_mappings, gateway_faults, identity_replies, symbol_inventory, text_functions, stable_uuids,
)

_R = "'R' || CAST({} AS VARCHAR)"
_RC, _RS = (_R.format(f"CAST(floor({c} / {n}) AS BIGINT)") for c, n in (("c_custkey", CUSTOMERS), ("s_suppkey", SUPPLIERS)))
_MAC = "'02:00:00:07:' || lpad(lower(hex((s_suppkey // 256) % 256)), 2, '0') || ':' || lpad(lower(hex(s_suppkey % 256)), 2, '0')"
_TAG = "CASE WHEN s_suppkey % 3 = 0 THEN 'programs' ELSE 'tags' END"

SQL = {
    "snmprec_scan": f"""
        WITH c AS (SELECT {_RC} AS recording, * FROM customer), s AS (SELECT {_RS} AS recording, * FROM supplier),
        l AS (SELECT DISTINCT recording, 'none' AS reason, '4' AS code, 0 AS v, 0 AS id FROM c UNION ALL SELECT DISTINCT recording, 'none', '4', 0, 1 FROM c
          UNION ALL SELECT recording, 'none', '2', c_custkey + 1, 2 FROM c UNION ALL SELECT recording, 'none', '4', 0, 3 FROM c UNION ALL SELECT recording, 'none', '66', c_custkey % 7 * 1000000, 4 FROM c
          UNION ALL SELECT recording, 'none', '4', 0, 5 FROM c WHERE c_custkey % 3 <> 0 UNION ALL SELECT recording, 'syntax', '-', 0, 6 FROM c WHERE c_custkey % 11 = 0
          UNION ALL SELECT recording, 'integer_value', '67', 0, 7 FROM c WHERE c_custkey % 13 = 0 UNION ALL SELECT recording, 'none', '70', CAST(18446744073709551615 AS HUGEINT), 8 FROM c
          UNION ALL SELECT recording, 'none', '2', s_suppkey % 8 + 101, 9 FROM s WHERE s_suppkey % 8 <> 4 UNION ALL SELECT recording, 'none', '4', 0, 10 FROM s UNION ALL SELECT recording, 'none', '2', s_suppkey % 8 + 1, 11 FROM s
          UNION ALL SELECT recording, 'none', '2', 3, 12 FROM s UNION ALL SELECT recording, 'none', '4', 0, 13 FROM s UNION ALL SELECT recording, 'none', '4', 0, 14 FROM s UNION ALL SELECT recording, 'none', '4', 0, 15 FROM s
          UNION ALL SELECT recording, 'none', '2', (s_suppkey + 1) // 2, 16 FROM s UNION ALL SELECT recording, 'none', '4', 0, 17 FROM s)
        SELECT recording, reason, code AS type_code, COUNT(*) AS n, CAST(CAST(SUM(v) AS HUGEINT) AS VARCHAR) AS total, COUNT(*) AS lines FROM l GROUP BY 1, 2, 3""",
    "snmp_system": f"SELECT DISTINCT {_RC} AS recording, {_RC} AS name FROM customer",
    "snmp_interfaces": f"SELECT {_RC} AS recording, c_custkey + 1 AS interface, CASE WHEN c_custkey % 3 <> 0 THEN 'Gi' || CAST(c_custkey + 1 AS VARCHAR) END AS name, c_name || '|' || c_mktsegment AS description, c_custkey % 7 * 1000000 AS speed_bps FROM customer",
    "snmp_forwarding": f"SELECT {_RS} AS recording, {_MAC} AS mac, s_suppkey % 8 + 1 AS bridge_port, CASE WHEN s_suppkey % 8 <> 4 THEN s_suppkey % 8 + 101 END AS interface, 3 AS status FROM supplier",
    "snmp_neighbours": f"SELECT {_RS} AS recording, s_suppkey % 8 + 1 AS local_port, '0a:0b:0c' AS chassis, 'e' || CAST(s_nationkey AS VARCHAR) AS port_id, s_name AS system_name FROM supplier",
    "snmp_entities": f"SELECT {_RS} AS recording, s_suppkey + 1 AS entity, (s_suppkey + 1) // 2 AS contained_in, s_name AS name FROM supplier",
    "snmp_entity_edges": "SELECT (s_suppkey + 1) // 2 AS parent, s_suppkey + 1 AS child FROM supplier WHERE s_suppkey > 0",
    "snmp_measure": f"""
        WITH c AS (SELECT {_RC} AS recording, COUNT(*) * 4 + 2 + COUNT(*) FILTER (c_custkey % 3 <> 0) + COUNT(*) FILTER (c_custkey % 11 = 0) + COUNT(*) FILTER (c_custkey % 13 = 0) AS lines,
            COUNT(*) FILTER (c_custkey % 11 = 0) + COUNT(*) FILTER (c_custkey % 13 = 0) AS faults, COUNT(*) * 4 + 1 + COUNT(*) FILTER (c_custkey % 3 <> 0) AS oids, COUNT(*) * 3 AS i, COUNT(*) FILTER (c_custkey % 3 <> 0) AS names FROM customer GROUP BY 1),
        s AS (SELECT {_RS} AS recording, COUNT(*) * 8 + COUNT(*) FILTER (s_suppkey % 8 <> 4) AS lines, COUNT(*) * 8 + COUNT(DISTINCT s_suppkey % 8) FILTER (s_suppkey % 8 <> 4) AS oids FROM supplier GROUP BY 1)
        SELECT recording, COALESCE(c.lines, 0) + COALESCE(s.lines, 0) AS lines, COALESCE(faults, 0) AS faults, COALESCE(c.oids, 0) + COALESCE(s.oids, 0) AS oids, i AS interfaces, COALESCE(names, 0) AS names FROM c FULL JOIN s USING (recording)""",
    "snmp_conversion": """
        SELECT '1.3.6.1.2.1.1.5.0' AS oid, COUNT(DISTINCT c_custkey // 500) AS n FROM customer
        UNION ALL SELECT UNNEST(['1.3.6.1.2.1.2.2.1.1.', '1.3.6.1.2.1.2.2.1.2.', '1.3.6.1.2.1.2.2.1.5.', '1.3.6.1.4.1.' || CAST(c_nationkey + 5 AS VARCHAR) || '.']) || CAST(c_custkey + 1 AS VARCHAR), 1 FROM customer
        UNION ALL SELECT '1.3.6.1.2.1.31.1.1.1.1.' || CAST(c_custkey + 1 AS VARCHAR), 1 FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT '1.3.6.1.2.1.17.1.4.1.2.' || CAST(s_suppkey % 8 + 1 AS VARCHAR), COUNT(DISTINCT s_suppkey // 50) FROM supplier WHERE s_suppkey % 8 <> 4 GROUP BY 1
        UNION ALL SELECT UNNEST(['1.3.6.1.2.1.17.4.3.1.1.', '1.3.6.1.2.1.17.4.3.1.2.', '1.3.6.1.2.1.17.4.3.1.3.']) || '2.0.0.7.' || CAST((s_suppkey // 256) % 256 AS VARCHAR) || '.' || CAST(s_suppkey % 256 AS VARCHAR), 1 FROM supplier
        UNION ALL SELECT UNNEST(['1.0.8802.1.1.2.1.4.1.1.5.9.', '1.0.8802.1.1.2.1.4.1.1.7.9.', '1.0.8802.1.1.2.1.4.1.1.9.9.']) || CAST(s_suppkey % 8 + 1 AS VARCHAR) || '.' || CAST(s_suppkey + 1 AS VARCHAR), 1 FROM supplier
        UNION ALL SELECT UNNEST(['1.3.6.1.2.1.47.1.1.1.1.4.', '1.3.6.1.2.1.47.1.1.1.1.7.']) || CAST(s_suppkey + 1 AS VARCHAR), 1 FROM supplier""",
    "snmpwalk_scan": f"""
        SELECT {_RC} AS recording, '1.3.6.1.2.1.2.2.1.2.' || CAST(c_custkey + 1 AS VARCHAR) AS oid, '4' AS type_code, c_name AS value, NULL AS reason FROM customer
        UNION ALL SELECT {_RC}, '1.3.6.1.2.1.1.3.' || CAST(c_custkey + 1 AS VARCHAR), '67', CAST(c_custkey * 10 AS VARCHAR), NULL FROM customer
        UNION ALL SELECT {_RC}, '1.3.6.1.2.1.2.2.1.8.' || CAST(c_custkey + 1 AS VARCHAR), '2', CAST(c_nationkey AS VARCHAR), NULL FROM customer
        UNION ALL SELECT {_RC}, NULL, '4', 'x', 'oid' FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT {_RC}, NULL, NULL, '', 'syntax' FROM customer WHERE c_custkey % 7 = 0
        UNION ALL SELECT {_RC}, '1.3.6.1.2.1.2.2.1.6.' || CAST(c_custkey + 1 AS VARCHAR), '4', '0a0b' || lower(hex(c_custkey % 200 + 16)), NULL FROM customer""",
    "eds_identity": "SELECT CAST(s_suppkey AS INTEGER) AS vendor_id, s_nationkey % 5 AS product_type, 7 AS product_code, 2 AS major, 3 AS minor, s_name || '; one, two' AS product_name FROM supplier",
    "eds_assemblies": "SELECT s_suppkey AS supplier, 'Connection1' AS connection, CAST(16 + s_nationkey % 5 AS VARCHAR) || ',51' AS points FROM supplier WHERE s_suppkey % 5 = 4",
    "gsd_scan": """
        SELECT s_suppkey AS supplier, NULL AS section, 'Vendor_Name' AS name, '"' || s_name || '"' AS "values", NULL AS direction, CAST(NULL AS BIGINT) AS count FROM supplier
        UNION ALL SELECT s_suppkey, s_name || ' io', 'Module', '0x1' || CAST(s_nationkey % 5 AS VARCHAR) || '|0x22', 'input', s_nationkey % 5 + 1 FROM supplier
        UNION ALL SELECT s_suppkey, s_name || ' io', 'Ext_Length', CAST(s_suppkey AS VARCHAR), NULL, NULL FROM supplier
        UNION ALL SELECT s_suppkey, NULL, 'Last', '2', NULL, NULL FROM supplier""",
    "psj_scan": "SELECT s_suppkey AS supplier, '/r' AS path, CAST(s_suppkey AS VARCHAR) AS n, NULL AS text FROM supplier UNION ALL SELECT s_suppkey, '/r/c', NULL, s_name FROM supplier",
    "gateway_mappings": "SELECT 'M' || CAST(s_suppkey AS VARCHAR) AS mapping_id, CASE WHEN s_nationkey < 20 AND s_suppkey % 4 IN (1, 2) THEN 'applied' ELSE 'unresolved' END AS state FROM supplier WHERE s_suppkey % 9 <> 0",
    "gateway_faults": "SELECT 'M' || CAST(s_suppkey AS VARCHAR) AS mapping_id, 'target_interface' AS missing, 'bar' AS unit FROM supplier WHERE s_suppkey % 9 = 0",
    "identity_replies": """
        WITH s AS (SELECT *, s_suppkey % 10 = 9 AS cut FROM supplier)
        SELECT s_suppkey, CASE WHEN NOT cut THEN s_nationkey END AS vendor_id, CASE WHEN NOT cut THEN s_suppkey % 65536 END AS product_code, CASE WHEN NOT cut THEN (s_suppkey * 65537) % 4294967296 END AS serial_number,
          CASE WHEN NOT cut THEN s_name END AS product_name, CASE WHEN NOT cut AND s_suppkey % 2 = 0 THEN 3 END AS state, CASE WHEN cut THEN 'name_exceeds_payload' END AS fault FROM s""",
    "symbol_inventory": f"SELECT CAST(floor(s_suppkey / {SUPPLIERS}) AS BIGINT) AS page_id, s_suppkey AS instance_id, {_TAG} AS capability, 'S' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier",
    "text_functions": """
        SELECT s_suppkey, s_name AS root, CASE WHEN s_suppkey % 2 = 0 THEN '.Sub[3].X' END AS member, '02:' || lpad(lower(hex(s_suppkey % 256)), 2, '0') || ':ff' AS mac, s_suppkey % 300 <= 255 AS is_ipv4,
          'a b' || lower(s_name) AS folded, 'T#' || CAST(s_suppkey * 10 AS VARCHAR) || 'ms' AS duration FROM supplier""",
    "stable_uuids": f"""
        WITH h AS (SELECT c_name, sha1(unhex('{_NAMESPACE.replace("-", "")}') || encode(c_name)) AS h FROM customer)
        SELECT c_name, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][CAST(('0x' || h[17]) AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
