"""SNMP recordings (snmprec and snmpwalk text) as varbind rows, and the tables in them.

Everything is column expressions and joins by key; a recording's lines are rows, so one
recording or a million of them run the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import netmask_prefix
from ..functions.text import mac_from_octets
from ..operators.aggregate import family_of
from ..operators.ordering import first_of

# Object identifiers of the standard tables, and type codes of recordings.
SYSTEM = {"1": "description", "2": "object_id", "3": "uptime_ticks", "4": "contact", "5": "name", "6": "location"}
SYSTEM_BASE = "1.3.6.1.2.1.1"
IF_ENTRY = "1.3.6.1.2.1.2.2.1"
IF_NAME = "1.3.6.1.2.1.31.1.1.1.1"
IP_ENTRY = "1.3.6.1.2.1.4.20.1"
PORT_INTERFACE = "1.3.6.1.2.1.17.1.4.1.2"
FORWARDING = "1.3.6.1.2.1.17.4.3.1"
LOCAL_PORT = "1.0.8802.1.1.2.1.3.7.1.3"
REMOTE = "1.0.8802.1.1.2.1.4.1.1"
ENTITY = "1.3.6.1.2.1.47.1.1.1.1"
INTEGER_CODES = ("2", "65", "66", "67", "70")
WALK_TYPES = {"INTEGER": "2", "INTEGER32": "2", "COUNTER": "65", "COUNTER32": "65", "GAUGE": "66", "GAUGE32": "66", "UNSIGNED32": "66", "TIMETICKS": "67", "COUNTER64": "70", "STRING": "4", "OCTET STRING": "4", "HEX-STRING": "4", "IPADDRESS": "64", "OID": "6", "OBJECT IDENTIFIER": "6"}
WALK_NAMES = {
    "sysDescr": "1.3.6.1.2.1.1.1", "sysObjectID": "1.3.6.1.2.1.1.2", "sysUpTime": "1.3.6.1.2.1.1.3", "sysContact": "1.3.6.1.2.1.1.4", "sysName": "1.3.6.1.2.1.1.5", "sysLocation": "1.3.6.1.2.1.1.6",
    "ifIndex": f"{IF_ENTRY}.1", "ifDescr": f"{IF_ENTRY}.2", "ifType": f"{IF_ENTRY}.3", "ifSpeed": f"{IF_ENTRY}.5", "ifPhysAddress": f"{IF_ENTRY}.6", "ifAdminStatus": f"{IF_ENTRY}.7", "ifOperStatus": f"{IF_ENTRY}.8", "ifName": IF_NAME,
    "ipAdEntAddr": f"{IP_ENTRY}.1", "ipAdEntIfIndex": f"{IP_ENTRY}.2", "ipAdEntNetMask": f"{IP_ENTRY}.3", "dot1dBasePortIfIndex": PORT_INTERFACE, "dot1dTpFdbAddress": f"{FORWARDING}.1", "dot1dTpFdbPort": f"{FORWARDING}.2", "dot1dTpFdbStatus": f"{FORWARDING}.3",
    "lldpLocPortId": LOCAL_PORT, "lldpRemChassisId": f"{REMOTE}.5", "lldpRemPortId": f"{REMOTE}.7", "lldpRemSysName": f"{REMOTE}.9",
}
ENTITY_COLUMNS = {"2": "description", "3": "vendor_type_oid", "4": "contained_in", "5": "physical_class", "6": "parent_relative_position", "7": "name", "8": "hardware_revision", "9": "firmware_revision", "10": "software_revision", "11": "serial_number", "12": "manufacturer_name", "13": "model_name", "14": "alias", "15": "asset_id", "17": "manufacturing_date", "19": "uuid"}
# Families of object identifiers: prefix, name, and whether the tables below read it.
FAMILIES: Sequence[tuple[str, str, bool]] = (
    ("1.0.8802.1.1.2", "ieee-lldp", True), ("1.3.6.1.2.1.1", "mib-2.system", True), ("1.3.6.1.2.1.2", "mib-2.interfaces", True), ("1.3.6.1.2.1.4", "mib-2.ip", True),
    ("1.3.6.1.2.1.5", "mib-2.icmp", False), ("1.3.6.1.2.1.6", "mib-2.tcp", False), ("1.3.6.1.2.1.7", "mib-2.udp", False), ("1.3.6.1.2.1.11", "mib-2.snmp", False),
    ("1.3.6.1.2.1.14", "ospf-mib", False), ("1.3.6.1.2.1.16", "rmon-mib", False), ("1.3.6.1.2.1.17", "mib-2.bridge", True), ("1.3.6.1.2.1.25", "host-resources", False),
    ("1.3.6.1.2.1.31", "if-mib", True), ("1.3.6.1.2.1.47", "entity-mib", True), ("1.3.6.1.2.1.55", "ipv6-mib-historic", False), ("1.3.6.1.2.1.191", "ospfv3-mib", False),
)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """recording, line_no and line. A line that isn't UTF-8 is read as Latin-1.

    Recordings are read by lines, large ones by many tasks; a line's number is its place in
    its block of the file plus the lines of the blocks before.
    """
    read = spark.read.option("recursiveFileLookup", True).text(path)
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    rows = read.select(F.col("_metadata.file_path").alias("recording"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), text.alias("line"))
    blocks = rows.groupBy("recording", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("recording").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("recording", "block").orderBy("at"))
    numbered = rows.withColumn("own", own).join(blocks.select("recording", "block", before.alias("before")), ["recording", "block"])
    return numbered.select("recording", (F.col("before") + F.col("own")).cast("int").alias("line_no"), "line").where("line <> ''")


def _whole_number(text: Column) -> Column:
    """Decimals of 20 digits hold 64-bit counters, which a long doesn't."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("decimal(20,0)"))


def read_snmprec(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """recording, line_no, oid, type_code, value, number, line and reason of every line.

    Lines are ``oid|type|value``; empty ones and those that start with # are skipped. A
    line that can't be read keeps its text and a reason, ``syntax`` or ``integer_value``;
    the others have null there. Plain and bz2 files are read.
    """
    parts = F.split("line", r"\|", 3)
    rows = _lines(spark, path).where(~F.col("line").startswith("#")).withColumn("p", parts)
    part = [F.try_element_at("p", F.lit(i)) for i in (1, 2, 3)]
    number = F.when(part[1].isin(*INTEGER_CODES), _whole_number(part[2]))
    reason = F.when(F.size("p") < 3, "syntax").when(part[1].isin(*INTEGER_CODES) & number.isNull(), "integer_value")
    return rows.select("recording", "line_no", part[0].alias("oid"), part[1].alias("type_code"), part[2].alias("value"), number.alias("number"), "line", reason.alias("reason"))


def read_snmpwalk(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same columns from the text that snmpwalk prints, ``name = TYPE: value``.

    Names may be numeric or of the standard tables. reason is ``syntax``, ``oid`` or
    ``type_or_value``.
    """
    rows = _lines(spark, path).withColumn("name", F.trim(F.regexp_extract("line", r"^(.+?)\s+=\s+(.*)$", 1))).withColumn("rest", F.regexp_extract("line", r"^(.+?)\s+=\s+(.*)$", 2))
    kind = F.upper(F.trim(F.regexp_extract("rest", r"^([A-Za-z0-9 -]+):\s?(.*)$", 1)))
    raw = F.regexp_extract("rest", r"^([A-Za-z0-9 -]+):\s?(.*)$", 2)
    plain = F.regexp_replace(F.regexp_replace("name", r"^\.+", ""), r"^iso\.", "1.")
    symbol = F.regexp_extract(plain, r"^(?:.*::)?([A-Za-z][A-Za-z0-9-]*)((?:\.\d+)*)$", 1)
    suffix = F.regexp_extract(plain, r"^(?:.*::)?([A-Za-z][A-Za-z0-9-]*)((?:\.\d+)*)$", 2)
    bases = F.create_map(*[F.lit(x) for kv in WALK_NAMES.items() for x in kv])
    oid = F.when(plain.rlike(r"^\d+(\.\d+)*$"), plain).when((symbol == "sysUpTimeInstance") & (suffix == ""), "1.3.6.1.2.1.1.3.0").when(suffix != "", F.concat(F.try_element_at(bases, symbol), suffix))
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in WALK_TYPES.items() for x in kv]), kind)
    digits = F.coalesce(F.nullif(F.regexp_extract(raw, r"^\((\d+)\)", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"\((-?\d+)\)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"^\s*(-?\d+)", 1), F.lit("")))
    number = F.when(code.isin(*INTEGER_CODES), digits.try_cast("decimal(20,0)"))
    value = F.when(code.isin(*INTEGER_CODES), number.cast("string")).when(kind == "HEX-STRING", F.lower(F.regexp_replace(raw, r"\s+", ""))).otherwise(F.trim(raw))
    reason = F.when(F.col("name") == "", "syntax").when(oid.isNull(), "oid").when(code.isNull() | value.isNull(), "type_or_value")
    return rows.select("recording", "line_no", oid.alias("oid"), code.alias("type_code"), value.alias("value"), number.alias("number"), "line", reason.alias("reason"))


def varbinds(rows: DataFrame) -> DataFrame:
    """The last good line of every object identifier of a recording."""
    return first_of(rows.where("reason is null"), ["recording", "oid"], [F.col("line_no").desc()])


def require_intact(rows: DataFrame) -> DataFrame:
    """``rows``, or an error when run if a line couldn't be read."""
    return rows.where(F.coalesce(F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("invalid record at line "), F.col("line_no").cast("string")))), F.lit(True)))


def family(oid: Column) -> Column:
    """Family of an object identifier: a named one, enterprise.N, mib-2.N or other."""
    plain = F.regexp_replace(F.trim(oid), r"^\.+", "")
    enterprise = F.regexp_extract(plain, r"^1\.3\.6\.1\.4\.1\.(\d+)(?:\.|$)", 1)
    branch = F.regexp_extract(plain, r"^1\.3\.6\.1\.2\.1\.([^.]*)", 1)
    rest = F.when(enterprise != "", F.concat(F.lit("enterprise."), enterprise)).when(plain.startswith("1.3.6.1.2.1."), F.concat(F.lit("mib-2."), branch)).otherwise("other")
    return family_of(plain, [(prefix, name) for prefix, name, _ in FAMILIES], rest)


def _column(rows: DataFrame, entry: str) -> DataFrame:
    """Cells of a table: recording, column, index, value, number."""
    rest = F.substring("oid", len(entry) + 2, 10_000)
    cells = rows.where(F.col("oid").startswith(f"{entry}.")).withColumn("rest", rest)
    return cells.select("recording", F.substring_index("rest", ".", 1).alias("column"), F.regexp_extract("rest", r"^\d+\.(.*)$", 1).alias("index"), "value", "number")


def _pick(column: str, what: str = "value") -> Column:
    return F.max(F.when(F.col("column") == column, F.col(what)))


def _mac(text: Column) -> Column:
    paired = F.regexp_replace(text, "(..)(?!$)", "$1:")
    return F.when(F.length(text) % 2 == 0, paired).otherwise(text)


def system(rows: DataFrame) -> DataFrame:
    """One row a recording with its system fields."""
    cells = _column(rows, SYSTEM_BASE).where("index = '0'")
    return cells.groupBy("recording").agg(*[_pick(n).alias(c) for n, c in SYSTEM.items()])


def addresses(rows: DataFrame) -> DataFrame:
    """recording, interface, address and prefix of every network address."""
    cells = _column(rows, IP_ENTRY).groupBy("recording", "index").agg(_pick("1").alias("own"), _pick("2", "number").alias("interface"), netmask_prefix(_pick("3")).alias("prefix"))
    return cells.where("own is not null and interface is not null").select("recording", F.col("interface").cast("long").alias("interface"), F.col("index").alias("address"), "prefix")


def interfaces(rows: DataFrame) -> DataFrame:
    """A row for every interface with a whole-number index; addresses as an array."""
    cells = _column(rows, IF_ENTRY).groupBy("recording", "index").agg(_pick("1", "number").alias("i"), _pick("2").alias("description"), _pick("3", "number").cast("long").alias("interface_type"), _pick("5", "number").alias("speed_bps"), _mac(_pick("6")).alias("mac_address"), _pick("7", "number").cast("int").alias("admin_status"), _pick("8", "number").cast("int").alias("operational_status"))
    named = rows.where(F.col("oid").startswith(f"{IF_NAME}.")).select("recording", F.substring("oid", len(IF_NAME) + 2, 100).alias("index"), F.col("value").alias("name"))
    held = addresses(rows).groupBy("recording", F.col("interface").cast("string").alias("index")).agg(F.array_sort(F.collect_list(F.struct("address", "prefix"))).alias("addresses"))
    return cells.where("i is not null").join(named, ["recording", "index"], "left").join(held, ["recording", "index"], "left").select("recording", F.col("i").cast("long").alias("interface"), "name", "description", "interface_type", "speed_bps", "mac_address", "admin_status", "operational_status", "addresses")


def forwarding(rows: DataFrame) -> DataFrame:
    """recording, mac, bridge_port, interface and status of every forwarding entry."""
    ports = rows.where(F.col("oid").startswith(f"{PORT_INTERFACE}.")).select("recording", F.substring("oid", len(PORT_INTERFACE) + 2, 20).cast("long").alias("bridge_port"), F.col("number").cast("long").alias("interface")).where("interface is not null")
    cells = _column(rows, FORWARDING).groupBy("recording", "index").agg(_pick("1").alias("own"), _pick("2", "number").cast("long").alias("bridge_port"), _pick("3", "number").cast("int").alias("status"))
    known = cells.where("own is not null and bridge_port is not null").select("recording", mac_from_octets(F.col("index")).alias("mac"), "bridge_port", "status")
    return known.join(ports, ["recording", "bridge_port"], "left").select("recording", "mac", "bridge_port", "interface", "status")


def neighbours(rows: DataFrame) -> DataFrame:
    """recording, local_port, interface, chassis, port_id and system_name of every LLDP neighbour.

    The local port is the last number but one of the index; its interface is the one
    whose name is the port's id.
    """
    cells = _column(rows, REMOTE).groupBy("recording", "index").agg(_pick("5").alias("chassis"), _pick("7").alias("port_id"), _pick("9").alias("system_name"))
    cells = cells.where(F.col("chassis").isNotNull() & (F.size(F.split("index", r"\.")) >= 3)).withColumn("local_port", F.element_at(F.split("index", r"\."), -2).cast("long"))
    local = rows.where(F.col("oid").startswith(f"{LOCAL_PORT}.")).select("recording", F.substring("oid", len(LOCAL_PORT) + 2, 20).cast("long").alias("local_port"), F.col("value").alias("local_id"))
    by_name = first_of(interfaces(rows).where("name is not null").select("recording", F.col("name").alias("local_id"), "interface"), ["recording", "local_id"], [F.col("interface").desc()])
    joined = cells.join(local, ["recording", "local_port"], "left").join(by_name, ["recording", "local_id"], "left")
    return joined.select("recording", "local_port", "interface", _mac(F.col("chassis")).alias("chassis"), F.coalesce("port_id", F.lit("")).alias("port_id"), "system_name")


def entities(rows: DataFrame) -> DataFrame:
    """A row for every physical entity; contained_in is null where it isn't a number."""
    cells = _column(rows, ENTITY).where(F.col("index").rlike(r"^\d+$"))
    whole = {"contained_in", "physical_class", "parent_relative_position"}
    columns = [(_pick(n, "number").cast("long") if c in whole else _pick(n)).alias(c) for n, c in ENTITY_COLUMNS.items()]
    fru = F.when(_pick("16", "number") == 1, True).when(_pick("16", "number") == 2, False)
    return cells.groupBy("recording", F.col("index").cast("long").alias("entity")).agg(*columns, fru.alias("is_fru"), F.split(F.trim(_pick("18")), r"\s+").alias("uris"))


def measure(rows: DataFrame) -> DataFrame:
    """Lines, faults, object identifiers and families of every recording."""
    good = varbinds(rows)
    lines = rows.groupBy("recording").agg(F.count(F.lit(1)).alias("lines"), F.count("reason").alias("faults"))
    by_family = good.groupBy("recording", family(F.col("oid")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    maps = by_family.groupBy("recording").agg(F.sum("n").alias("oids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("families"))
    return lines.join(maps, "recording", "left")


def to_snmprec(rows: DataFrame) -> DataFrame:
    """Lines of a recording in the order of the object identifiers, ready for ``write.text``."""
    key = F.transform(F.split("oid", r"\."), lambda n: n.cast("decimal(20,0)"))
    return varbinds(rows).orderBy("recording", key).select(F.concat_ws("|", "oid", "type_code", "value").alias("value"))
