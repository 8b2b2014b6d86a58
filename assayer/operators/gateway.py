"""Gateways between fieldbus and network: slots and their identifier bytes, endpoints, points and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_hot, stored

# What a gateway's settings mean. mode: role of the fieldbus side.
MODES = {"StandaloneMaster": "master", "Slave": "slave"}
QUIET = "Quiet"
#: Primary interface: its name, protocol and role.
PRIMARY = {"EtherNetIP": ("EtherNet/IP", "EtherNet/IP", "adapter"), "ModbusTCPSlave": ("Modbus TCP", "Modbus TCP", "server")}
FIELDBUS = "PROFIBUS DP"


def _hex_byte(text: Column, at: Column) -> Column:
    return F.conv(F.substr(text, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def identifier_length(octet: Column) -> Column:
    """Bytes that a cyclic identifier takes: itself and, in the special format, those that follow it.

    Bits 4 and 5 are 0 in the special format. Then bits 6 and 7 tell of which directions a length
    byte follows, and the low nibble how many bytes of the maker come after these (15: none).
    """
    low = octet.bitwiseAND(F.lit(15))
    lengths = F.shiftright(octet, 6).bitwiseAND(F.lit(1)) + F.shiftright(octet, 7).bitwiseAND(F.lit(1))
    return F.when(octet.bitwiseAND(F.lit(0x30)) != 0, 1).otherwise(1 + lengths + F.when(low == 15, 0).otherwise(low))


def _bytes_of(size: Column) -> Column:
    """Bytes that a length byte stands for: bit 6 the unit, the six low bits the count less one."""
    return (size.bitwiseAND(F.lit(63)) + 1) * F.when(size.bitwiseAND(F.lit(64)) != 0, 2).otherwise(1)


def identifiers(stream: Column) -> Column:
    """array<struct<at, taken, inputs, outputs, whole>> of a configuration's identifiers, in order.

    stream: hexadecimal digits. at is an identifier's first byte, taken how many it takes, inputs and outputs
    the bytes of process data that it stands for; whole is false for the last one if bytes are missing.
    A configuration is 244 bytes at most, so it is folded in its row.
    """
    kind = "array<struct<at:int,taken:int,inputs:int,outputs:int,whole:boolean>>"
    n = F.floor(F.length(stream) / 2).cast("int")
    octet = lambda i: _hex_byte(stream, i)

    def one(i: Column) -> Column:
        o = octet(i)
        special = o.bitwiseAND(F.lit(0x30)) == 0
        count = (o.bitwiseAND(F.lit(15)) + 1) * F.when(o.bitwiseAND(F.lit(64)) != 0, 2).otherwise(1)
        has_out, has_in = o.bitwiseAND(F.lit(128)) != 0, o.bitwiseAND(F.lit(64)) != 0
        out_size, in_size = octet(i + 1), octet(i + F.when(has_out, 2).otherwise(1))
        inputs = F.when(special, F.when(has_in, _bytes_of(in_size)).otherwise(0)).otherwise(F.when(o.bitwiseAND(F.lit(16)) != 0, count).otherwise(0))
        outputs = F.when(special, F.when(has_out, _bytes_of(out_size)).otherwise(0)).otherwise(F.when(o.bitwiseAND(F.lit(32)) != 0, count).otherwise(0))
        taken = identifier_length(o)
        return F.struct(i.cast("int").alias("at"), taken.cast("int").alias("taken"), F.coalesce(inputs, F.lit(0)).cast("int").alias("inputs"), F.coalesce(outputs, F.lit(0)).cast("int").alias("outputs"), (i + taken <= n).alias("whole"))

    def step(acc: Column, i: Column) -> Column:
        begins = i >= acc["next"]
        return F.struct(F.when(begins, i + identifier_length(octet(i))).otherwise(acc["next"]).cast("int").alias("next"), F.when(begins, F.concat(acc["found"], F.array(one(i)))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("found"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["found"])


def aligned_slots(devices: DataFrame, slots: DataFrame, modules: DataFrame, device: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """What each slot of a device takes of its configuration, and the bytes that no slot takes.

    devices: ``device``, ``kind`` and stream (hexadecimal); slots: ``device``, slot and module, in the order
    of slot; modules: ``kind``, module and configuration (hexadecimal: one or more identifiers). A
    cursor runs over the stream: a slot takes as many bytes as its module's configuration has,
    or one identifier if nobody describes the module. First table: ``device``, slot, module, at, taken
    (hexadecimal), input_at, inputs, output_at and outputs (bytes in the images) and fault:
    ``unknown_module``, ``mismatch`` (other bytes are there), ``beyond_end`` (they end before) or null.
    Second: ``device``, at and left (hexadecimal). Of modules of one name the least configuration counts.
    """
    described = modules.groupBy(kind, "module").agg(F.min(F.upper("configuration")).alias("configuration"))
    listed = slots.join(devices.select(device, kind), device).join(described, [kind, "module"], "left")
    listed = listed.groupBy(device).agg(F.array_sort(F.collect_list(F.struct("slot", "module", "configuration"))).alias("slots"))
    rows = devices.select(device, F.upper(F.coalesce("stream", F.lit(""))).alias("stream")).join(listed, device, "left")
    rows = rows.withColumn("ids", identifiers(F.col("stream"))).withColumn("slots", F.coalesce("slots", F.array().cast(listed.schema["slots"].dataType)))
    n = F.floor(F.length("stream") / 2).cast("int")
    slot_kind = "array<struct<slot:int,module:string,configuration:string,at:int,room:int,wanted:int>>"

    def step(acc: Column, s: Column) -> Column:
        next_id = F.get(F.filter("ids", lambda x: x["at"] >= acc["at"]), 0)
        wanted = F.when(s["configuration"].isNull(), F.coalesce(next_id["at"] + next_id["taken"] - acc["at"], F.lit(1))).otherwise(F.floor(F.length(s["configuration"]) / 2)).cast("int")
        room = F.greatest(F.lit(0), F.least(wanted, n - acc["at"])).cast("int")
        made = F.struct(s["slot"].cast("int").alias("slot"), s["module"].alias("module"), s["configuration"].alias("configuration"), acc["at"].alias("at"), room.alias("room"), wanted.alias("wanted"))
        return F.struct((acc["at"] + room).cast("int").alias("at"), F.concat(acc["made"], F.array(made)).alias("made"))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast(slot_kind).alias("made"))
    folded = stored(rows.select(device, "stream", F.aggregate("slots", begun, step).alias("f")), "slots")
    each = folded.select(device, "stream", F.explode("f.made").alias("s")).select(device, "stream", "s.*")
    each = each.withColumn("taken", F.substr("stream", F.col("at") * 2 + 1, F.col("room") * 2))
    fault = F.when(F.col("room") < F.col("wanted"), "beyond_end").when(F.col("configuration").isNull(), "unknown_module").when(F.col("taken") != F.col("configuration"), "mismatch")
    each = each.withColumn("own", identifiers(F.col("taken"))).withColumn("fault", fault)
    inputs = F.aggregate("own", F.lit(0), lambda total, x: total + x["inputs"])
    outputs = F.aggregate("own", F.lit(0), lambda total, x: total + x["outputs"])
    each = each.withColumns({"inputs": inputs, "outputs": outputs})
    before = Window.partitionBy(device).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"{c}_at": F.coalesce(F.sum(f"{c}s").over(before), F.lit(0)).cast("int") for c in ("input", "output")}
    each = each.withColumns(starts).select(device, "slot", "module", "at", "taken", "input_at", "inputs", "output_at", "outputs", "fault")
    left = folded.where(F.col("f.at") < F.floor(F.length("stream") / 2)).select(device, F.col("f.at").alias("at"), F.substr("stream", F.col("f.at") * 2 + 1, F.length("stream")).alias("left"))
    return each, left


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def endpoints(gateways: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Interfaces of every gateway that is described, and what doesn't fit.

    gateways: ``key``, eds_product and gsd_model (the two descriptions' names), has_eds and has_gsd, mode,
    primary and address (settings; null where a gateway isn't configured). First table: ``key``, interface,
    protocol, role, is_primary and address. Both descriptions give an interface, an adapter and
    a slave; settings change the fieldbus side's role and name the primary endpoint, which is added if no
    description has it. Second: ``key``, code and value, a row each: model_mismatch (names differ
    in more than case), mode_unresolved and primary_unresolved.
    """
    name, protocol, role = (_looked_up(F.col("primary"), {k: v[i] for k, v in PRIMARY.items()}) for i in range(3))
    mode = F.coalesce(_looked_up(F.col("mode"), MODES), F.lit("slave"))
    eds = "EtherNet/IP"
    made = lambda n, p, r, first, a: F.struct(n.alias("interface"), p.alias("protocol"), r.alias("role"), first.alias("is_primary"), a.alias("address"))
    none = F.lit(None).cast("string")
    is_eds = F.coalesce(name == eds, F.lit(False))
    listed = F.array(
        F.when(F.col("has_eds"), made(F.lit(eds), F.lit(eds), F.lit("adapter"), is_eds, F.when(is_eds, F.col("address")))),
        F.when(F.col("has_gsd"), made(F.lit(FIELDBUS), F.lit(FIELDBUS), mode, F.lit(False), none)),
        F.when(name.isNotNull() & ~(is_eds & F.col("has_eds")), made(name, protocol, role, F.lit(True), F.col("address"))),
    )
    interfaces = gateways.select(key, F.explode(F.array_compact(listed)).alias("i")).select(key, "i.*")
    fault = lambda when, code, value: F.when(when, F.struct(F.lit(code).alias("code"), value.alias("value")))
    faults = F.array(
        fault((F.col("eds_product") != "") & (F.col("gsd_model") != "") & (F.lower("eds_product") != F.lower("gsd_model")), "model_mismatch", F.concat("eds_product", F.lit("/"), "gsd_model")),
        fault(F.col("has_gsd") & F.col("mode").isNotNull() & (F.col("mode") != QUIET) & _looked_up(F.col("mode"), MODES).isNull(), "mode_unresolved", F.col("mode")),
        fault((F.col("mode").isNotNull() | F.col("primary").isNotNull()) & name.isNull(), "primary_unresolved", F.col("primary")),
    )
    return interfaces, gateways.select(key, F.explode(F.array_compact(faults)).alias("f")).select(key, "f.*")


#: Bytes of a bin by which ranges and offsets meet.
BIN = 64


def covering(points: DataFrame, ranges: DataFrame, keys: Sequence[str], offset: str, start: str, length: str, size: int = BIN) -> DataFrame:
    """Each point with every range of the same keys that it falls into: start <= offset < start + length.

    A range stands in every bin that it touches and a point in one, so they meet by equal keys and bin.
    """
    bins = F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(length) - 1) / size))
    wide = ranges.where(F.col(length) > 0).withColumn("__bin", F.explode(bins))
    own = points.withColumn("__bin", F.floor(F.col(offset) / size))
    return own.join(wide, [*keys, "__bin"]).where((F.col(offset) >= F.col(start)) & (F.col(offset) < F.col(start) + F.col(length))).drop("__bin")


HOPS = ("station", "tag", "member", "transfer")


def points_to_tags(points: DataFrame, stations: DataFrame, tags: DataFrame, members: DataFrame, transfers: DataFrame) -> DataFrame:
    """point, status, tag_path, assembly_at and lost_at of every fieldbus point: which controller tag holds it.

    A point (point, scope, station, direction Input or Output, name, offset) is held if exactly one chain leads to it:
    stations (scope, station, base: a tag that is assigned the station's number), tags (scope, base, data_type),
    members (scope, data_type, direction, name, member_offset: what the type has in that direction) and
    transfers (scope, holder, assembly_at, first, length: block copies to or from ``base.direction``), one whose bytes, from ``first`` on, the
    point's offset falls into. status is ``corroborated``, ``ambiguous`` (more than one chain) or
    ``unresolved``; lost_at is the first of HOPS that nothing leads past. assembly_at is where the point lies in the
    assembly. Repeated evidence counts once. Points without scope, station, name or direction are unresolved at ``station``.

    Each hop is a join on equal keys; points of a station that holds a large share of all are dealt to many tasks.
    """
    spark_rows = stored(points.select("point", "scope", "station", "direction", "name", "offset"), "points")
    own = spark_rows.where("scope is not null and station is not null and name is not null and direction in ('Input', 'Output')")
    n = own.count()
    key = F.struct("scope", "station")
    sizes = own.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    by_station = stations.select(key.alias("key"), "base").where("base is not null").groupBy("key").agg(F.collect_set("base").alias("bases")).join(sizes, "key")
    based = join_hot(own.withColumn("key", key), by_station, "key", F.col("copies"), n).select("point", "scope", "direction", "name", "offset", F.explode("bases").alias("base"))
    based = stored(based, "points-station")
    tagged = stored(based.join(tags.select("scope", "base", "data_type").distinct(), ["scope", "base"]), "points-tag")
    membered = tagged.join(members.select("scope", "data_type", "direction", "name").distinct(), ["scope", "data_type", "direction", "name"])
    membered = stored(membered.select("point", "scope", "name", "offset", F.concat("base", F.lit("."), "direction").alias("holder")), "points-member")
    blocks = transfers.select("scope", "holder", "assembly_at", "first", "length").distinct()
    moved = covering(membered, blocks, ["scope", "holder"], "offset", "first", "length")
    moved = moved.select("point", F.concat("holder", F.lit("."), "name").alias("tag_path"), (F.col("assembly_at") + F.col("offset") - F.col("first")).alias("assembly_at"))
    found = moved.groupBy("point").agg(F.count(F.lit(1)).alias("chains"), F.min(F.struct("tag_path", "assembly_at")).alias("only"))
    passed = None
    for hop, table in enumerate((based, tagged, membered), 1):
        one = table.select("point", F.lit(hop).alias("hop")).distinct()
        passed = one if passed is None else passed.union(one)
    reached = passed.groupBy("point").agg(F.max("hop").alias("hop"))
    out = spark_rows.select("point").join(reached, "point", "left").join(found, "point", "left")
    status = F.when(F.col("chains") == 1, "corroborated").when(F.col("chains") > 1, "ambiguous").otherwise("unresolved")
    lost = F.when(F.col("chains").isNull(), F.element_at(F.array(*[F.lit(h) for h in HOPS]), F.coalesce("hop", F.lit(0)) + 1))
    return out.select("point", status.alias("status"), F.when(F.col("chains") == 1, F.col("only.tag_path")).alias("tag_path"), F.when(F.col("chains") == 1, F.col("only.assembly_at")).alias("assembly_at"), lost.alias("lost_at"))
