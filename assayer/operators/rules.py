"""What calls, runtimes and module services mean, by tables of rules that are small and given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls of structured text by name: kind, maker (null: portable), least and most arguments.
CALL_RULES = (
    ("SIZE", "array_dimension_query", "Rockwell Automation", 3, 3),
    ("GSV", "controller_object_read", "Rockwell Automation", 4, 4),
    ("SSV", "controller_object_write", "Rockwell Automation", 4, 4),
    ("ABS", "absolute_value", None, 1, 1),
    ("COP", "memory_copy", "Rockwell Automation", 3, 3),
    ("MSG", "explicit_message", "Rockwell Automation", 1, 1),
    ("SWPB", "byte_swap", "Rockwell Automation", 3, 3),
    ("TONR", "retentive_timer", "Rockwell Automation", 1, 1),
)
# What a target offers for a module service: support and equivalence, by profile and intent.
MODULE_SERVICES = {
    "generic": {
        "instance_identity": ("bus_specific", "unavailable"),
        "connection_status": ("normalized", "approximated"),
        "fault_code": ("bus_specific", "unavailable"),
        "fault_information": ("bus_specific", "unavailable"),
        "operating_mode": ("unavailable", "unavailable"),
        "set_inhibited": ("bus_specific", "unavailable"),
        "source_specific": ("unavailable", "unavailable"),
    },
    "ethernet_ip_remote_adapter": {
        "instance_identity": ("normalized", "approximated"),
        "connection_status": ("normalized", "approximated"),
        "fault_code": ("normalized", "approximated"),
        "fault_information": ("normalized", "approximated"),
        "operating_mode": ("normalized", "approximated"),
        "set_inhibited": ("normalized", "hardware_validation_required"),
        "source_specific": ("unavailable", "unavailable"),
    },
}
#: Rules that a table of them may have: they stand in the plan of every task.
MOST_RULES = 10_000


def _literal(rules: Sequence[Sequence], names: Sequence[str]) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)]) for rule in rules])


def rule_table(df: DataFrame, rules: Sequence[Sequence], ddl: str) -> DataFrame:
    """The rules as a table of the session of ``df``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
    return df.sparkSession.createDataFrame(list(rules), ddl)


def classified_calls(calls: DataFrame, definitions: DataFrame, keys: Sequence[str], rules: Sequence[Sequence] = CALL_RULES) -> DataFrame:
    """``calls`` plus kind, maker and signature_valid.

    calls: keys, callee and arguments (their number); definitions: keys and name of the instructions
    that a project defines itself. Names compare without case; a rule goes before a definition. kind is
    ``user_defined_instruction`` for those and ``unknown`` for the rest, whose signature isn't judged (null).
    """
    named = rule_table(calls, [(r[0].lower(), *r[1:]) for r in rules], "rule_name string, rule_kind string, maker string, least int, most int")
    own = definitions.select(*keys, F.lower("name").alias("rule_name")).distinct().withColumn("own", F.lit(True))
    joined = calls.withColumn("rule_name", F.lower("callee")).join(F.broadcast(named), "rule_name", "left").join(own, [*keys, "rule_name"], "left")
    kind = F.coalesce("rule_kind", F.when(F.col("own"), F.lit("user_defined_instruction")), F.lit("unknown"))
    valid = F.when(F.col("rule_kind").isNotNull(), F.coalesce(F.col("arguments") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("arguments") <= F.col("most"), F.lit(True)))
    return joined.select(*calls.columns, kind.alias("kind"), "maker", valid.alias("signature_valid"))


def semantic_coverage(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """calls, known, portable (no maker's own), valid and invalid signatures of every group of ``classified_calls``."""
    known = F.col("kind") != "unknown"
    return classified.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(known).alias("known"), F.count_if(known & F.col("maker").isNull()).alias("portable"), F.count_if(F.col("signature_valid")).alias("valid"), F.count_if(~F.col("signature_valid")).alias("invalid"))


def module_services(requests: DataFrame, intent: str = "intent", profile: str = "profile") -> DataFrame:
    """``requests`` plus support and equivalence; an unknown profile is the generic one, an unknown intent source_specific."""
    rules = [(p, i, *v) for p, intents in MODULE_SERVICES.items() for i, v in intents.items()]
    asked_profile = F.when(F.col(profile).isin(*MODULE_SERVICES), F.col(profile)).otherwise("generic")
    asked = requests.withColumn("__profile", asked_profile).withColumn("__intent", F.when(F.col(intent).isin(*MODULE_SERVICES["generic"]), F.col(intent)).otherwise("source_specific"))
    table = rule_table(requests, rules, "__profile string, __intent string, support string, equivalence string")
    return asked.join(F.broadcast(table), ["__profile", "__intent"]).select(*requests.columns, "support", "equivalence")


def runtime_compatibility(requirements: DataFrame, key: str, capability: str, runtimes: dict[str, Sequence[str]]) -> DataFrame:
    """key, runtime, required, missing (sorted) and compatible of every key and every runtime of the given ones."""
    need = requirements.groupBy(key).agg(F.array_sort(F.collect_set(capability)).alias("required"))
    offers = _literal([(n, sorted(c)) for n, c in sorted(runtimes.items())], ("runtime", "provided"))
    each = need.withColumn("r", F.explode(offers))
    missing = F.array_except("required", F.col("r.provided"))
    return each.select(key, F.col("r.runtime").alias("runtime"), "required", missing.alias("missing"), (F.size(missing) == 0).alias("compatible"))


#: What has to be done to use an instruction elsewhere: area, disposition and the calls that show the need (none: always).
READINESS = (
    ("core logic", "direct", ()),
    ("cyclic datatypes", "type adaptation", ("COP", "CPS")),
    ("data operations", "type adaptation", ("COP", "SIZE", "SWPB", "TONR")),
    ("controller objects", "runtime service", ("GSV", "SSV")),
    ("explicit messages", "runtime service", ("MSG",)),
)


def readiness(definitions: DataFrame, calls: DataFrame, keys: Sequence[str], areas: Sequence[tuple[str, str, Sequence[str]]] = READINESS) -> DataFrame:
    """keys, name, area, disposition, evidence (sorted call names), needed and blocked_by of every definition and area.

    calls: keys, name (of the definition that calls), callee and resolved (whether what is called is there). An area is
    needed if one of its calls occurs; blocked_by is the number of different callees that aren't resolved.
    """
    seen = calls.groupBy(*keys, "name").agg(F.collect_set(F.upper("callee")).alias("callees"), F.countDistinct(F.when(~F.col("resolved"), F.upper("callee"))).alias("blocked_by"))
    rows = definitions.select(*keys, "name").distinct().join(seen, [*keys, "name"], "left").withColumn("a", F.explode(_literal([(a, d, sorted(c)) for a, d, c in areas], ("area", "disposition", "calls")) if all(c for _, _, c in areas) else F.array(*[F.struct(F.lit(a).alias("area"), F.lit(d).alias("disposition"), F.array(*[F.lit(x) for x in sorted(c)]).cast("array<string>").alias("calls")) for a, d, c in areas])))
    evidence = F.array_sort(F.array_intersect("a.calls", F.coalesce("callees", F.array().cast("array<string>"))))
    return rows.select(*keys, "name", "a.area", "a.disposition", evidence.alias("evidence"), ((F.size("a.calls") == 0) | (F.size(evidence) > 0)).alias("needed"), F.coalesce("blocked_by", F.lit(0)).alias("blocked_by"))


def described_behaviours(sources: DataFrame, keys: Sequence[str], text: str, behaviours: dict[str, Sequence[str]]) -> DataFrame:
    """keys, behaviour, marker, line and supported: where a source shows what each behaviour needs.

    A behaviour is supported if all its markers occur in the source; line is that of a marker's first
    place, null where it is missing. Every source has a row for each marker of each behaviour.
    """
    rules = [(b, m) for b, markers in behaviours.items() for m in markers]
    each = sources.select(*keys, F.coalesce(text, F.lit("")).alias("__text")).withColumn("r", F.explode(_literal(rules, ("behaviour", "marker"))))
    at = F.expr("position(r.marker IN __text)")
    line = F.when(at > 0, F.length(F.substring("__text", F.lit(1), at)) - F.length(F.replace(F.substring("__text", F.lit(1), at), F.lit("\n"), F.lit(""))) + 1)
    found = each.select(*keys, "r.behaviour", "r.marker", line.cast("int").alias("line"))
    whole = found.groupBy(*keys, "behaviour").agg((F.count_if(F.col("line").isNull()) == 0).alias("supported"))
    return found.join(whole, [*keys, "behaviour"])


def whole_number(text: Column) -> Column:
    """struct<value, fault> of an optional decimal number: a null text has neither, another text the fault invalid_integer."""
    plain = F.trim(text)
    value = F.when(plain.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.struct(value.alias("value"), F.when(text.isNotNull() & value.isNull(), "invalid_integer").alias("fault"))


def flag(text: Column) -> Column:
    """struct<value, fault> of an optional ``true`` or ``false``, in this spelling only; another text has the fault invalid_boolean."""
    value = F.when(text == "true", True).when(text == "false", False)
    return F.struct(value.alias("value"), F.when(text.isNotNull() & value.isNull(), "invalid_boolean").alias("fault"))


def first_answer(providers: dict[str, Column]) -> Column:
    """struct<provider, answer> of the first of ordered providers whose answer isn't null, or null."""
    return F.coalesce(*[F.when(a.isNotNull(), F.struct(F.lit(n).alias("provider"), a.alias("answer"))) for n, a in providers.items()])


def message_evidence(calls: DataFrame, program_tags: DataFrame, controller_tags: DataFrame, callee: str = "msg") -> DataFrame:
    """``calls`` of ``callee`` (in any case) plus tag, tag_scope and reason.

    calls: program, callee and arguments (array); program_tags: program and name; controller_tags: name. The one argument
    has to be a tag's name in its own case; a program's tag shadows the controller's. reason is ``arity``, ``not_a_name``,
    ``unknown_tag`` or null.
    """
    named = calls.where(F.lower("callee") == callee).withColumn("__name", F.when(F.size("arguments") == 1, F.trim(F.get("arguments", F.lit(0)))))
    plain = F.when(F.col("__name").rlike(r"^[A-Za-z_]\w*$"), F.col("__name"))
    own = program_tags.select("program", F.col("name").alias("__plain")).distinct().withColumn("__own", F.lit(True))
    shared = controller_tags.select(F.col("name").alias("__plain")).distinct().withColumn("__shared", F.lit(True))
    found = named.withColumn("__plain", plain).join(own, ["program", "__plain"], "left").join(shared, "__plain", "left")
    scope = F.when(F.col("__own"), "program").when(F.col("__shared"), "controller")
    reason = F.when(F.col("__name").isNull(), "arity").when(F.col("__plain").isNull(), "not_a_name").when(scope.isNull(), "unknown_tag")
    return found.select(*calls.columns, F.when(scope.isNotNull(), F.col("__plain")).alias("tag"), scope.alias("tag_scope"), reason.alias("reason"))
