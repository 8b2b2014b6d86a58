"""Network topology: reported neighbours, corroborated by forwarding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .ordering import first_of


def link_index(links: DataFrame, target: str, port: str, order: str) -> DataFrame:
    """One row a (target, port): the last one given."""
    return first_of(links, [target, port], [F.col(order).desc()])


def correlate(neighbours: DataFrame, forwarding: DataFrame) -> DataFrame:
    """target, interface, peer, kind and corroborated of every edge.

    neighbours: target, interface, chassis; forwarding: target, interface, mac. A
    forwarding entry whose mac is a neighbour's chassis on the same interface (null-safe,
    case folded) corroborates that neighbour; any other is a ``mac_reachability`` edge.
    """
    near = neighbours.select("target", "interface", F.lower("chassis").alias("peer")).distinct()
    seen = forwarding.select("target", "interface", F.lower("mac").alias("peer")).distinct()
    n, s = near.alias("n"), seen.alias("s")
    same = [F.col("n.target") == F.col("s.target"), F.col("n.peer") == F.col("s.peer"), F.col("n.interface").eqNullSafe(F.col("s.interface"))]
    reported = n.join(s, same, "left").select("n.*", F.lit("reported_neighbour").alias("kind"), F.col("s.peer").isNotNull().alias("corroborated"))
    reached = s.join(n, same, "left_anti").select("s.*", F.lit("mac_reachability").alias("kind"), F.lit(False).alias("corroborated"))
    return reported.union(reached)


def merged_nodes(nodes: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """One row a node with the sorted union of each set-valued column's values."""
    return nodes.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in sets])


def accepted_graphs(relationships: DataFrame, assets: DataFrame, nodes: DataFrame, interfaces: DataFrame, graph: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, interfaces and links of every graph that can be accepted as a whole, and what refuses the others.

    relationships: ``graph``, link, source_asset, source_node, source_index (null: no interface named), target_asset and
    target_node; assets: ``graph`` and asset; nodes: ``graph``, node and target (what was observed of it; a node
    has a row a target); interfaces: ``graph``, target and index. An asset's nodes are those
    that its relationships name, its interfaces what was observed of these. A graph is refused, with all
    its reasons as rows (``graph``, reason, what), if an asset or a node isn't known, if one interface of a node
    belongs to several assets, or if a link starts at an interface that nobody observed. Of a refused
    graph nothing is in the first three tables: nodes (``graph``, asset, nodes sorted), interfaces (``graph``, asset,
    target, index) and links (``graph``, link, source_asset, target_asset, source_interface: its
    asset, target and index, of several targets the least).
    """
    ends = F.array(*[F.struct(F.col(f"{e}_asset").alias("asset"), F.col(f"{e}_node").alias("node")) for e in ("source", "target")])
    named = stored(relationships.select(graph, F.explode(ends).alias("e")).select(graph, "e.asset", "e.node").distinct(), "graph-ends")
    no_asset = named.select(graph, "asset").distinct().join(assets.select(graph, "asset"), [graph, "asset"], "left_anti").select(graph, F.lit("unknown_asset").alias("reason"), F.col("asset").alias("what"))
    seen = nodes.select(graph, "node", "target").distinct()
    known = nodes.select(graph, "node").distinct()
    no_node = named.select(graph, "node").distinct().join(known, [graph, "node"], "left_anti").select(graph, F.lit("unknown_node"), F.col("node"))
    # Each of the three is distinct, so what they are joined to is: the longest table isn't grouped for that.
    observed = named.join(seen, [graph, "node"]).join(interfaces.select(graph, "target", "index").distinct(), [graph, "target"])
    held = stored(observed.select(graph, "asset", "node", "target", "index"), "graph-interfaces")
    # Two claims of one place of a node: other assets, or other targets that are seen as it.
    places = held.groupBy(graph, "node", "index").agg(F.count(F.lit(1)).alias("claims"), F.min(F.struct("asset", "target", "index")).alias("at"))
    claimed = places.where("claims > 1").select(graph, F.lit("claimed_twice"), F.concat_ws(":", "node", F.col("index").cast("string")))
    wanted = relationships.select(graph, "link", F.col("source_node").alias("node"), F.col("source_index").alias("index")).where("index is not null")
    unseen = wanted.join(places.select(graph, "node", "index"), [graph, "node", "index"], "left_anti").select(graph, F.lit("unobserved_interface"), F.col("link"))
    refusals = stored(no_asset.union(no_node).union(claimed).union(unseen).distinct(), "graph-refusals")
    refused = refusals.select(graph).distinct()
    good = lambda t: t.join(refused, graph, "left_anti")
    out_nodes = good(named.groupBy(graph, "asset").agg(F.array_sort(F.collect_set("node")).alias("nodes")))
    out_interfaces = good(held.select(graph, "asset", "target", "index").distinct())
    located = relationships.join(places.select(graph, F.col("node").alias("source_node"), F.col("index").alias("source_index"), "at"), [graph, "source_node", "source_index"], "left")
    out_links = good(located.select(graph, "link", "source_asset", "target_asset", F.concat_ws("|", "at.asset", "at.target", F.col("at.index").cast("string")).alias("source_interface")))
    return out_nodes, out_interfaces, out_links.withColumn("source_interface", F.nullif("source_interface", F.lit(""))), refusals
