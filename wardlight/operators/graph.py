"""Entity graph: nodes, edges, time slice, neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import strip
from wardlight.session import checkpointed

# Column -> (category, order within a row).
NODE_COLUMNS = {
    "HostName": (0, 0),
    "SubjectUserName": (1, 1),
    "TargetUserName": (1, 2),
    "SrcIpAddr": (2, 3),
    "DstIpAddr": (2, 4),
    "ProcessImagePath": (3, 5),
}
EDGE_COLUMNS = [
    ("HostName", "SubjectUserName"),
    ("HostName", "SrcIpAddr"),
    ("SrcIpAddr", "DstIpAddr"),
    ("HostName", "ProcessImagePath"),
]
CATEGORIES = ["Host", "User", "IP Address", "Process"]


def _appearance(order: int) -> Column:
    """Rank of appearance as one number: newest row first, then column order.

    A plain number keeps the fold in a hash aggregate.
    """
    return -F.unix_millis("TimeGenerated") * 8 + order


def graph_slice(events: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """Events of a time range that name a host or a source address."""
    rows = events.filter(
        (F.col("TimeGenerated") >= F.lit(start).cast("timestamp"))
        & (F.col("TimeGenerated") < F.lit(end).cast("timestamp"))
        & ((F.col("HostName") != "") | (F.col("SrcIpAddr") != ""))
    )
    return rows.orderBy(F.desc("TimeGenerated"), "EventRecordID").limit(limit) if limit else rows


def graph_nodes(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """(name, category, label, mentions); a name keeps its first category.

    ``cap`` keeps the nodes that appear first, as a browser view does.
    """
    items = F.array(
        *[
            F.struct(strip(F.col(n)).alias("name"), _appearance(order).alias("seen"))
            for n, (_, order) in NODE_COLUMNS.items()
        ]
    )
    nodes = (
        rows.select(F.explode(items).alias("n"))
        .select("n.*")
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.min("seen").alias("seen"), F.count("*").alias("mentions"))
    )
    if cap:
        nodes = nodes.orderBy("seen", "name").limit(cap)
    category_of = F.array(*[F.lit(category) for category, _ in NODE_COLUMNS.values()])
    labels = F.array(*[F.lit(x) for x in CATEGORIES])
    category = F.element_at(category_of, F.pmod("seen", F.lit(8)).cast("int") + 1)
    return nodes.select(
        "name", category.alias("category"), F.element_at(labels, category + 1).alias("label"), "mentions"
    )


def graph_edges(rows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, event_id, events, first_seen, last_seen), no self loops.

    The event id is that of the newest row, the least one among equals.  Edges
    are folded per event id first, which a hash aggregate can do; with
    ``nodes`` only edges between listed nodes stay.
    """
    items = F.array(
        *[F.struct(strip(F.col(a)).alias("src"), strip(F.col(b)).alias("dst")) for a, b in EDGE_COLUMNS]
    )
    per_id = (
        rows.select(F.explode(items).alias("e"), "EventID", "TimeGenerated")
        .select("e.*", "EventID", "TimeGenerated")
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst", "EventID")
        .agg(
            F.count("*").alias("n"),
            F.min("TimeGenerated").alias("first"),
            F.max("TimeGenerated").alias("last"),
        )
    )
    edges = per_id.groupBy("src", "dst").agg(
        F.min_by("EventID", F.struct(-F.unix_millis("last"), F.col("EventID"))).alias("event_id"),
        F.sum("n").alias("events"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
    )
    if nodes is not None:
        for side in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("name").alias(side)), side, "left_semi")
    return edges


def graph_khop(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(name, hop): nodes within ``hops`` undirected steps of one entity.

    Works on distinct edges.  Each step joins the edges with the newly reached
    nodes only and drops nodes already reached.  Edges and steps are
    checkpointed, so the plan stays flat however many hops there are.
    """
    links = edges.select("src", "dst").distinct()
    both = checkpointed(links.union(links.select("dst", "src")).toDF("src", "dst").distinct())
    reached = both.filter(F.col("src") == start).select(F.col("src").alias("name"), F.lit(0).alias("hop")).limit(1)
    frontier = reached
    for hop in range(1, hops + 1):
        step = checkpointed(
            both.join(frontier.select(F.col("name").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("name"))
            .distinct()
            .join(reached.select("name"), "name", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        reached = reached.unionByName(step)
        frontier = step
    return reached
