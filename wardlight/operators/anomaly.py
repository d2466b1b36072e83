"""Advisory entity scores: features, z-scores, isolation forest, attachment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.operators.correlate import fresh_addresses
from wardlight.session import checkpointed

ADVISORY_THRESHOLD = 0.8
FEATURES = [
    "events",
    "destinations",
    "interactive_share",
    "network_share",
    "remote_share",
    "off_hours_share",
    "new_addresses",
]
# Entity kind -> the column that names it.
ENTITY_KINDS = {"user": "SubjectUserName", "host": "HostName", "ip": "SrcIpAddr"}
WORK_HOURS = (8, 18)


def entity_features(events: DataFrame, kinds: dict[str, str] = ENTITY_KINDS) -> DataFrame:
    """(kind, entity, day, features): one row per entity and day.

    The kinds share one scan, and their new addresses a second one.  A first fold per (kind, entity, day,
    destination, logon type, hour class) keeps the shuffle small and spreads a
    hot entity; the second fold reads the groups.
    """
    hour = F.hour("TimeGenerated")
    off = (hour < WORK_HOURS[0]) | (hour >= WORK_HOURS[1])
    named = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(n).alias("entity")) for k, n in kinds.items()]
    )
    folded = (
        events.select(
            F.explode(named).alias("e"),
            F.to_date("TimeGenerated").alias("day"),
            "DstIpAddr",
            "LogonType",
            off.alias("off"),
        )
        .filter(F.col("e.entity") != "")
        .groupBy("e.kind", "e.entity", "day", "DstIpAddr", "LogonType", "off")
        .agg(F.count("*").alias("n"))
    )
    per_target = folded.groupBy("kind", "entity", "day", "DstIpAddr").agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.when(F.col("LogonType") == t, F.col("n")).otherwise(0)).alias(f"t{t}")
            for t in (2, 3, 10)
        ],
        F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).alias("off"),
    )
    share = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    counted = per_target.groupBy("kind", "entity", "day").agg(
        F.sum("n").alias("events"),
        F.count_if(F.col("DstIpAddr") != "").alias("destinations"),
        share("t2").alias("interactive_share"),
        share("t3").alias("network_share"),
        share("t10").alias("remote_share"),
        share("off").alias("off_hours_share"),
    )
    # An address is not a source of itself.
    others = [F.struct(F.lit(k).alias("kind"), F.col(n).alias("entity")) for k, n in kinds.items() if n != "SrcIpAddr"]
    if not others:
        return counted.withColumn("new_addresses", F.lit(0).cast("bigint"))
    pairs = (
        events.filter(F.col("SrcIpAddr") != "")
        .select(
            F.explode(F.array(*others)).alias("e"),
            F.col("SrcIpAddr").alias("address"),
            F.to_date("TimeGenerated").alias("day"),
        )
        .select("e.kind", "e.entity", "address", "day")
        .filter(F.col("entity") != "")
        .distinct()
    )
    fresh = fresh_addresses(pairs, ["kind", "entity"], baseline_days=30)
    return counted.join(fresh, ["kind", "entity", "day"], "left").na.fill(0, ["new_addresses"])


def zscore(
    features: DataFrame, names: list[str], baseline_days: int = 14, day: str = "day"
) -> DataFrame:
    """Deviation of each feature from the entity's own previous days.

    Null while there is no baseline, 0 when the baseline never varied and the
    value equals it.
    """
    at = F.unix_date(F.col(day))
    base = W.partitionBy("kind", "entity").orderBy(at).rangeBetween(-baseline_days, -1)
    out = {}
    for name in names:
        mean, spread = F.avg(name).over(base), F.stddev_pop(name).over(base)
        gap = F.col(name) - mean
        out[f"z_{name}"] = F.round(
            F.when(spread > 1e-9, gap / spread).when(F.abs(gap) <= 1e-9, F.lit(0.0)), 6
        )
    return features.select("kind", "entity", day, *[v.alias(k) for k, v in out.items()])


# -- isolation forest ---------------------------------------------------------


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


_TREE_SCHEMA = (
    "tree int, node int, feature int, cut double, low int, high int, depth_end double"
)


def _grow(points: np.ndarray, seed: int, limit: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    todo = [(points, 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        spans = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spans > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(rows))])
            continue
        feature = int(rng.choice(usable))
        low = rows[:, feature].min()
        cut = float(rng.uniform(low, low + spans[feature]))
        nodes.append([feature, cut, -1, -1, 0.0])
        left = rows[:, feature] < cut
        todo.append((rows[left], depth + 1, me, 2))
        todo.append((rows[~left], depth + 1, me, 3))
    return [(i, *n) for i, n in enumerate(nodes)]


def fit_forest(
    features: DataFrame,
    names: list[str],
    key: list[str],
    trees: int = 100,
    sample: int = 256,
    seed: int = 7,
) -> DataFrame:
    """Trees as rows (tree, node, feature, cut, low, high, depth_end).

    A tree takes the ``sample`` rows with the smallest hash of (tree, key), so
    the draw does not depend on partitioning.  Before they are ranked, rows whose
    hash is beyond about four samples' share are left out of that tree.
    """
    share = min(1.0, 4.0 * sample / max(1, features.count()))
    draw = F.xxhash64(F.lit(seed), *key)
    pool = features.select(*key, *[F.col(n).cast("double").alias(n) for n in names], draw.alias("_draw"))
    mine = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: F.pmod(F.xxhash64(tree, F.col("_draw")), F.lit(1_000_003)) <= F.lit(int(share * 1_000_003)),
    )
    spread = pool.withColumn("tree", F.explode(mine)).na.fill(0.0, names)
    rank = F.pmod(F.xxhash64("tree", "_draw"), F.lit(1_000_003))
    order = W.partitionBy("tree").orderBy(rank, "_draw", *key)
    drawn = spread.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)
    limit = math.ceil(math.log2(max(2, sample)))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rn")
        tree = int(rows["tree"].iloc[0])
        grown = _grow(rows[names].to_numpy(dtype=float), seed * 100_003 + tree, limit)
        return pd.DataFrame(
            [(tree, *n) for n in grown],
            columns=["tree", "node", "feature", "cut", "low", "high", "depth_end"],
        )

    return drawn.groupBy("tree").applyInPandas(grow, _TREE_SCHEMA)


def score_forest(
    features: DataFrame, names: list[str], forest: DataFrame, sample: int = 256
) -> DataFrame:
    """Add ``anomaly_score`` in [0, 1], four decimals, higher is stranger.

    The forest has at most ``trees * (2 * sample - 1)`` rows whatever the
    data, so it is read once and shipped to the tasks as a broadcast value.
    """
    nodes = forest.toPandas().sort_values(["tree", "node"])
    packed = [
        (
            g["feature"].to_numpy(np.int64),
            g["cut"].to_numpy(float),
            g["low"].to_numpy(np.int64),
            g["high"].to_numpy(np.int64),
            g["depth_end"].to_numpy(float),
        )
        for _, g in nodes.groupby("tree")
    ]
    shared = features.sparkSession.sparkContext.broadcast(packed)
    scale = _average_path(float(sample))

    @F.pandas_udf(T.DoubleType())
    def isolation(values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(dtype=float)
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, cut, low, high, depth_end in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                live = f >= 0
                if not live.any():
                    break
                go_low = x[rows, np.where(live, f, 0)] < cut[at]
                at = np.where(live, np.where(go_low, low[at], high[at]), at)
            total += depth_end[at]
        return pd.Series(np.round(np.power(2.0, -(total / len(shared.value)) / scale), 4))

    inputs = F.struct(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return features.withColumn("anomaly_score", isolation(inputs))


def isolation_forest(
    features: DataFrame,
    names: list[str] = FEATURES,
    key: tuple = ("kind", "entity", "day"),
    trees: int = 100,
    sample: int = 256,
    seed: int = 7,
) -> DataFrame:
    """Fit on the features and score them; one forest per entity kind."""
    fixed = checkpointed(features)
    out = None
    for kind in ENTITY_KINDS:
        part = fixed.filter(F.col("kind") == kind)
        if part.isEmpty():
            continue
        size = min(sample, part.count())
        forest = fit_forest(part, names, list(key), trees, size, seed)
        scored = score_forest(part, names, forest, size)
        out = scored if out is None else out.unionByName(scored)
    return fixed.withColumn("anomaly_score", F.lit(0.0)).limit(0) if out is None else out


# -- attachment ---------------------------------------------------------------


def score_hits(
    hits: DataFrame,
    matches: DataFrame,
    scores: DataFrame,
    window: str = "15 minutes",
    scope: str = "hit",
) -> DataFrame:
    """Hits with ``anomaly_score``: the maximum over the entities of the hit.

    ``matches`` are the rule matches the hits were built from, ``scores`` is
    (kind, entity, anomaly_score).  ``scope="batch"`` gives every hit of a
    window the maximum of the whole window.  Matches are folded to distinct
    (rule, window, entity) before the join.
    """
    keys = ["rule_id", "batch_start"]
    columns = [(k, n) for k, n in ENTITY_KINDS.items() if n in matches.columns]
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("entity")) for k, n in columns])
    entities = (
        matches.select("rule_id", F.window("TimeGenerated", window).start.alias("batch_start"), F.explode(named).alias("e"))
        .select(*keys, "e.*")
        .filter(F.col("entity") != "")
        .distinct()
    )
    best = scores.groupBy("kind", "entity").agg(F.max("anomaly_score").alias("_score"))
    if scope == "batch":
        keys = ["batch_start"]
    attached = entities.join(best, ["kind", "entity"]).groupBy(*keys).agg(F.max("_score").alias("_score"))
    return (
        hits.join(attached, keys, "left")
        .withColumn("anomaly_score", F.round(F.coalesce("_score", F.lit(0.0)), 4))
        .drop("_score")
        .select(*hits.columns)
    )


def advisory_records(scores: DataFrame, at, above: float = ADVISORY_THRESHOLD) -> DataFrame:
    """A low-severity record per entity above the threshold; never an incident."""
    return (
        scores.groupBy("kind", "entity")
        .agg(F.max("anomaly_score").alias("anomaly_score"))
        .filter(F.col("anomaly_score") > above)
        .select(
            F.lit(at).cast("timestamp").alias("TimeGenerated"),
            F.lit("AnomalyAdvisory").alias("EventType"),
            F.lit("Low").alias("Severity"),
            F.concat_ws(":", "kind", "entity").alias("Entity"),
            "anomaly_score",
        )
    )
