"""Connected components by frontier breadth-first search from many seeds, and splits that keep components whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_prefix
from ..operators.skew import lookup
from ..session import stage, unstage


def _small(pairs: list[tuple]) -> dict:
    """Union-find over a bounded list of pairs."""
    parent: dict = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {a: root(a) for a in list(parent)}


def components(links: DataFrame, small: int = 100_000, depth: int = 0, hub: int = 50_000) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: undirected links between ids of one type; component: any fixed member).

    Every node whose hash is below those of all its neighbours is a seed, so every component has one; all seeds expand
    together, a node reached by several takes the least label. Links between differently labelled nodes are collisions;
    they form a graph over the seeds, far smaller than the input, which is solved the same way until at most ``small``
    distinct collisions are left, which the driver merges. Adjacency is partitioned by node and piece: a node of more than
    ``hub`` neighbours has several pieces, by its neighbours' hashes, and a frontier asks each of them, so no task gets a
    whole hub. Labels are combined in the map tasks before they travel.
    """
    spark = links.sparkSession
    kind = dict(links.dtypes)["a"]
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    hubs = F.broadcast(both.groupBy(F.col("a").alias("hub")).count().where(F.col("count") > hub).select("hub", F.ceil(F.col("count") / hub).cast("int").alias("k")))  # at most a row for every ``hub`` links
    one = F.lit(1)

    def piece(df: DataFrame, node: str, other: str, name: str) -> DataFrame:
        return df.join(hubs, F.col(node) == F.col("hub"), "left").withColumn(name, F.pmod(F.xxhash64(other), F.coalesce("k", one)).cast("int")).drop("hub", "k")

    def pieces(df: DataFrame, node: str, name: str) -> DataFrame:
        """Every row once for each piece of its node."""
        return df.join(hubs, F.col(node) == F.col("hub"), "left").withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("k", one) - 1))).drop("hub", "k")

    adjacency = stage(piece(piece(both, "a", "b", "pa"), "b", "a", "pb"), "adjacency")
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    order = lambda c: F.struct(F.xxhash64(F.lit(depth), c), c)
    seeds = adjacency.groupBy("a").agg(F.min(order(F.col("b"))).alias("least")).where(order(F.col("a")) < F.col("least")).select(F.col("a").alias("node"), F.col("a").alias("label"))
    done = stage(seeds, "seeds")
    frontier, layers = done, [done]
    while True:
        asking = pieces(frontier, "node", "p")
        reached = asking.join(adjacency, (F.col("node") == F.col("a")) & (F.col("p") == F.col("pa"))).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        for layer in layers[-2:]:  # a neighbour of the newest layer lies in it, in the one before it, or is new
            reached = reached.join(layer.select("node"), "node", "left_anti")
        frontier = stage(reached, "frontier")
        if frontier.isEmpty():
            break
        layers.append(frontier)
    labelled = layers[0]
    for layer in layers[1:]:
        labelled = labelled.unionByName(layer)
    labelled = stage(labelled, "labelled")
    unstage(*layers, frontier)
    left = pieces(labelled.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "pa")
    right = pieces(labelled.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "pb")
    collisions = stage(
        adjacency.where("a < b").join(left, ["a", "pa"]).join(right, ["b", "pb"]).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "collisions"
    )
    unstage(adjacency, both)
    if collisions.count() <= small:
        merged = _small([tuple(r) for r in collisions.collect()])
        above = spark.createDataFrame(list(merged.items()), f"label {kind}, component {kind}")
    else:
        above = components(collisions, small, depth + 1, hub).withColumnRenamed("node", "label")
    heavy = labelled.groupBy("label").count().where(F.col("count") > hub)
    solved = lookup(labelled, above, "label", heavy).select("node", F.coalesce("component", "label").alias("component"))
    return alone.join(solved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def group_records(records: DataFrame, record_id: str, keys: list, hot: int = 50_000) -> DataFrame:
    """(record_id, group_id): records that share a non-null key belong together, transitively; group_id is the least record_id.

    ``keys`` are columns or expressions; equal values of different expressions are different keys. A key is a node, known by
    its text and so without collisions, and a record links its keys, so a key shared by a third of all records costs one
    node and no pairs; the records of keys and groups of more than ``hot`` records are answered by broadcast. Records
    without any key are groups of their own. Ids must be unique and not null; the result has one row for every record.
    """
    nodes = [F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(keys)]
    base = stage(records.select(F.col(record_id).alias("_id"), F.filter(F.array(*nodes), lambda v: v.isNotNull()).alias("_k")), "keys")
    links = base.where("size(_k) > 0").select(F.explode(F.transform("_k", lambda v: F.struct(F.col("_k")[0].alias("a"), v.alias("b")))).alias("l")).select("l.*").distinct()
    found = stage(components(links, hub=hot), "components")
    named = base.select("_id", F.get("_k", F.lit(0)).alias("node"))
    heavy = named.where("node IS NOT NULL").groupBy("node").count().where(F.col("count") > hot)
    own = stage(lookup(named, found, "node", heavy), "owned")
    least = own.where("component IS NOT NULL").groupBy("component").agg(F.min("_id").alias("_g"), F.count("*").alias("_n"))
    done = lookup(own, least.select("component", "_g"), "component", least.where(F.col("_n") > hot))
    return done.select(F.col("_id").alias(record_id), F.coalesce("_g", "_id").alias("group_id"))


def split_groups(grouped: DataFrame, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """(group_id, split): whole groups, in the order of their hashes, fill the splits in the given proportions of records.

    A group goes where the middle of its stretch of the order falls, so every share is met to within half a group.
    """
    total_shares = sum(shares.values())
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "group_id"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    middle = (F.col("start") + F.col("n") / 2) / total
    upto, split = 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share / total_shares
        split = F.when(middle <= upto, name) if split is None else split.when(middle <= upto, name)
    last = list(shares)[-1]
    return global_prefix(sizes, ["h", "group_id"], "n").select("group_id", (F.lit(last) if split is None else split.otherwise(last)).alias("split"))
