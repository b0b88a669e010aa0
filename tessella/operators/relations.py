"""Joins between nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE, WAY, RELATION = 0, 1, 2


def members(relations: DataFrame) -> DataFrame:
    """(rel_id, seq, type, ref, role): one row per member."""
    return relations.select(F.col("id").alias("rel_id"), F.explode("members").alias("m")).select(
        "rel_id", "m.seq", "m.type", "m.ref", "m.role"
    )


def used_ways(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Ways that a relation uses."""
    used = members(relations).where(F.col("type") == WAY).select(F.col("ref").alias("_ref"))
    return ways.join(used, ways["id"] == used["_ref"], "left_semi")


def used_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that a way uses."""
    refs = ways.select(F.explode("refs").alias("_ref"))
    return nodes.join(refs, nodes["id"] == refs["_ref"], "left_semi")


def kept_nodes(nodes: DataFrame, ways: DataFrame, emitted) -> DataFrame:
    """Nodes that are emitted as features or used by a way, each once."""
    refs = ways.select(F.explode("refs").alias("_ref"))
    return nodes.where(emitted).unionByName(nodes.where(~F.coalesce(emitted, F.lit(False))).join(refs, F.col("id") == refs["_ref"], "left_semi"))


def way_coordinates(ways: DataFrame, nodes: DataFrame, skip_integrity: bool = True) -> DataFrame:
    """ways with `coords` (array of lon, lat pairs in ref order), `closed` and `missing` (refs without a node).

    A missing node is an error unless skip_integrity, when the ref is left out; ways without any coordinates are dropped.
    Refs meet nodes in one equi-join; the order comes back by sorting each way's own short list.
    """
    refs = ways.select(F.col("id").alias("_way"), F.posexplode("refs").alias("pos", "ref"))
    n = nodes.select(F.col("id").alias("_node"), "lon", "lat")
    joined = refs.join(n, refs["ref"] == n["_node"], "left")
    if not skip_integrity:
        fail = F.raise_error(F.concat(F.lit("missing node "), F.col("ref").cast("string"))).cast("double")
        joined = joined.withColumn("lon", F.when(F.col("_node").isNull(), fail).otherwise(F.col("lon")))
    got = joined.groupBy("_way").agg(
        F.sort_array(F.collect_list(F.when(F.col("_node").isNotNull(), F.struct("pos", "ref", "lon", "lat")))).alias("c"),
        F.sum(F.col("_node").isNull().cast("long")).alias("missing"),
    )
    coords = F.transform("c", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    got = got.where(F.size("c") > 0).select("_way", coords.alias("coords"), "missing")
    closed = F.element_at("coords", 1) == F.element_at("coords", -1)
    return ways.join(got, ways["id"] == got["_way"]).drop("_way").withColumn("closed", closed)


def parents(objects: DataFrame, relations: DataFrame, kind: int) -> DataFrame:
    """objects with `parents`: (rel_id, role) of the relations they are members of, sorted; null if none."""
    m = members(relations).where(F.col("type") == kind)
    listed = m.groupBy(F.col("ref").alias("_ref")).agg(F.sort_array(F.collect_list(F.struct("rel_id", "role"))).alias("parents"))
    return objects.join(listed, objects["id"] == listed["_ref"], "left").drop("_ref")


def parent_tag(objects: DataFrame, relations: DataFrame, kind: int, key: str) -> DataFrame:
    """(id, rel_id, role, value): the tag of each parent relation, "" where it has none."""
    m = members(relations).where(F.col("type") == kind)
    tags = relations.select(F.col("id").alias("_rel"), F.coalesce(F.col("tags")[key], F.lit("")).alias("value"))
    return objects.select("id").join(m, F.col("id") == F.col("ref")).join(tags, F.col("rel_id") == tags["_rel"]).select("id", "rel_id", "role", "value")


def least_parent_number(objects: DataFrame, relations: DataFrame, kind: int, key: str) -> DataFrame:
    """(id, least): the least number among the parents' tags."""
    return parent_tag(objects, relations, kind, key).groupBy("id").agg(F.min(F.col("value").try_cast("double")).alias("least"))


def ancestors(edges: DataFrame, max_depth: int = 32) -> DataFrame:
    """(id, ancestor): every relation above another, each once, cycles cut. edges: (child, parent).

    Each round joins only the pairs found in the last one; the closure is checkpointed so plans stay short.
    """
    e = edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p")).distinct()
    found = fresh = e.select(F.col("_c").alias("id"), F.col("_p").alias("ancestor")).where("id <> ancestor")
    cut = edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for _ in range(max_depth):
        step = fresh.join(e, fresh["ancestor"] == e["_c"]).select("id", F.col("_p").alias("ancestor")).where("id <> ancestor").distinct()
        fresh = step.join(found, ["id", "ancestor"], "left_anti")
        fresh = fresh.checkpoint() if cut else fresh.persist()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise ValueError("relations nest deeper than max_depth")


def first_role_node(relations: DataFrame, nodes: DataFrame, roles: list[str]) -> DataFrame:
    """(rel_id, node_id, role, lon, lat): the member node that labels each relation: by order of roles, then of members."""
    rank = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    m = members(relations).where((F.col("type") == NODE) & F.col("role").isin(roles))
    n = nodes.select(F.col("id").alias("node_id"), "lon", "lat")
    best = Window.partitionBy("rel_id").orderBy(rank, "seq")
    return (
        m.join(n, m["ref"] == n["node_id"]).withColumn("_n", F.row_number().over(best)).where("_n = 1")
        .select("rel_id", "node_id", "role", "lon", "lat")
    )


def with_ancestors(relations: DataFrame) -> DataFrame:
    """relations with `ancestors`: (id, tags) of every relation above them, by id; what a rule over a relation's family reads."""
    edges = members(relations).where(F.col("type") == RELATION).select(F.col("ref").alias("child"), F.col("rel_id").alias("parent"))
    above = ancestors(edges)
    tags = relations.select(F.col("id").alias("_a"), F.col("tags").alias("_t"))
    # a map can't be sorted by, so the list is sorted by id alone
    pair = F.struct(F.col("ancestor").alias("id"), F.col("_t").alias("tags"))
    listed = above.join(tags, above["ancestor"] == tags["_a"]).groupBy(F.col("id").alias("_id")).agg(F.collect_list(pair).alias("ancestors"))
    by_id = F.expr("array_sort(ancestors, (l, r) -> CASE WHEN l.id < r.id THEN -1 WHEN l.id > r.id THEN 1 ELSE 0 END)")
    return relations.join(listed.select("_id", by_id.alias("ancestors")), relations["id"] == F.col("_id"), "left").drop("_id")


def label_tags(nodes: DataFrame, relations: DataFrame, key: str, role: str = "label") -> DataFrame:
    """nodes whose tag `key` is filled, where they lack it, from the first relation that they label."""
    found = parent_tag(nodes, relations, NODE, key).where((F.col("role") == role) & (F.col("value") != ""))
    first = found.groupBy(F.col("id").alias("_id")).agg(F.min_by("value", "rel_id").alias("_v"))
    own = F.coalesce(F.col("tags")[key], F.lit(""))
    filled = F.map_concat(F.map_filter("tags", lambda k, _: k != key), F.create_map(F.lit(key), F.col("_v")))
    joined = nodes.join(first, nodes["id"] == first["_id"], "left")
    return joined.withColumn("tags", F.when((own == "") & F.col("_v").isNotNull(), filled).otherwise(F.col("tags"))).drop("_id", "_v")
