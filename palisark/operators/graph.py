"""The resource graph as two tables: nodes and edges, in which every key holds ``source_file``.

Edges are found by equi-joins on references; nothing compares all nodes with all nodes. Where the first of several
nodes counts, ``ord``, the place in the input, decides.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark import dims
from palisark.operators import rules
from palisark.operators.ordering import first_titles
from palisark.session import written

MAX_NODES = 10_000
MAX_EDGES = 50_000
#: Properties that name the network a resource lies in, and the type of that network.
CONTAINMENT_HINTS = [("vpc_id", "aws_vpc"), ("vnet_id", "azurerm_virtual_network"), ("network_id", "google_compute_network")]
#: Zone pairs, in either direction, whose crossing is of high severity.
HIGH_RISK = (("internet", "private"), ("internet", "data"), ("dmz", "data"), ("internet", "management"))
PUBLIC_PROPERTIES = ("map_public_ip_on_launch", "associate_public_ip_address", "publicly_accessible")
ROLE_HOLDERS = ("aws_iam_role_policy_attachment", "aws_iam_instance_profile")


def register_containment_hint(prop: str, target_type: str) -> None:
    CONTAINMENT_HINTS.append((prop, target_type))


def _text(props: Column, key: str) -> Column:
    """The property if it is a string, else null."""
    value = F.try_variant_get(props, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(props, f"$.{key}", "string"))


def _truthy_list(props: Column, key: str) -> Column:
    """The property as an array of strings, null unless it is a list with items."""
    value = F.try_variant_get(props, f"$.{key}", "array<string>")
    return F.when(F.size(value) > 0, value)


def trust_zone(resource_type: Column, props: str) -> Column:
    """The zone of a resource with the VARIANT column ``props``. Public properties put a resource into the DMZ; else the longest prefix of its type; else private."""
    public = reduce(lambda a, b: a | b, [rules.truthy_at(props, k) for k in PUBLIC_PROPERTIES])
    return F.when(public, "dmz").otherwise(dims.longest_prefix(resource_type, dims.ZONE_OF, "private"))


def nodes(resources: DataFrame) -> DataFrame:
    """One node per address (``schemas.NODE``): of repeated addresses the last one's values, at the first one's place."""
    last = F.max_by(F.struct("resource_type", "name", "properties", "provider", "module"), "ord")
    one = resources.groupBy("source_file", "address").agg(F.min("ord").alias("ord"), last.alias("r"))
    kind, props = F.col("r.resource_type"), F.col("r.properties")
    return one.select(
        "source_file", "ord", F.col("address").alias("id"), kind.alias("resource_type"), F.col("r.name").alias("name"),
        dims.category(kind).alias("category"), trust_zone(kind, "r.properties").alias("trust_zone"), props.alias("properties"),
        F.col("r.provider").alias("provider"), F.col("r.module").alias("module"),
    )


def checked_nodes(found: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """The nodes, with an error for a source file that has more than ``most``."""
    sizes = found.groupBy("source_file").agg(F.count("*").alias("n_nodes"))
    ok = F.assert_true(F.col("n_nodes") <= most, F.lit(f"a graph of more than {most} nodes: split the input"))
    return found.join(sizes, "source_file").where(ok.isNull()).drop("n_nodes")


def edges(resources: DataFrame, found: DataFrame, most: int | None = None) -> DataFrame:
    """Edges (``schemas.EDGE``) by dependency, containment, network flow and IAM binding; each (source, target, type) once.

    ``most``: edges kept of each source file, in input order (MAX_EDGES is the data model's bound), which needs them
    ranked in one task for each file; by default all are kept, and ``ord`` is the place of the source in the input.
    """
    r = resources.select("source_file", F.col("ord").alias("src_ord"), F.col("address").alias("source"), "resource_type", "properties", "dependencies")
    slim = found.select("source_file", F.col("id").alias("target"), F.col("ord").alias("tgt_ord"), "name", F.col("resource_type").alias("tgt_type"))
    out = [
        r.select("source_file", "src_ord", "source", F.posexplode(F.coalesce("dependencies", F.array().cast("array<string>"))).alias("place", "target"))
        .join(slim.select("source_file", "target"), ["source_file", "target"])
        .select("source_file", "src_ord", F.lit(0).alias("step"), "place", "source", "target", F.lit("dependency").alias("edge_type"))
    ]
    # Containment hints: the first node of the type that isn't the resource itself; the two first ones are enough.
    types = sorted({t for _, t in CONTAINMENT_HINTS})
    firsts = (
        slim.where(F.col("tgt_type").isin(types)).groupBy("source_file", "tgt_type")
        .agg(F.min(F.struct("tgt_ord", "target")).alias("first"))
    )
    seconds = (
        slim.join(firsts, ["source_file", "tgt_type"]).where(F.col("target") != F.col("first.target")).groupBy("source_file", "tgt_type")
        .agg(F.min(F.struct("tgt_ord", "target")).alias("second"))
    )
    firsts = firsts.join(seconds, ["source_file", "tgt_type"], "left")
    hints = F.array(*[F.when(_text(F.col("properties"), p) != "", F.lit(t)) for p, t in CONTAINMENT_HINTS])
    hinted = r.select("source_file", "src_ord", "source", F.posexplode(hints).alias("place", "tgt_type")).where("tgt_type is not null")
    other = F.when(F.col("first.target") != F.col("source"), F.col("first.target")).otherwise(F.col("second.target"))
    out.append(
        hinted.join(firsts, ["source_file", "tgt_type"]).withColumn("target", other).where("target is not null")
        .select("source_file", "src_ord", F.lit(1).alias("step"), "place", "source", "target", F.lit("containment").alias("edge_type"))
    )
    p = F.col("properties")
    many = F.coalesce(_truthy_list(p, "subnet_ids"), _truthy_list(p, "subnets"), F.array().cast("array<string>"))
    one = _text(p, "subnet_id")
    subnets = F.when(F.coalesce(one, F.lit("")) != "", F.concat(F.array(one), many)).otherwise(many)
    groups = F.coalesce(_truthy_list(p, "security_groups"), _truthy_list(p, "vpc_security_group_ids"), F.array().cast("array<string>"))
    for step, refs, fits, kind in (
        (2, subnets, slim["tgt_type"].endswith("subnet"), "containment"),
        (3, groups, slim["tgt_type"].contains("security_group"), "network_flow"),
    ):
        wanted = r.select("source_file", "src_ord", "source", F.explode(F.array_distinct(refs)).alias("ref")).where("ref <> ''")
        by_id = slim.where(fits).select("source_file", "target", "tgt_ord", F.col("target").alias("ref"))
        by_name = slim.where(fits & (F.col("name") != "")).select("source_file", "target", "tgt_ord", F.col("name").alias("ref"))
        out.append(
            wanted.join(by_id.union(by_name), ["source_file", "ref"]).where("source <> target").select(
                "source_file", "src_ord", F.lit(step).alias("step"), F.col("tgt_ord").alias("place"), "source", "target", F.lit(kind).alias("edge_type")
            )
        )
    # IAM: the role of that address, else the first role of that name.
    holders = r.where(F.col("resource_type").isin(*ROLE_HOLDERS)).select("source_file", "src_ord", "source", _text(p, "role").alias("ref")).where("ref <> ''")
    roles = slim.where("tgt_type = 'aws_iam_role'")
    address = slim.select("source_file", F.col("target").alias("by_address"))
    named = roles.groupBy("source_file", F.col("name").alias("ref")).agg(F.min_by("target", "tgt_ord").alias("by_name"))
    bound = (
        holders.withColumn("by_address", F.concat(F.lit("aws_iam_role."), "ref"))
        .join(address.withColumn("there", F.lit(True)), ["source_file", "by_address"], "left")
        .join(named, ["source_file", "ref"], "left")
        .withColumn("target", F.when(F.col("there"), F.col("by_address")).otherwise(F.col("by_name")))
        .where("target is not null and target <> source")
    )
    out.append(bound.select("source_file", "src_ord", F.lit(4).alias("step"), F.lit(0).alias("place"), "source", "target", F.lit("iam_binding").alias("edge_type")))
    all_edges = reduce(DataFrame.unionByName, out)
    first = all_edges.groupBy("source_file", "source", "target", "edge_type").agg(F.min(F.struct("src_ord", "step", "place")).alias("at"))
    zones = found.select("source_file", "id", "trust_zone")
    side = lambda c: zones.select("source_file", F.col("id").alias(c), F.col("trust_zone").alias(f"{c}_zone"))
    marked = first.join(side("source"), ["source_file", "source"]).join(side("target"), ["source_file", "target"])
    if most is None:
        ranked = marked.withColumn("ord", F.col("at.src_ord"))
    else:
        place = F.row_number().over(W.partitionBy("source_file").orderBy("at", "source", "target", "edge_type")) - 1
        ranked = marked.withColumn("ord", place).where(F.col("ord") < most)
    return ranked.select(
        "source_file", "ord", "source", "target", "edge_type", "source_zone", "target_zone", (F.col("source_zone") != F.col("target_zone")).alias("crosses_trust_boundary")
    )


def boundary_severity(a: Column, b: Column) -> Column:
    """High for the risky pairs of zones, whichever way round; else medium."""
    pair = F.array_join(F.array_sort(F.array(a, b)), "/")
    return F.when(pair.isin(*["/".join(sorted(x)) for x in HIGH_RISK]), "high").otherwise("medium")


def boundary_threats(found_edges: DataFrame, found_nodes: DataFrame) -> DataFrame:
    """A threat for each edge between zones; parallel edges of other types repeat its id."""
    src = found_nodes.select("source_file", F.col("id").alias("source"), "resource_type")
    a, b = F.col("source_zone"), F.col("target_zone")
    rows = found_edges.where("crosses_trust_boundary").join(src, ["source_file", "source"])
    arrow = F.concat(a, F.lit(" -> "), b)
    return rows.select(
        "source_file", dims.hash_id(F.lit("BOUNDARY"), F.col("source"), F.col("target")).alias("id"),
        F.concat(F.lit("Trust boundary crossing: "), arrow).alias("title"),
        F.concat(F.col("source"), F.lit(" reaches "), F.col("target"), F.lit(" across zones "), arrow).alias("description"),
        F.lit("tampering").alias("stride_category"), boundary_severity(a, b).alias("severity"), F.lit("boundary").alias("source"), "resource_type",
        F.col("source").alias("resource_address"), F.lit("Encrypt, authenticate and validate what crosses the boundary.").alias("mitigation"),
        F.lit("").alias("rule_id"), F.lit(1.0).alias("confidence"), F.parse_json(F.lit("{}")).alias("metadata"),
        F.array(*map(F.lit, dims.BOUNDARY_TECHNIQUES)).alias("mitre_techniques"), F.array(*map(F.lit, dims.BOUNDARY_TACTICS)).alias("mitre_tactics"),
        dims.severity_rank(boundary_severity(a, b)).alias("sev_rank"),
    )


def threat_counts(found_nodes: DataFrame, threats: DataFrame) -> DataFrame:
    """Each node with n_threats, its worst severity and the titles of its first five threats (0, null and none without)."""
    rows = threats.select("source_file", F.col("resource_address").alias("id"), "sev_rank", "title")
    on = rows.groupBy("source_file", "id").agg(F.count("*").alias("n_threats"), F.max("sev_rank").alias("rank"))
    on = on.join(first_titles(rows, ["source_file", "id"], F.desc("sev_rank"), "title"), ["source_file", "id"])
    titles = F.coalesce("first_titles", F.array().cast("array<string>"))
    return found_nodes.join(on, ["source_file", "id"], "left").select(
        *found_nodes.columns, F.coalesce("n_threats", F.lit(0)).alias("n_threats"), dims.severity_name(F.col("rank")).alias("max_severity"), titles.alias("titles")
    )


def path_edges(found_edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges with path_nos: the numbers of the attack paths that run along them, in either direction."""
    n = F.size("path") - 1
    steps = paths.select("source_file", "path_no", F.explode(F.arrays_zip(F.slice("path", F.lit(1), n).alias("a"), F.slice("path", F.lit(2), n).alias("b"))).alias("x"))
    pairs = steps.select("source_file", F.col("x.a").alias("source"), F.col("x.b").alias("target"), "path_no")
    both = pairs.union(pairs.select("source_file", "target", "source", "path_no")).groupBy("source_file", "source", "target")
    numbers = both.agg(F.array_sort(F.collect_set("path_no")).alias("path_nos"))
    return found_edges.join(numbers, ["source_file", "source", "target"], "left").withColumn("path_nos", F.coalesce("path_nos", F.array().cast("array<int>")))


def zone_counts(found_nodes: DataFrame) -> DataFrame:
    """The nodes of each file and zone, with the first and last of their ids."""
    return found_nodes.groupBy("source_file", "trust_zone").agg(F.count("*").alias("n_nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def neighbours(found_edges: DataFrame, node_id: str) -> DataFrame:
    """The nodes that edges from ``node_id`` lead to."""
    return found_edges.where(F.col("source") == node_id).select("source_file", F.col("target").alias("id")).distinct()


def edges_of(found_edges: DataFrame, node_id: str) -> DataFrame:
    return found_edges.where((F.col("source") == node_id) | (F.col("target") == node_id))


def shortest_paths(links: DataFrame, entries: DataFrame, targets: DataFrame, max_hops: int | None = None, group: str = "source_file") -> DataFrame:
    """An undirected shortest path from each entry to each target that it reaches: group, entry, target, path, hops.

    Of equally short paths the lexicographically first one counts. Breadth-first: each round extends the paths that
    have just reached a new node by one edge, as a join; a node that an entry has reached isn't reached again, so a round
    holds at most one row for each entry and node. Rounds are written, so lineage stays short. They end when no new node is
    reached; only a caller that gives ``max_hops`` stops them earlier.
    """
    both = links.select(group, F.col("source").alias("at"), F.col("target").alias("to"))
    both = both.union(links.select(group, F.col("target"), F.col("source"))).where("at <> to").distinct()
    start = entries.select(group, F.col("id").alias("entry")).distinct()
    reached = near = frontier = written(start.select(group, "entry", F.col("entry").alias("at"), F.array("entry").alias("path")), "paths-0")
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        step = (
            frontier.join(both, [group, "at"])
            .select(group, "entry", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
            .groupBy(group, "entry", "at").agg(F.min("path").alias("path"))
            .join(near.select(group, "entry", "at"), [group, "entry", "at"], "left_anti")
        )
        before, frontier = frontier, written(step, f"paths-{hop}")
        near = before.unionByName(frontier)  # edges have no direction: they lead one round back at most
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    goal = targets.select(group, F.col("id").alias("at")).distinct()
    return reached.join(goal, [group, "at"]).where("entry <> at").select(
        group, "entry", F.col("at").alias("target"), "path", (F.size("path") - 1).alias("hops")
    )


#: Entries of a file that are searched from at a time.
ENTRIES_AT_ONCE = 64


def attack_paths(found_nodes: DataFrame, found_edges: DataFrame, threats: DataFrame, top: int = 5, at_once: int = ENTRIES_AT_ONCE) -> DataFrame:
    """The ``top`` worst paths of each file from threatened outer nodes (internet, DMZ) to threatened inner ones:
    source_file, path, n_threatened, rank, path_no, severity.

    A path is a shortest one of its ends, of several that whose nodes, from its end on, have the smallest ids; its severity
    is the worst on it; equal ones go by entry, then by target. Entries are taken in order, ``at_once`` of each file; a
    search keeps one row for each of them and node: the parent and the worst rank so far. Only the paths that are returned
    are put together. A file is done when its best paths are as bad as its worst threat, or it has no more entries: what is
    held doesn't grow with entries times nodes.
    """
    worst = written(threats.groupBy("source_file", F.col("resource_address").alias("id")).agg(F.max("sev_rank").alias("rank")), "ranks")
    hot = found_nodes.select("source_file", "id", "trust_zone").join(worst, ["source_file", "id"])
    number = F.row_number().over(W.partitionBy("source_file").orderBy("id")) - 1
    entries = hot.where(F.col("trust_zone").isin("internet", "dmz")).withColumn("round", F.floor(number / at_once))
    goals = hot.where(F.col("trust_zone").isin("data", "management")).select("source_file", F.col("id").alias("at"))
    entries = written(entries.join(goals.select("source_file").distinct(), "source_file").select("source_file", "id", "rank", "round"), "entries")
    goals = written(goals, "goals")
    links = found_edges.select("source_file", F.col("source").alias("at"), F.col("target").alias("to"))
    links = written(links.union(found_edges.select("source_file", "target", "source")).where("at <> to").distinct(), "links")
    most = worst.groupBy("source_file").agg(F.max("rank").alias("most"))
    place = F.row_number().over(W.partitionBy("source_file").orderBy(F.desc("rank"), "entry", "target"))
    best: DataFrame | None = None
    for turn in itertools.count():
        now = entries.where(F.col("round") == turn)
        if best is not None:
            done = best.join(most, "source_file").where("rank = most").groupBy("source_file").count().where(F.col("count") >= top)
            now = now.join(done, "source_file", "left_anti")
        now = written(now, "entries-now")
        if now.isEmpty():
            if entries.where(F.col("round") > turn).isEmpty() or best is not None:
                break
            continue
        reached = _searched(now, links, worst)
        hits = reached.join(goals, ["source_file", "at"]).where("entry <> at").withColumnRenamed("at", "target").drop("parent")
        hits = hits.withColumn("place", place).where(F.col("place") <= top).drop("place")
        found = _with_paths(written(hits, "hits"), reached)
        found = found if best is None else found.unionByName(best)
        best = written(found.withColumn("place", place).where(F.col("place") <= top).drop("place"), "best-paths")
    if best is None:
        best = entries.select("source_file", F.col("id").alias("entry"), F.col("id").alias("target"), "rank", F.lit(1).alias("n_threatened"), F.array("id").alias("path")).limit(0)
    return best.withColumn("path_no", place).withColumn("severity", dims.severity_name(F.col("rank"))).drop("entry", "target")


def _searched(entries: DataFrame, links: DataFrame, worst: DataFrame) -> DataFrame:
    """Breadth first from ``entries``: source_file, entry, at, parent, and rank and n_threatened of the path so far."""
    frontier = entries.select("source_file", F.col("id").alias("entry"), F.col("id").alias("at"), F.lit(None).cast("string").alias("parent"), "rank", F.lit(1).alias("n_threatened"))
    reached = near = frontier = written(frontier, "search-0")
    own = worst.select("source_file", F.col("id").alias("at"), F.col("rank").alias("own"))
    for hop in itertools.count(1):
        step = (
            frontier.join(links, ["source_file", "at"])
            .groupBy("source_file", "entry", F.col("to").alias("at")).agg(F.min(F.struct(F.col("at").alias("parent"), "rank", "n_threatened")).alias("x"))
            .join(near.select("source_file", "entry", "at"), ["source_file", "entry", "at"], "left_anti").join(own, ["source_file", "at"], "left")
            .select("source_file", "entry", "at", "x.parent", F.greatest("x.rank", "own").alias("rank"), (F.col("x.n_threatened") + F.col("own").isNotNull().cast("int")).alias("n_threatened"))
        )
        before, frontier = frontier, written(step, f"search-{hop}")
        if frontier.isEmpty():
            return reached
        near = before.unionByName(frontier)  # edges have no direction: they lead one round back at most
        reached = reached.unionByName(frontier)


def _with_paths(hits: DataFrame, reached: DataFrame) -> DataFrame:
    """``hits`` (source_file, entry, target) with their paths, from the parents."""
    open_ = hits.withColumns({"at": F.col("target"), "path": F.array("target")})
    ready: list[DataFrame] = []
    up = reached.select("source_file", "entry", "at", "parent")
    while True:
        step = open_.join(up, ["source_file", "entry", "at"]).withColumns({"at": F.col("parent"), "path": F.concat(F.array("parent"), "path")}).drop("parent")
        step = written(step, "walk-back")
        ready.append(step.where("at = entry").drop("at"))
        open_ = step.where("at <> entry")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, ready)
