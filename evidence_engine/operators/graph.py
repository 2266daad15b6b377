"""Property-graph operators: un-pivoted edges make every "either endpoint" an equi-join; hops are unrolled joins."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import all_of, pieces_of, scaled
from evidence_engine.sources.scratch import kept, scratch_path

# Relation ranks and node types of the paper graph.
RELATION_PRIORITY = {
    "PAPER_HAS_SECTION": 0,
    "CHILD_SECTION": 1,
    "SECTION_HAS_CHUNK": 2,
    "METHOD_EVALUATED_ON_DATASET": 3,
    "METHOD_REPORTED_METRIC": 3,
    "SECTION_HAS_TABLE": 4,
    "SECTION_HAS_CODE": 4,
    "SECTION_HAS_EQUATION": 4,
    "PAPER_HAS_METHOD": 5,
    "PAPER_CITES_PAPER": 6,
    "NEXT_CHUNK": 8,
    "PREV_CHUNK": 8,
}
PAPER_NODE_TYPES = ("paper", "section", "chunk", "table", "code", "equation", "reference", "method", "dataset", "metric")
FAN_OUT, MAX_DEPTH = 20, 3


def incident(edges: DataFrame) -> DataFrame:
    """node_id, other_id and the edge, once for each endpoint; a self-loop once."""
    keep = [c for c in edges.columns if c not in ("source", "target")]
    out = edges.select(F.col("source").alias("node_id"), F.col("target").alias("other_id"), *keep)
    return out.unionByName(edges.where("source <> target").select(F.col("target").alias("node_id"), F.col("source").alias("other_id"), *keep))


class Adjacency(NamedTuple):
    """Edges laid out by node: rows(node_id, part, other_id, edge columns, r, r_back), r and r_back being an edge's place
    among the best ones of its node and of the other end (null beyond FAN_OUT_MOST), and hubs(node_id, parts, wide) of the
    nodes that are in several parts or wide. Where no places are known, rows are (node_id, part, other_id) alone."""

    rows: DataFrame
    hubs: DataFrame
    buckets: int


#: Edges of a node that lie together; a hub's are dealt out to parts of about so many. Least buckets of the stored layout,
#: and rows that a bucket holds before there are more.
HUB, BUCKETS, BUCKET_ROWS = 50_000, 16, 2_000_000
#: Places of a node's best edges that are known; a search that fans out further reads all edges.
FAN_OUT_MOST = 128
#: Edges beyond which a node is wide: its neighbours are listed once for all queries that reach it.
WIDE = 1000
#: Bits of a query's id that tell it from those it lies with in the last hop; pairs of query and neighbour that a partition
#: of that hop has about, and one query at once; rows of shared nodes up to which Spark may choose how they are joined.
RUN_BITS, PART_PAIRS, FEW_SHARED = 9, 8_000_000, 1_000_000


def lay_out(edges: DataFrame, hub: int = HUB, buckets: int | None = None, wide: int = WIDE, placed: bool = True) -> Adjacency:
    """The incident edges of each node, stored in buckets of (node, part), so that steps join them where they lie and only
    frontiers move. A hub is in several parts, so neither layout nor step has all its edges in one task. Searches that
    follow all edges need no places among the best ones: with placed off only endpoints are read, moved and stored."""
    spark = edges.sparkSession
    buckets = buckets or max(BUCKETS, -(-2 * edges.count() // BUCKET_ROWS))
    keep = [c for c in edges.columns if c not in ("source", "target")]
    inc = incident(edges.withColumn("from", F.col("source")) if placed else edges.select("source", "target"))
    counted = inc.groupBy("node_id").agg(F.count("*").alias("n"))
    hubs = kept(counted.where(F.col("n") > min(hub, wide)).select("node_id", F.ceil(F.col("n") / hub).cast("int").alias("parts"), (F.col("n") > wide).alias("wide")), "graph-hubs")

    def parted(rows: DataFrame) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64("edge_id" if placed else "other_id"), F.col("parts")), F.lit(0)).cast("int")
        return rows.join(hubs.drop("wide"), "node_id", "left").withColumn("part", part).drop("parts")

    def stored(rows: DataFrame) -> Adjacency:
        name = f"adjacency_{uuid.uuid4().hex}"
        parted(rows).repartition(buckets, "node_id", "part").write.bucketBy(buckets, "node_id", "part").option("path", scratch_path(spark, "adjacency")).saveAsTable(name)
        return Adjacency(spark.table(name), hubs, buckets)

    if not placed:
        return stored(inc)

    # The best edges of a part first, then those of the node among them: at most FAN_OUT_MOST a part.
    near = parted(inc.select("node_id", "edge_id", "confidence", (F.col("node_id") == F.col("from")).alias("ahead")))
    near = near.withColumn("r", best_first("node_id", "part")).where(F.col("r") <= FAN_OUT_MOST)
    best = near.drop("r").withColumn("r", best_first("node_id")).where(F.col("r") <= FAN_OUT_MOST)
    # An edge's places at both of its ends come to it in one row.
    ends = best.groupBy("edge_id").agg(F.max(F.when(F.col("ahead"), F.col("r"))).alias("r_from"), F.max(F.when(~F.col("ahead"), F.col("r"))).alias("r_to"))
    both = kept(edges.join(ends, "edge_id", "left").select("source", "target", *keep, "r_from", F.when(F.col("source") == F.col("target"), F.col("r_from")).otherwise(F.col("r_to")).alias("r_to")), "graph-places")
    rows = both.select(F.col("source").alias("node_id"), F.col("target").alias("other_id"), *keep, F.col("r_from").alias("r"), F.col("r_to").alias("r_back"))
    rows = rows.unionByName(both.where("source <> target").select(F.col("target").alias("node_id"), F.col("source").alias("other_id"), *keep, F.col("r_to").alias("r"), F.col("r_from").alias("r_back")))
    return stored(rows)


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    return edges if isinstance(edges, Adjacency) else lay_out(edges)


def step(frontier: DataFrame, edges: Adjacency, fan_out: int | None = None) -> DataFrame:
    """frontier(node_id, ...) with the edges at its nodes, or each node's `fan_out` best ones (all, if that is beyond
    FAN_OUT_MOST)."""
    parts = frontier.join(edges.hubs.drop("wide"), "node_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    rows = edges.rows if fan_out is None or fan_out > FAN_OUT_MOST else edges.rows.where(F.col("r") <= fan_out)
    return parts.join(rows, ["node_id", "part"]).drop("part")


def best_first(*keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "edge_id"))


def _first_edges(met: DataFrame, limit: int) -> DataFrame:
    """met(query_id, edge_id, confidence, ...) of each query's `limit` best edges, with their place r. An edge that is met
    from both ends has one place, and what is beyond the limit goes before rows are shuffled."""
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "edge_id"))
    return met.withColumn("r", place).where(F.col("r") <= limit)


def ego(seeds: DataFrame, edges: DataFrame | Adjacency, limit: int = 8) -> DataFrame:
    """query_id, rank, edge_id, confidence: incident edges of each query's seeds(query_id, node_id), best first."""
    start = seeds.select("query_id", "node_id")
    met = step(start, edges, limit) if isinstance(edges, Adjacency) else incident(edges).join(start, "node_id")
    return _first_edges(met.select("query_id", "edge_id", "confidence"), limit).select("query_id", F.col("r").alias("rank"), "edge_id", "confidence").distinct()


def k_hop(seeds: DataFrame, edges: DataFrame | Adjacency, depth: int = 2) -> DataFrame:
    """query_id, node_id, hop: nodes within `depth` hops and their distance."""
    inc = adjacency(edges)
    seen = seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        near = step(frontier.select("query_id", "node_id"), inc).select("query_id", F.col("other_id").alias("node_id")).distinct()
        frontier = near.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("hop", F.lit(d))
        frontier = kept(frontier, "graph-frontier")
        seen = seen.unionByName(frontier)
    return seen


def k_hop_totals(seeds: DataFrame, edges: DataFrame | Adjacency, depth: int = 2) -> DataFrame:
    """query_id, hop, nodes, id_sum: how many nodes k_hop finds at each distance, and the sum of their ids.

    The last hop is not listed as pairs of queries and nodes. Queries whose frontiers hold the same wide nodes are a class,
    and what lies next to these is listed once a class; only what narrow nodes lead to is listed by query, less what its
    class has already. Queries of nearby ids are a run, to which a narrow node's neighbours travel once, as one list. There
    are as many partitions as the pairs, which are counted first, need to be told apart in memory.
    """
    inc = edges if isinstance(edges, Adjacency) else lay_out(kept(edges.select("source", "target"), "graph-pairs"), placed=False)
    start = kept(seeds.select("query_id", "node_id").distinct(), "graph-seeds")
    seen = k_hop(start, inc, depth - 1)
    totals = seen.groupBy("query_id", "hop").agg(F.count("*").alias("nodes"), F.sum("node_id").alias("id_sum"))
    frontier = seen.where(F.col("hop") == depth - 1).select("query_id", "node_id")
    hubs = inc.hubs.where("wide").select("node_id")
    reached = frontier.join(hubs, "node_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("node_id")).alias("wide"))
    reached = kept(reached, "graph-reached")
    classes = reached.groupBy("wide").agg(F.min("query_id").alias("class"))
    member = kept(reached.join(classes, "wide").select("query_id", "class"), "graph-members")
    shared = step(classes.select("class", F.explode("wide").alias("node_id")), inc).select("class", F.col("other_id").alias("node_id")).distinct()
    shared = kept(shared, "graph-shared")
    lists = inc.rows.join(hubs, "node_id", "left_anti").groupBy("node_id", "part").agg(F.collect_list("other_id").alias("near"))
    run = F.shiftright("query_id", RUN_BITS)
    parts = frontier.join(hubs, "node_id", "left_anti").join(inc.hubs.drop("wide"), "node_id", "left").join(member, "query_id", "left")
    parts = parts.select("node_id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "query_id", "class")
    asked = F.collect_list(F.struct("query_id", "class")).alias("asked")
    parts = parts.repartition(inc.buckets, "node_id", "part").groupBy("node_id", "part", run.alias("run")).agg(asked)
    none = F.array().cast("array<bigint>")
    near = kept(parts.join(lists, ["node_id", "part"], "left").select("run", F.col("asked.query_id").alias("queries"), F.col("asked.class").alias("classes"), "node_id", F.coalesce("near", none).alias("near")), "graph-near")
    each = near.select(F.explode("queries").alias("query_id"), (F.size("near") + 1).cast("long").alias("n")).groupBy("query_id").agg(F.sum("n").alias("n"))
    pairs, longest = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most, slices = max(inc.rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // PART_PAIRS)), max(1, -(-longest // PART_PAIRS))
    # What else a query has seen: earlier hops, and wide nodes of its frontier.
    own = seen.where(F.col("hop") < depth - 1).select("query_id", "node_id").unionByName(frontier.join(hubs, "node_id", "left_semi").select("query_id", "node_id"))
    own = own.join(member, "query_id", "left").select(run.alias("run"), F.array("query_id").alias("queries"), F.array("class").alias("classes"), "node_id", none.alias("near"))
    # A run's rows lie together, so a query's nodes are told apart where they lie; a row's own node is one that it has seen.
    met = near.unionByName(own).repartition(most, "run").select("run", F.explode(F.arrays_zip("queries", "classes")).alias("asker"), "node_id", "near").withColumn("slice", F.lit(0))
    if slices > 1:
        met = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("near", F.filter("near", lambda x: F.pmod(F.xxhash64(x), F.lit(slices)) == F.col("slice")))
    met = met.groupBy("run", F.col("asker.queries").alias("query_id"), F.col("asker.classes").alias("class"), "slice").agg(F.flatten(F.collect_list("near")).alias("near"), F.array_distinct(F.collect_list("node_id")).alias("own"))
    met = met.select("query_id", "class", F.array_except("near", "own").alias("new"), F.when(F.col("slice") == 0, F.col("own")).otherwise(none).alias("own"))
    met = met.select("query_id", "class", F.size("own").alias("n"), F.posexplode(F.concat("own", "new")).alias("pos", "node_id")).select("query_id", "class", "node_id", (F.col("pos") < F.col("n")).alias("old"))
    if shared.count() > FEW_SHARED:
        met = met.repartition(most, "class", "node_id")
    met = met.join(shared.withColumn("held", F.lit(True)), ["class", "node_id"], "left")
    adds, gone = ~F.col("old") & F.col("held").isNull(), F.col("old") & F.col("held").isNotNull()
    sign = F.when(adds, 1).when(gone, -1).otherwise(0)
    rest = met.groupBy("query_id").agg(F.sum(sign).alias("n"), F.sum(sign * F.col("node_id")).alias("s"))
    of_class = shared.groupBy("class").agg(F.count("*").alias("cn"), F.sum("node_id").alias("cs"))
    whole = rest.join(member, "query_id", "left").join(of_class, "class", "left")
    last = whole.select("query_id", F.lit(depth).alias("hop"), (F.col("n") + F.coalesce("cn", F.lit(0))).alias("nodes"), (F.col("s") + F.coalesce("cs", F.lit(0))).alias("id_sum"))
    return totals.unionByName(last.where("nodes > 0"))


def subgraph(seeds: DataFrame, edges: DataFrame | Adjacency, depth: int = 2, limit: int = 8, dedupe: bool = False) -> DataFrame:
    """query_id, place, hop, edge_id: for each hop the 3 * limit best edges of the frontier, until `limit` are taken.

    An edge may come again in a later hop, as a hop's edges lead back; with dedupe it doesn't. Where seeds have a column
    depth, it is each query's own, up to `depth`.
    """
    inc = adjacency(edges)
    hops = max(1, min(2, depth))
    own = F.col("depth") if "depth" in seeds.columns else F.lit(hops)
    frontier = visited = seeds.select("query_id", "node_id", own.alias("depth")).distinct()
    out = None
    for d in range(1, hops + 1):
        # What is among a query's first edges is among the first ones of each node that it is met at.
        met = step(frontier.where(F.col("depth") >= d), inc, 3 * limit).select("query_id", "edge_id", "confidence", "other_id", "depth")
        taken = kept(_first_edges(met, 3 * limit), "graph-hop")
        hop = taken.select("query_id", F.lit(d).alias("hop"), "r", "edge_id", "confidence").distinct()
        out = hop if out is None else out.unionByName(hop)
        if d < hops:
            near = taken.select("query_id", F.col("other_id").alias("node_id"), "depth").distinct()
            frontier = near.join(visited, ["query_id", "node_id"], "left_anti")
            visited = visited.unionByName(frontier)
    if dedupe:
        first = F.row_number().over(Window.partitionBy("query_id", "edge_id").orderBy("hop"))
        out = out.withColumn("f", first).where("f = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "r"))
    return out.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "hop", "edge_id")


def paths(starts: DataFrame, targets: DataFrame, edges: DataFrame | Adjacency, depth: int = 3, limit: int = 8, fan_out: int = FAN_OUT) -> DataFrame:
    """query_id, place, hops, nodes, edges: simple paths from starts to targets (query_id, node_id each), in the order of
    a breadth-first search that goes on from each node over its `fan_out` best edges and ends at a target. Where starts
    have a column depth, it is each query's own, up to `depth`."""
    inc = adjacency(edges)
    hops = max(2, min(MAX_DEPTH, depth))
    own = F.col("depth") if "depth" in starts.columns else F.lit(hops)
    goal = targets.select("query_id", F.col("node_id").alias("other_id"), F.lit(True).alias("hit")).distinct()
    open_paths = starts.select("query_id", "node_id", own.alias("depth"), F.array("node_id").alias("nodes"), F.array().cast("array<bigint>").alias("edges"), F.array().cast("array<int>").alias("order"))
    done = None
    for d in range(1, hops + 1):
        if d == hops:
            # The last step only looks for targets: the edges at these, seen from the other end, meet the open paths.
            back = step(goal.select("query_id", F.col("other_id").alias("node_id"), "hit"), inc).where(F.col("r_back") <= fan_out)
            ends = back.select("query_id", F.col("other_id").alias("node_id"), F.col("node_id").alias("other_id"), "edge_id", F.col("r_back").alias("r"), "hit")
            near = open_paths.where(F.col("depth") >= d).join(ends, ["query_id", "node_id"])
        else:
            near = step(open_paths.where(F.col("depth") >= d), inc, fan_out).join(goal, ["query_id", "other_id"], "left")
        near = near.where(~F.array_contains("nodes", F.col("other_id")))
        near = near.select("query_id", "other_id", "depth", "hit", F.array_append("nodes", F.col("other_id")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("order", F.col("r")).alias("order"))
        if d < hops:
            near = kept(near, "graph-paths")
        found = near.where("hit").select("query_id", F.lit(d).alias("hops"), "nodes", "edges", "order")
        done = found if done is None else done.unionByName(found)
        if d < hops:
            open_paths = near.where("hit is null").select("query_id", F.col("other_id").alias("node_id"), "depth", "nodes", "edges", "order")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "order", "nodes"))
    return done.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "hops", "nodes", "edges")


def neighbourhood(seeds: DataFrame, edges: DataFrame | Adjacency, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each query's centre(query_id, node_id): nodes(query_id, node_id, hop) hop by hop until a
    query has `limit` of them, and the first `limit` edges(query_id, place, hop, edge_id) met on the way, again in each
    hop that meets them."""
    inc = adjacency(edges)
    seen = seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0))
    frontier, met_all = seen, None
    for d in range(1, depth + 1):
        # A query that has enough nodes goes no further.
        full = seen.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("query_id")
        met = step(frontier.join(full, "query_id", "left_anti").select("query_id", "node_id"), inc)
        edge = met.select("query_id", F.lit(d).alias("hop"), "edge_id").distinct()
        met_all = edge if met_all is None else met_all.unionByName(edge)
        near = met.select("query_id", F.col("other_id").alias("node_id")).distinct()
        frontier = near.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("hop", F.lit(d))
        frontier = kept(frontier, "graph-frontier")
        seen = seen.unionByName(frontier)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "edge_id"))
    return seen, met_all.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "hop", "edge_id")


def first_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The whole graph's view: the first `limit` nodes by id, and the edges between them."""
    kept = nodes.orderBy("node_id").limit(limit)
    return kept, induced(kept, edges)


def document_graph(docs: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each docs(doc_id): up to `limit` nodes that name it among their source documents, or of a document
    without such nodes those of its document_id property, and up to twice as many edges between them."""
    by_list = nodes.select("node_id", F.explode("source_doc_ids").alias("doc_id")).join(docs, "doc_id", "left_semi").distinct()
    rest = docs.join(by_list, "doc_id", "left_anti")
    by_property = nodes.select("node_id", F.expr("try_cast(properties['document_id'] AS BIGINT)").alias("doc_id")).join(rest, "doc_id", "left_semi").distinct()
    found = by_list.unionByName(by_property)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    kept = found.withColumn("place", place).where(F.col("place") <= limit).select("doc_id", "node_id")
    ends = kept.select("doc_id", F.col("node_id").alias("source"))
    inner = edges.join(ends, "source").join(kept.select("doc_id", F.col("node_id").alias("target")), ["doc_id", "target"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("edge_id"))
    return kept, inner.withColumn("place", place).where(F.col("place") <= 2 * limit).select("doc_id", "edge_id", "source", "target", "relation")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose endpoints are among nodes(node_id)."""
    a, b = nodes.select(F.col("node_id").alias("source")), nodes.select(F.col("node_id").alias("target"))
    return edges.join(a, "source", "left_semi").join(b, "target", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """node_id, degree; a self-loop counts once."""
    return incident(edges).groupBy("node_id").agg(F.count("*").alias("degree"))


def hydrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints' names and types; an edge with a missing endpoint goes; score is confidence or 0.6."""
    s = nodes.select(F.col("node_id").alias("source"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    t = nodes.select(F.col("node_id").alias("target"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    score = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.6).otherwise(F.col("confidence"))
    return edges.join(s, "source").join(t, "target").withColumn("score", score)


def edge_rank(hydrated: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, rank, edge_id: a query's edges(query_id, ...) by paper endpoint, relation priority (2 less if a query
    term stands in relation or names) and confidence."""
    terms = F.transform(F.slice(all_of(F.col("text"), "[A-Za-z_][A-Za-z0-9_]{2,}|[一-龥]{2,6}"), 1, 8), F.lower)
    rows = hydrated.join(queries.select("query_id", terms.alias("terms")), "query_id")
    text = F.lower(F.concat_ws(" ", "relation", "source_name", "target_name"))
    hit = F.exists("terms", lambda t: F.contains(text, t))
    paper = F.col("source_type").isin(*PAPER_NODE_TYPES) | F.col("target_type").isin(*PAPER_NODE_TYPES)
    prio = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RELATION_PRIORITY.items() for x in kv)), F.col("relation")), F.lit(10))
    w = Window.partitionBy("query_id").orderBy(F.when(paper, 0).otherwise(5), prio - F.when(hit, 2).otherwise(0), F.desc("confidence"), "edge_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "edge_id")


def path_text(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, place, text (`a -r-> b` parts), score (mean, millionths), types (sorted, distinct) of paths' rows."""
    legs = found.select("query_id", "place", F.posexplode("edges").alias("leg", "edge_id"))
    rows = legs.join(hydrate(edges, nodes), "edge_id")
    part = F.concat("source_name", F.lit(" -"), "relation", F.lit("-> "), "target_name")
    out = rows.groupBy("query_id", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg", part.alias("p")))), lambda x: x["p"]), " | ").alias("text"),
        scaled(F.avg("score")).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source_type", "target_type"))))), ",").alias("types"),
    )
    return out


#: Characters of the pieces that names are indexed by, longest first.
GRAMS = (3, 2)


def named_like(terms: DataFrame, nodes: DataFrame, literal: bool = False) -> DataFrame:
    """key, node_id: nodes whose name holds a term(key, lower-cased) as ILIKE does, `_` standing for any character; with
    literal it doesn't.

    Names are indexed by their pieces: a term meets only names with one of its own pieces and is then verified. Terms
    without a whole piece (all of their pieces have a `_`, or they are single characters) are compared with all names.
    """
    plain = (lambda g: F.lit(True)) if literal else (lambda g: ~F.contains(g, F.lit("_")))
    piece = F.coalesce(*(F.try_element_at(F.filter(pieces_of(F.col("key"), n), plain), F.lit(1)) for n in GRAMS))
    asked = terms.select("key", piece.alias("piece"))
    low = F.lower(F.col("name"))
    pieces = F.array_distinct(F.concat(*(pieces_of(low, n) for n in GRAMS)))
    holds = F.contains(F.lower("name"), F.col("key")) if literal else F.expr("name ILIKE concat('%', key, '%')")
    wanted = asked.where("piece is not null")
    spread_out = nodes.select("node_id", "name", F.explode(pieces).alias("piece")).join(wanted, "piece").where(holds)
    rest = nodes.select("node_id", "name").join(asked.where("piece is null").select("key"), holds)
    return spread_out.select("key", "node_id").unionByName(rest.select("key", "node_id"))


def entity_search(queries: DataFrame, nodes: DataFrame, limit: int = 8, most_terms: int = 8, literal: bool = False) -> DataFrame:
    """query_id, rank, node_id: nodes whose name holds one of a query's first distinct terms, case folded.

    The terms are LIKE patterns, so `_` stands for any character; with literal it doesn't.
    """
    terms = F.slice(F.array_distinct(all_of(F.col("text"), "[A-Za-z_][A-Za-z0-9_]{2,}|[一-龥]{2,6}")), 1, most_terms)
    asked = queries.select("query_id", F.explode(terms).alias("term")).select("query_id", F.lower("term").alias("key")).distinct()
    met = named_like(asked.select("key").distinct(), nodes, literal)
    found = asked.join(met, "key").select("query_id", "node_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "node_id")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Upsert of nodes(seq, name, type, description, source_doc_ids, properties) by name and type.

    Document ids merge in order of first appearance, later properties win, the first non-empty description stays.
    """
    ordered = rows.groupBy("name", "type").agg(F.array_sort(F.collect_list(F.struct("seq", "description", "source_doc_ids", "properties")), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("r"))
    return ordered.select(
        F.xxhash64("type", "name").alias("node_id"), "name", "type",
        F.coalesce(F.try_element_at(F.filter(F.transform("r", lambda x: x["description"]), lambda d: d.isNotNull() & (d != "")), F.lit(1)), F.lit("")).alias("description"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["source_doc_ids"], F.array().cast("array<bigint>"))))).alias("source_doc_ids"),
        F.aggregate("r", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: ~F.coalesce(F.map_contains_key(x["properties"], k), F.lit(False))), F.coalesce(x["properties"], F.create_map().cast("map<string,string>")))).alias("properties"),
    )


def merge_edges(rows: DataFrame) -> DataFrame:
    """Upsert of edges(seq, source, target, relation, confidence): the first of each triple stays, self-loops go."""
    return rows.where("source <> target").groupBy("source", "target", "relation").agg(F.min_by("confidence", "seq").alias("confidence"))


def delete_nodes(gone: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without gone(node_id) and without the edges at them."""
    left = edges.join(gone.select(F.col("node_id").alias("source")), "source", "left_anti").join(gone.select(F.col("node_id").alias("target")), "target", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left
