"""Search in the graph of papers: seeds, edges ranked by the domain, paths to node types, and the dispatch over methods.

Queries come in batches; edges are those of a graph with edge_id, source, target, relation and confidence, nodes have
node_id, name, type and, where known, properties with a document_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import graph, policies
from evidence_engine.sources.scratch import kept

# Words of a question about papers, terms of a query that edges are matched with, bounds of the search.
PAPER_TOKENS = ("论文", "章节", "结构", "方法", "实验", "数据集", "指标", "引用", "参考文献", "paper", "section", "method", "dataset", "metric", "reference")
EDGE_TERM = "[一-龥a-zA-Z0-9_.-]{2,}"
SEEDS_MOST, FAN_OUT, DEPTH_MOST = 10, 30, 3


def document_of(properties: Column) -> Column:
    return F.try_element_at(properties, F.lit("document_id"))


def is_paper_query(queries: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, paper: whether a query(query_id, text) has a paper word, or one of its seeds is a node of a paper."""
    typed = seeds.join(nodes.select("node_id", "type"), "node_id").where(F.col("type").isin(*graph.PAPER_NODE_TYPES)).select("query_id").distinct()
    rows = queries.select("query_id", tx.contains_any(F.lower(F.coalesce("text", F.lit(""))), PAPER_TOKENS).alias("word"))
    return rows.join(typed.withColumn("typed", F.lit(True)), "query_id", "left").select("query_id", (F.col("word") | F.coalesce("typed", F.lit(False))).alias("paper"))


def expand_seeds(seeds: DataFrame, nodes: DataFrame, most: int = SEEDS_MOST) -> DataFrame:
    """query_id, place, node_id: the papers of the documents that the seeds(query_id, place, node_id) belong to go before
    them, the last of them first; `most` are kept."""
    keyed = nodes.select("node_id", "type", document_of(F.col("properties")).alias("document"))
    docs = seeds.join(keyed, "node_id").where("document is not null").select("query_id", "document").distinct()
    papers = docs.join(keyed.where("type = 'paper'").select("document", "node_id"), "document").select("query_id", "node_id").distinct()
    papers = papers.join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    rows = papers.select("query_id", "node_id", F.lit(0).alias("group"), (-F.col("node_id")).alias("at")).unionByName(seeds.select("query_id", "node_id", F.lit(1).alias("group"), F.col("place").cast("long").alias("at")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("group", "at"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "node_id")


def filtered_edges(frontier: DataFrame, edges: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """query_id, edge_id: for each query the `limit` most confident edges at its frontier(query_id, node_id), of the
    relations it wants(query_id, relations); an empty list wants all."""
    met = graph.incident(edges).join(frontier, "node_id").select("query_id", "edge_id", "relation", "confidence").distinct()
    kept = met.join(wanted, "query_id").where((F.size("relations") == 0) | F.array_contains("relations", F.col("relation")))
    return kept.withColumn("r", graph.best_first("query_id")).where(F.col("r") <= limit).select("query_id", "edge_id")


def _rank_keys(hydrated: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows(query_id, edge ...) with the keys of the domain's order: paper endpoint, relation and query, confidence."""
    terms = F.transform(F.slice(F.filter(tx.all_of(F.col("text"), EDGE_TERM), lambda t: F.length(t) >= 2), 1, 8), F.lower)
    rows = hydrated.join(queries.select("query_id", terms.alias("terms")), "query_id")
    text = F.lower(F.concat_ws(" ", "relation", "source_name", "target_name"))
    paper = F.col("source_type").isin(*graph.PAPER_NODE_TYPES) | F.col("target_type").isin(*graph.PAPER_NODE_TYPES)
    table = F.create_map(*(F.lit(x) for kv in graph.RELATION_PRIORITY.items() for x in kv))
    priority = F.coalesce(F.try_element_at(table, F.col("relation")), F.lit(10)) - F.when(F.exists("terms", lambda t: F.contains(text, t)), 2).otherwise(0)
    return rows.withColumns({"k_paper": F.when(paper, 0).otherwise(5), "k_priority": priority}).drop("terms")


def _order() -> list:
    return [F.col("k_paper"), F.col("k_priority"), F.desc("confidence"), F.col("edge_id")]


def paper_subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 8, depth: int = 2) -> DataFrame:
    """query_id, place, hop, edge_id: hop by hop the frontier's edges of the wanted relations, ranked by the domain, each
    edge once, until there are `limit`. Where seeds have a column depth, it is each query's own, up to `depth`."""
    wanted = queries.select("query_id", policies.relation_filter(F.col("text")).alias("relations"))
    named = kept(graph.hydrate(edges, nodes), "graph-named")
    hops = min(max(depth, 1), DEPTH_MOST)
    own = F.col("depth") if "depth" in seeds.columns else F.lit(hops)
    frontier = visited = seeds.select("query_id", "node_id", own.alias("depth")).distinct()
    deep = frontier.select("query_id", "depth").distinct()
    out = None
    for d in range(1, hops + 1):
        met = filtered_edges(frontier.where(F.col("depth") >= d), edges, wanted, limit * 5)
        ranked = _rank_keys(met.join(named, "edge_id"), queries).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
        ranked = kept(ranked.select("query_id", "edge_id", "source", "target", "r"), "graph-hop")
        hop = ranked.select("query_id", F.lit(d).alias("hop"), "r", "edge_id")
        out = hop if out is None else out.unionByName(hop)
        if d < hops:
            ends = ranked.select("query_id", F.explode(F.array("source", "target")).alias("node_id")).distinct().join(deep, "query_id")
            frontier = kept(ends.join(visited, ["query_id", "node_id"], "left_anti").select("query_id", "node_id", "depth"), "graph-frontier")
            visited = visited.unionByName(frontier)
    first = F.row_number().over(Window.partitionBy("query_id", "edge_id").orderBy("hop"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "r"))
    return out.withColumn("f", first).where("f = 1").withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "hop", "edge_id")


def paper_ego(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, place, edge_id: of the 4 * limit most confident wanted edges at the seeds, the domain's first `limit`."""
    wanted = queries.select("query_id", policies.relation_filter(F.col("text")).alias("relations"))
    met = filtered_edges(seeds.select("query_id", "node_id").distinct(), edges, wanted, limit * 4)
    ranked = _rank_keys(met.join(graph.hydrate(edges, nodes), "edge_id"), queries).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
    return ranked.where(F.col("place") <= limit).select("query_id", "place", "edge_id")


def paper_paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 8, depth: int = DEPTH_MOST) -> DataFrame:
    """query_id, place, hops, nodes, edges: paths from all seeds(query_id, place, node_id) to nodes of the types that the
    query asks for, in the order of a breadth-first search over each node's FAN_OUT most confident edges in the domain's
    order. A path goes on through a target; a query that names no type gets no path."""
    wanted = queries.select("query_id", "text", policies.target_types(F.col("text")).alias("types")).where(F.size("types") > 0)
    inc = graph.lay_out(graph.hydrate(edges, nodes))
    types = nodes.select(F.col("node_id").alias("other_id"), F.col("type").alias("other_type"))
    nothing = F.array().cast("array<bigint>")
    paths = seeds.join(wanted.select("query_id"), "query_id").select("query_id", "node_id", F.array("node_id").alias("nodes"), nothing.alias("edges"), F.array(F.col("place").cast("int")).alias("order"))
    done = None
    for d in range(1, depth + 1):
        step = graph.step(paths, inc, FAN_OUT).join(types, "other_id").where(~F.array_contains("nodes", F.col("other_id")))
        step = _rank_keys(step, wanted)
        # The places of a path's steps among all steps from its end, those that were visited already left out.
        place = F.row_number().over(Window.partitionBy("query_id", "order").orderBy(*_order()))
        step = step.withColumn("at", place).select("query_id", "other_id", "other_type", F.array_append("nodes", F.col("other_id")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("order", F.col("at")).alias("order"))
        step = kept(step, "graph-paths")
        hit = step.join(wanted.select("query_id", "types"), "query_id").where(F.array_contains("types", F.col("other_type"))).select("query_id", F.lit(d).alias("hops"), "nodes", "edges", "order")
        done = hit if done is None else done.unionByName(hit)
        paths = step.select("query_id", F.col("other_id").alias("node_id"), "nodes", "edges", "order")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "order"))
    return done.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "hops", "nodes", "edges")


def _edge_hits(found: DataFrame, kind: str) -> DataFrame:
    return found.select("query_id", "place", F.lit(kind).alias("result_type"), F.col("edge_id").cast("string").alias("hit_id"), F.array("edge_id").alias("edges"))


def _path_hits(found: DataFrame, kind: str) -> DataFrame:
    key = F.concat(F.lit("path:"), F.array_join(F.transform("edges", lambda e: e.cast("string")), ":"))
    return found.select("query_id", "place", F.lit(kind).alias("result_type"), key.alias("hit_id"), "edges")


def path_or_ego(seeds: DataFrame, edges: DataFrame | graph.Adjacency, limit: int = 8, depth: int = 3) -> DataFrame:
    """Hits of paths from a query's first seed to any other, or of the edges at its seeds where there is no path. Where
    seeds have a column depth, it is each query's own."""
    start = seeds.where("place = 1").drop("place")
    goals = seeds.where("place > 1").select("query_id", "node_id")
    found = kept(_path_hits(graph.paths(start, goals, edges, depth, limit), "path"), "graph-hits")
    rest = seeds.join(found.select("query_id").distinct(), "query_id", "left_anti")
    ego = graph.ego(rest.select("query_id", "node_id"), edges, limit).withColumnRenamed("rank", "place")
    return found.unionByName(_edge_hits(ego, "ego"))


def search(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 10, near: graph.Adjacency | None = None) -> DataFrame:
    """query_id, place, result_type, hit_id, edges: the graph hits of queries(query_id, text, graph_method, graph_depth)
    from their seeds(query_id, place, node_id).

    Method none, or a query without seeds, gives nothing. Paths are 2 to 3 edges deep, subgraphs 1 to 2 hops; a paper
    query's search is the paper graph's: paths to the types it names, else between its seeds if it names none, else the
    ranked subgraph of 1 to 3 hops.
    """
    seeds, edges = kept(seeds, "graph-seeds"), kept(edges, "graph-edges")
    near = near or graph.lay_out(edges)
    method, paper = F.col("graph_method"), F.col("paper")
    between = lambda low, high: F.least(F.greatest(F.coalesce("graph_depth", F.lit(1)), F.lit(low)), F.lit(high))
    depth = F.when(paper & (method == "path"), DEPTH_MOST).when(paper, between(1, DEPTH_MOST)).when(method == "path", between(2, 3)).otherwise(between(1, 2))
    asked = queries.where(method != "none").join(is_paper_query(queries, seeds, nodes), "query_id")
    asked = asked.select("query_id", "text", method.alias("method"), "paper", depth.alias("depth"), between(1, DEPTH_MOST).alias("around"), F.size(policies.target_types(F.col("text"))).alias("types"))
    asked = kept(asked, "graph-queries")

    # Which searches there are to do: a few rows at most, as there are four methods.
    todo = {tuple(r) for r in asked.select("paper", "method", F.col("types") > 0).distinct().collect()}

    def of(cond: str, level: str = "depth") -> DataFrame:
        """The seeds of some queries, with the depth of their search."""
        return all_seeds.join(asked.where(cond).select("query_id", F.col(level).alias("depth")), "query_id")

    any_paper = any(p for p, _, _ in todo)
    all_seeds = seeds.join(asked.where("not paper").select("query_id"), "query_id", "left_semi")
    if any_paper:
        papers = expand_seeds(seeds.join(asked.where("paper").select("query_id"), "query_id", "left_semi"), nodes)
        all_seeds = kept(all_seeds.unionByName(papers), "graph-seeds")
    # A paper query of one seed alone has nothing to find a path to.
    several = all_seeds.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 2").select("query_id")
    joined = of("not paper and method = 'path'").unionByName(of("paper and method = 'path' and types = 0").join(several, "query_id", "left_semi"))
    text = asked.select("query_id", "text")
    ego = graph.ego(of("not paper and method = 'ego'").select("query_id", "node_id"), near, limit).withColumnRenamed("rank", "place")
    found = [_edge_hits(ego, "ego")]
    if todo & {(False, "path", False), (False, "path", True), (True, "path", False)}:
        found.append(path_or_ego(joined, near, limit))
    if todo & {(False, "subgraph", False), (False, "subgraph", True)}:
        around = graph.subgraph(of("not paper and method = 'subgraph'").select("query_id", "node_id", "depth"), near, 2, limit)
        found.append(_edge_hits(around, "subgraph"))
    if any_paper:
        found.append(_edge_hits(paper_ego(of("paper and method = 'ego'"), nodes, edges, text, limit), "paper_ego"))
        typed = _path_hits(paper_paths(of("paper and method = 'path' and types > 0").drop("depth"), nodes, edges, text, limit), "paper_path")
        typed = kept(typed, "graph-hits")
        settled = typed.select("query_id").unionByName(joined.select("query_id")).distinct()
        rest = of("paper and method in ('path', 'subgraph')", "around").join(settled, "query_id", "left_anti")
        found += [typed, _edge_hits(paper_subgraph(rest, nodes, edges, text, limit, DEPTH_MOST), "paper_subgraph")]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def describe(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hits with their name (`a -r-> b` parts), score (mean, millionths) and node types; hits whose edges lack an endpoint
    keep no name."""
    legs = hits.select("query_id", "result_type", "hit_id", "place", F.posexplode("edges").alias("leg", "edge_id")).distinct()
    rows = legs.join(graph.hydrate(edges, nodes), "edge_id")
    part = F.concat("source_name", F.lit(" -"), "relation", F.lit("-> "), "target_name")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg", part.alias("p")))), lambda x: x["p"]), " | ")
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source_type", "target_type"))))), ",")
    return rows.groupBy("query_id", "result_type", "hit_id", "place").agg(text.alias("name"), tx.scaled(F.avg("score")).alias("score"), types.alias("types"))
