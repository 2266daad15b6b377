"""Academic search results: payloads flattened and normalised, ids resolved, and a batch of plans executed over stored results.

External services are tables here: a row says which search of which query gave which payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import evidence
from evidence_engine.operators.routing import clean_query

# Words that a query for an author, or for a paper's relations, is stripped of; endpoints by intent.
AUTHOR_WORDS = "(?i)搜索|查询|查找|作者|学者|的论文|论文|author|researcher"
RELATION_WORDS = "(?i)这篇|帮我|查找|找|返回|并返回|是否真实|是否存在|是真的吗|是真是假|真实|真假|相关论文参考|相关论文|相关文献|参考论文|引用了哪些|引用|被引|参考文献有哪些|参考文献|参考|参考了哪些|推荐类似|推荐|类似|相似|的论文|论文|文献|有哪些|哪一些|verify|real paper|exist|related papers|related work|citations?|cited by|references?|recommendations?|similar"
ENDPOINTS = {
    "paper_search": "/graph/v1/paper/search", "paper_match": "/graph/v1/paper/search/match", "paper_detail": "/graph/v1/paper/{paper_id}", "paper_citations": "/graph/v1/paper/{paper_id}/citations", "paper_references": "/graph/v1/paper/{paper_id}/references",
    "paper_recommendations": "/recommendations/v1/papers/forpaper/{paper_id}", "paper_verify": "/graph/v1/paper/search/match + related endpoints", "related_papers": "/graph/v1/paper/search/match + related endpoints", "snippet_search": "/graph/v1/snippet/search", "author_search": "/graph/v1/author/search",
}
_PERSON = "struct<name:string>"
_ITEM_FIELDS = "title:string,paper_title:string,name:string,abstract:string,snippet:string,summary:string,text:string,content:string,url:string,paper_url:string,pdf_url:string,external_url:string,paperId:string,paper_id:string,id:string,arxiv_id:string,arxivId:string,pmid:string,doi:string,authorId:string,author_id:string,year:string,publicationYear:string,published:string,published_date:string"
ITEM = f"struct<{_ITEM_FIELDS},authors:array<{_PERSON}>,contexts:array<string>,openAccessPdf:struct<url:string>>"


def _trimmed(text: Column, words: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, words, " "), "[ \\t\\n]+", " "), "^[ ：:，,。]+|[ ：:，,。]+$", "")


def author_query(queries: DataFrame) -> DataFrame:
    """query_id, cleaned: a query for an author without the words that ask; a query of nothing else is cleaned as usual."""
    rows = queries.join(clean_query(queries).withColumnRenamed("cleaned", "usual"), "query_id")
    return rows.select("query_id", F.coalesce(F.nullif(_trimmed(F.coalesce("text", F.lit("")), AUTHOR_WORDS), F.lit("")), F.col("usual")).alias("cleaned"))


def strip_relations(text: Column) -> Column:
    """A query without the words that ask for a paper's relations; one of nothing else stays."""
    return F.coalesce(F.nullif(_trimmed(F.coalesce(text, F.lit("")), RELATION_WORDS), F.lit("")), text)


def endpoint(intent: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ENDPOINTS.items() for x in kv)), intent), F.lit(ENDPOINTS["paper_search"]))


def items_of(payloads: DataFrame) -> DataFrame:
    """payloads(..., payload) with their items (JSON strings) exploded as (pos, item): a list, the list under results, papers,
    data or items, a single paper or author, or what the text blocks under content hold; anything else has none."""
    j = F.col("payload")
    strings = lambda c: F.from_json(c, "array<string>")
    under = F.coalesce(*(strings(F.get_json_object(j, f"$.{k}")) for k in ("results", "papers", "data", "items")))
    single = F.coalesce(*(F.get_json_object(j, f"$.{k}") for k in ("paperId", "title", "authorId", "name")))
    texts = F.filter(F.transform(strings(F.get_json_object(j, "$.content")), lambda b: F.get_json_object(b, "$.text")), lambda t: t.isNotNull())
    inner = F.flatten(F.transform(texts, lambda t: F.coalesce(F.from_json(F.get_json_object(t, "$.results"), "array<string>"), F.when(F.get_json_object(t, "$.title").isNotNull(), F.array(t)), F.from_json(t, "array<string>"), F.array().cast("array<string>"))))
    found = F.when(F.trim(j).startswith("["), strings(j)).otherwise(F.coalesce(under, F.when(single.isNotNull(), F.array(j)), inner, F.array().cast("array<string>")))
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keep, F.posexplode(F.filter(found, lambda i: F.trim(i).startswith("{"))).alias("pos", "item"))


def normalise(items: DataFrame) -> DataFrame:
    """Canonical rows (query_id, source, rank, title, url, snippet, authors, year, paper_id, quality) of items(query_id, source,
    pos, item): of each field the first name that is set, a nested paper's fields first; rows without a title and a snippet go."""
    rows = items.withColumn("i", F.from_json("item", ITEM)).withColumn("p", F.from_json(F.get_json_object("item", "$.paper"), ITEM))
    pick = lambda *names: F.coalesce(*(F.coalesce(F.col(f"p.{n}"), F.col(f"i.{n}")) for n in names), F.lit(""))
    either = lambda n: F.coalesce(F.col(f"p.{n}"), F.col(f"i.{n}"))
    or_else = lambda a, b: F.when(a != "", a).otherwise(b)
    snippet = or_else(pick("abstract", "snippet", "summary", "text", "content"), F.coalesce(F.array_join(F.slice(either("contexts"), 1, 3), " "), F.lit("")))
    paper = pick("paperId", "paper_id", "id", "arxiv_id", "pmid", "doi", "authorId", "author_id")
    arxiv = or_else(pick("arxivId", "arxiv_id"), F.when(paper.rlike("^[0-9]{4}[.][0-9]{4,5}"), paper).otherwise(""))
    upper = F.coalesce(F.get_json_object("item", "$.paper.DOI"), F.get_json_object("item", "$.DOI"), F.lit(""))
    doi = or_else(pick("doi"), upper)
    by_id = F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).when(doi != "", F.concat(F.lit("https://doi.org/"), F.replace(doi, F.lit("DOI:"), F.lit(""))))
    by_id = by_id.when((F.col("source") == "semantic_author") & (paper != ""), F.concat(F.lit("https://www.semanticscholar.org/author/"), paper)).when(F.col("source").startswith("semantic") & (paper != ""), F.concat(F.lit("https://www.semanticscholar.org/paper/"), paper)).otherwise("")
    url = or_else(or_else(pick("url", "paper_url", "pdf_url", "external_url"), F.coalesce(either("openAccessPdf")["url"], F.lit(""))), by_id)
    authors = F.coalesce(F.array_join(F.transform(F.slice(either("authors"), 1, 8), lambda a: a["name"]), ", "), F.lit(""))
    out = rows.select("query_id", "source", (F.col("pos") + 1).alias("rank"), pick("title", "paper_title", "name").alias("title"), url.alias("url"), snippet.alias("snippet"), authors.alias("authors"), pick("year", "publicationYear", "published", "published_date").alias("year"), paper.alias("paper_id"))
    out = out.where("title <> '' or snippet <> ''").withColumn("quality", evidence.academic_quality())
    return out.withColumn("title", F.when(F.col("title") == "", "未命名论文").otherwise(F.col("title")))


def _best_first(rows: DataFrame) -> DataFrame:
    """rows of each query without repeats of paper_id, url or title, the best quality staying, with their place."""
    key = F.lower(F.coalesce(F.nullif("paper_id", F.lit("")), F.nullif("url", F.lit("")), F.col("title")))
    once = evidence.first_of(rows.withColumn("key", key).where("key <> ''"), ["query_id", "key"], F.desc("quality"), "rank", "source")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("quality"), "rank", "key")))


def union_searches(rows: DataFrame, snippets: bool = True, most: int = 5) -> DataFrame:
    """query_id, place, paper_id, title, source: a query's semantic, arXiv and (if wanted) snippet results as one ranking."""
    kinds = ("semantic_scholar", "arxiv") + (("semantic_snippet",) if snippets else ())
    return _best_first(rows.where(F.col("source").isin(*kinds))).where(F.col("place") <= most).select("query_id", "place", "paper_id", "title", "source")


def resolve_ids(rows: DataFrame) -> DataFrame:
    """query_id, paper_id: the best candidate of a query's match and of the first three of its search."""
    candidates = rows.where((F.col("source") == "semantic_match") | ((F.col("source") == "semantic_scholar") & (F.col("rank") <= 3)))
    return _best_first(candidates).where("place = 1").select("query_id", "paper_id")


#: The source that answers an intent which looks a paper up, and the groups of one that follows its relations, in order.
_BY_INTENT = {"paper_match": "semantic_match", "snippet_search": "semantic_snippet", "author_search": "semantic_author", "paper_detail": "semantic_detail", "paper_citations": "semantic_citations", "paper_references": "semantic_references", "paper_recommendations": "semantic_recommendations"}
_GROUPS = ("semantic_detail", "semantic_references", "semantic_citations", "semantic_recommendations")


def execute(plans: DataFrame, rows: DataFrame, web: DataFrame, most: int = 5) -> DataFrame:
    """query_id, place, title, source of the results of plans(query_id, intent, paper_id) over normalised rows.

    A lookup needs a paper's id, its own or a resolved one; without, it is a search. Verifying and related papers keep the
    groups' order: the paper, references, citations, recommendations, each ranked. A query without any result gets the web
    results(query_id, rank, title).
    """
    known = plans.join(resolve_ids(rows).withColumnRenamed("paper_id", "resolved"), "query_id", "left")
    paper = F.coalesce(F.nullif("paper_id", F.lit("")), F.nullif("resolved", F.lit("")))
    needs = ~F.col("intent").isin("paper_search", "paper_match", "snippet_search", "author_search")
    asked = known.select("query_id", F.when(needs & paper.isNull(), "paper_search").otherwise(F.col("intent")).alias("intent"))
    mine = rows.join(asked, "query_id")
    table = F.create_map(*(F.lit(x) for kv in _BY_INTENT.items() for x in kv))
    searched = _best_first(mine.where((F.col("intent") == "paper_search") & F.col("source").isin("semantic_scholar", "arxiv", "semantic_snippet")))
    looked_up = _best_first(mine.where(F.col("source") == F.try_element_at(table, F.col("intent"))))
    related = mine.where(F.col("intent").isin("paper_verify", "related_papers") & F.col("source").isin(*_GROUPS))
    group = F.array_position(F.array(*(F.lit(g) for g in _GROUPS)), F.col("source"))
    related = related.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(group, F.desc("quality"), "rank")))
    found = searched.select("query_id", "place", "title", "source").unionByName(looked_up.select("query_id", "place", "title", "source")).unionByName(related.select("query_id", "place", "title", "source"))
    rest = web.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("rank").alias("place"), "title", F.lit("web_search").alias("source"))
    return found.unionByName(rest).where(F.col("place") <= most)
