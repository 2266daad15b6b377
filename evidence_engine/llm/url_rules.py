"""URL filters by association rules, with DataFrame functions and Spark's FP-growth only.

Tokens of a URL are its host labels, path segments and query keys, each marked with its part; runs of digits are one
token. A labelled URL is one whose path holds the number of a labelled document: the page shows that document. It is bad
if the document's quality is 0 or it is toxic, else good. FP-growth mines the token combinations that go with either
label; rules below the support or the confidence are pruned, and so is a rule whose label isn't more frequent among its
URLs than chance explains: it must lie DEVIATIONS standard deviations above the label's share of all labelled URLs.
Tokens that stand in exactly the same labelled URLs are one item while mining. A combination has up to MOST_TOKENS
tokens. Where a labelled URL has more than LONG_ROW frequent items, whose subsets FP-growth would list at any length,
Spark's PrefixSpan, which grows patterns up to a length, lists the same combinations instead; every labelled URL counts.
For matching, each rule is indexed under the rarest item of its combination; a URL meets only the rules of its own items
there, and a rule holds if the URL has all its items. A URL for which a rule of the bad label holds is blocked; any other
is allowed, by a rule of the good label or by default.

Hand-written rules (host, path) come first: a rule fits its host and its subdomains if the URL's path starts with the
rule's; the longest (host and path together) wins, and of rules of one length the one that is listed last.

Defined cases: a null URL or one without :// has an empty host and path, no tokens, and is allowed; repeated rows each
get their row; repeated labels of a document are bad if one of them is; a URL with several numbers in its path is linked
by the last; without labels, or with labels of one kind only, there are no mined rules; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import materialise, table

# The contract's rules, as host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A rule holds, with its label, for this share of the labelled URLs and this many at least, and its label is right for
#: this share of the URLs that it holds for.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 20, 0.6
#: Standard deviations by which a rule's label must be more frequent than among all labelled URLs; that happens by chance
#: to one combination in three million.
DEVIATIONS = 5
#: Tokens of a combination, and items of a labelled URL beyond which patterns grow by length; the latter changes no result.
MOST_TOKENS, LONG_ROW = 4, 16
BAD, GOOD = "label:bad", "label:good"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES_SCHEMA = "tokens array<string>, label string, confidence bigint, n bigint, rarest string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.lit(2**31 - 1))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct marked tokens; runs of digits are one token."""

    def words(mark: str, text: Column, separator: str) -> Column:
        parts = F.filter(F.split(text, separator), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    marked = F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    found = F.array_distinct(F.concat(words("h:", host, r"\."), words("p:", path, "/"), marked))
    return F.coalesce(found, F.array().cast("array<string>"))


def shown_document(path: Column) -> Column:
    """The number of the document that a page shows: the last run of up to 18 digits in its path; null without one."""
    return F.try_to_number(F.regexp_extract(path, "([0-9]{1,18})[^0-9]*$", 1), F.lit("9" * 18)).cast("bigint")


def _frequent(labelled: DataFrame, least: int) -> DataFrame:
    """token, item, freq of the tokens in `least` labelled(row, tokens) or more; tokens of the same rows share an item."""
    each = labelled.select("row", F.explode("tokens").alias("token"))
    rows = F.struct(F.count("*").alias("freq"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    counted = each.groupBy("token").agg(rows.alias("rows")).where(F.col("rows.freq") >= least)
    items = counted.groupBy("rows").agg(F.min("token").alias("item"), F.collect_list("token").alias("token"))
    return items.select(F.explode("token").alias("token"), "item", F.col("rows.freq").alias("freq"))


def _itemsets(rows: DataFrame, least: int, n: int) -> DataFrame:
    """items, freq of the combinations of up to MOST_TOKENS items, with and without a label, that `least` rows(items) or
    more of n have."""
    support = min(1.0, (least - 0.5) / n)
    if rows.agg(F.max(F.size("items"))).first()[0] <= LONG_ROW + 1:
        sets = FPGrowth(itemsCol="items", minSupport=support).fit(rows).freqItemsets
    else:
        ordered = rows.select(F.transform(F.array_sort("items"), lambda x: F.array(x)).alias("sequence"))
        sets = PrefixSpan(minSupport=support, maxPatternLength=MOST_TOKENS + 1).findFrequentSequentialPatterns(ordered)
        sets = sets.select(F.flatten("sequence").alias("items"), "freq")
    return sets.where(F.size(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD)))) <= MOST_TOKENS)


def beats_chance(both: Column, n: Column, of_label: Column, rows: int, deviations: float = DEVIATIONS) -> Column:
    """Whether `both` of a rule's n URLs have its label too often for the label's share, of_label in rows."""
    gain = both.cast("double") * F.lit(float(rows)) - n.cast("double") * of_label
    return (gain > 0) & (gain * gain > n.cast("double") * of_label * (float(rows) - of_label) * F.lit(float(deviations**2)))


def mine(
    spark: SparkSession, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, deviations: float = DEVIATIONS
) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, label, confidence in millionths, n, rarest) from labelled(row, tokens, bad), and their items' tokens
    (token, item).

    Tokens that always stand together are one item, named by the first of them: a rule holds of either alike.
    """
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not n:
        return spark.createDataFrame([], _RULES_SCHEMA), spark.createDataFrame([], "token string, item string")
    least = max(min_count, math.ceil(min_support * n))
    frequent = materialise(spark, _frequent(labelled, least), "url-tokens")
    own = labelled.select("row", "bad", F.explode_outer("tokens").alias("token")).join(frequent, "token", "left")
    rows = own.groupBy("row").agg(F.max("bad").alias("bad"), F.collect_set("item").alias("items"))
    rows = rows.select(F.array_append("items", F.when(F.col("bad"), F.lit(BAD)).otherwise(GOOD)).alias("items"))
    sets = materialise(spark, _itemsets(materialise(spark, rows, "url-rows"), least, n), "url-itemsets")
    label = F.when(F.array_contains("items", BAD), BAD).when(F.array_contains("items", GOOD), GOOD)
    plain = F.array_sort(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD))))
    sets = sets.select(plain.alias("tokens"), label.alias("label"), "freq").where(F.size("tokens") > 0)
    both = sets.where("label is not null").withColumnRenamed("freq", "both")
    rules = both.join(sets.where("label is null").select("tokens", F.col("freq").alias("n")), "tokens")
    of_label = F.when(F.col("label") == BAD, F.lit(float(bad))).otherwise(float(n - bad))
    rules = rules.where((F.col("both") >= min_confidence * F.col("n")) & beats_chance(F.col("both"), F.col("n"), of_label, n, deviations))
    confidence = F.floor(F.col("both") * 1_000_000 / F.col("n") + 0.5).cast("bigint")
    single = frequent.select(F.col("item").alias("t"), "freq").distinct()
    parts = rules.select("tokens", F.explode("tokens").alias("t")).distinct().join(single, "t")
    rarest = parts.groupBy("tokens").agg(F.min_by("t", F.struct("freq", "t")).alias("rarest"))
    rules = materialise(spark, rules.join(rarest, "tokens").select("tokens", "label", confidence.alias("confidence"), "n", "rarest"), "url-rules")
    return rules, frequent.join(rules.select(F.explode("tokens").alias("item")).distinct(), "item").select("token", "item")


def label_urls(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """row, tokens, bad: the rows of parts(page_id, path, tokens) that show a document of labels(doc_id, quality, toxic)."""
    is_bad = F.coalesce(F.min("quality") == 0, F.lit(False)) | F.coalesce(F.max("toxic") == 1, F.lit(False))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("shown")).agg(is_bad.alias("bad"))
    own = parts.where("page_id is not null").select(F.col("page_id").alias("row"), "tokens", shown_document(F.col("path")).alias("shown"))
    return own.where("shown is not null").join(marks, "shown").groupBy("row").agg(F.max("tokens").alias("tokens"), F.max("bad").alias("bad"))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict, and of the mined rule that decides its label, confidence (millionths) and n.

    Of the mined rules that hold, those of the bad label go before the others, then the most confident, then the one of
    most labelled URLs.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    own = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    parts = own.select("page_id", "url", "path", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined, items = mine(spark, materialise(spark, label_urls(parts, labels), "url-labels"), **limits)
    index = mined.select(F.col("rarest").alias("t"), F.col("tokens").alias("needs"), "label", "confidence", "n")
    # A URL is judged once, however many pages have it.
    asked = parts.where("url is not null").select("url", "tokens").dropDuplicates(["url"])
    asked = asked.select("url", F.explode("tokens").alias("token")).join(items, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    met = asked.select("url", "items", F.explode("items").alias("t")).join(index, "t").where(F.size(F.array_except("needs", "items")) == 0)
    decides = F.max(F.struct((F.col("label") == BAD).alias("bad"), "confidence", "n")).alias("m")
    best = met.groupBy("url").agg(decides).select("url", F.when(F.col("m.bad"), BAD).otherwise(GOOD).alias("mined"), "m.confidence", "m.n")
    best = materialise(spark, best, "url-matches")

    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("mined") == BAD, "block").otherwise("allow")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        rule = F.when(fits(h, p), h + p).otherwise(rule)
        verdict = F.when(fits(h, p), v).otherwise(verdict)
    return own.join(best, "url", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "mined", "confidence", "n")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
