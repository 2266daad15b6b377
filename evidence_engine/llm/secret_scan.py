"""Secret scans over an incremental blob ledger, with DataFrame functions only.

A blob is a distinct text, named by its SHA-256. The ledger keeps one row for each blob and rule version that was
scanned, with the spans found (none is a row as well), in parts by the blob's name. A run looks up which pairs of its
blobs and its rules are not in the ledger, reading only the parts that its own blobs lie in; it fetches one copy of each
blob that has such a pair, scans it with the missing rules, appends to the ledger, and joins the findings back to every
path that holds the blob.

A rule is a kind, a version, a pattern, the group whose length counts, and the least length. Patterns match leftmost
and without overlap; shorter matches are dropped after matching. Spans are code points, the end excluded. Work on a text
grows with its length and its matches, not with their product.

Defined cases: a null text is an empty one; a null path is a path; repeated rows each get their row, and rows of one path
with different texts each the spans of their own text; an empty table gives an empty result; equal starts are in the
order of the rules; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import discard, free_shuffles, materialise, scratch_path, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The contract's three kinds.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, "[0-9a-f]+", 0, 32),
)
#: Kinds that are added to the contract's.
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", 1, "gh[opsu]_[A-Za-z0-9]+", 0, 36),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
)
RULES = BASE + MORE
#: What a text must hold for a rule to match at all, as a cheaper first test.
_HINTS = {"assign": "(?i:password|passwd|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "pem": "PRIVATE KEY-----", "forge": "gh[opsu]_", "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ"}
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Parts of a ledger.
PARTS = 16
LEDGER = f"blob binary, kind string, version int, spans {SPANS}, part int"
#: Matches whose places are summed up in one go; a text of more matches is summed up by blocks of so many.
_BLOCK = 256


def _places(sizes: Column, least: int) -> Column:
    """Spans of the matches of sizes(gap, size, part) whose part has the least length.

    A match starts behind all gaps up to it and all matches before it. Sums run within blocks, and over the blocks, as an
    array that grows by one element at a time is copied each time.
    """
    none = F.array().cast(SPANS)
    reach = lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda k: F.slice(sizes, k * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda at, x: at + reach(x)))
    before = F.aggregate(sums, F.array(zero), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))

    def within(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["size"]).cast("bigint").alias("end"))
            out = F.when(x["part"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
            return F.struct((acc["at"] + reach(x)).alias("at"), out.alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), F.slice(before, F.lit(1), F.size(blocks)).alias("at")), lambda z: within(z["block"], z["at"])))


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in text, in order: from the gaps between the matches and the matches' lengths."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    # A match alone matches as it did in the text, so its group needs no second search of the text.
    part = (lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group))) if rule.group else F.length
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(whole, part).alias("part"),
    )
    none, hint = F.array().cast(SPANS), _HINTS.get(rule.kind)
    found = F.coalesce(_places(sizes, rule.least), none)
    return F.when(text.rlike(hint), found).otherwise(none) if hint else found


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _versions(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    own = versions.select(F.col(path_col).cast("long").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.withColumn("blob", blob_of(F.col("text")))


def _part(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(PARTS)).cast("int")


def _ledger_of(spark: SparkSession, ledger: str, blobs: DataFrame, active: Column) -> DataFrame | None:
    """The rows of the ledger for these blobs and rules; None if there is no ledger yet."""
    if not _exists(spark, ledger):
        return None
    # The parts are at most PARTS numbers, so this list is bounded.
    parts = [r[0] for r in blobs.select(_part(F.col("blob"))).distinct().collect()]
    rows = spark.read.schema(LEDGER).parquet(ledger).where(F.col("part").isin(parts))
    wanted = F.array_contains(active, F.struct(F.col("kind"), F.col("version")))
    return rows.where(wanted).join(blobs.select("blob"), "blob", "left_semi")


def scan_blobs(spark: SparkSession, own: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of the blobs of own(path, text, blob) that hold any, see scan_versions."""
    ledger = ledger or scratch_path(spark, "secret-ledger")
    active = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    blobs = materialise(spark, own.groupBy("blob").agg(F.min("path").alias("holder")), "secret-blobs")
    seen = _ledger_of(spark, ledger, blobs, active)
    if seen is None:
        missing = blobs.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        known = seen.groupBy("blob").agg(F.collect_set("kind").alias("known"))
        kinds = F.array_except(F.array(*(F.lit(r.kind) for r in rules)), F.coalesce("known", F.array().cast("array<string>")))
        missing = blobs.join(known, "blob", "left").select("blob", "holder", kinds.alias("kinds")).where(F.size("kinds") > 0)
    # The small side is hashed, so the texts are not sorted for this join.
    held = missing.withColumnRenamed("blob", "want").hint("shuffle_hash")
    due = lambda r: F.isnull("kinds") | F.array_contains("kinds", r.kind)
    found = F.array(*(F.when(due(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules))
    scanned = own.join(held, own.path.eqNullSafe(held.holder) & (own.blob == held.want)).select("blob", F.array_compact(found).alias("found"))
    # Rows of one path and one text are one blob's; it is scanned once for all of them.
    rows = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.*").dropDuplicates(["blob", "kind"])
    rows = rows.select("blob", "kind", F.col("version").cast("int"), "spans", _part(F.col("blob")).alias("part"))
    rows.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(ledger)
    known = _ledger_of(spark, ledger, blobs, active)
    hits = known.where(F.size("spans") > 0).groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
    place = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind"))
    named = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place.alias("no"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("s"))
    out = materialise(spark, named.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans")), "secret-findings")
    discard(spark, blobs)
    return out


def scan_versions(spark: SparkSession, versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, spans: array of (start, no, end, kind), sorted by start and the kind's place in rules, for every row.

    ledger: a folder that later runs go on with; None starts a new one in the shared folder.
    """
    own = _versions(versions, path_col, text_col)
    by_blob = scan_blobs(spark, own, ledger, rules)
    return own.select("path", "blob").join(by_blob, "blob", "left").select("path", F.coalesce("spans", F.array().cast(by_blob.schema["spans"].dataType)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by two runs over one ledger: the first with the contract's rules, the second with all,
    so it scans the texts for the added rules alone and takes the first run's spans from the ledger."""
    versions, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")
    scan_blobs(spark, _versions(versions, "doc_id", "text"), ledger, BASE)
    free_shuffles(spark)  # the first run's texts
    found = scan_versions(spark, versions, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("spans", lambda s: s["no"] <= len(BASE)))
    return found.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def cut_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every span of a secret replaced by its kind in brackets; rows and columns stay as they are.

    A row is cut by the spans of its own text, whatever its id: rows without an id and rows that share one are cut
    alike. A null or clean text stays as it is, repeated rows stay, spans that overlap are cut as one, named by the
    first of them, and docs may have columns of any names beside doc_id and text.
    """
    found = scan_blobs(spark, _versions(docs, "doc_id", "text")).withColumnRenamed("blob", "b")
    text = F.col("r.text")

    def merge(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")))
        apart = F.array_append(out, F.struct(s["start"], s["end"], s["kind"]))
        return F.when((F.size(out) > 0) & (s["start"] < F.try_element_at(out, F.lit(-1))["end"]), wider).otherwise(apart)

    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    piece = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    zero = F.lit(0).cast("bigint")
    ends = F.concat(F.array(zero), F.transform("m", lambda s: s["end"]))
    kept = F.transform("m", lambda s, i: F.concat(piece(F.element_at(ends, i + 1), s["start"]), F.lit("["), s["kind"], F.lit("]")))
    tail = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.lit(2**31 - 1))
    cut = F.when(F.size("m") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), blob_of(F.coalesce("text", F.lit(""))).alias("b")).join(found, "b", "left")
    rows = rows.select("r", F.when(F.col("spans").isNotNull(), F.aggregate("spans", none, merge)).alias("m"))
    return rows.select(*(cut.alias(c) if c == "text" else F.col("r")[c].alias(c) for c in docs.columns))
