"""Section types of headings and texts against a loop over all phrases."""

import random
import re

from pyspark.sql import functions as F

from evidence_engine.operators import sections


def plain(heading):
    out = heading.split("/")[-1].strip().lower().replace("（", "(").replace("）", ")")
    for pattern in sections.NUMBERING:
        out = re.sub(pattern, "", out)
    return re.sub(r"\s+", " ", out).strip()


def by_loop(path, text):
    head = plain(path or "").replace("ﬁ", "fi").replace("ﬂ", "fl")
    head = next((other for fragment, other in sections.INSTEAD if fragment in head), head)
    every = [(p, kind) for kind, ps in sections.PHRASES.items() for p in ps]
    for phrase, kind in sorted(every, key=lambda x: -len(x[0])) if head else []:
        k = plain(phrase)
        numbered = re.match(rf"(?:[0-9]+(?:[.][0-9]+)*|[ivxlcdm]+)[.)]?\s+{re.escape(k)}(?:$|\b)", head)
        if head == k or numbered or (head.endswith(" " + k) and re.match(r"[0-9]+([.][0-9]+)*\s", head)):
            return kind
    sample = (text or "").strip().lower()[:160]
    return next((kind for kind, opening in sections.OPENINGS if re.match(opening, sample)), "paragraph")


def test_section_types_match_a_loop(spark):
    draw = random.Random(11)
    every = [p for ps in sections.PHRASES.values() for p in ps]
    numbers = ["", "1 ", "1. ", "2.3 ", "IV. ", "第三章 ", "（五）", "三、", "1) 2 ", "(2) 3.1 ", "(1) ii) ", "(1) 2. "]
    rows = [(draw.choice(numbers) + draw.choice(every).title(), "") for _ in range(400)]
    rows += [(draw.choice(numbers) + draw.choice(["", "other ", "our "]) + draw.choice(every) + draw.choice(["", " of tests", "s", "-x", "方"]), draw.choice(["", "x"])) for _ in range(600)]
    rows += [("A / B / 2 Method", ""), ("Naive Bayes Classiﬁer", ""), ("x", "Results are here"), ("", "  参考文献 [1]"), ("", "plain"), (None, None), ("", ""), ("y" * 100_000, "z" * 100_000), ("A /", "method x")]
    rows += [("On interpreting models now", ""), ("applying softmax in logistic regression", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, text string")
    got = {r.i: r.kind for r in df.select("i", sections.section_type(F.col("path"), F.col("text")).alias("kind")).collect()}
    for i, (path, text) in enumerate(rows):
        assert got[i] == by_loop(path, text), (path, text)
    assert len(set(got.values())) == 8


def test_each_phrase_names_its_type(spark):
    rows = [(p, kind) for kind, ps in sections.PHRASES.items() for p in ps]
    df = spark.createDataFrame(rows, "path string, kind string")
    assert df.where(sections.section_type(F.col("path"), F.lit("")) != F.col("kind")).collect() == []


def test_sql_agrees(spark):
    import duckdb

    rows = [(f"{n}{p}{t}", "") for n in ("", "2 ", "(1) 2. ", "(2) 3.1 our ") for p in ("Results", "softmax", "related work", "模型设定", "results and discussion") for t in ("", " of x", "方")]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (path VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = con.execute(f"SELECT path, {sections.section_type_sql('path', 'text')} FROM t").fetchall()
    assert len(got) == len(rows) and all(kind == by_loop(path, "") for path, kind in got)
