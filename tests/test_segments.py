"""Blocks and paragraphs by windows against folds over lines in plain Python."""

import random
import re

from evidence_engine.operators import segments

PIECES = ["# A", "## B b", "### C", "###### D", "####### no", "#no", "```", "```python x", "``` sql", "| a | b |", "|a", "b|", "c | d |", "||", "Title", "A longer line of running text that goes on", "ends here.", "word",
          "结论", "第 2 章 方法", "一、x", "（三） y", "1. item", "2.3 item", "- dash", "* star", "12", "", "", "  ", "x\ty  z ", "Very Short", "is it?", "note:"]


def texts(n):
    draw = random.Random(5)
    return ["\n".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def clean(text):
    return re.sub(r"[\t ]+", " ", (text or "").replace("\r\n", "\n").replace("\r", "\n")).strip().split("\n")


def blocks_by_fold(text):
    out, path, kind, lines, lang = [], [], "", [], ""

    def close(tag=""):
        nonlocal kind, lines
        body = "\n".join(lines).strip()
        if kind and body:
            out.append((len(out), kind, body, " / ".join(path), 0, tag))
        kind, lines = "", []

    for line in (x.strip() for x in clean(text)):
        if line.startswith("```"):
            if kind == "code":
                close(lang)
            else:
                close()
                kind, lang = "code", re.match(r"```\s*([\w.+-]*)", line).group(1)
        elif kind == "code":
            lines.append(line)
        elif m := re.match(r"(#{1,6})\s+(.+)$", line):
            close()
            del path[len(m[1]) - 1 :]
            path.append(m[2])
            out.append((len(out), "heading", m[2], " / ".join(path), len(m[1]), ""))
        else:
            now = "table" if re.match(r"[|].*[|]$", line) else "paragraph" if line else ""
            if now != kind:
                close()
                kind = now
            lines.append(line)
    close()
    return out


def merged_by_fold(text):
    done, buf = [], ""
    for line in (x.strip() for x in clean(text)):
        if not line:
            done += [buf, ""] if buf else [""]
            buf = ""
            continue
        own = re.match(r"(#{1,6}|[-*+]|\d+([.]\d+)*[.)、]?)\s|第\s*[\d一二三四五六七八九十百]+\s*[章节篇部分]|[一二三四五六七八九十百]+[、.]|[(（][一二三四五六七八九十百]+[)）]", line)
        rows = any(re.match(r"[|].*[|]$", x) for x in (buf, line))
        title = len(buf) < 24 and re.match("[A-Z一-鿿][^。！？.!?]*$", buf)
        if buf and (buf[-1] in "。！？.!?:：；;" or own or rows or title):
            done.append(buf)
            buf = line
        else:
            buf = f"{buf} {line}" if buf else line
    return "\n".join([*done, buf]).strip()


def test_markdown_blocks_match_a_fold(spark):
    all_texts = texts(600) + ["", None, "```\n\n```", "```py\nx  = 1\n\n y", "# A\r\n### C\r### D\n## B\n#### E\ntext", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(all_texts)], "doc_id long, content string, kind string")
    got = {}
    for r in segments.markdown_blocks(docs).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.type, r.text, r.section_path, r.level, r.lang))
    for i, t in enumerate(all_texts):
        assert sorted(got.get(i, [])) == blocks_by_fold(t), t


def test_merged_lines_match_a_fold(spark):
    all_texts = texts(1500) + ["", None, "A long line of running text that\r\ngoes on here.\nNext sentence\n\nTitle Line\nbody starts", "some words before a list\n- one\n第一章 绪论\n| a | b |\nafter", "|a\nTitle\nb|\n|c\nd"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(all_texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in segments.merged_lines(docs).collect()}
    for i, t in enumerate(all_texts):
        assert got[i] == merged_by_fold(t), t
    assert got[1502] == "A long line of running text that goes on here.\nNext sentence\n\nTitle Line\nbody starts"
    assert got[1503] == "some words before a list\n- one\n第一章 绪论\n| a | b |\nafter"


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "# A\nx"), (1, "# A\nx"), (1, "y"), (None, "z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in segments.markdown_blocks(docs, "text").collect()) == [("1", "A"), ("1", "x"), ("1", "y"), ("None", "z")]
    assert sorted(r.text for r in segments.merged_lines(docs).collect()) == ["# A x", "y", "z"]
    assert segments.markdown_blocks(docs.limit(0), "text").collect() == [] and segments.merged_lines(docs.limit(0)).collect() == []
