"""What kind of section a heading opens, by a dictionary of phrases, or a text by its first words; Columns only.

A heading is looked up as a whole, and, if a number stands before it, by all its beginnings that end at a word's end and
by all its ends that begin after a blank. Each lookup is one look into a map, whatever the number of phrases; of those
that are found the longest phrase counts.

Defined cases: a null heading or text is empty; an empty heading leaves the decision to the text; an empty text, or one
whose first words are no opening, is a paragraph.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx

# Section types by heading, openings of texts, numbering, and headings that stand for another.
PHRASES = {
    "abstract": ("abstract", "摘要", "中文摘要", "英文摘要"),
    "introduction": ("introduction", "intro", "引言", "绪论", "选题背景", "研究意义", "研究背景", "研究内容", "研究内容与方法", "技术路线图", "可能的创新点"),
    "related_work": ("related work", "background", "preliminaries", "相关工作", "文献综述", "国内外研究现状", "研究现状", "理论基础", "概念界定", "概念界定与相关理论基础", "文献述评", "相关研究"),
    "method": (
        "method", "methods", "methodology", "materials and methods", "approach", "optimization models", "naive bayes classifier", "model", "models", "svm classification technique",
        "classification with logistic regression", "sentiment classification", "classification tasks and features", "softmax", "feature modeling", "feature classification",
        "方法", "研究方法", "方法设计", "模型", "模型构建", "模型设计", "算法", "算法设计", "系统设计", "总体设计", "方案设计", "指标构建", "评价指标体系构建原则", "数字经济发展水平指标构建",
        "指标选取", "样本选取", "数据预处理", "测算过程", "模型设定", "变量选择与数据来源", "模型、变量及数据说明", "直接效应", "间接效应", "研究假设", "机制检验", "调节效应",
        "系统架构与关键技术", "多智能体作文评分系统框架设计", "系统整体架构", "基于 agent 协作机制", "基于agent协作机制", "问题描述与方法概述", "多智能体强化学习控制方法",
        "多智能体协调控制与流程设计", "多智能体状态空间与协调策略", "物理信息神经网络",
    ),
    "experiment": (
        "learning in logistic regression", "gradient descent", "stochastic gradient descent algorithm", "mini-batch training", "numerical experiments", "results and discussion",
        "experiment", "experiments", "experimental setup", "evaluation", "results", "result", "results and discussions", "discussion", "training",
        "实验", "实验设计", "实验结果", "实验分析", "结果", "结果分析", "结果与分析", "实验结果与分析", "消融实验", "性能评估", "实证分析", "实证结果分析", "变量描述性统计", "多重共线性检验",
        "基准回归结果分析", "稳健性检验", "异质性分析", "收入水平异质性", "产品异质性", "区域异质性", "测算结果分析", "国家层面分析", "区域层面分析", "出口规模", "产品结构", "贸易现状分析",
        "试验结果与分析", "试验设置", "性能对比分析", "传统pid 方法", "模糊pid 方法", "实验设计与结 果分析", "数据集", "实验环境与配置", "评价指标",
    ),
    "conclusion": ("结束语", "结语", "conclusions", "结论", "总结", "总结与展望", "结论与展望"),
    "reference": ("参考文献", "references", "reference", "bibliography", "参考资料", "致谢"),
}
OPENINGS = (
    ("abstract", "abstract|摘要|中文摘要|英文摘要"),
    ("introduction", "introduction|intro|引言|绪论|选题背景|研究意义|研究背景|研究内容|研究内容与方法|技术路线图|可能的创新点"),
    ("related_work", "related work|background|preliminaries|相关工作|相关研究|文献综述|国内外研究现状|研究现状|理论基础|概念界定|文献述评"),
    ("method", "method|methods|methodology|materials and methods|方法|研究方法|方法设计|问题描述与方法概述|多智能体强化学习控制方法|多智能体协调控制与流程设计|多智能体状态空间与协调策略|物理信息神经网络|多智能体作文评分系统框架设计|模型构建|模型设计|算法设计|系统设计|系统架构|系统整体架构|关键技术|基于 agent 协作机制|方案设计|指标构建|样本选取|数据预处理|测算过程|模型设定|变量选择|直接效应|间接效应|研究假设|机制检验|调节效应"),
    ("experiment", "experiment|experiments|evaluation|results?|results and discussions|实验|试验|实验设计|实验设计与分析|试验结果与分析|试验设置|性能对比分析|传统pid 方法|模糊pid 方法|实验环境|评价指标|数据集|实验结果|实验分析|结果|结果分析|结果与分析|实验结果与分析|消融实验|性能评估|实证分析|实证结果分析|变量描述性统计|多重共线性检验|基准回归|稳健性检验|异质性分析|测算结果分析|出口规模|产品结构|区域结构"),
    ("conclusion", "conclusions?|结论|总结|结束语|结语|总结与展望|结论与展望"),
    ("reference", "references|bibliography|参考文献|参考资料|致谢"),
)
NUMBERING = (
    r"^第\s*[0-9一二三四五六七八九十百]+\s*[章节篇部分]\s*",
    r"^[\s0-9.ivxlcdm一二三四五六七八九十百]+[.)、:-]?\s*",
    r"^\([\s0-9一二三四五六七八九十百]+\)\s*",
)
INSTEAD = (
    ("classification with logistic regression", "classification with logistic regression"),
    ("sentiment classification", "sentiment classification"),
    ("other classification tasks and features", "classification tasks and features"),
    ("applying softmax in logistic regression", "softmax"),
    ("features in multinomial logistic regression", "classification tasks and features"),
    ("learning in multinomial logistic regression", "learning in logistic regression"),
    ("stochastic gradient descent algorithm", "stochastic gradient descent algorithm"),
    ("interpreting models", "method"),
    ("naive bayes classifier", "naive bayes classifier"),
    ("results and discussion", "results and discussion"),
)
NUMBERED = r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)[.)]?\s+"
DECIMAL = r"^[0-9]+(?:\.[0-9]+)*\s"
SAMPLE = 160


def _plain(heading: str) -> str:
    """A phrase as headings are compared: numbering cut off, which takes leading letters of Roman numbers, too."""
    out = heading
    for pattern in NUMBERING:
        out = re.sub(pattern, "", out)
    return re.sub(r"\s+", " ", out).strip()


def phrases() -> dict[str, tuple[int, str]]:
    """The length and type of each phrase, by its compared form; of phrases with one form the longest."""
    every = sorted(((len(p), kind, p) for kind, ps in PHRASES.items() for p in ps), key=lambda x: x[0])
    return {_plain(p): (n, kind) for n, kind, p in every}


def plain_heading(section_path: Column) -> Column:
    """The last part of a section path, lower-cased, without numbering, ligatures undone."""
    out = tx.strip(F.lower(F.element_at(F.split(F.coalesce(section_path, F.lit("")), "/"), -1)))
    out = F.translate(out, "（）", "()")
    for pattern in NUMBERING:
        out = F.regexp_replace(out, pattern, "")
    out = tx.strip(F.regexp_replace(out, r"\s+", " "))
    return F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def section_type(section_path: Column, text: Column) -> Column:
    """The type by heading, else by the text's first words, else paragraph."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("n"), F.lit(x[1]).alias("kind")) for pair in phrases().items() for x in pair))
    plain = plain_heading(section_path)
    head = plain
    for fragment, other in reversed(INSTEAD):
        head = F.when(F.contains(plain, F.lit(fragment)), other).otherwise(head)

    def by_heading(h: Column) -> Column:
        rest = F.regexp_replace(h, NUMBERED, "")
        ends = lambda k: (k == F.length(rest)) | (F.substring(rest, k, F.lit(1)).rlike(r"[0-9A-Za-z_\p{L}\p{N}]") != F.substring(rest, k + 1, F.lit(1)).rlike(r"[0-9A-Za-z_\p{L}\p{N}]"))
        longest = max(map(len, phrases()))
        beginnings = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(rest), F.lit(longest)))), ends), lambda k: F.substring(rest, F.lit(1), k))
        words = F.split(h, " ")
        tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words))), lambda k: F.array_join(F.slice(words, k, F.size(words)), " "))
        none = F.array().cast("array<string>")
        tried = F.concat(F.array(h), F.when(h.rlike(NUMBERED), beginnings).otherwise(none), F.when(h.rlike(DECIMAL), tails).otherwise(none))
        return F.array_max(F.transform(tried, lambda x: F.try_element_at(known, x))).kind

    # The heading is worked out once, as an array of one, and not once for each mention of it.
    found = F.element_at(F.transform(F.array(head), by_heading), 1)
    sample = F.substring(F.lower(tx.strip(F.coalesce(text, F.lit("")))), 1, SAMPLE)
    by_text = F.lit("paragraph")
    for name, pattern in reversed(OPENINGS):
        by_text = F.when(sample.rlike(f"^(?:{pattern})"), name).otherwise(by_text)
    return F.coalesce(found, by_text)


def section_type_sql(path: str, text: str) -> str:
    """The same for DuckDB, where every phrase is compared with the heading."""
    plain = rf"translate(regexp_replace(lower(string_split({path}, '/')[-1]), '^\s+|\s+$', '', 'g'), '（）', '()')"
    for pattern in NUMBERING:
        plain = f"regexp_replace({plain}, '{pattern}', '')"
    plain = rf"replace(replace(regexp_replace(regexp_replace({plain}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    instead = " ".join(f"WHEN contains(p, '{fragment}') THEN '{other}'" for fragment, other in INSTEAD)
    rows = ", ".join(f"({n}, '{kind}', '{form}')" for form, (n, kind) in phrases().items())
    word = r"[0-9A-Za-z_\p{L}\p{N}]"
    head = f"(SELECT CASE {instead} ELSE p END FROM (SELECT {plain} AS p))"
    fits = rf"h = k OR (regexp_matches(h, '{NUMBERED}') AND starts_with(regexp_replace(h, '{NUMBERED}', ''), k) AND NOT regexp_matches(substring(regexp_replace(h, '{NUMBERED}', ''), length(k) + 1), '^{word}')) OR (regexp_matches(h, '{DECIMAL}') AND ends_with(h, ' ' || k))"
    opening = " ".join(f"WHEN regexp_matches(substring(lower({text}), 1, {SAMPLE}), '^(?:{pattern})') THEN '{name}'" for name, pattern in OPENINGS)
    return f"coalesce((SELECT arg_max(kind, n) FROM (SELECT {head} AS h), (VALUES {rows}) AS phrases(n, kind, k) WHERE {fits}), CASE {opening} ELSE 'paragraph' END)"
