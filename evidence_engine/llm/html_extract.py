"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between block-level tags, with the open elements above them. Each
block has binary features of its ancestors (tags and the words of their class, id and role), of its text (length, links,
punctuation, letters, cue words, place), of its neighbours, and of how it stands to the page's main container, if there
is one. The field has two labels, main and other, learned transitions between neighbouring blocks, is trained by gradient
ascent on the likelihood of labelled pages, and is decoded by Viterbi.

The labelled pages are built here by a seeded generator of page layouts: articles in containers, straight in the body, in
layout tables and in nameless divs, or alone in the page, in several alphabets, amid menus, headers, footers, sidebars, notices, adverts, forms,
comments and related links, with sloppy mark-up; none of them comes from the input.

Reading is linear in the page, however deep its elements nest. Of the words of class, id and role, the innermost
MOST_MARKS count as features; text is never left out for length or depth.

Defined cases: a null or empty page has an empty text; scripts, styles, templates, drawings and comments are no text;
unclosed and stray tags are repaired as browsers do, but for a drawing or template without an end, which hides nothing;
<br> is white space inside its block; bytes that are no UTF-8 are read as U+FFFD; repeated rows each get their row; other
columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import table, text_slices, texts_of

# HTML's element classes. Content of _RAW is no mark-up and no text; that of _HIDDEN is mark-up that isn't
# part of the page's text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea iframe noembed noframes".split())
_HIDDEN = frozenset("svg template".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
_CLOSES_P = _BLOCK - frozenset("button body html head caption tbody td tfoot th thead tr optgroup option select legend title".split())
_P_STOPS = "button table td th caption".split()
_SIBLINGS = {
    name: (closed.split(), stops.split())
    for name, closed, stops in (
        ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"),
        ("option", "option", "select form"), ("tbody", "tbody thead tfoot tr td th", "table"), ("tfoot", "tbody thead tfoot tr td th", "table"),
    )
}
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
#: Where raw and hidden elements end; case is folded in A-Z alone, and the page searched as it is, so places are its own.
_ENDS_OF = {name: re.compile(f"</{name}", re.I | re.A) for name in _RAW | _HIDDEN}
_ATTR_STOP = re.compile("[>\"']")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words of class, id and role that count for a block, innermost first.
MOST_MARKS = 48


class Element(NamedTuple):
    """An open element: its name, its parent's, and of itself and all above it the tags and the innermost marks."""

    name: str
    parent: str
    tags: frozenset[str]
    marks: tuple[str, ...]


_ROOT = Element("none", "", frozenset(), ())


class Block(NamedTuple):
    text: str
    element: Element
    linked: int


def _below(above: Element, name: str, words: list[str]) -> Element:
    tags = above.tags if name in above.tags else above.tags | {name}
    marks = tuple(dict.fromkeys([*words, *above.marks]))[:MOST_MARKS] if words else above.marks
    return Element(name, above.name, tags, marks)


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, quoted values skipped; the page's end if there is none."""
    first = page.find(">", at)
    if first < 0:
        return len(page)
    i = at
    while (m := _ATTR_STOP.search(page, i)) is not None:
        if m.group() == ">":
            return m.start()
        close = page.find(m.group(), m.end())
        if close < 0 or page[m.start() - 1] != "=":
            if close < 0:
                return first
            i = m.end()
            continue
        i = close + 1
    return first


class _Reader:
    """The state of reading a page: open elements, where each name stands among them, and the text since the last block."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Element] = [_ROOT]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.buf: list[str] = []
        self.in_link, self.linked = False, 0

    def text(self, part: str) -> None:
        self.buf.append(part)
        if self.in_link:
            self.linked += len(part)

    def flush(self) -> None:
        if self.buf:
            text = " ".join(html.unescape("".join(self.buf)).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1], min(self.linked, len(text))))
            self.buf = []
        self.linked = 0

    def open(self, name: str, words: list[str]) -> None:
        self.places[name].append(len(self.stack))
        self.stack.append(_below(self.stack[-1], name, words))

    def innermost(self, names: list[str], stops: list[str] = ()) -> int:
        """The place of the innermost open element of names, unless one of stops is open within it; 0 if there is none."""
        at = lambda wanted: max((self.places[x][-1] for x in wanted if self.places.get(x)), default=0)
        found = at(names)
        return found if found > at(stops) else 0

    def close(self, place: int) -> None:
        self.flush()
        for element in self.stack[place:]:
            self.places[element.name].pop()
        del self.stack[place:]
        self.in_link = False


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; texts have their references decoded and white space made one space."""
    r, endless = _Reader(), set()
    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i:
            r.text(page[i:j])
        if j >= n:
            break
        if page.startswith("<!--", j):
            e = page.find("-->", j + 4)
            i = n if e < 0 else e + 3
            continue
        if page[j + 1 : j + 2] in ("!", "?"):
            e = page.find(">", j)
            i = n if e < 0 else e + 1
            continue
        m = _NAME.match(page, j + 1)
        if m is None:
            r.text("<")
            i = j + 1
            continue
        name = m.group().lower()
        e = _tag_end(page, m.end())
        i = e + 1
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                r.in_link = False
            elif name in _BLOCK:
                place = r.innermost([name])
                r.close(place) if place else r.flush()
            elif name == "br":
                r.text(" ")
        elif name in _RAW or name in _HIDDEN:
            # Once an end is missing it is missing further on, too, so no stretch is searched twice for one.
            if page[e - 1 : e] != "/" and name not in endless:
                end = _ENDS_OF[name].search(page, i)
                if end is not None:
                    after = page.find(">", end.end())
                    i = n if after < 0 else after + 1
                elif name in _RAW:
                    i = n
                else:
                    endless.add(name)
        elif name == "br":
            r.text(" ")
        elif name == "a":
            r.in_link = True
        elif name in _BLOCK:
            r.flush()
            r.in_link = False
            if name in _CLOSES_P and (place := r.innermost(["p"], _P_STOPS)):
                r.close(place)
            if name in _SIBLINGS and (place := r.innermost(*_SIBLINGS[name])):
                r.close(place)
            if name == "body" and (place := r.innermost(["head"])):
                r.close(place)
            if name != "hr":
                words = [w for g in _MARK.findall(page, m.end(), e) for w in _WORD.findall("".join(g).lower())] if e > m.end() else []
                r.open(name, words)
    r.flush()
    return r.blocks


#: Feature space of the field.
HASHED = 1 << 15
# Marks of a main container.
_CONTAINER = frozenset("content post entry article story main text body page primary".split())
_NAVIGATION = frozenset("nav header footer aside form head select menu dialog".split())
#: Cue words of what isn't main text.
_CUES = frozenset(
    "cookie cookies consent privacy policy subscribe newsletter copyright reserved rights comment comments reply share tweet menu login sign search advertisement"
    " sponsored promoted related archive categories tags home contact about next previous skip navigation follow".split()
)
_ENDS = frozenset(".!?:;…»”。！？")


@lru_cache(maxsize=200_000)
def _slot(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name.encode(), 7) % HASHED


def _holds(element: Element, kind: str) -> bool:
    if kind == "marked":
        return not _CONTAINER.isdisjoint(element.marks) and _NAVIGATION.isdisjoint(element.tags)
    return kind in element.tags


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed binary features of each block."""
    n = len(blocks)
    kind = next((k for k in ("article", "main", "marked") if any(_holds(b.element, k) for b in blocks)), "bare")
    above: dict[Element, list[int]] = {}
    own, out = [], []
    for b in blocks:
        size, words = len(b.text), b.text.count(" ") + 1
        share = 0 if not b.linked else 1 + min(3, 4 * b.linked // size)
        # Letters stand in for words where a script has no spaces.
        own.append((max(min(words, 64), min(size // 12, 64)).bit_length(), share))
    for i, b in enumerate(blocks):
        length, share = own[i]
        e = b.element
        if e not in above:
            names = [f"up:{t}" for t in e.tags]
            names += [f"in:{e.name}", f"path:{e.parent}/{e.name}", f"mark:{bool(e.marks)}", f"stands:{kind}:{kind != 'bare' and _holds(e, kind)}", f"{kind}:{e.name}"]
            names += [f"mark:{w}" for w in e.marks]
            above[e] = [_slot(x) for x in names]
        low = b.text.lower() if length <= 4 else ""
        prev, after = own[i - 1] if i else (0, 9), own[i + 1] if i + 1 < n else (0, 9)
        names = [
            f"link:{share}", f"words:{length}", f"link:{share}:{e.name}", f"{kind}:{length}:{share}", f"end:{b.text[-1] in _ENDS}", f"comma:{min(3, b.text.count(','))}",
            f"first:{i == 0}", f"last:{i == n - 1}", f"third:{3 * i // n}", f"copy:{'©' in b.text or 'copyright' in low}", f"cue:{min(2, len(_CUES.intersection(_WORD.findall(low))))}:{length}",
            f"prev:{kind}:{prev}", f"next:{kind}:{after}", "bias",
        ]
        out.append(above[e] + [_slot(x) for x in names])
    return out


class Field(NamedTuple):
    """Weights of the field: emissions[feature, label], transitions[from, to], start[label]; label 1 is main."""

    emissions: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _scores(field: Field, feats: list[list[int]]) -> np.ndarray:
    return np.array([field.emissions[f].sum(axis=0) for f in feats])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, feats: list[list[int]], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of a page's labels, its gradient by each block's scores, and that by the transitions."""
    s, n = _scores(field, feats), len(labels)
    fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
    fwd[0] = field.start + s[0]
    for t in range(1, n):
        fwd[t] = s[t] + _log_sum(fwd[t - 1][:, None] + field.transitions, 0)
    for t in range(n - 2, -1, -1):
        bwd[t] = _log_sum(field.transitions + (s[t + 1] + bwd[t + 1])[None, :], 1)
    z = _log_sum(fwd[-1], 0)
    gold = np.array(labels)
    pair = np.zeros((2, 2))
    if n > 1:
        pair -= np.exp(fwd[:-1, :, None] + field.transitions + (s[1:] + bwd[1:])[:, None, :] - z).sum(axis=0)
        np.add.at(pair, (gold[:-1], gold[1:]), 1)
    right = field.start[gold[0]] + s[np.arange(n), gold].sum() + field.transitions[gold[:-1], gold[1:]].sum()
    return float(right - z), np.eye(2)[gold] - np.exp(fwd + bwd - z), pair


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Stochastic gradient ascent (Adagrad) on the conditional log-likelihood of labelled block sequences."""
    field = Field(np.zeros((HASHED, 2)), np.zeros((2, 2)), np.zeros(2))
    past = Field(np.full((HASHED, 2), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6))
    order = random.Random(5)
    pages = [p for p in pages if p[0]]

    def step(k: int, at, grad: np.ndarray) -> None:
        grad = grad - decay * field[k][at]
        past[k][at] += grad**2
        field[k][at] += rate * grad / np.sqrt(past[k][at])

    for _ in range(epochs):
        order.shuffle(pages)
        for feats, labels in pages:
            _, diff, pair = likelihood(field, feats, labels)
            used, at = np.unique(np.concatenate(feats), return_inverse=True)
            each = np.repeat(diff, [len(f) for f in feats], axis=0)
            step(0, used, np.stack([np.bincount(at, each[:, y], len(used)) for y in (0, 1)], axis=1))
            step(1, slice(None), pair)
            step(2, slice(None), diff[0])
    return field


def viterbi(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> list[int]:
    """The labelling of the greatest score; ties go to the smaller label."""
    n = len(scores)
    if not n:
        return []
    s, (t00, t01), (t10, t11) = scores.tolist(), *transitions.tolist()
    a, b = start[0] + s[0][0], start[1] + s[0][1]
    back = []
    for x, y in s[1:]:
        a0, b0, a1, b1 = a + t00, b + t10, a + t01, b + t11
        back.append((int(b0 > a0), int(b1 > a1)))
        a, b = max(a0, b0) + x, max(a1, b1) + y
    out = [int(b > a)]
    for k in reversed(back):
        out.append(k[out[-1]])
    return out[::-1]


# The labelled pages. A private-use character marks main text while a page is built.
_KEY = "\ue000"
_ASIDE_MARKS = {
    "nav": "nav navbar menu navigation site-nav main-menu breadcrumbs breadcrumb",
    "header": "header site-header masthead banner top",
    "footer": "footer site-footer colophon bottom legal",
    "aside": "sidebar side aside widget related rail toc tags",
    "notice": "cookie cookie-notice notice consent alert gdpr popup modal newsletter",
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor",
    "comments": "comments comment comment-list respond reader-comments discussion replies",
    "share": "share social sharing buttons meta byline",
}
_PHRASES = {
    "notice": ["We use cookies on this site.", "By browsing you accept our privacy policy", "Subscribe to our newsletter"],
    "ad": ["Advertisement", "Sponsored", "Promoted content"],
    "share": ["Share this", "Follow us", "Tweet"],
    "comments": ["Comments", "3 comments", "Leave a reply"],
    "footer": ["All rights reserved.", "Copyright 2020", "Privacy policy | Contact"],
    "aside": ["Related", "Categories", "Archive", "Tags"],
    "nav": ["Skip to content", "Menu"],
    "form": ["Search", "Login", "Sign up to our newsletter"],
    "header": ["Home", "About us"],
}
#: Syllables of invented words; a page has one alphabet. The last is written without spaces.
_ALPHABETS = (
    "an be co de el fi go ha in jo ka lo mi no or pa qui re so ta un ver wo xi zu",
    "é ça où rê ñe ción ä öß ü ðe æ ış ğa ło że",
    "ва ко ли но по ра сто ть ши ю ея ост",
    "的 是 在 有 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们",
)


class _Layout:
    """One page of random layout."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.syllables = rng.choice((*_ALPHABETS[:1] * 5, *_ALPHABETS[1:])).split()
        self.dense = self.syllables[0] == _ALPHABETS[-1].split()[0]

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def link(self) -> str:
        word = self.word()
        return f'<a href="/{word}">{word.title() if self.rng.random() < 0.6 else word}</a>'

    def closing(self, tag: str) -> str:
        return f"</{tag}>" if self.rng.random() < 0.85 else ""

    def sentence(self, n: int) -> str:
        rng = self.rng
        words = [self.word() + ("," if rng.random() < 0.1 else "") for _ in range(n)]
        style = rng.random()
        if style < 0.05:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.1:
            words = [w + rng.choice(["***", "$$$", "%%%", " |", "&amp;"]) for w in words]
        if rng.random() < 0.15:
            k = rng.randrange(n)
            w = words[k]
            words[k] = rng.choice([f"<b>{w}</b>", f"<em>{w}</em>", f'<a href="/x">{w}</a>', f"<b>{w}", f"{w}<br>", f"<code>{w}</code>"])
        end = rng.choice(["。", "！", ""]) if self.dense else rng.choice([".", ".", ".", "!", "?", ""])
        return ("" if self.dense else " ").join(words).capitalize() + end

    def para(self, most: int = 9) -> str:
        return " ".join(self.sentence(self.rng.randint(2, 14)) for _ in range(min(most, self.rng.choice([1, 1, 2, 3, 5, 9]))))

    def marked(self, kind: str, tags: str) -> tuple[str, str]:
        rng = self.rng
        tag, r = rng.choice(tags.split()), rng.random()
        mark = rng.choice(_ASIDE_MARKS[kind].split()) if tag in ("div", "section", "ul", "p", "span") or r < 0.5 else ""
        return tag, f'<{tag}{rng.choice([" class", " id"])}="{mark}">' if mark else f"<{tag}>"

    def links(self, least: int, most: int) -> str:
        return "".join(f"<li>{self.link()}" + self.closing("li") for _ in range(self.rng.randint(least, most)))

    def other(self, kind: str) -> str:
        """A part of the page that isn't main text."""
        rng = self.rng
        phrase = rng.choice(_PHRASES[kind]) if kind in _PHRASES else ""
        if kind == "nav":
            tag, head = self.marked("nav", "nav nav nav div ul")
            return f"{head}{f'<a href=#c>{phrase}</a>' if rng.random() < 0.2 else ''}<ul>{self.links(2, 9)}</ul></{tag}>"
        if kind == "header":
            tag, head = self.marked("header", "header header div")
            inner = rng.choice([f"<h1>{self.word()}</h1>", f"<p>{self.sentence(3)}</p>", self.link(), f"<div>{self.sentence(5)}</div>", phrase])
            return f"{head}{inner}{self.other('nav') if rng.random() < 0.3 else ''}</{tag}>"
        if kind == "footer":
            tag, head = self.marked("footer", "footer footer footer div")
            tail = rng.choice(["", chr(10) + self.sentence(6), phrase])
            return f"{head}{rng.choice(['&copy; ', 'Copyright ', ''])}{self.word()}.example.com {rng.choice(['&middot; ', ''])}{self.para() if rng.random() < 0.6 else self.link()}{tail}</{tag}>"
        if kind == "aside":
            tag, head = self.marked("aside", "aside aside div section")
            body = f"<p>{self.para()}</p>" if rng.random() < 0.5 else f"<ul>{self.links(4, 4)}</ul>"
            return f"{head}<h3>{rng.choice([phrase, self.sentence(2)])}</h3>{body}</{tag}>"
        if kind == "form":
            note = rng.choice(["", f"<p>{self.sentence(7)}</p>", f"<select><option>{self.word()}<option>{self.word()}</select>"])
            return f'<form action="/x"><label>{rng.choice([phrase, self.word()])}</label><input name="q">{note}<button>{self.word().title()}</button></form>'
        if kind == "comments":
            tag, head = self.marked("comments", "div section ul")

            def one() -> str:
                r = rng.random()
                if r < 0.6:
                    return f'<div class="comment"><span class="author">{self.word()}</span><p>{self.para()}</p></div>'
                return f"<li><p>{self.para()}</p></li>" if r < 0.8 else f"<p>{self.para()}</p>"

            return f"{head}<h3>{rng.choice([phrase, self.sentence(2)])}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        tag, head = self.marked(kind, "div div div section p" if kind != "share" else "div p ul")
        return f"{head}{rng.choice([self.para(), self.sentence(6), self.link(), phrase])}</{tag}>"

    def main_block(self) -> str:
        rng, r = self.rng, self.rng.random()
        if r < 0.70:
            return f"<p>{_KEY}{self.para()}{rng.choice(['', '', '', '<br>'])}" + self.closing("p")
        if r < 0.80:
            return f"<h{rng.randint(2, 4)}>{_KEY}{self.sentence(rng.randint(1, 6))}</h2>"
        if r < 0.85:
            return f"<blockquote><p>{_KEY}{self.para()}</p></blockquote>"
        if r < 0.91:
            return "<ul>" + "".join(f"<li>{_KEY}{self.sentence(rng.randint(2, 9))}" + self.closing("li") for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.94:
            # Sources, read on: items that are links through and through, within the article.
            return "<ul>" + "".join(f'<li><a href="/x">{_KEY}{self.sentence(rng.randint(2, 7))}</a>' + self.closing("li") for _ in range(rng.randint(1, 4))) + "</ul>"
        if r < 0.97:
            return f"<pre>{_KEY}{self.sentence(5)}</pre>"
        return "<table>" + "".join(f"<tr><td>{_KEY}{self.word()}<td>{_KEY}{self.sentence(3)}</tr>" for _ in range(3)) + "</table>"

    def article(self, inside: str) -> str:
        rng = self.rng
        parts = [f"<h1>{_KEY}{self.sentence(rng.randint(1, 9))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            parts.append(self.main_block())
            if rng.random() < 0.08:
                parts.append(self.other(rng.choice(inside.split())))
        return "".join(parts)

    def others(self, kinds: str, most: int) -> list[str]:
        return [self.other(k) for k in self.rng.sample(kinds.split(), self.rng.randint(0, most))]

    def contained(self) -> list[str]:
        rng = self.rng
        body = self.others("notice nav header ad aside form share", 5)
        options = [("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "article-body"), ("section", "entry"), ("div", "story")]
        tag, mark = rng.choice(options)
        text = self.article("ad share form aside notice")
        if rng.random() < 0.15:
            text += self.other("comments")
        if rng.random() < 0.25:
            text = f"<div>{text}</div>"
        inner = f'<{tag} class="{mark}">{text}</{tag}>' if mark else f"<{tag}>{text}</{tag}>"
        body.append(f"<main>{inner}</main>" if rng.random() < 0.3 else inner)
        tail = [k for k in ("comments", "aside", "share", "ad", "form", "notice", "nav") if rng.random() < 0.25]
        rng.shuffle(tail)
        return body + [self.other(k) for k in tail]

    def bare(self) -> list[str]:
        """Main text straight in the body, or in divs without a name."""
        rng = self.rng
        wrap = rng.random()
        text = self.article("ad share form aside notice") if wrap < 0.6 else f'<div{rng.choice(["", f" class=x{rng.randint(1, 99)}"])}>{self.article("ad share")}</div>'
        return self.others("notice nav header ad form", 3) + [text] + self.others("comments aside share ad form nav", 2)

    def in_table(self) -> list[str]:
        """A layout table: links in one cell, main text in another."""
        rng = self.rng
        side = f"<td width=120>{'<br>'.join(self.link() for _ in range(rng.randint(2, 7)))}</td>"
        text = f"<td>{self.article('ad share')}</td>"
        row = [side, text] if rng.random() < 0.7 else [text, side]
        head = f"<tr><td colspan=2>{self.link()} | {self.link()}</td></tr>" if rng.random() < 0.5 else ""
        return [f"<table>{head}<tr>{''.join(row)}</tr></table>"]

    def alone(self) -> str:
        """Nothing but main text: a block or two in a page without anything else, or a text without a tag."""
        rng = self.rng
        text = rng.choice([self.para, lambda: self.sentence(rng.randint(1, 14))])
        body = rng.choice([
            lambda: f"{_KEY}{text()}", lambda: f"<p>{_KEY}{text()}</p>", lambda: f"<h1>{_KEY}{self.sentence(4)}</h1><p>{_KEY}{text()}</p>", lambda: f"<div>{_KEY}{text()}</div>",
            lambda: f"<article><p>{_KEY}{text()}</p></article>", lambda: f"<main>{_KEY}{text()}</main>", lambda: f"<p>{_KEY}{text()}<p>{_KEY}{text()}", lambda: f"<pre>{_KEY}{text()}</pre>",
        ])()
        return rng.choice([body, body, f"<body>{body}</body>", f"<html><body>{body}</body></html>", f"<html><head><title>{self.sentence(4)}</title></head><body>{body}</body></html>"])

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.12:
            return self.alone()
        body = rng.choice([self.contained, self.contained, self.contained, self.bare, self.bare, self.in_table])()
        if rng.random() < 0.85:
            body.append(self.other("footer"))
        glue = rng.choice(["", "\n", '<script>var a="</p>";</script>', "<!-- x <p>no</p> -->"])
        head = f"<head><title>{self.sentence(4)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{glue.join(body)}{rng.choice(['</body></html>', ''])}"


def labelled_pages(count: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of `count` generated pages."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        blocks = leaf_blocks(_Layout(rng).page())
        labels = [int(_KEY in b.text) for b in blocks]
        out.append(([b._replace(text=b.text.replace(_KEY, "").strip() or "x") for b in blocks], labels))
    return out


#: Generated pages that the field is trained on.
TRAINED_ON = 1200


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return train([(features(b), y) for b, y in labelled_pages(TRAINED_ON, seed=11)])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    labels = viterbi(_scores(field, features(blocks)), field.transitions, field.start)
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def _extract_side(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch, "html"):
                texts = [main_text(x.decode("utf-8", "replace"), field) if x else "" for x in texts_of(batch, s, e, "html")]
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """page_id, url, text (main blocks in page order, one a line), n_chars (code points) of every page."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_extract_side(field or trained_field()), "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
