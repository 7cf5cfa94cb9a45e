"""Markup residue in text blocks: parse, classify nodes, decode a kind that holds together, render clean text.

A block becomes a tree of nodes (HTML, Markdown, wiki and LaTeX constructs). Boosted trees over node features (subtree density,
attribute tokens, depth, sibling statistics) give each node a distribution over kinds; a bottom-up pass takes the kinds
of ancestors and descendants that are most probable together and do not contradict each other, where the nodes below a parent weigh as one.
Parsing, features and rendering walk the tree with stacks of their own, so that constructs may lie within each other at any depth.
The trees are fitted on constructs that are written here around a bounded sample of markup-free blocks (SAMPLE rows).

Defined results: null and empty texts have no markup; unclosed constructs count as markup of what they hold; a block's repeated rows count once.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.gbt import Boosted
from kiln.session import fine

KINDS = ["heading", "paragraph", "list", "code", "formula", "table", "image"]
INLINE = "inline"
CLASSES = [*KINDS, INLINE]
#: Markup-free blocks that the training constructs are written around, at most.
SAMPLE = 250

#: Tag names that count as HTML or wiki tags.
TAGS = set(
    "a abbr b big blockquote body br caption center cite code dd div dl dt em figure figcaption font footer h1 h2 h3 h4 h5 h6 head header hr html i img kbd li link main math meta nav nowiki ol p pre q ref s samp script "
    "section small source span strike strong style sub sup syntaxhighlight table tbody td tfoot th thead title tr tt u ul var references gallery blockquote poem".split()
)
_RAW = {"math", "pre", "code", "syntaxhighlight", "nowiki", "script", "style", "tt", "kbd", "samp"}
_MATH_ENV = r"equation|align|gather|multline|eqnarray|displaymath|math|split|cases|aligned"
#: Cheap test for rows that may hold markup at all; runs in the JVM.
MAYBE = r"[<>\\$`{}\[\]|~]|&[A-Za-z#]|''|==|\*|__|(?m)^\s*(?:[#:;>+-]|\d{1,3}[.)]) ?"

_PATTERNS: list[tuple[str, str, str]] = [
    ("html", "comment", r"<!--(?P<c0>[\s\S]*?)-->"),
    ("latex", "math_env", rf"\\begin\{{(?P<a1>(?:{_MATH_ENV})\*?)\}}(?P<c1>[\s\S]*?)(?:\\end\{{(?P=a1)\}}|\Z)"),
    ("latex", "code_env", r"\\begin\{(?P<a2>verbatim|lstlisting|minted|Verbatim)\*?\}(?P<c2>[\s\S]*?)(?:\\end\{(?P=a2)\*?\}|\Z)"),
    ("latex", "env", r"\\begin\{(?P<a3>[a-zA-Z]+)\*?\}(?P<c3>[\s\S]*?)(?:\\end\{(?P=a3)\*?\}|\Z)"),
    ("latex", "display", r"\\\[(?P<c4>[\s\S]*?)\\\]|\$\$(?P<c5>[\s\S]+?)\$\$"),
    ("latex", "math", r"\\\((?P<c6>[\s\S]*?)\\\)|(?<![\w\\$])\$(?P<c7>(?=[^$\n]*[\\^_={}])[^$\n]+?)\$(?![\w])|(?<=\w)\$(?P<c28>\^[^$\n]+?)\$"),
    ("md", "fence", r"^(?P<a8>```+|~~~+)[ \t]*(?P<b8>[\w+-]*)[ \t]*\n(?P<c8>[\s\S]*?)(?:\n?^(?P=a8)[ \t]*$|\Z)"),
    ("wiki", "table", r"\{\|(?P<b9>[^\n|]*)(?P<c9>[\s\S]*?)(?:\|\}|\Z)"),
    ("md", "table", r"^(?P<c10>[ \t]*\|[^\n]*\|[ \t]*\n[ \t]*\|[ \t:|-]*-[ \t:|-]*\|?[ \t]*(?:\n[ \t]*\|[^\n]*)*)"),
    ("md", "image", r"!\[(?P<c11>[^\]\n]*)\]\((?P<b11>[^)\n]*)\)"),
    ("wiki", "image", r"\[\[(?:File|Image|Datei|Bild|Файл|Изображение):(?P<c12>[^\]\n]*)\]\]"),
    ("wiki", "link", r"\[\[(?P<c13>[^\]\n]+)\]\]"),
    ("md", "link", r"\[(?P<c14>[^\[\]\n]+)\]\((?P<b14>[^()\s]+)\)"),
    ("wiki", "extlink", r"\[https?://\S+(?:\s+(?P<c15>[^\]\n]+))?\]"),
    ("wiki", "template", r"\{\{(?P<c16>[^{}]*)\}\}"),
    ("wiki", "heading", r"^[ \t]*(?P<a17>={1,6})[ \t]*(?P<c17>[^=\n][^\n]*?)[ \t]*(?P=a17)[ \t]*$"),
    ("md", "heading", r"^[ \t]{0,3}(?P<a18>#{1,6})[ \t]+(?P<c18>[^\n]+?)(?:[ \t]+#+)?[ \t]*$"),
    ("md", "setext", r"^(?P<c19>[^\n]+)\n(?:={3,}|-{3,})[ \t]*$"),
    ("md", "item", r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?P<c20>(?!\d+\s*[-–—]\s*$)[^\n]+)$"),
    ("wiki", "item", r"^(?!\*{1,3}[^\s*][^*\n]*\*)(?P<a21>[*#:;]+)[ \t]*(?P<c21>(?![-*#:;])[^\n]+)$"),
    ("md", "quote", r"^[ \t]*>[ \t]+(?P<c22>[^\n]+)$"),
    ("wiki", "bold", r"'{2,5}(?P<c23>[^'\n]+)'{2,5}"),
    ("md", "strong", r"\*\*(?P<c24>[^*\n]+?)\*\*|(?<!\w)__(?P<c25>[^_\n]+?)__(?!\w)|~~(?P<c26>[^~\n]+?)~~"),
    ("md", "em", r"(?<![\w*])\*(?P<c27>[^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<!\w)_(?P<c29>[^\s_](?:[^_\n]*[^\s_])?)_(?!\w)"),
    ("md", "code", r"(?<!`)`(?P<c30>[^`\n]+)`(?!`)"),
    ("latex", "image", r"\\includegraphics\*?(?:\[(?P<b31>[^\]]*)\])?\{(?P<c31>[^}]*)\}"),
    ("latex", "heading", r"\\(?P<a32>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\{(?P<c32>[^{}\n]*)\}"),
    ("latex", "item", r"\\item\b(?:\[[^\]]*\])?[ \t]*(?P<c33>[^\n\\]*(?:\\(?!item|end)[^\n\\]*)*)"),
    ("latex", "command", r"\\(?P<a34>[a-zA-Z]+)\*?(?:\[[^\]\n]*\])*\{(?P<c34>[^{}\n]*)\}~?"),
    ("latex", "macro", r"\\(?P<a35>[a-zA-Z]{2,})(?![a-zA-Z])|\\(?P<a36>[%&_#{}$,;!])"),
    ("html", "entity", r"&(?:[a-zA-Z]{2,8}|#\d{2,5}|#x[0-9a-fA-F]{2,5});"),
]
_MASTER = re.compile(r"(?P<tag><(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\s[^<>]*)?)/?>)|" + "|".join(f"(?P<m{i}>{p})" for i, (_, _, p) in enumerate(_PATTERNS)), re.M)
_INNER = [re.findall(r"\?P<(c\d+)>", p) for _, _, p in _PATTERNS]
_ATTRS = [re.findall(r"\?P<([ab]\d+)>", p) for _, _, p in _PATTERNS]


@dataclass
class Node:
    fmt: str
    tag: str
    attrs: str = ""
    source: str = ""
    inner: str = ""
    children: list = field(default_factory=list)
    start: int = 0
    end: int = 0
    #: What is left of the inside without the marks of the nodes in it, and what a reader sees of the node.
    bare: str = ""
    seen: str = ""

    @property
    def key(self) -> str:
        return f"{self.fmt}:{self.tag}"


_HTML = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)(/?)>")
_EMPTY = {"br", "hr", "img", "meta", "link"}
#: Constructs whose inside is no markup.
_CLOSED = {"math_env", "code_env", "display", "math", "fence", "code", "comment", "image", "entity", "template"}


def closers(text: str) -> dict[int, tuple[int, int]]:
    """Start of each opening tag -> span of the tag that closes it, in one pass: the balanced one, else the next of its name, for tags of raw text always the next."""
    out: dict[int, tuple[int, int]] = {}
    open_: dict[str, list[int]] = {}
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _HTML.finditer(text):
        name = m[2].lower()
        if name not in TAGS:
            continue
        if m[1]:
            ends.setdefault(name, []).append(m.span())
            stack = open_.get(name)
            if name in _RAW:
                for at in stack or ():
                    out[at] = m.span()
                open_[name] = []
            elif stack:
                out[stack.pop()] = m.span()
        elif name not in _EMPTY and not m[0].endswith("/>"):
            open_.setdefault(name, []).append(m.start())
    for name, stack in open_.items():
        spans = ends.get(name, [])
        for at in stack:
            i = bisect_left(spans, (at, at))
            if i < len(spans):
                out[at] = spans[i]
    return out


def parse(text: str) -> list[Node]:
    """The constructs of a text in order, each with its parsed inside."""
    root = Node("", "", inner=text)
    # Each entry: a node to parse the inside of, that inside, and where it starts in the text.
    work, closing = [(root, text, 0)], closers(text) if "<" in text else {}
    while work:
        parent, inside, base = work.pop()
        at = 0
        while m := _MASTER.search(inside, at):
            start, end = m.span()
            if m["tag"]:
                name, raw, where = m["name"].lower(), "", 0
                if name not in TAGS:
                    at = start + 1
                    continue
                close = closing.get(base + start)
                if close and close[1] <= base + len(inside):
                    raw, where, end = inside[end : close[0] - base], base + end, close[1] - base
                node = Node("html", name, m["attrs"], inside[start:end], raw, [], start, end)
                if raw and name not in _RAW:
                    work.append((node, raw, where))
                elif name == "pre" and (inner := re.fullmatch(r"\s*<code[^>]*>([\s\S]*?)(?:</code>)?\s*", raw)):
                    node.children, node.inner = [Node("html", "code", "", raw, inner[1], [], 0, len(raw))], inner[1]
            else:
                i = next(i for i in range(len(_PATTERNS)) if m[f"m{i}"] is not None)
                fmt, tag, _ = _PATTERNS[i]
                group = next((g for g in _INNER[i] if m[g] is not None), None)
                raw = m[group] if group else ""
                node = Node(fmt, tag, " ".join(m[g] for g in _ATTRS[i] if m[g]), m[0], raw, [], start, end)
                if tag == "env":
                    node.tag = "list_env" if node.attrs in ("itemize", "enumerate", "description") else "table_env" if node.attrs.startswith(("tab", "long")) else "image_env" if node.attrs == "figure" else "env"
                if raw and tag not in _CLOSED and raw != inside:
                    work.append((node, raw, base + m.start(group)))
            parent.children.append(node)
            at = max(end, start + 1)
    for n in reversed(preorder(root)):
        n.bare = strip(n.inner, n.children)
        n.seen = visible(n)
    return root.children


def preorder(root: Node) -> list[Node]:
    """A node and all below it, parents first, children in order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.children)
    return out


def visible(node: Node) -> str:
    """What a reader sees of a node, without its marks; the nodes below it are done."""
    if node.key in ("html:comment", "html:ref", "wiki:template", "latex:macro", "html:br", "html:hr"):
        return "\n" if node.tag == "br" else ""
    if node.tag == "entity":
        return html.unescape(node.source)
    if node.tag in ("math", "math_env", "display", "code", "fence", "code_env") and not node.children:
        return "" if node.tag == "math" and re.fullmatch(r"\^\{?[\d,\s]+\}?", node.inner) else node.inner.strip("\n")
    if node.key == "html:sup" and re.fullmatch(r"[\d,\s]+", node.inner):
        return ""
    if node.key == "html:img":
        return (re.search(r'alt="([^"]*)"', node.attrs) or [""])[0][5:-1]
    if node.key == "wiki:image":
        return node.inner.split("|")[-1]
    if node.key == "wiki:link":
        return node.inner.split("|")[-1]
    if node.key == "latex:image":
        return ""
    return node.bare


def strip(text: str, nodes: list[Node]) -> str:
    """Text with what a reader sees of the nodes in place of them."""
    out, at = [], 0
    for n in nodes:
        out += [text[at : n.start], n.seen]
        at = n.end
    return "".join([*out, text[at:]])


#: Tag tokens with a feature of their own; all others share one.
KEYS = sorted({f"{f}:{t}" for f, t, _ in _PATTERNS} | {"latex:list_env", "latex:table_env", "latex:image_env"} | {f"html:{t}" for t in "p h1 h2 h3 h4 h5 h6 ul ol li pre code table tr td th img math syntaxhighlight div span b i sup sub ref a figure br em strong blockquote".split()})
_KEY_AT = {k: i for i, k in enumerate(KEYS)}
_ATTR_TOKENS = ["class", "style", "src", "alt", "href", "lang", "wikitable", "width"]


#: Kinds that a tag stands for by its definition; anything else inside is inline.
_INNER_KIND = {
    "li": "list", "item": "list", "ul": "list", "ol": "list", "list_env": "list", "tr": "table", "td": "table", "th": "table", "table": "table", "table_env": "table", "pre": "code", "fence": "code", "code_env": "code", "syntaxhighlight": "code",
    "p": "paragraph", "div": "paragraph", "quote": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "heading": "heading", "setext": "heading", "display": "formula",
    "math_env": "formula", "img": "image", "image": "image", "figure": "image", "image_env": "image",
}


def features(text: str, seen: str, source: str, key: str, attrs: str, nodes: list[Node], depth: int, siblings: int, alike: float) -> np.ndarray:
    """Of one node: own tag, attribute tokens, depth, siblings, subtree density, share of the subtree under each child tag, shape of lines."""
    own, below = np.zeros(len(KEYS) + 1), np.zeros(len(KEYS) + 1)
    if key:
        own[_KEY_AT.get(key, len(KEYS))] = 1
    size = max(len(text), 1)
    for n in nodes:
        below[_KEY_AT.get(n.key, len(KEYS))] += (n.end - n.start) / size
    lines = [x for x in seen.split("\n") if x.strip()]
    n = max(len(seen), 1)
    outside = size - sum(x.end - x.start for x in nodes)
    general = [
        depth, len(nodes), siblings, alike, len(seen) / max(len(source), 1), np.log1p(len(seen)), len(lines), outside / size,
        sum(map(str.isdigit, seen)) / n, sum(map(seen.count, "=+^_\\{}/()")) / n, sum(map(str.isalpha, seen)) / n, sum(map(str.isupper, seen)) / n,
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(len(lines), 1), sum(x.startswith((" ", "\t")) for x in lines) / max(len(lines), 1), sum("|" in x or "&" in x for x in lines) / max(len(lines), 1), max((len(x) for x in lines), default=0),
        *(sum(x.end - x.start for x in nodes if _INNER_KIND.get(x.tag) == k) / size for k in KINDS), float(len(nodes) == 1), len({x.key for x in nodes}),
    ]
    return np.concatenate([general, [float(a in attrs) for a in _ATTR_TOKENS], own, below])


def flatten(text: str) -> tuple[list[Node], list[np.ndarray], list[int]]:
    """Nodes of a block, root first, with features and the parent of each."""
    root = Node("", "", "", text, text, parse(text), 0, len(text))
    root.bare = strip(text, root.children)
    nodes, feats, parents = [], [], []
    stack = [(root, 0, -1, 0, 0.0)]
    while stack:
        n, depth, parent, siblings, alike = stack.pop()
        k = len(nodes)
        nodes.append(n)
        parents.append(parent)
        feats.append(features(n.inner, n.bare, n.source, n.key if depth else "", n.attrs, n.children, depth, siblings, alike))
        keys = Counter(c.key for c in n.children)
        size = len(n.children)
        stack += [(c, depth + 1, k, size, keys[c.key] / size) for c in reversed(n.children)]
    return nodes, feats, parents


#: Kinds that a node may have below a node of a kind: a code, a formula, an image and a heading hold nothing but inline nodes or themselves.
_MAY = {
    "heading": {"heading", INLINE, "formula"}, "paragraph": {"paragraph", INLINE, "formula", "image", "code"}, "list": {"list", INLINE, "paragraph", "formula", "code"}, "code": {"code", INLINE}, "formula": {"formula", INLINE},
    "table": {"table", INLINE, "paragraph", "formula", "image"}, "image": {"image", INLINE}, INLINE: {INLINE, "formula", "code"},
}
_ALLOWED = np.array([[c in _MAY[a] for c in CLASSES] for a in CLASSES])


def decode(logp: np.ndarray, parents: list[int]) -> list[int]:
    """Kinds of a tree that maximise the sum of the nodes' log-probabilities, none contradicting its parent; the nodes below a parent weigh as one, each an equal share, so that many children do not outvote it. The root has one of the seven kinds."""
    total, pick, size = logp.copy(), np.zeros((len(logp), len(CLASSES)), int), Counter(parents)
    for i in range(len(logp) - 1, 0, -1):
        below = np.where(_ALLOWED, total[i][None, :], -np.inf)
        pick[i] = below.argmax(1)
        total[parents[i]] += below.max(1) / size[parents[i]]
    out = [int(total[0][: len(KINDS)].argmax())]
    for i in range(1, len(logp)):
        out.append(int(pick[i][out[parents[i]]]))
    return out


def _written(plain: list[str], rnd: random.Random) -> Iterator[tuple[str, str]]:
    """(text, kind) of constructs written around plain texts, in each of the four markups."""
    code = ["for i in range(n):\n    x = f(x, i)", "SET gap=12\nRUN\nEND", "def area(b, h):\n    return b * h * 0.5", "load mesh 4\nsolve flow\nprint 12", "int main() {\n  return 0;\n}", "select a, b\nfrom t\nwhere c = 1"]
    maths = [r"a = b + c d^{-1/2}", r"\frac{a}{b_0} \ln x", r"X_{max} = 1 - \exp(-k t^{m})", r"\dot{q} = \alpha \Delta T", r"\sqrt{R h} \cdot v", r"y = x"]
    words = [w for t in plain for w in t.split() if len(w) > 3] or ["word"]

    def short() -> str:
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))

    def marked(t: str) -> str:
        w = t.split(" ")
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(w))
            w[i] = rnd.choice(["**{}**", "<b>{}</b>", "<i>{}</i>", "''{}''", "'''{}'''", "`{}`", "[[{0}|{0}]]", "[{}](a/b-1)", "\\emph{{{}}}~", "\\textbf{{{}}}", "{}<sup>3</sup>", "{}<ref>A-1</ref>", "{}&nbsp;", "{} &amp; {{{{cite|A-2}}}}", "{}$^{{7}}$", "<span style=\"x\">{}</span>", "*{}*", "{}~\\cite{{a1}}", "{} $a = b_0$", "<a href=\"x\">{}</a>"]).format(w[i])
        return " ".join(w)

    for t in plain:
        t = " ".join(t.split())
        s = short()
        # Sentences of any length: an opening of the text with its full stop stands for a short paragraph.
        brief = " ".join(t.split()[: rnd.randint(3, 9)]).rstrip(" .,;:") + "."
        yield marked(t), "paragraph"
        yield marked(brief), "paragraph"
        yield f"<p>{t if rnd.random() < 0.4 else marked(t)}</p>", "paragraph"
        yield f"<p>{brief if rnd.random() < 0.4 else marked(brief)}</p>", "paragraph"
        yield rnd.choice([f"<div>{t}</div>", f"{t}<br/>{t}", f"<p class=\"x\">{marked(t)}</p>", f"> {t}"]), "paragraph"
        d = rnd.randint(1, 4)
        yield rnd.choice([f"<h{d}>{s}</h{d}>", f"<h{d} class=\"sec\">{s}</h{d}>", f"<H{d}>{s}</H{d}>", f"{'#' * d} {s}", f"{'#' * d} {s} {'#' * d}", f"{'=' * (d + 1)} {s} {'=' * (d + 1)}", f"\\section{{{s}}}", f"\\subsection*{{{s}}}", f"<h2>{marked(s)}</h2>", f"## {marked(s)}", f"{s}\n-----"]), "heading"
        items = [rnd.choice([short(), t, brief]) for _ in range(rnd.randint(2, 5))]
        items = [marked(x) if rnd.random() < 0.2 else x for x in items]
        mark = rnd.choice(["- ", "* ", "+ ", "# ", "1. "])
        yield rnd.choice(["\n".join(mark + x for x in items), "\n".join(f"{i + 1}. {x}" for i, x in enumerate(items)), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ol>\n" + "\n".join(f"  <li>{x}</li>" for x in items) + "\n</ol>", "\\begin{itemize}\n" + "\n".join(f"\\item {x}" for x in items) + "\n\\end{itemize}", "\\begin{enumerate}\n" + "\n".join(f"\\item {x}" for x in items) + "\n\\end{enumerate}"]), "list"
        if rnd.random() < 0.6:
            yield "\n".join(mark + x for x in items), "list"
        items = [short() for _ in range(rnd.randint(2, 4))]
        pad = rnd.choice(["", " ", "  ", "\t"])
        yield rnd.choice(["<ol>", "<ul>"]) + "\n" + "\n".join(f"{pad}<li>{x}</li>" for x in items) + "\n" + "</ol>", "list"
        c = rnd.choice(code).replace("12", str(rnd.randint(1, 99)))
        yield rnd.choice([f"```\n{c}\n```", f"```python\n{c}\n```", f"~~~\n{c}\n~~~", f"<pre><code>{c}</code></pre>", f"<pre>{c}</pre>", f'<syntaxhighlight lang="text">\n{c}\n</syntaxhighlight>', f"\\begin{{verbatim}}\n{c}\n\\end{{verbatim}}", f"\\begin{{lstlisting}}\n{c}\n\\end{{lstlisting}}"]), "code"
        f = rnd.choice(maths)
        yield rnd.choice([f"$${f}$$", f"\\[ {f} \\]", f"\\begin{{equation}}\n{f}\n\\end{{equation}}", f"\\begin{{align*}}{f}\\end{{align*}}", f"<math>{f}</math>", f":<math>{f}</math>", f"$ {f} $ \\quad ({rnd.randint(1, 30)})", f"\\({f}\\)"]), "formula"
        n = rnd.randint(2, 4)
        grid = [[short().split()[0] if rnd.random() < 0.5 else str(rnd.randint(1, 999)) for _ in range(n)] for _ in range(rnd.randint(2, 4))]
        yield rnd.choice(["<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in grid) + "</table>", "| " + " | ".join(grid[0]) + " |\n|" + "---|" * n + "".join("\n| " + " | ".join(r) + " |" for r in grid[1:]), "{| class=\"wikitable\"\n! " + " !! ".join(grid[0]) + "".join("\n|-\n| " + " || ".join(r) for r in grid[1:]) + "\n|}", f"\\begin{{tabular}}{{{'l' * n}}}\n" + "\n".join(" & ".join(r) + " \\\\" for r in grid) + "\n\\end{tabular}"]), "table"
        yield rnd.choice([f"![{s}](img/p_{d}.png)", f'<img src="img/p_{d}.png" alt="{s}"/>', f"[[File:p{d}.png|thumb|{s}]]", f"\\includegraphics[width=0.{d}\\textwidth]{{img/p_{d}.png}}", f"<figure><img src=\"a.png\"/><figcaption>{s}</figcaption></figure>", f"\\begin{{figure}}\\includegraphics{{a{d}.png}}\\caption{{{s}}}\\end{{figure}}"]), "image"


def train(plain: list[str], seed: int = 7) -> Boosted:
    """Trees fitted on constructs written around plain texts (at most SAMPLE of them)."""
    x, y, rnd = [], [], random.Random(seed)
    # A table without a markup-free text is taught with sentences of its own.
    plain = plain or [f"The block {i} of this text has no marks and ends here." for i in range(40)]
    for text, kind in _written(plain[:SAMPLE], rnd):
        nodes, feats, _ = flatten(text)
        x.append(feats[0])
        y.append(CLASSES.index(kind))
        for n, f in list(zip(nodes, feats))[1:6]:
            known = _INNER_KIND.get(n.tag, INLINE)
            x.append(f)
            y.append(CLASSES.index(kind if n.fmt in ("md", "wiki") and (known == "list" != kind or known == "heading" != kind) else "formula" if n.tag == "math" and kind == "formula" else known))
    return Boosted(len(CLASSES), rounds=24, depth=4).fit(np.array(x), np.array(y))


_ITEMS = {"li", "item"}


def _list_lines(root: Node) -> list[str]:
    """Lines of a list in order: items with '- ', each once, and the text before, between and after them as lines of its own."""
    lines: list[list[str]] = [[]]
    holds = {}
    for n in reversed(preorder(root)):
        holds[id(n)] = n.tag in _ITEMS or any(holds[id(c)] for c in n.children)
    # Each entry: text to add, or a node to go into, or the sign that an item ends.
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            lines.append([])
        elif isinstance(x, str):
            parts = x.split("\n")
            lines[-1].append(parts[0])
            lines += [[p] for p in parts[1:]]
        elif not holds[id(x)]:
            stack.append(x.seen)
        else:
            inside, at = [], 0
            for c in x.children:
                inside += [x.inner[at : c.start], c]
                at = c.end
            inside.append(x.inner[at:])
            if x.tag in _ITEMS:
                # Its own text stands in one line, however it is broken.
                inside = [" ".join(p.split("\n")) if isinstance(p, str) else p for p in inside]
                lines.append(["- "])
                inside.append(None)
            elif x is not root:
                inside = [None, *inside, None]
            stack += reversed(inside)
    out = [" ".join("".join(x).split()) for x in lines]
    return [x for x in out if x and x != "-"]


def render(nodes: list[Node], kinds: list[int]) -> str:
    """Clean text of a block: headings with '# ', items with '- ' and other lines of a list as they are, cells parted by ' | ', code and formulas bare."""
    root, kind = nodes[0], CLASSES[kinds[0]]
    seen = root.bare
    if kind == "heading":
        return "# " + " ".join(seen.split())
    if kind == "list":
        if any(n.tag in _ITEMS for n in nodes):
            return "\n".join(_list_lines(root))
        return "\n".join("- " + " ".join(x.split()) for x in seen.split("\n") if x.strip())
    if kind == "table":
        rows = re.split(r"</tr>|\\\\|\n", root.inner) if "<tr" in root.inner or "\\\\" in root.inner else root.inner.split("\n")
        cells = [[x for x in (strip(c, parse(c)).strip() for c in re.split(r"</t[dh]>\s*|\|\|?|!!|&(?!\w+;)|^!", re.sub(r"\\(?:begin|end)\{tabular\}(?:\{\w*\})?|\{\|[^\n]*|\|\}|\|-+$", "", r))) if x] for r in rows]
        return "\n".join(" | ".join(r) for r in cells if r and not all(set(x) <= set(":-|") for x in r))
    return seen.strip("\n") if kind == "code" else re.sub(r"[^\S\n]+", " ", seen).strip()


def plain_sample(blocks: DataFrame) -> list[str]:
    """At most SAMPLE markup-free texts, the first by hash among those that a hash draws; the training text of the trees. The draw keeps some SAMPLE * 80 rows of a table of any size, so that no whole table is sorted for it."""
    every = max(1, blocks.count() // (SAMPLE * 80))
    drawn = blocks.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    rows = drawn.filter(F.col("text").isNotNull() & ~F.col("text").rlike(MAYBE) & F.length("text").between(20, 400)).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE)
    return [r.text for r in rows.collect()]


def convert(blocks: DataFrame) -> DataFrame:
    """(block_id, block_kind, clean_text) of each block with markup. blocks: block_id, text; other columns are not read."""
    held = blocks.sparkSession.sparkContext.broadcast(train(plain_sample(blocks)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for b in batches:
            trees = [flatten(t) for t in b.text]
            keep = [i for i, t in enumerate(trees) if len(t[0]) > 1]
            out = []
            if keep:
                p = np.log(model.prob(np.array([f for i in keep for f in trees[i][1]])) + 1e-9)
                at = 0
                for i in keep:
                    nodes, _, parents = trees[i]
                    kinds = decode(p[at : at + len(nodes)], parents)
                    at += len(nodes)
                    out.append((b.block_id.iloc[i], CLASSES[kinds[0]], render(nodes, kinds)))
            yield pd.DataFrame(out, columns=["block_id", "block_kind", "clean_text"])

    rows = blocks.select("block_id", "text").filter(F.col("text").rlike(MAYBE))
    return fine(rows).mapInPandas(run, "block_id long, block_kind string, clean_text string").dropDuplicates(["block_id", "block_kind", "clean_text"])


def found(blocks: DataFrame) -> DataFrame:
    """(block_id, block_kind) of each block with markup."""
    return convert(blocks).select("block_id", "block_kind").distinct()
