"""Markup residue in text documents (problem 3).

Method: tag-path ratios. A text that holds HTML, Markdown, wiki or LaTeX markup
is read as nodes, each with its path of tags from the root (``ul/li``,
``nav/ul/li``, ``template``, ``env:itemize/item`` ...). Over all texts, text
length and punctuation are added up per path and divided by the path's nodes,
smoothed along the order of paths, fused into one score and held against a
threshold: paths below it hold no content (menus, footers, citations,
categories) and are left out, in every text. Inline elements (sup, b, span, a
...) belong to the sentence and have the path of their block. Sentences outside
any element, and headings, lists, tables, code and formulas outside the frame
of a page (``nav``, ``footer`` ...) stay whatever their score; what is
structure is told by spans with kind and level beside the clean text.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code, spread

KINDS = ("html", "markdown", "wiki", "latex")
#: A text without any of these characters or pairs can hold no markup: filtered at the scan.
CANDIDATE = r"[<&\\`~|]|\*\*|\*[A-Za-z]|__|\]\(|\[\^|[-*+][ \t\x{A0}]\[|\[\[|\{\{|''|(?m)^[ \t\x{A0}]*(?:#{1,6}[ \t\x{A0}]|#REDIRECT|>|={2,})|\$"

# Element names. Of ``_SURE`` an opening tag alone is markup; those of ``_WORDS``
# are also names in grammar rules or type parameters, and need attributes or their closing tag.
_SURE = "br hr li td tr th ul ol h1 h2 h3 h4 h5 h6 tbody thead tfoot colgroup blockquote nobr noscript iframe"
_WORDS = (
    "p b i u s a q em tt dl dt dd pre div sub sup del ins img var kbd col span code font table strong small big center "
    "caption section article header footer nav main aside title body head html link meta style script label form input "
    "button select option textarea fieldset legend figure figcaption details summary time data map area object param "
    "source track template slot frame frameset base cite dfn mark abbr address menu output picture video audio canvas svg"
)
_BLOCK = set("p div li ul ol dl dt dd table tr h1 h2 h3 h4 h5 h6 pre blockquote section article header footer nav aside menu main form button option label fieldset legend hr caption center title".split())
#: The frame of a page: what looks like structure in it has to show by its score that it is content.
_FRAME = {"nav", "footer", "header", "aside", "menu", "form", "button", "select", "option", "label", "fieldset"}
_INLINE = set("b i u s a q em tt sub sup del ins var kbd span code font strong small big cite dfn mark abbr time data nobr".split())
_SKIP = {"script", "style", "head", "noscript"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "col", "base", "area"}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S | re.I)
_SURE_SET, _WORD_SET = set(_SURE.split()), set(_WORDS.split())
_REFERENCE = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_B = r"[ \t\xa0]"

_MARKDOWN = [
    re.compile(rf"^{_B}{{0,3}}#{{1,6}}{_B}+\S", re.M),  # heading
    re.compile(rf"^(?!{_B}*$).*\r?\n{_B}{{0,3}}={{3,}}{_B}*\r?$", re.M),  # underlined heading
    re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])"),  # strong
    re.compile(rf"^{_B}{{0,3}}(?:```|~~~)", re.M),  # fence
    re.compile(r"(?<![\w\[\]])!?\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),  # link, image
    re.compile(rf"^{_B}*\|?{_B}*:?-{{3,}}:?{_B}*(?:\|{_B}*:?-{{3,}}:?{_B}*)+\|?{_B}*\r?$", re.M),  # table
    re.compile(rf"^{_B}*[-*+]{_B}\[[ xX\xa0]\]{_B}", re.M),  # task
    re.compile(r"(?<!~)~~(?=[^\s~])[^~\n]+~~(?!~)"),  # struck out
    re.compile(r"\[\^\w+\]"),  # footnote
    re.compile(rf"(?:^{_B}{{0,3}}>(?:{_B}.*)?\r?(?:\n|\Z)){{2,}}", re.M),  # quotation of two lines or more
]
#: Signs that count only in company: two different ones are markup.
_MARKDOWN_WEAK = [
    re.compile(r"(?<![`\w])`[^`\n]+`(?![`\w])"),
    re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])"),
    re.compile(r"(?<!\w)__(?=[A-Za-z])[^_\n]+__(?!\w)"),
]
_WIKI = [
    re.compile(r"'''(?=\S)[^'\n]+'''"),
    re.compile(r"(?<!\[)\[\[(?=[^\s:\[\]])[^\[\]\n]+\]\](?!\])"),
    re.compile(r"\{\{(?=[A-Za-z#])[^{}\n]+\}\}"),
    re.compile(rf"^{_B}*\{{\|", re.M),
    re.compile(rf"^{_B}*(={{2,6}})(?!=)[^=\n]+(?<!=)\1{_B}*\r?$", re.M),
    re.compile(rf"^{_B}*#REDIRECT{_B}", re.M | re.I),
    re.compile(r"</?(?:nowiki|ref)\b[^<>]*>|__(?:NO)?TOC__", re.I),
]
# LaTeX commands that stand without an argument in braces.
_COMMANDS = (
    "item hline cdot cdots ldots dots times le leq ge geq neq ne approx infty alpha beta gamma delta epsilon lambda mu sigma omega theta pi phi "
    "Delta Sigma Omega left right lfloor rfloor lceil rceil sum prod int min max log ln exp sin cos frac sqrt quad qquad noindent newline newpage "
    "maketitle tableofcontents toprule midrule bottomrule centering textbf textit emph label ref begin end section"
)
_LATEX = [
    re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    re.compile(r"(?<![\w\\:/.])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{(?=[A-Za-z\\])"),
    re.compile(r"(?<![\w\\:/.])\\(?:frac|sqrt|sum|int|prod)(?:\{|_|\^)"),
    re.compile(rf"(?<![\w\\:/.])\\(?:{'|'.join(_COMMANDS.split())})(?![A-Za-z])"),
    re.compile(r"(?<![\\\w])\$[^$\n]*(?:\\[A-Za-z]{2,}|[_^]\{)[^$\n]*\$"),
]


def _html_signs(text: str) -> bool:
    if _COMMENT.search(text):
        return True
    if "&" in text:
        for m in _REFERENCE.finditer(text):
            if m[1][0] == "#" or m[1] + ";" in html.entities.html5:
                return True
    if "<" not in text:
        return False
    tags = list(_TAG.finditer(text))
    if not tags:
        return False
    closed = {m[2].lower() for m in tags if m[1]}
    for m in tags:
        name = m[2].lower()
        if m[1]:
            continue
        if name in _SURE_SET and not _in_rule(text, m.start()):
            return True
        if name in _WORD_SET and (name in closed or "=" in m[3] or (name == "p" and _starts_line(text, m.start()) and not _in_rule(text, m.start()))):
            return True
    return False


def _starts_line(text: str, at: int) -> bool:
    return text[text.rfind("\n", 0, at) + 1 : at].strip(" \t\xa0") == ""


def _in_rule(text: str, at: int) -> bool:
    """Within a grammar rule (``name = <x> ...``, ``<x> ::= ...``) or a type parameter."""
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    line = text[a : b if b >= 0 else len(text)]
    return "::=" in line or bool(re.match(r"\s*[\w-]+\s*=\s*<", line)) or (at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_") and "/" not in text[at : at + 4] and text[at + 1 : at + 3].lower() != "br")


def markup_kinds(text: str | None) -> list[str]:
    """Which of html, markdown, wiki and latex the text holds."""
    if not text:
        return []
    kinds = []
    if _html_signs(text):
        kinds.append("html")
    if any(r.search(text) for r in _MARKDOWN) or sum(bool(r.search(text)) for r in _MARKDOWN_WEAK) > 1:
        kinds.append("markdown")
    if any(r.search(text) for r in _WIKI):
        kinds.append("wiki")
    if "\\" in text and any(r.search(text) for r in _LATEX):
        kinds.append("latex")
    return kinds


# --- reading into nodes -------------------------------------------------------------


@dataclass
class Node:
    path: tuple[str, ...]
    text: str
    #: Opens a new line in the output.
    block: bool = False
    #: Structure stays whatever its path's score, unless it is in a page's frame.
    keep: bool = False
    #: What structure it is (heading, item, row, code, formula, quote) and how deep.
    role: str = ""
    level: int = 0
    #: Opens a new line only where something stands in this one.
    soft: bool = False


@dataclass
class Reader:
    nodes: list[Node] = field(default_factory=list)

    def add(self, path: tuple[str, ...], text: str, block: bool = False, keep: bool = False, role: str = "", level: int = 0, soft: bool = False) -> None:
        if text or block:
            self.nodes.append(Node(path, text, block, keep, role, level, soft))


_ROLES = {"li": "item", "td": "row", "th": "row", "tr": "row", "pre": "code", "blockquote": "quote"}
_STRUCTURE = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "code", "formula", "item", "tr"}


def _read_html(text: str, out: Reader) -> None:
    if "<" not in text and re.search(r"&lt;/?[A-Za-z]", text):
        text = html.unescape(text)  # tags that were escaped once more
    text = _COMMENT.sub(lambda m: "<cmt>" + re.sub(r"[<>]", "", m[0][4:-3]) + "</cmt>", text)
    stack: list[str] = []
    counts: list[int] = []  # items so far of each open list, -1 in one without numbers
    at, hidden = 0, 0
    known = _SURE_SET | _WORD_SET | {"cmt"}

    def path() -> tuple[str, ...]:
        """That of the nearest block: inline elements are part of its sentences."""
        n = len(stack)
        while n and (stack[n - 1] in _INLINE or ":" in stack[n - 1]):
            n -= 1
        return tuple(stack[:n]) or ("text",)

    def role() -> tuple[str, int]:
        for t in reversed(stack):
            if t in _ROLES:
                return _ROLES[t], len(counts) if t == "li" else 0
            if len(t) == 2 and t[0] == "h" and t[1] in "123456":
                return "heading", int(t[1])
        return "", 0

    def said(part: str) -> None:
        if not part or hidden:
            return
        part = html.unescape(part)
        if "pre" not in stack:
            part = re.sub(r"[ \t\r\n]+", " ", part) if stack else part
        out.add(path(), part, False, bool(_STRUCTURE & set(stack)), *role())

    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name not in known and ":" not in name:
            continue
        said(text[at : m.start()])
        at = m.end()
        if m[1]:
            if name in stack:
                while stack:
                    top = stack.pop()
                    hidden -= top in _SKIP
                    if top in ("ul", "ol") and counts:
                        counts.pop()
                    if top == name:
                        break
        elif name in _VOID or m[4]:
            if name in ("br", "hr"):
                out.add(path(), "", block=True)
            continue
        else:
            if name in ("li", "tr", "td", "th", "p", "dt", "dd") and name in stack and name == stack[-1]:
                stack.pop()  # left open
            stack.append(name)
            hidden += name in _SKIP
            if name in ("ul", "ol"):
                counts.append(0 if name == "ol" else -1)
        if name in _BLOCK:
            mark = ""
            if name == "li" and not m[1]:
                mark = "- "
                if counts and counts[-1] >= 0:
                    counts[-1] += 1
                    mark = f"{counts[-1]}. "
            out.add(path(), mark, True, bool(mark), *role(), soft=name in ("li", "tr", "dt", "dd"))
        elif name in ("td", "th") and m[1]:
            out.add((*stack, name), "\t", False, True, "row")
    said(text[at:])


_INLINE_MD = [
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\^\w+\]:?"), ""),
    (re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<!\w)__(?=[A-Za-z])([^_\n]+)__(?!\w)"), r"\1"),
    (re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+)~~(?!~)"), r"\1"),
    (re.compile(r"(?<![`\w])`([^`\n]+)`(?![`\w])"), r"\1"),
]


def _plain(line: str, rules: list) -> str:
    for r, to in rules:
        line = r.sub(to, line)
    return line


def _read_markdown(text: str, out: Reader) -> None:
    fence, lines = "", text.split("\n")
    for k, raw in enumerate(lines):
        line = raw.rstrip("\r")
        bare = line.strip(" \t\xa0")
        if fence or bare.startswith(("```", "~~~")):
            if fence and bare.startswith(fence):
                fence = ""
            elif not fence:
                fence = bare[:3]
            else:
                out.add(("pre", "code"), line, True, True, "code")
            continue
        under = lines[k + 1].strip(" \t\xa0\r") if k + 1 < len(lines) else ""
        if bare and re.fullmatch(r"={3,}", under):
            out.add(("h1",), _plain(line, _INLINE_MD), True, True, "heading", 1)
            continue
        if re.fullmatch(r"={3,}", bare) and k and lines[k - 1].strip() or _MARKDOWN[5].fullmatch(line):
            continue  # the line under a heading or table head
        m = re.match(rf"{_B}{{0,3}}(#{{1,6}}){_B}+(.*)", line)
        if m:
            out.add((f"h{len(m[1])}",), _plain(m[2], _INLINE_MD), True, True, "heading", len(m[1]))
            continue
        if bare.startswith("|") and bare.endswith("|") and len(bare) > 1:
            out.add(("table", "tr", "td"), "\t".join(_plain(c.strip(), _INLINE_MD) for c in bare[1:-1].split("|")), True, True, "row")
            continue
        m = re.match(rf"({_B}*)[-*+]{_B}(?:\[[ xX\xa0]\]{_B})?(.*)", line)
        if m and not line.lstrip().startswith("-\t"):
            out.add(("ul", "li"), f"{m[1]}- {_plain(m[2], _INLINE_MD)}", True, True, "item", len(m[1].expandtabs(4)) // 2 + 1)
            continue
        m = re.match(rf"{_B}{{0,3}}>{_B}?(.*)", line)
        out.add(("blockquote",) if m else ("p",), _plain(m[1] if m else line, _INLINE_MD), True, bool(m), "quote" if m else "")


_INLINE_WIKI = [
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"'''''|'''|''"), ""),
    (re.compile(r"</?(?:nowiki|ref)\b[^<>]*>", re.I), ""),
]


# Templates that only format their last value, which stands in the sentence.
_VALUE_TEMPLATES = "nowrap nobr small big lang abbr code mono math nobold sub sup val"
_VALUE = re.compile(rf"\{{\{{(?:{'|'.join(_VALUE_TEMPLATES.split())})\|(?:[^{{}}|\n]*\|)*([^{{}}|\n]*)\}}\}}", re.I)


def _read_wiki(text: str, out: Reader) -> None:
    row: list[str] = []
    numbers: dict[int, int] = {}
    text = _VALUE.sub(r"\1", text)
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        bare = line.strip(" \t\xa0")
        m = re.fullmatch(r"(={2,6})\s*([^=]+?)\s*\1", bare)
        if m:
            out.add((f"h{len(m[1])}",), _plain(m[2], _INLINE_WIKI), True, True, "heading", len(m[1]))
        elif bare.startswith(("{|", "|-", "|}")):
            continue
        elif bare.startswith(("|", "!")) and len(bare) > 1 and not bare.startswith("||"):
            row = re.split(r"\|\||!!", bare[1:])
            out.add(("table", "tr", "td"), "\t".join(_plain(c.strip(), _INLINE_WIKI) for c in row), True, True, "row")
        elif re.match(r"#REDIRECT\b", bare, re.I):
            out.add(("redirect",), bare, block=True)
        elif m := re.match(rf"([*#:;]+){_B}*(.*)", bare):
            depth = len(m[1])
            numbers = {d: n for d, n in numbers.items() if d <= depth}
            numbers[depth] = numbers.get(depth, 0) + 1
            mark = f"{numbers[depth]}. " if m[1][-1] == "#" else "- "
            out.add(("ul", "li"), "  " * (depth - 1) + mark, True, True, "item", depth)
            _wiki_line(m[2], ("ul", "li"), out, True, "item", depth)
        else:
            out.add(("p",), "", block=True)
            _wiki_line(line, ("p",), out)
        if not bare.startswith(("*", "#", ":", ";")):
            numbers = {}


def _wiki_line(line: str, path: tuple[str, ...], out: Reader, keep: bool = False, role: str = "", level: int = 0) -> None:
    """The text of a line, its templates and categories as nodes of their own."""
    at = 0
    for t in re.finditer(r"\{\{([^{}\n]*)\}\}|\[\[((?:Category|File|Image):[^\[\]\n]*)\]\]", line, re.I):
        out.add(path, _plain(line[at : t.start()], _INLINE_WIKI), False, keep, role, level)
        out.add(("template",) if t[1] is not None else ("category",), t[1] or t[2] or "")
        at = t.end()
    out.add(path, _plain(line[at:], _INLINE_WIKI), False, keep, role, level)


_INLINE_TEX = [
    (re.compile(r"\\(?:label|index|vspace|hspace)\*?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:ref|eqref|cite|pageref)\*?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textrm|textsc|mbox|footnote|caption|url)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"(?<!\\)~"), " "),
    (re.compile(r"\\([%&_#$])"), r"\1"),
]


def _tex_inline(line: str) -> str:
    """Formulas stay as they are, the rest loses its commands."""
    parts = re.split(r"(\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\))", line)
    return "".join(p if k % 2 else _plain(p, _INLINE_TEX) for k, p in enumerate(parts))


def _read_latex(text: str, out: Reader) -> None:
    env: list[str] = []
    numbers: list[int] = []
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        bare = line.strip(" \t\xa0")
        m = re.match(r"\\(begin|end)\{([A-Za-z]+\*?)\}", bare)
        if m and m[1] == "begin":
            env.append(m[2].rstrip("*"))
            numbers.append(0)
            continue
        if m:
            if env:
                env.pop()
                numbers.pop()
            continue
        top = env[-1] if env else ""
        if top in ("verbatim", "lstlisting"):
            out.add(("pre", "code"), line, True, True, "code")
        elif top in ("equation", "align", "displaymath", "gather", "eqnarray"):
            out.add(("formula",), line, True, True, "formula")
        elif top in ("tabular", "array", "longtable"):
            cells = re.sub(r"\\\\|\\(?:hline|toprule|midrule|bottomrule)", "", bare).strip()
            if cells:
                out.add(("table", "tr", "td"), "\t".join(_tex_inline(c.strip()) for c in re.split(r"(?<!\\)&", cells)), True, True, "row")
        elif s := re.match(r"\\((?:sub)*)(?:section|chapter|paragraph)\*?\{([^{}]*)\}(.*)", bare):
            depth = len(s[1]) // 3 + 1
            out.add((f"h{depth}",), _tex_inline(s[2]), True, True, "heading", depth)
            if rest := _tex_inline(s[3]).strip():  # a sentence may go on in the heading's line
                out.add(("p",), rest, block=True)
        elif s := re.match(r"\\item(?:\[([^\]]*)\])?\s*(.*)", bare):
            if numbers:
                numbers[-1] += 1
            mark = f"{numbers[-1]}. " if top == "enumerate" else "- "
            out.add((*(f"env:{e}" for e in env), "item"), mark + (f"{s[1]} " if s[1] else "") + _tex_inline(s[2]), True, True, "item", max(1, len(env)))
        elif bare.startswith(("\\[", "\\(")):
            out.add(("formula",), bare, True, True, "formula")
        else:
            out.add(tuple(f"env:{e}" for e in env) or ("p",), _tex_inline(line), block=True)


_READERS = {"html": _read_html, "markdown": _read_markdown, "wiki": _read_wiki, "latex": _read_latex}
_PUNCTUATION = re.compile(r"[.,;:!?。，；：]")
#: Share of the mean score (weighed by text) below which a path holds no content.
THRESHOLD = 0.25
#: Levels of a path that tell paths apart, from the leaf up; a tag counts once.
PATH_LEVELS = 5


def path_of(node: Node) -> str:
    """The node's path from root to leaf, a repeated tag once, as text."""
    return "/".join(list(dict.fromkeys(node.path))[-PATH_LEVELS:])


def path_sums(nodes: list[Node], into: dict[str, list[int]] | None = None) -> dict[str, list[int]]:
    """Text length, punctuation and nodes of each path, added to ``into``.

    What inline elements cut a sentence into counts as one node.
    """
    sums = {} if into is None else into
    last = None
    for n in nodes:
        if n.text.strip():
            p = sums.setdefault(path_of(n), [0, 0, 0])
            p[0] += len(n.text.strip())
            p[1] += len(_PUNCTUATION.findall(n.text))
            p[2] += n.block or n.path != last
        if n.block or n.text.strip():
            last = None if n.block else n.path
    return sums


def path_scores(sums: dict[str, list[int]]) -> dict[str, float]:
    """Fused text and punctuation ratio of each path, smoothed along the paths' order."""
    order = sorted(sums)
    ratios = [(sums[p][0] / max(1, sums[p][2]), sums[p][1] / max(1, sums[p][2])) for p in order]

    def smooth(x: list[float]) -> list[float]:
        return [(x[i] * 6 + x[max(i - 1, 0)] + x[min(i + 1, len(x) - 1)]) / 8 for i in range(len(x))]

    text, marks = smooth([r[0] for r in ratios]), smooth([r[1] for r in ratios])
    return {p: (t * (0.5 + m)) ** 0.5 for p, t, m in zip(order, text, marks)}


def residue_paths(sums: dict[str, list[int]]) -> frozenset[str]:
    """The paths that hold no content."""
    scores = path_scores(sums)
    whole = sum(s[0] for s in sums.values())
    mean = sum(scores[p] * s[0] for p, s in sums.items()) / whole if whole else 0.0
    return frozenset(p for p, x in scores.items() if x < THRESHOLD * mean)


def is_residue(node: Node, residue: frozenset[str]) -> bool:
    """Comments always are; of the rest, what stands outside a page's frame as a sentence or as structure isn't."""
    if "cmt" in node.path:
        return True
    if path_of(node) not in residue:
        return False
    return bool(_FRAME & set(node.path)) or not (node.keep or node.path[-1:] in (("p",), ("text",), ("plain",), ()))


def _blocks(text: str) -> Iterator[str]:
    """Parts between blank lines; fences, environments, tables and pre elements stay whole."""
    held: list[str] = []
    open_until = None
    for part in re.split(r"((?:\r?\n[ \t\xa0]*){2,})", text):
        held.append(part)
        joined = part.lower()
        if open_until is None:
            for start, end in (("```", "```"), ("\\begin{", "\\end{"), ("<pre", "</pre"), ("<table", "</table"), ("{|", "|}")):
                k = joined.rfind(start)
                if k >= 0 and end not in joined[k + len(start) :] and not (start == "```" and joined.count("```") % 2 == 0):
                    open_until = end
        elif open_until in joined:
            open_until = None
        if open_until is None:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def read_nodes(text: str) -> list[Node]:
    """A text with markup as nodes in reading order; blocks without markup are one ``plain`` line each."""
    reader = Reader()
    for block in _blocks(text):
        own = markup_kinds(block) if block.strip() else []
        if not own:
            for i, line in enumerate(block.split("\n")):  # as it is
                reader.add(("plain",), line.rstrip("\r"), block=i > 0, keep=True)
        elif own[:2] == ["markdown", "wiki"] and _WIKI[4].search(block):  # with a wiki heading, # is a list
            _read_wiki(block, reader)
        elif len(own) == 1 or own[0] != "html":
            _READERS[own[0]](block, reader)
        else:  # HTML within another markup: its tags go first, then the other is read
            inner = Reader()
            _READERS[own[1]](block, inner)
            for n in inner.nodes:
                deeper = Reader()
                _read_html(n.text, deeper) if _html_signs(n.text) else deeper.add((), n.text)
                reader.add(n.path, "", n.block, n.keep, n.role, n.level, n.soft)
                for x in deeper.nodes:
                    reader.add(n.path + x.path, x.text, x.block, n.keep or x.keep, n.role or x.role, n.level or x.level, x.soft)
    return reader.nodes


#: Paths that one text alone tells too little of.
_BESIDE = frozenset({"template", "category", "redirect"})
#: Kind, level, and where in the clean text: (kind, level, start, end).
Span = tuple[str, int, int, int]


def clean_text(text: str | None, residue: frozenset[str] | None = None) -> tuple[str | None, list[str], int, list[Span]]:
    """(clean text, kinds found, characters left out, spans of structure) of one text.

    residue: the paths that hold no content; told from the text alone if not given.
    """
    kinds = markup_kinds(text)
    if not kinds:
        return text, kinds, 0, []
    nodes = read_nodes(text)
    if residue is None:
        residue = residue_paths(path_sums(nodes)) | _BESIDE
    lines: list[list] = [["", "", 0, False]]  # text, role, level, whether something was left out
    left_out = 0
    for n in nodes:
        if n.block and (len(lines) > 1 or lines[0][0]) and not (n.soft and not lines[-1][0].strip()):
            lines.append(["", "", 0, False])
        if is_residue(n, residue):
            left_out += len(n.text)
            lines[-1][3] = True
            continue
        for i, part in enumerate(n.text.split("\n")):
            if i:
                lines.append(["", "", 0, False])
            lines[-1][0] += part
            if n.role and (part.strip() or not lines[-1][1]):
                lines[-1][1:3] = n.role, n.level
    out: list[str] = []
    spans: list[Span] = []
    at, blank = 0, True
    for line, role, level, cut in lines:
        line = re.sub(r"(?<=\S)[ \t]{2,}", " ", line).strip(" \t") if cut and role != "code" else line.rstrip(" \t")
        if not line.strip() and role != "code":
            if not blank:
                out.append("")
                at += 1
            blank = True
            continue
        blank = False
        if role and line.strip():
            spans.append((role, level, at, at + len(line)))
        out.append(line)
        at += len(line) + 1
    while out and not out[-1].strip():
        out.pop()
    return "\n".join(out), kinds, left_out, _joined(spans)


def _joined(spans: list[Span]) -> list[Span]:
    """Neighbouring lines of one code block, table, formula or quotation as one span."""
    out: list[Span] = []
    for s in spans:
        if out and s[0] in ("code", "row", "formula", "quote") and out[-1][0] == s[0] and s[2] <= out[-1][3] + 1:
            out[-1] = (s[0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return [("table" if k == "row" else k, n, a, b) for k, n, a, b in out]


#: Paths that a decision may name; tags are of a fixed list, so a corpus has some hundreds.
MAX_PATHS = 200_000


def corpus_residue(df: DataFrame, text_col: str = "text") -> frozenset[str]:
    """The paths that hold no content, from the sums over all texts: one pass, a few rows a task."""
    spark = df.sparkSession
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if markup_kinds(t):
                    path_sums(read_nodes(t), sums)
        yield pa.RecordBatch.from_pydict({"path": list(sums), "chars": [x[0] for x in sums.values()], "marks": [x[1] for x in sums.values()], "nodes": [x[2] for x in sums.values()]}, pa.schema([("path", pa.string()), ("chars", pa.int64()), ("marks", pa.int64()), ("nodes", pa.int64())]))

    rows = spread(df.select(df[text_col].alias("__text")).where(F.col("__text").rlike(CANDIDATE)))
    sums = rows.mapInArrow(run, "path string, chars long, marks long, nodes long").groupBy("path").agg(F.sum("chars"), F.sum("marks"), F.sum("nodes"))
    got = sums.limit(MAX_PATHS + 1).collect()
    if len(got) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} tag paths: lower PATH_LEVELS")
    return residue_paths({r[0]: [r[1], r[2], r[3]] for r in got})


def clean_markup(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", only_marked: bool = False, residue: frozenset[str] | None = None) -> DataFrame:
    """(id, clean_text, kinds, left_out, structure) of every row, without a shuffle.

    residue: paths that hold no content, as ``corpus_residue`` gives them over
    the same texts; without it each text is judged by its own paths. structure:
    spans (kind, level, start, end) of headings, list items, tables, code,
    formulas and quotations in the clean text. Texts without markup come out
    unchanged with no kinds; null stays null, an empty text empty. With
    ``only_marked`` such rows give no rows (most are sorted out at the scan).
    Repeated rows stay repeated; other columns are not read.
    """
    spark = df.sparkSession
    ship_code(spark)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("clean_text", T.StringType()),
            T.StructField("kinds", T.ArrayType(T.StringType())),
            T.StructField("left_out", T.IntegerType()),
            T.StructField("structure", T.ArrayType(span)),
        ]
    )
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    if only_marked:
        rows = rows.where(F.col("__text").rlike(CANDIDATE))
    rows = spread(rows, "__id")
    sent = spark.sparkContext.broadcast(residue)  # at most MAX_PATHS paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        names = ("kind", "level", "start", "end")
        for batch in batches:
            done = [clean_text(t, sent.value) for t in batch.column(1).to_pylist()]
            take = [i for i, d in enumerate(done) if d[1] or not only_marked]
            cols = [pa.array([done[i][c] for i in take], out_schema.field(c + 1).type) for c in range(3)]
            spans = pa.array([[dict(zip(names, x)) for x in done[i][3]] for i in take], out_schema.field(4).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), *cols, spans], schema=out_schema)

    return rows.mapInArrow(run, schema)
