"""HTML documents to clause rows and table rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# The forms of clause headings, and of the ETSI header comment.
ANNEX = re.compile(r"^Annex\s+([A-Z][0-9]*)\s*[:.)]?\s*(.*)$", re.I)
ANNEX_SUB = re.compile(r"^([A-Z]\.[0-9]+(?:\.[0-9A-Za-z]+)*)\s+(.+)$")
NUMERIC = re.compile(r"^([0-9]+(?:\.[0-9A-Za-z]+)*)\s+(.+)$")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LINES = {"p", "li", "pre", "dd", "dt"}
_BLANKS = re.compile(r"[ \t\r\n ]+")


def collapse(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def heading_parts(text: str) -> tuple[str, str, bool | None] | None:
    """(path, heading, informative) of a numbered heading.

    informative is None where the heading says nothing about it (a sub-clause);
    None altogether for text that isn't a numbered heading.
    """
    text = collapse(text)
    if m := ANNEX.match(text):
        return m[1].upper(), m[2] or text, "informative" in text.lower()
    if m := ANNEX_SUB.match(text):
        return m[1], m[2], None
    if m := NUMERIC.match(text):
        return m[1], m[2], False if "." not in m[1] else None
    return None


@dataclass
class Clause:
    clause_path: str
    heading: str
    is_normative: bool
    lines: list[str] = field(default_factory=list)


class _Walker(HTMLParser):
    """Streams a document: headings open clauses, lines and table rows fill them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.clauses: list[Clause] = []
        self.loose: list[str] = []
        self.tables: list[tuple[int, list[str]]] = []
        self.now: Clause | None = None
        self.saw_history = self.skipping = self.informative = False
        self.stack: list[str] = []
        self.text: list[str] = []
        self.row: list[str] | None = None
        self.n_tables = 0
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in _HEADINGS or tag in _LINES:
            self._line()
            self.stack.append(tag)
        elif tag == "table":
            self._line()
            self.n_tables += 1
        elif tag == "tr":
            self._line()
            self.row = []
        elif tag in ("td", "th"):
            self.text = []
        elif tag == "br":
            self.text.append("\n" if "pre" in self.stack else " ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _HEADINGS and tag in self.stack:
            self._heading(collapse("".join(self.text)))
            self.text = []
            self.stack.remove(tag)
        elif tag in _LINES and tag in self.stack:
            self._line()
            self.stack.remove(tag)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(collapse("".join(self.text)))
            self.text = []
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.tables.append((self.n_tables, self.row))
                self._add("\t".join(self.row))
            self.row, self.text = None, []

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def _heading(self, text: str) -> None:
        if not text:
            return
        if "change history" in text.lower():
            self.saw_history = self.skipping = True
            self.now = None
            return
        parts = heading_parts(text)
        if parts is None:
            if not self.skipping:
                self._add(text)
            return
        path, heading, informative = parts
        self.skipping = False
        if informative is not None:
            self.informative = informative
        self.now = Clause(path, heading, not self.informative)
        self.clauses.append(self.now)

    def _line(self) -> None:
        if self.row is not None:
            return
        raw = "".join(self.text)
        self.text = []
        if self.stack and self.stack[-1] in _HEADINGS:
            self.text = [raw]
            return
        line = raw.strip("\r\n") if "pre" in self.stack else collapse(raw)
        if line.strip():
            self._add(line)

    def _add(self, line: str) -> None:
        if self.skipping:
            return
        (self.now.lines if self.now else self.loose).append(line)


def parse_clauses(html: str | None) -> tuple[list[Clause], bool, bool]:
    """(clauses, saw a change history, salvaged) of one document.

    Clauses without text and sub-clauses are dropped. A document without any
    heading is salvaged: its lines that look like numbered headings open clauses.
    """
    w = _Walker()
    w.feed(html or "")
    w.close()
    w._line()
    out = [c for c in w.clauses if c.lines]
    if out or w.clauses:
        return out, w.saw_history, False
    now = None
    for line in w.loose:
        parts = heading_parts(line) if len(line) < 200 else None
        if parts and not line.rstrip().endswith((".", ";", ",")):
            now = Clause(parts[0], parts[1], True)
            out.append(now)
        elif now is not None:
            now.lines.append(line)
    return [c for c in out if c.lines], w.saw_history, True


def table_rows(html: str | None) -> list[tuple[int, list[str]]]:
    """(table number, cells) of each row that isn't blank."""
    w = _Walker()
    w.feed(html or "")
    w.close()
    return w.tables
