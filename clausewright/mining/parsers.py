"""Line parsers: abbreviations, ASN.1 modules, OpenAPI documents, interception
points, change-request lines, catalogue pages."""

from __future__ import annotations

import json
import re
from datetime import date, datetime
from typing import Any

from .html import collapse, table_rows

# --- abbreviations ------------------------------------------------------------------

#: Most characters and blanks of a term, and what a term never holds.
TERM_CHARS, TERM_BLANKS, NOT_IN_TERMS = 16, 2, set(".,;:()[]")
_CHANGE = re.compile(r"^(?:(?:start|begin|end|first|second|third|next|last)\s+(?:of\s+)?(?:the\s+)?(?:set\s+of\s+)?)?(?:modified\s+)?changes?(?:\s+(?:in|to|intended|ts|tr)\b.*)?$", re.I)
_NOTE = re.compile(r"^(?:note|editor'?s note)\b", re.I)


def _first_sign(text: str) -> str:
    return next((c for c in text.upper() if c.isascii() and c.isalnum()), "")


def plausible(term: str, expansion: str) -> bool:
    """Whether the two may be an abbreviation and its meaning: a short token with a capital
    or digit that begins as its expansion does. Initials aren't asked for: not all names follow them."""
    return (
        0 < len(term) <= TERM_CHARS
        and len(expansion) >= 2
        and term.count(" ") <= TERM_BLANKS
        and not NOT_IN_TERMS & set(term)
        and any(c.isascii() and (c.isupper() or c.isdigit()) for c in term)
        and _first_sign(term) == _first_sign(expansion)
    )


def initials_match(term: str, expansion: str) -> bool:
    """Whether the term's letters (digits don't count) are met, in order, by initials of the expansion's words."""
    letters = [c for c in term.upper() if c.isalpha()]
    initials = iter(w[0].upper() for w in re.findall(r"[^\W_]+", expansion))
    return bool(letters) and all(c in initials for c in letters)


def _is_change_marker(line: str) -> bool:
    """A line such as ``***** END SET OF CHANGES *****``, or one of such signs alone."""
    bare = line.strip(" \t*-=<>_")
    return not bare or bool(_CHANGE.match(re.sub(r"[*=<>\[\]]+.*$", "", bare).strip()))


def parse_abbreviations(text: str | None) -> list[tuple[str, str]]:
    """(term, expansion) that a clause lists, distinct, in order.

    Columns are split by tabs. A line without one goes on with the entry before
    (an expansion that wraps), unless a change marker or note came between;
    prose before the first entry is skipped. In a clause without any tab the
    shortest of the first one to three words that makes a plausible entry is
    the term, and lines that give none are left out.
    """
    lines = (text or "").replace("\r\n", "\n").split("\n")
    tabs = any("\t" in line for line in lines)
    out: list[list[str]] = []
    goes_on = False
    for line in lines:
        bare = line.strip()
        if not bare:
            continue
        if _is_change_marker(bare) or _NOTE.match(bare):
            goes_on = False
            continue
        if "\t" in line.rstrip():
            options = [line.rstrip().split("\t", 1)]
        elif tabs:
            if goes_on:
                out[-1][1] = f"{out[-1][1]} {collapse(bare)}"
            continue
        else:
            words = bare.split()
            options = [[" ".join(words[:n]), " ".join(words[n:])] for n in range(1, min(3, len(words) - 1) + 1)]
        entry = next(([t.strip(), collapse(e)] for t, e in options if plausible(t.strip(), collapse(e))), None)
        if entry:
            out.append(entry)
            goes_on = True
    return list(dict.fromkeys(map(tuple, out)))


# --- ASN.1 ------------------------------------------------------------------------------

# Which domain a clause belongs to, which interface a module's container stands for.
DOMAINS = (("6.2", "5GC"), ("6.3", "EPC"), ("6.4", "3G"))
CONTAINERS = {"XIRIEvent": "X2", "CCPDU": "X3", "IRIEvent": "HI2", "LINotificationMessage": "HI4"}
_TYPE = re.compile(r"^\s*(?:<[^<>\n]*>\s*)*([A-Za-z][A-Za-z0-9-]*)\s*::=\s*(?:\[\d+\]\s*)?(SEQUENCE OF|SET OF|SEQUENCE|SET|CHOICE|ENUMERATED|[A-Za-z][A-Za-z0-9 -]*)", re.M)
_MEMBER = re.compile(r"^\s*([A-Za-z][\w-]*)\s*\[(\d+)\]\s*([A-Za-z][A-Za-z0-9-]*(?: STRING)?)[^,\n]*?(OPTIONAL)?\s*,?\s*(?:--.*)?$")
_VALUE = re.compile(r"^\s*([a-z][\w-]*)\s*\((\d+)\)\s*,?")
# How a comment names the function that events are of, and cites a clause.
_EVENTS_OF = re.compile(r"^\s*--\s*([A-Z][A-Za-z0-9/-]*)\s+events")
_CLAUSE = re.compile(r"clause\s+([0-9]+[0-9A-Za-z.]*)")


def parse_asn1(text: str | None) -> list[dict[str, Any]]:
    """The types of a module: name, kind, members (name, type, tag, optional) and the
    clause that the comment of each member cites."""
    text = (text or "").replace(" ", " ").replace("\r\n", "\n")
    out = []
    found = list(_TYPE.finditer(text))
    for k, m in enumerate(found):
        body = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        a, b = body.find("{"), body.find("}")
        kind = m[2].strip()
        members: list[dict[str, Any]] = []
        if kind in ("SEQUENCE", "SET", "CHOICE", "ENUMERATED") and 0 <= a < b:
            cited = of = None
            for line in body[a + 1 : b].split("\n"):
                if c := _EVENTS_OF.match(line):
                    of = c[1]
                if c := _CLAUSE.search(line):
                    cited = c[1].rstrip(".")
                if kind == "ENUMERATED":
                    if v := _VALUE.match(line):
                        members.append({"name": v[1], "type": None, "tag": int(v[2]), "optional": False, "clause": None, "of": None})
                elif v := _MEMBER.match(line):
                    members.append({"name": v[1], "type": v[3], "tag": int(v[2]), "optional": bool(v[4]), "clause": cited, "of": of})
        elif kind in ("SEQUENCE", "SET", "CHOICE", "ENUMERATED"):
            continue  # a bare mention
        out.append({"name": m[1], "kind": kind.lower() if members else "alias", "members": members})
    return out


def asn1_events(types: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Members of container CHOICEs as events, with their type's number of fields."""
    sizes = {t["name"]: len(t["members"]) for t in types}
    return [
        {"interface": CONTAINERS[t["name"]], "nf": m["of"], "domain": next((d for p, d in DOMAINS if (m["clause"] or "").startswith(p)), ""), "event": m["name"], "type": m["type"], "tag": m["tag"], "clause": m["clause"], "fields": sizes.get(m["type"], 0)}
        for t in types
        if t["name"] in CONTAINERS
        for m in t["members"]
    ]


# --- OpenAPI ----------------------------------------------------------------------------

_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def load_document(data: str) -> dict[str, Any]:
    """JSON, or YAML where a YAML library is installed."""
    try:
        return json.loads(data)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML documents need a YAML library") from e
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        return yaml.load(data, Loader=loader) or {}


def references(node: Any) -> list[str]:
    """Names that a part of a document refers to, distinct, in first-seen order."""
    seen: dict[str, None] = {}
    todo = [node]
    while todo:
        n = todo.pop(0)
        if isinstance(n, dict):
            if isinstance(n.get("$ref"), str):
                seen.setdefault(n["$ref"].rsplit("/", 1)[-1])
            todo = [*n.values(), *todo]
        elif isinstance(n, list):
            todo = [*n, *todo]
    return list(seen)


def parse_openapi(data: str) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """(operations, schemas) of one document."""
    doc = load_document(data)
    version = str((doc.get("info") or {}).get("version", ""))
    operations = []
    for path, item in (doc.get("paths") or {}).items():
        for method in _METHODS:
            op = (item or {}).get(method)
            if not isinstance(op, dict):
                continue
            content = ((op.get("requestBody") or {}).get("content") or {}).values()
            request = next((r for c in content for r in references(c.get("schema"))), "")
            operations.append(
                {"path": path, "method": method.upper(), "operation_id": op.get("operationId", ""), "summary": op.get("summary", ""), "tags": list(op.get("tags") or []), "request_schema": request, "response_codes": sorted(map(str, op.get("responses") or {})), "api_version": version}
            )
    schemas = []
    for name, s in ((doc.get("components") or {}).get("schemas") or {}).items():
        s = s or {}
        values = list(map(str, s.get("enum") or [])) or [str(v) for part in s.get("anyOf") or [] for v in (part or {}).get("enum") or []]
        kind = "enum" if values else s.get("type") or next((k for k in ("allOf", "oneOf", "anyOf") if k in s), "object")
        schemas.append({"schema_name": name, "kind": kind, "description": s.get("description", ""), "properties": sorted(s.get("properties") or {}), "enum_values": values, "refs_out": references(s)})
    return operations, schemas


# --- change requests ----------------------------------------------------------------------



def parse_change_line(line: str) -> tuple[str, int | None, str, str] | None:
    """(number, revision, category, title) of a change line such as ``CR002r1 (cat B) two``."""
    m = re.match(r"^\s*(CR\s?\d{1,5})(?:\s*r(?:ev)?\.?\s*(\d{1,2}))?\s*\(cat(?:egory)?\.?\s*([A-F])\)\s*(.*)$", line.strip(), re.I)
    return (m[1].upper().replace(" ", ""), int(m[2]) if m[2] else None, m[3].upper(), m[4].strip()) if m else None


# --- catalogue pages ------------------------------------------------------------------------


def _date(text: str) -> date | None:
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d %b %Y"):
        try:
            return datetime.strptime(text.strip(), form).date()
        except ValueError:
            pass
    return None


def date_and_meeting(cell: str) -> tuple[date | None, str]:
    """``2020-07-03 (SA#88)`` as its date and meeting."""
    m = re.match(r"^\s*([^()]*?)\s*(?:\(([^()]*)\))?\s*$", cell)
    return (_date(m[1]), (m[2] or "").strip()) if m else (None, "")


def _by_header(html: str, wanted: dict[str, str]) -> list[dict[str, str]]:
    """Rows of tables whose header has all the wanted columns, by name."""
    out: list[dict[str, str]] = []
    places: dict[int, dict[str, int]] = {}
    for n, cells in table_rows(html):
        if n not in places:
            low = [c.lower() for c in cells]
            where = {k: next((i for i, c in enumerate(low) if v in c), -1) for k, v in wanted.items()}
            if all(i >= 0 for i in where.values()):
                places[n] = where
            continue
        out.append({k: cells[i] if i < len(cells) else "" for k, i in places[n].items()})
    return out


def parse_releases(html: str) -> list[dict[str, Any]]:
    """The release calendar: code, name, status, start and freeze dates, freeze meeting."""
    out = []
    for r in _by_header(html, {"code": "code", "name": "name", "status": "status", "start": "start", "freeze": "freeze"}):
        freeze, meeting = date_and_meeting(r["freeze"])
        out.append({"code": r["code"], "name": r["name"], "status": r["status"], "start_date": date_and_meeting(r["start"])[0], "freeze_date": freeze, "freeze_meeting": meeting})
    return out


def parse_status_report(html: str) -> list[dict[str, str]]:
    """Specs with their versions: spec_id, title, release, version, working_group."""
    return _by_header(html, {"spec_id": "spec", "title": "title", "release": "rel", "version": "ver", "working_group": "group"})
