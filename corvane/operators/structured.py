"""Structure-aware chunking of Markdown, code, YAML and JSON texts.

Parsing needs a position-keeping scanner, so these run in an Arrow-batched function; plain text
stays with the native expressions of :mod:`corvane.operators.windows`.
"""

from __future__ import annotations

import ast
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.config import Settings
from corvane.operators.workers import map_batches, slices, tidy

COLUMNS = {"rel": "string", "chunk_index": "int", "content": "string", "position_start": "long", "position_end": "long", "metadata": "map<string,string>"}
SCHEMA = pa.schema(list(zip(COLUMNS, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())), strict=True)))
#: Characters of texts, and of chunks with ROW for each one's other columns, that a worker holds as Python objects at a time.
HELD, ROW = 1 << 20, 500


@dataclass(frozen=True)
class Piece:
    """A unit of a text before windows are cut: text, range in the source, labels."""

    text: str
    start: int
    end: int
    labels: dict[str, str] = field(default_factory=dict)


def windows(text: str, size: int, overlap: int, paragraphs: bool = False) -> list[tuple[int, int]]:
    """Ranges of windows, as in :mod:`corvane.operators.windows`."""
    out, start, stride = [], 0, max(1, size - overlap)
    while start < len(text):
        end = start + size
        if end < len(text) and (space := text.rfind(" ", start, end)) > start:
            end = space
        if paragraphs and 0 < (blank := text[start:end].rfind("\n\n")) < min(end, len(text)) - start - 20:
            end = start + blank + 2
        out.append((start, min(end, len(text))))
        if end >= len(text):
            break
        start += stride
    return out


class _Text(HTMLParser):
    BLOCK = frozenset("p div br hr li ul ol tr table blockquote section article pre h1 h2 h3 h4 h5 h6".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCK:
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(markup: str) -> str:
    """Text of markup; new lines stay, since Markdown gives them a meaning."""
    if "<" not in markup:
        return html.unescape(markup)
    p = _Text()
    p.feed(markup)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.parts))).strip("\n")


HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t].*|)$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def markdown(text: str) -> list[Piece]:
    """A piece for each section, its nested sections included, and then one for each nested section.

    Headings are lines of one to six ``#``, or paragraphs underlined by ``=`` or ``-``, outside fenced code.  Text before the first heading is a section
    without a label.  A blank text has none.
    """
    marks, at, fence, para = [], 0, "", None  # para: where the paragraph began that the last line belongs to
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        under = UNDERLINE.match(bare) if para is not None and not fence else None
        if m := FENCE.match(bare):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not bare.strip().strip(fence[0]):
                fence = ""
            para = None
        elif not fence and (m := HEADING.match(bare)):
            marks.append((len(m[1]), at, at + len(line), bare.strip()))
            para = None
        elif under:
            marks.append((1 if under[1][0] == "=" else 2, para, at + len(line), text[para:at].strip()))
            para = None
        elif fence or not bare.strip() or bare.startswith(("    ", "\t", ">", "- ", "* ", "+ ", "|")):
            para = None
        elif para is None:
            para = at
        at += len(line)
    out = []
    lead = text[: marks[0][1]] if marks else text
    if lead.strip():
        out.append(Piece(html_text(lead), 0, len(lead)))
    for i, (level, start, body, label) in enumerate(marks):
        end = next((s for n, s, _, _ in marks[i + 1 :] if n <= level), len(text))
        out.append(Piece(html_text(text[body:end]).strip("\n"), start, end, {"section": label}))
    return out


def _unit(text: str, start: int, end: int, function: str = "", owner: str = "") -> Piece:
    line = text.count("\n", 0, start) + 1
    labels = {"function_name": function, "class_name": owner, "line_start": str(line), "line_end": str(line + text.count("\n", start, end))}
    return Piece(text[start:end], start, end, labels)


def python_units(text: str) -> list[Piece]:
    """Outermost functions and classes, without decorators; by their indentation if the text doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return indented_units(text)
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    place = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            s, e = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            out.append(_unit(text, s, e, owner=node.name) if isinstance(node, ast.ClassDef) else _unit(text, s, e, node.name))
        else:
            todo.extend(ast.iter_child_nodes(node))
    return sorted(out, key=lambda p: p.start)


_UNIT = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")


def indented_units(text: str) -> list[Piece]:
    """A unit runs from its ``def`` or ``class`` line to the last line indented more, blank lines and comments aside."""
    out, at, unit = [], 0, None  # unit: indent, start, end, kind, name

    def close() -> None:
        if unit:
            _, start, end, kind, name = unit
            out.append(_unit(text, start, end, owner=name) if kind == "class" else _unit(text, start, end, name))

    for line in text.splitlines(keepends=True):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if unit and bare and (indent > unit[0] or bare[0] in ")]}"):
            unit[2] = at + len(line.rstrip())
        elif bare and not (unit and bare[0] == "#"):
            close()
            m = _UNIT.match(line)
            unit = [indent, at + indent, at + len(line.rstrip()), m[2], m[3]] if m else None
        at += len(line)
    close()
    return out


_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_FUNCTION = re.compile(rf"(?:async\s+)?function\s*\*?\s*({_NAME})")
_CLASS = re.compile(rf"(?:abstract\s+)?class\s+({_NAME})")
_ARROW = re.compile(rf"(?:const|let)\s+({_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_NAME})\s*(?::[^=]+?)?=>")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(#?{_NAME})\s*(?:<[^>{{}}]*>)?\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?(?={{)")
_RESERVED = frozenset("if for while switch catch return function new typeof super".split())


def script_units(text: str, typed: bool) -> list[Piece]:
    """Functions, arrow functions bound by const or let, and methods of JavaScript (or TypeScript, ``typed``).

    Classes give their methods: with the class's name in TypeScript, without in JavaScript.  A scan by
    brackets, with comments and strings blanked; units are not descended into.
    """
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)

    def close(at: int) -> int:
        depth = 0
        for i in range(at, len(blank)):
            depth += (blank[i] in "{([") - (blank[i] in "})]")
            if depth == 0:
                return i + 1
        return len(blank)

    def statement(at: int) -> int:
        """End of an arrow function's body: its braces, or the expression up to ``;`` or a line's end outside brackets."""
        while at < len(blank) and blank[at].isspace():
            at += 1
        if at < len(blank) and blank[at] == "{":
            return close(at)
        while at < len(blank) and blank[at] not in ";\n":
            at = close(at) if blank[at] in "{([" else at + 1
        return at

    out: list[Piece] = []

    def scan(at: int, end: int, owner: str | None) -> None:
        while at < end:
            if at and (blank[at - 1].isalnum() or blank[at - 1] in "_$."):
                at += 1
                continue
            if (m := _FUNCTION.match(blank, at, end)) and (b := blank.find("{", m.end())) >= 0:
                stop = close(b)
                out.append(_unit(text, at, stop, m[1]))
            elif (m := _CLASS.match(blank, at, end)) and (b := blank.find("{", m.end())) >= 0:
                stop = close(b)
                scan(b + 1, stop - 1, m[1])
            elif owner is None and (m := _ARROW.match(blank, at, end)):
                stop = statement(m.end())
                out.append(_unit(text, at, stop, m[1] if typed else ""))
            elif owner is not None and (m := _METHOD.match(blank, at, end)) and m[1] not in _RESERVED:
                stop = close(m.end())
                out.append(_unit(text, at, stop, m[1], owner if typed else ""))
            else:
                at = close(at) if owner is not None and blank[at] == "{" else at + 1
                continue
            at = stop

    scan(0, len(blank), None)
    return out


def yaml_type(value: str | None) -> str:
    v = (value or "").strip()
    if v in ("", "null", "~"):
        return "null"
    if v in ("true", "false", "yes", "no", "on", "off"):
        return "boolean"
    for kind, name in ((int, "integer"), (float, "float")):
        try:
            kind(v)
            return name
        except ValueError:
            pass
    return "string"


def yaml_pairs(text: str) -> list[Piece]:
    """A piece for each pair of the document's mappings, outer before inner: value text, dotted path, type.

    Lists are not descended into, but for one that is the whole document: its first mapping counts.  Pairs without a value or a plain key are left out.  Unreadable text has no pieces.
    """
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return []
    out: list[Piece] = []

    def walk(node, path: str) -> None:
        for key, value in node.value:
            if not isinstance(key, yaml.ScalarNode):
                continue
            name = f"{path}.{key.value}" if path else key.value
            s, e = value.start_mark.index, value.end_mark.index
            raw = text[s:e].rstrip()
            if not raw:
                continue
            if isinstance(value, yaml.MappingNode):
                kind = "mapping"
            elif isinstance(value, yaml.SequenceNode):
                kind = "sequence"
            else:
                kind = "string" if value.style in ("'", '"', "|", ">") else yaml_type(value.value)
            out.append(Piece(raw, s, s + len(raw), {"key_path": name, "value_type": kind}))
            if isinstance(value, yaml.MappingNode):
                walk(value, name)

    todo = [root]
    while todo:  # a document that is a list is read by its first mapping
        node = todo.pop()
        if isinstance(node, yaml.MappingNode):
            walk(node, "")
            break
        if isinstance(node, yaml.SequenceNode):
            todo += reversed(node.value)
    return out


_JSON = re.compile(r'\s*("(?:\\.|[^"\\])*"|[{}\[\],:]|[^\s{}\[\],:"]+)', re.S)


def json_leaves(text: str) -> list[Piece]:
    """A piece for each scalar inside an object or array: raw text, dotted path, type; none for a bare scalar.

    A scanner with a stack of open containers: it keeps offsets, and goes as far as the text is well formed.
    """
    out: list[Piece] = []
    stack: list[list] = []  # [is object, key or index, waits for a key]
    at = 0
    while m := _JSON.match(text, at):
        token, s, at = m[1], m.start(1), m.end()
        top = stack[-1] if stack else None
        if token in "{[":
            stack.append([token == "{", "" if token == "{" else 0, token == "{"])
        elif token in "}]":
            if stack:
                stack.pop()
        elif token == ",":
            if top and top[0]:
                top[2] = True
            elif top:
                top[1] += 1
        elif token == ":":
            if top:
                top[2] = False
        elif top and top[0] and top[2]:
            top[1] = token[1:-1]
        elif top:
            out.append(Piece(token, s, at, {"key_path": ".".join(str(x[1]) for x in stack), "value_type": _json_type(token)}))
    return out


def _json_type(token: str) -> str:
    if token[0] == '"':
        return "string"
    if token in ("true", "false"):
        return "boolean"
    if token == "null":
        return "null"
    try:
        float(token)
    except ValueError:
        return "unknown"
    return "float" if re.search(r"[.eE]", token) else "integer"


#: Extension (without dot) to scanner; others are plain text.  Callers may add to a copy.
REGISTRY: dict[str, Callable[[str], list[Piece]]] = {
    "md": markdown,
    "py": python_units,
    "js": lambda t: script_units(t, False),
    "ts": lambda t: script_units(t, True),
    "json": json_leaves,
    "yaml": yaml_pairs,
    "yml": yaml_pairs,
}
#: Kinds whose texts without any unit are chunked as plain text.
FALLBACK = frozenset({"py", "js", "ts"})


def split_text(text: str, extension: str, size: int = 500, overlap: int = 50, registry=None) -> list[Piece]:
    """Chunks of one text by its extension (with or without its dot, any case), in order."""
    ext = extension.lower().lstrip(".")
    scan = (registry or REGISTRY).get(ext)
    pieces = scan(text) if scan else []
    if not scan or (ext in FALLBACK and not pieces):
        return [Piece(text[a:b], a, b) for a, b in windows(text, size, overlap, paragraphs=True)]
    out = []
    for p in pieces:
        if len(p.text) <= size:
            out.append(p)
        else:
            out += [Piece(p.text[a:b], p.start + a, p.start + b, p.labels) for a, b in windows(p.text, size, overlap)]
    return out


def chunk_files(files: DataFrame, settings: Settings = Settings(), registry=None) -> DataFrame:  # noqa: B008
    """``files(rel, ext, text)`` to ``(rel, chunk_index, content, position_start, position_end, metadata)``, one row a chunk.

    Each file is chunked by itself, whole; null and empty texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, HELD):
                columns, held = [[] for _ in SCHEMA], 0
                for rel, ext, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for i, p in enumerate(split_text(text, ext or "", *settings.chunk_params(ext or ""), registry) if text else []):
                        for column, x in zip(columns, (rel, i, p.text, p.start, p.end, list(p.labels.items())), strict=True):
                            column.append(x)
                        held += len(p.text) + ROW
                        if held >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
                            columns, held = [[] for _ in SCHEMA], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    kinds = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
    return map_batches(files.select("rel", "ext", "text"), tidy(run), kinds)
