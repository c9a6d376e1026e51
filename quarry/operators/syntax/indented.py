"""Python by its indentation: definitions, decorators, comments and imports; all other lines are plain statements."""

from __future__ import annotations

import re

from quarry.operators.syntax.tree import CLOSE, OPEN, Node, scan

_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>[A-Za-z]{0,2}(?:\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?))"""
    r"""|(?P<word>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<space>\\\r?\n|[ \t\r\f])|(?P<mark>\n|.)""",
    re.S,
)


class _Line:
    """A logical line: its indentation, tokens, and offsets."""

    def __init__(self, source: str, tokens: list):
        self.tokens, self.start, self.end = tokens, tokens[0].start, tokens[-1].end
        self.indent = len(source[source.rfind("\n", 0, self.start) + 1 : self.start].expandtabs(8))
        self.comment = tokens[0].kind == "comment"


def _lines(source: str) -> list[_Line]:
    lines, now, depth = [], [], 0
    for t in scan(source, _TOKEN):
        if t.kind in OPEN:
            depth += 1
        elif t.kind in CLOSE:
            depth = max(0, depth - 1)
        if t.kind == "\n":
            if not depth and now:
                lines.append(_Line(source, now))
                now = []
        elif t.kind == "comment" and not depth:
            if now:  # behind a statement: a node of its own, as is a comment on its own line
                lines.append(_Line(source, now))
                lines[-1].trailing = t
                now = []
            else:
                lines.append(_Line(source, [t]))
        elif t.kind != "comment":
            now.append(t)
    if now:
        lines.append(_Line(source, now))
    return lines


def read_python(source: str) -> Node:
    lines = _lines(source)
    root = Node("module", 0, len(source))

    def block(i: int, indent: int) -> tuple[int, list[Node]]:
        """Statements from line i on, as far as they are indented by indent or more."""
        out: list[Node] = []
        while i < len(lines) and (lines[i].indent >= indent or lines[i].comment and any(x.indent >= indent and not x.comment for x in lines[i : _next_code(lines, i) + 1])):
            i, node = statement(i)
            out.append(node)
        return i, out

    def statement(i: int) -> tuple[int, Node]:
        line = lines[i]
        words = [t.text for t in line.tokens[:3]]
        if line.comment:
            return i + 1, Node("comment", line.start, line.end)
        if words[0] == "@":
            start, j = line.start, i
            while j < len(lines) and (lines[j].comment or lines[j].tokens[0].text == "@") and lines[j].indent >= line.indent:
                j += 1
            if j < len(lines) and lines[j].indent == line.indent and _defines(lines[j]):
                j, inner = definition(j)
                return j, Node("decorated_definition", start, inner.end, None, None, [*(Node("decorator", x.start, x.end) for x in lines[i:j] if not x.comment and x.tokens[0].text == "@" and x.start < inner.start), inner])
            return i + 1, Node("decorator", line.start, line.end)
        if _defines(line):
            return definition(i)
        if words[0] == "import":
            return i + 1, Node("import_statement", line.start, line.end)
        if words[0] == "from" and any(t.text == "import" for t in line.tokens):
            return i + 1, Node("future_import_statement" if words[1] == "__future__" else "import_from_statement", line.start, line.end)
        end, inner = i + 1, []
        if line.tokens[-1].text == ":":  # a compound statement
            end, inner = block(i + 1, line.indent + 1)
        return end, Node("statement", line.start, max([line.end, *(c.end for c in inner)]), None, None, inner)

    def definition(i: int) -> tuple[int, Node]:
        line = lines[i]
        tokens = line.tokens
        k = 1 if tokens[0].text == "async" else 0
        kind = "class_definition" if tokens[k].text == "class" else "function_definition"
        name = tokens[k + 1].text if len(tokens) > k + 1 and tokens[k + 1].kind == "word" else None
        depth, colon = 0, len(tokens) - 1
        for j, t in enumerate(tokens):
            depth += (t.kind in OPEN) - (t.kind in CLOSE)
            if t.text == ":" and not depth:
                colon = j
                break
        node = Node(kind, line.start, line.end, name)
        if colon < len(tokens) - 1:  # the body stands on the same line
            node.body = tokens[colon + 1].start
            return i + 1, node
        i, node.children = block(i + 1, line.indent + 1)
        while node.children and node.children[-1].kind == "comment" and _indent(source, node.children[-1].start) <= line.indent:
            node.children.pop()
            i -= 1
        code = [c for c in node.children if c.kind != "comment"]
        if code:
            node.body, node.end = code[0].start, code[-1].end
        return i, node

    i = 0
    while i < len(lines):
        i, made = block(i, 0)
        root.children += made
    return root


def _defines(line: _Line) -> bool:
    words = [t.text for t in line.tokens[:2]]
    return words[0] in ("def", "class") or words[:2] == ["async", "def"]


def _next_code(lines: list[_Line], i: int) -> int:
    while i < len(lines) - 1 and lines[i].comment:
        i += 1
    return i


def _indent(source: str, start: int) -> int:
    return len(source[source.rfind("\n", 0, start) + 1 : start].expandtabs(8))
