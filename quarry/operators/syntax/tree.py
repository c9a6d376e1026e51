"""Nodes and the tokens they are read from. Sources are strings of one character per byte, so offsets are byte offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class Node:
    kind: str
    start: int
    end: int
    name: str | None = None
    body: int | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Token:
    """kind: word, number, string, comment, or the punctuation itself."""

    kind: str
    start: int
    end: int
    text: str


def scan(source: str, pattern: re.Pattern) -> list[Token]:
    """Tokens by the named groups of pattern; what nothing matches is skipped."""
    out = []
    for m in pattern.finditer(source):
        kind = m.lastgroup
        if kind != "space":
            out.append(Token(m[0] if kind == "mark" else kind, m.start(), m.end(), m[0]))
    return out


def partners(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one, or of the last token where it has none; for others their own index."""
    out, stack = list(range(len(tokens))), []
    for i, t in enumerate(tokens):
        if t.kind in OPEN:
            stack.append(i)
        elif t.kind in CLOSE:
            for k in range(len(stack) - 1, -1, -1):  # a bracket that was forgotten ends with the one around it
                if tokens[stack[k]].kind == CLOSE[t.kind]:
                    for j in stack[k:]:
                        out[j] = i
                    del stack[k:]
                    break
    for j in stack:
        out[j] = len(tokens) - 1
    return out
