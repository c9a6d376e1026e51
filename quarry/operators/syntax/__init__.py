"""Tolerant readers of five languages: each gives a small tree whose nodes bear the public grammars' kind names, for sources that may be broken."""

from __future__ import annotations

from quarry.operators.syntax.braces import read_go, read_rust, read_typescript
from quarry.operators.syntax.indented import read_python
from quarry.operators.syntax.tree import Node

READERS = {"python": read_python, "rust": read_rust, "go": read_go, "typescript": read_typescript, "tsx": read_typescript}


def read_tree(source: bytes, language: str) -> Node:
    """The root node of a source; offsets are bytes. Raises ValueError for a language without a reader."""
    if language not in READERS:
        raise ValueError(f"no reader for language {language!r}")
    return READERS[language](source.decode("latin-1"))
