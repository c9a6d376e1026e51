"""Files to chunks: a row per definition, in the order of the source, by way of the readers in syntax."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.identity import blake3_hex
from quarry.functions.paths import detect_language, is_language_allowed
from quarry.operators.chunk_rows import SLICE_LINES, SPLIT_BYTES
from quarry.operators.syntax import read_tree
from quarry.operators.syntax.tree import Node
from quarry.schema import CHUNK

_TS = ("function_declaration", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "export_statement", "lexical_declaration", "method_definition", "arrow_function")
#: The kinds of nodes that define, and that import, by language.
DEFINITIONS = {
    "rust": ("function_item", "impl_item", "struct_item", "enum_item", "type_item", "const_item", "static_item", "mod_item", "trait_item", "macro_definition"),
    "python": ("function_definition", "class_definition", "decorated_definition"),
    "typescript": _TS,
    "tsx": _TS,
    "go": ("function_declaration", "method_declaration", "type_declaration", "const_declaration", "var_declaration"),
}
IMPORTS = {"rust": ("use_declaration", "extern_crate_declaration"), "python": ("import_statement", "import_from_statement"), "typescript": ("import_statement",), "tsx": ("import_statement",), "go": ("import_declaration",)}
#: The kinds of symbols and the kinds of nodes that are one.
SYMBOL_KINDS = {
    "function": ("function_item", "function_definition", "function_declaration", "arrow_function"),
    "method": ("method_declaration", "method_definition"),
    "impl": ("impl_item",),
    "struct": ("struct_item",),
    "enum": ("enum_item", "enum_declaration"),
    "class": ("class_definition", "class_declaration"),
    "trait": ("trait_item",),
    "interface": ("interface_declaration",),
    "type_alias": ("type_item", "type_alias_declaration", "type_declaration"),
    "const": ("const_item", "const_declaration"),
    "static": ("static_item",),
    "variable": ("var_declaration", "lexical_declaration"),
    "module": ("mod_item",),
    "macro": ("macro_definition",),
    "export": ("export_statement",),
    "decorated": ("decorated_definition",),
}
_KIND = {node: symbol for symbol, nodes in SYMBOL_KINDS.items() for node in nodes}
_COMMENTS = ("comment", "line_comment", "block_comment", "doc_comment", "string")
_CALLABLE = SYMBOL_KINDS["function"] + SYMBOL_KINDS["method"]


def symbol_kind(node_kind: str) -> str:
    """The symbol kind of a node kind; one that is not known stands for itself."""
    return _KIND.get(node_kind, node_kind)


class _Chunker:
    """The rows of one file."""

    def __init__(self, source: str, language: str, path: str, hash_algorithm: str):
        self.raw = source.encode()
        self.language, self.path = language, path
        self.kinds = DEFINITIONS[language]
        self.hash = blake3_hex if hash_algorithm == "blake3" else lambda data: hashlib.sha256(data).hexdigest()
        self.tree = read_tree(self.raw, language)
        self.imports = "\n".join(self.text(n.start, n.end).strip() for n in self.tree.children if n.kind in IMPORTS[language]) or None
        self.rows: list[dict] = []

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def line(self, at: int) -> int:
        return self.raw.count(b"\n", 0, at) + 1

    def add(self, name: str, kind: str, path: str, parent: str | None, lines: tuple[int, int], span: tuple[int, int], text: str, signature: str | None = None, doc: str | None = None) -> None:
        self.rows.append(
            {
                "symbol_name": name, "symbol_kind": kind, "symbol_path": path, "parent_symbol": parent, "line_start": lines[0], "line_end": lines[1], "byte_start": span[0], "byte_end": span[1],
                "imports": self.imports, "signature": signature, "doc_comment": doc, "chunk_text": text, "content_hash": self.hash(text.encode()),
            }
        )

    def name(self, node: Node) -> str:
        if node.name is None and node.kind in ("decorated_definition", "export_statement"):
            inner = next((c for c in node.children if c.kind in self.kinds), None)
            return self.name(inner) if inner else "anonymous"
        return "anonymous" if node.name is None else node.name.encode("latin-1").decode("utf-8", "replace")

    def run(self) -> list[dict]:
        stack: list[tuple[list[Node], int, str | None]] = [(self.tree.children, 0, None)]
        while stack:
            nodes, i, parent = stack.pop()
            if i == len(nodes):
                continue
            stack.append((nodes, i + 1, parent))
            node = nodes[i]
            inner = parent
            if node.kind in self.kinds:
                inner = self.define(node, nodes, i, parent)
                if inner is None:
                    continue
            if node.children:
                stack.append((node.children, 0, inner))
        if not self.rows and self.raw.decode("utf-8", "replace").strip():
            text = self.raw.decode("utf-8", "replace")
            stem = self.path.replace("\\", "/").rpartition("/")[2]
            stem = (stem.rpartition(".")[0] or stem) or "unknown"
            self.add(stem, "module", stem, None, (1, text.count("\n") + (not text.endswith("\n"))), (0, len(self.raw)), text)
        return self.rows

    def define(self, node: Node, nodes: list[Node], at: int, parent: str | None) -> str | None:
        """Add a definition's rows; the symbol path for those inside, or None if a split has dealt with them."""
        name = self.name(node)
        path = name if parent is None else f"{parent}::{name}"
        kind = symbol_kind(node.kind)
        doc = self.doc(nodes, at)
        signature = self.text(node.start, node.body if node.body is not None else node.end).strip() if node.kind in _CALLABLE else None
        if node.end - node.start <= SPLIT_BYTES:
            self.add(name, kind, path, parent, (self.line(node.start), self.line(node.end)), (node.start, node.end), self.text(node.start, node.end), signature or None, doc)
            return path
        self.split(node, name, kind, path, signature or None, doc)
        return None

    def doc(self, nodes: list[Node], at: int) -> str | None:
        """The comments right before the node at a place of a list, however many."""
        found = []
        while at and nodes[at - 1].kind in _COMMENTS:
            at -= 1
            found.append(self.text(nodes[at].start, nodes[at].end).strip())
        return "\n".join(reversed(found)) or None

    def split(self, node: Node, name: str, kind: str, path: str, signature: str | None, doc: str | None) -> None:
        """Rows of an oversized definition: a head and its direct definitions, or slices of lines where it has none."""
        inner = [(i, c) for i, c in enumerate(node.children) if c.kind in self.kinds]
        first = self.line(node.start)
        if inner:
            start = inner[0][1].start
            head = self.text(node.start, start).strip()
            if head:
                self.add(name, f"{kind}_header", f"{path}::__header__", None, (first, self.line(start)), (node.start, start), head, signature, doc)
            for i, c in inner:
                own = self.name(c)
                sig = self.text(c.start, c.body if c.body is not None else c.end).strip() if c.kind in _CALLABLE else None
                self.add(own, symbol_kind(c.kind), f"{path}::{own}", path, (self.line(c.start), self.line(c.end)), (c.start, c.end), self.text(c.start, c.end), sig, self.doc(node.children, i))
            return
        lines = self.text(node.start, node.end).replace("\r\n", "\n").removesuffix("\n").split("\n")
        for part, i in enumerate(range(0, len(lines), SLICE_LINES)):
            piece = lines[i : i + SLICE_LINES]
            self.add(f"{name}__part{part}", f"{kind}_part", f"{path}::__part{part}__", path, (first + i, first + i + len(piece)), (node.start, node.end), "\n".join(piece), *((signature, doc) if part == 0 else (None, None)))


def chunk_source(source: str, language: str, path: str, hash_algorithm: str = "sha256") -> list[dict]:
    """The rows of one file; a blank file has none."""
    return _Chunker(source, language, path, hash_algorithm).run() if source.strip() else []


def chunk_files(files: DataFrame, repo: str, languages: list[str] | None = None, hash_algorithm: str = "sha256") -> DataFrame:
    """Of files (path, mtime, size, content) all chunks (CHUNK), with error: a row with a path and an error stands for a file that could not be read.
    Files of no known language, or of one that is not allowed, have no row."""
    known = files.withColumn("language", detect_language(F.col("path"))).where(F.col("language").isNotNull() & is_language_allowed(F.col("language"), languages))
    names = [f.split()[0] for f in CHUNK.split(", ")] + ["error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[dict] = []
            for path, mtime, size, content, language in pdf.itertuples(index=False):
                whole = {"repo": repo, "path": path, "language": language, "file_mtime": mtime, "file_size": size}
                try:
                    if content is None:
                        raise ValueError("the file is not UTF-8")
                    chunks = chunk_source(content, language, path, hash_algorithm)
                    digest = blake3_hex(content.encode()) if hash_algorithm == "blake3" else hashlib.sha256(content.encode()).hexdigest()
                    rows += [whole | c | {"file_hash": digest} for c in chunks]
                except Exception as e:  # one file's failure is a row, not the job's
                    rows.append(whole | {"error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=names)
            for c in ("line_start", "line_end", "byte_start", "byte_end", "file_size"):
                out[c] = out[c].astype("Int64")
            yield out.astype({c: object for c in names if out[c].dtype == float}).where(out.notna(), None)

    return known.select("path", "mtime", "size", "content", "language").mapInPandas(run, f"{CHUNK}, error string")
