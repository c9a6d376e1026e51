"""Rust, Go and TypeScript by tokens and brackets: a definition begins with its key words and ends with its block, a semicolon or a line."""

from __future__ import annotations

import re

from quarry.operators.syntax.tree import Node, partners, scan

_COMMON = r"(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<number>\d[\w.]*)|(?P<space>[ \t\r\f]+)|(?P<mark>=>|->|::|\n|.)"
_BLOCK = r"(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))|"
_RUST = re.compile(_BLOCK + r"""(?P<string>b?r(?P<h>\#*)"[\s\S]*?(?:"(?P=h)|\Z)|b?"(?:\\.|[^"\\])*"?|b?'(?:\\[^\n]{1,10}?|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)|""" + _COMMON, re.S)
_GO = re.compile(_BLOCK + r"""(?P<string>`[^`]*`?|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|""" + _COMMON, re.S)
_TS = re.compile(_BLOCK + r"""(?P<string>`(?:\\.|[^`\\])*`?|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|""" + _COMMON, re.S)


class _Reader:
    """Walks tokens; a language says what begins at a token."""

    comment = staticmethod(lambda text: "comment")

    def __init__(self, source: str, pattern: re.Pattern, root: str):
        self.source, self.tokens = source, scan(source, pattern)
        self.partner = partners(self.tokens)
        self.root = Node(root, 0, len(source), children=self.block(0, len(self.tokens)))

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def after(self, i: int, stop: int) -> int:
        """The first token from i on that is neither a line break nor a comment."""
        while i < stop and self.tokens[i].kind in ("\n", "comment"):
            i += 1
        return i

    def until(self, i: int, stop: int, marks: tuple[str, ...]) -> int:
        """The first of marks from i on outside of brackets that open on the way, or stop."""
        while i < stop:
            if self.tokens[i].kind in marks:
                return i
            if self.tokens[i].kind in (")", "]", "}"):
                return stop if self.partner[i] == i and i + 1 >= stop else i
            i = max(i, self.partner[i]) + 1
        return stop

    def block(self, i: int, stop: int) -> list[Node]:
        out: list[Node] = []
        while i < stop:
            t = self.tokens[i]
            if t.kind == "\n":
                i += 1
                continue
            if t.kind == "comment":
                out.append(Node(self.comment(t.text), t.start, t.end))
                i += 1
                continue
            found = self.definition(i, stop, out)
            if found is not None:
                i, node = found
                out.append(node)
                continue
            close = self.partner[i]
            if close > i:
                out.append(Node("group", t.start, self.tokens[close].end, children=self.block(i + 1, close)))
                i = close + 1
            else:
                out.append(Node("token", t.start, t.end))
                i += 1
        return out

    def definition(self, i: int, stop: int, before: list[Node]) -> tuple[int, Node] | None:
        raise NotImplementedError

    def make(self, kind: str, first: int, last: int, name: str | None, body: int | None, inner: tuple[int, int] | None = None) -> tuple[int, Node]:
        """A node of tokens first to last; its children are read from inner, or from the block that body opens."""
        last = min(last, len(self.tokens) - 1)
        if inner is None and body is not None:
            inner = body + 1, self.partner[body]
        children = self.block(*inner) if inner else []
        return last + 1, Node(kind, self.tokens[first].start, self.tokens[last].end, name, None if body is None else self.tokens[body].start, children)


#: Words that begin an item, with the grammar's kind.
_RUST_ITEMS = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "type": "type_item", "const": "const_item", "static": "static_item", "mod": "mod_item", "trait": "trait_item", "impl": "impl_item"}


class _Rust(_Reader):
    comment = staticmethod(lambda text: "block_comment" if text.startswith("/*") else "line_comment")

    def definition(self, i, stop, before):
        if self.text(i) == "#" and self.text(i + 1) in ("[", "!"):
            k = i + 1 + (self.text(i + 1) == "!")
            close = self.partner[k] if k < stop else i
            return close + 1, Node("attribute_item", self.tokens[i].start, self.tokens[close].end)
        k = i
        if self.text(k) == "pub":
            k = self.after(k + 1, stop)
            if self.text(k) == "(":
                k = self.after(self.partner[k] + 1, stop)
        word = self.text(k)
        if word == "use" or word == "extern" and self.text(k + 1) == "crate":
            end = self.until(k, stop, (";",))
            return self.make("use_declaration" if word == "use" else "extern_crate_declaration", i, min(end, stop - 1), None, None)
        if word == "macro_rules" and self.text(k + 1) == "!":
            at = self.until(k + 2, stop, ("{", "(", "["))
            return None if at >= stop else self.make("macro_definition", i, self.partner[at], self.text(k + 2), None)
        while word in ("async", "unsafe", "extern", "default") or word == "const" and self.text(self.after(k + 1, stop)) in ("fn", "unsafe", "async", "extern"):
            k = self.after(k + 1, stop)
            if k < stop and self.tokens[k].kind == "string":
                k = self.after(k + 1, stop)
            word = self.text(k)
            if k >= stop:
                return None
        kind = _RUST_ITEMS.get(word)
        if kind is None or k + 1 >= stop or before and before[-1].kind == "token" and self.source[before[-1].start : before[-1].end] in (".", "::", "&", "<", "=", ":", "*", "->"):
            return None
        n = self.after(k + 1, stop)
        if kind == "static_item" or kind == "const_item":
            n = self.after(n + 1, stop) if self.text(n) == "mut" else n
        name = self.text(n) if n < stop and self.tokens[n].kind == "word" else None
        if kind != "impl_item" and name is None:
            return None
        if kind in ("type_item", "const_item", "static_item"):
            end = min(self.until(n, stop, (";",)), stop - 1)
            return self.make(kind, i, end, name, None, (n + 1, end))
        at = self.until(n, stop, ("{", ";"))
        if at >= stop:
            return None
        if self.text(at) == ";":
            return None if kind in ("function_item", "impl_item", "trait_item") else self.make(kind, i, at, name, None)
        if kind == "impl_item":
            name = self._impl_name(k + 1, at)
        return self.make(kind, i, self.partner[at], name, at)

    def _impl_name(self, i: int, stop: int) -> str | None:
        """The first of trait and type that is a plain name."""
        if self.text(i) == "<":
            i = self._angle(i, stop)
        while i < stop and self.text(i) != "where":
            i = self.after(i, stop)
            if self.text(i) == "!":
                i += 1
            if i < stop and self.tokens[i].kind == "word" and self.after(i + 1, stop) >= stop or self.text(self.after(i + 1, stop)) in ("for", "where") and self.tokens[i].kind == "word":
                return self.text(i)
            while i < stop and self.text(i) != "for":
                i = self._angle(i, stop) if self.text(i) == "<" else max(i, self.partner[i]) + 1
            i += 1
        return None

    def _angle(self, i: int, stop: int) -> int:
        depth = 0
        while i < stop:
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i += 1
            if depth <= 0:
                break
        return i


class _Go(_Reader):
    #: Words that begin a declaration, with the grammar's kind.
    declarations = {"import": "import_declaration", "type": "type_declaration", "const": "const_declaration", "var": "var_declaration"}

    def definition(self, i, stop, before):
        word = self.text(i)
        fresh = not before or "\n" in self.source[before[-1].end : self.tokens[i].start] or before[-1].kind == "comment" or self.source[before[-1].start : before[-1].end] == ";"
        if not fresh:
            return None
        if word in self.declarations:
            end = i + 1
            while end < stop and self.tokens[end].kind not in ("\n", ";"):
                end = max(end, self.partner[end]) + 1
            return self.make(self.declarations[word], i, end - 1, None, None, (i + 1, end))
        if word == "func":
            n, kind = i + 1, "function_declaration"
            if self.text(n) == "(":
                n, kind = self.partner[n] + 1, "method_declaration"
            if n >= stop or self.tokens[n].kind != "word":
                return None
            at = n + 1
            while at < stop and self.tokens[at].kind != "\n":
                if self.text(at) == "{" and self.text(at - 1) not in ("interface", "struct"):
                    return self.make(kind, i, self.partner[at], self.text(n), at)
                at = max(at, self.partner[at]) + 1
            return self.make(kind, i, at - 1, self.text(n), None)
        return None


#: Words that begin a declaration with a block, with the grammar's kind.
_TS_BLOCKS = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "namespace": "internal_module"}


class _TypeScript(_Reader):
    in_class = False

    def statement_end(self, i: int, stop: int) -> int:
        """The last token of a statement without a block: up to a semicolon or a line break that no operator spans."""
        last = i
        while i < stop and self.tokens[i].kind != ";":
            if self.tokens[i].kind == "\n":
                n = self.after(i, stop)
                if n >= stop or self.text(last) not in ("=", "+", "-", "*", "/", "=>", ",", "|", "&", "?", ":", ".", "(") and self.text(n) not in (".", "+", "-", "*", "?", ":", "|", "&", "="):
                    return last
            elif self.tokens[i].kind in ("}", ")", "]"):
                return last
            else:
                last = max(i, self.partner[i])
            i = max(i, self.partner[i]) + 1
        return i if i < stop else last

    def definition(self, i, stop, before):
        word = self.text(i)
        at_start = not before or self.source[before[-1].start : before[-1].end] not in (".", "=", "(", ",", "new", "?", ":") or "\n" in self.source[before[-1].end : self.tokens[i].start]
        if self.in_class and self.tokens[i].kind in ("word", "string", "number", "[", "#", "*"):
            return self.member(i, stop)
        if word == "import" and at_start and self.text(i + 1) not in ("(", "."):
            return self.make("import_statement", i, self.statement_end(i, stop), None, None)
        if word == "export" and at_start:
            inner = self.after(i + 1, stop)
            if self.text(inner) == "default":
                inner = self.after(inner + 1, stop)
            found = self.definition(inner, stop, []) if inner < stop else None
            if found is not None:
                end, node = found
                last = end - 1
                if self.text(end) == ";" and end < stop:
                    last = end
                return last + 1, Node("export_statement", self.tokens[i].start, self.tokens[last].end, None, None, [node])
            last = self.statement_end(i, stop)
            return self.make("export_statement", i, last, None, None, (inner, last + 1))
        k = self.after(i + 1, stop) if word in ("declare",) and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "word" else i
        head = self.text(k)
        if head == "async" and self.text(k + 1) == "function":
            k, head = k + 1, "function"
        if head == "const" and self.text(k + 1) == "enum":
            k, head = k + 1, "enum"
        n = k + 1
        named = n < stop and self.tokens[n].kind == "word"
        if head == "function" and at_start and named:
            at = self.until(n + 1, stop, ("{", ";"))
            return None if at >= stop or self.text(at) != "{" else self.make("function_declaration", i, self.partner[at], self.text(n), at)
        if head in _TS_BLOCKS and at_start and named and self.text(i) != "abstract" and not (before and self.source[before[-1].start : before[-1].end] == "abstract"):
            at = self.until(n + 1, stop, ("{",))
            if at >= stop:
                return None
            was, self.in_class = self.in_class, head == "class"
            made = self.make(_TS_BLOCKS[head], i, self.partner[at], self.text(n), at)
            self.in_class = was
            return made
        if head == "type" and at_start and named and self.text(n + 1) in ("=", "<"):
            return self.make("type_alias_declaration", i, self.statement_end(k, stop), self.text(n), None)
        if head in ("let", "const") and at_start and n < stop and self.tokens[n].kind in ("word", "{", "["):
            last = self.statement_end(k, stop)
            return self.make("lexical_declaration", i, last, None, None, (n, last + (self.text(last) != ";")))
        return self.arrow(i, stop)

    def arrow(self, i, stop):
        k = i + 1 if self.text(i) == "async" and self.text(i + 1) in ("(",) or self.text(i) == "async" and self.text(i + 2) == "=>" else i
        name, at = None, None
        if k < stop and self.tokens[k].kind == "word" and self.text(k + 1) == "=>":
            name, at = self.text(k), k + 1
        elif self.text(k) == "(":
            at = self.partner[k] + 1
            if self.text(at) == ":":
                at = self.until(at + 1, stop, ("=>", ";", "\n", "{", ",", ")"))
        if at is None or at + 1 >= stop or self.text(at) != "=>":
            return None
        body = self.after(at + 1, stop)
        if body >= stop:
            return None
        was, self.in_class = self.in_class, False
        if self.text(body) == "{":
            made = self.make("arrow_function", i, self.partner[body], name, body)
        else:
            last = body
            j = body
            while j < stop and self.tokens[j].kind not in (",", ";", ")", "]", "}") and not (self.tokens[j].kind == "\n" and self.text(self.after(j, stop)) not in (".", "?", ":", "+")):
                last = max(j, self.partner[j])
                j = last + 1
            made = self.make("arrow_function", i, last, name, None, (body, last + 1))
            made[1].body = self.tokens[body].start
        self.in_class = was
        return made

    def member(self, i, stop):
        k = i
        while self.text(k) in ("public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "*", "#", "abstract") and self.text(k + 1) not in ("(", "=", ":", ";", "?"):
            k += 1
        n = k
        k = self.partner[k] + 1 if self.text(k) == "[" else k + 1
        if self.text(k) == "<":
            k = self.until(k, stop, ("(",))
        was, self.in_class = self.in_class, False
        try:
            if k < stop and self.text(k) == "(":
                at = self.until(self.partner[k] + 1, stop, ("{", ";", "\n"))
                if at < stop and self.text(at) == "{":
                    return self.make("method_definition", i, self.partner[at], self.source[self.tokens[n].start : self.tokens[k - 1].end] if self.text(n) == "[" else self.text(n), at)
                return self.make("method_signature", i, max(i, min(at, stop) - 1), None, None)
            last = self.statement_end(i, stop)
            return self.make("field_definition", i, max(i, last), None, None, (k, max(k, last + 1)))
        finally:
            self.in_class = was


def read_rust(source: str) -> Node:
    return _Rust(source, _RUST, "source_file").root


def read_go(source: str) -> Node:
    return _Go(source, _GO, "source_file").root


def read_typescript(source: str) -> Node:
    return _TypeScript(source, _TS, "program").root
