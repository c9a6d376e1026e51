import pytest

from quarry.operators.chunking import chunk_files, chunk_source, symbol_kind


def rows(source, language, path="a/b.x"):
    return [(r["symbol_kind"], r["symbol_path"]) for r in chunk_source(source, language, path)]


def test_rust():
    source = "/// Says.\nfn greet() { 1 }\nstruct Config;\nimpl Config { fn new() {} fn get_name(&self) {} }\nimpl Tr for U {}\nimpl fmt::D for U {}\nimpl<T> Foo<T> {}\n"
    assert rows(source, "rust") == [
        ("function", "greet"), ("struct", "Config"), ("impl", "Config"), ("function", "Config::new"), ("function", "Config::get_name"), ("impl", "Tr"), ("impl", "U"), ("impl", "anonymous"),
    ]
    first = chunk_source(source, "rust", "a.rs")[0]
    assert first["doc_comment"] == "/// Says." and first["signature"] == "fn greet()" and first["chunk_text"] == "fn greet() { 1 }" and first["line_start"] == 2
    assert chunk_source("/// d\n#[test]\nfn f() {}\n", "rust", "a.rs")[0]["doc_comment"] is None


@pytest.mark.parametrize("body", ["1", "x" * 20_000])
def test_doc_comments_have_no_bound(body):
    lines = [f"/// line {i}" for i in range(500)]
    first = chunk_source("struct S;\n" + "\n".join(lines) + f"\nfn f() {{ {body} }}\n", "rust", "a.rs")[1]
    assert first["doc_comment"] == "\n".join(lines)


def test_python():
    source = "import os\n# c\ndef f(a):\n    return a\n\n@d\nclass C:\n    def m(self):\n        pass\n"
    assert rows(source, "python") == [("function", "f"), ("decorated", "C"), ("class", "C::C"), ("function", "C::C::m")]
    assert [r["imports"] for r in chunk_source(source, "python", "a.py")] == ["import os"] * 4


def test_typescript_and_go():
    assert rows("export class C { m() { const x = 1; } }\nlet f = (a) => a;\n", "typescript") == [("export", "C"), ("class", "C::C"), ("method", "C::C::m"), ("variable", "C::C::m::anonymous"), ("variable", "anonymous"), ("function", "anonymous::anonymous")]
    assert rows("package p\nfunc F() {}\nfunc (s S) M() {}\ntype T struct {\n a int\n}\n", "go") == [("function", "F"), ("method", "M"), ("type_alias", "anonymous")]


def test_whole_file_and_blank():
    assert rows("words\nmore\n", "python", "x/y.py") == [("module", "y")] and rows(" \n", "python") == []


def test_splits():
    body = "".join(f"    x = {i}  # {'y' * 40}\n" for i in range(500))
    parts = chunk_source(f"def f():\n{body}", "python", "a.py")
    assert [r["symbol_kind"] for r in parts] == ["function_part"] * 3 and parts[1]["symbol_path"] == "f::__part1__" and parts[1]["signature"] is None and parts[0]["signature"] == "def f():"
    assert (parts[0]["line_start"], parts[0]["line_end"]) == (1, 201) and parts[2]["byte_end"] == parts[0]["byte_end"]
    split = chunk_source(f"@d\ndef f():\n{body}", "python", "a.py")
    assert [r["symbol_kind"] for r in split] == ["decorated_header", "function"] and split[0]["chunk_text"] == "@d" and split[1]["symbol_path"] == "f::f"


@pytest.mark.parametrize("source", ["fn f( {", "class C:\n def", "'", '"""', "func (", "export", "impl", "const", "((((", "}}}}", "@", "a => ", "\x00", "é = 'ü'", "async", "type T =", "fn f<"])
@pytest.mark.parametrize("language", ["rust", "python", "typescript", "tsx", "go"])
def test_broken_sources_do_not_fail(source, language):
    for r in chunk_source(source, language, "a"):
        assert r["byte_start"] <= r["byte_end"] <= len(source.encode())


def test_files_and_errors(spark):
    files = spark.createDataFrame([("a.py", "t", 3, "def f(): pass\n"), ("b.rs", "t", 1, None), ("c.md", "t", 1, "x"), ("d.go", "t", 1, " ")], "path string, mtime string, size long, content string")
    got = {(r.path, r.symbol_name, r.error is None) for r in chunk_files(files, "repo").collect()}
    assert got == {("a.py", "f", True), ("b.rs", None, False)}
    assert chunk_files(files, "repo", ["RUST"]).count() == 1 and chunk_files(files, "repo", []).count() == 0
    assert symbol_kind("odd_thing") == "odd_thing"
