import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.batching import assign_batches, greedy
from quarry.operators.embedding import BREAKER_PAUSE, EmbeddingError, HashEmbedder, HttpEmbedder, HttpError, RetryingEmbedder, embed_chunks
from quarry.operators.jobs import Job, JobRegistry
from quarry.operators.search import SearchRequest, batch_search, cosine, search
from quarry.plans.commands import Command, CommandError, parse_command
from quarry.plans.config import Config
from quarry.plans.engine import Engine, IndexError_
from quarry.plans.shell import Shell
from quarry.schema import FILES, STORED
from quarry.sources.repo_files import repo_files
from quarry.streaming.ingest import ingest_stream


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my-repo"
    for name, content in {
        "main.rs": "fn main() {}\n", "lib.rs": "pub fn lib() {}\n", "app.py": "def app():\n    return 1\n", "readme.md": "x", "target/debug.rs": "fn no() {}", "node_modules/pkg.ts": "function no() {}", "pkg/__init__.py": "x = 1\n",
        "pkg/_priv.py": "def priv(): pass\n", ".hidden/x.py": "y = 1\n", "pkg/blank.py": " \n", "logs/a.py": "a = 1\n", "logs/keep.py": "def keep(): pass\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / ".git").mkdir()
    (root / "logs" / ".gitignore").write_text("*.py\n!keep.py\n")
    return root


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


def test_walk(spark, tree):
    every = ["app.py", "bad.py", "lib.rs", "logs/keep.py", "main.rs", "pkg/__init__.py", "pkg/_priv.py", "pkg/blank.py"]
    assert names(repo_files(spark, str(tree)), tree) == every
    assert names(repo_files(spark, str(tree), ["**/*.rs"]), tree) == ["lib.rs", "main.rs"]
    assert names(repo_files(spark, str(tree), None, ["**/*.py"]), tree) == ["lib.rs", "main.rs"]
    assert names(repo_files(spark, str(tree), []), tree) == []
    named_build = tree.rename(tree.parent / "build")
    assert repo_files(spark, str(named_build)).count() == 0


def test_index_search_refresh(spark, tree, tmp_path):
    engine = Engine(spark, Config(store_path=str(tmp_path / "store"), embedding_dimensions=32))
    job = engine.index(str(tree))
    assert job.stage == "completed" and job.counters["discovered"] == 8 and job.counters["indexed"] == job.counters["chunked"] == 6 and job.counters["failed"] == 1 and "bad.py" in job.status()["recent_errors"][0]
    assert engine.store.list_collections() == ["quarry_my_repo"]
    before = {r.chunk_id for r in engine.store.chunks("my_repo").collect()}
    engine.index(str(tree))  # again: nothing changes
    assert {r.chunk_id for r in engine.store.chunks("my_repo").collect()} == before and len(before) == 6
    found = engine.search(SearchRequest("app", repo="my_repo", limit=3)).collect()
    assert found[0].symbol_name == "app" and len(found) == 3 and found[0].total_candidates == 6
    assert json.loads(engine.search_json(SearchRequest("app", repo="my_repo", language="Rust")))["total_candidates"] == 2
    assert json.loads(engine.search_json(SearchRequest("app")))["results"] == []
    (tree / "app.py").write_text("def app2():\n    return 2\n")
    (tree / "lib.rs").unlink()
    (tree / "new.go").write_text("package p\nfunc N() {}\n")
    # blank and unreadable files never get rows, so each refresh calls them added
    assert engine.refresh(str(tree)) == {"added": 3, "updated": 1, "deleted": 1, "unchanged": 4}
    assert {r.symbol_name for r in engine.store.chunks("my_repo").collect()} == {"main", "app2", "__init__", "priv", "keep", "N"}
    assert engine.refresh(str(tree), ["**/*.go"])["deleted"] == 0
    assert engine.request_delete("nothing") is None and not engine.confirm_delete()
    assert engine.request_delete("my_repo") == "quarry_my_repo" and engine.confirm_delete() and engine.store.list_collections() == []
    with pytest.raises(IndexError_):
        engine.index(str(tree / "missing"))


def test_cancelled_between_actions_stays_cancelled(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, Config(store_path=str(tmp_path / "store"), embedding_dimensions=8))
    job = Job("j", str(tree), "my_repo")
    monkeypatch.setattr(engine, "_note_errors", lambda j, rows: engine.registry.cancel("j"))
    assert engine.index(str(tree), job=job).stage == "cancelled" and engine.store.chunks("my_repo").count() == 0


def test_put_is_tried_again(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, Config(store_path=str(tmp_path / "store"), embedding_dimensions=8, max_retries=2))
    put, calls = engine.store.upsert, []
    engine.sleep = calls.append

    def failing(repo, rows):
        if len(calls) < 2:
            raise OSError("down")
        put(repo, rows)

    monkeypatch.setattr(engine.store, "upsert", failing)
    job = engine.index(str(tree))
    assert job.stage == "completed" and calls == [1.0, 2.0] and job.counters["indexed"] == 6
    monkeypatch.setattr(engine.store, "upsert", lambda repo, rows: 1 / 0)
    job = Job("k", str(tree), "my_repo")
    with pytest.raises(ZeroDivisionError):
        engine.index(str(tree), job=job)
    assert job.stage == "failed" and job.counters["failed"] >= 6


def test_shell(spark, tree, tmp_path):
    engine = Engine(spark, Config(store_path=str(tmp_path / "store"), embedding_dimensions=8, embedding_url="http://x"))
    shell = Shell(engine)
    assert shell.run(f"/index {tree}").startswith("indexing") and "error" in shell.run("/index /no/such/place") and "error" in shell.run("/nothing")
    shell.threads[0].join()
    assert shell.status()[0].startswith("my_repo [Completed] - D:8 ") and "quarry_my_repo" in shell.run("/refresh")
    found = json.loads(engine.search_json(SearchRequest("app", repo="my_repo", path_prefix="app.p")))
    engine.config.path_match = "exact"
    assert found["total_candidates"] == 1 and json.loads(engine.search_json(SearchRequest("app", repo="my_repo", path_prefix="app.p")))["total_candidates"] == 0
    assert [shell.run("/model ollama"), shell.run("/model"), shell.run("/model")] == ["model ollama", "model gemini", "model ollama"]
    assert isinstance(engine.embedder, HttpEmbedder) and engine.embedder.kind == "simple"
    assert "error" in shell.run("/confirm") and "confirm" in shell.run("/delete my_repo") and shell.run("no") == "not deleted"
    shell.run("/delete quarry_my_repo")
    assert shell.run("yes") == "deleted quarry_my_repo" and "index" in shell.run("?") and shell.run("/clear") == "" and shell.run("q") == "bye" and shell.done
    assert [x.partition(" ")[2] for x in shell.tail(1)] == ["bye"]


def test_names_of_models_reach_an_embedder():
    from quarry.plans.commands import MODELS
    from quarry.plans.engine import EMBEDDERS, embedder_of

    assert set(MODELS) <= set(EMBEDDERS)
    for name in EMBEDDERS:
        assert embedder_of(Config(active_embedder=name, embedding_url="http://x")).start_batch > 0
    for config in (Config(active_embedder="other"), Config(active_embedder="gemini")):
        with pytest.raises(ValueError):
            embedder_of(config)


def test_batch_search_equals_single_ones(spark, monkeypatch):
    monkeypatch.setattr("quarry.operators.search.QUERY_BLOCK", 3)
    rows = [(f"c{i:02}", [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(30)] + [("x", None), ("y", [0.0, 0.0, 0.0]), ("z", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(7)], "query_id long, vector array<float>")
    got = {(r.query_id, r.rank): r.chunk_id for r in batch_search(chunks, queries, 4).collect()}
    for i in range(7):
        q = F.array(*[F.lit(x) for x in (1.0, float(i), 0.5)])
        best = chunks.where("chunk_id <> 'z'").select("chunk_id", F.round(cosine(F.col("embedding"), q), 12).alias("s")).orderBy(F.desc("s"), "chunk_id").limit(4).collect()
        assert [got[i, n + 1] for n in range(4)] == [r.chunk_id for r in best]
    assert batch_search(chunks, queries.limit(0), 4).count() == 0 and "CartesianProduct" not in batch_search(chunks, queries, 4)._jdf.queryExecution().toString()


def test_stored_vectors_have_unit_length(spark):
    from quarry.operators.store import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] and [round(x, 6) for x in r[0]] for r in df.select(unit("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_rerank_formula(spark):
    chunks = spark.createDataFrame(
        [("a", "other", "x::other", None, [1.0, 0.0]), ("b", "Find", "m::find me", "find docs", [0.9, 0.1]), ("c", "finder", "m", None, [0.0, 0.0]), ("d", "z", "z", None, [1.0, 0.0])],
        "chunk_id string, symbol_name string, symbol_path string, doc_comment string, embedding array<float>",
    )
    full = chunks.select("*", *[F.lit("").alias(c) for c in ("repo", "path", "language", "symbol_kind", "chunk_text")], *[F.lit(1).alias(c) for c in ("line_start", "line_end")], F.lit(None).cast("string").alias("signature"))
    got = search(full, [1.0, 0.0], SearchRequest("find")).collect()
    want = {"Find": 0.9 / (0.82**0.5) + 0.15 + 0.05 + 0.03, "other": 1.0, "z": 1.0, "finder": 0.08}
    assert [r.symbol_name for r in got] == ["Find", "other", "z", "finder"]
    assert all(abs(r.score - want[r.symbol_name]) < 1e-5 for r in got)
    assert search(full, [1.0, 0.0], SearchRequest("find", limit=0)).count() == 0
    assert full.select(cosine(F.col("embedding"), F.lit(None).cast("array<double>"))).first()[0] == 0.0


def test_batches(spark):
    assert list(greedy([3, 3, 3, 10, 1], 6, 3)) == [0, 0, 1, 1, 2] and list(greedy([3, 3, 3, 10, 1], 6, 3, True)) == [0, 0, 1, 2, 3]
    df = spark.createDataFrame([(i, 3) for i in range(10)], "i long, t long").coalesce(1)
    assert [r.batch for r in assign_batches(df, "i", "t", 6, 100).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def scripted(*answers):
    left, slept = list(answers), []

    def post(url, body, headers, timeout):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return {"embeddings": x}

    client = RetryingEmbedder(HttpEmbedder("http://x", "m", kind="simple", post=post), 5, 0.5, slept.append, lambda: 0.0)
    return client, slept


def test_retries():
    client, slept = scripted(HttpError(429, "7"), HttpError(429), HttpError(429, "soon"), [[1.0]])
    assert client.embed(["a"], "t") == [[1.0]] and slept == [7.0, 1.0, 0.5, BREAKER_PAUSE] and client.batch_max == 6 and client.limited == 0
    client, slept = scripted(HttpError(400), HttpError(503), [[1.0]])
    assert client.embed(["a"], "t") == [[1.0]] and slept == [2.0, 4.0]
    for bad in (HttpError(302), OSError("down"), [[1.0], [2.0]]):
        client, slept = scripted(bad)
        with pytest.raises(EmbeddingError):
            client.embed(["a"], "t")
        assert not slept


def test_cache_and_failed_batches(spark):
    class Failing(HashEmbedder):
        def embed(self, texts, task):
            raise HttpError(302)

    rows = spark.createDataFrame([("k", "p", "h1"), ("k2", "p", "h2")], "symbol_name string, path string, content_hash string")
    rows = rows.select("*", *[F.lit("x").alias(c) for c in ("language", "symbol_kind", "signature", "doc_comment", "chunk_text")])
    cache = spark.createDataFrame([("h1", "hash", [1.0, 2.0])], "content_hash string, embedding_model string, embedding array<float>")
    got = {r.content_hash: (r.embedding, r.error is None) for r in embed_chunks(rows, Failing(2), cache).collect()}
    assert got == {"h1": ([1.0, 2.0], True), "h2": (None, False)}


def test_jobs():
    registry = JobRegistry()
    jobs = [Job(str(i), "/r", "r", f"2020-01-0{i}") for i in range(1, 5)]
    for j in jobs:
        registry.register(j)
    jobs[0].set_stage("completed")
    jobs[1].set_stage("failed")
    jobs[2].errors += [str(i) for i in range(12)]
    assert jobs[2].status()["recent_errors"] == [str(i) for i in range(11, 1, -1)]
    assert registry.cancel("3") and not registry.cancel("9") and jobs[2].stage == "cancelled" and registry.any_active()
    assert registry.cleanup(1) == 2 and [j.job_id for j in registry.list()] == ["3", "4"]
    assert registry.cancel_repo("r") == ["4"]


@pytest.mark.parametrize(
    ("line", "command"),
    [
        ("/index", None), ("/index /a/b c", Command("index", "/a/b c")), ('/index "/a b"', Command("index", "/a b")), ("/a/b", Command("index", "/a/b")), ("src", Command("index", "src")), ("/i C:\\x", Command("index", "C:\\x")),
        ("/delete", Command("delete")), ("/del selected", Command("delete")), ("d name", Command("delete", "name")), ("/delete a b", None), ("/model", Command("model")), ("/m OLLAMA", Command("model", "ollama")), ("/model x", None),
        ("/nothing", None), ('/index "a', None), ('/index a"b', None), ("", Command("help")), ("?", Command("help")), ("/QUIT", Command("quit")), ("yes", Command("confirm")), ("/clear now", None),
    ],
)
def test_commands(line, command):
    if command is None:
        with pytest.raises(CommandError):
            parse_command(line)
    else:
        assert parse_command(line) == command


def test_config():
    c = Config.from_env({"MAX_RETRIES": "7", "EMBEDDING_DIMENSIONS": "many"}, api_key="k")
    assert (c.max_retries, c.embedding_dimensions, c.api_key) == (7, 3072, "k")


def test_stream(spark, tmp_path):
    from quarry.operators.store import ChunkStore

    spark.createDataFrame([("a.py", "t", 3, "def f(): pass\n", None)], FILES).write.parquet(str(tmp_path / "in"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    for n in range(2):
        stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
        ingest_stream(stream, "r", store, HashEmbedder(8), str(tmp_path / f"ck{n}")).awaitTermination()
    assert store.chunks("r").count() == 1 and set(store.chunks("r").columns) >= {c.split()[0] for c in STORED.split(", ")}
