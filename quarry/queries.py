"""The registered queries of the indexing engine and their SQL: each key of QUERIES takes (spark, sf_dir).

Tables stand in for a store: documents are files (text is content, source the repository, lang the language), embeddings are the vectors of
documents (vec_id is doc_id), pages' urls are paths, events are job events, conversations and benchmark are queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import identity, paths, text
from quarry.operators import batching, chunk_rows, jobs, refresh, search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The stored vector that stands for an embedded query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = docs.join(vectors, docs.doc_id == vectors.vec_id)
    return joined.select(
        F.format_string("%012d", "doc_id").alias("chunk_id"), F.col("source").alias("repo"), F.concat_ws("/", "source", "lang").alias("path"), F.col("lang").alias("language"),
        F.col("source").alias("symbol_name"), F.when(F.col("label") % 2 == 0, "function").otherwise("struct").alias("symbol_kind"), F.concat_ws("::", "source", "lang").alias("symbol_path"),
        F.lit(1).alias("line_start"), F.col("n_chars").cast("int").alias("line_end"), F.lit(None).cast("string").alias("signature"), F.when(F.col("label") < 5, F.col("text")).alias("doc_comment"), F.col("text").alias("chunk_text"), "embedding",
    )


_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_COS = "coalesce(list_cosine_similarity(embedding::double[], q), 0)"


@query(f"select vec_id, row_number() over (order by s desc, vec_id) as rank, round(s, 6) as score from (select vec_id, {_COS} as s from embeddings, {_Q}) order by s desc, vec_id limit 10")
def vector_topk(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    best = table(spark, sf_dir, "embeddings").select("vec_id", search.cosine(F.col("embedding"), q).alias("s")).orderBy(F.desc("s"), "vec_id").limit(10)
    return best.select("vec_id", F.row_number().over(Window.orderBy(F.desc("s"), "vec_id")).cast("long").alias("rank"), F.round("s", 6).alias("score"))


@query(f"select vec_id, label, round({_COS}, 6) as score from embeddings, {_Q} where label = 3 order by {_COS} desc, vec_id limit 10")
def vector_topk_filtered(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    kept = table(spark, sf_dir, "embeddings").where("label = 3").withColumn("s", search.cosine(F.col("embedding"), q))
    return kept.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("score"))


_CHUNKS = """(select printf('%012d', doc_id) as chunk_id, source as repo, source || '/' || lang as path, lang as language, source as symbol_name, source || '::' || lang as symbol_path,
    case when label < 5 then "text" end as doc_comment, "text" as snippet, embedding from documents join embeddings on doc_id = vec_id)"""
_WORDS = "list_filter(string_split_regex(lower('The of then'), '\\s+'), lambda w: w <> '')"


def _ratio(c: str) -> str:
    return f"len(list_filter({_WORDS}, lambda w: contains(lower({c}), w))) / greatest(len({_WORDS}), 1)"


_RERANK = f"""with c as (select *, {_COS} as s from {_CHUNKS}, {_Q} where language = 'en' order by s desc, chunk_id limit 30),
    r as (select *, count(*) over () as total_candidates, s + case when lower(symbol_name) = lower('The of then') then 0.15 when contains(lower(symbol_name), lower('The of then')) then 0.08 else 0 end
    + {_ratio("symbol_path")} * 0.05 + case when doc_comment is not null then {_ratio("doc_comment")} * 0.03 else 0 end + 0.02 as a from c)
    select repo, path, symbol_name, symbol_path, snippet, round(a, 5) as score, total_candidates from r order by a desc, s desc, chunk_id limit 10"""


@query(_RERANK)
def search_rerank(spark, sf_dir):
    found = search.search(_chunks(spark, sf_dir), _vector(spark, sf_dir), search.SearchRequest("The of then", language="EN", limit=10))
    return found.select("repo", "path", "symbol_name", "symbol_path", "snippet", F.round(F.col("score").cast("double"), 5).alias("score"), "total_candidates")


@query(f"with c as (select chunk_id, round({_COS}, 6) as score from {_CHUNKS}, {_Q} order by {_COS} desc, chunk_id limit 100) select count(*) as total_candidates, min(score) as least from c")
def overfetch_limit(spark, sf_dir):
    found = search.candidates(_chunks(spark, sf_dir), _vector(spark, sf_dir), search.SearchRequest("x", limit=200))
    return found.agg(F.count(F.lit(1)).alias("total_candidates"), F.round(F.min("score"), 6).alias("least"))


@query("""with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as chunk_id, coalesce(list_cosine_similarity(embedding::double[], q), 0) as s from embeddings, q)
    select query_id, row_number() over (partition by query_id order by s desc, chunk_id) as rank, chunk_id, round(s, 6) as score from s qualify rank <= 5""")
def batch_search_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batch_search(chunks, queries, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query("""select doc_id, cast(case when lower(source) = 'src1' then 0.15 when contains(lower(source), 'src1') then 0.08 else 0.0 end as double) as boost from documents""")
def symbol_boost(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", search.boost(F.lit("SRC1"), F.col("source"), F.lit(""), none).alias("boost"))


@query(f"select doc_id, round({_ratio('source')} * 0.05 + {_ratio('\"text\"')} * 0.03, 6) as boost from documents")
def term_ratio_boost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(search.boost(F.lit("The of then"), F.lit(""), F.col("source"), F.col("text")), 6).alias("boost"))


@query('select doc_id, sha256("text") as content_hash from documents')
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))


@query()
def content_hash_blake3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.col("text"), "blake3").alias("content_hash"))


_NAME = """source || ':' || lang || ':' || 'module' || ':0:' || strlen("text") || ':' || sha256("text")"""


@query(f"""select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) as chunk_id
    from (select doc_id, sha1(unhex('{identity.NAMESPACE.replace("-", "")}') || encode({_NAME})) as h from documents)""")
def chunk_id_uuid5(spark, sf_dir):
    hashed = identity.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", identity.chunk_id("source", "lang", F.lit("module"), F.lit(0), F.octet_length("text"), hashed).alias("chunk_id"))


_LAST = "regexp_extract(url, '([^/]+)/*$', 1)"
_CLEAN = f"trim(regexp_replace(translate({_LAST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '_', 'g'), '_')"


@query(f"select page_id, {_CLEAN} as name from pages")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.sanitize_name(F.col("url")).alias("name"))


@query(f"select page_id, 'quarry_' || {_CLEAN} as collection from pages")
def collection_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.collection_name(paths.sanitize_name(F.col("url"))).alias("collection"))


@query("select distinct 'quarry_' || source as collection from documents where 'quarry_' || source in ('src1', 'quarry_src1')")
def collection_resolution(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(paths.collection_name(F.col("source")).alias("collection"))
    return named.where(paths.resolves_to(F.col("collection"), "src1")).distinct()


@query('select doc_id, cast(strlen("text") // 4 as bigint) as tokens from documents')
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.token_estimate(F.col("text")).alias("tokens"))


@query('select doc_id, cast(strlen("text") // 4 + 258 + strlen(source) // 1000 as bigint) as remote, cast(coalesce(case when lang = \'en\' then strlen("text") // 4 end, 10) as bigint) as local from documents')
def multimodal_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    english = F.when(F.col("lang") == "en", F.col("text"))
    return d.select("doc_id", identity.multimodal_token_estimate(F.col("text"), F.col("source")).alias("remote"), identity.multimodal_token_estimate(english, F.col("source"), remote=False).alias("local"))


@query("""select doc_id, concat_ws(chr(10), 'Language: ' || lang, 'File: ' || source, 'function ' || source, case when n_chars % 2 = 0 then 'Signature: ' || lang end, case when n_chars % 3 = 0 then 'Documentation: ' || source end, '', "text") as embed_text from documents""")
def embed_text_template(spark, sf_dir):
    made = text.embedding_text(F.col("lang"), F.col("source"), F.lit("function"), F.col("source"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")), F.when(F.col("n_chars") % 3 == 0, F.col("source")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("embed_text"))


@query("""select doc_id, case when lang = 'en' then '[Image: ' || source || '] ' || "text" else '[Uncaptioned Image: ' || source || ']' end as fallback, case when lang = 'en' then 2 else 1 end as n_parts from documents""")
def multimodal_inputs(spark, sf_dir):
    caption = F.when(F.col("lang") == "en", F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.multimodal_text(caption, F.col("source")).alias("fallback"), F.size(text.multimodal_parts(caption, F.col("source"), F.lit("AA=="))).alias("n_parts"))


@query("select conv_id, turn, list_filter(string_split_regex(lower(\"text\"), '\\s+'), lambda w: w <> '')[1:20] as terms from conversations".replace("[1:20] as terms", "[1:20] as l").replace("select conv_id, turn,", "select conv_id, turn, array_to_string(").replace("[1:20] as l", ", ' ') as terms"))
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("select page_id, regexp_full_match(url, 'http.*://.*(?:.*/)?en/.*', 's') and not regexp_full_match(url, '.*[?]page=[1-5]&.*', 's') as matched from pages")
def glob_include_exclude(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.matches_globs(F.col("url"), ["http*://*/**/en/*", "broken["], ["*[?]page=[1-5]&*"]).alias("matched"))


_SUFFIX = "url || case page_id % 8 when 0 then '/node_modules/a.rs' when 1 then '/x.py' when 2 then '/t.tsx' when 3 then '/g.go' when 4 then '/build/m.ts' when 5 then '/README' when 6 then '/i.PNG' else '/.rs' end"


def _suffixed(spark, sf_dir) -> DataFrame:
    ends = ["/node_modules/a.rs", "/x.py", "/t.tsx", "/g.go", "/build/m.ts", "/README", "/i.PNG", "/.rs"]
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))


@query("select page_id, page_id % 8 in (0, 4) as skipped from pages")
def skip_dirs(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("page_id", paths.in_skipped_directory(F.col("path")).alias("skipped"))


@query("select page_id, case page_id % 8 when 0 then 'rust' when 1 then 'python' when 2 then 'tsx' when 3 then 'go' when 4 then 'typescript' end as language from pages")
def language_detect(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("page_id", paths.detect_language(F.col("path")).alias("language"))


@query("select page_id, page_id % 8 = 6 as is_binary from pages")
def binary_ext(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("page_id", paths.is_binary(F.col("path")).alias("is_binary"))


@query("select page_id from pages where page_id % 8 in (0, 3)")
def language_allow(spark, sf_dir):
    return _suffixed(spark, sf_dir).where(paths.is_language_allowed(paths.detect_language(F.col("path")), ["Rust", "GO"])).select("page_id")


@query(f"select page_id, regexp_extract({_SUFFIX}, '([^/]*)$', 1) as base, case page_id % 8 when 0 then 'a' when 1 then 'x' when 2 then 't' when 3 then 'g' when 4 then 'm' when 5 then 'README' when 6 then 'i' else '.rs' end as stem from pages")
def file_names(spark, sf_dir):
    return _suffixed(spark, sf_dir).select("page_id", paths.base_name(F.col("path")).alias("base"), paths.file_stem(F.col("path")).alias("stem"))


@query("select page_id, case when starts_with(url, 'https://') then substr(url, 9) else url end as relative from pages")
def relative_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.relative_path(F.col("url"), "https:/").alias("relative")).withColumn("relative", F.regexp_replace("relative", r"\A/", ""))


@query(f"select chunk_id from {_CHUNKS} where path = 'src1/en'")
def path_exact(spark, sf_dir):
    return _chunks(spark, sf_dir).where(search.search_filter(search.SearchRequest("", path_prefix="src1/en", path_match="exact"))).select("chunk_id")


@query(f"select chunk_id from {_CHUNKS} where starts_with(path, 'src1') and language = 'en'")
def path_prefix(spark, sf_dir):
    return _chunks(spark, sf_dir).where(search.search_filter(search.SearchRequest("", language="EN", path_prefix="src1"))).select("chunk_id")


@query("select doc_id, length(trim(regexp_replace(\"text\", '\\s+', ' ', 'g'))) = 0 as blank from documents")
def blank_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_blank(F.col("text")).alias("blank"))


@query("""with d as (select doc_id, string_split(regexp_replace(replace("text", chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) as l from documents), p as (select doc_id, l, unnest(range(0, (len(l) - 1) // 20 + 1)) as part from d)
    select doc_id, cast(part as int) as part, cast(len(l[part * 20 + 1:part * 20 + 20]) as int) as n_lines, array_to_string(l[part * 20 + 1:part * 20 + 20], chr(10)) as part_text from p""")
def line_parts(spark, sf_dir):
    return chunk_rows.line_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 20)


@query("""select source || '.' || lang as path, source as symbol_name, 'module' as symbol_kind, source as symbol_path, 1 as line_start, cast(len(string_split(regexp_replace(replace("text", chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) as int) as line_end, 0 as byte_start, cast(strlen("text") as int) as byte_end from documents""")
def module_fallback(spark, sf_dir):
    return chunk_rows.module_rows(table(spark, sf_dir, "documents").select(F.concat_ws(".", "source", "lang").alias("path"), F.col("text").alias("content")))


def _greedy_sql(before: bool) -> str:
    if before:
        new, size = "(b.n > 0 and (b.run + i.t > 8000 or b.n >= 50))", "i.t"
        step = f"select i.r, i.doc_id, case when {new} then b.batch + 1 else b.batch end, case when {new} then {size} else b.run + {size} end, case when {new} then 1 else b.n + 1 end from b join i on i.r = b.r + 1 and i.source = b.source"
    else:
        new = "(b.n >= 50 or b.run >= 8000)"
        step = f"select i.r, i.doc_id, case when {new} then b.batch + 1 else b.batch end, case when {new} then i.t else b.run + i.t end, case when {new} then 1 else b.n + 1 end from b join i on i.r = b.r + 1 and i.source = b.source"
    step = step.replace("select i.r,", "select i.source, i.r,")
    return f"""with recursive i as (select source, doc_id, strlen("text") // 4 as t, row_number() over (partition by source order by doc_id) as r from documents),
        b as (select source, r, doc_id, 0 as batch, t as run, 1 as n from i where r = 1 union all {step}) select source, doc_id, cast(batch as bigint) as batch from b"""


@query(_greedy_sql(False))
def greedy_batches(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", identity.token_estimate(F.col("text")).alias("tokens"))
    return batching.assign_batches(sized, "doc_id", "tokens", group="source").select("source", "doc_id", "batch")


@query(_greedy_sql(True))
def greedy_batches_pre(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", identity.token_estimate(F.col("text")).alias("tokens"))
    return batching.assign_batches(sized, "doc_id", "tokens", before=True, group="source").select("source", "doc_id", "batch")


_CACHE = """(select sha256("text") as h, arg_min(vec_id, vec_id) as v from documents join embeddings on doc_id = vec_id where doc_id % 2 = 0 group by 1)"""


def _cached(spark, sf_dir):
    from quarry.operators.embedding import embedding_cache

    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    hashed = docs.select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))
    stored = hashed.where("doc_id % 2 = 0").join(vectors, hashed.doc_id == vectors.vec_id).select(F.col("doc_id").alias("chunk_id"), "content_hash", F.lit("m").alias("embedding_model"), "embedding")
    return hashed.withColumn("embedding_model", F.lit("m")), embedding_cache(stored)


@query(f"select doc_id from documents where sha256(\"text\") in (select h from {_CACHE})")
def cache_hits(spark, sf_dir):
    chunks, cache = _cached(spark, sf_dir)
    return chunks.join(cache, ["content_hash", "embedding_model"], "left_semi").select("doc_id")


@query(f"select doc_id from documents where sha256(\"text\") not in (select h from {_CACHE})")
def cache_misses(spark, sf_dir):
    chunks, cache = _cached(spark, sf_dir)
    return chunks.join(cache, ["content_hash", "embedding_model"], "left_anti").select("doc_id")


@query(f"select doc_id, round(list_sum(embedding::double[]), 5) as total from documents left join {_CACHE} on h = sha256(\"text\") left join embeddings on vec_id = v")
def cache_join(spark, sf_dir):
    chunks, cache = _cached(spark, sf_dir)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return chunks.join(cache, ["content_hash", "embedding_model"], "left").select("doc_id", F.round(total, 5).alias("total"))


@query('select sha256("text") as content_hash, min(doc_id) as doc_id from documents group by 1')
def dedupe_by_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(identity.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


_INDEXED = """(select source || '/' || (doc_id % 97) as path, arg_max(n_chars, row(lang, doc_id)) as file_size, arg_max(sha256("text"), row(lang, doc_id)) as file_hash from documents where doc_id % 5 <> 0 group by 1)"""
_CURRENT = """(select source || '/' || (doc_id % 97) as path, min(n_chars) as size, min(sha256("text")) as hash from documents where doc_id % 7 <> 0 group by 1)"""


def _both_sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id") % 97).alias("path"), "*")
    hashed = identity.content_hash(F.col("text"))
    stored = docs.where("doc_id % 5 <> 0").select("path", F.lit("t").alias("file_mtime"), F.col("n_chars").alias("file_size"), hashed.alias("file_hash"), F.col("lang").alias("indexed_at"), F.col("doc_id").alias("chunk_id"))
    current = docs.where("doc_id % 7 <> 0").groupBy("path").agg(F.lit("t").alias("mtime"), F.min("n_chars").alias("size"), F.min(hashed).alias("hash"))
    return current, refresh.file_metadata(stored)


@query(f"select * from {_INDEXED}")
def file_metadata_latest(spark, sf_dir):
    return _both_sides(spark, sf_dir)[1].select("path", "file_size", "file_hash")


_STATE = f"""(select coalesce(c.path, i.path) as path, case when i.path is null then 'added' when c.path is null then case when starts_with(i.path, 'src1') then 'deleted' else 'out_of_scope' end
    when c.size is distinct from i.file_size then 'updated' when c.hash <> i.file_hash then 'updated' else 'unchanged' end as state from {_CURRENT} c full outer join {_INDEXED} i on c.path = i.path)"""


@query(f"select path, state from {_STATE}")
def refresh_state(spark, sf_dir):
    return refresh.compare(*_both_sides(spark, sf_dir), include=["src1*"])


@query(f"select count(*) filter (state = 'added') as added, count(*) filter (state = 'updated') as updated, count(*) filter (state = 'deleted') as deleted, count(*) filter (state = 'unchanged') as unchanged from {_STATE}")
def refresh_counts(spark, sf_dir):
    return refresh.counts(refresh.compare(*_both_sides(spark, sf_dir), include=["src1*"]))


@query(f"select i.path from {_INDEXED} i anti join {_CURRENT} c on i.path = c.path where starts_with(i.path, 'src1')")
def deleted_in_scope(spark, sf_dir):
    current, indexed = _both_sides(spark, sf_dir)
    return refresh.deleted_files(indexed, current, include=["src1*"])


@query(f"select c.path from {_CURRENT} c anti join {_INDEXED} i on i.path = c.path")
def new_files(spark, sf_dir):
    return refresh.new_files(*_both_sides(spark, sf_dir))


@query("""select doc_id as chunk_id, source as path, n_chars, case when doc_id % 3 = 0 then 'new' else 'old' end as origin from documents where doc_id % 2 = 0 or doc_id % 3 = 0""")
def upsert_merge(spark, sf_dir):
    from quarry.operators.store import merge

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), "n_chars")
    return merge(rows.where("chunk_id % 2 = 0").withColumn("origin", F.lit("old")), rows.where("chunk_id % 3 = 0").withColumn("origin", F.lit("new")))


@query("select doc_id as chunk_id, source as path from documents where source not in ('src1', 'src2')")
def delete_by_path(spark, sf_dir):
    from quarry.operators.store import without_paths

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"))
    return without_paths(rows, rows.where("path in ('src1', 'src2')").select("path").distinct())


_EVENTS = ("view", "click", "purchase", "signup", "error")


@query("select user_id, " + ", ".join(f"count(*) filter (event_type = '{e}') as n_{e}" for e in _EVENTS) + " from events group by 1")
def job_counters(spark, sf_dir):
    counted = jobs.job_counters(table(spark, sf_dir, "events"), "user_id", "event_type", _EVENTS)
    return counted.select("user_id", *[F.col(e).alias(f"n_{e}") for e in _EVENTS])


@query("select user_id, array_to_string(list(cast(event_id as varchar) order by ts desc, event_id desc)[1:10], ',') as recent_errors from events where event_type = 'error' group by 1")
def job_recent_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = jobs.recent_errors(e, "user_id", F.col("event_type") == "error", F.col("event_id").cast("string"), [F.desc("ts"), F.desc("event_id")])
    return found.select("user_id", F.array_join("recent_errors", ",").alias("recent_errors"))


_JOBS = "(select user_id as job_id, max(ts) as started_at, arg_max(event_type, row(ts, event_id)) as last from events group by 1)"


def _jobs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("started_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select("job_id", "started_at", F.when(F.col("last") == "purchase", "completed").when(F.col("last") == "error", "failed").otherwise("parsing").alias("stage"))


@query(f"select job_id from {_JOBS} where last not in ('purchase', 'error') union all (select job_id from {_JOBS} where last in ('purchase', 'error') order by started_at desc, job_id desc limit 20)")
def job_retention(spark, sf_dir):
    return jobs.retained(_jobs(spark, sf_dir), 20).select("job_id")


@query(f"select count(*) as jobs, count(*) filter (last not in ('purchase', 'error')) as active, coalesce(bool_or(last not in ('purchase', 'error')), false) as any_active from {_JOBS}")
def active_jobs(spark, sf_dir):
    active = jobs.is_active(F.col("stage"))
    return _jobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(active).alias("active"), F.coalesce(F.bool_or(active), F.lit(False)).alias("any_active"))


@query("select user_id, 'job' || user_id || ' [Parsing] - D:' || count(*) || ' P:' || count(*) filter (event_type = 'view') || ' E:' || count(*) filter (event_type = 'click') || ' I:' || count(*) filter (event_type = 'purchase') as line from events group by 1")
def job_status_line(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("d"), *[F.count_if(F.col("event_type") == k).alias(k) for k in _EVENTS])
    return e.select("user_id", text.job_line(F.concat(F.lit("job"), F.col("user_id").cast("string")), F.lit("parsing"), F.col("d"), F.col("view"), F.col("click"), F.col("purchase")).alias("line"))


#: By language of a file: its suffix, and for a function and a type what comes before the text, before each of its lines and after it.
_FILES = (
    ("py", ("def f_{}(a):", "    # ", "\n    return a\n"), ("class C_{}:", "    # ", "\n    def m(self):\n        return 1\n")),
    ("rs", ("fn f_{}() {{", "    // ", "\n}}\n"), ("impl C_{} {{", "    // ", "\n    fn m(&self) {{}}\n}}\n")),
    ("ts", ("function f_{}() {{", "    // ", "\n}}\n"), ("class C_{} {{", "    // ", "\n    m() {{ return 1; }}\n}}\n")),
    ("tsx", ("function f_{}() {{", "    // ", "\n}}\n"), ("class C_{} {{", "    // ", "\n    m() {{ return 1; }}\n}}\n")),
    ("go", ("func f_{}() {{", "    // ", "\n}}\n"), ("func g_{}() {{", "    // ", "\n}}\n")),
)


def _source_files(docs: DataFrame) -> DataFrame:
    """A file per document that holds its whole text: as the comments in a function or a type, a sentence or line each, or as it is, in every language."""
    id_, form = F.col("doc_id"), F.floor(F.col("doc_id") / len(_FILES)) % 3

    def around(before: str, each: str, after: str):
        lines = F.regexp_replace("text", r"\r?\n|(?<=[.!?,;]) ", "\n" + each)
        return F.concat(F.format_string(before.replace("{}", "%s").replace("{{", "{"), id_.cast("string")), F.lit("\n" + each), lines, F.lit(after.format()))

    cases = [F.when(F.pmod(id_, F.lit(len(_FILES))) == i, F.when(form == 0, around(*function)).when(form == 1, around(*kind)).otherwise(F.col("text"))) for i, (_, function, kind) in enumerate(_FILES)]
    suffix = F.element_at(F.array(*[F.lit(f[0]) for f in _FILES]), (F.pmod(id_, F.lit(len(_FILES))) + 1).cast("int"))
    body = F.coalesce(*cases)
    return docs.select(F.concat("source", F.lit("/"), id_.cast("string"), F.lit("."), suffix).alias("path"), F.lit("").alias("mtime"), F.octet_length(body).cast("long").alias("size"), body.alias("content"))


@query()
def source_chunks(spark, sf_dir):
    """Definitions in a tree of sources that hold the documents' whole texts."""
    from quarry.operators.chunking import chunk_files

    files = _source_files(table(spark, sf_dir, "documents"))
    return chunk_files(files, "repo").select("path", "symbol_name", "symbol_kind", "symbol_path", "line_start", "line_end", "byte_start", "byte_end", "signature", "doc_comment", "content_hash")
