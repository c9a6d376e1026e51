"""Secret scans over an incremental blob ledger: content-address every version of a text, scan only unseen pairs of blob and rule version, join findings to all paths.

A blob is the SHA-256 of a whole text. The ledger, two Parquet tables in a folder, has a row for each blob and rule version scanned, and a row for each
finding. A scan hashes the rows, takes one row for each blob whose rules the ledger lacks, scans those texts and appends to both tables. Findings are
then joined to every row with the blob. DataFrame functions only.

Positions: a pattern's matches and the gaps between them partition a text, so a match starts after the lengths of what comes before; lengths and
positions are in code points. Matches are leftmost and do not overlap, within each rule; those that fail the rule's least length are then dropped.

Defined cases: null text is empty and has no finding; null doc_id is kept as null; repeated rows each yield a row, and their blob is scanned once;
an empty table yields no row; other columns are ignored.
Recovery: findings are written before the scanned pairs. A run that dies between leaves pairs that are scanned again; readers drop doubled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import shared_dir


#: Copies of a blob's findings that its rows are dealt to.
PARTS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least so many code points. A changed rule takes a new version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values, in the order in which spans that start together are listed; the first three are the base.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
RULES = (*BASE, Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24), Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20))


def blob(text: Column) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings in the texts of blobs (blob, text, todo: keys of rules to apply): blob, rule, start, end, ordinal."""
    parts = []
    for n, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        pieces = F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda x: F.length(x).cast("long")).alias("size"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least).alias("kept"),
        )
        parts.append(F.when(F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern), F.struct(F.lit(n).alias("ordinal"), pieces.alias("pieces"))))
    per_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("r"))
    rows = per_rule.select("blob", "r.ordinal", F.posexplode("r.pieces").alias("i", "m")).where("m.size is not null").select("blob", "ordinal", "i", "m.gap", "m.size", "m.kept")
    before = Window.partitionBy("blob", "ordinal").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.dropDuplicates(["blob", "ordinal", "i"]).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    keys = F.array(*[F.lit(r.key) for r in rules])
    return placed.where("kept").select("blob", F.element_at(keys, F.col("ordinal") + 1).alias("rule"), (F.col("end") - F.col("size")).alias("start"), "end", "ordinal")


class BlobLedger:
    """The two tables of a ledger in a folder that all executors share."""

    FINDINGS = "blob binary, rule string, start long, end long, ordinal int"
    SCANNED = "blob binary, rule string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "secret-ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        """A table of the ledger; None if it was never written."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def findings(self) -> DataFrame:
        found = self._read("findings", self.FINDINGS)
        return self.spark.createDataFrame([], self.FINDINGS) if found is None else found.distinct()

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen of docs (doc_id, text); return the paths: doc_id and blob of every row."""
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
        paths = texts.select("doc_id", "blob")
        todo = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).withColumn("todo", F.array(*[F.lit(r.key) for r in rules]))
        scanned = self._read("scanned", self.SCANNED)
        if scanned is not None:
            done = scanned.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # at most as many as there are rule versions
            todo = todo.join(done, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("done", F.array().cast("array<string>")))).drop("done")
        todo = todo.where(F.size("todo") > 0)
        marked = todo.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "todo")
        unseen = texts.join(marked.hint("shuffle_hash"), texts.doc_id.eqNullSafe(F.col("_id")) & (texts.blob == F.col("_blob"))).select("blob", "text", "todo")
        todo_pairs = todo.select("blob", F.explode("todo").alias("rule"))
        if scanned is not None:  # fixed before this run's own findings and pairs are written
            pairs_path = shared_dir(self.spark, "secret-todo")
            todo_pairs.write.parquet(pairs_path)
            todo_pairs = self.spark.read.schema(self.SCANNED).parquet(pairs_path)
        find(unseen, rules).write.mode("append").parquet(f"{self.path}/findings")
        todo_pairs.write.mode("append").parquet(f"{self.path}/scanned")
        return paths


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: doc_id, a count per rule of BASE, and spans, an array of (start, ordinal, kind, end, base) in order; null where nothing was found."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = ledger.update(docs, rules)
    dealt = paths.withColumn("part", _part(F.col("doc_id")))
    return dealt.join(_per_blob(ledger, rules), ["blob", "part"], "left").select("doc_id", "spans")


def _part(doc_id: Column) -> Column:
    """Which copy of a blob's findings a row is joined to: a blob that many rows share is then many tasks' work."""
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS)).cast("int")


def _per_blob(ledger: BlobLedger, rules: tuple[Rule, ...]) -> DataFrame:
    """Of every blob with findings PARTS copies: blob, part and spans."""
    current = [r.key for r in rules]
    kind = F.split("rule", "@")[0].alias("kind")
    found = ledger.findings().where(F.col("rule").isin(current)).select("blob", F.struct("start", "ordinal", kind, "end", (F.col("ordinal") < len(BASE)).alias("base")).alias("span"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("spans")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # an array is bounded by one text


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(spans, F.array().cast("array<struct<start:bigint,ordinal:int,kind:string,end:bigint,base:boolean>>")), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """scan's rows as doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = F.col("spans")
    def count(kind: str) -> Column:
        return F.when(spans.isNull(), 0).otherwise(F.size(F.filter(spans, lambda s: s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.filter(spans, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its columns and order of columns; in text, every span found is replaced by [KIND]; matches that are too short stay."""
    secret = docs["text"]
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(docs, rules)
    flagged = _per_blob(ledger, rules).select(F.col("blob").alias("_blob"), F.col("part").alias("_part"), F.col("spans").alias("_spans"))
    joined = docs.join(flagged, (blob(F.coalesce(secret, F.lit(""))) == flagged["_blob"]) & (_part(docs["doc_id"]) == flagged["_part"]), "left")
    # spans that overlap count as one, named after the first; the text is put together from the ends of one to the starts of the next
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        flagged["_spans"],
        start,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr(secret, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substr(secret, (acc["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return joined.select(*[F.when(flagged["_spans"].isNull(), secret).otherwise(folded).alias("text") if c == "text" else docs[c] for c in docs.columns])


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for n, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, {n} as ordinal, '{r.kind}' as kind, {str(n < len(BASE)).lower()} as base, unnest(range(1, len(m) + 1)) as i, g, m, v from (
            select doc_id, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) as g, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) as m,
                list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x) >= {r.least}) as v from d)""")
    return f"""with d as (select doc_id, coalesce("text", '') as t from documents), f as ({" union all ".join(parts)}),
    s as (select doc_id, ordinal, kind, base, list_sum(g[1:i]) + coalesce(list_sum(m[1:i-1]), 0) as a, m[i] as n from f where v[i]),
    x as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, ordinal) filter (base) as b, string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, ordinal) as spans from s group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join x using (doc_id)"""


ORACLE = _oracle()
