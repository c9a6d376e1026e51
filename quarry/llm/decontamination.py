"""Benchmark decontamination by template canonicalisation: typed placeholders, a hash join of template windows, and a check that slots are filled consistently.

A text becomes tokens: words and numbers. Numbers (digits or number words), names (capitalised words inside a sentence) and units (after a number)
become placeholders, other words are lower-cased. WINDOW typed tokens in a row, of which LITERALS or more are no placeholders, are a template window;
an item shorter than WINDOW is one window of its own length. Windows of documents meet equal ones of items by hash. The windows of a document and an
item with the same distance between their places are one alignment. It counts if its windows make up SHARE of the item's, or RUN windows, and if its
slots are consistent: equal values in the item stand for equal values in the document. So a question that only changes its numbers, names or units is
caught, and one that fills the same frame at random is not. Windows whose slots are all unchanged are verbatim; they count whether or not the other
slots are consistent, from VERBATIM of the item's windows, or RUN windows.
Items without any template window (short ones, or with few literals) are matched word for word as a whole; with fewer than WHOLE tokens they match
only a document that is nothing else.
DataFrame functions only.

Plan: documents are read once to explode (document, place, hash) of every window, and semi-joined with the items' hashes; only documents that meet
one are read again, and of them only the windows that met are cut out. The work is linear in a text's length.

Defined cases: null texts have no token, and items without a token match nothing; null doc_id or item_id is kept; a document is a doc_id with its
text, so that different texts under one doc_id, or under none, are apart and yield a result each; repeated rows of documents yield one result, equal
items each; an empty table on either side yields no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, fits

WINDOW, LITERALS, RUN, SHARE, VERBATIM, WHOLE = 8, 4, 6, 0.5, 0.4, 3
#: Hashes of items' windows (8 bytes each) are broadcast up to so many rows, and documents that met one (16 bytes each, with their places); beyond, both sides are shuffled.
BROADCAST_WINDOWS, BROADCAST_DOCUMENTS = 1_000_000, 100_000
#: Units that a number may have, and number words; English, French, German, Spanish. Words that are articles too are no numbers.
UNITS = (
    "km m cm mm kg g mg lb oz l ml s ms min h hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent mile miles meter meters metre metres "
    "foot feet inch inches gram grams kilogram kilograms liter liters litre litres degree degrees watt watts volt volts heure heures jour jours semaine semaines mois ans année années mètre mètres kilomètre kilomètres "
    "stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren kilometer kilometers kilometre kilometres hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
TYPED, PLAIN = "typed", "plain"
_SENTENCE = r"""(^|[.!?:;\n"(«»“]\s*)(\p{Lu})"""
_TOKEN = r"""\x01?\p{L}[\p{L}\p{M}']*|\p{N}+(?:[.,]\p{N}+)*"""
_SLOT = "('<number>', '<name>', '<unit>')"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def tokens(text: str) -> str:
    """SQL: the tokens of a text; a word that begins a sentence with a capital has \\x01 before it."""
    return f"regexp_extract_all(regexp_replace(coalesce({text}, ''), {_quoted(_SENTENCE)}, '$1\x01$2'), {_quoted(_TOKEN)}, 0)"


def typed(words: str) -> str:
    """SQL: the tokens with placeholders in place of numbers, names and units."""
    before = f"{words}[i - 1]"
    is_unit = f"i > 0 and lower(x) in ({_listed(UNITS)}) and ({before} rlike '^\\\\p{{N}}' or ltrim('\x01', lower({before})) in ({_listed(NUMBERS)}))"
    # words that begin with a small ASCII letter, most of all, need no pattern
    return f"""transform({words}, (x, i) -> case when ltrim('\x01', lower(x)) in ({_listed(NUMBERS)}) then '<number>'
        when ascii(x) between 97 and 122 then case when {is_unit} then '<unit>' else lower(x) end
        when ascii(x) = 1 then lower(substr(x, 2)) when x rlike '^\\\\p{{N}}' then '<number>' when {is_unit} then '<unit>'
        when x rlike '^\\\\p{{Lu}}\\\\p{{Ll}}' then '<name>' else lower(x) end)"""


def plain(words: str) -> str:
    """SQL: the tokens in lower case."""
    return f"transform({words}, x -> ltrim('\x01', lower(x)))"


def _tokenised(rows: DataFrame, *keys: str) -> DataFrame:
    """keys with kinds and plain of the rows' texts."""
    return rows.select(*keys, F.expr(tokens("text")).alias("words")).select(*keys, F.expr(typed("words")).alias("kinds"), F.expr(plain("words")).alias("plain"))


def _column(form: str) -> str:
    return "kinds" if form == TYPED else "plain"


def _hashes(form: str, n: int) -> str:
    """SQL: the hash of each run of n tokens, which tells forms and lengths apart."""
    of = _column(form)
    return f"case when size({of}) >= {n} then transform(sequence(0, size({of}) - {n}), i -> xxhash64('{form}', {n}, slice({of}, i + 1, {n}))) else array() end"


def _frames(once: DataFrame) -> DataFrame:
    """Of items (text_key, kinds, plain) the windows: text_key, form, n, item_place, hash, part, old, n_tokens."""
    def cut_out(rows: DataFrame, form: str) -> DataFrame:
        sized = rows.withColumn("n", F.least(F.size("kinds"), F.lit(WINDOW))).withColumn("form", F.lit(form))
        placed = sized.select("*", F.explode(F.expr("sequence(0, size(kinds) - n)")).alias("item_place"))
        part = F.expr(f"slice({_column(form)}, item_place + 1, n)")
        return placed.select("text_key", "form", "n", "item_place", part.alias("part"), F.expr("slice(plain, item_place + 1, n)").alias("old"), F.size("kinds").alias("n_tokens")).withColumn("hash", F.xxhash64("form", "n", "part"))

    literal = f"size(filter(part, k -> k not in {_SLOT})) >= {LITERALS}"
    by_type = cut_out(once, TYPED).where(literal)
    rest = once.join(by_type.select("text_key").distinct(), "text_key", "left_anti")
    return by_type.unionByName(cut_out(rest, PLAIN))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document and item: doc_id, item_id, n_windows, n_slots and changed (whether a slot's value differs)."""
    return _matches(docs, benchmark).drop("doc_key")


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """matches with doc_key, the hash of the document's text."""
    items = _tokenised(benchmark.select("item_id", "text"), "item_id").where("size(kinds) > 0").withColumn("text_key", F.xxhash64("plain", "kinds"))
    once = items.groupBy("text_key").agg(F.min_by(F.struct("kinds", "plain"), F.coalesce("item_id", F.lit(0))).alias("t")).select("text_key", "t.kinds", "t.plain")
    frames = cut(_frames(once), "frames")
    forms = sorted((r.form, r.n) for r in frames.select("form", "n").distinct().collect()) or [(TYPED, WINDOW)]  # at most 2 * WINDOW
    wanted = frames.select("hash").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")

    # a place among all forms' windows of a document, one after the other
    every = _tokenised(texts, "doc_id", "doc_key").select("doc_id", "doc_key", F.posexplode(F.expr(f"concat({', '.join(_hashes(*f) for f in forms)})")).alias("at", "hash"))
    met = every.join(F.broadcast(wanted) if fits(wanted, BROADCAST_WINDOWS) else wanted, "hash", "left_semi")
    places = cut(met.groupBy("doc_id", "doc_key").agg(F.collect_set("at").alias("ats")), "places")  # bounded by one text
    few = F.broadcast(places) if fits(places, BROADCAST_DOCUMENTS) else places
    p = few.toDF("_id", "_key", "ats")
    hit = texts.join(p, texts["doc_id"].eqNullSafe(p["_id"]) & (texts["doc_key"] == p["_key"])).select("doc_id", "doc_key", "text", "ats")
    cut_out, before = [], "0"
    for form, n in forms:
        size = f"greatest(size(kinds) - {n - 1}, 0)"
        mine = f"filter(ats, a -> a >= {before} and a < {before} + {size})"
        cut_out.append(f"transform({mine}, a -> named_struct('form', '{form}', 'n', {n}, 'place', a - ({before}), 'part', slice({_column(form)}, a - ({before}) + 1, {n}), 'new', slice(plain, a - ({before}) + 1, {n}), 'doc_tokens', size(kinds)))")
        before = f"{before} + {size}"
    windows = _tokenised(hit, "doc_id", "doc_key", "ats").select("doc_id", "doc_key", F.explode(F.expr(f"concat({', '.join(cut_out)})")).alias("w")).select("doc_id", "doc_key", "w.*")
    windows = windows.withColumn("hash", F.xxhash64("form", "n", "part"))
    f = frames.select(F.col("hash").alias("_hash"), F.col("form").alias("_form"), F.col("part").alias("_part"), "text_key", "item_place", "old", "n_tokens")
    pairs = windows.join(F.broadcast(f) if fits(f, BROADCAST_WINDOWS // 16) else f, (windows["hash"] == f["_hash"]) & (windows["form"] == f["_form"]) & (windows["part"] == f["_part"]))
    pairs = pairs.where((F.col("n_tokens") >= WHOLE) | (F.col("doc_tokens") == F.col("n_tokens")))
    slots = F.expr(f"filter(transform(part, (k, i) -> named_struct('kind', k, 'old', old[i], 'new', new[i])), x -> x.kind in {_SLOT})")
    found = pairs.select("doc_id", "doc_key", "text_key", "form", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", F.when(F.col("form") == TYPED, slots).otherwise(F.expr("filter(array(named_struct('kind', '', 'old', '', 'new', '')), x -> false)")).alias("slots"))
    found = found.dropDuplicates(["doc_id", "doc_key", "text_key", "shift", "item_place"]).withColumn("same", F.expr("not exists(slots, s -> s.old <> s.new)"))
    runs = found.groupBy("doc_id", "doc_key", "text_key", "form", "shift").agg(  # bounded by the item's length
        F.count(F.lit(1)).alias("n_all"), F.count_if("same").alias("n_same"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("same"), F.col("slots"))))).alias("kept"),
    )
    per_item = frames.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_item"))
    runs = runs.join(per_item, "text_key")
    consistent = F.expr("size(slots) = size(array_distinct(transform(slots, s -> struct(s.kind, s.old))))")

    def enough(n: str, share: float) -> Column:
        return F.when(F.col("form") == PLAIN, F.col(n) >= F.col("n_item")).otherwise((F.col(n) >= F.ceil(F.col("n_item") * share)) | (F.col(n) >= RUN))

    def result(n: str, slots: str) -> Column:
        return F.struct(F.col(n).alias("n_windows"), F.size(slots).cast("long").alias("n_slots"), F.expr(f"exists({slots}, s -> s.old <> s.new)").alias("changed"))

    judged = runs.select("doc_id", "doc_key", "text_key", F.when(consistent & enough("n_all", SHARE), result("n_all", "slots")).when(enough("n_same", VERBATIM), result("n_same", "kept")).alias("b")).where("b is not null")
    best = judged.groupBy("doc_id", "doc_key", "text_key").agg(F.max("b").alias("b"))
    return best.join(items.select("item_id", "text_key"), "text_key").select("doc_id", "doc_key", "item_id", "b.n_windows", "b.n_slots", "b.changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark."""
    hit = _matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_key"]), "left_anti")


def _oracle() -> str:
    def words(table: str, key: str) -> str:
        sentence, token = (p.replace("'", "''") for p in (_SENTENCE, _TOKEN))
        low = "list_transform(words, lambda x: lower(replace(x, chr(1), '')))"
        return f"""(select {key}, low, list_transform(words, lambda x, i: case when regexp_matches(x, '^\\p{{N}}') or low[i] in ({_listed(NUMBERS)}) then '<number>'
            when i > 1 and lower(x) in ({_listed(UNITS)}) and (regexp_matches(words[i - 1], '^\\p{{N}}') or low[i - 1] in ({_listed(NUMBERS)})) then '<unit>'
            when regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}') then '<name>' else low[i] end) as kinds
            from (select *, {low} as low from (select {key}, regexp_extract_all(regexp_replace(coalesce("text", ''), '{sentence}', '\\1' || chr(1) || '\\2', 'g'), '{token}') as words from {table})))"""

    return f"""with i as (select * from {words("benchmark", "item_id")} where len(kinds) > 0),
    iw as (select item_id, least(len(kinds), {WINDOW}) as size, unnest(range(0, len(kinds) - least(len(kinds), {WINDOW}) + 1)) as p, low, kinds from i),
    tf as (select item_id, '{TYPED}' as form, size, p as ip, kinds[p+1:p+size] as part, low[p+1:p+size] as old, len(kinds) as n_tokens from iw where len(list_filter(kinds[p+1:p+size], lambda k: k not in {_SLOT})) >= {LITERALS}),
    f as (select * from tf union all select item_id, '{PLAIN}', size, p, low[p+1:p+size], low[p+1:p+size], len(kinds) from iw where item_id not in (select item_id from tf)),
    c as (select item_id, count(*) as n_item from f group by item_id),
    n as (select distinct form, size from f),
    d as (select doc_id, low, kinds from {words("documents", "doc_id")}),
    dw as (select doc_id, form, size, unnest(range(0, len(kinds) - size + 1)) as p, low, kinds from d, n where len(kinds) >= size),
    dp as (select doc_id, form, size, p, case when form = '{TYPED}' then kinds[p+1:p+size] else low[p+1:p+size] end as part, low[p+1:p+size] as new, len(kinds) as doc_tokens from dw),
    w as (select doc_id, item_id, f.form, p - ip as shift, case when f.form = '{TYPED}' then list_filter(list_transform(f.part, lambda k, j: struct_pack(k := k, o := old[j], w := new[j])), lambda s: s.k in {_SLOT}) else [] end as slots
        from dp join f on dp.form = f.form and dp.size = f.size and dp.part = f.part where n_tokens >= {WHOLE} or n_tokens = doc_tokens),
    m as (select doc_id, item_id, form, shift, count(*) as na, count(*) filter (len(list_filter(slots, lambda s: s.o <> s.w)) = 0) as ns, list_distinct(flatten(list(slots))) as sa,
        list_distinct(flatten(coalesce(list(slots) filter (len(list_filter(slots, lambda s: s.o <> s.w)) = 0), []))) as ss from w group by all),
    j as (select m.*, len(sa) = len(list_distinct(list_transform(sa, lambda s: struct_pack(k := s.k, o := s.o)))) and case when form = '{PLAIN}' then na >= n_item else na >= ceil(n_item * {SHARE}) or na >= {RUN} end as whole,
        case when form = '{PLAIN}' then ns >= n_item else ns >= ceil(n_item * {VERBATIM}) or ns >= {RUN} end as verbatim from m join c using (item_id)),
    g as (select doc_id, item_id, case when whole then na else ns end as n_windows, cast(len(case when whole then sa else ss end) as bigint) as n_slots, whole and len(list_filter(sa, lambda s: s.o <> s.w)) > 0 as changed from j where whole or verbatim)
    select doc_id, item_id, n_windows, n_slots, changed from g qualify row_number() over (partition by doc_id, item_id order by n_windows desc, n_slots desc, changed desc) = 1"""


ORACLE = _oracle()
