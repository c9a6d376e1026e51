"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every document's set of distinct five-word shingles becomes a signature of COORDINATES minima. Documents with equal sets (count and 128-bit sum)
   form a class, which its smallest doc_id represents from then on: copies never meet each other again.
2. Each representative is posted under its coordinate-value pairs; pairs that one representative alone has are dropped. Two sets that should link
   agree in matches coordinates or more (MATCHES by default: at a similarity of exactly 0.75 one pair in three million has fewer, at 0.8 one in 10^11),
   so a representative with fewer postings left has no partner. matches=1 leaves out only what agrees in no coordinate.
3. Large lists are contracted: in ROUNDS rounds, each representative meets one member of another component from each of its lists, the one with most
   collisions is tried on full sets, and links join components. Lists of near copies end as one component, whatever their length, by pairs in
   proportion to it.
4. What is left is enumerated: with postings ordered by rarity, two representatives with MATCHES collisions share one in their prefixes, all but the
   last matches - 1. Prefix lists that lie in one component are done; those that others connect are a family, dealt by size (within a factor
   of 4/3) to blocks of BLOCK. Block against block, collisions are counted across components, and pairs with matches or more are confirmed on full sets;
   only links leave a block. This work grows with the square of a family of documents that are nearly, but not quite, near copies of each other.

Links that both their ends' component already implies are not sought: the components are what all links give.

Defined cases: null or blank text has an empty set and links with nothing; fewer than five words are one shingle; null doc_id: component null, kept;
repeated rows each yield a row; rows of one doc_id with different texts count as one document with links of either; other columns are ignored; an
empty table yields no row. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import byte_slices, cut, fits, folded_words, mix, text_bytes, word_hashes
from quarry.llm.components import components

WORDS, COORDINATES, MATCHES = 5, 96, 50
#: Contractions before what is left is enumerated.
ROUNDS = 3
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Ids of documents whose sets are needed are broadcast up to so many (8 bytes each); beyond, they are joined by shuffling.
BROADCAST_IDS = 400_000
#: Representatives of a block.
BLOCK = 256
_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and the n + 1 offsets of the rows."""
    raw, offsets = text_bytes(column)
    low, starts, ends, rows = folded_words(raw, offsets)
    h = word_hashes(low, starts, ends)
    n = len(rows) - 1
    sizes = np.diff(rows)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    of_row = np.repeat(np.arange(n), counts)
    first = np.repeat(rows[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    made = np.zeros(len(first), np.uint64)
    length = np.minimum(sizes, WORDS)[of_row]
    for k in range(WORDS):
        made += np.where(k < length, padded[first + k], np.uint64(0)) * _PLACE[k]
    made = mix(made + length.astype(np.uint64))
    order = np.lexsort((made, of_row))
    made, of_row = made[order], of_row[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (of_row[1:] != of_row[:-1])
    made, of_row = made[new], of_row[new]
    return made, np.searchsorted(of_row, np.arange(n + 1))


def signatures(made: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't empty and their signatures, int32 of COORDINATES columns."""
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[full]
    out = np.empty((len(full), COORDINATES), np.int32)
    for k in range(COORDINATES):
        out[:, k] = (np.minimum.reduceat(made * _ODD[k], at) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(at) else 0
    return full, out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (sums that stand for the set) and signature (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, 1):
                made, offsets = shingles(b.column(1))
                full, sig = signatures(made, offsets)
                sums = np.zeros((2, b.num_rows), np.uint64)
                if len(full):
                    for k in (0, 1):
                        sums[k, full] = np.add.reduceat(mix(made ^ _PLACE[k]), offsets[full])
                sizes = np.zeros(b.num_rows, np.int64)
                sizes[full] = COORDINATES
                mask = np.ones(b.num_rows, bool)
                mask[full] = False
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(sig.reshape(-1)), mask=pa.array(mask))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), *(pa.array(s.view(np.int64)) for s in sums), lists], names=["doc_id", "n_shingles", "f1", "f2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, signature array<int>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets (id, set: ascending 64-bit hashes) of the documents in ids (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, 1):
                made, offsets = shingles(b.column(1))
                yield pa.record_batch([b.column(0), pa.array([made[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["id", "set"])

    wanted = F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.select(F.col("rep").alias("id")), "id", "left_semi")
    return cut(texts.mapInArrow(run, "id long, set binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (u, v) that link on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                keep.append(shared > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.record_batch([pa.array([p for p, k in zip(q, keep, strict=True) if k], pa.int64()) for q in (u, v)], names=["u", "v"])

    a, c = sets.toDF("u", "set_u"), sets.toDF("v", "set_v")
    return pairs.join(a, "u").join(c, "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long").distinct()


def _agreeing(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Those of pairs (u, v) whose signatures collide matches times or more, with the number n."""
    both = pairs.join(sigs.toDF("u", "su"), "u").join(sigs.toDF("v", "sv"), "v")
    n = F.size(F.filter(F.zip_with("su", "sv", lambda x, y: x == y), lambda t: t))
    return both.select("u", "v", n.alias("n")).where(F.col("n") >= matches)


def _labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows (rep, ...) with comp: the component of rep."""
    return rows.join(joined.select(F.col("u").alias("rep"), F.col("v").alias("_c")), "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: its key, its least and largest component, and its members' ids, components, sizes, signatures and sets."""
    family, band, block = (table.column(c)[0].as_py() for c in ("family", "band", "block"))
    comp = table.column("comp").to_numpy()
    sigs = table.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    sets = [x.as_py() for x in table.column("set")]
    blobs = [table.column("rep").to_numpy().tobytes(), comp.tobytes(), np.array([len(x) // 8 for x in sets], np.int64).tobytes(), sigs.tobytes(), b"".join(sets)]
    head = [pa.array([x], pa.int64()) for x in (family, band, block, comp.min(), comp.max())]
    return pa.table([*head, *(pa.array([x], pa.binary()) for x in blobs)], names=[c.split()[0] for c in _PACKED.split(", ")])


_PACKED = "family long, band long, block long, lo long, hi long, reps binary, comps binary, sizes binary, sigs binary, sets binary"


def _block_links(x: list[bytes], y: list[bytes], same: bool, matches: int) -> list[tuple[int, int]]:
    """The links between members of two packed blocks that lie in different components."""
    (rx, cx, nx, sx, tx), (ry, cy, ny, sy, ty) = ([*(np.frombuffer(v, np.int64) for v in z[:3]), np.frombuffer(z[3], np.int32).reshape(-1, COORDINATES), np.frombuffer(z[4], np.uint64)] for z in (x, y))
    open_ = (cx[:, None] != cy[None, :]) & (100 * np.minimum(nx[:, None], ny[None, :]) >= PERCENT * np.maximum(nx[:, None], ny[None, :]))
    if same:
        open_ &= rx[:, None] < ry[None, :]
    if not open_.any():
        return []
    n = np.zeros(open_.shape, np.uint16)
    for k in range(COORDINATES):
        n += sx[:, k][:, None] == sy[:, k][None, :]
    pairs = np.argwhere(open_ & (n >= matches))
    ox, oy = np.concatenate([[0], np.cumsum(nx)]), np.concatenate([[0], np.cumsum(ny)])
    out = []
    for i in np.unique(pairs[:, 0]):
        mine = tx[ox[i] : ox[i + 1]]
        at = np.minimum(np.searchsorted(mine, ty), len(mine) - 1)
        shared = np.add.reduceat(mine[at] == ty, oy[:-1], dtype=np.int64)
        for j in pairs[pairs[:, 0] == i, 1]:
            if 100 * shared[j] >= PERCENT * (nx[i] + ny[j] - shared[j]):
                out.append((int(rx[i]), int(ry[j])))
    return out


def _blocked_links(open_lists: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """Links across components among representatives that open lists (key, rep, comp, n_shingles, band) connect, block against block; pairs never become rows."""
    members = open_lists.select("rep", "comp", "n_shingles", "band").distinct()
    least = open_lists.groupBy("key").agg(F.min("rep").alias("v"))
    families = components(open_lists.join(least, "key").select(F.col("rep").alias("u"), "v"))
    placed = members.join(families.select(F.col("u").alias("rep"), F.col("v").alias("_f")), "rep", "left").withColumn("family", F.coalesce("_f", "rep")).drop("_f")
    sizes = placed.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(sizes, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    packed = cut(dealt.join(sigs, "rep").join(sets.withColumnRenamed("id", "rep"), "rep").select("family", "band", "block", "rep", "comp", "signature", "set").groupBy("family", "band", "block").applyInArrow(_pack, _PACKED), "blocks")
    keys = packed.select("family", "band", "block", "lo", "hi")
    there = keys.toDF("family", "band_", "block_", "lo_", "hi_")
    near = keys.join(there, "family").where("(band = band_ and block <= block_) or band_ = band + 1").where("not (lo = hi and lo_ = hi_ and lo = lo_)").select("family", "band", "block", "band_", "block_")
    data = ["reps", "comps", "sizes", "sigs", "sets"]
    left = packed.select("family", "band", "block", *data)
    right = packed.select(F.col("family"), F.col("band").alias("band_"), F.col("block").alias("block_"), *[F.col(c).alias(f"{c}_") for c in data])
    met = near.join(left, ["family", "band", "block"]).join(right, ["family", "band_", "block_"])
    met = met.select(((F.col("band") == F.col("band_")) & (F.col("block") == F.col("block_"))).alias("same"), *data, *[f"{c}_" for c in data])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(b.num_columns)]
                found = _block_links(row[1:6], row[6:], row[0], matches)
                yield pa.record_batch([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def link(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept. matches: the coordinates in which two documents have to agree to be compared."""
    spark = docs.sparkSession
    sketched = cut(sketch(docs), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = cut(full.join(same, ["n_shingles", "f1", "f2"]).select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("signature")).alias("signature")), "classes")
    reps = classes.where("signature is not null").select("rep", "n_shingles", "signature").distinct()

    key = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = reps.select("rep", "n_shingles", F.posexplode("signature").alias("k", "value")).select("rep", "n_shingles", key.alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    postings = cut(posted.join(shared, "key").select("key", "rep", "n_shingles", "c"), "postings")
    active = cut(postings.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= matches), "active")
    postings = cut(postings.join(active, "rep").select("key", "rep", "n_shingles", "c", "m"), "active-postings")
    sets = _sets(docs, active.select("rep"))

    edges = spark.createDataFrame([], "u long, v long")
    joined = edges
    sigs = cut(reps.join(active.select("rep"), "rep", "left_semi").select("rep", "signature"), "signatures")
    for turn in range(ROUNDS):
        # another order of components and members each time, so that who meets is new
        labelled = _labelled(postings, joined).withColumn("by", F.struct(F.xxhash64("comp", F.lit(turn)), F.xxhash64("rep", F.lit(turn)), "rep"))
        ends = labelled.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min_by("comp", "by").alias("lo"), F.min_by("rep", "by").alias("a"), F.max_by("rep", "by").alias("z")).where("least < most")
        met = labelled.join(ends.select("key", "lo", "a", "z"), "key").select(F.col("rep").alias("u"), F.when(F.col("comp") == F.col("lo"), F.col("z")).otherwise(F.col("a")).alias("v")).where("u <> v").distinct()
        closest = Window.partitionBy("u").orderBy(F.desc("n"), "v")
        tried = _agreeing(met, sigs, matches).withColumn("place", F.row_number().over(closest)).where("place = 1").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        found = cut(_confirmed(tried, sets), "links")
        if not found.limit(1).count():
            break
        edges = edges.union(found)
        joined = components(edges)

    prefixes = postings.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("c", "key"))).where(F.col("place") <= F.col("m") - matches + 1)
    labelled = cut(_labelled(prefixes, joined).select("key", "rep", "comp", "n_shingles", F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))).alias("band")), "prefixes")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_lists = cut(labelled.join(mixed, "key"), "open-lists")
    edges = cut(edges.union(_blocked_links(open_lists, sigs, sets, matches)), "links")
    # rows of one doc_id with different texts are one document
    own = classes.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    doubled = classes.join(own.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined = components(edges.union(doubled))
    least = _labelled(classes.select("doc_id", "rep").distinct(), joined).groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(least, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the one kept of its component; rows without a doc_id stay."""
    gone = link(docs).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")
