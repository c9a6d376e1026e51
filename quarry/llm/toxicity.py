"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, and how much better the one compresses a window than the other.

Fit, over a bounded sample of labelled rows with whole texts, by MEMBERS that differ in their splits. Each member trains a dictionary on windows of
ordinary rows; its toxic dictionary has the same content and beside it what zstandard's trainer makes of windows of toxic rows. Most windows of a
toxic row are ordinary, so training goes in rounds: the toxic rows are in FOLDS, the windows of each are compared by the dictionary of the others,
and those that gain more than all but a share of an ordinary control's windows are what the next round trains on. A window that gains only because
its own text was learnt never counts. A logistic curve over the cross-fitted gains of whole rows calibrates, and 0.5 is its threshold.

Score: every window of every whole text. Windows are the words, between two fixed carriers that both dictionaries hold, and, about each word that
gains anything, the three words around it. A word's gain depends on the word alone, so each distinct word is compressed once, and only if it holds a
run of bytes that the toxic content has and the ordinary one lacks: without one the best parse by either dictionary is the same. A process remembers
the gains of the words it has met, by their hashes, from slice to slice and from task to task.

Defined cases: null or empty texts have no window and take the curve's value at no gain; a null doc_id is held out of nothing and scored; rows
without a label, with a null label or a null text teach nothing; repeated rows count once in the fit and each yields a row; an empty or one-class
label table gives the score 0 to all (share of toxic rows, if all are toxic: 1); other columns are ignored.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, byte_slices, cut, folded_words, let_go, mix, only_held, text_bytes, word_hashes

#: Labelled rows of each class that a fit takes at most, by ascending hash of doc_id; their texts are read whole.
SAMPLE_ROWS = 4000
MEMBERS, FOLDS = 3, 3
#: Bytes of the ordinary dictionary, and of what is trained on toxic windows in each round.
ORDINARY, TOXIC_ROUNDS = 128 << 10, (64 << 10, 32 << 10, 32 << 10)
#: The share of the control's windows that a toxic row's window has to surpass, and windows of that control.
SURPASSED, CONTROL = 0.98, 60_000
LEVEL, MATCH, SEGMENT, RUN = 6, 5, 16, 6
#: Both dictionaries end with this text twice (the library does not index the last bytes), and each window begins and ends with it.
CARRIER = b"\x01\x02\x03\x04\x05\x06\x07\x08" * 2
#: Bytes of the longest word in a window, words of an ordinary window that is trained on, windows whose gains a pair of dictionaries remembers, and
#: words whose gains a scorer remembers.
LONGEST, WORDS, WORDS_KNOWN, HASHES_KNOWN = 64, 6, 100_000, 1 << 20
STRONG = (1, 2, 3)


@dataclass
class Model:
    """Each member's ordinary and toxic content, and the calibrated curve; without members a constant."""

    members: list[tuple[bytes, bytes]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    constant: float = 0.0


def windows(words: list[bytes]) -> list[bytes]:
    """The words of a text as windows; every part of a long one is a window of its own."""
    return [w for word in words for w in ([word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)])]


class Runs:
    """Which windows hold a run of bytes by which the toxic content may gain: one of MATCH bytes or more that the ordinary content lacks.

    Runs of MATCH to MATCH + 2 bytes are told apart exactly; one of MATCH + 3 in the toxic content counts whether or not the ordinary one has it, as
    it may go on longer in the toxic one.
    """

    PLACES = 1 << 20

    def __init__(self, ordinary: bytes, toxic: bytes):
        mine, theirs = (np.frombuffer(c, np.uint8) for c in (toxic, ordinary))
        self.first = self._marked(self._runs(mine, MATCH))
        self.only = [np.setdiff1d(self._runs(mine, n), self._runs(theirs, n)) for n in range(MATCH, MATCH + 3)] + [np.unique(self._runs(mine, MATCH + 3))]
        self.likely = [self._marked(only) for only in self.only]

    @staticmethod
    def _runs(data: np.ndarray, n: int) -> np.ndarray:
        """The runs of n <= 8 bytes at every place, as numbers."""
        out = np.zeros(max(len(data) - n + 1, 0), np.uint64)
        for k in range(n):
            out = (out << np.uint64(8)) | data[k : k + len(out)]
        return out

    @classmethod
    def _place(cls, runs: np.ndarray) -> np.ndarray:
        return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % cls.PLACES

    @classmethod
    def _marked(cls, runs: np.ndarray) -> np.ndarray:
        out = np.zeros(cls.PLACES, bool)
        out[cls._place(runs)] = True
        return out

    def held(self, spaced: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each window, whether spaced holds such a run between its start and end. Windows are in order; the first starts at 0."""
        return self.held_in(Laid(spaced, starts, ends))

    def held_in(self, laid: Laid) -> np.ndarray:
        at = np.flatnonzero(self.first[laid.places])
        run, window = laid.runs[at], laid.window[at]
        room = laid.ends[window] - at
        out = np.zeros(len(laid.starts), bool)
        for n, (only, likely) in enumerate(zip(self.only, self.likely, strict=True), MATCH):
            fit = room >= n
            at, window, room, run = at[fit], window[fit], room[fit], run[fit]
            if n > MATCH:
                run = (run << np.uint64(8)) | laid.spaced[at + n - 1]
            seen = np.flatnonzero(likely[self._place(run)])
            if len(seen):
                out[window[seen[only[np.minimum(np.searchsorted(only, run[seen]), len(only) - 1)] == run[seen]]]] = True
        return out


class Laid:
    """Windows side by side, a space before and after each, with the run of MATCH bytes, its place in Runs' tables and the window at every byte."""

    def __init__(self, spaced: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.spaced, self.starts, self.ends = spaced, starts, ends
        self.runs = Runs._runs(spaced, MATCH)
        self.places = Runs._place(self.runs)
        self.window = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(spaced))) if len(starts) else np.zeros(len(spaced), np.int64)

    @classmethod
    def of(cls, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Laid:
        """The windows that lie between starts and ends of low."""
        sizes = ends - starts
        first = np.cumsum(sizes + 1) - sizes
        spaced = np.full(int(sizes.sum()) + len(sizes) + 1, 32, np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spaced[np.repeat(first, sizes) + within] = low[np.repeat(starts, sizes) + within]
        return cls(spaced, first - 1, first + sizes + 1)


class Gains:
    """Bytes that a toxic dictionary saves over the ordinary one, per window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # bytes that no UTF-8 text holds keep the ordinary dictionary as long, so that both index the common content alike
        blank = random.Random(len(toxic)).choices(b"\xf8\xf9\xfa\xfb\xfc\xfd\xfe\xff", k=len(toxic))
        self.pair = [self._packer(content + ordinary) for content in (toxic, bytes(blank))]
        self.runs = Runs(ordinary, toxic)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _packer(content: bytes):
        data = zstandard.ZstdCompressionDict(content + CARRIER + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def saved(self, window: bytes) -> int:
        """The gain of a window by both its compressed lengths."""
        framed = b"%b %b %b" % (CARRIER, window, CARRIER)
        toxic, ordinary = self.pair
        return len(ordinary(framed)) - len(toxic(framed))

    def compressed(self, window: bytes) -> int:
        """The gain of a window, remembered."""
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) >= WORDS_KNOWN:
                self.known.clear()
            gain = self.known[window] = self.saved(window)
        return gain

    def among(self, text: bytes, starts: np.ndarray, ends: np.ndarray, laid: Laid, gain=None) -> np.ndarray:
        """The gains of the windows that lie between starts and ends of text, and in laid; one without a run that the toxic content has to itself gains nothing."""
        gain = gain or self.compressed
        out = np.zeros(len(starts), np.int32)
        at = np.flatnonzero(self.runs.held_in(laid))
        out[at] = [gain(text[a:z]) for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        return out

    def all(self, found: list[bytes]) -> np.ndarray:
        """The gains of windows."""
        place: dict[bytes, int] = {}
        back = np.fromiter((place.setdefault(w, len(place)) for w in found), np.int64, len(found))
        text = b"".join(place)
        sizes = np.fromiter(map(len, place), np.int64, len(place))
        ends = np.cumsum(sizes)
        return self.among(text, ends - sizes, ends, Laid.of(np.frombuffer(text, np.uint8), ends - sizes, ends))[back]


def features(sizes: np.ndarray, row: np.ndarray, gains: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A line for each row, of sizes windows. row, gains and around: of each window that gains anything its row, its gain and that of the words around it.

    The two largest gains, the number of strong ones by threshold, their share, the number of windows, the largest gain around and the strong ones there.
    """
    n = np.maximum(sizes, 5)
    top = np.zeros((len(sizes), 2))
    order = np.lexsort((-gains, row))
    place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    for k in (0, 1):
        top[row[order][place == k], k] = gains[order][place == k]
    strong = np.stack([np.bincount(row[gains >= t], minlength=len(sizes)) for t in STRONG], axis=1)
    near = np.zeros(len(sizes))
    np.maximum.at(near, row, around)
    often = np.bincount(row[around >= STRONG[-1]], minlength=len(sizes))
    return np.column_stack([np.clip(top, 0, 12), np.log1p(strong), np.log1p(100 * strong / n[:, None]), np.log(n), np.minimum(near, 12), np.log1p(often)])


def row_features(words: list[bytes], gains: Gains) -> list[float]:
    """The features of a text's words by one pair of dictionaries."""
    g = gains.all(words)
    hot = np.flatnonzero(g > 0)
    around = gains.all([b" ".join(words[max(i - 1, 0) : i + 2]) for i in hot.tolist()])
    return features(np.array([len(words)]), np.zeros(len(hot), np.int64), g[hot], around)[0].tolist()


def probability(x: np.ndarray, weights: list[float]) -> np.ndarray:
    w = np.asarray(weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> list[float]:
    """Newton steps for a ridge-penalised logistic curve."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _copies_once(rows: list[tuple[str, int]]) -> list[tuple[list[bytes], int]]:
    """The windows of one of the rows that share one of two minima over hashes of four-word runs: copies would pass off their own words as marks of a class."""
    seen: set[tuple[int, int]] = set()
    once: dict[bytes, bytes] = {}  # equal words of all rows are one object
    out = []
    for text, label in rows:
        raw, offsets = text_bytes(pa.array([text], pa.string()))
        low, starts, ends, _ = folded_words(raw, offsets)
        h = word_hashes(low, starts, ends)
        for _ in range(3):
            h = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
        if not len(h):
            continue
        keys = {(0, int(h.min())), (1, int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).min()))}
        if not keys & seen:
            text_low = low.tobytes()
            out.append(([once.setdefault(w, w) for w in windows([text_low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])], label))
        seen |= keys
    return out


def _content(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard's trainer makes of samples; where they are too few to train on, the samples themselves."""
    try:
        # the header and entropy tables before the content stay in: as raw content they match nothing
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=RUN, f=20, accel=1, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def toxic_windows(toxic: list[list[bytes]], ordinary: bytes, control: list[bytes]) -> list[list[bytes]]:
    """Of each fold of toxic rows the windows that gain by the dictionaries of the other folds, after all rounds."""
    folds = [[w for words in toxic[k::FOLDS] for w in dict.fromkeys(words)] for k in range(FOLDS)]
    kept = folds
    for size in TOXIC_ROUNDS:
        taken = []
        for k in range(FOLDS):
            gains = Gains(ordinary, _content([b" %b " % w for j in range(FOLDS) if j != k for w in kept[j]], size))
            least = max(1, int(np.quantile(gains.all(control), SURPASSED))) if control else 1
            taken.append([w for w, g in zip(folds[k], gains.all(folds[k]), strict=True) if g > least])
        if not any(taken):
            break
        kept = taken
    return kept


def fit_member(docs: list[tuple[list[bytes], int]], seed: int) -> tuple[bytes, bytes, list[list[float]]]:
    """A member's ordinary and toxic content, and the cross-fitted features of the rows of calibration_rows, in order."""
    toxic, ordinary, held = _split(docs)
    rng = random.Random(seed)
    rng.shuffle(ordinary)
    half = len(ordinary) // 2
    plain = [b" %b " % b" ".join(words[i : i + WORDS]) for words in ordinary[:half] for i in range(0, len(words), WORDS)]
    rng.shuffle(plain)
    common = _content(plain, ORDINARY)
    control = [w for words in ordinary[half:] for w in dict.fromkeys(words)]
    rng.shuffle(control)
    kept = toxic_windows(toxic, common, control[:CONTROL])
    size = TOXIC_ROUNDS[-1]
    found: dict[tuple[int, int], list[float]] = {}
    for k in range(FOLDS):
        gains = Gains(common, _content([b" %b " % w for j in range(FOLDS) if j != k for w in kept[j]], size))
        for label, rows in ((1, toxic), (0, held)):
            for i in range(k, len(rows), FOLDS):
                found[label, i] = row_features(rows[i], gains)
    final = _content([b" %b " % w for part in kept for w in part], size)
    return common, final, [found[1, i] for i in range(len(toxic))] + [found[0, i] for i in range(len(held))]


def _split(docs: list[tuple[list[bytes], int]]) -> tuple[list, list, list]:
    """Toxic rows, ordinary rows to learn from and, a third, ordinary rows to calibrate with."""
    toxic, ordinary = ([w for w, y in docs if y == k] for k in (1, 0))
    return toxic, [w for i, w in enumerate(ordinary) if i % 3], ordinary[::3]


def calibrated(toxic: int, members: list[tuple[bytes, bytes, list[list[float]]]], odds: float) -> Model:
    """The model of fitted members; the first so many rows of their features are toxic. odds: toxic rows to ordinary ones among all that are labelled, not only those that calibrate."""
    x = np.mean([m[2] for m in members], axis=0)
    y = (np.arange(len(x)) < toxic).astype(float)
    weights = _logistic(x, y)
    weights[-1] += float(np.log(odds * (len(x) - toxic) / toxic))
    return Model([m[:2] for m in members], weights)


def _one_class(rows: list[tuple[str, int]], docs: list) -> Model | None:
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    if min(n) >= 2 * FOLDS:
        return None
    return Model(constant=1.0 if rows and all(y == 1 for _, y in rows) else 0.0)


def fit_rows(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled texts (text, 0 or 1), in the order given."""
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    docs = _copies_once(rows)
    toxic = sum(y for _, y in docs)
    return _one_class(rows, docs) or calibrated(toxic, [fit_member(docs, seed) for seed in range(MEMBERS)], toxic / (len(docs) - toxic))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0: of each class the sample_rows with the least hash of doc_id. A task fits a member; the
    driver receives the dictionaries and a few numbers for each of at most 2 * sample_rows rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).distinct()
    first, second = (known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1))
    picked = F.broadcast(first.union(second))  # at most 2 * sample_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").join(picked, "doc_id").dropDuplicates(["doc_id", "toxic"])
    sample = cut(texts.select("doc_id", "text", "toxic"), "labelled")

    def member(key: tuple, table: pa.Table) -> pa.Table:
        let_go()
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("toxic").to_pylist(), table.column("text").to_pylist(), strict=True))
        random.Random(11).shuffle(rows)
        labelled = [(t, y) for _, y, t in rows]
        found = _copies_once(labelled)
        one = _one_class(labelled, found)
        common, final, x = fit_member(found, key[0].as_py()) if one is None else (b"", b"", [])
        toxic_rows = sum(y for _, y in found)
        del rows, labelled, found
        let_go()
        made = {"member": key[0].as_py(), "toxic_rows": toxic_rows, "constant": one.constant if one else None, "common": common, "content": final, "features": json.dumps(x)}
        return pa.Table.from_pylist([made], schema=pa.schema([("member", pa.int32()), ("toxic_rows", pa.int64()), ("constant", pa.float64()), ("common", pa.binary()), ("content", pa.binary()), ("features", pa.string())]))

    each = sample.withColumn("member", F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])))
    fitted = each.groupBy("member").applyInArrow(member, "member int, toxic_rows long, constant double, common binary, content binary, features string")
    rows = sorted(cut(fitted, "members").collect())  # MEMBERS rows
    if not rows:
        return Model()
    if rows[0].constant is not None:
        return Model(constant=rows[0].constant)
    share = known.agg(F.avg("toxic")).first()[0]
    return calibrated(rows[0].toxic_rows, [(bytes(r.common), bytes(r.content), json.loads(r.features)) for r in rows], share / (1 - share))


class _Scorer:
    """Scores texts with a model; the gains of words are remembered by hash, and of what is around them by text, up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.gains = [Gains(*m) for m in model.members]
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros((0, len(self.gains)), np.int16)

    def word_gains(self, hashes: np.ndarray, text: bytes, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each member's gains of the words between starts and ends of text (low: its bytes), whose ascending, distinct hashes are given."""
        if len(self.hashes) > HASHES_KNOWN:
            self.hashes, self.known = self.hashes[:0], self.known[:0]
        at = np.searchsorted(self.hashes, hashes)
        met = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        met[inside] = self.hashes[at[inside]] == hashes[inside]
        out = np.empty((len(hashes), len(self.gains)), np.int16)
        out[met] = self.known[at[met]]
        fresh = np.flatnonzero(~met)
        if len(fresh):
            starts, ends = starts[fresh], ends[fresh]
            laid = Laid.of(low, starts, ends)
            for k, gains in enumerate(self.gains):
                out[fresh, k] = gains.among(text, starts, ends, laid, gains.saved)
            self.hashes = np.insert(self.hashes, at[fresh], hashes[fresh])
            self.known = np.insert(self.known, at[fresh], out[fresh], axis=0)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.gains:
            return np.full(len(column), self.model.constant)
        raw, offsets = text_bytes(column)
        low, starts, ends, rows = folded_words(raw, offsets)
        text = low.tobytes()
        if len(starts) and int((ends - starts).max()) > LONGEST:
            sizes = -(-(ends - starts) // LONGEST)
            rows = np.concatenate([[0], np.cumsum(sizes)])[rows]
            first = np.repeat(starts, sizes) + LONGEST * (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            starts, ends = first, np.minimum(first + LONGEST, np.repeat(ends, sizes))
        hashes, first, back = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        each = self.word_gains(hashes, text, low, starts[first], ends[first])
        row = np.repeat(np.arange(len(column)), np.diff(rows))
        x = np.zeros((len(column), len(self.model.weights) - 1))
        for k, gains in enumerate(self.gains):
            found = each[:, k][back].astype(np.int64)
            hot = np.flatnonzero(found > 0)
            least, most = np.maximum(hot - 1, rows[row[hot]]), np.minimum(hot + 2, rows[row[hot] + 1])
            near = [b" ".join([text[starts[j] : ends[j]] for j in range(a, z)]) for a, z in zip(least.tolist(), most.tolist(), strict=True)]
            x += features(np.diff(rows), row[hot], found[hot], gains.all(near))
        return probability(x / len(self.gains), self.model.weights)


def _scorer(model: Model) -> _Scorer:
    """The scorer of this Python process for a model."""
    return only_held(("toxicity", tuple(model.members), tuple(model.weights), model.constant), lambda: _Scorer(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with held_out, score and predicted, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for whole in batches:
            for b in byte_slices(whole, 1, 2 * SLICE_BYTES):
                yield pa.record_batch([b.column(0), pa.array(scorer.scores(b.column(1)), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for whole in batches:
            for b in byte_slices(whole, at, 2 * SLICE_BYTES):
                yield b.filter(pa.array(scorer.scores(b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
