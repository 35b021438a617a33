"""Language-model scores: exact unigram counts, and a hashed maximum-entropy model with a class-factored softmax.

The model gives P(class | history) * P(word | class). A frequent word is a class of its own; the other words of the head share classes of
CLASS_SHARE of the corpus, by falling frequency, and all others share class 0; inside these a word has its smoothed unigram share. P(class | history) is
factored once more: classes are halved by mass again and again, and each halving is a softmax of two over a bias, which starts at the
corpus shares, plus one weight for each of four hashed history features: the last word, the last two words, and the words two and three back (skips).
A token touches some nine halvings of four weights each, of millions: batches are sparse lists of (token, weight). A weight's place is a hash of the
feature and of a group of halvings, three levels of them, whose seven weights share a cache line; the hash also permutes them in it, so that
all places fill alike. The probabilities of all words, unseen ones included, add up to one. Weights grow in number with the training tokens.
They are learned in rounds: each task sums the gradient of its texts, sums are added by block of weights, and the driver, which holds only the
weights, takes a step. Each round reads another part of the training texts; together they read all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

#: No word has white space, so this token is none.
END = "\n"
ALPHA = 0.1
#: Words whose counts every task has; the counts of others are joined.
HEAD = 150_000
#: Share of the training tokens that makes a class: words with more are classes by themselves.
CLASS_SHARE = 1 / 1024
#: WEIGHTS do for BASE_TOKENS training tokens; they double with every eightfold of them. Blocks of them are added up together.
WEIGHTS, BASE_TOKENS, BLOCKS = 1 << 21, 1 << 22, 64
FEATURES, ROUNDS, STEP, RIDGE = 4, 4, 0.35, 4.0
#: Halvings of LEVELS levels of a path make a group, whose weights for a feature lie side by side.
LEVELS = 3
#: Tokens that are scored at once.
TOKENS = 1 << 16
#: Tokens whose halvings are held at once, small enough for a core's cache.
AT_ONCE = 1 << 12


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, then the end."""
    return [*(text or "").encode().lower().split(), END.encode()]


def held_out(key: Column) -> Column:
    return part(key) == 0


def part(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(10))


def count_tokens(texts: DataFrame) -> DataFrame:
    """word, n over texts (one column); counted by batch, then by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, _ = coded(batch.column(0))
            counts = np.bincount(codes, minlength=len(words))
            if not counts[-1]:  # a batch without rows has no end
                continue
            yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halved(mass: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Of each class its path, (halving, side) from the top, and of each halving the log of its sides' masses' ratio. Classes stay in order."""
    upto, paths, bias = np.concatenate([[0.0], np.cumsum(mass)]), [[] for _ in mass], []
    open_: list[tuple[int, int, list[tuple[int, int]]]] = [(0, len(mass), [])]
    while open_:
        a, b, path = open_.pop()
        if b - a == 1:
            paths[a] = path
            continue
        middle = (upto[a] + upto[b]) / 2
        cut = min(max(int(np.searchsorted(upto, middle)), a + 1), b - 1)
        if cut - 1 > a and middle - upto[cut - 1] < upto[cut] - middle:
            cut -= 1
        bias.append(math.log((upto[b] - upto[cut]) / (upto[cut] - upto[a])))
        open_ += [(a, cut, [*path, (len(bias) - 1, 0)]), (cut, b, [*path, (len(bias) - 1, 1)])]
    return paths, bias


class Paths:
    """Matrices of paths of one length, a column each: of every halving its bias, the side taken and its slot in its group (1 for the group's topmost,
    2 and 3 under it, and so on), and of every group the hash of its topmost halving. group: that of each row."""

    def __init__(self, paths: list[list[tuple[int, int]]], bias: np.ndarray):
        steps = np.array(paths, np.int64).reshape(len(paths), len(paths[0]), 2)
        halving, side = steps[..., 0].T.copy(), steps[..., 1].T.copy()
        self.ratio, self.side, self.slot = bias[halving], side.astype(np.float32), np.ones_like(side)
        for j in range(len(side)):
            if j % LEVELS:
                self.slot[j] = 2 * self.slot[j - 1] + side[j - 1]
        self.mixed, self.group = halving[::LEVELS].astype(np.uint32) * np.uint32(0x9E3779B1), np.arange(len(side)) // LEVELS


def aligned(n: int, kind: type) -> np.ndarray:
    """n zeros that begin at a cache line, so that few groups lie across two."""
    size = np.dtype(kind).itemsize
    held = np.zeros(n + 64 // size, kind)
    skip = -held.ctypes.data % 64 // size
    return held[skip : skip + n]


@dataclass
class Model:
    """head: words by falling count, with counts. total and distinct: of training tokens."""

    head: list[tuple[str, int]]
    total: int
    distinct: int
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        growth = max(0, math.floor(math.log2(max(1, self.total) / BASE_TOKENS) / 3))
        self.weights = np.zeros(WEIGHTS << growth, np.float32)
        counts = np.array([n for _, n in self.head], float) + ALPHA
        rest = max(self.total - (counts.sum() - ALPHA * len(counts)), 0) + ALPHA * (self.distinct - len(self.head) + 1)
        mass = np.concatenate([[rest], counts])
        #: Class of each rank; rank 0 is that of words outside the head.
        self.class_of, least = np.zeros(len(mass), np.int64), CLASS_SHARE * mass.sum()
        held, last = math.inf, 0
        for r in range(1, len(mass)):
            if held >= least or mass[r] >= least:
                held, last = 0.0, last + 1
            self.class_of[r] = last
            held += mass[r]
        self.n_classes = last + 1
        sums = np.bincount(self.class_of, mass, self.n_classes)
        #: log10 of the mass that the counts inside a class are divided by.
        self.within_log = np.log10(sums)
        paths, bias = halved(sums)
        self.bias = np.array(bias, np.float32)
        self.depth = np.array([len(p) for p in paths], np.int64)
        #: Of each class its place by depth, then number, and its place among those of its depth.
        order = np.argsort(self.depth, kind="stable")
        self.by_depth, upto = np.argsort(order).astype(np.uint32), np.cumsum(np.bincount(self.depth))
        self.column = self.by_depth - (upto - np.bincount(self.depth))[self.depth]
        self.paths = {int(d): Paths([paths[c] for c in order if self.depth[c] == d], self.bias) for d in np.unique(self.depth)}
        self.log_counts = np.log10(np.array([0.0, *(n for _, n in self.head)]) + ALPHA)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state: dict):
        self.__dict__ |= state | {"weights": aligned(len(state["weights"]), np.float32)}
        self.weights[:] = state["weights"]

    def word_table(self) -> Words:
        """This process's table for the model, kept between its tasks."""
        if "words" not in self.__dict__:
            self.words = Words(self)
        return self.words

    def feature_rows(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes of the features (features, tokens), of 32 bits; place: of each token in its text."""
        back = [np.where(place >= k, np.roll(hashes, k), np.uint64(k)) for k in (1, 2, 3)]
        mixes = (back[0] * np.uint64(0x9E3779B97F4A7C15), back[0] * np.uint64(0xC2B2AE3D27D4EB4F) + back[1] * np.uint64(0x165667B19E3779F9), back[1] * np.uint64(0xD6E8FEB86659FD93), back[2] * np.uint64(0xA0761D6478BD642F))
        return np.stack([(m ^ m >> np.uint64(31)) * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(32) for m in mixes]).astype(np.uint32)

    def in_order(self, classes: np.ndarray) -> np.ndarray:
        """Places of the tokens by class, those of a depth together."""
        return np.argsort(self.by_depth.take(classes).astype(np.uint16 if self.n_classes < 1 << 16 else np.uint32), kind="stable")

    def halvings(self, features: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """A sparse batch: of each halving on the classes' paths its token, its side, the place of its weight for each feature, and its logit. Classes of
        one depth are a matrix, so tokens in_order() cost least."""
        shift, depths = np.uint32(33 - len(self.weights).bit_length()), self.depth.take(classes)
        parts = []
        for d in np.flatnonzero(np.bincount(depths)).tolist():
            at, paths = np.flatnonzero(depths == d), self.paths[d]
            column = self.column.take(classes.take(at))
            mixed, slot, z, places = paths.mixed.take(column, 1), paths.slot.take(column, 1), paths.ratio.take(column, 1), []
            for f in features:
                i = mixed ^ f.take(at)
                i *= np.uint32(0x85EBCA6B)
                i >>= shift
                i = i.astype(np.int64).take(paths.group, 0)
                i ^= slot
                places.append(i.ravel())
                z += self.weights.take(i)
            parts.append((np.tile(at, d), paths.side.take(column, 1).ravel(), *places, z.ravel()))
        token, side, *places, z = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        return token, side, places, z

    def class_logs(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of P(class | history) of each token."""
        token, side, _, z = self.halvings(features, classes)
        z *= 1 - 2 * side
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        z += 1
        return np.bincount(token, np.log(z, out=z), len(classes)) / -math.log(10)


class Words:
    """Hashes of words, and their ranks from 1 in the head or 0."""

    def __init__(self, model: Model):
        import xxhash

        self.hash, self.head = xxhash.xxh32_intdigest, pa.array([w for w, _ in model.head], pa.string())

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ranks = pc.index_in(words, self.head).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # by way of numpy, as to_pylist() takes many times as long
        return np.fromiter(map(self.hash, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words)), ranks


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """tokens() of many texts: distinct words, of each token the place of its word among them, and of each text its number of tokens."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    starts, flat = np.asarray(words.offsets) - words.offsets[0].as_py(), words.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at the ends of a text leaves empty strings
    upto = np.concatenate([[0], np.cumsum(full)])
    sizes = np.diff(upto[starts]) + 1
    found = flat.filter(pa.array(full)).dictionary_encode()
    codes = np.full(sizes.sum(), len(found.dictionary), np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = np.asarray(found.indices)
    return pa.concat_arrays([found.dictionary, pa.array([END], found.dictionary.type)]), codes, sizes


def token_batches(model: Model, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.Array], tuple[pa.Array, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns before the texts', distinct words and codes of all tokens, first token of each row, ranks, hashes and places of all tokens, for TOKENS
    tokens or one text at a time. A batch's distinct words are looked up once."""
    table = model.word_table()
    for batch in batches:
        words, codes, sizes = coded(batch.column(column))
        hashes, ranks = table.look_up(words)
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            begin = ends[row] - sizes[row]
            upto = min(max(int(np.searchsorted(ends, begin + TOKENS, "right")), row + 1), len(sizes))
            first = ends[row:upto] - sizes[row:upto] - begin
            part = codes[begin : ends[upto - 1]]
            place = np.arange(len(part)) - np.repeat(first, sizes[row:upto])
            yield [c.slice(row, upto - row) for c in batch.columns[:column]], (words, part), first, ranks.take(part), hashes.take(part), place
            row = upto


def parts_of(n: int, size: int) -> Iterator[slice]:
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def gradient(model: Model, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of each weight the gradient of the log probability and the curvature, summed over the texts in the batches' only column."""
    both = aligned(len(model.weights), np.complex64)  # slope and curvature, so that one access adds both
    for _, _, _, ranks, hashes, place in token_batches(model, batches, 0):
        order = model.in_order(classes := model.class_of.take(ranks))
        classes, features = classes.take(order), model.feature_rows(hashes, place).take(order, 1)
        for s in parts_of(len(ranks), AT_ONCE):
            _, side, places, z = model.halvings(features[:, s], classes[s])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = np.empty(len(p), np.complex64)
            step.real, step.imag = side - p, p * (1 - p)
            for i in places:
                np.add.at(both, i, step)
    return both.real.copy(), both.imag.copy()


def gradient_sum(model: Model, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """gradient() over all texts: blocks of weights are added by block, from many tasks by salted block first; the driver gets one sum of the model's
    size. Curvatures, which only scale the step, travel as 16-bit numbers."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(model)
    # every task hands on a whole gradient, so there are as many as cores can use, however large the input
    tasks = max(spark.sparkContext.defaultParallelism, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slope, curve = gradient(held.value, batches)
        salt = TaskContext.get().partitionId() % 64
        for k, (g, h) in enumerate(zip(np.split(slope, BLOCKS), np.split(np.minimum(curve, 6e4).astype(np.float16), BLOCKS), strict=True)):
            if g.any():
                yield packed_blocks([k], [salt], [g.tobytes()], [h.tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, g, h in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                g, h = np.frombuffer(g.as_buffer(), np.float32), np.frombuffer(h.as_buffer(), np.float16).astype(np.float32)
                if block in sums:
                    sums[block][0] += g
                    sums[block][1] += h
                else:
                    sums[block] = [g.copy(), h]
        if sums:
            yield packed_blocks(list(sums), [0] * len(sums), [x[0].tobytes() for x in sums.values()], [np.minimum(x[1], 6e4).astype(np.float16).tobytes() for x in sums.values()])

    schema = "block int, salt int, slope binary, curve binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = texts.coalesce(tasks).mapInArrow(run, schema)
    if tasks > 64:
        summed = summed.repartition(parts, "block", "salt").mapInArrow(add, schema)
    summed = summed.repartition(min(parts, BLOCKS), "block").mapInArrow(add, schema)
    slope, curve = np.zeros((BLOCKS, len(model.weights) // BLOCKS), np.float32), np.zeros((BLOCKS, len(model.weights) // BLOCKS), np.float32)
    for row in summed.toLocalIterator():
        slope[row.block] += np.frombuffer(row.slope, np.float32)
        curve[row.block] += np.frombuffer(row.curve, np.float16)
    held.unpersist()
    return slope.ravel(), curve.ravel()


def packed_blocks(blocks: list[int], salts: list[int], slopes: list[bytes], curves: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(salts, pa.int32()), pa.array(slopes, pa.binary()), pa.array(curves, pa.binary())], names=["block", "salt", "slope", "curve"])


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[str, int]]:
    """The words with counts high enough that no more than `most` words have them, by falling count, then word.

    Tasks are asked only for these: the least such count is found first, from the number of words with each count.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    upto = sizes.select("n", F.sum("words").over(Window.orderBy(F.col("n").desc())).alias("upto"))
    least = upto.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    found = [] if least is None else counts.where(F.col("n") >= least).collect()
    return sorted(((r.word, r.n) for r in found), key=lambda r: (-r[1], r[0]))


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table of all training words' counts. texts: column text, and column part, a number from 1 to 9 that deals them to rounds."""
    counts = materialize(count_tokens(texts.select("text")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = frequent(counts)
    model = Model(head, total, distinct)
    for k in range(rounds if total else 0):
        slope, curve = gradient_sum(model, texts.where(F.pmod(F.col("part"), F.lit(rounds)) == k).select("text"))
        model.weights += np.float32(STEP) * slope / (curve + np.float32(RIDGE))  # a diagonal Newton step
    return model, counts


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """key, held_out, n_tokens, n_known, base_log, score_log, tail: what can be had without the counts of rare words, which are listed in tail."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score_log", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for docs, (names, codes), first, ranks, hashes, place in token_batches(model, batches, 2):
            classes, features = model.class_of.take(ranks), model.feature_rows(hashes, place)
            order, logs = model.in_order(classes), np.empty(len(ranks))
            for s in parts_of(len(ranks), AT_ONCE):
                logs[order[s]] = model.class_logs(features.take(order[s], 1), classes.take(order[s]))
            known = ranks > 0
            base = np.where(known, model.log_counts[ranks], 0.0)
            logs += base - model.within_log[classes]
            ends = np.append(first[1:], len(ranks))
            rare = np.flatnonzero(~known)
            # rows and words as one number, which sorts by row
            pairs, times = np.unique(np.searchsorted(ends, rare, "right") * len(names) + codes[rare], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(first) + 1) * len(names))
            tail = pa.StructArray.from_arrays([names.take(pa.array(pairs % len(names))).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "m"])
            columns = [ends - first, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logs, first)]
            numbers = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(docs) :], strict=False)]
            yield pa.RecordBatch.from_arrays([*docs, *numbers, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)], names=schema.names)

    return rows.mapInArrow(run, "key long, held_out boolean, n_tokens long, n_known long, base_log double, score_log double, tail array<struct<word:string,m:long>>")


def language_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of df, in log10 of probability.

    Rows are held out if the crc32 of the key, as text, is divisible by ten; a null key counts as empty, and is held out. Null texts count
    as empty: one token, the end. Without training texts every token has probability one by the base and the model. Repeated rows
    train and are scored each by itself. Other columns aren't read. Counts of words outside the HEAD most frequent are
    joined by word, which no hot word can skew, and added up by row.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("part", part(F.col("key")))
    model, counts = train(rows.where("part != 0").select("text", "part"))
    scored = score_rows(rows.select("key", (F.col("part") == 0).alias("held_out"), "text"), model)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("tail")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + ALPHA)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base_norm = math.log10(model.total + ALPHA * (model.distinct + 1))
    return scored.drop("tail").join(rare, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_log") + zero("rare_log") - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("score_log") + zero("rare_log")).alias("score"),
    )


def op10(df: DataFrame) -> DataFrame:
    return language_scores(df)
