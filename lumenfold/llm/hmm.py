"""A hidden Markov language model, trained by Baum-Welch and scored by the scaled forward recursion.

Each state emits a class; each class emits a word. The ``TOP`` most frequent training words and the end
of text are classes of their own, any other word belongs to the class of its last bytes (``SHAPES`` of
them), inside which words are smoothed counts over the training texts (a count of c weighs c + 0.1, an
unseen word 0.1). So the model's size is fixed while word counts grow with the corpus, and the
probabilities of all token sequences that end sum to one.

Passes over the data:
1. word counts of the training texts, aggregated by a 64-bit hash of the word;
2. texts written as class ids, with the sums that need only frequent words (``KNOWN`` of them are sent
   to the tasks, a fixed number); rarer words are joined to their counts by a shuffle on the hash;
3. Baum-Welch rounds over all training texts until one gains less than ``GAIN``, or ``ROUNDS``: each task returns expected counts, summed by
   class across tasks. Only the starting point comes from a bounded sample (``START_DOCS`` texts,
   clustered, then a few rounds of the same training);
4. the forward recursion over every text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fold, small_batches, table, threshold
from .words import hash_words, _LOWER, mix, pieces, tidy, utf8, word_spans

TOP, SHAPES, KNOWN = 32_768, 4096, 131_072
STATES, START_DOCS, START_ROUNDS = 8, 1000, 4
#: Training over the corpus ends when a round gains less than GAIN in log10 likelihood a token, or after ROUNDS.
ROUNDS, GAIN = 12, 0.001
ADD = 0.1
#: Tokens whose forward and backward values are held at once.
HELD = 400_000


def shapes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class of each word by its last three bytes (fewer if it is shorter)."""
    h = np.minimum(lengths, 3).astype(np.uint64)
    end = starts + lengths - 1
    for j in range(3):
        at = np.maximum(end - j, starts)
        h = h * np.uint64(257) + _LOWER[raw[at]].astype(np.uint64)
    return (mix(h, 11) % np.uint64(SHAPES)).astype(np.int32)


@tidy
def _tally(batches):
    """Word hash, shape and count, summed inside the task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def merged():
        h, s, c = (np.concatenate(x) for x in zip(*held))
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        return u, s[first], np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        for a, b in pieces(offsets):
            part = raw[offsets[a] : offsets[b]]
            starts, lengths, _ = word_spans(part, offsets[a : b + 1] - offsets[a])
            h = hash_words(part, starts, lengths)
            u, first, count = np.unique(h, return_index=True, return_counts=True)
            held.append((u, shapes(part, starts[first], lengths[first]), count))
            n += len(u)
        if n > 2_000_000:
            held[:] = [merged()]
            n = len(held[0][0])
            if n > 1_500_000:
                yield _tallied(held.pop())
                n = 0
    if held:
        yield _tallied(merged())


def _tallied(x):
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2])], ["h", "shape", "c"])


class Vocabulary:
    """What a task needs to know of the counts: the most frequent words and the totals of the shape classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, rank: np.ndarray, shape_n: np.ndarray, shape_v: np.ndarray, ends: int, tokens: int, types: int):
        self.h, self.c, self.rank = h, c, rank  # sorted by h
        self.inside = np.log10(shape_n + ADD * (shape_v + 1))
        self.ends, self.tokens, self.types = ends, tokens, types
        self.floor = np.log10(tokens + ADD * (types + 1))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the frequent words, and whether it is one."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


END = TOP + SHAPES
CLASSES = END + 1


@tidy
def _encode(batches, vocabulary):
    v: Vocabulary = vocabulary.value
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    done = 0
    for batch in batches:
        raw, offsets = utf8(batch.column(2))
        out: list[list] = [[] for _ in range(8)]
        for a, b in pieces(offsets):
            piece = raw[offsets[a] : offsets[b]]
            starts, lengths, first = word_spans(piece, offsets[a : b + 1] - offsets[a])
            h = hash_words(piece, starts, lengths)
            u, some, back = np.unique(h, return_index=True, return_inverse=True)
            shape = shapes(piece, starts[some], lengths[some])
            at, known = v.look(u)
            own = known & (v.rank[at] < TOP) if len(v.h) else known
            cls = np.where(own, v.rank[at] if len(v.h) else 0, TOP + shape).astype(np.uint16)[back]
            logc = np.where(known, np.log10((v.c[at] if len(v.h) else 0) + ADD), 0.0)
            word_base = logc[back]
            word_in = np.where(own, 0.0, logc - v.inside[shape])[back]
            rare = ~known[back]
            for i in range(b - a):
                s, e = first[i], first[i + 1]
                r, n = np.unique(h[s:e][rare[s:e]], return_counts=True)
                row = (part + done, e - s + 1, np.append(cls[s:e], np.uint16(END)).astype("<u2").tobytes(), word_base[s:e].sum() + np.log10(v.ends + ADD) - (e - s + 1) * v.floor, word_in[s:e].sum(), int((~rare[s:e]).sum()) + (v.ends > 0), r.view(np.int64), n)
                done += 1
                for x, y in zip(out, row):
                    x.append(y)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(out, kinds)]], ["doc_id", "held_out", "row", "n_tokens", "cls", "base", "inside", "known", "rare", "times"])


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Expected counts to probabilities. A class's prior share in every state is its share over all."""
        share = emit.sum(axis=1) + ADD
        emit = emit + 5.0 * (share / share.sum())[:, None] * STATES
        return cls((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def lockstep(docs: list[np.ndarray]):
    """Sequences, longest first, laid out by time: classes, the first place of each time, and the order of the documents."""
    size = np.array([len(d) for d in docs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(alive)])
    flat = np.concatenate([docs[i] for i in order])
    rank = np.repeat(np.arange(len(size)), size)
    time = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(flat), np.int64)
    out[begin[time] + rank] = flat
    return out, begin, order


def groups(docs: list[np.ndarray], most: int = HELD):
    """Documents in groups of at most ``most`` tokens (or one longer), longest first, as index lists."""
    held, n = [], 0
    for i in np.argsort([-len(d) for d in docs], kind="stable"):
        if held and n + len(docs[i]) > most:
            yield held
            held, n = [], 0
        held.append(int(i))
        n += len(docs[i])
    if held:
        yield held


def forward(model: Model, cls: np.ndarray, begin: np.ndarray, keep: bool):
    """Scale factors of every place, and with ``keep`` the scaled forward values too.

    The product of a document's factors is its probability.
    """
    seen = model.emit[cls]
    scale = np.empty(len(cls))
    ones = np.ones(len(model.start))
    alpha = model.start
    for t in range(len(begin) - 1):
        lo, hi = begin[t], begin[t + 1]
        now = seen[lo:hi]
        if t:
            now *= alpha[: hi - lo] @ model.move
        else:
            now *= alpha
        c = now @ ones
        now /= c[:, None]
        scale[lo:hi] = c
        alpha = now
    return scale, seen if keep else None


def log10_likelihood(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(docs))
    for group in groups(docs):
        cls, begin, order = lockstep([docs[i] for i in group])
        scale, _ = forward(model, cls, begin, False)
        rank = np.arange(len(cls)) - np.repeat(begin[:-1], np.diff(begin))
        out[np.array(group)[order]] = np.bincount(rank, weights=np.log10(scale), minlength=len(group))
    return out


def expected_counts(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One E step: expected starts, moves and emissions."""
    return e_step(model, docs)[:3]


def e_step(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log10 likelihood of ``docs`` under ``model``."""
    k, log = len(model.start), 0.0
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    for group in groups(docs):
        cls, begin, _ = lockstep([docs[i] for i in group])
        scale, alpha = forward(model, cls, begin, True)
        log += float(np.log10(scale).sum())
        seen = model.emit[cls] / scale[:, None]
        beta = np.ones((len(cls), k))
        for t in range(len(begin) - 3, -1, -1):
            lo, hi, end = begin[t], begin[t + 1], begin[t + 2]
            ahead = seen[hi:end]
            ahead *= beta[hi:end]  # what follows, seen from the next place
            beta[lo : lo + end - hi] = ahead @ model.move.T
        # rows that have a next place: alpha there, against ``seen`` (now emission * beta / scale) at the next
        later = np.arange(begin[1], len(cls)) if len(begin) > 2 else np.zeros(0, np.int64)
        if len(later):
            width = np.diff(begin)
            earlier = later - np.repeat(width[:-1], width[1:])
            move += alpha[earlier].T @ seen[later]
        alpha *= beta
        start += alpha[begin[0] : begin[1]].sum(axis=0)
        for j in range(k):
            emit[:, j] += np.bincount(cls, weights=alpha[:, j], minlength=CLASSES)
    return start, move * model.move, emit, log


@tidy
def _expect(batches, model):
    total = None
    for batch in batches:
        docs = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(0)]
        if docs:
            got = e_step(model.value, docs)
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
    if total is None:
        return
    start, move, emit, log = total
    rows = np.flatnonzero(emit.sum(axis=1) > 0)
    key = np.concatenate([rows, CLASSES + np.arange(len(move) + 2)])
    value = np.concatenate([emit[rows], move, start[None, :], np.full((1, len(move)), log)])
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *[pa.array(value[:, j]) for j in range(value.shape[1])]], ["key", *[f"s{j}" for j in range(value.shape[1])]])


def start_model(docs: list[np.ndarray], states: int, seed: int = 5) -> Model:
    """A first model from a bounded sample: texts clustered by their classes, then a few rounds of training."""
    rng = np.random.default_rng(seed)
    docs = [d.astype(np.int64) for d in docs]
    emit = np.zeros((CLASSES, states))
    if not docs:
        return Model.from_counts(np.ones(states), np.eye(states) * 9 + 1, emit + 1)
    bag = np.zeros((len(docs), 4096), np.float32)
    for i, d in enumerate(docs):
        np.add.at(bag[i], (d * 2654435761 >> 7) % 4096, 1)
    bag = np.sqrt(bag / bag.sum(axis=1, keepdims=True))
    centre = bag[rng.choice(len(docs), states, replace=len(docs) < states)]
    for _ in range(12):
        near = (bag @ centre.T).argmax(axis=1)
        for j in range(states):
            if (near == j).any():
                centre[j] = bag[near == j].mean(axis=0)
                centre[j] /= np.linalg.norm(centre[j]) + 1e-9
    for d, j in zip(docs, near):
        emit[:, j] += np.bincount(d, minlength=CLASSES)
    emit += 0.1 * emit.sum(axis=1, keepdims=True) / states + rng.random((1, states)) * 1e-3
    model = Model.from_counts(np.bincount(near, minlength=states).astype(float), np.eye(states) * 200 + 1, emit)
    for _ in range(START_ROUNDS):
        model = Model.from_counts(*expected_counts(model, docs))
    return model


@tidy
def _score(batches, model):
    for batch in batches:
        docs = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log10_likelihood(model.value, docs))], ["row", "hmm"])


def score_corpus(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    Texts whose id falls in fold 0 of ``modulus`` are held out of every count. Null and empty texts are
    the end token alone. A null id counts as held out. Repeated rows are trained on and scored each.
    With no training texts all counts are 0 and scores come from the smoothing alone. Other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", fold(F.col("doc_id"), modulus) == 0).select("doc_id", "held_out", "text")
    train = docs.filter(~F.col("held_out"))
    counts = cut(train.select("text").mapInArrow(_tally, "h long, shape int, c long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")))
    # at most KNOWN rows; ties in count go to the smaller hash, so a rerun picks the same words
    top = counts.filter(F.col("c") >= threshold(counts, "c", KNOWN)).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    by_shape = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    shape_n[by_shape["shape"]], shape_v[by_shape["shape"]] = by_shape["c"], by_shape["v"]
    np.subtract.at(shape_n, top["shape"].to_numpy()[:TOP], top["c"].to_numpy()[:TOP])
    np.subtract.at(shape_v, top["shape"].to_numpy()[:TOP], 1)
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    vocabulary = Vocabulary(h[order], top["c"].to_numpy()[order], order, shape_n, shape_v, ends, int(total["c"]) + ends, int(total["v"]) + (ends > 0))
    sent = spark.sparkContext.broadcast(vocabulary)
    kind = "doc_id long, held_out boolean, row long, n_tokens long, cls binary, base double, inside double, known long, rare array<long>, times array<long>"
    coded = cut(docs.mapInArrow(functools.partial(_encode, vocabulary=sent), kind))
    model = _trained(coded.filter(~F.col("held_out")), STATES)
    scored = coded.select("row", "cls").mapInArrow(functools.partial(_score, model=spark.sparkContext.broadcast(model)), "row long, hmm double")
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    found = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    found = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = coded.drop("cls", "rare", "times").join(scored, "row").join(found, "row", "left")
    more = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("hmm") + F.col("inside") + more).alias("score"),
    )


def _trained(train: DataFrame, states: int) -> Model:
    """Baum-Welch over all rows of ``train``, until a round gains less than ``GAIN`` a token, at most ``ROUNDS`` times."""
    spark = train.sparkSession
    picked = sorted(bounded_sample(train.select("doc_id", "cls"), "doc_id", START_DOCS).collect())  # by id, so any partitioning starts alike
    model = start_model([np.frombuffer(r["cls"], "<u2") for r in picked], states)
    names = [f"s{j}" for j in range(states)]
    last = -np.inf
    for _ in range(ROUNDS):
        rows = train.select("cls").mapInArrow(functools.partial(_expect, model=spark.sparkContext.broadcast(model)), "key int, " + ", ".join(f"{n} double" for n in names))
        got = rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        if not len(got):
            break
        value = np.zeros((CLASSES + states + 2, states))
        value[got["key"]] = got[names]
        model = Model.from_counts(value[-2], value[CLASSES:-2], value[:CLASSES])
        now = value[-1, 0] / value[:CLASSES].sum()  # of the model that went into this round
        if now - last < GAIN:
            break
        last = now
    return model


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
