"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, reported speech, clause end, other. Five small
transducers rewrite the stream one after the other, and are composed into one table of arcs:

* negation marks insults and threats that follow a negation within a few words;
* reported speech marks those that follow a reporting verb in their clause;
* target marks a clause end if the clause names someone;
* threat marks it if the clause also holds a threat that is neither negated nor reported;
* insult reads all these marks and gives the clause its class: targeted, plain, negated or reported.

Only clauses score: an insult needs another word in its clause, a threat needs a target, and isolated words
score nothing. A clause weighs as much as its heaviest insult. A document's score is a logistic
function of the sums by class.

Learned from labelled rows outside the held-out fold: which words and word stems are insults (with
weights, their log odds), and the classes' coefficients. At most ``sample`` labelled documents are used,
picked by a hash of their ids; near copies among them count once. Everything else covers all rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, cut, fold, small_batches, table, threshold
from .minhash import shingle_sets
from .words import mix, tidy

#: Words that a grammar of insults starts from, before labels add to them or take them away.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumb idiota imbécil estúpido basura asqueroso dummkopf trottel abschaum widerlich crétin abruti connard débile"
THREATS = "kill hurt destroy murder shoot stab töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours u he she they them him her du dich dein ihr euch sie tu toi vous ton votre te ti usted ustedes vosotros"
NEGATIONS = "not no never isn't aren't don't without nicht kein keine nie ne pas jamais nunca jamás ni"
REPORTS = "said says quoted wrote claimed reported alleged according sagte schrieb zitiert laut dit écrit selon dijo escribió según"
CLASSES = ("plain", "targeted", "negated", "reported", "threat")
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "stop")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+")
_SHORT, _STEM, _WHOLE = 4, 7, 24
SEED_WEIGHT = 4.0

#: A transducer: (state, symbol) to (next state, symbol). Every one starts in state None.
Rule = Callable[[object, str], tuple[object, str]]


def negation(reach: int = 3) -> Rule:
    def rule(left, symbol):
        if symbol == "stop":
            return None, symbol
        if symbol == "negation":
            return reach, "other"
        said = "not " + symbol if left and symbol in ("insult", "threat") else symbol
        return (left - 1 or None) if left else None, said

    return rule


def reported(state, symbol):
    if symbol == "stop":
        return None, symbol
    if symbol == "report":
        return True, "other"
    return state, "said " + symbol.removeprefix("not ") if state and symbol.endswith(("insult", "threat")) else symbol


def target(state, symbol):
    if symbol == "stop":
        return None, "stop you" if state else symbol
    return (True, "other") if symbol == "target" else (state, symbol)


def threat(state, symbol):
    if symbol.startswith("stop"):
        return None, symbol + " threat" if state and symbol == "stop you" else symbol
    return (True, "other") if symbol == "threat" else (state, "other" if symbol.endswith("threat") else symbol)


def insult(state, symbol):
    """State: the clause's strongest insult so far, and whether it has another word. Output: the clause's classes."""
    kind, word = state or ("", False)
    if symbol.startswith("stop"):
        found = {"insult": "targeted" if "you" in symbol else "plain", "not insult": "negated", "said insult": "reported"}.get(kind) if word else None
        return None, " ".join(c for c in (found, "threat" if symbol.endswith("threat") else None) if c)
    if symbol.endswith("insult"):
        order = ("", "said insult", "not insult", "insult")
        return (max(kind, symbol, key=order.index), word), ""
    return (kind, True), ""


def compose(*rules: Rule) -> tuple[list[list[int]], list[list[str]]]:
    """The cascade of ``rules`` as one transducer over ``SYMBOLS``: next state and output by state and symbol.

    A state is one state of each rule; those that can be reached from the start are numbered as they are met.
    """
    number: dict[tuple, int] = {(None,) * len(rules): 0}
    states = list(number)
    after: list[list[int]] = []
    out: list[list[str]] = []
    for state in states:  # grows as states are met
        after.append([])
        out.append([])
        for symbol in SYMBOLS:
            to = []
            for rule, own in zip(rules, state):
                own, symbol = rule(own, symbol)
                to.append(own)
            if tuple(to) not in number:
                number[tuple(to)] = len(states)
                states.append(tuple(to))
            after[-1].append(number[tuple(to)])
            out[-1].append(symbol)
    return after, out


class Grammar:
    """Symbols for words, and the composed machine that reads them."""

    def __init__(self, lexicon: dict[str, float]):
        """``lexicon``: weights of whole words, and of stems written with a final ``*``."""
        import ahocorasick

        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        named = (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS))
        self.symbol = {w: SYMBOLS.index(s) for s, names in named for w in names.split()}
        self.after, out = compose(negation(), reported, target, threat, insult)
        self.out = [[[c for c in said.split() if c in CLASSES] for said in row] for row in out]
        self.find = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS.split()]:
            self.find.add_word(w, w)
        self.find.make_automaton()

    def insult(self, word: str) -> float | None:
        if word in self.words:
            return self.words[word]
        for n in range(_SHORT, min(_STEM, len(word)) + 1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return None

    def features(self, text: str) -> tuple[float, ...]:
        """Summed weights of matched clauses by class. Texts in which no insult or threat occurs are not read word by word."""
        text = text.lower()
        total = dict.fromkeys(CLASSES, 0.0)
        if next(self.find.iter(text), None) is not None:
            other, insulting, stop = (SYMBOLS.index(s) for s in ("other", "insult", "stop"))
            state, heaviest = 0, 0.0
            for token in [*_TOKEN.findall(text), "."]:
                if token in ".!?;\n":
                    for said in self.out[state][stop]:
                        total[said] += SEED_WEIGHT if said == "threat" else heaviest
                    state, heaviest = 0, 0.0
                    continue
                symbol = self.symbol.get(token, other)
                if symbol == other and (weight := self.insult(token)) is not None:
                    symbol, heaviest = insulting, max(heaviest, weight)
                state = self.after[state][symbol]
        return tuple(total.values())


def _stems(text: str) -> set[str]:
    """The words of a text, and their stems (with ``*``)."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if _SHORT <= len(w) <= _WHOLE:
            out.add(w)
        out.update(w[:n] + "*" for n in range(_SHORT, min(_STEM, len(w) - 1) + 1))
    return out


@tidy
def _keyed(batches):
    """Adds a key that near copies mostly share and other texts don't: three minima of the shingle set as one."""
    for batch in batches:
        key = []
        for s in shingle_sets(batch.column("text"), 5):
            low = [mix(s, salt).min() if len(s) else np.uint64(0) for salt in (401, 402, 403)]
            key.append(int(np.bitwise_xor.reduce([mix(np.array([x]), i)[0] for i, x in enumerate(low)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("toxic"), pa.array(key, pa.int64())], ["doc_id", "text", "toxic", "key"])


@tidy
def _counted(batches, only):
    """Documents that hold each stem. ``only``: a broadcast set to keep to, or None for all."""
    n: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            found = _stems(text.as_py() or "")
            n.update(found if only is None else found & only.value)
    yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["stem", "n"])


def learn_lexicon(sample: DataFrame, most: int = 100_000, support: int = 4) -> dict[str, float]:
    """Insult words and stems of a bounded sample (text, toxic), with log odds as weights.

    A stem is taken if what it says about the label is worth more bits than the number of stems looked
    at could yield by chance, and at most one in fifty documents that hold it is clean. Of nested stems the
    shortest such stands for all, drawn out as long as it keeps 19 of 20 of its toxic documents.
    """
    sc = sample.sparkSession.sparkContext
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    seeds = dict.fromkeys(INSULTS.split(), SEED_WEIGHT)
    if not bad or not good:
        return seeds
    in_bad = cut(sample.filter("toxic = 1").mapInArrow(functools.partial(_counted, only=None), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")))
    looked = in_bad.count()
    top = in_bad.filter(F.col("n") >= max(support, threshold(in_bad, "n", most)))
    seen = {r["stem"]: r["n"] for r in top.collect()}
    seen |= {w: seen.get(w, 0) for w in seeds}
    only = sc.broadcast(set(seen))
    rows = sample.filter("toxic = 0").mapInArrow(functools.partial(_counted, only=only), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()
    clean = {r["stem"]: r["n"] for r in rows}
    base, out = bad / (bad + good), {}
    nested: dict[str, list[str]] = {}
    for w in seen:
        nested.setdefault(w.rstrip("*")[:-1], []).append(w)
    for w, a in sorted(seen.items(), key=lambda x: (len(x[0].rstrip("*")), x[0])):
        b = clean.get(w, 0)
        weight = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        if w in seeds:
            if a + b < 3 or weight > 1:
                out[w] = max(weight, 1.0) if a + b >= 3 else SEED_WEIGHT
            continue
        if a < 50 * b:
            continue
        worth = a * math.log(a / (a + b) / base) + (b * math.log(b / (a + b) / (1 - base)) if b else 0.0)
        root = w.rstrip("*")
        if worth >= math.log(looked + 1) + 3 and not any(root[:n] + "*" in out for n in range(_SHORT, len(root) + 1)):
            out[w] = weight
            while w.endswith("*"):
                longer = max((x for x in nested.get(root, ()) if x.endswith("*")), key=lambda x: (seen[x], x), default=None)
                if longer is None or seen[longer] < 0.95 * a:
                    break
                root = longer.rstrip("*")
                out[longer] = out.pop(w)
                w = longer
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients (intercept last) pulled towards ``prior``; Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.copy()
    pull = np.full(len(w), strength)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


_PRIOR = np.array([1.5, 2.0, 0.2, 0.4, 2.0, -2.0])


@functools.lru_cache(maxsize=4)
def _grammar(lexicon: tuple[tuple[str, float], ...]) -> Grammar:
    return Grammar(dict(lexicon))


@tidy
def _matched(batches, lexicon):
    grammar = _grammar(lexicon)
    for batch in batches:
        rows = [grammar.features(x.as_py() or "") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c, pa.float64()) for c in zip(*rows)]] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.float64())] * len(CLASSES)], ["toxic", *CLASSES])


@tidy
def _scored(batches, lexicon, weights):
    """Rows of (row, text) to (row, score); ``row`` is passed through as it is."""
    grammar = _grammar(lexicon)
    for batch in batches:
        x = np.log1p(np.array([grammar.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(CLASSES)))
        score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["row", "score"])


def score_rows(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` whole, as a struct, with its score."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = cut(bounded_sample(cut(known), "doc_id", sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    taught = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most ``sample`` rows
    taught = taught.mapInArrow(_keyed, "doc_id long, text string, toxic int, key long")
    taught = cut(taught.groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "toxic"))
    lexicon = tuple(sorted(learn_lexicon(taught).items()))
    kind = "toxic int, " + ", ".join(f"{c} double" for c in CLASSES)
    seen = np.array([tuple(r) for r in taught.mapInArrow(functools.partial(_matched, lexicon=lexicon), kind).collect()], float).reshape(-1, 1 + len(CLASSES))
    seen = seen[np.lexsort(seen.T)]  # so that sums don't depend on the order of the tasks
    weights = fit_logistic(np.log1p(seen[:, 1:]), seen[:, 0], _PRIOR) if len(seen) else _PRIOR
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    kind = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(functools.partial(_scored, lexicon=lexicon, weights=weights), kind)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; ``labels`` has (doc_id, toxic).

    Null and empty texts have the score of a text without matches. Rows with a null id are scored and
    count as held out. Repeated rows are each scored. A document labelled twice counts as toxic if any
    label says so; null labels teach nothing. With no labels, or one kind only, the starting lexicon and
    coefficients are used. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_rows(docs, labels, sample).select("row.doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
