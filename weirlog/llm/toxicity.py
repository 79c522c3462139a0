"""Toxicity by a weighted finite-state grammar: composed transducers score matched clauses, not isolated words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shingles import mix

#: At most this many labelled rows of each class are learnt from, by the order of a hash of their ids.
SAMPLE = 2_000
#: Only texts of at most so many characters are learnt from; every text is scored whole.
BODY = 50_000
THRESHOLD = 0.3
#: A word is an insult if enough unrelated toxic texts of the sample hold it and its log-odds, less SURE standard errors, reach this.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, SURE = 3, 0.005, 1.5, 1.64
#: Texts whose word sets agree in one of so many groups of so many minima count as related; strict, as relation is passed on.
RELATED_BANDS, RELATED_ROWS = 4, 6
#: Word beginnings of these lengths are weighed like words, for forms that the sample does not hold.
STEMS = (5, 6, 7)
#: Words of the closed classes, in English, German, French and Spanish.
TARGETS = "you your u ya he she they them these those people everyone du dich dir ihr euch sie ihm leute tu te toi vous ils elles gens vosotros ustedes usted ellos ellas ti gente".split()
THREATS = "kill hurt destroy murder burn hang shoot stab beat crush strangle töten umbringen schlagen verbrennen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split()
NEGATIONS = "not no never none nor neither cannot nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote writes called quoted quote claimed reported according sagte sagt schrieb behauptete dit écrit déclaré dijo dice escribió".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")
FEATURES = ("plain", "targeted", "negated", "reported", "threat", "clauses", "strongest", "density")


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs (state, input) -> (state, output); an input without an arc takes its state's default move and passes unchanged."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    default: dict[int, int]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that feeds first's output into second, over the states reachable from both starts."""
    number = {(0, 0): 0}
    todo, arcs, default = [(0, 0)], {}, {}

    def at(pair: tuple[int, int]) -> int:
        if pair not in number:
            number[pair] = len(number)
            todo.append(pair)
        return number[pair]

    symbols = list(alphabet)
    while todo:
        a, b = todo.pop()
        here = number[(a, b)]
        for s in symbols:
            a2, mid = first.step(a, s)
            b2, out = second.step(b, mid)
            arcs[(here, s)] = (at((a2, b2)), out)
    return Transducer(arcs, default)


def _window(trigger: str, reach: int, marks: dict[str, str]) -> Transducer:
    """After trigger, each of the next `reach` symbols that marks names is rewritten."""
    arcs = {}
    for state in range(reach + 1):
        arcs[(state, trigger)] = (reach, trigger)
        for s, out in marks.items():
            arcs[(state, s)] = (max(state - 1, 0), out if state else s)
    return Transducer(arcs, {state: max(state - 1, 0) for state in range(reach + 1)})


def grammar() -> Transducer:
    """Insults I and threats T become negated (In, Tn), reported (Ir, Tr) or targeted (Iy, Ty), in this order of precedence."""
    negation = _window("N", 3, {"I": "In", "T": "Tn"})
    report = Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "Ir"), (1, "T"): (1, "Tr")}, {0: 0, 1: 1})
    target = _window("Y", 4, {"I": "Iy", "T": "Ty"})
    alphabet = ("I", "T", "Y", "N", "R", "o")
    return compose(compose(negation, report, alphabet), target, alphabet)


#: Output symbol -> feature; a negated or reported threat counts with the negated or reported insults.
ROLES = {"I": "plain", "Iy": "targeted", "In": "negated", "Ir": "reported", "Ty": "threat", "Tn": "negated", "Tr": "reported"}


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...]
    bias: float


class Lexicon:
    """Word -> (input symbol, weight); an insult's weight is its own or, for an unknown form, its longest known stem's."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float]) -> None:
        self.words = {w: (s, 1.0) for s, words in (("Y", TARGETS), ("T", THREATS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
        self.words |= {w: ("I", v) for w, v in insults.items()}
        self.stems = stems
        self.heads = frozenset(s[: STEMS[0]] for s in stems)
        self.triggers = frozenset(insults) | frozenset(THREATS)

    def look(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found is None and word[: STEMS[0]] in self.heads:
            stem = next((word[:n] for n in reversed(STEMS) if word[:n] in self.stems), None)
            found = ("I", self.stems[stem]) if stem else None
        return found or ("o", 0.0)

    def triggered(self, words: list[str]) -> bool:
        if not self.triggers.isdisjoint(words):
            return True
        n, heads = STEMS[0], self.heads
        return bool(heads) and any(w[:n] in heads for w in words)


def clauses_of(low: str, lexicon: Lexicon) -> Iterator[str]:
    """Clauses of a lower-cased text. A colon ends one, unless a reporting word stands before it: what it reports comes after."""
    for part in _CLAUSE.split(low):
        if ":" not in part:
            yield part
            continue
        held = ""
        for piece in part.split(":"):
            held = f"{held} {piece}"
            if not any(lexicon.look(w)[0] == "R" for w in _WORD.findall(held)):
                yield held
                held = ""
        if held:
            yield held


def features(text: str, lexicon: Lexicon, machine: Transducer) -> np.ndarray | None:
    """Feature values of a text, or None if no clause matches."""
    low = text.lower()
    words = _WORD.findall(low)
    if not lexicon.triggered(words):
        return None
    sums: dict[str, float] = defaultdict(float)
    clauses, top = 0, 0.0
    for clause in clauses_of(low, lexicon):
        state, hit = 0, 0.0
        for w in _WORD.findall(clause):
            symbol, weight = lexicon.look(w)
            state, out = machine.step(state, symbol)
            role = ROLES.get(out)
            if role:
                sums[role] += weight
                hit = max(hit, weight)
        clauses += hit > 0
        top = max(top, hit)
    if not clauses:
        return None
    total = sum(sums.values())
    x = [math.log1p(sums[r]) for r in ("plain", "targeted", "negated", "reported", "threat")]
    return np.array([*x, math.log1p(clauses), top, math.log1p(100 * total / len(words))])


def score(x: np.ndarray | None, model: Model) -> float:
    z = model.bias + (float(np.dot(x, model.weights)) if x is not None else 0.0)
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _unrelated(texts: list[str]) -> list[int]:
    """A group number for each text; texts that share much of their words get one number."""
    group, seen = list(range(len(texts))), {}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, t in enumerate(texts):
        words = _words(t)
        if not words:
            continue
        h = np.fromiter((hash_word(w) for w in words), dtype=np.uint64, count=len(words))
        for band in range(RELATED_BANDS):
            key = (band, *(int(mix(h ^ np.uint64(1 + band * RELATED_ROWS + k)).min()) for k in range(RELATED_ROWS)))
            a, b = root(seen.setdefault(key, i)), root(i)
            group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def _words(text: str) -> frozenset:
    return frozenset(_WORD.findall(text.lower()))


def _marks(texts: list[str], group: list[int], parts: Callable[[frozenset], Iterable[str]], only: frozenset | None = None) -> tuple[Counter, int]:
    """(in how many groups of texts a part occurs, number of groups); group by group, so that only counts are held."""
    count, n, order = Counter(), 0, sorted(range(len(texts)), key=lambda i: group[i])
    k = 0
    while k < len(order):
        found: set[str] = set()
        g = group[order[k]]
        while k < len(order) and group[order[k]] == g:
            found.update(parts(_words(texts[order[k]])))
            k += 1
        count.update(found if only is None else found & only)
        n += 1
    return count, max(n, 1)


def hash_word(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode()) | (zlib.adler32(w.encode()) << 32)


def learn(texts: list[str], toxic: list[int], prior: float) -> Model:
    """Insult weights by log-odds, then the grammar's feature weights by logistic regression; prior is the true share of toxic texts."""
    group = _unrelated(texts)
    side = {y: ([t for t, z in zip(texts, toxic, strict=True) if z == y], [g for g, z in zip(group, toxic, strict=True) if z == y]) for y in (0, 1)}

    def weigh(parts: Callable[[frozenset], Iterable[str]]) -> dict[str, float]:
        """Log-odds of the parts that mark toxic texts, counted once for each group of related texts."""
        bad, n1 = _marks(*side[1], parts)
        least = max(LEAST_TEXTS, LEAST_SHARE * n1)
        bad = {w: k for w, k in bad.items() if k >= least}
        good, n0 = _marks(*side[0], parts, frozenset(bad))
        odds = {w: math.log((k + 0.5) / (n1 + 1)) - math.log((good[w] + 0.5) / (n0 + 1)) for w, k in bad.items()}
        error = {w: math.sqrt(1 / (k + 0.5) + 1 / (good[w] + 0.5)) for w, k in bad.items()}
        return {w: round(v, 6) for w, v in odds.items() if v - SURE * error[w] >= LEAST_ODDS}

    insults = weigh(lambda words: words)
    stems = weigh(lambda words: (w[:k] for w in words if len(w) > STEMS[0] and w not in insults for k in STEMS if len(w) >= k))
    machine, lexicon = grammar(), Lexicon(insults, stems)
    x = [features(t, lexicon, machine) for t in texts]
    a = np.array([np.zeros(len(FEATURES)) if v is None else v for v in x]).reshape(len(texts), len(FEATURES))
    y = np.array(toxic, dtype=float)
    a1 = np.hstack([a, np.ones((len(a), 1))])
    w = np.zeros(a1.shape[1])
    ridge = np.diag([0.5] * len(FEATURES) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a1 @ w, -30, 30)))
        step = np.linalg.solve(a1.T @ (a1 * (p * (1 - p))[:, None]) + ridge, a1.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return Model(insults, stems, tuple(w[:-1].tolist()), float(w[-1] + shift))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, body: int = BODY) -> Model:
    """Learn from at most `sample` labelled, not held-out rows of each class; their number, and `body`, the most characters of each, bound the driver's share.

    A document with rows of both labels gives one example for each; rows that repeat a label count once.
    """
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    order = [F.xxhash64(F.lit(5), F.col("doc_id")), F.col("doc_id")]
    picked = lab.where("y = 1").orderBy(*order).limit(sample).unionByName(lab.where("y = 0").orderBy(*order).limit(sample))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.where(F.length("text") <= body).join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id, however often it comes
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in found.collect())
    total = sum(counts.values())
    if not rows or not counts.get(1):
        return Model({}, {}, (0.0,) * len(FEATURES), -4.0)
    return learn([r[2] for r in rows], [r[1] for r in rows], counts[1] / total)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    machine, lexicon = grammar(), Lexicon(model.insults, model.stems)
    clean = score(None, model)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        out = []
        for t in texts:
            x = features(t.as_py() or "", lexicon, machine)
            out.append(clean if x is None else score(x, model))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts match no clause and get the model's base score.

    Rows are scored where they are read, nothing is shuffled. Null and repeated ids are carried. Empty table: no rows.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    ship(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, lexicon = grammar(), Lexicon(model.insults, model.stems)
        clean = score(None, model) < threshold
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            x = (features(t.as_py() or "", lexicon, machine) for t in batch.column(at))
            yield batch.filter(pa.array([clean if v is None else score(v, model) < threshold for v in x], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
