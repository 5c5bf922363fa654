"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat verb, intensifier, modal, target, negation,
reporting, other. Five weighted transducers are composed into one machine, whose arcs'
weights multiply: insult strengthens an insult after an intensifier and weakens those that
follow another; threat tells a threat verb after a modal or future from a bare one, which
weighs half; negation turns an insult or threat shortly after a negation into a
negated one; reported speech turns what follows a reporting verb in its clause into
a reported one; target turns what comes after an address into an aimed one, and in a
second run, from the clause's end, what comes before one. The last emits a class per
match. A match counts with the weight of its word times that of its arcs, and the clause totals
per class, squashed, are the features of a small logistic model.

Insult words and stems and their weights are learned from labelled rows: the log
odds of a word or of a stem of 4 to 6 characters between toxic and other rows.
Training reads at most MAX_ROWS labelled rows, chosen by a hash of the id; this
bounds the lexicon, the broadcast of the sample, and what comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairn.llm.shared import documents, in_slices, save

MAX_ROWS = 50_000
MIN_ROWS_WITH = 4
MIN_WEIGHT = 3.0
STEMS = (4, 5, 6)
HEAD = 3
THREAT_WEIGHT = 2.0

# Closed classes of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself du dich dir dein deine ihr euch euer tu toi tes vous votre vos tú ti te usted ustedes vosotros".split()
NEGATIONS = "not no never none don't isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTING = "said says say wrote writes told tells claimed quoted reported according sagte sagt schrieb berichtete dit disait écrit selon dijo dice escribió según".split()
THREATS = "kill hurt beat stab shoot destroy murder töten verletzen schlagen umbringen tuer frapper blesser détruire matar golpear herir destruir".split()
MODALS = "will would shall should must could can going gonna let's i'll we'll they'll werde wird werden wirst sollte muss vais va allons vont voy va vamos van".split()
INTENSIFIERS = "such so very really total totally complete completely utter utterly absolute absolutely damn so ein eine völlig total absolut vraiment complètement espèce sale muy tan totalmente maldito maldita".split()

CLAUSE_END = re.compile(r"[.!?;:\n]")
TOKEN = re.compile(r"\w+(?:'\w+)?|[^\w\s]+|\n")

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSE, MODAL, OTHER = "IVYNRXMO"
WORDS = "IVYNRXMO"
CLASSES = ("plain", "aimed", "negated", "reported", "threat", "aimed threat")

Arc = tuple[str, str, float]


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, input) to (next state, output, weight); an input without an arc is passed on in the same state, with weight 1."""

    start: str
    arcs: dict[tuple[str, str], Arc]

    def step(self, state: str, symbol: str) -> Arc:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for symbol in symbols:
            state, emitted, weight = self.step(state, symbol)
            out.append((emitted, weight))
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` emits to ``second``: states are pairs that can be reached, weights are multiplied."""
    start = f"{first.start}|{second.start}"
    arcs, ahead, seen = {}, [(first.start, second.start)], {start}
    while ahead:
        a, b = ahead.pop()
        for symbol in WORDS:
            a2, middle, x = first.step(a, symbol)
            b2, out, y = second.step(b, middle)
            arcs[f"{a}|{b}", symbol] = (pair := f"{a2}|{b2}", out, x * y)
            if pair not in seen:
                seen.add(pair)
                ahead.append((a2, b2))
    return Transducer(start, arcs)


STRONG, AGAIN, BARE = 1.5, 0.5, 0.5


def _insult() -> Transducer:
    """An insult right after an intensifier weighs more, one right after another insult less."""
    arcs: dict[tuple[str, str], Arc] = {(s, INTENSE): ("strong", INTENSE, 1.0) for s in ("none", "strong", "insult")}
    arcs |= {("none", INSULT): ("insult", INSULT, 1.0), ("strong", INSULT): ("insult", INSULT, STRONG), ("insult", INSULT): ("insult", INSULT, AGAIN)}
    arcs |= {(s, w): ("none", w, 1.0) for s in ("strong", "insult") for w in WORDS if w not in (INSULT, INTENSE)}
    return Transducer("none", arcs)


def _threat(window: int = 3) -> Transducer:
    """A threat verb within some words after a modal or future has its whole weight, a bare one half of it."""
    arcs: dict[tuple[str, str], Arc] = {("0", THREAT): ("0", THREAT, BARE), ("0", MODAL): (str(window), MODAL, 1.0)}
    for k in range(1, window + 1):
        arcs |= {(str(k), w): (str(k - 1), w, 1.0) for w in WORDS if w not in (THREAT, MODAL)}
        arcs |= {(str(k), THREAT): ("0", THREAT, 1.0), (str(k), MODAL): (str(window), MODAL, 1.0)}
    return Transducer("0", arcs)


def _negation(window: int = 2) -> Transducer:
    """i and v: negated insult and threat."""
    arcs: dict[tuple[str, str], Arc] = {("0", NEGATION): (str(window), NEGATION, 1.0)}
    for k in range(1, window + 1):
        left = str(k - 1)
        arcs |= {(str(k), s): (left, s, 1.0) for s in (OTHER, TARGET, REPORT, INTENSE, MODAL)}
        arcs |= {(str(k), INSULT): (left, "i", 1.0), (str(k), THREAT): (left, "v", 1.0), (str(k), NEGATION): (str(window), NEGATION, 1.0)}
    return Transducer("0", arcs)


def _reported() -> Transducer:
    """q: an insult or threat that is only reported."""
    return Transducer("own", {("own", REPORT): ("other", REPORT, 1.0), ("other", INSULT): ("other", "q", 1.0), ("other", THREAT): ("other", "q", 1.0)})


def _aimed() -> Transducer:
    """a and w: insult and threat after an address in the same clause."""
    return Transducer("any", {("any", TARGET): ("aimed", TARGET, 1.0), ("aimed", INSULT): ("aimed", "a", 1.0), ("aimed", THREAT): ("aimed", "w", 1.0)})


GRAMMAR = compose(compose(compose(compose(_insult(), _threat()), _negation()), _reported()), _aimed())
AIM = _aimed()
CLASS_OF = {INSULT: "plain", "a": "aimed", "i": "negated", "v": "negated", "q": "reported", THREAT: "threat", "w": "aimed threat"}


def matched(symbols: list[str]) -> list[tuple[str | None, float]]:
    """For each of a clause's symbols its class, if it matches, and its arcs' weight. The second run of the aim goes from the clause's end."""
    first = GRAMMAR.run(symbols)
    back = AIM.run([emitted for emitted, _ in reversed(first)])[::-1]
    return [(CLASS_OF.get(emitted), weight) for (emitted, _), (_, weight) in zip(back, first, strict=True)]


def stems(word: str) -> set[str]:
    """A word's features: itself, and its stems with a mark at their end."""
    return {word} | {word[:n] + "*" for n in STEMS if len(word) > n}


@dataclass
class Model:
    """insults: weights of words and stems; coefficients: of 1, the class features and the strongest clause."""

    insults: dict[str, float]
    coefficients: list[float]
    closed: dict[str, str] = field(default_factory=lambda: {w: s for s, ws in ((INTENSE, INTENSIFIERS), (MODAL, MODALS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS)) for w in ws})

    def heads(self) -> frozenset[str]:
        return frozenset(w.rstrip("*")[:HEAD] for w in (*self.insults, *THREATS))

    def weight(self, word: str) -> float:
        return max((self.insults[s] for s in stems(word) if s in self.insults), default=0.0)

    def features(self, text: str, heads: frozenset[str]) -> list[float]:
        """Per class the squashed total of its matches, and the strongest clause."""
        tokens = TOKEN.findall(text.lower())
        totals, strongest, done = dict.fromkeys(CLASSES, 0.0), 0.0, -1
        for k in [k for k, t in enumerate(tokens) if t[:HEAD] in heads]:
            if k <= done or not (self.closed.get(tokens[k]) == THREAT or self.weight(tokens[k])):
                continue
            lo = hi = k
            while lo > done + 1 and not CLAUSE_END.search(tokens[lo - 1]):
                lo -= 1
            while hi + 1 < len(tokens) and not CLAUSE_END.search(tokens[hi + 1]):
                hi += 1
            done, clause = hi, [t for t in tokens[lo : hi + 1] if t[0].isalnum() or t[0] == "_"]
            weights = [self.weight(t) if t[:HEAD] in heads else 0.0 for t in clause]
            symbols = [INSULT if w else self.closed.get(t, OTHER) for t, w in zip(clause, weights, strict=True)]
            score = 0.0
            for (kind, factor), w in zip(matched(symbols), weights, strict=True):
                if kind:
                    totals[kind] += factor * (w or THREAT_WEIGHT)
                    score += factor * (w or THREAT_WEIGHT)
            strongest = max(strongest, score)
        return [math.log1p(x) for x in (*totals.values(), strongest)]

    def score(self, features: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_col: Column) -> Column:
    """The fold that no training row comes from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def evidence(k_toxic: int, k_other: int, n_toxic: int, n_other: int) -> float:
    """The log-likelihood ratio of the two shares of rows that have a feature, against one share for both."""
    share = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)
    together = (k_toxic + k_other) / (n_toxic + n_other)
    apart = share(k_toxic, n_toxic, k_toxic / n_toxic) + share(k_other, n_other, k_other / n_other)
    return 2 * (apart - share(k_toxic, n_toxic, together) - share(k_other, n_other, together))


def _word_rows(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Per feature, the rows that have it; of all features, or of some."""
    for batch in in_slices(batches):
        seen: Counter[str] = Counter()
        for text in batch["text"].to_pylist():
            words = {t for t in TOKEN.findall((text or "").lower()) if len(t) >= HEAD and t[0].isalpha()}
            found = set().union(*map(stems, words)) if words else set()
            seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _feature_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    heads = model.heads()
    for batch in in_slices(batches):
        rows = [model.features(text or "", heads) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> list[float]:
    """Newton's method with a small ridge; columns: 1, then the features."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), gradient)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows outside the held-out fold, at most about ``max_rows`` of them.

    Labels without an id, without a mark or with another mark than 0 and 1 are
    not used. Without rows of both kinds every score is 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    parts = 1_000_000
    share = min(parts, max_rows * parts // max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("l_id"), F.lit(parts)) < share)
    # The sample's size is bounded by max_rows, so its ids are broadcast. Copies count once, or their chance words would look like insults.
    table = save(docs.select(F.col("doc_id").cast("long").alias("l_id"), "text").join(F.broadcast(sample), "l_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    rows = table.df
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, [-60.0] + [0.0] * (len(CLASSES) + 1))

    def count(toxic: int, only: frozenset[str] | None) -> DataFrame:
        some = rows.where(F.col("toxic") == toxic).select("text").mapInArrow(partial(_word_rows, only=only), "feature string, n long")
        return some.groupBy("feature").agg(F.sum("n").alias("n"))

    in_toxic = {r.feature: r.n for r in count(1, None).where(F.col("n") >= MIN_ROWS_WITH).collect()}
    in_other = {r.feature: r.n for r in count(0, frozenset(in_toxic)).collect()}
    odds = {f: math.log((k + 0.5) / (n[1] + 1)) - math.log((in_other.get(f, 0) + 1) / (n[0] + 2)) for f, k in in_toxic.items()}
    least = 2 * math.log(max(2, len(odds))) + 2  # so much evidence that less than one of all features has it by chance
    sure = [f for f in odds if odds[f] >= MIN_WEIGHT and evidence(in_toxic[f], in_other.get(f, 0), n[1], n[0]) >= least]
    model = Model({f: odds[f] for f in sorted(sure)}, [])  # all of them, as many as the sample's rows give evidence for
    scored = rows.mapInArrow(partial(_feature_rows, model=model), "toxic int, x array<double>").toPandas()
    model.coefficients = fit_logistic(np.array(scored["x"].tolist()), scored["toxic"].to_numpy(float))
    table.drop()
    return model


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    heads = model.heads()
    for batch in in_slices(batches):
        scores = [model.score(model.features(text or "", heads)) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without any match. Texts of any
    length are read whole. Rows are independent, an empty table gives an empty
    result, and columns but the id and the text are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).alias("text"))
    scored = base.mapInArrow(partial(_score_rows, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _append_score(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, name: str) -> Iterator[pa.RecordBatch]:
    heads = model.heads()
    for batch in in_slices(batches, text_at):
        scores = [model.score(model.features(text or "", heads)) for text in batch.column(text_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``; null and empty texts stay if a text without any match does."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    scored = docs.mapInArrow(partial(_append_score, model=model, text_at=docs.columns.index(text_col), name=name), schema)
    return scored.where(F.col(name) < threshold).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
