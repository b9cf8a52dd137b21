"""Operator 8: toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult (a learned lexicon with weights), threat, target, negation, reported speech, other. Four small
transducers read a clause's classes; each has its own states and multiplies what an insult or threat weighs: a target before it raises
it, a negation shortly before it or reported speech in the clause lowers it, and a threat without a target counts little. They are
composed once into one transducer, and it scores each clause that holds an insult or threat, never a word alone. A document's clause scores (sum a
word, largest, number, share of clauses) go to a logistic model.

Learned from labelled documents: the lexicon (words and word beginnings whose rate in toxic documents is surely above that in
others) and the logistic model. At most TRAIN_DOCS labelled documents, chosen by a hash of doc_id, are used for it; equal texts
count once. All documents are scored, whole.

Defined results: null and empty texts have no clauses and get the model's base score; without labels of both kinds every score is 0;
a document with several labels counts as toxic if at least half of them say so; labels and documents without doc_id teach nothing;
repeated rows get equal results. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 20_000
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
MIN_DOCS = 5
MIN_WEIGHT = 1.0
CAP = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Function words of English, German, French and Spanish for the classes that are not learned.
WORDS = {
    THREAT: "kill hurt destroy beat shoot burn stab punish töten schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
    TARGET: "you your yours he him she her they them du dich dein ihr euch tu te toi vous ils elles tú ti vosotros ellos ellas".split(),
    NEGATION: "not no never neither nor isn't aren't don't nicht kein keine nie jamais aucun nunca ningún".split(),
    REPORT: "said says wrote writes claimed quoted reported sagte schrieb behauptete dit écrit déclaré dijo escribió declaró".split(),
}
THREAT_WEIGHT = 2.0


# ---- the grammar --------------------------------------------------------------------------------------------------------------


class Transducer:
    """States 0.. (0 starts a clause); step[state][class] = (next state, factor on what the class weighs)."""

    def __init__(self, step: list[list[tuple[int, float]]]):
        self.step = step

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read the clause, factors multiply; only states that can be reached are kept."""
        number, queue, out = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = []
            for c in range(6):
                (na, fa), (nb, fb) = self.step[a][c], other.step[b][c]
                if (na, nb) not in number:
                    number[na, nb] = len(number)
                    queue.append((na, nb))
                row.append((number[na, nb], fa * fb))
            out.append(row)
        return Transducer(out)


def _machine(states: int, move, factor) -> Transducer:
    return Transducer([[(move(s, c), factor(s, c)) for c in range(6)] for s in range(states)])


INSULTS = _machine(1, lambda s, c: 0, lambda s, c: 1.0)
TARGETS = _machine(2, lambda s, c: 1 if s or c == TARGET else 0, lambda s, c: 1.25 if s and c in (INSULT, THREAT) else 1.0)
THREATS = _machine(2, lambda s, c: 1 if s or c == TARGET else 0, lambda s, c: 0.3 if not s and c == THREAT else 1.0)
#: A negation reaches the next three words.
NEGATIONS = _machine(4, lambda s, c: 3 if c == NEGATION else max(0, s - 1), lambda s, c: 0.5 if s and c in (INSULT, THREAT) else 1.0)
REPORTS = _machine(2, lambda s, c: 1 if s or c == REPORT else 0, lambda s, c: 0.6 if s and c in (INSULT, THREAT) else 1.0)
GRAMMAR = INSULTS @ TARGETS @ THREATS @ NEGATIONS @ REPORTS


def clause_score(classes: list[int], weights: list[float]) -> float:
    state, total = 0, 0.0
    for c, w in zip(classes, weights):
        state, factor = GRAMMAR.step[state][c]
        total += w * factor
    return total


# ---- reading ------------------------------------------------------------------------------------------------------------------


def normal(chunk: str) -> str:
    return re.sub(r"[^\w']+|_", "", chunk.lower()).strip("'")


class Lexicon(dict):
    """White-space separated chunk -> (class, weight, ends a clause) as a number in self.kinds; bounded."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        self.weights, self.most = weights, most
        self.kinds: list[tuple[int, float, bool]] = []
        self._number: dict[tuple, int] = {}
        self._fixed = {w: c for c, words in WORDS.items() for w in words}
        self.kind(OTHER, 0.0, False)

    def __reduce__(self):
        return Lexicon, (self.weights, self.most)

    def kind(self, c: int, w: float, stop: bool) -> int:
        key = (c, w, stop)
        if key not in self._number:
            self._number[key] = len(self.kinds)
            self.kinds.append(key)
        return self._number[key]

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max([get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in BEGINNINGS if len(word) >= n)])

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word, stop = normal(chunk), chunk[-1] in ".,;:!?…"
        w = self.weight(word)
        if w > 0:
            out = self.kind(INSULT, round(w, 3), stop)
        else:
            c = self._fixed.get(word, OTHER)
            out = self.kind(c, THREAT_WEIGHT if c == THREAT else 0.0, stop)
        self[chunk] = out
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Sum of clause scores per 100 words (20 more words, for very short texts), largest, logarithm of 1 + matched clauses, their share of all clauses."""
        chunks = (text or "").replace("\n", " ; ").split()
        numbers = list(map(self.__getitem__, chunks))
        kinds = self.kinds
        found = set(numbers)
        if not any(kinds[k][0] in (INSULT, THREAT) for k in found):
            return 0.0, 0.0, 0.0, 0.0
        n = np.array(numbers)
        stops = np.array([k[2] for k in kinds])[n]
        marks = np.array([k[0] in (INSULT, THREAT) for k in kinds])[n]
        clause = np.concatenate([[0], np.cumsum(stops[:-1])])
        scores = []
        for c in np.unique(clause[marks]):
            lo, hi = np.searchsorted(clause, [c, c + 1])
            own = [kinds[k] for k in numbers[lo:hi]]
            scores.append(clause_score([k[0] for k in own], [k[1] for k in own]))
        total = sum(scores)
        return 100 * total / (len(numbers) + 20), max(scores), float(np.log1p(len(scores))), len(scores) / (int(clause[-1]) + 1)


def keys_of(text: str | None) -> dict[str, int]:
    """Words and word beginnings (with *) of a text, with counts of at most CAP."""
    out: dict[str, int] = {}
    for chunk in set((text or "").split()):
        word = normal(chunk)
        for k in {word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)} if word else ():
            out[k] = out.get(k, 0) + 1
    return {k: min(n, CAP) for k, n in out.items()}


# ---- learning -----------------------------------------------------------------------------------------------------------------


class Model:
    """The lexicon and the logistic model over the features of a document."""

    def __init__(self, weights: dict[str, float], center=None, scale=None, coefficients=None):
        self.lexicon, self.center, self.scale, self.coefficients = Lexicon(weights), center, scale, coefficients

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(x))
        z = self.coefficients[0] + ((x - self.center) / self.scale) @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (the constant first) by iteratively reweighted least squares."""
    a = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _count_keys(only: set[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        docs: dict[str, int] = {}
        total = 0
        for pdf in batches:
            for text in pdf["text"]:
                own = keys_of(text)
                total += sum(c for k, c in own.items() if k[-1] != "*")
                for k, c in own.items():
                    if only is None or k in only:
                        n[k] = n.get(k, 0) + c
                        docs[k] = docs.get(k, 0) + 1
        n[""], docs[""] = total, MIN_DOCS
        yield pd.DataFrame({"key": list(n), "n": list(n.values()), "docs": list(docs.values())})

    return run


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): only the rows given here are learned from."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, train_docs / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about train_docs small rows
    train = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic").dropDuplicates(["text"])
    schema = "key string, n long, docs long"
    toxic = train.where("toxic = 1").select("text").mapInPandas(_count_keys(None), schema).groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = {r["key"]: r["n"] for r in toxic.where(F.col("docs") >= MIN_DOCS).collect()}
    total_one = one.pop("", 0)
    clean = train.where("toxic = 0").select("text").mapInPandas(_count_keys(set(one)), schema).groupBy("key").agg(F.sum("n").alias("n"))
    zero = {r["key"]: r["n"] for r in clean.collect()}
    total_zero = zero.pop("", 0)
    if not total_one or not total_zero:
        return Model({})
    weights = {}
    for k, c in one.items():
        a, b = c + 0.5, zero.get(k, 0) + 0.5
        w = np.log(a / (total_one + 1)) - np.log(b / (total_zero + 1)) - 1.96 * np.sqrt(1 / a + 1 / b)
        if w >= MIN_WEIGHT:
            weights[k] = float(w)
    lexicon = Lexicon(weights)
    rows = _with_features(train, lexicon).select("toxic", "_f.*").collect()  # about train_docs rows of numbers
    x, y = np.array([list(r)[1:] for r in rows], dtype=float), np.array([r["toxic"] for r in rows], dtype=float)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(weights, center, scale, logistic((x - center) / scale, y))


def _with_features(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("per_word double, largest double, matched double, share double")
    def features(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.features(t) for t in texts], columns=["per_word", "largest", "matched", "share"])

    return df.withColumn("_f", features("text"))


def score(df: DataFrame, model: Model) -> DataFrame:
    """df with score double and predicted int of column text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(own.scores(np.array([own.lexicon.features(t) for t in texts], dtype=float).reshape(len(texts), 4)))

    out = df.drop("score", "predicted").withColumn("score", scores("text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Learns from the labels outside the held-out fold, scores all documents."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    model = fit(docs.select("doc_id", "text"), labels.where(fold != held).select("doc_id", "toxic"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", "predicted")
