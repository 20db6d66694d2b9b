"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into symbols: insult, threat, target (a person spoken to or of), negation, report
(speech that is quoted or told). Small sequential transducers rewrite the symbol stream one after the
other - an insult after a negation becomes a negated one, one inside reported speech a reported one, a
threat needs a target and counts only where it is not told, a target marks the clause as aimed at someone - and are composed into one machine
that pays out the weight of each clause where it ends. The strongest clause, the sum of the clauses
and their number give the score by a logistic model.

Insults beyond the built-in list are learned: words that labelled toxic texts hold and clean ones
do not, far beyond chance. Lexicon and logistic model are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.sampling import ROWS_PER_CLASS, class_sample, label_counts, one_text
from tallyframe.session import written

# Words in English, German, French and Spanish.
INSULTS = "idiot moron stupid trash scum loser worthless pathetic disgusting clown imbecile dumb vermin idioten dummkopf abschaum imbécile ordure crétin basura imbécil".split()
THREATS = "kill hurt destroy punch shoot burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yourself he she they them du dich ihr euch tu toi vous ils tú te vosotros usted ellos".split()
NEGATIONS = "not no never without nicht kein keine nie ne jamais sin nunca jamás".split()
REPORTS = "said says called wrote quoted claims sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "insult threat target negation report other end".split()
NEGATED, REPORTED, HIT = "negated reported hit".split()
# Endings of insults (plurals) and threats (forms of the verb).
INSULT_ENDINGS, THREAT_ENDINGS = ("s", "es", "n", "en"), ("s", "ed", "ing")
# Weights of the symbols in a clause, and what a target in the same clause adds.
WEIGHTS = {INSULT: 1.0, NEGATED: 0.4, REPORTED: 0.6, HIT: 1.0}
AIMED = 0.3

# Words that are learned at most, those that stand out most; a parameter of ``fit``.
MAX_LEARNED = 5000
# A learned word occurs in toxic texts this unlikely often, if it had nothing to do with them.
CHANCE = 1e-6
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
# A negation that is written together with its verb.
_CONTRACTED = re.compile(r"n['\u2019]t\b")
_WORD_SQL = r"[^\p{L}]+"


@dataclass
class Transducer:
    """Sequential transducer: step(state, symbol) gives (state, symbol out, weight)."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (state, symbol, 0.0)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """One machine that feeds what ``first`` writes to ``second``; weights add."""
    made, todo = Transducer((first.start, second.start)), [(first.start, second.start)]
    seen = set(todo)
    while todo:
        a, b = state = todo.pop()
        for symbol in symbols:
            a2, middle, w1 = first.step(a, symbol)
            b2, out, w2 = second.step(b, middle)
            made.arcs[state, symbol] = ((a2, b2), out, w1 + w2)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return made


def clause_grammar() -> Transducer:
    """Negation, report, threat and target rules in one machine; its arcs carry the weights."""
    negation = Transducer(0)
    for left in range(4):
        negation.arcs[left, NEGATION] = (3, OTHER, 0.0)
        negation.arcs[left, END] = (0, END, 0.0)
        for symbol in (TARGET, REPORT, OTHER, THREAT):
            out = OTHER if symbol == THREAT and left else symbol
            negation.arcs[left, symbol] = (max(0, left - 1), out, 0.0)
        negation.arcs[left, INSULT] = (max(0, left - 1), NEGATED if left else INSULT, 0.0)
    report = Transducer("told")
    for state in ("told", "reported"):
        report.arcs[state, REPORT] = ("reported", OTHER, 0.0)
        report.arcs[state, END] = ("told", END, 0.0)
    report.arcs["reported", INSULT] = ("reported", REPORTED, 0.0)
    report.arcs["reported", THREAT] = ("reported", OTHER, 0.0)
    threat = Transducer("calm")
    threat.arcs["calm", THREAT] = ("armed", OTHER, 0.0)
    threat.arcs["armed", TARGET] = ("calm", HIT, 0.0)
    threat.arcs["armed", THREAT] = ("armed", OTHER, 0.0)
    threat.arcs["armed", END] = ("calm", END, 0.0)
    weigh = Transducer(("", False))
    for found in (False, True):
        for aimed in ("", TARGET):
            state = (aimed, found)
            weigh.arcs[state, TARGET] = ((TARGET, found), OTHER, AIMED if found and not aimed else 0.0)
            for symbol, weight in WEIGHTS.items():
                known = aimed or (TARGET if symbol == HIT else "")
                weigh.arcs[state, symbol] = ((known, True), symbol, weight + (AIMED if aimed and not found else 0.0))
            weigh.arcs[state, END] = (("", False), END, 0.0)
    symbols = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END]
    machine = compose(compose(negation, report, symbols), threat, symbols)
    return compose(machine, weigh, symbols)


@dataclass
class ToxicityModel:
    lexicon: dict[str, tuple[str, float]]  # word -> symbol, weight of the word
    beta: np.ndarray
    grammar: Transducer = field(default_factory=clause_grammar)

    def __post_init__(self):
        self.triggers = {w for w, (symbol, _) in self.lexicon.items() if symbol in (INSULT, THREAT)}

    def clauses(self, text: str | None) -> list[tuple[float, str]]:
        """(weight, text) of the matched clauses, in order, from the whole text."""
        lowered = _CONTRACTED.sub(" not", (text or "").lower())
        tokens = _TOKEN.findall(lowered)
        if self.triggers.isdisjoint(tokens):
            return []
        found, state, total, begin = [], self.grammar.start, 0.0, 0
        tokens.append("\n")
        for i, token in enumerate(tokens):
            symbol, scale = self.lexicon.get(token) or ((OTHER, 1.0) if token[0].isalpha() else (END, 1.0))
            state, out, weight = self.grammar.step(state, symbol)
            total += weight * scale
            if out == END:
                if total > 0:
                    found.append((total, " ".join(tokens[begin:i])))
                total, begin = 0.0, i + 1
        return found

    def features(self, text: str | None) -> np.ndarray:
        return self._features([w for w, _ in self.clauses(text)])

    @staticmethod
    def _features(weights: list[float]) -> np.ndarray:
        return np.array([1.0, max(weights, default=0.0), np.log1p(sum(weights)), np.log1p(len(weights))])

    def scored_clauses(self, text: str | None) -> tuple[float, list[str]]:
        """Score of a text and its matched clauses."""
        found = self.clauses(text)
        score = float(1 / (1 + np.exp(-np.clip(self._features([w for w, _ in found]) @ self.beta, -30, 30))))
        return score, [clause for _, clause in found]

    def score(self, text: str | None) -> float:
        return self.scored_clauses(text)[0]


# Without labelled rows of both classes: a clause of weight 1 is as likely toxic as not.
UNTRAINED = np.array([-3.0, 3.0, 0.0, 0.0])


def base_lexicon() -> dict[str, tuple[str, float]]:
    endings = {INSULT: INSULT_ENDINGS, THREAT: THREAT_ENDINGS}
    lists = {INSULT: INSULTS, THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
    inflected = {word + ending: (symbol, 1.0) for symbol, ends in endings.items() for word in lists[symbol] for ending in ends}
    return inflected | {word: (symbol, 1.0) for symbol, words in lists.items() for word in words}


def learned_insults(sampled: DataFrame, rows: dict[int, int], max_learned: int = MAX_LEARNED) -> dict[str, tuple[str, float]]:
    """Words that stand out in toxic texts: at most ``max_learned``, each with a weight up to 1.

    ``sampled``: doc_id, text, label; ``rows``: its rows by label.
    """
    if not rows.get(1) or not rows.get(0):
        return {}
    words = sampled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), _WORD_SQL))).alias("word")).where("word != ''")
    counts = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    rate = rows[1] / (rows[0] + rows[1])
    # Chernoff's bound on the chance of so many toxic texts among those that hold the word.
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    clean_term = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = F.col("toxic") * F.log(share / rate) + clean_term
    odds = F.log((F.col("toxic") + 0.5) / rows[1]) - F.log((F.col("clean") + 0.5) / rows[0])
    top = (
        counts.where((F.col("toxic") > 0) & (share > rate))
        .select("word", surprise.alias("surprise"), odds.alias("odds"), n.alias("n"))
        .where((F.col("surprise") > -np.log(CHANCE)) & (F.col("odds") > 2.0))
        .orderBy(F.desc("surprise"), "word")
        .limit(max_learned)
    )
    return {r["word"]: (INSULT, float(min(1.0, r["odds"] / 6))) for r in top.collect()}


def fit(
    docs: DataFrame, labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_learned: int = MAX_LEARNED
) -> ToxicityModel:
    """Lexicon and logistic model from docs (doc_id, text) with labelled (doc_id, label); 1 is toxic.

    Of an id with several texts the one of the smallest hash is learned.
    """
    sample = class_sample(labelled, rows_per_class)
    ids = [(r["doc_id"], r["label"]) for r in sample.collect()]  # at most two times rows_per_class
    session = docs.sparkSession
    known = F.broadcast(session.createDataFrame(ids, "doc_id long, label int"))
    sampled = written(one_text(docs.select("doc_id", "text").join(known, "doc_id")), "toxicity_sample")
    rows = {c: sum(label == c for _, label in ids) for c in (0, 1)}
    lexicon = learned_insults(sampled, rows, max_learned) | base_lexicon()
    model = ToxicityModel(lexicon, UNTRAINED)
    if not rows[0] or not rows[1]:
        return model

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([model.features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    found = sampled.select("doc_id", "label", features("text").alias("x")).toPandas().sort_values("doc_id")
    if found["label"].nunique() < 2:
        return model
    return ToxicityModel(lexicon, logistic(np.stack(found["x"].to_numpy()), found["label"].to_numpy(), label_counts(labelled)))


def logistic(x: np.ndarray, y: np.ndarray, shares: dict[int, int]) -> np.ndarray:
    """Penalised logistic regression; the classes count as often as ``shares`` has them."""
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    weight = weight * len(y) / weight.sum()
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def score(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """``columns`` of docs with score, predicted and clauses, from the whole ``text`` alone.

    ``clauses`` lists the matched clauses. A null or empty text has none and gets the score of the
    bias. Other columns do not matter; repeated rows get equal scores.
    """

    @F.arrow_udf("score double, clauses array<string>")
    def scored(texts: pa.Array) -> pa.Array:
        found = [model.scored_clauses(t.as_py()) for t in texts]
        scores, clauses = pa.array([s for s, _ in found], pa.float64()), pa.array([c for _, c in found], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([scores, clauses], ["score", "clauses"])

    rows = docs.select(*columns, scored("text").alias("__scored"))
    return rows.select(*columns, "__scored.score", (F.col("__scored.score") >= 0.5).cast("int").alias("predicted"), "__scored.clauses")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; a null text is clean."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) < 0.5 for t in texts], pa.bool_())

    return docs.where(clean("text"))
