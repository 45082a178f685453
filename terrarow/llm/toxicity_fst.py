r"""Toxicity by a weighted finite-state pattern grammar.

Six transducers are composed. The lexicon reads words: an insult (learned words and stems) may be read as INSULT, with
its learned weight, or merely as NAMED; threats, targets, negations and reported speech have fixed lists. The insult
transducer lets insults of a clause reinforce each other, the threat one turns a target behind a threat, and the
target one an insult behind a target, into a stronger match. The negation transducer admits only NAMED insults and no
threats behind a negation, the reported-speech one weakens what follows a verb of speech; both have a competing arc
that passes over the trigger at a cost, so that the tropical best path chooses for every clause which reading weighs
most. The lexicon is composed with the others as words are read. A clause is matched if its best path weighs more
than MATCH; a document's score is a logistic function of its clauses' matches and path weights, never of words apart
from their clauses.

Insults and weights are learned from labelled rows of the training fold only: crc32(doc_id as text) mod 4 is not 2.
At most MAX_TOXIC and MAX_CLEAN labelled documents (a documented bound, taken by a hash of the id) are used, with
weights that restore the label shares of all rows in the fold; the lexicon holds at most MAX_TERMS words and stems,
those that stand out most.

Edge cases: null and empty texts have no clause and get the base rate; equal rows get equal scores; texts of any length
are read whole, clause by clause; an empty table gives no rows; without labels
the grammar keeps only its fixed lists and the base rate is 0; extra columns are ignored; doc_id, lang and source
are never inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

MAX_TOXIC, MAX_CLEAN = 4000, 6000
MAX_TERMS = 4000
THRESHOLD = 0.3
STEMS = range(4, 8)

# Fixed word lists of the grammar.
THREATS = "kill hurt destroy beat smash crush burn stab shoot strangle töten umbringen schlagen vernichten tuer frapper détruire écraser matar golpear destruir aplastar".split()
TARGETS = "you your yours yourself u he she they him them his her their du dich dir dein deine ihr euch euer sie toi vous ton votre vos tú te tu tus usted ustedes ellos".split()
NEGATIONS = "not no never none nobody neither nor without isn't aren't wasn't don't doesn't nicht kein keine keiner nie niemals pas jamais aucun aucune ni nunca jamás ningún ninguna".split()
REPORTS = "said says say told called calls wrote quoted quote reported claimed sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()

_WORD = re.compile(r"\w+(?:['’]\w+)?")
_CLAUSE_END = re.compile(r"[.!?;:]['\")]*$")
O, INSULT, THREAT, TARGET, NEG, REPORT, INSULT_AT, THREAT_AT, INSULT_NOT, INSULT_SAID, NAMED, THREAT_SAID = range(12)
#: Weights of arcs: passing over a negation or a verb of speech; matches; what reported speech takes away.
PASS_OVER, AT_TARGET, AGAIN, SAID, MENTION, ODDS = -2.0, 0.5, 0.25, -0.6, 0.02, 0.25
#: Weight above which a clause is matched.
MATCH = 0.3


@dataclass(frozen=True)
class Transducer:
    """Epsilon-free: arcs[state][input] lists (output, weight, next state); all states are final, 0 is the start."""

    arcs: tuple[dict[int, tuple[tuple[int, float, int], ...]], ...]

    def compose(self, after: Transducer) -> Transducer:
        """First this one, then after; states are the reachable pairs."""
        ids, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            own: dict[int, list] = {}
            for symbol, outs in self.arcs[a].items():
                for mid, w, na in outs:
                    for out, v, nb in after.arcs[b].get(mid, ()):
                        if (na, nb) not in ids:
                            ids[na, nb] = len(ids)
                            queue.append((na, nb))
                        own.setdefault(symbol, []).append((out, w + v, ids[na, nb]))
            arcs.append({k: tuple(v) for k, v in own.items()})
        return Transducer(tuple(arcs))

    def best(self, words: list[tuple[tuple[int, float], ...]]) -> tuple[float, list[int]]:
        """The heaviest path over words' alternative (symbol, weight) readings: its weight and outputs."""
        heads: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for readings in words:
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for state, (w, path) in heads.items():
                arcs = self.arcs[state]
                for symbol, u in readings:
                    for out, v, to in arcs.get(symbol, ()):
                        if to not in nxt or w + u + v > nxt[to][0]:
                            nxt[to] = (w + u + v, (out, path))
            heads = nxt
        w, path = max(heads.values(), key=lambda x: x[0])
        outs = []
        while path is not None:
            outs.append(path[0])
            path = path[1]
        return w, outs[::-1]


_ALL = range(12)


def _scope(trigger: int, reach: int, rewrite: dict[int, tuple[tuple[int, float], ...]], pass_over: float | None = None) -> Transducer:
    """Copies symbols; within reach symbols after trigger, gives the rewritten ones instead; pass_over: weight of ignoring a trigger."""
    arcs = []
    for left in range(reach + 1):
        own = {}
        for s in _ALL:
            outs = rewrite.get(s, ((s, 0.0),)) if left else ((s, 0.0),)
            own[s] = tuple((out, w, reach if s == trigger else max(0, left - 1)) for out, w in outs)
        if pass_over is not None:
            own[trigger] += ((O, pass_over, max(0, left - 1)),)
        arcs.append(own)
    return Transducer(tuple(arcs))


def grammar() -> Transducer:
    """Threat, insult, target, negation and reported-speech transducers, composed."""
    threat = _scope(THREAT, 4, {TARGET: ((THREAT_AT, 2 * AT_TARGET), (TARGET, 0.0))})
    insult = _scope(INSULT, 3, {INSULT: ((INSULT, AGAIN),)})
    target = _scope(TARGET, 5, {INSULT: ((INSULT_AT, AT_TARGET), (INSULT, 0.0))})
    negation = _scope(NEG, 3, {INSULT: (), INSULT_AT: (), THREAT_AT: (), NAMED: ((INSULT_NOT, 0.0),)}, PASS_OVER)
    reported = _scope(REPORT, 6, {INSULT: ((INSULT_SAID, SAID),), INSULT_AT: ((INSULT_SAID, SAID - AT_TARGET),), THREAT_AT: ((THREAT_SAID, SAID - 0.2),), NAMED: ((INSULT_SAID, 0.0),)}, PASS_OVER)
    return threat.compose(insult).compose(target).compose(negation).compose(reported)


@dataclass
class Grammar:
    """The lexicon (words and stems with their log odds), read into the composed scopes."""

    words: dict[str, float]
    stems: dict[str, float]
    scopes: Transducer = field(default_factory=grammar)
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "scopes": self.scopes, "known": {}}

    def readings(self, chunk: str) -> tuple[tuple[tuple[int, float], ...], bool, bool]:
        """The arcs of a chunk of lower-case text without white space, whether it can match, whether a clause ends."""
        hit = self.known.get(chunk)
        if hit is None:
            symbol, weight = O, 0.0
            for w in _WORD.findall(chunk):
                value = self.words.get(w, 0.0)
                for n in STEMS:
                    if n <= len(w):
                        value = max(value, self.stems.get(w[:n], 0.0))
                if value > weight:
                    symbol, weight = INSULT, value
                elif symbol == O:
                    symbol = _FIXED.get(w, O)
            arcs = ((INSULT, ODDS * weight), (NAMED, MENTION)) if symbol == INSULT else ((symbol, 0.0),)
            if len(self.known) > 400_000:
                self.known.clear()
            hit = (arcs, symbol in (INSULT, THREAT), _CLAUSE_END.search(chunk) is not None)
            if len(chunk) <= 64:
                self.known[chunk] = hit
        return hit

    def features(self, text: str | None) -> list[float]:
        """Of a whole text: matched clauses by kind, their weights, and their density."""
        counts, total, top, matched, clauses, words = Counter(), 0.0, 0.0, 0, 0, 0
        readings = self.readings
        for line in (text or "").lower().split("\n"):
            clause: list = []
            hot = False
            chunks = line.split()
            words += len(chunks)
            for i, chunk in enumerate(chunks):
                arcs, can_match, end = readings(chunk)
                clause.append(arcs)
                hot |= can_match
                if end or i == len(chunks) - 1:
                    clauses += 1
                    if hot:
                        w, outs = self.scopes.best(clause)
                        counts.update(outs)
                        if w > MATCH:
                            matched += 1
                            total += w
                            top = max(top, w)
                    clause, hot = [], False
        n = [counts[k] for k in (INSULT, INSULT_AT, INSULT_NOT, INSULT_SAID, THREAT_AT)]
        return [1.0, *map(math.log1p, n), math.log1p(total), min(top, 4.0), float(matched > 0), float(matched > 1), 10 * matched / max(clauses, 1), min(3.0, 30 * total / max(words, 1)), math.log1p(words) / 8]


_FIXED = {w: k for k, ws in ((REPORT, REPORTS), (NEG, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class ToxicityModel:
    grammar: Grammar
    w: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.w, -30, 30)))


def _terms(texts_and_labels):
    counts: dict[str, list[int]] = {}
    for text, y in texts_and_labels:
        words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
        found = {"=" + w for w in words} | {w[:n] for w in words for n in STEMS if n < len(w)}
        for t in found:
            counts.setdefault(t, [0, 0])[y] += 1
    return counts


def learn_lexicon(terms: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that stand out in toxic documents: z of 4.5 or more against the sample's rate, and log odds as weight."""
    rate = n_toxic / max(1, n_toxic + n_clean)
    found = []
    for term, a, b in terms:
        z = (a - (a + b) * rate) / math.sqrt(max(1e-9, (a + b) * rate * (1 - rate)))
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if a >= 4 and z >= 4.5 and odds >= 2.3:
            found.append((-z, term, min(odds, 8.0)))
    found = sorted(found)[:MAX_TERMS]
    stems = {t: w for _, t, w in found if t[0] != "="}
    covered = lambda t: any(t[:n] in stems for n in STEMS if n < len(t))
    return {t[1:]: w for _, t, w in found if t[0] == "="}, {t: w for t, w in stems.items() if not covered(t)}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column is the intercept and unpenalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The lexicon and the logistic weights from the training fold's labelled sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("doc_id", "text", "toxic")

    def count(batch):
        got = _terms(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        yield {"term": list(got), "clean": [v[0] for v in got.values()], "bad": [v[1] for v in got.values()]}

    seen = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    rate = n_toxic / max(1, n_toxic + n_clean)
    sums = map_rows(rows, count, "term string, clean bigint, bad bigint").groupBy("term").agg(F.sum("bad").alias("a"), F.sum("clean").alias("b"))
    n = F.col("a") + F.col("b")
    terms = sums.where((F.col("a") >= 4) & (F.col("a") > n * rate + 4.4 * F.sqrt(n * rate * (1 - rate)))).orderBy(F.desc((F.col("a") - n * rate) / F.sqrt(n)), "term").limit(4 * MAX_TERMS).collect()
    grammar = Grammar(*learn_lexicon([(r.term, r.a, r.b) for r in terms], n_toxic, n_clean))

    def featured(batch):
        yield {"y": batch.column(2), "f": [grammar.features(t) for t in batch.column(1).to_pylist()]}

    data = map_rows(rows, featured, "y int, f array<double>").orderBy("y", "f").collect()
    if not data:
        return ToxicityModel(grammar, np.r_[-30.0, np.zeros(len(grammar.features("")) - 1)])
    x, y = np.array([r.f for r in data]), np.array([r.y for r in data], float)
    weight = np.where(y == 1, shares.get(1, 0) / max(1, n_toxic), shares.get(0, 0) / max(1, n_clean))
    return ToxicityModel(grammar, fit_logistic(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and matched_clauses of every whole text."""

    def scored(batch):
        x = np.array([model.grammar.features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, -1)
        p = model.scores(x)
        yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (p >= threshold).astype(np.int32), "clause_density": x[:, 10] / 10}

    return map_rows(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), scored, "doc_id bigint, held_out boolean, score double, predicted int, clause_density double")


def op2_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
