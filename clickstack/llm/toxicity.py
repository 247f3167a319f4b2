"""Toxicity by a weighted finite-state pattern grammar.

Words fall into classes (insult, threat, target, negation, report, other).  Small
transducers over classes each follow one thing: whether a target is near, whether a
negation still reaches, whether the clause reports what another said.  They are composed
into one machine whose output for an insult or a threat is the product of their weights,
so a clause scores by how its words stand together and not by isolated words.

Which words insult or threaten is learned: whole words and word beginnings whose share of
toxic labelled documents is far above their share of others.  A logistic fit on clause
features of other labelled documents gives the score.  Both come from a bounded sample of
labelled rows (``fit_rows``, the smallest hashes of doc_id); scoring covers every whole
text.  Label, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without a match; repeated rows
score alike; documents without a label are scored but never learned from; without any
labelled row of each kind the seed words and a prior of 0.05 serve; an empty table gives an
empty result."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.rowindex import global_ordinal
from ..session import cut_lineage
from .common import arrow_map

# Seed words of the grammar in English, German, French and Spanish.
SEED = {
    "insult": "idiot moron scum stupid trash pathetic worthless disgusting loser clown imbecile dumb "
              "dumm abschaum blöd wertlos ordure crétin débile basura imbécil estúpido",
    "threat": "kill hurt destroy murder beat töten vernichten tuer détruire matar destruir",
}
WORDS = {
    "target": "you your yours u they them he she him her du dich dein ihr euch sie tu te ton vous votre il elle "
              "usted ustedes tú ellos ella",
    "negation": "not no never without isn't don't nicht kein keine nie ne pas jamais sans nunca sin",
    "report": "said says say claimed called wrote quoted reported sagte sagt nannte schrieb dit disait écrit dijo dice "
              "llamó escribió",
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report")
INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 3, 4, 5

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
BOUNDS = ".,;:!?\n|()。，、；：！？（）｜．｡､"
CLAUSE = re.compile(f"[{re.escape(BOUNDS)}]+")


class Transducer:
    """``step[state][class]`` -> next state, ``weight[state][class]`` -> factor of a match."""

    def __init__(self, step: list[list[int]], weight: list[list[float]]):
        self.step, self.weight = step, weight

    def compose(self, other: Transducer) -> Transducer:
        """Both run on the same words; weights multiply."""
        n = len(other.step)
        pairs = [(a, b) for a in range(len(self.step)) for b in range(n)]
        return Transducer([[self.step[a][c] * n + other.step[b][c] for c in range(len(CLASSES))] for a, b in pairs],
                          [[self.weight[a][c] * other.weight[b][c] for c in range(len(CLASSES))] for a, b in pairs])


def matches() -> Transducer:
    return Transducer([[0] * 6], [[0.0, 1.0, 1.0, 0.0, 0.0, 0.0]])


def target_near(gain: float = 1.2) -> Transducer:
    """A target earlier in the clause."""
    return Transducer([[0, 0, 0, 1, 0, 0], [1] * 6], [[1.0] * 6, [gain] * 6])


def negated(reach: int = 3, factor: float = 0.4) -> Transducer:
    """A negation up to ``reach`` words before."""
    step = [[max(0, s - 1)] * 4 + [reach] + [max(0, s - 1)] for s in range(reach + 1)]
    return Transducer(step, [[1.0 if s == 0 else factor] * 6 for s in range(reach + 1)])


def reported(factor: float = 0.6) -> Transducer:
    """A verb of saying earlier in the clause."""
    return Transducer([[0, 0, 0, 0, 0, 1], [1] * 6], [[1.0] * 6, [factor] * 6])


GRAMMAR = matches().compose(target_near()).compose(negated()).compose(reported())
FIXED = {w: CLASSES.index(k) for k, words in WORDS.items() for w in words.split()}
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that can be learned


def lexicon_seed() -> dict[str, tuple[int, float]]:
    return {w: (CLASSES.index(k), 2.0) for k, words in SEED.items() for w in words.split()}


def candidates(word: str):
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Scorer:
    """Clause features of a text under a lexicon of words and beginnings (``stem*``)."""

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        import ahocorasick
        self.lexicon = lexicon
        self.finder = ahocorasick.Automaton()
        for stem in {k.rstrip("*") for k in lexicon}:
            self.finder.add_word(stem, len(stem))
        if lexicon:
            self.finder.make_automaton()

    def look(self, word: str) -> tuple[int, float]:
        best = (FIXED.get(word, 0), 0.0)
        for c in candidates(word):
            got = self.lexicon.get(c)
            if got and got[1] > best[1]:
                best = got
        return best

    def features(self, text: str) -> tuple[float, ...]:
        low = text.lower()
        n_words = low.count(" ") + low.count("\n") + 1
        hit_at = []
        if self.lexicon and low:
            for end, n in self.finder.iter(low):
                begin = end - n + 1
                if begin == 0 or not low[begin - 1].isalpha():
                    hit_at.append(begin)
        clauses: list[float] = []
        done = 0
        for at in sorted(hit_at):
            if at < done:
                continue
            lo = at
            while lo > done and low[lo - 1] not in BOUNDS:
                lo -= 1
            m = CLAUSE.search(low, at)
            done = m.start() if m else len(low)
            clauses.append(self.clause(low[lo:done]))
        clauses = [c for c in clauses if c > 0]
        total, top = sum(clauses), max(clauses, default=0.0)
        return (math.log1p(total), top, math.log1p(len(clauses)), math.log1p(100 * total / n_words),
                math.log1p(100 * len(clauses) / n_words), math.log(n_words))

    def clause(self, clause: str) -> float:
        state, score = 0, 0.0
        for m in WORD.finditer(clause):
            word = m[0]
            kind, weight = self.look(word)
            score += GRAMMAR.weight[state][kind] * weight
            state = GRAMMAR.step[state][kind]
        return score


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant last), means and scales."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -30, 30)))
        h = np.einsum("ij,i,ik->jk", z, np.maximum(p * (1 - p), 1e-6), z) + ridge * len(z) * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, (z * (y - p)[:, None]).sum(axis=0) - ridge * len(z) * 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_lexicon(sample: DataFrame, least: int = 5, share: float = 0.01, odds: float = 1.5) -> dict[str, tuple[int, float]]:
    """Words and beginnings that toxic texts hold far more often: (class, log odds).  At least
    ``least`` toxic texts and ``share`` of them must hold one."""
    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                for c in {c for w in words for c in candidates(w)}:
                    seen[c, toxic] += 1
            stems = list({c for c, _ in seen})
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([seen[c, 1] for c in stems], pa.int64()),
                                              pa.array([seen[c, 0] for c in stems], pa.int64())], names=["stem", "bad", "fair"])

    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    weight = F.log(((F.col("bad") + 0.5) / (n[1] + 1)) / ((F.col("fair") + 0.5) / (n[0] + 1)))
    found = (arrow_map(sample.select("text", "toxic"), count, "stem string, bad long, fair long")
             .groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("fair").alias("fair"))
             .where(F.col("bad") >= max(least, share * n[1])).withColumn("odds", weight).where(F.col("odds") >= odds)
             .select("stem", "odds").collect())  # bounded by the sample
    odds_of = {r[0]: r[1] for r in found}
    out = {}
    for stem, o in odds_of.items():
        bare = stem.rstrip("*")
        shorter = [odds_of.get(bare[:k] + "*", -9.0) for k in STEMS if k < len(bare) or (k == len(bare) and not stem.endswith("*"))]
        if max(shorter, default=-9.0) < o - 0.2:  # a shorter beginning tells no less
            out[stem] = (INSULT, float(o))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000) -> tuple[dict, tuple]:
    """(lexicon, logistic fit) from at most ``fit_rows`` labelled rows that are not held out.  The
    weights are fitted on one half of them with a lexicon from the other half.  Rows that share an
    id all carry its label, equal ones once; the bound holds for the rows."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    sample = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                         .join(F.broadcast(known), "doc_id")  # fit_rows rows at most
                         .dropDuplicates(["doc_id", "text"])
                         .withColumn("half", F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(2))), "fit-sample")
    if sample.count() > fit_rows:  # a repeated id brings more rows than labels
        order = [F.xxhash64("doc_id", "text"), F.col("doc_id")]
        sample = cut_lineage(global_ordinal(sample, order, "_place").where(F.col("_place") < fit_rows).drop("_place"), "fit-sample")
    seed = {k: (kind, 1.0) for k, (kind, _) in lexicon_seed().items()}
    half = seed | learn_lexicon(sample.where("half = 0"))  # the weights see it on other rows
    lexicon = seed | learn_lexicon(sample)

    def features(batches):
        scorer = Scorer(half)
        for batch in batches:
            got = [scorer.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(g) for g in got], pa.list_(pa.float64()))],
                                             names=["toxic", "x"])

    rows = arrow_map(sample.where("half = 1").select("text", "toxic"), features, "toxic int, x array<double>").collect()
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return lexicon, (np.array([1.0, 0, 0, 0, 0, 0, math.log(0.05 / 0.95)]), np.zeros(6), np.ones(6))
    return lexicon, logistic(np.array([r[1] for r in rows]), y)


def scored(docs: DataFrame, model: tuple[dict, tuple]) -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, model, "score").select("doc_id", "score")


def with_score(docs: DataFrame, model: tuple[dict, tuple], name: str) -> DataFrame:
    """``docs`` with the score as column ``name``."""
    lexicon, (w, mean, scale) = model
    text = docs.columns.index("text")

    def score(batches):
        scorer = Scorer(lexicon)
        for batch in batches:
            x = np.array([scorer.features(t or "") for t in batch.column(text).to_pylist()]).reshape(-1, 6)
            z = ((x - mean) / scale) @ w[:-1] + w[-1]
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    return arrow_map(docs, score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
