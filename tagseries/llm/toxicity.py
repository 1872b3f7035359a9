"""Operator 7, toxicity by a weighted finite-state pattern grammar.

Terminals.  Insult terms (whole words and word stems) and their weights are learned from labelled
training rows by log odds over texts; threats, targets, negations and reporting verbs are fixed lists.
Grammar.  A text is cut into clauses.  Only clauses that hold an insult or a threat are read: an
Aho-Corasick automaton finds the terms, and a transducer then runs over the clause's words.  Its
states say whether a target, a negation or a reporting verb is near; each insult or threat adds its
weight times the state's factor, and a target next to it adds a bonus.
Score.  A logistic model over six sums of matched clauses, fitted on the same training rows.

Learning uses at most ``sample`` labelled rows (those of the smallest id hash), so its terms and
coefficients are of bounded size; every document is then scored whole.  Equal texts count once while
terms are learned, so a text with thousands of copies does not turn its words into insults.

Edge cases: null and empty texts match nothing and get the model's base score; several labels of one
id count as toxic if any is; without labelled rows of both kinds all scores are 0; repeated rows are
scored alike; an empty table gives an empty result.  A very long text is scanned
whole, clause by clause.  Only the id and the text are read, and of the labels the id and the label; the columns of
``keep`` must not be called id, fold, text or f.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import add_columns, crc_fold, lower_ascii

# Word lists of the grammar.
THREATS = "kill murder strangle stab shoot hang".split()
TARGETS = "you your he she they them those these people du ihr sie tu vous ils eux usted ustedes ellos".split()
NEGATIONS = "not never no nicht kein keine nie pas jamais ne nunca tampoco".split()
REPORTS = "said says wrote quoted called claims sagte schrieb nannte dit dijo llamó".split()
NEAR = 4                       # words that a negation or target reaches
NEGATED, REPORTED, TARGETED = 0.3, 0.5, 0.5
SAMPLE, STEMS = 20_000, (4, 5, 6, 7, 8)
MIN_SHARE, MIN_TEXTS, MIN_ODDS, MOST_TERMS = 0.01, 3, 3.0, 1024
CLAUSE = re.compile(r"[.!?;:|\n]")
WORD = re.compile(r"[^\W\d_]+")
FEATURES = 6


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
                  folds=5, held_out=0, sample=SAMPLE) -> DataFrame:
    """(text, y): the ``sample`` labelled rows outside the held-out fold with the smallest id hash.
    Only their ids are broadcast, at most ``sample`` of them."""
    y = labels.where(F.col(label_col).isNotNull() & (crc_fold(F.col(id_col), folds) != held_out)).groupBy(
        F.col(id_col).alias("k")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    picked = y.orderBy(F.xxhash64("k"), "k").limit(sample)
    return docs.join(F.broadcast(picked), docs[id_col] == picked["k"]).select(
        F.coalesce(docs[text_col], F.lit("")).alias("text"), "y")


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Term to weight; a stem ends in ``*``.  Counts are over different texts."""
    texts = train.groupBy(lower_ascii(F.col("text")).alias("text")).agg(F.max("y").alias("y"))

    def terms(batches):
        import pyarrow as pa

        for b in batches:
            pos, neg = {}, {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(t))
                found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
                c = pos if y else neg
                for x in found:
                    if len(x) <= 32:
                        c[x] = c.get(x, 0) + 1
            keys = [*pos, *(k for k in neg if k not in pos)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([pos.get(k, 0) for k in keys], pa.int64()),
                                                  pa.array([neg.get(k, 0) for k in keys], pa.int64())], ["term", "p", "n"])

    n = texts.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = n[0] or 0, n[1] or 0
    if not n1 or not n0:
        return {}
    c = texts.mapInArrow(terms, "term string, p bigint, n bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("n") + 0.5) / (n0 + 1))
    good = c.withColumn("w", odds).where((F.col("w") >= MIN_ODDS) & (F.col("p") >= max(MIN_TEXTS, MIN_SHARE * n1)))
    rows = good.orderBy(F.desc("w"), F.desc("p"), "term").limit(MOST_TERMS).collect()
    # a stem is too short if one longer term holds most of its toxic texts at clearly better odds
    short = {r.term for r in rows if r.term.endswith("*") and any(
        x.term != r.term and x.term.startswith(r.term[:-1]) and x.p >= 0.8 * r.p and x.w > r.w + 0.7 for x in rows)}
    rows = [r for r in rows if r.term not in short]
    out: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (not r.term.endswith("*"), len(r.term))):  # short stems cover their words
        plain = r.term.rstrip("*")
        if not any(plain.startswith(s[:-1]) for s in out if s.endswith("*") and r.term != s):
            out[r.term] = float(min(r.w, 8.0)) / 8.0
    return out


class Grammar:
    """Finds clauses with a term and sums what the transducer emits for them."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.auto = ahocorasick.Automaton()
        for t in {*(x.rstrip("*") for x in terms), *THREATS}:
            self.auto.add_word(t, len(t))
        self.auto.make_automaton()
        self.stems = tuple(sorted({len(x) - 1 for x in terms if x.endswith("*")}))

    def weight(self, w: str) -> float:
        got = self.terms.get(w, 0.0)
        for n in self.stems:
            if len(w) >= n:
                got = max(got, self.terms.get(w[:n] + "*", 0.0))
        return got

    def clause(self, words: list[str]) -> tuple[float, float, int, int]:
        """Weight, weight without the state's factors, number of insults and of threats."""
        negated = target = -NEAR - 1
        reported, total, plain, insults, threats, pending = False, 0.0, 0.0, 0, 0, []
        for i, w in enumerate(words):
            if w in NEGATIONS:
                negated = i
            elif w in REPORTS:
                reported = True
            elif w in TARGETS:
                target = i
                total += sum(TARGETED * x for at, x in pending if i - at <= NEAR)
                pending = []
            else:
                threat = w in THREATS
                x = 1.0 if threat else self.weight(w)
                if x:
                    x_here = x * (NEGATED if i - negated <= NEAR else 1.0) * (REPORTED if reported else 1.0)
                    if i - target <= NEAR:
                        total += TARGETED * x_here
                    else:
                        pending.append((i, x_here))
                    total, plain = total + x_here, plain + x
                    insults, threats = insults + (not threat), threats + threat
        return total, plain, insults, threats

    def features(self, text: str) -> list[float]:
        low = text.lower()
        at, total, plain, best, insults, clauses, different = -1, 0.0, 0.0, 0.0, 0, 0, set()
        for end, n in self.auto.iter(low) if len(self.auto) else ():
            first = end - n + 1
            if first < at or first and low[first - 1].isalpha():
                continue
            a = b = None
            for m in CLAUSE.finditer(low, end + 1):
                b = m.start()
                break
            b = len(low) if b is None else b
            a = 1 + max(low.rfind(c, max(at, 0), first) for c in ".!?;:|\n")
            a = max(a, at, 0)
            words = WORD.findall(low[a:b])
            w, p, k, threats = self.clause(words)
            at = b
            if k or threats:
                total, plain, best, insults, clauses = total + w, plain + p, max(best, w), insults + k + threats, clauses + 1
                different.update(x for x in words if self.weight(x))
        return [np.log1p(total), np.log1p(plain), best, np.log1p(insults), np.log1p(clauses), np.log1p(len(different))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pen), x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _matched(df: DataFrame, terms: dict[str, float]) -> DataFrame:
    def start():
        g = Grammar(terms)
        return lambda texts: [[g.features(t.decode("utf-8")) for t in texts]]

    return add_columns(df, "text", start, "f array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
             folds=5, held_out=0, sample=SAMPLE, keep=()) -> DataFrame:
    """One row per document: id, held_out, score, predicted, matched (weight of its clauses), and the
    columns of ``keep``."""
    train = training_rows(docs, labels, id_col, text_col, label_col, folds, held_out, sample)
    terms = learn_terms(train)
    rows = _matched(train, terms).select("f", "y").toPandas() if terms else None  # at most `sample` rows
    coef = fit_logistic(np.array(rows.f.tolist()).reshape(-1, FEATURES), rows.y.to_numpy()) if terms else None
    src = docs.select(F.col(id_col).alias("id"), crc_fold(F.col(id_col), folds).alias("fold"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    scored = _matched(src, terms)
    if coef is None:
        score = F.lit(0.0)
    else:
        z = F.lit(float(coef[0])) + sum((F.col("f")[i] * float(c) for i, c in enumerate(coef[1:])), F.lit(0.0))
        score = 1 / (1 + F.exp(-z))
    out = scored.select(F.col("id").alias(id_col), (F.col("fold") == held_out).alias("held_out"), score.alias("score"),
                        (F.exp(F.col("f")[0]) - 1).alias("matched"), *keep)
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched", *keep)
