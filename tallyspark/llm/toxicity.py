"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first (compatibility forms, look-alike letters of other
alphabets, digits and signs standing in for letters), then searched once for
all terms.  A term is a whole word or the beginning of words; its weight is
the log-odds of meeting it in toxic against other labelled texts.  Hits inside
an exception phrase do not count.  The summed weight over the number of words
is turned into a probability by a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
#: The lexicon and the curve are fitted on about so many labelled rows at most.
MAX_LABELLED = 20_000
MAX_TERMS = 3_000
PREFIXES = range(3, 9)
#: A term needs this log-odds weight and this likelihood-ratio statistic.
MIN_WEIGHT, MIN_G2 = 2.0, 20.0
#: Harmless phrases that hold a word which insults use.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "circus clown",
              "idiot proof", "idiotproof", "pathetic fallacy")

#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁԛԝһӏαβεικνορτυχγ",
    "abekmhopctyxijsdqwhlabeiknoptuxy")
#: Digits and signs that stand for letters, with i, l, 1, ! and | as one class.
LEET = str.maketrans("013457|!8@$", "oieastiibas")
_INSIDE = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![^\W_])")
_FOREIGN = re.compile("[Ͱ-ԯᴀ-\U0010ffff]")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded text: words between single blanks, one blank at either end."""
    t = (text or "").lower()
    if not t.isascii() and _FOREIGN.search(t):
        t = unicodedata.normalize("NFKC", t).lower().translate(HOMOGLYPHS)
    t = _INSIDE.sub(lambda m: m[0].translate(LEET), t).replace("l", "i")
    return f" {_GAP.sub(' ', t).strip()} "


@dataclass
class Lexicon:
    """Terms start with a blank; those that end in one are whole words, the others word beginnings."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -3.0
    slope: float = 1.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term.rstrip(" "), (term.rstrip(" "), w, term.endswith(" ")))
            for phrase in self.exceptions:
                p = fold(phrase).rstrip()
                if p:
                    a.add_word(p, (p, 0.0, False))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def density(self, text: str | None) -> float:
        """log(1 + summed weight per 100 words); each word counts once, with its heaviest term."""
        t = fold(text)
        n = t.count(" ") - 1
        if n <= 0 or not len(self.automaton):
            return 0.0
        hits, free = {}, []
        for end, (term, w, whole) in self.automaton.iter(t):
            if whole and t[end + 1] != " ":
                continue
            start = end - len(term) + 1
            if w:
                hits[start] = max(w, hits.get(start, 0.0))
            else:
                free.append((start, end))
        total = sum(w for s, w in hits.items() if not any(a <= s <= b for a, b in free))
        return math.log1p(100.0 * total / n)

    def score(self, text: str | None) -> float:
        z = self.intercept + self.slope * self.density(text)
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out quarter, about ``bound`` at most, drawn by a hash of the id."""
    lab = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, bound / max(1, lab.count()))
    lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    return (docs.select("doc_id", "text").join(lab.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
            .select("text", F.col("toxic").cast("int").alias("toxic")))


def fit_lexicon(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of a labelled sample (text, toxic).  No toxic or no other row: no terms and the base rate as score."""
    by = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = by.get(1, 0), by.get(0, 0)
    if not pos or not neg:
        rate = (pos + 0.5) / (pos + neg + 1.0) if pos + neg else 0.0
        return Lexicon({}, exceptions, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), 0.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                seen = {0: Counter(), 1: Counter()}
                for text, toxic in zip(b["text"][k:k + 500], b["toxic"][k:k + 500]):
                    terms = set()
                    for w in set(fold(text).split()):
                        if len(w) >= 3:
                            terms.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
                            terms.add(f" {w} ")
                    seen[1 if toxic else 0].update(terms)
                every = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"term": every, "p": [seen[1][x] for x in every], "n": [seen[0][x] for x in every]})

    terms = sample.mapInPandas(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n, P, N = F.col("p"), F.col("n"), float(pos), float(neg)
    weight = F.log((p + 0.5) / (P + 1)) - F.log((n + 0.5) / (N + 1))
    met, total = p + n, P + N
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(p, met * P / total) + part(n, met * N / total)
              + part(P - p, (total - met) * P / total) + part(N - n, (total - met) * N / total))
    best = (terms.withColumn("w", weight).withColumn("g2", g2).where((F.col("w") >= MIN_WEIGHT) & (F.col("g2") >= MIN_G2))
            .orderBy(F.desc("g2"), F.col("term").endswith(" "), F.desc(F.length("term")), "term").limit(20 * MAX_TERMS).collect())
    chosen: dict[str, float] = {}
    # best first, beginnings before whole words that do no better: a term that one chosen before begins, or that begins
    # it, says nothing new; the closing blank of a whole word is part of it, so it begins no longer word
    for r in best:
        t = r["term"]
        if len(chosen) < MAX_TERMS and not any(t[:k] in chosen for k in range(2, len(t) + 1)) \
                and not any(c.startswith(t) for c in chosen):
            chosen[t] = round(r["w"], 6)
    lex = Lexicon(chosen, exceptions)

    @F.pandas_udf("double")
    def density(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([round(lex.density(x), 2) for x in t], dtype="float64")

    hist = [(r["x"], r["pos"], r["all"]) for r in sample.groupBy(density("text").alias("x"))
            .agg(F.sum("toxic").alias("pos"), F.count("*").alias("all")).collect()]
    lex.intercept, lex.slope = _logistic(hist)
    return lex


def _logistic(hist: list[tuple[float, int, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Newton steps for P(toxic | x), on counts by rounded x."""
    a, b = -1.0, 0.0
    for _ in range(50):
        ga, gb, aa, ab, bb = 0.0, -ridge * b, ridge, 0.0, ridge
        for x, pos, n in hist:
            q = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            r, v = pos - n * q, n * q * (1 - q)
            ga, gb, aa, ab, bb = ga + r, gb + r * x, aa + v, ab + v * x, bb + v * x * x
        det = aa * bb - ab * ab
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        far = max(1.0, abs(da), abs(db))
        a, b = a + da / far, b + db / far
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def score_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("double")
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([lexicon.score(x) for x in t], dtype="float64")

    return compute(text)


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts score the curve's value without a hit.

    A null doc_id is not held out.  Other columns are not read.
    """
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         score_column(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are.

    Null and empty texts score as texts without a term and stay; very long
    texts are read whole; each row is scored by itself, so repeated rows and
    equal scores fare alike.  No rows give no rows.
    """
    return docs.where(score_column(F.col("text"), lexicon) < THRESHOLD)
