"""Toxicity by maximum-scoring segments.

Words, and their beginnings of ``STEMS`` letters, get a log-odds score from labelled texts,
with an informative Dirichlet prior that shrinks rare ones; those that lean to the toxic
class by ``ODDS`` and beyond ``Z`` standard errors are kept, and a word scores what its best part scores.
All other words share the small negative score of a word that is none of them.  A
linear-time scan finds every maximal segment of a text.  Under the score's own null model
the best segment follows an extreme-value law with slope 1; its scale is fitted on the
labelled clean texts.  The segments that beat the law's mean are summed up to one p-value
per text, and a logistic curve over it gives the score.

The classifier is fitted on at most ``ROWS`` labelled rows (the documented bound: those of
smallest hash of the id), so that the join with the texts may be a broadcast.  Scoring reads
every whole text, each row in the task that read it: no shuffle.

Defined cases: null labels are no labels, of several for one id the largest counts; equal
labelled texts teach once; a null or blank text has no words and gets the score of a text
without any segment; without labels of both classes every score is 0; a null id is kept, and has no label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import map_batches
from wayfold.session import materialize

ROWS = 100_000
#: Weight of the prior as a share of all counted words; least log-odds, and least standard errors.  These tests alone
#: decide which words the model has; each needs about Z * Z toxic texts, so ROWS bounds their number.
PRIOR, ODDS, Z = 0.1, 3.2, 4.0
#: Lengths of the word beginnings that count as tokens beside the words, so that an ending hides no stem.
STEMS = (4, 5, 6)
#: Entries of a task's cache of word scores; a full cache is emptied.
CACHE = 400_000
WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass
class Model:
    scores: dict[str, float]
    other: float = 0.0
    scale: float = 1.0
    curve: tuple[float, float] | None = None
    known: dict[str, float | None] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> float | None:
        """The best score among a word's parts, None for a word without any."""
        if word not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = max((self.scores[p] for p in parts(word) if p in self.scores), default=None)
        return self.known[word]


def parts(word: str) -> list[str]:
    """A word and its beginnings; a star marks a beginning."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def word_list(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def segments(marked: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first place, last place).

    ``marked`` holds the scored words by place; every place between them counts ``other``.  Each kept
    candidate points to the nearest one on its left that starts lower, so no candidate is passed twice.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, pointer
    total, place = 0.0, -1
    for at, score in marked:
        total += other * (at - place - 1)
        place = at
        if score <= 0:
            total += score
            continue
        low, high, first = total, total + score, at
        total = high
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= high:
                kept.append((low, high, first, at, j))
                break
            low, first, up = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = up
    return [(high - low, first, last) for low, high, first, last, _ in kept]


def passages(text: str | None, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of words, and the segments with their places as word numbers."""
    found = word_list(text)
    of = model.of
    return len(found), segments([(i, s) for i, s in enumerate([of(w) for w in found]) if s is not None], model.other)


def evidence(n: int, scores: list[float], scale: float) -> float:
    """Minus the log of the p-value of all segments above the extreme-value law's location, taken together."""
    location = math.log(max(scale * n, 1e-300)) if n else 0.0
    over = [s - location for s in scores if s > location]
    r, total = len(over), sum(over)
    if not r:
        return 0.0
    log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
    return max(0.0, -log_p)


def score_of(n: int, scores: list[float], model: Model) -> float:
    if model.curve is None:
        return 0.0
    a, b = model.curve
    return 1 / (1 + math.exp(-min(50.0, max(-50.0, a + b * math.log1p(evidence(n, scores, model.scale))))))


def labelled_texts(docs: DataFrame, labels: DataFrame, held_out, id_col: str, text: str) -> DataFrame:
    """(text, label) of the labelled rows that may be learned from, each text once."""
    marks = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("label"))
             .orderBy(F.xxhash64("__id"), "__id").limit(ROWS))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (rows.join(F.broadcast(marks), "__id")  # at most ROWS rows of two numbers
            .select("text", (F.col("label") > 0).cast("int").alias("label")))


def count_words(rows: DataFrame) -> DataFrame:
    """word (or beginning), n0, n1: clean and toxic texts that hold it; a word said often in one text is one witness."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, label in zip(batch["text"], batch["label"]):
                for part in {p for w in set(word_list(t)) for p in parts(w)}:
                    counts.setdefault(part, [0, 0])[label] += 1
            if len(counts) > 300_000:
                yield _count_frame(counts)
                counts = {}
        yield _count_frame(counts)

    return map_batches(rows, run, "word string, n0 long, n1 long").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _count_frame(counts: dict[str, list[int]]) -> pd.DataFrame:
    both = np.array(list(counts.values()), dtype="int64").reshape(-1, 2)
    return pd.DataFrame({"word": list(counts), "n0": both[:, 0], "n1": both[:, 1]})


def fit(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> Model:
    rows = labelled_texts(docs, labels, held_out, id_col, text)
    # equal texts are copies of one text: they must not count as evidence of their own
    rows = rows.groupBy(F.xxhash64("text").alias("__h"), F.length("text").alias("__n")).agg(
        F.max(F.struct("label", "text")).alias("one")).select("one.text", "one.label")
    rows = materialize(rows, "labelled-texts")
    counts = materialize(count_words(rows), "labelled-words")
    n0, n1 = counts.where(~F.col("word").endswith("*")).agg(F.sum("n0"), F.sum("n1")).first()
    if not n0 or not n1:
        return Model({})
    prior = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) + 0.01
    all_prior = PRIOR * (n0 + n1)
    odds = lambda n, whole: F.log((n + prior) / (F.lit(whole + all_prior) - n - prior))
    scored = counts.select("word", "n0", "n1", (odds(F.col("n1"), n1) - odds(F.col("n0"), n0)).alias("d"),
                           F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)).alias("e"))
    best = (scored.where((F.col("d") >= ODDS) & (F.col("d") >= Z * F.col("e")))
            .collect())  # bounded by ROWS, as each needs many texts
    scores = {r["word"]: float(r["d"]) for r in best}
    # a word and its beginnings are counted apart, so their sum may pass the share of marked words: hence the bounds
    toxic_share, clean_share = (min(0.5, sum(r[k] for r in best) / n) for k, n in (("n1", n1), ("n0", n0)))
    model = Model(scores, min(-1e-6, math.log((1 - toxic_share) / (1 - clean_share))))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [passages(t, shared.value) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "n": [n for n, _ in found],
                                "s": [[s for s, _, _ in x] for _, x in found]})

    seen = map_batches(rows, run, "label int, n long, s array<double>").collect()  # at most ROWS
    spread = [r["n"] * math.exp(-max(r["s"], default=0.0)) for r in seen if r["label"] == 0 and r["n"]]
    model.scale = len(spread) / sum(spread) if spread else 1.0
    x = np.array([math.log1p(evidence(r["n"], list(r["s"]), model.scale)) for r in seen])
    model.curve = logistic(x, np.array([r["label"] for r in seen], dtype="float64"))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a little ridge, for classes that part without error."""
    theta = np.zeros(2)
    a = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -50, 50)))
        ridge = np.diag([1e-3, 1e-1])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ theta)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, n_passages, and the passages as word places ``first:last`` by place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see Z

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                n, found = passages(t, shared.value)
                location = math.log(max(shared.value.scale * n, 1e-300)) if n else 0.0
                shown = [f"{first}:{last + 1}" for s, first, last in found if s > location]
                rows.append((score_of(n, [s for s, _, _ in found], shared.value), len(shown), ",".join(shown)))
            out = pd.DataFrame(rows, columns=["score", "n_passages", "passages"])
            out.insert(0, "id", batch["id"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                       f"id {kind}, score double, n_passages long, passages string").withColumnRenamed("id", id_col)
