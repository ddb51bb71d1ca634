"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, look-alike letters of other scripts and
full-width forms to plain Latin, invisible characters away, digits and signs
inside words to the letters they stand for. The lexicon is learned from a bounded
sample of labelled rows: whole words and word beginnings, each weighted by the
log ratio of its rates in toxic and in clean texts. Longer words that contain an
entry but belong to clean texts become exception phrases, whose matches cancel
the entries inside them. A text's weight per hundred words and its number of
different hits go through a logistic curve fitted on the same sample.

The sample of labelled documents that the table has is bounded by a parameter, and what is learned from it by the
sample, so it can be sent to all tasks;
scoring is a projection of each row. Defined results: a null text counts as empty
and gets the score of a text without a hit; repeated rows get equal scores;
without toxic rows in the sample the lexicon is empty and every score is below
the threshold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brainstate.llm.common import numbered, slices, stored

#: Labelled rows that the lexicon is learned from, at most: those with the smallest hashes of their id.
MAX_SAMPLE = 20_000
#: Times that a text counts a term in learning: a text that repeats one word doesn't decide alone.
SATURATION = 3
#: Toxic texts that an entry needs, at least and as a share of all, and the least log ratio of its rates.
MIN_TOXIC = 4
MIN_TOXIC_SHARE = 0.01
MIN_WEIGHT = 2.5
#: A word beginning is a family if it is so many times as frequent as each longer term that has it.
FAMILY = 1.3
#: Lengths of the word beginnings that can be entries.
BEGINNINGS = range(4, 9)
THRESHOLD = 0.3

#: Look-alikes of other scripts, and the Latin letters they are read as.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁԛԝһӏкмтвнгαεορυικνητχɑɡıⅼ",
        "aeopcyxijsdqwhlkmtbhraeopuiknntxagil",
        strict=True,
    )
)
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE, ""))
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134589@$!7]+(?=[^\W\d_])|(?<![\w@$!])[0134589@$!7]{1,2}(?=[^\W\d_]{2})")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_OTHER = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Folded words of a text, each with one space before and after it."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    else:
        text = text.lower()
    text = _INSIDE.sub(lambda m: m[0].translate(_SUBSTITUTE), text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Model:
    """Entries and their weights, exception phrases, and the logistic curve."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope_weight: float
    slope_hits: float

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        if len(found):
            found.make_automaton()
        return found


def matched(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """Weight of the entries in a folded text, their number, and the text's words; an entry counts once a place."""
    words = text.count(" ") - 1
    if not len(automaton):
        return 0.0, 0, max(words, 1)
    hits: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight:
            hits[start] = max(weight, hits.get(start, 0.0))
        else:
            excepted.append((start, end))
    if excepted:
        excepted.sort()
        starts, ends = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        # Of the exceptions that begin at a hit or before it, none may end behind it.
        hits = {s: w for s, w in hits.items() if not ((i := bisect_right(starts, s)) and s < ends[i - 1])}
    return sum(hits.values()), len(hits), max(words, 1)


def _features(weight, hits, words):
    return np.log1p(100.0 * np.asarray(weight) / (np.asarray(words) + 20.0)), np.log1p(np.asarray(hits))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n) of the words and word beginnings of labelled texts, n saturated a text."""
    for batch in slices(batches, 0):
        terms, toxic, counts = [], [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: dict[str, int] = {}
            for word in folded(text).split():
                keys = [f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if k <= len(word))]
                for key in keys:
                    found[key] = found.get(key, 0) + 1
            terms += found
            toxic += [label] * len(found)
            counts += [min(n, SATURATION) for n in found.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(toxic, pa.int32()), pa.array(counts, pa.int64())],
            ["term", "toxic", "n"],
        )


def sample_of(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(text, toxic) of at most max_sample labelled documents."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_sample)
    )
    return docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """Lexicon, exceptions and curve from docs (doc_id, text) and labels (doc_id, toxic)."""
    sample = stored(sample_of(docs, labels, max_sample), "sample")
    n_toxic, n_clean = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = n_toxic or 0, n_clean or 0
    if not n_toxic or not n_clean:
        return Model({}, (), -3.0, 1.0, 1.0)
    terms = (
        sample.mapInArrow(_candidates, "term string, toxic int, n long")
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
            F.sum("toxic").alias("t_docs"),
            F.count("*").alias("docs"),
        )
        .withColumn(
            "weight", F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
        )
    )
    rows = (
        terms.filter((F.col("t_docs") >= max(MIN_TOXIC, MIN_TOXIC_SHARE * n_toxic)) & (F.col("weight") >= MIN_WEIGHT))
        .collect()
    )
    weights = {r["term"]: r["weight"] for r in rows}
    # Of a beginning and the longer terms that have it, the beginning stands for a family of words if it
    # is clearly more frequent than each of them; if not, the longer term is the more exact entry.
    counts = {r["term"]: r["t"] for r in rows}
    longest: dict[str, int] = {}
    for term, n in counts.items():
        for k in range(2, len(term)):
            longest[term[:k]] = max(n, longest.get(term[:k], 0))
    entries: dict[str, float] = {}
    for term in sorted(weights, key=lambda x: (len(x), x)):
        inside = any(term[:k] in entries for k in range(2, len(term)))
        if not inside and counts[term] > FAMILY * longest.get(term, 0):
            entries[term] = weights[term]
    beginnings = [e for e in entries if not e.endswith(" ")]
    exceptions: list[str] = []
    if beginnings:
        clean = terms.filter((F.col("t_docs") == 0) & (F.col("docs") >= 3) & F.col("term").endswith(" "))
        inside = F.lit(False)
        for size in sorted({len(b) for b in beginnings}):
            inside = inside | F.substring("term", 1, size).isin([b for b in beginnings if len(b) == size])
        found = clean.filter(inside).collect()
        exceptions = [r["term"] for r in found if r["term"] not in entries]
    model = Model(entries, tuple(exceptions), 0.0, 1.0, 1.0)
    return _fitted(model, sample)


def _fitted(model: Model, sample: DataFrame) -> Model:
    """The model with a logistic curve fitted to the sample by Newton steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches, 0):
            found = [matched(folded(t), automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f[i] for f in found], pa.float64()) for i in range(3)), batch.column(1)],
                ["weight", "hits", "words", "toxic"],
            )

    rows = np.array(
        sample.mapInArrow(run, "weight double, hits double, words double, toxic int").collect(), dtype=float
    ).reshape(-1, 4)
    x = np.column_stack([np.ones(len(rows)), *_features(rows[:, 0], rows[:, 1], rows[:, 2])])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (rows[:, 3] - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.entries, model.exceptions, *(float(b) for b in beta))


def with_scores(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the struct column `out`, added or replaced: score, predicted, weight and hits."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    kind = T.StructType(
        [
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("hits", T.LongType()),
        ]
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches, at):
            scores, weights, hits = [], [], []
            for value in batch.column(at).to_pylist():
                weight, n, words = matched(folded(value or ""), automaton)
                x, y = _features(weight, n, words)
                z = model.bias + model.slope_weight * float(x) + model.slope_hits * float(y)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                weights.append(weight)
                hits.append(n)
            column = pa.StructArray.from_arrays(
                [
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array(weights, pa.float64()),
                    pa.array(hits, pa.int64()),
                ],
                ["score", "predicted", "weight", "hits"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema.names)

    return numbered(docs).mapInArrow(run, schema)
