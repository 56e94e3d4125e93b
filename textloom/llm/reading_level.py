"""Reading level of documents.

Method: word acquisition grades. Documents with human grades give each word a distribution over grades
(the share of a grade's documents that use it); the grade at which half of it is reached is the word's
acquisition grade. A document's level is predicted from quantiles of the grades of its known words,
calibrated by linear regression on labelled documents that the word grades were not taken from.

Limits of the sentence count: initials (``J. Smith``), abbreviations that are not in the list, and those that happen to end a sentence count as
written there; the README has figures.

The fit takes at most ``FIT_DOCS`` labelled documents, chosen by the hash of their id; everything else covers
all documents and whole texts. The operator also gives the surface measures of a text: words, sentences and long words. What is asked of these alone
(``demanding``) can't be had from a level and needs no fit (``surface``); the queries predict the level all the same.

Defined results: every row gives one row; null and empty texts have no words, no sentences and no level; a document
without known words, or a table without usable labels, has the level null; stray grades (outside 1 to 20) and
repeated label rows count for nothing more; raters who differ are reduced to their median.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.functions.vectext import BASE, Words, code_points, prefix_hash, segment_hash
from textloom.llm.common import per_chunk, pick

FIT_DOCS = 20_000
#: Labelled documents that a word must stand in to be known.
MIN_DOCS = 4
QUANTILES = (0.25, 0.5, 0.75, 0.9)
GRADES = 20
#: Common abbreviations of English, German, French and Spanish prose, in lower case; their dot ends no sentence. Forms that also end sentences as
#: words (``no.``, ``st.``) and initials are not among them.
ABBREVIATIONS = (
    "fig figs vol vols cf resp approx i.e e.g ed eds chap ch sec etc vs pp ibid dr mr mrs ms prof jr rev dept univ a.m p.m u.s u.k u.n ph.d "
    "art ca bd abb vgl bzw z.b d.h u.a u.ä o.ä s.o s.u nr hrsg evtl ggf inkl zzgl usw bspw sog str tel "
    "env p.ex mm mme mlle apr éd "
    "aprox cap núm pág págs sr sra srta ud uds ee.uu p.ej"
).split()
#: The same with a space between the parts.
SPACED = (("z", "b"), ("d", "h"), ("u", "a"), ("p", "ex"), ("p", "ej"), ("i", "e"), ("e", "g"))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points that are white space; sorted hashes of the abbreviations, and of the spaced forms."""

    def hashes(words: list[str]) -> np.ndarray:
        ends = np.cumsum([len(a) for a in words])
        return segment_hash(prefix_hash(code_points("".join(words))), ends - [len(a) for a in words], ends)

    space = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return space, np.sort(hashes(ABBREVIATIONS)), np.sort(_joint(*(hashes([p[i] for p in SPACED]) for i in (0, 1))))


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(BASE) + b


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def sentence_counts(w: Words) -> np.ndarray:
    """Sentences with at least one word of each text. ``w`` holds lower-case texts."""
    space, abbreviations, spaced = _tables()
    cp = w.cp
    if not len(cp) or not len(w.start):
        return np.zeros(w.n_docs, np.int64)
    blank = space[cp]
    after = np.r_[blank[1:], True]
    dot = (cp == 46) & after
    dots = np.flatnonzero(dot)
    if len(dots):
        # The run of letters, digits and dots that the dot closes, without leading dots.
        part = w.alnum | (cp == 46)
        breaks = np.flatnonzero(~part)
        run = np.searchsorted(breaks, dots)
        start = np.where(run > 0, breaks[np.maximum(run - 1, 0)] + 1, 0)
        solid = np.flatnonzero(w.alnum)
        start = np.minimum(solid[np.minimum(np.searchsorted(solid, start), len(solid) - 1)], dots)
        h = segment_hash(prefix_hash(cp), start, dots)
        known = _among(h, abbreviations)
        pair = (start[1:] == dots[:-1] + 2) & _among(_joint(h[:-1], h[1:]), spaced)
        known[:-1] |= pair
        known[1:] |= pair
        dots = dots[~known]
    marks = np.flatnonzero(((cp == 33) | (cp == 63)) & after)
    lines = np.flatnonzero(cp == 10)
    solid_before = np.cumsum(~blank)
    empty = lines[1:][solid_before[lines[1:]] == solid_before[lines[:-1]]]
    ends = np.sort(np.concatenate([dots, marks, empty]))
    sentence = np.searchsorted(ends, w.start)
    new = np.r_[True, (sentence[1:] != sentence[:-1]) | (w.doc[1:] != w.doc[:-1])]
    return np.bincount(w.doc[new], minlength=w.n_docs)


@dataclass
class Levels:
    """Acquisition grades of known words (sorted hashes), and the calibration of the quantiles."""

    words: np.ndarray
    grades: np.ndarray
    weights: np.ndarray

    def quantiles(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Known words of each text, and the quantiles of their grades (NaN without any)."""
        out = np.full((w.n_docs, len(QUANTILES)), np.nan)
        if not len(self.words) or not len(w.hash):
            return np.zeros(w.n_docs, np.int64), out
        slot = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        known = self.words[slot] == w.hash
        doc, grade = w.doc[known], self.grades[slot[known]]
        grade = grade[np.lexsort((grade, doc))]
        n = np.bincount(doc, minlength=w.n_docs)
        first = np.cumsum(n) - n
        at = np.flatnonzero(n)
        for i, q in enumerate(QUANTILES):
            out[at, i] = grade[first[at] + np.floor(q * (n[at] - 1)).astype(np.int64)]
        return n, out

    def predict(self, quantiles: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(quantiles), np.nan)
        return np.clip(self.weights[0] + quantiles @ self.weights[1:], 1, GRADES)


def _word_grade_rows(it):
    schema = pa.schema([("word", pa.int64()), ("grade", pa.int32())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words([t.lower() for t in batch.column("text").to_pylist()])
        pairs = np.unique(np.stack([w.doc, w.hash.view(np.int64)], axis=1), axis=0)
        grade = batch.column("grade").to_numpy()[pairs[:, 0]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(grade.round().astype(np.int32))], schema=schema)

    yield from per_chunk(f)(it)


def _quantile_rows(levels: Levels):
    schema = pa.schema([("grade", pa.float64()), ("q", pa.list_(pa.float64()))])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, q = levels.quantiles(Words([t.lower() for t in batch.column("text").to_pylist()]))
        at = np.flatnonzero(n >= 20)
        return pa.RecordBatch.from_arrays([batch.column("grade").take(pa.array(at)), pa.array(q[at].tolist(), pa.list_(pa.float64()))], schema=schema)

    return per_chunk(f)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: the median of its raters' plausible grades."""
    labels = pick(labels, "doc_id", "rater", "reading_grade", "rated_ts")
    good = labels.where(F.col("reading_grade").between(1, GRADES) & F.col("doc_id").isNotNull()).distinct()
    return good.groupBy("doc_id").agg(F.percentile("reading_grade", F.lit(0.5)).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, min_docs: int = MIN_DOCS) -> Levels:
    """Word grades from two thirds of the labelled documents, calibration on the rest."""
    chosen = graded(labels).withColumn("u", F.xxhash64("doc_id")).orderBy("u", "doc_id").limit(fit_docs)
    # At most fit_docs rows, so the texts need no shuffle.
    sample = materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "graded")
    learn, calibrate = (sample.where(F.pmod("u", F.lit(3)) < 2), sample.where(F.pmod("u", F.lit(3)) == 2))
    per_grade = {r["g"]: r["n"] for r in learn.groupBy(F.round("grade").cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = learn.select("text", "grade").mapInArrow(_word_grade_rows, "word long, grade int").groupBy("word", "grade").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("all", F.sum("n").over(Window.partitionBy("word"))).where(F.col("all") >= min_docs).drop("all")
    # Bounded by the sample: a kept word stands in min_docs of at most fit_docs documents.
    rows = kept.toPandas()
    if rows.empty:
        return Levels(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    word, slot = np.unique(rows["word"].to_numpy().view(np.uint64), return_inverse=True)
    share = np.zeros((len(word), GRADES + 1))
    share[slot, rows["grade"]] = rows["n"] / rows["grade"].map(per_grade)
    reached = np.cumsum(share, axis=1) / share.sum(axis=1, keepdims=True)
    g = np.argmax(reached >= 0.5, axis=1)
    before = np.where(g > 0, reached[np.arange(len(g)), np.maximum(g - 1, 0)], 0)
    grade = g - 0.5 + (0.5 - before) / np.maximum(reached[np.arange(len(g)), g] - before, 1e-9)
    levels = Levels(word, grade, np.zeros(0))
    held = calibrate.select("text", "grade").mapInArrow(_quantile_rows(levels), "grade double, q array<double>").toPandas()
    if len(held) > 2 * len(QUANTILES):
        x = np.c_[np.ones(len(held)), np.array(held["q"].tolist())]
        ridge = np.diag([0.0] + [1e-3 * len(held)] * len(QUANTILES))
        levels.weights = np.linalg.solve(x.T @ x + ridge, x.T @ held["grade"].to_numpy())
    return levels


def _measure(w: Words, long_word: int) -> dict[str, pa.Array]:
    long_words = np.bincount(w.doc[w.end - w.start >= long_word], minlength=w.n_docs)
    return {"n_words": pa.array(w.counts), "n_sentences": pa.array(sentence_counts(w)), "long_words": pa.array(long_words)}


def _level_rows(levels: Levels | None, long_word: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words([(t or "").lower() for t in batch.column("text").to_pylist()], hashed=levels is not None)
        out = {"doc_id": batch.column("doc_id")} | _measure(w, long_word)
        if levels is not None:
            known, q = levels.quantiles(w)
            out |= {"known_words": pa.array(known), "level": pa.array(levels.predict(q), from_pandas=True)}
        return pa.RecordBatch.from_pydict(out)

    return per_chunk(f)


_SURFACE = "doc_id long, n_words long, n_sentences long, long_words long"


def reading_levels(docs: DataFrame, labels: DataFrame, long_word: int = 9, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id, n_words, n_sentences, long_words, known_words, level`` of every row of ``docs``."""
    docs = pick(docs, "doc_id", "text")
    levels = fit(docs, labels, fit_docs)
    return docs.mapInArrow(_level_rows(levels, long_word), _SURFACE + ", known_words long, level double")


def surface(docs: DataFrame, long_word: int = 9) -> DataFrame:
    """``doc_id, n_words, n_sentences, long_words`` of every row of ``docs``: the measures alone, in one pass without labels."""
    return pick(docs, "doc_id", "text").mapInArrow(_level_rows(None, long_word), _SURFACE)


def demanding(levels: DataFrame, min_words: int = 60, sentence: int = 24, long_tenths: int = 3) -> DataFrame:
    """Texts of long sentences and many long words: at least ``sentence`` words each, and so many tenths of the words."""
    return levels.where((F.col("n_words") >= min_words) & (F.col("n_words") >= sentence * F.col("n_sentences")) & (10 * F.col("long_words") >= long_tenths * F.col("n_words")))
