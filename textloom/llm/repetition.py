"""Repetition inside single documents.

Method: distribution divergence. The histograms of a document's character classes and of the common words of
its language are compared with the references of that language (all of its documents together) by the
Jensen-Shannon distance; documents below a least length are guarded against and get none.

The divergence alone cannot give the share of repeated content: a text of many different words written twice
has exactly the histograms of the text written once. So the operator also measures what is asked for, by
the runs of ``run`` consecutive words that occur more than once in the document; the share of words that lie in
such runs (overlaps count) is ``repeated_share``, and the divergences stand beside it as evidence of how the
repetition shifts the text away from its language.

The share alone can be had without the divergences, which saves the pass over the corpus that counts the references; no query does so.

Defined results: every row gives one row; null and empty texts have no words and a share of 0; the
language of a null or unusual ``lang`` is "und", a reference of its own; languages beyond the ``LANGUAGES`` largest are compared with
one reference of all of these together; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.functions.vectext import Words, code_points, word_runs
from textloom.llm.common import per_chunk, pick

#: Common words of a language that the word histogram has a bin for; one more holds all other words.
COMMON = 100
#: Languages with a reference of their own, the most frequent ones; bounds what goes to the driver. All others share one.
LANGUAGES, OTHERS = 64, "*"
#: lower, upper and other letters, digits, white space, line ends, ASCII punctuation, anything else
CLASSES = 8


def language(lang: Column) -> Column:
    """The primary subtag in lower case; "und" if there is none."""
    tag = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_]|$)", 1))
    return F.when(F.coalesce(tag, F.lit("")).isin("", "und"), "und").otherwise(tag)


@lru_cache(1)
def class_table() -> np.ndarray:
    out = np.full(0x110000, 7, np.int8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 0 if s.islower() else 1 if s.isupper() else 2
        elif s.isalnum():
            out[c] = 3
        elif s.isspace():
            out[c] = 5 if s in "\n\r" else 4
        elif c < 128:
            out[c] = 6
    return out


def class_counts(texts: list[str]) -> np.ndarray:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lens)
    return np.bincount(doc * CLASSES + class_table()[code_points("".join(texts))], minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)


def repeated_words(words: Words, run: int) -> np.ndarray:
    """Of each text, the words that lie in a run of ``run`` words that occurs more than once in it."""
    h, at = word_runs(words, run)
    if not len(h):
        return np.zeros(words.n_docs, np.int64)
    doc = words.doc[at]
    o = np.lexsort((h, doc))
    same = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    again = np.zeros(len(h), bool)
    again[o[1:][same]] = True
    again[o[:-1][same]] = True
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + run, -1)
    hit = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.doc[hit], minlength=words.n_docs)


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance, 0 to 1, of each row's distribution from the reference's row."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q))
    return np.sqrt(np.clip(kl / 2, 0, 1))


def _count_rows(it):
    """(language, kind, id, count): kind 0 character classes, 1 words; merged over a few million words before they leave the task."""
    schema = pa.schema([("language", pa.string()), ("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
    chars: dict[str, np.ndarray] = {}
    words: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush():
        for name, parts in words.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(np.ones(len(h), np.int8)), pa.array(h.view(np.int64)), pa.array(n)], schema=schema)
        words.clear()

    def rows(batch: pa.RecordBatch) -> None:
        nonlocal held
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names = np.array(batch.column("language").to_pylist(), object)
        counts, w = class_counts(texts), Words([t.lower() for t in texts])
        for name in set(names.tolist()):
            mine = names == name
            chars[name] = chars.get(name, 0) + counts[mine].sum(axis=0)
            words.setdefault(name, []).append(w.hash[mine[w.doc]])
        held += len(w.hash)

    split = per_chunk(rows)
    for batch in it:
        list(split(iter([batch])))
        if held > 2_000_000:
            yield from flush()
            held = 0
    yield from flush()
    for name, n in chars.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * CLASSES), pa.array(np.zeros(CLASSES, np.int8)), pa.array(np.arange(CLASSES)), pa.array(n)], schema=schema)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language: character class counts, hashes of its common words (sorted), counts of these and of all other words."""
    counts = docs.select("language", "text").mapInArrow(_count_rows, "language string, kind byte, id long, n long")
    counts = materialize(counts.groupBy("language", "kind", "id").agg(F.sum("n").alias("n")), "language-counts")
    sizes = counts.where("kind = 0").groupBy("language").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "language").limit(LANGUAGES + 1)
    kept = [r["language"] for r in sizes.collect()]
    if len(kept) > LANGUAGES:
        kept = kept[:LANGUAGES]
        name = F.when(F.col("language").isin(kept), F.col("language")).otherwise(OTHERS)
        counts = counts.groupBy(name.alias("language"), "kind", "id").agg(F.sum("n").alias("n"))
        kept.append(OTHERS)
    top = counts.where("kind = 1").withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "id"))).where(F.col("r") <= COMMON).drop("r")
    total = {r["language"]: r["n"] for r in counts.where("kind = 1").groupBy("language").agg(F.sum("n").alias("n")).collect()}
    rows = counts.where("kind = 0").unionByName(top).collect()
    out = {}
    for name in kept:
        chars = np.zeros(CLASSES, np.int64)
        words = sorted((r["id"], r["n"]) for r in rows if r["language"] == name and r["kind"] == 1)
        for r in rows:
            if r["language"] == name and r["kind"] == 0:
                chars[r["id"]] = r["n"]
        n = np.array([c for _, c in words], np.int64)
        h = np.array([i for i, _ in words], np.int64).view(np.uint64)
        o = np.argsort(h)
        out[name] = chars, h[o], np.r_[n[o], total.get(name, 0) - n.sum()]
    return out


def _measure_rows(refs: dict, run: int, min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("repeated_words", pa.int64()), ("js_chars", pa.float64()), ("js_words", pa.float64())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names = [x if x in refs else OTHERS for x in batch.column("language").to_pylist()]
        w = Words([t.lower() for t in texts])
        chars, n = class_counts(texts), w.counts
        far = np.full((2, len(texts)), np.nan)
        for name in set(names) & refs.keys():
            c, h, words = refs[name]
            mine = np.array([x == name for x in names]) & (n >= min_words)
            at = np.flatnonzero(mine)
            if not len(at):
                continue
            ours = mine[w.doc]
            slot = np.minimum(np.searchsorted(h, w.hash[ours]), len(h) - 1)
            slot[h[slot] != w.hash[ours]] = len(h)
            doc = np.searchsorted(at, w.doc[ours])
            hist = np.bincount(doc * (len(h) + 1) + slot, minlength=len(at) * (len(h) + 1)).reshape(len(at), -1)
            far[0, at] = jensen_shannon(chars[at], c[None])
            far[1, at] = jensen_shannon(hist, words[None])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(repeated_words(w, run)), *(pa.array(x, from_pandas=True) for x in far)], schema=schema)

    return per_chunk(f)


def _share_rows(run: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words([(t or "").lower() for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(w.counts), "repeated_words": pa.array(repeated_words(w, run))})

    return per_chunk(f)


def repetition(docs: DataFrame, run: int = 5, min_words: int = 20, divergence: bool = True) -> DataFrame:
    """``doc_id, n_words, repeated_words, repeated_share`` and, with ``divergence``, ``js_chars, js_words`` of every row of ``doc_id, text, lang``."""
    docs = pick(docs, "doc_id", "text", "lang")
    share = F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(0.0).alias("repeated_share")
    if not divergence:
        rows = docs.select("doc_id", "text").mapInArrow(_share_rows(run), "doc_id long, n_words long, repeated_words long")
        return rows.select("doc_id", "n_words", "repeated_words", share)
    docs = docs.select("doc_id", "text", language(F.col("lang")).alias("language"))
    rows = docs.mapInArrow(_measure_rows(references(docs), run, min_words), "doc_id long, n_words long, repeated_words long, js_chars double, js_words double")
    return rows.select("doc_id", "n_words", "repeated_words", share, "js_chars", "js_words")


def repetitive(measured: DataFrame, share: float = 0.5, min_words: int = 20) -> DataFrame:
    return measured.where((F.col("n_words") >= min_words) & (F.col("repeated_words") >= share * F.col("n_words")))
