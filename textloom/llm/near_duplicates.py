"""Near-duplicates: texts whose sets of word runs are similar, across a collection too large to compare pairwise.

Method: binary fingerprints in a hierarchical index in Gray order (see ``gray_index``).

1. Texts of the same words in the same order form a class; one row stands for it from here on, and
   copies are never paired. Within a task they are merged before the shuffle.
2. A class gets a fingerprint of 128 bits from min-hashes of its runs of three words; two classes
   of similarity s differ in about 64 (1-s) bits. The radius lies 4.5 standard deviations above what the
   threshold gives; by the binomial tail about 20 in a million pairs at 0.6 and 22 at 0.8 are lost by it.
3. At this radius, 45 of 128 bits for 0.6, a tree over all fingerprints prunes nothing: unrelated ones differ in 64 bits, and
   upper nodes share only the first few. So the top level of the index factors out masked patterns first: all bits of a band
   of ``ROWS`` min-hashes, once for each of ``BANDS`` masks. Classes at similarity s share at least one of these nodes with
   probability 1-(1-s^ROWS)^BANDS: 0.99996 at 0.6, more above. Below every such node the fingerprints
   are sorted by Gray rank, upper nodes keep shared bit patterns, and whole groups are pruned by
   accumulated differences, whatever the node's size.
4. A node with very many classes is found from a sample (which decides only how the work is split). Its mask is lengthened by
   each band of a second family of min-hashes, so that its classes are dealt to nodes by similarity instead of being compared with each other; a pair
   at 0.6 is kept by this with probability 0.99996 once more. A node that is still as large holds classes that agree in six min-hashes. It is a dense cluster
   whose links are the result; it is cut into blocks in Gray order, which are joined two by two in many tasks.
5. The pairs left are verified exactly on their sets of word runs.

Defined results: null, empty and short texts (fewer than ``min_words`` words) and rows without ``doc_id`` take no part; an empty
table gives no rows; rows that repeat a ``doc_id`` are one document (with several texts, it may be
in several classes); further columns are ignored. Ties at the threshold count as similar.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.functions.vectext import BASE, U, Words, mix, powers, spans_of, word_runs
from textloom.llm.common import buckets, per_chunk, pick
from textloom.llm.gray_index import gray_rank, join_groups, join_sides

BANDS, ROWS, BITS = 42, 3, 128
#: One class in so many is looked at to find patterns that very many classes share.
SAMPLE = 64
#: Classes below one node from which it is cut into blocks.
HOT_ROWS = 40_000
#: Classes of one cluster whose texts are compared with those of another such cell in one place.
CELL = 100

#: Copies of one text beyond which the pairs among them are made in several tasks.
COPIES = 1000

_SEEDS = np.arange(1, 2 * BITS + 1, dtype=U)
_MUL = (mix(_SEEDS * U(BASE)) | U(1)).reshape(2, BITS)
_ADD = mix(_SEEDS * U(0xC2B2AE3D27D4EB4F)).reshape(2, BITS)


def radius_of(threshold: float) -> int:
    """Bits in which fingerprints at the threshold differ, plus 4.5 standard deviations."""
    p = (1 - threshold) / 2
    return math.floor(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p)))


def classes_of(words: Words) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words."""
    p = np.zeros(len(words.hash) + 1, U)
    pw, inv = powers(len(p))
    np.cumsum(mix(words.hash ^ U(0xA0761D6478BD642F)) * pw[:-1], out=p[1:])
    a, b = words.first[:-1], words.first[1:]
    return mix((p[b] - p[a]) * inv[np.minimum(a, len(p) - 1)] + (b - a).astype(U))


def signatures(shingles: np.ndarray, first: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and fingerprints (texts x 2 words) of one of the two families; text t has shingles from first[t] on, at least one."""
    n = len(first)
    low = np.empty((BITS, n), U)
    buf = np.empty(len(shingles), U)
    for i in range(BITS):
        np.multiply(shingles, _MUL[family, i], out=buf)
        buf += _ADD[family, i]
        np.minimum.reduceat(buf, first, out=low[i])
    low = mix(low)
    keys = np.zeros((n, BANDS), U)
    for b in range(BANDS):
        h = np.full(n, U(b + 1))
        for v in low[b * ROWS : (b + 1) * ROWS]:
            h = mix(h * U(BASE) + v)
        keys[:, b] = h
    bits = ((low * U(BASE)) >> U(63)).T
    at = np.arange(63, -1, -1, dtype=U)
    return keys, np.stack([(bits[:, w * 64 : (w + 1) * 64] << at).sum(axis=1, dtype=U) for w in range(BITS // 64)], axis=1)


def _words(batch: pa.RecordBatch) -> Words:
    return Words([(t or "").lower() for t in batch.column("text").to_pylist()])


def _class_rows(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int64())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _words(batch)
        ok = np.flatnonzero(w.counts >= min_words)
        return pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[ok]), pa.array(classes_of(w)[ok].view(np.int64))], schema=schema)

    return per_chunk(f)


def _entry_rows(min_words: int, n: int, n_buckets: int, sample: int = 1, family: int = 0):
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("class", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])

    def run(it):
        seen: set[int] = set()  # of this task's rows; it only spares work, so it may be forgotten

        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if len(seen) > 1_000_000:
                seen.clear()
            w = _words(batch)
            runs, at = word_runs(w, n)
            cls = classes_of(w)
            take = []
            for t in np.flatnonzero(w.counts >= max(min_words, n)).tolist():
                c = int(cls[t])
                if c not in seen and (sample == 1 or c % sample == 0):
                    seen.add(c)
                    take.append(t)
            if not take:
                return None
            doc = w.doc[at]
            keep = np.zeros(w.n_docs, bool)
            keep[take] = True
            runs, doc = runs[keep[doc]], doc[keep[doc]]
            keys, f = signatures(runs, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), family)
            key = keys.ravel()
            rep = lambda x: pa.array(np.repeat(x, BANDS).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array((key % U(n_buckets)).astype(np.int32)), pa.array(key.view(np.int64)), rep(cls[take]), rep(f[:, 0]), rep(f[:, 1])], schema=schema)

        yield from per_chunk(f)(it)

    return run


_ENTRY = "bucket int, key long, class long, f1 long, f2 long"


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = {x: t.column(x).to_numpy() for x in ("key", "class", "f1", "f2")}
    return c["key"], c["class"], np.stack([c["f1"], c["f2"]], axis=1).view(U)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    o = np.lexsort((hi, lo))
    lo, hi = lo[o], hi[o]
    new = lo != hi
    new[1:] &= (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return pa.table({"a": lo[new], "b": hi[new]})


def _bucket_join(radius: int):
    def f(t: pa.Table) -> pa.Table:
        key, cls, fp = _columns(t)
        order = np.lexsort((cls, key))  # copies that different tasks saw
        order = order[np.r_[True, (key[order][1:] != key[order][:-1]) | (cls[order][1:] != cls[order][:-1])]]
        key, cls, fp = key[order], cls[order], fp[order]
        i, j = join_groups(key, fp, radius)
        return _pairs(cls[i], cls[j])

    return f


def _block_join(radius: int):
    def f(t: pa.Table) -> pa.Table:
        _, cls, fp = _columns(t)
        side = t.column("side").to_numpy()
        x, y = (np.flatnonzero(side == s) for s in (0, 1))
        x, y = (at[np.unique(cls[at], return_index=True)[1]] for at in (x, y))
        if not len(x):
            return _pairs(cls[:0], cls[:0])
        if len(y):
            i, j = join_sides(fp[x], fp[y], radius)
            return _pairs(cls[x[i]], cls[y[j]])
        i, j = join_groups(np.zeros(len(x), np.int64), fp[x], radius)
        return _pairs(cls[x[i]], cls[x[j]])

    return f


def _rank_rows(it):
    for b in it:
        f = np.stack([b.column("f1").to_numpy(), b.column("f2").to_numpy()], axis=1).view(U)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array((gray_rank(f)[:, 0] >> U(56)).astype(np.int64))], [*b.schema.names, "prefix"])


def _hot_pairs(entries: DataFrame, second: DataFrame, radius: int, hot_rows: int) -> DataFrame:
    """Pairs below the nodes with very many classes: each such node's mask is lengthened by every band of the ``second`` family."""
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    entries = materialize(entries.dropDuplicates(["key", "class"]).select("key", "class", "f1", "f2"), "hot-entries")
    more = second.join(entries.select("class").distinct(), "class", "left_semi").select("class", F.col("key").alias("key2")).distinct()
    rows = entries.join(more, "class").select(F.xxhash64("key", "key2").alias("key"), "class", "f1", "f2")
    rows = materialize(rows.select(F.lit(0).alias("bucket"), "key", "class", "f1", "f2"), "longer-masks")
    n_buckets = buckets(rows.count())
    dense = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"), "dense-nodes")
    apart = rows.withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int"))
    if not dense.take(1):
        return apart.groupBy("bucket").applyInArrow(_bucket_join(radius), "a long, b long")
    found = apart.join(dense, "key", "left_anti").groupBy("bucket").applyInArrow(_bucket_join(radius), "a long, b long")
    return found.unionByName(_dense_pairs(rows.join(dense, "key", "left_semi").select(*names), radius, hot_rows))


def _dense_pairs(entries: DataFrame, radius: int, hot_rows: int) -> DataFrame:
    """Pairs below the nodes of dense clusters: blocks in Gray order, salted where one still is too large, joined two by two."""
    block_rows = max(1, hot_rows // 4)
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    rows = materialize(entries.mapInArrow(_rank_rows, _ENTRY + ", prefix long"), "dense-entries")
    parts = rows.groupBy("key", "prefix").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("salts"))
    rows = rows.join(parts, ["key", "prefix"]).withColumn("block", F.col("prefix") * 1_000_000 + F.pmod(F.xxhash64("class"), "salts"))
    blocks = rows.select("key", "block").distinct()
    met = blocks.select("key", F.col("block").alias("p")).join(blocks.select("key", F.col("block").alias("q")), "key").where("p <= q")
    met = materialize(met, "block-pairs")
    cols = [*names, "p", "q"]
    left = rows.join(met.withColumn("block", F.col("p")), ["key", "block"]).select(*cols, F.lit(0).alias("side"))
    right = rows.join(met.where("p < q").withColumn("block", F.col("q")), ["key", "block"]).select(*cols, F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("key", "p", "q").applyInArrow(_block_join(radius), "a long, b long")


def _own_text_rows(it):
    """Keeps texts that belong to their class: a repeated ``doc_id`` may have brought another one along."""
    schema = pa.schema([("class", pa.int64()), ("text", pa.string())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = classes_of(_words(batch)).view(np.int64) == batch.column("class").to_numpy()
        return pa.RecordBatch.from_arrays([c.filter(pa.array(own)) for c in (batch.column("class"), batch.column("text"))], schema=schema)

    yield from per_chunk(f)(it)


def _verified(n: int, threshold: float):
    least = Fraction(str(threshold))

    def f(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        classes, bodies = texts.column("class").to_pylist(), [t.lower() for t in texts.column("text").to_pylist()]
        for lo, hi in spans_of(bodies):
            w = Words(bodies[lo:hi])
            runs, at = word_runs(w, n)
            cut = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
            sets |= {c: np.unique(runs[cut[i] : cut[i + 1]]) for i, c in enumerate(classes[lo:hi])}
        rows = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            s, t = sets[a], sets[b]
            if min(len(s), len(t)) * least.denominator < max(len(s), len(t)) * least.numerator:
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            either = len(s) + len(t) - both
            if both * least.denominator >= either * least.numerator:
                rows.append((a, b, both / either))
        a, b, similarity = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    return f


def _verify(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach the threshold on their sets of word runs.

    Texts are not sent along with every pair. Classes with the same smallest partner lie close together; each such cluster is cut into cells of
    about ``CELL`` classes, and a text goes once to each pair of cells that has a pair of it: in a dense cluster a hundredth as often.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("m")).select("class", F.least("class", "m").alias("low"))
    salts = low.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("salts"))
    cells = low.join(salts, "low").select("class", F.xxhash64("low", F.pmod(F.xxhash64("class"), "salts")).alias("cell"))
    cells = materialize(cells, "cells")
    x, y = (cells.select(F.col("class").alias(c), F.col("cell").alias(f"cell_{c}")) for c in "ab")
    placed = materialize(pairs.join(x, "a").join(y, "b").select(F.xxhash64("cell_a", "cell_b").alias("at"), "a", "b"), "placed")
    needed = placed.select("at", F.explode(F.array("a", "b")).alias("class")).distinct()
    bucket = F.pmod("at", F.lit(buckets(needed.count(), 1000))).alias("bucket")
    sent = needed.select(bucket, "class").distinct().join(texts, "class")
    return placed.select(bucket, "a", "b").groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_verified(n, threshold), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 20, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``doc_id, class`` of every document of at least ``min_words`` words, and ``a, b, similarity`` of every pair of similar classes.

    Documents of one class have the same words in the same order. The links are between classes, a < b. Texts shorter than a run of ``shingle``
    words have a class, but no links: they are similar only to their copies.
    """
    docs = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    members = materialize(docs.mapInArrow(_class_rows(min_words), "doc_id long, class long").distinct(), "members")
    classes = members.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    n_buckets = buckets(members.count() * BANDS)
    radius = radius_of(threshold)
    # The sample counts classes; a node of more than hot_rows of them shows up with hot_rows / sample.
    seen = docs.mapInArrow(_entry_rows(min_words, shingle, n_buckets, sample), _ENTRY).groupBy("key").agg(F.count_distinct("class").alias("n"))
    hot = materialize(seen.where(F.col("n") * sample > hot_rows).select("key"), "hot-nodes")
    entries = docs.mapInArrow(_entry_rows(min_words, shingle, n_buckets), _ENTRY)
    if hot.take(1):
        cold = entries.join(hot, "key", "left_anti")
        pairs = cold.groupBy("bucket").applyInArrow(_bucket_join(radius), "a long, b long")
        second = docs.mapInArrow(_entry_rows(min_words, shingle, n_buckets, family=1), _ENTRY)
        pairs = pairs.unionByName(_hot_pairs(entries.join(hot, "key", "left_semi"), second, radius, hot_rows))
    else:
        pairs = entries.groupBy("bucket").applyInArrow(_bucket_join(radius), "a long, b long")
    pairs = materialize(pairs.distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class")
    own = needed.join(docs, "doc_id").select("class", "text").mapInArrow(_own_text_rows, "class long, text string")
    texts = materialize(own.groupBy("class").agg(F.first("text").alias("text")), "texts")
    links = materialize(_verify(pairs, texts, shingle, threshold), "links")
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id_a < doc_id_b``: every pair of documents of one class or of linked classes.

    The pairs among the copies of one text are as many as the square of the copies. A text of many copies is salted, so that they are made in many tasks.
    """
    x = members.select(F.col("class").alias("a"), F.col("doc_id").alias("i"))
    y = members.select(F.col("class").alias("b"), F.col("doc_id").alias("j"))
    across = links.join(x, "a").join(y, "b").where("i <> j")
    n = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("a"), F.ceil(F.col("n") / COPIES).alias("salts"))
    several = materialize(x.join(n, "a"), "copies")
    left = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("a", "i", "salt")
    right = several.select(F.col("a").alias("b"), F.col("i").alias("j"), F.pmod(F.xxhash64("i"), "salts").alias("to"))
    within = left.join(right, F.expr("a = b and salt = to and i < j"))
    return across.select("i", "j").unionByName(within.select("i", "j")).select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of the undirected graph ``a, b``.

    Alternating star contraction: every node points to the smallest of its neighbours, first for larger,
    then for smaller ones, until nothing changes; the rounds grow with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "edges")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicate_groups(members: DataFrame, links: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``doc_id, group_id, links``: every document, the smallest document of its group, and the number of classes linked to its own.

    With ``docs``, documents without a class (no text, or fewer than ``min_words`` words) have a row as well: each is a group of its own.
    """
    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    rows = members.join(found, members["class"] == found["node"], "left").select("doc_id", "class", F.coalesce("component", "class").alias("component"))
    rows = rows.join(degree, "class", "left").fillna(0, ["links"])
    rows = rows.join(rows.groupBy("component").agg(F.min("doc_id").alias("group_id")), "component").select("doc_id", "group_id", "links")
    if docs is None:
        return rows
    every = docs.select("doc_id").where("doc_id is not null").distinct()
    return every.join(rows, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
