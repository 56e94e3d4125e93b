"""Mixing sources to target weights.

Method: Pareto order sampling. Of the copies a document is expected to contribute, the whole part is certain; the
fraction is its inclusion probability. Documents are ranked by random odds divided by inclusion odds,
u/(1-u) over p/(1-p), and the first ones are taken until the source has its tokens: a sample of fixed
size with unequal probabilities. u comes from a hash of the id and a seed, so a lost executor redraws the same.

Per source, the driver holds totals and histograms of fixed size only; the rank at which to cut is found by two
levels of bins, only the rows of the last bin are ordered, and one filter takes what lies below the cut.

Defined results: rows that repeat a ``doc_id`` are one document (the largest); rows without ``doc_id`` are not used; documents of null or unlisted sources are not used; a listed source without documents contributes nothing;
null and empty texts have no tokens and are not used; a source that ``max_repeats`` keeps from its share gives
everything, ``max_repeats`` times, and the others keep their proportions; null, negative and zero shares give nothing.
Weights enter the inclusion odds as they are; only the factor common to a source is found from a histogram of the weights.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.llm.common import per_chunk, pick
from textloom.llm.token_budget import plain_name

#: Where the vocabulary of a public byte-level tokenizer lies: a token and its rank in each line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level tokenizers of this kind cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096


def _token_rows(vocabulary: bytes):
    import tiktoken

    def run(it):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict({x: batch.column(x) for x in batch.schema.names if x != "text"} | {"tokens": pa.array(n, pa.int64())})

        yield from per_chunk(f)(it)

    return run


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the column ``text`` replaced by its ``tokens``. The vocabulary (under 2 MB) goes along with the function."""
    docs = docs.drop("tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_token_rows(Path(tokenizer).read_bytes()), f"{fields}, tokens long")


def _scale(tokens: np.ndarray, weight: np.ndarray, most: int, target: float) -> float:
    """The factor with sum(tokens * min(most, factor * weight)) = target, or infinity if all repeats give less."""
    if target >= tokens.sum() * most:
        return math.inf
    order = np.argsort(-weight)  # the heaviest reach the cap first
    t, w = tokens[order].astype(float), weight[order]
    capped = 0.0
    for i in range(len(w)):
        factor = (target - capped * most) / (t[i:] * w[i:]).sum()
        if factor * w[i] <= most:
            return factor
        capped += t[i]
    return math.inf


def _cuts(rows: DataFrame, need: dict[str, float]) -> list[tuple[str, float, int]]:
    """Of ``source, doc_id, z, tokens``: for each source the last (z, doc_id) to take, so that the tokens up to it come nearest to the need."""
    spark = rows.sparkSession
    low, width = {s: -64.0 for s in need}, {s: 128.0 / BINS for s in need}
    left, cuts, rest = dict(need), {}, rows
    last = (1 << 63) - 1
    for _ in range(2):
        open_ = [s for s in need if s not in cuts]
        if not open_:
            break
        bounds = spark.createDataFrame([(s, low[s], width[s]) for s in open_], "source string, low double, width double")
        at = F.floor((F.col("z") - F.col("low")) / F.col("width"))
        binned = rest.join(F.broadcast(bounds), "source").withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int")).drop("low", "width")
        found: dict[str, int] = {}
        for r in binned.groupBy("source", "bin").agg(F.sum("tokens").alias("n")).orderBy("source", "bin").collect():  # sources x BINS at most
            s = r["source"]
            if s not in found:
                if r["n"] > left[s]:
                    found[s] = r["bin"]
                else:
                    left[s] -= r["n"]
        for s in open_:
            if s not in found:
                cuts[s] = (math.inf, last)  # all of it
        if not found:
            return [(s, *c) for s, c in cuts.items()]
        bins = spark.createDataFrame(list(found.items()), "source string, cut int")
        rest = binned.join(F.broadcast(bins), "source").where("bin = cut").drop("bin", "cut")
        for s, b in found.items():
            low[s] += width[s] * b
            width[s] /= BINS
    needs = spark.createDataFrame([(s, left[s]) for s in need if s not in cuts], "source string, need double")
    ordered = Window.partitionBy("source").orderBy("z", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.join(F.broadcast(needs), "source").withColumn("sum", F.sum("tokens").over(ordered))
    ends = rest.groupBy("source").agg(
        F.max(F.when(F.col("sum") - F.col("tokens") / 2 <= F.col("need"), F.struct("z", "doc_id"))).alias("in"), F.min(F.struct("z", "doc_id")).alias("first")
    )
    for r in ends.collect():  # a row for each source
        z, d = r["in"] or r["first"]
        cuts[r["source"]] = (z, d if r["in"] else d - 1)
    return [(s, *c) for s, c in cuts.items()]


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, report). ``docs``: ``doc_id, source, tokens`` and, if wanted, ``weight`` (relative number of copies within its source).

    The selection has ``doc_id, source, tokens, copies`` of every document taken; the report, for each target, its
    share, the tokens wanted and taken, the actual share and the number of documents. ``total`` is the size wanted, by default
    the tokens of all usable documents.
    """
    spark = docs.sparkSession
    if "weight" not in docs.columns:
        docs = docs.withColumn("weight", F.lit(1.0))
    docs, targets = pick(docs, "doc_id", "source", "tokens", "weight"), pick(targets, "source", "target_share", "max_repeats")
    goals = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).orderBy("source").collect()  # a row for each source
    key = {r["source"]: r["k"] for r in targets.select("source", plain_name(F.col("source")).alias("k")).collect()}
    rows = docs.where("doc_id is not null and tokens > 0 and weight > 0").select("doc_id", plain_name(F.col("source")).alias("source"), "tokens", F.col("weight").cast("double").alias("weight"))
    rows = rows.where(F.col("source").isin([*key.values()])).groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "weight")).alias("r")).select("doc_id", "r.*")
    rows = materialize(rows, "sized")
    step = F.greatest(F.lit(-400), F.least(F.lit(400), F.floor(F.log2("weight") * 8))).alias("step")
    held: dict[str, list[tuple[float, int]]] = {}
    for r in rows.groupBy("source", step).agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("weight")).alias("w")).collect():  # sources x 801 at most
        held.setdefault(r["source"], []).append((r["w"] / r["n"], r["n"]))
    total = total if total is not None else sum(n for v in held.values() for _, n in v)
    plan: list[tuple[str, float, int]] = []
    for g in goals:
        k, most = key[g["source"]], max(0, g["most"])
        if k in held and g["share"] > 0 and most:
            w, n = (np.array(x, float) for x in zip(*held[k]))
            factor = _scale(n, w, most, g["share"] * total)
            plan.append((k, float(factor) if factor < math.inf else 1e300, most))
    parts = spark.createDataFrame(plan, "source string, factor double, most int")
    copies = F.least(F.col("most").cast("double"), F.col("factor") * F.col("weight"))
    rows = rows.join(F.broadcast(parts), "source").withColumn("whole", F.floor(copies).cast("int")).withColumn("p", copies - F.floor(copies))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    z = F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p")))  # the logarithm keeps the order
    rows = rows.select("doc_id", "source", "tokens", "whole", "p", F.when(F.col("p") > 0, z).alias("z"))
    open_ = rows.where("p > 0").select("source", "doc_id", "z", "tokens", "p")
    need = {r["source"]: r["n"] for r in open_.groupBy("source").agg(F.sum(F.col("tokens") * F.col("p")).alias("n")).collect()}
    cuts = spark.createDataFrame(_cuts(open_, need) if need else [], "source string, z_cut double, id_cut long")
    drawn = F.coalesce((F.col("z") < F.col("z_cut")) | ((F.col("z") == F.col("z_cut")) & (F.col("doc_id") <= F.col("id_cut"))), F.lit(False))
    chosen = rows.join(F.broadcast(cuts), "source", "left").select("doc_id", "source", "tokens", (F.col("whole") + drawn.cast("int")).alias("copies"))
    chosen = materialize(chosen.where("copies > 0"), "mix")
    sums = {r["source"]: r for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    taken = sum(r["n"] for r in sums.values())
    report = []
    for g in goals:
        r = sums.get(key[g["source"]])
        n = r["n"] if r else 0
        report.append((g["source"], g["share"], int(round(g["share"] * total)), n, n / taken if taken else 0.0, r["docs"] if r else 0))
    return chosen, spark.createDataFrame(report, "source string, target_share double, target_tokens long, tokens long, actual_share double, n_docs long")
