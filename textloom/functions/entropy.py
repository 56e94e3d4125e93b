"""Entropy of texts: of single symbols, and of the symbol that follows a context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits(n: Column, total: Column) -> Column:
    """Contribution of a symbol of frequency n to the entropy of a total, in bits."""
    return -(n / total) * F.log2(n / total)


def gram_counts(docs: DataFrame, k: int) -> DataFrame:
    """``context, symbol, n``: each byte of a text after the k bytes before it, packed as numbers; contexts don't cross documents.

    Counted within each task before the shuffle; at most 256 ** (k + 1) rows can come out of it, k <= 6.
    """
    if not 0 <= k <= 6:
        raise ValueError("0 <= k <= 6")
    schema = pa.schema([("context", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])

    def f(it):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v >> 8), pa.array((v & 255).astype(np.int32)), pa.array(n)], schema=schema)

        for batch in it:
            for t in batch.column("text").to_pylist():
                b = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                if len(b) > k:
                    v = np.zeros(len(b) - k, np.int64)
                    for i in range(k + 1):
                        v = v << 8 | b[i : len(b) - k + i]
                    held.append(v)
                    size += len(v)
                    if size > 2_000_000:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(f, "context long, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def conditional_entropy(counts: DataFrame) -> DataFrame:
    """One row ``entropy, contexts``: bits of a symbol given its context, weighted by the contexts' frequencies."""
    per = counts.groupBy("context").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    # sum of n/t log2(t/n) over a context, times t, is t log2 t - sum n log2 n
    out = per.agg(F.sum(F.col("t") * F.log2("t") - F.col("s")).alias("e"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("contexts"))
    return out.select(F.coalesce(F.col("e") / F.col("t"), F.lit(0.0)).alias("entropy"), "contexts")
