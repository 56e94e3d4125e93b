"""Token budget per source, language and domain.

Method: regression. The tokens of a document are predicted from its bytes, words, digits, punctuation and letters by
script, with weights fitted for each language on tokenised documents; the prediction is applied to every document,
and its totals are corrected by the ratio of true to predicted tokens on holdouts that the fit did not see.

The fit takes about ``SAMPLE_DOCS`` documents of each of at most ``LANGUAGES`` languages (those below a cut through the hashes of the ids, so nothing is
ordered or shuffled to find them), and tokenises them whole; all other figures cover all documents. A language's weights are drawn towards those of all
languages together by a ridge that counts as much as ``PRIOR`` documents: with few documents they stay near them, with many they are the language's own.
Languages beyond the bound take the common weights. The tokenizer is the table of merges: a word (text between
white space) starts with ``▁``, is split into characters, and adjacent pieces are joined in order of rank.

Defined results: null and empty texts have 0 tokens; null names are "(none)", null or unusual languages "und"; several
metadata rows of one document count once (the smallest name); repeated rows of documents count again.
An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectext import code_points
from textloom.llm.common import per_chunk, pick
from textloom.llm.repetition import language

SAMPLE_DOCS, LANGUAGES, PRIOR = 1500, 64, 10
#: Rows of a table of merges that may go to the driver.
MERGES = 1_000_000
#: Text columns of the features: words, digits, punctuation, ASCII letters, other Latin, Greek and Cyrillic, any other script, anything else; bytes come last.
CLASSES, FEATURES = 7, 9


class MergeTokenizer:
    """Counts tokens under a table of (rank, left, right) merges."""

    def __init__(self, merges: list[tuple[int, str, str]]):
        self.rank = {(a, b): r for r, a, b in merges}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            pieces = ["▁", *word]
            while len(pieces) > 1:
                ranks = [self.rank.get(p, 1 << 60) for p in zip(pieces, pieces[1:])]
                best = min(ranks)
                if best == 1 << 60:
                    break
                joined, i = [], 0
                while i < len(pieces):
                    if i < len(ranks) and ranks[i] == best:
                        joined.append(pieces[i] + pieces[i + 1])
                        i += 2
                    else:
                        joined.append(pieces[i])
                        i += 1
                pieces = joined
            if len(self.known) > 200_000:
                self.known.clear()
            n = self.known[word] = len(pieces)
        return n

    def count(self, text: str) -> int:
        return sum(map(self.word, text.split()))


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, 6, np.int8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 2 if c < 128 else 3 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 4 if 0x370 <= c < 0x530 else 5
        elif s.isalnum():
            out[c] = 0
        elif s.isspace():
            out[c] = 7
        elif c < 128 or 0x2010 <= c < 0x2040:
            out[c] = 1
    return out


def features(texts: list[str]) -> np.ndarray:
    """Words, digits, punctuation, four scripts, other characters and bytes of each text."""
    n = len(texts)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    joined = "\n".join(texts) + "\n" if n else ""
    cp = code_points(joined)
    cls = _classes()[cp]
    doc = np.repeat(np.arange(n), lens)
    hist = np.bincount(doc * 8 + cls, minlength=n * 8).reshape(n, 8)[:, :7]
    solid = cls != 7
    words = np.bincount(doc[1:][solid[1:] & ~solid[:-1]], minlength=n) + np.bincount(doc[:1][solid[:1]], minlength=n)
    return np.c_[words, hist, np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, n)].astype(np.float64)


def _sample_rows(merges: list[tuple[int, str, str]]):
    schema = pa.schema([("language", pa.string()), ("u", pa.int64()), ("x", pa.list_(pa.float64())), ("tokens", pa.int64())])
    tokenizer = MergeTokenizer(merges)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        return pa.RecordBatch.from_arrays([batch.column("language"), batch.column("u"), pa.array(features(texts).tolist(), pa.list_(pa.float64())), pa.array([tokenizer.count(t) for t in texts])], schema=schema)

    return per_chunk(f)


def _weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """Least squares without intercept, so that predictions add up over documents; relative errors weigh alike."""
    w = 1 / np.sqrt(np.maximum(y, 20))[:, None]
    a, b = x * w, y * w[:, 0]
    scale = np.maximum(np.sqrt((a**2).sum(axis=0)), 1e-9)
    a = a / scale
    pull = 1e-6 if prior is None else PRIOR / len(y)
    towards = np.zeros(x.shape[1]) if prior is None else prior * scale
    return np.linalg.solve(a.T @ a + pull * np.eye(a.shape[1]), a.T @ b + pull * towards) / scale


def _sample(docs: DataFrame, sample_docs: int) -> tuple[list[str], DataFrame]:
    """The largest languages, and ``text, language, u`` of about ``sample_docs`` documents of each; rows that repeat a ``doc_id`` are one."""
    usable = docs.where("doc_id is not null and length(text) > 0")
    largest = usable.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(LANGUAGES).collect()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    cut = F.lit(0).cast("long")
    for r in largest:
        cut = F.when(F.col("language") == r["language"], F.lit(min(1 << 52, (sample_docs << 52) // r["n"]))).otherwise(cut)
    rows = usable.select("doc_id", "text", "language", u.alias("u")).where(F.col("u") < cut)
    return [r["language"] for r in largest], rows.groupBy("doc_id", "u").agg(F.min(F.struct("language", "text")).alias("r")).select("r.text", "r.language", "u")


def fit(docs: DataFrame, merges: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[dict[str, np.ndarray], DataFrame]:
    """Weights of each language, corrected on its holdout ("" is the model of all the rest), and the report of the holdouts."""
    table = [tuple(r) for r in pick(merges, "merge_rank", "left_piece", "right_piece").where("left_piece is not null and right_piece is not null").limit(MERGES + 1).collect()]
    if len(table) > MERGES:
        raise ValueError(f"more than {MERGES:,} merges")
    kept, rows = _sample(docs, sample_docs)
    # A row of ten numbers for each document of the sample.
    rows = rows.mapInArrow(_sample_rows(table), "language string, u long, x array<double>, tokens long").toPandas()
    models, report = {}, []
    x = np.array(rows["x"].tolist()).reshape(len(rows), FEATURES)
    y, names, hold = rows["tokens"].to_numpy(np.float64), rows["language"].to_numpy(), rows["u"].to_numpy() % 3 == 0
    common = None
    for name in ["", *kept]:
        mine = names == name if name else np.ones(len(rows), bool)
        if not (mine & ~hold).any():
            continue
        w = _weights(x[mine & ~hold], y[mine & ~hold], common)
        common = w if common is None else common
        test = mine & hold if (mine & hold).any() else mine
        predicted = np.maximum(x[test] @ w, 0)
        # The correction of a small holdout is drawn towards 1 in the same way.
        bias = (y[test].sum() + PRIOR * y[test].mean()) / max(predicted.sum() + PRIOR * y[test].mean(), 1e-9) if name else y[test].sum() / max(predicted.sum(), 1e-9)
        models[name] = w * bias
        report.append((name or "(all)", int(mine.sum()), int(test.sum()), float(bias), float(np.abs(predicted * bias - y[test]).sum() / max(y[test].sum(), 1.0))))
    return models, docs.sparkSession.createDataFrame(report, "language string, docs long, holdout_docs long, bias double, relative_error double")


def _estimate_rows(models: dict[str, np.ndarray]):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        x = features(texts)
        none = np.zeros(FEATURES)
        w = np.array([models.get(n, models.get("", none)) for n in batch.column("language").to_pylist()]).reshape(len(texts), FEATURES)
        out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        return pa.RecordBatch.from_pydict(out | {"n_bytes": pa.array(x[:, -1].astype(np.int64)), "milli_tokens": pa.array(np.rint(np.maximum((x * w).sum(axis=1), 0) * 1000).astype(np.int64))})

    return per_chunk(f)


def plain_name(name: Column) -> Column:
    """Names that are spelled variously: letters and digits in lower case."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(key) > 0, key).otherwise("(none)")


def estimates(docs: DataFrame, merges: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, source, language, domain, n_bytes, milli_tokens`` of every row (thousandths of tokens are whole numbers, so totals don't depend on order)."""
    docs = pick(docs, "doc_id", "text", "source", "lang", "domain").select("doc_id", "text", plain_name(F.col("source")).alias("source"), language(F.col("lang")).alias("language"), F.coalesce("domain", F.lit("(none)")).alias("domain"))
    models, _ = fit(docs, merges, sample_docs)
    return docs.mapInArrow(_estimate_rows(models), "doc_id long, source string, language string, domain string, n_bytes long, milli_tokens long")


def pile_names(meta: DataFrame) -> DataFrame:
    """``doc_id, pile_set_name`` of every document that has one."""
    name = F.coalesce(F.get_json_object("metadata", "$.meta.pile_set_name"), F.get_json_object("metadata", "$.pile_set_name"))
    return pick(meta, "doc_id", "metadata").select("doc_id", plain_name(name).alias("pile_set_name")).where("doc_id is not null and pile_set_name <> '(none)'").groupBy("doc_id").agg(F.min("pile_set_name").alias("pile_set_name"))


def token_budget(docs: DataFrame, meta: DataFrame, merges: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Totals by source, by pile_set_name, by language, by domain, by source and language, by all four together, and of everything; ``slice`` says which."""
    rows = estimates(docs, merges, sample_docs).join(pile_names(meta), "doc_id", "left").fillna("(none)", ["pile_set_name"])
    keys = ["source", "pile_set_name", "language", "domain"]
    sets = [("source",), ("pile_set_name",), ("language",), ("domain",), ("source", "language"), tuple(keys), ()]
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys))
    out = out.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("milli_tokens"), F.lit(0)).alias("milli"))
    name = F.lit(None).cast("string")
    for s in sets:
        name = F.when(F.col("g") == sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s), "+".join(s) or "total").otherwise(name)
    return out.select(name.alias("slice"), *keys, "n_docs", "n_bytes", F.round(F.col("milli") / 1000).cast("long").alias("est_tokens"))
