"""Evaluation texts that stand, fully or partly, in the documents of a corpus.

Method: q-gram lemma filtering. A piece of m characters within ``k`` edits of a stretch of a document
shares at least m - q + 1 - k q of its q-grams with it, and these lie in a band of k + 1
neighbouring diagonals (position in the document minus position in the piece).

1. Items and documents are reduced to their words, in lower case, one space apart. A piece is ``run``
   consecutive words of an item (all of them if it has fewer), for every start.
2. The q-grams of all items form one table. It is small: its size is checked. Items beyond the bound are taken in several blocks;
   then one pass over the corpus keeps the documents that have as many q-grams of any item as the lemma asks for at least (by a bitmap of fixed size, which loses none), and
   the blocks are matched against these alone.
3. The q-grams of each document are looked up, each hit counts for two overlapping bands
   of its item, and bands with fewer hits than the lemma asks for are dropped.
4. In the regions left, each piece is verified by alignment within a band of 2 k + 1 cells per character. With no edits allowed the band is a
   single diagonal, and the alignment is a comparison.

Exact matches are the case of no edits; the lemma loses none. The edits of a piece are at most
``edits`` and so few that at least one q-gram must be shared.

Defined results: null texts, texts without words and rows without an id match nothing; an item listed twice counts under each id;
empty tables give no rows; repeated documents with the same id give one row; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import materialize
from textloom.functions.vectext import U, Words, code_points, gram_hash
from textloom.llm.common import per_chunk, pick

Q = 16
#: Characters of items that one block's table may hold; a table takes about 100 bytes for each.
BLOCK_CHARS = 1 << 20
#: Bits of the map of all items' q-grams, where there are several blocks.
MAP_BITS = 27


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between ``a`` and the stretch of ``b`` nearest to it, or most + 1 if there are more than ``most``.

    Only the band of cells that can still end at ``most`` or less is filled in each column.
    """
    m, col, best = len(a), list(range(len(a) + 1)), most + 1
    last = min(m, most)
    if last == m:
        best = m
    for y in b:
        top = min(m, last + 1)
        if top > last:
            col[top] = most + 1
        diagonal = 0
        for i in range(1, top + 1):
            left = col[i]
            col[i] = diagonal if a[i - 1] == y else 1 + min(diagonal, left, col[i - 1])
            diagonal = left
        last = top
        while last and col[last] > most:
            last -= 1
        if last == m:
            best = min(best, col[m])
    return best


class Pieces:
    """The q-gram table of some items: sorted hashes, and the (item, position) pairs of each."""

    def __init__(self, items: list[tuple[int, str]], run: int, edits: int, q: int = Q):
        self.run, self.q, self.items, self.pieces, self.least, self.reach, self.size = run, q, [], [], [], [], []
        hashes, where = [], []
        for item_id, text in items:
            w = Words([text.lower()], hashed=False)
            words = [text.lower()[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
            if not words:
                continue
            pieces = [" ".join(words[i : i + run]) for i in range(max(1, len(words) - run + 1))]
            # A space on either side makes words whole, and gives short items more to match.
            line = f" {' '.join(words)} "
            short = min(map(len, pieces)) + 2
            size = min(q, short)
            k = max(0, min(edits, (short - size) // size))
            n = len(self.items)
            self.items.append((item_id, k))
            self.pieces.append(pieces)
            self.reach.append(max(map(len, pieces)) + 2 + k)
            self.least.append(short - size + 1 - k * size)
            self.size.append(size)
            g = gram_hash(code_points(line), size)
            hashes.append(g ^ U(size))
            where.append(np.stack([np.full(len(g), n), np.arange(len(g))], axis=1))
        self.sizes = sorted({min(q, min(map(len, p)) + 2) for p in self.pieces})
        if hashes:
            h, at = np.concatenate(hashes), np.concatenate(where)
            o = np.argsort(h, kind="stable")
            self.hash, first = np.unique(h[o], return_index=True)
            self.at, self.first = at[o], np.r_[first, len(o)]
            self.filter = np.zeros(1 << 20, bool)
            self.filter[(self.hash >> U(44)).astype(np.int64)] = True
        self.least = np.array(self.least, np.int64)
        self.edits = np.array([k for _, k in self.items], np.int64)

    def regions(self, cp: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text, item) -> stretches [a, b) of the joined texts that may hold a piece of the item."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for size in self.sizes:
            g = gram_hash(cp, size) ^ U(size)
            pos = np.flatnonzero(self.filter[(g >> U(44)).astype(np.int64)])
            if not len(pos):
                continue
            slot = np.minimum(np.searchsorted(self.hash, g[pos]), len(self.hash) - 1)
            hit = self.hash[slot] == g[pos]
            pos, slot = pos[hit], slot[hit]
            n = self.first[slot + 1] - self.first[slot]
            pos = np.repeat(pos, n)
            if not len(pos):
                continue
            at = self.at[np.repeat(self.first[slot], n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)]
            item, diagonal = at[:, 0], pos - at[:, 1]
            width = self.edits[item] + 1
            # Bands of twice that width begin every width diagonals: any width diagonals lie in one of them.
            key = np.stack([np.r_[item, item], np.r_[doc[pos], doc[pos]], np.r_[diagonal // width, diagonal // width - 1]], axis=1)
            o = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
            k, p = key[o], np.r_[pos, pos][o]
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            m = np.diff(np.r_[first, len(k)])
            for f, c in zip(first[m >= self.least[k[first, 0]]].tolist(), m[m >= self.least[k[first, 0]]].tolist()):
                i, d, _ = k[f].tolist()
                lo, hi = int(p[f : f + c].min()), int(p[f : f + c].max())
                # An edit near an end spoils all q-grams beyond it: a piece may reach further than its hits.
                found[d, i].append((lo - self.reach[i], hi + size + self.reach[i]))
        return found


def _line(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts; all of them one space apart, with a space on either side; the text of each code point (-1 at the end); starts and sizes of the words therein."""
    w = Words([(t or "").lower() for t in texts], hashed=False)
    # A text is rewritten by shifting its code points.
    size = w.end - w.start
    out = np.full(int(size.sum() + len(size) + 1), 32, np.uint32)
    start = np.cumsum(size + 1) - size
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[np.repeat(start - before, size) + step] = w.cp[np.repeat(w.start - before, size) + step]
    doc = np.full(len(out), -1)
    doc[:-1] = np.repeat(w.doc, size + 1)
    return w, out, doc, start, size


def _map_of(tables: list[Pieces]) -> tuple[np.ndarray, dict[int, int]]:
    """A bitmap of the q-grams of all tables, and for each size of q-gram the least number of hits that an item asks for."""
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    least: dict[int, int] = {}
    for t in tables:
        at = (t.hash >> U(64 - MAP_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for size in t.sizes:
            least[size] = min([least.get(size, 1 << 60), *(n for n, s in zip(t.least.tolist(), t.size) if s == size)])
    return bits, least


def _candidate_rows(bits: np.ndarray, least: dict[int, int]):
    """Documents with as many q-grams of the items as one of these asks for."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, line, doc, _, _ = _line(batch.column("text").to_pylist())
        keep = np.zeros(w.n_docs, bool)
        for size, n in least.items():
            at = ((gram_hash(line, size) ^ U(size)) >> U(64 - MAP_BITS)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            mine = doc[: len(at)][hit]
            keep |= np.bincount(mine[mine >= 0], minlength=w.n_docs) >= n
        return batch.filter(pa.array(keep))

    return per_chunk(f)


def _leak_rows(table: Pieces):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("edits", pa.int32()), ("pieces", pa.int32()), ("matched", pa.int32())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_pylist()
        w, out, doc, start, size = _line(batch.column("text").to_pylist())
        rows = []
        for (d, i), spans in table.regions(out, doc).items():
            a, b = int(start[w.first[d]]) - 1, int(start[w.first[d + 1] - 1] + size[w.first[d + 1] - 1]) + 1
            merged: list[list[int]] = []
            for lo, hi in sorted((max(a, lo), min(b, hi)) for lo, hi in spans):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            areas = [out[lo:hi].tobytes().decode("utf-32-le", "surrogatepass") for lo, hi in merged]
            item, k = table.items[i]
            best = [min((0 if f" {p} " in s else edit_distance(f" {p} ", s, k) if k else 1 for s in areas), default=k + 1) for p in table.pieces[i]]
            if min(best) <= k:
                rows.append((item, ids[d], min(best), len(best), sum(x <= k for x in best)))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else None

    return per_chunk(f)


def leaks(items: DataFrame, docs: DataFrame, run: int = 13, edits: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, doc_id, edits, pieces, matched`` of every item of which a piece stands in a document with at most ``edits`` edits.

    ``edits`` is the least over the pieces, 0 for an exact match; ``matched`` of the item's ``pieces`` match.
    Items (a bounded set: they are held-out questions, not the corpus) go to the driver a block at a time. With ``edits`` 0 nothing is aligned beyond a comparison.
    """
    items = pick(items, "item_id", "text").where("item_id is not null and text is not null").distinct()
    size = F.length("text") + 2
    blocks = int(items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]) // block_chars + 1
    docs = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    schema = "item_id long, doc_id long, edits int, pieces int, matched int"
    part = lambda b: Pieces([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()], run, edits)
    if blocks > 1:
        bits, least = np.zeros(1 << (MAP_BITS - 3), np.uint8), {}
        for b in range(blocks):  # one block at a time on the driver
            more, fewest = _map_of([t] if (t := part(b)).items else [])
            bits |= more
            least = {s: min(least.get(s, 1 << 60), fewest.get(s, 1 << 60)) for s in least.keys() | fewest.keys()}
        docs = materialize(docs.mapInArrow(_candidate_rows(bits, least), "doc_id long, text string"), "candidates")
    found = None
    for b in range(blocks):
        table = part(b)
        if table.items:
            rows = docs.mapInArrow(_leak_rows(table), schema)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"), F.max("pieces").alias("pieces"), F.max("matched").alias("matched"))


def leaked_items(found: DataFrame) -> DataFrame:
    """Items and documents with an exact run: ``item_id, doc_id``."""
    return found.where("edits = 0").select("item_id", "doc_id")
