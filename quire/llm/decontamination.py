"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share seeds: runs of `least` words. Where a document holds a seed of an item,
running Karp-Rabin tiles the pair: again and again the longest match of words that no tile covers yet becomes
a tile, down to `least` words. The share of the item's words under tiles is its coverage; from `share` on the
document is contaminated, in whatever order the passages stand.

Words are runs of ASCII letters, digits and all non-ASCII characters, lower-cased; punctuation separates.

The benchmark is read in blocks of at most `block_bytes` of text, so a benchmark of any size is handled by
one pass over the documents for each block; a block's seed index is what the executors receive.

Defined cases: null and empty texts or items match nothing; an item with fewer than `least` words matches
where it stands whole; repeated documents and items each give their rows; ids may be null; other columns are
not read. The result has a row for each contaminated document and item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, filtered_by_text, mix, text_batches, words

LEAST = 5
SHARE = 0.6
BLOCK_BYTES = 8 << 20

_STEP = U64(0xA0761D6478BD642F)
_separates = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def item_words(texts: pa.Array):
    return words(texts, "utf8", _separates)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every k words in a row."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def longest_matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of the maximal common runs of free words with k words or more."""
    ra, rb = rolling(a, k), rolling(b, k)
    ok_a = np.flatnonzero(np.convolve(free_a, np.ones(k, np.int64), "valid") == k) if len(ra) else np.zeros(0, np.int64)
    ok_b = np.flatnonzero(np.convolve(free_b, np.ones(k, np.int64), "valid") == k) if len(rb) else np.zeros(0, np.int64)
    if not len(ok_a) or not len(ok_b):
        return []
    order = np.argsort(rb[ok_b], kind="stable")
    keys = rb[ok_b][order]
    lo, hi = np.searchsorted(keys, ra[ok_a], "left"), np.searchsorted(keys, ra[ok_a], "right")
    found = []
    done = set()
    for i, x, y in zip(ok_a[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
        for j in ok_b[order[x:y]].tolist():
            if (i - 1, j - 1) in done:  # inside a run that is already found
                done.add((i, j))
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= k:
                found.append((n, i, j))
                done.add((i, j))
    return found


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in a, start in b), longest first; ties go to the first in a, then in b."""
    free_a, free_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    tiles: list[tuple[int, int, int]] = []
    while True:
        found = sorted(longest_matches(a, b, free_a, free_b, least), key=lambda m: (-m[0], m[1], m[2]))
        if not found:
            return tiles
        longest = found[0][0]
        for n, i, j in found:
            if n < longest:
                break
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = 0
                tiles.append((n, i, j))


class SeedIndex:
    """Seeds of a block of items: every run of `least` words, or a shorter item's whole words."""

    def __init__(self, ids: list, texts: list, least: int):
        w = item_words(pa.array(texts, pa.string()))
        self.ids, self.least = ids, least
        self.items = [w.hashes[w.rows[i] : w.rows[i + 1]] for i in range(len(ids))]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, item in enumerate(self.items):
            if len(item):
                k = min(least, len(item))
                by_width.setdefault(k, []).append((np.unique(rolling(item, k)), n))
        self.bits = {}
        for k, found in by_width.items():
            keys = np.concatenate([x for x, _ in found])
            owner = np.concatenate([np.full(len(x), n, np.int64) for x, n in found])
            order = np.argsort(keys, kind="stable")
            self.seeds[k] = (keys[order], owner[order])
            self.bits[k] = np.zeros(1 << 20, bool)
            self.bits[k][keys >> U64(44)] = True

    def candidates(self, w) -> dict[int, set[int]]:
        """Items that share a seed, by row."""
        out: dict[int, set[int]] = {}
        for k, (keys, owner) in self.seeds.items():
            rolled = rolling(w.hashes, k)
            at = np.flatnonzero(self.bits[k][rolled >> U64(44)])
            lo, hi = np.searchsorted(keys, rolled[at], "left"), np.searchsorted(keys, rolled[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            row = np.searchsorted(w.rows, at, "right") - 1
            inside = at + k <= w.rows[row + 1]
            for r, x, y in zip(row[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                out.setdefault(r, set()).update(owner[x:y].tolist())
        return out


def _match(index: SeedIndex, share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def match(batches):
        for batch in text_batches(batches):
            w = item_words(batch.column("text"))
            rows = []
            for r, items in index.candidates(w).items():
                a = w.hashes[w.rows[r] : w.rows[r + 1]]
                first = w.offsets[r]
                for n in sorted(items):
                    b = index.items[n]
                    tiles = tile(a, b, min(index.least, len(b)))
                    covered = sum(x[0] for x in tiles)
                    if covered >= share * len(b):
                        spans = [{"start": int(w.starts[w.rows[r] + i] - first), "end": int(w.ends[w.rows[r] + i + m - 1] - first)} for m, i, _ in sorted(tiles, key=lambda x: x[1])]
                        rows.append({"doc_id": batch.column("doc_id")[r].as_py(), "item_id": index.ids[n], "item_words": len(b), "covered_words": covered, "coverage": covered / len(b), "n_tiles": len(tiles), "spans": spans})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return match


def benchmark_blocks(benchmark: DataFrame, block_bytes: int):
    """(ids, texts) of the items in blocks that are bounded in bytes, streamed to the driver one after the other."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if texts and size + len(row[1]) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, coverage, n_tiles and the tiles' spans (bytes of the lower-cased text)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for ids, texts in benchmark_blocks(benchmark, block_bytes):
        found = read.mapInArrow(_match(SeedIndex(ids, texts, least), share), "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long, spans array<struct<start:long,end:long>>")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the contaminated ones, all columns as they came: the text decides, in one pass for each block."""
    out = docs
    for ids, texts in benchmark_blocks(benchmark, block_bytes):
        index = SeedIndex(ids, texts, least)

        def keep(batches, index=index):
            for batch in text_batches(batches):
                w = item_words(batch.column("text"))
                bad = np.zeros(batch.num_rows, bool)
                for r, items in index.candidates(w).items():
                    a = w.hashes[w.rows[r] : w.rows[r + 1]]
                    for n in items:
                        b = index.items[n]
                        if sum(x[0] for x in tile(a, b, min(index.least, len(b)))) >= share * len(b):
                            bad[r] = True
                            break
                yield batch.filter(pa.array(~bad))

        out = filtered_by_text(out, keep)
    return out
