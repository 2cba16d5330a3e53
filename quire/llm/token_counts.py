"""Token counts: an exact histogram of encoded lengths, from which suffix sums answer every context limit.

Each whole text is encoded once with a public byte-level BPE vocabulary whose path is a parameter; only
(length, documents) pairs leave the executors. Suffix sums over the histogram run in blocks of lengths, so
no task sees more than one block's lengths or the blocks' totals.

Defined cases: a null or empty text has length 0 and is counted; repeated rows count each time; an empty
table gives an empty histogram; columns other than the text are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_batches, words, written

#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024

_encoders: dict[int, object] = {}
#: Words whose token counts a worker keeps; beyond that they are encoded again.
KEPT_WORDS = 1 << 21
_spaced: dict[int, int] = {}
_plain: dict[int, int] = {}
#: First two bytes in UTF-8 of white space beyond ASCII (a superset).
_WIDE_SPACE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def read_vocabulary(path: str) -> bytes:
    """The rank file's bytes, read once on the driver (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _spaced.clear(), _plain.clear()
    return _encoders[key]


def _word_tokens(w, chosen: np.ndarray, known: dict[int, int], encode, lead: str) -> np.ndarray:
    keys, first, back = np.unique(w.hashes[chosen], return_index=True, return_inverse=True)
    counts = np.empty(len(keys), np.int64)
    for n, (key, i) in enumerate(zip(keys.tolist(), chosen[first].tolist(), strict=True)):
        got = known.get(key)
        if got is None:
            got = len(encode(lead + w.data[w.starts[i] : w.ends[i]].tobytes().decode()))
            if len(known) < KEPT_WORDS:
                known[key] = got
        counts[n] = got
    return counts[back]


def token_lengths(texts: pa.Array, encode) -> np.ndarray:
    """Tokens of each text, equal to encoding it whole.

    The split pattern never joins two words: a word takes the one space before it, and what is left of the white
    space stands alone. So each distinct word is encoded once. Texts with white space beyond ASCII are encoded whole.
    """
    w = words(texts, "")
    data, n = w.data, len(w.starts)
    row = w.row_of()
    before = np.concatenate([[0], w.ends[:-1]]) if n else np.zeros(0, np.int64)
    heads = w.rows[:-1][w.counts() > 0]
    before[heads] = w.offsets[:-1][w.counts() > 0]
    gap = w.starts - before
    spaced = np.zeros(n, bool)
    spaced[gap > 0] = data[w.starts[gap > 0] - 1] == 0x20
    per_word = np.zeros(n, np.int64)
    for mask, known, lead in ((spaced, _spaced, " "), (~spaced, _plain, "")):
        chosen = np.flatnonzero(mask)
        if len(chosen):
            per_word[chosen] = _word_tokens(w, chosen, known, encode, lead)
    single = np.flatnonzero(~spaced & (gap > 0))
    if len(single):
        by_byte = np.zeros(256, np.int64)
        for b in np.unique(data[w.starts[single] - 1]).tolist():
            by_byte[b] = len(encode(chr(b)))
        per_word[single] += by_byte[data[w.starts[single] - 1]]
    piece = lambda a, b: len(encode(data[a:b].tobytes().decode()))
    for i in np.flatnonzero(gap > 1).tolist():
        per_word[i] += piece(before[i], w.starts[i] - 1)
    out = np.bincount(row, per_word, len(w.rows) - 1).astype(np.int64)
    last = np.where(w.counts() > 0, w.ends[np.maximum(w.rows[1:] - 1, 0)] if n else 0, w.offsets[:-1])
    for r in np.flatnonzero(last < w.offsets[1:]).tolist():
        out[r] += piece(last[r], w.offsets[r + 1])
    pair = np.zeros(len(data), bool)
    for a, b in _WIDE_SPACE:
        lead = np.flatnonzero(data[:-1] == a)
        pair[lead[data[lead + 1] == b]] = True
    for r in np.unique(np.searchsorted(w.offsets, np.flatnonzero(pair), "right") - 1).tolist():
        out[r] = piece(w.offsets[r], w.offsets[r + 1])
    return out


def encoded_lengths(docs: DataFrame, vocabulary_path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: partial counts of documents by encoded length, a row for each length and partition."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def count(batches):
        encode = encoder(shipped.value).encode_ordinary
        seen: dict[int, int] = {}
        for batch in text_batches(batches, most=1 << 20):
            found, times = np.unique(token_lengths(batch.column(0), encode), return_counts=True)
            for n, k in zip(found.tolist(), times.tolist(), strict=True):
                seen[n] = seen.get(n, 0) + k
        keys = np.fromiter(seen, np.int64, len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["n_tokens", "n_docs"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each occurring length: documents and, by suffix and prefix sums, what a context of that length holds.

    n_docs, docs_longer and tokens_longer (of documents with more tokens), docs_within (at most so many),
    truncated_tokens (all documents cut to this length), lost_tokens, quantile (docs_within over all documents).
    """
    h = written(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))  # once: encoding is what costs
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "all_docs",
        "all_tokens",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"),
    )
    within = F.col("all_docs") - F.col("docs_longer")
    truncated = F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return h.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", within.alias("docs_within"), truncated.alias("truncated_tokens"),
        (F.col("all_tokens") - truncated).alias("lost_tokens"), (within / F.col("all_docs")).alias("quantile"), "all_docs", "all_tokens",
    )


def context_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context, truncated_tokens and docs_cut for each limit, from the histogram alone."""
    cut = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context")
    h = histogram.select("n_tokens", "n_docs", cut)
    kept = F.least("n_tokens", "context") * F.col("n_docs")
    over = F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)
    return h.groupBy("context").agg(F.sum(kept).alias("truncated_tokens"), F.sum(over).alias("docs_cut"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of the documents does not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
