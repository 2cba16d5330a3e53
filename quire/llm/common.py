"""Helpers that the operators share: tables, written intermediate results, vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at a time; the tables of powers have this length.
_PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local one is set only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.getConf().get("spark.master") or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", f"file://{here}")
    return f"file://{here}"


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends, executors may be lost.

    Inside `with Scratch(spark)` the table goes with the rest when the block ends.
    """
    held = _scratch.get()
    return held.written(df) if held else _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """The tables of one call: those written inside its block go when the block ends, but for the ones to keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        self.paths.append(path)
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """The result, as a table that stays."""
        return _stored(df)[0]

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []

    def __enter__(self) -> Scratch:
        self._before = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._before)
        self.drop()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until df has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MULTIPLIER)
_INVERSE = U64(pow(int(_STEP), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        up, down = powers(_STEP, max(n, _PIECE * 5 // 4)), powers(_INVERSE, max(n, _PIECE * 5 // 4))
        if n > 8 * _PIECE:
            return up, down
        _tables.update(up=up, down=down)
    return _tables["up"], _tables["down"]


_is_space = np.zeros(256, bool)
_is_space[[0x20, 9, 10, 11, 12, 13]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have at most so many bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            floor = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a slice of texts: 64-bit hashes, byte spans in `data`, and row pointers."""

    def __init__(self, hashes, starts, ends, rows, data, offsets):
        self.hashes, self.starts, self.ends, self.rows, self.data, self.offsets = hashes, starts, ends, rows, data, offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, fold: str = "utf8", space: np.ndarray = _is_space) -> Words:
    """Words between white space, hashed without a Python object for each.

    fold: "utf8" lower-cases by Unicode, "ascii" lower-cases A-Z only, "" not at all.
    """
    if fold == "utf8":
        texts = pc.utf8_lower(texts)
    data, offsets = text_bytes(texts)
    if fold == "ascii":
        data = _fold[data]
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        stop = int(ends[to - 1])
        up, down = _power_tables(stop - base)
        sums = np.empty(stop - base + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[data[base:stop]] * up[: stop - base], out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * _MULTIPLIER)
        at = to
    return Words(hashes, starts, ends, rows, data, offsets)


def word_hash(word: str, fold: str = "") -> int:
    """The hash that words() gives one word (0 if it has no byte)."""
    found = words(pa.array([word], pa.string()), fold, np.zeros(256, bool)).hashes
    return int(found[0]) if len(found) else 0


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, with row pointers; a row with fewer words, but some, has one shingle of them all."""
    n, counts = len(w.hashes), w.counts()
    size = max(0, n - k + 1)
    rolled = np.zeros(size, U64)
    for j in range(k):
        rolled = rolled * _STEP + w.hashes[j : j + size]
    rolled = mix(rolled)
    left = np.repeat(w.rows[1:], counts) - np.arange(n)  # words from here to the row's end
    full = np.flatnonzero(left[: len(rolled)] >= k)
    per_row = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return rolled[full], np.concatenate([[0], np.cumsum(per_row)])
    whole = np.zeros(len(short), U64)
    for j in range(k - 1):
        has = counts[short] > j
        whole[has] = whole[has] * _STEP + w.hashes[w.rows[short][has] + j]
    whole = mix(whole + counts[short].astype(U64) * _MULTIPLIER)
    per_row[short] = 1
    rows = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(rows[-1], U64)
    alone = np.zeros(len(out), bool)
    alone[rows[short]] = True
    out[alone], out[~alone] = whole, rolled[full]
    return out, rows


def sequence_hash(w: Words) -> np.ndarray:
    """For each row one 64-bit hash of its words in order (0 for a row without words)."""
    counts = w.counts()
    out = np.zeros(len(counts), U64)
    if len(w.hashes):
        place = np.arange(len(w.hashes)) - np.repeat(w.rows[:-1], counts)
        weighted = w.hashes * powers(_MULTIPLIER, int(counts.max()))[place]
        some = np.flatnonzero(counts)
        out[some] = mix(np.add.reduceat(weighted, w.rows[:-1][some]) + counts[some].astype(U64))
    return out


def number_of_words(text) -> "F.Column":
    """Words of a text column, native; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the map that passes rows over before a join; a full map passes nothing over.
MARK_BITS = 22


def only_marked(df: DataFrame, key, wanted: DataFrame, inside: bool = True, bits: int = MARK_BITS) -> DataFrame:
    """The rows whose key may be among wanted's `mark` (64-bit hashes): fewer rows for the join that decides.
    With inside=False the other rows, whose keys are certainly not among them.

    The executors get one map of 2^`bits` bits (half a megabyte), however many keys there are.
    """
    bit, part, marks = free_names(df, "_bit", "_part", "_marks")
    place = lambda c: F.pmod(c, F.lit(1 << bits))
    m = place(F.col("mark"))
    maps = wanted.select(m.alias("m")).groupBy(F.shiftright("m", 15).alias(part)).agg(F.bitmap_construct_agg(F.col("m").bitwiseAND(32767)).alias(marks))
    at = F.col(bit).bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(marks, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    met = df.withColumn(bit, place(key)).join(F.broadcast(maps), F.shiftright(bit, 15) == F.col(part), "inner" if inside else "left")
    return met.where(hit if inside else ~F.coalesce(hit, F.lit(False))).drop(bit, part, marks)


def own_columns(df: DataFrame) -> list:
    """The columns of df by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def filtered_by_text(df: DataFrame, keep) -> DataFrame:
    """The rows of df that keep(batches) lets pass, in Arrow batches with the column `text`; columns of any name stay as they are."""
    plain = [c if c == "text" else f"_{n}" for n, c in enumerate(df.columns)]
    renamed = df.toDF(*plain)
    return renamed.mapInArrow(keep, renamed.schema).toDF(*df.columns)
