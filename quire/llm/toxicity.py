"""Toxicity by cumulative-link ordinal regression.

P(grade > j | text) = sigmoid(w . x - theta_j): one weight vector for all thresholds theta_1 < theta_2 < ...;
the expected severity is the sum of these probabilities. x marks which of the kept words (and pairs of
neighbouring words) the whole text has, so a long text counts each once.

The model is fitted on a bounded sample of labelled rows (`sample` documents, those with the least hash of their
id): of their features those that tell grades apart, at most `FEATURES`, come to the driver, and no text. Weights are sparse by an L1 penalty, so that
chance words of long clean texts weigh nothing. Scoring covers every whole text in vectorised batches.

Defined cases: null and empty texts have no feature; no labels at all, or one grade only: severity is that grade
(0 without labels); null grades and labels of unknown documents are ignored; an id with several labels takes the
largest; repeated rows are scored each; null ids are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, filtered_by_text, mix, text_batches, word_hash, words, written

SAMPLE = 20_000
#: Features that may reach the driver.
FEATURES = 1 << 14
LEAST_DOCS = 4
PENALTY = 2e-4
THRESHOLD = 0.4

_separates = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_PAIR = U64(0x8EBC6AF09C88C6E3)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and neighbouring pairs, with their rows (repeats included)."""
    w = words(texts, "utf8", _separates)
    row = w.row_of()
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = mix(w.hashes[inside] * _PAIR + w.hashes[inside + 1])
    return np.concatenate([w.hashes, pairs]), np.concatenate([row, row[inside]])


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, row = features(texts)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


class Model:
    """keys: sorted feature hashes; weights; thresholds: ascending; grades: their values in order."""

    def __init__(self, keys, weights, thresholds, grades):
        self.keys, self.weights, self.thresholds, self.grades = keys, weights, thresholds, grades
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys >> U64(44)] = True

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > j), a column for each threshold."""
        h, row = features(texts)
        may = np.flatnonzero(self.bits[h >> U64(44)])
        h, row = h[may], row[may]
        score = np.zeros(len(texts))
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pair = np.unique(row[hit] * len(self.keys) + at[hit])
            score += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _solve(y, row, column, m: int, k: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal accelerated gradient on the mean cumulative-link loss with an L1 penalty; weights and thresholds."""
    n = len(y)
    share = np.clip((y[:, None] > np.arange(k)[None, :]).mean(0), 1e-6, 1 - 1e-6)
    theta = -np.log(share / (1 - share))
    w = np.zeros(m)
    v, v_theta, t = w.copy(), theta.copy(), 1.0
    crowd = np.bincount(row, minlength=n).max() if m else 1
    rate = 1.0 / (0.5 * max(1.0, min(crowd, 16)))
    for _ in range(steps):
        score = np.bincount(row, v[column], n) if m else np.zeros(n)
        cuts = np.concatenate([[-np.inf], v_theta, [np.inf]])
        a, b = cuts[y] - score, cuts[y + 1] - score
        sa, sb = 1 / (1 + np.exp(-np.clip(a, -500, 500))), 1 / (1 + np.exp(-np.clip(b, -500, 500)))
        p = np.maximum(sb - sa, 1e-12)
        da, db = sa * (1 - sa) / p, sb * (1 - sb) / p
        g_theta = np.array([(da[y == j + 1].sum() - db[y == j].sum()) / n for j in range(k)])
        g = np.bincount(column, ((db - da) / n)[row], m) if m else np.zeros(0)
        step = v - rate * g
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_theta = np.maximum.accumulate(v_theta - rate * g_theta)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_theta = new + (t - 1) / t_new * (new - w), np.maximum.accumulate(new_theta + (t - 1) / t_new * (new_theta - theta))
        w, theta, t = new, new_theta, t_new
    return w, theta


def fit(rows: list[np.ndarray], grades: np.ndarray, least_docs: int = LEAST_DOCS, penalty: float = PENALTY, steps: int = 300) -> Model:
    """rows: each document's distinct feature hashes. The L1 penalty chooses features; a tenth of it weighs them."""
    values = np.unique(grades)
    if len(values) < 2:
        return Model(np.zeros(0, U64), np.zeros(0), np.zeros(0), values if len(values) else np.zeros(1, np.int64))
    k = len(values) - 1
    sizes = np.array([len(r) for r in rows])
    every = np.concatenate(rows) if sizes.sum() else np.zeros(0, U64)
    keys, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    y = np.searchsorted(values, grades)
    # features kept: in enough documents, and not spread over the grades as by chance
    drift = np.bincount(column, y[row] - y.mean(), len(keys))
    kept = (times >= least_docs) & (np.abs(drift) > 3 * np.sqrt(times * max(y.var(), 1e-9)))
    for strength in (penalty, penalty / 10):
        chosen = kept[column]
        row, column, keys = row[chosen], (np.cumsum(kept) - 1)[column[chosen]], keys[kept]
        w, theta = _solve(y, row, column, len(keys), k, strength, steps if strength == penalty else 5 * steps)
        kept = w != 0
    return Model(keys[kept], w[kept], theta, values)


def sampled_features(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, grade and distinct features of a bounded sample: the labelled ids with the least hash, at most `sample`."""
    graded = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(grade).cast("long")).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def collect(batches):
        for batch in text_batches(batches):
            h, row = distinct_features(batch.column("text"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], ["doc_id", "grade", "features"])

    rows = read.mapInArrow(collect, "doc_id long, grade long, features array<long>")
    return rows.groupBy("doc_id", "grade").agg(F.min("features").alias("features"))


def screened(rows: DataFrame, least_docs: int, most: int) -> np.ndarray:
    """The features in enough documents whose grades differ from the mean by more than chance: at most `most`, the clearest."""
    facts = rows.agg(F.avg("grade"), F.var_pop("grade")).first()
    mean, spread = float(facts[0] or 0), max(float(facts[1] or 0), 1e-9)
    per = rows.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("grade").alias("s")).where(F.col("n") >= least_docs)
    z = F.abs(F.col("s") - F.col("n") * mean) / F.sqrt(F.col("n") * spread)
    kept = per.withColumn("z", z).where(F.col("z") > 3).orderBy(F.desc("z"), "feature").limit(most).select("feature").toArrow()
    return np.sort(kept["feature"].to_numpy().astype(np.int64))


def trained(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE, most: int = FEATURES, **how) -> Model:
    """Fitted on the driver from screened features alone: at most `sample` rows of at most `most` distinct ones."""
    rows = written(sampled_features(docs, labels, grade, sample))
    kept = screened(rows, how.get("least_docs", LEAST_DOCS), most)

    def only_kept(batches):
        for batch in batches:
            lists = batch.column("features")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(kept, flat), max(0, len(kept) - 1))
            hit = kept[at] == flat if len(kept) else np.zeros(len(flat), bool)
            counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat[hit]))], ["grade", "features"])

    small = rows.select("grade", "features").mapInArrow(only_kept, "grade long, features array<long>").toArrow().combine_chunks()
    lists = small["features"].combine_chunks() if isinstance(small["features"], pa.ChunkedArray) else small["features"]
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64), lists.offsets.to_numpy()
    return fit([flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)], small["grade"].to_numpy().astype(np.int64), **how)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (the likeliest passed grade), expected_severity, p_above_least (P of more than the least grade)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def score(batches):
        steps = np.diff(model.grades).astype(float)
        for batch in text_batches(batches):
            above = model.above(batch.column("text"))
            severity = model.grades[(above >= 0.5).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(severity.astype(np.int64)), pa.array(float(model.grades[0]) + (above * steps[None, :]).sum(1)), pa.array(above[:, 0] if above.shape[1] else np.zeros(len(above)))],
                ["doc_id", "severity", "expected_severity", "p_above_least"],
            )

    return read.mapInArrow(score, "doc_id long, severity long, expected_severity double, p_above_least double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose text is not likelier than `threshold` to pass the least grade; all columns as they came."""

    def keep(batches):
        for batch in text_batches(batches):
            above = model.above(batch.column("text"))
            yield batch.filter(pa.array(above[:, 0] < threshold)) if above.shape[1] else batch

    return filtered_by_text(docs, keep)


def top_words(model: Model, vocabulary: list[str]) -> dict[str, float]:
    """Weights of given words, to look into a model."""
    at = {int(k): float(v) for k, v in zip(model.keys, model.weights, strict=True)}
    return {x: at.get(word_hash(x), 0.0) for x in vocabulary}
