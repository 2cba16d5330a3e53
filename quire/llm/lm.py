"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(w | history) = P(class(w) | history) P(w | class(w), history). The history's features are the word before (n-gram),
the word before that (skip) and both together; each is hashed to a row of weights, for the classes and, together with
the class, for its members. The commonest words and the text's end are dealt to classes by count; all other words share one class,
whose members are bins of word endings. Inside a bin a word has its add-one share of the training counts, so that
every word, seen or not, has a probability and they add up to 1.

Training: biases are the training counts; then each round sends the weights to all parts, every part runs
its minibatches of gradient steps over that round's training texts in it, and the weights' changes are averaged
over the parts that have the feature. The rounds together cover all training texts. Rows of weights and parts grow with the training tokens. Scoring reads every whole text once, in numpy batches.
Counts of the commonest `KNOWN` words go to the executors; the other words of a text meet their exact counts in a join.

Defined cases: null and empty texts are one end token; null ids are training rows; repeated rows count and are scored
each; without training texts every token has the uniform share 1/(0+0+1) in the base and the model has no counts.
Words are identified by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, mix, text_batches, words, written

FOLDS, FOLD = 7, 2
KNOWN = 1 << 19
CLASSES, MEMBERS = 32, 32
HEAD = CLASSES * MEMBERS
#: Hashed rows of weights: what the n-gram, skip and pair features of the corpus are gathered in. From 2^27 training tokens
#: on they grow with their root, as the distinct pairs in a row would otherwise grow without end; at most so many (105 MB).
LEAST_ROWS, MOST_ROWS, LEAST_TOKENS = 1 << 13, 1 << 18, 1 << 27
#: Training tokens of a part: what one task learns from, one after the other, before the parts' changes are averaged.
PART_TOKENS = 1 << 21
ROUNDS = 2
RATE = 1.0
DAMP = 20.0
BATCH = 1 << 14
#: Tokens whose odds are worked out at a time: few enough for the processor's cache.
SLICE = 1 << 12
BLOCKS = 32

END = 0x1E5D0F7A3B9C2468
_END = U64(END)
_BEGIN = U64(0x51ED270B7A649D1F)
_K = mix(np.arange(21, 27, dtype=U64)) | U64(1)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == FOLD, F.lit(False))


class Tokens:
    """All tokens of a slice with their ends: hash, the two before, row, and the bin of the word's ending."""

    def __init__(self, texts: pa.Array):
        w = words(texts, "ascii")
        n, r = len(w.hashes), len(w.rows) - 1
        row = w.row_of()
        place, ends = np.arange(n) + row, w.rows[1:] + np.arange(r)
        self.hash = np.empty(n + r, U64)
        self.hash[place], self.hash[ends] = w.hashes, _END
        self.row = np.empty(n + r, np.int64)
        self.row[place], self.row[ends] = row, np.arange(r)
        self.bin = np.zeros(n + r, np.int64)
        if n:
            last = w.data[w.ends - 1].astype(np.int64)
            before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
            self.bin[place] = (last * 31 + before * 7) % MEMBERS
        self.before = np.roll(self.hash, 1)
        heads = ends - w.counts()
        self.before[heads] = _BEGIN
        self.skipped = np.roll(self.before, 1)
        self.skipped[heads] = _BEGIN
        self.counts = w.counts() + 1

    def __len__(self):
        return len(self.hash)


def _count(batches):
    """token, bin, n: partial counts of a partition, merged as they grow."""
    held: list[np.ndarray] = []
    key = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(parts):
        h, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, b[first], np.bincount(back, n, len(u)).astype(np.int64)

    def table(k):
        return pa.RecordBatch.from_arrays([pa.array(k[0].view(np.int64)), pa.array(k[1]), pa.array(k[2])], ["token", "bin", "n"])

    size = 0
    for batch in text_batches(batches, most=1 << 20):
        t = Tokens(batch.column("text"))
        u, first, n = np.unique(t.hash, return_index=True, return_counts=True)
        held.append((u, t.bin[first], n))
        size += len(u)
        if size > 1 << 20:
            key = merged([key, *held])
            held, size = [], 0
            if len(key[0]) > 1 << 21:
                yield table(key)
                key = key[0][:0], key[1][:0], key[2][:0]
    key = merged([key, *held])
    if len(key[0]):
        yield table(key)


def token_counts(training: DataFrame) -> DataFrame:
    """token (hash), bin, c over all training texts."""
    return training.select("text").mapInArrow(_count, "token long, bin long, n long").groupBy("token", "bin").agg(F.sum("n").alias("c"))


class Counts:
    """What the executors receive: totals, counts of the commonest tokens, head slots, and the tail bins' masses."""

    def __init__(self, total, distinct, keys, counts, bins, bin_sums):
        self.total, self.distinct = total, distinct
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        bins = bins[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> U64(42)] = True
        by_count = np.lexsort((self.keys, -self.counts))
        if len(by_count):
            end = np.flatnonzero(self.keys[by_count] == _END)
            by_count = np.concatenate([by_count[end], np.delete(by_count, end)])[:HEAD]  # the end has a slot in any case
        self.slot = np.full(len(self.keys), -1, np.int64)
        self.slot[by_count] = np.arange(len(by_count))
        head_mass = np.zeros(MEMBERS)
        np.add.at(head_mass, bins[by_count], self.counts[by_count] + 1.0)
        # mass of a bin: count + 1 of each of its words outside the head, and 1 for unseen words
        self.bin_mass = np.maximum(bin_sums - head_mass, 0) + 1.0
        self.bias_2 = np.full((CLASSES + 1, MEMBERS), -1e9, np.float32)
        flat = np.zeros(HEAD)
        flat[: len(by_count)] = self.counts[by_count]
        mass = flat.reshape(CLASSES, MEMBERS)
        self.bias_2[:CLASSES] = np.where(mass > 0, np.log(np.maximum(mass, 1e-300)), -1e9)
        self.bias_2[CLASSES] = np.log(self.bin_mass)
        sums = np.concatenate([mass.sum(1), [self.bin_mass.sum()]])
        self.bias_1 = np.where(sums > 0, np.log(np.maximum(sums, 1e-300)), -1e9).astype(np.float32)
        self.bias_1 -= self.bias_1.max()
        self.bias_2 -= self.bias_2.max(1, keepdims=True)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into keys, and whether the token is there."""
        found = np.zeros(len(h), bool)
        at = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self.bits[h >> U64(42)])
        if len(may):
            i = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
            hit = self.keys[i] == h[may]
            found[may[hit]], at[may[hit]] = True, i[hit]
        return at, found

    def symbols(self, t: Tokens, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token."""
        slot = np.full(len(t), -1, np.int64)
        slot[found] = self.slot[at[found]]
        head = slot >= 0
        return np.where(head, slot // MEMBERS, CLASSES), np.where(head, slot % MEMBERS, t.bin)


def gathered_counts(counts: DataFrame, most: int = KNOWN) -> Counts:
    """Totals of all counts, and the commonest tokens: at most `most`, cut between powers of two to the eighth."""
    rank = F.floor(F.log2("c") * 8).cast("int")
    ranks = counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).toPandas().sort_values("rank", ascending=False)
    total, distinct = int(ranks["tokens"].sum()), int(ranks["words"].sum())
    fits = ranks[ranks["words"].cumsum() <= most]
    least = int(fits["rank"].min()) if len(fits) else 1 << 20
    known = counts.where(rank >= least).select("token", "bin", "c").toArrow()
    sums = np.zeros(MEMBERS)
    for row in counts.groupBy("bin").agg(F.sum(F.col("c") + 1).alias("mass")).collect():
        sums[row["bin"]] = row["mass"]
    column = lambda x: known[x].to_numpy().astype(np.int64)
    return Counts(total, distinct, column("token").view(U64), column("c"), column("bin"), sums)


def rows_for(tokens: int) -> int:
    """Rows of the class weights for so many training tokens, a power of two; the member weights have twice as many."""
    return min(MOST_ROWS, LEAST_ROWS << max(0, (tokens // LEAST_TOKENS).bit_length()) // 2)


class Weights:
    """first: weights of a feature's row for the classes; second: of a feature and class for the members; in one flat array."""

    def __init__(self, flat: np.ndarray):
        self.rows = len(flat) // (CLASSES + 1 + 2 * MEMBERS)
        self.flat = flat
        n = self.rows * (CLASSES + 1)
        self.first, self.second = flat[:n].reshape(self.rows, -1), flat[n:].reshape(2 * self.rows, -1)

    @classmethod
    def zero(cls, rows: int) -> Weights:
        return cls(np.zeros(rows * (CLASSES + 1 + 2 * MEMBERS), np.float32))

    def rows_of(self, t: Tokens, part: slice, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the class weights and of the member weights for the three features."""
        a, b = t.before[part], t.skipped[part]
        bits = self.rows.bit_length() - 1
        codes = (mix(a * _K[0]), mix(b * _K[1]), mix(a * _K[2] + b * _K[3]))
        short = [np.uint16 if b <= 16 else np.uint32 for b in (bits, bits + 1)]  # numpy sorts 16 bits much faster
        first = [(c >> U64(64 - bits)).astype(short[0]) for c in codes]
        salt = group.astype(U64) * _K[4]
        second = [((c ^ salt) * _K[5] >> U64(63 - bits)).astype(short[1]) for c in codes]
        return first, second


def _odds(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """exp of bias and weights of the three rows. Biases are logs of shares and weights stay small: nothing overflows."""
    x = table[rows[0]]
    x += table[rows[1]]
    x += table[rows[2]]
    x += bias
    np.minimum(x, 80, out=x)
    return np.exp(x, out=x)


def log_probabilities(c: Counts, w: Weights, t: Tokens, group: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Natural log of P(class) P(member | class) of every token."""
    out = np.empty(len(t))
    for at in range(0, len(t), SLICE):
        part = slice(at, min(len(t), at + SLICE))
        g, m = group[part], member[part]
        first, second = w.rows_of(t, part, g)
        i = np.arange(len(g))
        e1, e2 = _odds(w.first, first, c.bias_1), _odds(w.second, second, c.bias_2[g])
        out[part] = np.log(np.maximum(e1[i, g].astype(float), 1e-300) / e1.sum(1)) + np.log(np.maximum(e2[i, m].astype(float), 1e-300) / e2.sum(1))
    return out


def _step(weights: np.ndarray, rows: list[np.ndarray], gradient: np.ndarray) -> None:
    for r in rows:
        order = np.argsort(r, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(r[order]) != 0]))
        n = np.diff(np.concatenate([heads, [len(r)]]))
        weights[r[order[heads]]] += RATE * np.add.reduceat(gradient[order], heads) / (n + DAMP)[:, None].astype(np.float32)


def train_on(c: Counts, w: Weights, t: Tokens) -> None:
    """Minibatches of gradient steps on the log-likelihood, in place."""
    group, member = c.symbols(t, *c.look_up(t.hash))
    for at in range(0, len(t), BATCH):
        part = slice(at, min(len(t), at + BATCH))
        g, m = group[part], member[part]
        first, second = w.rows_of(t, part, g)
        i = np.arange(len(g))
        d1, d2 = _odds(w.first, first, c.bias_1), _odds(w.second, second, c.bias_2[g])
        d1 /= -d1.sum(1, keepdims=True)
        d2 /= -d2.sum(1, keepdims=True)
        d1[i, g] += 1
        d2[i, m] += 1
        _step(w.first, first, d1)
        _step(w.second, second, d2)


def _only_changed(change: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of what is not 0, or all values without places where those take less."""
    at = np.flatnonzero(change).astype(np.int32)
    return (at.tobytes(), change[at].tobytes()) if 2 * len(at) < len(change) else (b"", change.tobytes())


def _add_to(sums: np.ndarray, at: bytes, change: bytes) -> np.ndarray:
    """Adds what _only_changed gave; returns its places."""
    x = np.frombuffer(change, np.float32)
    place = np.frombuffer(at, np.int32) if at else np.flatnonzero(x)
    sums[place] += x if at else x[place]
    return place


def trained(training: DataFrame, counts, rounds: int = ROUNDS, part_tokens: int = PART_TOKENS) -> Weights:
    """counts: a Spark broadcast of Counts. Each round takes its share of the training texts, all rounds take all.

    The rows of weights and the number of parts follow the training tokens, not the cluster. The parts' changes are added up block by
    block on the executors, each weight by those parts that changed it; the driver gets one sum for each weight.
    """
    sc = training.sparkSession.sparkContext
    total = counts.value.total
    weights = Weights.zero(rows_for(total))
    width = -(-len(weights.flat) // BLOCKS)
    parts = max(1, -(-total // (rounds * part_tokens)))
    for n in range(rounds):
        sent = sc.broadcast(weights.flat)

        def learn(batches, sent=sent):
            w, tokens = Weights(sent.value.copy()), 0
            for batch in text_batches(batches, most=1 << 20):
                t = Tokens(batch.column("text"))
                train_on(counts.value, w, t)
                tokens += len(t)
            if tokens:
                change = w.flat - sent.value
                for k in range(BLOCKS):
                    at, x = _only_changed(change[k * width : (k + 1) * width])
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "at": pa.array([at], pa.binary()), "change": pa.array([x], pa.binary())})

        def add(batches, sent=sent):
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for k, at, x in zip(batch.column("block").to_pylist(), batch.column("at").to_pylist(), batch.column("change").to_pylist(), strict=True):
                    if k not in sums:
                        own = min(width, len(sent.value) - k * width)
                        sums[k] = np.zeros(own), np.zeros(own, np.int32)
                    sums[k][1][_add_to(sums[k][0], at, x)] += 1
            for k, (x, times) in sums.items():
                # the mean over the parts that have the feature, as far as it is not one part's alone
                at, mean = _only_changed((x / np.maximum(times, 1)).astype(np.float32))
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "at": pa.array([at], pa.binary()), "change": pa.array([mean], pa.binary())})

        schema = "block int, at binary, change binary"
        share = training.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == n).select("text")
        changes = share.coalesce(parts).mapInArrow(learn, schema)
        flat = weights.flat.copy()
        for row in changes.repartition(BLOCKS, "block").mapInArrow(add, schema).toLocalIterator():
            _add_to(flat[row["block"] * width : (row["block"] + 1) * width], row["at"], row["change"])
        weights = Weights(flat)
        sent.unpersist()
    return weights


def scored(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    training = read.where(~held_out(F.col("doc_id")))
    counted = written(token_counts(training))
    gathered = gathered_counts(counted, known)
    counts = sc.broadcast(gathered)
    weights = sc.broadcast(trained(training, counts, rounds).flat)
    total, share = gathered.total, float(np.log10(gathered.total + gathered.distinct + 1))

    def score(batches):
        c, w = counts.value, Weights(weights.value)
        log_bin = np.log10(c.bin_mass)
        for batch in text_batches(batches, most=1 << 20):
            t = Tokens(batch.column("text"))
            at, found = c.look_up(t.hash)
            group, member = c.symbols(t, at, found)
            rows = batch.num_rows
            model = log_probabilities(c, w, t, group, member) / np.log(10)
            tail = group == CLASSES
            model[tail] -= log_bin[member[tail]]
            own = np.zeros(len(t))
            own[found] = np.log10(c.counts[at[found]] + 1.0)
            model[tail] += own[tail]
            add = lambda x: np.bincount(t.row, x, rows)
            rest = ~found
            order = np.lexsort((t.hash[rest], t.row[rest]))
            h, r = t.hash[rest][order], t.row[rest][order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([first, [len(h)]])).astype(np.int32) if len(h) else np.zeros(0, np.int32)
            ends = np.searchsorted(r[first], np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(t.counts.astype(np.int64)), pa.array(add(found).astype(np.int64)), pa.array(add(own) - share * t.counts), pa.array(add(model)),
                    pa.ListArray.from_arrays(ends, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest", "times"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<long>, times array<int>"
    first = written(read.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = first.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    met = rest.join(counted.select("token", "c"), "token").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    out = first.drop("rest", "times").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
