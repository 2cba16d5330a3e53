"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its five-word shingles and, for the paths, `T` min-hashes of that set: the shared
token that a path samples at coordinate i is the set's least shingle under hash i. In each of `runs` runs a set
follows paths: a path hashes itself to one coordinate, with probability 1/4 to a second (1.25 = 1/similarity on
average, so that a pair at the threshold keeps about one common path), and goes on with the value found there.
Paths with at most `small` sets stop; larger ones split again, `depth` times at most. Runs are repeated as often as a
pair at the threshold needs to be found with the target recall (runs_needed). Sets that share a last path
are compared by their min-hashes in units of bounded size; those that may be similar join a candidate group.

Within the candidate groups all pairs are verified exactly, again in units of bounded size, by their whole shingle
sets: a group's links are complete however many of them the paths found themselves. No pair leaves its unit: what
comes out is, for each text, its number of links and the group it is linked to.

Exact copies (equal words in order) are one text with a count, so copies cost nothing.

Defined cases: words are separated by white space and lower-cased; a text of one to four words has one shingle of
them all; a text without words (null, empty) has no shingle, no link and a class of its own with its like ids; repeated
rows are copies; ids may be null; columns besides doc_id and text are not read, and keep their names and values.
Identity of texts is by 64-bit hash.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U64, Scratch, free_names, mix, only_marked, own_columns, sequence_hash, shingles, text_batches, words, written

SIMILARITY = 0.8
SHINGLE = 5
T = 64
#: The share of pairs at the threshold that the runs have to find.
RECALL = 0.999
SMALL = 256
#: Texts in a part of a large bucket or group; two parts at most meet in a task.
PART = 1024
DEPTH = 3
#: Min-hashes that must agree for a candidate: a pair at 0.8 stays below it with probability 1e-4 in a comparison.
AGREE = 39

_A = mix(np.arange(1, T + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(1001, T + 1001, dtype=U64))


def _sign(batches):
    for batch in text_batches(batches, most=1 << 20):
        w = words(batch.column("text"))
        h, rows = shingles(w, SHINGLE)
        some = np.flatnonzero(np.diff(rows))
        sig = np.zeros((batch.num_rows, T), np.int32)
        for j in range(T):
            if len(some):
                sig[some, j] = (np.minimum.reduceat(h * _A[j] + _B[j], rows[:-1][some]) >> U64(32)).astype(np.uint32).view(np.int32)
        node = sequence_hash(w).view(np.int64)
        has = np.diff(rows) > 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, mask=~has), pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), T).cast(pa.list_(pa.int32()))],
            ["doc_id", "text_hash", "node", "sig"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (hash of the words in order, null without words), sig (T min-hashes)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    return read.mapInArrow(_sign, "doc_id long, text_hash long, node long, sig array<int>")


def _next(path, sig):
    """The paths that follow: one coordinate, or with probability 1/4 two, chosen by the path itself."""
    def step(n):
        coordinate = F.pmod(F.xxhash64(path, F.lit(n)), F.lit(T)).cast("int")
        return F.xxhash64(path, coordinate, F.get(sig, coordinate))

    return F.when(F.pmod(F.xxhash64(path, F.lit(7)), F.lit(4)) == 0, F.array_distinct(F.array(step(0), step(1)))).otherwise(F.array(step(0)))


def leaf_buckets(nodes: DataFrame, runs: int, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """path, node, size: the last paths that more than one text follows."""
    paths = nodes.select("node", "sig", F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(r))).alias("path"))
    done = None
    for level in range(depth):
        paths = written(paths.select("node", F.explode(_next(F.col("path"), F.col("sig"))).alias("path")))
        sizes = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        sized = written(paths.join(sizes, "path"))
        last = level == depth - 1
        found = sized if last else sized.where(F.col("size") <= small)
        done = found if done is None else done.unionByName(found)
        large = sized.where(F.col("size") > small)
        if last or large.isEmpty():
            return done
        paths = large.select("path", "node").join(nodes.select("node", "sig"), "node")
    return done


def in_units(members: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """Deals a group's rows out to units of at most two parts; every pair of rows meets, once as (first part, second part).

    Adds unit (long) and part: 0 where the unit has one part, else 1 or 2.
    """
    parts = F.ceil(F.col(size) / most).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
    both = lambda i: F.struct(F.xxhash64(group, F.least(i, own), F.greatest(i, own)).alias("unit"), F.when(i == own, 0).when(own < i, 1).otherwise(2).alias("part"))
    return members.withColumn("u", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), both))).select("*", "u.unit", "u.part").drop("u")


def _by_unit(batches):
    """Whole units as tables, from rows that come sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        if not len(unit):
            continue
        cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
        if cut and held or (held and held[-1].column("unit")[-1].as_py() != unit[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _settle(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n rows the least row that the links left-right connect each to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _likely(batches):
    """node, label: candidate links of each unit, as links to the least linked node of the unit."""
    for t in _by_unit(batches):
        unit, node = t["unit"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort((node, unit))
        unit, node = unit[order], node[order]
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, T)[order]
        left, right = [], []
        ends = np.searchsorted(unit, unit, "right")
        at, step = np.arange(len(unit)), 1
        while True:
            at = at[at + step < ends[at]]
            if not len(at):
                break
            for piece in np.array_split(at, len(at) // 20_000 + 1):
                alike = (sig[piece] == sig[piece + step]).sum(1) >= AGREE
                left.append(piece[alike])
                right.append(piece[alike] + step)
            step += 1
        if left:
            label = _settle(len(unit), np.concatenate(left), np.concatenate(right))
            linked = label != np.arange(len(unit))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["node", "label"])


def _verify(similarity: float):
    def verify(batches):
        for t in _by_unit(batches):
            unit = t["unit"].to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    out.append(verified(t["node"][a:b].to_numpy(), t["part"][a:b].to_numpy(), t["text"][a:b], similarity))
            if out:
                node, label, links = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(links)], ["node", "label", "links"])

    return verify


def verified(node: np.ndarray, part: np.ndarray, texts, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's least linked node in the unit and number of links that the unit answers for, by exact Jaccard."""
    order = np.argsort(node, kind="stable")
    node, part = node[order], part[order]
    sets = []
    for i in order.tolist():
        h, _ = shingles(words(texts[i : i + 1].combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts[i : i + 1]), SHINGLE)
        sets.append(np.unique(h))
    n, sizes = len(node), np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = max(64, min(8192, (16 << 20) // (4 * n)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [start, start + width])
        block = np.zeros((n, width), np.float32)
        block[owner[x:y], column[x:y] - start] = 1
        common += block @ block.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= similarity * union - 1e-9
    np.fill_diagonal(linked, False)
    linked &= ~((part[:, None] == part[None, :]) & (part[:, None] > 0))
    left, right = np.nonzero(linked)
    return node, node[_settle(n, left, right)], linked.sum(1).astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each is connected to by links (node, label); nodes without links are left out."""
    both = written(links.where("node != label").select("node", "label").unionByName(links.where("node != label").select(F.col("label").alias("node"), F.col("node").alias("label"))).distinct())
    root = written(both.groupBy("node").agg(F.least(F.min("label"), F.col("node")).alias("root")))
    while True:
        seen = both.join(root.withColumnRenamed("node", "label"), "label").groupBy("node").agg(F.min("root").alias("near"))
        low = root.join(seen, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        up = root.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = written(low.join(up, "low", "left").select("node", F.least("low", "up").alias("root"), F.col("old")))
        changed = new.where("root != old").isEmpty()
        root = new.select("node", "root")
        if changed:
            return root


def runs_needed(similarity: float, recall: float = RECALL, depth: int = DEPTH, coordinates: int = T, agree: int = AGREE) -> int:
    """How many runs a pair at the threshold needs to be found with this probability.

    In a run, it shares a last path with the probability that the branching process of its common paths lives for `depth`
    steps: a path has one child or, one time in four, two, and each is common with the probability `similarity`. Pairs also
    have to agree in `agree` of the min-hashes, which all runs share; that loss is no run's to mend.
    """
    lives = 1.0
    for _ in range(depth):
        one = similarity * lives
        lives = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    passes = sum(comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(agree, coordinates + 1))
    missed = 1 - recall / passes
    if missed <= 0:
        raise ValueError(f"the min-hashes alone find only {passes:.5f} of the pairs at {similarity}")
    return max(1, ceil(log(missed) / log(1 - lives))) if lives < 1 else 1


def _classified(docs: DataFrame, similarity: float, runs: int | None, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """signed (doc_id, text_hash, node of each row) and known (node, copy_id, n_copies, n_links, class_id, and the place of the class's first row)."""
    runs = runs or runs_needed(similarity, depth=depth)
    signed = written(signatures(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(signed.where("node is not null").groupBy("node").agg(F.min(place).alias("first"), F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")))
    buckets = in_units(leaf_buckets(nodes, runs, small, depth), "path", "size", PART)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.select("unit", "node").join(nodes.select("node", "sig"), "node").repartition(parts, "unit").sortWithinPartitions("unit")
    groups = components(dealt.mapInArrow(_likely, "node long, label long"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = in_units(groups.join(sizes, "root"), "root", "size", small)
    wanted = written(members.select("node", "unit", "part").join(nodes.select("node", "first.doc_id", "first.text_hash"), "node"))
    ids = wanted.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    read = only_marked(read, F.col("text_hash"), ids.select(F.col("h").alias("mark")))
    texts = read.join(ids, (read.doc_id.eqNullSafe(ids.d)) & (read.text_hash == ids.h)).select("node", "text").groupBy("node").agg(F.min("text").alias("text"))
    units = wanted.select("node", "unit", "part").join(texts, "node").repartition(parts, "unit").sortWithinPartitions("unit")
    checked = written(units.mapInArrow(_verify(similarity), "node long, label long, links long"))
    classes = components(checked)
    counts = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = classes.join(counts, "node").join(nodes.select("node", "copy_id", "first"), "node")
    roots = linked.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("first").alias("class_first"))
    of_class = linked.select("node", "n_links", "root").join(roots, "root").drop("root")
    known = nodes.select("node", "copy_id", "n_copies", "first").join(of_class, "node", "left")
    return signed, known.select("node", "copy_id", "n_copies", "n_links", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("class_first", "first").alias("first"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, runs: int | None = None, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """For each row: doc_id, copy_id (least id of its exact copies), class_id (least id of all texts that links connect),
    n_links (different texts with a Jaccard similarity of at least `similarity`), n_copies (rows with its words)."""
    with Scratch(docs.sparkSession) as scratch:
        signed, known = _classified(docs, similarity, runs, small, depth)
        out = signed.select("doc_id", "node").join(known.drop("first"), "node", "left")
        return scratch.kept(out.select(
            "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        ))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns as they came: that with the least id (null ids last), then the least hash of its text.

    Rows are told apart by id and text together, so that different texts with one id, or without, are each kept or left by
    their own class. Of rows that agree in both one stays. Rows without words are in no class and all stay.
    """
    gone_id, gone_text, state = free_names(docs, "gone_id", "gone_text", "state")
    with Scratch(docs.sparkSession) as scratch:
        signed, known = _classified(docs, similarity, None, SMALL, DEPTH)
        places = signed.where("node is not null").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("n"))
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        placed = places.join(known.select("node", "first"), "node").select("doc_id", "text_hash", "n", stays.alias("stays"))
        # what changes: places that go, and places of several rows of which one stays
        touched = scratch.kept(placed.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text), F.col("stays").alias(state)))
    key, own = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), own_columns(docs)
    marks = touched.select(F.xxhash64(gone_id, gone_text).alias("mark"))
    met = only_marked(docs, key, marks).join(touched, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_text)), "left")
    whole = F.struct(*own)
    once = met.where(F.col(state)).groupBy(gone_id, gone_text).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
    return only_marked(docs, key, marks, inside=False).unionByName(met.where(F.col(state).isNull()).select(*own)).unionByName(once)
