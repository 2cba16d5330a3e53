"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Sizes are words. Source s gets a target of words (weights share a multiple of all words; a target stops at `most_repeats`
times its source's size and the excess is shared again). Its documents, hashed, fall into `BLOCKS` blocks in random order; going
round the blocks until the target's whole words are taken gives whole rounds and a last, partial one, whose
last document may be cut. The blocks so drawn are the source's exact block quota.

The tree splits the vector of quotas over the shards: at each node the left child's share is drawn from
the multivariate hypergeometric distribution, source after source, by inversion around the mode; children split again until each
shard has its own exact quota of each source's blocks. Shard k draws the source's blocks that come after those of
the shards before it: disjoint, and in permuted order. Within a shard, `place` is the local shuffle's sort key.

All draws come from hashes of the seed, so reruns agree. Documents are placed by a hash of id and text, so that rows that share
an id, or have none, spread over the blocks.

Defined cases: null text: size 0; a null source is a source of its own, the last; documents of size 0 take nothing;
repeated rows count each, and take the same words each as far as the target goes; an empty table gives no row; an empty source (all sizes 0) has target 0.
Only the sources are assumed to fit one row (their quotas are an array); blocks are bounded by `BLOCKS` a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import free_names, number_of_words, own_columns, written

#: Weights by code-point order of the source, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCKS = 4096
SHARDS = 16


def _uniform(*what) -> Column:
    """A number in (0, 1) from the md5 hash of what."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in what])), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """rank, source_key, source_size, target: the shares of `share` times all words, by water-filling under the caps."""
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source_key") == "", "source_key")) - 1
    per = per.withColumn("rank", rank)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    per = per.withColumn("cap", cap).withColumn("all_words", F.sum("source_size").over(every))
    level = (F.lit(float(share)) * F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    # the sources under their caps share one level: that of the first, in order of cap by weight, that stays under
    shared = F.min_by(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")), F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(every)
    target = F.when(shared.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), shared * F.col("weight")))
    return per.select("rank", "source_key", "source_size", target.alias("target"))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A draw of how many of `drawn` among `total` blocks are marked, from a uniform number, by inversion.

    Weights relative to the mode's are walked upwards, then downwards, within 9 standard deviations (and 9) of it, once for their
    sum and once to the place that u picks; what is left out is below double precision.
    """
    given = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("d"), u.alias("u"))

    def bounds(p):
        lo, hi = F.greatest(F.lit(0.0), p["d"] + p["m"] - p["t"]), F.least(p["d"], p["m"])
        mode = F.greatest(lo, F.least(hi, F.floor((p["d"] + 1) * (p["m"] + 1) / (p["t"] + 2)).cast("double")))
        reach = F.ceil(F.sqrt(p["d"] * (p["m"] / p["t"]) * (1 - p["m"] / p["t"])) * 9).cast("double") + 9
        whole = lambda c: c.cast("long")
        return F.struct(p["t"].alias("t"), p["m"].alias("m"), p["d"].alias("d"), p["u"].alias("u"), whole(mode).alias("mode"), whole(F.greatest(lo, mode - reach)).alias("a"), whole(F.least(hi, mode + reach)).alias("b"))

    def draw(p):
        none = F.array().cast("array<bigint>")
        above = F.when(p["b"] > p["mode"], F.sequence(p["mode"] + 1, p["b"])).otherwise(none)
        below = F.when(p["a"] < p["mode"], F.sequence(p["mode"] - 1, p["a"], F.lit(-1).cast("long"))).otherwise(none)
        up = lambda w, k: w * (p["m"] - k + 1) * (p["d"] - k + 1) / (k * (p["t"] - p["m"] - p["d"] + k))
        down = lambda w, k: w * ((k + 1) * (p["t"] - p["m"] - p["d"] + k + 1)) / ((p["m"] - k) * (p["d"] - k))
        summed = lambda way, ks: F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda s, k: _let(way(s["w"], k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))["sum"]

        def walked(way, ks, left, at):
            start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), at.alias("k"))
            return F.aggregate(ks, start, lambda s, k: _let(way(s["w"], k), lambda w: F.struct(w.alias("w"), F.when(s["left"] < 0, s["left"]).otherwise(s["left"] - w).alias("left"), F.when(s["left"] < 0, s["k"]).otherwise(k).alias("k"))))

        rest = p["u"] * (1 + summed(up, above) + summed(down, below)) - 1
        return _let(walked(up, above, rest, p["mode"]), lambda s: F.when(s["left"] < 0, s["k"]).otherwise(walked(down, below, s["left"], s["k"])["k"]))

    return F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).otherwise(_let(_let(given, bounds), draw))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """rank, shard, first, blocks: how many of source `rank`'s blocks (quotas: rank, blocks) each shard draws, and from which on."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("q")).select(F.lit(0).alias("first_shard"), F.lit(shards).alias("n"), "q")
    level = 1
    while level < shards:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        half = F.floor(F.col("n") / 2).cast("int")
        node = node.withColumn("half", half).withColumn("total", total)
        # the left child's capacity: its shards' part of the blocks
        node = node.withColumn("cap", F.when(F.col("n") > 1, F.floor(F.col("total") * F.col("half") / F.col("n")).cast("long")).otherwise(F.lit(0).cast("long")))
        start = F.struct(F.col("total").alias("total"), F.col("cap").alias("cap"), F.array().cast("array<bigint>").alias("left"))

        def draw(s, x):
            u = _uniform(seed, F.col("first_shard"), F.col("n"), x["rank"])
            return _let(hypergeometric(s["total"], x["blocks"], s["cap"], u), lambda k: F.struct((s["total"] - x["blocks"]).alias("total"), (s["cap"] - k).alias("cap"), F.array_append(s["left"], k).alias("left")))

        node = node.withColumn("left", F.aggregate("q", start, draw)["left"])
        left = F.struct(F.col("first_shard"), F.when(F.col("n") > 1, F.col("half")).otherwise(F.col("n")).alias("n"), F.when(F.col("n") > 1, F.zip_with("q", "left", lambda x, k: F.struct(x["rank"].alias("rank"), k.alias("blocks")))).otherwise(F.col("q")).alias("q"))
        right = F.struct((F.col("first_shard") + F.col("half")).alias("first_shard"), (F.col("n") - F.col("half")).alias("n"), F.zip_with("q", "left", lambda x, k: F.struct(x["rank"].alias("rank"), (x["blocks"] - k).alias("blocks"))).alias("q"))
        children = F.when(F.col("n") > 1, F.array(left, right)).otherwise(F.array(left))
        node = node.select(F.explode(children).alias("c")).select("c.first_shard", "c.n", "c.q")
        level *= 2
    leaves = node.select(F.col("first_shard").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rank", "x.blocks")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("rank", "shard", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"), "blocks")


def sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source_key, size, key and what is carried along: key is the permutation's hash, as 32 hexadecimal digits.

    source_key is "=" and the source, or empty for a null source.
    """
    doc = F.col("doc_id").cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    key = F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(doc.alias("doc_id"), source.alias("source_key"), number_of_words(F.col("text")).alias("size"), key.alias("key"), *carried)


def mixed(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows of sized() with rank, source_size, target and draws: an array of (shard, round, words, place)."""
    bits = (blocks - 1).bit_length()
    block = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)
    d = sizes.withColumn("block", block)
    per_block = d.groupBy("source_key", "block").agg(F.sum("size").alias("size"))
    per_block = per_block.join(targets(per_block, weights, share, most), "source_key")
    of_source, order = Window.partitionBy("source_key"), Window.partitionBy("source_key").orderBy("block")
    goal = F.floor("target").cast("long")
    plan = per_block.select(
        "source_key", "block", "rank", "source_size", "target",
        (F.row_number().over(order) - 1).cast("long").alias("number"), F.count("*").over(of_source).alias("n_blocks"),
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long").alias("rounds"),
    ).withColumn("last", goal - F.col("rounds") * F.col("source_size"))
    drawn = F.col("rounds") * F.col("n_blocks") + F.sum(F.when(F.col("before") < F.col("last"), 1).otherwise(0)).over(of_source)
    plan = plan.withColumn("quota", drawn)
    tree = splitting_tree(plan.where("number = 0").select("rank", F.col("quota").alias("blocks")), shards, seed)
    cuts = tree.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("cuts"))
    # the r-th round's draw of a block is draw number r * n_blocks + number of its source
    whose = lambda n: F.element_at(F.filter("cuts", lambda c: c["first"] <= n), -1)["shard"]
    plan = plan.join(cuts, "rank").select("source_key", "block", "rank", "source_size", "target", "before", "last", "rounds", F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds")), lambda r: whose(r * F.col("n_blocks") + F.col("number"))).alias("shards"))
    within = Window.partitionBy("source_key", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("in_block", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, ["source_key", "block"])
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("last") - F.col("before") - F.col("in_block")))
    place = lambda r, shard: F.md5(F.concat_ws(":", F.lit(str(seed)), shard.cast("string"), r.cast("string"), F.col("key")))
    draws = F.transform("shards", lambda shard, r: F.struct(shard.alias("shard"), r.alias("round"), F.when(r < F.col("rounds"), F.col("size")).otherwise(part).alias("words"), place(r, shard).alias("place")))
    return out.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0)).drop("block", "in_block", "before", "last", "rounds", "shards")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each draw of a document, with the columns of docs and mix_shard, mix_round, mix_words
    and mix_place; a shard's rows in order of mix_place are shuffled. A last document counts only its first mix_words words.
    Where docs has columns of these names, the new ones get underscores in front."""
    d = mixed(written(sized(docs, F.struct(*own_columns(docs)).alias("row"))), **how).select("row", F.explode("draws").alias("draw"))
    names = free_names(docs, "mix_shard", "mix_round", "mix_words", "mix_place")
    return d.select("row.*", *[F.col("draw")[x].alias(c) for c, x in zip(names, ("shard", "round", "words", "place"), strict=True)])


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return mixed(written(sized(docs)), **how).select("doc_id", "size", "source_size", "target", words.alias("taken"))


def shards(docs: DataFrame, **how) -> DataFrame:
    """shard, source, documents (draws) and words of each: what the splitting tree deals to the output shards."""
    d = mixed(written(sized(docs)), **how).select("source_key", F.explode("draws").alias("draw"))
    source = F.when(F.col("source_key") != "", F.substring("source_key", 2, 1 << 30))
    return d.groupBy(F.col("draw.shard").alias("shard"), source.alias("source")).agg(F.count("*").alias("documents"), F.sum("draw.words").alias("words"))


#: DuckDB SQL for taken() with its default parameters: who takes how much follows from the permutation alone.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT *, row_number() OVER (ORDER BY k = '', k) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM r),
l AS (
  SELECT *, (1.5 * total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
m AS (SELECT *, min_by(level, cap::DOUBLE / weight) FILTER (cap::DOUBLE / weight > level) OVER () AS shared FROM l),
t AS (SELECT k, source_size, CASE WHEN shared IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, shared * weight) END AS target FROM m),
g AS (SELECT *, floor(target)::BIGINT AS goal FROM t),
o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS rounds, g.goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g USING (k))
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, goal - rounds * source_size - before)))::BIGINT AS taken FROM o
"""
