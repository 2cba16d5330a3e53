"""Relational operators hidden in document processing, as DataFrame transformations.

Each keeps to one shuffle by its key where it needs one at all; lookups of bounded tables are left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row for each key: the first by the given order, as cross-reference sections override older ones."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def resolve(df: DataFrame, ref: str, objects: DataFrame, key: str, hops: int = 1, next_ref: str | None = None) -> DataFrame:
    """Follows a reference: a left join, so that a dangling reference reads as null; further hops follow `next_ref`."""
    out = df
    at = ref
    for hop in range(hops):
        side = objects.select(*[F.col(c).alias(f"{c}_{hop}" if hops > 1 else c) for c in objects.columns])
        own = f"{key}_{hop}" if hops > 1 else key
        out = out.join(side, out[at] == side[own], "left")
        if next_ref is None:
            break
        at = f"{next_ref}_{hop}" if hops > 1 else next_ref
    return out


def inherit(df: DataFrame, name: str, *nearest_first: Column) -> DataFrame:
    """An attribute that a node takes from its nearest ancestor that has it."""
    return df.withColumn(name, F.coalesce(*nearest_first))


def leaves(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Nodes that no node names as its parent."""
    parents = nodes.select(F.col(parent).alias("_parent")).where(F.col("_parent").isNotNull()).distinct()
    return nodes.join(parents, nodes[key] == parents["_parent"], "left_anti")


def free_entries(used: DataFrame, number: str) -> DataFrame:
    """number, in_use: every number from 0 to the largest used one, as a classic cross-reference table lists them.

    The numbers are dealt out by range, a slice for each task: none of them holds all.
    """
    top = used.agg(F.max(number)).first()[0] or 0
    have = used.select(F.col(number).alias("_have")).distinct()
    every = used.sparkSession.range(0, top + 1).select(F.col("id").alias("number"))
    return every.join(have, F.col("number") == F.col("_have"), "left").select("number", F.col("_have").isNotNull().alias("in_use"))


def override(base: DataFrame, delta: DataFrame, key: str, column: str) -> DataFrame:
    """Base rows with the delta's values by key; keys that the base lacks are not added."""
    d = delta.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    out = base.join(d, base[key] == d["_key"], "left")
    return out.select(*[F.coalesce("_new", base[c]).alias(c) if c == column else base[c] for c in base.columns])


def renumbered(parts: list[DataFrame], key: str, block: int = 1 << 16) -> DataFrame:
    """The union of the parts with `source` (their place) and `new_id`: 1.. by (source, key), without one task for all rows.

    Rows are numbered inside ranges of keys; the ranges' offsets are a window over their counts.
    """
    every = None
    for n, part in enumerate(parts):
        p = part.select(F.lit(n).alias("source"), F.col(key).cast("long").alias("old_id"))
        every = p if every is None else every.unionByName(p)
    every = every.withColumn("_range", F.floor(F.col("old_id") / block))
    before = Window.orderBy("source", "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = every.groupBy("source", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("source", "_range").orderBy("old_id")
    placed = every.withColumn("_at", F.row_number().over(inside)).join(counts.drop("_n"), ["source", "_range"])
    return placed.select("source", "old_id", (F.col("_before") + F.col("_at")).alias("new_id"))


def extract_positions(pages: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """The pages at the given places, in the given order, repeats kept, places that don't exist left out; adds out_index."""
    # plain (place, index) rows of the argument: bounded by the caller's list
    spark = pages.sparkSession
    places = spark.createDataFrame([(n, int(i)) for n, i in enumerate(wanted)], "_at int, _index long")
    hit = pages.join(places, pages[index] == places["_index"])
    return hit.withColumn("out_index", F.row_number().over(Window.orderBy("_at")).cast("long") - 1).drop("_at", "_index")


def reading_order(fragments: DataFrame, page: list[str], x: str, y: str, seq: str, text: str) -> DataFrame:
    """Text of each page: fragments by rounded y from the top, then x, then emission; a space within a line, else a new line."""
    line = F.round(F.col(y)).alias("_line")
    word = F.struct(F.col(x).alias("x"), F.col(seq).alias("s"), F.col(text).alias("t"))
    lines = fragments.groupBy(*page, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["t"]), " ").alias("_text"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_line")).alias("k"), F.col("_text").alias("t"))))
    return lines.groupBy(*page).agg(F.array_join(F.transform(ordered, lambda w: w["t"]), "\n").alias("page_text"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with this row: the current font of a content stream."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def joined_pages(pages: DataFrame, doc: str, index: str, text: str, separator: str = "\f") -> DataFrame:
    """One text for each document: its pages' texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), separator).alias("document_text"))


def revocation_summary(df: DataFrame, key: str, status: Column) -> DataFrame:
    """Revoked if any link is; else Incomplete if any is unknown; else Good."""
    verdict = F.when(F.bool_or(status == "revoked"), "Revoked").when(F.bool_or(status == "unknown"), "Incomplete").otherwise("Good")
    return df.groupBy(key).agg(verdict.alias("summary"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Distinct by key, first seen kept."""
    return newest_wins(df, keys, order)


def ranges_lookup(codes: DataFrame, code: str, ranges: DataFrame, how: str = "last") -> DataFrame:
    """Joins codes to ranges (lo, hi, base, ord) that hold them: the last defined wins ("last"), or the first ("first").

    An equi-join on blocks of 256 codes: a range is listed under each block it touches, and ranges of 65,536 codes or more are ignored.
    """
    r = ranges.where("hi - lo < 65536 and hi >= lo").withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / 256), F.floor(F.col("hi") / 256))))
    c = codes.withColumn("_block", F.floor(F.col(code) / 256))
    pick = F.max_by if how == "last" else F.min_by
    hit = c.join(r, "_block", "left").where(F.col("lo").isNull() | F.col(code).between(F.col("lo"), F.col("hi")))
    target = F.when(F.col("lo").isNotNull(), F.col("base") + F.col(code) - F.col("lo"))
    mapped = hit.groupBy(code).agg(pick(target, F.col("ord")).alias("mapped"))
    return codes.join(mapped, code, "left")


def as_of(df: DataFrame, at: str, marks: DataFrame, start: str) -> DataFrame:
    """Each row with the mark of the greatest start that is not after it. Marks are few (label ranges): a sorted array."""
    every = marks.agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("_start"), *[F.col(c) for c in marks.columns if c != start]))).alias("_marks"))
    out = df.join(F.broadcast(every.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left")
    hit = F.try_element_at(F.filter("_marks", lambda m: m["_start"] <= F.col(at)), F.lit(-1))
    return out.withColumn("_hit", hit).drop("_marks", "_one")


def majority(votes: DataFrame, key: str, accepts: Column, least: int = 3) -> DataFrame:
    """Keys with enough votes, and whether more than half accept."""
    g = votes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(accepts).alias("yes"))
    return g.where(F.col("n") >= least).select(key, "n", "yes", (F.col("yes") * 2 > F.col("n")).alias("accepted"))


def worst(df: DataFrame, keys: list[str], value: Column, score: Column, seq: Column) -> DataFrame:
    """The value with the highest score; of ties the last."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(score, seq)).alias("worst"))


def qualified_names(nodes: DataFrame, key: str, parent: str, name: str, depth: int = 64) -> DataFrame:
    """key, fqn: names from the root down, joined by "."; nodes deeper than `depth` are left out.

    One join for each level that exists; the loop ends with the tree's depth, not with `depth`.
    """
    level = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("key"), F.col(name).alias("fqn"))
    out = level
    child = nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"), F.col(name).alias("_name"))
    for _ in range(depth):
        level = child.join(level, child["_parent"] == level["key"]).select(F.col("_key").alias("key"), F.concat_ws(".", "fqn", F.when(F.col("_name") != "", F.col("_name"))).alias("fqn"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
