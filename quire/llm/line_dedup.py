"""Line dedup: an exact set-similarity join of lines; DataFrame operations only.

A line is the set of its tokens (between white space, as written). One pass over the texts counts all tokens in 2^18
hashed bins; a second one writes, for each line, its token set's hash and size, a sketch, and its prefix: with the
tokens in order of rarity (quarter octaves of their bin's count, then hash), sets with Jaccard >= t share one of the
first n - ceil(t n) + 1 of each. Lines with equal sets form a class; only the class's first line goes on. Classes get
numbers in the order of their first lines and meet in a join on the prefix tokens, filtered by length, by position
(what can still be shared after the token) and by the sketch: the parities of the tokens' hashes in 64 cells (128 for long
lines), of which every differing token turns one. Pairs that pass are verified on the whole token sets, read again from the texts: first the likeliest
earlier partner of each class, then the others of the classes still without a match.

Before that join, classes of crowded groups are compared with the first class that shares one of three min-hashes of
their prefix. Those that match it are settled: pairs of two settled classes are not made, so that a group of near copies costs about its size, not its square.

A line is removed if a line before it, by (doc_id, hash of the text, line number), is similar, whether that one stays or not.

Defined cases: null and empty texts have one empty line; lines without tokens stay; null ids come first; lines
at the same place of rows that repeat an id and a text are one place, and stay or go together; ids that several texts
share, and null ids, are told apart by the text's hash; other columns are not read, and keep their names and values.
Sets are the same if their 64-bit hashes are, tokens if their 56-bit codes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, free_names, only_marked, own_columns, written

SIMILARITY = 0.8
#: What tells a line from all others: rows that agree in it are one.
PLACE = ("doc_id", "text_hash", "line_no")
#: Hashed bins of token counts; their levels are the one thing that goes through the driver.
BIN_BITS = 18
#: Classes that share a min-hash before they count as crowded, and bins in which they are counted first.
CROWD = 256
CROWD_BITS = 18
#: Sets of more tokens have 128 cells in their sketch, others 64.
LONG = 80


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line: the first three are the line's place."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _pieces(text: Column) -> Column:
    """The tokens of a text without line ends, and empty strings; translating only where there is something to translate is much cheaper."""
    other = [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"]
    plain = F.when(other[0] | other[1] | other[2] | other[3], F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    return F.split(plain, " ")


def _words(text: Column) -> Column:
    return F.array_remove(_pieces(text), "")


def _bin_of(hashed: Column) -> Column:
    return hashed.bitwiseAND((1 << BIN_BITS) - 1).cast("int")


def _bin(token: Column) -> Column:
    return _bin_of(F.xxhash64(token))


def rarity_levels(docs: DataFrame) -> list[int]:
    """For each bin, quarter octaves of the number of its tokens in all texts; empty strings count in a bin of theirs."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    counted = docs.select(F.explode(_pieces(text)).alias("word")).groupBy(_bin(F.col("word")).alias("bin")).agg(F.count("*").alias("n"))
    packed = counted.select(F.shiftright("bin", 9).alias("part"), (F.col("bin") * 256 + F.least(F.lit(255), F.floor(F.log2("n") * 4))).cast("int").alias("x"))
    out = [0] * (1 << BIN_BITS)
    for row in packed.groupBy("part").agg(F.collect_list("x").alias("all")).toLocalIterator():
        for x in row["all"]:
            out[x >> 8] = x & 255
    return out


def _needed(a: Column, b: Column, t: float) -> Column:
    """Tokens that sets of these sizes must share for Jaccard >= t."""
    return F.ceil((a + b) * (t / (1 + t)) - 1e-9)


def ranks(line: Column, levels: list[int]) -> Column:
    """The codes of a line's distinct tokens, the rarest first; as they can't be null, they are sorted as plain longs."""
    level = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")  # a literal by constant folding
    ranked = lambda h: F.shiftleft(F.coalesce(F.get(level, _bin_of(h)), F.lit(0).cast("long")), 48).bitwiseOR(F.shiftrightunsigned(h, 16))
    return F.sort_array(F.array_distinct(F.transform(F.transform(_words(line), lambda x: F.xxhash64(x)), ranked)))


def line_sets(docs: DataFrame, similarity: float, levels: list[int]) -> DataFrame:
    """row (unique), place, key (hash of the token set), n, sketch_1, sketch_2, prefix (the rarest tokens, in order) of every line with tokens."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # the row number keeps the filter from being pushed below the tokens, which would compute them twice
    s = _lines(docs).select(F.monotonically_increasing_id().alias("row"), *PLACE, ranks(F.col("line"), levels).alias("tokens")).where(F.size("tokens") > 0)
    n = F.size("tokens")
    cell = lambda x: F.shiftright(x, 20).bitwiseAND(63).cast("int")
    every = F.aggregate("tokens", none, lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", one, cell(x))))
    half = F.when(n > LONG, F.aggregate("tokens", none, lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", F.shiftright(x, 30).bitwiseAND(1), cell(x))))).otherwise(none)
    # a set this small has no other within the similarity
    alone = n + 1e-9 < similarity / (1 - similarity) if similarity < 1 else F.lit(True)
    prefix = F.when(alone, F.array().cast("array<bigint>")).otherwise(F.slice("tokens", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")))
    return s.select("row", *PLACE, F.xxhash64("tokens").alias("key"), n.alias("n"), every.bitwiseXOR(half).alias("sketch_1"), half.alias("sketch_2"), prefix.alias("prefix"))


def first_lines(lines: DataFrame) -> DataFrame:
    """ord, key, place and row of each class's first line, and how many lines it has; ord has the order of the places."""
    first = lines.groupBy("key").agg(F.min(F.struct(*PLACE, "row")).alias("first"), F.count("*").alias("copies"))
    out = first.select("key", *[F.col(f"first.{c}").alias(c) for c in (*PLACE, "row")], "copies")
    return out.orderBy(F.asc_nulls_first("doc_id"), "text_hash", "line_no", "row").withColumn("ord", F.monotonically_increasing_id())


def _apart(a: str, b: str) -> Column:
    """Tokens by which two sets differ at least: those in one half of the hashes, and in the other, turn cells of their own where both sets are long."""
    one, two = (F.col(f"{a}_sketch_{k}").bitwiseXOR(F.col(f"{b}_sketch_{k}")) for k in (1, 2))
    long = F.least(F.col(f"{a}_n"), F.col(f"{b}_n")) > LONG
    return F.when(long, F.bit_count(one) + F.bit_count(two)).otherwise(F.bit_count(one.bitwiseXOR(two))).cast("int")


def _may_be_similar(a: str, b: str, t: float) -> Column:
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (F.least(na, nb) >= F.greatest(na, nb) * t - 1e-9) & (_apart(a, b) <= na + nb - 2 * _needed(na, nb, t))


FACTS = ("n", "sketch_1", "sketch_2")


def _min_hashes() -> Column:
    """Three min-hashes of the prefix."""
    spread = lambda bits: F.transform("prefix", lambda x: F.call_function("shiftleft", x, F.lit(bits)))
    low, high = spread(16), spread(36)
    hashes = F.array_distinct(F.array(F.array_min(low), F.array_max(low), F.array_min(high)))
    return F.when(F.size("prefix") > 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes")


def crowded(classes: DataFrame, similarity: float, least: int = CROWD) -> DataFrame:
    """left, right, apart: classes with the first class that shares a min-hash of the prefix, where at least `least` do."""
    seen = classes.select("ord", *FACTS, F.explode("hashes").alias("hash"))
    bin_ = F.xxhash64("hash").bitwiseAND((1 << CROWD_BITS) - 1).cast("int")
    # bins first: most of the classes share their min-hashes with few others and need no shuffle
    bins = seen.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("bin").alias("mark"))
    among = written(only_marked(seen, bin_, bins, bits=CROWD_BITS))  # it is read three times
    first = among.groupBy("hash").agg(F.min("ord").alias("left"), F.count("*").alias("n")).where(F.col("n") >= least).select("hash", "left")
    pairs = among.join(first, "hash").where(F.col("left") < F.col("ord")).select("left", *[F.col(c).alias(f"b_{c}") for c in ("ord", *FACTS)])
    facts = classes.select(*[F.col(c).alias(f"a_{c}") for c in ("ord", *FACTS)])
    # few classes are first: a map of them spares the others the join
    met = pairs.join(only_marked(facts, F.col("a_ord"), first.select(F.col("left").alias("mark"))), F.col("left") == F.col("a_ord"))
    return met.where(_may_be_similar("a", "b", similarity)).select("left", F.col("b_ord").alias("right"), _apart("a", "b").alias("apart")).distinct()


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """left, right, apart: classes (left first) whose prefixes meet and that pass the filters, for all rights not yet `settled`."""
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.when(F.col("settled"), 1).otherwise(0)
    index = classes.where(F.size("prefix") > 0).select("ord", "sketch_1", "sketch_2", packed.alias("packed"), F.posexplode("prefix").alias("place", "token"))
    index = index.select("token", "ord", (F.col("packed") + F.col("place") * 2).alias("packed"), "sketch_1", "sketch_2")
    a, b = (index.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("ord", "packed", "sketch_1", "sketch_2")]) for x in "ab")
    part = lambda x: {f"{x}_n": F.shiftright(f"{x}_packed", 32), f"{x}_place": F.shiftright(f"{x}_packed", 1).bitwiseAND((1 << 31) - 1) + 1}
    # naming both sides keeps this in the join, so that both sides stay one and the same exchange
    waits = F.col("b_packed").bitwiseAND(F.when(F.col("a_packed") >= 0, 1).otherwise(0)) == 0
    met = a.join(b, "token").withColumns(part("a") | part("b"))
    needed = _needed(F.col("a_n"), F.col("b_n"), similarity)
    placed = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) + 1 >= needed
    met = met.where((F.col("a_ord") < F.col("b_ord")) & _may_be_similar("a", "b", similarity) & placed & waits)
    return met.select(F.col("a_ord").alias("left"), F.col("b_ord").alias("right"), _apart("a", "b").alias("apart")).distinct()


def token_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """ord, set (64-bit hashes of the tokens) of the lines at the given places (ord, doc_id, text_hash, line_no).

    Only texts, and of them only lines, whose hash is marked in a map of bounded size are split and go through the join.
    """
    texts = only_marked(docs.select("doc_id", "text"), F.xxhash64(F.coalesce("text", F.lit(""))), places.select(F.col("text_hash").alias("mark")))
    lines = only_marked(_lines(texts), F.xxhash64("text_hash", "line_no"), places.select(F.xxhash64("text_hash", "line_no").alias("mark")))
    lines = lines.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("line_no").alias("l"), F.array_distinct(F.transform(_words(F.col("line")), lambda x: F.xxhash64(x))).alias("set"))
    found = places.join(lines, places.doc_id.eqNullSafe(lines.d) & (places.text_hash == lines.t) & (places.line_no == lines.l))
    return found.select("ord", "set").groupBy("ord").agg(F.first("set").alias("set"))


def _jaccard(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """left, right, jaccard of the pairs that are similar."""
    a, b = (sets.select(F.col("ord").alias(x), F.col("set").alias(f"{x}_set")) for x in ("left", "right"))
    shared = F.size(F.array_intersect("left_set", "right_set"))
    jaccard = shared / (F.size("left_set") + F.size("right_set") - shared)
    return pairs.join(a, "left").join(b, "right").select("left", "right", jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity - 1e-9)


def verified(scratch: Scratch, docs: DataFrame, firsts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """right, match (a left), jaccard: for each right that has a similar left."""
    pairs = scratch.written(pairs)
    used = pairs.select(F.col("left").alias("ord")).unionByName(pairs.select(F.col("right").alias("ord"))).distinct()
    sets = scratch.written(token_sets(docs, firsts.select("ord", *PLACE).join(used, "ord", "left_semi")))
    likeliest = pairs.groupBy("right").agg(F.min(F.struct("apart", "left")).alias("x")).select(F.col("x.left").alias("left"), "right")
    found = scratch.written(_jaccard(likeliest, sets, similarity).select("right", F.col("left").alias("match"), "jaccard"))
    others = pairs.select("left", "right").join(found, "right", "left_anti")
    late = _jaccard(others, sets, similarity).groupBy("right").agg(F.max_by("left", F.struct("jaccard", "left")).alias("match"), F.max("jaccard").alias("jaccard"))
    return scratch.written(found.unionByName(late.select("right", "match", "jaccard")))


def marked_lines(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_hash, line_no, match (number of a class before it that it repeats), jaccard: the lines to remove."""
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as wide:  # only keys and places of the lines are used later
            sets = wide.written(line_sets(docs, similarity, rarity_levels(docs)))
            firsts = scratch.written(first_lines(sets.select("row", "key", *PLACE)))
            classes = scratch.written(sets.select("row", *FACTS, "prefix").join(firsts.select("row", "ord"), "row").select("ord", *FACTS, "prefix", _min_hashes()))
            lines = scratch.written(sets.select("key", *PLACE))
        early = verified(scratch, docs, firsts, crowded(classes, similarity, crowd), similarity)
        settled = classes.join(early.select(F.col("right").alias("ord"), F.lit(True).alias("found")), "ord", "left").withColumn("settled", F.col("found").isNotNull())
        late = verified(scratch, docs, firsts, candidates(settled, similarity), similarity)
        again = late.join(early, "right", "left_anti").unionByName(early)
        first = [F.col(c).alias(f"first_{c}") for c in PLACE]
        known = firsts.select("ord", "key", *first, "copies").join(again.withColumnRenamed("right", "ord"), "ord", "left").where((F.col("copies") > 1) | F.col("match").isNotNull())
        known = scratch.written(known.select("key", F.coalesce("match", "ord").alias("match"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.col("match").isNotNull().alias("whole"), *[f"first_{c}" for c in PLACE]))
        own = only_marked(lines.select("key", *PLACE), F.col("key"), known.select(F.col("key").alias("mark")))
        later = ~(F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_hash") == F.col("first_text_hash")) & (F.col("line_no") == F.col("first_line_no")))
        return scratch.kept(own.join(known, "key").where(later | F.col("whole")).select(*PLACE, "match", "jaccard"))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_removed, removed (line numbers from 0, ascending), text_hash, for each id and text with a line to remove."""
    return marked_lines(docs, similarity).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed")).select("doc_id", F.size("removed").alias("n_removed"), "removed", "text_hash")


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns as they came, their texts without the repeated lines; no document goes."""
    gone_id, gone_text, numbers = free_names(docs, "gone_id", "gone_text", "gone_lines")
    gone = removed_lines(docs, similarity).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text), F.col("removed").alias(numbers))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(numbers), i)), "\n")
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept)
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(gone_text)), "left")
    return joined.select(*[text.alias(c) if c == "text" else own for c, own in zip(docs.columns, own_columns(docs), strict=True)])
