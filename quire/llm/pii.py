"""Information-theoretic sanitisation of personal data; DataFrame operations only.

Base entities are spans of four kinds, found by pattern in every whole text. An entity, however rare, is
protected beyond its own spans: a term t of the corpus discloses it as far as

    D(t, e) = PMI(t, e) / IC(e) = log(n_te n / (n_t n_e)) / log(n / n_e)

with counts of distinct texts: n of all, n_t with the term, n_e with the entity, n_te with both. Both means that the term stands
whole within `WINDOW` characters of a span of the entity (or in it), in any number of texts; or anywhere in the same text, if at least
`SUPPORT` texts have both, as fewer may meet by chance. The larger D counts. D = 1 means that whoever reads the term knows the entity. From `GENERALISE` on, a term is generalised (to [WORD] or [NUMBER]) in
every text that has it; from `REMOVE` on it is removed. Terms are runs of letters and digits, lower-cased.

Defined cases: null text is empty; empty texts have no span; exact copies count as one text in the statistics, and each gets its
spans; rows that repeat give rows each; ids may be null; other columns are not read by found(), and kept by sanitised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_names, only_marked, own_columns, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Texts that must hold a term and an entity if the term may stand anywhere in them; beside the entity one is enough.
SUPPORT = 3
#: Characters on each side of an entity that are beside it.
WINDOW = 64
GENERALISE = 0.9
REMOVE = 0.98

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns. Possessive runs that can't start inside a run keep them linear; what they match is the same.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match: cheap to look for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"[\p{L}\p{N}]+"


def _spans(text: Column, pattern: str, keep) -> Column:
    """Array of (start, end, value) of the matches whose value is kept, in code points: the gaps between matches give the places.

    Both arrays are zipped, so that the text is split once and not once for each match.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    pairs = F.transform(both, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("size"), x["value"].alias("value")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))

    def step(s, x):
        start = s["at"] + x["gap"]
        end = start + x["size"]  # null after the last gap
        more = F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(end.isNotNull() & keep(x["value"]), more).otherwise(s["out"]).alias("out"))

    return F.aggregate(pairs, state, step)["out"]


def _luhn(digits: Column) -> Column:
    def add(s, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add), F.lit(10)) == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str):
    if kind == "ip":
        return lambda x: x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return lambda x: F.length(_digits(x)).between(14, 19) & _luhn(_digits(x))
    if kind == "phone":
        return lambda x: F.length(_digits(x)).between(10, 15)
    return lambda x: F.lit(True)


def _of_kind(no: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """Array of (start, no, end, kind, value), by start, then kind as listed."""
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,value:string>>")
    every = []
    for no, kind in enumerate(KINDS):
        good = _spans(text, PATTERNS[kind], _valid(kind))
        typed = F.transform(good, _of_kind(no, kind))
        may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        every.append(F.when(may & text.rlike(PATTERNS[kind]), typed).otherwise(none))
    return F.array_sort(F.concat(*every))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def _beside(text: Column, start: Column, end: Column, window: int) -> Column:
    """The terms that stand whole within so many characters of the span, and the span's own."""
    first = F.greatest(start - window - 1, F.lit(0))  # one more on each side shows whether a term goes on there
    piece = F.substring(text, (first + 1).cast("int"), (end + window + 1 - first).cast("int"))
    piece = F.when(start > window, F.regexp_replace(piece, rf"^{_TERM}", "")).otherwise(piece)
    piece = F.when(F.length(text) > end + window, F.regexp_replace(piece, rf"(?<![\p{{L}}\p{{N}}]){_TERM}+\z", "")).otherwise(piece)
    return _terms(piece)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def disclosing_terms(texts: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = GENERALISE, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure) from `least` on, and (term, text_hash) where those terms occur.

    texts: text, text_hash; base: text_hash, spans.
    """
    value = lambda x: F.when(x["kind"].isin("card", "phone"), _digits(x["value"])).otherwise(F.lower(x["value"]))
    entity = lambda x: F.concat_ws(":", x["kind"], value(x))
    n = base.select("text_hash").distinct().count()
    wanted = base.where(F.size("spans") > 0).select(F.col("text_hash").alias("mark"))
    holders = only_marked(texts, F.col("text_hash"), wanted).groupBy("text_hash").agg(F.first("text").alias("text"))
    holders = written(holders.withColumn("spans", base_spans(F.col("text")))).where(F.size("spans") > 0)
    held = holders.select("text_hash", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    sizes = written(held.groupBy("entity").agg(F.count("*").alias("n_e")))
    often = written(held.join(sizes.where(F.col("n_e") >= support), "entity"))
    near = often.join(holders.select("text_hash", _terms(F.col("text")).alias("terms")), "text_hash").select("entity", "n_e", "text_hash", F.explode("terms").alias("term"))
    both = near.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    each = F.transform("spans", lambda x: F.struct(entity(x).alias("entity"), _beside(F.col("text"), x["start"], x["end"], window).alias("terms")))
    beside = holders.select("text_hash", F.explode(each).alias("x")).select("text_hash", "x.entity", F.explode("x.terms").alias("term"))
    beside = written(beside.distinct())
    single = beside.groupBy("entity", "term").agg(F.count("*").alias("n_te")).join(sizes, "entity").select("entity", "n_e", "term", "n_te")
    # n_t is at least the number of texts here: that already rules out the common terms
    seen = lambda d: d.groupBy("term").agg(F.count_distinct("text_hash").alias("seen"))
    most = F.col("n_te") * F.pow(F.lit(float(max(n, 1))) / F.col("n_e"), 1 - least) + 1e-6
    few = lambda pairs, d: pairs.join(seen(d), "term").where(F.col("seen") <= most)
    pairs = written(few(both, near).unionByName(few(single, beside)))
    candidates = pairs.select("term").distinct()
    copied = base.groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("text_hash").alias("mark"))
    terms = lambda t: t.select("text_hash", F.explode(_terms(F.col("text"))).alias("term"))
    wanted_terms = candidates.select(F.xxhash64("term").alias("mark"))
    # texts without copies are counted where they are; only those with copies need their (term, text) pairs made distinct
    alone = only_marked(terms(only_marked(texts, F.col("text_hash"), copied, inside=False)), F.xxhash64("term"), wanted_terms).groupBy("term").agg(F.count("*").alias("n"))
    twice = only_marked(terms(only_marked(texts, F.col("text_hash"), copied)), F.xxhash64("term"), wanted_terms).distinct().groupBy("term").agg(F.count("*").alias("n"))
    counts = alone.unionByName(twice).groupBy("term").agg(F.sum("n").alias("n_t"))
    d = F.log(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    told = pairs.join(counts, "term").where(F.col("n_e") < n).select("term", d.alias("d")).groupBy("term").agg(F.max("d").alias("disclosure"))
    told = written(told.where(F.col("disclosure") >= least))
    places = only_marked(terms(texts), F.xxhash64("term"), told.select(F.xxhash64("term").alias("mark"))).join(told.select("term"), "term").distinct()
    return told, places


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def term_spans(texts: DataFrame, base: DataFrame, **how) -> DataFrame:
    """text_hash, extra: the spans of disclosing terms outside the base spans, for each text that has some."""
    told, places = disclosing_terms(texts, base, **how)
    of_text = written(places.join(told, "term").groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told")))
    hit = only_marked(texts, F.col("text_hash"), of_text.select(F.col("text_hash").alias("mark"))).join(of_text, "text_hash")
    hit = hit.groupBy("text_hash").agg(F.first("text").alias("text"), F.first("told").alias("told")).withColumn("spans", base_spans(F.col("text")))
    told = F.col("told")
    hits = _spans(F.col("text"), _TERM, lambda v: F.map_contains_key(told, F.lower(v)))
    said = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("no"), x["end"].alias("end"), F.lit(TERM).alias("kind"), x["value"].alias("value"), F.try_element_at(told, F.lower(x["value"])).alias("disclosure")))
    free = F.filter(said, lambda x: ~F.exists("spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return hit.select("text_hash", free.alias("extra")).where(F.size("extra") > 0)


def spans_of(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """base (doc_id, text_hash, spans: a row for each document) and extra (text_hash, extra)."""
    texts = _prepared(docs)
    base = written(texts.select("doc_id", "text_hash", base_spans(F.col("text")).alias("spans")))
    return base, written(term_spans(texts, base, **how))


def found(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    base, extra = spans_of(docs, **how)
    d = base.join(extra, "text_hash", "left")
    plain = lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"), x["kind"].alias("kind"))
    more = F.when(F.col("extra").isNull(), F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")).otherwise(F.transform("extra", plain))
    every = F.array_sort(F.concat(F.transform("spans", plain), more))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size(more).cast("long").alias("n_term"))


def sanitised(docs: DataFrame, remove: float = REMOVE, **how) -> DataFrame:
    """The documents, all columns as they came, with base spans replaced by [KIND] and disclosing terms generalised or removed."""
    _, extra = spans_of(docs, **how)
    hash_, terms = free_names(docs, "text_hash", "extra")
    text = F.coalesce("text", F.lit(""))
    d = docs.join(extra.select(F.col("text_hash").alias(hash_), F.col("extra").alias(terms)), F.xxhash64(text) == F.col(hash_), "left")
    cut = lambda x, tag: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"), tag.alias("tag"))
    base = F.transform(base_spans(text), lambda x: cut(x, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
    general = lambda x: F.when(x["disclosure"] >= remove, F.lit("")).when(x["value"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
    more = F.coalesce(F.transform(terms, lambda x: cut(x, general(x))), F.array().cast("array<struct<start:bigint,no:int,end:bigint,tag:string>>"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - s["at"]).cast("int"))
        said = F.when(x["start"] >= s["at"], F.concat(gap, x["tag"])).otherwise(F.lit(""))  # a span inside another goes with it
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.array_append(s["out"], said).alias("out"))

    pieces = F.aggregate(F.array_sort(F.concat(base, more)), state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("text").isNull(), F.col("text")).otherwise(pieces)
    return d.select(*[new.alias(c) if c == "text" else own for c, own in zip(docs.columns, own_columns(docs), strict=True)])
