"""Queries of the relational operators over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import relational as R

_all: dict[str, tuple] = {}


def _query(sql: str):
    def add(f):
        _all[f.__name__] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}


@_query("""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS inherited
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def page_tree_inherit(spark, d):
    tree = R.resolve(R.resolve(_t(spark, d, "customer"), "c_nationkey", _t(spark, d, "nation"), "n_nationkey"), "n_regionkey", _t(spark, d, "region"), "r_regionkey")
    own, parent = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return R.inherit(tree, "inherited", own, parent, F.col("r_name")).select("c_custkey", "inherited")


_TREE = """
WITH nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


def _tree(spark, d):
    node = lambda t, k, p, n, a, b: t.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("id"), (F.concat(F.lit(b), F.col(p).cast("string")) if p else F.lit(None).cast("string")).alias("parent"), F.col(n).alias("name"))
    out = node(_t(spark, d, "region"), "r_regionkey", None, "r_name", "r", "")
    out = out.unionByName(node(_t(spark, d, "nation"), "n_nationkey", "n_regionkey", "n_name", "n", "r"))
    return out.unionByName(node(_t(spark, d, "customer"), "c_custkey", "c_nationkey", "c_name", "c", "n"))


@_query(_TREE + " SELECT substr(id, 1, 1) AS level, count(*) AS n_leaves FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes k WHERE k.parent = n.id) GROUP BY 1")
def leaf_page_count(spark, d):
    return R.leaves(_tree(spark, d), "id", "parent").groupBy(F.substring("id", 1, 1).alias("level")).agg(F.count("*").alias("n_leaves"))


@_query(_TREE.replace("WITH nodes", "WITH RECURSIVE nodes") + """, t AS (
  SELECT id, name AS fqn FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, t.fqn || '.' || n.name FROM nodes n JOIN t ON n.parent = t.id)
SELECT id AS key, fqn FROM t""")
def fqn_fields(spark, d):
    return R.qualified_names(_tree(spark, d), "id", "parent", "name")


@_query("""
SELECT n_name, count(*) AS n_lines, count(o_orderkey) AS n_resolved FROM lineitem
LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def resolve_ref_chain(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey")
    out = R.resolve(lines, "l_orderkey", _t(spark, d, "orders").select("o_orderkey", "o_custkey").where("o_orderkey % 7 != 0"), "o_orderkey")
    out = R.resolve(R.resolve(out, "o_custkey", _t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), "c_nationkey", _t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return out.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.count("o_orderkey").alias("n_resolved"))


@_query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def newest_revision_wins(spark, d):
    return R.newest_wins(_t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@_query("SELECT user_id, event_id % 3 AS section, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, event_id) = 1")
def hybrid_rank_merge(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("section"))
    rank = F.when(F.col("section") == 1, 0).when(F.col("section") == 0, 1).otherwise(2)
    return R.newest_wins(e, ["user_id"], [rank, F.col("event_id")]).select("user_id", "section", "event_id")


@_query("""
WITH used AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
SELECT number, o_orderkey IS NOT NULL AS in_use FROM range(0, (SELECT max(o_orderkey) + 1 FROM used)) r(number) LEFT JOIN used ON number = o_orderkey""")
def gaps_as_free(spark, d):
    return R.free_entries(_t(spark, d, "orders").where("o_orderstatus != 'F'"), "o_orderkey")


@_query("""
SELECT o_orderkey, coalesce(n, o_orderpriority) AS o_orderpriority FROM orders
LEFT JOIN (SELECT o_orderkey AS k, 'override-' || o_custkey AS n FROM orders WHERE o_orderkey % 5 = 0) ON o_orderkey = k""")
def override_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    delta = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.concat(F.lit("override-"), F.col("o_custkey").cast("string")).alias("o_orderpriority"))
    return R.override(o.select("o_orderkey", "o_orderpriority"), delta, "o_orderkey", "o_orderpriority")


@_query("""
SELECT source, old_id, row_number() OVER (ORDER BY source, old_id) AS new_id
FROM (SELECT 0 AS source, p_partkey AS old_id FROM part UNION ALL SELECT 1, s_suppkey FROM supplier)""")
def merge_renumber(spark, d):
    out = R.renumbered([_t(spark, d, "part").withColumnRenamed("p_partkey", "k"), _t(spark, d, "supplier").withColumnRenamed("s_suppkey", "k")], "k")
    return out.select("source", "old_id", F.col("new_id").cast("long").alias("new_id"))


@_query("""
SELECT row_number() OVER (ORDER BY o) - 1 AS out_index, page_id, url FROM (SELECT unnest([3, 1, 1, 99999999, 0, 7]) AS i, generate_subscripts([3, 1, 1, 99999999, 0, 7], 1) AS o) w
JOIN pages ON page_id = i""")
def extract_pages(spark, d):
    return R.extract_positions(_t(spark, d, "pages").select("page_id", "url"), "page_id", [3, 1, 1, 99999999, 0, 7]).select("out_index", "page_id", "url")


@_query("SELECT l_orderkey, l_linenumber, ((((l_partkey * 90 - 720 * l_linenumber) % 360) + 360) % 360)::BIGINT AS rotation FROM lineitem")
def rotate_mod(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.rotated(F.col("l_partkey") * 90 - F.lit(720) * F.col("l_linenumber")).cast("long").alias("rotation"))


@_query("""
WITH f AS (SELECT l_orderkey, l_linenumber AS s, l_extendedprice AS x, round(l_quantity / 10) AS y, l_returnflag || l_linenumber AS t FROM lineitem),
l AS (SELECT l_orderkey, y, string_agg(t, ' ' ORDER BY x, s, t) AS line FROM f GROUP BY l_orderkey, y)
SELECT l_orderkey, string_agg(line, chr(10) ORDER BY y DESC) AS page_text FROM l GROUP BY l_orderkey""")
def reading_order(spark, d):
    f = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_quantity") / 10).alias("y"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    return R.reading_order(f, ["l_orderkey"], "l_extendedprice", "y", "l_linenumber", "t")


@_query("""
SELECT event_id, last_value(CASE WHEN event_type = 'view' OR event_id % 4 = 0 THEN event_type || (event_id % 10) END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS font FROM events""")
def carry_font(spark, d):
    tf = F.when((F.col("event_type") == "view") | (F.col("event_id") % 4 == 0), F.concat("event_type", (F.col("event_id") % 10).cast("string")))
    return R.carry_forward(_t(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], tf, "font").select("event_id", "font")


@_query("SELECT conv_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS document_text FROM conversations GROUP BY conv_id")
def form_feed_join(spark, d):
    return R.joined_pages(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@_query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '^\n|\n$', '', 'g')) AS text_sha FROM documents")
def newline_collapse(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(S.collapsed_newlines(F.col("text")), 256).alias("text_sha"))


@_query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND event_id % 5 = 0) THEN 'Revoked' WHEN bool_or(event_id % 3 = 0) THEN 'Incomplete' ELSE 'Good' END AS summary
FROM events GROUP BY user_id""")
def revocation_summary(spark, d):
    status = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "revoked").when(F.col("event_id") % 3 == 0, "unknown").otherwise("good")
    return R.revocation_summary(_t(spark, d, "events"), "user_id", status)


@_query("""
SELECT lang, count(*) AS n_docs, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 0) AS n_low, count(*) FILTER (toxic IS NULL) AS n_unlabelled,
  bool_or(n_chars > 20000) AS has_long, max(n_chars) AS most_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def doc_facts(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    c = F.col
    return j.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(c("toxic") == 1).alias("n_toxic"), F.count_if(c("quality") == 0).alias("n_low"), F.count_if(c("toxic").isNull()).alias("n_unlabelled"), F.bool_or(c("n_chars") > 20000).alias("has_long"), F.max("n_chars").alias("most_chars"))


@_query("SELECT lang, count(DISTINCT c) AS n_glyphs FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang")
def glyph_usage(spark, d):
    # distinct characters within a text first, so that the shuffle carries alphabets and not texts
    chars = _t(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c != ''")
    return chars.distinct().groupBy("lang").agg(F.count("*").alias("n_glyphs"))


@_query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def font_dedupe(spark, d):
    return R.first_of_each(_t(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")])


@_query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def content_dedupe(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@_query("SELECT user_id, event_type AS worst FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, event_id DESC) = 1")
def worst_construct(spark, d):
    return R.worst(_t(spark, d, "events"), ["user_id"], F.col("event_type"), F.col("event_id") % 7, F.col("event_id"))


@_query("""
SELECT p_brand, (m // 10)::INTEGER AS major, (m % 10)::INTEGER AS minor FROM (
  SELECT p_brand, greatest(14, max(CASE WHEN p_size > 48 THEN 20 WHEN p_size > 45 THEN 17 WHEN p_size > 30 THEN 15 ELSE 13 END)) AS m FROM part GROUP BY p_brand)""")
def min_version(spark, d):
    v = lambda a, b: F.struct(F.lit(a).alias("major"), F.lit(b).alias("minor"))
    size = F.col("p_size")
    need = F.when(size > 48, v(2, 0)).when(size > 45, v(1, 7)).when(size > 30, v(1, 5)).otherwise(v(1, 3))
    return _t(spark, d, "part").groupBy("p_brand").agg(F.greatest(v(1, 4), F.max(need)).alias("v")).select("p_brand", "v.major", "v.minor")


#: (lo, hi, base, ord): overlapping ranges, one of them too wide to count.
_RANGES = [(32, 126, 1000, 0), (65, 90, 2000, 1), (97, 122, 3000, 2), (100, 110, 4000, 3), (0, 70000, 9000, 4), (224, 255, 5000, 5), (200, 260, 6000, 6)]
_VALUES = ", ".join(map(str, _RANGES))
_CODES = "SELECT DISTINCT unicode(c)::BIGINT AS code FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''"


def _codes(spark, d):
    chars = _t(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c != ''").distinct()
    return chars.select(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long").alias("code"))


def _ranges(spark):
    return spark.createDataFrame(_RANGES, "lo long, hi long, base long, ord int")


@_query(f"SELECT code, max_by(base + code - lo, ord) FILTER (lo IS NOT NULL)::BIGINT AS mapped FROM ({_CODES}) LEFT JOIN (VALUES {_VALUES}) r(lo, hi, base, ord) ON code BETWEEN lo AND hi AND hi - lo < 65536 GROUP BY code")
def bfrange_lookup(spark, d):
    return R.ranges_lookup(_codes(spark, d), "code", _ranges(spark))


@_query(f"SELECT code, coalesce(min_by(base + code - lo, ord) FILTER (lo IS NOT NULL), 0)::BIGINT AS cid FROM ({_CODES}) LEFT JOIN (VALUES {_VALUES}) r(lo, hi, base, ord) ON code BETWEEN lo AND hi AND hi - lo < 65536 GROUP BY code")
def cid_first_range(spark, d):
    return R.ranges_lookup(_codes(spark, d), "code", _ranges(spark), "first").select("code", F.coalesce("mapped", F.lit(0)).cast("long").alias("cid"))


@_query("""
SELECT l_orderkey, l_linenumber, (CASE WHEN x >= 0.06 THEN 2 WHEN x >= 0.03 THEN 1 ELSE 0 END)::INTEGER AS piece,
  round(CASE WHEN x >= 0.06 THEN (x - 0.06) * (1 / (0.1 - 0.06)) WHEN x >= 0.03 THEN 1 - (x - 0.03) * (1 / (0.06 - 0.03)) ELSE x * (1 / 0.03) END, 6) AS input
FROM (SELECT *, least(0.1::DOUBLE, greatest(0::DOUBLE, l_discount)) AS x FROM lineitem)""")
def stitching_bounds(spark, d):
    s = S.stitching(F.col("l_discount"), [0.03, 0.06], [(0, 1), (1, 0), (0, 1)], (0.0, 0.1))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s["which"].cast("int").alias("piece"), F.round(s["input"], 6).alias("input"))


@_query("SELECT l_orderkey, l_linenumber, round(1 + pow(l_discount * 10, 2) * -1, 6) AS red, round(0.5 + pow(l_discount * 10, 2) * 0.25, 6) AS green FROM lineitem")
def fn_exponential(spark, d):
    f = S.exponential(F.col("l_discount") * 10, [1.0, 0.5], [0.0, 0.75], 2)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(f[0], 6).alias("red"), F.round(f[1], 6).alias("green"))


@_query("""
SELECT l_orderkey, l_linenumber, round((s[i + 1] + (s[least(i + 1, 2) + 1] - s[i + 1]) * (e - i)) / 255, 6) AS y
FROM (SELECT *, [0, 128, 255]::DOUBLE[] AS s, (l_tax * 10) / 1 * 2 AS e, least(floor((l_tax * 10) / 1 * 2), 1)::INTEGER AS i FROM lineitem)""")
def fn_sampled_1d(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.sampled(F.col("l_tax") * 10, [0, 128, 255], 8), 6).alias("y"))


@_query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, sqrt(abs(l_discount - l_tax)) * 2)), 6) AS y FROM lineitem")
def fn_postscript(spark, d):
    # { sub abs sqrt 2 mul } with range [0, 1]
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.clamped(F.sqrt(F.abs(F.col("l_discount") - F.col("l_tax"))) * 2, 0, 1), 6).alias("y"))


@_query("""
WITH m(start, style, prefix, first) AS (VALUES (0, 'r', '', 1), (10, 'D', 'A-', 1), (40, 'D', '', 100)),
r AS (SELECT * FROM (VALUES (1, 'i'), (2, 'ii'), (3, 'iii'), (4, 'iv'), (5, 'v'), (6, 'vi'), (7, 'vii'), (8, 'viii'), (9, 'ix'), (10, 'x')) t(n, roman))
SELECT page_id, prefix || CASE style WHEN 'r' THEN roman ELSE (page_id - start + first)::VARCHAR END AS label
FROM pages ASOF JOIN m ON page_id >= start LEFT JOIN r ON n = page_id - start + first""")
def page_labels(spark, d):
    marks = spark.createDataFrame([(0, "r", "", 1), (10, "D", "A-", 1), (40, "D", "", 100)], "start long, style string, prefix string, first long")
    out = R.as_of(_t(spark, d, "pages").select("page_id"), "page_id", marks, "start")
    h = F.col("_hit")
    return out.select("page_id", S.page_label(h["style"], h["prefix"], F.col("page_id") - h["_start"] + h["first"]).alias("label"))


@_query("""
SELECT part, count(*) AS n_docs FROM documents JOIN (VALUES (0, 0, 99), (1, 100, 100), (2, 150, 499), (3, 400, 2000)) p(part, a, b) ON doc_id BETWEEN a AND b GROUP BY part""")
def dpart_interval(spark, d):
    parts = spark.createDataFrame([(0, 0, 99), (1, 100, 100), (2, 150, 499), (3, 400, 2000)], "part int, a long, b long")
    return _t(spark, d, "documents").select("doc_id").join(F.broadcast(parts), F.col("doc_id").between(F.col("a"), F.col("b"))).groupBy("part").agg(F.count("*").alias("n_docs"))


@_query("SELECT c_custkey, coalesce(v, c_mktsegment) AS value FROM customer LEFT JOIN (VALUES ('Customer#000000001', 'filled'), ('Customer#000000007', 'seven'), ('nobody', 'x')) f(n, v) ON c_name = n")
def fill_form(spark, d):
    values = spark.createDataFrame([("Customer#000000001", "filled"), ("Customer#000000007", "seven"), ("nobody", "x")], "c_name string, value string")
    fields = _t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("value"))
    return R.override(fields, values, "c_name", "value").select("c_custkey", "value")


@_query("""
SELECT doc_id, CASE WHEN n_chars < 50 THEN 'UnembeddedFont' WHEN source = 'src3' THEN 'AttachmentRequiresPdfA3' WHEN toxic = 1 THEN 'LevelARequiresTagging' WHEN lang = 'de' AND quality = 0 THEN 'TransparencyRequiresPdfA2' ELSE 'ok' END AS violation
FROM documents LEFT JOIN labels USING (doc_id)""")
def conformance_first_error(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "n_chars", "source", "lang").join(_t(spark, d, "labels"), "doc_id", "left")
    c = F.col
    rule = F.when(c("n_chars") < 50, "UnembeddedFont").when(c("source") == "src3", "AttachmentRequiresPdfA3").when(c("toxic") == 1, "LevelARequiresTagging").when((c("lang") == "de") & (c("quality") == 0), "TransparencyRequiresPdfA2").otherwise("ok")
    return j.select("doc_id", rule.alias("violation"))


@_query("SELECT coalesce(quality::VARCHAR, 'all') AS expected, coalesce(toxic::VARCHAR, 'all') AS got, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic)")
def confusion_matrix(spark, d):
    return _t(spark, d, "labels").rollup("quality", "toxic").agg(F.count("*").alias("n")).select(F.coalesce(F.col("quality").cast("string"), F.lit("all")).alias("expected"), F.coalesce(F.col("toxic").cast("string"), F.lit("all")).alias("got"), "n")


@_query("SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS yes, count(*) FILTER (value > 50) * 2 > count(*) AS accepted FROM events GROUP BY user_id HAVING count(*) >= 3")
def majority_vote(spark, d):
    return R.majority(_t(spark, d, "events"), "user_id", F.col("value") > 50)


@_query("SELECT n_nationkey, (w & 4) <> 0 AS print, (w & 16) <> 0 AS copy, (w & 2048) <> 0 AS print_high, (w | 4)::BIGINT AS with_print FROM (SELECT n_nationkey, n_nationkey * 97 % 4096 AS w FROM nation)")
def permissions_bits(spark, d):
    w = F.col("n_nationkey") * 97 % 4096
    return _t(spark, d, "nation").select("n_nationkey", S.allows(w, "print").alias("print"), S.allows(w, "copy").alias("copy"), S.allows(w, "print_high").alias("print_high"), w.bitwiseOR(4).cast("long").alias("with_print"))


@_query("SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%SZ') AS pdf_date FROM orders")
def pdf_date_format(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", S.format_pdf_date(F.col("o_orderdate")).alias("pdf_date"))


@_query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day, (120)::INTEGER AS offset_min FROM orders")
def pdf_date_parse(spark, d):
    p = S.pdf_date(F.concat(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss"), F.lit("+02'00'")))
    return _t(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.year", "p.month", "p.day", "p.offset_min")


@_query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/]', ''), '[^A-Za-z0-9._-]', '_', 'g'), '^[.]+|[.]+$', '', 'g') AS x, CASE WHEN x = '' THEN 'attachment_' || page_id ELSE x END AS file FROM pages".replace("AS x,", "AS x_,").replace("x = ''", "x_ = ''").replace("ELSE x END", "ELSE x_ END"))
def attachment_filenames(spark, d):
    base = S.safe_filename(F.col("url"), F.col("page_id"))
    return _t(spark, d, "pages").select("page_id", F.when(base.startswith("attachment_"), F.lit("")).otherwise(base).alias("x_"), base.alias("file"))


@_query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS page FROM lineitem")
def table_pagination(spark, d):
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor((row - 1) / 3).cast("long").alias("page"))


@_query("""
SELECT l_orderkey, l_linenumber, CASE a WHEN 1 THEN (100 - w) / 2 WHEN 2 THEN 100 - w ELSE 0 END AS x, CASE WHEN a = 3 AND l_linestatus <> 'F' THEN (100 - w) / 4 ELSE 0 END AS word_space
FROM (SELECT *, l_quantity AS w, l_linenumber % 4 AS a FROM lineitem)""")
def line_layout(spark, d):
    a = F.element_at(F.array(*[F.lit(x) for x in ("left", "center", "right", "justify")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    o = S.line_offset(a, F.col("l_quantity"), F.lit(100.0), F.lit(4), F.col("l_linestatus") == "F")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", o["x"].alias("x"), o["word_space"].alias("word_space"))


@_query("SELECT c_custkey, upper(sha1(upper(hex(c_name)))) AS vri_key FROM customer")
def signature_vri_keys(spark, d):
    return _t(spark, d, "customer").select("c_custkey", S.vri_key(F.col("c_name").cast("binary")).alias("vri_key"))


@_query("SELECT doc_id, substr(sha256(text), 1, 32) AS file_id FROM documents")
def synthesize_file_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lower(F.hex(S.file_id(F.col("text").cast("binary")))).alias("file_id"))
