"""Queries over documents authored from the given texts and read back, and over their edits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import codecs, content, security, structure
from quire.functions.composing import wrapped
from quire.functions.objects import open_document
from quire.operators import documents as D
from quire.operators.relational import reading_order

_all: dict[str, tuple] = {}


def _query(sql: str | None = None):
    def add(f):
        _all[f.__name__] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents, dealt out anew only where the files give fewer tasks than there are cores."""
    docs, cores = _t(spark, d, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def queries() -> dict:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}


#: What an authored text reads back as: pages of 50 lines, without empty lines and outer white space, a form feed between pages.
_PAGES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i // 50 AS page_index, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), ''), '^\s+|\s+$', '', 'g') AS t FROM l GROUP BY ALL)
"""


@_query(_PAGES + "SELECT doc_id, count(*)::INTEGER AS n_pages, sha256(string_agg(t, chr(12) ORDER BY page_index)) AS text_sha FROM p GROUP BY doc_id")
def document_text(spark, d):
    """Author, parse, extract: every whole text survives the way into a file and back."""
    texts = D.document_texts(D.authored(_docs(spark, d)))
    return texts.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\f"), F.lit(""))) + 1).cast("int").alias("n_pages"), F.sha2("text", 256).alias("text_sha"))


@_query(_PAGES + "SELECT doc_id, page_index::INTEGER AS page_index, sha256(t) AS text_sha FROM p")
def page_text(spark, d):
    files = D.authored(_docs(spark, d), kind="packed")
    return D.page_texts(files).select("doc_id", "page_index", F.sha2("text", 256).alias("text_sha"))


@_query("SELECT doc_id, '1.7' AS version, 'Strict' AS open_mode, ((length(text) - length(replace(text, chr(10), ''))) // 50 + 1)::INTEGER AS n_pages, doc_id::VARCHAR AS title, false AS encrypted FROM documents")
def document_meta(spark, d):
    return D.meta(D.authored(_docs(spark, d), kind="xref")).select("doc_id", "version", "open_mode", "n_pages", "title", "encrypted")


@_query("SELECT doc_id, 'Recovered' AS open_mode, ((length(text) - length(replace(text, chr(10), ''))) // 50 + 1)::INTEGER AS n_pages FROM documents")
def recovered_open(spark, d):
    """Files whose cross-reference can't be found open by recovery."""
    def broken(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[: x.rfind(b"startxref")] for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    files = D.authored(_docs(spark, d)).mapInArrow(broken, "doc_id long, content binary")
    return D.meta(files).select("doc_id", "open_mode", "n_pages")


@_query("SELECT page_id, 'f' || n AS name, CASE n WHEN 0 THEN url ELSE 'v' || page_id END AS value, 'Tx' AS field_type, 0 AS page_index FROM pages, (VALUES (0), (1)) t(n)")
def form_fields(spark, d):
    def author(batches):
        for b in batches:
            out = [structure.author("", fields={"f0": u, "f1": f"v{i}"}) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page_id", "content"])

    files = _t(spark, d, "pages").select("page_id", "url").mapInArrow(author, "page_id long, content binary")
    return D.fields(files, "page_id").select("page_id", "name", "value", "field_type", "page_index")


@_query("SELECT page_id, 'f0' AS name, 'filled ' || url AS value FROM pages UNION ALL SELECT page_id, 'f1', 'old' FROM pages")
def fill_form_bytes(spark, d):
    def author(batches):
        for b in batches:
            out = [structure.fill_form(open_document(structure.author("", fields={"f0": "x", "f1": "old"})), {"f0": f"filled {u}", "none": "y"}) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page_id", "content"])

    return D.fields(_t(spark, d, "pages").select("page_id", "url").mapInArrow(author, "page_id long, content binary"), "page_id").select("page_id", "name", "value")


@_query("SELECT doc_id, i::INTEGER AS ord, 'Page ' || (i + 1) AS title, i::INTEGER AS dest_page FROM documents, range(0, (length(text) - length(replace(text, chr(10), ''))) // 50 + 1) r(i)")
def outline_rows(spark, d):
    return D.outline_nodes(D.authored(_docs(spark, d), outline_titles=True)).select("doc_id", "ord", "title", "dest_page")


@_query("SELECT page_id, page_id || '.html' AS name, sha256(html) AS digest FROM pages")
def attachment_rows(spark, d):
    def author(batches):
        for b in batches:
            out = [structure.author("", files={f"{i}.html": (h or "").encode()}) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page_id", "content"])

    files = _t(spark, d, "pages").select("page_id", "html").mapInArrow(author, "page_id long, content binary")
    return D.attachments(files, "page_id").select("page_id", "name", F.sha2("data", 256).alias("digest"))


@_query("SELECT doc_id, 'F1' AS resource, 'Helvetica' AS base_font, 'Type1' AS subtype FROM documents")
def document_fonts(spark, d):
    return D.fonts(D.authored(_docs(spark, d))).select("doc_id", "resource", "base_font", "subtype")


@_query("SELECT lang, count(*) AS n_docs, sum((length(text) - length(replace(text, chr(10), ''))) // 50 + 1)::BIGINT AS n_pages FROM documents GROUP BY lang")
def merge_pages(spark, d):
    """Files of a language, in groups of 64 by id, merged; pages add up."""
    files = D.authored(_docs(spark, d), keep=("lang",)).withColumn("part", F.concat_ws(":", "lang", F.floor(F.col("doc_id") / 64).cast("string")))
    merged = D.meta(D.merged(files, "part", "doc_id"), "part")
    counts = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    return merged.groupBy(F.substring_index("part", ":", 1).alias("lang")).agg(F.sum("n_pages").alias("n_pages")).join(counts, "lang").select("lang", "n_docs", "n_pages")


@_query("SELECT doc_id, 0 AS page_index, 90::BIGINT AS rotate FROM documents")
def rotate_page_bytes(spark, d):
    files = D.edited(D.authored(_docs(spark, d)), lambda x: structure.rotate_page(x, 0, 450))
    return D.page_table(files).where("page_index = 0").select("doc_id", "page_index", "rotate")


@_query(_PAGES + "SELECT doc_id, 0 AS page_index, sha256(t) AS text_sha FROM p WHERE page_index = 0 UNION ALL SELECT doc_id, 1, sha256(t) FROM p WHERE page_index = 0")
def extract_pages_bytes(spark, d):
    files = D.edited(D.authored(_docs(spark, d)), lambda x: structure.extract_pages(x, [0, 0, 9999]))
    return D.page_texts(files).select("doc_id", "page_index", F.sha2("text", 256).alias("text_sha"))


@_query(_PAGES + "SELECT doc_id, page_index::INTEGER AS page_index, sha256(t) AS text_sha FROM p")
def fragment_layout(spark, d):
    """Positioned fragments as a table, put in reading order by DataFrame operations alone."""
    f = D.fragment_table(D.authored(_docs(spark, d)), every_page=True)
    laid = reading_order(f, ["doc_id", "page_index"], "x", "y", "seq", "text")
    text = F.regexp_replace(F.coalesce("page_text", F.lit("")), r"^\s+|\s+$", "")
    return laid.select("doc_id", "page_index", F.sha2(text, 256).alias("text_sha"))


@_query("""
WITH d AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents)
SELECT doc_id, operator, CASE WHEN operator IN ('Tj', 'T*') THEN lines ELSE (lines - 1) // 50 + 1 END::BIGINT AS n FROM d, (VALUES ('BT'), ('Tf'), ('TL'), ('Td'), ('Tj'), ('T*'), ('ET')) o(operator)""")
def operation_counts(spark, d):
    return D.operation_table(D.authored(_docs(spark, d))).groupBy("doc_id", "operator").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, sha256(text) AS digest, 5 AS n_codecs FROM documents")
def codec_round_trips(spark, d):
    """Every text through each codec and back."""
    pairs = ((codecs.hex_encode, codecs.hex_decode), (codecs.a85_encode, codecs.a85_decode), (codecs.run_length_encode, codecs.run_length_decode), (codecs.lzw_encode, codecs.lzw_decode), (codecs.flate_encode, codecs.flate_decode))

    def go(batches):
        import hashlib

        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            out = [hashlib.sha256(pairs[0][1](pairs[0][0](x))).hexdigest() for x in raw]
            n = [sum(decode(encode(x)) == x for encode, decode in pairs) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(n, pa.int32())], ["doc_id", "digest", "n_codecs"])

    return _t(spark, d, "documents").select("doc_id", "text").mapInArrow(go, "doc_id long, digest string, n_codecs int")


@_query("SELECT page_id, 'T' || page_id AS title, 2 AS n_ok FROM pages")
def encrypted_round_trips(spark, d):
    """A file with the page's address under RC4 and AES-128, opened with the user's and the owner's password. AES-256 is left to a
    unit test: its key derivation, in Python, takes seconds a file."""
    def go(batches):
        for b in batches:
            titles, ok = [], []
            for i, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = open_document(structure.author(said, f"T{i}"))
                files = [security.encrypted(doc, b"user", b"owner", algorithm=a) for a in ("rc4", "aes128")]
                opened = [[open_document(f, p) for p in (b"user", b"owner")] for f in files]
                ok.append(sum(all(structure.document_text(x) == said for x in o) for o in opened))
                titles.append(structure.facts(opened[1][0])["title"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles), pa.array(ok, pa.int32())], ["page_id", "title", "n_ok"])

    return _t(spark, d, "pages").select("page_id", "url").repartition(8).mapInArrow(go, "page_id long, title string, n_ok int")


@_query("SELECT conv_id, turn, 'R' AS kind, text FROM (SELECT conv_id, turn, text FROM conversations)")
def text_strings(spark, d):
    """Text strings as files hold them, read back."""
    def go(batches):
        for b in batches:
            out = [content.text_string(content.to_text_string(x)) if x is not None else None for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["R"] * b.num_rows), pa.array(out, pa.string())], ["conv_id", "turn", "kind", "text"])

    return _t(spark, d, "conversations").select("conv_id", "turn", "text").mapInArrow(go, "conv_id long, turn long, kind string, text string")


@_query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, list_filter(string_split_regex(p, '[ \t\x0b\f\r]+'), lambda x: x <> '') AS words FROM p),
l AS (SELECT doc_id, i, CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda a, x: a || CASE WHEN length(a) - length(regexp_replace(a, '[^\n]*$', '')) + 1 + length(x) > 80 THEN chr(10) ELSE ' ' END || x) END AS t FROM w),
d AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS t FROM l GROUP BY doc_id)
SELECT doc_id, (length(t) - length(replace(t, chr(10), '')) + 1)::INTEGER AS n_lines, sha256(t) AS lines_sha FROM d""")
def wrap_text(spark, d):
    """Lines of at most 80 characters, as an expression."""
    return _t(spark, d, "documents").select("doc_id", wrapped(F.col("text"), 80).alias("lines")).select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha"))
