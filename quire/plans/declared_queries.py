"""Queries over what documents declare about themselves: files with declarations, written from the given texts, and read back."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import calc, flow, fonts, metadata, structure
from quire.functions import values as V
from quire.functions import scalars as S
from quire.functions import signatures as signing
from quire.functions.objects import Name, Stream, open_document, pages
from quire.operators import documents as D
from quire.plans import foreign_files

_all: dict[str, tuple] = {}


def _query(sql: str | None = None):
    def add(f):
        _all[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents, dealt out anew only where the files give fewer tasks than there are cores."""
    docs, cores = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _files(spark: SparkSession, d: str, declare) -> DataFrame:
    """doc_id, content: each whole text as a file with what declare(doc_id, text, number of pages) gives metadata.declared."""

    def author(doc_id, text):
        doc = open_document(structure.author(text or "", str(doc_id)))
        return metadata.declared(doc, **declare(doc_id, text or "", len(structure.pages(doc))))

    return D.written(_docs(spark, d), author, "doc_id", "doc_id", "text")


_PAGES = "((length(text) - length(replace(text, chr(10), ''))) // 50 + 1)"


@_query("SELECT doc_id, 2000 + (doc_id % 30)::INTEGER AS year, (doc_id % 12 + 1)::INTEGER AS month, (doc_id % 28 + 1)::INTEGER AS day, (-(60 * (doc_id % 12) + 30))::INTEGER AS offset_min, 'Document <' || doc_id || '> & more' AS title FROM documents")
def declared_dates(spark, d):
    """Creation dates and XMP titles, through the raw strings that the file holds."""
    def declare(i, text, n):
        return {"creation": f"D:{2000 + i % 30}{i % 12 + 1:02}{i % 28 + 1:02}101112-{i % 12:02}'30'", "packet": metadata.xmp_packet(f"Document <{i}> & more", "quire", "en", "pdfaid 3 B")}

    date = S.pdf_date(F.col("creation"))
    title = F.regexp_extract("xmp", "<rdf:li xml:lang=\"x-default\">([^<]*)</rdf:li>", 1)
    plain = F.replace(F.replace(F.replace(title, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return D.declared_dates(_files(spark, d, declare)).select("doc_id", *[date[c].alias(c) for c in ("year", "month", "day", "offset_min")], plain.alias("title"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1.4' WHEN 1 THEN '1.7' ELSE '2.0' END AS version, CASE doc_id % 4 WHEN 1 THEN 'developer extension''s base version' WHEN 2 THEN 'structure namespaces' WHEN 3 THEN 'document part root' END AS violation FROM documents")
def least_versions(spark, d):
    """The least version that a file's constructs need, and the construct that needs it, whatever the header says."""
    def declare(i, text, n):
        kinds = ({}, {"extensions": {"ADBE": {"BaseVersion": Name("1.7"), "ExtensionLevel": 3}}}, {"namespaces": ["urn:x"]}, {"parts": [(0, n - 1, {})]})
        return {**kinds[i % 4], "version": (1, 7)}

    return D.least_versions(_files(spark, d, declare))


@_query(f"SELECT doc_id, p::INTEGER AS part, CASE WHEN p = 0 THEN 0 ELSE {_PAGES} - 1 END::INTEGER AS start_page, ({_PAGES} - 1)::INTEGER AS end_page, CASE WHEN p = 0 THEN 'whole ' || doc_id ELSE 'last' END AS label FROM documents, (VALUES (0), (1)) t(p)")
def document_part_rows(spark, d):
    parts = D.document_parts(_files(spark, d, lambda i, text, n: {"parts": [(0, n - 1, {"Label": f"whole {i}"}), (n - 1, n - 1, {"Label": "last"})]}))
    return parts.select("doc_id", "part", "start_page", "end_page", F.col("metadata")["Label"].alias("label"))


@_query("SELECT doc_id, n::INTEGER AS ord, 'urn:' || doc_id || ':' || n AS uri FROM documents, range(0, 3) r(n)")
def namespace_rows(spark, d):
    return D.structure_namespaces(_files(spark, d, lambda i, text, n: {"namespaces": [f"urn:{i}:{k}" for k in range(3)]}))


@_query("SELECT doc_id, prefix, base_version, level::BIGINT AS level, url FROM documents, (VALUES ('ADBE', '1.7', 8, NULL), ('GLGR', '1.7', 1002, 'https://x.example'), ('GLGR', '2.0', 1, NULL)) t(prefix, base_version, level, url)")
def extension_rows(spark, d):
    """An extension by itself, two in an array, and one without a level, which is passed over."""
    one = lambda base, level, **more: {"BaseVersion": Name(base), "ExtensionLevel": level, **more}
    found = {"Type": Name("Extensions"), "ADBE": one("1.7", 8), "GLGR": [one("1.7", 1002, URL=b"https://x.example"), one("2.0", 1)], "BAD": {"BaseVersion": Name("1.7")}}
    return D.developer_extensions(_files(spark, d, lambda i, text, n: {"extensions": found})).select("doc_id", "prefix", "base_version", "level", "url")


@_query("SELECT doc_id, 'secret ' || doc_id || '.pdf' AS file_name, 'Custom' AS filter, '1.0' AS version, sha256(text) AS digest FROM documents")
def payload_rows(spark, d):
    files = _files(spark, d, lambda i, text, n: {"wrapped": (f"secret {i}.pdf", "Custom", text.encode())})
    return D.encrypted_payloads(files).select("doc_id", "file_name", "filter", "version", F.sha2("data", 256).alias("digest"))


@_query(f"SELECT doc_id, page_index::INTEGER AS page_index, CASE WHEN page_index < 2 THEN ['i', 'ii'][page_index + 1] ELSE 'A-' || (page_index + 3) END AS label FROM documents, range(0, {_PAGES}) r(page_index)")
def labelled_pages(spark, d):
    """Labels of all pages, from the ranges in the file."""
    files = _files(spark, d, lambda i, text, n: {"labels": [(0, "r", "", 1), (2, "D", "A-", 5)]})
    ranges = D.label_ranges(files).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_page", "style", "prefix", "first"))).alias("ranges"))
    pages = D.page_table(files).select("doc_id", "page_index").join(ranges, "doc_id")
    own = F.element_at(F.filter("ranges", lambda r: r["start_page"] <= F.col("page_index")), -1)
    return pages.withColumn("own", own).select("doc_id", "page_index", S.page_label(F.col("own.style"), F.col("own.prefix"), F.col("page_index") - F.col("own.start_page") + F.col("own.first")).alias("label"))


@_query("""
SELECT doc_id, name, kind, base, colorants, CASE WHEN name = 'Cs0' THEN (doc_id % 256 + 1)::INTEGER END AS entries, round(CASE name WHEN 'Cs0' THEN doc_id % 7 WHEN 'Cs1' THEN (doc_id % 100) / 100.0 ELSE 0.75 END, 6)::DOUBLE AS second
FROM documents, (VALUES ('Cs0', 'Indexed', 'DeviceRGB', ''), ('Cs1', 'Separation', 'DeviceCMYK', 'Spot'), ('Cs2', 'DeviceN', 'DeviceRGB', 'Cyan,Gold')) t(name, kind, base, colorants)""")
def special_color_spaces(spark, d):
    """Palettes and tint transforms (exponential and calculator) of the first page's colour spaces."""
    def declare(i, text, n):
        palette = bytes([i % 5, i % 7, i % 11]) + bytes(765)
        spot = {"FunctionType": 2, "Domain": [0, 1], "C0": [0.0, 0.0, 0.0, 0.0], "C1": [0.5, (i % 100) / 100, 0.0, 0.0], "N": 1}
        pair = Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1, 0, 1, 0, 1]}, b"{ 0.25 sub exch 0.5 mul exch dup }")
        return {"spaces": {"Cs0": [Name("Indexed"), Name("DeviceRGB"), i % 256, palette], "Cs1": [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), spot], "Cs2": [Name("DeviceN"), [Name("Cyan"), Name("Gold")], Name("DeviceRGB"), pair]}}

    found = D.special_spaces(_files(spark, d, declare))
    return found.select("doc_id", "name", "kind", "base", F.array_join("colorants", ",").alias("colorants"), "entries", F.round(F.get("first", F.lit(1)), 6).alias("second"))


@_query(f"SELECT doc_id, subtype, CASE subtype WHEN 'Text' THEN 'note ' || doc_id END AS contents, uri, CASE WHEN subtype = 'Link' AND uri IS NULL THEN {_PAGES} - 1 END::INTEGER AS dest_page FROM documents, (VALUES ('Text', NULL), ('Link', 'https://x.example/a'), ('Link', NULL)) t(subtype, uri)")
def annotation_rows(spark, d):
    """A note, a link to an address, and a link to a named destination in a tree of names."""
    def declare(i, text, n):
        links = [{"Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "A": {"S": Name("URI"), "URI": b"https://x.example/a"}}, {"Subtype": Name("Link"), "Rect": [0, 9, 9, 18], "A": {"S": Name("GoTo"), "D": b"end"}}]
        return {"annotations": [{"Subtype": Name("Text"), "Rect": [0, 0, 5, 5], "Contents": f"note {i}".encode()}, *links], "destinations": {"begin": 0, "end": n - 1}}

    return D.annotations(_files(spark, d, declare)).select("doc_id", "subtype", "contents", "uri", "dest_page")


def _png(width: int, rows: list[bytes], palette: bytes) -> bytes:
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 3, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"PLTE", palette) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


@_query("SELECT doc_id, w::BIGINT AS width, space AS color_space, encoding, CASE w WHEN 7 THEN NULL ELSE sha256(CASE w WHEN 4 THEN 'ABCDEFGH' ELSE left(lpad(doc_id::VARCHAR, 6, '0'), 6) END) END AS digest FROM documents, (VALUES (4, 'Indexed', 'raw'), (6, 'DeviceGray', 'raw'), (7, 'DeviceRGB', 'jpeg')) t(w, space, encoding)")
def image_rows(spark, d):
    """Images of a page: one from a PNG file, one inside a form, one that stays JPEG."""
    def declare(i, text, n):
        image = lambda w, h, space, raw, **more: Stream({"Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(space), **more}, raw)
        inner = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 1, 1], "Resources": {"XObject": {"In": image(6, 1, "DeviceGray", f"{i:06}".encode()[:6])}}}, b"/In Do")
        return {"xobjects": {"Png": metadata.png_image(_png(4, [b"ABCD", b"EFGH"], bytes(300))), "Fm": inner, "Jpg": image(7, 1, "DeviceRGB", b"\xff\xd8\xff\xd9", Filter=Name("DCTDecode"))}, "paint": b"/Png Do /Fm Do"}

    found = D.images(_files(spark, d, declare))
    return found.select("doc_id", "width", "color_space", F.when(F.col("width") == 7, F.lit("jpeg")).otherwise(F.col("encoding")).alias("encoding"), F.when(F.col("width") != 7, F.sha2("data", 256)).alias("digest"))


@_query("SELECT doc_id, 'inside ' || doc_id AS form_text, 'flat ' || doc_id AS flat_text, 0::BIGINT AS n_fields FROM documents")
def flattened_forms(spark, d):
    """A form field's appearance becomes page content; the text inside form objects is read, that of widgets only after flattening."""
    def author(i):
        font = {"Font": {"F0": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}}
        said = lambda t: Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 100, 20], "Resources": font}, b"BT /F0 9 Tf (%s) Tj ET" % t.encode())
        doc = open_document(structure.author("", fields={"f": "v"}))
        widget = {"Subtype": Name("Widget"), "Rect": [10, 10, 110, 30], "AP": {"N": said(f"flat {i}")}}
        return structure.flatten_form(open_document(metadata.declared(doc, xobjects={"Fm": said(f"inside {i}")}, paint=b"/Fm Do", annotations=[widget])))

    files = D.written(_docs(spark, d).select("doc_id"), author, "doc_id", "doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    texts = D.document_texts(files).select("doc_id", F.get(lines, F.lit(0)).alias("form_text"), F.get(lines, F.lit(1)).alias("flat_text"))
    left = D.fields(files).groupBy("doc_id").agg(F.count("*").alias("n"))
    return texts.join(left, "doc_id", "left").select("doc_id", "form_text", "flat_text", F.coalesce("n", F.lit(0)).cast("long").alias("n_fields"))


@_query(f"SELECT doc_id, kind, n::BIGINT AS n FROM (SELECT doc_id, 'dict' AS kind, 4 + {_PAGES} AS n FROM documents UNION ALL SELECT doc_id, 'stream', {_PAGES} FROM documents)")
def object_kinds(spark, d):
    """Objects in use by kind, read out of object streams."""
    return D.object_table(D.authored(_docs(spark, d), kind="packed")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, doc_id % 3 = 0 AS rejected, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_read FROM documents")
def unreadable_files(spark, d):
    """Every third file is no document: it has an error row and no other; none vanishes."""
    files = D.written(_docs(spark, d), lambda i, t: (t or "").encode() if i % 3 == 0 else structure.author(t or ""), "doc_id", "doc_id", "text")
    bad = D.rejects(files).where("error != ''").select("doc_id", F.lit(True).alias("bad"))
    read = D.meta(files).groupBy("doc_id").agg(F.count("*").alias("n"))
    return files.select("doc_id").join(bad, "doc_id", "left").join(read, "doc_id", "left").select("doc_id", F.coalesce("bad", F.lit(False)).alias("rejected"), F.coalesce("n", F.lit(0)).cast("long").alias("n_read"))


@_query("SELECT doc_id, (strlen(text) + 28)::BIGINT AS sealed_bytes, sha256(text) AS digest, true AS other_key_fails FROM documents")
def gcm_round_trips(spark, d):
    """Texts sealed with AES-256-GCM and opened again, as expressions; another key opens nothing."""
    key = lambda salt: F.unhex(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(salt)), 256))
    nonce = F.substring(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), 1, 12)
    sealed = _docs(spark, d).withColumn("sealed", S.gcm_encrypt(key("a"), nonce, F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return sealed.select("doc_id", F.octet_length("sealed").cast("long").alias("sealed_bytes"), F.sha2(S.gcm_decrypt(key("a"), F.col("sealed")), 256).alias("digest"), S.gcm_decrypt(key("b"), F.col("sealed")).isNull().alias("other_key_fails"))


@_query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, sqrt(abs(l_discount - l_tax)) * 2)), 6) AS y FROM lineitem")
def calculator_program(spark, d):
    """A calculator function of a file, run by the interpreter on every row."""
    def go(batches):
        doc = open_document(structure.author(""))
        f = calc.parse(doc, Stream({"FunctionType": 4, "Domain": [-1, 1, -1, 1], "Range": [0, 1]}, b"{ sub abs sqrt dup 0 ge { 2 mul } { pop 0 } ifelse }"))
        for b in batches:
            y = [round(f([u, v])[0], 6) for u, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y, pa.float64())], ["l_orderkey", "l_linenumber", "y"])

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return rows.mapInArrow(go, "l_orderkey long, l_linenumber long, y double")



#: Characters of the font that these queries embed; others come out as its glyph 0 and have no text.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,éèêëïîôöùûüßçñáíóúÄÖÜ"
_IN_FONT = f"regexp_replace(text, '[^{_LETTERS}\\n]', '', 'g')"
_SET = f"trim(regexp_replace(regexp_replace({_IN_FONT}, '\\n+', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'))"


@_query(f"SELECT doc_id, sha256(regexp_replace({_SET}, '^\\s+|\\s+$', '', 'g')) AS text_sha, 'Drawn' AS font, {len(_LETTERS) + 1} AS n_glyphs, true AS smaller FROM documents")
def composite_fonts(spark, d):
    """Whole texts set in glyph numbers of an embedded font without a ToUnicode map, cut down to the glyphs in use, and read back through its characters."""
    program = fonts.drawn(_LETTERS)

    def read(whole):
        # what the subset drops of the program is its character table, so text is read from the whole file
        text, cut = structure.document_text(whole), open_document(metadata.subset_fonts(whole))
        named = metadata.embedded_fonts(whole)
        for x in metadata.embedded_fonts(cut):
            yield from ({"text": text, "font": f["name"], "n_glyphs": x["n_glyphs"], "smaller": x["bytes"] < len(program)} for f in named)

    schema = "text string, font string, n_glyphs int, smaller boolean"
    found = D.read_back(_docs(spark, d), lambda t: (metadata.set_in_font(t or "", program), {}), read, schema, "doc_id", "text")
    return found.select("doc_id", F.sha2("text", 256).alias("text_sha"), "font", "n_glyphs", "smaller")


@_query(f"""
WITH f AS (SELECT unnest(string_split('{_LETTERS}', '')) AS c),
w AS (SELECT c, 400 + ord(c) % 7 * 50 AS w FROM f),
t AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), '')) AS c FROM conversations)
SELECT t.conv_id, t.turn, count(*)::BIGINT AS n_glyphs, sum(coalesce(w, 500))::BIGINT AS width FROM t LEFT JOIN w USING (c) WHERE t.c <> '' GROUP BY t.conv_id, t.turn""")
def shaped_text(spark, d):
    """Texts as glyphs and advances of a font program, measured."""
    def go(batches):
        program = fonts.drawn(_LETTERS)
        for b in batches:
            found = [fonts.shaped(program, t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(g["advance"] for g in x) for x in found], pa.int64())], ["conv_id", "turn", "n_glyphs", "width"])

    said = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    shaped = said.mapInArrow(go, "conv_id long, turn long, n_glyphs long, width long")
    return shaped.groupBy("conv_id", "turn").agg(F.sum("n_glyphs").alias("n_glyphs"), F.sum("width").alias("width")).where("n_glyphs > 0")


def _blocks(doc_id, text):
    lines = (text or "").split("\n")
    return [flow.Block("heading", f"Document {doc_id}", level=doc_id % 9), flow.Block("text", "\n".join(lines[:-2]), style=flow.Style(align="justify")), flow.Block("list", lines[-2:], numbered=True)]


_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"


@_query(f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, array_to_string(list_concat(['Document', doc_id::VARCHAR], {_WORDS.format("array_to_string(l[:-3], chr(10))")}, list_concat(CASE WHEN len(l) > 1 THEN list_concat(['1.'], {_WORDS.format("l[-2]")}, ['2.'], {_WORDS.format("l[-1]")}) ELSE list_concat(['1.'], {_WORDS.format("l[-1]")}) END)), ' ') AS t FROM d)
SELECT doc_id, sha256(t) AS words_sha, true AS preflight FROM w""")
def flowed_text(spark, d):
    """Whole texts as a heading, justified paragraphs and a numbered list, broken into lines and pages by glyph widths, and read back; pages as counted beforehand."""
    def author(i, text):
        sheets, elements = flow.laid(_blocks(i, text))
        return flow.file_of(sheets, elements), {"needed": len(sheets)}

    def read(doc):
        yield {"text": structure.document_text(doc), "n_pages": len(pages(doc))}

    found = D.read_back(_docs(spark, d), author, read, "needed int, text string, n_pages int", "doc_id", "doc_id", "text")
    words = F.array_join(F.filter(F.split("text", r"\s+"), lambda x: x != ""), " ")
    return found.select("doc_id", F.sha2(words, 256).alias("words_sha"), (F.col("needed") == F.col("n_pages")).alias("preflight"))


@_query("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT k, ceil((n + 0) / 39.0)::INTEGER AS n_pages, n::BIGINT AS n_rows, ceil(n / 39.0)::BIGINT AS n_headers FROM s""")
def flowed_tables(spark, d):
    """A table of each nation's suppliers: rows of 18 points below a header row that every page repeats, 39 rows a page."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_suppkey").cast("string").alias("key"))
    groups = rows.groupBy("k").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    paper = flow.Paper(400, 100 + 40 * 18, 50)

    def author(keys):
        table = flow.Block("table", [["Header", "Number"], *[["row", x] for x in keys]], columns=(("auto", 0), ("relative", 1)), headers=1)
        return flow.flowed([table], paper, title="t", language="en")

    files = D.written(groups, author, "k", "keys")
    text = D.page_texts(files, "k").groupBy("k").agg(F.count("*").cast("int").alias("n_pages"), F.sum(F.regexp_count("text", F.lit("Header"))).cast("long").alias("n_headers"))
    cells = D.structure_elements(files, "k").where("tag = 'TR'").groupBy("k").agg((F.count("*") - 1).alias("n_rows"))
    return text.join(cells, "k").select("k", "n_pages", "n_rows", "n_headers")


@_query("SELECT doc_id, 'H' || greatest(1, least(6, doc_id % 9)) AS heading, CASE WHEN strpos(text, chr(10)) > 0 THEN 2 ELSE 1 END::BIGINT AS n_items, 'UnembeddedFont' AS pdfa, CASE doc_id % 2 WHEN 0 THEN 'UnembeddedFont' ELSE 'NotTagged' END AS pdfua FROM documents")
def tagged_structure(spark, d):
    """Structure trees of tagged documents, and the first rule of PDF/A and PDF/UA that the files break."""
    files = D.written(_docs(spark, d), lambda i, t: flow.flowed(_blocks(i, t), title=f"T{i}", language="en" if i % 2 == 0 else ""), "doc_id", "doc_id", "text")
    always = D.written(_docs(spark, d), lambda i, t: flow.flowed(_blocks(i, t), title=f"T{i}", language="en"), "doc_id", "doc_id", "text")
    found = D.structure_elements(always)
    tags = found.groupBy("doc_id").agg(F.max(F.when(F.col("tag").rlike("^H[1-6]$"), F.col("tag"))).alias("heading"), F.count_if(F.col("tag") == "LI").alias("n_items"))
    return tags.join(D.conformance(files), "doc_id").select("doc_id", "heading", "n_items", "pdfa", "pdfua")


@_query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), ''), '^\\s+|\\s+$', '', 'g') AS t FROM l GROUP BY doc_id)
SELECT doc_id, (doc_id % {len(foreign_files.LAYOUTS)})::INTEGER AS layout, sha256(t) AS text_sha, CASE WHEN doc_id % {len(foreign_files.LAYOUTS)} < {foreign_files.DAMAGED} THEN 'Strict' ELSE 'Recovered' END AS open_mode FROM t""")
def foreign_layouts(spark, d):
    """Whole texts in files that this package's writer has not written: thirteen layouts, four of them damaged."""
    files = D.written(_docs(spark, d), lambda i, t: foreign_files.built(foreign_files.LAYOUTS[i % len(foreign_files.LAYOUTS)], t or ""), "doc_id", "doc_id", "text")
    texts = D.document_texts(files).select("doc_id", F.pmod("doc_id", F.lit(len(foreign_files.LAYOUTS))).cast("int").alias("layout"), F.sha2("text", 256).alias("text_sha"))
    return texts.join(D.meta(files).select("doc_id", "open_mode"), "doc_id")


@lru_cache
def _authority(seed: int) -> tuple[bytes, bytes]:
    """A root's certificate, and that of a signer whom it vouches for (with key 10)."""
    root = signing.key_for_tests(seed)
    return signing.certificate(f"Root {seed}", root, f"Root {seed}", root), signing.certificate("Signer", signing.key_for_tests(10), f"Root {seed}", root, 7)


@_query("SELECT doc_id, 'Signer' AS signer, 'sha256' AS digest, doc_id % 3 <> 1 AS intact, true AS authentic, doc_id % 3 <> 2 AS trusted, doc_id % 2 = 0 AS covers_file, 'Reason ' || doc_id AS reason, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END::INTEGER AS n_certificates FROM documents")
def signed_documents(spark, d):
    """Whole texts signed and verified: every third file changed after signing, every third by a signer of an unknown root, every second
    with a revision behind the signature that adds the certificate to the security store."""
    def author(i, text):
        root, own = _authority(2 if i % 3 == 2 else 1)
        data = signing.signed(open_document(structure.author(text or "")), signing.key_for_tests(10), [own], reason=f"Reason {i}", time="260101120000Z")
        if i % 3 == 1:
            data = data.replace(b"(quire)", b"(quirk)", 1)
        return signing.with_validation(open_document(data), [own]) if i % 2 else data, {}

    def read(doc):
        held = {x["vri_key"]: x["n_certificates"] for x in signing.validation_info(doc) if x["vri_key"]}
        for x in signing.signatures(doc, [signing.Certificate.of(_authority(1)[0])]):
            yield {**x, "n_certificates": held.get(x["vri_key"], 0)}

    schema = "signer string, digest string, intact boolean, authentic boolean, trusted boolean, covers_file boolean, reason string, n_certificates int"
    return D.read_back(_docs(spark, d), author, read, schema, "doc_id", "doc_id", "text")


@_query(f"SELECT doc_id, {_PAGES}::BIGINT AS n_pages, 2::BIGINT AS tree, 842.0::DOUBLE AS height, 2 * {_PAGES} AS n_kids, 'Count,Kids,Lang,Type' AS names, {_PAGES}::BIGINT AS n_parents FROM documents")
def value_accessors(spark, d):
    """Entries of the files' objects through the value accessors: integers, references, numbers of arrays, dictionaries changed."""
    e = D.object_entries(D.authored(_docs(spark, d), kind="xref"))
    kind, syntax = F.col("kind"), F.col("syntax")
    numbers = F.filter(F.split(F.translate("syntax", "[]", ""), " "), lambda x: x != "")
    tree = F.col("num") == 2
    dictionary = F.map_from_entries(F.collect_list(F.when(tree, F.struct("name", "syntax"))))
    changed = V.removed(V.inserted(V.inserted(dictionary, "Count", F.lit("7")), "Lang", F.lit("(en)")), "MediaBox")
    kids = F.max(F.when(tree & (F.col("name") == "Kids"), F.size(V.pushed(F.split("syntax", " R"), F.lit("x"))) - 2))
    out = e.groupBy("doc_id").agg(
        F.max(F.when(F.col("name") == "Count", V.as_integer(kind, syntax))).alias("n_pages"), F.max(F.when((F.col("name") == "Pages"), V.as_reference(kind, syntax)["num"])).alias("tree"),
        F.max(F.when(F.col("name") == "MediaBox", V.as_number(F.lit("int"), F.get(numbers, F.lit(3))))).alias("height"), kids.alias("kids"),
        F.array_join(F.transform(V.entries(changed), lambda x: x["key"]), ",").alias("names"), V.got(dictionary, "Count").try_cast("long").alias("count"),
        F.count_if((F.col("name") == "Parent") & (V.as_reference(kind, syntax)["num"] == 2) & V.as_bool(kind, syntax).isNull() & V.as_real(kind, syntax).isNull()).alias("n_parents"),
    )
    return out.select("doc_id", "n_pages", "tree", "height", (F.col("kids") + F.col("count")).cast("long").alias("n_kids"), "names", "n_parents")


@_query(r"""
SELECT page_id, len(regexp_extract_all(url, '[()<>\[\]{}/%]'))::BIGINT AS delimiters, len(regexp_extract_all(html, '[\x00\t\n\f\r ]'))::BIGINT AS spaces, len(regexp_extract_all(url, '[^\x00\t\n\f\r ()<>\[\]{}/%]'))::BIGINT AS regular,
  coalesce(list_sum(list_transform(regexp_extract_all(url, '[0-9A-Fa-f]'), lambda x: instr('123456789abcdef', lower(x)))), 0)::BIGINT AS digits
FROM pages""")
def byte_classes(spark, d):
    """Classes of the bytes of whole addresses and pages."""
    codes = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x))
    count = lambda c, f: F.size(F.filter(codes(F.col(c)), f)).cast("long")
    digits = F.aggregate(codes(F.col("url")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(V.hex_value(x), F.lit(0)))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", count("url", V.is_delimiter).alias("delimiters"), count("html", V.is_white_space).alias("spaces"), count("url", V.is_regular).alias("regular"), digits.alias("digits"))
