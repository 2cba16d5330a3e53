"""Documents as rows: bytes in a BINARY column become tables of their structure, and edited bytes.

Each reader opens a document once, in an Arrow batch function beside the scan; there is no shuffle. A document that can't be read has
a row in rejects(), with its error, and none in the other tables; a null document has no row in either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import composing, content, flow, metadata, structure
from quire.functions import signatures as signing
from quire.functions.objects import Document, open_document, pages, serialise

FAULTS = (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError)


def _rows(df: DataFrame, read: Callable[[Document], Iterator[dict]], schema: str, key: str, content_: str) -> DataFrame:
    """A row for each dict that `read` gives, with the document's key."""
    return _found(df, None, read, schema, key, content_)


#: Rows, and bytes of text and binary values, that a reader puts in one Arrow batch.
MAX_ROWS, MAX_BYTES = 4096, 16 << 20


def _found(df: DataFrame, author: Callable[..., tuple[bytes, dict]] | None, read: Callable[[Document], Iterator[dict]], schema: str, key: str, *columns: str) -> DataFrame:
    """A row for each dict that `read` gives for a row's file: the one of its column, or the one that `author` writes."""
    kind = df.schema[key].dataType.simpleString()
    names = [x.split(" ")[0] for x in _split(schema)]

    def go(batches):
        for batch in batches:
            keys, rows, held = [], [], 0

            def packed(keys, rows, own=batch.schema[0].type):
                return pa.RecordBatch.from_arrays([pa.array(keys, own), *[pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types, strict=True)]], [key, *names])

            for k, *values in zip(batch.column(0).to_pylist(), *_values(batch, columns), strict=True):
                data, facts = author(*values) if author else (values[0], {})
                if data is None:
                    continue
                try:
                    found = [{**facts, **r} for r in read(open_document(data))]
                except FAULTS:
                    continue
                keys += [k] * len(found)
                rows += found
                held += sum(len(v) for r in found for v in r.values() if isinstance(v, (bytes, str)))
                if len(rows) >= MAX_ROWS or held >= MAX_BYTES:
                    yield packed(keys, rows)
                    keys, rows, held = [], [], 0
            if rows:
                yield packed(keys, rows)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]
    return df.select(key, *[c for c in columns if c != key]).mapInArrow(go, f"{key} {kind}, {schema}")


def read_back(df: DataFrame, author: Callable[..., tuple[bytes, dict]], read: Callable[[Document], Iterator[dict]], schema: str, key: str, *columns: str) -> DataFrame:
    """key and a row for each dict that `read` gives for the file that `author` writes from a row's columns, with what `author` knew
    of it beforehand: written, opened from its bytes and read in one pass, so that no file goes through the JVM."""
    return _found(df, author, read, schema, key, *columns)


def _values(batch: pa.RecordBatch, columns: tuple[str, ...]) -> list[Iterator]:
    """The columns' values, one at a time: a batch's files are not all held twice."""
    return [(x.as_py() for x in batch.column(batch.schema.get_field_index(c))) for c in columns]


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def rejects(df: DataFrame, key: str = "doc_id", content_: str = "content", read: Callable[[Document], object] = structure.facts) -> DataFrame:
    """key, error: the documents that can't be read, and why; `read` is what was to be read of them."""
    kind = df.schema[key].dataType.simpleString()

    def go(batches):
        for batch in batches:
            keys, errors = [], []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is not None:
                    try:
                        read(open_document(data))
                    except FAULTS as e:
                        keys.append(batch.column(0)[i].as_py())
                        errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(errors, pa.string())], [key, "error"])

    return df.select(key, content_).mapInArrow(go, f"{key} {kind}, error string")


def meta(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, lambda d: [structure.facts(d)], "version string, open_mode string, n_pages int, n_objects int, title string, author string, encrypted boolean", key, content_)


def page_texts(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, lambda d: [{"page_index": i, "text": content.page_text(d, p)} for i, (_, p) in enumerate(pages(d))], "page_index int, text string", key, content_)


def document_texts(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, lambda d: [{"text": structure.document_text(d)}], "text string", key, content_)


def page_table(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    def read(d):
        for i, (num, p) in enumerate(pages(d)):
            box = d.resolve(p.get("MediaBox"))
            yield {"page_index": i, "object": num, "media_box": [float(x) for x in box] if isinstance(box, list) else None, "rotate": d.resolve(p.get("Rotate")) or 0}

    return _rows(df, read, "page_index int, object long, media_box array<double>, rotate long", key, content_)


_KINDS = {type(None): "null", bool: "bool", int: "int", float: "real", bytes: "string", list: "array", dict: "dict"}


def _value(v) -> tuple[str, str]:
    """Kind and syntax; a stream's syntax is its dictionary's."""
    return _KINDS.get(type(v), type(v).__name__.lower()), serialise(v if not hasattr(v, "raw") else v.dict).decode("latin-1")


def object_table(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    def read(d):
        for num, v in d.live():
            kind, syntax = _value(v)
            yield {"num": num, "kind": kind, "syntax": syntax}

    return _rows(df, read, "num long, kind string, syntax string", key, content_)


def object_entries(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    """Entries of dictionaries and streams, a row each: functions.values has accessors for kind and syntax."""

    def read(d):
        for num, v in d.live():
            for k, x in (v.dict if hasattr(v, "raw") else v if isinstance(v, dict) else {}).items():
                kind, syntax = _value(x)
                yield {"num": num, "name": k, "kind": kind, "syntax": syntax}

    return _rows(df, read, "num long, name string, kind string, syntax string", key, content_)


def operation_table(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    def read(d):
        for i, (_, p) in enumerate(pages(d)):
            for n, (op, args) in enumerate(content.operations(content.page_content(d, p))):
                yield {"page_index": i, "seq": n, "operator": op, "operands": [serialise(a).decode("latin-1") for a in args]}

    return _rows(df, read, "page_index int, seq int, operator string, operands array<string>", key, content_)


def fragment_table(df: DataFrame, key: str = "doc_id", content_: str = "content", every_page: bool = False) -> DataFrame:
    """The positioned texts of each page; with every_page, a page without any has one empty text."""
    def read(d):
        for i, (_, p) in enumerate(pages(d)):
            for n, (t, x, y) in enumerate(content.page_fragments(d, p) or [("", 0.0, 0.0)] * every_page):
                yield {"page_index": i, "seq": n, "text": t, "x": x, "y": y}

    return _rows(df, read, "page_index int, seq int, text string, x double, y double", key, content_)


def fields(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.form_fields, "name string, field_type string, value string, rect array<double>, page_index int", key, content_)


def outline_nodes(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.outline, "node_id int, parent_id int, ord int, depth int, title string, dest_page int", key, content_)


def annotations(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.annotations, "page_index int, subtype string, rect array<double>, contents string, uri string, dest_page int", key, content_)


def attachments(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.attachments, "name string, data binary, mime string, relationship string, description string", key, content_)


def fonts(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.fonts, "resource string, base_font string, subtype string, embedded boolean, to_unicode boolean", key, content_)


def images(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, structure.images, "page_index int, width long, height long, bits long, color_space string, components int, encoding string, data binary", key, content_)


def declared_dates(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    """The raw dates and XMP packet; scalars.pdf_date reads the dates."""
    return _rows(df, lambda d: [{**metadata.dates(d), "xmp": metadata.xmp(d)}], "creation string, modification string, xmp string", key, content_)


def version_requirements(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.requirements, "seq int, num long, major int, minor int, construct string", key, content_)


def least_versions(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, lambda d: [{"version": "%d.%d" % metadata.least_version(d), "violation": metadata.violation(d, (1, 4))}], "version string, violation string", key, content_)


def document_parts(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    read = lambda d: [{**r, "metadata": list(r["metadata"].items())} for r in metadata.parts(d)]
    return _rows(df, read, "part int, start_page int, end_page int, metadata map<string,string>", key, content_)


def structure_namespaces(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.namespaces, "ord int, uri string", key, content_)


def developer_extensions(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.extensions, "prefix string, base_version string, level long, url string, revision string", key, content_)


def encrypted_payloads(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, lambda d: [x] if (x := metadata.payload(d)) else [], "file_name string, filter string, version string, data binary", key, content_)


def label_ranges(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.label_ranges, "start_page long, style string, prefix string, first long", key, content_)


def special_spaces(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.special_spaces, "page_index int, name string, kind string, base string, colorants array<string>, entries int, first array<double>", key, content_)


def embedded_fonts(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, metadata.embedded_fonts, "num long, name string, units_per_em int, n_glyphs int, ascent int, descent int, cap_height int, bbox array<int>, italic_angle double, italic boolean, outlines string, bytes long", key, content_)


def structure_elements(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, flow.elements_of, "seq int, tag string, depth int, first_page int, n_lines int, described boolean", key, content_)


def conformance(df: DataFrame, flavour: str = "2b", key: str = "doc_id", content_: str = "content") -> DataFrame:
    """The first broken rule of a PDF/A flavour and of PDF/UA, from the facts of each file; null where none is broken."""
    part, level, _ = composing.PDFA[flavour]

    def read(d):
        facts = flow.conformance_facts(d)
        yield {"pdfa": composing.pdfa_violation(facts, part, level.lower()), "pdfua": composing.pdfua_violation(facts)}

    return _rows(df, read, "pdfa string, pdfua string", key, content_)


def signatures(df: DataFrame, roots: tuple[bytes, ...] = (), key: str = "doc_id", content_: str = "content") -> DataFrame:
    """Every signature, verified; roots: certificates (DER) that are trusted."""
    read = lambda d: signing.signatures(d, [signing.Certificate.of(r) for r in roots])
    return _rows(df, read, "name string, signer string, digest string, intact boolean, authentic boolean, trusted boolean, covers_file boolean, vri_key string, reason string, fault string", key, content_)


def validation_info(df: DataFrame, key: str = "doc_id", content_: str = "content") -> DataFrame:
    return _rows(df, signing.validation_info, "vri_key string, n_certificates int, n_crls int, n_ocsps int", key, content_)


def written(df: DataFrame, author: Callable[..., bytes], key: str, *columns: str) -> DataFrame:
    """key, content: a document that `author` writes from each row's columns."""
    kind = df.schema[key].dataType.simpleString()

    def go(batches):
        for batch in batches:
            out = [author(*row.values()) for row in batch.select(list(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "content"])

    return df.select(key, *[c for c in columns if c != key]).mapInArrow(go, f"{key} {kind}, content binary")


def edited(df: DataFrame, edit: Callable[[Document], bytes], key: str = "doc_id", content_: str = "content") -> DataFrame:
    """key, content: each document's bytes after an edit of quire.functions.structure."""
    return _rows(df, lambda d: [{"content": edit(d)}], "content binary", key, content_)


def authored(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """key, content and the columns to keep: a document written from each text."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}

    def go(batches):
        for batch in batches:
            out = [structure.author(t or "", str(k), **how) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *[batch.column(c) for c in keep]], [key, "content", *keep])

    return df.select(key, text, *keep).mapInArrow(go, ", ".join([f"{key} {kinds[key]}", "content binary", *[f"{c} {kinds[c]}" for c in keep]]))


def merged(df: DataFrame, group: str, order: str, content_: str = "content") -> DataFrame:
    """group, content: one file of each group's documents in order. A group's bytes have to fit one task, as its result does."""
    whole = df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content_).alias("c")))), lambda x: x["c"]).alias("parts"))
    kind = df.schema[group].dataType.simpleString()

    def go(batches):
        for batch in batches:
            out = [structure.merge([open_document(p) for p in parts if p is not None]) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [group, "content"])

    return whole.mapInArrow(go, f"{group} {kind}, content binary")
