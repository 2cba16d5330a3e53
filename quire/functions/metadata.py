"""What a document declares about itself: dates, XMP, versions its constructs need, parts, namespaces, extensions,
wrapped payloads, page labels, special colour spaces; and an author of these for files that are written here."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape

import numpy as np

from quire.functions import calc, codecs, fonts
from quire.functions.content import operations, text_string, to_text_string
from quire.functions.objects import Document, Name, Ref, Stream, decoded, page_content, pages, write
from quire.functions.structure import color_space, names

Version = tuple[int, int]


def info_string(doc: Document, key: str) -> str | None:
    v = doc.resolve(doc.dict_of(doc.trailer.get("Info")).get(key))
    return text_string(v) if isinstance(v, bytes) else None


def dates(doc: Document) -> dict:
    """Creation and modification date as they are written: scalars.pdf_date reads them as columns."""
    return {"creation": info_string(doc, "CreationDate"), "modification": info_string(doc, "ModDate")}


def xmp(doc: Document) -> str | None:
    s = doc.resolve(doc.catalog.get("Metadata"))
    if not isinstance(s, Stream):
        return None
    try:
        return decoded(s).decode("utf-8", "replace")
    except codecs.CodecError:
        return None


# --- versions ---------------------------------------------------------------------------------------------------------

#: Fixed values: (version, construct, types that the dictionary may have or None for any, key, the key's value or None for any).
RULES: tuple[tuple[Version, str, tuple[str, ...] | None, str, str | None], ...] = (
    ((1, 5), "JPXDecode filter", None, "Filter", "JPXDecode"),
    ((1, 5), "object stream", None, "Type", "ObjStm"),
    ((2, 0), "document part", None, "Type", "DPart"),
    ((2, 0), "document part root", None, "Type", "DPartRoot"),
    ((2, 0), "structure namespace", None, "Type", "Namespace"),
    ((2, 0), "associated file", ("Page", "Annot", "XObject", "StructElem"), "AF", None),
    ((2, 0), "encrypted payload", ("Filespec",), "EP", None),
    ((1, 5), "tab order", ("Page",), "Tabs", None),
    ((2, 0), "page output intent", ("Page",), "OutputIntents", None),
    ((2, 0), "structure element reference", ("StructElem",), "Ref", None),
    ((1, 6), "OpenType font program", None, "Subtype", "OpenType"),
    ((1, 5), "optional content", None, "OCProperties", None),
    ((1, 7), "collection", None, "Collection", None),
    ((2, 0), "document parts", None, "DPartRoot", None),
    ((2, 0), "structure namespaces", None, "Namespaces", None),
)
#: The same for dictionaries inside a typed one: (version, construct, type, key that holds them, key, value).
NESTED = (
    ((2, 0), "structure destination", "Annot", "A", "SD", None),
    ((2, 0), "GoToDp action", "Annot", "A", "S", "GoToDp"),
    ((1, 5), "table header scope", "StructElem", "A", "Scope", None),
    ((1, 7), "PrintField attributes", "StructElem", "A", "O", "PrintField"),
)
#: Versions by the encryption dictionary's /V.
ENCRYPTION = {4: (1, 6), 5: (2, 0)}


def _version(v) -> Version | None:
    m = re.fullmatch(r"(\d{1,3})\.(\d{1,3})", str(v)) if isinstance(v, Name) else None
    return (int(m[1]), int(m[2])) if m else None


def _has(d: dict, key: str, value: str | None) -> bool:
    if key not in d:
        return False
    found = d[key] if isinstance(d[key], list) else [d[key]]
    return value is None or any(isinstance(x, Name) and x == value for x in found)


def _in_utf8(v) -> bool:
    if isinstance(v, bytes):
        return v.startswith(b"\xef\xbb\xbf")
    if isinstance(v, Stream):
        v = v.dict
    return any(map(_in_utf8, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else False


def _extension_needs(extensions: dict) -> Iterator[tuple[Version, str]]:
    yield (1, 7), "developer extensions"
    for prefix, v in extensions.items():
        if isinstance(v, list):
            yield (2, 0), "array of developer extensions"
        for d in [] if prefix == "Type" else v if isinstance(v, list) else [v]:
            if isinstance(d, dict):
                if "URL" in d or "ExtensionRevision" in d:
                    yield (2, 0), "developer extension with URL or revision"
                if _version(d.get("BaseVersion")):
                    yield _version(d["BaseVersion"]), "developer extension's base version"


def needs(v) -> Iterator[tuple[Version, str]]:
    """(version, construct) of what an object holds that raises the version."""
    d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
    kind = d.get("Type")
    for version, construct, kinds, key, value in RULES:
        if (kinds is None or kind in kinds) and _has(d, key, value):
            yield version, construct
    for version, construct, of, holder, key, value in NESTED:
        if kind == of and any(isinstance(x, dict) and _has(x, key, value) for x in (d[holder] if isinstance(d.get(holder), list) else [d.get(holder)])):
            yield version, construct
    if isinstance(d.get("Extensions"), dict):
        yield from _extension_needs(d["Extensions"])
    if _version(d.get("Version")):
        yield _version(d["Version"]), "catalog version"
    if _in_utf8(v):
        yield (2, 0), "UTF-8 text string"


def requirements(doc: Document) -> list[dict]:
    """A row for each construct met, by object number, with its place in that order."""
    out = []
    for num, v in doc.live():
        out += [{"num": num, "major": m, "minor": n, "construct": c} for (m, n), c in needs(v)]
    return [{"seq": i, **r} for i, r in enumerate(out)]


def least_version(doc: Document) -> Version:
    """The least version, from 1.4 on, that has all of the document's constructs."""
    floor = (1, 4)
    if "Encrypt" in doc.trailer:
        floor = ENCRYPTION.get(doc.dict_of(doc.trailer["Encrypt"]).get("V"), floor)
    return max([floor, *[(r["major"], r["minor"]) for r in requirements(doc)]])


def violation(doc: Document, target: Version) -> str | None:
    """The construct that needs most beyond the target; of equals the last."""
    over = [((r["major"], r["minor"]), r["seq"], r["construct"]) for r in requirements(doc) if (r["major"], r["minor"]) > target]
    return max(over)[2] if over else None


# --- parts, namespaces, extensions, payloads, labels ---------------------------------------------------------------------


def parts(doc: Document) -> list[dict]:
    """The parts right below the root node: their pages (from 0; the end is the start where it is missing) and metadata."""
    index = {num: i for i, (num, _) in enumerate(pages(doc)) if num is not None}
    node = doc.dict_of(doc.dict_of(doc.catalog.get("DPartRoot")).get("DPartRootNode"))
    out = []
    for n, ref in enumerate(node["DParts"] if isinstance(node.get("DParts"), list) else []):
        d = doc.dict_of(ref)
        at = lambda key, d=d: index.get(d[key].num) if isinstance(d.get(key), Ref) else None
        start = at("Start") or 0
        end = at("End")
        said = {k: text_string(v) if isinstance(v, bytes) else "" for k, v in doc.dict_of(d.get("DPM")).items()}
        out.append({"part": n, "start_page": start, "end_page": start if end is None else end, "metadata": said})
    return out


def namespaces(doc: Document) -> list[dict]:
    found = doc.dict_of(doc.catalog.get("StructTreeRoot")).get("Namespaces")
    uris = [doc.dict_of(x).get("NS") for x in found] if isinstance(found, list) else []
    return [{"ord": i, "uri": text_string(x)} for i, x in enumerate(u for u in uris if isinstance(u, bytes))]


def extensions(doc: Document) -> list[dict]:
    """One row for each extensions dictionary, whether it stands alone or in an array; those without version or level are passed over."""
    out = []
    for prefix, v in doc.dict_of(doc.catalog.get("Extensions")).items():
        v = doc.resolve(v)
        for x in [] if prefix == "Type" else v if isinstance(v, list) else [v]:
            d = doc.dict_of(x)
            base, level = _version(d.get("BaseVersion")), d.get("ExtensionLevel")
            if base and type(level) is int:
                said = {k: text_string(d[key]) if isinstance(d.get(key), bytes) else None for k, key in (("url", "URL"), ("revision", "ExtensionRevision"))}
                out.append({"prefix": prefix, "base_version": "%d.%d" % base, "level": level, **said})
    return out


def payload(doc: Document) -> dict | None:
    """The first embedded file with an encrypted payload dictionary: the wrapped, still encrypted document."""
    for key, spec in names(doc, "EmbeddedFiles"):
        d = doc.dict_of(spec)
        wrapped = doc.dict_of(d.get("EP"))
        s = doc.resolve(doc.dict_of(d.get("EF")).get("F"))
        if isinstance(wrapped.get("Subtype"), Name) and isinstance(s, Stream):
            try:
                data = decoded(s)
            except codecs.CodecError:
                continue
            v = _version(wrapped.get("Version"))
            title = next((x for k in ("UF", "F") if isinstance(x := doc.resolve(d.get(k)), bytes)), None)
            return {"file_name": text_string(title) if title is not None else key.decode("utf-8", "replace"), "filter": str(wrapped["Subtype"]), "version": "%d.%d" % v if v else None, "data": data}
    return None


def label_ranges(doc: Document) -> list[dict]:
    """start_page, style, prefix and first number of each range of page labels: scalars.page_label numbers pages with them."""
    out, todo = [], [doc.catalog.get("PageLabels")]
    while todo and len(out) < 65_536:
        d = doc.dict_of(todo.pop(0))
        flat = doc.resolve(d.get("Nums")) or []
        for start, v in zip(flat[::2], flat[1::2], strict=False):
            x = doc.dict_of(v)
            out.append({"start_page": start, "style": str(x["S"]) if "S" in x else "", "prefix": text_string(x["P"]) if isinstance(x.get("P"), bytes) else "", "first": x.get("St", 1)})
        todo = [*(doc.resolve(d.get("Kids")) or []), *todo]
    return out


# --- colour spaces -----------------------------------------------------------------------------------------------------


def indexed(doc: Document, v) -> dict | None:
    """base, components, top and palette of an Indexed space."""
    v = doc.resolve(v)
    if not (isinstance(v, list) and len(v) >= 4 and v[0] in ("Indexed", "I")):
        return None
    top, table = doc.resolve(v[2]), doc.resolve(v[3])
    table = decoded(table) if isinstance(table, Stream) else table
    if type(top) is not int or not isinstance(table, bytes):
        return None
    base, n = color_space(doc, v[1])
    return {"base": base, "components": n, "top": max(0, min(255, top)), "palette": table}


def entry(space: dict, i: int) -> bytes | None:
    """The base colour of an index, or nothing beyond the top or the palette."""
    n = space["components"]
    found = space["palette"][i * n : (i + 1) * n]
    return found if 0 <= i <= space["top"] and len(found) == n else None


def separation(doc: Document, v) -> dict | None:
    """names, alternate, components and tint function of a Separation or DeviceN space."""
    v = doc.resolve(v)
    if not (isinstance(v, list) and len(v) >= 4 and v[0] in ("Separation", "DeviceN")):
        return None
    said = doc.resolve(v[1])
    found = [str(x) for x in (said if isinstance(said, list) else [said]) if isinstance(x, Name)]
    if not found or isinstance(said, list) != (v[0] == "DeviceN"):
        return None
    tint = calc.parse(doc, v[3])
    alternate, n = color_space(doc, v[2])
    return {"names": found, "alternate": alternate, "components": n, "tint": tint} if tint else None


def to_alternate(space: dict, tints: list[float]) -> list[float]:
    return space["tint"](tints)


def special_spaces(doc: Document) -> list[dict]:
    """Indexed, Separation and DeviceN spaces of the pages' resources, with their colours at full tint or index 0."""
    out = []
    for i, (_, page) in enumerate(pages(doc)):
        for name, v in doc.dict_of(doc.dict_of(page.get("Resources")).get("ColorSpace")).items():
            if x := indexed(doc, v):
                out.append({"page_index": i, "name": name, "kind": "Indexed", "base": x["base"], "colorants": [], "entries": x["top"] + 1, "first": [float(b) for b in entry(x, 0) or b""]})
            elif x := separation(doc, v):
                out.append({"page_index": i, "name": name, "kind": str(doc.resolve(v)[0]), "base": x["alternate"], "colorants": x["names"], "entries": None, "first": to_alternate(x, [1.0] * len(x["names"]))})
    return out


def jbig2_globals(doc: Document, image: dict) -> bytes | None:
    """The shared segments that an image's decoding parameters name."""
    found = doc.resolve(image.get("DecodeParms"))
    for x in found if isinstance(found, list) else [found]:
        s = doc.resolve(doc.dict_of(x).get("JBIG2Globals"))
        if isinstance(s, Stream):
            return decoded(s)
    return None


def embedded_fonts(doc: Document) -> list[dict]:
    """Embedded programs by object number: their metrics, and how many glyphs have outlines."""
    out, seen = [], set()
    for num, v in doc.live():
        d = v if isinstance(v, dict) else {}
        for key in ("FontFile", "FontFile2", "FontFile3"):
            ref = d.get(key)
            s = doc.resolve(ref)
            if isinstance(s, Stream) and isinstance(ref, Ref) and ref.num not in seen and (facts := fonts.metrics(program := decoded(s))):
                seen.add(ref.num)
                out.append({"num": ref.num, **facts, "bytes": len(program)})
    return out


def used_codes(doc: Document) -> dict[int, set[int]]:
    """The two-byte codes that pages show with each composite font (by object number)."""
    out: dict[int, set[int]] = {}
    for _, page in pages(doc):
        known = doc.dict_of(doc.dict_of(page.get("Resources")).get("Font"))
        num = None
        for op, args in operations(page_content(doc, page)):
            if op == "Tf" and args:
                ref = known.get(str(args[0]))
                num = ref.num if isinstance(ref, Ref) else None
            elif op in ("Tj", "TJ", "'", '"') and num is not None and args:
                for x in args[-1] if isinstance(args[-1], list) else [args[-1]]:
                    if isinstance(x, bytes):
                        out.setdefault(num, set()).update(np.frombuffer(x[: len(x) // 2 * 2], ">u2").tolist())
    return out


def subset_fonts(doc: Document) -> bytes:
    """The document as a new file whose TrueType programs of composite Identity fonts hold only the outlines in use, where that is smaller."""
    objects = dict(doc.live())
    for num, codes in used_codes(doc).items():
        font = doc.dict_of(Ref(num))
        below = doc.resolve(font.get("DescendantFonts"))
        own = doc.dict_of(below[0]) if isinstance(below, list) and below else {}
        ref = doc.dict_of(own.get("FontDescriptor")).get("FontFile2")
        if str(font.get("Encoding")) not in ("Identity-H", "Identity-V") or isinstance(doc.resolve(own.get("CIDToGIDMap")), Stream) or not isinstance(ref, Ref):
            continue
        whole = decoded(doc.resolve(ref))
        less = fonts.subset(whole, sorted(codes))
        if less is not None and len(less) < len(whole):
            objects[ref.num] = Stream({"Filter": Name("FlateDecode"), "Length1": len(less)}, codecs.flate_encode(less))
    info = doc.trailer.get("Info")
    return write(objects, doc.trailer["Root"].num, info.num if isinstance(info, Ref) else None, doc.version or (1, 7))


# --- authoring ---------------------------------------------------------------------------------------------------------


def xmp_packet(title: str, author: str = "", language: str = "", identification: str = "") -> str:
    """An XMP packet; identification: a schema prefix, part and level such as "pdfaid 3 B" or "pdfuaid 1"."""
    prefix, part, *level = identification.split() if identification else ("", "")
    known = f'<rdf:Description rdf:about="" xmlns:{prefix}="http://www.aiim.org/{prefix.removesuffix("id")}/ns/id/">' if prefix else ""
    known += f"<{prefix}:part>{part}</{prefix}:part>" + "".join(f"<{prefix}:conformance>{x}</{prefix}:conformance>" for x in level) + "</rdf:Description>" if prefix else ""
    body = f'<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">{escape(title)}</rdf:li></rdf:Alt></dc:title>'
    body += f"<dc:creator><rdf:Seq><rdf:li>{escape(author)}</rdf:li></rdf:Seq></dc:creator>" if author else ""
    body += f"<dc:language><rdf:Bag><rdf:li>{escape(language)}</rdf:li></rdf:Bag></dc:language>" if language else ""
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">{body}</rdf:Description>{known}</rdf:RDF></x:xmpmeta>\n<?xpacket end="w"?>'


def output_intent(profile: Ref, identifier: str) -> dict:
    return {"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1"), "OutputConditionIdentifier": to_text_string(identifier), "DestOutputProfile": profile}


def png_image(data: bytes) -> Stream | None:
    """An image object from PNG bytes: grey, RGB or palette without interlace and alpha; its rows stay as PNG packed them."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, table, rows = 8, None, b"", b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" and len(body) == 13 else head
        table, rows = table + body * (kind == b"PLTE"), rows + body * (kind == b"IDAT")
        at += 12 + size
    if not head or head[6] or head[3] not in (0, 2, 3) or not 0 < head[0] <= 1 << 20 or not 0 < head[1] <= 1 << 20 or head[0] * head[1] > 1 << 28:
        return None
    width, height, bits, kind = head[:4]
    n = 3 if kind == 2 else 1
    try:
        if len(zlib.decompress(rows)) != height * (1 + (width * bits * n + 7) // 8):
            return None
    except zlib.error:
        return None
    space = [Name("Indexed"), Name("DeviceRGB"), len(table) // 3 - 1, table] if kind == 3 else Name("DeviceRGB" if n == 3 else "DeviceGray")
    parms = {"Predictor": 15, "Colors": n, "BitsPerComponent": bits, "Columns": width}
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": bits, "ColorSpace": space, "Filter": Name("FlateDecode"), "DecodeParms": parms}, rows)


def declared(
    doc: Document, *, creation: str = "", packet: str = "", parts: list[tuple[int, int, dict[str, str]]] = (), namespaces: list[str] = (), extensions: dict[str, object] | None = None,
    labels: list[tuple[int, str, str, int]] = (), wrapped: tuple[str, str, bytes] | None = None, annotations: list[dict] = (), spaces: dict[str, object] | None = None,
    xobjects: dict[str, Stream] | None = None, paint: bytes = b"", destinations: dict[str, int] | None = None, version: Version = (2, 0),
) -> bytes:
    """The document as a new file with declarations added: dates, XMP, parts (first page, last page, metadata), namespaces, extensions,
    page labels (start, style, prefix, first), a wrapped payload (name, filter, bytes), and on the first page annotations, colour spaces, external objects and content."""
    objects = dict(doc.live())
    root = doc.trailer["Root"].num
    catalog, found = dict(doc.catalog), pages(doc)

    def add(v) -> Ref:
        objects[max(objects) + 1] = v
        return Ref(max(objects))

    def direct(v):
        """The value with its streams as objects of their own."""
        if isinstance(v, Stream):
            return add(v)
        return [direct(x) for x in v] if isinstance(v, list) else {k: direct(x) for k, x in v.items()} if isinstance(v, dict) else v

    info = doc.trailer.get("Info")
    if creation and isinstance(info, Ref):
        objects[info.num] = {**doc.dict_of(info), "CreationDate": creation.encode("latin-1"), "ModDate": creation.encode("latin-1")}
    if packet:
        catalog["Metadata"] = add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, packet.encode()))
    if parts:
        node = add(None)
        leaves = [add({"Type": Name("DPart"), "Parent": node, "Start": Ref(found[a][0]), "End": Ref(found[b][0]), "DPM": {k: to_text_string(v) for k, v in said.items()}}) for a, b, said in parts]
        objects[node.num] = {"Type": Name("DPart"), "DParts": leaves}
        catalog["DPartRoot"] = add({"Type": Name("DPartRoot"), "DPartRootNode": node})
    if namespaces:
        catalog["StructTreeRoot"] = add({"Type": Name("StructTreeRoot"), "Namespaces": [add({"Type": Name("Namespace"), "NS": to_text_string(x)}) for x in namespaces]})
    if extensions:
        catalog["Extensions"] = extensions
    if labels:
        catalog["PageLabels"] = {"Nums": [x for start, style, prefix, first in labels for x in (start, {**({"S": Name(style)} if style else {}), **({"P": to_text_string(prefix)} if prefix else {}), "St": first})]}
    tree = dict(doc.dict_of(catalog.get("Names")))
    if wrapped:
        title, kind, data = wrapped
        spec = {"Type": Name("Filespec"), "F": to_text_string(title), "UF": to_text_string(title), "EP": {"Type": Name("EncryptedPayload"), "Subtype": Name(kind), "Version": Name("1.0")}, "EF": {"F": add(Stream({"Type": Name("EmbeddedFile")}, data))}}
        tree["EmbeddedFiles"] = {"Names": [to_text_string(title), add(spec)]}
    if destinations:
        tree["Dests"] = {"Kids": [add({"Names": [to_text_string(k), [Ref(found[i][0]), Name("Fit")]], "Limits": [to_text_string(k)] * 2}) for k, i in sorted(destinations.items())]}
    if tree:
        catalog["Names"] = tree
    num, page = found[0]
    own = dict(objects[num])
    resources = dict(doc.dict_of(page.get("Resources")))
    if annotations:
        own["Annots"] = [*(doc.resolve(page.get("Annots")) or []), *[add({"Type": Name("Annot"), **direct(a)}) for a in annotations]]
    if spaces:
        resources["ColorSpace"] = direct(spaces)
    if xobjects:
        resources["XObject"] = {k: add(Stream(direct(v.dict), v.raw)) for k, v in xobjects.items()}
    if paint:
        old = page.get("Contents")
        own["Contents"] = [*(old if isinstance(old, list) else [old] if old else []), add(Stream({}, paint))]
    objects[num], objects[root] = {**own, "Resources": resources}, catalog
    return write(objects, root, info.num if isinstance(info, Ref) else None, version)


def composite_font(program: bytes, map_: bytes | None = None) -> dict:
    """A Type0 font of an embedded TrueType program without a ToUnicode map; map_: CIDs to glyphs, two bytes each."""
    facts = fonts.metrics(program)
    descriptor = {"Type": Name("FontDescriptor"), "FontName": Name(facts["name"]), "Flags": 4, "FontBBox": facts["bbox"], "ItalicAngle": facts["italic_angle"], "Ascent": facts["ascent"], "Descent": facts["descent"], "CapHeight": facts["cap_height"], "StemV": 80, "FontFile2": Stream({"Length1": len(program)}, program)}
    widths = [w for _, w in fonts.advances(program)]
    below = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(facts["name"]), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": descriptor, "W": [0, widths], "CIDToGIDMap": Stream({}, map_) if map_ else Name("Identity")}
    return {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(facts["name"]), "Encoding": Name("Identity-H"), "DescendantFonts": [below]}


#: The same for all texts that are set in one program; set_in_font copies what it takes.
_composite_font = lru_cache(8)(composite_font)


def set_in_font(text: str, program: bytes, size: float = 12) -> bytes:
    """A document of one page whose lines are set in an embedded program, in glyph numbers."""
    codes, at, lines = fonts.glyph_codes(program, text), 0, []
    for x in text.split("\n"):
        said = b"".join(b"%04X" % g["glyph"] for g in fonts.shaped(program, x)) if codes is None else codes[2 * at : 2 * (at + len(x))].hex().upper().encode()
        lines.append(b"<" + said + b"> Tj T*")
        at += len(x) + 1
    content = b"BT /F0 %g Tf %g TL 50 790 Td " % (size, size * 1.2) + b"\n".join(lines) + b" ET"
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}}

    def add(v, whole: bool = False):
        """Streams, descriptors and fonts as objects of their own."""
        if isinstance(v, list):
            return [add(x) for x in v]
        if isinstance(v, dict):
            v = {k: add(x) for k, x in v.items()}
        if whole or isinstance(v, Stream) or isinstance(v, dict) and v.get("Type") in ("Font", "FontDescriptor"):
            objects[max(objects) + 1] = v
            return Ref(max(objects))
        return v

    objects[3] = None
    objects[3] = {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 595, 842], "Contents": add(Stream({}, content)), "Resources": {"Font": {"F0": add(_composite_font(program))}}}
    return write(objects, 1)
