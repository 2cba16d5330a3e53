"""Readers of a document's structure, and edits that give new bytes: fields, outline, names, annotations, fonts, images; merge, extract, rotate, fill, flatten."""

from __future__ import annotations

from quire.functions import codecs
from quire.functions.content import layout, page_fragments, page_text, text_string, to_text_string, winansi_encode
from quire.functions.objects import Document, Name, Ref, Stream, decoded, filters_of, pages, write, write_incremental

MAX_FIELDS, MAX_FIELD_DEPTH = 65_536, 64


def field_value(doc: Document, v) -> str | None:
    v = doc.resolve(v)
    if isinstance(v, bytes):
        return text_string(v)
    if isinstance(v, Name):
        return str(v)
    if isinstance(v, list):
        return ", ".join(x for x in (field_value(doc, y) for y in v) if x is not None)
    return None


def _terminal_fields(doc: Document):
    """(number, qualified name, type, value, dictionary, widgets) of terminal fields; kids with a name are fields, others widgets."""
    out, seen = [], set()

    def walk(ref, prefix: str, kind, value, depth: int) -> None:
        num = ref.num if isinstance(ref, Ref) else None
        if depth > MAX_FIELD_DEPTH or len(out) >= MAX_FIELDS or (num is not None and num in seen):
            return
        seen.add(num)
        d = doc.dict_of(ref)
        own = text_string(doc.resolve(d.get("T"))) if "T" in d else ""
        name = f"{prefix}.{own}" if prefix and own else prefix or own
        kind, value = d.get("FT", kind), d.get("V", value)
        kids = doc.resolve(d.get("Kids")) or []
        fields = [k for k in kids if "T" in doc.dict_of(k)]
        for k in fields:
            walk(k, name, kind, value, depth + 1)
        if not fields:
            out.append((num, name, kind, value, d, kids or [ref]))

    for ref in doc.resolve(doc.dict_of(doc.catalog.get("AcroForm")).get("Fields")) or []:
        walk(ref, "", None, None, 0)
    return out


def form_fields(doc: Document) -> list[dict]:
    found = pages(doc)
    index = {num: i for i, (num, _) in enumerate(found) if num is not None}
    holder: dict[int, int] = {}
    for i, (_, page) in enumerate(found):
        for a in doc.resolve(page.get("Annots")) or []:
            if isinstance(a, Ref):
                holder.setdefault(a.num, i)
    out = []
    for _, name, kind, value, _, widgets in _terminal_fields(doc):
        w = doc.dict_of(widgets[0])
        rect = doc.resolve(w.get("Rect"))
        at = index.get(w["P"].num) if isinstance(w.get("P"), Ref) else None
        if at is None and isinstance(widgets[0], Ref):
            at = holder.get(widgets[0].num)
        out.append({"name": name, "field_type": str(kind) if kind else None, "value": field_value(doc, value), "rect": [float(x) for x in rect] if isinstance(rect, list) and len(rect) == 4 else None, "page_index": at})
    return out


def outline(doc: Document) -> list[dict]:
    """Adjacency rows in reading order; an item met twice ends its chain."""
    index = {num: i for i, (num, _) in enumerate(pages(doc)) if num is not None}
    out, seen = [], set()

    def walk(ref, parent: int | None, depth: int) -> None:
        order = 0
        while isinstance(ref, Ref) and ref.num not in seen and depth < 64:
            seen.add(ref.num)
            d = doc.dict_of(ref)
            node = len(out)
            out.append({"node_id": node, "parent_id": parent, "ord": order, "depth": depth, "title": text_string(doc.resolve(d.get("Title"))), "dest_page": destination(doc, d, index)})
            walk(d.get("First"), node, depth + 1)
            ref, order = d.get("Next"), order + 1

    walk(doc.dict_of(doc.catalog.get("Outlines")).get("First"), None, 0)
    return out


def name_tree(doc: Document, root, depth: int = 0, out: list | None = None) -> list[tuple[bytes, object]]:
    out = [] if out is None else out
    d = doc.dict_of(root)
    if depth > 64 or len(out) > 65_536:
        return out
    entries = doc.resolve(d.get("Names")) or []
    out += [(k, v) for k, v in zip(entries[::2], entries[1::2], strict=False) if isinstance(k, bytes)]
    for kid in doc.resolve(d.get("Kids")) or []:
        name_tree(doc, kid, depth + 1, out)
    return out


def names(doc: Document, category: str) -> list[tuple[bytes, object]]:
    return name_tree(doc, doc.dict_of(doc.catalog.get("Names")).get(category))


def destination(doc: Document, d: dict, index: dict[int, int]) -> int | None:
    """Page of /Dest, or of a GoTo action's /D; names and strings look their destination up."""
    dest = doc.resolve(d.get("Dest"))
    if dest is None:
        a = doc.dict_of(d.get("A"))
        dest = doc.resolve(a.get("D")) if a.get("S") == "GoTo" else None
    if isinstance(dest, Name):
        dest = doc.resolve(doc.dict_of(doc.catalog.get("Dests")).get(str(dest)))
    elif isinstance(dest, bytes):
        dest = doc.resolve(dict(names(doc, "Dests")).get(dest))
    if isinstance(dest, dict):
        dest = doc.resolve(dest.get("D"))
    first = dest[0] if isinstance(dest, list) and dest else None
    return index.get(first.num) if isinstance(first, Ref) else first if type(first) is int else None


def annotations(doc: Document) -> list[dict]:
    found = pages(doc)
    index = {num: i for i, (num, _) in enumerate(found) if num is not None}
    out = []
    for i, (_, page) in enumerate(found):
        for a in doc.resolve(page.get("Annots")) or []:
            d = doc.dict_of(a)
            if not d:
                continue
            rect, action = doc.resolve(d.get("Rect")), doc.dict_of(d.get("A"))
            uri = doc.resolve(action.get("URI"))
            out.append({"page_index": i, "subtype": str(d.get("Subtype", "")), "rect": [float(x) for x in rect] if isinstance(rect, list) and len(rect) == 4 else None, "contents": text_string(doc.resolve(d["Contents"])) if "Contents" in d else None, "uri": uri.decode("latin-1") if isinstance(uri, bytes) else None, "dest_page": destination(doc, d, index)})
    return out


def attachments(doc: Document) -> list[dict]:
    out = []
    for key, spec in names(doc, "EmbeddedFiles"):
        d = doc.dict_of(spec)
        files = doc.dict_of(d.get("EF"))
        s = doc.resolve(files.get("F") or files.get("UF"))
        if isinstance(s, Stream):
            out.append({"name": text_string(doc.resolve(d.get("UF") or d.get("F"))) or text_string(key), "data": decoded(s), "mime": str(s.dict["Subtype"]) if "Subtype" in s.dict else None, "relationship": str(d["AFRelationship"]) if "AFRelationship" in d else None, "description": text_string(doc.resolve(d["Desc"])) if "Desc" in d else None})
    return out


def fonts(doc: Document) -> list[dict]:
    """Fonts by object number, first seen first; direct ones each time."""
    out, seen = [], set()
    for _, page in pages(doc):
        for name, ref in doc.dict_of(doc.dict_of(page.get("Resources")).get("Font")).items():
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            d = doc.dict_of(ref)
            descriptor = doc.dict_of(d.get("FontDescriptor"))
            out.append({"resource": name, "base_font": str(d.get("BaseFont", "")), "subtype": str(d.get("Subtype", "")), "embedded": any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3")), "to_unicode": "ToUnicode" in d})
    return out


#: Components of the device and calibrated colour spaces.
_COMPONENTS = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Lab": 3}


def color_space(doc: Document, v) -> tuple[str, int]:
    """(name, components); unknown names count one component."""
    v = doc.resolve(v)
    if v is None:
        return "DeviceGray", 1
    if isinstance(v, list) and v:
        head = str(v[0])
        if head == "ICCBased":
            n = doc.dict_of(v[1]).get("N", 3) if len(v) > 1 else 3
            return head, max(1, min(8, n)) if type(n) is int else 3
        if head == "DeviceN":
            colorants = doc.resolve(v[1]) if len(v) > 1 else None
            return head, max(1, len(colorants)) if isinstance(colorants, list) else 1
        return head, _COMPONENTS.get(head, 1)
    return str(v), _COMPONENTS.get(str(v), 1)


def images(doc: Document) -> list[dict]:
    out = []
    for i, (_, page) in enumerate(pages(doc)):
        seen: set = set()

        def walk(resources: dict, depth: int, i=i, seen=seen) -> None:
            for ref in doc.dict_of(resources.get("XObject")).values():
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        continue
                    seen.add(ref.num)
                s = doc.resolve(ref)
                if not isinstance(s, Stream):
                    continue
                if s.dict.get("Subtype") == "Image":
                    names_, _ = filters_of(s.dict)
                    kinds = [codecs.FILTERS.get(n) for n in names_ if n in codecs.FILTERS]
                    last = kinds[-1] if kinds and kinds[-1] in codecs.IMAGE_CODECS else "raw"
                    space, n = color_space(doc, s.dict.get("ColorSpace"))
                    try:
                        data = decoded(s)
                    except codecs.CodecError:
                        data = None
                    out.append({"page_index": i, "width": s.dict.get("Width"), "height": s.dict.get("Height"), "bits": s.dict.get("BitsPerComponent"), "color_space": space, "components": n, "encoding": last, "data": data})
                elif s.dict.get("Subtype") == "Form" and depth < 16:
                    walk(doc.dict_of(s.dict.get("Resources")), depth + 1)

        walk(doc.dict_of(page.get("Resources")), 0)
    return out


def facts(doc: Document) -> dict:
    info = doc.dict_of(doc.trailer.get("Info"))
    v = doc.version or (0, 0)
    return {"version": f"{v[0]}.{v[1]}", "open_mode": doc.mode, "n_pages": len(pages(doc)), "n_objects": sum(1 for _ in doc.live()), "title": text_string(doc.resolve(info.get("Title"))), "author": text_string(doc.resolve(info.get("Author"))), "encrypted": "Encrypt" in doc.trailer}


def document_text(doc: Document) -> str:
    return "\f".join(page_text(doc, p) for _, p in pages(doc))


def document_layout(doc: Document) -> str:
    return "\f".join(layout(page_fragments(doc, p)) for _, p in pages(doc))


# --- edits -----------------------------------------------------------------------------------------------------------

_INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class _Copier:
    """Deep copies into a new file: one new number for each (source, old number); cycles end because numbers come first."""

    def __init__(self):
        self.objects: dict[int, object] = {1: None, 2: None}
        self.map: dict[tuple[int, int], int] = {}

    def add(self, v) -> int:
        n = len(self.objects) + 1
        self.objects[n] = v
        return n

    def copy(self, doc: Document, v, depth: int = 0):
        if depth > 1024:
            raise ValueError("nested too deeply")
        if isinstance(v, Ref):
            key = (id(doc), v.num)
            if key not in self.map:
                self.map[key] = self.add(None)
                self.objects[self.map[key]] = self.copy(doc, doc.get(v.num), depth + 1)
            return Ref(self.map[key])
        if isinstance(v, list):
            return [self.copy(doc, x, depth + 1) for x in v]
        if isinstance(v, Stream):
            return Stream(self.copy(doc, v.dict, depth + 1), v.raw)
        if isinstance(v, dict):
            return {k: self.copy(doc, x, depth + 1) for k, x in v.items()}
        return v

    def page(self, doc: Document, page: dict) -> Ref:
        kept = {k: v for k, v in page.items() if k not in ("Parent", "StructParents", "Tabs")}
        n = self.add(None)
        self.objects[n] = {**self.copy(doc, kept), "Parent": Ref(2)}
        return Ref(n)

    def file(self, kids: list[Ref]) -> bytes:
        self.objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)}
        self.objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        return write(self.objects, 1)


def merge(docs: list[Document]) -> bytes:
    """All pages in order, as version 1.7; what is not part of a page is dropped."""
    c = _Copier()
    return c.file([c.page(d, p) for d in docs for _, p in pages(d)])


def extract_pages(doc: Document, indices: list[int]) -> bytes:
    """The pages at these places: order and repeats kept, places that don't exist left out."""
    found, c = pages(doc), _Copier()
    return c.file([c.page(doc, found[i][1]) for i in indices if 0 <= i < len(found)])


def rotate_page(doc: Document, index: int, degrees: int) -> bytes:
    num, _ = pages(doc)[index]
    return write_incremental(doc.data, {num: {**doc.get(num), "Rotate": degrees % 360}}, doc)


def save(doc: Document, kind: str = "classic", overrides: dict[int, object] | None = None) -> bytes:
    objects = {n: v for n, v in doc.live()} | (overrides or {})
    version = max(doc.version or (1, 4), (1, 5) if kind != "classic" else (1, 0))
    info = doc.trailer.get("Info")
    return write(objects, doc.trailer["Root"].num, info.num if isinstance(info, Ref) else None, version, kind)


def fill_form(doc: Document, values: dict[str, str]) -> bytes:
    """Sets fields by qualified name (the first of that name); unknown names are ignored; the original bytes stay a prefix."""
    changed: dict[int, object] = {}
    done: set[str] = set()
    buttons = True
    for num, name, kind, _, d, _ in _terminal_fields(doc):
        if name in values and name not in done and num is not None:
            done.add(name)
            button = kind == "Btn"
            buttons &= button
            changed[num] = {**d, "V": Name(values[name]) if button else to_text_string(values[name])} | ({"AS": Name(values[name])} if button else {})
    form = doc.catalog.get("AcroForm")
    if changed and not buttons:
        if isinstance(form, Ref):
            changed[form.num] = {**doc.dict_of(form), "NeedAppearances": True}
        else:
            changed[doc.trailer["Root"].num] = {**doc.catalog, "AcroForm": {**doc.dict_of(form), "NeedAppearances": True}}
    return write_incremental(doc.data, changed, doc)


def _placed(doc: Document, rect, form: dict) -> tuple[float, float, float, float] | None:
    """Scale and shift that put an appearance's box, turned by its matrix, onto the annotation's rectangle."""
    if not isinstance(rect, list) or len(rect) != 4:
        return None
    x0, y0, x1, y1 = (float(v) for v in rect)
    box = [float(v) for v in doc.resolve(form.get("BBox")) or [0, 0, x1 - x0, y1 - y0]]
    a, b, c, d, e, f = (float(v) for v in doc.resolve(form.get("Matrix")) or [1, 0, 0, 1, 0, 0])
    corners = [(a * x + c * y + e, b * x + d * y + f) for x in box[::2] for y in box[1::2]]
    left, low = min(x for x, _ in corners), min(y for _, y in corners)
    wide, high = max(x for x, _ in corners) - left, max(y for _, y in corners) - low
    sx, sy = abs(x1 - x0) / wide if wide else 1.0, abs(y1 - y0) / high if high else 1.0
    return sx, sy, min(x0, x1) - left * sx, min(y0, y1) - low * sy


def flatten_form(doc: Document) -> bytes:
    """Paints widgets' normal appearances into their pages; widgets without one stay; the form goes."""
    changed: dict[int, object] = {}
    new = max(doc.xref, default=0)
    for num, page in pages(doc):
        keep, paint, resources = [], [], {}
        for a in doc.resolve(page.get("Annots")) or []:
            d = doc.dict_of(a)
            normal = doc.dict_of(d.get("AP")).get("N")
            if d.get("Subtype") == "Widget" and isinstance(normal, Ref) and isinstance(doc.resolve(normal), Stream):
                placed = _placed(doc, doc.resolve(d.get("Rect")), doc.resolve(normal).dict)
                if placed is None:
                    keep.append(a)
                    continue
                name = f"Flat{len(resources)}"
                resources[name] = normal
                paint.append(b"q %g 0 0 %g %g %g cm /%s Do Q" % (*placed, name.encode()))
            else:
                keep.append(a)
        if paint and num is not None:
            new += 1
            changed[new] = Stream({}, b"\n".join(paint))
            old = page.get("Contents")
            res = doc.dict_of(page.get("Resources"))
            own = {**doc.get(num), "Contents": [*(old if isinstance(old, list) else [old] if old else []), Ref(new)], "Annots": keep, "Resources": {**res, "XObject": {**doc.dict_of(res.get("XObject")), **resources}}}
            changed[num] = own
    root = {k: v for k, v in doc.catalog.items() if k != "AcroForm"}
    return write_incremental(doc.data, {**changed, doc.trailer["Root"].num: root}, doc)


# --- authoring -------------------------------------------------------------------------------------------------------


def author(text: str, title: str = "", lines_per_page: int = 50, kind: str = "classic", fields: dict[str, str] | None = None, outline_titles: bool = False, files: dict[str, bytes] | None = None) -> bytes:
    """A document of text lines in Helvetica, with what else is asked for: form fields, an outline entry for each page, attachments."""
    lines = text.split("\n") or [""]
    parts = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)]
    objects: dict[int, object] = {3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}
    n, kids = 4, []
    objects[n] = {"Title": to_text_string(title), "Producer": b"quire"}
    info = n
    for part in parts:
        ops = [b"BT /F1 11 Tf 14 TL 50 790 Td"] + [b"(" + winansi_encode(x).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*" for x in part] + [b"ET"]
        objects[n + 1] = Stream({"Filter": Name("FlateDecode")}, codecs.flate_encode(b"\n".join(ops)))
        objects[n + 2] = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(n + 1), "Resources": {"Font": {"F1": Ref(3)}}}
        kids.append(Ref(n + 2))
        n += 2
    catalog: dict = {"Type": Name("Catalog"), "Pages": Ref(2)}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 595, 842]}
    if fields:
        refs = []
        for i, (k, v) in enumerate(fields.items()):
            n += 1
            refs.append(Ref(n))
            objects[n] = {"FT": Name("Tx"), "T": to_text_string(k), "V": to_text_string(v), "Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [50, 20 + 20 * i, 250, 36 + 20 * i], "P": kids[0]}
        objects[kids[0].num]["Annots"] = refs
        catalog["AcroForm"] = {"Fields": refs}
    if outline_titles:
        first = n + 2
        for i, kid in enumerate(kids):
            objects[first + i] = {"Title": to_text_string(f"Page {i + 1}"), "Parent": Ref(n + 1), "Dest": [kid, Name("Fit")]} | ({"Next": Ref(first + i + 1)} if i + 1 < len(kids) else {})
        objects[n + 1] = {"Type": Name("Outlines"), "First": Ref(first), "Last": Ref(first + len(kids) - 1), "Count": len(kids)}
        catalog["Outlines"] = Ref(n + 1)
        n = first + len(kids) - 1
    if files:
        entries: list = []
        for k, v in sorted(files.items()):
            objects[n + 1] = Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode")}, codecs.flate_encode(v))
            objects[n + 2] = {"Type": Name("Filespec"), "F": to_text_string(k), "UF": to_text_string(k), "EF": {"F": Ref(n + 1)}}
            entries += [to_text_string(k), Ref(n + 2)]
            n += 2
        catalog["Names"] = {"EmbeddedFiles": {"Names": entries}}
    objects[1] = catalog
    return write(objects, 1, info, kind=kind)
