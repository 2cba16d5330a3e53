"""Pages from blocks: headings, paragraphs, lists and tables are measured, broken into lines and pages, painted, and tagged.

Layout is a pure function of the blocks: laid() gives the lines with their places, and both the page count and the file come from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.functions import codecs
from quire.functions.composing import measured_lines, row_widths, text_width, wrap
from quire.functions.content import to_text_string, winansi_encode
from quire.functions.metadata import least_version
from quire.functions.objects import Document, Name, Ref, Stream, escape_literal, open_document, pages, write


@dataclass(frozen=True)
class Style:
    size: float = 11.0
    leading: float = 14.0
    align: str = "left"  # left, center, right or justify
    font: str = "Helvetica"


@dataclass(frozen=True)
class Paper:
    width: float = 595.0
    height: float = 842.0
    margin: float = 50.0

    @property
    def inner(self) -> tuple[float, float]:
        return self.width - 2 * self.margin, self.height - 2 * self.margin


@dataclass(frozen=True)
class Block:
    """kind: text, heading, list (numbered or not) or table (rows of cells; the first `headers` rows repeat on each page)."""

    kind: str
    content: object = ""
    level: int = 1
    numbered: bool = False
    columns: tuple = ()
    headers: int = 0
    padding: float = 2.0
    indent: float = 18.0
    style: Style = Style()


@dataclass
class Line:
    """A line of text: its place, extra space between words, and the element whose content it is (an index, or None for artifacts)."""

    x: float
    y: float
    text: str
    spread: float
    style: Style
    element: int | None


@dataclass
class Element:
    tag: str
    parent: int | None
    lines: list[tuple[int, int]] = field(default_factory=list)  # page, number of marked content


def line_place(style: Style, text: str, width: float, last: bool, wide: int | None = None) -> tuple[float, float]:
    """Shift from the left and extra space at each blank; the last line of a paragraph is not spread. wide: the text's units, if known."""
    free = width - ((text_width(text, style.size, style.font) or 0.0) if wide is None else wide * style.size / 1000)
    if style.align == "justify":
        blanks = text.count(" ")
        return 0.0, free / blanks if blanks and not last and free > 0 else 0.0
    return (free / 2 if style.align == "center" else free if style.align == "right" else 0.0), 0.0


def heading_tag(level: int) -> str:
    return f"H{min(6, max(1, level))}"


class _Sheet:
    """Lines so far by page, and how far down the page is filled."""

    def __init__(self, paper: Paper):
        self.paper, self.pages, self.down = paper, [[]], 0.0
        self.elements: list[Element] = []

    def element(self, tag: str, parent: int | None = None) -> int:
        self.elements.append(Element(tag, parent))
        return len(self.elements) - 1

    def room(self, height: float) -> bool:
        return self.down + height <= self.paper.inner[1] + 1e-9

    def turn(self) -> None:
        self.pages.append([])
        self.down = 0.0

    def paragraph(self, style: Style, text: str, element: int | None, shift: float = 0.0) -> None:
        width = self.paper.inner[0] - shift
        for part in text.split("\n"):
            found = measured_lines(part, style.size, width, style.font)
            for n, (t, wide) in enumerate(found):
                if not self.room(style.leading) and self.down:
                    self.turn()
                x, spread = line_place(style, t, width, n == len(found) - 1, wide)
                self.put(style, x + shift, t, spread, element)
                self.down += style.leading

    def put(self, style: Style, x: float, text: str, spread: float, element: int | None, below: float = 0.0) -> None:
        if text:
            p = self.paper
            self.pages[-1].append(Line(p.margin + x, p.height - p.margin - self.down - below - style.size, text, spread, style, element))


def row_lines(cells: list[str], widths: list[float], block: Block) -> tuple[list[list[str]], float]:
    """Each cell's lines, and the row's height: that of the cell with most lines, and the padding above and below."""
    lines = [wrap(c, block.style.size, w - 2 * block.padding, block.style.font) for c, w in zip(cells, widths, strict=True)]
    return lines, max(map(len, lines)) * block.style.leading + 2 * block.padding


def column_widths(block: Block, rows: list[list[str]], available: float) -> list[float]:
    """Fixed, relative and automatic columns; an automatic one is as wide as its widest cell, header included."""
    columns = list(block.columns) or [("relative", 1.0)] * len(rows[0])
    widest = [max(text_width(r[i], block.style.size, block.style.font) or 0.0 for r in rows) + 2 * block.padding for i in range(len(columns))]
    return row_widths(columns, widest, available)


def _table(sheet: _Sheet, block: Block) -> None:
    rows = [[str(c) for c in r] for r in block.content]
    if not rows:
        return
    widths = column_widths(block, rows, sheet.paper.inner[0])
    laid_rows = [row_lines(r, widths, block) for r in rows]
    table = sheet.element("Table")

    def paint(n: int, tagged: bool = True) -> None:
        row, x = sheet.element("TR", table) if tagged else None, 0.0
        for lines, w in zip(laid_rows[n][0], widths, strict=True):
            cell = sheet.element("TH" if n < block.headers else "TD", row) if tagged else None
            for k, t in enumerate(lines):
                shift, spread = line_place(block.style, t, w - 2 * block.padding, True)
                sheet.put(block.style, x + block.padding + shift, t, spread, cell, block.padding + k * block.style.leading)
            x += w
        sheet.down += laid_rows[n][1]

    for n in range(len(rows)):
        if sheet.down and not sheet.room(laid_rows[n][1]):
            sheet.turn()
            for h in range(block.headers if n >= block.headers else 0):
                paint(h, tagged=False)  # repeated headers are artifacts
        paint(n)


def laid(blocks: list[Block], paper: Paper = Paper()) -> tuple[list[list[Line]], list[Element]]:
    """Lines of each page, and the elements in reading order."""
    sheet = _Sheet(paper)
    for b in blocks:
        if b.kind == "heading":
            sheet.paragraph(b.style, str(b.content), sheet.element(heading_tag(b.level)))
        elif b.kind == "list":
            whole = sheet.element("L")
            for n, item in enumerate(b.content):
                li = sheet.element("LI", whole)
                label, body = sheet.element("Lbl", li), sheet.element("LBody", li)
                if not sheet.room(b.style.leading) and sheet.down:
                    sheet.turn()
                sheet.put(b.style, 0.0, f"{n + 1}." if b.numbered else "•", 0.0, label)
                sheet.paragraph(b.style, str(item), body, b.indent)
        elif b.kind == "table":
            _table(sheet, b)
        else:
            sheet.paragraph(b.style, str(b.content), sheet.element("P"))
    return sheet.pages, sheet.elements


def pages_needed(blocks: list[Block], paper: Paper = Paper()) -> int:
    return len(laid(blocks, paper)[0])


def painted(line: Line, font: str) -> bytes:
    said = escape_literal(winansi_encode(line.text))
    return b"BT /%s %g Tf %g Tw 1 0 0 1 %.4f %.4f Tm (%s) Tj ET" % (font.encode(), line.style.size, line.spread, line.x, line.y, said)


def flowed(blocks: list[Block], paper: Paper = Paper(), title: str = "", language: str = "", header: str = "", footer: str = "", target: tuple[int, int] | None = None) -> bytes:
    """The file; with a language it is tagged. {page} and {pages} in header and footer are numbers. A target version that the
    constructs go beyond is an error."""
    return file_of(*laid(blocks, paper), paper, title, language, header, footer, target)


def file_of(sheets: list[list[Line]], elements: list[Element], paper: Paper = Paper(), title: str = "", language: str = "", header: str = "", footer: str = "", target: tuple[int, int] | None = None) -> bytes:
    """The file of what laid() gave, as flowed() writes it."""
    fonts: dict[str, int] = {}
    objects: dict[int, object] = {1: None, 2: None}

    def add(v) -> Ref:
        objects[len(objects) + 1] = v
        return Ref(len(objects))

    def font(name: str) -> str:
        if name not in fonts:
            fonts[name] = add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name), "Encoding": Name("WinAnsiEncoding")}).num
        return f"F{list(fonts).index(name)}"

    kids, running = [], Style(9.0, 11.0, "center")
    marked: list[list[int]] = []
    for p, lines in enumerate(sheets):
        ops, own = [], []
        for text, y in ((header, paper.height - paper.margin / 2), (footer, paper.margin / 2)):
            if text:
                text = text.replace("{pages}", str(len(sheets))).replace("{page}", str(p + 1))
                x, _ = line_place(running, text, paper.inner[0], True)
                ops.append(b"/Artifact BMC " + painted(Line(paper.margin + x, y, text, 0.0, running, None), font(running.font)) + b" EMC")
        for x in lines:
            body = painted(x, font(x.style.font))
            if language:
                if x.element is None:
                    body = b"/Artifact BMC " + body + b" EMC"
                else:
                    elements[x.element].lines.append((p, len(own)))
                    body = b"/%s <</MCID %d>> BDC " % (elements[x.element].tag.encode(), len(own)) + body + b" EMC"
                    own.append(x.element)
            ops.append(body)
        marked.append(own)
        content = add(Stream({"Filter": Name("FlateDecode")}, codecs.flate_encode(b"\n".join(ops))))
        kids.append(add({"Type": Name("Page"), "Parent": Ref(2), "Contents": content, **({"StructParents": p} if language else {})}))
    named = {f"F{i}": Ref(n) for i, n in enumerate(fonts.values())}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, paper.width, paper.height], "Resources": {"Font": named}}
    catalog: dict = {"Type": Name("Catalog"), "Pages": Ref(2)}
    if language:
        catalog |= {"Lang": to_text_string(language), "MarkInfo": {"Marked": True}, "StructTreeRoot": _tree(elements, marked, kids, objects, add), "ViewerPreferences": {"DisplayDocTitle": True}}
    objects[1] = catalog
    info = add({"Title": to_text_string(title), "Producer": b"quire"}) if title else None
    data = write(objects, 1, info.num if info else None, target or (1, 7))
    if target and least_version(open_document(data)) > target:
        raise ValueError("the constructs go beyond the version")
    return data


def _tree(elements: list[Element], marked: list[list[int]], kids: list[Ref], objects: dict[int, object], add) -> Ref:
    root = add(None)
    whole = add(None)
    refs = [add(None) for _ in elements]
    out = {r.num: {"Type": Name("StructElem"), "S": Name(e.tag), "P": whole if e.parent is None else refs[e.parent], "K": []} for r, e in zip(refs, elements, strict=True)}
    for r, e in zip(refs, elements, strict=True):
        out[r.num]["K"] += [{"Type": Name("MCR"), "Pg": kids[p], "MCID": n} for p, n in e.lines]
        if e.parent is not None:
            out[refs[e.parent].num]["K"].append(r)
    top = [r for r, e in zip(refs, elements, strict=True) if e.parent is None]
    places = add({"Nums": [x for p, own in enumerate(marked) for x in (p, [refs[n] for n in own])]})
    objects.update(out | {whole.num: {"Type": Name("StructElem"), "S": Name("Document"), "P": root, "K": top}, root.num: {"Type": Name("StructTreeRoot"), "K": whole, "ParentTree": places}})
    return root


# --- reading ----------------------------------------------------------------------------------------------------------


def elements_of(doc: Document) -> list[dict]:
    """The structure tree in order: tag, depth, pages of its own content, alternative text."""
    index = {num: i for i, (num, _) in enumerate(pages(doc)) if num is not None}
    out, seen = [], set()

    def walk(ref, depth: int) -> None:
        if depth > 64 or len(out) >= 65_536 or isinstance(ref, Ref) and ref.num in seen:
            return
        seen.add(ref.num if isinstance(ref, Ref) else None)
        d = doc.dict_of(ref)
        kids = doc.resolve(d.get("K"))
        kids = kids if isinstance(kids, list) else [] if kids is None else [d["K"]]
        if "S" in d:
            at = [index[x["Pg"].num] for k in kids if isinstance(x := doc.resolve(k), dict) and isinstance(x.get("Pg"), Ref) and x["Pg"].num in index and "MCID" in x]
            out.append({"seq": len(out), "tag": str(d["S"]), "depth": depth, "first_page": min(at, default=None), "n_lines": len(at), "described": "Alt" in d or "ActualText" in d})
        for k in kids:
            if "S" in doc.dict_of(k):
                walk(k, depth + 1)

    walk(doc.catalog.get("StructTreeRoot"), 0)
    return out


def conformance_facts(doc: Document) -> dict:
    """What the conformance rules look at, read from the file."""
    embedded = lambda f: any(k in doc.dict_of(f.get("FontDescriptor")) for k in ("FontFile", "FontFile2", "FontFile3"))
    loose = sum(1 for _, v in doc.live() if isinstance(v, dict) and v.get("Type") == "Font" and v.get("Subtype") in ("Type1", "TrueType", "MMType1") and not embedded(v))
    found = elements_of(doc)
    title, language = doc.resolve(doc.dict_of(doc.trailer.get("Info")).get("Title")), doc.resolve(doc.catalog.get("Lang"))
    files = doc.dict_of(doc.dict_of(doc.catalog.get("Names")).get("EmbeddedFiles"))
    return {
        "tagged": bool(doc.dict_of(doc.catalog.get("MarkInfo")).get("Marked")) and "StructTreeRoot" in doc.catalog, "unembedded_fonts": loose,
        "figures_without_alt": sum(x["tag"] == "Figure" and not x["described"] for x in found), "title": title or None, "language": language or None, "attachments": len(doc.resolve(files.get("Names")) or []) // 2,
    }
