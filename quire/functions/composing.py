"""Layout: text widths, greedy wrapping, column widths, pagination, and the ordered conformance rules."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths (thousandths) of Helvetica's printable ASCII, from the space on.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)


def char_width(c: str, base_font: str = "Helvetica") -> int | None:
    """Thousandths; a glyph that is not listed counts as the space. Courier is 600 throughout; other fonts are not measured."""
    if base_font.startswith("Courier"):
        return 600
    if base_font != "Helvetica":
        return None
    i = ord(c) - 32
    return HELVETICA[i] if 0 <= i < len(HELVETICA) else HELVETICA[0]


class _Widths(dict):
    def __missing__(self, c: str) -> int:
        return HELVETICA[0]


_width = _Widths({chr(32 + i): w for i, w in enumerate(HELVETICA)}).__getitem__
#: Words up to this length are measured once.
_SHORT = 32


@lru_cache(1 << 16)
def _word_units(word: str) -> int:
    return sum(map(_width, word))


def units(text: str, base_font: str = "Helvetica") -> int | None:
    """The sum of the text's advances, in thousandths of its size."""
    if base_font != "Helvetica":
        each = char_width(" ", base_font)
        return None if each is None else each * len(text)
    return _word_units(text) if len(text) <= _SHORT else sum(map(_width, text))


def text_width(text: str, size: float, base_font: str = "Helvetica") -> float | None:
    n = units(text, base_font)
    return None if n is None else n * size / 1000


def measured_lines(text: str, size: float, width: float, base_font: str = "Helvetica") -> list[tuple[str, int | None]]:
    """The lines of wrap() with their units. Units are whole numbers, so a line's are those of its words and blanks: each word is measured once."""
    out, blank = [], units(" ", base_font)
    known = base_font == "Helvetica"
    for paragraph in text.split("\n"):
        if blank is None:
            out.append((paragraph, None))
            continue
        line, so_far = [], 0
        for word in paragraph.split():
            own = _word_units(word) if known and len(word) <= _SHORT else units(word, base_font)
            longer = so_far + blank + own
            if not line:
                line, so_far = [word], own
            elif longer * size / 1000 > width:
                out.append((" ".join(line), so_far))
                line, so_far = [word], own
            else:
                line.append(word)
                so_far = longer
        out.append((" ".join(line), so_far))
    return out


def wrap(text: str, size: float, width: float, base_font: str = "Helvetica") -> list[str]:
    """Greedy lines of whole words; each new line is a paragraph; an over-long word stays whole; a font without widths is not wrapped."""
    return [line for line, _ in measured_lines(text, size, width, base_font)]


def wrapped(text: Column, chars: int) -> Column:
    """The same greedy rule for a font of fixed width, as an expression: an array of lines of at most `chars` characters."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(s, word):
        longer = F.when(s["line"] == "", word).otherwise(F.concat(s["line"], F.lit(" "), word))
        over = (s["line"] != "") & (F.length(longer) > chars)
        return F.struct(F.when(over, F.array_append(s["done"], s["line"])).otherwise(s["done"]).alias("done"), F.when(over, word).otherwise(longer).alias("line"))

    lines = lambda p: F.aggregate(F.filter(F.split(p, r"\s+"), lambda w: w != ""), state, step, lambda s: F.array_append(s["done"], s["line"]))
    return F.flatten(F.transform(F.split(text, "\n"), lines))


def row_widths(columns: list[tuple[str, float]], natural: list[float], available: float) -> list[float]:
    """Widths of (fixed, w), (auto, _) and (relative, share) columns; relative ones share what is left; overflow is an error."""
    out = [w if kind == "fixed" else natural[i] if kind == "auto" else 0.0 for i, (kind, w) in enumerate(columns)]
    left, shares = available - sum(out), sum(w for kind, w in columns if kind == "relative")
    if left < -1e-9:
        raise ValueError("InvalidGeometry")
    return [left * w / shares if kind == "relative" and shares else out[i] for i, (kind, w) in enumerate(columns)]


def paginate(heights: list[float], page: float, header: float = 0.0) -> list[list[int]]:
    """Rows by page: a row that crosses the end starts a page, unless the page is empty; the header repeats."""
    out: list[list[int]] = [[]]
    y = header
    for i, h in enumerate(heights):
        if out[-1] and y + h > page:
            out.append([])
            y = header
        out[-1].append(i)
        y += h
    return out


def pdfa_violation(facts: dict, part: int, level: str) -> str | None:
    """The first broken rule, in order; None if the document may claim the flavour."""
    rules = (
        ("UnembeddedFont", facts.get("unembedded_fonts", 0) > 0),
        ("AttachmentRequiresPdfA3", facts.get("attachments", 0) > 0 and part != 3 and not (part == 4 and level in ("e", "f"))),
        ("LevelARequiresTagging", level == "a" and not facts.get("tagged", False)),
        ("TransparencyRequiresPdfA2", facts.get("transparency", False) and part == 1),
    )
    return next((name for name, broken in rules if broken), None)


#: Flavours of PDF/A: part, conformance letter, version that the header gets.
PDFA = {
    "1a": (1, "A", (1, 4)), "1b": (1, "B", (1, 4)), "2a": (2, "A", (1, 7)), "2b": (2, "B", (1, 7)), "2u": (2, "U", (1, 7)), "3a": (3, "A", (1, 7)), "3b": (3, "B", (1, 7)), "3u": (3, "U", (1, 7)),
    "4": (4, "", (2, 0)), "4e": (4, "E", (2, 0)), "4f": (4, "F", (2, 0)),
}
#: Standard structure types of PDF 1.7, and those of the PDF 2.0 namespace.
TYPES_17 = """Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot
Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form""".split()
TYPES_20 = """Document DocumentFragment Part Sect Div Aside NonStruct P H Title FENote Sub Lbl Span Em Strong Link Annot Form Ruby RB RT RP Warichu WT WP L LI LBody
Table TR TH TD THead TBody TFoot Caption Figure Formula Artifact""".split()
NAMESPACE_20, NAMESPACE_MATH = "http://iso.org/pdf2/ssn", "http://www.w3.org/1998/Math/MathML"


def allows_attachments(flavour: str) -> bool:
    return flavour in PDFA and (PDFA[flavour][0] == 3 or flavour in ("4e", "4f"))


def known_structure_type(tag: str, namespace: str | None = None, maps: dict[tuple[str, str], tuple[str, str | None]] | None = None) -> bool:
    """Whether a type is standard in its namespace, or a map takes it in one step to one that is. maps: (namespace, type) to (type, namespace)."""
    standard = {None: lambda t: t in TYPES_17, NAMESPACE_20: lambda t: t in TYPES_20 or t[:1] == "H" and t[1:].isdigit() and not t.startswith("H0"), NAMESPACE_MATH: lambda t: True}
    if namespace in standard:
        return standard[namespace](tag)
    to, there = (maps or {}).get((namespace, tag), (None, ""))
    return to is not None and there in standard and standard[there](to)


def pdfua2_violation(facts: dict) -> str | None:
    """The rules of the second part: those of the first, without untyped notes and headings, and with files, links and types in order."""
    rules = (
        ("DeprecatedNote", "Note" in facts.get("types", ())), ("UnnumberedHeading", "H" in facts.get("types", ())), ("AttachmentWithoutDescription", facts.get("undescribed_files", 0) > 0),
        ("LinkWithoutDestination", facts.get("loose_links", 0) > 0), ("UnknownStructureType", any(not known_structure_type(*x) for x in facts.get("typed", ()))),
    )
    first = pdfua_violation(facts)
    return first or next((name for name, broken in rules if broken), None)


def pdfua_violation(facts: dict) -> str | None:
    rules = (
        ("NotTagged", not facts.get("tagged", False)), ("UnembeddedFont", facts.get("unembedded_fonts", 0) > 0), ("FigureWithoutAlt", facts.get("figures_without_alt", 0) > 0),
        ("NotdefGlyph", facts.get("notdef", False)), ("MissingTitle", not facts.get("title")), ("MissingLanguage", not facts.get("language")),
    )
    return next((name for name, broken in rules if broken), None)
