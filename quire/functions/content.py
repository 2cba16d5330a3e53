"""Content streams: operators, text in emission order, positioned fragments, font decoding."""

from __future__ import annotations

import codecs as charmaps
import re

from quire.functions import codecs
from quire.functions.objects import Document, Lexer, Name, Operator, Stream, SyntaxFault, decoded, page_content

MAX_OPERANDS = 65_536
MAX_FORMS = 16
#: A TJ gap that reads as a space.
GAP = -100

_end_image = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")


_END = rb"(?![^\0\t\n\f\r ()<>\[\]{}/%])"
#: Operators, integers, reals, strings without escapes, and names without them, as the lexer reads them.
_plain = re.compile(
    rb"[\0\t\n\f\r ]*(?:([A-Za-z'\"*]+[0-9]?)" + _END + rb"|([+-]?[0-9]+)" + _END + rb"|([+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+))" + _END + rb"|\(([^()\\\r]*)\)|/([A-Za-z0-9_.+*-]+)" + _END + rb")"
)
_NO_OPERATOR = (b"true", b"false", b"null", b"BI")


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) in order; what can't be read is passed over byte by byte, with the operands before it."""
    lex, out, operands, at = Lexer(data), [], [], 0
    while True:
        # most tokens are plain ones: one match each; the lexer reads what is not
        last = None
        for m in iter(_plain.scanner(data, at).match, None):
            kind = m.lastindex
            word = m[kind]
            if kind == 1:
                if word in _NO_OPERATOR:
                    break
                out.append((word.decode("latin-1"), operands))
                operands = []
            elif len(operands) < MAX_OPERANDS:
                operands.append(int(word) if kind == 2 else float(word) if kind == 3 else word if kind == 4 else Name(word.decode("ascii")))
            last = m
        at = lex.at = last.end() if last else at
        lex.skip()
        if lex.at >= len(data):
            return out
        try:
            v = lex.value(refs=False)
        except SyntaxFault:
            lex.at += 1
            at = lex.at
            operands = []
            continue
        at = lex.at
        if not isinstance(v, Operator):
            if len(operands) < MAX_OPERANDS:
                operands.append(v)
            continue
        if v == b"BI":
            operands = _inline_image(lex)
            at = lex.at
        out.append((v.decode("latin-1"), operands))
        operands = []


def _inline_image(lex: Lexer) -> list:
    d: dict = {}
    while True:
        try:
            k = lex.value(refs=False)
            if isinstance(k, Operator):
                break
            d[str(k)] = lex.value(refs=False)
        except SyntaxFault:
            return [d, b""]
    start = lex.at + 1
    m = _end_image.search(lex.data, lex.at)
    lex.at = m.end() if m else len(lex.data)
    return [d, lex.data[start : m.start() if m else len(lex.data)]]


def _latin(font, data: bytes) -> str:
    return data.decode("latin-1")


def text_of(ops: list[tuple[str, list]], decode=_latin, form=lambda name: None) -> str:
    """Text in emission order: line moves break lines, TJ gaps of -100 or less are spaces."""
    out: list[str] = []
    font = None

    def end_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def show(v) -> None:
        if isinstance(v, bytes) and (t := decode(font, v)):
            out.append(t)

    for op, args in ops:
        if op == "Tf":
            font = str(args[0]) if args and isinstance(args[0], Name) else font
        elif op in ("Td", "TD", "T*", "Tm", "ET"):
            end_line()
        elif op == "Tj":
            show(args[0] if args else None)
        elif op in ("'", '"'):
            end_line()
            show(args[-1] if args else None)
        elif op == "TJ":
            for v in args[0] if args and isinstance(args[0], list) else []:
                if isinstance(v, (int, float)) and not isinstance(v, bool) and v <= GAP:
                    out.append(" ")
                show(v)
        elif op == "Do" and args and isinstance(args[0], Name) and (t := form(str(args[0]))):
            end_line()
            out.append(t)
            end_line()
    return "".join(out).strip()


def _times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def fragments(ops: list[tuple[str, list]], decode=_latin) -> list[tuple[str, float, float]]:
    """(text, x, y) where each shown string starts. q and Q save the matrix alone; font and leading stay."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, stack, tm, line, leading, font, out = unit, [], unit, unit, 0.0, None, []
    number = lambda a: [float(x) for x in a if isinstance(x, (int, float)) and not isinstance(x, bool)]

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        line = _times((1, 0, 0, 1, x, y), line)
        tm = line

    def show(text: str) -> None:
        if text:
            x = _times(tm, ctm)
            out.append((text, x[4], x[5]))

    for op, args in ops:
        n = number(args)
        if op == "q":
            stack.append(ctm)
        elif op == "Q":
            ctm = stack.pop() if stack else ctm
        elif op == "cm" and len(n) >= 6:
            ctm = _times(tuple(n[:6]), ctm)
        elif op == "BT":
            tm = line = unit
        elif op == "Tm" and len(n) >= 6:
            tm = line = tuple(n[:6])
        elif op in ("Td", "TD") and len(n) >= 2:
            leading = -n[1] if op == "TD" else leading
            move(n[0], n[1])
        elif op == "TL" and n:
            leading = n[0]
        elif op == "T*":
            move(0, -leading)
        elif op == "Tf":
            font = str(args[0]) if args and isinstance(args[0], Name) else font
        elif op in ("Tj", "'", '"'):
            if op != "Tj":
                move(0, -leading)
            if args and isinstance(args[-1], bytes):
                show(decode(font, args[-1]))
        elif op == "TJ" and args and isinstance(args[0], list):
            said = []
            for v in args[0]:
                if isinstance(v, bytes):
                    said.append(decode(font, v))
                elif isinstance(v, (int, float)) and v <= GAP:
                    said.append(" ")
            show("".join(said))
    return out


#: Windows-1252 from 0x80 on where it is no Latin-1 (None: undefined).
_WIN = "€\0‚ƒ„…†‡ˆ‰Š‹Œ\0Ž\0\0‘’“”•–—˜™š›œ\0žŸ"
WINANSI = {b: chr(b) for b in [*range(0x20, 0x7F), *range(0xA0, 0x100)]} | {0x80 + i: c for i, c in enumerate(_WIN) if c != "\0"}
_TO_WIN = {c: b for b, c in WINANSI.items()}
MACROMAN = {b: bytes([b]).decode("mac_roman") for b in range(0x20, 0x100) if b != 0x7F}
#: Glyph names that are no single character, the common ones.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "Euro": "€", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "adieresis": "ä", "odieresis": "ö",
    "udieresis": "ü", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ",
}


def _table_of(table: dict[int, str]) -> str:
    return "".join(table.get(b, "\ufffe") for b in range(256))


_WINANSI, _MACROMAN = _table_of(WINANSI), _table_of(MACROMAN)
_TO_WINANSI = charmaps.charmap_build(_WINANSI)


def winansi_encode(text: str) -> bytes:
    """What the encoding lacks, control characters too, becomes "?"."""
    return charmaps.charmap_encode(text.replace("\ufffe", "?"), "replace", _TO_WINANSI)[0]


def glyph_to_char(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isascii():
        return name
    m = re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name)
    code = int(m[1] or m[2], 16) if m else -1
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Unicode:
    """A ToUnicode map: codes of one width."""

    def __init__(self, cmap: bytes):
        self.width, self.map = 1, {}
        first = True
        for op, args in operations(cmap):
            strings = [a for a in args if isinstance(a, bytes)]
            if op == "endcodespacerange" and strings and first:
                self.width, first = max(1, len(strings[0])), False
            elif op == "endbfchar":
                for code, to in zip(args[::2], args[1::2], strict=False):
                    if isinstance(code, bytes) and isinstance(to, bytes):
                        self._put(int.from_bytes(code, "big"), len(code), to)
            elif op == "endbfrange":
                for lo, hi, to in zip(args[::3], args[1::3], args[2::3], strict=False):
                    if isinstance(lo, bytes) and isinstance(hi, bytes):
                        self._range(lo, hi, to)

    def _put(self, code: int, width: int, to: bytes) -> None:
        self.width = max(self.width, width)
        self.map[code] = to.decode("utf-16-be", "replace")

    def _range(self, lo: bytes, hi: bytes, to) -> None:
        a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
        if not 0 <= b - a < 65_536:
            return
        for i in range(b - a + 1):
            if isinstance(to, list):
                if i < len(to) and isinstance(to[i], bytes):
                    self._put(a + i, len(lo), to[i])
            elif isinstance(to, bytes) and to:
                last = int.from_bytes(to[-2:], "big") + i
                self._put(a + i, len(lo), to[:-2] + (last & 0xFFFF).to_bytes(2, "big"))

    def decode(self, data: bytes) -> str:
        w = self.width
        return "".join(self.map.get(int.from_bytes(data[i : i + w], "big"), "") for i in range(0, len(data) - w + 1, w))


def encoding_of(font: dict, doc: Document) -> dict[int, str]:
    e = doc.resolve(font.get("Encoding"))
    base = e.get("BaseEncoding") if isinstance(e, dict) else e
    table = dict(MACROMAN if base == "MacRomanEncoding" else WINANSI)
    code = 0
    for d in e.get("Differences", []) if isinstance(e, dict) else []:
        if isinstance(d, Name):
            c = glyph_to_char(d)
            table.pop(code, None)
            if c:
                table[code] = c
            code += 1
        elif isinstance(d, int):
            code = d
    return table


def decoders(resources: dict, doc: Document) -> dict:
    """A function bytes -> str for each font resource: ToUnicode, then composite fonts by their character map and program, then the encoding."""
    out = {}
    for name, ref in doc.dict_of(resources.get("Font")).items():
        font = doc.dict_of(ref)
        s = doc.resolve(font.get("ToUnicode"))
        cmap = None
        if isinstance(s, Stream):
            try:
                cmap = Unicode(decoded(s))
            except codecs.CodecError:
                cmap = None
        if cmap and cmap.map:
            out[name] = cmap.decode
        elif font.get("Subtype") == "Type0":
            out[name] = _composite(font, doc)
        else:
            out[name] = _simple(font, doc)
    return out


def _simple(font: dict, doc: Document):
    """Bytes by the font's encoding; those that it lacks have no text."""
    e = doc.resolve(font.get("Encoding"))
    if isinstance(e, dict):
        table = encoding_of(font, doc)
        if "\ufffe" in table.values():  # the mark of what is missing, below
            return lambda data: "".join(table.get(b, "") for b in data)
        known = _table_of(table)
    else:
        known = _MACROMAN if e == "MacRomanEncoding" else _WINANSI
    return lambda data: charmaps.charmap_decode(data, "ignore", known)[0]


def _composite(font: dict, doc: Document):
    """Codes to CIDs, to glyphs of the embedded program, to the characters that it maps to them; nothing for what can't be followed."""
    from quire.functions.cids import CharacterMap
    from quire.functions.fonts import glyph_to_unicode, text_of_glyphs

    nothing = lambda data: ""
    below = doc.resolve(font.get("DescendantFonts"))
    own = doc.dict_of(below[0]) if isinstance(below, list) and below else {}
    descriptor = doc.dict_of(font.get("FontDescriptor") or own.get("FontDescriptor"))
    program = next((s for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(s := doc.resolve(descriptor.get(k)), Stream)), None)
    encoding = doc.resolve(font.get("Encoding"))
    try:
        whole = decoded(program) if program else b""
        chars = glyph_to_unicode(whole) if program else None
        cmap = CharacterMap(decoded(encoding)) if isinstance(encoding, Stream) else CharacterMap.predefined(str(encoding)) if isinstance(encoding, Name) else None
        places = doc.resolve(own.get("CIDToGIDMap") or font.get("CIDToGIDMap"))
        table = decoded(places) if isinstance(places, Stream) else None
    except codecs.CodecError:
        return nothing
    if not chars or cmap is None:
        return nothing
    if table is None and cmap.identity and cmap.spaces == [(b"\0\0", b"\xff\xff")]:
        return lambda data: text_of_glyphs(whole, data)
    glyph = lambda cid: cid if table is None else int.from_bytes(table[2 * cid : 2 * cid + 2], "big")
    return lambda data: "".join(chars.get(glyph(cid), "") for cid in cmap.cids(data))


def _with(fonts: dict):
    return lambda font, data: fonts[font](data) if font in fonts else data.decode("latin-1")


def content_text(doc: Document, data: bytes, resources: dict, depth: int = 0) -> str:
    """Text of a content stream with its form XObjects, which inherit resources that they lack."""
    if depth > MAX_FORMS:
        return ""
    xobjects = doc.dict_of(resources.get("XObject"))

    def form(name: str):
        s = doc.resolve(xobjects.get(name))
        if not isinstance(s, Stream) or s.dict.get("Subtype") != "Form":
            return None
        own = doc.dict_of(s.dict.get("Resources")) or resources
        return content_text(doc, decoded(s), own, depth + 1)

    return text_of(operations(data), _with(decoders(resources, doc)), form)


def page_text(doc: Document, page: dict) -> str:
    """Content text, then the annotations' contents, a line each."""
    text = content_text(doc, page_content(doc, page), doc.dict_of(page.get("Resources")))
    notes = [n for a in doc.resolve(page.get("Annots")) or [] if (n := text_string(doc.resolve(doc.dict_of(a).get("Contents"))))]
    return "\n".join([t for t in [text, *notes] if t])


def page_fragments(doc: Document, page: dict) -> list[tuple[str, float, float]]:
    return fragments(operations(page_content(doc, page)), _with(decoders(doc.dict_of(page.get("Resources")), doc)))


def layout(found: list[tuple[str, float, float]]) -> str:
    """Reading order: rounded y from the top (half away from zero), then x, then emission."""
    import math

    up = lambda y: math.floor(abs(y) + 0.5) * (1 if y >= 0 else -1)
    lines: dict[int, list] = {}
    for n, (t, x, y) in enumerate(found):
        lines.setdefault(up(y), []).append((x, n, t))
    return "\n".join(" ".join(t for _, _, t in sorted(lines[y])) for y in sorted(lines, reverse=True))


def text_string(raw) -> str:
    """UTF-16BE or UTF-8 by their marks, else Latin-1; language escapes go."""
    if not isinstance(raw, bytes):
        return ""
    if raw.startswith(b"\xfe\xff"):
        body = raw[2:] + b"\0" * (len(raw) % 2)
        text = body.decode("utf-16-be", "replace")
    elif raw.startswith(b"\xef\xbb\xbf"):
        text = raw[3:].decode("utf-8", "replace")
    else:
        text = raw.decode("latin-1")
    return re.sub("\x1b[^\x1b]*\x1b", "", text).replace("\x1b", "")


def to_text_string(text: str) -> bytes:
    return text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")
