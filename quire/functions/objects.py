"""Document objects: syntax, reading (strict, then by recovery) and writing.

Values: None, bool, int, float, bytes (strings), Name, Ref, list, dict (keys str) and Stream. Integers and reals are never mixed up;
references never resolve themselves; a stream keeps its encoded bytes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from quire.functions import codecs

MAX_NESTING = 512
MAX_OBJECTS = 1 << 21
MAX_MEMBERS = 1 << 20
MAX_SECTIONS = 8192
MAX_HOPS = 64
MAX_TREE = 1024


@dataclass(frozen=True)
class Limits:
    """What a file may ask for: nesting of values, members of an object stream, objects, bytes and filters of a stream."""

    nesting: int = MAX_NESTING
    members: int = MAX_MEMBERS
    objects: int = MAX_OBJECTS
    decoded: int = codecs.MAX_OUTPUT
    filters: int = codecs.MAX_FILTERS


WHITE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes


class SyntaxFault(ValueError):
    pass


_token = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_blank = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_int = re.compile(rb"[+-]?\d+$")
_real = re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)$")
_ref = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_END = rb"(?![^\0\t\n\f\r ()<>\[\]{}/%])"
#: Plain names, references and numbers without signs: most values of dictionaries and arrays.
_plain_name, _plain_ref, _plain_int = rb"/([A-Za-z0-9_.+-]+)" + _END, rb"([0-9]+)[\0\t\n\f\r ]+([0-9]+)[\0\t\n\f\r ]+R" + _END, rb"([0-9]+)" + _END
_plain = {refs: re.compile(rb"[\0\t\n\f\r ]*(?:" + b"|".join([_plain_name, _plain_ref if refs else rb"((?!))((?!))", _plain_int]) + rb")") for refs in (True, False)}
_integers = re.compile(rb"\[([0-9\t\n\f\r ]*)\]")
#: Bytes of a literal string that stand for themselves.
_ordinary = re.compile(rb"[^()\\\r]*")
_octal = re.compile(rb"[0-7]{1,3}")
_endstream = re.compile(rb"[\0\t\n\f\r ]*endstream")
_entry = re.compile(rb"[\0\t\n\f\r ]*(\d{10}) (\d{5}) ([nf])(?=[\0\t\n\f\r ])")
_escaped_byte = re.compile(rb"#([0-9A-Fa-f]{2})")
_KEYWORDS = {b"true": True, b"false": False, b"null": None}
#: The escapes of literal strings.
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12, 0x28: 0x28, 0x29: 0x29, 0x5C: 0x5C}


class Operator(bytes):
    """A keyword that is no value."""


class Lexer:
    def __init__(self, data: bytes, at: int = 0, nesting: int = MAX_NESTING):
        self.nesting = nesting
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _blank.match(self.data, self.at).end()

    def value(self, depth: int = 0, refs: bool = True):
        """The next value or Operator; raises SyntaxFault at the end or on a stray delimiter."""
        if depth > self.nesting:
            raise SyntaxFault("nested too deeply")
        if m := _plain[refs].match(self.data, self.at):
            self.at, kind = m.end(), m.lastindex
            return Name(m[1].decode("ascii")) if kind == 1 else Ref(int(m[2]), int(m[3])) if kind == 3 else int(m[4])
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise SyntaxFault("end of data")
        c = data[at]
        if c == 0x2F:
            m = _token.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            if b"#" in raw:
                raw = _escaped_byte.sub(lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("utf-8", "surrogateescape"))
        if c == 0x28:
            return self._literal()
        if data.startswith(b"<<", at):
            return self._dictionary(depth, refs)
        if c == 0x3C:
            end = data.find(b">", at)
            if end < 0:
                raise SyntaxFault("open hexadecimal string")
            self.at = end + 1
            try:
                return codecs.hex_decode(data[at + 1 : end + 1])
            except codecs.CodecError:
                raise SyntaxFault("bad hexadecimal string") from None
        if c == 0x5B:
            if m := _integers.match(data, at):
                self.at = m.end()
                return list(map(int, m[1].split()))
            self.at = at + 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                v = self.value(depth + 1, refs)
                if not isinstance(v, Operator):
                    out.append(v)
        m = _token.match(data, at)
        if not m:
            raise SyntaxFault("stray delimiter")
        self.at, word = m.end(), m[0]
        if word in _KEYWORDS:
            return _KEYWORDS[word]
        if _int.match(word):
            n = int(word)
            if refs and n >= 0 and (r := _ref.match(data, self.at)):
                self.at = r.end()
                return Ref(n, int(r[1]))
            return n
        return float(word) if _real.match(word) else Operator(word)

    def _literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            m = _ordinary.match(data, at)
            if m.end() > at:
                out += m[0]
                at = m.end()
                if at >= len(data):
                    break
            c = data[at]
            if c == 0x5C:
                n = data[at + 1] if at + 1 < len(data) else 0x5C
                if n in _ESCAPES:
                    out.append(_ESCAPES[n])
                    at += 2
                elif 0x30 <= n <= 0x37:
                    m = _octal.match(data, at + 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif n in b"\r\n":
                    at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                else:
                    out.append(n)
                    at += 2
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at + 1
                    return bytes(out)
            if c == 0x0D:
                out.append(10)
                at += 2 if data[at + 1 : at + 2] == b"\n" else 1
                continue
            out.append(c)
            at += 1
        raise SyntaxFault("open string")

    def _dictionary(self, depth: int, refs: bool) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value(depth + 1, refs)
            if not isinstance(key, Name):
                raise SyntaxFault("dictionary key is no name")
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            out[str(key)] = self.value(depth + 1, refs)

    def indirect(self):
        """(number, generation, value) of `n g obj ... endobj`."""
        n, g, word = self.value(refs=False), self.value(refs=False), self.value(refs=False)
        if not (isinstance(n, int) and isinstance(g, int) and word == b"obj"):
            raise SyntaxFault("no object here")
        v = self.value()
        if isinstance(v, Operator):
            return n, g, None
        if isinstance(v, dict):
            self.skip()
            if self.data.startswith(b"stream", self.at):
                v = self._stream(v)
        return n, g, v

    def _stream(self, d: dict) -> Stream:
        start = self.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
        n = d.get("Length")
        if type(n) is int and n >= 0:
            end = start + n
            if _endstream.match(self.data, end):
                self.at = end
                return Stream(d, self.data[start:end])
        end = self.data.find(b"endstream", start)
        if end < 0:
            end = len(self.data)
        self.at = end
        stop = end - (2 if self.data[end - 2 : end] == b"\r\n" else 1 if self.data[end - 1 : end] in (b"\n", b"\r") else 0)
        return Stream(d, self.data[start : max(start, stop)])


_unprintable = re.compile(rb"[^ -~\n\r\t]")
_to_escape = re.compile(rb"[\\()\n\r]")


def escape_literal(data: bytes) -> bytes:
    if not _to_escape.search(data):
        return data
    out = data.replace(b"\\", b"\\\\")
    for a, b in ((b"(", b"\\("), (b")", b"\\)"), (b"\n", b"\\n"), (b"\r", b"\\r")):
        out = out.replace(a, b)
    return out


@lru_cache(4096)
def _name(n: str) -> bytes:
    return b"/" + b"".join(bytes([b]) if 0x21 <= b <= 0x7E and b not in DELIMITERS + b"#" else b"#%02X" % b for b in n.encode("utf-8", "surrogateescape"))


def serialise(v) -> bytes:
    """Canonical syntax; a stream's /Length is written anew."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, Name):
        return _name(v)
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode() if v != int(v) else b"%d.0" % v
    if isinstance(v, bytes):
        return b"(" + escape_literal(v) + b")" if not _unprintable.search(v) else b"<" + v.hex().upper().encode() + b">"
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialise, v)) + b"]"
    if isinstance(v, Stream):
        return serialise({**v.dict, "Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    return b"<<" + b" ".join(_name(k) + b" " + serialise(x) for k, x in v.items()) + b">>"


def filters_of(d: dict) -> tuple[list[str], list[dict | None]]:
    f, p = d.get("Filter", d.get("F") if not isinstance(d.get("F"), (bytes, dict)) else None), d.get("DecodeParms", d.get("DP"))
    if isinstance(f, Ref):
        raise codecs.CodecError("indirect /Filter")
    names = [str(x) for x in (f if isinstance(f, list) else [f] if f is not None else [])]
    params = p if isinstance(p, list) else [p]
    return names, [x if isinstance(x, dict) else None for x in params]


def decoded(s: Stream) -> bytes:
    names, params = filters_of(s.dict)
    return codecs.decode_chain(s.raw, names, params)


@dataclass
class Document:
    """Bytes, cross-reference map (number -> (kind, a, b)) and trailer. kinds: f free, n at offset, c in a container."""

    data: bytes
    xref: dict[int, tuple[str, int, int]]
    trailer: dict
    mode: str = "Strict"
    notes: list[str] = field(default_factory=list)
    cache: dict[int, object] = field(default_factory=dict)
    members: dict[int, list] = field(default_factory=dict)
    decrypt: object = None
    exempt: int | None = None
    limits: Limits = Limits()

    def data_of(self, s: Stream) -> bytes:
        """A stream's bytes through its filters, within the document's limits."""
        names, params = filters_of(s.dict)
        return codecs.decode_chain(s.raw, names, params, self.limits.decoded, self.limits.filters)

    def get(self, num: int):
        """The object of a number; null where it is missing, free or broken. Containers are decoded once."""
        if num in self.cache:
            return self.cache[num]
        kind, a, b = self.xref.get(num, ("f", 0, 0))
        v = None
        self.cache[num] = None
        try:
            if kind == "n":
                n, g, v = Lexer(self.data, a, self.limits.nesting).indirect()
                if n != num:
                    v = None
                elif self.decrypt and num != self.exempt:
                    v = self.decrypt(n, g, v)
            elif kind == "c":
                v = self.container(a)[b] if b < len(self.container(a)) else None
        except (SyntaxFault, codecs.CodecError):
            v = None
        self.cache[num] = v
        return v

    def container(self, num: int) -> list:
        if num not in self.members:
            self.members[num] = []
            s = self.get(num)
            if isinstance(s, Stream):
                body = self.data_of(s)
                n, first = s.dict.get("N", 0), s.dict.get("First", 0)
                heads = [int(x) for x in re.findall(rb"\d+", body[:first])[: 2 * min(n, self.limits.members)]]
                out = []
                for offset in heads[1::2]:
                    try:
                        v = Lexer(body, first + offset, self.limits.nesting).value()
                        out.append(None if isinstance(v, Operator) else v)
                    except SyntaxFault:
                        out.append(None)
                self.members[num] = out
        return self.members[num]

    def resolve(self, v):
        for _ in range(MAX_HOPS):
            if not isinstance(v, Ref):
                return v
            v = self.get(v.num)
        raise SyntaxFault("reference chain too long")

    def dict_of(self, v) -> dict:
        v = self.resolve(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    def live(self):
        """(number, value) of what is in use, without containers and cross-reference streams, by number."""
        for num in sorted(self.xref):
            if self.xref[num][0] != "f":
                v = self.get(num)
                if not (isinstance(v, Stream) and v.dict.get("Type") in ("ObjStm", "XRef")):
                    yield num, v

    @property
    def version(self) -> tuple[int, int] | None:
        m = re.search(rb"%PDF-(\d)\.(\d)", self.data[:1024])
        return (int(m[1]), int(m[2])) if m else None


def _classic(data: bytes, at: int, entries: dict, most: int) -> dict:
    lex = Lexer(data, at + 4)
    while True:
        v = lex.value(refs=False)
        if v == b"trailer":
            t = lex.value()
            if not isinstance(t, dict):
                raise SyntaxFault("trailer is no dictionary")
            return t
        n = lex.value(refs=False)
        if not (type(v) is int and type(n) is int and 0 <= n <= most):
            raise SyntaxFault("bad subsection")
        for i in range(v, v + n):
            if m := _entry.match(data, lex.at):
                lex.at = m.end()
                entries.setdefault(i, ("n", int(m[1]), int(m[2])) if m[3] == b"n" else ("f", 0, 0))
                continue
            offset, gen, kind = lex.value(refs=False), lex.value(refs=False), lex.value(refs=False)
            if kind not in (b"n", b"f") or type(offset) is not int:
                raise SyntaxFault("bad entry")
            entries.setdefault(i, ("n", offset, gen) if kind == b"n" else ("f", 0, 0))


def _xref_stream(data: bytes, at: int, entries: dict, most: int) -> dict:
    _, _, s = Lexer(data, at).indirect()
    if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
        raise SyntaxFault("no cross-reference stream")
    widths, body = s.dict.get("W"), decoded(s)
    if not (isinstance(widths, list) and len(widths) >= 3 and all(type(w) is int and 0 <= w <= 8 for w in widths)):
        raise SyntaxFault("bad /W")
    index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
    w0, w1, w2 = widths[:3]
    at = 0
    for first, n in zip(index[::2], index[1::2], strict=False):
        for i in range(first, first + min(n, most)):
            row = body[at : at + sum(widths)]
            if len(row) < sum(widths) or not row:
                return s.dict
            at += len(row)
            kind = int.from_bytes(row[:w0], "big") if w0 else 1
            a, b = int.from_bytes(row[w0 : w0 + w1], "big"), int.from_bytes(row[w0 + w1 : w0 + w1 + w2], "big")
            if kind < 3:
                entries.setdefault(i, (("f", 0, 0), ("n", a, b), ("c", a, b))[kind])
    return s.dict


def _strict(data: bytes, limits: Limits) -> tuple[dict, dict]:
    at = data.rfind(b"startxref")
    m = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)").match(data, at) if at >= 0 else None
    if not m:
        raise SyntaxFault("no startxref")
    entries: dict = {}
    trailer, todo, seen = None, [(int(m[1]), True)], set()
    while todo and len(seen) < MAX_SECTIONS:
        offset, whole = todo.pop(0)
        if offset in seen:
            continue
        seen.add(offset)
        blank = _blank.match(data, offset).end() if offset < len(data) else offset
        try:
            t = _classic(data, blank, entries, limits.objects) if whole and data.startswith(b"xref", blank) else _xref_stream(data, offset, entries, limits.objects)
        except (SyntaxFault, codecs.CodecError):
            if whole:
                raise
            continue  # a hybrid file reads without its stream, as far as it goes
        trailer = trailer or t
        # the section's own hybrid stream ranks before older sections
        if len(entries) > limits.objects:
            raise SyntaxFault("too many objects")
        todo = [(t[k], k == "Prev") for k in ("XRefStm", "Prev") if type(t.get(k)) is int and (whole or k == "XRefStm")] + todo
    return entries, trailer


_object = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")


def _recovered(data: bytes, limits: Limits) -> tuple[dict, dict]:
    """Scans for objects: the later definition wins; members of object streams fill gaps; the scan ends at the limit of objects."""
    entries: dict = {}
    for n, m in enumerate(_object.finditer(data)):
        if n >= limits.objects:
            break
        entries[int(m[1])] = ("n", m.start(), int(m[2]))
    if not entries:
        raise SyntaxFault("no object found")
    trailer: dict = {}
    for m in re.finditer(rb"trailer", data):
        try:
            t = Lexer(data, m.end()).value()
            trailer = t if isinstance(t, dict) else trailer
        except SyntaxFault:
            pass
    doc = Document(data, entries, trailer, limits=limits)
    root = None
    for num in list(entries):
        v = doc.get(num)
        d = v.dict if isinstance(v, Stream) else v
        if not isinstance(d, dict):
            continue
        if isinstance(v, Stream) and d.get("Type") == "ObjStm":
            try:
                heads = re.findall(rb"\d+", doc.data_of(v)[: d.get("First", 0)])[: 2 * min(d.get("N", 0), limits.members)]
            except codecs.CodecError:
                continue
            for i, member in enumerate(heads[::2]):
                entries.setdefault(int(member), ("c", num, i))
        if d.get("Type") == "XRef" and not trailer:
            trailer = d
    for num in list(entries):
        if doc.dict_of(Ref(num)).get("Type") == "Catalog":
            root = Ref(num)
    return entries, {**trailer, **({"Root": root} if root else {})}


def open_document(data: bytes, password: bytes = b"", limits: Limits = Limits()) -> Document:
    """Strict first; then recovery, also when the catalog can't be reached or the table names more objects than the limits allow."""
    try:
        doc = Document(data, *_strict(data, limits), limits=limits)
    except (SyntaxFault, codecs.CodecError, ValueError, TypeError) as e:
        doc = Document(data, *_recovered(data, limits), "Recovered", [str(e)[:80]], limits=limits)
    if "Encrypt" in doc.trailer:
        from quire.functions.security import unlock

        unlock(doc, password)
    if doc.mode == "Strict" and not doc.catalog.get("Pages"):
        doc = Document(data, *_recovered(data, limits), "Recovered", ["catalog out of reach"], limits=limits)
    return doc


def pages(doc: Document) -> list[tuple[int | None, dict]]:
    """(object number, page with inherited attributes) in document order; a node met twice is passed over."""
    out, seen = [], set()

    def walk(ref, inherited: dict, depth: int) -> None:
        if depth > MAX_TREE:
            raise SyntaxFault("page tree too deep")
        num = ref.num if isinstance(ref, Ref) else None
        if num is not None and num in seen:
            return
        seen.add(num)
        node = doc.resolve(ref)
        if not isinstance(node, dict):
            raise SyntaxFault("page tree node is no dictionary")
        own = {**inherited, **{k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}}
        if "Kids" not in node:
            out.append((num, {**own, **node}))
            return
        kids = doc.resolve(node["Kids"])
        if not isinstance(kids, list):
            raise SyntaxFault("/Kids is no array")
        for kid in kids:
            walk(kid, own, depth + 1)

    walk(doc.catalog.get("Pages"), {}, 0)
    return out


def page_content(doc: Document, page: dict) -> bytes:
    """The decoded content streams of a page, a new line between those that are not empty."""
    c = doc.resolve(page.get("Contents"))
    parts = []
    for s in c if isinstance(c, list) else [c]:
        s = doc.resolve(s)
        if isinstance(s, Stream):
            parts.append(decoded(s))
    return b"\n".join(p for p in parts if p)


def file_id(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:16]


def write(objects: dict[int, object], root: int, info: int | None = None, version: tuple[int, int] = (1, 7), kind: str = "classic", more: dict | None = None) -> bytes:
    """A whole file. kind: classic table, xref (cross-reference stream) or packed (object streams of up to 100)."""
    out = bytearray(b"%%PDF-%d.%d\n%%\xe2\xe3\xcf\xd3\n" % version)
    trailer: dict = {"Root": Ref(root), **({"Info": Ref(info)} if info else {}), **(more or {})}
    entries: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    plain = dict(sorted(objects.items()))
    top = max(plain, default=0)
    if kind == "packed":
        loose = {n: v for n, v in plain.items() if not isinstance(v, Stream)}
        plain = {n: v for n, v in plain.items() if isinstance(v, Stream)}
        names = list(loose)
        for at in range(0, len(names), 100):
            part, top = names[at : at + 100], top + 1
            bodies = [serialise(loose[n]) for n in part]
            heads, offset = [], 0
            for i, (n, b) in enumerate(zip(part, bodies, strict=True)):
                heads.append(b"%d %d" % (n, offset))
                offset += len(b) + 1
                entries[n] = (2, top, i)
            head = b" ".join(heads) + b"\n"
            plain[top] = Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head), "Filter": Name("FlateDecode")}, codecs.flate_encode(head + b"\n".join(bodies)))
    for n, v in sorted(plain.items()):
        entries[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + serialise(v) + b"\nendobj\n"
    if version >= (2, 0):
        trailer["ID"] = [file_id(bytes(out))] * 2
    start = len(out)
    if kind == "classic":
        out += b"xref\n0 %d\n" % (top + 1)
        for n in range(top + 1):
            t, a, g = entries.get(n, (0, 0, 65535))
            out += b"%010d %05d %c \n" % (a, g, b"fn"[t])
        out += b"trailer\n" + serialise({"Size": top + 1, **trailer}) + b"\n"
    else:
        top += 1
        entries[top] = (1, start, 0)
        rows = b"".join(bytes([entries.get(n, (0, 0, 0))[0]]) + entries.get(n, (0, 0, 0))[1].to_bytes(4, "big") + min(entries.get(n, (0, 0, 0))[2], 65535).to_bytes(2, "big") for n in range(top + 1))
        s = Stream({"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode"), **trailer}, codecs.flate_encode(rows))
        out += b"%d 0 obj\n" % top + serialise(s) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def write_incremental(original: bytes, changed: dict[int, object], doc: Document) -> bytes:
    """The original bytes, then the changed objects and a section that points back."""
    out = bytearray(original)
    if not out.endswith(b"\n"):
        out += b"\n"
    at = {}
    for n, v in sorted(changed.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + serialise(v) + b"\nendobj\n"
    start, prev = len(out), int(re.findall(rb"startxref[\0\t\n\f\r ]+(\d+)", original)[-1])
    out += b"xref\n"
    for n, offset in at.items():
        out += b"%d 1\n%010d %05d n \n" % (n, offset, 0)
    size = max([*doc.xref, *changed, 0]) + 1
    keep = {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer}
    out += b"trailer\n" + serialise({"Size": size, **keep, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)
