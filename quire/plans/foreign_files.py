"""Files put together byte by byte, without the writer of this package: layouts that other programs give documents, sound and damaged."""

from __future__ import annotations

import base64
import zlib

#: Layouts by number; those from DAMAGED on can only be read by recovery.
LAYOUTS = ("plain", "indirect length", "nested tree", "foreign lzw", "ascii85 and flate", "comments", "wrong length", "xref stream", "hybrid", "no startxref", "bad startxref", "cut in the table", "junk before")
DAMAGED = 9


def _lzw(data: bytes) -> bytes:
    """LZW as a lazy encoder writes it: every byte for itself in 9 bits, and a clear code before codes would grow."""
    codes = []
    for i, b in enumerate(data):
        codes += [256] * (i % 200 == 0) + [b]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def _stream(body: bytes, more: str = "", length: str | None = None) -> bytes:
    return f"<< /Length {len(body) if length is None else length} {more}>>\nstream\n".encode() + body + b"\nendstream"


def built(layout: str, text: str) -> bytes:
    """A file of this layout that shows the text, a line in a string each."""
    shown = b"BT /F 10 Tf 12 TL 40 700 Td\n" + b"\n".join(b"<" + line.encode("cp1252", "replace").hex().encode() + b"> Tj T*" for line in text.split("\n")) + b"\nET"
    content = _stream(shown)
    if layout == "indirect length":
        content = _stream(shown, length="6 0 R")
    elif layout == "foreign lzw":
        content = _stream(_lzw(shown), "/Filter /LZWDecode ")
    elif layout == "ascii85 and flate":
        content = _stream(base64.a85encode(zlib.compress(shown, 1), wrapcol=72) + b"~>", "/Filter [/ASCII85Decode /FlateDecode] ")
    elif layout == "wrong length":
        content = _stream(shown, length="2")
    page = b"<< /Type /Page /Parent %d 0 R /Contents 4 0 R %s>>" % (7 if layout == "nested tree" else 2, b"" if layout == "nested tree" else b"/Resources << /Font << /F 5 0 R >> >> ")
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%d 0 R] /Count 1 /MediaBox [0 0 500 800] >>" % (7 if layout == "nested tree" else 3), 3: page, 4: content,
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: str(len(shown)).encode(),
    }
    if layout == "nested tree":
        bodies[7] = b"<< /Type /Pages /Parent 2 0 R /Kids [3 0 R] /Count 1 /Resources << /Font << /F 5 0 R >> >> >>"
    out = b"%PDF-1.5\n" + (b"% a comment (with << marks\n" if layout == "comments" else b"")
    places = {}
    for n, body in bodies.items():
        places[n] = len(out)
        out += b"%d 0 obj %s\n" % (n, b"% said here\n" if layout == "comments" else b"") + body + b"\nendobj\n"
    start, size = len(out), max(bodies) + 1
    if layout == "xref stream":
        rows = b"\0\0\0\0\xff" + b"".join(b"\1" + places[n].to_bytes(3, "big") + b"\0" for n in sorted(places)) + b"\1" + start.to_bytes(3, "big") + b"\0"
        out += b"%d 0 obj\n" % size + _stream(zlib.compress(rows), f"/Type /XRef /Size {size + 1} /W [1 3 1] /Root 1 0 R /Filter /FlateDecode ") + b"\nendobj\n"
        return out + b"startxref\n%d\n%%%%EOF" % start
    apart = {4} if layout == "hybrid" else set()  # only in the stream that the trailer points to
    runs = [(0, 4), (5, size)] if apart else [(0, size)]
    row = lambda n: b"%010d 00000 n \n" % places[n] if n else b"0000000000 65535 f \n"
    out += b"xref\n" + b"".join(b"%d %d\n" % (x, y - x) + b"".join(map(row, range(x, y))) for x, y in runs)
    more = b""
    if apart:
        table = out[start:]
        out, rows = out[:start], b"\1" + places[4].to_bytes(3, "big") + b"\0"
        at, out = len(out), out + b"%d 0 obj\n" % size + _stream(rows, f"/Type /XRef /Size {size} /Index [4 1] /W [1 3 1] /Root 1 0 R ") + b"\nendobj\n"
        start, more = len(out), b"/XRefStm %d " % at
        out += table
    if layout == "cut in the table":
        return out[: start + 40]
    out += b"trailer\n<< /Size %d /Root 1 0 R %s>>\n" % (size, more)
    if layout != "no startxref":
        out += b"startxref\n%d\n%%%%EOF\n" % (999_999_999 if layout == "bad startxref" else start)
    return b"\x01\x02junk line\n" * 3 + out if layout == "junk before" else out
