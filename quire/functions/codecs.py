"""Byte codecs of document streams: pure functions on bytes, each bounded in its output.

decode_chain applies a stream's filters from left to right: at most MAX_FILTERS of them, each at most MAX_OUTPUT bytes.
Terminal image codecs (DCT, JPX, JBIG2) stay encoded.
"""

from __future__ import annotations

import zlib

import numpy as np

MAX_OUTPUT = 256 << 20
MAX_FILTERS = 8

#: Filter names and their abbreviations.
FILTERS = {
    "ASCIIHexDecode": "hex", "AHx": "hex", "ASCII85Decode": "a85", "A85": "a85", "LZWDecode": "lzw", "LZW": "lzw", "FlateDecode": "flate", "Fl": "flate",
    "RunLengthDecode": "rl", "RL": "rl", "CCITTFaxDecode": "ccitt", "CCF": "ccitt", "DCTDecode": "dct", "DCT": "dct", "JPXDecode": "jpx", "JBIG2Decode": "jbig2", "Crypt": "crypt",
}
IMAGE_CODECS = ("dct", "jpx", "jbig2")
_WHITE = b"\0\t\n\f\r "


class CodecError(ValueError):
    pass


def hex_decode(data: bytes) -> bytes:
    body = data.split(b">", 1)[0].translate(None, _WHITE)
    try:
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("ascii"))
    except (ValueError, UnicodeDecodeError):
        raise CodecError("ASCIIHex: not a hexadecimal digit") from None


def hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def a85_decode(data: bytes) -> bytes:
    body = data.translate(None, _WHITE)
    body = body.removeprefix(b"<~").split(b"~", 1)[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A:
            if group:
                raise CodecError("ASCII85: z inside a group")
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            raise CodecError("ASCII85: character out of range")
        group.append(c - 0x21)
        if len(group) == 5:
            out += _group(group)
            group = []
    if len(group) == 1:
        raise CodecError("ASCII85: one character left over")
    if group:
        out += _group(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group(group: list[int]) -> bytes:
    n = 0
    for g in group:
        n = n * 85 + g
    if n >= 1 << 32:
        raise CodecError("ASCII85: group too large")
    return n.to_bytes(4, "big")


def a85_encode(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


def run_length_decode(data: bytes, most: int = MAX_OUTPUT) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            if i + n + 2 > len(data):
                raise CodecError("RunLength: literal run cut short")
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if i + 1 >= len(data):
                raise CodecError("RunLength: repeat run cut short")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > most:
            raise CodecError("RunLength: output too large")
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            n = 1
            while n < 128 and i + n < len(data) and (i + n + 1 >= len(data) or data[i + n] != data[i + n + 1]):
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


def flate_decode(data: bytes, params: dict | None = None, most: int = MAX_OUTPUT) -> bytes:
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, most + 1)
        except zlib.error:
            continue
        if len(out) > most:
            raise CodecError("Flate: output too large")
        return predicted(out, params)
    raise CodecError("Flate: not a deflate stream")


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data)


def lzw_decode(data: bytes, params: dict | None = None, most: int = MAX_OUTPUT) -> bytes:
    early = 0 if (params or {}).get("EarlyChange") == 0 else 1
    roots = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, last = list(roots), 9, None
    out, held, bits = bytearray(), 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(roots), 9, None
            continue
        if last is None:
            if code > 255:
                raise CodecError("LZW: code out of range")
            entry = table[code]
        else:
            if code > len(table):
                raise CodecError("LZW: code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + entry[:1])
        out += entry
        last = entry
        if len(out) > most:
            raise CodecError("LZW: output too large")
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return predicted(bytes(out), params)


def lzw_encode(data: bytes) -> bytes:
    """Codes of one width at a time, as the decoder grows them."""
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width, word, size = {bytes([b]): b for b in range(256)}, 9, b"", 258
    put(256, 9)
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if size < 4095:
            table[longer] = size
            size += 1
            if size + 1 > 1 << width and width < 12:
                width += 1
        else:
            put(256, width)
            table, width, size = {bytes([x]): x for x in range(256)}, 9, 258
        word = bytes([b])
    if word:
        put(table[word], width)
        if size + 2 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def predicted(data: bytes, params: dict | None) -> bytes:
    """Undoes the predictor: 1 none, 2 TIFF (8 bits), from 10 PNG; an incomplete last row is dropped."""
    p = params or {}
    kind = p.get("Predictor", 1)
    if not isinstance(kind, int) or kind <= 1:
        return data
    colors, bpc, columns = (max(1, int(p.get(k, d))) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    bpp, row = max(1, colors * bpc // 8), (colors * bpc * columns + 7) // 8
    if kind == 2:
        if bpc != 8:
            raise CodecError("TIFF predictor: 8 bits only")
        n = len(data) // row
        body = np.frombuffer(data[: n * row], np.uint8).reshape(n, columns, colors)
        return np.cumsum(body, axis=1, dtype=np.uint8).tobytes() + data[n * row :]
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data) - row, row + 1):
        line = np.frombuffer(data[at + 1 : at + 1 + row], np.uint8).copy()
        above = _png_row(data[at], line, above, bpp)
        out += above.tobytes()
    return bytes(out)


def _png_row(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        for k in range(bpp):
            line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        return line
    if kind not in (3, 4):
        raise CodecError("PNG predictor: unknown row filter")
    got, up = line.tolist(), above.tolist()
    for i in range(len(got)):
        a = got[i - bpp] if i >= bpp else 0
        b, c = up[i], up[i - bpp] if i >= bpp else 0
        if kind == 3:
            got[i] = got[i] + (a + b) // 2 & 255
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            got[i] = got[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
    return np.array(got, np.uint8)


def decode_chain(data: bytes, filters: list[str], params: list[dict | None] | None = None, most: int = MAX_OUTPUT, longest: int = MAX_FILTERS) -> bytes:
    """Applies the filters in order; image codecs must come last, and leave the data as they are."""
    if len(filters) > longest:
        raise CodecError("too many filters")
    params = (params or []) + [None] * len(filters)
    for name, p in zip(filters, params, strict=False):
        kind = FILTERS.get(name)
        if kind is None:
            raise CodecError(f"unknown filter {name}")
        if kind in IMAGE_CODECS:
            return data
        if kind == "hex":
            data = hex_decode(data)
        elif kind == "a85":
            data = a85_decode(data)
        elif kind == "rl":
            data = run_length_decode(data, most)
        elif kind == "flate":
            data = flate_decode(data, p, most)
        elif kind == "lzw":
            data = lzw_decode(data, p, most)
        elif kind == "ccitt":
            raise CodecError("CCITT is not decoded")
        if len(data) > most:
            raise CodecError("output too large")
    return data
