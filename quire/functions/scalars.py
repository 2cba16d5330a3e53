"""Scalar functions as native column expressions: dates, text strings, names, page numbers, PDF functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\s*(?:D:)?(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:([Zz+\-])(?:(\d{2})'?(?:(\d{2})'?)?)?)?\s*$"


def pdf_date(raw: Column) -> Column:
    """struct(year, month, day, hour, minute, second, offset_min) or null; the day is checked against 1-31 only."""
    part = lambda n, default: F.coalesce(F.nullif(F.regexp_extract(raw, _DATE, n), F.lit("")).cast("int"), F.lit(default))
    sign = F.regexp_extract(raw, _DATE, 7)
    hours, minutes = part(8, 0), part(9, 0)
    offset = F.when(sign == "", F.lit(None).cast("int")).when(sign == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    ok = raw.rlike(_DATE) & part(2, 1).between(1, 12) & part(3, 1).between(1, 31) & (part(4, 0) <= 23) & (part(5, 0) <= 59) & (part(6, 0) <= 59) & (hours <= 23) & (minutes <= 59)
    ok &= ~(F.upper(sign) == "Z") | (hours * 60 + minutes == 0)
    ok &= ~sign.isin("+", "-") | (F.regexp_extract(raw, _DATE, 8) != "")
    return F.when(ok, F.struct(part(1, 0).alias("year"), part(2, 1).alias("month"), part(3, 1).alias("day"), part(4, 0).alias("hour"), part(5, 0).alias("minute"), part(6, 0).alias("second"), offset.alias("offset_min")))


def pdf_date_timestamp(d: Column) -> Column:
    """The date's local time; null for days that the calendar lacks."""
    return F.try_make_timestamp(d["year"], d["month"], d["day"], d["hour"], d["minute"], d["second"].cast("decimal(16,6)"))


def format_pdf_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'")


def strip_language_escapes(text: Column) -> Column:
    """Text without the runs between two escape characters; a lone escape goes alone."""
    return F.replace(F.regexp_replace(text, "\x1b[^\x1b]*\x1b", ""), F.lit("\x1b"), F.lit(""))


def rotated(degrees: Column) -> Column:
    """A page's rotation is set, not added: degrees modulo 360, never negative."""
    return F.pmod(degrees, F.lit(360))


def collapsed_newlines(text: Column) -> Column:
    """One new line for each run of them, and none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "\n+", "\n"), "^\n|\n$", "")


def safe_filename(name: Column, index: Column) -> Column:
    """The last path part; all but letters, digits, dot, minus and underscore become underscores; outer dots go; never empty."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._\-]", "_"), r"^\.+|\.+$", "")
    return F.when(clean == "", F.concat(F.lit("attachment_"), index.cast("string"))).otherwise(clean)


#: Roman numerals by decimal place.
_ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
)


def roman(n: Column) -> Column:
    digit = lambda place: F.get(F.array(*[F.lit(x) for x in _ROMAN[place]]), F.pmod(F.floor(n / 10**place), F.lit(10)).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))


def letters(n: Column) -> Column:
    """a..z, aa..zz, aaa..: the letter repeats once more for each 26."""
    letter = F.chr(F.pmod(n - 1, F.lit(26)) + 97)
    return F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """style: D, R, r, A, a or null (the prefix alone)."""
    body = F.when(style == "D", number.cast("string")).when(style == "r", roman(number)).when(style == "R", F.upper(roman(number))).when(style == "a", letters(number)).when(style == "A", F.upper(letters(number))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain=(0.0, 1.0), range_=None) -> Column:
    """Type 2 function: an array, c0 + x^n (c1 - c0)."""
    v = F.pow(clamped(x, *domain), F.lit(float(n)))
    out = [F.lit(float(a)) + v * F.lit(float(b - a)) for a, b in zip(c0, c1, strict=True)]
    return F.array(*[clamped(o, *range_[i]) if range_ else o for i, o in enumerate(out)])


def stitching(x: Column, bounds: list[float], encode: list[tuple[float, float]], domain=(0.0, 1.0)) -> Column:
    """Type 3 function: struct(which, input): the half-open interval that holds x (the last one closed) and its encoded input."""
    v = clamped(x, *domain)
    which = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: v >= b)) if bounds else F.lit(0)
    edges = [domain[0], *bounds, domain[1]]
    encoded = None
    for i, (a, b) in reversed(list(enumerate(encode))):
        lo, hi = edges[i], edges[i + 1]
        e = F.lit(float(a)) if hi == lo else F.lit(float(a)) + (v - F.lit(float(lo))) * F.lit((b - a) / (hi - lo))
        encoded = e if encoded is None else F.when(which == i, e).otherwise(encoded)
    return F.struct(which.alias("which"), encoded.alias("input"))


def sampled(x: Column, samples: list[int], bits: int, domain=(0.0, 1.0), decode=(0.0, 1.0)) -> Column:
    """Type 0 function of one input: linear between the samples."""
    n, top = len(samples), float((1 << bits) - 1)
    e = (clamped(x, *domain) - domain[0]) / (domain[1] - domain[0]) * (n - 1)
    i = F.least(F.floor(e), F.lit(max(0, n - 2))).cast("int")
    table = F.array(*[F.lit(float(s)) for s in samples])
    lo, hi = F.get(table, i), F.get(table, F.least(i + 1, F.lit(n - 1)).cast("int"))
    return F.lit(float(decode[0])) + (lo + (hi - lo) * (e - i)) / top * (decode[1] - decode[0])


#: Permission bits of the standard security handler, by name.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high": 12}


def allows(word: Column, name: str) -> Column:
    return word.bitwiseAND(1 << PERMISSIONS[name] - 1) != 0


def line_offset(align: Column, line_width: Column, width: Column, gaps: Column, last: Column) -> Column:
    """struct(x, word_space) of a line in a column: left, center, right, or justify (never the last line)."""
    spare = width - line_width
    x = F.when(align == "center", spare / 2).when(align == "right", spare).otherwise(0.0)
    space = F.when((align == "justify") & ~last & (gaps > 0), spare / gaps).otherwise(0.0)
    return F.struct(x.alias("x"), space.alias("word_space"))


def ascii_hex_decode(text: Column) -> Column:
    """Bytes of hexadecimal text up to ">"; white space ignored, an odd digit padded, null where another character stands."""
    body = F.regexp_replace(F.substring_index(text, ">", 1), "[\\x00\\t\\n\\f\\r ]", "")
    return F.when(body.rlike("^[0-9A-Fa-f]*$"), F.unhex(F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body)))


def escape_literal(text: Column) -> Column:
    """A literal string's body: backslash and parentheses escaped, line ends spelt."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def vri_key(contents: Column) -> Column:
    """Upper-case hexadecimal SHA-1 of a signature's bytes in upper-case hexadecimal."""
    return F.upper(F.sha1(F.hex(contents).cast("binary")))


def file_id(body: Column) -> Column:
    """First 16 bytes of SHA-256."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def gcm_encrypt(key: Column, nonce: Column, data: Column) -> Column:
    """AES-256-GCM: the 12 bytes of nonce, the encrypted bytes, then the tag of 16."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("NONE"), nonce)


def gcm_decrypt(key: Column, sealed: Column) -> Column:
    """The bytes back, or null where key or tag don't fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("NONE"))
