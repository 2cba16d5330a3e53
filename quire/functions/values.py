"""Values of objects as columns: a value is its kind and its syntax, as operators.documents.object_entries gives them; dictionaries
are maps and arrays are arrays of such syntax. Accessors give null where the kind is another. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The syntax's white space and delimiters.
WHITE_SPACE = (0, 9, 10, 12, 13, 32)
DELIMITERS = "()<>[]{}/%"
_REFERENCE = r"^(\d+) (\d+) R$"


def as_bool(kind: Column, syntax: Column) -> Column:
    return F.when(kind == "bool", syntax == "true")


def as_integer(kind: Column, syntax: Column) -> Column:
    return F.when(kind == "int", syntax.try_cast("long"))


def as_real(kind: Column, syntax: Column) -> Column:
    return F.when(kind == "real", syntax.try_cast("double"))


def as_number(kind: Column, syntax: Column) -> Column:
    """Integers and reals alike."""
    return F.when(kind.isin("int", "real"), syntax.try_cast("double"))


def as_reference(kind: Column, syntax: Column) -> Column:
    """struct(num, gen)."""
    part = lambda n: F.regexp_extract(syntax, _REFERENCE, n)
    return F.when((kind == "ref") & syntax.rlike(_REFERENCE), F.struct(part(1).cast("long").alias("num"), part(2).cast("int").alias("gen")))


def pushed(array: Column, value: Column) -> Column:
    return F.array_append(array, value)


def got(dictionary: Column, key: str) -> Column:
    return F.try_element_at(dictionary, F.lit(key))


def inserted(dictionary: Column, key: str, value: Column) -> Column:
    """The dictionary with the entry, in place of one of that key."""
    return F.map_concat(removed(dictionary, key), F.create_map(F.lit(key), value))


def removed(dictionary: Column, key: str) -> Column:
    return F.map_filter(dictionary, lambda k, _: k != key)


def entries(dictionary: Column) -> Column:
    """struct(key, value) of each entry, by key."""
    return F.array_sort(F.map_entries(dictionary))


def got_reference(dictionary: Column, key: str) -> Column:
    found = got(dictionary, key)
    return as_reference(F.when(found.rlike(_REFERENCE), "ref"), found)


def is_white_space(byte: Column) -> Column:
    return byte.isin(*WHITE_SPACE)


def is_delimiter(byte: Column) -> Column:
    return byte.isin(*map(ord, DELIMITERS))


def is_regular(byte: Column) -> Column:
    return ~is_white_space(byte) & ~is_delimiter(byte)


def hex_value(byte: Column) -> Column:
    """0 to 15, or null where the byte is no hexadecimal digit."""
    return F.when(byte.between(48, 57), byte - 48).when(byte.between(65, 70), byte - 55).when(byte.between(97, 102), byte - 87)
