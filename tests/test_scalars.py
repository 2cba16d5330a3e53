import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.functions.composing import wrapped


@pytest.mark.parametrize("raw, year, offset", [("D:20260817143005+02'00'", 2026, 120), ("D:20260817143005+02'00", 2026, 120), ("D:20260817143005+0200", 2026, 120), ("D:2026", 2026, None), ("D:202608", 2026, None), (" 20260817120000Z ", 2026, 0), ("D:20260817120000Z00'00'", 2026, 0), ("D:20260817120000-05'30", 2026, -330)])
def test_dates(spark, raw, year, offset):
    d = spark.createDataFrame([(raw,)], "r string").select(S.pdf_date(F.col("r")).alias("d")).first().d
    assert d is not None and d.year == year and d.offset_min == offset


@pytest.mark.parametrize("raw", ["D:20260817120000Z02'00'", "D:20261317", "D:20260832", "D:2026081725", "D:2026081712301", "D:202", "D:20260817120000+", "D:20260817120000+25'00", "D:2026 x", "not a date", ""])
def test_bad_dates(spark, raw):
    assert spark.createDataFrame([(raw,)], "r string").select(S.pdf_date(F.col("r")).alias("d")).first().d is None


def test_labels_names_and_lines(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(S.roman(F.lit(n))) for n in (1, 4, 9, 14, 1999)] == ["i", "iv", "ix", "xiv", "mcmxcix"]
    assert [value(S.letters(F.lit(n))) for n in (1, 26, 27)] == ["a", "z", "aa"]
    assert value(S.safe_filename(F.lit("../a b?.txt"), F.lit(1))) == "a_b_.txt" and value(S.safe_filename(F.lit("..."), F.lit(3))) == "attachment_3"
    assert value(wrapped(F.lit("aa bb cc\n\ndddddd e"), 5)) == ["aa bb", "cc", "", "dddddd", "e"]
    assert value(S.strip_language_escapes(F.lit("a\x1bde\x1bb\x1bc"))) == "abc"
    assert bytes(value(S.ascii_hex_decode(F.lit("41 4>")))) == b"A@" and value(S.ascii_hex_decode(F.lit("4G"))) is None


def test_streaming_ingest(spark, tmp_path):
    from quire.functions.structure import author
    from quire.streaming.ingest import ingest_texts

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(author(f"file {i}"))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"nothing")
    ingest_texts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["file 0", "file 1", "file 2"]
