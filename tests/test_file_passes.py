"""Queries that write files from texts: each file is written and read once, and the quicker ways give what the plain ones do."""

import random

from quire.functions import composing, content, flow, fonts, metadata, structure
from quire.functions import signatures as signing
from quire.functions.objects import open_document
from quire.plans import declared_queries


def passes(frame):
    """Python passes and joins of a plan."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow"), plan.count("Join ")


def test_flowed_text_writes_each_file_once(spark, sf):
    assert passes(declared_queries.flowed_text(spark, sf)) == (1, 0)


def test_repeated_ids_stay_rows_of_their_own(spark, tmp_path):
    docs = [(7, "one two\nthree"), (7, "one two\nthree"), (8, "four")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert declared_queries.flowed_text(spark, str(tmp_path)).groupBy("doc_id").count().sort("doc_id").collect() == [(7, 2), (8, 1)]


def test_wrap_measures_each_word_once(monkeypatch):
    plain = lambda text, size, font: sum(composing.char_width(c, font) for c in text) * size / 1000

    def greedy(text, size, width, font):
        out = []
        for paragraph in text.split("\n"):
            line = ""
            for word in paragraph.split():
                longer = f"{line} {word}" if line else word
                if line and plain(longer, size, font) > width:
                    out.append(line)
                    line = word
                else:
                    line = longer
            out.append(line)
        return out

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abW .,é€\n\tmmm  ") for _ in range(rng.randrange(300)))
        for font in ("Helvetica", "Courier"):
            found = composing.measured_lines(text, 10.7, 61.3, font)
            assert [x for x, _ in found] == greedy(text, 10.7, 61.3, font)
            assert all(n * 10.7 / 1000 == plain(x, 10.7, font) for x, n in found)
    measured = []
    own = composing.units
    monkeypatch.setattr(composing, "units", lambda text, font="Helvetica": measured.append(len(text)) or own(text, font))
    composing.wrap("word " * 4000, 10, 1e9, "Courier")
    assert sum(measured) < 5 * 4000


def test_characters_that_no_encoding_has():
    assert content.winansi_encode("a￾￿\x07\U0001f600€") == b"a????\x80"
    assert [op for op, _ in content.operations(b"/F1 12 Tf true (a\\)b) ' BI /W 1 ID x EI Q")] == ["Tf", "'", "BI", "Q"]
    assert flow.pages_needed([flow.Block("text", "x\n" * 200)]) == 4


def test_signed_documents_are_written_and_read_once(spark, sf, monkeypatch):
    assert passes(declared_queries.signed_documents(spark, sf)) == (1, 0)
    key, message = signing.key_for_tests(10), b"content"
    signature = signing.rsa_sign(key, message)
    assert signature == signing.rsa_sign(signing.Key(key.n, key.e, key.d), message) and signing.rsa_verified(key.n, key.e, message, signature, "sha256")
    # with the primes no power is taken to the whole modulus, and certificates are made and tried once
    asked = []
    monkeypatch.setattr(signing, "pow", lambda x, e, n: asked.append(n) or pow(x, e, n), raising=False)
    root, own = declared_queries._authority(1)
    assert declared_queries._authority(1)[1] is own and signing.rsa_sign(key, message) == signature and key.n not in asked
    leaf, top = signing.Certificate.of(own), signing.Certificate.of(root)
    assert signing.trusted(leaf, [], [top])
    asked.clear()
    assert signing.trusted(leaf, [], [top]) and not signing.trusted(leaf, [], []) and not asked


def test_composite_fonts_are_written_and_read_once(spark, sf, monkeypatch):
    assert passes(declared_queries.composite_fonts(spark, sf)) == (1, 0)
    program = fonts.drawn("abé€\U0001f600", name="Once")
    text = "abéx\U0001f600\n\n€"
    plain = [b"".join(b"%04X" % g["glyph"] for g in fonts.shaped(program, x)) for x in text.split("\n")]
    data = metadata.set_in_font(text, program)
    assert all(b"<" + x + b"> Tj" in data for x in plain)
    assert structure.document_text(open_document(data)) == "abé\U0001f600\n€"
    assert fonts.text_of_glyphs(program, b"\0\1\0\x09\0\5\2") == "a\U0001f600b" and fonts.glyph_codes(b"no font", "a") is None
    # a program's tables are read once for all documents and lines that share it
    made = []
    own = fonts.characters
    monkeypatch.setattr(fonts, "characters", lambda font: made.append(font) or own(font))
    other = fonts.drawn("xyz", name="Other")
    for _ in range(5):
        structure.document_text(open_document(metadata.set_in_font("x\ny\nz", other)))
    assert len(made) <= 2
