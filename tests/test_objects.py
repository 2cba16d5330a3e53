import random

import pytest

from quire.functions import calc, codecs, composing, content, flow, fonts, metadata, security, structure
from quire.functions import signatures as signing
from quire.functions.objects import Document, Lexer, Limits, Name, Ref, Stream, SyntaxFault, open_document, pages, serialise, write


def assembled(bodies):
    return write({i + 1: b for i, b in enumerate(bodies)}, 1)


@pytest.mark.parametrize("n", [0, 1, 5, 300, 9000])
def test_codecs_round_trip(n):
    random.seed(n)
    for data in (bytes(random.randrange(256) for _ in range(n)), bytes(random.choice(b"ab") for _ in range(n))):
        for encode, decode in ((codecs.lzw_encode, codecs.lzw_decode), (codecs.run_length_encode, codecs.run_length_decode), (codecs.a85_encode, codecs.a85_decode), (codecs.hex_encode, codecs.hex_decode), (codecs.flate_encode, codecs.flate_decode)):
            assert decode(encode(data)) == data


def test_codec_rules():
    assert codecs.hex_decode(b"4 1 4>zz") == b"A@"
    assert codecs.a85_decode(b"<~z~>") == bytes(4)
    with pytest.raises(codecs.CodecError):
        codecs.hex_decode(b"4G>")
    with pytest.raises(codecs.CodecError):
        codecs.a85_decode(b"!~>")
    with pytest.raises(codecs.CodecError):
        codecs.run_length_decode(b"\x05ab")
    with pytest.raises(codecs.CodecError):
        codecs.decode_chain(b"", ["Fl"] * 9)
    assert codecs.predicted(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    assert codecs.predicted(bytes([1, 1, 1, 5]), {"Predictor": 2, "Columns": 2}) == bytes([1, 2, 1, 6])


def shown(*ops):
    return content.text_of(content.operations(b"\n".join(ops)))


def test_text_of_an_invoice():
    """Breaks come from moves and from the end of a text object, blanks from wide gaps only."""
    assert shown(b"q 0.5 w 40 40 200 300 re S Q") == ""
    assert shown(b"BT /F3 9 Tf 72 640 Td (Invoice 2207) Tj ET", b"BT (Due) Tj 0 -11 TD (30 days) Tj ET") == "Invoice 2207\nDue\n30 days"
    # kerning of 80 joins, a gap of 100 or more thousandths parts; numbers between strings may be real
    assert shown(b"BT [(To) 80 (tal) -99.9 (:) -100 (41) -612.5 (EUR)] TJ ET") == "Total: 41 EUR"
    assert shown(b"BT 13 TL (net) Tj (vat) ' 2 1 (gross) \" T* T* (paid) Tj ET") == "net\nvat\ngross\npaid"


def test_fragments_of_a_turned_page():
    """Places by hand: the text matrix first, then the page's; q and Q keep the latter alone."""
    read = lambda *ops: content.fragments(content.operations(b"\n".join(ops)))
    # a quarter turn about the origin and a shift: (x, y) goes to (300 - y, x)
    assert read(b"0 1 -1 0 300 0 cm", b"BT 1 0 0 1 25 110 Tm (stamp) Tj ET") == [("stamp", 190.0, 25.0)]
    # doubled inside q/Q only; the second move adds to the first line's start
    got = read(b"q 2 0 0 2 0 0 cm BT 7 31 Td (in) Tj ET Q", b"BT 7 31 Td (out) Tj 3 -4 Td (below) Tj ET")
    assert got == [("in", 14.0, 62.0), ("out", 7.0, 31.0), ("below", 10.0, 27.0)]
    # TD sets the leading that T* and the quote use
    assert [y for _, _, y in read(b"BT 0 500 Td 0 -17 TD (a) Tj T* (b) Tj (c) ' ET")] == [483.0, 466.0, 449.0]
    # rows by rounded height, then from left to right, then as they came
    cells = [("9.50", 220, 431.4), ("tea", 36, 430.6), ("Menu", 90, 612), ("!", 220, 431.0)]
    assert content.layout(cells) == "Menu\ntea 9.50 !"


def test_text_strings():
    """Marks of the encodings, language escapes, and what PDFDocEncoding has above ASCII."""
    assert content.text_string(b"\xfe\xff" + "Žluťoučký 𝄞".encode("utf-16-be")) == "Žluťoučký 𝄞"
    assert content.text_string(b"\xef\xbb\xbf" + "naïve ‰".encode()) == "naïve ‰"
    assert content.text_string(b"on\x1ben-GB\x1be of two") == "one of two" and content.text_string(b"one\x1b mark") == "one mark"
    for said in ("plain", "Größe", "π ≈ 3", ""):
        assert content.text_string(content.to_text_string(said)) == said


def test_unicode_map():
    """Codes of the widest entry's width; a list gives each code of its range a text of its own; unknown codes have none."""
    m = content.Unicode(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0021> <00660066> endbfchar 2 beginbfrange <8001> <8003> <03B1> <0030> <0031> [<0078> <00790079>] endbfrange")
    assert m.decode(b"\x00\x21\x80\x02\x00\x30\x00\x31\x12\x34\x80") == "ffβxyy"


@pytest.mark.parametrize("kind", ["classic", "xref", "packed"])
def test_author_read_edit(kind):
    data = structure.author("Hello (world)\n\nsecond \\ line\n" + "\n".join(f"l{i} é€" for i in range(120)), "Tïtle", kind=kind, fields={"a": "1", "b": "ü"}, outline_titles=True, files={"x": b"data"})
    doc = open_document(data)
    text = structure.document_text(doc)
    assert doc.mode == "Strict" and text.startswith("Hello (world)\nsecond \\ line\nl0 é€") and text.count("\f") == 2
    assert structure.form_fields(doc)[1] | {"rect": None} == {"name": "b", "field_type": "Tx", "value": "ü", "rect": None, "page_index": 0}
    assert [x["dest_page"] for x in structure.outline(doc)] == [0, 1, 2] and structure.attachments(doc)[0]["data"] == b"data"
    assert len(pages(open_document(structure.merge([doc, doc])))) == 6
    assert len(pages(open_document(structure.extract_pages(doc, [2, 0, 0, 9])))) == 3
    assert structure.document_text(open_document(structure.save(doc, "packed"))) == text
    if kind == "classic":
        filled = structure.fill_form(doc, {"a": "new", "zz": "q"})
        assert filled.startswith(data) and structure.form_fields(open_document(filled))[0]["value"] == "new"
        assert pages(open_document(structure.rotate_page(doc, 1, -90)))[1][1]["Rotate"] == 270
        for bad in (data.replace(b"startxref", b"startxxxx"), b"junk\n" + data, data[: data.rfind(b"trailer") - 40], data.replace(b"startxref\n", b"startxref\n999")):
            again = open_document(bad)
            assert structure.document_text(again) == text


def test_broken_trees():
    cyclic = assembled([{"Type": Name("Catalog"), "Pages": Ref(2)}, {"Kids": [Ref(3), Ref(2)]}, {"Kids": [Ref(2), Ref(4)]}, {"Type": Name("Page")}])
    assert len(pages(open_document(cyclic))) == 1
    with pytest.raises(SyntaxFault):
        pages(open_document(assembled([{"Type": Name("Catalog"), "Pages": Ref(2)}, {"Kids": 7}])))
    nested = b"[" * 600 + b"]" * 600
    with pytest.raises(SyntaxFault):
        Lexer(nested).value()


def test_serialise_round_trip():
    v = {"A": [1, 1.5, True, None, Name("x y"), b"(a)\\\n", b"\xff\x00", Ref(3, 0)], "B": {"C": -0.25}}
    assert Lexer(serialise(v)).value() == v


def test_ciphers():
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, out in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        a = security.AES(bytes(range(n)))
        assert a.encrypt_block(plain).hex() == out and a.decrypt_block(bytes.fromhex(out)) == plain
    assert security.cbc_decrypt(bytes(16), security.cbc_encrypt(bytes(16), bytes(range(16)), b"x" * 31)) == b"x" * 31


@pytest.mark.parametrize("algorithm", ["rc4", "aes128", "aes256"])
def test_encryption(algorithm):
    doc = open_document(structure.author("secret\ntext", "T"))
    sealed = security.encrypted(doc, b"u", b"own", algorithm=algorithm)
    for password in (b"u", b"own"):
        assert structure.document_text(open_document(sealed, password)) == "secret\ntext"
    with pytest.raises(SyntaxFault):
        open_document(sealed, b"no")


def test_functions():
    """Values worked out by hand for a spot colour's ramp, a folded ramp, a table of samples, and programs."""
    d = Document(b"", {}, {})
    made = lambda kind, **k: calc.parse(d, {"FunctionType": kind, "Domain": [0, 4]} | k)
    ramp = made(2, C0=[0.2, 1.0], C1=[0.7, 0.0], N=2)
    assert ramp([0.4]) == pytest.approx([0.28, 0.84]) and ramp([9]) == pytest.approx([8.2, -15.0]) and ramp([-3]) == [0.2, 1.0]
    assert made(2, C1=[2.0], Range=[0.25, 1.5])([1]) == [1.5] and made(2, C1=[2.0], Range=[0.25, 1.5])([0]) == [0.25]
    line = {"FunctionType": 2, "Domain": [0, 1], "N": 1}
    fold = made(3, Functions=[line, {**line, "C0": [5], "C1": [7]}, line], Bounds=[1, 3], Encode=[0, 1, 0, 1, 1, 0])
    assert [fold([x])[0] for x in (0.5, 1, 2, 3, 3.75, 4)] == [0.5, 5, 6, 1, 0.25, 0]
    table = calc.parse(d, Stream({"FunctionType": 0, "Domain": [0, 6], "Range": [0, 30], "Size": [4], "BitsPerSample": 4}, b"\x05\xaf"))
    assert [table([x])[0] for x in (0, 1, 2, 5, 6)] == pytest.approx([0, 5, 10, 25, 30])  # samples 0, 5, 10, 15 of 15 stand at 0, 2, 4, 6
    run = lambda text, *x: calc.run(calc.tokens(text), list(x), 1)[0]
    assert run("{ 7 3 idiv 7 3 mod add }") == 3 and run("{ dup 0 lt { neg } if }", -6) == 6 and run("{ 4 5 6 2 copy add exch pop sub sub }") == 10 and run("{ 8 9 1 index sub sub }") == 7
    assert run("{ 10 20 30 3 -1 roll }") == 10 and run("{ 1 1 atan }") == pytest.approx(45) and run("{ 2 10 exp 1 bitshift }") == 2048 and run("{ pop pop }") == 0


def test_layout():
    assert composing.wrap("Hello wide world", 12, 60) == ["Hello wide", "world"]
    assert composing.row_widths([("fixed", 10), ("relative", 1), ("relative", 3)], [0, 0, 0], 50) == [10, 10, 30]
    assert composing.paginate([4, 4, 40, 4], 10, 1) == [[0, 1], [2], [3]]
    assert composing.pdfa_violation({"unembedded_fonts": 1, "attachments": 1}, 1, "b") == "UnembeddedFont"
    assert composing.pdfua_violation({"tagged": True, "title": "x"}) == "MissingLanguage"


def test_font_programs():
    """A font written here: characters, widths, parts of composites, and a subset that keeps numbers."""
    program = fonts.drawn("Tea é𝄞", lambda c: 300 + 10 * (ord(c) % 9), "Test Face")
    assert fonts.glyph_to_unicode(program) == {i + 1: c for i, c in enumerate("Tea é𝄞")}
    facts = fonts.metrics(program)
    assert facts["name"] == "Test Face" and facts["n_glyphs"] == 7 and (facts["ascent"], facts["descent"]) == (800, -200) and facts["outlines"] == "glyf"
    assert [(g["glyph"], g["advance"]) for g in fonts.shaped(program, "eX")] == [(2, 300 + 10 * (101 % 9)), (0, 500)]
    assert fonts.glyphs_for(program, "Teeth") == [0, 1, 2] and fonts.advances(program)[0] == (0, 500)
    less = fonts.subset(program, [2])
    kept = fonts._outlines(fonts.opened(less))
    assert len(less) < len(program) and [bool(x) for x in kept] == [True, False, True, False, False, False, False] and fonts.advances(less) == fonts.advances(program)
    assert fonts.opened(b"OTTO") is None and fonts.metrics(program[:40]) is None and fonts.subset(b"", [1]) is None
    # CIDs by way of a map to glyphs: code 5 is glyph 2, the rest has no glyph
    font = metadata.composite_font(program, bytes(10) + b"\0\2")
    assert content._composite(font, Document(b"", {}, {}))(b"\0\5\0\1") == "e"


def test_declarations():
    """What files declare wrongly is passed over."""
    doc = open_document(structure.author("a\nb", "T"))
    again = lambda **how: open_document(metadata.declared(doc, **how))
    assert metadata.dates(doc) == {"creation": None, "modification": None} and metadata.xmp(doc) is None and metadata.payload(doc) is None and metadata.parts(doc) == []
    x = again(annotations=[{"Subtype": Name("Link"), "A": {"S": Name("GoToDp")}}, {"AF": []}], packet="<x/>")
    assert metadata.least_version(x) == (2, 0) and metadata.violation(x, (1, 7)) == "associated file" and metadata.violation(x, (2, 0)) is None and metadata.xmp(x) == "<x/>"
    assert metadata.indexed(doc, [Name("Indexed"), Name("DeviceGray"), 300, b"\1\2"]) == {"base": "DeviceGray", "components": 1, "top": 255, "palette": b"\1\2"}
    space = metadata.indexed(doc, [Name("I"), Name("DeviceRGB"), 1, b"abcdef"])
    assert metadata.entry(space, 1) == b"def" and metadata.entry(space, 2) is None and metadata.indexed(doc, [Name("Indexed"), Name("G"), 1]) is None
    assert metadata.separation(doc, [Name("DeviceN"), Name("Cyan"), Name("G"), {}]) is None and structure.color_space(doc, [Name("DeviceN"), [Name("A"), Name("B")]]) == ("DeviceN", 2)
    assert metadata.png_image(b"no") is None and security.supports({"Filter": Name("Standard"), "V": 5}) and not security.supports({"Filter": Name("Adobe.PubSec"), "V": 4})


def test_flow():
    """Places worked out by hand: alignment, hanging indents, breaks before rows that cross the page's end, widths of columns."""
    style = flow.Style(10, 12, "right", "Courier")
    assert flow.line_place(style, "abcd", 100, False) == (76.0, 0.0)
    assert flow.line_place(flow.Style(10, 12, "justify", "Courier"), "ab c d", 60, False) == (0.0, 12.0) and flow.line_place(flow.Style(10, 12, "justify", "Courier"), "ab c d", 60, True) == (0.0, 0.0)
    paper = flow.Paper(120, 100, 20)  # 80 by 60: five lines of 12
    plain = flow.Style(10, 12, "left", "Courier")
    sheets, elements = flow.laid([flow.Block("heading", "Top", level=9, style=plain), flow.Block("list", ["one two three four"], style=plain, indent=20)], paper)
    assert [(x.text, x.x, x.y) for x in sheets[0]] == [("Top", 20, 70), ("•", 20, 58), ("one two", 40, 58), ("three four", 40, 46)]
    assert [e.tag for e in elements] == ["H6", "L", "LI", "Lbl", "LBody"] and flow.heading_tag(-1) == "H1"
    table = flow.Block("table", [["h", "i"]] + [[str(k), "x"] for k in range(5)], columns=(("auto", 0), ("relative", 1)), headers=1, padding=4, style=plain)
    sheets, _ = flow.laid([table], paper)  # rows of 20: three a page, the header again on each
    assert [[x.text for x in s] for s in sheets] == [["h", "i", "0", "x", "1", "x"], ["h", "i", "2", "x", "3", "x"], ["h", "i", "4", "x"]]
    assert flow.column_widths(table, [["abc", ""]], 80) == [26.0, 54.0]
    data = flow.flowed([table], paper, "T", "de", header="{page}/{pages}")
    doc = open_document(data)
    assert structure.document_text(doc).split("\f")[1].split("\n")[0] == "2/3" and sum(x["tag"] == "TH" for x in flow.elements_of(doc)) == 2
    assert flow.conformance_facts(doc) == {"tagged": True, "unembedded_fonts": 2, "figures_without_alt": 0, "title": b"T", "language": b"de", "attachments": 0}
    assert flow.flowed([table], paper, target=(1, 4))[:8] == b"%PDF-1.4"


def test_standards():
    assert composing.PDFA["2u"][:2] == (2, "U") and composing.allows_attachments("4f") and not composing.allows_attachments("2b")
    known = composing.known_structure_type
    assert known("Note") and not known("Title") and known("Title", composing.NAMESPACE_20) and known("H17", composing.NAMESPACE_20) and not known("Note", composing.NAMESPACE_20) and known("mi", composing.NAMESPACE_MATH)
    maps = {("urn:a", "Para"): ("P", None), ("urn:a", "Far"): ("Para", "urn:a")}
    assert known("Para", "urn:a", maps) and not known("Far", "urn:a", maps) and not known("Other", "urn:a", maps)
    fine = {"tagged": True, "title": "t", "language": "en"}
    assert composing.pdfua2_violation(fine) is None and composing.pdfua2_violation({**fine, "types": ["Note"]}) == "DeprecatedNote" and composing.pdfua2_violation({**fine, "typed": [("Far", "urn:a", maps)]}) == "UnknownStructureType"


def test_signatures():
    root, own = signing.key_for_tests(1), signing.key_for_tests(2)
    top, mid = signing.certificate("Top", root, "Top", root), signing.certificate("Mid", own, "Top", root, 5)
    leaf_key = signing.key_for_tests(3)
    leaf = signing.certificate("Leaf", leaf_key, "Mid", own, 300, ("250101000000Z", "260101000000Z"))
    of = signing.Certificate.of
    message = signing.signed_message(b"content", leaf_key, [leaf, mid], "250601000000Z")
    good = signing.verified(message + bytes(40), b"content", [of(top)])
    assert (good.signer, good.intact, good.authentic, good.trusted, good.time) == ("Leaf", True, True, True, "250601000000Z")
    assert not signing.verified(message, b"contents", [of(top)]).intact and not signing.verified(message, b"content").trusted
    late = signing.verified(signing.signed_message(b"content", leaf_key, [leaf, mid], "260601000000Z"), b"content", [of(top)])
    assert late.authentic and not late.trusted  # the certificate had ended
    forged = signing.verified(signing.signed_message(b"content", own, [leaf, mid]), b"content", [of(top)])
    assert forged.intact and not forged.authentic and not forged.trusted
    for bad in (b"", b"\x30\x80", message[:200], b"\x30\x03\x02\x01\x01"):
        assert signing.verified(bad, b"content").fault
    assert signing.read(signing.integer(-129))[0].number() == -129 and signing.read(signing.identifier("1.2.840.113549.1.7.2"))[0].oid() == "1.2.840.113549.1.7.2"
    assert len(signing.der(4, bytes(300))) == 304 and signing.rsa_verified(own.n, own.e, b"m", signing.rsa_sign(own, b"m", "sha512"), "sha512")
    plain = structure.author("one\ntwo", fields={"f": "v"})
    data = signing.signed(open_document(plain), leaf_key, [leaf, mid], "Sig", "why", "250601000000Z")
    again = signing.signed(open_document(data), leaf_key, [leaf, mid], "Second")
    rows = signing.signatures(open_document(again), [of(top)])
    assert data.startswith(plain) and [(r["name"], r["covers_file"], r["intact"], r["trusted"]) for r in rows] == [("Sig", False, True, True), ("Second", True, True, True)]
    assert structure.document_text(open_document(again)) == "one\ntwo" and {f["name"] for f in structure.form_fields(open_document(again))} == {"f", "Sig", "Second"}


def test_limits():
    """Fewer objects than the table names: recovery keeps the first ones; a bomb and a deep value are refused."""
    data = structure.author("\n".join(f"line {i}" for i in range(120)))
    few = open_document(data, limits=Limits(objects=5))
    assert few.mode == "Recovered" and len(few.xref) == 5 and open_document(data).mode == "Strict"
    doc = open_document(data, limits=Limits(decoded=10, filters=1, nesting=3))
    s = next(v for _, v in open_document(data).live() if isinstance(v, Stream))
    with pytest.raises(codecs.CodecError):
        doc.data_of(s)
    with pytest.raises(codecs.CodecError):
        doc.data_of(Stream({"Filter": [Name("ASCIIHexDecode")] * 2}, b">"))
    packed = structure.author("x", kind="packed")
    assert len(open_document(packed, limits=Limits(members=2)).container(next(b for k, b, _ in open_document(packed).xref.values() if k == "c"))) == 2
    with pytest.raises(SyntaxFault):
        Lexer(b"[[[[[1]]]]]", nesting=3).value()
