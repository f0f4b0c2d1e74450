"""PDF files with object streams, nested page trees, filters, fonts of several kinds, links and footers."""

import base64
import zlib

from quillgrid.operators import joins
from quillgrid.sources import pdf
from quillgrid.storage import written


def obj(n, body):
    return f"{n} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"


def stream(n, data, head="", raw=False):
    body = data if raw else zlib.compress(data)
    flt = "" if raw else "/Filter /FlateDecode"
    return obj(n, f"<< {flt} {head} /Length {len(body)} >>\nstream\n".encode("latin-1") + body + b"\nendstream")


CMAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <65E5> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<672C> <0066006C>] endbfrange"""


def one():
    """Four pages: text operators, two fonts, an object stream, an inherited box, links and footers."""
    first = b"BT /F1 10 Tf 12 TL 72 700 Td (A \\(b\\) \\351\\\nc) Tj T* [(Spl) -20 (it) -400 (gap)] TJ 200 0 Td (far) Tj ET q 1 0 0 1 0 -50 cm BT /F2 10 Tf 1 0 0 1 72 600 Tm <00010002001000120021> Tj ET Q"
    second = b"BT /F1 9 Tf 72 500 Td (1.1 Start ...... 3) Tj 0 -40 Td (Second) Tj ET BT /F1 9 Tf 300 460 Td (....... 4) Tj ET"
    objs = [
        stream(4, b"5 0 6 33 " + b"<< /Type /Font /Subtype /Type1 >>" + b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", "/Type /ObjStm /N 2 /First 9"),
        stream(7, CMAP),
        obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        obj(2, "<< /Type /Pages /MediaBox [0 0 500 800] /Kids [3 0 R 8 0 R] /Count 4 /Resources 9 0 R >>"),
        obj(9, "<< /Font << /F1 5 0 R /F2 6 0 R >> >>"),
        obj(3, "<< /Type /Pages /Parent 2 0 R /Kids [10 0 R 11 0 R] >>"),
        obj(10, "<< /Type /Page /Parent 3 0 R /Contents [20 0 R 21 0 R] >>"),
        obj(11, "<< /Type /Page /Parent 3 0 R /Contents 22 0 R /Annots 30 0 R >>"),
        obj(8, "<< /Type /Pages /Parent 2 0 R /Kids [12 0 R 13 0 R 2 0 R] >>"),
        obj(12, "<< /Type /Page /Parent 8 0 R /Contents 23 0 R >>"),
        obj(13, "<< /Type /Page /Parent 8 0 R >>"),
        stream(20, first[:60], raw=True), stream(21, first[60:]), stream(22, second),
        stream(23, base64.a85encode(b"BT /F1 9 Tf 20 100 Td (5-7) Tj 0 500 Td (9-9) Tj ET") + b"~>", "/Filter /ASCII85Decode", raw=True),
        obj(30, "[31 0 R << /Type /Annot /Subtype /Link /Rect [400 450 70 470] /A << /S /GoTo /D [13 0 R /Fit] >> >> << /Subtype /Text /Rect [0 0 900 900] >>]"),
        obj(31, "<< /Type /Annot /Subtype /Link /Rect [70 495 400 512] /Dest [12 0 R /XYZ 0 0 0] >>"),
    ]
    return b"%PDF-1.5\n" + b"".join(objs) + b"trailer << /Root 1 0 R >>\n%%EOF"


def read(spark, **files):
    objs = written(pdf.objects(spark.createDataFrame(list(files.items()), "path string, content binary")), "objects")
    tree = written(pdf.pages(objs), "tree")
    return objs, tree, written(pdf.lines(pdf.spans(objs, tree)), "lines")


def test_pages(spark):
    raw = one()
    updated = raw + stream(22, b"BT /F1 9 Tf 72 500 Td (newer) Tj ET")
    broken = raw.replace(b"/Contents 22 0 R", b"/Contents 99 0 R")
    objs, tree, found = read(spark, one=raw, updated=updated, broken=broken, no=b"plain", locked=raw + b"trailer << /Encrypt 5 0 R >>", null=None)
    got = {}
    for r in pdf.page_texts(objs, tree, found).collect():
        got.setdefault(r.path, {})[r.page] = r.text
    text = "A (b) éc\nSplit gap far\n日\U0001f600ACfl"
    assert got["one"] == {1: text, 2: "1.1 Start ...... 3\nSecond ....... 4", 3: "5-7\n9-9", 4: ""}
    assert got["updated"][2] == "newer" and got["broken"][2] == "" and got["broken"][1] == text
    assert got["no"] == got["locked"] == got["null"] == {1: ""}
    whole = {r.path: r.text for r in pdf.texts(pdf.page_texts(objs, tree, found)).collect()}
    assert whole["one"] == "\n".join(got["one"][k] for k in (1, 2, 3, 4)) and whole["no"] == ""


def test_contents_and_footers(spark):
    objs, tree, found = read(spark, one=one())
    items = pdf.contents(found, pdf.links(objs, tree)).orderBy("item").collect()
    assert [(r.page, r.item, r.section_number, r.title, r.page_code, r.target_page) for r in items] == [(2, 1, "1.1", "Start", "3", 3), (2, 2, "", "Second", "4", 4)]
    codes = pdf.footers(found, tree)
    assert [(r.page, r.code) for r in codes.collect()] == [(3, "5-7")]
    toc = spark.createDataFrame([("one", "5-7", 9)], "doc_id string, toc_page_code string, target_page int")
    got = joins.calibrate(toc, codes.withColumnRenamed("path", "doc_id"), least_count=1)
    assert got.first().target_page == 3


def test_empty(spark):
    objs, tree, found = read(spark, no=b"")
    assert tree.count() == 0 and found.count() == 0 and pdf.links(objs, tree).count() == 0
    assert pdf.page_texts(objs, tree, found).count() == 1
