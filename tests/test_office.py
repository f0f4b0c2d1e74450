"""Office packages with what real ones hold: merged cells, styles, gaps, dates, broken files."""

import io
import zipfile

import pytest

from quillgrid.sources import packages, sheets, slides, word

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml_rels", ".xml.rels").replace("_xml", ".xml"), xml)
    return held.getvalue()


def packed(spark, tmp_path, suffix, **files):
    """Written to disk and read back as binary files."""
    for name, raw in files.items():
        (tmp_path / f"{name}{suffix}").write_bytes(raw)
    return packages.files(spark, f"file://{tmp_path}/*{suffix}")


def named(rows, *columns):
    return {r.path.rsplit("/", 1)[-1].split(".")[0]: r for r in rows} if not columns else sorted(tuple(r[c] if c != "path" else r.path.rsplit("/", 1)[-1].split(".")[0] for c in columns) for r in rows)


def p(text, style=""):
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"


STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="a"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Sub"><w:name w:val="Heading"/><w:basedOn w:val="1"/></w:style>
<w:style w:type="character" w:styleId="b"><w:name w:val="heading 9"/></w:style></w:styles>"""


def doc(body):
    return archive(word__document_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", word__styles_xml=STYLES)


def test_word(spark, tmp_path):
    tc = lambda inner, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{inner}</w:tc>"
    table = "<w:tbl><w:tr>" + tc(p("wide"), '<w:gridSpan w:val="2"/>') + tc(p("tall"), '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + tc(p(" a ") + p("b")) + tc(p(" ")) + tc(p(""), "<w:vMerge/>") + "</w:tr></w:tbl>"
    link = "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>tab</w:t><w:br/><w:t>line</w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"
    one = doc(p("1.2 First", "1") + p("  ") + p("text &amp; more") + link + table + p("Second", "Sub") + p("none", "unknown"))
    files = packed(spark, tmp_path, ".docx", one=one, empty=doc(""), broken=b"no archive", half=one[: len(one) // 2])
    rows = word.parts(files).cache()
    got = {k: r.text for k, r in named(word.texts(rows).collect()).items()}
    assert got == {"one": "1.2 First\ntext & more\nlink\ttab\nline\nSecond\nnone\nwide | wide | tall\na \nb | tall", "empty": "", "broken": None, "half": None}
    heads = word.paragraphs(rows).filter("level is not null").collect()
    assert named(heads, "path", "n", "text", "level") == [("one", 0, "1.2 First", 1), ("one", 3, "Second", 1)]
    pages = word.paged(word.paragraphs(rows), 20)
    own = named(word.virtual_pages(pages).collect(), "path", "page", "text")
    assert own == [("one", 1, "1.2 First\ntext & more"), ("one", 2, "link\ttab\nline\nSecond"), ("one", 3, "none")]
    items = word.contents(pages).orderBy("item").collect()
    assert [(r.title, r.section_number) for r in items] == [("First", "1.2"), ("Second", "2")]
    assert items[0].page_start == 1 and items[0].page_end == items[1].page_start - 1 and items[1].page_end == len(own)
    assert word.texts(word.parts(files.limit(0))).count() == 0


def book(body, strings="", styles="", old=""):
    return archive(
        xl__workbook_xml=f'<workbook xmlns:r="{REL}"><workbookPr {old}/><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        xl___rels__workbook_xml_rels='<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        xl__worksheets__s_xml=f"<worksheet><sheetData>{body}</sheetData></worksheet>", xl__sharedStrings_xml=f"<sst>{strings}</sst>", xl__styles_xml=f"<styleSheet>{styles}</styleSheet>",
    )


STYLE = '<numFmts><numFmt numFmtId="170" formatCode="&quot;day&quot; yyyy"/><numFmt numFmtId="171" formatCode="&quot;d&quot; 0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_workbook(spark, tmp_path):
    v = lambda ref, value, more="": f'<c r="{ref}" {more}><v>{value}</v></c>'
    body = "<row>" + v("A1", 0, 't="s"') + v("C1", 0, 't="s"') + "</row><row>" + v("A2", 1) + v("B2", 2.5) + v("C2", 1, 't="b"') + v("AA2", 36526.5, 's="1"') + "</row><row>" + v("A4", 3) + v("B4", 4) + v("C4", "#DIV/0!", 't="e"') + v("AA4", 7, 's="2"') + "</row>"
    one = book(body, "<si><r><t>na</t></r><r><t>me</t></r></si>", STYLE)
    files = packed(
        spark, tmp_path, ".xlsx", one=one, none=book(""), broken=b"PK", old=book("<row>" + v("A1", 0, 's="1"') + "</row>", "", STYLE, 'date1904="1"'),
        narrow=book("<row><c><v>1</v></c></row><row/><row r='3'><c r='A3'><v>2.0</v></c></row>"), ints=book("<row><c t='str'><v>a</v></c><c t='str'><v>b</v></c></row><row><c><v>1</v></c><c><v>0.5</v></c></row><row><c><v>2</v></c><c><v>1e20</v></c></row>"),
    )
    rows = sheets.parts(files).cache()
    got = {k: r.text for k, r in named(sheets.texts(rows).collect()).items()}
    gaps = ["nan"] * 23
    heads = ["name", "Unnamed: 1", "name.1", *[f"Unnamed: {k}" for k in range(3, 27)]]
    lines = [heads, ["1.0", "2.5", "True", *gaps, "2000-01-01 12:00:00"], ["nan"] * 27, ["3.0", "4.0", "#DIV/0!", *gaps, "7"]]
    assert got["one"] == "\n=== Sheet: S ===\n\n" + "\n".join(" | ".join(x) for x in lines)
    assert got["none"] == "\n=== Sheet: S ===\n\n" and got["broken"] is None
    assert got["old"].endswith("\n1904-01-01 00:00:00") and got["narrow"].endswith("\n1\n2")
    assert got["ints"].endswith("a | b\n1.0 | 0.5\n2.0 | 1.0E20")
    assert sheets.read_sheet(rows, "S").count() == 4 + 1 + 1 + 2 + 3 and sheets.read_sheet(rows, "x").count() == 0


def test_deck(spark, tmp_path):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    t = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r><a:br/><a:fld><a:t>1</a:t></a:fld></a:p>"
    slide = lambda inner: f"<p:sld {ns}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>{t('x')}</a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    one = archive(
        ppt__presentation_xml=f'<p:presentation {ns} xmlns:r="{REL}"><p:sldIdLst><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:sldIdLst></p:presentation>',
        ppt___rels__presentation_xml_rels='<Relationships><Relationship Id="a" Target="slides/s1.xml"/><Relationship Id="b" Target="slides/s2.xml"/></Relationships>',
        ppt__slides__s1_xml=slide(""), ppt__slides__s2_xml=slide(table + f"<p:sp><p:txBody>{t('one')}{t('two')}</p:txBody></p:sp><p:grpSp><p:sp><p:txBody>{t('no')}</p:txBody></p:sp></p:grpSp>"),
    )
    rows = slides.parts(packed(spark, tmp_path, ".pptx", one=one, broken=b"PK")).cache()
    got = {k: r.text for k, r in named(slides.texts(rows).collect()).items()}
    assert got == {"one": "\n=== Slide 1 ===\n\none\x0b1\ntwo\x0b1\nx\x0b1\n\n=== Slide 2 ===\n", "broken": None}
    assert named(slides.slide_counts(rows).collect(), "path", "slides") == [("one", 2)]
    at = lambda k: {n: r.text for n, r in named(slides.read_slide(rows, k).collect()).items()}["one"]
    assert at(0).startswith("one") and at(1) is None and at(2) is None and at(-1) is None


@pytest.mark.parametrize("raw", [b"", None, b"PK\x03\x04"])
def test_unreadable(spark, raw):
    rows = word.parts(spark.createDataFrame([("x", raw)], "path string, content binary"))
    assert [r.path for r in packages.broken(rows).collect()] == ["x"]


def test_readers_by_suffix(spark, tmp_path):
    from quillgrid.sources import readers

    (tmp_path / "a.docx").write_bytes(doc(p("one")))
    (tmp_path / "b.xlsx").write_bytes(book("<row><c t='str'><v>h</v></c></row>"))
    (tmp_path / "c.txt").write_text("plain")
    assert readers.read_file(spark, f"file://{tmp_path}/a.docx").first().text == "one"
    assert readers.read_file(spark, f"file://{tmp_path}/b.xlsx").first().text.endswith("h")
    assert readers.read_file(spark, f"file://{tmp_path}/c.txt").first().text == "plain"
    with pytest.raises(ValueError):
        readers.read_file(spark, f"file://{tmp_path}/d.doc")
