"""Workbooks, documents, slides and taxonomies from files that the tests write."""

import zipfile
from xml.sax.saxutils import escape

from tidewire.sources import office

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as whole:
        for name, text in parts.items():
            whole.writestr(name, text)


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def workbook(path, sheets):
    """A workbook; texts are shared, numbers are not, every third text is inline."""
    shared, parts = [], {"xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = rels(**{f"r{i}": f"worksheets/s{i}.xml" for i in range(len(sheets))})
    for i, rows in enumerate(sheets.values()):
        out = []
        for y, row in enumerate(rows, 1):
            cells = ""
            for x, value in enumerate(row):
                place = f"{chr(65 + x)}{y}"
                if isinstance(value, (int, float)):
                    cells += f'<c r="{place}"><v>{value}</v></c>'
                elif value is not None and x % 3 == 2:
                    cells += f'<c r="{place}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                elif value is not None:
                    shared.append(value)
                    cells += f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'
            out.append(f'<row r="{y}">{cells}</row>')
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet><sheetData>{''.join(out)}</sheetData></worksheet>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>"
    packed(path, parts)


def test_sources_of_a_workbook(spark, tmp_path):
    head = ["Источник", "Группа", "Тип", "Ссылка", "Рейтинг источника", None, "Роль в дайджесте", "Покрываемые направления", "Частота мониторинга"]
    workbook(tmp_path / "a.xlsx", {"Other": [["x"]], "Sources": [head, ["  One ", "G", "Telegram channel", "t.me/x", 2.5, "no name", None, "D1"], [None, "nameless"], ["Two", None, None, " ", "high"], [], ["One", "G & H", "News", "http://one.org", "3", None, "R", "", "daily"]]})
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    rows = office.workbook_rows(spark, str(tmp_path))
    assert [r.error is not None for r in rows.where("sheet IS NULL").collect()] == [True]
    got = {r.name: tuple(r)[1:] for r in office.source_seeds(office.sheet_records(rows, "Sources")).collect()}
    assert got == {"One": ("News", "http://one.org", True, "rss", "G & H | R", "daily", 3.0), "Two": ("Unknown", None, True, "rss", None, None, 1.0)}


def test_directions_and_keywords(spark, tmp_path):
    directions = [["ID", "Направление RU", "Direction EN", "Что покрывает"], ["D1", "Бурение", "Drilling", "wells"], ["", "none"], ["D2", None, "Safety"]]
    keywords = [["ID направления", "Ключевые слова RU", "Keywords EN"], ["D1", "бур; скважина\nБУР", "drill;;well"]]
    workbook(tmp_path / "a.xlsx", {"D": directions, "K": keywords})
    rows = office.workbook_rows(spark, str(tmp_path))
    got = sorted(tuple(r) for r in office.direction_tags(office.sheet_records(rows, "D"), office.sheet_records(rows, "K")).collect())
    assert got == [("Safety", "Safety", None, [], [], 12), ("Бурение", "Drilling", "wells", ["бур", "скважина"], ["drill", "well"], 10)]


TAXONOMY = """# All tags

## 1. First topic

**Описание для AI**
What it
covers.

**Ключевые слова RU**
бур, скважина,
ГРП

**Keywords EN**
drill, well

**Стоп-слова**
—

---

## 2. Second
**Описание для AI**
Short.

**Keywords EN**
x

**Стоп-слова**
war, spam
"""


def test_taxonomy_and_seed(spark, tmp_path):
    (tmp_path / "t.md").write_text(TAXONOMY)
    seeds = office.taxonomy(spark, str(tmp_path / "t.md"))
    rows = sorted(tuple(r) for r in seeds.collect())
    assert rows == [(1, "First topic", "What it covers.", ["бур", "скважина", "ГРП"], ["drill", "well"], []), (2, "Second", "Short.", [], ["x"], ["war", "spam"])]
    old = spark.createDataFrame([("Second", "My own", ["a"], ["X", "y"], None, 7, True), ("Gone", "old", [], None, [], 3, True), ("Off", None, None, None, None, 1, False)], "name string, description string, keywords array<string>, keywords_en array<string>, negative_keywords array<string>, sort_order int, enabled boolean")
    got = {r.name: r for r in office.seeded_tags(old, seeds).collect()}
    assert (got["Second"].description, got["Second"].keywords_en, got["Second"].sort_order, got["Second"].enabled) == ("My own", ["X", "y"], 7, True)
    assert got["First topic"].enabled and got["First topic"].sort_order == 1 and got["Gone"].enabled and not got["Off"].enabled
    retired = {r.name: r.enabled for r in office.seeded_tags(old, seeds, retire=True).collect()}
    assert retired == {"Second": True, "First topic": True, "Gone": False, "Off": False}


def test_anchors(spark, tmp_path):
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{escape(r)}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("One ", "block") + p(" ") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl>" + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p><w:sectPr/>"
    packed(tmp_path / "a.docx", {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
    shape = lambda t: f"<p:sp><p:txBody>{''.join(f'<a:p><a:r><a:t>{x}</a:t></a:r></a:p>' for x in t)}</p:txBody></p:sp>"
    slide = lambda inner: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    packed(tmp_path / "b.pptx", {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="2" r:id="b"/><p:sldId id="1" r:id="a"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(a="slides/slide1.xml", b="/ppt/slides/slide2.xml"),
        "ppt/slides/slide1.xml": slide(""), "ppt/slides/slide2.xml": slide(shape(["Head", "line"]) + f"<p:grpSp>{shape(['inner'])}</p:grpSp>" + table), "ppt/slides/_rels/slide2.xml.rels": rels(n="../notesSlides/n1.xml"), "ppt/notesSlides/n1.xml": slide(shape(["note"])),
    })
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04broken")
    packed(tmp_path / "d.docx", {"other.xml": "<x/>"})
    rows = sorted((r.path[-6:], r.kind, r.number, r.text, r.error is not None) for r in office.document_anchors(spark, str(tmp_path)).collect())
    assert rows == [
        ("a.docx", "docx", 1, "One block", False), ("a.docx", "docx", 2, "a | b\nc |", False), ("a.docx", "docx", 3, "x\ty\nz", False), ("b.pptx", "pptx", 1, "Head\nline\ninner\nk | v\nnote", False), ("b.pptx", "pptx", 2, "", False),
        ("c.docx", None, None, None, True), ("d.docx", None, None, None, True),
    ]
