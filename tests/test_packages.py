"""Word packages: what is read, what is broken or unsafe in them, and what they have that is not shown."""

import io
import zipfile

from quire.operators import fidelity
from quire.sources import docx, packages

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def package(body, rels="", notes="", styles=""):
    files = {
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{R}" xmlns:m="{M}" xmlns:a="{A}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>',
    }
    if notes:
        files["word/footnotes.xml"] = f'<w:footnotes xmlns:w="{W}">{notes}</w:footnotes>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return made.getvalue()


def run(text, look=""):
    return f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}<w:t>{text}</w:t></w:r>"


LINK = f'<Relationship Id="rId1" Type="{R}/hyperlink" Target="https://example.org/a" TargetMode="External"/>'


def test_links_changes_fields_and_equations_are_read():
    body = f'<w:p>{run("see ")}<w:hyperlink r:id="rId1">{run("this")}{run(" page")}</w:hyperlink><w:ins>{run(" new")}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:moveFrom>{run("away")}</w:moveFrom></w:p>'
    body += f'<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{run("7")}<w:r><w:fldChar w:fldCharType="end"/></w:r><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></w:p>'
    body += f'<w:sdt><w:sdtPr/><w:sdtContent><w:p>{run("held")}</w:p></w:sdtContent></w:sdt>'
    got = docx.read(package(body, LINK, f'<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="1"><w:p>{run(" a note ")}</w:p></w:footnote>'))
    assert [(e["type"], e["content"]) for e in got] == [("paragraph", "see this page new"), ("paragraph", "7(a)/(b)"), ("paragraph", "held"), ("footnote", "a note")]
    assert got[0]["links"] == [{"start": 4, "end": 13, "href": "https://example.org/a"}]


def test_merged_and_nested_cells_are_read_and_written():
    inner = f"<w:tbl><w:tr><w:tc><w:p>{run('in')}</w:p></w:tc></w:tr></w:tbl>"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"
    rows = [cell("a", '<w:vMerge w:val="restart"/>') + cell("b", '<w:gridSpan w:val="2"/>'), cell("", "<w:vMerge/>") + cell("c") + f"<w:tc><w:p>{run('d')}</w:p>{inner}</w:tc>", cell("e") + cell("f") + cell("g")]
    got = docx.read(package("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"))
    cells = got[0]["cells"]
    assert [tuple(c.values()) for c in cells] == [(0, 0, 1, 2, "a"), (0, 1, 2, 1, "b"), (1, 1, 1, 1, "c"), (1, 2, 1, 1, "d\nin"), (2, 0, 1, 1, "e"), (2, 1, 1, 1, "f"), (2, 2, 1, 1, "g")]
    assert docx.read(docx.write(got))[0]["cells"] == cells


def test_broken_unsafe_and_special_packages(spark):
    body = f'<w:p><w:pPr><w:pStyle w:val="Lost"/></w:pPr><w:hyperlink r:id="rId9">{run("x")}</w:hyperlink>{run("secret", "<w:vanish/>")}{run("shown", "<w:vanish w:val=&quot;0&quot;/>".replace("&quot;", chr(34)))}{run("wide", "<w:w w:val=#150#/>".replace("#", chr(34)))}</w:p>'
    body += '<w:p><w:pPr><w:pStyle w:val="Known"/><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr><w:bookmarkStart w:id="1"/><w:bookmarkStart w:id="1"/><w:r><w:instrText> INCLUDETEXT "c:/x" </w:instrText></w:r><w:r><w:instrText> PAGE </w:instrText></w:r></w:p>'
    body += f'<w:sdt><w:sdtPr><w:text/></w:sdtPr><w:sdtContent><w:p>{run("field")}</w:p></w:sdtContent></w:sdt><w:del>{run("gone", "<w:vanish/>")}</w:del><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/chart"/>'
    rels = LINK + f'<Relationship Id="rId2" Type="{R}/hyperlink" Target="javascript:x" TargetMode="External"/><Relationship Id="rId3" Type="{R}/image" Target="http://far/a.png" TargetMode="External"/>'
    files = spark.createDataFrame([("a", package(body, rels, styles='<w:style w:styleId="Known"/>')), ("b", b"no"), ("c", package(f"<w:p>{run('plain')}</w:p>"))], "key string, content binary")
    rows = packages.nodes(files).cache()
    assert [(r.key, r.problem) for r in rows.where("problem is not null").collect()] == [("b", "not a zip")]
    assert sorted(tuple(r) for r in packages.broken(rows).collect()) == [("a", "list", "3", 1), ("a", "relationship", "rId9", 1), ("a", "style", "Lost", 1), ("a", "twice bookmarkStart", "1", 2)]
    assert {tuple(r) for r in packages.unsafe(rows).collect()} == {("a", 1, 1, 1), ("c", 0, 0, 0)}
    told = {r.feature: (r.n, r.example) for r in fidelity.findings(packages.features(rows), ["key"]).collect()}
    assert told == {"hidden": (1, "e.g. “secret”"), "scale": (1, "e.g. “wide”"), "content_control": (1, "e.g. “field”"), "chart": (1, None), "tracked": (1, None)}
