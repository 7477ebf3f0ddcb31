"""Interval-numbered markup: nearest elements around, looks through chains of styles, cells of table styles, pictures."""

import io
import random
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from quire.operators import looks as L
from quire.operators import sections
from quire.sources import markup

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def tree(spark, **parts):
    rows = [("d", {"document": "word/document.xml", "styles": "word/styles.xml"}.get(k, k), x) for k, x in parts.items()]
    return markup.tree(spark.createDataFrame(rows, "key string, part string, xml string"))


def test_intervals_and_broken_texts(spark):
    rows = tree(spark, a="<a x='1' y='2'>one<b/>two<c xmlns='u'><d>é&amp;</d></c></a>", b="<a>", c="", d="<!DOCTYPE a><a/>", e="<z/>").orderBy("part", "pre").collect()
    assert [(r.part, r.pre, r.last, r.up, r.space, r.tag, r.attrs, r.text) for r in rows] == [
        ("a", 0, 3, None, "", "a", {"x": "1", "y": "2"}, "one"), ("a", 1, 1, 0, "", "b", {}, None), ("a", 2, 3, 0, "u", "c", {}, None), ("a", 3, 3, 2, "u", "d", {}, "é&"), ("e", 0, 0, None, "", "z", {}, None)]


def test_nearest_element_around_against_a_walk(spark):
    rng = random.Random(2)

    def grown(depth):
        x = ET.Element(rng.choice("pqr"))
        for _ in range(rng.randrange(0, 4) if depth < 7 else 0):
            x.append(grown(depth + 1))
        return x

    texts = {f"t{i}": grown(0) for i in range(8)}
    want, n = {}, 0
    for part, root in texts.items():
        count = iter(range(10_000))

        def walk(x, near):
            here = next(count)
            want[part, here] = near
            for y in x:
                walk(y, here if x.tag == "p" else near)

        walk(root, None)
    rows = tree(spark, **{p: ET.tostring(x, "unicode") for p, x in texts.items()})
    got = {(r.part, r.pre): r.near for r in markup.within(rows, F.col("tag") == "p", "near", F.col("pre")).collect()}
    assert got == want and len(want) > 60


def run(text, look=""):
    return f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}<w:t>{text}</w:t></w:r>"


def paragraph(style, *runs):
    return f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}<w:rPr><w:vanish/></w:rPr></w:pPr>{''.join(runs)}</w:p>"


def styled(name, base=None, look="", more=""):
    return f'<w:style w:styleId="{name}" {more}>' + (f'<w:basedOn w:val="{base}"/>' if base else "") + (f"<w:rPr>{look}</w:rPr>" if look else "") + "</w:style>"


def test_looks_follow_styles(spark):
    sheet = styled("n0", None, '<w:vanish/><w:u w:val="words"/>') + "".join(styled(f"n{i}", f"n{i - 1}") for i in range(1, 45)) + styled("plain", "n3", '<w:vanish w:val="0"/>')
    sheet += styled("a", "b", "<w:outline/>") + styled("b", "a") + styled("usual", None, '<w:w w:val="90"/>', 'w:type="paragraph" w:default="1"') + styled("ch", None, '<w:w w:val="100"/>')
    box = f"<w:r><w:txbxContent>{paragraph('n1', run('boxed'))}</w:txbxContent><w:t>holder</w:t></w:r>"
    body = paragraph("n44", run("deep")) + paragraph("plain", run("shown"), run("again", "<w:vanish/>")) + paragraph("b", run("ring")) + paragraph(None, run("narrow"), run("usual", '<w:rStyle w:val="ch"/>'), box)
    body += f"<w:del>{paragraph('n0', run('gone'))}</w:del>" + paragraph("lost", run("x", '<w:rtl/><w:bdr w:val="none"/>'), run("  ", "<w:vanish/>"))
    rows = tree(spark, document=f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', styles=f'<w:styles xmlns:w="{W}"><w:docDefaults><w:rPrDefault><w:rPr><w:em w:val="dot"/></w:rPr></w:rPrDefault></w:docDefaults>{sheet}</w:styles>')
    got = {r.text: (r.hidden, r.underline, r.scale, r.effects, r.rtl) for r in L.run_looks(rows.cache()).collect()}
    assert got == {
        "deep": (True, "words", None, True, False), "shown": (False, "words", None, True, False), "again": (True, "words", None, True, False), "ring": (None, None, None, True, False), "narrow": (None, None, 90, True, False),
        "usual": (None, None, 100, True, False), "holder": (None, None, 90, True, False), "boxed": (True, "words", None, True, False), "x": (None, None, None, True, True),
    }
    told = {(r.feature, r.text) for r in L.look_features(rows).where("feature in ('hidden', 'scale', 'rtl')").collect()}
    assert told == {("hidden", "deep"), ("hidden", "again"), ("hidden", "boxed"), ("scale", "narrow"), ("scale", "holder"), ("rtl", "x")}


def test_a_package_without_styles(spark):
    rows = tree(spark, document=f'<w:document xmlns:w="{W}"><w:body>{paragraph("n1", run("a"), run("b", "<w:vanish/>"))}</w:body></w:document>')
    assert sorted((r.text, r.hidden) for r in L.run_looks(rows).collect()) == [("a", None), ("b", True)]


def test_cells_of_one_row_are_corners(spark):
    every = {r: r for r in L.REGIONS}
    styles = spark.createDataFrame([(1, r, "fill", v) for r, v in every.items()] + [(1, "firstRow", "bold", "yes")], "style int, region string, property string, value string")
    cells = spark.createDataFrame([("t", r, c, {"fill": "own"} if (r, c) == (2, 1) else {}) for r in range(4) for c in range(3)] + [("u", 0, 0, {})], "table_id string, row int, col int, own map<string,string>")
    look = {"firstRow": "1", "lastRow": "true", "firstColumn": "on", "lastColumn": "0"}
    tables = spark.createDataFrame([("t", 1, 4, 3, "0600", look), ("u", 1, 1, 1, "01E0", {})], "table_id string, style int, rows int, cols int, v string, own map<string,string>")
    tables = tables.select("table_id", "style", "rows", "cols", L.look_flags(F.col("v"), F.col("own")).alias("look"))
    got = {(r.table_id, r.row, r.col, r.property): r.value for r in L.cell_looks(cells, tables, styles).collect()}
    assert {k[1:3]: v for k, v in got.items() if k[0] == "t" and k[3] == "fill"} == {
        (0, 0): "nwCell", (0, 1): "firstRow", (0, 2): "firstRow", (1, 0): "firstCol", (1, 1): "wholeTable", (1, 2): "wholeTable", (2, 0): "firstCol", (2, 1): "own", (2, 2): "wholeTable",
        (3, 0): "swCell", (3, 1): "lastRow", (3, 2): "lastRow"}
    assert got["t", 0, 1, "bold"] == "yes" and got["u", 0, 0, "fill"] == "swCell" and ("t", 1, 1, "bold") not in got


def test_pictures_in_and_beside_the_line(spark):
    inner = '<extent cx="{0}" cy="720000"/><docPr name="" descr="d"/><srcRect l="10000" t="x" r="-5"/><xfrm rot="-5400000"/>'
    anchor = f'<drawing><anchor behindDoc="1" distT="36000" distB="99999999"><positionV relativeFrom="line"><align>top</align></positionV><positionH relativeFrom="elsewhere"><align>left of</align><posOffset> 180000 </posOffset></positionH>{inner.format("x")}</anchor></drawing>'
    rows = tree(spark, document=f"<body><p><drawing><inline>{inner.format(36000)}</inline></drawing></p>{anchor}<drawing/></body>")
    one, two, three = sorted(L.pictures(rows).collect(), key=lambda r: r.seq)
    assert (one.name, one.alt, one.width_cm, one.height_cm, one.crop.left, one.crop.right, one.rotation, one.flip_h, one.placement) == (None, "d", 0.1, 2.0, 0.1, 0.0, 270.0, False, None)
    p = two.placement
    assert (two.width_cm, p.wrap, p.vertical_from, p.vertical_align, p.horizontal_from, p.horizontal_align, p.horizontal_cm, p.distance_top_cm, p.distance_bottom_cm, p.allow_overlap) == (None, "behind", "line", "top", None, None, 0.5, 0.1, None, True)
    assert three.alt is None and three.crop is None and three.placement is None


def test_features_of_packages_tell_hidden_styles(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{paragraph("s2", run("out of sight"))}<w:sdt><w:sdtPr><w:text/></w:sdtPr><w:sdtContent/></w:sdt></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styled("s1", None, "<w:vanish/>")}{styled("s2", "s1")}</w:styles>')
    files = spark.createDataFrame([("a", made.getvalue()), ("b", b"no package")], "key string, content binary")
    assert {(r.key, r.feature, r.text) for r in L.features(files).collect()} == {("a", "hidden", "out of sight"), ("a", "content_control", "")}


def test_page_setups_and_styles_of_odd_packages(spark):
    sect = '<w:sectPr><w:pgSz w:w="x" w:h="5"/><w:pgMar w:top="-1134" w:bottom="99999" w:left=""/><w:cols w:num="many"/><w:pgNumType w:start="-1" w:fmt="words"/></w:sectPr>'
    rows = tree(spark, document=f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr>{sect}</w:pPr></w:p><w:p/><w:sectPr><w:type w:val="evenPage"/><w:pgSz w:w="16838" w:h="11906"/><w:cols w:num="11"/></w:sectPr></w:body></w:document>').cache()
    one, two = sections.page_setups(rows).orderBy("section").collect()
    assert (one.last, one.start, one.size, one.orientation, one.width_mm, one.top, one.bottom, one.left, one.columns, one.number_start, one.number_format) == (False, "evenPage", None, "portrait", None, 2.0, None, None, None, None, None)
    assert (two.last, two.start, two.size, two.orientation, two.width_mm, two.columns) == (True, None, "A4", "landscape", 297.0, None)
    assert [tuple(r) for r in sections.style_systems(rows).collect()] == [("d", "Table", "spaceAfterPt", "0")]
    ring = f'<w:style w:type="paragraph" w:default="1" w:styleId="a"><w:name w:val="Normal"/><w:basedOn w:val="b"/><w:rPr><w:i/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="b"><w:name w:val="QUOTE"/><w:basedOn w:val="a"/><w:pPr><w:ind w:hanging="567" w:start="1134"/></w:pPr><w:rPr><w:sz w:val="25"/><w:color w:val="auto"/></w:rPr></w:style>'
    got = {(r.target, r.property): r.value for r in sections.style_systems(tree(spark, styles=f'<w:styles xmlns:w="{W}">{ring}</w:styles>')).collect()}
    assert {p: v for (t, p), v in got.items() if t == "Quote"} == {"italic": "true", "fontSizePt": "12.5", "indentLeftCm": "2", "firstLineIndentCm": "-1"}
    assert {p: v for (t, p), v in got.items() if t == "List"} == {"italic": "true", "fontSizePt": "12.5"} and ("Heading 1", "italic") not in got
