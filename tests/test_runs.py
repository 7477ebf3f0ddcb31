"""Runs that come with what is around them: held against the walk over interval-numbered elements; what a query writes of markup."""

import io
import random
import zipfile

import duckdb
from pyspark.sql import functions as F

from quire.operators import looks as L
from quire.plans import catalogue
from quire.sources import markup, tables

from .test_catalogue import rows
from .test_looks import W, paragraph, run, styled

LOOKS = ("key", "seq", "text", "hidden", "underline", "scale", "effects", "rtl")
WORD_2010 = 'xmlns:v="http://schemas.microsoft.com/office/word/2010/wordml"'


def both(spark, packages):
    """What the two readers tell of (key, document, styles)."""
    texts = spark.createDataFrame(packages, "key string, document string, styles string")
    parts = [(k, p, x) for k, d, s in packages for p, x in ((markup.BODY, d), (markup.SHEET, s)) if x is not None]
    tree = markup.tree(spark.createDataFrame(parts, "key string, part string, xml string"))
    told = lambda df: sorted((tuple(r[c] for c in LOOKS) for r in df.collect()), key=lambda r: r[:2])
    return told(L.run_looks_of(texts)), told(L.run_looks(tree.cache()))


def body(x):
    return f'<w:document xmlns:w="{W}" {WORD_2010}><w:body>{x}</w:body></w:document>'


def sheet(x):
    return f'<w:styles xmlns:w="{W}">{x}</w:styles>'


def test_odd_markup_against_numbered_elements(spark):
    late = '<w:p><w:r><w:t>before</w:t></w:r><w:pPr><w:pStyle w:val="h"/><w:pStyle w:val="n"/></w:pPr></w:p>'
    twice = '<w:p><w:r><w:rPr><w:u/></w:rPr><w:t>a</w:t><w:rPr><w:u w:val="words"/><w:vanish w:val="OFF"/><w:vanish/></w:rPr><w:t>b<w:x/>c</w:t><w:t><!-- - -->d<![CDATA[<e>]]>&amp;</w:t></w:r></w:p>'
    effects = "".join(paragraph(None, run(f"e{k}", x)) for k, x in enumerate(("<v:glow/>", "<v:rStyle w:val='c'/>", "<w:bdr/>", "<w:bdr w:val='nil'/>", "<w:outline w:val='0'/><w:shadow/>", "<w:fitText/>", "<w:w w:val='9x'/>", "<w:w/><w:w w:val='50'/>", "<w:rStyle/><w:rStyle w:val='c'/>", "<w:rPrChange><w:rPr><w:vanish/></w:rPr></w:rPrChange>", "<w:u w:val='a' v:val='dotDash'/>")))
    inside = f"<w:p><w:pPr><w:pStyle w:val='h'/></w:pPr><w:r><w:rPr><w:w w:val='70'/></w:rPr><w:t>out</w:t><w:pict><w:p><w:r><w:rPr><w:rtl/></w:rPr><w:t>in</w:t></w:r></w:p></w:pict><w:t>side</w:t><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:r><w:moveFrom><w:p><w:r><w:t>gone</w:t></w:r></w:p></w:moveFrom><w:r><w:t/></w:r><w:r/><w:r><w:t> \t</w:t></w:r></w:p><w:r><w:t>bare</w:t></w:r>"
    look = styled("h", None, "<w:vanish/>") + styled("c", "h", '<w:u w:val="wave"/>') + styled("n", None, "", 'w:type="paragraph" w:default="on"')
    packages = [("odd", body(late + twice + effects + inside), sheet(look)), ("same sheet", body(late), sheet(look)), ("no sheet", body(late + twice), None), ("broken sheet", body(late), "<a"), ("broken", "<w:p>", sheet(look)), ("typed", "<!DOCTYPE a><p><r><t>x</t></r></p>", None), ("none", None, sheet(look)), ("plain", "<p xmlns=''><r><t>x<!--<!DOCTYPE--></t></r></p>", None), ("empty", "", "")]
    got, want = both(spark, packages)
    assert got == want and len(want) > 20 and {r[0] for r in want} == {"odd", "same sheet", "no sheet", "broken sheet", "plain"}
    told = {r[2]: r[3:] for r in got if r[0] == "odd"}
    assert told["before"] == (True, None, None, None, False) and told["abd<e>&"][:2] == (False, "single") and told["outside"] == (True, None, 70, None, False) and told["in"][4] and "gone" not in told


def test_grown_markup_against_numbered_elements(spark):
    rng = random.Random(4)
    tags = ("p", "r", "r", "t", "t", "rPr", "pPr", "pStyle", "rStyle", "vanish", "u", "del", "x", "w", "em")

    def grown(depth):
        tag = rng.choice(tags)
        inner = "".join(grown(depth + 1) for _ in range(rng.randrange(0, 5) if depth < 8 else 0))
        return f"<w:{tag}" + (f' w:val="{rng.choice(("s1", "s2", "0", "90"))}"' if rng.random() < 0.6 else "") + f">{rng.choice(('', 'a', 'b '))}{inner}{rng.choice(('', 'z'))}</w:{tag}>"

    sheets = [sheet(styled("s1", "s2", "<w:vanish/>") + styled("s2", None, "<w:em/>")), sheet(styled("s1", None, "<w:u/>", 'w:type="paragraph" w:default="1"')), None]
    packages = [(f"k{i:02}", body("".join(f"<w:p>{grown(0)}<w:r>{grown(1)}<w:t>{i}</w:t></w:r></w:p>" for _ in range(12))), sheets[i % 3]) for i in range(30)]
    got, want = both(spark, packages)
    assert got == want and len(want) > 400


def test_runs_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(markup, "RUNS", 7)
    texts = spark.createDataFrame([(i, i * 10, body(paragraph(None, *(run(f"{i}.{j}") for j in range(i * 3))))) for i in range(9)], "key int, other int, xml string").repartition(1)
    got = markup.runs(texts)
    assert got.columns == ["key", "other", "seq", "text", "style", "said"]
    assert sorted((r.key, r.other, r.text) for r in got.collect()) == sorted((i, i * 10, f"{i}.{j}") for i in range(9) for j in range(i * 3))
    assert markup.runs(texts.limit(0)).count() == 0


def test_looks_of_orders_write_only_sheets_that_differ(spark, tmp_path, monkeypatch):
    """Documents' elements are not written, and a sheet that many have is read once; results are those of SQL."""
    k = F.col("id")
    lines = spark.range(1200).select((k / 4).cast("long").alias("l_orderkey"), (k % 4 + 1).cast("int").alias("l_linenumber"), (k * 4001 + 3).alias("l_partkey"), (k * 151 + 1).alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"{tmp_path}/shared")
    df = catalogue.queries()["v7_look_features"](spark, str(tmp_path))
    got = rows(df.collect(), df.columns)
    of_markup = spark.read.parquet(f"{tmp_path}/shared/quire/markup-*")
    assert of_markup.select("part").distinct().collect() == [("word/styles.xml",)] and of_markup.where("tag = 'styles'").count() == 4
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    result = con.execute(catalogue.oracle_sql()["v7_look_features"])
    assert got == rows(result.fetchall(), [c[0] for c in result.description])


def test_bodies_of_packages(spark):
    def zipped(**parts):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            for n, x in parts.items():
                z.writestr(f"word/{n}.xml", x)
        return made.getvalue()

    files = spark.createDataFrame([("a", zipped(document="<d/>", styles="<s/>")), ("b", zipped(document="<d/>")), ("c", zipped(styles="<s/>")), ("d", b"no package"), ("e", None)], "key string, content binary")
    assert sorted(map(tuple, markup.bodies(files).collect())) == [("a", "<d/>", "<s/>"), ("b", "<d/>", None)]
