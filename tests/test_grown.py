"""Cases that larger tables bring: keys beyond what a format holds, groups dealt over many tasks, texts that end in a mark."""

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import fidelity, layout, looks
from quire.plans import catalogue
from quire.sources import markup

from .test_catalogue import rows


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Orders of four lines, whose parts and suppliers have large keys."""
    d = str(tmp_path_factory.mktemp("grown"))
    k = F.col("id")
    lines = spark.range(400).select((k / 4).cast("long").alias("l_orderkey"), (k % 4 + 1).cast("int").alias("l_linenumber"), (k * 4001 + 3).alias("l_partkey"), (k * 151 + 1).alias("l_suppkey"))
    lines.write.parquet(f"{d}/lineitem.parquet")
    return d


def same(spark, d, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
    df, result = catalogue.queries()[name](spark, d), con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns) and sorted(columns) == sorted(df.columns)


def test_a_tables_rows_meet_whatever_its_inputs_are_dealt_by(spark):
    """Both inputs come dealt by the key; tasks that are coalesced apart on each side of a union must not keep a table's rows from meeting."""
    each = spark.range(600).select((F.col("id") / 3).cast("int").alias("t"), (F.col("id") % 3).alias("n"))
    each = each.select("t", (F.row_number().over(W.partitionBy("t").orderBy("n")) - 1).alias("row"))
    cells = each.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("t", "row", "col", F.lit(1).alias("rowspan"), F.lit(5.0).alias("need"))
    out = layout.row_heights(each.select("t", "row", F.lit(1.0).alias("height"), F.lit("atLeast").alias("rule")), cells, key="t")
    steps = out._jdf.queryExecution().executedPlan().toString()
    assert 0 < steps.find("Exchange") < steps.index("Union")
    got = out.collect()
    assert len(got) == 600 and {r.height for r in got} == {5.0}


def test_page_margins_beyond_a_page_are_told_as_written(spark, grown):
    same(spark, grown, "g16_page_setups")


def test_pictures_larger_than_a_jpeg_can_be(spark, grown):
    same(spark, grown, "p18_picture_headers")


def test_a_mark_at_the_end_of_a_text_that_goes_on(spark):
    pairs = spark.createDataFrame([(1, "one two.\nY.", "one two.\nY. and 17 more"), (2, "a\nY. and", "a\nY."), (3, "a\nY.", "a\nZ. and")], "k int, a string, b string")
    got = {r.k: (r.kind, r.source, r.result) for r in fidelity.token_edits(pairs, keys=["k"], source="a", result="b").collect()}
    assert got == {1: ("added", "", "and 17 more"), 2: ("missing", "and", ""), 3: ("changed", "Y .", "and")}


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pictures_are_read_where_their_part_is(spark):
    xml = '<p><drawing><anchor><positionH relativeFrom="page"><align> left </align></positionH><extent cx="360000" cy="720000"/><t><drawing><inline><docPr name="in"/></inline></drawing></t><docPr name="out"/></anchor></drawing><drawing/></p>'
    texts = spark.createDataFrame([("d", "word/document.xml", xml), ("e", "word/document.xml", "<p>")], "key string, part string, xml string")
    out = looks.pictures_of(markup.nodes(texts))
    assert "Exchange" not in steps(out)
    got = sorted(map(tuple, out.collect()), key=lambda r: r[2])
    assert [(r[2], r[3], r[6], r[7]) for r in got] == [(1, "out", 1.0, 2.0), (7, "in", None, None), (11, None, None, None)]
    assert got == sorted(map(tuple, looks.pictures(markup.tree(texts)).collect()), key=lambda r: r[2])


def test_nothing_is_sorted_to_find_what_is_around(spark):
    xml = "<body><p><r><rPr><vanish/></rPr><t>a</t></r><del><r><t>b</t></r></del><r><t>c</t></r></p></body>"
    sheet = "<styles><style styleId='s' type='paragraph'/></styles>"
    out = looks.run_looks(markup.tree(spark.createDataFrame([("d", "word/document.xml", xml), ("d", "word/styles.xml", sheet)], "key string, part string, xml string")))
    assert "Window" not in steps(out) and sorted((r.text, r.hidden) for r in out.collect()) == [("a", True), ("c", None)]
