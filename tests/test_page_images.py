"""Page images drawn here: a ruled grid with words, a block of ink, leaning lines."""

import numpy as np

from quire.operators import page_images as P
from quire.sinks import convert, office


def drawn():
    g = np.full((300, 400), 255, np.uint8)
    g[0, 0] = 60  # the threshold is the lightest dark value, which itself isn't ink
    for y in (50, 80, 110, 140):
        g[y, 40:361] = 0
    for x in (40, 140, 260, 360):
        g[50:141, x] = 0
    words = [(f"c{i}{j}", x + 5.0, 60.0 + 30 * i, x + 30.0, 70.0 + 30 * i) for i in range(3) for j, x in enumerate((40, 140, 260))]
    return g, words


SCHEMA = "doc string, page long, width int, height int, scale double, gray binary, words array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>"


def page(no, gray, words=(), scale=1.0):
    return ("d", no, gray.shape[1], gray.shape[0], scale, bytearray(gray.tobytes()), list(words))


def test_the_limit_of_dark_is_the_best_of_all():
    for seed in range(20):
        g = np.random.default_rng(seed).choice([3, 40, 90, 200, 250], (9, 9))
        spread = {}
        for t in range(256):
            dark, light = g[g <= t], g[g > t]
            if len(dark) and len(light):
                spread[t] = round(len(dark) * len(light) * (dark.mean() - light.mean()) ** 2, 6)
        assert spread[P.dark_limit(g.astype(np.uint8))] == max(spread.values())
    assert P.dark_limit(np.full((4, 4), 9, np.uint8)) == 0


def test_long_runs_are_those_of_every_row():
    ink = np.random.default_rng(1).random((30, 50)) < 0.7
    want = []
    for y, row in enumerate(ink):
        x = 0
        while x < 50:
            end = x
            while end < 50 and row[end]:
                end += 1
            want += [(y, x, end - 1)] if end - x >= 4 else []
            x = end + 1
    assert list(zip(*map(list, P.long_runs(ink, 4)), strict=True)) == want


def test_ruled_table_and_second_readings(spark):
    g, words = drawn()
    blank = np.full((60, 60), 255, np.uint8)
    df = spark.createDataFrame([page(1, g, words), page(2, g), page(3, blank, words), page(4, g, words[:-1])], SCHEMA)
    got = {r["page"]: r for r in P.ruled_tables(df).collect()}
    want = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    assert set(got) == {1, 4} and got[1]["rows"] == want and got[1]["confidence"] == 1.0
    assert (got[1]["x0"], got[1]["top"], got[1]["x1"], got[1]["bottom"]) == (40.0, 50.0, 360.0, 140.0)
    assert got[4]["rows"][2] == ["c20", "c21", ""]
    again = spark.createDataFrame([("d", 4, 3, 3, "| 7,5 |"), ("d", 4, 1, 1, "other")], "doc string, page long, i int, j int, text string")
    got = {r["page"]: r["rows"] for r in P.ruled_tables(df, again).collect()}
    assert got[4] == [want[0], want[1], ["c20", "c21", "7,5"]] and got[1] == want
    drawing = again.select("doc", "page", "i", "j").selectExpr("*", "'/\\\\~~|' AS text")
    assert P.ruled_tables(df.where("page = 4"), drawing).first()["rows"][2][2] == ""


def test_figures_lie_outside_text_and_tables(spark):
    drawing = np.full((300, 400), 255, np.uint8)
    drawing[0, 0], drawing[200:270, 100:220] = 60, 0
    word = [("text", 100.0, 200.0, 220.0, 270.0)]
    df = spark.createDataFrame([page(1, drawing), page(2, drawing, word), page(3, np.full((300, 400), 255, np.uint8))], SCHEMA)
    (f,) = P.figures(df).collect()
    assert f["page"] == 1 and abs(f["x0"] - 100) <= 6 and abs(f["bottom"] - 270) <= 6 and f["ink"] > 0.5
    tables = spark.createDataFrame([("d", 1, 90.0, 190.0, 400.0, 300.0)], "doc string, page long, x0 double, top double, x1 double, bottom double")
    assert P.figures(df, tables).count() == 0
    assert P.crop(drawing, 1.0, 100, 200, 220, 270).shape == (78, 128) and P.crop(drawing, 1.0, 0, 0, 9, 9).shape == (13, 13)


def test_leaning_pages_are_made_level(spark):
    g = np.full((400, 400), 255, np.uint8)
    g[0, 0] = 60
    for y in range(40, 360, 20):
        for x in range(20, 380):
            g[int(y - (x - 200) * np.tan(np.radians(1.5))), x] = 0
    blank = np.full((60, 60), 255, np.uint8)
    got = {r["page"]: r for r in P.prepared(spark.createDataFrame([page(1, g), page(2, blank)], SCHEMA)).collect()}
    assert abs(got[1]["angle"] - 1.5) <= 0.25 and got[2]["angle"] == 0 and bytes(got[2]["gray"]) == blank.tobytes()
    assert P.lean(np.frombuffer(got[1]["gray"], np.uint8).reshape(400, 400)) == 0


def test_sheets_and_conversion(spark, tmp_path):
    names = spark.createDataFrame([("d", 1, "A/b"), ("d", 2, "a-B"), ("e", 1, "")], "doc string, ordinal int, name string")
    assert [r["sheet"] for r in office.unique_names(names).orderBy("doc", "ordinal").collect()] == ["A-b", "a-B_2", "Hoja"]
    tables = spark.createDataFrame([("d", 1, 1, [["x", "1,5"], ["y"]], "native", 0.987)], "doc string, page long, table_no long, rows array<array<string>>, source string, confidence double")
    assert tuple(office.index_sheet(tables).first()) == ("d", "p1_t1", 1, 2, 2, "native", 0.99)
    assert [r["number"] for r in office.cells(tables).orderBy("row", "column").collect()] == [None, 1.5, None, None]
    from quire.operators.redact import build_rules

    e = spark.createDataFrame([("d", 1, 1, "block", "paragraph", 0, "", False, 0, "Acme was here", None, None, None, None)], "doc string, page long, element_no long, type string, kind string, level int, marker string, ordered boolean, indent int, text string, rows array<array<string>>, has_header boolean, path string, caption string")
    done = convert.convert(e, str(tmp_path), ("md", "nope", "json"), build_rules(terms=["acme"]), terms=["acme"])
    assert done["nope"].startswith("unknown") and "[OCULTO] was here" in spark.read.parquet(done["md"]).first()["content"]
