"""Scan, redaction, layout, tables, rasters and sinks on literal rows."""

import re
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import detectors as D
from quire.operators import layout as L
from quire.operators import raster as R
from quire.operators import redact, scan
from quire.operators import tables as G
from quire.plans import catalogue
from quire.sinks import render as W
from quire.sources import markdown, terms, tsv

from .conftest import SF

PAGES = [
    ("d", 1, "ACME Manual\nWrite to Ana.Ruiz@acme.org. Talleres Muñoz S.L. is here.\nfoot line one"),
    ("d", 2, "ACME Manual\nana.ruiz@acme.org again; Javier Ortega called.\nfoot line one"),
    ("d", 3, "ACME Manual\nTALLERES MUNOZ  S.L. and Javier Ortega.\nfoot line one"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc string, page long, text string")


def test_scan(spark, pages):
    got = {(r["kind"], r["text"]): r for r in scan.scan(pages).collect()}
    assert got["email", "Ana.Ruiz@acme.org"]["count"] == 2 and got["email", "Ana.Ruiz@acme.org"]["pages"] == [1, 2]
    assert got["encabezado", "ACME Manual"]["suggested"] and got["encabezado", "foot line one"]["count"] == 3
    assert any(k == "empresa" for k, _ in got) and ("nombre", "Javier Ortega") in got
    assert scan.scan(pages.limit(0)).count() == 0


def test_scan_counts_names_as_a_plain_loop_does(spark, pages):
    want = sorted(m[0] for _, _, t in PAGES for m in re.finditer(D.PROPER, t))
    got = sorted(r["hit"] for r in pages.select(F.explode(D.matches(F.col("text"), D.unicode(D.PROPER))).alias("m")).select("m.hit").collect())
    assert got == want


def test_styles(spark, pages):
    rules = redact.build_rules(terms=["Talleres Muñoz S.L."], detectors=["email"])
    texts = lambda style: [r["text"] for r in pages.orderBy("page").select(redact.scrub(F.col("text"), rules, style).alias("text")).collect()]
    masked = texts("mask")
    assert "[OCULTO]. is here" in masked[0] and "[OCULTO]. and" in masked[2] and "@" not in "".join(masked)
    hashed = texts("hash")
    assert len(set(re.findall(r"\[REF:[0-9A-F]{6}\]", " ".join(hashed)))) == 2
    assert "Write to " in texts("remove")[0] and "[" not in "".join(texts("remove"))
    assert redact.leaks(pages, ["talleres munoz"]).where("size(leaked) > 0").count() == 2  # accents and case aside


def test_labels_follow_first_appearance(spark, pages):
    rules = redact.build_rules(terms=["Talleres Muñoz S.L."], detectors=["email"], patterns=["Javier Ortega", "(broken"])
    out, entities = redact.label(pages, rules)
    texts = [r["text"] for r in out.orderBy("page").collect()]
    # Rules run one after the other on each page: the term is met before the address.
    assert "[CONFIDENCIAL_1]. is here" in texts[0] and "[EMAIL_2]." in texts[0]
    assert "[EMAIL_2] again; [CONFIDENCIAL_3] called" in texts[1] and "[CONFIDENCIAL_1]. and [CONFIDENCIAL_3]." in texts[2]
    rows = redact.report(entities).orderBy("rank").collect()
    assert sorted(r["count"] for r in rows) == [2, 2, 2] and rows[0]["label"] == "[CONFIDENCIAL_1]"


def test_label_matches_a_sequential_loop(spark):
    """Another document and page for every text, numbered by a plain Python loop."""
    docs = [("a", 1, "x@y.org 10.0.0.1 x@y.org"), ("a", 2, "10.0.0.1. then 4111 1111 1111 1111"), ("b", 1, "4111 1111 1111 1111"), ("b", 2, ""), ("c", 1, "nothing")]
    kinds = ["card", "email", "ip"]
    rules = redact.build_rules(detectors=kinds)
    want, seen, numbers = {}, {}, {}
    for doc, page, text in docs:
        for kind in kinds:
            def token(m, doc=doc, kind=kind):
                key = (doc, m[0].lower())
                if key not in seen:
                    numbers[doc] = numbers.get(doc, 0) + 1
                    seen[key] = f"[{kind.upper()}_{numbers[doc]}]"
                return seen[key]

            text = re.sub(D.PATTERNS[kind], token, text)
        want[doc, page] = text
    out, _ = redact.label(spark.createDataFrame(docs, "doc string, page long, text string"), rules)
    assert {(r["doc"], r["page"]): r["text"] for r in out.collect()} == want


def test_group_lines_is_a_fold(spark):
    words = [(1, "b", 20.0, 0.4, 30.0, 10.4), (1, "a", 0.0, 0.0, 10.0, 10.0), (1, "c", 0.0, 14.0, 10.0, 24.0), (1, "d", 40.0, 3.0, 50.0, 13.0)]
    df = spark.createDataFrame(words, "page long, text string, x0 double, top double, x1 double, bottom double")
    assert [r["text"] for r in L.group_lines(df, ["page"]).orderBy("line_no").collect()] == ["a b d", "c"]


def test_a_median_between_two_sizes_is_cut_to_their_decimals(spark):
    rows = [("a", 1, 10.0, "x" * 12, 0.0, 10.0), ("a", 2, 11.5, "x" * 12, 13.1, 23.1), ("a", 3, 10.0, "x", 26.0, 36.0), ("b", 1, 10.0, "x", 0.0, 10.0), ("b", 2, 11.5, "x", 13.1, 23.1)]
    lines = spark.createDataFrame(rows, "k string, line_no int, size double, text string, top double, bottom double")
    bodies = lambda *d: [r["body"] for r in L.body_size(lines, ["k"], *d).orderBy("k").collect()]
    # DuckDB: quantile_cont(size, 0.5) over DECIMAL(3,1) 10.0 and 11.5 is 10.7.
    assert bodies() == [10.75, 10.75] and bodies(1) == [10.7, 10.7]
    assert [r["gap"] for r in L.median_gap(lines, ["k"], 1).orderBy("k").collect()] == [3.0, 3.1]


def test_tables(spark):
    grid = [["A", "B", ""], ["1", "x\ny", ""], ["", "", ""], ["2", "z", ""]]
    df = spark.createDataFrame([(grid,)], "rows array<array<string>>")
    r = df.select(G.clean_grid(F.col("rows")).alias("g")).select("g", G.quality(F.col("g")).alias("q"), G.looks_like_header(F.col("g")).alias("h"), G.to_markdown(F.col("g"), F.lit(True)).alias("m")).first()
    assert r["g"] == [["A", "B"], ["1", "x y"], ["2", "z"]] and r["q"] == 1.0 and r["h"]
    assert r["m"] == "| A | B |\n|---|---|\n| 1 | x y |\n| 2 | z |"
    empty = spark.createDataFrame([([],), (None,)], "rows array<array<string>>").select(G.clean_grid(F.col("rows")).alias("g"))
    assert [x["g"] for x in empty.collect()] == [[], []]


def test_suppression_keeps_the_first(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 9.0, 9.0), (20.0, 0.0, 30.0, 10.0)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<x0:double,top:double,x1:double,bottom:double>>")
    assert [tuple(x) for x in df.select(G.suppress(F.col("b")).alias("k")).first()["k"]] == [boxes[0], boxes[2]]


def test_whitespace_table(spark):
    line = lambda i, cells: (1, i, [(t, x, x + 5.0 * len(t)) for t, x in cells], 0.0, 12.0 * i, 300.0, 12.0 * i + 10)
    rows = [line(i, [(f"n{i}", 0.0), (f"{i}.5", 120.0), ("ok", 240.0)]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "page long, line_no long, words array<struct<text:string,x0:double,x1:double>>, x0 double, top double, x1 double, bottom double")
    got = G.whitespace_tables(df, ["page"]).collect()
    assert len(got) == 1 and got[0]["rows"] == [[f"n{i}", f"{i}.5", "ok"] for i in range(1, 5)] and got[0]["confidence"] == 1.0


def test_components_and_merging(spark):
    cells = [(1, 0, 0), (1, 1, 1), (1, 5, 5), (1, 5, 6), (1, 6, 7)]
    got = R.components(spark.createDataFrame(cells, "k long, y long, x long"), "k").orderBy("component").collect()
    assert [r["cells"] for r in got] == [2, 3]
    boxes = [(0.0, 0.0, 5.0, 5.0, 1.0), (10.0, 0.0, 15.0, 5.0, 2.0), (100.0, 0.0, 110.0, 5.0, 1.0)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<x0:double,top:double,x1:double,bottom:double,ink:double>>")
    assert [tuple(x) for x in df.select(R.merge_close(F.col("b")).alias("m")).first()["m"]] == [(0.0, 0.0, 15.0, 5.0, 2.0), boxes[2]]


def test_sources(spark):
    assert terms.from_lines(["# c", "re: a+", "det:email", "det:card", " Acme ", ""]) == terms.Terms(("Acme",), ("a+",), ("card", "email"))
    review = '{"candidatos": [{"texto": "x", "tipo": "email"}, {"texto": "Acme", "tipo": "marca"}, {"texto": "n", "elegido": false}], "patrones": ["b"]}'
    assert terms.from_review(review) == terms.Terms(("Acme",), ("b",), ("email",))
    sheet = "\t".join(tsv.COLUMNS) + "\n5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t91\tHola\n5\t1\t1\t1\t1\t2\t50\t20\t30\t10\t20\tx\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\nbroken"
    df = spark.createDataFrame([(1, sheet)], "doc_id long, tsv string")
    assert [r["text"] for r in tsv.words(df).collect()] == ["Hola"] and tsv.mean_confidence(df).first()["mean_conf"] == 55.5
    md = spark.createDataFrame([(1, "# T\n```\n- no\n```\n- yes\n| a | b |\n\ntext")], "doc_id long, text string")
    assert [r["class"] for r in markdown.parse(md).orderBy("line_no").collect()] == ["heading", "fence", "code", "fence", "ul", "table", "blank", "paragraph"]


def test_rendering(spark):
    rows = [
        ("d", 1, 1, "block", "heading", 1, "", False, 0, "Title", None, None, None, None),
        ("d", 1, 2, "block", "list_item", 0, "•", False, 0, "• one", None, None, None, None),
        ("d", 1, 3, "block", "list_item", 0, "2)", True, 1, "2) two", None, None, None, None),
        ("d", 1, 4, "table", None, 0, "", False, 0, "", [["a", "b"], ["1", "<2"]], True, None, None),
        ("d", 2, 5, "image", None, 0, "", False, 0, "", None, None, "m/p.png", "Cap"),
    ]
    e = spark.createDataFrame(rows, "doc string, page long, element_no long, type string, kind string, level int, marker string, ordered boolean, indent int, text string, rows array<array<string>>, has_header boolean, path string, caption string")
    md = W.documents_md(e).first()["md"]
    assert md == "<!-- pagina 1 -->\n\n# Title\n\n- one\n  1. two\n\n| a | b |\n|---|---|\n| 1 | <2 |\n\n<!-- pagina 2 -->\n\n![Cap](m/p.png)\n"
    titled = spark.createDataFrame([("d", "Title page")], "doc string, title string")
    assert W.documents_md(e, titled).first()["md"] == md
    assert "<ul><li>one</li></ul><ol><li>two</li></ol>" in W.documents_html(e).first()["html"]
    assert "a\tb\n\n1\t<2" in W.documents_txt(e).first()["txt"]
    assert spark.range(1).select(W.embedded(F.array(F.lit(5), F.lit(9), F.lit(4)), 10).alias("e")).first()["e"] == [True, False, True]


def test_every_query_runs_and_has_a_stable_schema(spark):
    """The registered queries over the smallest tables; those with an oracle are compared by the driver."""
    for name, q in catalogue.queries().items():
        df = q(spark, SF)
        assert len(set(df.columns)) == len(df.columns), name
        start = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        assert time.monotonic() - start < 60, name
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.queries()["scan_candidates"](spark, SF).count() > 0


def test_markdown_spans_fields_and_paragraphs(spark):
    from quire.sources import markdown as M

    text = "---\ntitle: 'A b'\nlang: es\n---\n# H\none `x **y**` and\n  **two** [l](u)\n\nthree\n---\n"
    lines = M.parse(spark.createDataFrame([(1, text), (2, "plain\n---"), (3, None)], "doc_id long, text string")).cache()
    assert [(r["name"], r["value"]) for r in M.front_matter(lines).orderBy("name").collect()] == [("lang", "es"), ("title", "A b")]
    got = [(r["doc_id"], r["line_no"], r["text"]) for r in M.paragraphs(lines).orderBy("doc_id", "line_no").collect()]
    assert got[1:] == [(1, 6, "one `x **y**` and **two** [l](u)"), (1, 9, "three"), (2, 1, "plain")]
    spans = lines.where("doc_id = 1 AND line_no IN (6, 7)").orderBy("line_no").select(M.spans(F.col("line")).alias("s")).collect()
    assert [tuple(x) for r in spans for x in r["s"]] == [("code", "x **y**"), ("bold", "two"), ("link", "l")]


def test_a_candidate_keeps_its_first_three_contexts(spark):
    from quire.operators import scan as S

    pages = spark.createDataFrame([("d", p, f"write to a@b.org, page {p}") for p in range(9, 0, -1)], "doc string, page long, text string")
    (r,) = S.gather(S.detector_hits(pages, ["email"])).collect()
    assert r["count"] == 9 and r["pages"] == list(range(1, 10)) and [s[-1] for s in r["samples"]] == ["1", "2", "3"]


def test_stream(spark, tmp_path):
    from quire.streaming import drop_folder

    spark.createDataFrame([("d", 1, "a@b.org")], drop_folder.PAGES).write.parquet(str(tmp_path / "in"))
    q = drop_folder.redact_stream(drop_folder.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ("email",))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "[OCULTO]"
