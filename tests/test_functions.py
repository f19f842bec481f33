"""Text, numbers and detectors on literal rows, against expected values of our own."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import detectors as D
from quire.functions import geometry as G
from quire.functions import numbers as N
from quire.functions import text as T


def ask(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_and_fold(spark):
    assert ask(spark, ["“x”\xa0–\x07 y\t\tz  ", "a\n\nb", None, ""], T.clean) == ['"x" - y z', "a\n\nb", "", ""]
    assert ask(spark, ["  Ñandú  ÉÀ\n½ ", "ABC", None], T.fold) == ["nandu ea 1⁄2", "abc", ""]


def test_lines(spark):
    pairs = spark.createDataFrame([("inge-", "niería"), ("inge-", "Niería"), ("12-", "x"), ("a-", "b"), ("end", "x")], "p string, n string")
    assert [r[0] for r in pairs.select(T.dehyphenate(F.col("p"), F.col("n"))).collect()] == ["ingeniería", None, None, None, None]
    got = ask(spark, ["• uno", "12) dos", "iv. tres", "1994. no", "plain", "(b) x"], T.list_marker)
    assert [(g["marker"], g["ordered"]) if g else None for g in got] == [("•", False), ("12)", True), ("iv.", True), None, None, ("(b)", True)]
    assert ask(spark, ["2.3.1 Title", "1994 x", "3. y"], T.heading_number) == ["2.3.1", None, "3"]
    assert ask(spark, ["Figura 3", "Tábla 2", "Figure", "grafico. 7"], T.is_caption) == [True, True, False, True]


def test_guesses_and_escapes(spark):
    assert ask(spark, ["#" * 50, "word " * 20, "�" * 5 + "a" * 45, "short"], T.looks_like_garbage) == [True, False, True, False]
    assert ask(spark, ["a|b\\c"], T.escape_md) == ["a\\|b\\\\c"]
    assert ask(spark, ["¡Hola, Señor!", "***", None], T.slugify) == ["hola-senor", "sin-titulo", "sin-titulo"]
    assert ask(spark, ["", "a" * 9], T.token_estimate) == [1, 2]


@pytest.mark.parametrize(
    ("cell", "number"),
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.240", 1.24), ("50%", 50), ("1,234", 1.234), ("1,2,3", 123), ("-7", -7), ("1.2.3", None), ("abc", None), ("", None), ("€ 5", 5), ("x" * 50, None)],
)
def test_coerce(spark, cell, number):
    got = ask(spark, [cell], N.coerce)[0]
    assert got["number"] == number and (got["text"] is None) == (number is not None)


def test_pages_names_sizes(spark):
    specs = spark.createDataFrame([("1-3", 5), ("3-1", 5), ("4-", 5), ("-2", 5), ("9", 5), ("", 2), ("1, 3", 5)], "s string, n int")
    assert [r[0] for r in specs.select(N.selected_pages(F.col("s"), F.col("n"))).collect()] == [[1, 2, 3], [1, 2, 3], [4, 5], [1, 2], [1, 2, 3, 4, 5], [1, 2], [1, 3]]
    assert ask(spark, ["a/b:c", "con", " . ", "x" * 200], N.safe_stem) == ["a_b_c", "_con", "documento", "x" * 120]
    assert ask(spark, [0, 2048, 5 * 1024**3], N.human_size, "long") == ["0 B", "2.0 KB", "5.0 GB"]


def test_sizes_are_rounded_as_printf_does(spark):
    k, g = 1024, 1024**3
    sizes = [1023.5, 0.5, 2.5, 1.25 * k, 1.75 * k, 1.35 * k, 1.05 * k, 1.96875 * k, 1023.96 * k, 1227656.25 * g, 1227656.75 * g, 0.45 * k * k, 3.0, g - 1.0, 9.5e15 * k]
    sizes += [k * (1 + x / 40) for x in range(1, 400)] + [k * (x + 0.05) for x in range(1, 200)]
    unit = lambda d: ("%.0f B", 1) if d < k else ("%.1f KB", k) if d < k * k else ("%.1f MB", k * k) if d < g else ("%.1f GB", g)
    assert ask(spark, sizes, N.human_size, "double") == [unit(d)[0] % (d / unit(d)[1]) for d in sizes]


DETECTED = {
    "email": (["a.b@c.org"], ["a@b"]),
    "phone": (["+34 600 123 456"], ["12,50 30,00 45,75", "192.168.10.25"]),
    "iban": (["ES91 2100 0418 4502 0005 1332"], ["ES9"]),
    "card": (["4111 1111 1111 1111"], ["4111 1111 1111 1112"]),
    "url": (["https://x.org/a"], ["http:/x"]),
    "ip": (["10.0.0.255"], ["10.0.0.256"]),
    "id_fiscal": (["12345678Z"], ["1234Z"]),
    "serial": (["SIE-4520B"], ["A-B"]),
    "coord": (["40.41678, -3.70379"], ["40.4, 3.7"]),
}


@pytest.mark.parametrize("kind", DETECTED)
def test_detectors(spark, kind):
    d = next(x for x in D.DETECTORS if x.name == kind)
    yes, no = DETECTED[kind]
    hits = lambda c: F.filter(F.regexp_extract_all(c, F.lit(d.pattern), F.lit(0)), d.valid)
    assert ask(spark, [f"see {y} now" for y in yes], hits) == [[y] for y in yes]
    assert ask(spark, [f"see {n} now" for n in no], hits) == [[] for _ in no]


@pytest.mark.parametrize("pattern", [D.PROPER, D.ACRONYM, D.PATTERNS["phone"], D.PATTERNS["serial"]])
def test_matches_have_their_places(spark, pattern):
    texts = ["Javier Ortega met ABB-7710 in Málaga. Call 600 123 456 or MOD.88-X", "ÉL no", "", None, "tel 91 123 45 67x"]
    got = ask(spark, texts, lambda c: D.matches(c, D.unicode(pattern)))
    assert [[(m["start"], m["hit"]) for m in g] for g in got] == [[(m.start(), m[0]) for m in re.finditer(pattern, t or "")] for t in texts]


def test_overlap(spark):
    row = spark.sql("SELECT 0D x0, 0D top, 10D x1, 10D bottom, 5D b_x0, 0D b_top, 15D b_x1, 10D b_bottom")
    got = row.select(G.overlap_ratio(G.box(), G.box("b_")), G.overlaps(G.box(), G.box("b_"))).first()
    assert tuple(got) == (0.5, True)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 99))
def test_numbers_round_trip(spark, whole, cents):
    es = f"{whole:,}".replace(",", ".") + f",{cents:02d}"
    en = f"{whole:,}.{cents:02d}"
    if whole >= 1000:
        assert [g["number"] for g in ask(spark, [es, en], N.coerce)] == [whole + cents / 100] * 2
