"""Hand-made edge rows for the cleaning and text functions."""

import pytest
from pyspark.sql import functions as F

from plantwise.functions import cleaning as C
from plantwise.functions import text as T


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_percent_bad_as_zero(spark):
    cases = {"41,65%": 0.4165, " 41.65 % ": 0.4165, "1.234,5": 0.0, "1e2": 0.01 * 100 / 100, "nan": 0.0,
             None: 0.0, "": 0.0, "5d": 0.0, "-3%": -0.03, "+4": 0.04, "\xa085,5%\t": 0.855}
    cases["1e2"] = 1.0
    got = col_values(spark, list(cases), C.percent_fraction)
    assert got == list(cases.values())


def test_percent_bad_as_null(spark):
    got = col_values(spark, ["1.234,5", "nan", None, "85,5%"], lambda c: C.percent_fraction(c, bad_as_zero=False))
    assert got == [None, None, None, 0.855]


def test_percent_is_the_number_over_100(spark):
    # tiny and long values keep their digits
    assert col_values(spark, ["41,7%", "1e-11", "41,123456789012345%"], C.percent_fraction) == [
        41.7 / 100, 1e-11 / 100, 41.123456789012345 / 100]


def test_day_first_date(spark):
    cases = {"03/02/2026": "2026-02-03", "2026-02-03": "2026-02-03", "02/13/2026": "2026-02-13",
             "03/02/26": "2026-02-03", "3-2-2026": "2026-02-03", "x": None, None: None,
             " 5/1/2024 10:00": "2024-01-05", "31/02/2026": None, "2026/2/3": "2026-02-03"}
    got = col_values(spark, list(cases), lambda c: C.day_first_date(c).cast("string"))
    assert got == list(cases.values())


def test_shift_label_and_valid(spark):
    vals = ["1", "1.0", "1.7", "2", "3", " 1", None]
    assert col_values(spark, vals, C.shift_label) == ["Turno A"] * 3 + ["Turno B", None, None, None]
    assert col_values(spark, vals, C.shift_valid) == [True] * 4 + [False] * 3


def test_hour_value(spark):
    assert col_values(spark, ["06:00", "6", "6.5", " 7 ", "21.0", "n/d"], C.hour_value) == [None, 6.0, 6.5, 7.0, 21.0, None]


def test_oee_product_half_even(spark):
    df = spark.createDataFrame([(0.12345, 1.0, 1.0), (0.00005, 1.0, 1.0), (0.12355, 1.0, 1.0)], "a double, p double, q double")
    got = [r[0] for r in df.select(C.oee_product("a", "p", "q", decimals=4)).collect()]
    assert got == [0.1234, 0.0, 0.1236]


def test_weekday_and_names(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string").select(F.to_date("d").alias("d"))
    r = df.select(C.weekday_index("d"), C.day_month_label("d"), C.weekday_name_pt("d")).collect()
    assert [tuple(x) for x in r] == [(0, "01/01", "Segunda-feira"), (6, "07/01", "Domingo")]


MONEY = [("$1.234,56", 1234.56), ("$1,234.56", 1234.56), ("$1.234,567,8", None), ("$1234,5", 1234.5),
         ("$10,", 10.0), ("$,", None), ("$1,234", 1234.0), ("$1,234,567", 1234567.0), ("$250.000", 250000.0),
         ("$0.125", 125.0), ("$1.50", 1.5), ("$1.2345", 1.2345), ("$5.", 5.0), ("$.", None),
         ("$1.234.567", 1234567.0), ("$ 1.234,56", 1234.56), ("$1234.56.", 123456.0)]


@pytest.mark.parametrize("mention,expected", MONEY)
def test_money_parse(spark, mention, expected):
    assert col_values(spark, [mention], T.parse_money) == [expected]


def test_money_parse_array_equals_scalar(spark):
    df = spark.createDataFrame([([m for m, _ in MONEY],)], "a array<string>")
    assert df.select(T.parse_money_array(F.col("a"))).first()[0] == [e for _, e in MONEY]


def test_money_format(spark):
    assert col_values(spark, [1234567.5, 0.004, 0.0, 0.125, 2.675], T.format_brl, "double") == [
        "1.234.567,50", "0,01", "0,00", "0,12", "2,67"]


def test_money_rewrite(spark):
    df = spark.createDataFrame(
        [("Custa $1,234.56. e R$ 5 e $ 10,5 fim", 5.0), ("nada aqui", 5.0), ("$1 $2", 5.0), ("$3 hoje", None),
         ("$3 hoje\n", 2.0), ("$$$ junk", 5.0), ("$x e $7", 0.0)], "t string, r double")
    from plantwise.operators.mentions import rewrite_texts

    got = [r[0] for r in rewrite_texts(df, "t", "r").select("rewritten").collect()]
    assert got == [
        "Custa $1,234.56. e R$ 5 e \\$ 10,5 (R\\$ 52,50) fim\n(valores sem impostos)",
        "nada aqui",
        "\\$1 (R\\$ 5,00) \\$2 (R\\$ 10,00)\n(valores sem impostos)",
        "$3 hoje",
        "\\$3 (R\\$ 6,00) hoje\n(valores sem impostos)",
        "$$$ junk",
        "$x e $7",
    ]


def test_drive_id(spark):
    vals = ["https://x/file/d/ABC/view", "https://x/file/d/ABC?x", "u?id=9&x=1", "https://no.id/"]
    assert col_values(spark, vals, T.drive_id) == ["ABC", "ABC?x", "9", None]


def test_links_and_kinds(spark):
    from plantwise.operators.links import explode_links

    df = spark.createDataFrame([(1, "Veja. LINK DE VÍDEO: http://a.com/x.mp4). Link de Imagem: https://b.org/p#top.png"),
                                (2, "Link de Máquina: https://drive.google.com/file/d/ID3/view?usp=drive_link"),
                                (3, "Link de foto: https://drive.google.com/open?id=ID4&x=1")], "id int, t string")
    rows = explode_links(df, "t", keep=("id",)).select("id", "tag", "url", "media_type", "render_kind", "drive_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "vídeo", "http://a.com/x.mp4", "video", "video", None),
        (1, "imagem", "https://b.org/p#top.png", "image", "image", None),
        (2, "", "https://drive.google.com/file/d/ID3/view?usp=drive_link", "drive", "button", "ID3"),
        (3, "foto", "https://drive.google.com/open?id=ID4&x=1", "drive", "image", "ID4"),
    ]


def test_answer_cleanup_and_row_line(spark):
    got = col_values(spark, ["Links de imagens: - item", "  * ", "LINKS DE IMAGENS texto"], T.answer_cleanup)
    assert got == ["item", None, "texto"]
    df = spark.createDataFrame([("a", " ", None), ("", "b", "c")], "k string, v string, w string")
    assert [r[0] for r in df.select(T.row_line(["k", "v", "w"])).collect()] == ["k: a", "v: b | w: c"]
