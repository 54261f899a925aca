"""Worked examples for text, money and page functions."""

import pytest
from pyspark.sql import functions as F

from tasador.functions import money, text
from tasador.operators import features, pages, reports, selection
from tasador.schema import RAW_LISTINGS


def one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression(F.col("v"))).first()[0]


def extracted(spark, basic, extra=None, legacy=False):
    row = (1, "t", "Actur", 100, basic, extra)
    df = spark.createDataFrame([row], RAW_LISTINGS)
    return features.extract_features(df, legacy=legacy).first().asDict()


@pytest.mark.parametrize(
    "basic, expected",
    [
        ("90 m² construidos, 80 m² útiles", {"m2_construidos": 90, "m2_utiles": 80}),
        ("1.200 m² construidos", {"m2_construidos": 200, "m2_utiles": None}),
        ("90 m² construidos", {"m2_construidos": 90}),
        ("1 habitación; 2 baños", {"habitaciones": 1, "banos": 2}),
        ("3 habitaciones; 1 baño", {"habitaciones": 3, "banos": 1}),
        ("Sin habitación", {"habitaciones": None}),
        ("Planta 2ª exterior", {"planta_numero": 2, "Exterior": 1, "Interior": 0}),
        ("Bajo exterior", {"planta_numero": None}),
        ("planta 2", {"planta_numero": None}),
        ("Construido en 1975", {"ano_construccion": 1975}),
        ("x; Calefacción individual: Gas; y", {"Calefacción": "individual: Gas"}),
        ("No dispone de calefacción", {"Calefacción": "sin calefacción"}),
        ("Segunda mano/para reformar", {"estado_vivienda": "Segunda mano/Para reformar"}),
        ("Promoción de obra nueva", {"estado_vivienda": "Obra nueva"}),
        ("armario empotrado", {"armarios_empotrados": 0}),
        (
            "Orientación oeste",
            {"orientacion_este": 1, "orientacion_oeste": 1, "orientacion_norte": 0, "orientacion_sur": 0},
        ),
    ],
)
def test_features(spark, basic, expected):
    found = extracted(spark, basic)
    assert {k: found[k] for k in expected} == expected


def test_features_of_missing_text(spark):
    found = extracted(spark, None)
    assert found["Calefacción"] == "sin calefacción" and found["estado_vivienda"] is None
    assert found["trastero"] == found["Exterior"] == found["orientacion_este"] == found["piscina"] == 0
    assert not {"Titulo", "Caracteristicas_basicas", "Caracteristicas_extra"} & set(found)


def test_legacy_features(spark):
    found = extracted(spark, "Armario empotrado; terraza; Promoción de obra nueva", legacy=True)
    assert found["armarios_empotrados"] == 1 and found["terraza"] == 0
    assert found["estado_vivienda"] == "Promoción de obra nueva"


def test_word_boundary_tells_west_from_east(spark):
    df = spark.createDataFrame([("Orientación oeste",), ("al este",)], "t string")
    got = features.keyword_flags(df, "t", {"este": ["este"]}, word_boundary=True).collect()
    assert [r["este"] for r in got] == [0, 1]


def test_prices_and_places(spark):
    assert one(spark, pages.price_value, "185.000 €") == 185000
    assert one(spark, pages.price_value, " 185.000€ ") == 185000
    assert one(spark, pages.price_value, "consultar") is None
    assert one(spark, pages.location_name, "Actur, Zaragoza") == "Actur"
    assert one(spark, lambda c: money.price_per_area(F.lit(100000), c), 0, "int") is None
    assert one(spark, lambda c: money.price_per_area(F.lit(100000), c), 50, "int") == 2000


def test_items(spark):
    html = '<div class="a details"><div><ul><li> a </li><li>b</li></ul></div></div><li>c</li>'
    assert one(spark, lambda c: pages.list_items_joined(c, "details"), html) == "a; b"
    assert one(spark, lambda c: pages.list_items_joined(c, "details"), '<div class="details"></div>') is None
    assert one(spark, lambda c: pages.list_items_joined(c, "other"), html) is None


@pytest.mark.parametrize(
    "html, expected",
    [
        ('<span class="x">a<span>b</span>c</span>d', "abc"),
        ('<span class="x">a<b>b</b></span><span>d</span>', "ab"),
        ('<span class="y x z">a &amp; b', "a & b"),
        ('<SPAN CLASS="x">a</SPAN>', "a"),
        ('<span class="xx">a</span>', None),
        ('<span class="x"></span>', ""),
        ('<span class="x"><span><span>a</span></span></span>b</span>', "a"),
        (None, None),
    ],
)
def test_element_text(spark, html, expected):
    assert one(spark, lambda c: pages.element_text(c, "span", "x"), html) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a &amp; b &eacute;", "a & b é"),
        ("&#8364;&#x1F600;", "€😀"),
        ("&nope; & &amp", "&nope; & &amp"),
        ("&#xD800;&#0;", "&#xD800;&#0;"),
        ("it&apos;s &quot;x&quot;", "it's \"x\""),
    ],
)
def test_entities(spark, raw, expected):
    assert one(spark, text.unescape_entities, raw) == expected


def test_attributes(spark):
    assert one(spark, lambda c: pages.attribute(c, "src"), "<img alt='' src=\"a'b?x=1&amp;y\">") == "a'b?x=1&y"
    assert one(spark, lambda c: pages.attribute(c, "src"), "<img data-src='a'>") is None


def test_strip_accents(spark):
    assert one(spark, text.strip_accents, "Ñandú é ﬁn Ấ") == "Nandu e fin A"
    assert one(spark, text.strip_accents, "90 ㎡… ™ № 𝐀") == "90 m2... TM No A"
    assert one(spark, text.strip_accents, "plain") == "plain"
    assert one(spark, text.strip_accents, "") == ""
    assert one(spark, text.strip_accents, None) is None


@pytest.mark.parametrize(
    "html",
    [
        '<span data-class="txt-bold">WRONG</span><span class="txt-bold">1</span>',
        "<span class=txt-bold>1</span>",
        "<span id=a class='big txt-bold'>1</span>",
        '<span class="txt-bolder">no</span><span class="a txt-bold b">1</span>',
    ],
)
def test_class_is_an_attribute_of_its_own(spark, html):
    assert one(spark, lambda c: pages.element_text(c, "span", "txt-bold"), html) == "1"


def test_unquoted_attribute(spark):
    assert one(spark, lambda c: pages.attribute(c, "src"), "<img src=a.png alt=x>") == "a.png"


def test_lists(spark):
    assert one(spark, text.split_list, "Actur, ,Centro ") == ["Actur", "Centro"]
    assert one(spark, text.split_list, None) == []
    assert one(spark, text.parse_id_list, "[3, 7]") == [3, 7]


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        (180000.0, "price", "180.000 €"),
        (1234.5, "price", "1.234.5 €"),
        (90.0, "area", "90 m²"),
        (None, "area", "No definido"),
        (2.0, "plain", "2"),
        (2.675, "plain", "2.67"),
    ],
)
def test_number_formats(spark, value, kind, expected):
    shown = one(spark, lambda c: reports.format_preference(c, kind), value, "double")
    assert shown == f"<strong>{expected}</strong>"


def test_text_formats(spark):
    shown = one(spark, lambda c: reports.format_preference(c, "text"), "aire_acondicionado,terraza")
    assert shown == "<strong>Aire Acondicionado, Terraza</strong>"
    assert "7 días" in one(spark, reports.membership_text, "Prueba gratuita")
    assert "Plan Mensual</strong>" in one(spark, reports.membership_text, " Plan Mensual ")
    assert one(spark, reports.membership_text, "Oro") is None


def test_selected_answers(spark):
    answers = [" TRUE ", "1", "Yes", "sí", "No", None]
    got = [one(spark, reports.is_selected, a) for a in answers]
    assert got == [True, True, True, False, False, False]


@pytest.mark.parametrize(
    "price, diff, minimum, maximum, shown",
    [
        (100000.0, 20000.0, 100000, 110000, "\\num{100000} - \\num{110000} €"),
        (99000.0, 0.0, 100000, 100000, "\\num{100000} €"),
    ],
)
def test_price_interval(spark, price, diff, minimum, maximum, shown):
    df = spark.createDataFrame([(price, diff)], "Precio double, Diferencia_Ponderada double")
    row = money.with_price_interval(df).first()
    assert (row["minimo"], row["maximo"], row["intervalo"]) == (minimum, maximum, shown)


def test_estimate_rounds_half_to_even(spark):
    assert one(spark, lambda c: money.rounded_estimate(c, F.lit(20000.0)), 105000.0, "double") == 120000


@pytest.mark.parametrize(
    "place, price, expected",
    [
        ("Actur", 179999, 5399.97),
        ("Actur", 180000, 1800),
        ("Actur", 1500000, 15000),
        ("Actur", 1500001, 0),
        ("Ranillas", 149999, 7499.95),
        ("Ranillas", 150000, 4500),
        ("Delicias", 149999, 14999.9),
        ("Delicias", 150000, 10500),
        ("Actur", -5, 0),
        (None, 100000, 10000),
    ],
)
def test_thresholds(spark, place, price, expected):
    df = spark.createDataFrame([(place, price)], "Localizacion string, Precio long")
    assert selection.with_threshold(df).first()["Umbral"] == pytest.approx(expected)


def test_selection_keeps_the_boundary_and_drops_unscored(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 5.0, 5.0), (3, 4.9, 5.0)], "id int, d double, u double")
    kept = selection.select_opportunities(df, "d", "u").collect()
    assert [r["id"] for r in kept] == [2]


def test_first_block_is_dropped_without_cover(spark):
    begin, end = "\\begin{tcolorbox}", "\\end{tcolorbox}"
    tex = f"a{begin}x{end}b{begin}y{end}c"
    assert one(spark, lambda c: reports.drop_block(c, F.lit(True)), tex) == f"ab{begin}y{end}c"
    assert one(spark, lambda c: reports.drop_block(c, F.lit(False)), tex) == tex
    assert one(spark, lambda c: reports.drop_block(c, F.lit(True)), "plain") == "plain"
