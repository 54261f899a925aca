"""Operators against literal re-tellings of their rules, small limits forcing the large-scale paths."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasador.operators import incremental, matching, reports, stats
from tasador.plans.joins import checked_join, salted_join
from tasador.plans.lineage import cut_lineage, path_exists, scratch
from tasador.plans.quantiles import exact_quantiles
from tasador.sources import files, outbox

LISTING = (
    "id long, Localizacion string, Precio double, m2_utiles double, planta_numero int, habitaciones int, "
    "banos int, Exterior int, terraza int, estado_vivienda string"
)
CLIENT = (
    "id long, precio_min double, precio_max double, m2_min double, m2_max double, planta_min double, "
    "planta_max double, habitaciones_min double, `baños_min` double, exterior int, extras string, "
    "estados_vivienda string, barrios_interes string"
)


def _rows(spark, schema, dicts):
    names = [part.split()[0].strip("`") for part in schema.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


HOME = {
    "Localizacion": "Actur", "Precio": 100000.0, "m2_utiles": 80.0, "habitaciones": 3, "banos": 1,
    "Exterior": 0, "terraza": 1, "estado_vivienda": "Obra nueva",
}
# what differs from HOME, what the client asks for, whether they match, and with quirks
CASES = [
    ({}, {}, True, False),
    ({}, {"planta_min": 1.0}, False, False),
    ({"planta_numero": 1}, {"planta_min": 1.0}, True, False),
    ({}, {"exterior": 0}, True, False),
    ({}, {"extras": "terraza,helipuerto"}, True, False),
    ({"terraza": 0}, {"extras": "terraza"}, False, False),
    ({"Precio": None}, {}, True, False),
    ({"Precio": None}, {"precio_max": 1.0}, False, False),
    ({"Precio": 0.5}, {"precio_max": 1.0}, True, False),
    ({"Localizacion": None}, {}, True, False),
    ({"Localizacion": None}, {"barrios_interes": "a"}, False, False),
    ({}, {"barrios_interes": "CT, zz", "estados_vivienda": "OBRA NUEVA"}, True, True),
    ({}, {"barrios_interes": "ctu", "estados_vivienda": "obra"}, False, False),
    ({}, {"barrios_interes": "r", "estados_vivienda": "Obra nueva", "exterior": 0}, True, False),
    ({"Localizacion": "Fernando"}, {"estados_vivienda": "Obra nueva"}, True, True),
    ({}, {"precio_min": 200000.0, "precio_max": 100000.0}, False, False),
]


@pytest.mark.parametrize("quirks", [False, True])
def test_preferences(spark, quirks):
    homes = _rows(spark, LISTING, [{**HOME, **home, "id": i} for i, (home, *_) in enumerate(CASES)])
    people = _rows(spark, CLIENT, [{**wish, "id": i} for i, (_, wish, *_) in enumerate(CASES)])
    found = {tuple(r) for r in matching.match_preferences(homes, people, quirks).collect()}
    for i, (home, wish, *expected) in enumerate(CASES):
        assert ((i, i) in found) == expected[quirks], (home, wish)


def _suits(home, wish):
    (_, place, price, area, level, rooms, baths, outside, terrace, state) = home
    bounds = [(price, wish[1], wish[2]), (area, wish[3], wish[4]), (level, wish[5], wish[6]),
              (rooms, wish[7], None), (baths, wish[8], None)]
    for value, low, high in bounds:
        if (low is not None or high is not None) and value is None:
            return False
        if (low is not None and value < low) or (high is not None and value > high):
            return False
    states = [s.strip().lower() for s in (wish[11] or "").split(",") if s.strip()]
    places = [s.strip().lower() for s in (wish[12] or "").split(",") if s.strip()]
    return (
        (wish[9] != 1 or outside == 1)
        and ("terraza" not in (wish[10] or "") or terrace == 1)
        and (not states or (state or "").lower() in states)
        and (not places or (place is not None and any(p in place.lower() for p in places)))
    )


def test_matching_equals_the_nested_loop(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice(v)
    homes = [
        # one location holds most listings
        (i, pick("Centro", "Centro", "Centro", "Actur", "Casco Viejo", None), pick(None, rng.uniform(0.1, 9e5)),
         pick(None, rng.uniform(30, 200)), pick(None, 0, 3), rng.randint(0, 5), pick(None, 1, 2), pick(0, 1),
         pick(0, 1), pick(None, "Obra nueva", "Segunda mano/Buen estado"))
        for i in range(300)
    ]
    wishes = [
        (i, pick(None, rng.uniform(0, 4e5)), pick(None, rng.uniform(2e5, 9e5)), pick(None, 40.0), pick(None, 150.0),
         pick(None, None, 0.0), pick(None, None, 2.0), pick(None, 2.0), pick(None, None, 1.0), pick(None, 0, 1),
         pick(None, "terraza"), pick(None, "obra nueva, x"), pick(None, "centro", "C, ", "asco, Actur"))
        for i in range(60)
    ]
    expected = {(h[0], w[0]) for h in homes for w in wishes if _suits(h, w)}
    found = matching.match_preferences(
        spark.createDataFrame(homes, LISTING), spark.createDataFrame(wishes, CLIENT), cell_rows=7
    )
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_lists_come_in_bounded_parts(spark):
    pairs = [(1, c) for c in range(25)] + [(2, 3)]
    matches = spark.createDataFrame(pairs, "listing_id long, client_id long")
    rows = matching.collect_clients(matches, part_rows=10).orderBy("listing_id", "part").collect()
    assert [(r["listing_id"], r["part"], r["n"]) for r in rows] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    assert sum((r["clients"] for r in rows if r["listing_id"] == 1), []) == list(range(25))


def test_lists_follow_the_rank_and_not_the_id(spark):
    matches = spark.createDataFrame([(1, 5), (1, 100005), (1, 2**40)], "listing_id long, client_id long")
    listings = spark.createDataFrame([(1,), (2,)], "id long")
    rows = matching.collect_clients(matches, listings).orderBy("listing_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, [5, 100005, 2**40], 3), (2, 0, [], 0)]


def test_locations_whose_lower_case_is_longer(spark):
    names = spark.createDataFrame([("İz",), ("calle",), ("calma",)], "location string")
    wanted = spark.createDataFrame([(1, ["z"]), (2, ["CAL"])], "client_id long, barrios_interes array<string>")
    for cell_rows in (8192, 1):  # one cell, and a hot beginning split into many
        found = matching.resolve_locations(wanted, names, cell_rows).collect()
        assert sorted(tuple(r) for r in found) == [(1, "İz"), (2, "calle"), (2, "calma")]


def test_rows_without_an_id_are_not_appended(spark):
    old = spark.createDataFrame([(1, "a")], "id long, x string")
    batch = spark.createDataFrame([(2, "b"), (None, "c"), (1, "d")], old.schema)
    once = incremental.append_new(old, batch)
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "b")]
    assert incremental.append_new(once, batch).count() == 2


def test_keyless_rows_of_a_salted_join_are_kept(spark):
    big = spark.range(1000).selectExpr("cast(null as long) k", "id")
    big = big.union(spark.createDataFrame([(1, -1)], "k long, id long"))
    small = spark.createDataFrame([(1,)], "k long")
    assert salted_join(big, small, ["k"], "left_anti", ["id"]).count() == 1000
    assert salted_join(big, small, ["k"], "left", ["id"]).count() == 1001


def test_far_off_values_make_no_long_array(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (25_000.0,)], "x double")
    found = stats.int_histogram(rows, "x")
    assert found.count() == 25_000 and found.agg(F.sum("n")).first()[0] == 3


def test_scratch_removes_its_own_tables(spark):
    with scratch(spark):
        kept = cut_lineage(spark.range(3), "mine")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert path_exists(spark, path) and kept.count() == 3
    assert not path_exists(spark, path)


def _scan(rows, known, n):
    kept, streak = [], 0
    for item in rows:
        if item is None:
            continue
        if item in known:
            streak += 1
            if streak >= n:
                break
            continue
        streak = 0
        kept.append(item)
    return list(dict.fromkeys(kept))


@pytest.mark.parametrize("blocks", [1, 7])
def test_streak_cut_equals_the_scan(spark, blocks):
    rng = random.Random(3)
    rows, known = [], set(range(40))
    for run in range(12):
        # the long runs span many blocks; some have long known stretches, some no cut
        for at in range(rng.choice([3, 30, 200])):
            share = 0.9 if run % 3 else 0.4
            item = None if rng.random() < 0.05 else rng.randrange(40) + (0 if rng.random() < share else 40)
            rows.append((run, at // 30, at % 30, item))
    df = spark.createDataFrame(rows, "run int, page int, pos int, id int")
    ids = spark.createDataFrame([(i,) for i in known], "id int")
    found = incremental.cut_after_seen_streak(df, ids, "run", ["page", "pos"], blocks=blocks)
    got = {}
    for r in found.orderBy("run", "page", "pos").collect():
        got.setdefault(r["run"], []).append(r["id"])
    expected = {
        run: kept
        for run, group in groupby(rows, key=lambda r: r[0])
        if (kept := _scan([r[3] for r in group], known, 5))
    }
    assert got == expected


def test_streak_example(spark):
    seen = [100, 1, 1, 1, 1, 101, 1, 1, 1, 1, 1, 102]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(seen)], "run int, pos int, id int")
    found = incremental.cut_after_seen_streak(df, spark.createDataFrame([(1,)], "id int"), "run", ["pos"])
    assert sorted(r["id"] for r in found.collect()) == [100, 101]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    # one key holds most rows
    big = spark.createDataFrame([(i, 0 if i % 3 else i % 11) for i in range(400)], "id int, k int")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (4, "c"), (99, "d")], "k int, v string")
    plain = big.join(small, ["k"], how)
    for got in (
        salted_join(big, small, ["k"], how, ["id"], rows_per_split=10),
        checked_join(big, small, ["k"], how, ["id"], broadcast_rows=1, rows_per_split=10),
        checked_join(big, small, ["k"], how),
    ):
        got = got.select(plain.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("limits", [{}, {"leaf_rows": 20, "bins": 16}])
def test_exact_quantiles(spark, limits):
    rng = random.Random(1)
    values = {
        "repeats": [float(int(rng.expovariate(1) * 5)) for _ in range(300)],
        "wide": [rng.random() ** 9 * 1e6 for _ in range(700)],
        "same": [5.0] * 50,
        "signs": [rng.uniform(-1, 1) for _ in range(101)],
    }
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs] + [("none", None)], "g string, x double")
    probs = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "x", probs, ["g"], **limits).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert got[g] == pytest.approx(list(np.quantile(xs, probs)), rel=1e-12)
    whole = exact_quantiles(df, "x", [0.5], **limits).first()["q"]
    assert whole == pytest.approx([np.median(sum(values.values(), []))])


def test_histogram_equals_numpy(spark):
    rng = random.Random(2)
    values = {"a": [float(i) for i in range(31)], "b": [rng.gauss(0, 1) for _ in range(200)], "c": [7.0, 7.0]}
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs] + [("a", None)], "g string, x double")
    rows = stats.histogram(df, "x", 30, ["g"]).orderBy("g", "bin").collect()
    for g, xs in values.items():
        counts, edges = np.histogram(xs, bins=30)
        mine = [r for r in rows if r["g"] == g]
        assert [r["n"] for r in mine] == list(counts)
        assert [r["lo"] for r in mine] == pytest.approx(list(edges[:-1]))
    assert [r["n"] for r in rows if r["g"] == "a"][-1] == 2


def test_kde_equals_the_formula(spark):
    xs = np.array([1.0, 2.0, 2.5, 4.0, 9.0])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = stats.kde(df, "x", grid=20, bins=5).orderBy("point").collect()
    h = xs.std(ddof=1) * len(xs) ** -0.2
    at = np.linspace(1, 9, 20)
    density = np.exp(-0.5 * ((at[:, None] - xs) / h) ** 2).sum(axis=1) / (len(xs) * h * np.sqrt(2 * np.pi))
    assert [r["x"] for r in rows] == pytest.approx(list(at))
    assert [r["density"] for r in rows] == pytest.approx(list(density))


@pytest.mark.parametrize("spread", ["even", "far", "equal"])
def test_kde_stays_within_its_bound(spark, spread):
    rng = np.random.default_rng(4)
    xs = {"even": rng.normal(100, 30, 3000), "far": np.append(rng.normal(0, 1, 400), [1e6, -1e5]), "equal": np.append(np.full(500, 7.0), [8.0] * 90)}
    rows = [("g", float(x)) for x in xs[spread]] + [("none", 3.0)] * 4 + [("g", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = stats.kde(df, "x", ["g"], grid=200).orderBy("point").collect()
    own = xs[spread]
    h = own.std(ddof=1) * len(own) ** -0.2
    at = np.linspace(own.min(), own.max(), 200)
    exact = np.exp(-0.5 * ((at[:, None] - own) / h) ** 2).sum(axis=1)
    sums = np.array([r["density"] for r in got]) * (len(own) * h * np.sqrt(2 * np.pi))
    assert len(got) == 200 and {r["g"] for r in got} == {"g"}
    assert np.abs(sums - exact).max() < 1e-9 * len(own)


def test_shares_and_rooms(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", 1), ("x", "b", 3), ("x", None, None)], "g string, c string, r int")
    shares = {r["c"]: r["pct"] for r in stats.value_share(df, "c", ["g"]).collect()}
    assert shares == {"a": pytest.approx(200 / 3), "b": pytest.approx(100 / 3)}
    rooms = {r["value"]: r["n"] for r in stats.int_histogram(df, "r", ["g"]).collect()}
    assert rooms == {1: 2, 2: 0, 3: 1}


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 100])], "id int, x double")
    box = stats.box_stats(df, "x").first()
    assert (box["q1"], box["median"], box["q3"]) == (2, 3, 4)
    assert (box["whisker_lo"], box["whisker_hi"], box["outliers"]) == (1, 4, 1)
    assert [r["x"] for r in stats.box_outliers(df, "x").collect()] == [100]


def test_append_new_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id long, x string")
    batch = spark.createDataFrame([(2, 5), (1, 6)], "id long, y int")
    once = incremental.append_new(old, batch)
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, None, 5)]
    assert incremental.append_new(once, batch).count() == 2


def test_known_ids_and_listings_on_disk(spark, tmp_path):
    ids, homes = str(tmp_path / "ids"), str(tmp_path / "homes")
    assert files.read_known_ids(spark, ids).count() == 0
    assert files.read_listings(spark, homes).count() == 0
    parsed = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    for _ in range(2):
        files.append_known_ids(spark, parsed, ids)
    assert sorted(r["id"] for r in files.read_known_ids(spark, ids).collect()) == [1, 2]
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    for _ in range(2):
        files.append_listings(spark, batch, homes)
    assert spark.read.parquet(homes).count() == 2


def test_utf16_listings(spark, tmp_path):
    text = "id;Titulo;Localizacion;Precio;Caracteristicas_basicas;Caracteristicas_extra\n7;Piso ñ;Actur;185000.0;\"90 m² construidos; 2 baños\";\n"
    path = tmp_path / "raw.csv"
    path.write_text(text, encoding="utf-16")
    row = files.read_raw_listings(spark, str(path)).first()
    assert (row["id"], row["Titulo"], row["Precio"]) == (7, "Piso ñ", 185000)
    assert row["Caracteristicas_basicas"] == "90 m² construidos; 2 baños" and row["Caracteristicas_extra"] is None


def test_clients_and_decisions_from_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "id;nombre;email;Membresía;precio_min;exterior;extras;barrios_interes\n1;Ana;a@x;Oro;nan;1.0;\"a, b\";\n",
        encoding="utf-8",
    )
    row = files.read_clients(spark, str(tmp_path / "c.csv")).first()
    assert row["precio_min"] is None and row["exterior"] == 1
    assert row["extras"] == ["a", "b"] and row["barrios_interes"] == []
    (tmp_path / "d.csv").write_text("id;Seleccionado\n1; Yes\n2;No\n", encoding="utf-8")
    decisions = files.read_decisions(spark, str(tmp_path / "d.csv"))
    homes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert [r["id"] for r in reports.reviewed(homes, decisions).collect()] == [1]


def test_matches_with_arrays_on_disk(spark, tmp_path):
    matches = spark.createDataFrame([(1, [3, 4])], "id long, clients array<bigint>")
    for fmt in ("parquet", "json"):
        files.write_matches(matches, str(tmp_path / fmt), fmt)
        back = spark.read.schema(matches.schema).format(fmt).load(str(tmp_path / fmt))
        assert back.first()["clients"] == [3, 4]


def test_outbox_takes_each_key_once(spark, tmp_path):
    columns = "client_id long, kind string, run string, body string"
    rows = spark.createDataFrame([(1, "report", "mo", "a"), (2, "report", "mo", "b")], columns)
    later = spark.createDataFrame([(1, "report", "tu", "c")], columns)
    for part in (rows, rows, later, later):
        outbox.write_outbox(part, str(tmp_path / "o"), outbox.KEYS["messages"])
    waiting = outbox.read_outbox(spark, str(tmp_path / "o"), rows)
    assert sorted((r["client_id"], r["run"]) for r in waiting.collect()) == [(1, "mo"), (1, "tu"), (2, "mo")]


def test_index_and_rejected_pages(spark):
    from tasador.operators import pages

    body = '<main class="listing-items"><article data-element-id="5"></article><article></article></main>'
    df = spark.createDataFrame([(1, body), (2, None)], "page int, html string")
    assert [tuple(r) for r in pages.extract_listing_ids(df).collect()] == [(1, 0, "5")]
    found, rejected = pages.parse_pages(df)
    assert found.count() == 0 and rejected.count() == 2


def test_imputed_means(spark):
    from tasador.operators.features import cross_fill_areas, impute_means

    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (None, None)], "m2_construidos double, m2_utiles double")
    assert [tuple(r) for r in cross_fill_areas(df).collect()] == [(1.0, 2.0), (4.0, 4.0)]
    assert [r["m2_utiles"] for r in impute_means(df, ["m2_utiles"]).collect()] == [2.0, 4.0, 3.0]
    assert df.where(F.col("m2_utiles").isNull()).count() == 1
