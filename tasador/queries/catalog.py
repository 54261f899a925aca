"""Every operator bound to the given tables, one function per registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasador.functions import money
from tasador.functions.text import parse_id_list, strip_accents
from tasador.operators import features, incremental, matching, models, pages, prefindex, reports, selection, stats, summaries, trees
from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_lineage, cut_measured, fresh_path
from tasador.queries import views
from tasador.sources import files, outbox
from tasador.sources.models import load_model, save_model
from tasador.streaming import jobs, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BRAND = "Tasador"
SENDER = "hola@tasador.example"
TEMPLATE = (
    "Informe {{ID}} en {{LOCALIZACION}}: {{PRECIO}} €\n"
    "\\begin{tcolorbox}\\includegraphics{portada}\\end{tcolorbox}\n"
    "{{M2_CONSTRUIDOS}}/{{M2_UTIL}} m², {{HABITACIONES}} hab., {{BANOS}} baños, {{ESTADO}}, "
    "ascensor {{ASCENSOR}}, {{CALEFACCION}}, {{ANO}}\n"
    "{{ESTIMACION}} [{{MINIMO}}, {{MAXIMO}}] {{INTERVALO}} {{ID}}\n"
    "\\begin{tcolorbox}Notas\\end{tcolorbox}"
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def text_list(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


def area_rates(listings: DataFrame) -> DataFrame:
    rated = features.with_price_per_area(listings)
    return rated.groupBy("Localizacion").agg(F.avg("eur_m2").alias("_rate"))


def scored(listings: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Estimate from the mean price per m² of the location, in place of a model."""
    rates = area_rates(listings) if rates is None else rates
    estimate = F.col("_rate") * F.col("m2_construidos")
    return (
        checked_join(listings, rates, ["Localizacion"], "left", salt=["id"])
        .withColumn("Diferencia_Ponderada", estimate - F.col("Precio"))
        .drop("_rate")
    )


def with_margin(df: DataFrame) -> DataFrame:
    return selection.with_threshold(df, groups=views.GROUPS)


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_opportunities(with_margin(scored(views.listings(spark, sf_dir))))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_price_per_area(views.listings(spark, sf_dir))


# ---------------------------------------------------------------- feature text


def _features(spark: SparkSession, sf_dir: str, legacy: bool = False) -> DataFrame:
    return features.extract_features(views.feature_text(views.table(spark, sf_dir, "part")), legacy=legacy)


@query
def feature_ints(spark, sf_dir):
    columns = ["m2_construidos", "m2_utiles", "habitaciones", "banos", "planta_numero", "ano_construccion"]
    return _features(spark, sf_dir).select("id", *columns)


@query
def feature_flags(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "id",
        "trastero",
        "terraza",
        "balcon",
        "ascensor",
        "armarios_empotrados",
        "plaza_garaje",
        "garaje_incluido",
        "garaje_adicional",
        "adaptado_movilidad_reducida",
        F.col("Exterior").alias("exterior"),
        F.col("Interior").alias("interior"),
        "orientacion_este",
        "orientacion_oeste",
        "orientacion_norte",
        "orientacion_sur",
        "jardin",
        "piscina",
        "aire_acondicionado",
        "zonas_verdes",
    )


@query
def feature_labels(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "id", "estado_vivienda", F.col("Calefacción").alias("calefaccion")
    )


@query
def feature_legacy(spark, sf_dir):
    return _features(spark, sf_dir, legacy=True).select(
        "id", "estado_vivienda", "trastero", "terraza", "balcon", "armarios_empotrados"
    )


@query
def document_flags(spark, sf_dir):
    """Keyword flags over whole document texts: plain, cased, and whole words only."""
    docs = views.table(spark, sf_dir, "documents")
    docs = features.keyword_flags(docs, "text", {"either": ["The ", "que "]})
    docs = features.keyword_flags(docs, "text", {"cased": ["The "]}, case_sensitive=True)
    docs = features.keyword_flags(docs, "text", {"word": ["de", "une"]}, word_boundary=True)
    return docs.select("doc_id", "either", "cased", "word")


@query
def document_accents(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", strip_accents(F.col("text")).alias("plain"))


# -------------------------------------------------------------------- clean-up


@query
def clean_areas(spark, sf_dir):
    df = features.cross_fill_areas(views.listings(spark, sf_dir)).dropna(subset=["habitaciones", "banos"])
    return features.fill_constants(df).select(
        "id", "m2_construidos", "m2_utiles", "planta_numero", "estado_vivienda"
    )


@query
def impute_means(spark, sf_dir):
    columns = ["m2_construidos", "m2_utiles", "habitaciones", "banos", "planta_numero", "ano_construccion"]
    df = features.impute_means(views.listings(spark, sf_dir), columns)
    return df.select("id", *[rounded(c) for c in columns])


@query
def price_per_area(spark, sf_dir):
    return rated(spark, sf_dir).select("id", "eur_m2")


# ----------------------------------------------------------------------- pages


@query
def page_titles(spark, sf_dir):
    html = pages.visible_html(F.col("html"))
    return views.table(spark, sf_dir, "pages").select(
        "page_id",
        pages.element_text(html, "title").alias("title"),
        pages.element_text(html, "h1").alias("h1"),
        pages.element_text(html, "div", "ad").alias("ad"),
    )


@query
def page_items(spark, sf_dir):
    html = pages.visible_html(F.col("html"))
    return views.table(spark, sf_dir, "pages").select(
        "page_id", pages.list_items_joined(html, tag="nav").alias("items")
    )


@query
def page_links(spark, sf_dir):
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    links = views.table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return links.select("page_id", "pos", pages.attribute(F.col("tag"), "href").alias("href"))


@query
def listing_pages(spark, sf_dir):
    found, _ = pages.parse_pages(views.listing_pages(spark, sf_dir))
    return found.select(
        "id",
        F.col("Titulo").alias("titulo"),
        F.col("Localizacion").alias("localizacion"),
        F.col("Precio").alias("precio"),
        F.col("Caracteristicas_basicas").alias("basicas"),
        F.col("Caracteristicas_extra").alias("extra"),
        "descripcion",
        "portada",
        F.col("bad_price").cast("int").alias("bad_price"),
    )


@query
def rejected_pages(spark, sf_dir):
    _, rejected = pages.parse_pages(views.listing_pages(spark, sf_dir))
    return rejected.select("id", "reason")


@query
def index_ids(spark, sf_dir):
    served = pages.served_pages(views.index_pages(spark, sf_dir), "page")
    return pages.extract_listing_ids(served).select("page", "pos", "id")


@query
def price_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 9 == 0, "A consultar")
        .when(k % 9 == 1, F.concat(F.lit(" "), views.dotted_price(F.col("o_totalprice")), F.lit(" ")))
        .when(k % 9 == 2, F.translate(views.dotted_price(F.col("o_totalprice")), ".", " "))
        .otherwise(views.dotted_price(F.col("o_totalprice")))
    )
    place = F.concat_ws(", ", "o_orderpriority", "o_orderstatus")
    return views.table(spark, sf_dir, "orders").select(
        k.alias("id"), pages.price_value(text).alias("precio"), pages.location_name(place).alias("lugar")
    )


# ----------------------------------------------------------------- incremental


@query
def new_ids(spark, sf_dir):
    seen = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return incremental.new_ids(seen, views.known_ids(spark, sf_dir))


@query
def kept_listings(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    kept = incremental.keep_ids(views.listings(spark, sf_dir), line.select(F.col("l_orderkey").alias("id")))
    return kept.select("id", F.col("Precio").alias("precio"))


@query
def seen_streak_cut(spark, sf_dir):
    kept = incremental.cut_after_seen_streak(
        views.sightings(spark, sf_dir), views.known_ids(spark, sf_dir), "run", ["newest", "event_id"]
    )
    return kept.select("run", "id", "event_id")


@query
def append_new(spark, sf_dir):
    df = views.listings(spark, sf_dir)
    built = F.col("estado_vivienda") == "Obra nueva"
    old = df.where(F.coalesce(~built, F.lit(True))).select("id", "Precio", "Localizacion")
    batch = df.where(built | F.col("estado_vivienda").isNull()).select("Precio", "id", "habitaciones")
    return incremental.append_new(old, batch).select(
        "id",
        F.col("Precio").alias("precio"),
        F.col("Localizacion").alias("localizacion"),
        "habitaciones",
    )


# ------------------------------------------------------- selection and matching


@query
def threshold_select(spark, sf_dir):
    return opportunities(spark, sf_dir).select(
        "id",
        F.col("Precio").alias("precio"),
        F.col("Umbral").alias("umbral"),
        F.round("Diferencia_Ponderada", 2).alias("diferencia"),
    )


@query
def match_preferences(spark, sf_dir):
    return matching.match_preferences(views.listings(spark, sf_dir), views.clients(spark, sf_dir))


@query
def match_quirks(spark, sf_dir):
    return matching.match_preferences(
        views.listings(spark, sf_dir), views.clients(spark, sf_dir), reference_quirks=True
    )


@query
def match_indexed(spark, sf_dir):
    """The same pairs from a preference index that has been saved and read again."""
    path = fresh_path(spark, "index")
    prefindex.build_index(views.clients(spark, sf_dir)).save(path)
    return prefindex.match_indexed(views.listings(spark, sf_dir), prefindex.load_index(spark, path))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_preferences(opportunities(spark, sf_dir), views.clients(spark, sf_dir))


@query
def clients_per_listing(spark, sf_dir):
    """Every opportunity with the clients who want it, also those nobody wants."""
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    matches = matching.preference_matches(chosen, views.clients(spark, sf_dir))
    found = matching.collect_clients(matches, chosen)
    return found.select("listing_id", "part", text_list("clients"), "n")


@query
def reports_per_client(spark, sf_dir):
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    found = matching.reports_per_client(matching.preference_matches(chosen, views.clients(spark, sf_dir)))
    return found.select("client_id", "part", text_list("listings"), "n")


@query
def interested_counts(spark, sf_dir):
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    matches = matching.preference_matches(chosen, views.clients(spark, sf_dir))
    return matching.interested(chosen, matches).select("id", "n_clientes")


def _new_opportunities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """New listings of a run, the under-priced among them, and how many of both were written.

    Known are the ids that an earlier run has recorded: listings ordered before its day.
    """
    recorded = fresh_path(spark, "known")
    files.append_known_ids(spark, views.earlier_ids(spark, sf_dir), recorded)
    df = cut_lineage(views.listings(spark, sf_dir), "listings")
    fresh = incremental.new_ids(df, files.read_known_ids(spark, recorded))
    rows = {"rows": F.count("*")}
    arrived, found = cut_measured(incremental.keep_ids(scored(df, area_rates(df)), fresh), "arrived", **rows)
    chosen, kept = cut_measured(selection.select_opportunities(with_margin(arrived)), "chosen", **rows)
    return arrived, chosen, {"found": found["rows"], "kept": kept["rows"]}


@query
def daily_run(spark, sf_dir):
    """New listings only: scored, selected, matched, listed with their clients, ready for review."""
    _, chosen, _ = _new_opportunities(spark, sf_dir)
    matches = prefindex.matches_of(chosen, prefindex.build_index(views.clients(spark, sf_dir)))
    lists = matching.collect_clients(matches, chosen).withColumnRenamed("listing_id", "id")
    sheet = reports.for_review(chosen, views.URL_BASE).join(lists, "id")
    return sheet.select(
        "id",
        F.round("Diferencia_Ponderada", 2).alias("diferencia"),
        "part",
        text_list("clients"),
        "n",
        F.col("Seleccionado").alias("seleccionado"),
        F.col("Enlace").alias("enlace"),
    )


@query
def run_counts(spark, sf_dir):
    """How many listings a run found, kept and matched."""
    _, chosen, counts = _new_opportunities(spark, sf_dir)
    matches = prefindex.matches_of(chosen, prefindex.build_index(views.clients(spark, sf_dir)))
    return reports.run_counts("daily", matches, **counts)


# ----------------------------------------------------------------- comparisons


@query
def condition_share(spark, sf_dir):
    shares = stats.value_share(views.listings(spark, sf_dir), "estado_vivienda", ["Localizacion"])
    return shares.select(
        F.col("Localizacion").alias("localizacion"), "estado_vivienda", "n", rounded("pct")
    )


@query
def condition_rank(spark, sf_dir):
    """Conditions by falling count, per location and for all."""
    df = views.listings(spark, sf_dir)
    shares = stats.value_share(df, "estado_vivienda", ["Localizacion"])
    local = stats.rank_values(shares, "estado_vivienda", ["Localizacion"])
    overall = stats.rank_values(stats.value_share(df, "estado_vivienda"), "estado_vivienda")
    overall = overall.withColumn("Localizacion", F.lit("*"))
    return local.unionByName(overall).select(
        F.col("Localizacion").alias("localizacion"), "estado_vivienda", "n", F.col("rank").cast("long").alias("rank")
    )


@query
def condition_marked(spark, sf_dir):
    df = views.listings(spark, sf_dir)
    shares = stats.value_share(df, "estado_vivienda", ["Localizacion"])
    marked = stats.mark_share(shares, df, "estado_vivienda", ["Localizacion"])
    return marked.select(
        "subject", "estado_vivienda", rounded("pct"), F.col("highlight").cast("int").alias("highlight")
    )


def _bins(df: DataFrame) -> DataFrame:
    return df.select(F.col("Localizacion").alias("localizacion"), "bin", rounded("lo"), rounded("hi"), "n")


@query
def price_histogram(spark, sf_dir):
    return _bins(stats.histogram(views.listings(spark, sf_dir), "Precio", 30, ["Localizacion"]))


@query
def rate_histogram(spark, sf_dir):
    return _bins(stats.histogram(rated(spark, sf_dir), "eur_m2", 25, ["Localizacion"]))


@query
def rooms_histogram(spark, sf_dir):
    counts = stats.int_histogram(views.listings(spark, sf_dir), "habitaciones", ["Localizacion"])
    return counts.select(F.col("Localizacion").alias("localizacion"), "value", "n")


def _curve(df: DataFrame) -> DataFrame:
    return df.select(F.col("Localizacion").alias("localizacion"), "point", rounded("x", 4), rounded("curve", 4))


@query
def price_kde(spark, sf_dir):
    return _curve(stats.kde(views.listings(spark, sf_dir), "Precio", ["Localizacion"], grid=50, bins=30))


@query
def rate_kde(spark, sf_dir):
    return _curve(stats.kde(rated(spark, sf_dir), "eur_m2", ["Localizacion"], grid=50, bins=25))


def _merged_summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings merged batch by batch, one of them handed in twice."""
    path = fresh_path(spark, "summaries")
    df = cut_lineage(views.listings(spark, sf_dir), "listings")
    for part in (0, 1, 2, 1):
        batch = df.where(F.pmod(F.hash("id"), 3) == part)
        summaries.merge_batch(batch, path, "ano_construccion", "Precio", ["Localizacion"], 10000.0, f"day {part}")
    return summaries.read_summaries(spark, path)


@query
def summary_trend(spark, sf_dir):
    """The trend of every location from merged moments."""
    merged, _ = _merged_summaries(spark, sf_dir)
    return summaries.trend(merged, ["Localizacion"]).where("n > 0").select(
        F.col("Localizacion").alias("localizacion"), "n", *[rounded(c, 4) for c in ("slope", "intercept", "r2")]
    )


@query
def summary_bins(spark, sf_dir):
    """Merged counts of prices in bins of 10000."""
    _, bins = _merged_summaries(spark, sf_dir)
    return bins.select(F.col("Localizacion").alias("localizacion"), "bin", "n")


@query
def summary_moments(spark, sf_dir):
    """Merged moments, and whether each sketched quantile's rank is within the stated error."""
    merged, _ = _merged_summaries(spark, sf_dir)
    probs = (0.02, 0.25, 0.5, 0.75, 0.98)
    told = summaries.quantile(merged, probs, ["Localizacion"]).select("Localizacion", F.posexplode("q").alias("i", "q"))
    ranks = views.listings(spark, sf_dir).select("Localizacion", "Precio").join(F.broadcast(told), "Localizacion")
    ranks = ranks.groupBy("Localizacion", "i", "q").agg(
        F.avg((F.col("Precio") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("Precio") <= F.col("q")).cast("int")).alias("upto"), F.count("*").alias("of")
    )
    prob = F.get(F.array(*[F.lit(p) for p in probs]), F.col("i"))
    slack = summaries.RANK_ERROR + 1 / F.col("of")
    within = (F.col("below") <= prob + slack) & (F.col("upto") >= prob - slack)
    good = ranks.groupBy("Localizacion").agg(F.bool_and(within).alias("within"))
    deviation = F.sqrt(F.try_divide("m2", F.col("n") - 1))
    return merged.join(good, "Localizacion").select(
        F.col("Localizacion").alias("localizacion"), "n", F.round("mean", 4).alias("mean"), F.round(deviation, 4).alias("sd"), "lo", "hi", "within"
    )


@query
def area_box(spark, sf_dir):
    box = stats.box_stats(views.listings(spark, sf_dir), "m2_construidos", ["Localizacion"])
    return box.select(
        F.col("Localizacion").alias("localizacion"),
        "n",
        *[rounded(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
        "outliers",
    )


@query
def rooms_box(spark, sf_dir):
    box = stats.box_stats(rated(spark, sf_dir), "eur_m2", ["habitaciones"])
    return box.select(
        "habitaciones",
        "n",
        *[rounded(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
        "outliers",
    )


@query
def rate_outliers(spark, sf_dir):
    found = stats.box_outliers(rated(spark, sf_dir), "eur_m2", ["habitaciones"])
    return found.select("id", "habitaciones", "eur_m2")


@query
def trend_area(spark, sf_dir):
    line = stats.linear_trend(rated(spark, sf_dir), "m2_construidos", "eur_m2")
    return line.select("n", *[rounded(c) for c in ("slope", "intercept", "r2")])


@query
def trend_year(spark, sf_dir):
    line = stats.linear_trend(views.listings(spark, sf_dir), "ano_construccion", "Precio", ["Localizacion"])
    return line.select(
        F.col("Localizacion").alias("localizacion"), "n", *[rounded(c, 4) for c in ("slope", "intercept", "r2")]
    )


@query
def axis_clip(spark, sf_dir):
    band = stats.quantile_limits(rated(spark, sf_dir), "eur_m2", ["Localizacion"])
    return band.select(
        F.col("Localizacion").alias("localizacion"),
        *[rounded(c) for c in ("q_lo", "q_hi", "axis_lo", "axis_hi")],
    )


@query
def city_axis_clip(spark, sf_dir):
    band = stats.quantile_limits(rated(spark, sf_dir), "eur_m2", margin=0.05)
    return band.select(*[rounded(c) for c in ("q_lo", "q_hi", "axis_lo", "axis_hi")])


@query
def price_axis(spark, sf_dir):
    limits = stats.axis_limits(views.listings(spark, sf_dir), "Precio", ["Localizacion"], 0.05, 0.1)
    return limits.select(
        F.col("Localizacion").alias("localizacion"), "n", rounded("axis_lo"), rounded("axis_hi")
    )


def _peers(df: DataFrame, on: str) -> DataFrame:
    figures = ("peer_mean", "peer_min", "peer_max", "vs_mean_pct", "axis_lo", "axis_hi")
    return stats.compare_to_peers(df, df, [on], "eur_m2").select(
        "id", F.col(on).alias("peer_group"), "peers", *[rounded(c, 4) for c in figures]
    )


@query
def peers_by_location(spark, sf_dir):
    return _peers(rated(spark, sf_dir), "Localizacion")


@query
def peers_by_rooms(spark, sf_dir):
    return _peers(rated(spark, sf_dir), "habitaciones")


# --------------------------------------------------------------------- reports


@query
def price_interval(spark, sf_dir):
    df = money.with_price_interval(scored(views.listings(spark, sf_dir)))
    return df.select("id", "estimacion", "minimo", "maximo", "intervalo")


@query
def listing_reports(spark, sf_dir):
    covered = scored(views.listings(spark, sf_dir)).withColumn(
        "portada", F.when(F.col("Exterior") == 1, F.lit("portada.png"))
    )
    return reports.listing_reports(covered, TEMPLATE)


@query
def welcome_messages(spark, sf_dir):
    return reports.welcome_messages(views.clients(spark, sf_dir), SENDER, BRAND)


@query
def preference_texts(spark, sf_dir):
    shown = {
        "precio_min": "price",
        "m2_min": "area",
        "planta_min": "plain",
        "exterior": "yes",
        "extras": "text",
        "barrios_interes": "text",
    }
    return views.clients(spark, sf_dir).select(
        "id",
        *[reports.format_preference(F.col(c), kind).alias(c) for c, kind in shown.items()],
        reports.membership_text(F.col("Membresía")).alias("intro"),
    )


@query
def preference_lists(spark, sf_dir):
    people = matching.prepare_clients(views.clients(spark, sf_dir))
    return people.select("id", *[text_list(c) for c in ("extras", "estados_vivienda", "barrios_interes")])


def _mail(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    people = views.clients(spark, sf_dir)
    # reports exist for the listings the reviewer has let through
    ready = chosen.where(F.col("Exterior") == 1).select(F.col("id").alias("listing_id"))
    return reports.report_messages(people, matching.preference_matches(chosen, people), ready, BRAND)


@query
def report_messages(spark, sf_dir):
    return _mail(spark, sf_dir)[0]


@query
def report_attachments(spark, sf_dir):
    """Queued twice: the second time adds nothing."""
    attached = cut_lineage(_mail(spark, sf_dir)[1], "attached")
    path = fresh_path(spark, "outbox")
    for _ in range(2):
        outbox.write_outbox(attached, path, outbox.KEYS["attachments"])
    return outbox.read_outbox(spark, path, attached)


@query
def outbox_two_runs(spark, sf_dir):
    """Two runs and a replay of the second: one mail per client and run."""
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    people = views.clients(spark, sf_dir)
    matches = matching.preference_matches(chosen, people)
    path = fresh_path(spark, "outbox")
    for run, part in (("monday", 0), ("tuesday", 1), ("tuesday", 1)):
        ready = chosen.where(F.col("id") % 2 == part).select(F.col("id").alias("listing_id"))
        mails, _ = reports.report_messages(people, matches, ready, BRAND, run)
        like = cut_lineage(mails, "mails")
        outbox.write_outbox(like, path, outbox.KEYS["messages"], run)
    return outbox.read_outbox(spark, path, like).select("client_id", "kind", "run", "n_reports")


@query
def review_sheet(spark, sf_dir):
    sheet = reports.for_review(opportunities(spark, sf_dir), views.URL_BASE)
    return sheet.select("id", F.col("Seleccionado").alias("seleccionado"), F.col("Enlace").alias("enlace"))


@query
def reviewed_listings(spark, sf_dir):
    k = F.col("o_orderkey")
    answer = (
        F.when(k % 6 == 0, " TRUE ").when(k % 6 == 1, "1").when(k % 6 == 2, "Yes").when(k % 6 == 3, "sí").when(
            k % 6 == 4, "No"
        )
    )
    decisions = views.table(spark, sf_dir, "orders").select(k.alias("id"), answer.alias("Seleccionado"))
    kept = reports.reviewed(views.listings(spark, sf_dir), decisions)
    return kept.select("id", F.col("Precio").alias("precio"))


# ----------------------------------------------------------- sources and sinks


@query
def csv_roundtrip(spark, sf_dir):
    """Listings through ``;``-separated text, where whole numbers become ``90.0``."""
    path = fresh_path(spark, "csv")
    files.write_listings(views.listings(spark, sf_dir), path, "csv")
    back = files.read_listings(spark, path, fmt="csv")
    return back.select(
        "id",
        F.col("Localizacion").alias("localizacion"),
        F.col("Precio").alias("precio"),
        "m2_construidos",
        "m2_utiles",
        "habitaciones",
        "planta_numero",
        "estado_vivienda",
        F.col("Calefacción").alias("calefaccion"),
    )


@query
def raw_roundtrip(spark, sf_dir):
    """Raw listings through UTF-16 text with quoted separators."""
    raw = views.feature_text(views.table(spark, sf_dir, "part")).select(
        "id",
        "Titulo",
        F.lit("Centro; norte").alias("Localizacion"),
        (F.col("id") * 1000).alias("Precio"),
        "Caracteristicas_basicas",
        "Caracteristicas_extra",
    )
    path = fresh_path(spark, "raw")
    raw.write.options(header=True, sep=";", encoding="UTF-16", escape='"').csv(path)
    back = files.read_raw_listings(spark, path)
    return back.select(
        "id",
        F.col("Localizacion").alias("localizacion"),
        F.col("Precio").cast("long").alias("precio"),
        F.coalesce(F.length("Caracteristicas_basicas"), F.lit(0)).alias("basicas"),
    )


@query
def clients_roundtrip(spark, sf_dir):
    """Clients through ``;``-separated text, list columns read as arrays."""
    path = fresh_path(spark, "clients")
    views.clients(spark, sf_dir).write.options(header=True, sep=";", encoding="UTF-8", escape='"').csv(path)
    back = files.read_clients(spark, path)
    return back.select(
        "id", "precio_min", "exterior", *[text_list(c) for c in ("extras", "estados_vivienda", "barrios_interes")]
    )


@query
def matches_roundtrip(spark, sf_dir):
    """Matches with their client lists written and read, and the lists as text and back."""
    chosen = cut_lineage(opportunities(spark, sf_dir), "chosen")
    lists = matching.collect_clients(matching.preference_matches(chosen, views.clients(spark, sf_dir)))
    path = fresh_path(spark, "matches")
    files.write_matches(lists, path)
    back = spark.read.parquet(path).withColumn("clients", parse_id_list(F.to_json("clients")))
    return back.select("listing_id", text_list("clients"))


@query
def known_ids_append(spark, sf_dir):
    """Ids of parsed pages recorded twice; failed pages stay unknown."""
    found, _ = pages.parse_pages(views.listing_pages(spark, sf_dir))
    parsed = cut_lineage(found.where(~F.col("bad_price")).select("id"), "parsed")
    path = fresh_path(spark, "known")
    for _ in range(2):
        files.append_known_ids(spark, parsed, path)
    return files.read_known_ids(spark, path)


# ---------------------------------------------------------------------- models


def _mean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location means as predictions, folds by id: a predictor SQL can repeat."""
    df = views.listings(spark, sf_dir)
    means = df.groupBy("Localizacion").agg(F.avg("Precio").alias("y_hat"))
    return checked_join(df, means, ["Localizacion"], salt=["id"]).select(
        F.lit("mean").alias("model"),
        (F.col("id") % 5).cast("int").alias("fold"),
        "id",
        F.col("Precio").alias("y"),
        "y_hat",
    )


@query
def trimmed_metrics(spark, sf_dir):
    found = models.trimmed_metrics(_mean_predictions(spark, sf_dir))
    return found.select("model", "fold", "n", rounded("mse", 0), rounded("r2"))


@query
def mean_metrics(spark, sf_dir):
    found = models.mean_metrics(models.trimmed_metrics(_mean_predictions(spark, sf_dir)))
    return found.select("model", "folds", rounded("mse", 0), rounded("r2"))


@query
def best_depth(spark, sf_dir):
    """Folds stand in for depths: the one with the least mean error wins."""
    metrics = models.trimmed_metrics(_mean_predictions(spark, sf_dir))
    return models.best_depth(metrics.withColumn("depth", F.col("fold"))).select("depth", rounded("mse", 0))


@query
def one_hot_levels(spark, sf_dir):
    """Position of the set level and how many are set, per listing and text column."""
    df = models.prepare_training(views.listings(spark, sf_dir)).select(
        "id", "Precio", "Localizacion", "estado_vivienda", "habitaciones"
    )
    encoded = Pipeline(stages=models.feature_stages(df)).fit(df).transform(df)
    place = vector_to_array(F.col("Localizacion_levels"))
    state = vector_to_array(F.col("estado_vivienda_levels"))
    return encoded.select(
        "id",
        F.array_position(place, 1.0).cast("int").alias("location_level"),
        F.array_position(state, 1.0).cast("int").alias("condition_level"),
        F.size(place).alias("locations"),
        F.size(state).alias("conditions"),
    )


@query
def train_test_folds(spark, sf_dir):
    train, test = models.split_train_test(views.listings(spark, sf_dir))
    parts = models.with_fold(train).select("id", F.lit("train").alias("part"), "fold")
    return parts.unionByName(test.select("id", F.lit("test").alias("part"), F.lit(-1).alias("fold")))


def _training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a price that their features explain; the given order totals follow from none of them."""
    price = F.coalesce("m2_construidos", F.lit(50.0)) * 1500 + F.col("Exterior") * 20000 + 30000
    return cut_lineage(views.listings(spark, sf_dir).withColumn("Precio", price), "training")


# few candidates and few trees, but a search with something to choose from
SMALL_GRIDS = {
    "forest": {"numTrees": [10, 20], "minSplit": [2, 10], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["all"]},
    "bagging": {"members": [4, 6], "rows": [0.7, 1.0], "features": [0.7, 1.0], "bootstrap": [True, False]},
    "boosting": {"maxIter": [5, 10], "maxDepth": [3], "stepSize": [0.1, 0.3]},
    "kernel": {"gamma": [0.005, 0.02], "penalty": [100.0]},
}
SMALL_DRAWS = 2
SMALL_FIXED = {"forest": {"maxDepth": 6}, "bagging": {"maxDepth": 6}, "kernel": {"components": 64}, "boosting": {}}


def _trained(spark: SparkSession, sf_dir: str, presets: list[str]) -> tuple[DataFrame, dict, DataFrame]:
    df = _training_set(spark, sf_dir)
    return df, *models.train_models(df, presets, SMALL_GRIDS, SMALL_FIXED, draws=SMALL_DRAWS)


def _scores(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    """One model searched, refitted, tested and applied: what must hold of it, in one row.

    The chosen candidate is one of those drawn, the trimmed test rows are told
    better than by their mean, and every difference is estimate minus price.
    """
    df, fitted, tested = _trained(spark, sf_dir, [preset])
    chosen = fitted[preset].params
    drawn = models.draw_params(SMALL_GRIDS[preset], SMALL_DRAWS)
    among = any(all(chosen[k] == v for k, v in c.items()) for c in drawn)
    out = models.score_listings(df, fitted, {preset: 1.0})
    off = F.abs(F.col("Diferencia_Ponderada") - (F.col("estimate") - F.col("Precio"))) > 1e-6
    found = out.agg(
        F.count("*").alias("listings"), F.count("estimate").alias("estimates"), F.count_if(off).alias("off")
    )
    better = tested.select(F.lit(preset).alias("model"), (F.col("r2") > 0).alias("better"))
    return found.join(better).select("model", "listings", "estimates", "off", "better", F.lit(among).alias("drawn"))


@query
def forest_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "forest")


@query
def bagging_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "bagging")


@query
def boosting_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "boosting")


@query
def kernel_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "kernel")


@query
def weighted_scores(spark, sf_dir):
    """Four models trained, tested, weighted by trimmed error, and applied: which listings get which values.

    The estimate lies between the values of the models.
    """
    df, fitted, tested = _trained(spark, sf_dir, list(SMALL_GRIDS))
    out = models.score_listings(df, fitted, models.weights_from(tested))
    values = [F.col(f"pred_{n}") for n in fitted]
    inside = F.col("estimate").between(F.least(*values) - 1e-6, F.greatest(*values) + 1e-6)
    return out.select(
        "id",
        *[F.col(f"pred_{n}").isNotNull().alias(n) for n in fitted],
        F.coalesce(inside, F.lit(False)).alias("inside"),
        (F.abs(F.col("Diferencia_Ponderada") - F.col("estimate") + F.col("Precio")) < 1e-6).alias("difference"),
    )


@query
def depth_metrics(spark, sf_dir):
    """Depth search over 3 to 19 and five folds: every row told once per depth, and better than by the mean.

    ``least`` holds if no depth has a smaller mean error than the chosen one.
    """
    train, _ = models.split_train_test(models.prepare_training(_training_set(spark, sf_dir)))
    chosen, told = models.depth_search(train, models.DEPTHS, folds=5, trees=3)
    rows = told.groupBy(F.col("model").cast("int").alias("depth"), "fold").agg(
        F.count("*").alias("told"), F.countDistinct("id").alias("ids"), F.count("y_hat").alias("values")
    )
    metrics = cut_lineage(models.depth_metrics(told), "metrics")
    mean = metrics.groupBy("depth").agg(F.avg("mse").alias("mean"))
    # one row a depth
    least = mean.join(F.broadcast(mean.where(F.col("depth") == chosen).select(F.col("mean").alias("best")))).select(
        "depth", (F.col("mean") >= F.col("best")).alias("least")
    )
    finite = F.col("mse").isNotNull() & ~F.isnan("mse") & (F.col("mse") < float("inf")) & (F.col("mse") >= 0)
    scored = metrics.select("depth", "fold", finite.alias("finite"), (F.col("r2") > 0).alias("better"))
    return rows.join(scored, ["depth", "fold"]).join(F.broadcast(least), "depth").select(
        "depth", "fold", "told", "ids", "values", "finite", "better", "least"
    )


@query
def subspace_members(spark, sf_dir):
    """Bagged trees over half the columns and rows: what each member's nodes use.

    ``own`` holds if all its splits are in its own columns, ``half`` if these are half of all, and
    ``differs`` if another member has other columns.
    """
    train = models.prepare_training(_training_set(spark, sf_dir))
    encoded = cut_lineage(Pipeline(stages=models.feature_stages(train)).fit(train).transform(train).select("features", "Precio"))
    ensemble = trees.SubspaceForest(members=5, rows=0.5, features=0.5, labelCol="Precio", maxDepth=6)
    forest = ensemble.fit(encoded)
    width = forest.numFeatures
    own = ensemble.columns(width)
    rows = [(i, columns, len(columns) == width // 2, any(c != columns for c in own)) for i, columns in enumerate(own)]
    members = spark.createDataFrame(rows, "member int, columns array<int>, half boolean, differs boolean")
    nodes = trees.tree_nodes(spark, forest).where("leftChild >= 0").withColumnRenamed("treeID", "member")
    used = nodes.join(F.broadcast(members), "member").groupBy("member", "half", "differs").agg(
        F.bool_and(F.array_contains("columns", F.col("split.featureIndex"))).alias("own"), (F.count("*") > 0).alias("splits")
    )
    return used.select("member", "own", "half", "differs", "splits")


@query
def split_sizes(spark, sf_dir):
    """A forest grown with a least number of rows to split, saved and read again.

    Listings and those with equal values from both models, inner nodes below the bound, and whether the
    bound has made leaves of nodes that would have been split.
    """
    train = models.prepare_training(_training_set(spark, sf_dir))
    params = {"numTrees": 4, "maxDepth": 8, "featureSubsetStrategy": "all"}
    plain = models.fit(train, "forest", params).model.stages[-1]
    fitted = models.fit(train, "forest", {**params, "minSplit": 40})
    path = fresh_path(spark, "model")
    save_model(fitted.model, path)
    again = load_model(path)
    both = fitted.model.transform(train).select("id", "prediction").join(
        again.transform(train).select("id", F.col("prediction").alias("again")), "id"
    )
    equal = both.agg(F.count("*").alias("listings"), F.count_if(F.col("prediction") == F.col("again")).alias("equal"))
    inner = lambda model: trees.tree_nodes(spark, model).where("leftChild >= 0")
    cut = inner(again.stages[-1]).agg(F.count_if(F.col("rawCount") < 40).alias("small"), F.count("*").alias("inner"))
    grown = inner(plain).agg(F.count("*").alias("grown"))
    return equal.join(cut).join(grown).select("listings", "equal", "small", (F.col("inner") < F.col("grown")).alias("fewer"))


# --------------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(columns).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query
def stream_new_ids(spark, sf_dir):
    arriving = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id")
    sink = fresh_path(spark, "new-ids")
    state.unseen_stream(arriving, views.known_ids(spark, sf_dir), sink, fresh_path(spark, "state"), "event_id")
    return spark.read.parquet(sink).select("id", "event_id")


def _in_parts(df: DataFrame, parts: int, by: str) -> DataFrame:
    """A stream of the rows in ``parts`` files, one micro-batch each."""
    source = fresh_path(df.sparkSession, "arriving")
    df.repartition(parts, F.expr(by)).write.parquet(source)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)


@query
def stream_unique(spark, sf_dir):
    """Every id once, over several batches that arrive out of order."""
    seen = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id")
    arriving = _in_parts(seen, 4, "event_id % 4")
    sink = fresh_path(spark, "unique")
    state.unseen_stream(arriving, None, sink, fresh_path(spark, "state"), "event_id")
    return spark.read.parquet(sink).select("id")


@query
def stream_streak_cut(spark, sf_dir):
    """The seen-streak cut of every day's run, pages of 30 sightings arriving in any order."""
    nth = F.row_number().over(Window.partitionBy("run").orderBy("newest", "event_id")) - 1
    rows = views.sightings(spark, sf_dir).withColumn("nth", nth)
    size = F.count("*").over(Window.partitionBy("run", "page"))
    pages_ = rows.withColumn("page", F.floor(F.col("nth") / 30) + 1).select(
        "run", "page", (F.col("nth") % 30).cast("int").alias("pos"), size.cast("int").alias("items"), "id", F.col("event_id").alias("ref")
    )
    flagged, sink = fresh_path(spark, "flagged"), fresh_path(spark, "met")
    state.known_flags_stream(
        _in_parts(cut_lineage(pages_, "pages"), 3, "hash(run, page)"), views.known_ids(spark, sf_dir), flagged, fresh_path(spark, "state")
    )
    arriving = spark.readStream.schema(state.RUN_ROWS).parquet(flagged)
    state.streak_stream(arriving, sink, fresh_path(spark, "state"))
    return spark.read.parquet(sink).select("run", "id", F.col("ref").alias("event_id"))


@query
def stream_features(spark, sf_dir):
    def extract(parts: DataFrame) -> DataFrame:
        found = features.extract_features(views.feature_text(parts))
        return found.select("id", "m2_utiles", "banos", "ascensor", "estado_vivienda", "piscina")

    return jobs.extract_stream(
        _stream(spark, sf_dir, "part"), extract, fresh_path(spark, "features"), fresh_path(spark, "state")
    )


@query
def stream_notify(spark, sf_dir):
    rates = cut_lineage(area_rates(views.listings(spark, sf_dir)), "rates")
    path = fresh_path(spark, "outbox")
    jobs.notify_stream(
        _stream(spark, sf_dir, "orders"),
        lambda orders: scored(views.listings(spark, sf_dir, orders), rates),
        views.clients(spark, sf_dir),
        path,
        fresh_path(spark, "state"),
        with_margin,
    )
    return outbox.read_outbox(spark, path, spark.createDataFrame([], "client_id long, listing_id long"))
