"""Listings, clients, texts, pages and sightings derived from the given tables.

The given tables hold no property listings, so orders stand in for listings,
customers for clients, parts for feature texts and events for sightings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasador import rules

URL_BASE = "https://listings.example/inmueble/"
GROUPS = {"prime": ["NATION_1", "NATION_2", "NATION_3"], "growth": ["NATION_4", "NATION_5"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(
    spark: SparkSession, sf_dir: str, orders: DataFrame | None = None
) -> DataFrame:
    """One listing per order: location from the customer, sizes from its line items."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    line = table(spark, sf_dir, "lineitem")
    sizes = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("m2_construidos"),
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("m2_utiles"),
        F.count("*").cast("int").alias("habitaciones"),
        F.nullif(F.count_if(F.col("l_linestatus") == "F"), F.lit(0)).cast("int").alias("banos"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("planta_numero"),
        F.max((F.col("l_discount") >= 0.09).cast("int")).alias("terraza"),
        F.max((F.col("l_tax") >= 0.07).cast("int")).alias("ascensor"),
        F.max((F.col("l_linenumber") >= 6).cast("int")).alias("plaza_garaje"),
    )
    place = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("Localizacion"))
    )
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    labels = [label for _, label in rules.CONDITIONS]
    condition = (
        F.when(urgency == "4-NOT SPECIFIED", F.lit(None))
        .when(status == "F", labels[0])
        .when(status == "O", labels[1])
        .when(status == "P", labels[2])
    )
    heating = (
        F.when(urgency == "1-URGENT", "individual: Gas natural")
        .when(urgency.isin("2-HIGH", "3-MEDIUM"), "central")
        .otherwise(rules.NO_HEATING)
    )
    flags = ["terraza", "ascensor", "plaza_garaje"]
    return (
        orders.join(place, "o_custkey")
        .join(sizes, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("id"),
            "Localizacion",
            F.col("o_totalprice").alias("Precio"),
            "m2_construidos",
            "m2_utiles",
            "habitaciones",
            "banos",
            "planta_numero",
            F.when(F.col("o_custkey") % 17 != 0, F.year("o_orderdate") - F.col("o_custkey") % 60)
            .cast("int")
            .alias("ano_construccion"),
            urgency.isin("1-URGENT", "2-HIGH").cast("int").alias("Exterior"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in flags],
            condition.alias("estado_vivienda"),
            heating.alias("Calefacción"),
        )
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per customer; every preference is unset for some of them."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    low = F.abs("c_acctbal") * 20
    tier = (
        F.when(F.col("c_mktsegment") == "BUILDING", "Prueba gratuita")
        .when(F.col("c_mktsegment") == "FURNITURE", " Plan Mensual ")
        .when(F.col("c_mktsegment") == "MACHINERY", "Plan Semestral")
        .otherwise("Otro")
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("nombre"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        tier.alias("Membresía"),
        F.when(k % 5 != 0, low).alias("precio_min"),
        F.when(k % 7 != 0, low + 60000).alias("precio_max"),
        F.when(k % 3 != 0, (k % 100 + 40).cast("double")).alias("m2_min"),
        F.when(k % 4 != 0, (k % 150 + 90).cast("double")).alias("m2_max"),
        F.when(k % 6 == 0, (k % 4).cast("double")).alias("planta_min"),
        F.when(k % 8 == 0, (k % 5 + 2).cast("double")).alias("planta_max"),
        F.when(k % 2 != 0, (k % 5).cast("double")).alias("habitaciones_min"),
        F.when(k % 9 == 0, (k % 3 + 1).cast("double")).alias("baños_min"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("exterior"),
        F.when(k % 5 == 1, "terraza")
        .when(k % 5 == 2, "ascensor, plaza_garaje")
        .when(k % 5 == 3, "helipuerto,terraza")
        .alias("extras"),
        F.when(k % 3 == 1, "Segunda mano/Buen estado")
        .when(k % 3 == 2, "obra nueva, Segunda mano/Para reformar,")
        .alias("estados_vivienda"),
        F.when(k % 4 == 1, F.concat(F.lit("NATION_"), nation.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("nation_"), (nation % 10).cast("string"), F.lit(", ,Nation_2")))
        .when(k % 4 == 3, F.concat(F.lit("_"), (nation % 3).cast("string")))
        .alias("barrios_interes"),
    )


def feature_text(parts: DataFrame) -> DataFrame:
    """Feature texts in listing wording, each piece left out for some parts."""
    k, size = F.col("p_partkey"), F.col("p_size")

    def text(c: Column) -> Column:
        return c.cast("string")

    rooms = F.when(k % 5 == 0, " habitación").otherwise(" habitaciones")
    baths = F.when(k % 3 == 0, " baño").otherwise(" baños")
    basic = F.concat_ws(
        "; ",
        F.when(
            k % 11 != 0,
            F.concat(text(size + 20), F.lit(" m² construidos, "), text(size + 10), F.lit(" m² útiles")),
        ),
        F.when(k % 7 != 0, F.concat(text(k % 5 + 1), rooms)),
        F.when(k % 6 != 0, F.concat(text(k % 3 + 1), baths)),
        F.when(k % 4 == 0, "Segunda mano/buen estado")
        .when(k % 4 == 1, "Segunda mano/para reformar")
        .when(k % 4 == 2, "Promoción de obra nueva"),
        F.when(k % 3 == 0, "Orientación oeste").when(k % 3 == 1, "Orientación norte, sur"),
        F.when(k % 5 != 0, "Calefacción individual: Gas natural"),
        F.when(k % 8 != 0, F.concat(F.lit("Planta "), text(k % 9), F.lit("ª exterior con ascensor"))).otherwise(
            "Bajo interior"
        ),
        F.when(k % 10 != 0, F.concat(F.lit("Construido en "), text(k % 70 + 1950))),
        F.when(k % 12 == 1, "Trastero").when(k % 12 == 2, "terraza y balcón").when(k % 12 == 3, "Terraza"),
        F.when(k % 13 == 1, "Plaza de garaje incluida en el precio").when(
            k % 13 == 2, "Garaje por 10.000 eur adicionales"
        ),
        F.when(k % 14 == 1, "Armarios empotrados").when(k % 14 == 2, "Armario empotrado"),
        F.when(k % 15 == 1, "Acceso adaptado a personas con movilidad reducida"),
    )
    extra = F.concat_ws(
        "; ",
        F.when(k % 2 == 0, "Piscina"),
        F.when(k % 3 == 0, "Jardín"),
        F.when(k % 5 == 0, "Aire acondicionado"),
        F.when(k % 7 == 0, "Zonas verdes"),
    )
    return parts.select(
        k.alias("id"),
        F.col("p_name").alias("Titulo"),
        F.when(k % 16 != 0, basic).alias("Caracteristicas_basicas"),
        F.when(k % 18 != 0, extra).alias("Caracteristicas_extra"),
    )


def dotted_price(price: Column) -> Column:
    return F.concat(F.translate(F.format_number(F.floor(price), 0), ",", "."), F.lit(" €"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page per order, with the markup real pages surround the facts with."""
    k = F.col("o_orderkey")
    title = F.concat(
        F.lit("<!-- <span class=\"main-info__title-main\">viejo</span> -->"),
        F.when(
            k % 29 != 0,
            F.concat(
                F.lit('<h1><span class="big main-info__title-main">Piso <span>n.&ordm; '),
                k.cast("string"),
                F.lit("</span> &amp; garaje</span></h1>"),
            ),
        ).otherwise(F.lit("<h1>Oferta retirada</h1>")),
    )
    place = F.concat(
        F.lit("<span class='main-info__title-minor'>"), F.col("n_name"), F.lit(", "), F.col("r_name"), F.lit("</span>")
    )
    price = F.when(
        k % 37 != 0,
        F.concat(
            F.lit('<span data-class="txt-bold">9 €</span><span class=info-data-price><span class=txt-bold>'),
            F.when(k % 31 == 0, "consultar").otherwise(dotted_price(F.col("o_totalprice"))),
            F.lit("</span></span>"),
        ),
    ).otherwise("")
    basic = F.when(
        k % 7 != 0,
        F.concat(
            F.lit('<div class="details-property-feature-one"><div><h2>Basics</h2><ul><li> '),
            (k % 90 + 30).cast("string"),
            F.lit(" m² construidos </li><li>"),
            (k % 5 + 1).cast("string"),
            F.lit(" <b>habitaciones</b></li></ul></div><div><ul><li>Planta "),
            (k % 9).cast("string"),
            F.lit("</li></ul></div></div><div><li>otro</li></div>"),
        ),
    ).otherwise("")
    extra = F.when(
        k % 11 != 0, F.lit('<div class="details-property-feature-two"><ul><li>Piscina</li></ul></div>')
    ).otherwise('<div class="details-property-feature-two"><ul></ul></div>')
    described = F.when(
        k % 5 != 0,
        F.concat(
            F.lit('<div class="adCommentsLanguage expandable"> <p>Vivienda '),
            F.col("o_orderpriority"),
            F.lit("</p> </div>"),
        ),
    ).otherwise("")
    cover = F.when(
        k % 3 != 0,
        F.concat(
            F.lit('<picture class="first-image"><source srcset="x"><img alt="" src="https://img.example/'),
            k.cast("string"),
            F.lit('.jpg?w=1&amp;h=2"></picture><picture><img src="https://img.example/otra.jpg"></picture>'),
        ),
    ).otherwise("")
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # real pages arrive in many files, while few files of narrow orders would
    # leave all the parsing to few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").drop("o_orderdate", "o_orderstatus")
    orders = orders.repartition(tasks, "o_orderkey")
    return (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("id"),
            F.concat(
                F.lit("<html><body><script>var s='<span class=\"txt-bold\">1 €</span>';</script>"),
                title,
                place,
                price,
                basic,
                extra,
                described,
                cover,
                F.lit("</body></html>"),
            ).alias("html"),
        )
    )


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of 30 cards each; some show another page than was asked for."""
    card = F.concat(
        F.lit("<article class='item'"),
        F.when(
            F.col("event_type") != "error",
            F.concat(F.lit(' data-element-id="'), F.col("user_id").cast("string"), F.lit('"')),
        ).otherwise(""),
        F.lit("><a>x</a></article>"),
    )
    page = F.expr("cast(event_id div 30 as int)")
    cards = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("at"), card.alias("card"))))
    shown = F.when(F.col("page") % 11 == 10, F.lit(1)).otherwise(F.col("page"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(page.alias("page"))
        .agg(cards.alias("cards"))
        .select(
            "page",
            F.concat(
                F.lit("<article data-element-id='0'></article><main class=\"listing-items\">"),
                F.array_join(F.transform("cards", lambda c: c["card"]), ""),
                F.lit('<div class="pagination"><ul><li>0</li><li class="selected"><span>'),
                shown.cast("string"),
                F.lit("</span></li></ul></div></main>"),
            ).alias("html"),
        )
    )


KNOWN_BEFORE = "2024-01-04"
RUN_DAY = "2001-01-01"


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    early = F.col("ts") < F.lit(KNOWN_BEFORE).cast("timestamp_ntz")
    return events.where((F.col("event_type") == "signup") & early).select(F.col("user_id").alias("id"))


def earlier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that an earlier daily run has met: orders placed before its day."""
    before = F.col("o_orderdate") < F.lit(RUN_DAY).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where(before).select(F.col("o_orderkey").alias("id"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids seen per day, newest first."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("run"),
        (-micros(F.col("ts"))).alias("newest"),
        "event_id",
        F.col("user_id").alias("id"),
    )
