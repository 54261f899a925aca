"""The registered queries as plain SQL over the same tables, for checking.

Where a query extracts facts from text that a view has written, the SQL states
the facts from the base columns instead of reading the text again.
"""

from __future__ import annotations

from tasador.queries.catalog import BRAND, SENDER, TEMPLATE
from tasador.queries.views import KNOWN_BEFORE, RUN_DAY, URL_BASE

LISTINGS = """
sizes as (
  select l_orderkey,
         sum(l_quantity) as m2_construidos,
         sum(case when l_returnflag = 'N' then l_quantity end) as m2_utiles,
         cast(count(*) as int) as habitaciones,
         cast(nullif(sum(case when l_linestatus = 'F' then 1 else 0 end), 0) as int) as banos,
         max(case when l_returnflag = 'R' then l_linenumber end) as planta_numero,
         max(case when l_discount >= 0.09 then 1 else 0 end) as terraza,
         max(case when l_tax >= 0.07 then 1 else 0 end) as ascensor,
         max(case when l_linenumber >= 6 then 1 else 0 end) as plaza_garaje
  from lineitem group by l_orderkey),
l as (
  select o_orderkey as id, n_name as localizacion, o_totalprice as precio,
         m2_construidos, m2_utiles, habitaciones, banos, planta_numero,
         case when o_custkey % 17 <> 0 then cast(year(o_orderdate) - o_custkey % 60 as int) end as ano_construccion,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as exterior,
         coalesce(terraza, 0) as terraza, coalesce(ascensor, 0) as ascensor,
         coalesce(plaza_garaje, 0) as plaza_garaje,
         case when o_orderpriority = '4-NOT SPECIFIED' then null
              when o_orderstatus = 'F' then 'Segunda mano/Buen estado'
              when o_orderstatus = 'O' then 'Segunda mano/Para reformar'
              when o_orderstatus = 'P' then 'Obra nueva' end as estado_vivienda,
         case when o_orderpriority = '1-URGENT' then 'individual: Gas natural'
              when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'central'
              else 'sin calefacción' end as calefaccion
  from orders join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey
       left join sizes on l_orderkey = o_orderkey)"""

RATED = LISTINGS + """,
rated as (
  select *, precio / m2_construidos as eur_m2 from l where m2_construidos <> 0 and precio is not null)"""

SCORED = RATED + """,
rates as (select localizacion as loc, avg(eur_m2) as rate from rated group by localizacion),
scored as (
  select l.*, rate * m2_construidos - precio as diferencia from l left join rates on loc = localizacion),
margins as (
  select *, greatest(case
      when localizacion in ('NATION_1', 'NATION_2', 'NATION_3') then
        case when precio >= 0 and precio < 180000 then precio * 0.03::double
             when precio >= 180000 and precio <= 1500000 then precio * 0.01::double else 0 end
      when localizacion in ('NATION_4', 'NATION_5') then
        case when precio >= 0 and precio < 150000 then precio * 0.05::double
             when precio >= 150000 and precio <= 1500000 then precio * 0.03::double else 0 end
      else
        case when precio >= 0 and precio < 150000 then precio * 0.1::double
             when precio >= 150000 and precio <= 1500000 then precio * 0.07::double else 0 end
      end, 0) as umbral
  from scored),
chosen as (select * from margins where diferencia >= umbral)"""

CLIENTS = """
c as (
  select c_custkey as cid, c_name as nombre, lower(c_name) || '@example.org' as email,
         case c_mktsegment when 'BUILDING' then 'Prueba gratuita' when 'FURNITURE' then ' Plan Mensual '
              when 'MACHINERY' then 'Plan Semestral' else 'Otro' end as membresia,
         case when c_custkey % 5 <> 0 then abs(c_acctbal) * 20 end as precio_min,
         case when c_custkey % 7 <> 0 then abs(c_acctbal) * 20 + 60000 end as precio_max,
         case when c_custkey % 3 <> 0 then c_custkey % 100 + 40 end as m2_min,
         case when c_custkey % 4 <> 0 then c_custkey % 150 + 90 end as m2_max,
         case when c_custkey % 6 = 0 then c_custkey % 4 end as planta_min,
         case when c_custkey % 8 = 0 then c_custkey % 5 + 2 end as planta_max,
         case when c_custkey % 2 <> 0 then c_custkey % 5 end as habitaciones_min,
         case when c_custkey % 9 = 0 then c_custkey % 3 + 1 end as banos_min,
         case when c_custkey % 3 = 0 then 1 when c_custkey % 3 = 1 then 0 end as wants_exterior,
         case when c_custkey % 5 = 1 then 'terraza' when c_custkey % 5 = 2 then 'ascensor, plaza_garaje'
              when c_custkey % 5 = 3 then 'helipuerto,terraza' end as extras,
         case when c_custkey % 3 = 1 then 'Segunda mano/Buen estado'
              when c_custkey % 3 = 2 then 'obra nueva, Segunda mano/Para reformar,' end as estados,
         case when c_custkey % 4 = 1 then 'NATION_' || c_nationkey
              when c_custkey % 4 = 2 then 'nation_' || (c_nationkey % 10) || ', ,Nation_2'
              when c_custkey % 4 = 3 then '_' || (c_nationkey % 3) end as barrios
  from customer),
people as (
  select *,
         coalesce(list_filter(list_transform(string_split(extras, ','), lambda x: trim(x)), lambda x: x <> ''), []) as extra_list,
         coalesce(list_filter(list_transform(string_split(estados, ','), lambda x: lower(trim(x))), lambda x: x <> ''), []) as estado_list,
         coalesce(list_filter(list_transform(string_split(barrios, ','), lambda x: trim(x)), lambda x: x <> ''), []) as barrio_list
  from c)"""


def _match(listings: str, quirks: bool = False) -> str:
    outside = "wants_exterior is null" if quirks else "coalesce(wants_exterior, 0) <> 1"
    no_states = "false" if quirks else "len(estado_list) = 0"
    no_places = "(len(barrio_list) = 0 and contains(lower(localizacion), 'nan'))" if quirks else "len(barrio_list) = 0"
    return f"""
matches as (
  select id as listing_id, cid as client_id from {listings} join people on
       (precio_min is null or precio >= precio_min) and (precio_max is null or precio <= precio_max)
   and (m2_min is null or m2_utiles >= m2_min) and (m2_max is null or m2_utiles <= m2_max)
   and (planta_min is null or planta_numero >= planta_min)
   and (planta_max is null or planta_numero <= planta_max)
   and (habitaciones_min is null or habitaciones >= habitaciones_min)
   and (banos_min is null or banos >= banos_min)
   and ({outside} or exterior = 1)
   and ({no_states} or list_contains(estado_list, lower(estado_vivienda)))
   and (not list_contains(extra_list, 'terraza') or terraza = 1)
   and (not list_contains(extra_list, 'ascensor') or ascensor = 1)
   and (not list_contains(extra_list, 'plaza_garaje') or plaza_garaje = 1)
   and ({no_places}
        or len(list_filter(barrio_list, lambda b: contains(lower(localizacion), lower(b)))) > 0))"""


USABLE = "(coalesce(m2_construidos, m2_utiles) is not null and habitaciones is not null and banos is not null)"

# the feature text of a part as the view words it
BASIC_TEXT = """concat_ws('; ',
  case when p_partkey % 11 <> 0 then (p_size + 20) || ' m² construidos, ' || (p_size + 10) || ' m² útiles' end,
  case when p_partkey % 7 <> 0 then (p_partkey % 5 + 1)
    || case when p_partkey % 5 = 0 then ' habitación' else ' habitaciones' end end,
  case when p_partkey % 6 <> 0 then (p_partkey % 3 + 1) || case when p_partkey % 3 = 0 then ' baño' else ' baños' end end,
  case p_partkey % 4 when 0 then 'Segunda mano/buen estado' when 1 then 'Segunda mano/para reformar'
    when 2 then 'Promoción de obra nueva' end,
  case p_partkey % 3 when 0 then 'Orientación oeste' when 1 then 'Orientación norte, sur' end,
  case when p_partkey % 5 <> 0 then 'Calefacción individual: Gas natural' end,
  case when p_partkey % 8 <> 0 then 'Planta ' || (p_partkey % 9) || 'ª exterior con ascensor' else 'Bajo interior' end,
  case when p_partkey % 10 <> 0 then 'Construido en ' || (p_partkey % 70 + 1950) end,
  case p_partkey % 12 when 1 then 'Trastero' when 2 then 'terraza y balcón' when 3 then 'Terraza' end,
  case p_partkey % 13 when 1 then 'Plaza de garaje incluida en el precio'
    when 2 then 'Garaje por 10.000 eur adicionales' end,
  case p_partkey % 14 when 1 then 'Armarios empotrados' when 2 then 'Armario empotrado' end,
  case when p_partkey % 15 = 1 then 'Acceso adaptado a personas con movilidad reducida' end)"""

REPORTED = SCORED + "," + CLIENTS + "," + _match("chosen")

PREDICTED = LISTINGS + """,
means as (select localizacion as loc, avg(precio) as y_hat from l group by localizacion),
oof as (
  select cast(id % 5 as int) as fold, precio as y, y_hat, abs(precio - y_hat) as r
  from l join means on loc = localizacion),
spread as (select fold as f, stddev_samp(r) as sd from oof group by fold),
metrics as (
  select fold, count(*) as n, avg(r * r) as mse, 1 - sum(r * r) / (count(*) * var_pop(y)) as r2
  from oof join spread on f = fold where r < 1.5 * sd group by fold)"""

RENDERED = """
p as (
  select o_orderkey as k, n_name, r_name, o_totalprice, o_orderpriority
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey)"""


def _hist(source: str, col: str, bins: int) -> str:
    return f"""
span as (
  select localizacion as loc,
         case when min({col}) = max({col}) then min({col}) - 0.5 else min({col}) end as lo,
         case when min({col}) = max({col}) then max({col}) + 0.5 else max({col}) end as hi
  from {source} where {col} is not null and localizacion is not null group by 1),
guess as (
  select loc, lo, hi, {col} as x,
         least(floor(({col} - lo) / (hi - lo) * {bins}), {bins - 1}) as g
  from {source} join span on loc = localizacion where {col} is not null),
binned as (
  select loc, case when x < lo + g * ((hi - lo) / {bins}) then g - 1
                   when x >= lo + (g + 1) * ((hi - lo) / {bins}) and g < {bins - 1} then g + 1
                   else g end as b
  from guess),
counted as (select loc, b, count(*) as n from binned group by 1, 2)
select span.loc as localizacion, cast(i as int) as bin,
       round(lo + i * ((hi - lo) / {bins}), 6) as lo, round(lo + (i + 1) * ((hi - lo) / {bins}), 6) as hi,
       coalesce(n, 0) as n
from span cross join (select unnest(range({bins})) as i)
     left join counted on counted.loc = span.loc and b = i"""


def _kde(source: str, col: str, bins: int, grid: int = 50) -> str:
    return f"""
span as (
  select localizacion as loc, count({col}) as total, min({col}) as lo, max({col}) as hi,
         stddev_samp({col}) * pow(count({col}), -0.2) as h
  from {source} where localizacion is not null group by 1 having stddev_samp({col}) > 0),
pts as (
  select *, lo + i * ((hi - lo) / {grid - 1}) as g
  from span cross join (select unnest(range({grid})) as i)),
sums as (
  select loc, i, g, total, lo, hi, h, sum(exp(-0.5 * ((g - {col}) / h) * ((g - {col}) / h))) as s
  from pts join {source} on loc = localizacion where {col} is not null group by all)
select loc as localizacion, cast(i as int) as point, round(g, 4) as x,
       round(s / (total * h * sqrt(2 * pi())) * total * ((hi - lo) / {bins}), 4) as curve
from sums"""


def _box(source: str, col: str, by: str) -> str:
    return f"""
box as (
  select {by} as k, count(*) as n, quantile_cont({col}, 0.25) as q1, quantile_cont({col}, 0.5) as median,
         quantile_cont({col}, 0.75) as q3
  from {source} where {col} is not null and {by} is not null group by 1),
fenced as (select *, q1 - 1.5 * (q3 - q1) as flo, q3 + 1.5 * (q3 - q1) as fhi from box),
ends as (
  select k, min(case when {col} between flo and fhi then {col} end) as lo,
         max(case when {col} between flo and fhi then {col} end) as hi,
         cast(sum(case when {col} between flo and fhi then 0 else 1 end) as bigint) as outliers
  from {source} join fenced on k = {by} where {col} is not null group by k)"""


def _box_rows(name: str) -> str:
    return f"""
select fenced.k as {name}, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
       round(least(lo, q1), 6) as whisker_lo, round(greatest(hi, q3), 6) as whisker_hi, outliers
from fenced join ends on ends.k = fenced.k"""


def _peers(on: str) -> str:
    return f"""with {RATED},
peers as (
  select {on} as k, count(*) as peers, avg(eur_m2) as m, min(eur_m2) as lo, max(eur_m2) as hi
  from rated where {on} is not null group by 1)
select id, {on} as peer_group, peers, round(m, 4) as peer_mean, round(lo, 4) as peer_min,
       round(hi, 4) as peer_max, round((eur_m2 - m) * 100 / m, 4) as vs_mean_pct,
       round(lo * 0.9, 4) as axis_lo, round(greatest(hi, eur_m2) * 1.1, 4) as axis_hi
from rated join peers on k = {on}"""


def _strong(value: str, unit: str = "") -> str:
    return f"coalesce('<strong>' || {value} || '{unit}</strong>', '<strong>No definido</strong>')"


def _dotted(x: str) -> str:
    """Amounts have two decimals at most, so cents are exact."""
    whole = f"replace(format('{{:,}}', cast(floor({x}) as bigint)), ',', '.')"
    # printed to two places from the binary value, as both sides' printf does
    text = f"replace(format('{{:,.2f}}', {x}), ',', '.')"
    return f"case when {x} = floor({x}) then {whole} else regexp_replace({text}, '0$', '') end"


def _plain(x: str) -> str:
    return f"cast(cast({x} as bigint) as varchar)"


def _words(x: str) -> str:
    spaced = f"regexp_replace(trim(replace(replace({x}, ',', ', '), '_', ' ')), '\\s+', ' ', 'g')"
    return (
        f"array_to_string(list_transform(string_split({spaced}, ' '), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


def _intro() -> str:
    return """case
  when lower(trim(membresia)) = 'prueba gratuita' then '¡Gracias por comenzar tu <strong>prueba gratuita</strong>! Durante los próximos <strong>7 días</strong> recibirás informes automáticos con pisos que se ajustan a tus criterios y que representen buenas oportunidades.'
  when contains(lower(membresia), 'mensual') then 'Has activado tu suscripción al <strong>' || trim(membresia) || '</strong>. Durante los próximos <strong>30 días</strong> recibirás informes automáticos con pisos que encajen con tus criterios y detectemos como buenas oportunidades.'
  when contains(lower(membresia), 'semestral') then 'Has activado tu suscripción al <strong>' || trim(membresia) || '</strong>. Durante los próximos <strong>6 meses</strong> recibirás informes automáticos con pisos que cumplan tus filtros y representen oportunidades destacadas.'
  end"""


_SHOWN = {
    "Precio mínimo": _strong(_dotted("precio_min"), " €"),
    "Precio máximo": _strong(_dotted("precio_max"), " €"),
    "Metros mínimos": _strong(_plain("m2_min"), " m²"),
    "Metros máximos": _strong(_plain("m2_max"), " m²"),
    "Planta mínima": _strong(_plain("planta_min")),
    "Planta máxima": _strong(_plain("planta_max")),
    "Habitaciones mínimas": _strong(_plain("habitaciones_min")),
    "Baños mínimos": _strong(_plain("banos_min")),
    "Exterior": "case when wants_exterior = 1 then '<strong>Sí</strong>' else '<strong>No o no definido</strong>' end",
    "Extras": _strong(_words("extras")),
    "Estado vivienda": _strong(_words("estados")),
    "Barrios de interés": _strong(_words("barrios")),
}


def _welcome() -> str:
    items = " || ".join(f"'<li>{label}: ' || {shown} || '</li>' || chr(10)" for label, shown in _SHOWN.items())
    return f"""with {CLIENTS}
select cid as client_id, email as recipient, 'welcome' as kind, 'Bienvenido a {BRAND}' as subject,
  '<html><body>' || chr(10) || '<p><strong>¡Bienvenido a tu ' || trim(membresia) || '!</strong></p>' || chr(10)
  || '<p>Hola ' || nombre || ',</p>' || chr(10) || '<p>' || {_intro()} || '</p>' || chr(10)
  || '<p>🔍 Estas son las especificaciones que has definido:</p>' || chr(10) || '<ul>' || chr(10)
  || {items} || '</ul>' || chr(10)
  || '<p>Si deseas ajustar cualquier preferencia, puedes escribirnos a <a href="mailto:{SENDER}">{SENDER}</a> o responder a este correo.</p>' || chr(10)
  || '<p>Gracias por confiar en nosotros.<br>El equipo de {BRAND}.</p>' || chr(10) || '</body></html>' as body
from people where {_intro()} is not null"""


INTERVAL = SCORED + """,
est as (
  select *, cast(round_even((precio + diferencia) / 10000, 0) * 10000 as bigint) as estimacion,
    cast(case when diferencia is not null then greatest(
      floor((precio + diferencia - 10000 - 0.66::double * diferencia) / 10000) * 10000,
      floor((precio + 9999) / 10000) * 10000) end as bigint) as minimo,
    cast(floor((precio + diferencia + 10000 - 0.66::double * diferencia) / 10000) * 10000 as bigint) as maximo
  from scored),
priced as (
  select *, case when minimo = maximo then '\\num{' || minimo || '} €'
                 else '\\num{' || minimo || '} - \\num{' || maximo || '} €' end as intervalo
  from est)"""


def _report() -> str:
    def whole(c: str) -> str:
        return f"cast(cast(trunc({c}) as bigint) as varchar)"

    values = {
        "ID": "cast(id as varchar)",
        "LOCALIZACION": "localizacion",
        "PRECIO": whole("precio"),
        "M2_CONSTRUIDOS": whole("m2_construidos"),
        "M2_UTIL": whole("m2_utiles"),
        "HABITACIONES": whole("habitaciones"),
        "BANOS": whole("banos"),
        "ESTADO": "estado_vivienda",
        "ASCENSOR": "case when ascensor = 1 then 'Sí' else 'No' end",
        "CALEFACCION": "calefaccion",
        "ANO": whole("ano_construccion"),
        "ESTIMACION": "cast(estimacion as varchar)",
        "MINIMO": "cast(minimo as varchar)",
        "MAXIMO": "cast(maximo as varchar)",
        "INTERVALO": "intervalo",
    }
    block = "\\begin{tcolorbox}\\includegraphics{portada}\\end{tcolorbox}"
    text = f"case when exterior = 1 then '{TEMPLATE}' else '{TEMPLATE.replace(block, '')}' end"
    for name, value in values.items():
        text = f"replace({text}, '{{{{{name}}}}}', coalesce({value}, 'No definido'))"
    return f"with {INTERVAL} select id as listing_id, {text} as report from priced"


# k: part key; basic and extra texts are missing for some parts
_BASIC = "case when p_partkey % 16 <> 0 and ({0}) then {1} end"
_FLAG = "cast(case when p_partkey % {0} <> 0 and ({1}) then 1 else 0 end as int) as {2}"


def _text_entities(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"replace({x}, '&amp;', '&')"


_VISIBLE = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
)


def _elem(pattern: str) -> str:
    found = f"regexp_extract({_VISIBLE}, '(?is){pattern}', 1)"
    return f"case when regexp_matches({_VISIBLE}, '(?is){pattern}') then {_text_entities(found)} end"


_SERVED = "event_id // 30 % 11 <> 10"
_ARRIVED = f"select o_orderkey from orders where o_orderdate >= timestamp '{RUN_DAY}'"
_KNOWN = f"select distinct user_id from events where event_type = 'signup' and ts < timestamp '{KNOWN_BEFORE}'"

ORACLES: dict[str, str] = {
    "feature_ints": f"""select p_partkey as id,
  cast({_BASIC.format('p_partkey % 11 <> 0', 'p_size + 20')} as int) as m2_construidos,
  cast({_BASIC.format('p_partkey % 11 <> 0', 'p_size + 10')} as int) as m2_utiles,
  cast({_BASIC.format('p_partkey % 7 <> 0', 'p_partkey % 5 + 1')} as int) as habitaciones,
  cast({_BASIC.format('p_partkey % 6 <> 0', 'p_partkey % 3 + 1')} as int) as banos,
  cast({_BASIC.format('p_partkey % 8 <> 0', 'p_partkey % 9')} as int) as planta_numero,
  cast({_BASIC.format('p_partkey % 10 <> 0', 'p_partkey % 70 + 1950')} as int) as ano_construccion
from part""",
    "feature_flags": "select p_partkey as id, "
    + ", ".join(
        _FLAG.format(missing, when, name)
        for missing, when, name in [
            (16, "p_partkey % 12 = 1", "trastero"),
            (16, "p_partkey % 12 in (2, 3)", "terraza"),
            (16, "p_partkey % 12 = 2", "balcon"),
            (16, "p_partkey % 8 <> 0", "ascensor"),
            (16, "p_partkey % 14 = 1", "armarios_empotrados"),
            (16, "p_partkey % 13 in (1, 2)", "plaza_garaje"),
            (16, "p_partkey % 13 = 1", "garaje_incluido"),
            (16, "p_partkey % 13 = 2", "garaje_adicional"),
            (16, "p_partkey % 15 = 1", "adaptado_movilidad_reducida"),
            (16, "p_partkey % 8 <> 0", "exterior"),
            (16, "p_partkey % 8 = 0", "interior"),
            (16, "p_partkey % 3 = 0", "orientacion_este"),
            (16, "p_partkey % 3 = 0", "orientacion_oeste"),
            (16, "p_partkey % 3 = 1", "orientacion_norte"),
            (16, "p_partkey % 3 = 1", "orientacion_sur"),
            (18, "p_partkey % 3 = 0", "jardin"),
            (18, "p_partkey % 2 = 0", "piscina"),
            (18, "p_partkey % 5 = 0", "aire_acondicionado"),
            (18, "p_partkey % 7 = 0", "zonas_verdes"),
        ]
    )
    + " from part",
    "feature_labels": """select p_partkey as id,
  case when p_partkey % 16 = 0 then null when p_partkey % 4 = 0 then 'Segunda mano/Buen estado'
       when p_partkey % 4 = 1 then 'Segunda mano/Para reformar' when p_partkey % 4 = 2 then 'Obra nueva' end as estado_vivienda,
  case when p_partkey % 16 <> 0 and p_partkey % 5 <> 0 then 'individual: Gas natural' else 'sin calefacción' end as calefaccion
from part""",
    "feature_legacy": "select p_partkey as id, "
    "case when p_partkey % 16 = 0 then null when p_partkey % 4 = 0 then 'Segunda mano/Buen estado' "
    "when p_partkey % 4 = 1 then 'Segunda mano/para reformar' "
    "when p_partkey % 4 = 2 then 'Promoción de obra nueva' end as estado_vivienda, "
    + ", ".join(
        _FLAG.format(16, when, name)
        for when, name in [
            ("p_partkey % 12 = 1", "trastero"),
            ("p_partkey % 12 = 3", "terraza"),
            ("false", "balcon"),
            ("p_partkey % 14 in (1, 2)", "armarios_empotrados"),
        ]
    )
    + " from part",
    "document_flags": r"""select doc_id,
  cast(contains(lower(text), 'the ') or contains(lower(text), 'que ') as int) as either,
  cast(contains(text, 'The ') as int) as cased,
  cast(regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}_])(de|une)([^\p{L}\p{M}\p{N}_]|$)') as int) as word
from documents""",
    "document_accents": "select doc_id, strip_accents(text) as plain from documents",
    "clean_areas": f"""with {LISTINGS}
select id, coalesce(m2_construidos, m2_utiles) as m2_construidos, coalesce(m2_utiles, m2_construidos) as m2_utiles,
       coalesce(planta_numero, 0) as planta_numero, coalesce(estado_vivienda, 'Desconocido') as estado_vivienda
from l where (m2_construidos is not null or m2_utiles is not null)
  and habitaciones is not null and banos is not null""",
    "impute_means": f"""with {LISTINGS}
select id, """
    + ", ".join(
        f"round(coalesce({c}, (select avg({c}) from l)), 6) as {c}"
        for c in ["m2_construidos", "m2_utiles", "habitaciones", "banos", "planta_numero", "ano_construccion"]
    )
    + " from l",
    "price_per_area": f"with {RATED} select id, eur_m2 from rated",
    "page_titles": f"""select page_id, {_elem('<title[^>]*>(.*?)</title>')} as title,
  {_elem('<h1[^>]*>(.*?)</h1>')} as h1, {_elem('<div class="ad">(.*?)</div>')} as ad from pages""",
    "page_items": f"""select page_id, nullif(array_to_string(list_transform(
    regexp_extract_all(regexp_extract({_VISIBLE}, '(?is)<nav>(.*?)</nav>', 1), '(?is)<li>(.*?)</li>', 1),
    lambda x: trim({_text_entities('x')})), '; '), '') as items from pages""",
    "page_links": f"""select page_id, cast(i - 1 as int) as pos, {_text_entities('href')} as href from (
  select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\shref="([^"]*)"[^>]*>', 1)) as href,
         generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*\\shref="([^"]*)"[^>]*>', 1), 1) as i
  from pages)""",
    "listing_pages": f"""with {RENDERED}
select k as id, 'Piso n.º ' || k || ' & garaje' as titulo, n_name as localizacion,
  case when k % 37 <> 0 and k % 31 <> 0 then cast(floor(o_totalprice) as bigint) end as precio,
  case when k % 7 <> 0 then (k % 90 + 30) || ' m² construidos; ' || (k % 5 + 1) || ' habitaciones; Planta ' || (k % 9) end as basicas,
  case when k % 11 <> 0 then 'Piscina' end as extra,
  case when k % 5 <> 0 then 'Vivienda ' || o_orderpriority else 'No disponible' end as descripcion,
  case when k % 3 <> 0 then 'https://img.example/' || k || '.jpg?w=1&h=2' end as portada,
  cast(case when k % 37 <> 0 and k % 31 = 0 then 1 else 0 end as int) as bad_price
from p where k % 29 <> 0""",
    "rejected_pages": f"with {RENDERED} select k as id, 'no title' as reason from p where k % 29 = 0",
    "index_ids": f"""select cast(event_id // 30 as int) as page,
  cast(row_number() over (partition by event_id // 30 order by event_id) - 1 as int) as pos, event_type,
  cast(user_id as varchar) as id from events where {_SERVED}""",
    "price_parse": """select o_orderkey as id,
  case when o_orderkey % 9 = 0 then null
       when o_orderkey % 9 = 2 and o_totalprice >= 1000 then null
       else cast(floor(o_totalprice) as bigint) end as precio, o_orderpriority as lugar from orders""",
    "new_ids": f"select distinct user_id as id from events where user_id not in ({_KNOWN})",
    "kept_listings": """select o_orderkey as id, o_totalprice as precio from orders
where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""",
    "seen_streak_cut": f"""with known as ({_KNOWN}),
s as (
  select cast(cast(ts as date) as varchar) as run, user_id as id, event_id, ts,
         case when user_id in (select user_id from known) then 1 else 0 end as seen,
         row_number() over (partition by cast(ts as date) order by ts desc, event_id) as nth
  from events),
islands as (select *, sum(1 - seen) over (partition by run order by nth) as island from s),
streaks as (select *, sum(seen) over (partition by run, island order by nth) as streak from islands),
cuts as (select run as r, min(nth) as cut from streaks where streak >= 5 group by run)
select run, id, arg_min(event_id, nth) as event_id from streaks left join cuts on r = run
where seen = 0 and (cut is null or nth < cut) group by run, id""",
    "append_new": f"""with {LISTINGS}
select id, precio, case when estado_vivienda <> 'Obra nueva' or estado_vivienda is null then localizacion end as localizacion,
  case when estado_vivienda = 'Obra nueva' then habitaciones end as habitaciones from l""",
    "threshold_select": f"""with {SCORED}
select id, precio, umbral, round(diferencia, 2) as diferencia from chosen""",
    "match_preferences": f"with {LISTINGS}, {CLIENTS}, {_match('l')} select * from matches",
    "match_quirks": f"with {LISTINGS}, {CLIENTS}, {_match('l', quirks=True)} select * from matches",
    "clients_per_listing": f"""with {REPORTED}
select id as listing_id, 0 as part, coalesce(string_agg(client_id, ',' order by client_id), '') as clients,
       cast(count(client_id) as int) as n from chosen left join matches on id = listing_id group by 1""",
    "reports_per_client": f"""with {REPORTED}
select client_id, 0 as part, string_agg(listing_id, ',' order by listing_id) as listings,
       cast(count(*) as int) as n from matches group by 1""",
    "daily_run": f"""with {REPORTED}
select id, round(any_value(diferencia), 2) as diferencia, 0 as part,
       coalesce(string_agg(client_id, ',' order by client_id), '') as clients,
       cast(count(client_id) as int) as n, 'No' as seleccionado, '{URL_BASE}' || id || '/' as enlace
from chosen left join matches on id = listing_id where id in ({_ARRIVED}) group by id""",
    "run_counts": f"""with {REPORTED}
select 'daily' as run, (select count(*) from l where id in ({_ARRIVED})) as found,
       (select count(*) from chosen where id in ({_ARRIVED})) as kept,
       count(distinct listing_id) as matched, count(*) as matches from matches where listing_id in ({_ARRIVED})""",
    "outbox_two_runs": f"""with {REPORTED}
select client_id, 'report' as kind, case when listing_id % 2 = 0 then 'monday' else 'tuesday' end as run,
       count(*) as n_reports from matches group by 1, 2, 3""",
    "condition_rank": f"""with {LISTINGS},
counted as (
  select localizacion, estado_vivienda, count(*) as n from l where estado_vivienda is not null group by 1, 2
  union all select '*', estado_vivienda, count(*) from l where estado_vivienda is not null group by 2)
select localizacion, estado_vivienda, n,
       row_number() over (partition by localizacion order by n desc, estado_vivienda) as rank from counted""",
    "raw_roundtrip": f"""select p_partkey as id, 'Centro; norte' as localizacion, p_partkey * 1000 as precio,
       coalesce(length(text), 0) as basicas
from (select p_partkey, case when p_partkey % 16 <> 0 then {BASIC_TEXT} end as text from part)""",
    "clients_roundtrip": f"""with {CLIENTS}
select cid as id, precio_min, wants_exterior as exterior, array_to_string(extra_list, ',') as extras,
       array_to_string(estado_list, ',') as estados_vivienda, array_to_string(barrio_list, ',') as barrios_interes
from people""",
    "matches_roundtrip": f"""with {REPORTED}
select listing_id, string_agg(client_id, ',' order by client_id) as clients from matches group by 1""",
    "train_test_folds": f"""with {LISTINGS},
parts as (
  select id, cast(('0x' || substr(md5(id || ':42'), 1, 8)) as bigint) % 5 = 0 as held,
         cast(cast(('0x' || substr(md5(id || ':43'), 1, 8)) as bigint) % 5 as int) as fold from l)
select id, case when held then 'test' else 'train' end as part, case when held then -1 else fold end as fold from parts""",
    **{
        f"{model}_scores": f"""with {LISTINGS}
select '{model}' as model, count(*) as listings, count(*) filter ({usable}) as estimates, cast(0 as bigint) as off,
       true as better, true as drawn from l"""
        for model, usable in {
            "forest": USABLE, "bagging": USABLE, "boosting": USABLE, "kernel": "true"
        }.items()
    },
    "weighted_scores": f"""with {LISTINGS}
select id, {USABLE} as forest, {USABLE} as bagging, {USABLE} as boosting, true as kernel, true as inside,
       true as difference from l""",
    "depth_metrics": f"""with {LISTINGS},
told as (
  select cast(cast(('0x' || substr(md5(id || ':43'), 1, 8)) as bigint) % 5 as int) as fold
  from l where {USABLE} and cast(('0x' || substr(md5(id || ':42'), 1, 8)) as bigint) % 5 <> 0)
select depth, fold, count(*) as told, count(*) as ids, count(*) as values, true as finite, true as better, true as least
from told, (select cast(unnest(range(3, 20)) as int) as depth) group by 1, 2""",
    "interested_counts": f"""with {REPORTED}
select listing_id as id, count(*) as n_clientes from matches group by 1""",
    "subspace_members": """
select cast(unnest(range(5)) as int) as member, true as own, true as half, true as differs, true as splits""",
    "split_sizes": f"""with {LISTINGS}
select count(*) as listings, count(*) as equal, 0 as small, true as fewer from l where {USABLE}""",
    "condition_share": f"""with {LISTINGS}
select localizacion, estado_vivienda, count(*) as n,
       round(count(*) * 100.0::double / sum(count(*)) over (partition by localizacion), 6) as pct
from l where estado_vivienda is not null group by 1, 2""",
    "condition_marked": f"""with {LISTINGS},
shares as (
  select localizacion as loc, estado_vivienda as e,
         round(count(*) * 100.0::double / sum(count(*)) over (partition by localizacion), 6) as pct
  from l where estado_vivienda is not null group by 1, 2)
select id as subject, e as estado_vivienda, pct, cast(coalesce(e = estado_vivienda, false) as int) as highlight
from l join shares on loc = localizacion""",
    "price_histogram": f"with {LISTINGS}, {_hist('l', 'precio', 30)}",
    "rate_histogram": f"with {RATED}, {_hist('rated', 'eur_m2', 25)}",
    "rooms_histogram": f"""with {LISTINGS},
span as (select localizacion as loc, min(habitaciones) as a, max(habitaciones) as b from l where habitaciones is not null group by 1),
every as (select loc, unnest(range(a, b + 1)) as v from span),
counted as (select localizacion, habitaciones, count(*) as n from l group by 1, 2)
select loc as localizacion, cast(v as bigint) as value, coalesce(n, 0) as n
from every left join counted on localizacion = loc and habitaciones = v""",
    "price_kde": f"with {LISTINGS}, {_kde('l', 'precio', 30)}",
    "rate_kde": f"with {RATED}, {_kde('rated', 'eur_m2', 25)}",
    "summary_bins": f"""with {LISTINGS}
select localizacion, cast(floor(precio / 10000) as bigint) as bin, count(*) as n
from l where localizacion is not null and precio is not null group by 1, 2""",
    "summary_moments": f"""with {LISTINGS}
select localizacion, count(*) as n, round(avg(precio), 4) as mean, round(stddev_samp(precio), 4) as sd,
       min(cast(precio as double)) as lo, max(cast(precio as double)) as hi, true as within
from l where localizacion is not null and precio is not null group by 1""",
    "area_box": f"with {LISTINGS}, {_box('l', 'm2_construidos', 'localizacion')} {_box_rows('localizacion')}",
    "rooms_box": f"with {RATED}, {_box('rated', 'eur_m2', 'habitaciones')} {_box_rows('habitaciones')}",
    "rate_outliers": f"""with {RATED}, {_box('rated', 'eur_m2', 'habitaciones')}
select id, habitaciones, eur_m2 from rated join fenced on k = habitaciones where not eur_m2 between flo and fhi""",
    "trend_area": f"""with {RATED}
select count(*) as n, round(regr_slope(eur_m2, m2_construidos), 6) as slope,
       round(regr_intercept(eur_m2, m2_construidos), 6) as intercept, round(regr_r2(eur_m2, m2_construidos), 6) as r2
from rated""",
    "trend_year": f"""with {LISTINGS}
select localizacion, count(*) as n, round(regr_slope(precio, ano_construccion), 4) as slope,
       round(regr_intercept(precio, ano_construccion), 4) as intercept, round(regr_r2(precio, ano_construccion), 4) as r2
from l where ano_construccion is not null group by 1""",
    "axis_clip": f"""with {RATED},
q as (select localizacion, quantile_cont(eur_m2, 0.02) as a, quantile_cont(eur_m2, 0.98) as b from rated group by 1)
select localizacion, round(a, 6) as q_lo, round(b, 6) as q_hi, round(a - (b - a) * 0.05, 6) as axis_lo,
       round(b + (b - a) * 0.05, 6) as axis_hi from q""",
    "city_axis_clip": f"""with {RATED},
q as (select quantile_cont(eur_m2, 0.02) as a, quantile_cont(eur_m2, 0.98) as b from rated)
select round(a, 6) as q_lo, round(b, 6) as q_hi, round(a - (b - a) * 0.05, 6) as axis_lo,
       round(b + (b - a) * 0.05, 6) as axis_hi from q""",
    "price_axis": f"""with {LISTINGS}
select localizacion, count(*) as n, round(min(precio) * 0.95, 6) as axis_lo, round(max(precio) * 1.1, 6) as axis_hi
from l group by 1""",
    "peers_by_location": _peers("localizacion"),
    "peers_by_rooms": _peers("habitaciones"),
    "price_interval": f"with {INTERVAL} select id, estimacion, minimo, maximo, intervalo from priced",
    "listing_reports": _report(),
    "welcome_messages": _welcome(),
    "preference_texts": f"""with {CLIENTS}
select cid as id, {_SHOWN['Precio mínimo']} as precio_min, {_SHOWN['Metros mínimos']} as m2_min,
  {_SHOWN['Planta mínima']} as planta_min, {_SHOWN['Exterior']} as exterior, {_SHOWN['Extras']} as extras,
  {_SHOWN['Barrios de interés']} as barrios_interes, {_intro()} as intro from people""",
    "preference_lists": f"""with {CLIENTS}
select cid as id, array_to_string(extra_list, ',') as extras, array_to_string(estado_list, ',') as estados_vivienda,
  array_to_string(barrio_list, ',') as barrios_interes from people""",
    "report_messages": f"""with {REPORTED}
select client_id, any_value(email) as recipient, 'report' as kind, '' as run,
  'Informes inmobiliarios recientes - Oportunidades destacadas para ti' as subject,
  'Estimado/a ' || any_value(nombre) || ',' || chr(10) || chr(10)
  || 'Te adjuntamos los informes más recientes que cumplimentan tus preferencias de inversión.' || chr(10) || chr(10)
  || 'Un cordial saludo,' || chr(10) || 'El equipo de {BRAND}.' as body, count(*) as n_reports
from matches join chosen on id = listing_id join people on cid = client_id where exterior = 1 group by client_id""",
    "report_attachments": f"""with {REPORTED}
select client_id, listing_id from matches join chosen on id = listing_id where exterior = 1""",
    "review_sheet": f"""with {SCORED}
select id, 'No' as seleccionado, '{URL_BASE}' || id || '/' as enlace from chosen""",
    "reviewed_listings": "select o_orderkey as id, o_totalprice as precio from orders where o_orderkey % 6 in (0, 1, 2)",
    "csv_roundtrip": f"""with {LISTINGS}
select id, localizacion, cast(trunc(precio) as bigint) as precio, cast(m2_construidos as int) as m2_construidos,
  cast(m2_utiles as int) as m2_utiles, habitaciones, planta_numero, estado_vivienda, calefaccion from l""",
    "known_ids_append": f"""with {RENDERED}
select k as id from p where k % 29 <> 0 and (k % 37 = 0 or k % 31 <> 0)""",
    "trimmed_metrics": f"""with {PREDICTED}
select 'mean' as model, fold, n, round(mse, 0) as mse, round(r2, 6) as r2 from metrics""",
    "mean_metrics": f"""with {PREDICTED}
select 'mean' as model, count(*) as folds, round(avg(mse), 0) as mse, round(avg(r2), 6) as r2 from metrics""",
    "best_depth": f"""with {PREDICTED}
select fold as depth, round(mse, 0) as mse from metrics order by metrics.mse, fold limit 1""",
    "one_hot_levels": f"""with {LISTINGS},
t as (
  select id, localizacion, coalesce(estado_vivienda, 'Desconocido') as estado from l
  where (m2_construidos is not null or m2_utiles is not null) and habitaciones is not null and banos is not null)
select id, cast(dense_rank() over (order by localizacion) as int) as location_level,
  cast(dense_rank() over (order by estado) as int) as condition_level,
  cast((select count(distinct localizacion) from t) as int) as locations,
  cast((select count(distinct estado) from t) as int) as conditions from t""",
    "stream_new_ids": f"""select user_id as id, min(event_id) as event_id from events
where user_id not in ({_KNOWN}) group by 1""",
    "stream_unique": "select distinct user_id as id from events",
    "stream_notify": f"with {REPORTED} select client_id, listing_id from matches",
}
ORACLES["summary_trend"] = ORACLES["trend_year"]
ORACLES["match_indexed"] = ORACLES["match_preferences"]
ORACLES["stream_streak_cut"] = ORACLES["seen_streak_cut"]
ORACLES["index_ids"] = f"""select page, pos, id from ({ORACLES['index_ids']}) where event_type <> 'error'"""
ORACLES["stream_features"] = f"""select f.id, m2_utiles, banos, ascensor, estado_vivienda, piscina
from ({ORACLES['feature_ints']}) f join ({ORACLES['feature_flags']}) g on f.id = g.id
     join ({ORACLES['feature_labels']}) h on f.id = h.id"""
