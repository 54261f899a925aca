"""Rule tables: edit these, not the operators, to change what is detected."""

from __future__ import annotations

# --- Fixed values: feature text patterns (first capture group is the value) ---
INT_PATTERNS = {
    "m2_construidos": r"(\d+)\s*m² construidos",
    "m2_utiles": r"(\d+)\s*m² útiles",
    "habitaciones": r"(\d+)\s*habitaci[oó]n(?:es)?",
    "banos": r"(\d+)\s*bañ(?:o|os)",
    "planta_numero": r"Planta (\d+)",
}
LOWERED_INT_PATTERNS = {"ano_construccion": r"construido en\s*(\d+)"}
HEATING_PATTERN = r"Calefacción ([^;]+)"
NO_HEATING = "sin calefacción"

# --- Fixed values: column -> wordings, any of which sets the flag ---
BASIC_FLAGS = {
    "trastero": ["trastero"],
    "terraza": ["terraza"],
    "balcon": ["balcón"],
    "ascensor": ["con ascensor"],
    "armarios_empotrados": ["armarios empotrados"],
    "plaza_garaje": ["garaje"],
    "garaje_incluido": ["incluida"],
    "garaje_adicional": ["adicionales"],
    "adaptado_movilidad_reducida": ["movilidad reducida"],
}
SIDE_FLAGS = {"Exterior": ["exterior"], "Interior": ["interior"]}
ORIENTATION_FLAGS = {
    "orientacion_este": ["este"],
    "orientacion_oeste": ["oeste"],
    "orientacion_norte": ["norte"],
    "orientacion_sur": ["sur"],
}
EXTRA_FLAGS = {
    "jardin": ["jardín"],
    "piscina": ["piscina"],
    "aire_acondicionado": ["aire acondicionado"],
    "zonas_verdes": ["zonas verdes"],
}
# the older extraction: capitalised wording, singular wardrobe accepted
LEGACY_CASED_FLAGS = {"trastero": ["Trastero"], "terraza": ["Terraza"], "balcon": ["Balcón"]}
LEGACY_WARDROBE = ["armarios empotrados", "armario empotrado"]

# --- Fixed values: lower-cased wording -> label, first hit wins ---
CONDITIONS = [
    ("segunda mano/buen estado", "Segunda mano/Buen estado"),
    ("segunda mano/para reformar", "Segunda mano/Para reformar"),
    ("promoción de obra nueva", "Obra nueva"),
]
LEGACY_CONDITIONS = [
    ("segunda mano/buen estado", "Segunda mano/Buen estado"),
    ("segunda mano/para reformar", "Segunda mano/para reformar"),
    ("promoción de obra nueva", "Promoción de obra nueva"),
]

# --- Fixed values: margin a listing must beat, by group of locations ---
LOCATION_GROUPS = {
    "prime": [
        "Actur",
        "Centro",
        "Grancasa",
        "Almozara",
        "Pol Universidad Romareda",
        "Doctor Cerrada",
        "Universidad San Francisco",
        "Paseo Sagasta",
        "Paseo Independencia",
        "Casco Historico",
        "Alfonso",
        "Paseo de la Constitución",
    ],
    "growth": ["Ranillas", "Plaza de Toros", "Barrio del AVE", "Mercado San Valero"],
}
# group -> (from, to, upper bound included, share of the price)
THRESHOLD_BANDS = {
    "prime": [(0, 180_000, False, 0.03), (180_000, 1_500_000, True, 0.01)],
    "growth": [(0, 150_000, False, 0.05), (150_000, 1_500_000, True, 0.03)],
    "other": [(0, 150_000, False, 0.10), (150_000, 1_500_000, True, 0.07)],
}

# --- Fixed values: captured pages ---
TITLE_CLASS = "main-info__title-main"
LOCATION_CLASS = "main-info__title-minor"
PRICE_CLASS = "txt-bold"
BASIC_CLASS = "details-property-feature-one"
EXTRA_CLASS = "details-property-feature-two"
DESCRIPTION_CLASS = "adCommentsLanguage"
COVER_CLASS = "first-image"
INDEX_CLASS = "listing-items"
NO_DESCRIPTION = "No disponible"

# --- Fixed values: training ---
UNKNOWN = "Desconocido"
TRIM = 1.5

# --- Fixed values: review and messages ---
SELECTED_WORDS = ["true", "1", "yes"]
UNDEFINED = "No definido"
BLOCK_BEGIN = "\\begin{tcolorbox}"
BLOCK_END = "\\end{tcolorbox}"
TIERS = [
    (
        "exact",
        "prueba gratuita",
        "¡Gracias por comenzar tu <strong>prueba gratuita</strong>! Durante los próximos "
        "<strong>7 días</strong> recibirás informes automáticos con pisos que se ajustan a tus "
        "criterios y que representen buenas oportunidades.",
    ),
    (
        "contains",
        "mensual",
        "Has activado tu suscripción al <strong>{tier}</strong>. Durante los próximos "
        "<strong>30 días</strong> recibirás informes automáticos con pisos que encajen con tus "
        "criterios y detectemos como buenas oportunidades.",
    ),
    (
        "contains",
        "semestral",
        "Has activado tu suscripción al <strong>{tier}</strong>. Durante los próximos "
        "<strong>6 meses</strong> recibirás informes automáticos con pisos que cumplan tus "
        "filtros y representen oportunidades destacadas.",
    ),
]
# label, client column, unit
PREFERENCE_LINES = [
    ("Precio mínimo", "precio_min", "price"),
    ("Precio máximo", "precio_max", "price"),
    ("Metros mínimos", "m2_min", "area"),
    ("Metros máximos", "m2_max", "area"),
    ("Planta mínima", "planta_min", "plain"),
    ("Planta máxima", "planta_max", "plain"),
    ("Habitaciones mínimas", "habitaciones_min", "plain"),
    ("Baños mínimos", "baños_min", "plain"),
    ("Exterior", "exterior", "yes"),
    ("Extras", "extras", "text"),
    ("Estado vivienda", "estados_vivienda", "text"),
    ("Barrios de interés", "barrios_interes", "text"),
]
WELCOME_SUBJECT = "Bienvenido a {brand}"
WELCOME_TITLE = ("¡Bienvenido a tu ", "!")
GREETING = "Hola "
PREFERENCES_TITLE = "🔍 Estas son las especificaciones que has definido:"
WELCOME_HELP = (
    "Si deseas ajustar cualquier preferencia, puedes escribirnos a "
    '<a href="mailto:{sender}">{sender}</a> o responder a este correo.'
)
WELCOME_END = "Gracias por confiar en nosotros.<br>El equipo de {brand}."
REPORT_GREETING = "Estimado/a "
REPORT_END = "Un cordial saludo,\nEl equipo de {brand}."
REPORT_SUBJECT = "Informes inmobiliarios recientes - Oportunidades destacadas para ti"
REPORT_BODY = (
    "Te adjuntamos los informes más recientes que cumplimentan tus preferencias de inversión."
)
