"""Codes, limits, word lists and mappings, and the small dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLATFORMS = ("vinted", "wallapop")
CATEGORIES = ("moda", "electronica", "hogar", "libros", "otros")
GENDERS = ("hombre", "mujer", "niño", "niña", "unisex")
CONDITIONS = ("PRECINTADO", "NUEVO", "COMO_NUEVO", "MUY_BUENO", "BUENO", "ACEPTABLE", "PARA_REPARAR")  # best to worst
BROKEN_LEVEL = 6  # the one level that does not work
CHOICES = {"Nuevo": 1, "Como nuevo": 2, "Muy bueno": 3, "Bueno": 4, "Satisfactorio": 5, "Para reparar": 6}
WALLAPOP_FASHION = ("Nuevo", "Nuevo", "Como nuevo", "Buen estado", "Buen estado", "En condiciones aceptables", "En condiciones aceptables")
WALLAPOP_OTHER = ("Sin abrir", "Nuevo", "Como nuevo", "Buen estado", "Buen estado", "En condiciones aceptables", "Lo ha dado todo")
VINTED_LITERALS = ("Nuevo", "Nuevo", "Como nuevo", "Muy bueno", "Bueno", "Satisfactorio", "Satisfactorio")
VINTED_BROKEN_ELECTRONICS = "Necesita reparación"

TITLE_MAX = 100
TEXT_LIMITS = {("vinted", "title"): (5, 100), ("vinted", "description"): (5, 2000), ("wallapop", "title"): (1, 100), ("wallapop", "description"): (1, 600)}
PHOTO_LIMITS = {"wallapop": 10, "vinted": 20}
WEIGHT_STEPS_KG = (2, 5, 10, 20, 30)
MAX_COLOURS, MAX_MATERIALS = 2, 3

# (platform, field, required, type, max items)
FIELDS = (
    ("vinted", "title", True, "text", None),
    ("vinted", "description", True, "text", None),
    ("vinted", "fotos", True, "images", 20),
    ("vinted", "catalog_id", True, "category", None),
    ("vinted", "brand", True, "brand", None),
    ("vinted", "status_id", True, "condition", None),
    ("vinted", "price", True, "price", None),
    ("vinted", "package_size_id", True, "open_enum", None),
    ("vinted", "size_id", False, "size", None),
    ("vinted", "colores", False, "open_list", 2),
    ("vinted", "materiales", False, "open_list", 3),
    ("vinted", "largo_cm", False, "number", None),
    ("vinted", "ancho_cm", False, "number", None),
    ("wallapop", "title", True, "text", None),
    ("wallapop", "categoria", True, "category", None),
    ("wallapop", "description", True, "text", None),
    ("wallapop", "fotos", True, "images", 10),
    ("wallapop", "medidas", False, "text", None),
    ("wallapop", "estado", True, "condition", None),
    ("wallapop", "marca", False, "brand", None),
    ("wallapop", "hashtags", False, "text_list", None),
    ("wallapop", "precio", True, "price", None),
    ("wallapop", "tramo_peso_kg", True, "enum", None),
    ("wallapop", "ubicacion", True, "text", None),
)
ATTRIBUTES = {
    "moda": ("brand", "size", "color", "condition"),
    "electronica": ("brand", "model", "storage_capacity", "color", "condition"),
    "hogar": ("height_cm", "width_cm", "length_cm", "material", "color", "is_bulky"),
    "libros": ("isbn", "author", "publisher", "language", "book_format"),
}
COVERED = {
    "vinted": ("title", "description", "fotos", "brand", "status_id", "package_size_id"),
    "wallapop": ("title", "description", "fotos", "estado", "tramo_peso_kg", "ubicacion"),
}
BLOCK_ORDER = {
    "wallapop": ("resumen", "fotos", "categoria", "titulo_desc", "marca", "talla", "estado", "precio", "desperfectos", "tramo_peso_kg"),
    "vinted": ("fotos", "titulo_desc", "categoria", "marca", "talla", "desperfectos", "estado", "color", "composicion", "precio", "package_size"),
}
REQUIRED_FIELDS = ("categoria", "estado", "titulo", "descripcion")
IDENTITY_FIELDS = ("marca", "talla", "modelo", "ean")

BRANDS = (
    "nike", "adidas", "puma", "zara", "h&m", "mango", "levi's", "levis", "gucci", "prada", "louis vuitton", "apple",
    "samsung", "xiaomi", "sony", "lego", "ikea", "the north face", "reebok", "new balance", "converse", "vans",
    "calvin klein", "tommy hilfiger", "ralph lauren", "hugo boss", "michael kors", "coach", "bershka", "pull&bear",
    "stradivarius", "desigual",
)
GARMENTS = (
    "sudadera", "camiseta", "camisa", "pantalon", "vaquero", "jeans", "falda", "chaqueta", "abrigo", "vestido",
    "zapatilla", "zapato", "bota", "jersey", "chandal", "cazadora", "parka", "polo", "top", "body", "pijama", "bikini",
    "banador", "short", "bermuda", "mono", "leggings", "sujetador", "calcetin",
)
LIGHT_WORDS = ("camiseta", "camisetas", "top", "tops", "body", "calcetines", "ropa interior", "bufanda", "panuelo", "gorro", "gorra", "bikini", "bañador", "banador")
HEAVY_WORDS = ("abrigo", "abrigos", "botas", "bota", "zapatos", "zapatillas", "plancha", "caja", "masajeador", "electrodomestico", "manta", "edredon", "cazadora", "chaqueton", "parka")
RANKING_STOP_WORDS = (
    "de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "con", "sin", "para", "por", "en",
    "al", "a", "su", "sus", "mas", "otro", "otros", "otra", "otras", "talla", "color", "nuevo", "nueva", "usado",
    "usada", "estado", "buen", "bueno", "muy", "como", "the", "meses", "mes", "anos", "ano", "nino", "nina", "ninos",
    "ninas", "bebe", "bebes", "infantil", "junior", "kids",
)
DEFECT_STOP_WORDS = (
    "de", "la", "el", "en", "con", "un", "una", "unos", "unas", "los", "las", "y", "a", "por", "que", "se", "del",
    "al", "lo", "su", "sus", "es", "muy", "esta", "este", "sin", "hay", "tiene", "the",
)
GENDER_WORDS = {"hombre": ("hombre", "hombres", "masculino", "chico", "chicos"), "mujer": ("mujer", "mujeres", "femenino", "chica", "chicas")}
CHILD_WORDS = ("niño", "niña", "niños", "niñas", "bebé", "bebés", "infantil", "junior", "kids", "meses", "años")
ROOTS = {
    ("wallapop", "moda"): (12465,), ("wallapop", "electronica"): (24200,), ("wallapop", "hogar"): (12467, 13100), ("wallapop", "libros"): (12463,),
    ("vinted", "moda"): (1904, 5, 2993), ("vinted", "electronica"): (2994,), ("vinted", "hogar"): (1918,), ("vinted", "libros"): (2309,),
}
CHILD_ROOTS = {"wallapop": (12461,), "vinted": (1193,)}
LEAF_WEIGHT, PARENT_WEIGHT, ANCESTOR_WEIGHT = 3.0, 1.5, 0.5
GENDER_BONUS, GENDER_PENALTY, CHILD_BONUS, ADULT_PENALTY = 1.7, 0.25, 1.7, 0.4

LOCATIONS = ("etiqueta_interior", "estampado_o_grafico", "papel_manuscrito", "codigo_o_modelo_impreso", "otro")
CONTENTS = ("marca", "talla", "modelo", "ean", "desperfecto", "otro")
FIELD_LOCATIONS = {"marca": ("etiqueta_interior",), "talla": ("etiqueta_interior",), "modelo": ("etiqueta_interior", "codigo_o_modelo_impreso"), "ean": ("codigo_o_modelo_impreso",)}
DEFECT_MARKER, MARKER_DISTANCE = "DESPERFECTOS", 2
RULER_DIGITS, RULER_SHARE = 16, 0.9
LONG_WORDS, LONG_CHARS = 6, 40
CLEAN_SCORE, DOUBTFUL_SIMILARITY, WITNESS_CHARS = 0.85, 0.4, 3
NEAR_GAP_Y, NEAR_OVERLAP_X = 150, -400
MAX_REQUESTS, COLOUR_SAMPLE = 20, 3
EAN_LENGTHS = (8, 12, 13, 14)
PALETTE = (
    ("negro", 25, 25, 25), ("blanco", 240, 240, 240), ("gris", 130, 130, 130), ("gris claro", 195, 195, 195),
    ("gris oscuro", 75, 75, 75), ("beige", 222, 202, 173), ("marron", 101, 67, 33), ("rojo", 200, 30, 30),
    ("rojo vino", 110, 20, 40), ("rosa", 232, 160, 180), ("naranja", 230, 120, 30), ("amarillo", 230, 210, 60),
    ("verde", 60, 140, 60), ("azul", 40, 90, 180), ("azul marino", 20, 30, 70), ("morado", 120, 60, 150),
)
COLOUR_BIN = 32

SEARCHABLE_SOURCES = ("foto", "reviewer")
SOURCES = ("foto", "reviewer", "comparable", "inferido")
CONFIDENCES = ("alta", "media", "baja")
SEARCH_URLS = {"wallapop": "https://es.wallapop.com/search?keywords=", "vinted": "https://www.vinted.es/catalog?search_text="}
LEAST_COMPARABLES, MOST_COMPARABLES = 5, 15
GAP_SECONDS, LONG_PAUSE_SECONDS = 15.0, 600.0
NEAR_HASH_BITS = 5
IMAGE_TOKENS_IN, TEXT_TOKENS_IN, TOKENS_OUT = 1600, 800, 300
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif")
FORMULA_STARTS = "=+-@\t\r"

LATIN_FROM = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ"
LATIN_TO = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def literal(level: int, platform: str, category: str) -> str:
    """The condition text that a platform shows for a level."""
    if platform == "wallapop":
        return (WALLAPOP_FASHION if category == "moda" else WALLAPOP_OTHER)[level]
    if category == "electronica" and level == BROKEN_LEVEL:
        return VINTED_BROKEN_ELECTRONICS
    return VINTED_LITERALS[level]


def conditions(spark: SparkSession) -> DataFrame:
    """level, code, platform, category, literal: seven levels, five categories, two platforms."""
    rows = [(n, code, p, c, literal(n, p, c)) for n, code in enumerate(CONDITIONS) for p in PLATFORMS for c in CATEGORIES]
    return spark.createDataFrame(rows, "level int, code string, platform string, category string, literal string")


def choices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHOICES.items()), "choice string, level int")


def limits(spark: SparkSession) -> DataFrame:
    rows = [(p, f, low, high) for (p, f), (low, high) in TEXT_LIMITS.items()]
    return spark.createDataFrame(rows, "platform string, field string, least int, most int")


def fields(spark: SparkSession) -> DataFrame:
    rows = [(p, n, f, r, t, m, f in COVERED[p]) for n, (p, f, r, t, m) in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "platform string, pos int, field string, required boolean, type string, max_items int, covered boolean")


def attributes(spark: SparkSession) -> DataFrame:
    rows = [(c, n, a) for c, names in ATTRIBUTES.items() for n, a in enumerate(names)]
    return spark.createDataFrame(rows, "category string, pos int, attribute string")


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *x) for n, x in enumerate(PALETTE)], "ord int, name string, pr int, pg int, pb int")


def block_order(spark: SparkSession) -> DataFrame:
    rows = [(p, b, n) for p, names in BLOCK_ORDER.items() for n, b in enumerate(names)]
    return spark.createDataFrame(rows, "platform string, block string, pos int")


def roots(spark: SparkSession) -> DataFrame:
    rows = [(p, c, r) for (p, c), ids in ROOTS.items() for r in ids]
    return spark.createDataFrame(rows, "platform string, category string, root_id int")
