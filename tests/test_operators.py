"""Hand-made cases with exact rows, and laws over seeded random input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingops.functions import numbers as N
from listingops.functions import text as T
from listingops.operators import dedupe, evals, grouping, ledger, listings, ordering, pixels, pricing, readings, usage
from listingops.sources import dims, ingest, reports

START = datetime(2026, 5, 1, 10)
PHOTOS = "lot_id string, photo_id string, name string, captured_at timestamp, readable boolean, read_error string"


def photos(spark, lots):
    rows = [(lot, f"{lot}{n}", f"{n:03}.jpg", None if s is None or s == "bad" else START + timedelta(seconds=s), s != "bad", "broken" if s == "bad" else None) for lot, times in lots.items() for n, s in enumerate(times)]
    return spark.createDataFrame(rows, PHOTOS)


def one(spark, column, **values):
    types = {int: "bigint", str: "string", float: "double", type(None): "string", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def test_group_boundaries(spark):
    lots = {"below": [0, 14.9], "exact": [0, 15.0], "above": [0, 15.1], "single": [0], "undated": [None, None], "same": [0, 0, 0], "bad": [0, 3, "bad"]}
    got = {}
    for r in grouping.group_photos(photos(spark, lots)).orderBy("emit_order").collect():
        got.setdefault(r.lot_id, []).append((r.size, r.confidence, r.reason_code))
    assert got == {
        "below": [(2, "media", "burst")], "exact": [(1, "baja", "single")] * 2, "above": [(1, "baja", "single")] * 2, "single": [(1, "baja", "single_dated")],
        "undated": [(1, "baja", "undated")] * 2, "same": [(1, "baja", "same_time")] * 3, "bad": [(2, "media", "burst"), (1, "baja", "unreadable")],
    }


def test_groups_never_mix_bursts(spark):
    lots, truth = {}, {}
    for seed in range(40):
        r, at, times = random.Random(seed), 0.0, []
        for burst in range(r.randint(2, 6)):
            at += r.uniform(15, 315)
            for _ in range(r.randint(1, 5)):
                truth[f"L{seed}_{len(times)}"] = burst
                times.append(at)
                at += r.uniform(0.01, 14)
        lots[f"L{seed}_"] = times
    out = grouping.group_photos(photos(spark, lots).orderBy(F.rand(1))).collect()
    members = [m for r in out for m in r.members]
    assert sorted(members) == sorted(truth) and all(len({truth[m] for m in r.members}) == 1 for r in out)
    assert {r.confidence for r in out} <= {"media", "baja"}


def test_seams_invert_partitions(spark):
    order = spark.createDataFrame([("a", f"p{i}", i) for i in range(8)], "lot_id string, photo_id string, pos int")
    seams = spark.createDataFrame([("a", "p1", "p2"), ("a", "p4", "p5")], "lot_id string, left_id string, right_id string")
    parts = grouping.partition_by_seams(order, seams)
    back = grouping.open_seams_of(parts.withColumn("product_id", F.col("part")))
    assert sorted(back.collect()) == sorted(seams.collect())
    assert grouping.open_seams_of(order.withColumn("product_id", F.lit(None).cast("int"))).count() == 7
    assert grouping.partition_by_seams(order, seams.limit(0)).select("part").distinct().count() == 1


def test_golden_names_sweep(spark):
    p = spark.createDataFrame([("g", f"p{n}", START + timedelta(seconds=s), t) for n, (s, t) in enumerate([(0, 1), (5, 1), (30, 1), (50, 2), (55, 2), (200, 3)])], "lot_id string, photo_id string, captured_at timestamp, true_id int")
    swept = evals.sweep(p, spark.createDataFrame([(10.0,), (21.0,), (26.0,)], "threshold_s double"))
    assert {r.threshold_s: (r.n_groups, r.fusions, r.over_cuts) for r in swept.collect()} == {10.0: (4, 0, 1), 21.0: (3, 1, 1), 26.0: (2, 1, 0)}
    assert tuple(evals.safe_zone(swept).first()) == (10.0, 21.0, 11.0)


EVENTS = "product_id string, seq bigint, at timestamp, type string, platform string, price_cents bigint, cost_cents bigint, title string, reference bigint, bundle_id bigint, sold_at timestamp"


def events(spark, rows):
    made = []
    for product, seq, kind, more in rows:
        e = dict.fromkeys(("platform", "price_cents", "cost_cents", "title", "reference", "bundle_id", "sold_at")) | ({"platform": "vinted"} if kind in ("sold", "published") else {}) | more
        made.append((product, seq, START + timedelta(minutes=seq), kind, *(e[k] for k in ("platform", "price_cents", "cost_cents", "title", "reference", "bundle_id", "sold_at"))))
    return spark.createDataFrame(made, EVENTS)


def test_ledger_cases(spark):
    e = events(spark, [
        ("frozen", 1, "cost", {"cost_cents": 500}), ("frozen", 2, "sold", {"price_cents": 2000}), ("frozen", 3, "cost", {"cost_cents": 900}),
        ("again", 1, "cost", {"cost_cents": 100}), ("again", 2, "sold", {"price_cents": 1000, "bundle_id": 7}), ("again", 3, "cost", {"cost_cents": 300}), ("again", 4, "sold", {"price_cents": 1500}),
        ("undone", 1, "sold", {"price_cents": 900}), ("undone", 2, "undo_sale", {}), ("none", 1, "undo_sale", {}), ("neg", 1, "cost", {"cost_cents": -1}),
        ("back", 1, "sold", {"price_cents": 3000}), ("back", 2, "returned", {}), ("resold", 1, "cost", {"cost_cents": 10}), ("resold", 2, "sold", {"price_cents": 50}), ("resold", 3, "undo_sale", {}), ("resold", 4, "cost", {"cost_cents": 20}), ("resold", 5, "sold", {"price_cents": 60}),
        ("listed", 1, "published", {"price_cents": 700}), ("listed", 2, "published", {"price_cents": None}),
    ])
    good, bad = ledger.checked_events(e)
    assert {(r.product_id, r.reason) for r in bad.collect()} == {("none", "no_sale"), ("neg", "negative_cents")}
    sold = {r.product_id: (r.price_cents, r.cost_snap_cents, r.state, r.bundle_id) for r in ledger.sales(good).collect()}
    assert sold == {"frozen": (2000, 500, "vendida", None), "again": (1500, 100, "vendida", 7), "back": (3000, 0, "devuelta", None), "resold": (60, 20, "vendida", None)}
    pubs = ledger.publications(good)
    assert [tuple(r) for r in pubs.select("product_id", "price_cents", "times").collect()] == [("listed", None, 2)]
    live = ledger.live_products(good).filter("product_id <> 'back'").withColumn("lot_id", F.lit("L"))
    rows = ledger.ledger(live, ledger.folded(e))
    assert {r.product_id: r.profit_cents for r in rows.collect()} == {"frozen": 1500, "again": 1400, "back": None, "resold": 40, "listed": None}
    assert tuple(ledger.totals(rows).first()) == (3560, 2940) and tuple(ledger.totals(rows.limit(0)).first()) == (0, 0)
    assert {r.product_id for r in ledger.filtered(rows, "unsold").collect()} == {"listed"}


def test_report_is_written_in_order_and_guarded(spark, tmp_path):
    e = events(spark, [("a", 1, "title", {"title": "=1+1"}), ("a", 2, "sold", {"price_cents": 1999}), ("b", 3, "published", {})])
    rows = ledger.ledger(ledger.live_products(e).withColumn("lot_id", F.lit("L")), ledger.folded(e))
    path = reports.write_ledger(rows, str(tmp_path), START)
    assert path.endswith("ledger_2026-05-01")
    got = [tuple(r) for r in spark.read.option("header", "true").csv(path).orderBy("product_id").select("title", "price", "sold").collect()]
    assert got == [("'=1+1", "19.99", "sí"), (None, None, "no")]


def test_references_go_on_above_history(spark):
    waiting = spark.createDataFrame([(f"p{i}", START + timedelta(seconds=i % 7)) for i in range(50)], "product_id string, created_at timestamp")
    history = spark.createDataFrame([("p3", 4), ("gone", 90)], "product_id string, n bigint")
    got = {r.product_id: r.reference for r in ledger.assign_references(waiting, history).collect()}
    order = sorted((i % 7, f"p{i}") for i in range(50) if i != 3)
    assert got == {p: 91 + n for n, (_, p) in enumerate(order)}


@pytest.mark.parametrize(("text", "cents"), [("19,99", 1999), (" 5 ", 500), ("", None), ("words", None), ("nan", None), ("inf", None), ("0.125", 12), (None, None)])
def test_cents_of_text(spark, text, cents):
    assert one(spark, N.cents_of_text(F.col("t").cast("string")), t=text) == cents


def test_money_and_checks(spark):
    assert [one(spark, N.cents_text(F.col("c").cast("bigint")), c=c) for c in (1999, 5, None)] == ["19.99", "0.05", ""]
    assert [one(spark, N.ean_valid(F.col("d")), d=d) for d in ("8445061029720", "8445061029721", "12", "96385074")] == [True, False, False, True]
    assert one(spark, N.hash_bits(F.col("h")), h="ffffffffffffffff") == -1 and one(spark, N.hash_bits(F.col("h")), h="xyz") is None


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (T.marker_value, "DESPERFECT0S: cremallera rota", "cremallera rota"), (T.marker_value, "nota DESPERFECTOS- mancha", "mancha"), (T.marker_value, "DESPERFECTOS : algo", None),
        (T.marker_value, "acabados PERFECTOS: si", None), (T.marker_value, "DESPERFECTOS:  ", None), (T.is_ruler_text, "69899995999291909698925959556575", True), (T.is_ruler_text, "8445061029720", False),
        (T.garment, "PANTALÓN azul", "pantalon"), (T.long_word, "a " + "x" * 31 + ".", "x" * 31), (T.excess_symbols, "que bien!!!!", True), (T.excess_upper, "ESTO ES MUY ALTO ya", True),
        (T.slug_ok, "a/b", False), (T.slug_ok, " ok ", True), (T.guarded, "@x", "'@x"), (T.plain, "Ñandú", "Nandu"), (T.stem, "camisetas", "camiseta"), (T.stem, "pantalones", "pantalon"),
        (T.shipping_class, "unas BOTAS y camiseta", "pesado"), (T.compared, " Jack  &  Jónes ", "JACK & JONES"), (T.names_child, "body 12 meses", True),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, column(F.col("t")), t=text) == want


def test_text_pairs(spark):
    has = lambda t, v: one(spark, T.has_token(F.col("t"), F.col("v")), t=t, v=v)
    assert not has("ORIGINAL MARINES", "M") and has("talla  xl, azul", "XL,") and not has("MAXÍM", "M")
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="Reebok", b="Raabdk") == 0.5
    lead = lambda t, k: one(spark, T.led_by_type(F.col("t"), F.col("k")), t=t, k=k)
    assert lead("Reebok roja", "sudadera") == "Sudadera Reebok roja" and lead("Sudadera Reebok", "sudadera") == "Sudadera Reebok"
    long = lead("palabra " * 13, "masajeador de rodilla")
    assert long.startswith("Masajeador de rodilla palabra") and len(long) <= 100 and not long.endswith("palabr")
    add = lambda t, d: one(spark, T.with_defect(F.col("t"), F.col("d")), t=t, d=d)
    assert add("la cremallera no cierra", "cremallera rota") == "la cremallera no cierra" and add("bonita", "cremallera rota").endswith("\n\nDESPERFECTOS: cremallera rota")
    stamp = lambda t, r: one(spark, T.stamped(F.col("t"), F.col("r")), t=t, r=r)
    assert stamp(stamp("hola ", 7), 7) == "hola\n\nRef. 7" and stamp(" ", 7) == "Ref. 7"
    hit = one(spark, T.ocr_shortcut(F.col("t"), F.col("s")), t="EANCODE:*8445061029720*", s=0.91)
    assert (hit.content, hit.value) == ("ean", "8445061029720")
    assert one(spark, T.ocr_shortcut(F.col("t"), F.col("s")), t="EANCODE:*8445061029721*", s=0.91) is None
    assert one(spark, T.ocr_shortcut(F.col("t"), F.col("s")), t="Model:LLLT-200", s=0.88).value == "LLLT-200"


@pytest.mark.parametrize(
    ("text", "field", "brand", "codes"),
    [
        ("escribe a yo@correo.es ya", "description", None, ["CONTAINS_EMAIL", "UNALLOWED_SYMBOLS"]), ("mira www.sitio.es/x", "description", None, ["CONTAINS_LINK"]), ("abc", "title", None, ["TOO_SHORT"]),
        ("a" * 20 + " " + "b" * 90, "title", None, ["LONG_WORDS", "TOO_LONG"]), ("camiseta nike azul", "title", "Adidas", ["MENTIONS_OTHER_BRAND"]), ("camiseta nike azul", "title", "Nike", []),
        ("camiseta ✨ nueva", "title", None, ["UNALLOWED_SYMBOLS"]), ("sudadera de algodón, talla M", "title", None, []),
    ],
)
def test_violations(spark, text, field, brand, codes):
    t = spark.createDataFrame([(1, "vinted", field, brand, text)], "text_id int, platform string, field string, brand string, text string")
    assert listings.text_violations(t).first().codes == codes


READ = "product_id string, seq bigint, photo string, box struct<x:int,y:int,w:int,h:int>, legible boolean, belongs boolean, location string, content string, text string, raw_ocr string, origin string"


def test_field_resolution(spark):
    def r(p, seq, text, location="etiqueta_interior", content="marca", photo="a.jpg", legible=True):
        return (p, seq, photo, None, legible, True, location, content, text, None, "vlm")

    rows = [
        r("two", 1, "Reebok"), r("two", 2, "Nike", "estampado_o_grafico"), r("print", 1, "Nike", "estampado_o_grafico"), r("one", 2, "Reebok "), r("one", 3, "reebok"), r("blur", 1, None, legible=False), r("nothing", 1, "x", content="otro"),
        r("ean", 1, "8445061029720", "codigo_o_modelo_impreso", "ean"), r("ean", 2, "8445061029721", "codigo_o_modelo_impreso", "ean"), r("split", 1, "Puma"), r("split", 2, "8445061029720", "codigo_o_modelo_impreso", "ean", "b.jpg"),
    ]
    got = {(x.product_id, x.field): x for x in readings.resolve(spark.createDataFrame(rows, READ)).collect()}
    brand = {p: (got[p, "marca"].value, got[p, "marca"].source, got[p, "marca"].confidence, got[p, "marca"].reason) for p in ("two", "print", "one", "blur", "nothing")}
    assert brand == {"two": (None, "inferido", "baja", "conflict"), "print": (None, "inferido", "baja", "only_elsewhere"), "one": ("Reebok ", "foto", "media", "single_value"), "blur": (None, "foto", "baja", "illegible"), "nothing": (None, "inferido", "baja", "not_photographed")}
    assert got["two", "marca"].alternatives == ["Reebok", "Nike"]
    assert got["ean", "ean"].confidence == "alta" and got["split", "ean"].confidence == "media"
    assert {x.confidence for x in got.values() if x.field != "ean"} <= {"media", "baja"}


def test_region_clusters(spark):
    rows = [("p", "f", 1, n, 0, y, 50, 20, t, 0.9) for n, (y, t) in enumerate([(0, "ORIGINAL"), (100, "MARINES"), (260, "x"), (900, "far")])]
    reg = spark.createDataFrame(rows, "product_id string, photo string, photo_seq int, region_seq int, x int, y int, w int, h int, text string, score double")
    merged = readings.merged_regions(readings.region_clusters(reg))
    assert sorted((r.text, r.y, r.h) for r in merged.collect()) == [("ORIGINAL MARINES x", 0, 280), ("far", 900, 20)]


def test_prices(spark):
    price = [7, 10, 22, 20, 9, 17.5, 4, 30]
    lst = spark.createDataFrame([("Reebok", n, f"u{n}", float(p), "t") for n, p in enumerate(price)] + [("few", n, f"f{n}", 5.0, "t") for n in range(3)] + [("many", n, f"m{n}", float(n + 1), "t") for n in range(39)], "query string, rank int, url string, price double, title string")
    attr = spark.createDataFrame([("a", "marca", "Reebok", "foto"), ("b", "talla", "M", "foto"), ("c", "tipo", "sudadera", "reviewer"), ("d", "marca", "few", "foto"), ("e", "marca", "many", "foto"), ("f", "marca", "Reebok", "inferido")], "product_id string, field string, value string, source string")
    got = {r.product_id: (r.n, r.median, r.least, r.most, r.reason) for r in pricing.value_products(pricing.wide_attributes(attr), lst).collect()}
    assert got == {"a": (8, 13.75, 4.0, 30.0, "median_asked"), "b": (0, None, None, None, "no_terms"), "c": (0, None, None, None, "cohort_too_wide"), "d": (3, None, None, None, "too_few"), "e": (15, 8.0, 1.0, 15.0, "median_asked"), "f": (0, None, None, None, "no_terms")}
    full = spark.createDataFrame([("p", f, v, "foto") for f, v in (("marca", "Reebok"), ("modelo", "Z1"), ("tipo", "sudadera"), ("talla", "XXL"))], attr.schema)
    assert pricing.search_variants(pricing.wide_attributes(full)).count() == 7
    some = pricing.search_variants(pricing.wide_attributes(full.filter("field <> 'modelo'"))).orderBy("pos")
    assert [r.terms for r in some.collect()] == ["Reebok sudadera XXL", "Reebok sudadera", "Reebok XXL", "Reebok"]


def test_near_hashes(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(40)]
    flipped = [b ^ sum(1 << i for i in r.sample(range(63), k)) for b, k in zip(base, [n % 9 for n in range(40)], strict=True)]
    values = base + flipped
    got = {(x.a, x.b): x.distance for x in dedupe.near_duplicates(spark.createDataFrame(list(enumerate(values)), "photo_id int, bits bigint")).collect()}
    want = {(i, j): (values[i] ^ values[j]).bit_count() for j in range(80) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 5}
    assert got == want


def test_order_and_colour(spark):
    p = spark.createDataFrame([("s", "a", "1", 2.0, None, None), ("s", "b", "2", 9.0, None, None), ("c", "x", "1", None, None, START), ("c", "y", "2", 5.0, START + timedelta(1), None), ("c", "z", "0", 1.0, None, None)], "product_id string, photo_id string, name string, sharpness double, captured_at timestamp, mtime timestamp")
    out = ordering.suggested_order(p).orderBy("product_id", "position").collect()
    assert [(r.photo_id, r.criterion) for r in out] == [("y", "chronological"), ("x", "chronological"), ("z", "chronological"), ("b", "sharpness"), ("a", "sharpness")]
    px = spark.createDataFrame([("red", x, y, 200, 30, 30) for x in range(8) for y in range(8)], "photo_id string, x int, y int, r int, g int, b int")
    assert pixels.named_colours(pixels.dominant_colour(pixels.central(px))).first().colour == "rojo"
    mask = spark.createDataFrame([("red", 0, 0, 99, 99)], "photo_id string, bx int, by int, bw int, bh int")
    assert pixels.unmasked(px, mask).count() == 64
    flat = px.select("photo_id", "x", "y", F.lit(7).alias("v"))
    inner, n = (8 - 2) ** 2, 8**2  # 128 inside, the grey value on the border
    assert pixels.sharpness(flat).first().sharpness == pytest.approx(inner / n * (1 - inner / n) * (128 - 7) ** 2)
    assert pixels.sharpness(flat.withColumn("v", F.lit(128))).first().sharpness == 0.0
    assert pixels.sharpness(flat.filter("x < 2 AND y = 0")).first().sharpness == 0.0


def test_usage_estimate(spark):
    req = spark.createDataFrame([("k1", "image", 1), ("k2", "image", 1), ("k3", "image", 2), ("k4", "image", 0)], "key string, kind string, n_images int")
    cache = spark.createDataFrame([("k1", True), ("k2", False)], "key string, valid boolean")
    r = usage.estimate(req, cache, 1.0, 5.0).first()
    assert (r.total, r.cached, r.payable) == (3, 1, 2) and abs(r.cost - ((1600 + 3200) / 1e6 + 600 / 1e6 * 5)) < 1e-12


def test_condition_fidelity(spark):
    notes = {(r.platform, r.category): r.note for r in listings.condition_fidelity(dims.conditions(spark)).filter("level = 6").collect()}
    assert notes["vinted", "electronica"] is None and notes["wallapop", "hogar"] is None
    assert notes["vinted", "moda"] == notes["wallapop", "moda"] == "broken_as_working"
    assert listings.condition_fidelity(dims.conditions(spark)).filter("note = 'overstated'").count() == 0


def test_files_and_payloads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.JPG", "b.txt", "c.png"):
        (tmp_path / "in" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in ingest.photo_files(spark, str(tmp_path)).collect()] == ["a.JPG", "c.png"]
    assert ingest.photo_files(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("p", 1, "f", "", '{"legible": true, "belongs": true, "location": "otro", "findings": [{"content": "marca", "text": " X "}, {"content": "talla", "text": ""}]}'), ("p", 2, "f", "", "{broken")], "product_id string, seq int, photo string, raw_ocr string, body string")
    good, bad = ingest.reading_rows(rows)
    assert sorted((r.content, r.text) for r in good.collect()) == [("marca", "X"), ("talla", None)] and bad.count() == 1
    snap = tmp_path / "snap.json"
    snap.write_text('{"fecha": "2026-01-01", "hojas": [{"id": 5, "nombre": "Camisetas", "ruta": ["Moda", "Hombre"], "raiz_id": 1, "leaf_mandatory": true}]}')
    assert tuple(ingest.snapshot_leaves(spark, str(snap)).select("leaf_id", "leaf_mandatory", "snapshot_date").first()) == (5, True, "2026-01-01")
    with pytest.raises(Exception):
        ingest.snapshot_leaves(spark, str(tmp_path / "absent.json")).count()


def test_free_names_are_unique(spark):
    import random

    r = random.Random(1)
    paths = [("x", f"{d}/{n}.jpg") for d in "xyzw" for n in ("a", "a_1", "a_3", "a_01", "b", "a_1_1", "a_2_1")] + [("y", "x/a.jpg"), ("y", "noext"), ("y", "z/noext")]
    r.shuffle(paths)
    rows = [(lot, i, p) for i, (lot, p) in enumerate(paths)]
    out = ingest.free_names(spark.createDataFrame(rows, "lot_id string, photo_id long, path string")).collect()
    assert len(out) == len(rows) == len({(x.lot_id, x.target) for x in out})
    first = {}
    for lot, _, p in sorted(rows, key=lambda x: (x[2], x[1])):
        first.setdefault((lot, p.split("/")[-1]), p)
    assert all(x.target == x.path.split("/")[-1] for x in out if first[x.lot_id, x.path.split("/")[-1]] == x.path)
    one = spark.createDataFrame([(1, 1, "x/a.jpg"), (1, 2, "y/a.jpg"), (1, 3, "x/a_1.jpg"), (1, 4, "x/a_3.jpg"), (1, 5, "z/a.jpg")], "lot_id int, photo_id int, path string")
    assert {x.photo_id: x.target for x in ingest.free_names(one).collect()} == {1: "a.jpg", 2: "a_2.jpg", 3: "a_1.jpg", 4: "a_3.jpg", 5: "a_4.jpg"}


def test_chains_of_regions_settle(spark):
    import random

    r, rows = random.Random(2), []
    for product, n in enumerate((2, 30, 50, 120)):
        order = list(range(n))
        r.shuffle(order)
        rows += [(product, "p", 1, seq, 0, 12 * place, 40, 10, "t", 0.9) for place, seq in enumerate(order)]
    frame = spark.createDataFrame(rows, "product_id int, photo string, photo_seq int, region_seq int, x int, y int, w int, h int, text string, score double")
    assert {x.cluster for x in readings.region_clusters(frame).collect()} == {0}


def test_shortcuts_join_the_readings(spark):
    own = spark.createDataFrame([(1, 4, "a.jpg", None, True, True, "etiqueta_interior", "marca", "Nike", None, "vlm")], "product_id int, seq long, photo string, box struct<x:int,y:int,w:int,h:int>, legible boolean, belongs boolean, location string, content string, text string, raw_ocr string, origin string")
    plan = spark.createDataFrame([(1, "b.jpg", 2, 1, 0, 0, 9, 9, "x 4006381333931", 0.9, "shortcut", "ean", "4006381333931"), (1, "b.jpg", 2, 2, 0, 0, 9, 9, "word", 0.9, "read", None, None), (2, "c.jpg", 1, 1, 0, 0, 9, 9, "DV1234-001", 0.9, "shortcut", "modelo", "DV1234-001")], "product_id int, photo string, photo_seq int, region_seq int, x int, y int, w int, h int, text string, score double, plan string, content string, value string")
    out = sorted((x.product_id, x.seq, x.content, x.text, x.origin) for x in readings.pooled_readings(own, plan).collect())
    assert out == [(1, 4, "marca", "Nike", "vlm"), (1, 5, "ean", "4006381333931", "ocr"), (2, 1, "modelo", "DV1234-001", "ocr")]


def test_measures_without_a_photo(spark):
    tries = spark.createDataFrame([(1, 1, True, True, 40.0), (2, 1, True, False, 30.0)], "product_id int, seq int, zero_visible boolean, edge_visible boolean, value double")
    out = readings.measures(tries, spark.createDataFrame([(1,), (2,), (3,)], "product_id int")).collect()
    assert sorted((x.product_id, x.value, x.reason) for x in out)[0] == (1, 40.0, "measured")
    assert {x.product_id: x.reason for x in out} == {1: "measured", 2: "illegible", 3: "not_photographed"}


def test_near_duplicates_by_any_bands(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    bits = base + [b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 7))) for b in base for _ in range(3)]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    hashes = spark.createDataFrame(list(enumerate(signed)), "photo_id long, bits long")
    want = {(i, j, (bits[i] ^ bits[j]).bit_count()) for j in range(len(bits)) for i in range(j) if 0 < (bits[i] ^ bits[j]).bit_count() <= 5}
    for plan in ((6, 1), (7, 2), (9, 4)):
        assert {tuple(x) for x in dedupe.near_duplicates(hashes, 5, True, plan).collect()} == want
    assert [dedupe.band_plan(n, 5) for n in (100, 100_000, 10**9)] == [(6, 1), (7, 2), (9, 4)]
