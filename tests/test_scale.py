"""Operators that must hold at any size: against brute force where a photo, lot or text holds much, and by their plans."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.operators import ledger, pixels, readings, taxonomy
from listingops.plans import file_queries, listing_queries, sales_queries  # noqa: F401  they register their queries
from listingops.plans.registry import QUERIES
from listingops.sources import derived, dims, reports

START = datetime(2026, 5, 1, 10)
BOX = "product_id int, photo string, region_seq int, x int, y int, w int, h int"


def near(a, b):
    gap = max(a[4], b[4]) - min(a[4] + a[6], b[4] + b[6])
    over = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return gap <= 150 and over > -400


def boxes(seed):
    r, rows = random.Random(seed), []
    for p in range(40):
        side = r.choice([900, 2500, 6000])
        rows += [(p, "f", i, r.randint(-200, side), r.randint(-200, side), r.choice([0, 5, 60, 900]), r.choice([0, 3, 40, 500])) for i in range(r.choice([1, 2, 8, 40]))]
    return rows + [(99, "g", i, r.randint(0, 40_000), r.randint(0, 15_000), r.randint(1, 120), r.randint(1, 60)) for i in range(1500)]


def roots(rows, pairs):
    root = {(x[0], x[2]): (x[0], x[2]) for x in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, a, b in pairs:
        a, b = find((p, a)), find((p, b))
        root[max(a, b)] = min(a, b)
    return {x: find(x)[1] for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_in_tiles_equal_brute_force(spark, seed):
    rows, by = boxes(seed), {}
    for x in rows:
        by.setdefault(x[:2], []).append(x)
    pairs = {(a[0], min(a[2], b[2]), max(a[2], b[2])) for g in by.values() for i, a in enumerate(g) for b in g[:i] if near(a, b)}
    frame = spark.createDataFrame(rows, BOX)
    got = [tuple(x) for x in readings.near_regions(frame).select("product_id", "a", "b").collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    want = roots(rows, pairs)
    links = {(x.product_id, min(x.a, x.b), max(x.a, x.b)) for x in readings.cluster_links(frame).collect()}
    assert links <= pairs and roots(rows, links) == want
    if seed == 1:
        assert {(x.product_id, x.region_seq): x.cluster for x in readings.region_clusters(frame).collect()} == want


def test_a_dense_photo_of_10000_boxes(spark):
    r = random.Random(3)
    rows = [(1, "f", i, r.randint(0, 3000), r.randint(0, 3000), 20, 10) for i in range(10_000)]
    assert readings.cluster_links(spark.createDataFrame(rows, BOX)).count() < 40 * len(rows)  # near pairs: over a million


def test_masks_in_tiles_equal_brute_force(spark):
    r = random.Random(4)
    px = [(p, x, y, 1, 2, 3) for p in range(3) for x in range(90) for y in range(70)]
    masks = [(r.randint(0, 1), r.randint(-20, 90), r.randint(-20, 70), r.randint(0, 40), r.randint(0, 40)) for _ in range(9)] + [(2, -5, -5, 200, 200)]
    inside = lambda p, x, y: any(m[0] == p and m[1] <= x <= m[1] + m[3] and m[2] <= y <= m[2] + m[4] for m in masks)
    want = {(p, x, y) for p, x, y, *_ in px if p == 2 or not inside(p, x, y)}
    got = pixels.unmasked(spark.createDataFrame(px, "photo_id int, x int, y int, r int, g int, b int"), spark.createDataFrame(masks, "photo_id int, bx int, by int, bw int, bh int"))
    assert {(x.photo_id, x.x, x.y) for x in got.collect()} == want


def test_brands_by_hash_equal_patterns(spark):
    r = random.Random(5)
    parts = [*dims.BRANDS, "nikes", "h & m", "m", "pull", "bear", "north", "the north", "levi", "café", "levi's-", "(nike)", "x_nike", "NIKE", "Louis  Vuitton", "louis vuitton", "ñike", "nikeñ"]
    texts = [r.choice(["", " "]).join(r.choice([p, p.upper(), p + r.choice(",.- ")]) + r.choice([" ", "", "\n"]) for p in r.sample(parts, r.randint(0, 6))) for _ in range(400)] + [None, ""]
    rows = [(i, t, r.choice([None, "Nike", " adidas ", "h&m"])) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string, b string").select("i", T.other_brands(F.col("t"), F.col("b")).alias("x")).collect()
    found = {x.i: x.x for x in got}
    for i, t, b in rows:
        want = sorted(x for x in dims.BRANDS if x != (b or "").strip().lower() and re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t.lower())) if t is not None else None
        assert (found[i] or []) == (want or []), (t, b)


def test_a_larger_brand_list(spark):
    brands = tuple(f"brand{i}" for i in range(3000)) + ("brand co", "a.b.c")
    row = spark.createDataFrame([("the Brand77, a brand co and A.B.C; brand9999",)], "t string")
    assert row.select(T.other_brands(F.col("t"), F.lit(None).cast("string"), brands)).first()[0] == ["a.b.c", "brand co", "brand77"]


def test_references_are_unique_without_reuse(spark):
    """Ranges are cut by constants, so a second evaluation of the rows deals them alike."""
    rows = [(i, START + timedelta(seconds=i % 5) if i % 11 else None) for i in range(5000)]
    random.Random(6).shuffle(rows)
    waiting = spark.createDataFrame(rows, "product_id long, created_at timestamp").repartition(7)
    history = spark.createDataFrame([(1, 10), (2, 40)], "product_id long, n long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {x.product_id: x.reference for x in ledger.assign_references(waiting, history, 16).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    order = [i for _, i in sorted((t or datetime.min, i) for i, t in rows if i not in (1, 2))]
    assert got == {p: 41 + n for n, p in enumerate(order)}


def test_the_ledger_takes_one_exchange_a_product(spark):
    events = spark.createDataFrame([], "product_id long, seq long, at timestamp, type string, platform string, price_cents long, cost_cents long, title string, reference long, bundle_id long, sold_at timestamp")
    plan = ledger.folded(events.repartition(3)).explain
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        plan("formatted")
    shown = out.getvalue().split("== Physical Plan ==")[1].split("\n\n")[0]
    assert len(re.findall(r"Exchange", shown)) <= 2  # repartition's own, and by product
    assert sales_queries.sales_ledger(spark, "/root/testdata/sf0.001").count() > 0


def test_few_leaves_are_scored(spark):
    """Of 2,000 leaves, a listing that names one is scored against a few, and the best are those of scoring all."""
    r = random.Random(7)
    words = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(4)) for _ in range(900)]
    leaves = [("p", i, f"{r.choice(words)} {r.choice(words)}", ["root", f"{r.choice(words[:20])} common"], 0) for i in range(2000)]
    asked = [(i, "otros", f"{leaves[i][2]} {leaves[i][3][1]} {' '.join(r.sample(words[:20], 2))} vendo esta prenda casi sin uso") for i in range(60)]
    tree = spark.createDataFrame(leaves, "platform string, leaf_id int, name string, path array<string>, root_id int")
    listings = spark.createDataFrame(asked, "product_id int, category string, text string")
    index = taxonomy.postings(listings.select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct(), tree)
    kept = {}
    for x in index.collect():
        kept.setdefault(x.token, {})[x.leaf_id] = x.w
    name = {i: (n, p) for _, i, n, p, _ in leaves}
    want = {}
    for i, _, text in asked:
        score = {}
        for t in T_tokens(text):
            for leaf, w in kept.get(t, {}).items():
                score[leaf] = score.get(leaf, 0.0) + w
        ranked = sorted(((-round(s, 9), len(name[x][1]), name[x][0], x) for x, s in score.items()))[:3]
        want[i] = [x for *_, x in ranked]
    got = {}
    for x in sorted(taxonomy.rank_categories(listings, tree).collect(), key=lambda x: x.rank):
        got.setdefault(x.product_id, []).append(x.leaf_id)
    assert got == want
    hopeful, _ = taxonomy.likely_leaves(taxonomy.asked_tokens(listings), tree, 3)
    every = sum(len({leaf for t in T_tokens(text) for leaf in kept.get(t, ())}) for _, _, text in asked)
    n = hopeful.count()
    assert n < every / 20, (n, every)


def T_tokens(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= 3 and w not in dims.RANKING_STOP_WORDS]


def test_payloads_are_written_by_platform(spark, tmp_path):
    done, _ = listing_queries._payloads(spark, "/root/testdata/sf0.001")
    reports.write_payloads(done, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == done.count() and {x.platform for x in back.select("platform").distinct().collect()} == set(dims.PLATFORMS)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"platform=vinted", "platform=wallapop"}


def plan_of(frame):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("simple")
    return out.getvalue()


def test_required_fields_meet_without_a_broadcast(spark):
    assert "Broadcast" not in plan_of(listing_queries.required_fields(spark, "/root/testdata/sf0.001"))


def test_photos_of_payloads_meet_their_paths_without_a_broadcast(spark):
    done, _ = listing_queries._payloads(spark, "/root/testdata/sf0.001")
    for frame in (done, listing_queries.export_payloads(spark, "/root/testdata/sf0.001")):
        assert re.search(r"SortMergeJoin \[photo_id", plan_of(frame)) and not re.search(r"HashJoin \[(photo|product)_id", plan_of(frame))


@pytest.mark.parametrize("name", ["product_upkeep", "blocked_payloads", "ready_listings", "redacted_listings", "rejected_events", "saved_assignments", "guarded_events"])
def test_rows_are_dealt_to_all_tasks_before_they_are_sorted(spark, name):
    """Every operator that sorts a large table gets partitions that the adaptive plan doesn't merge."""
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_accents_of_every_character(spark):
    rows = [(c, chr(c)) for c in (*range(0x20, 0xD800), *range(0xE000, 0x30000), *range(0xE0100, 0xE01F0))]
    several = 0
    for x in spark.createDataFrame(rows, "c int, t string").select("c", "t", T.plain(F.col("t")).alias("p")).toPandas().itertuples():
        want = T.decomposed(x.t)
        several += len(want) > 1
        assert x.p == (x.t if len(want) > 1 else want), hex(x.c)
    assert several > 11_172  # Hangul syllables and what else becomes several characters


def test_garments_read_a_text_once(spark):
    """Lowering and accents are worked out before the garments are sought, not once for each of them."""
    r = random.Random(8)
    parts = [*dims.GARMENTS, *dims.HEAVY_WORDS, *dims.LIGHT_WORDS, "PANTALÓN", "Camisa", "ñandú", "x", "Ropa"]
    rows = [(" ".join(r.sample(parts, r.randint(0, 3))),) for _ in range(200)] + [(None,), ("",)]
    frame = spark.createDataFrame(rows, "t string").select("t", T.garment(F.col("t")).alias("g"), T.shipping_class(F.col("t")).alias("s"))
    for x in frame.collect():
        low = (x.t or "").lower()
        assert x.g == next((g for g in dims.GARMENTS if g in T.decomposed(low)), None) and x.s == ("pesado" if any(w in low for w in dims.HEAVY_WORDS) else "ligero" if any(w in low for w in dims.LIGHT_WORDS) else "normal")
    assert not re.search(r"filter\(.*translate", plan_of(frame))


def test_accents_in_texts(spark):
    rows = [("Ἀθῆναι ﬁn ½ Ｎike de\u0301ja\u0300 Đã",), (None,), ("déjà",)]
    frame = spark.createDataFrame(rows, "t string")
    assert [x[0] for x in frame.select(T.fold_accents(F.col("t"))).collect()] == ["Αθηναι fin 1⁄2 Nike deja Đa", None, "deja"]
    assert [x[0] for x in frame.select(T.plain(F.col("t"))).collect()] == ["Αθηναι ﬁn ½ Nike deja Đa", None, "deja"]
