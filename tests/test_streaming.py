"""Streams give what the batch operators give."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from listingops.operators import grouping, ledger
from listingops.plans import stream_queries  # noqa: F401  it registers its queries
from listingops.plans.registry import QUERIES
from listingops.sources import derived
from listingops.streaming import streams

START = datetime(2026, 5, 1, 10)


def drained(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def source(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def test_sessions_equal_groups(spark, tmp_path):
    times = [0, 14.9, 29.9, 40, 100, 114, 129]
    rows = [("a", n, START + timedelta(seconds=s)) for n, s in enumerate(times)]
    s = source(spark, [*rows, ("z", 99, START + timedelta(hours=2))], "lot_id string, photo_id long, captured_at timestamp", tmp_path / "p")
    got = sorted((r.started_at, r.size) for r in drained(spark, streams.gap_groups(s), "gaps", tmp_path).filter("lot_id = 'a'").collect())
    batch = spark.createDataFrame([(*r, f"{r[1]}", True, None) for r in rows], "lot_id string, photo_id long, captured_at timestamp, name string, readable boolean, read_error string")
    assert got == sorted((r.started_at, r.size) for r in grouping.group_photos(batch).collect())


def test_repeats_are_dropped(spark, tmp_path):
    rows = [(1, "x", "a", "h1", START), (2, "x", "a", "h1", START), (3, "x", "b", None, START), (4, "x", "c", None, START)]
    s = source(spark, rows, "photo_id long, lot_id string, path string, sha256 string, arrived_at timestamp", tmp_path / "p")
    assert drained(spark, streams.first_contents(s), "contents", tmp_path).count() == 3
    assert drained(spark, streams.first_paths(s), "paths", tmp_path).count() == 3


EVENTS = "product_id string, seq bigint, at timestamp, type string, platform string, price_cents bigint, cost_cents bigint, title string, reference bigint, bundle_id bigint, sold_at timestamp"


def event(product, seq, kind, price=None, cost=None, platform="vinted", title=None, reference=None, bundle=None):
    return product, seq, START + timedelta(minutes=seq), kind, platform, price, cost, title, reference, bundle, None


def test_ledger_changes_sum_to_totals(spark, tmp_path):
    rows = [event("p", 1, "cost", None, 500), event("p", 2, "sold", 2000), event("p", 3, "cost", None, 900), event("p", 4, "sold", 2500), event("q", 1, "undo_sale"), event("r", 1, "sold", 700), event("r", 2, "returned"), event("s", 1, "sold", 100), event("s", 2, "undo_sale"), event("t", 1, "sold", 5, platform="other"), event("t", 2, "published", -1)]
    s = source(spark, rows, EVENTS, tmp_path / "e")
    out = drained(spark, streams.ledger_changes(s), "changes", tmp_path)
    assert tuple(streams.live_totals(out).first()) == (2500, 2000, 3)
    assert {(r.product_id, r.reject) for r in out.filter("reject IS NOT NULL").collect()} == {("q", "no_sale"), ("t", "unknown_platform"), ("t", "negative_cents")}


def ledger_of_stream(out):
    """(sales, publications) that the changes of a stream leave, as ledger.sales and ledger.publications give them."""
    last, listed = {}, {}
    for r in sorted(out.filter("reject IS NULL").collect(), key=lambda r: r.seq):
        last[r.product_id] = (r.state, r.price_cents, r.sale_platform, r.bundle_id, r.cost_cents, r.title, r.reference, r.sold_at, r.created_at)
        if r.type == "published":
            listed[r.product_id, r.platform] = (r.listed_at, r.listed_price_cents, r.listed_times)
    return {k: v for k, v in last.items() if v[0]}, listed


def batch_ledger(events):
    fold = ledger.folded(events)
    sold = {str(r.product_id): (r.state, r.price_cents, r.platform, r.bundle_id, r.cost_snap_cents, r.title_snap, r.reference_snap, r.sold_at, r.created_at) for r in ledger.sales_of(fold).collect()}
    return sold, {(str(r.product_id), r.platform): (r.listed_at, r.price_cents, r.times) for r in ledger.publications_of(fold).collect()}


def test_streamed_ledger_equals_the_batch_ledger(spark, tmp_path):
    """All events of the given tables, with titles and references, in three batches; then from an initial state."""
    made = derived.events(spark, "/root/testdata/sf0.001").withColumn("product_id", F.col("product_id").cast("string"))
    named = made.filter("seq % 7 = 0").withColumn("seq", F.col("seq") + 3)
    titles = named.select("product_id", "seq", "at", F.lit("title").alias("type"), *(F.lit(None).cast(t).alias(c) for c, t in (("platform", "string"), ("price_cents", "long"), ("cost_cents", "long"))), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("title"), F.lit(None).cast("long").alias("reference"), F.lit(None).cast("long").alias("bundle_id"), F.lit(None).cast("timestamp").alias("sold_at"))
    numbers = titles.withColumn("type", F.lit("reference")).withColumn("seq", F.col("seq") + 100).withColumn("reference", F.col("seq")).withColumn("title", F.lit(None).cast("string"))
    every = made.unionByName(titles).unionByName(numbers.filter("seq % 2 = 0"))
    every = every.withColumn("seq", F.row_number().over(Window.partitionBy("product_id").orderBy("seq", "type")).cast("long")).select(*[c.split()[0] for c in EVENTS.split(", ")])
    every.write.parquet(str(tmp_path / "all"))
    every = spark.read.schema(EVENTS).parquet(str(tmp_path / "all"))
    cuts = [every.filter("seq <= 40"), every.filter("seq > 40 AND seq <= 90"), every.filter("seq > 90")]
    for n, part in enumerate(cuts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    want = batch_ledger(every)
    assert len(want[0]) > 50 and len(want[1]) > 100
    assert ledger_of_stream(drained(spark, streams.ledger_changes(stream), "whole", tmp_path)) == want
    later = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in/2"))
    begun = streams.ledger_state(ledger.folded(cuts[0].unionByName(cuts[1])))
    sold, listed = ledger_of_stream(drained(spark, streams.ledger_changes(later, begun), "begun", tmp_path))
    touched = {str(r.product_id) for r in cuts[2].select("product_id").distinct().collect()}
    assert sold == {k: v for k, v in want[0].items() if k in touched}
    again = {(r.product_id, r.platform) for r in cuts[2].filter("type = 'published'").select("product_id", "platform").distinct().collect()}
    assert listed == {k: v for k, v in want[1].items() if k in again}


def test_first_batch_without_a_closed_group_and_dropped_rows(spark, tmp_path):
    put = streams.late_writer(str(tmp_path / "none"), str(tmp_path / "late"), str(tmp_path / "kept"))
    put(spark.createDataFrame([("x", 1, START)], "lot_id string, photo_id long, captured_at timestamp"), 0)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1 and spark.read.schema("lot_id string").parquet(str(tmp_path / "late")).count() == 0
    late = streams.LateRows()
    spark.streams.addListener(late)
    schema = "lot_id string, photo_id long, captured_at timestamp"
    folder = tmp_path / "p"
    stream = source(spark, [("a", 1, START + timedelta(hours=2))], schema, folder)
    q = streams.gap_groups(stream).writeStream.outputMode("append").format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    source(spark, [("a", 2, START), ("b", 3, START), ("a", 4, START + timedelta(hours=3))], schema, folder)
    q.processAllAvailable()
    q.stop()
    for _ in range(50):
        if late.dropped.get("dropped"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped == {"dropped": 2}


def test_references_and_late_photos(spark, tmp_path):
    write = streams.reference_writer(str(tmp_path / "refs"))
    batch = spark.createDataFrame([("a", START), ("b", START + timedelta(1))], "product_id string, confirmed_at timestamp")
    write(batch, 0)
    write(batch, 0)
    write(batch.union(spark.createDataFrame([("c", START)], batch.schema)), 1)
    assert {r.product_id: r.n for r in spark.read.parquet(str(tmp_path / "refs")).collect()} == {"a": 1, "b": 2, "c": 3}
    spark.createDataFrame([("x", START)], "lot_id string, ended_at timestamp").write.parquet(str(tmp_path / "closed"))
    put = streams.late_writer(str(tmp_path / "closed"), str(tmp_path / "late"), str(tmp_path / "kept"))
    put(spark.createDataFrame([("x", 1, START), ("x", 2, START + timedelta(1)), ("y", 3, START)], "lot_id string, photo_id long, captured_at timestamp"), 0)
    assert [r.photo_id for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [1]
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_violations_and_usage(spark, tmp_path):
    t = source(spark, [(1, "vinted", "title", None, "abc"), (2, "vinted", "title", None, "buena camiseta")], "text_id long, platform string, field string, brand string, text string", tmp_path / "t")
    assert [r.text_id for r in drained(spark, streams.live_violations(t), "codes", tmp_path).collect()] == [1]
    u = source(spark, [("p", "m", 10, 1, 0, False), ("p", "m", 10, 1, 0, True)], "product_id string, model string, tokens_in long, tokens_out long, cache_read long, cached boolean", tmp_path / "u")
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, price_in double, price_out double")
    r = drained(spark, streams.live_usage(u, prices, ["product_id"]), "usage", tmp_path, "complete").first()
    assert (r.calls, r.hits, r.tokens_in) == (1, 1, 10) and F.col is not None


class Held:
    """State in memory that counts its calls."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def containsKey(self, key):
        return self.getValue(key) is not None

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value


def test_a_product_takes_plain_rows_and_few_state_calls():
    p = streams.LedgerProcessor()
    p.held, p.places = Held(), Held()
    row = lambda seq, kind, price: Row(seq=seq, type=kind, at=seq, platform="vinted", price_cents=price, cost_cents=None, title=None, reference=None, bundle_id=None, sold_at=None)
    out = list(p.handleInputRows(("p",), iter([row(n, ("published", "sold")[n % 2], n) for n in range(99, -1, -1)]), None))
    assert [r.seq for r in out] == list(range(100)) and out[-1].price_cents == 99 and out[-2].listed_times == 50 and out[-2].listed_at == 0
    assert p.held.calls + p.places.calls <= 5


KINDS = ("published", "published", "sold", "sold", "returned", "undo_sale", "cost", "title", "reference", "other", None)


def odd_events(seed, products=60, batches=3):
    """Batches of events of every kind with nulls, negative cents, unknown platforms, equal times and products that come late or rest."""
    r, out, seq = random.Random(seed), [[] for _ in range(batches)], {}
    for n in range(batches):
        for p in range(products):
            for _ in range(r.choice((0, 0, 1, 3, 12)) if p < products - 2 or n else 0):
                seq[p] = seq.get(p, -2) + r.choice((1, 5))
                cents = lambda: r.choice((None, 0, 5, 700, 700, 1200, -1 if r.random() < 0.2 else 9))
                times = (None, START, START + timedelta(days=r.randint(-3, 3)))
                out[n].append((f"p{p}", seq[p], r.choice(times), r.choice(KINDS), r.choice(("vinted", "wallapop", "vinted", "wallapop", "ebay", None)), cents(), cents(), r.choice((None, "a", "b")), r.choice((None, 1, 2)), r.choice((None, None, 7, 8)), r.choice(times)))
    return out


def machine(parts):
    """After each batch: every product's state as ledger_state has it, by LedgerProcessor, and (rejected, sold, profit) of the batch."""
    made, out, names = {}, [], [c.split()[0] for c in EVENTS.split(", ")]
    for part in parts:
        rejected = sold = profit = 0
        for product in sorted({e[0] for e in part}):
            p = made.setdefault(product, streams.LedgerProcessor())
            if not hasattr(p, "held"):
                p.held, p.places = Held(), Held()
            for r in p.handleInputRows((product,), iter([Row(**dict(zip(names, e, strict=True))) for e in part if e[0] == product]), None):
                rejected, sold, profit = rejected + (r.reject is not None), sold + r.sold_delta, profit + r.profit_delta
        out.append(({k: ([(n, *v) for (n,), v in sorted(p.places.kept.items())], *p.held.kept[()]) for k, p in made.items()}, (rejected, sold, profit)))
    return out


def written(spark, folder, n):
    rows = spark.read.parquet(f"{folder}/batch={n}").collect()
    return {r.product_id: ([tuple(x) for x in r.publications], *(r[c] for c in (*streams.LIVE, *streams.SALE))) for r in rows}, tuple(sum(r[c] for r in rows) for c in ("rejected", "sold_delta", "profit_delta", "events"))


@pytest.mark.parametrize("seed", [1, 2])
def test_written_ledger_equals_the_state_machine(spark, tmp_path, seed):
    """Odd events in three batches, each run twice; then from the state of the batch ledger."""
    parts = odd_events(seed)
    frames, write, want = [spark.createDataFrame(x, EVENTS) for x in parts], streams.ledger_writer(str(tmp_path / "held")), machine(parts)
    for n, frame in enumerate(frames):
        write(frame, n)
        write(frame, n)
        held, sums = written(spark, tmp_path / "held", n)
        assert held == want[n][0] and sums == (*want[n][1], len(parts[n])) and len(held) > 20 and sums[0] > 5
    fold = ledger.folded(frames[0].unionByName(frames[1]).unionByName(frames[2]))
    sales = {r.product_id: (r.state, r.price_cents, r.platform, r.bundle_id, r.cost_snap_cents, r.title_snap, r.reference_snap, r.sold_at, r.created_at) for r in ledger.sales_of(fold).collect()}
    assert {k: v[4:] for k, v in held.items() if v[4]} == sales and len(sales) > 10
    assert {(k, x[0]): x[1:] for k, v in held.items() for x in v[0]} == {(r.product_id, r.platform): (r.listed_at, r.price_cents, r.times) for r in ledger.publications_of(fold).collect()}
    begun = spark.read.parquet(str(tmp_path / "held/batch=1")).drop("events", "rejected", "sold_delta", "profit_delta")
    streams.ledger_writer(str(tmp_path / "begun"), begun)(frames[2], 0)
    assert written(spark, tmp_path / "begun", 0) == (held, sums)


def test_a_batch_of_the_ledger_takes_one_exchange_and_one_sort(spark):
    parts = [spark.createDataFrame(x, EVENTS) for x in odd_events(3)]
    plan = streams.ledger_after(parts[1], streams.ledger_state(ledger.folded(parts[0])).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and "Python" not in plan


def test_streamed_publications_call_no_state_of_a_product(spark, monkeypatch):
    monkeypatch.setattr(streams, "LedgerProcessor", None)
    got = {(r.product_id, r.platform): r.times for r in QUERIES["streamed_publications"](spark, "/root/testdata/sf0.001").collect()}
    made = derived.events(spark, "/root/testdata/sf0.001").filter("type = 'published'").groupBy("product_id", "platform").count()
    assert got == {(r.product_id, r.platform): r["count"] for r in made.collect()} and len(got) > 100


def test_streamed_totals_sum_the_changes_of_batches(spark, tmp_path, monkeypatch):
    """Re-sales, returns and undone sales of a later batch retract what an earlier one counted; rejects are counted."""
    parts = odd_events(4)
    write, want = streams.ledger_writer(str(tmp_path / "held")), [x[1] for x in machine(parts)]
    for n, part in enumerate(parts):
        write(spark.createDataFrame(part, EVENTS), n)
    rejected, sold, profit = (sum(x) for x in zip(*want, strict=True))
    assert min(x[1] for x in want) < 0 and tuple(streams.live_totals(spark.read.parquet(str(tmp_path / "held"))).first()) == (sold, profit, rejected)
    monkeypatch.setattr(streams, "LedgerProcessor", None)
    sales = ledger.sales(derived.events(spark, "/root/testdata/sf0.001")).filter("state = 'vendida'").selectExpr("sum(price_cents)", "sum(price_cents - cost_snap_cents)").first()
    assert tuple(QUERIES["streamed_totals"](spark, "/root/testdata/sf0.001").first()) == (*sales, 0)


def test_streamed_sales_read_the_last_state(spark, monkeypatch):
    """Neither a state machine in Python nor the rows of every event."""
    monkeypatch.setattr(streams, "LedgerProcessor", None)
    out = QUERIES["streamed_sales"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(r.product_id, r.state, r.price_cents, r.platform, r.bundle_id, r.cost_snap_cents, r.sold_at) for r in ledger.sales(derived.events(spark, "/root/testdata/sf0.001")).collect()}
    assert {(r.product_id, r.state, r.price_cents, r.platform, r.bundle_id, r.cost_cents, r.sold_at) for r in out.collect()} == want and len(want) > 50
