"""Search terms, queries and valuations from comparable listings.

attributes: product_id, field, value, source. listings: query, rank, url, price, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.sources import dims


def searchable(value: Column, source: Column) -> Column:
    """The trimmed value of an observed field, else null."""
    return F.when(source.isin(*dims.SEARCHABLE_SOURCES), T.blank_to_null(value))


def wide_attributes(attributes: DataFrame, any_source: bool = False) -> DataFrame:
    """product_id, marca, modelo, tipo, talla, ean, titulo: searchable values (or all, for editable suggestions)."""
    v = T.blank_to_null(F.col("value")) if any_source else searchable(F.col("value"), F.col("source"))
    return attributes.groupBy("product_id").agg(*(F.max(F.when(F.col("field") == f, v)).alias(f) for f in ("marca", "modelo", "tipo", "talla", "ean", "titulo")))


def search_urls(terms: Column) -> Column:
    return F.struct(*(F.when(terms != "", F.concat(F.lit(u), F.url_encode(terms))).alias(p) for p, u in sorted(dims.SEARCH_URLS.items())))


def build_queries(wide: DataFrame) -> DataFrame:
    """product_id, terms, match, reason, urls: an EAN is exact; brand, model, type and size in that order are
    approximate; a size alone or nothing gives no query."""
    text = F.concat_ws(" ", "marca", "modelo", "tipo", "talla")
    named = F.coalesce("marca", "modelo", "tipo").isNotNull()
    terms = F.when(F.col("ean").isNotNull(), F.col("ean")).when(named, text).otherwise("")
    reason = F.when(F.col("ean").isNotNull(), "by_ean").when(named, "by_text").when(F.col("talla").isNotNull(), "only_modifiers").otherwise("no_data")
    out = wide.select("product_id", terms.alias("terms"), F.when(F.col("ean").isNotNull(), "exacto").when(named, "aproximado").alias("match"), reason.alias("reason"))
    return out.withColumn("urls", search_urls(F.col("terms")))


def search_variants(wide: DataFrame) -> DataFrame:
    """product_id, pos, terms: up to seven combinations, narrow to wide, each with the brand or the model, once each."""
    b, m, t, s = (F.col(c) for c in ("marca", "modelo", "tipo", "talla"))
    both = b.isNotNull() & m.isNotNull()
    made = F.array(
        F.when(both, F.concat_ws(" ", b, m, t, s)), F.when(both, F.concat_ws(" ", b, m)), m,
        F.when(b.isNotNull(), F.concat_ws(" ", b, t, s)), F.when(b.isNotNull(), F.concat_ws(" ", b, t)), F.when(b.isNotNull(), F.concat_ws(" ", b, s)), b,
    )
    return wide.select("product_id", F.posexplode(F.array_distinct(F.array_compact(made))).alias("pos", "terms"))


def suggested_variants(attributes: DataFrame) -> DataFrame:
    """search_variants of values of any source; the title stands in where there are none."""
    wide = wide_attributes(attributes, any_source=True)
    made = search_variants(wide)
    bare = wide.join(made.select("product_id").distinct(), "product_id", "left_anti").filter("titulo IS NOT NULL")
    return made.unionByName(bare.select("product_id", F.lit(0).alias("pos"), F.col("titulo").alias("terms")))


def comparables(listings: DataFrame) -> DataFrame:
    """The first fifteen listings of each query by rank, after those without a slug or a price above 0 are gone."""
    valid = listings.filter((F.col("price") > 0) & T.blank_to_null(F.col("url")).isNotNull())
    return valid.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("rank", "url"))).filter(F.col("_n") <= dims.MOST_COMPARABLES).drop("_n")


def value_queries(queries: DataFrame, listings: DataFrame) -> DataFrame:
    """queries(..., terms) with n, median, least, most, reason and comparables; no figure under five comparables. Prices count
    in whole cents."""
    first = comparables(listings).groupBy("query").agg(F.count(F.lit(1)).alias("n"), *(f(F.rint(F.col("price") * 100)).alias(c) for f, c in ((F.median, "_m"), (F.min, "_l"), (F.max, "_h"))), F.array_sort(F.collect_list(F.struct("rank", "url", "price", "title"))).alias("comparables"))
    rows = queries.join(first, queries["terms"] == first["query"], "left").drop("query")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= dims.LEAST_COMPARABLES
    rounded = lambda c: F.when(enough, F.floor(F.col(c) + 0.5) / 100)  # noqa: E731  half a cent goes up
    reason = F.when(enough, "median_asked").otherwise("too_few")
    return rows.withColumn("median", rounded("_m")).withColumn("least", rounded("_l")).withColumn("most", rounded("_h")).withColumn("reason", reason).drop("_m", "_l", "_h")


def value_products(wide: DataFrame, listings: DataFrame) -> DataFrame:
    """product_id, terms, n, median, least, most, reason: gates in order no terms, no brand or model, too few. By text only."""
    named = F.coalesce("marca", "modelo", "tipo").isNotNull()
    strong = F.coalesce("marca", "modelo").isNotNull()
    terms = F.when(named, F.concat_ws(" ", "marca", "modelo", "tipo", "talla"))
    rows = wide.select("product_id", terms.alias("shown"), F.when(strong, terms).alias("terms"))
    out = value_queries(rows, listings)
    reason = F.when(F.col("shown").isNull(), "no_terms").when(F.col("terms").isNull(), "cohort_too_wide").otherwise(F.col("reason"))
    return out.select("product_id", F.coalesce("shown", F.lit("")).alias("terms"), "n", "median", "least", "most", reason.alias("reason"), "comparables")


def value_variants(wide: DataFrame, listings: DataFrame) -> DataFrame:
    return value_queries(search_variants(wide), listings)


def value_terms(terms: DataFrame, listings: DataFrame) -> DataFrame:
    """One valuation for each non-blank free term of terms(term_id, terms)."""
    return value_queries(terms.withColumn("terms", T.blank_to_null(F.col("terms"))).filter("terms IS NOT NULL"), listings)


def suggested_price(valuations: DataFrame) -> DataFrame:
    """product_id, price: the first variant with a median."""
    out = valuations.groupBy("product_id").agg(F.min(F.when(F.col("median").isNotNull(), F.struct("pos", "median"))).alias("x"))
    return out.select("product_id", F.col("x.median").alias("price"))


def with_garment(attributes: DataFrame) -> DataFrame:
    """attributes, with tipo taken from the title for products without a searchable one."""
    has = attributes.filter((F.col("field") == "tipo") & searchable(F.col("value"), F.col("source")).isNotNull()).select("product_id").distinct()
    found = attributes.filter("field = 'titulo'").join(has, "product_id", "left_anti").select("product_id", F.lit("tipo").alias("field"), T.garment(F.col("value")).alias("value"), F.lit("reviewer").alias("source")).filter("value IS NOT NULL")
    rest = attributes.join(found.select("product_id", "field"), ["product_id", "field"], "left_anti")
    return rest.select("product_id", "field", "value", "source").unionByName(found)
