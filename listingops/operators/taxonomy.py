"""Ranking category leaves for a listing's text.

leaves: platform, leaf_id, name, path (array, root first), root_id. Query tokens are matched against the tree's distinct
tokens, never against every leaf of every listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingops.functions import text as T
from listingops.sources import dims
from listingops.sources.stored import stored


def tree_leaves(nodes: DataFrame) -> DataFrame:
    """platform, leaf_id, name, path, root_id of nodes(platform, id, parent_id, name): nodes that are nobody's parent.

    path holds the ancestors' names, root first. The tree is walked by a recursive query, level by level.
    """
    spark = nodes.sparkSession
    walked = spark.sql("""
        WITH RECURSIVE walk AS (
          SELECT platform, id, name, CAST(array() AS array<string>) AS path, id AS root_id FROM {nodes} WHERE parent_id IS NULL
          UNION ALL
          SELECT n.platform, n.id, n.name, concat(w.path, array(w.name)) AS path, w.root_id FROM walk w JOIN {nodes} n ON n.parent_id = w.id AND n.platform = w.platform
        ) SELECT * FROM walk""", nodes=nodes)
    parents = nodes.filter("parent_id IS NOT NULL").select("platform", F.col("parent_id").alias("id")).distinct()
    return walked.join(parents, ["platform", "id"], "left_anti").select("platform", F.col("id").alias("leaf_id"), "name", "path", "root_id")


def leaf_tokens(leaves: DataFrame) -> DataFrame:
    """platform, leaf_id, token, stem, weight: leaf name 3, parent 1.5, inner ancestors 0.5; the root does not count."""
    n = F.size("path")
    own = F.struct(F.lit(dims.LEAF_WEIGHT).alias("weight"), T.tokens(F.col("name")).alias("tokens"))
    parent = F.struct(F.lit(dims.PARENT_WEIGHT).alias("weight"), T.tokens(F.get("path", n - 1)).alias("tokens"))
    inner = F.struct(F.lit(dims.ANCESTOR_WEIGHT).alias("weight"), T.tokens(F.array_join(F.slice("path", F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).alias("tokens"))
    rows = leaves.select("platform", "leaf_id", F.explode(F.array(own, parent, inner)).alias("x")).select("platform", "leaf_id", "x.weight", F.explode("x.tokens").alias("token"))
    return rows.withColumn("stem", T.stem(F.col("token"))).distinct()


def idf(leaves: DataFrame) -> DataFrame:
    """platform, stem, idf = ln(1 + N / leaves whose whole path or name holds the stem)."""
    every = leaves.select("platform", "leaf_id", F.explode(T.tokens(F.concat_ws(" ", F.array_join("path", " "), "name"))).alias("t")).select("platform", "leaf_id", T.stem(F.col("t")).alias("stem")).distinct()
    df = every.groupBy("platform", "stem").agg(F.count(F.lit(1)).alias("df"))
    total = leaves.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(total), "platform").select("platform", "stem", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def token_matches(query_words: DataFrame, tree_words: DataFrame) -> DataFrame:
    """token, tree_token of query_words(token) and tree_words(tree_token) that match: equal stems, or one holds the
    other with four letters or more in both. Both sides are distinct vocabularies."""
    q = query_words.select("token", T.stem(F.col("token")).alias("stem"))
    t = tree_words.select("tree_token", T.stem(F.col("tree_token")).alias("stem"))
    stems = q.join(t, "stem").select("token", "tree_token")
    # containment by equality: a word's pieces of four letters or more against whole words of the other side
    pieces = lambda w: F.filter(F.flatten(F.transform(F.sequence(F.lit(4), F.length(w)), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)))), lambda s: F.length(s) >= 4)
    long_q, long_t = q.filter(F.length("token") >= 4), t.filter(F.length("tree_token") >= 4)
    inside = long_q.join(long_t.select("tree_token", F.explode(F.array_distinct(pieces(F.col("tree_token")))).alias("_p")), F.col("token") == F.col("_p")).select("token", "tree_token")
    around = long_q.select("token", F.explode(F.array_distinct(pieces(F.col("token")))).alias("_p")).join(long_t, F.col("tree_token") == F.col("_p")).select("token", "tree_token")
    return stems.union(inside).union(around).distinct()


def postings(words: DataFrame, leaves: DataFrame) -> DataFrame:
    """token, platform, leaf_id, w of words(token), distinct: the best weight times IDF of a tree token that the word matches."""
    tree = leaf_tokens(leaves)
    matches = token_matches(words, tree.select(F.col("token").alias("tree_token")).distinct())
    weights = idf(leaves)
    fallback = weights.groupBy("platform").agg(F.avg("idf").alias("mean"))
    scored = tree.join(weights, ["platform", "stem"], "left").join(F.broadcast(fallback), "platform").select("platform", "leaf_id", F.col("token").alias("tree_token"), (F.col("weight") * F.coalesce("idf", "mean")).alias("w"))
    return matches.join(scored, "tree_token").groupBy("token", "platform", "leaf_id").agg(F.max("w").alias("w"))


def _scopes(platform: Column, category: Column, child: Column) -> Column:
    """The roots that a category is searched under on a platform, as text: ALL where the category restricts nothing."""
    known = sorted({p for p, _ in dims.ROOTS})
    names = lambda ids: F.array(*(F.lit(str(x)) for x in ids))
    none = F.array().cast("array<string>")
    of = F.coalesce(*(F.when((platform == p) & (category == c), names(ids)) for (p, c), ids in dims.ROOTS.items()), none)
    young = F.coalesce(*(F.when(platform == p, names(dims.CHILD_ROOTS.get(p, ()))) for p in known), none)
    limited = F.coalesce(category.isin(*sorted({c for _, c in dims.ROOTS})), F.lit(False))
    return F.when(limited, F.when(child, F.array_union(of, young)).otherwise(of)).otherwise(F.array(F.lit(ALL)))


ALL = "all"  # the scope of every root
SEED_TOKENS = 2


def asked_tokens(listings: DataFrame) -> DataFrame:
    """product_id, category, gender, child, tokens (sorted) of listings(product_id, category, text); '' for no category or gender."""
    asked = listings.select("product_id", "category", "text", T.tokens(F.col("text")).alias("tokens"))
    child = F.coalesce((F.col("category") == "moda") & T.names_child(F.col("text")), F.lit(False))
    return asked.select("product_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce(T.gender_of(F.col("tokens")), F.lit("")).alias("gender"), child.alias("child"), F.array_sort("tokens").alias("tokens"))


def rank_categories(listings: DataFrame, leaves: DataFrame, k: int = 3) -> DataFrame:
    """product_id, platform, rank, leaf_id, name, score of listings(product_id, category, text).

    The broad category restricts the tree to its roots, with the child roots where a fashion text says child; unknown
    categories search the whole tree. Scores sum, for each query token, the best weight times IDF; gender and child
    factors multiply. Only scores above 0, rounded to nine digits; ties go to the shorter path, then the name, then the id.

    Few leaves are scored. The best leaves of a listing's strongest tokens give a score that k leaves reach. Tokens whose
    best weights together stay below it, with the largest factor that the listing can get, cannot lift a leaf there on
    their own: only leaves that hold another token are looked up, and of these only the ones that the weights found and
    the bounds of the rest may lift there are scored in full. Listings of the same tokens, category, gender and child
    words are one search. The rows are those of scoring every leaf for every listing; a null text has no tokens and no
    rows, repeated rows get theirs each.
    """
    rows = stored(asked_tokens(listings), "listing-tokens")
    same = ["category", "gender", "child", "tokens"]
    searches = rows.groupBy(*same).agg(F.min("product_id").alias("search_id"))
    ranks = _ranked(searches.withColumnRenamed("search_id", "product_id"), leaves, k).withColumnRenamed("product_id", "search_id")
    named = rows.join(searches, same).select("product_id", "search_id")
    return named.join(ranks, "search_id").select("product_id", "platform", "rank", "leaf_id", "name", "score")


def _ranked(asked: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """rank_categories() of asked(product_id, category, gender, child, tokens), one row for each product_id."""
    hopeful, scored = likely_leaves(asked, leaves, k)
    w = W.partitionBy("product_id", "platform").orderBy(F.col("score").desc(), "depth", "name", "leaf_id")
    final = scored(hopeful).filter("score > 0").withColumn("rank", F.row_number().over(w))
    return final.filter(F.col("rank") <= k).select("product_id", "platform", "rank", "leaf_id", "name", "score")


def likely_leaves(asked: DataFrame, leaves: DataFrame, k: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(product_id, platform, leaf_id, gender, child of all leaves that may be among the k best, what scores such rows)."""
    words = asked.select("product_id", F.explode("tokens").alias("token")).groupBy("product_id", "token").agg(F.count(F.lit(1)).alias("n"))
    index = stored(postings(words.select("token").distinct(), leaves), "postings")
    genders = F.transform(T.tokens(F.concat_ws(" ", F.array_join("path", " "), "name")), T.stem)
    holds = lambda g: F.arrays_overlap("_stems", F.array(*(F.lit(s) for s in T.stems_of(dims.GENDER_WORDS[g]))))
    child_root = F.coalesce(*(F.when(F.col("platform") == p, F.col("root_id").isin(*ids)) for p, ids in dims.CHILD_ROOTS.items()), F.lit(False))
    about = leaves.withColumn("_stems", genders).select("platform", "leaf_id", "root_id", "name", F.size("path").alias("depth"), holds("hombre").alias("man"), holds("mujer").alias("woman"), child_root.alias("child_root"))
    scoped = index.join(about.select("platform", "leaf_id", F.explode(F.array(F.col("root_id").cast("string"), F.lit(ALL))).alias("scope")), ["platform", "leaf_id"])
    by_token = ["platform", "scope", "token"]
    bounds = scoped.groupBy(*by_token).agg(F.max("w").alias("most"))
    heads = scoped.withColumn("_r", F.row_number().over(W.partitionBy(*by_token).orderBy(F.col("w").desc(), "leaf_id"))).filter(F.col("_r") <= k).select(*by_token, "leaf_id")

    # a listing's tokens under each scope, the strongest first, with the bounds of all after
    places = F.broadcast(leaves.select("platform").distinct())
    under = asked.drop("tokens").crossJoin(places).withColumn("scope", F.explode(_scopes(F.col("platform"), F.col("category"), F.col("child"))))
    query = ["product_id", "platform", "scope"]
    strongest = W.partitionBy(*query).orderBy((F.col("n") * F.col("most")).desc(), "token")
    held = under.join(words, "product_id").join(bounds, by_token)
    held = stored(held.withColumn("place", F.row_number().over(strongest)).withColumn("below", F.sum(F.col("n") * F.col("most")).over(strongest.rowsBetween(W.currentRow, W.unboundedFollowing))), "asked")

    gender = F.when(F.col("gender") == "hombre", F.when(F.col("man") & ~F.col("woman"), dims.GENDER_BONUS).when(~F.col("man") & F.col("woman"), dims.GENDER_PENALTY)).when(F.col("gender") == "mujer", F.when(F.col("woman") & ~F.col("man"), dims.GENDER_BONUS).when(~F.col("woman") & F.col("man"), dims.GENDER_PENALTY))
    factor = F.coalesce(gender, F.lit(1.0)) * F.when(~F.col("child"), 1.0).when(F.col("child_root"), dims.CHILD_BONUS).otherwise(dims.ADULT_PENALTY)
    top_factor = F.when(F.col("gender") != "", dims.GENDER_BONUS).otherwise(1.0) * F.when(F.col("child"), dims.CHILD_BONUS).otherwise(1.0)
    leaf = ["product_id", "platform", "leaf_id"]
    room = 1e-6  # for rounding

    def scored(rows: DataFrame) -> DataFrame:
        """rows(leaf, gender, child) with the score of each leaf over all of the listing's tokens."""
        sums = rows.join(words, "product_id").join(index, ["token", "platform", "leaf_id"]).groupBy(*leaf, "gender", "child").agg(F.sum(F.col("n") * F.col("w")).alias("sum"))
        return sums.join(about, ["platform", "leaf_id"]).withColumn("score", F.round(F.col("sum") * factor, 9))

    seeds = scored(held.filter(F.col("place") <= SEED_TOKENS).join(heads, by_token).select(*leaf, "gender", "child").distinct())
    kth = seeds.withColumn("_r", F.row_number().over(W.partitionBy("product_id", "platform").orderBy(F.col("score").desc()))).filter(F.col("_r") == k).select("product_id", "platform", F.col("score").alias("reached"))
    bounded = held.join(kth, ["product_id", "platform"], "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))
    able = bounded.filter(F.col("below") * top_factor + room >= F.col("reached"))  # tokens from the first that the rest can do without
    rest = able.groupBy(*query).agg(F.max("place").alias("last"))
    after = bounded.join(rest, query).filter(F.col("place") > F.col("last")).groupBy(*query).agg(F.sum(F.col("n") * F.col("most")).alias("rest"))
    found = able.join(scoped, by_token).groupBy(*query, "leaf_id", "gender", "child", "reached").agg(F.sum(F.col("n") * F.col("w")).alias("part"))
    hopeful = found.join(after, query, "left").join(about.select("platform", "leaf_id", "man", "woman", "child_root"), ["platform", "leaf_id"])
    hopeful = hopeful.filter((F.col("part") + F.coalesce("rest", F.lit(0.0))) * factor + room >= F.col("reached"))
    return hopeful.select(*leaf, "gender", "child"), scored
