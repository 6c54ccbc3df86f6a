"""N-gram Jaccard join: a grouped prefix join that returns the components of its links.

A document's set holds the hashes of its k-word shingles. Two documents link when den * |A & B| >= num * |A | B|.

1. Documents with equal sets are one class. A set of n shingles whose shingles are put in a global order can only link
   to sets that share one of its first n - ceil(num n / den) + 1 shingles, its prefix. The order used is: shingles of
   a fixed share of the hash space by how many classes hold them, those that nothing else holds first; then the rest by
   hash. So only that share of shingles is counted, over all documents, and hot passages come last.
2. Classes of identical prefix and size are one group, held against its first member.
3. Each class is held against one class that shares most of its prefix. What is linked so far gets the label of its
   component; only classes of different labels are ever held against each other from there on.
4. The classes that share a prefix shingle, less those of its most frequent label, are the shingle's rest. With FEW of
   them, they are paired with the others directly. More are held against a hub, a central one of them, and each class
   is then its difference to the hub's set: |x ^ y| = |dx| + |dy| - 2 |dx & dy|, so
   two classes that are not both linked to the hub can only link if they share a good part of their differences.
   These are joined by prefixes in turn, rarest first, in place of the long common part: step 4 again, with elements of
   differences as shingles. After LEVELS rounds what is left is paired directly, so that nothing depends on the bound.

A hot group of near copies so costs a few comparisons for each member. Pairs are first bounded by parity sketches (the
sets' symmetric difference is at least the number of odd bits) and then compared on the whole sets. No link between
different sets is lost; links within a class or a component are never listed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import discard, if_small, ship, written
from listingops.llm.components import components
from listingops.llm.words import mixed, shingles, word_hashes

U = np.uint64
SKETCH_BITS = 512
FEW = 256
LEVELS = 4
SAMPLE = 64  # members of a group that vote for its hub, about


def class_of(s: np.ndarray) -> int:
    """A hash of a sorted set."""
    with np.errstate(over="ignore"):
        x = mixed(s + np.arange(len(s), dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        return int((mixed(np.add.reduce(x, keepdims=True) ^ np.bitwise_xor.reduce(x, keepdims=True) * U(0xD6E8FEB86659FD93)) + U(len(s))).view(np.int64)[0])


def sketch_of(s: np.ndarray) -> bytes:
    odd = np.bincount((s >> U(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def counted_share(num: int, den: int) -> int:
    """One of how many shingles are counted: two and a half prefixes' worth, so that a prefix can avoid hot ones."""
    return max(1, int(1 / (2.5 * (1 - num / den)) + 1e-9)) if num < den else 16


SETS = "doc_id long, text_key long, cid long, n int, n0 int, low array<long>, extra array<long>, sketch binary"


def shingle_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """SETS of docs(doc_id, text_key, text): class, size, the counted shingles, and the first of the others if needed."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("n0", pa.int32()), ("low", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("sketch", pa.binary())])
    share = U(counted_share(num, den))

    def run(batches):
        for batch in batches:
            for i, j, h, bounds in word_hashes(batch.column(2)):
                cid, n, low, extra, sketch = [], [], [], [], []
                for r in range(j - i):
                    s = np.unique(shingles(h[bounds[r] : bounds[r + 1]], k))
                    counted = s % share == 0
                    own, p = s[counted], prefix_size(len(s), num, den)
                    cid.append(class_of(s) if len(s) else 0)
                    n.append(len(s))
                    low.append(own)
                    extra.append(s[~counted][: p - len(own)] if len(s) and len(own) < p else s[:0])
                    sketch.append(sketch_of(s))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c]))), pa.int32()), pa.array(np.concatenate(c).view(np.int64))) for c in (low, extra)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array([len(x) for x in low], pa.int32()), *lists, pa.array(sketch)], schema=schema)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, SETS)


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid, s (sorted set) of the classes of wanted(doc_id, text_key), read from their texts again."""
    wanted = if_small(wanted.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")))
    own = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["text_key"] == F.col("_k")), "left_semi")
    schema = pa.schema([("cid", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for _, _, h, bounds in word_hashes(batch.column(0)):
                sets = [np.unique(shingles(h[a:b], k)) for a, b in zip(bounds, bounds[1:], strict=False)]
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) if len(s) else 0 for s in sets], pa.int64()), flat], schema=schema)

    return own.select("text").mapInArrow(run, "cid long, s array<long>").dropDuplicates(["cid"])


class Join:
    """One run over docs; every table of it is written to the shared folder."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.kappa = (den - num) / (den + num)  # of two linked sets' sizes, the most that they differ by
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        self.rows = written(shingle_sets(self.docs, k, num, den), "sets")

    # -- prefixes ----------------------------------------------------------------------------------------------------

    def prefixes(self, classes: DataFrame) -> DataFrame:
        """cid, n, u, prefix of the classes that can link: u shingles of the prefix are nobody else's and left out."""
        total = classes.agg(F.sum("n0")).first()[0] or 1
        bits = min(63, max(32, int(total).bit_length() + 8))  # a key may stand for several shingles; it then joins more, never less
        marks = classes.select("cid", F.explode(F.transform("low", lambda x: F.shiftrightunsigned(x, 64 - bits))).alias("key"))
        often = marks.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = marks.join(often, "key").groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("shared"))  # no more than a document's shingles
        p = F.col("n") - F.ceil(F.col("n") * self.num / F.lit(self.den)).cast("int") + 1
        both = classes.select("cid", "n", "n0", "extra").join(shared, "cid", "left").withColumn("u", F.col("n0") - F.coalesce(F.size("shared"), F.lit(0))).withColumn("p", p)
        able = both.filter("u < p OR n0 < p")
        own = F.coalesce(F.transform(F.slice("shared", F.lit(1), F.greatest(F.col("p") - F.greatest("u", F.lit(0)), F.lit(0))), lambda x: x["key"]), F.expr("CAST(array() AS array<bigint>)"))
        return able.select("cid", "n", F.greatest("u", F.lit(0)).alias("u"), F.array_distinct(F.concat(own, "extra")).alias("prefix"))

    # -- comparisons -------------------------------------------------------------------------------------------------

    def most(self, a: str, b: str) -> Column:
        """The largest symmetric difference of two linked sets of sizes a and b, with room for rounding."""
        return (F.col(a) + F.col(b)) * self.kappa + 1e-6

    def near(self, a: str, b: str, na: str, nb: str) -> Column:
        """Whether the sketches a and b leave room for a link of sets of the sizes na and nb."""
        odd = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
        return (F.abs(F.col(na) - F.col(nb)) <= self.most(na, nb)) & (odd <= self.most(na, nb))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) that link, by their whole sets, as a written table."""
        whole = lambda x: self.wholes.select(F.col("cid").alias(x), F.col("s").alias(f"s{x}"))
        shared = F.size(F.array_intersect("sa", "sb"))
        compared = written(pairs, "near").join(whole("a"), "a").join(whole("b"), "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
        return written(compared.filter(F.col("shared") * self.den >= (F.col("both") - F.col("shared")) * self.num).select("a", "b"), "links")

    def labelled(self, posts: DataFrame, links: DataFrame) -> DataFrame:
        """posts(cid, ...) with lab: the component of the class by links."""
        roots = components(links).select(F.col("node").alias("cid"), F.col("root").alias("_root"))
        return posts.join(roots, "cid", "left").withColumn("lab", F.coalesce("_root", "cid")).drop("_root")

    # -- groups ------------------------------------------------------------------------------------------------------

    def settled(self, posts: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
        """(links found among groups with a small rest, hub and cid of the members of others).

        posts(key, cid, n, m, w, lab, side): the classes that share key; m is the size of their set (or difference), w
        how many of its elements come before key: two sets whose first common element is key differ by the w of both at
        least. Groups of one label are done. Where side is not null, only classes of
        different sides are paired.
        """
        by_label = posts.groupBy("key", "lab").agg(F.count(F.lit(1)).alias("m"))
        mains = by_label.groupBy("key").agg(F.max(F.struct("m", "lab")).alias("x"), F.sum("m").alias("f"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        mains = mains.select("key", F.col("x.lab").alias("main"), (F.col("f") - F.col("x.m")).alias("rest"))
        posts = written(posts.join(mains, "key"), "posts")
        few = (posts if last else posts.filter(F.col("rest") <= FEW)).join(self.sketches.select("cid", "sketch"), "cid")
        x, y = few.filter("lab <> main").alias("x"), few.alias("y")
        fits = (F.abs(F.col("x.m") - F.col("y.m")) <= self.most("x.n", "y.n")) & (F.col("x.w") + F.col("y.w") <= self.most("x.n", "y.n"))
        other = (F.col("x.lab") != F.col("y.lab")) & ((F.col("y.lab") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))) & (F.col("x.side").isNull() | (F.col("x.side") != F.col("y.side")))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & other & fits & self.near("x.sketch", "y.sketch", "x.n", "y.n"))
        found = self.linked(pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())
        if last:
            return found, posts.select(F.col("cid").alias("hub"), "cid").limit(0)
        many = posts.filter(F.col("rest") > FEW)
        hubs = many.filter("lab <> main").groupBy("key").agg(F.min(F.struct("w", "cid")).alias("x")).select("key", F.col("x.cid").alias("hub"))
        return found, written(many.join(hubs, "key").select("hub", "cid").distinct(), "members")

    def differences(self, members: DataFrame) -> DataFrame:
        """hub, cid, n, m, d, near of members(hub, cid): the difference d to its group's hub, its size, whether they link.

        The first hub is any member and may be far from the others. Elements in which most of a sample of the group
        differ from it are its own peculiarities; the member nearest to the group without these becomes the hub. The
        sample only chooses the hub, whatever it is the links found are the same.
        """
        own = members.select(F.col("hub").alias("group"), "cid").join(self.wholes.select("cid", F.col("s").alias("sn")), "cid").join(self.wholes.select(F.col("cid").alias("group"), F.col("s").alias("sh")), "group")
        rows = written(own.select("group", "cid", F.size("sn").alias("n"), F.concat(F.array_except("sn", "sh"), F.array_except("sh", "sn")).alias("d")), "first")
        sizes = rows.groupBy("group").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / SAMPLE)).alias("each"))
        some = rows.select("group", "cid", "d").join(sizes, "group").filter(F.pmod(F.xxhash64("cid"), F.col("each")) == 0)
        voters = some.groupBy("group").agg(F.count(F.lit(1)).alias("voters"))
        common = some.select("group", F.explode("d").alias("e")).groupBy("group", "e").agg(F.count(F.lit(1)).alias("c")).join(voters, "group").filter("2 * c > voters").groupBy("group").agg(F.collect_list("e").alias("common"))
        apart = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
        nothing = F.expr("CAST(array() AS array<bigint>)")
        ranked = rows.join(common, "group", "left").select("group", F.struct(apart("d", F.coalesce("common", nothing)).alias("far"), "cid").alias("x"))
        hubs = ranked.groupBy("group").agg(F.min("x").alias("x")).select("group", F.col("x.cid").alias("hub"))
        hubs = hubs.join(rows.select("group", F.col("cid").alias("hub"), F.col("n").alias("nh"), F.col("d").alias("dh")), ["group", "hub"])
        once = rows.select("group", "cid").join(hubs.select("group", "hub"), "group").filter("cid <> hub").groupBy("hub", "cid").agg(F.min("group").alias("group"))  # groups of one hub are one
        out = rows.join(once, ["group", "cid"]).join(hubs, ["group", "hub"]).select("hub", "cid", "n", "nh", F.concat(F.array_except("d", "dh"), F.array_except("dh", "d")).alias("d")).withColumn("m", F.size("d"))
        shared, union = (F.col("n") + F.col("nh") - F.col("m")) / 2, (F.col("n") + F.col("nh") + F.col("m")) / 2
        return written(out.withColumn("near", shared * self.den >= union * self.num), "differences")

    def regrouped(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """Posts, as settled() takes them, of the elements of differences(...) that classes not yet linked may share.

        A class x with |dx| = m can only link to a y with m - most <= |dy|, so they share (m + |dy| - most) / 2 elements
        at least; x stands under its rarest elements up to that number. An element that fewer than two can share counts
        as nobody else's.
        """
        rows = self.labelled(rows, links)
        by_label = rows.groupBy("hub", "lab").agg(F.count(F.lit(1)).alias("c"))
        mains = by_label.groupBy("hub").agg(F.max(F.struct("c", "lab")).alias("x"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("hub", F.col("x.lab").alias("main"))
        rows = written(rows.join(mains, "hub").withColumn("rest", F.col("lab") != F.col("main")), "sides")
        least = rows.groupBy("hub").agg(F.min(F.when(F.col("rest"), F.col("m"))).alias("least_rest"), F.min(F.when(~F.col("rest"), F.col("m"))).alias("least_main"))
        marks = rows.select("hub", "cid", "rest", F.explode("d").alias("e"))
        use = marks.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("rest").cast("int")).alias("r")).filter("df > 1 AND r > 0")
        kept = marks.join(use, ["hub", "e"]).groupBy("hub", "cid").agg(F.array_sort(F.collect_list(F.struct("df", "e", "r"))).alias("u"))  # no more than two documents' shingles
        sized = rows.select("hub", "cid", "n", "m", "lab", "rest").join(least, "hub").join(kept, ["hub", "cid"])
        most = F.col("n") * (1 + self.den / self.num) * self.kappa + 1e-6  # for the largest set that may link
        need = lambda other: F.greatest(F.lit(1.0), F.ceil((F.col("m") + F.greatest(F.col(other), F.col("m") - most) - most - 1e-6) / 2))

        def prefix(kind: int, fits, other: str) -> Column:  # kind: 0 among the rest, 1 between the rest and the most frequent label
            u = F.filter("u", fits)
            size = F.greatest(F.lit(0.0), F.coalesce(F.size(u) - need(other) + 1, F.lit(0.0))).cast("int")
            return F.transform(F.slice(u, F.lit(1), size), lambda v, i: F.struct(F.lit(kind).alias("kind"), v["e"].alias("e"), (F.col("m") - F.size(u) + i).alias("w")))

        among_rest = F.when(F.col("rest"), prefix(0, lambda v: v["r"] > 1, "least_rest"))
        with_main = prefix(1, lambda v: v["r"] < v["df"], "_other")
        sized = sized.withColumn("_other", F.when(F.col("rest"), F.col("least_main")).otherwise(F.col("least_rest")))
        nothing = F.expr("CAST(array() AS array<struct<kind:int,e:bigint,w:int>>)")
        posts = sized.select("hub", "cid", "n", "m", "lab", "rest", F.explode(F.concat(F.coalesce(among_rest, nothing), F.coalesce(with_main, nothing))).alias("p"))
        return posts.select(F.xxhash64("hub", "p.kind", "p.e").alias("key"), "cid", "n", "m", F.col("p.w").alias("w"), "lab", F.when(F.col("p.kind") == 1, F.col("rest").cast("int")).alias("side"))

    def links(self) -> DataFrame:
        """a, b: links between classes that connect all that any links connect."""
        sets, classes = self.rows, written(self.rows.filter("n > 0").dropDuplicates(["cid"]), "classes")
        self.rows = written(sets.select("doc_id", "text_key", "cid", "n"), "rows")
        discard(sets)  # the arrays of all rows are the largest of the tables
        prefixes = written(self.prefixes(classes), "prefixes")
        posts = prefixes.select("cid", "n", "u", F.xxhash64("n", "prefix").alias("alike"), F.posexplode("prefix").alias("at", "key"))
        heads = posts.groupBy("key").agg(F.min(F.struct("u", "cid")).alias("x"), F.count(F.lit(1)).alias("f")).filter("f > 1").select("key", F.col("x.cid").alias("head"))
        posts = written(posts.join(heads, "key"), "posts")
        able = posts.select("cid").distinct()
        chosen = classes.join(able, "cid", "left_semi")
        self.wholes = written(_whole_sets(self.docs, written(chosen.select("doc_id", "text_key"), "wanted"), self.k), "wholes")
        words = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_BITS // 64 - 1)), lambda i: F.conv(F.hex(F.substring("sketch", i * 8 + 1, 8)), 16, -10).cast("long"))
        self.sketches = written(chosen.select("cid", "n", words.alias("sketch")), "sketches")
        discard(classes)
        # groups of identical prefix and size against their first member; each class against one that shares most of its prefix
        groups = posts.filter("u = 0").select("cid", "alike").distinct()
        firsts = groups.groupBy("alike").agg(F.min("cid").alias("b"))
        alike = groups.join(firsts, "alike").filter("cid > b").select(F.col("cid").alias("a"), "b")
        best = posts.filter("cid <> head").groupBy("cid", "head").agg(F.count(F.lit(1)).alias("c"))
        best = best.groupBy(F.col("cid").alias("a")).agg(F.max(F.struct("c", "head")).alias("x")).select("a", F.col("x.head").alias("b"))
        pairs = alike.union(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda x: self.sketches.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
        links = self.linked(pairs.join(side("a"), "a").join(side("b"), "b").filter(self.near("ka", "kb", "na", "nb")).select("a", "b"))
        posts = posts.select("key", "cid", "n", F.col("n").alias("m"), (F.col("u") + F.col("at")).alias("w"), F.lit(None).cast("int").alias("side"))
        posts = self.labelled(posts, links)
        for level in range(LEVELS):
            found, members = self.settled(posts, level == LEVELS - 1)
            links = links.unionByName(found)
            if members.isEmpty():
                break
            rows = self.differences(members)
            links = written(links.unionByName(rows.filter("near").select(F.col("hub").alias("a"), F.col("cid").alias("b"))), "links")
            posts = self.regrouped(rows, links)
        links = written(links, "links")
        discard(self.wholes)
        return links

    def result(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id, component_key of every row."""
        roots = components(self.links())
        least = self.rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
        named = least.join(roots, least["cid"] == roots["node"], "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
        first = named.groupBy("root").agg(F.min("least").alias("component_id"))
        by_class = named.join(first, "root").select("cid", "component_id", F.col("root").alias("component_key"))
        rows = self.rows.select("doc_id", "text_key", "cid", "n")
        linked = rows.filter("n > 0").join(by_class, "cid").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "component_key")
        alone = rows.filter("n = 0").select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_key"))
        return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component_key of every row of docs(doc_id, text).

    component_id is the least doc_id that links reach, the row's own included; a null doc_id is none, so it is null
    where links reach no other. component_key names the component in any case, and is null where a text has no words. A
    text with fewer than k words has one shingle of them all; a text without words, empty or null has none and links
    with nothing. Repeated rows are rows each, and link. text_key is xxhash64 of the text. Other columns are ignored;
    empty input gives no rows.
    """
    return Join(docs, k, num, den).result()
