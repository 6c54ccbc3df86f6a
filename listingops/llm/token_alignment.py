"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers see a space and the text; A is a byte-level BPE file of tokenizers, B a sentencepiece model, which adds
the space itself. Tokens are byte ranges. In each batch two merge_asof calls, keyed by document (the documents of a batch
follow each other, so that the key is part of a position), find for every token start the token of the other side that
covers it; both directions together are all overlaps. Overlapping tokens of equal ends close a group: between two such
ends both sides cut the same bytes. All pairs of an A and a B token of one group are linked.

The batches' tables, one row for each document with its distinct id pairs, are written once; counts of pairs are sums over
them, and so are the highest counts of each A id. Counts meet the documents again by a broadcast where the table of counts
takes COUNT_BYTES at most, else by a shuffle on the pair; both give the same rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import discard, ship, written
from listingops.llm.packing import _byte_characters, encoder
from listingops.llm.words import BLOCK

SHIFT = 32  # a pair of ids is a << SHIFT | b
COUNT_BYTES = 64 << 20
CROSSED = 1 << 22  # links of one step, about
_held: dict[tuple[int, int], Pieces] = {}


class Pieces:
    """Texts to ids of a sentencepiece model given by its file's bytes; the model adds the space before a text.

    No merge crosses from another character to a space where no piece has a space inside, so long texts are encoded in
    parts that end there, for bounded memory and the same ids. A model with such pieces encodes texts whole.
    """

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.cuts = not any("▁" in x.lstrip("▁") for x in names)

    def parts(self, text: str) -> list[str]:
        """The text in parts of about BLOCK characters; the space before each but the first is left to the model."""
        out, at = [], 0
        while self.cuts and len(text) - at > BLOCK:
            to = text.find(" ", at + BLOCK)
            while to > 0 and text[to - 1] in " ▁":  # a run of spaces stays whole
                to = text.find(" ", to + 1)
            if to < 0:
                break
            out.append(text[at:to])
            at = to + 1
        return [*out, text[at:]]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        parts = [self.parts(t) for t in texts]
        ids = iter(self.model.encode([p for own in parts for p in own], num_threads=1))
        return [next(ids) if len(own) == 1 else [x for _ in own for x in next(ids)] for own in parts]


def pieces(file: bytes) -> Pieces:
    """The model of a file's bytes, made once in a Python worker."""
    key = zlib.crc32(file), len(file)
    if key not in _held:
        _held[key] = Pieces(file)
    return _held[key]


def byte_level_entries(file: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file; of characters that stand for no byte, their UTF-8."""
    held, byte = json.loads(file), _byte_characters()
    ids = held["model"]["vocab"] | {x["content"]: x["id"] for x in held.get("added_tokens", ())}
    out = [b""] * (max(ids.values(), default=-1) + 1)
    for name, i in ids.items():
        out[i] = b"".join(bytes([byte[c]]) if c in byte else c.encode() for c in name)
    return out


class Side:
    """What a batch needs of one vocabulary: entries, their lengths, and ids as text with what follows within a group."""

    def __init__(self, entries: list[bytes], last: str):
        self.lengths = np.array([len(x) for x in entries], dtype=np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.inner = np.array([f"{i}," for i in range(len(entries))], dtype=object)
        self.last = np.array([f"{i}{last}" for i in range(len(entries))], dtype=object)


    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the entries of ids, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - ends + n, n) + np.arange(n.sum())]


def same_ends(starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens whose covering token of the other side, found by their starts, ends where they do, and of those."""
    own, other = pd.DataFrame({"at": starts}), pd.DataFrame({"at": other_starts, "other": np.arange(len(other_starts))})
    covering = pd.merge_asof(own, other, on="at")["other"].to_numpy()
    equal = np.flatnonzero(ends == other_ends[covering])
    return equal, covering[equal]


def _distinct(group: np.ndarray, ids: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times), by group: tokens as they stand, in crowded groups one for each id."""
    big = crowded[group]
    if not big.any():
        return group, ids, np.ones(len(ids), dtype=np.int64)
    keys, times = np.unique(group[big] << SHIFT | ids[big], return_counts=True)
    g = np.concatenate((group[~big], keys >> SHIFT))
    order = np.argsort(g, kind="stable")
    return g[order], np.concatenate((ids[~big], keys & ((1 << SHIFT) - 1)))[order], np.concatenate((np.ones((~big).sum(), dtype=np.int64), times))[order]


def tallied(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the weights of each, of 1 each without weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, n_groups: int, doc_of: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, links, bounds): document d has the distinct id pairs pairs[bounds[d] : bounds[d + 1]], each so many links.

    Groups are numbered in order and doc_of names the document of each. Groups of many tokens are crossed by distinct
    ids, and groups go in steps of about CROSSED links, so that no group is ever listed token by token.
    """
    crowded = np.bincount(group_a, minlength=n_groups) + np.bincount(group_b, minlength=n_groups) > 64
    ga, a, na = _distinct(group_a, a, crowded)
    gb, b, nb = _distinct(group_b, b, crowded)
    first_a, first_b = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n_groups)))) for x in (ga, gb))
    crossed = np.diff(first_a) * np.diff(first_b)
    total = np.concatenate(([0], np.cumsum(crossed)))
    wide_a, wide_b = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
    keys, sums, low = [], [], 0
    while low < n_groups:
        high = max(low + 1, int(np.searchsorted(total, total[low] + CROSSED, side="right")) - 1)
        g = np.repeat(np.arange(low, high), crossed[low:high])
        k = np.arange(total[low], total[high]) - total[g]
        width = (first_b[1:] - first_b[:-1])[g]
        i, j = first_a[g] + k // width, first_b[g] + k % width
        key, n = tallied((doc_of[g] * wide_a + a[i]) * wide_b + b[j], na[i] * nb[j] if crowded[low:high].any() else None)
        keys.append(key)
        sums.append(n)
        low = high
    key, n = (keys[0], sums[0]) if len(keys) == 1 else tallied(np.concatenate(keys), np.concatenate(sums)) if keys else (np.empty(0, np.int64),) * 2
    doc, pair = key // (wide_a * wide_b), key % (wide_a * wide_b)
    return pair // wide_b << SHIFT | pair % wide_b, n, np.searchsorted(doc, np.arange(n_docs + 1))


def aligned(texts: list[str], ids_a: list[np.ndarray], ids_b: list[np.ndarray], side_a: Side, side_b: Side) -> pa.RecordBatch:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, links of each text. Tokens of texts that they do not spell are left out."""
    n = len(texts)
    whole = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.array([len(w) for w in whole], dtype=np.int64)
    a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (ids_a, ids_b))
    differ = np.zeros(n, dtype=bool)
    for ids, flat, side in ((ids_a, a, side_a), (ids_b, b, side_b)):
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        differ |= np.diff(np.concatenate(([0], np.cumsum(side.lengths[flat])))[bounds]) != sizes
    if not differ.any():
        known = np.frombuffer(b"".join(whole), dtype=np.uint8)
        for flat, side in ((a, side_a), (b, side_b)):
            differ[np.searchsorted(np.cumsum(sizes), np.flatnonzero(side.spelled(flat) != known), side="right")] = True
    if differ.any():
        none = np.empty(0, np.int64)
        return aligned(["" if x else t for t, x in zip(texts, differ, strict=True)], *([none if x else v for v, x in zip(ids, differ, strict=True)] for ids in (ids_a, ids_b)), side_a, side_b)
    n_a, n_b = np.array([len(x) for x in ids_a], dtype=np.int64), np.array([len(x) for x in ids_b], dtype=np.int64)
    end_a, end_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
    start_a, start_b = end_a - side_a.lengths[a], end_b - side_b.lengths[b]
    closes_a, closes_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    if len(a):
        for (x, y), (own, other) in ((same_ends(start_a, end_a, start_b, end_b), (closes_a, closes_b)), (same_ends(start_b, end_b, start_a, end_a), (closes_b, closes_a))):
            own[x] = other[y] = True
    up_to = np.concatenate(([0], np.cumsum(closes_a)))
    group_a, group_b = up_to[:-1], np.cumsum(closes_b) - closes_b
    first_a, first_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    n_groups, g = np.diff(up_to[first_a]), int(up_to[-1])
    doc_of = np.repeat(np.arange(n), n_groups)
    sizes_a, sizes_b = np.bincount(group_a, minlength=g), np.bincount(group_b, minlength=g)
    n_links = np.concatenate(([0], np.cumsum(sizes_a * sizes_b)))[np.concatenate(([0], np.cumsum(n_groups)))]
    # a group's ids as text: its A ids, then its B ids
    shown = np.empty(len(a) + len(b), dtype=object)
    shown_a, shown_b = side_a.inner[a], side_b.inner[b]
    shown_a[closes_a], shown_b[closes_b] = side_a.last[a[closes_a]], side_b.last[b[closes_b]]
    shown[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = shown_a
    shown[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = shown_b
    both = first_a + first_b
    digests = [hashlib.sha256("".join(shown[both[r] : both[r + 1]].tolist())[:-1].encode()).hexdigest() if n_a[r] else "" for r in range(n)]
    pairs, links, bounds = linked(group_a, a, group_b, b, g, doc_of, n)
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, links)]
    return pa.RecordBatch.from_arrays([pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()), pa.array(np.diff(n_links)), pa.array(digests), *lists], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])


ALIGNED = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
TEXT_BYTES = 1 << 20  # of one step, about


def alignments(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """ALIGNED of every row of docs(doc_id, text): token counts, groups, links, and distinct id pairs with their links.

    byte_level and piece_model are paths of vocabulary files on the driver; their contents, a few MB whatever the input,
    are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast((Path(byte_level).read_text(encoding="utf-8"), Path(piece_model).read_bytes()))

    def run(batches):
        file, model = held.value
        encode, split = encoder(file, plain_specials=True), pieces(model)
        side_a, side_b = Side(byte_level_entries(file), "|"), Side(split.bytes, ";")

        def step(batch, texts):
            ids_a = [np.frombuffer(x, dtype="<u4") for x in encode([" " + t for t in texts])]
            ids_b = [np.array(x, dtype=np.int64) for x in split(texts)]
            ids_a, ids_b = ([x if t else x[:0] for x, t in zip(ids, texts, strict=True)] for ids in (ids_a, ids_b))
            out = aligned(texts, ids_a, ids_b, side_a, side_b)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out.columns], names=["row_key", "doc_id", *out.schema.names])

        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            low, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= TEXT_BYTES or i + 1 == len(texts):
                    yield step(batch.slice(low, i + 1 - low), texts[low : i + 1])
                    low, size = i + 1, 0

    ship(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """pair, docs: in how many rows of a table of ALIGNED each pair is linked. Tasks add up what they read, in steps of most pairs."""

    def run(batches):
        keys, sums, held = [], [], 0
        for batch in batches:
            k = batch.column(0).flatten().to_numpy()
            keys.append(k)
            sums.append(np.ones(len(k), dtype=np.int64))
            held += len(k)
            if held > most:
                k, s = tallied(np.concatenate(keys), np.concatenate(sums))
                keys, sums, held = [k], [s], len(k)
                if len(k) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s)], names=["pair", "docs"])
                    keys, sums, held = [], [], 0
        if held:
            k, s = tallied(np.concatenate(keys), np.concatenate(sums))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s)], names=["pair", "docs"])

    return rows.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def counted(rows: DataFrame, counts: DataFrame, count_bytes: int) -> DataFrame:
    """row_key, n_best, count_sum of the rows of a table of ALIGNED that have links; counts(pair, docs, best) is a written table."""
    if counts.count() * 17 <= count_bytes:
        known = counts.toArrow().sort_by("pair")
        pair, docs, best = (known.column(c).to_numpy() for c in ("pair", "docs", "best"))
        held = rows.sparkSession.sparkContext.broadcast((pair, docs, best))  # no more than count_bytes
        del known, pair, docs, best

        def run(batches):
            pair, docs, best = held.value
            for batch in batches:
                lists = batch.column(1)
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                at = np.searchsorted(pair, lists.flatten().to_numpy())
                n = batch.column(2).flatten().to_numpy()
                sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[offsets]) for x in (n * best[at], n * docs[at])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["row_key", "n_best", "count_sum"])

        return rows.select("row_key", "pairs", "links").mapInArrow(run, "row_key long, n_best long, count_sum long")
    each = rows.select("row_key", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row_key", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    met = each.join(counts, "pair")
    return met.groupBy("row_key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))


def align(docs: DataFrame, byte_level: str, piece_model: str, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text).

    n_best counts the links whose id pair is linked in as many rows as any pair of its A id is, ties included; count_sum
    adds up that count over all links. Null and empty texts, and texts whose tokens do not spell them (such as those with
    U+2581), have no tokens: zeros and ''. Repeated rows count each; a null doc_id stays null. Other columns are ignored;
    empty input gives no rows. A text that offers the piece model no place to part it, a run of one character, is
    encoded whole.
    """
    rows = written(alignments(docs, byte_level, piece_model), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    a = F.shiftright("pair", SHIFT)
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top"))
    counts = written(counts.withColumn("a", a).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "pair-ranks")
    sums = written(counted(rows, counts, count_bytes), "pair-sums")
    zero = F.lit(0).cast("long")
    out = rows.select("row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row_key", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
