"""SimHash near duplicates by Golay-code fuzzy hashing.

Fingerprints of two near copies differ by two bits at most. A fingerprint is cut into three segments of 22, 21 and 21
bits, each read as a word of the binary Golay code of 23 bits. That code is perfect: every word lies within three bits
of exactly one codeword. The fuzzy indices of a segment are the codeword indices of the word itself and of its 23
one-bit neighbours, one or six different ones; two words that differ by two bits at most have a neighbour in common,
and so an index.

1. Rows of one fingerprint are one class: all that follows sees distinct fingerprints.
2. Of three segments that hold two errors together one has none, and the next one after it has two at most. A
   fingerprint stands under keys of one exact segment and a fuzzy index of the next, 33 bits: 16 keys on average. Two
   fingerprints within two bits share one of them.
3. Keys of up to FEW fingerprints are joined with themselves, and the pairs are verified by counting bits.
4. The fingerprints of keys that hold more are not paired: each stands under itself and its 64 neighbours, and under
   each of these is linked to the least one there. Two that share a neighbour differ by two bits at most and two that
   differ by two bits at most share one, so this connects the same fingerprints in 65 rows each, however hot the key.

Classes are joined into components, and rows take the component of their class.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import discard, ship, written
from listingops.llm.components import components
from listingops.llm.words import BLOCK

SEED = 42
RADIUS = 2  # what one-bit neighbours on both sides reach
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and width of each
FEW = 64
WHITE = re.compile(rb"[\t-\r ]")
GOLAY = 0b110001110101  # the generator polynomial of the binary Golay code of 23 bits


def _remainders() -> np.ndarray:
    """The remainder of each power of x below 23 by the generator polynomial."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    return np.array(out, dtype=np.uint32)


REMAINDERS = _remainders()
_held: dict[str, np.ndarray] = {}


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of all values of each of a word's three bytes, and the errors that each of the 2,048 remainders tells."""
    if not _held:
        for b in range(3):
            value, out = np.arange(256, dtype=np.uint32), np.zeros(256, dtype=np.uint32)
            for i in range(8 * b, min(23, 8 * b + 8)):
                out ^= np.where(value >> np.uint32(i - 8 * b) & np.uint32(1), REMAINDERS[i], np.uint32(0)).astype(np.uint32)
            _held[f"byte{b}"] = out
        errors = np.zeros(2048, dtype=np.uint32)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                errors[np.bitwise_xor.reduce(REMAINDERS[list(bits)])] = sum(1 << i for i in bits)
        _held["errors"] = errors
    return [_held[f"byte{b}"] for b in range(3)], _held["errors"]


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The index, 0 to 4095, of the codeword nearest to each word of 23 bits."""
    own, errors = _tables()
    words = words.astype(np.uint32)
    syndrome = own[0][words & np.uint32(255)] ^ own[1][words >> np.uint32(8) & np.uint32(255)] ^ own[2][words >> np.uint32(16)]
    return (words ^ errors[syndrome]) >> np.uint32(11)


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """(words, 24) sorted codeword indices of each word of 23 bits and its one-bit neighbours, repeated ones included."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.uint32)
    return np.sort(codeword_index(words.astype(np.uint32)[:, None] ^ flips), axis=1)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) of all keys of the fingerprints."""
    segments = [(fingerprints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    places, keys = [], []
    for i, exact in enumerate(segments):
        fuzzy = fuzzy_indices(segments[(i + 1) % len(segments)])
        first = np.ones(fuzzy.shape, dtype=bool)
        first[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
        place, at = np.nonzero(first)
        places.append(place)
        keys.append(np.int64(i) << 40 | exact[place] << 12 | fuzzy[place, at].astype(np.int64))
    return np.concatenate(places), np.concatenate(keys)


def _blocks(text: bytes, size: int):
    """The text in blocks of about size bytes that end at white space."""
    at = 0
    while len(text) - at > size:
        white = WHITE.search(text, at + size)
        to = white.start() if white else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def fingerprint(text: str | None, k: int = 3, block: int = BLOCK) -> int:
    """The 64-bit SimHash of a text: bit b is 1 where more than half of its k-word shingles' hashes have it set.

    Words are runs other than space and \\x09-\\x0D, A-Z lower-cased; repeats count; a hash is XXH64 of the shingle's
    UTF-8 bytes, words joined by one space. A text with fewer words has one shingle of them all; one without words has
    0. Long texts go in blocks, each with the last words of the one before.
    """
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for part in _blocks((text or "").encode().lower(), block):
        words = tail + part.split()
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, (ends[k - 1 :] - 1).tolist())), repeat(SEED)), dtype=np.uint64, count=len(starts))
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[max(0, len(words) - k + 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a long) of every row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def keyed(classes: DataFrame) -> DataFrame:
    """key, fingerprint: every key of every row of classes(fingerprint)."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(own), 1 << 14):
                part = own[low : low + (1 << 14)]
                place, key = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[place])], names=["key", "fingerprint"])

    ship(classes.sparkSession)
    return classes.select("fingerprint").mapInArrow(run, "key long, fingerprint long")


def links(classes: DataFrame, few: int = FEW) -> DataFrame:
    """a, b: links between the fingerprints of classes(fingerprint), a written table, that connect all within RADIUS bits."""
    keys = keyed(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    posts = written(keys.join(shared, "key"), "posts")
    x, y = (posts.filter(F.col("held") <= few).select("key", "fingerprint").alias(n) for n in "xy")
    within = F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= RADIUS
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fingerprint") < F.col("y.fingerprint")) & within).select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))
    crowded = posts.filter(F.col("held") > few).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    stars = crowded.select("fingerprint", F.explode(F.transform(flips, lambda b: F.col("fingerprint").bitwiseXOR(b))).alias("near"))
    hubs = stars.groupBy("near").agg(F.min("fingerprint").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spokes = stars.join(hubs, "near").filter("fingerprint <> hub").select(F.col("hub").alias("a"), F.col("fingerprint").alias("b"))
    found = written(pairs.unionByName(spokes).distinct(), "links")
    discard(posts)
    return found


def near_fingerprints(docs: DataFrame, k: int = 3, few: int = FEW) -> DataFrame:
    """doc_id, fingerprint, component_id, component_key of every row of docs(doc_id, text).

    fingerprint is the SimHash as a long; rows whose fingerprints differ by two bits or fewer link. component_id is the
    least doc_id that links reach, the row's own included; a null doc_id is none, so it is null where links reach no
    other. component_key, the least fingerprint reached, names the component in any case. Null, empty and blank texts
    have fingerprint 0 and link like others. Repeated rows are rows each, and link. Other columns are ignored; empty
    input gives no rows.
    """
    rows = written(fingerprints(docs, k), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, few))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("component_key"))
    first = rooted.groupBy("component_key").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "component_key").select("fingerprint", "component_id", "component_key")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "component_key")
