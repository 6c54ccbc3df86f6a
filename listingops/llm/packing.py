"""Best-fit packing by exact-complement hashing of lengths.

Planning sees only how many pieces there are of each length, never the pieces: a table of at most `capacity` counts.
Sums of one, two and three lengths are indexed; for each length from the longest, combinations that exactly fill its
gap are consumed in batches as large as the counts allow; what remains is packed best fit. A plan is a list of patterns
(lengths, times). Each piece finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from listingops.llm.common import ranked_in, salts, ship, written

Pattern = tuple[tuple[int, ...], int]


class Counts:
    """How many pieces of each length are left, with the sums that two lengths make as a set of bits."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.left)
        self._pairs: int | None = None

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.left.get(x, 0) // lengths.count(x) for x in lengths)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
            if not self.left[x]:
                del self.left[x]
                self.lengths.pop(bisect.bisect_left(self.lengths, x))
                self._pairs = None

    def pair_sums(self) -> int:
        if self._pairs is None:
            single = sum(1 << x for x in self.lengths)
            self._pairs = 0
            for x in self.lengths:
                self._pairs |= single << x
        return self._pairs


def exact_fill(counts: Counts, gap: int, own: int) -> tuple[int, ...] | None:
    """One, two or three lengths that fill gap exactly beside a piece of length own; long ones first."""
    if gap in counts.left and counts.times((own, gap)):
        return (gap,)
    lengths = counts.lengths[: bisect.bisect_right(counts.lengths, gap)]

    def pair(total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        for a in reversed(lengths):
            if 2 * a < total:
                return None
            if total - a in counts.left and counts.times((*beside, a, total - a)):
                return (a, total - a)
        return None

    sums = counts.pair_sums()
    if sums >> gap & 1 and (two := pair(gap, (own,))):
        return two
    for a in reversed(lengths):
        if sums >> (gap - a) & 1 and (two := pair(gap - a, (own, a))):
            return (a, *two)
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns whose lengths sum to at most capacity and which use every piece of the histogram once."""
    counts = Counts(histogram)
    patterns: list[Pattern] = []
    rest: dict[int, int] = {}
    while counts.lengths:
        own = counts.lengths[-1]
        if own == capacity:
            patterns.append(((own,), counts.left[own]))
            counts.take((own,), counts.left[own])
        elif fill := exact_fill(counts, capacity - own, own):
            lengths = (own, *fill)
            patterns.append((lengths, counts.times(lengths)))
            counts.take(lengths, patterns[-1][1])
        else:
            rest[own] = counts.left[own]
            counts.take((own,), rest[own])
    bins: dict[int, list[Pattern]] = {}  # by gap
    for own in sorted(rest, reverse=True):
        left = rest[own]
        while left:
            gap = min((g for g in bins if g >= own), default=None)
            if gap is None:
                each = capacity // own  # as many as fit, then the remainder
                lengths, times = ((own,) * each, left // each) if left >= each else ((own,) * left, 1)
            else:
                lengths, times = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                fit = max(1, min(gap // own, left // times))
                if times > left:
                    bins.setdefault(gap, []).append((lengths, times - left))
                    times, fit = left, 1
                lengths = lengths + (own,) * fit
                left -= times * fit
                bins.setdefault(capacity - sum(lengths), []).append((lengths, times))
                continue
            left -= times * len(lengths)
            bins.setdefault(capacity - sum(lengths), []).append((lengths, times))
    return patterns + [p for g in sorted(bins) for p in bins[g]]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per sequence, first sequence, offset of the first in a sequence) by pattern and length.

    Equal lengths stand next to each other in a sequence, so rank r lands in sequence first + (r - low) // per, at
    offset + (r - low) % per * length.
    """
    out, used, sequence = [], {}, 0
    for lengths, times in patterns:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            out.append((x, used.get(x, 0), per * times, per, sequence, at))
            used[x] = used.get(x, 0) + per * times
            at += per * x
        sequence += times
    return out


def assign(pieces: DataFrame, capacity: int, length: str, order: list[str]) -> DataFrame:
    """pieces with sequence_id and offset (long). pieces is read again: pass a written table. capacity: under 131,072.

    A length may hold any share of the pieces; ranks come from salted counts. The plan's rows are bounded by capacity
    lengths times the patterns that exhaust them, not by the input, so tasks hold it as arrays and search it by
    (length, rank).
    """
    if capacity >= 1 << 17:
        raise ValueError("capacity times RANKS must stay within a long")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # capacity rows at most
    rows = sorted(slots(plan(histogram, capacity)))
    lengths, lows, _, pers, firsts, offsets = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 6
    keys = lengths * RANKS + lows
    ranked = ranked_in(pieces, [length], order, salts(sum(histogram.values())), "_r")

    def place(batches):
        for batch in batches:
            x, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_r"))
            i = np.searchsorted(keys, x * RANKS + r, side="right") - 1
            k = r - lows[i]
            kept = batch.drop_columns(["_r"])
            yield kept.append_column("sequence_id", pa.array(firsts[i] + k // pers[i])).append_column("offset", pa.array(offsets[i] + k % pers[i] * x))

    ship(pieces.sparkSession)
    fields = [f for f in ranked.schema if f.name != "_r"]
    return ranked.mapInArrow(place, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


RANKS = 1 << 46  # more than any length has pieces
# Fixed value: the pattern by which byte-level BPE cuts a text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row from which on a text goes through tokenizers: BYTE_LEVEL backtracks once for each character.
LONG_BLANK = 10_000
BLANKS = re.compile(r"\s+")
#: Characters whose classes are the same in every version of Unicode that a library may have.
SETTLED = re.compile("[\\x00-\u024f\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
_held: dict[tuple[int, int, bool], Encoder] = {}


def long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in BLANKS.finditer(text))


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the contents of a vocabulary file of the tokenizers library.

    Where the file is plain byte-level BPE whose ids follow its merges, texts of settled characters without a special
    token go through a tiktoken encoding built from the same file, which gives the same ids in a fraction of the time.
    All others, and texts with very long runs of white space, go through tokenizers. With plain_specials the strings of
    special tokens are ordinary text.
    """

    def __init__(self, file: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = plain_specials
        held = json.loads(file)
        specials = tuple(x["content"] for x in held.get("added_tokens", ()))
        self.special = () if plain_specials else specials
        self.fast = self._ranks(held, specials)

    def _ranks(self, held: dict, specials: tuple[str, ...]):
        import tiktoken

        model, cut = held["model"], held.get("pre_tokenizer") or {}
        if held.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            return None
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        byte = _byte_characters()
        ids = {k: v for k, v in model["vocab"].items() if k not in specials}
        merged = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if sorted(merged) != merged or merged[:1] == [-1] or any(c not in byte for k in ids for c in k):
            return None
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in ids.items()}, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self.whole(texts)
        odd = [(not t.isascii() and not SETTLED.fullmatch(t)) or any(x in t for x in self.special) or long_blank(t) for t in texts]
        others = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(others) if o else np.array(self.fast.encode_ordinary(t), dtype="<u4").tobytes() for t, o in zip(texts, odd, strict=True)]


def encoder(file: str, plain_specials: bool = False) -> Encoder:
    """The encoder of a vocabulary file's contents, made once in a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = zlib.crc32(file.encode()), len(file), plain_specials
    if key not in _held:
        _held[key] = Encoder(file, plain_specials)
    return _held[key]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids): pieces of capacity tokens, the first may be shorter."""
    n = len(ids) // 4
    first = n % capacity if n > capacity else n
    at, k = 0, 0
    while at < n:
        to = at + (first if not k and first else capacity)
        yield k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])
        at, k = to, k + 1


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: PIECES. A null text has only end_id.

    tokenizer is the path of a vocabulary file on the driver; its contents, a few MB whatever the input, are broadcast.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
    end = end_id.to_bytes(4, "little")
    held = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches):
        encode = encoder(held.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                rows = [(d, *p) for d, x in zip(part.column(0).to_pylist(), ids, strict=True) for p in pieces_of(x + end, capacity)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """PIECES with sequence_id and offset: all documents packed into few sequences of at most capacity tokens.

    Null and empty texts are one piece of one token. Repeated rows are packed each. A null doc_id stays null. Empty
    input gives no rows. Other columns are ignored.
    """
    pieces = written(tokenized(docs, tokenizer, capacity, end_id), "pieces")
    return assign(pieces, capacity, "length", ["doc_id", "piece", "start", "ids_crc32"])
