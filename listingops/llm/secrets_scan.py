"""Secret scans: fixed rules, and character Markov models of random strings and of ordinary identifiers.

A candidate is a run of 12 or more key characters that no fixed rule covers. Two first-order character models give it a
log-likelihood ratio; a run is reported when the ratio, in total and per character, says random. The models are trained
from labelled samples (token, random 0/1): values that the rules find in the corpus and drawn strings on one side, all
other runs of key characters of the corpus, words and identifiers, on the other.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingops.llm.common import ship

# The rules and their shortest lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

SHORTEST = 12
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
EDGE = len(SYMBOLS)
CODE = {c: i for i, c in enumerate(SYMBOLS)}
_BYTE_CODE = np.full(256, EDGE, dtype=np.int64)
for _c, _i in CODE.items():
    _BYTE_CODE[ord(_c)] = _i


def _run_table(chars: str) -> bytes:
    return bytes(1 if chr(i) in chars and i < 128 else 0 for i in range(256))


_HEX_RUN, _KEY_RUN = _run_table("0123456789abcdef"), _run_table(SYMBOLS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind index, value) of the fixed rules, leftmost and non-overlapping within a kind."""
    out = []
    raw = text.encode("utf-8", "surrogatepass")
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"\1" * LEAST["hex"] in raw.translate(_HEX_RUN):
        out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


_LONG_RUN = re.compile(b"\1{%d,}" % SHORTEST)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of SHORTEST or more key characters, without dots at their ends, that touch no span of taken, by start."""
    raw = text.encode("utf-8", "surrogatepass")
    n, reach, at, point = 0, 0, 0, 0
    for m in _LONG_RUN.finditer(raw.translate(_KEY_RUN)):
        token = raw[m.start() : m.end()].lstrip(b".")
        low = m.end() - len(token)
        token = token.rstrip(b".")
        point += low - at if len(raw) == len(text) else len(raw[at:low].decode("utf-8", "surrogatepass"))
        at = low
        if len(token) >= SHORTEST:
            while n < len(taken) and taken[n][0] < point + len(token):  # the furthest end of spans that start before the run's end
                reach, n = max(reach, taken[n][1]), n + 1
            if reach <= point:
                yield point, point + len(token), token


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the next character under both models: ratio[a, b] = log random - log identifier."""

    ratio: np.ndarray
    per_char: float = 0.9
    total: float = 14.0

    def scores(self, tokens: list[bytes]) -> np.ndarray:
        """The log-likelihood ratio of each token, its edges included."""
        if not tokens:
            return np.empty(0)
        codes = _BYTE_CODE[np.frombuffer(b"\0".join([b"", *tokens, b""]), np.uint8)]
        sums = np.concatenate(([0.0], np.cumsum(self.ratio[codes[:-1], codes[1:]])))
        ends = np.cumsum([len(t) + 1 for t in tokens])
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]

    def secret(self, tokens: list[bytes]) -> np.ndarray:
        """The log-likelihood ratio of each token that is random, NaN for the others."""
        x = self.scores(tokens)
        return np.where((x >= self.total) & (x >= self.per_char * np.array([len(t) + 1 for t in tokens])), x, np.nan)


def drawn(samples: int, seed: int) -> list[str]:
    """Random strings over the alphabets that keys are commonly written in, as many of each."""
    r = random.Random(seed)
    alphabets = (SYMBOLS[:62], SYMBOLS[26:62], SYMBOLS[:26] + SYMBOLS[52:62], "0123456789abcdef", SYMBOLS[:64])
    return ["".join(r.choices(a, k=r.randint(SHORTEST, 48))) for a in alphabets for _ in range(samples)]


def transitions(texts: Iterable[str]) -> np.ndarray:
    """How often each key character follows each in texts. A run's edges are EDGE, as are all other characters."""
    codes = _BYTE_CODE[np.frombuffer("\0".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)]
    out = np.bincount(codes[:-1] * (EDGE + 1) + codes[1:], minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1)
    out[EDGE, EDGE] = 0  # between runs
    return out


def outside(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[str]:
    """The parts of text that no span of spans, sorted by start, covers."""
    at = 0
    for s, e, *_ in spans:
        if s > at:
            yield text[at:s]
        at = max(at, e)
    yield text[at:]


def fit(docs: DataFrame, *, drawn_each: int = 2_000, seed: int = 7) -> Model:
    """Both models, counted over all rows of docs (doc_id, text); what leaves a task and reaches the driver are counts
    of character pairs, whose number is fixed."""
    spark: SparkSession = docs.sparkSession
    schema = pa.schema([("random", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def count(batches):
        both = np.zeros((2, EDGE + 1, EDGE + 1), dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                secret, plain = [], []
                for text in batch.column(0).slice(low, 64).to_pylist():
                    found = base_spans(text or "")
                    secret += [v for *_, v in found]
                    plain += outside(text or "", found)
                both += np.stack((transitions(plain), transitions(secret)))
        at = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*at, both[at]), schema, strict=True)], schema=schema)

    ship(spark)
    counts = np.zeros((2, EDGE + 1, EDGE + 1))
    for r in docs.select("text").mapInArrow(count, "random int, a int, b int, n long").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["random"], r["a"], r["b"]] = r["n"]
    counts[1] /= max(1.0, counts[1].sum() / 50_000)  # samples from the corpus weigh no more than the drawn ones
    counts[1] += transitions(drawn(drawn_each, seed))
    p = counts + np.array([0.5, 0.05])[:, None, None]
    p = np.log(p / p.sum(axis=2, keepdims=True))
    return Model(p[1] - p[0])


SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and SPANS of every row of docs(doc_id, text), by start, then kind as in KINDS. score: of markov spans.

    start and end are code points, end exclusive. Null texts are empty; rows without a span have an empty array;
    repeated rows stay; other columns are ignored; empty input gives no rows.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(s, e, k, None) for s, e, k, _ in base]
                found = list(candidates(text, base))
                spans += [(s, e, 3, float(x)) for (s, e, _), x in zip(found, model.secret([t for *_, t in found]), strict=True) if x == x]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, e, k, x in sorted(spans, key=lambda y: (y[0], y[2], y[1]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SPANS}")
