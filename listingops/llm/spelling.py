"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter-count vectors.

One inserted or deleted letter changes the counts of a word's letters by one in all, one replaced letter by two: near
words lie at an L1 distance of one where their lengths differ by one, and of two where they are equal.

Tasks count words as they read texts, and Spark adds up the counts. For each length, cells of a k-d tree, its planes
taken from a bounded sample of the words, split the words into boxes of about BOX words; the planes only decide what
shares a task, never what is found. A word is a point of the box of its length that it lies in. It also asks there, in
the other boxes of its length that lie within a replacement, and in those of the next length within an insertion: a
plane is crossed by one step up or down, and an edit has few. Each box with its questions is one group: a local k-d tree
over the points is searched for all of them at once, subtrees pruned by their bounding boxes, and the letter order of
what is left is verified. A group gives back one row for each word with near words in it: how many, and the best.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import discard, ship, written

RUN = re.compile("[a-zÀ-ÿ]+")
BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")
BOX = 16_384  # words of a box, about
SAMPLE = 65_536  # words from which planes are taken, about
LEAF = 128
HELD = 1 << 18  # distinct words that a task counts before it gives them away
BLOCK = 1 << 20
STEP = 1 << 21  # cells of a comparison


def damaged(doc_id: int | None, run: str) -> str:
    """The run, less one letter where the checksum of document and run is divisible by 97. A null doc_id reads ''."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str):
    """The maximal runs of letters, A-Z lower-cased, in lists: of the whole text, or of blocks that end between runs."""
    at = 0
    while len(text) - at > BLOCK:
        gap = BETWEEN.search(text, at + BLOCK)
        to = gap.start() if gap else len(text)
        yield RUN.findall(text[at:to].encode().lower().decode())
        at = to
    yield RUN.findall(text[at:].encode().lower().decode())


def word_counts(docs: DataFrame, shortest: int, least: int) -> DataFrame:
    """word, n: words of shortest letters or more that all texts hold least times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: Counter[str] = Counter()

        def give():
            words, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in runs_of(text or ""):
                    for word, n in Counter(part).items():
                        if len(word) >= shortest and len(word := damaged(doc_id, word)) >= shortest:
                            held[word] += n
                    if len(held) > HELD:
                        yield give()
        yield give()

    ship(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# -- vectors and cells -----------------------------------------------------------------------------------------------


def planes(words: list[str], most: float) -> list:
    """A tree of [letter, count, lower, upper] or None: words of at most count of the letter go lower, cells hold most of the sample."""
    if len(words) <= most:
        return None
    best = None
    for x in set("".join(words)):
        n = np.array([w.count(x) for w in words])
        at = int(np.median(n))
        for cut in (at - 1, at):
            low = int((n <= cut).sum())
            if 0 < low < len(words) and (best is None or abs(2 * low - len(words)) < best[0]):
                best = (abs(2 * low - len(words)), x, cut)
    if best is None:
        return None
    _, x, cut = best
    return [x, cut, planes([w for w in words if w.count(x) <= cut], most), planes([w for w in words if w.count(x) > cut], most)]


def cells(word: str, tree: list | None, ups: int, downs: int, at: int = 1):
    """(cell, ups, downs left) of the cells that the word reaches with so many letters more and fewer; cells as paths in the tree."""
    if tree is None:
        yield at, ups, downs
        return
    x, cut, lower, upper = tree
    n = word.count(x)
    if n <= cut:
        yield from cells(word, lower, ups, downs, 2 * at)
        if n == cut and ups:
            yield from cells(word, upper, ups - 1, downs, 2 * at + 1)
    else:
        yield from cells(word, upper, ups, downs, 2 * at + 1)
        if n == cut + 1 and downs:
            yield from cells(word, lower, ups, downs - 1, 2 * at)


# -- the search in a box ---------------------------------------------------------------------------------------------


def search(points: np.ndarray, asked: np.ndarray, ups: int, downs: int):
    """(question, point) numbers of all pairs where the point has ups letters more in all, by a k-d tree over points; in blocks.

    Vectors are columns. Nodes carry the bounding box of their points; a question goes down only where the box is ups
    letters above and downs below it at most. All points have one sum, as have all questions, and the difference of the
    two is that of ups and downs.
    """
    most = asked.max(axis=1)
    stack = [(np.arange(points.shape[1]), np.arange(asked.shape[1]))]
    while stack:
        own, live = stack.pop()
        box = points[:, own]
        low, high = box.min(axis=1), box.max(axis=1)
        above, below = np.zeros(len(live), dtype=asked.dtype), np.zeros(len(live), dtype=asked.dtype)
        for d in np.flatnonzero((low > 0) | (high < most)):
            q = asked[d, live]
            above += np.maximum(low[d] - q, 0)
            below += np.maximum(q - high[d], 0)
        live = live[(above <= ups) & (below <= downs)]
        if not len(live):
            continue
        spread = high - low
        if len(own) <= LEAF or not spread.any():
            used = np.flatnonzero(high)
            for i in range(0, len(live), STEP // 256):
                part = asked[np.ix_(used, live[i : i + STEP // 256])]
                for p in range(0, len(own), 256):
                    more = np.zeros((len(own[p : p + 256]), part.shape[1]), dtype=asked.dtype)
                    for x, q in zip(box[used, p : p + 256], part, strict=True):
                        more += np.maximum(x[:, None] - q, 0)
                    y, x = np.nonzero(more == ups)
                    yield live[i : i + STEP // 256][x], own[p : p + 256][y]
            continue
        cuts = np.minimum(np.median(box, axis=1).astype(box.dtype), high - 1)
        halves = np.abs((box <= cuts[:, None]).sum(axis=1) * 2 - len(own))
        halves[spread == 0] = len(own) + 1
        d = int(halves.argmin())
        lower = box[d] <= cuts[d]
        stack += [(own[lower], live), (own[~lower], live)]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which columns of a become those of b by one replaced letter, or by one inserted where b is one row longer."""
    if len(a) == len(b):
        return (a != b).sum(axis=0, dtype=np.int32) == 1
    tail = np.ones((len(b), a.shape[1]), dtype=bool)  # whether all letters from a place on are those after the inserted one
    for i in range(len(a) - 1, -1, -1):
        tail[i] = tail[i + 1] & (a[i] == b[i + 1])
    head, near = np.ones(a.shape[1], dtype=bool), tail[0].copy()
    for i in range(len(a)):
        head &= a[i] == b[i]
        near |= head & tail[i + 1]
    return near


def near_pairs(points: list[str], asked: list[str]):
    """(question, point) numbers of the words of points, all of one length, one edit from words of asked, of that length or one less."""
    if not points or not asked:
        return
    longer = len(points[0]) - len(asked[0])
    codes = [np.frombuffer("".join(x).encode("utf-32-le"), dtype="<u4").reshape(len(x), -1) for x in (points, asked)]
    alphabet = np.unique(np.concatenate([x.ravel() for x in codes]))
    own, other = (np.ascontiguousarray(np.searchsorted(alphabet, x).T.astype(np.uint8)) for x in codes)  # 90 letters at most
    kind = np.int8 if len(own) < 128 else np.int32

    def counts(x):
        flat = x.astype(np.int64) * x.shape[1] + np.arange(x.shape[1])
        return np.bincount(flat.ravel(), minlength=len(alphabet) * x.shape[1]).reshape(len(alphabet), -1).astype(kind)

    held, size = [], 0

    def verified():
        q, p = (np.concatenate(x) for x in zip(*held, strict=True))
        step = max(1, STEP // len(own))
        for i in range(0, len(q), step):
            near = one_edit(other[:, q[i : i + step]], own[:, p[i : i + step]])
            yield q[i : i + step][near], p[i : i + step][near]

    for q, p in search(counts(own), counts(other), 1, 1 - longer):
        held.append((q, p))
        size += len(q)
        if size >= STEP:
            yield from verified()
            held, size = [], 0
    if size:
        yield from verified()


def _better(best: np.ndarray, rank: np.ndarray, at: np.ndarray, of: np.ndarray) -> None:
    """best[at] becomes the number of least rank among its own and of."""
    order = np.lexsort((-rank[of], at))  # the last of equal places is the one that counts
    at, of = at[order], of[order]
    last = np.append(at[1:] != at[:-1], True)
    at, of = at[last], of[last]
    won = (best[at] < 0) | (rank[of] < rank[best[at]])
    best[at[won]] = of[won]


NEAR = "word string, n_near long, best_n long, best string"


def box_rows(table: pa.Table) -> pa.Table:
    """NEAR of the words of one box: rows (word, n, role), role 0 the points, 1 questions of their length, 2 of one less.

    Of two words of equal length the one with a question meets the other once: points ask each other as pairs.
    """
    table = table.sort_by("word")
    words, n, role = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("role").to_numpy()
    rank = np.empty(len(words), dtype=np.int64)  # the more frequent first, then the smaller in code-point order
    rank[np.lexsort((np.arange(len(words)), -n))] = np.arange(len(words))
    near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
    places = [np.flatnonzero(role == r) for r in range(3)]
    points = [words[i] for i in places[0]]
    for r in range(3):
        for q, p in near_pairs(points, [words[i] for i in places[r]]):
            a, b = places[r][q], places[0][p]
            if r == 0:
                a, b = a[q < p], b[q < p]
            for x, y in ((a, b), (b, a)):
                near += np.bincount(x, minlength=len(words))
                if len(x):
                    _better(best, rank, x, y)
    some = np.flatnonzero(near)
    return pa.table({"word": pa.array([words[i] for i in some], pa.string()), "n_near": near[some], "best_n": pa.array(n[best[some]], pa.int64()), "best": pa.array([words[i] for i in best[some]], pa.string())})


def near_words(words: DataFrame, box: int = BOX, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, best_n, best of the words of a written table words(word, n) that have near ones.

    sample bounds the words, drawn by a hash, from which planes are taken: they go to the driver and back. Boxes of
    words that no plane can part, as they have the same letters, stay whole.
    """
    total = words.count()
    share = min(1.0, sample / max(1, total))
    trees: dict[int, list | None] = {}
    if total > box:
        drawn: dict[int, list[str]] = {}
        for (w,) in words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").collect():  # about sample
            drawn.setdefault(len(w), []).append(w)
        trees = {k: planes(v, box * share) for k, v in drawn.items()}
    schema = pa.schema([("length", pa.int32()), ("cell", pa.int64()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def deal(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                rows = []
                for w, n in zip(*(c.to_pylist() for c in batch.slice(low, 8192).columns), strict=True):
                    k = len(w)
                    own = next(cells(w, trees.get(k), 0, 0))[0]
                    rows.append((k, own, 0, w, n))
                    # of two boxes of a length the lower asks the upper, so a pair meets once
                    rows += [(k, c, 1, w, n) for c in {c for c, _, _ in cells(w, trees.get(k), 1, 1)} if c > own]
                    rows += [(k + 1, c, 2, w, n) for c in {c for c, _, _ in cells(w, trees.get(k + 1), 1, 0)}]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    ship(words.sparkSession)
    dealt = words.select("word", "n").mapInArrow(deal, "length int, cell long, role int, word string, n long")
    return dealt.groupBy("length", "cell").applyInArrow(box_rows, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x")).select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.best").alias("best"))


def spelling_forms(docs: DataFrame, shortest: int = 5, least: int = 3, box: int = BOX, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text).

    A word is a maximal run of letters (a-z and U+00C0 to U+00FF, A-Z lower-cased), less one letter in one of 97 by a
    checksum of document and run, of shortest letters or more, that occurs least times or more in all texts, n. n_near
    counts the words one edit away. Its form is the one of largest n, the smaller in code-point order of ties, if that n
    is at least twice its own; root is reached by following forms, the word itself without any. Null texts have no
    words; runs of a null doc_id are summed with an empty one. Repeated rows count each. Other columns are ignored;
    empty input gives no rows.
    """
    words = written(word_counts(docs, shortest, least), "words")
    near = words.join(near_words(words, box, sample), "word", "left")
    takes = F.col("best_n") >= 2 * F.col("n")
    forms = written(near.select("word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    # n at least doubles with each form, so a chain ends; its followed part doubles each round
    step = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        over = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = written(step.join(over, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            break
        discard(step)
        step = new.drop("moved")
        step._written_at = new._written_at
    return forms.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
