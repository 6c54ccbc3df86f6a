"""SimHash links, token alignment and spelling variants against brute force on small data, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from listingops.llm import packing, simhash_join, spelling, token_alignment
from listingops.llm.queries import op11_simhash, op12_token_alignment, op13_spelling, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key long, word string, fingerprint long, n int, pair long, row_key long, component_id long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (5, "one two"), (None, "one two"), (6, "naïve ÉCOLE \U0001f600 x"), (7, "a ▁ b"), (8, "uno dos tres " * 40_000)]


def odd(spark):
    return spark.createDataFrame([(d, t, 1, "w", 2, 3, 4, 5, 6) for d, t in ODD], SCHEMA)


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# -- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_decoding_is_perfect():
    words = np.array(random.Random(1).sample(range(1 << 23), 3000), dtype=np.uint32)
    r = np.random.default_rng(2)
    for errors in range(4):
        flips = np.array([np.bitwise_or.reduce(1 << r.choice(23, errors, replace=False)) if errors else 0 for _ in range(4096)], dtype=np.uint32)
        data = np.arange(4096, dtype=np.uint32)
        rest = np.array([np.bitwise_xor.reduce(simhash_join.REMAINDERS[[11 + i for i in range(12) if d >> i & 1]]) if d else 0 for d in range(4096)], dtype=np.uint32)
        assert (simhash_join.codeword_index((data << np.uint32(11) | rest) ^ flips) == data).all()
    kinds = {len(set(row)) for row in simhash_join.fuzzy_indices(words).tolist()}
    assert kinds == {1, 6}


def test_fingerprints_two_bits_apart_share_a_key():
    r = random.Random(3)
    for _ in range(400):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2)))
        keys = [set(simhash_join.keys_of(np.array([v], dtype=np.uint64))[1].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("few", [64, 2])
def test_links_connect_what_brute_force_connects(spark, few):
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(150)}
    hub = r.getrandbits(64)
    for _ in range(150):  # a dense neighbourhood, and chains away from it
        values.add(hub ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(12):
            values.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), 2))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    classes = simhash_join.written(spark.createDataFrame([(v,) for v in values], "fingerprint long"), "classes")
    place = {v: i for i, v in enumerate(values)}
    got = [(place[x.a], place[x.b]) for x in simhash_join.links(classes, few).collect()]
    far = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    assert all(((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 2 for i, j in got)
    assert roots_of(len(values), got) == roots_of(len(values), far)


def test_simhash_query_equals_brute_force(spark):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = sorted((d, f"{f:016x}", ids[c]) for d, f, c in zip(ids, prints, roots_of(len(ids), near), strict=True))
    assert sorted(map(tuple, op11_simhash(spark, SF).collect())) == want


def test_long_texts_have_the_fingerprint_of_the_whole():
    r = random.Random(5)
    text = "".join(r.choice("abC \n\t") * r.randint(1, 3) for _ in range(3000)) + "x" * 500
    assert {simhash_join.fingerprint(text, 3, block) for block in (1, 7, 100, 1 << 20)} == {plain_fingerprint(text)}


def test_simhash_edges(spark):
    rows = simhash_join.near_fingerprints(odd(spark)).collect()
    assert sorted(((x.doc_id, x.fingerprint & ((1 << 64) - 1)) for x in rows), key=str) == sorted(((d, plain_fingerprint(t)) for d, t in ODD), key=str)
    assert {x.component_id for x in rows if x.doc_id in (1, 2, 3)} == {1} and {x.component_id for x in rows if x.doc_id in (5, None)} == {5}
    alone = spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string")
    assert [x.component_id for x in simhash_join.near_fingerprints(alone).collect()] == [None, None]
    assert simhash_join.near_fingerprints(odd(spark).limit(0)).count() == 0


# -- alignment -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    byte = packing._byte_characters()
    names = {i: k for k, i in t.get_vocab().items()}

    def a(text):
        ids = t.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte[c] for c in names[i]) for i in ids]

    def b(text):
        ids = p.encode(text)
        shown = [p.id_to_piece(i) for i in ids]
        return ids, [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in shown]

    return a, b


def plain_alignment(texts, tokenizers):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    groups_of = []
    for text in texts:
        groups = []
        (ia, ba), (ib, bb) = (f(text or "") for f in tokenizers)
        if text and b"".join(ba) == b"".join(bb) == b" " + text.encode():
            ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ba, bb)]
            low = (0, 0)
            for e in sorted(set(ends[0]) & set(ends[1])):
                high = tuple(side.index(e) + 1 for side in ends)
                groups.append((ia[low[0] : high[0]], ib[low[1] : high[1]]))
                low = high
        groups_of.append(groups)
    links_of = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in groups_of]
    count = Counter(pair for links in links_of for pair in links)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for groups, links in zip(groups_of, links_of, strict=True):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), links.total(), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), digest))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((x.doc_id, *found) for x, found in zip(docs, plain_alignment([x.text for x in docs], tokenizers), strict=True))
    assert sorted((x.doc_id, *(x[f] for f in FIELDS)) for x in op12_token_alignment(spark, SF).collect()) == want


@pytest.mark.parametrize("count_bytes", [64 << 20, 0])
def test_alignment_edges(spark, tokenizers, monkeypatch, count_bytes):
    more = [(9, "<|endoftext|> <s> <0x41> ▁"), (10, "=" * 3001 + " x"), (11, "日本語テキスト、 é́ \U0001f600"), (12, "  two  spaces "), (13, "\n\n\tx"), (12, "  two  spaces ")]
    rows = [(d, t) for d, t in ODD if d != 8] + more
    docs = spark.createDataFrame([(d, t, 1, "w", 2, 3, 4, 5, 6) for d, t in rows], SCHEMA)
    got = token_alignment.align(docs, vocabulary(), vocabulary("piece_bpe_32k.model"), count_bytes).collect()
    want = [(d, *found) for (d, _), found in zip(rows, plain_alignment([t for _, t in rows], tokenizers), strict=True)]
    assert sorted(((x.doc_id, *(x[f] for f in FIELDS)) for x in got), key=str) == sorted(want, key=str)
    assert token_alignment.align(docs.limit(0), vocabulary(), vocabulary("piece_bpe_32k.model"), count_bytes).count() == 0


def test_crossing_in_steps_counts_all_links(monkeypatch):
    r = np.random.default_rng(6)
    sizes = [r.integers(1, 90, 40), r.integers(1, 90, 40)]
    groups = [np.repeat(np.arange(40), s) for s in sizes]
    ids = [r.integers(0, 30, len(g)) for g in groups]
    doc_of = np.sort(r.integers(0, 7, 40))
    want = [Counter() for _ in range(9)]
    for g in range(40):
        want[doc_of[g]].update(int(x) << 32 | int(y) for x in ids[0][groups[0] == g] for y in ids[1][groups[1] == g])
    for step in (1, 100, 1 << 22):
        monkeypatch.setattr(token_alignment, "CROSSED", step)
        pairs, n, bounds = token_alignment.linked(groups[0], ids[0], groups[1], ids[1], 40, doc_of, 9)
        assert [dict(zip(pairs[x:y].tolist(), n[x:y].tolist(), strict=True)) for x, y in zip(bounds, bounds[1:], strict=False)] == [dict(w) for w in want]


def test_long_texts_get_the_ids_of_the_whole(monkeypatch):
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        p = token_alignment.Pieces(f.read())
    assert p.cuts
    r = random.Random(7)
    text = "".join(r.choice(["ab", " ", "  ", "Zeit", "\n", "é", "tion "]) for _ in range(2000))
    whole = p.model.encode(text)
    for block in (5, 64, 1000):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        assert p([text, "x", ""]) == [whole, p.model.encode("x"), []] and len(p.parts(text)) > 1


# -- spelling --------------------------------------------------------------------------------------------------------


def plain_forms(rows, shortest, least):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
    for (_, short), own in gaps.items():
        for w in own:
            near[w] |= own - {w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_forms(docs, 5, 3)
    assert len(want) > 1000 and sorted(map(tuple, op13_spelling(spark, SF).collect())) == want


def test_boxes_do_not_change_what_is_near(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeéz") for _ in range(r.randint(3, 8))) for _ in range(900)]
    words += [w[:i] + r.choice(["", "a", "x", "bc"]) + w[i + 1 :] for w in words[:300] for i in [r.randrange(len(w))]]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_forms(rows, 3, 2)
    for box, sample in ((1 << 14, 1 << 16), (60, 500), (8, 100)):
        assert sorted(map(tuple, spelling.spelling_forms(docs, 3, 2, box, sample).collect())) == want


def test_search_finds_what_brute_force_finds(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 4)
    r = random.Random(9)
    for n, alphabet in ((300, "ab"), (300, "abcdefgh"), (1, "a"), (40, "a")):
        points = ["".join(r.choice(alphabet) for _ in range(6)) for _ in range(n)]
        for asked in (["".join(r.choice(alphabet) for _ in range(k)) for _ in range(200)] for k in (5, 6)):
            got = sorted((int(q), int(p)) for qs, ps in spelling.near_pairs(points, asked) for q, p in zip(qs, ps, strict=True))

            def near(a, b):
                return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

            assert got == [(q, p) for q, a in enumerate(asked) for p, b in enumerate(points) if near(a, b)]


def test_spelling_edges(spark, monkeypatch):
    rows = ODD + [(20, "ab" * 70 + " " + "ab" * 70 + "c")] * 3 + [(None, "colour Colour COLOUR ÉCOLES éCOLES color color_color")] * 2
    docs = spark.createDataFrame([(d, t, 1, "w", 2, 3, 4, 5, 6) for d, t in rows], SCHEMA)
    want = plain_forms(rows, 5, 2)
    assert any(w == "colour" and f is None and m >= 1 for w, f, _, _, m, _ in want)
    for block in (3, 1 << 20):
        monkeypatch.setattr(spelling, "BLOCK", block)
        assert [x for part in spelling.runs_of("Ab cd-Éf ghij") for x in part] == ["ab", "cd", "Éf", "ghij"]
    assert sorted(map(tuple, spelling.spelling_forms(docs, 5, 2).collect())) == want
    assert spelling.spelling_forms(docs.limit(0)).count() == 0
