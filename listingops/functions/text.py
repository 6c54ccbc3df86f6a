"""Text rules of listings as columns. Regular expressions use (?U) where words and letters are not only ASCII."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from listingops.functions.numbers import ean_valid
from listingops.sources import dims

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"(?i)(https?://|www\.)\S+"
ALLOWED = r".,;:!¿?¡'\"()€%/&\-\n\r\t"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def decomposed(text: str) -> str:
    """Text without any combining mark (NFKD)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@functools.cache
def accent_table() -> tuple[str, str]:
    """(characters, what each becomes) of all that lose their marks as one character; those beyond the second vanish."""
    becomes = {c: decomposed(c) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0100, 0xE01F0)))}
    single = {c: d for c, d in becomes.items() if len(d) == 1 and d != c}
    return "".join([*single, *(c for c, d in becomes.items() if not d)]), "".join(single.values())


def plain(x: Column) -> Column:
    """Text without accents and other combining marks, of any script, in the JVM.

    Equal to decomposed() but for characters that become several, such as ligatures, fractions and Hangul syllables,
    which stay; fold_accents takes those apart too.
    """
    return F.translate(x, *accent_table())


@F.pandas_udf(StringType())
def fold_accents(x: pd.Series) -> pd.Series:
    """decomposed() of every text, in Python."""
    return x.map(lambda t: None if t is None else decomposed(t))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matching ratio of two texts, case ignored; null where either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.strip().lower(), y.strip().lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def stem(token: Column) -> Column:
    """A token without its plural ending."""
    n = F.length(token)
    return F.when((n > 4) & token.endswith("es"), F.substring(token, F.lit(1), n - 2)).when((n > 3) & token.endswith("s"), F.substring(token, F.lit(1), n - 1)).otherwise(token)


def raw_tokens(x: Column) -> Column:
    return F.regexp_extract_all(plain(F.lower(F.coalesce(x, F.lit("")))), F.lit("([a-z0-9]+)"), 1)


def tokens(x: Column) -> Column:
    """Ranking tokens in order, repeats kept."""
    stop = F.array(*(F.lit(w) for w in dims.RANKING_STOP_WORDS))
    return F.filter(raw_tokens(x), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"\D+", "")


def is_ruler_text(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x, r"[^\p{Nd}]+", ""))
    return (digits >= dims.RULER_DIGITS) & (digits > dims.RULER_SHARE * F.length(x))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def is_long_block(x: Column) -> Column:
    return (F.size(words(x)) > dims.LONG_WORDS) | (F.length(x) > dims.LONG_CHARS)


def is_witness(x: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")) >= dims.WITNESS_CHARS, F.lit(False))


DISALLOWED = rf"([^\p{{L}}\p{{Nd}}\s{ALLOWED}])"


def disallowed(x: Column) -> Column:
    """Characters that a listing may not hold, each once, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(DISALLOWED), 0))


def excess_symbols(x: Column) -> Column:
    odd = F.length(F.regexp_replace(x, r"[\p{L}\p{Nd}\s]+", ""))
    return x.rlike(r"([^\p{L}\p{N}_\s])\1{3,}") | ((F.length(x) >= 20) & (odd > 0.15 * F.length(x)))


def excess_upper(x: Column) -> Column:
    letters, upper = F.length(F.regexp_replace(x, r"[^\p{L}]+", "")), F.length(F.regexp_replace(x, r"[^\p{Lu}]+", ""))
    return (letters >= 10) & (upper > 0.5 * letters)


def long_word(x: Column) -> Column:
    """The first word of more than 30 characters without its outer punctuation, or null."""
    long = F.filter(words(x), lambda w: F.length(w) > 30)  # few words are, so few are stripped
    bare = F.transform(long, lambda w: F.regexp_replace(w, r"^[.,;:!¿?¡'\"()]+|[.,;:!¿?¡'\"()]+$", ""))
    return F.get(F.filter(bare, lambda w: F.length(w) > 30), F.lit(0))


def brand_keys(brands: tuple[str, ...]) -> tuple[list[str], dict[str, list[str]]]:
    """(brands of one word, the other brands by their longest word): the dictionary in which a text's words are looked up."""
    split = {b: re.findall(r"\w+", b) for b in brands}
    several: dict[str, list[str]] = {}
    for b, own in sorted(split.items()):
        if own != [b]:
            several.setdefault(max(own, key=len), []).append(b)
    return sorted(b for b, own in split.items() if own == [b]), several


def other_brands(x: Column, brand: Column, brands: tuple[str, ...] = dims.BRANDS) -> Column:
    """Known brands that the text names as whole words, but for the selected one; sorted, null for a null text.

    The text's words are taken once and looked up by hash. A brand of several words, or with signs in it, is looked up
    by its longest word, and its whole spelling is sought only in texts that hold that word.
    """
    single, several = brand_keys(brands)
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    spelled = F.create_map(*(c for k, own in several.items() for c in (F.lit(k), texts(own)))) if several else None

    def named(low: Column, words_: Column) -> Column:
        found = F.array_intersect(words_, texts(single))
        if several:
            likely = F.flatten(F.transform(F.array_intersect(words_, texts(several)), lambda k: F.element_at(spelled, k)))
            found = F.concat(found, F.filter(likely, lambda b: F.regexp_like(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), b, F.lit(r"\E(?!\w)")))))
        return F.array_sort(found)

    low = F.lower(x)
    each = F.transform(F.array(F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(r"(?U)\w+"), 0).alias("words"))), lambda r: named(r["low"], r["words"]))
    return F.array_remove(F.get(each, F.lit(0)), F.lower(F.trim(F.coalesce(brand, F.lit("")))))


def content_codes(x: Column, brand: Column) -> Column:
    """The codes that a text breaks whatever its platform, in a fixed order."""
    rules = (
        ("CONTAINS_EMAIL", x.contains("@") & x.rlike(EMAIL)),  # the plain test spares most texts the pattern
        ("CONTAINS_LINK", (x.contains("://") | F.lower(x).contains("www.")) & x.rlike(LINK)),
        ("EXCESSIVE_SYMBOLS", excess_symbols(x)),
        ("EXCESSIVE_UPPERCASE", excess_upper(x)),
        ("LONG_WORDS", long_word(x).isNotNull()),
        ("MENTIONS_OTHER_BRAND", F.size(other_brands(x, brand)) > 0),
        ("UNALLOWED_SYMBOLS", x.rlike(DISALLOWED)),
    )
    return F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules)))


def with_length_codes(codes: Column, x: Column, least: Column, most: Column) -> Column:
    """codes with those of a text's length, in the alphabet's order."""
    n = F.length(x)
    return F.array_sort(F.concat(codes, F.array_compact(F.array(F.when(n > most, F.lit("TOO_LONG")), F.when(n < least, F.lit("TOO_SHORT"))))))


def violations(x: Column, least: Column, most: Column, brand: Column) -> Column:
    """The codes that a text breaks, in a fixed order."""
    return with_length_codes(content_codes(x, brand), x, least, most)


def has_token(text: Column, value: Column) -> Column:
    """Whether value stands in text as whole tokens; case and runs of white space ignored."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), squeeze(value), F.lit(r"\E(?!\w)"))
    return F.coalesce((squeeze(value) != "") & F.regexp_like(squeeze(text), pattern), F.lit(False))


def marker_value(text: Column, marker: str = dims.DEFECT_MARKER, most: int = dims.MARKER_DISTANCE) -> Column:
    """What follows the first word near marker with : or - glued to it, to the end; null where blank or absent."""
    heads = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)[:\-]"), 1)
    near = F.get(F.filter(heads, lambda w: F.levenshtein(F.upper(plain(w)), F.lit(marker), most) >= 0), F.lit(0))
    after = F.regexp_extract(text, r"(?s)^(.*)$", 1)
    at = F.regexp_instr(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), near, F.lit(r"\E[:\-]")))
    return F.when(near.isNotNull() & (at > 0), blank_to_null(F.substring(after, at + F.length(near) + 1, F.length(text))))


def ocr_shortcut(text: Column, score: Column) -> Column:
    """content and value that a clean OCR text gives without a model: a checked EAN, else a model code; null if none."""
    ean = F.regexp_extract(text, r"(?iU)EAN\w*\W*\*?(\d{8,14})\*?", 1)
    model = F.regexp_extract(text, r"(?iU)\bmodel\w*\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\-]{2,20})\b", 1)
    hit = F.when((ean != "") & ean_valid(ean), F.struct(F.lit("ean").alias("content"), ean.alias("value"))).when(model != "", F.struct(F.lit("modelo").alias("content"), model.alias("value")))
    return F.when(score >= dims.CLEAN_SCORE, hit)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once a row, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def garment(title: Column) -> Column:
    """The first listed garment that the title holds."""
    found = lambda t: F.coalesce(*(F.when(t.contains(g), F.lit(g)) for g in dims.GARMENTS))
    ascii_only = lambda low: F.octet_length(low) == F.length(low)  # noqa: E731  such texts have no accents to look up
    return once(F.lower(title), lambda low: once(F.when(ascii_only(low), low).otherwise(plain(low)), found))


def stamped(description: Column, reference: Column) -> Column:
    """The description with its reference number at the end, once; null and unnumbered ones stay."""
    stamp = F.concat(F.lit("Ref. "), reference.cast("string"))
    body = F.rtrim(description)
    done = F.when(body.endswith(stamp), body).when(F.trim(description) == "", stamp).otherwise(F.concat(body, F.lit("\n\n"), stamp))
    return F.when(description.isNull() | reference.isNull(), description).otherwise(done)


def shipping_class(text: Column) -> Column:
    holds = lambda t, ws: reduce(lambda a, b: a | b, (t.contains(w) for w in ws))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(holds(t, dims.HEAVY_WORDS), "pesado").when(holds(t, dims.LIGHT_WORDS), "ligero").otherwise("normal"))


def shipping_value(text: Column, platform: Column) -> Column:
    c = shipping_class(text)
    weight = F.when(c == "ligero", "2 kg").when(c == "normal", "5 kg").otherwise("10 kg")
    size = F.when(c == "ligero", "Pequeño").when(c == "normal", "Mediano").otherwise("Grande")
    return F.when(platform == "wallapop", weight).otherwise(size)


def significant_words(x: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in dims.DEFECT_STOP_WORDS))
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-záéíóúñü]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def mentions_defect(description: Column, defect: Column) -> Column:
    """Whether at least half of the defect's significant words stand in the description."""
    own = significant_words(defect)
    both = F.size(F.array_intersect(own, significant_words(description)))
    return (F.size(own) == 0) | (both >= F.greatest(F.lit(1), F.floor((F.size(own) + 1) / 2)))


def with_defect(description: Column, defect: Column) -> Column:
    d = blank_to_null(defect)
    return F.when(d.isNull() | mentions_defect(description, d), description).otherwise(F.concat(description, F.lit("\n\nDESPERFECTOS: "), d))


def led_by_type(title: Column, kind: Column, most: int = dims.TITLE_MAX) -> Column:
    """The title with the product type in front unless it is there; cut on whole words, the type survives."""
    k = blank_to_null(kind)
    norm = lambda c: F.trim(F.regexp_replace(plain(F.lower(c)), r"\s+", " "))
    head = F.get(F.split(norm(k), " "), F.lit(0))
    present = F.array_contains(F.split(norm(title), " "), head) | norm(title).contains(norm(k))
    prefix = F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, F.lit(2), F.length(k)))
    whole = F.trim(F.concat_ws(" ", prefix, title))

    def cut(text: Column) -> Column:  # whole words up to the limit
        kept = F.aggregate(F.split(text, " "), F.struct(F.lit("").alias("t"), F.lit(True).alias("go")), lambda acc, w: F.struct(
            F.when(acc["go"] & (F.length(acc["t"]) + F.length(w) + F.when(acc["t"] == "", 0).otherwise(1) <= most), F.when(acc["t"] == "", w).otherwise(F.concat(acc["t"], F.lit(" "), w))).otherwise(acc["t"]).alias("t"),
            (acc["go"] & (F.length(acc["t"]) + F.length(w) + F.when(acc["t"] == "", 0).otherwise(1) <= most)).alias("go")))
        return kept["t"]

    shorter = F.when(F.length(prefix) >= most, F.coalesce(F.nullif(cut(prefix), F.lit("")), F.substring(prefix, 1, most))).otherwise(cut(whole))
    return F.when(k.isNull() | present, title).when(F.length(whole) <= most, whole).otherwise(shorter)


def guarded(x: Column) -> Column:
    """Text that a spreadsheet would read as a formula, with a quote in front."""
    return F.when(x.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def slug_ok(x: Column) -> Column:
    return F.coalesce((F.trim(x) != "") & ~x.rlike(r"[/\\\x00]"), F.lit(False))


def compared(x: Column) -> Column:
    """Text as golden cells are compared: no accents, upper case, single blanks."""
    return F.trim(F.regexp_replace(F.upper(plain(x)), r"\s+", " "))


def stems_of(words_: tuple[str, ...]) -> tuple[str, ...]:
    """The stems of a word list, by the rules that stem() and raw_tokens() follow."""
    cut = lambda t: t[:-2] if len(t) > 4 and t.endswith("es") else t[:-1] if len(t) > 3 and t.endswith("s") else t
    return tuple(sorted({cut(decomposed(w.lower())) for w in words_}))


def names_child(x: Column) -> Column:
    own = F.transform(raw_tokens(x), stem)
    return F.arrays_overlap(own, F.array(*(F.lit(s) for s in stems_of(dims.CHILD_WORDS))))


def gender_of(token_array: Column) -> Column:
    """hombre or mujer where the tokens name one of them only."""
    own = F.transform(token_array, stem)
    man, woman = (F.arrays_overlap(own, F.array(*(F.lit(s) for s in stems_of(dims.GENDER_WORDS[g])))) for g in ("hombre", "mujer"))
    return F.when(man & ~woman, "hombre").when(woman & ~man, "mujer")
