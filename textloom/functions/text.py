"""Scalar text functions as Column expressions: no UDFs, so they stay in generated code and can be pushed around by Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import vocabulary as V

WORD = r"[a-z0-9_]{2,}"
BLANKS = r"[ \t\n\x0B\f\r]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def split_words(c: Column | str) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(col(c), BLANKS), lambda w: w != "")


def words(c: Column | str, pattern: str = WORD) -> Column:
    """All matches of a pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(pattern), 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stem(c: Column | str) -> Column:
    """The first suffix rule that leaves enough of the word; keeps case, protects known terms."""
    word, low = col(c), F.lower(col(c))
    out = F.when(low.isin(V.PROTECTED_TERMS), word)
    for suffix, replacement, least in V.SUFFIX_RULES:
        cut = F.length(word) - len(suffix)
        out = out.when(low.endswith(suffix) & (cut + len(replacement) >= least), F.concat(F.substring(word, F.lit(1), cut), F.lit(replacement)))
    return out.otherwise(word)


def canonical(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(col(c))), r"[\s-]+", "_"), r"[^\w]", "")


def aliases(c: Column | str) -> Column:
    """The term in lower case, and joined by other signs than its own."""
    low = strip(F.lower(col(c)))
    swap = lambda a, b: F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b)))
    found = F.array(low, swap(" ", "-"), swap(" ", "_"), swap(" ", ""), swap("-", " "), swap("-", "_"), swap("_", " "), swap("_", "-"))
    return F.array_distinct(F.array_compact(found))


def simple_terms(c: Column | str) -> Column:
    """Words of three or more characters without stopwords, first ones kept."""
    return F.array_distinct(F.filter(split_words(F.lower(col(c))), lambda w: (F.length(w) > 2) & ~w.isin(V.SIMPLE_STOPWORDS)))


def ngrams(tokens: Column | str, n: int, glue: str = " ") -> Column:
    """Runs of n tokens, joined. The shifted arrays are arguments, so they are made once and not once a run."""
    t = col(tokens)
    if n == 1:
        return t
    count = F.greatest(F.size(t) - n + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(t, k + 1, count).alias(f"w{k}") for k in range(n)])
    return F.transform(shifted, lambda z: F.concat_ws(glue, *[z[f"w{k}"] for k in range(n)]))


def candidates(c: Column | str, stopwords: list[str]) -> Column:
    """Words, pairs and triples of words that are no stopwords, in this order, without regard to case once each."""
    found = F.filter(F.regexp_extract_all(col(c), F.lit(r"\b[a-zA-Z][a-zA-Z0-9_-]*\b"), 0), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(stopwords))
    return keep_first(F.concat(found, ngrams(found, 2), ngrams(found, 3)))


def keep_first(items: Column | str) -> Column:
    """Of items that are equal but for case, the first; in order. Sorted by (lower case, place), equal neighbours go, and the places bring the order back."""
    numbered = F.array_sort(F.transform(col(items), lambda w, i: F.struct(F.lower(w).alias("l"), i.alias("i"), w.alias("w"))))
    before = F.concat(F.array(F.lit(None).cast("struct<l:string,i:int,w:string>")), F.slice(numbered, 1, F.greatest(F.size(numbered) - 1, F.lit(0))))
    pairs = F.filter(F.arrays_zip(numbered.alias("a"), before.alias("b")), lambda z: z["a"].isNotNull() & (z["b"].isNull() | (z["a"]["l"] != z["b"]["l"])))
    return F.transform(F.array_sort(F.transform(pairs, lambda z: F.struct(z["a"]["i"].alias("i"), z["a"]["w"].alias("w")))), lambda x: x["w"])


def delimited_terms(c: Column | str, stopwords: list[str]) -> Column:
    """Parts at the first delimiter present of , ; newline | bullet - :, or else words of three or more characters."""
    text = col(c)
    keep = lambda a: F.filter(F.transform(a, strip), lambda p: (F.length(p) > 1) & ~F.lower(p).isin(stopwords))
    out = None
    for sign, pattern in ((",", ","), (";", ";"), ("\n", "\n"), ("|", r"\|"), ("•", "•"), ("-", "-"), (":", ":")):
        part = keep(F.split(text, pattern))
        out = F.when(F.contains(text, F.lit(sign)), part) if out is None else out.when(F.contains(text, F.lit(sign)), part)
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z][a-zA-Z0-9_-]*\b"), 0), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stopwords))
    return out.otherwise(bare)


def without_thoughts(c: Column | str) -> Column:
    """Model output without its <think> blocks, closed or not."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?s)<think>.*?</think>\s*", ""), r"(?s)<think>.*$", ""))


def box_density(c: Column | str) -> Column:
    """Share of box-drawing characters in a line; 0 for an empty one."""
    line = col(c)
    return F.when(F.length(line) > 0, 1 - F.length(F.translate(line, V.BOX_CHARACTERS, "")) / F.length(line)).otherwise(0.0)


def is_technical(c: Column | str) -> Column:
    return any_of([F.contains(F.lower(col(c)), F.lit(p)) for p in V.TECHNICAL_PARTS])


def is_code_query(c: Column | str, keywords: list[str]) -> Column:
    low = F.lower(col(c))
    return F.arrays_overlap(split_words(low), F.array(*[F.lit(k) for k in keywords])) | any_of([F.contains(low, F.lit(p)) for p in V.CODE_PARTS])


def title_domain(c: Column | str) -> Column:
    out = None
    for domain, keys in V.TITLE_DOMAINS.items():
        hit = any_of([F.contains(F.lower(col(c)), F.lit(k)) for k in keys])
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("general")


def cache_key(texts: Column | str) -> Column:
    return F.md5(F.array_join(col(texts), "||"))


def fenced_json(c: Column | str) -> Column:
    """What stands in the first json fence, else in the first fence, else the text itself."""
    json = F.regexp_extract(col(c), r"(?s)```json\s*(.*?)```", 1)
    bare = F.regexp_extract(col(c), r"(?s)```\s*(.*?)```", 1)
    return strip(F.coalesce(F.nullif(json, F.lit("")), F.nullif(bare, F.lit("")), col(c)))


def prompt(title: Column | str, text: Column | str, most: int = 8000) -> Column:
    return F.format_string("Title: %s\nText: %s", col(title), F.substring(col(text), 1, most))


def index_entry(line: Column | str) -> Column:
    """(term, pages) of a line of a book index, null if it is none: the first of four patterns whose term has letters; page ranges are expanded, footnote marks dropped."""
    s = strip(line)
    out = None
    for pattern in V.INDEX_LINES:
        term, pages = strip(F.regexp_extract(s, pattern, 1)), strip(F.regexp_extract(s, pattern, 2))
        ok = s.rlike(pattern) & term.rlike("[a-zA-Z]{2,}")
        found = F.struct(term.alias("term"), pages.alias("pages"))
        out = F.when(ok, found) if out is None else out.when(ok, found)
    skip = (F.length(s) <= 2) | s.rlike(r"^\d+$") | s.isin("Index", "Symbols", "Glossary")
    hit = F.when(~skip, out)
    name = F.regexp_replace(F.regexp_replace(hit["term"], r"\s+", " "), r"^[•\-*]\s*", "")
    parts = F.filter(F.split(F.regexp_replace(hit["pages"], r"n(?=\s|,|$)", ""), r"[,\s]+"), lambda p: p != "")

    def pages_of(p: Column) -> Column:
        ends = F.split(p, "[-–]")
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        whole = a.rlike(r"^\d{1,9}$") & b.rlike(r"^\d{1,9}$") & (F.size(ends) == 2)
        low, high = F.when(whole, a).cast("int"), F.when(whole, b).cast("int")
        ranged = F.when(whole & (high > low) & (high - low < 100), F.sequence(low, F.when(high > low, high).otherwise(low))).otherwise(F.array().cast("array<int>"))
        single = F.when(p.rlike(r"^\d{1,9}$"), F.array(F.when(p.rlike(r"^\d{1,9}$"), p).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(p.rlike("[-–]"), ranged).otherwise(single)

    numbers = F.flatten(F.transform(parts, pages_of))
    good = (F.length(name) >= 3) & (F.length(name) <= 80) & ~F.lower(name).isin("see", "see also", "also", "versus") & (F.size(numbers) > 0)
    return F.when(good, F.struct(name.alias("term"), numbers.alias("pages")))
