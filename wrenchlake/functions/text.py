"""Column functions over service text: tokens, page references, charts, brands, status, chunks and file names.

All of them are built-in expressions; nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CHART_CUES, DEFAULT, INTENTS, Lexicon

PAGE_REF = r"(?i)page\s*0*(\d+)"
CHUNK, OVERLAP = 900, 120
#: The characters that count as white space.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Whether there is white space alone.  Looks no further than the first other character, where ``strip`` reads to the end."""
    return F.ltrim(c, F.lit(WHITE)) == ""


def words_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(c: Column, values) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(v)) for v in values], F.lit(False))


def tokenize(c: Column) -> Column:
    """Runs of ASCII letters and digits longer than two, lower-cased, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)


def page_refs(c: Column) -> Column:
    """Distinct numbers after the word "page"."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(PAGE_REF), F.lit(1)), lambda p: p.try_cast("int")))


def is_index_chart(c: Column) -> Column:
    """Whether a page's text is a symptom index: it names sections and pages, or symptom and cause, or refers to many pages."""
    return is_index_text(F.lower(text(c)))


def is_index_text(t: Column) -> Column:
    """``is_index_chart`` of a lower-cased text, which it names many times: best a column of its own.

    All that makes a chart says "page", so a text without it costs one search.  (As a branch: Spark would else count references of each text, as an expression that occurs twice.)"""
    hits = F.regexp_count(t, F.lit(PAGE_REF))
    found = any_of(t, ("section & page", "section and page"))
    found = found | (F.contains(t, F.lit("symptom")) & F.contains(t, F.lit("cause")) & (hits >= 2))
    many = any_of(t, CHART_CUES) & (hits >= 4)
    return F.when(F.contains(t, F.lit("page")), (F.length(t) >= 80) & (found | many)).otherwise(False)


def named_brands(*cols: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Brands that occur anywhere in the texts, in the lexicon's order."""
    return brands_in(F.lower(F.concat_ws(" ", *[text(c) for c in cols])), lexicon)


def brands_in(blob: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``named_brands`` of a lower-cased text."""
    found = F.filter(words_array(lexicon.brands), lambda b: F.contains(blob, b))
    return F.filter(found, lambda b: (b != lexicon.short_brand) | any_of(blob, lexicon.short_brand_needs))


def plain_tokens(value: str) -> list[str]:
    import re

    return [t for t in re.findall("[a-z0-9]+", value.lower()) if len(t) > 2]


def expand_terms(model: Column, symptom: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Distinct query terms: tokens of model and symptom, of every topic that the symptom touches, and the core terms."""
    low = F.lower(text(symptom))
    none = F.array().cast("array<string>")
    own = F.array_distinct(tokenize(F.concat_ws(" ", text(model), text(symptom))))
    topics = [F.when(any_of(low, ts), words_array(ts)).otherwise(none) for ts in map(plain_tokens, lexicon.topics) if ts]
    core = F.when(any_of(low, lexicon.core_triggers), words_array(lexicon.core_terms)).otherwise(none)
    return F.array_distinct(F.flatten(F.array(own, *topics, core)))


def symptom_intents(symptom: Column) -> Column:
    """What the symptom asks about, as flags."""
    t = F.lower(text(symptom))
    flags = {k: any_of(t, v) for k, v in INTENTS.items()}
    both = (flags["gas"] & flags["ac"]) | (F.contains(t, F.lit("gas")) & F.contains(t, F.lit("electric"))) | any_of(t, ("neither", "all mode"))
    return F.struct(*[v.alias(k) for k, v in flags.items()], both.alias("both_modes"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_position(backward: Column, markers) -> Column:
    """Place of the last occurrence of any marker (from 0), or -1, in a text given backwards."""
    at = lambda m: F.length(backward) - (F.locate(m[::-1], backward) - 1) - len(m)
    return F.greatest(*[F.when(F.contains(backward, F.lit(m[::-1])), at(m)).otherwise(-1) for m in markers], F.lit(-1))


def is_open_status(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether the latest status wording says that work is still open."""

    def last(backward: Column) -> Column:
        return F.struct(last_position(backward, lexicon.open_markers).alias("left"), last_position(backward, lexicon.done_markers).alias("done"))

    at = bound(F.reverse(F.lower(text(c))), last)
    return bound(at, lambda x: (x["done"] <= x["left"]) & (x["left"] >= 0))


def chunk_texts(c: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a page's text; a short page is one chunk as it is, longer ones give stripped, non-blank windows."""
    step = size - overlap
    last = F.ceil((F.length(c) - size) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: strip(F.substring(c, k * step + 1, F.lit(size))))
    short = (F.octet_length(c) <= size) | (F.length(c) <= size)  # characters of few bytes need no count
    return F.when(short, F.array(c)).otherwise(F.filter(cut, lambda x: x != ""))


def guess_title(key: Column) -> Column:
    """A title from a storage key: the file name without upload prefixes and extension."""
    name = F.element_at(F.split(key, "/"), -1)
    name = F.regexp_replace(name, r"^\d+_\d+_", "")
    name = F.regexp_replace(name, r"(?i)^[a-f0-9]{8,}_", "")
    name = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(name, "[_-]", " ")), F.lit("")), key)


def chat_title(message: Column, default: str = "Guided Diagnostics", length: int = 80) -> Column:
    raw = F.when(text(message) == "", F.lit(default)).otherwise(text(message))
    return F.coalesce(F.nullif(F.left(F.replace(strip(raw), F.lit("\n"), F.lit(" ")), F.lit(length)), F.lit("")), F.lit(default))


def upload_type(name: Column) -> Column:
    """Lower-cased text after the last dot (the whole name without a dot); pdf if that is empty."""
    return F.coalesce(F.nullif(F.lower(F.element_at(F.split(name, r"\."), -1)), F.lit("")), F.lit("pdf"))


def relinked_type(key: Column) -> Column:
    return F.when(F.lower(key).endswith(".pdf"), "pdf").otherwise("bin")


def route_of(key: Column) -> Column:
    """The registry that a storage key belongs to."""
    return F.when(key.startswith("documents/"), "manual").when(key.startswith("certificates/"), "certificate").when(key.startswith("safety/"), "safety").otherwise("unknown")


def storage_key(folder: Column, owner: Column, at: Column, name: Column) -> Column:
    """folder/owner_stamp_name; without an owner, as for safety files, folder/stamp_name."""
    return F.concat(folder, F.lit("/"), F.concat_ws("_", owner.cast("string"), F.date_format(at, "yyyyMMddHHmmss"), name))


def search_matches(needle: Column, *fields: Column) -> Column:
    """Every white-space separated term of the needle occurs in the fields; a blank needle matches all."""
    hay = F.lower(F.concat_ws(" ", *[text(f) for f in fields]))
    terms = F.filter(F.split(F.lower(text(needle)), r"(?U)\s+"), lambda t: t != "")
    return F.forall(terms, lambda t: F.contains(hay, t))
