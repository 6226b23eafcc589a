"""Column functions on text, each with its twin in DuckDB's SQL where one is needed for checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, for RE2, which has no flag for it.
WHITE = r"\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)^\s+|\s+$", "")


def strip_sql(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def display_name(name: Column) -> Column:
    """A scheme's name without its plan."""
    return strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i) - Direct (Plan )?Growth$", ""))


def display_name_sql(name: str) -> str:
    return strip_sql(f"regexp_replace(coalesce({name}, ''), '(?i) - Direct (Plan )?Growth$', '')")


def entity_key(name: Column) -> Column:
    """Words of a name in lower case with one blank between them; what is compared when entities are looked for."""
    return F.trim(F.regexp_replace(F.lower(display_name(name)), r"[^\p{L}\p{M}\p{Nd}]+", " "))


def entity_key_sql(name: str) -> str:
    return f"trim(regexp_replace(lower({display_name_sql(name)}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', ' ', 'g'))"


#: Lines, in lower case, that belong to a page's interface and not to its content.
CHROME = (
    "skip to main content", "skip to content", "main content", "compare", "education", "view details", "read more", "read more less", "load more",
    "more details are loading", "calculators", "watch", "learn", "search", "home", "next", "previous", "back", "menu", "all", "apply", "reset", "clear",
    "invest now", "know more", "view all", "show more", "i am ready to invest", "get started", "mr.", "ms.", "mrs.", "dr.", "disclaimer", "terms of use",
    "privacy notice", "contact us", "about amfi", "important updates",
)


def clean_lines(text: Column) -> Column:
    """One blank for runs of blanks, lines stripped, blank lines and lines of the interface dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    stripped = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t\u00A0]+", " ")))
    return F.array_join(F.filter(stripped, lambda x: (x != "") & ~F.lower(x).isin(*CHROME)), "\n")


def clean_lines_sql(text: str) -> str:
    line = strip_sql("regexp_replace(x, '[ \\t\\x{00A0}]+', ' ', 'g')")
    return f"array_to_string([y FOR y IN [{line} FOR x IN str_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10))] IF y <> '' AND lower(y) NOT IN ({', '.join(repr(c) for c in CHROME)})], chr(10))"


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{Nd}]+)"))


def word_runs(text: Column, longest: int) -> Column:
    """Every run of at most ``longest`` neighbouring words, joined by blanks."""
    w = words(text)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))


def pack(pieces: Column, cap: Column | int, glue: str) -> Column:
    """Pieces put together greedily, joined by ``glue``, each result at most ``cap`` long; a longer piece stays whole."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["open"]) + len(glue) + F.length(x) <= cap
        return F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open"))).when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit(glue), x).alias("open"))).otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), x.alias("open")))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def pack_sql(pieces: str, cap: str, glue: str) -> str:
    """pack as a fold: results are joined by chr(30), the last is open."""
    last = "list_last(str_split(s, chr(30)))"
    return f"CASE WHEN len({pieces}) = 0 THEN '' ELSE list_reduce({pieces}, lambda s, x: CASE WHEN length({last}) + {len(glue)} + length(x) <= {cap} THEN s || '{glue}' || x ELSE s || chr(30) || x END) END"


#: A sentence ends after its mark where white space and a capital, a digit or an opening mark follow.
SENTENCE_GAP = r"(?<=[.?!])\s+(?=[A-Z0-9(\"'“])"


def sentences(text: Column) -> Column:
    """Sentences by punctuation alone, for packing."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), strip), lambda x: x != "")


def overlap_tail(text: Column, size: int = 80) -> Column:
    """The last ``size`` characters, from the last beginning of a sentence in them, else from the first blank; empty for short texts."""
    window = F.right(text, F.lit(size))
    parts = F.filter(F.split(window, SENTENCE_GAP), lambda x: strip(x) != "")
    word = F.regexp_replace(window, r"^\S*\s", "")
    return F.when(F.length(text) <= size, "").when(F.size(parts) > 1, strip(F.element_at(parts, -1))).otherwise(strip(F.when(window.rlike(r"\s"), word).otherwise(window)))
