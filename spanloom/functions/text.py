"""Text columns: normalization, tokens, trigram similarity, query classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a question about structure.
STRUCTURE_PHRASES = ("section structure", "document outline", "table of contents", "chapter hierarchy")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each token, with two blanks before and one after it."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 where both have none."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(x) + F.size(y) - both), F.lit(0.0))


def match_score(text: Column, query: str) -> Column:
    """1 where the query stands in the text (its % and _ are wildcards), else the similarity."""
    return F.greatest(F.when(text.ilike(f"%{query}%"), 1.0).otherwise(0.0), trigram_similarity(text, F.lit(query)))


def term_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct tokens, times 1.2 where more than one is shared, 1 at most."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.size(F.array_intersect(x, y))
    plain = F.coalesce(F.try_divide(shared.cast("double"), F.size(x) + F.size(y) - shared), F.lit(0.0))
    return F.least(F.lit(1.0), F.when(shared > 1, plain * 1.2).otherwise(plain))


def query_kind(column: Column) -> Column:
    """keyword, vector or tree: the first rule that fits decides; an empty query is vector."""
    clean = F.regexp_replace(F.coalesce(column, F.lit("")), r"\A\s+|\s+\z", "")
    words = F.size(F.filter(F.split(clean, r"\s+"), lambda w: w != ""))
    return (
        F.when(clean == "", "vector")
        .when(F.lower(clean).rlike("|".join(STRUCTURE_PHRASES)), "tree")
        .when(words >= 6, "vector")
        .when((words <= 1) & clean.rlike(r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}].*){6}"), "vector")
        .when(clean.rlike(r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}-\x{2089}]"), "keyword")
        .when(clean.rlike(r"[-/_.]"), "keyword")
        .when(F.length(clean) <= 16, "keyword")
        .otherwise("vector")
    )


def keyword_list(text: Column) -> Column:
    """Parts between commas and semicolons (also full-width), trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;，；]"), lambda t: F.trim(t)), lambda t: t != "")


def keywords(text: Column, stop_words: tuple[str, ...] = (), longest: int = 4096) -> Column:
    """Tokens of two letters or more that are no stop words, first ones first, each once."""
    found = F.filter(tokens(F.substr(F.coalesce(text, F.lit("")), F.lit(1), F.lit(longest))), lambda t: F.length(t) >= 2)
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(*stop_words))
    return F.array_distinct(found)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def page_list(text: Column) -> Column:
    """'5-7,12' as sorted distinct numbers; a reversed range raises."""

    def of(part: Column) -> Column:
        ends = F.split(part, "-")
        low, high = (F.trim(F.element_at(ends, i)).cast("int") for i in (1, -1))
        return F.when(low > high, F.raise_error(F.concat(F.lit("reversed page range: "), part)).cast("array<int>")).otherwise(F.sequence(low, high))

    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, of))))


def heading_parts(path: Column) -> Column:
    """Parts of a heading path: by ' > ', else '>', else '/'; trimmed, none empty."""
    split = F.when(path.contains(" > "), F.split(path, " > ")).when(path.contains(">"), F.split(path, ">")).otherwise(F.split(path, "/"))
    return F.filter(F.transform(split, lambda p: F.trim(p)), lambda p: p != "")


def prefixes(path: Column, separator: str = " > ") -> Column:
    """All ancestors of a path from the root down, itself last."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def clipped(text: Column, longest: int = 1600) -> Column:
    """Collapsed white space, cut with an ellipsis beyond `longest` letters."""
    clean = collapsed(text)
    return F.when(F.length(clean) > longest, F.concat(F.substr(clean, F.lit(1), F.lit(longest - 1)), F.lit("…"))).otherwise(clean)


def json_verdict(text: Column, schema: str) -> Column:
    """A JSON object from free text: the whole, else a fenced block, else the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.trim(c).startswith("{") & F.get_json_object(F.trim(c), "$").isNotNull(), F.from_json(F.trim(c), schema))
    return F.coalesce(good(text), good(fenced), good(braces))
