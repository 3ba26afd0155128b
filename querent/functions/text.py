"""Analyzers and text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default stop list of the n-gram analyzer; any other list can be passed.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most "
    "my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
WORD = r"([\p{L}\p{N}_]{2,})"


def plain_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def words(text: Column, stop: tuple | list = STOP_WORDS) -> Column:
    """Words of two or more letters, digits or _ that are no stop words."""
    return F.filter(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1), F.array().cast("array<string>")), lambda w: ~w.isin(list(stop)))


def ngrams(text: Column, stop: tuple | list = STOP_WORDS) -> Column:
    """The same words, and pairs of neighbours among them."""
    return F.transform(F.array(words(text, stop)), lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))[0]


def strip(c: Column) -> Column:
    """Null to empty, white space of both ends off."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def filled(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def year(c: Column) -> Column:
    """A whole year from text such as 2019 or 2019.0; null for anything else."""
    return c.cast("string").try_cast("double").try_cast("int")


def media_type(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("movie", "film"), "film").when(t.isin("tv show", "tv", "series", "television"), "tv").otherwise("unknown")


def shorten(c: Column, limit: int = 280) -> Column:
    """White space squeezed; longer texts end at the last space before the limit, with an ellipsis."""
    t = squeeze(c)
    cut = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…")))


def preview(c: Column, limit: int = 80) -> Column:
    return F.replace(F.substring(c, 1, limit), F.lit("\n"), F.lit(" "))


def meta_line(*parts: Column) -> Column:
    """Parts joined by a middle dot; blank ones and the text nan are skipped."""
    return F.concat_ws(" · ", *[F.when(F.lower(strip(p)) != "nan", filled(p)) for p in parts])


def truncate(c: Column, limit: int = 4000) -> Column:
    """At most limit characters: cut after the last sentence end in the second half (of '. ', '.\\n', '? ', '! ' the
    first kind that has one), else at the last space, with an ellipsis."""
    t = strip(c)
    head = F.substring(t, 1, limit)
    last = lambda sep: F.when(F.contains(head, F.lit(sep)), F.length(head) - F.length(F.substring_index(head, sep, -1)) - len(sep))
    out = None
    for sep in (". ", ".\n", "? ", "! "):
        at, piece = last(sep), None
        piece = strip(F.substring(head, F.lit(1), at.cast("int") + 1))
        out = F.when(at >= limit // 2, piece) if out is None else out.when(at >= limit // 2, piece)
    tail = F.concat(strip(F.regexp_replace(head, r"(?s) [^ ]*$", "")), F.lit("…"))
    return F.when(F.lit(limit <= 0) | (F.length(t) <= limit), t).otherwise(out.otherwise(tail))


def page_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """Percent-encoded, spaces as underscores, slashes kept."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.concat(F.lit(base), F.replace(coded, F.lit("*"), F.lit("%2A")))


def _tagged(c: Column) -> Column:
    """HTML of a text whose words are marked with control characters. Markup characters are escaped in the same pass
    order that keeps entity names apart: words are marked first, and the control characters become tags last."""
    out = c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("<mark>")), F.lit("\u0002"), F.lit("</mark>"))


_MARK = "\u0001$1\u0002"
_BEFORE, _AFTER = r"(?iu)(?<![\p{L}\p{N}_])(", r")(?![\p{L}\p{N}_])"


def highlight(c: Column, tokens: list[str]) -> Column:
    """HTML with whole words of tokens marked."""
    words = sorted({t.lower() for t in tokens if len(t) >= 2 and t.isalnum()}, key=lambda t: (-len(t), t))
    return _tagged(F.regexp_replace(c, f"{_BEFORE}{'|'.join(words)}{_AFTER}", _MARK) if words else c)


def highlight_query(c: Column, query: Column) -> Column:
    """HTML with the whole words of each row's own query marked: two characters or more, letters and digits only, the
    longest first."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) >= 2) & w.rlike(r"^[\p{L}\p{N}]+$")))
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    alternatives = F.when(F.size(longest) > 0, F.array_join(longest, "|")).otherwise(F.lit("(?!)"))
    return _tagged(F.regexp_replace(c, F.concat(F.lit(_BEFORE), alternatives, F.lit(_AFTER)), F.lit(_MARK)))


def score_text(score: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", score)
