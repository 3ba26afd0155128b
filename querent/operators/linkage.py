"""Linking catalog rows to encyclopedia pages by title, kind and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.functions.text import page_url, squeeze, truncate

#: The forms of titles by kind of work, with and without a year; and what a description says of a series.
FORMS = {"film": ("film",), "tv": ("TV series", "television series", "miniseries")}
UNDATED = {"film": ("film",), "tv": ("TV series", "television series", "miniseries", "TV program")}
TV_WORDS = ("television series", "tv series", "miniseries", "web series", "television program", "tv program", "television show", "sitcom")


def title_variants(title: Column, year: Column, media: Column) -> Column:
    """Titles to look up, the most specific first, the bare one last; none for a blank title; case-blind duplicates go."""
    base = squeeze(title)

    def of(kind: str) -> Column:
        dated = F.array(*[F.concat(base, F.lit(" ("), year.cast("string"), F.lit(f" {form})")) for form in FORMS[kind]])
        rest = F.array(*[F.concat(base, F.lit(f" ({form})")) for form in UNDATED[kind]], base)
        return F.when(year.isNotNull() & (year != 0), F.concat(dated, rest)).otherwise(rest)

    found = F.when(base == "", F.array().cast("array<string>")).when(media == "film", of("film")).when(media == "tv", of("tv")).otherwise(F.array(base))
    first = lambda v, i: F.size(F.filter(F.slice(found, F.lit(1), i), lambda w: F.lower(w) == F.lower(v))) == 0
    return F.filter(found, first)


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\s*([^)]*)\)\s*$", 1), F.lit("")).cast("int")


def title_kind(title: Column) -> Column:
    """What a title's closing brackets say it is: film, tv or nothing (null)."""
    low = F.lower(title)
    inside = F.lower(F.regexp_extract(title, r"\((\d{4})\s*([^)]*)\)\s*$", 2))
    dated = F.when(inside.rlike("film|movie"), "film").when(inside.rlike("tv|television|miniseries|series"), "tv")
    bare = F.when(F.contains(low, F.lit("film")) & low.rlike(r"\)\s*$"), "film").when(low.rlike("tv series|television series|miniseries|tv program"), "tv")
    return F.when(title_year(title).isNotNull(), dated).otherwise(bare)


def described_years(text: Column) -> Column:
    """Years 1900 to 2099 in a description, each once; a range counts by its ends."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int")))


def described_kind(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("|".join(TV_WORDS)), "tv").when(low.rlike("film|movie"), "film")


def year_fits(year: Column, years: Column, within: int = 1) -> Column:
    return year.isNull() | F.exists(years, lambda y: F.abs(y - year) <= within)


#: The endings of a looked-up title that say its kind.
ASKED_ENDS = {"film": ("(film)",), "tv": ("(tv)", "(TV series)", "(television series)", "(miniseries)", "(TV program)")}


def score(title: Column, year: Column, media: Column, page: Column, asked: Column) -> Column:
    """(confidence, reason) of a page for a catalog row. page: struct of title, description, missing, disambiguation;
    asked: the title it was looked up by. Conditions are tried in order and the first that holds decides. The reasons are fixed values. A row
    without a year agrees with any; a page without years agrees with no year."""
    p_title, said = page["title"], page["description"]
    own_kind, said_kind = title_kind(p_title), described_kind(said)
    kind = F.coalesce(own_kind, said_kind)
    t_year, said_years = title_year(p_title), described_years(said)
    years = F.concat(F.when(t_year.isNotNull(), F.array(t_year)).otherwise(F.array().cast("array<int>")), said_years)
    same, exact = F.coalesce(kind == media, F.lit(False)), lambda y: year.isNull() | (y == year)
    q_year = title_year(asked)
    whole = (F.size(years) == 0) | year_fits(year, years)
    ends = lambda k: F.exists(F.array(*map(F.lit, ASKED_ENDS[k])), lambda e: F.endswith(F.rtrim(asked), e))
    says_kind = F.coalesce(own_kind == media, F.lit(False)) | ((media == "film") & ends("film")) | ((media == "tv") & ends("tv"))
    film_title = kind.isNull() & (media == "film") & F.contains(F.lower(p_title), F.lit("film"))
    corroborated = same & year_fits(year, said_years)
    say = lambda c, r: F.struct(F.lit(c).alias("confidence"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    bare_base = F.lower(F.trim(F.regexp_replace(p_title, r"\(\d{4}\s*[^)]*\)\s*$", "")))
    return (
        F.when(page["missing"] | p_title.isNull() | (p_title == ""), say("none", "missing"))
        .when(page["disambiguation"], say("none", "disambiguation"))
        .when(media.isin("film", "tv") & kind.isNotNull() & (kind != media), say("none", F.concat(F.lit("type_mismatch:"), kind)))
        .when(q_year.isNotNull() & (title_kind(asked) == media) & exact(q_year) & (year.isNull() | whole), say("high", "year_qualified_title"))
        .when(t_year.isNotNull() & exact(t_year) & (same | film_title), say("high", "title_embeds_matching_year"))
        .when(corroborated & says_kind, say("medium", "type_title_plus_desc_year"))
        .when(corroborated & (bare_base == F.lower(squeeze(title))) & (said_kind == media), say("high", "bare_title_desc_corroborated"))
        .when(corroborated & (said_kind == media), say("medium", "desc_type_and_year"))
        .when(same & year.isNull(), say("low", "type_only_no_year"))
        .when(same & (F.size(years) == 0), say("low", "type_without_year_corroboration"))
        .when((F.size(years) > 0) & ~year_fits(year, years), say("none", "year_mismatch"))
        .otherwise(say("none", "insufficient_evidence"))
    )


def choose(scored: DataFrame) -> DataFrame:
    """scored: (show_id, page_title, confidence). One row a show_id: the only high page, else the only medium one if none
    is high, else ambiguous; not_found without either. A page found twice counts once, by its better confidence."""
    strong = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    pages = scored.groupBy("show_id", F.lower("page_title").alias("key")).agg(F.max(F.struct(strong.alias("s"), "page_title")).alias("best"))
    out = pages.groupBy("show_id").agg(
        F.count_if(F.col("best.s") == 2).alias("high"), F.count_if(F.col("best.s") == 1).alias("medium"),
        F.min(F.when(F.col("best.s") == 2, F.col("best.page_title"))).alias("h"), F.min(F.when(F.col("best.s") == 1, F.col("best.page_title"))).alias("m"),
    )
    status = F.when((F.col("high") == 1) | ((F.col("high") == 0) & (F.col("medium") == 1)), "matched").when(F.col("high") + F.col("medium") > 0, "ambiguous").otherwise("not_found")
    page = F.when(F.col("high") == 1, F.col("h")).when((F.col("high") == 0) & (F.col("medium") == 1), F.col("m"))
    return out.select("show_id", status.alias("status"), page.alias("page_title"), F.when(F.col("high") == 1, "high").when(page.isNotNull(), "medium").otherwise("none").alias("confidence"))


def attach_plot(status: Column, plot: Column, plot_title: Column) -> Column:
    """matched needs a plot: without one it is no_plot; other states stay."""
    return F.when((status == "matched") & (F.coalesce(plot, F.lit("")) == ""), "no_plot").otherwise(status)


def records(catalog: DataFrame, choices: DataFrame, plots: DataFrame) -> DataFrame:
    """One flat record a catalog row: status after its plot is attached, page and link, confidence none unless matched."""
    out = catalog.select("show_id", "title").join(choices, "show_id", "left").join(plots.select("page_title", "plot"), "page_title", "left")
    status = attach_plot(F.coalesce("status", F.lit("not_found")), F.col("plot"), F.col("page_title"))
    matched = status == "matched"
    return out.select("show_id", "title", status.alias("status"), F.when(matched, F.col("page_title")).alias("page_title"), F.when(matched, page_url(F.col("page_title"))).alias("page_url"), F.when(matched, F.col("confidence")).otherwise("none").alias("confidence"), F.when(matched, truncate(F.col("plot"))).otherwise("").alias("plot"))


def follow(titles: DataFrame, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """(title, target) after up to hops redirects (source, target); of several targets of a source the least counts.

    The pointers are jumped: squaring the graph doubles the hops of a join, so there are as many joins as hops has bits. A
    cycle is followed for hops steps and left there.
    """
    out = titles.select("title", F.col("title").alias("target")).distinct()
    step = redirects.groupBy("source").agg(F.min("target").alias("next"))
    while hops:
        if hops % 2:
            out = out.join(step, out["target"] == step["source"], "left").select("title", F.coalesce("next", "target").alias("target"))
        hops //= 2
        if hops:
            again = step.select(F.col("source").alias("middle"), F.col("next").alias("far"))
            step = step.join(again, step["next"] == again["middle"], "left").select("source", F.coalesce("far", "next").alias("next"))
    return out


def resolve_titles(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame, hops: int = 3) -> DataFrame:
    """(title, page_title, pageid, description, missing, disambiguation) of each distinct title (title).

    normalized, redirects: (source, target); pages: (title, pageid, description, missing, disambiguation), one row a title.
    A title is normalised once and then follows up to hops redirects. A page that isn't there, or is marked missing, has no
    pageid and keeps the title that was reached; its description is empty.
    """
    first = normalized.groupBy("source").agg(F.min("target").alias("next"))
    asked = titles.select("title").where("title is not null").distinct().join(first, F.col("title") == F.col("source"), "left").select("title", F.coalesce("next", "title").alias("start"))
    reached = follow(asked.select(F.col("start").alias("title")), redirects, hops).select(F.col("title").alias("start"), F.col("target").alias("page_title"))
    known = pages.select(F.col("title").alias("page_title"), "pageid", "description", F.coalesce("missing", F.lit(False)).alias("gone"), F.coalesce("disambiguation", F.lit(False)).alias("several"), F.lit(True).alias("there"))
    found = asked.join(reached, "start").join(known, "page_title", "left")
    missing = F.col("there").isNull() | F.col("gone")
    return found.select("title", "page_title", F.when(~missing, F.col("pageid")).alias("pageid"), F.coalesce("description", F.lit("")).alias("description"), missing.alias("missing"), F.coalesce("several", F.lit(False)).alias("disambiguation"))


def coverage(records: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(slice, n, with_plot, ratio, by_status, by_confidence) of all records, and of gold ids: those without a record count as not_found."""
    rows = records.select(F.lit("catalog").alias("slice"), "show_id", "status", "plot", "confidence")
    if gold is not None:
        own = gold.select("show_id").distinct().join(records, "show_id", "left")
        rows = rows.unionByName(own.select(F.lit("gold").alias("slice"), "show_id", F.coalesce("status", F.lit("not_found")).alias("status"), "plot", F.coalesce("confidence", F.lit("none")).alias("confidence")))
    has = F.count_if((F.col("status") == "matched") & (F.coalesce("plot", F.lit("")) != ""))
    base = rows.groupBy("slice").agg(F.count("*").alias("n"), has.alias("with_plot"))

    def counts(column: str, name: str) -> DataFrame:
        each = rows.groupBy("slice", column).agg(F.count("*").alias("c"))
        return each.groupBy("slice").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", column, "c"))), ",").alias(name))

    out = base.join(counts("status", "by_status"), "slice").join(counts("confidence", "by_confidence"), "slice")
    return out.select("slice", "n", "with_plot", F.round(F.col("with_plot") / F.col("n"), 4).alias("ratio"), "by_status", "by_confidence")
