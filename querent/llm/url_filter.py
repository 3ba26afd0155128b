"""URL filters: rules, host word segmentation, and naive Bayes over the words.

A rule's host fits itself and its subdomains, its path starts the url's path; the longest rule wins. Names in
hosts are split into words by unigram Viterbi, with the word counts of a text column. The urls that rules
decide teach a multinomial naive Bayes over host and path words, which judges the rest. Words that a rule
names made the labels, so they are no features; the ruled urls are no sample of the others, so both verdicts
are as likely before a word is seen, and a block needs odds of BLOCK_ODDS to one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.runtime import cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: How much likelier block than allow must be where no rule fits.
BLOCK_ODDS = 9
#: A label of a host has 63 characters at most, so no word in a valid name is longer; an unknown string of n letters
#: counts 10 / (total * 10 ** n).
LONGEST = 63
LETTERS = r"\p{L}+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; empty for a null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls; of equally long ones the first given."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def word_counts(texts: DataFrame, column: str, markup: bool = True) -> DataFrame:
    """(word, n) of all runs of letters in a column, in lower case."""
    plain = F.regexp_replace(column, "<[^>]*>", " ") if markup else F.col(column)
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(LETTERS), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a name: known has (start, length, count) of its substrings that are words; start from 0."""
    n, log_total = len(name), math.log(max(total, 1))
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, count in known:
        ends[start + length].append((start, math.log(count) - log_total))
    best, back, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), math.log(10) - log_total
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            value = best[start] + unknown - (end - start) * math.log(10)
            if value > best[end]:
                best[end], back[end] = value, start
        for start, score in ends[end]:
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], n
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name. The vocabulary stays distributed: only substrings of names meet it."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    at = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
    spans = at.select("name", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("i") + 1))).alias("l"))
    spans = spans.withColumn("word", F.substring("name", F.col("i"), F.col("l")))
    found = spans.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "l", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[(x["i"], x["l"], x["n"]) for x in known or []] for known in batch.column("known").to_pylist()]
            words = [split_name(name, sorted(known), total) for name, known in zip(batch.column("name").to_pylist(), lists)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def rule_words(rules: tuple[Rule, ...]) -> tuple[list[str], list[str]]:
    """Names in the rules' hosts, without the last label, and words of their paths."""
    hosts = {w for r in rules for w in re.findall(r"[^\W\d_]+", r.host.rpartition(".")[0].lower())}
    return sorted(hosts), sorted({w for r in rules for w in re.findall(r"[^\W\d_]+", r.path.lower())})


def weigh(held: DataFrame) -> DataFrame:
    """(token, w): log of how much likelier a token is in blocked than in allowed urls, add-one smoothed, from rows of
    (tokens, ruled, n). Without ruled urls there is no token."""
    seen = held.where("ruled is not null").select((F.col("ruled") == "block").alias("b"), "n", F.explode("tokens").alias("token"))
    # summed before the shuffle, so a word of every url is one row a task
    table = cut(seen.groupBy("token").agg(F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("b"), 0).otherwise(F.col("n"))).alias("allow")), "tokens")
    block, allow, size = table.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*")).first()
    shift = math.log((allow + size) / (block + size)) if size else 0.0
    return table.select("token", (F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0) + F.lit(shift)).alias("w"))


def judge(pages: DataFrame, counts: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, log_odds and the host's words of each row of pages.

    A null url, or one without `://`, has an empty host and path. Where no rule fits, a url is blocked if
    naive Bayes finds block BLOCK_ODDS times likelier than allow (log_odds is the log of that ratio); without any
    ruled url all of these are allowed. The host's last label (com, net, ...) and names that rules hold are no words,
    digits count as one word, and a word that no ruled url holds tells nothing. Repeated rows get equal results; a
    null id stays null; an empty table gives an empty one; columns besides id and url are ignored.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"), F.regexp_replace(F.lower("path"), "[0-9]+", "0").alias("shape"))
    # all that follows works on distinct hosts, path shapes and names
    kinds = cut(rows.groupBy("host", "shape", "ruled").agg(F.count("*").alias("n")), "urls")
    hosts = kinds.select("host").distinct()
    host_rules, path_rules = rule_words(rules)
    spelled = F.regexp_replace(F.lower(F.regexp_replace("host", r"\.[^.]*$", "")), "[0-9]+", "0")
    names = hosts.select("host", F.posexplode(F.regexp_extract_all(spelled, F.lit(LETTERS + "|0"), 0)).alias("p", "name")).where(~F.col("name").isin(host_rules))
    split = names.join(segment(names.select("name").distinct(), cut(counts, "counts")), "name")
    split = split.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("p", "words"))).alias("x")).select("host", F.flatten(F.col("x.words")).alias("words"))
    in_path = F.filter(F.regexp_extract_all("shape", F.lit(LETTERS + "|0"), 0), lambda w: ~w.isin(path_rules))
    in_host = F.coalesce("words", F.array().cast("array<string>"))
    tokens = F.concat(F.transform(in_host, lambda w: F.concat(F.lit("h:"), w)), F.transform(in_path, lambda w: F.concat(F.lit("p:"), w)))
    held = cut(kinds.join(split, "host", "left").select("host", "shape", "ruled", "n", in_host.alias("words"), tokens.alias("tokens")), "tokens")
    once = held.groupBy("host", "shape").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens"))
    each = once.select("host", "shape", "words", F.explode_outer("tokens").alias("token")).join(weigh(held), "token", "left")
    odds = each.groupBy("host", "shape").agg(F.first("words").alias("words"), F.round(F.sum(F.coalesce("w", F.lit(0.0))), 9).alias("log_odds"))
    # the only join that reads every row; a host with many urls of one shape is split by Spark's skew join
    out = rows.join(odds, ["host", "shape"])
    judged = F.when(F.col("log_odds") >= math.log(BLOCK_ODDS), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "log_odds", F.array_join("words", " ").alias("words"))
