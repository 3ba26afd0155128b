"""The prefix trie of conversations, rebuilt with shared beginnings.

A prefix is known by its depth and 128 bits that its turns make (an exclusive or of hashes that hold each turn's
place). The least conv_id of those that begin with a prefix owns its node. Whoever owns a node owns all later ones
along itself, so a conversation's first owned depth is found by binary search: in each round all open conversations
ask, in one batched join, who owns their prefix at the middle depth. What a conversation owns is a chain of nodes; it
hangs on the node before it. Subtree sums go up the tree of chains, doubling the distance with each round, and then
along each chain. Neither a conversation nor a node need fit a task: running values are carried over sorted ranges,
hot prefixes are joined by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.runtime import cut
from querent.llm.scan import meet, running

#: Conversations of which one leads the others, and turns that it may lead with.
FAMILY, LEAD = 20, 4
#: Neighbouring ids that are joined to one text before a digest reads them.
IDS = 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) and (conv_id, depth, mark, words, last): rebuilt conversations and their turns, by turn (null first).

    Rows of equal turn are sorted by their mark, the MD5 of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    turns = running(rows, "conv_id", [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark"), F.col("row")]).select("conv_id", "at", "mark", "words")
    own = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("skipped", F.crc32(F.col("conv_id").cast("string")) % LEAD)
    leads = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    lead = F.least("skipped", F.coalesce("base_own", F.lit(0)))
    convs = own.join(leads, "base", "left").select("conv_id", "base", "own", "skipped", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("skipped"), F.lit(0))).alias("n"))
    convs = cut(convs, "conversations")
    total = convs.agg(F.sum("own")).first()[0] or 0
    later = meet(turns, convs, ["conv_id"], "own", total).where(F.col("at") > F.col("skipped")).withColumn("depth", F.col("lead") + F.col("at") - F.col("skipped"))
    heads = turns.where((F.col("at") < LEAD) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").where(F.col("at") <= F.col("lead")).withColumn("depth", F.col("at"))
    columns = ["conv_id", "depth", "mark", "words", (F.col("depth") == F.col("n")).alias("last")]
    return convs.select("conv_id", "n"), later.select(*columns).unionByName(first.select(*columns))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, words, last) of each prefix of each conversation, the empty one included; words: of its last turn."""
    hashed = turns.withColumns({"a": F.xxhash64("depth", "mark"), "b": F.xxhash64("mark", F.lit("b"), "depth")})
    found = running(hashed, "conv_id", [F.col("conv_id"), F.col("depth")], xors=("a", "b"))
    none = F.lit(0).cast("long")
    empty = convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("words"), (F.col("n") == 0).alias("last"))
    return empty.unionByName(found.select("conv_id", "depth", F.col("run_a").alias("a"), F.col("run_b").alias("b"), "words", "last"))


def chains(convs: DataFrame, found: DataFrame, owners: DataFrame, total: int) -> DataFrame:
    """(conv_id, n, first, up): a conversation's least owned depth, n + 1 if it owns none, and who owns the node before that."""
    asking = found.select("conv_id", "depth", "a", "b")
    opened = convs.select("conv_id", "n", F.lit(-1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(None).cast("long").alias("up"))
    closed = None
    while True:
        probe = opened.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(asking, ["conv_id", "depth"])
        told = meet(probe, owners.select("depth", "a", "b", "owner", "n_convs"), ["depth", "a", "b"], "n_convs", total)
        owns = F.col("owner") == F.col("conv_id")
        told = told.select("conv_id", "n", F.when(owns, F.col("lo")).otherwise(F.col("depth")).alias("lo"), F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owns, F.col("up")).otherwise(F.col("owner")).alias("up"))
        told = cut(told, "search")
        ready = told.where("hi - lo = 1").select("conv_id", "n", F.col("hi").alias("first"), "up")
        closed = ready if closed is None else closed.unionByName(ready)
        opened = told.where("hi - lo > 1")
        if opened.isEmpty():
            return closed


def summed_up(tree: DataFrame, total: int) -> DataFrame:
    """(conv_id, leaves, saved) summed over each chain and all that hang on it, from (conv_id, up, leaves, saved).

    Round by round a chain adds what chains at twice the distance below it have, until none has one above.
    """
    while not tree.where("up is not null").isEmpty():
        below = tree.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("below"))
        heads = tree.join(below.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        heads = cut(heads.select("conv_id", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.coalesce("below", F.lit(0)).alias("below")), "chains")
        above = heads.select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "below")
        moved = meet(heads.where("up is not null").drop("below"), above, ["up"], "below", total).select("conv_id", F.col("next").alias("up"), "leaves", "saved")
        tree = cut(heads.where("up is null").select("conv_id", "up", "leaves", "saved").unionByName(moved), "chains")
    return tree.select("conv_id", "leaves", "saved")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's texts joined by commas, read as a stream in order."""
    node, digest = None, None
    for batch in batches:
        out = []
        for conv_id, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
            if (conv_id, depth) != node:
                if digest:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv_id, depth), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield _digest_rows(out)
    if digest:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): of the members' ids, ascending and joined by commas.

    Runs of ids become texts first, so the task that reads a node's in order, as SHA-256 has to, reads few rows.
    """
    runs = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / IDS).alias("run")).agg(F.array_sort(F.collect_list("member")).alias("ids"))
    texts = runs.select("conv_id", "depth", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Null roles and texts are empty; a null turn comes first; rows of equal
    turn are sorted by the MD5 of role and text, and rows that repeat are turns of their own; a row without conv_id
    belongs to no conversation. An empty table has no node, not even a root. Texts and conversations may be of any
    length. Other columns are ignored.
    """
    convs, turns = rebuilt(conversations)
    found = cut(prefixes(convs, turns), "prefixes")
    total = found.count()
    owners = found.groupBy("depth", "a", "b").agg(F.min(F.struct("conv_id", "last")).alias("least"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    owners = cut(owners.select("depth", "a", "b", F.col("least.conv_id").alias("owner"), F.col("least.last").alias("last"), "n_convs", "words"), "owners")
    found_chains = chains(convs, found, owners, total)
    hung = found_chains.where("up is not null and first <= n").withColumn("place", F.col("first") - 1)
    # nodes, with the chains that hang on each
    own = owners.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words", "last")
    kids = hung.groupBy(F.col("up").alias("conv_id"), F.col("place").alias("depth")).agg(F.count("*").alias("kids"))
    nodes = own.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1))
    nodes = nodes.select("conv_id", "depth", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = cut(nodes, "nodes")
    tops = found_chains.where("first <= n").select("conv_id", "first", "up")
    heads = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(tops, "conv_id")
    sums = summed_up(cut(heads.select("conv_id", "up", "leaves", "saved"), "chains"), total)
    below = hung.join(sums, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("place").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    top = tops.select("conv_id", F.col("first").alias("depth"), "up", F.lit(True).alias("top"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left").join(top, ["conv_id", "depth"], "left")
    nodes = nodes.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "parent": F.when(F.col("top"), F.col("up")).otherwise(F.col("conv_id"))})
    along = running(nodes.select("conv_id", "depth", "n_convs", "n_children", "leaves", "saved", "parent"), "conv_id", [F.col("conv_id"), F.col("depth").desc()], sums=("leaves", "saved"))
    ends = found_chains.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    out = along.join(end_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("run_leaves").alias("n_leaves"),
        F.col("run_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
