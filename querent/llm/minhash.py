"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star edges, exact checks.

One pass makes each text's set of 5-word shingle hashes, its size, a 128-bit digest and 32 band keys of
4 bins each; a pair at 0.75 shares no band with probability (1 - 0.75**4)**32, 5e-6. Texts of equal sets
are one class, named by its digest and numbered. In each bucket the least class is the centre of a star; stars
are checked on full sets. Pairs whose sizes alone rule the threshold out are never made.

What shares a bucket and is still apart then meets again. Buckets are grouped by the component that most of
their members are in; the other members are the group's stragglers. Turns of a few stars around stragglers
join most of them while that pays, and then all stragglers are compared with all of their group, block by
block. So every pair that shares a bucket is compared or already in one component, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm import textscan
from querent.llm.components import components
from querent.llm.runtime import cut
from querent.llm.textscan import tidied

_U = np.uint64
WORDS, BINS, ROWS, PROBES = 5, 128, 4, 2048
BANDS = BINS // ROWS
PERCENT = 75
#: Members of a star that are checked in one group.
STAR_BLOCK = 64
#: Stars a turn in each group of classes that may still link, and the share of them that a turn has to place for another one.
HUBS, PAYS = 3, 0.2
#: Members, and shingles of them, that are about one side of two blocks compared in one group: stragglers, and all.
NEAR_BLOCK, FAR_BLOCK, BLOCK_SHINGLES = 512, 64, 200_000
_rng = np.random.default_rng(5)
_WEIGHT = _rng.integers(0, 2**63, WORDS, dtype=_U) * _U(2) + _U(1)
_BAND_WEIGHT = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=_U) * _U(2) + _U(1)
_PROBE = _rng.integers(0, BINS, (BINS, PROBES), dtype=np.int16)
_EDGES = np.arange(BINS, dtype=_U) << _U(64 - BINS.bit_length() + 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending: 5 words, or all of 1 to 4 words as one."""
    words, at = textscan.word_hashes(data, offsets)
    n = np.diff(at)
    sums = np.zeros(len(words), _U)
    for k in range(WORDS):
        sums[: max(0, len(words) - k)] += words[k:] * _WEIGHT[k]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        whole = np.zeros(len(few), _U)
        for k in range(WORDS - 1):
            has = n[few] > k
            whole[has] += words[at[few][has] + k] * _WEIGHT[k]
        sums[at[few]] = whole + n[few].astype(_U)
    hashes = textscan.mix(sums)
    for first, size in zip(at[:-1].tolist(), n.tolist()):
        own = np.sort(hashes[first : first + (size - WORDS + 1 if size >= WORDS else min(size, 1))])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own


def signature(own: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS ranges; an empty bin takes that of the first filled one among its random probes."""
    at = np.searchsorted(own, _EDGES)
    end = np.append(at[1:], len(own))
    filled = end > at
    least = own[np.minimum(at, len(own) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        for width in (32, PROBES):
            hit = filled[_PROBE[empty, :width]]
            found = hit.any(axis=1)
            if found.all():
                break
        # with none among the probes: any filled bin, the same for equal sets
        source = np.where(found, _PROBE[empty, hit.argmax(axis=1)], np.flatnonzero(filled)[0])
        least[empty] = least[source]
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return textscan.mix((textscan.mix(least).reshape(BANDS, ROWS) * _BAND_WEIGHT).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textscan.utf8(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for first, last in textscan.blocks(offsets):
            sizes, digests, bands = [], [], []
            for own in shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]):
                sizes.append(len(own))
                digests.append(digest(own))
                bands.append(band_keys(signature(own)).view(np.int64) if len(own) else np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), keys.slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "digest", "bands"])


def _check(table: pa.Table) -> pa.Table:
    """A block of a star: the members whose sets meet the threshold with the centre's."""
    centre, ids = table.column("a")[0].as_py(), table.column("b").to_numpy()
    data, offsets = textscan.utf8(table.column("text"))
    hub, found = None, []
    order = np.argsort(ids != centre, kind="stable")  # the centre first
    for i in order.tolist():
        own = next(shingle_sets(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])))
        if hub is None:
            hub = own
            continue
        small, large = (own, hub) if len(own) < len(hub) else (hub, own)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        if 100 * both >= PERCENT * (len(own) + len(hub) - both):
            found.append(int(ids[i]))
    return pa.table({"a": pa.array([centre] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def _able(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can meet the threshold at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that meet the threshold. Each block takes a's text once and up to about STAR_BLOCK of b's."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("k"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).alias("block"))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "text")
    hubs = dealt.select("a", "block").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "block", F.col("a").alias("b"), "text")
    return members.unionByName(hubs).groupBy("a", "block").applyInArrow(_check, "a long, b long")


def _stragglers(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with their component; and (group, id, n, component) of those that share a bucket with a component
    which more of the bucket's members are in (of equal counts the least), the group."""
    named = cut(members.join(label, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), "buckets"), "named")
    spots = named.select("id", "n", "component", F.explode("buckets").alias("bucket"))
    most = spots.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.struct("c", (-F.col("component")).alias("m"))).alias("x")).where("kinds > 1")
    most = most.select(F.col("bucket").alias("of"), (-F.col("x.m")).alias("group"))
    near = spots.join(most, (F.col("bucket") == F.col("of")) & (F.col("component") != F.col("group")))
    return named, cut(near.select("group", "id", "n", "component").distinct(), "stragglers")


def _pool(named: DataFrame, near: DataFrame) -> DataFrame:
    """(group, id, n, component) of all members of the groups' own components, and their stragglers."""
    own = named.join(near.select("group").distinct(), F.col("component") == F.col("group")).select("group", "id", "n", "component")
    return own.unionByName(near)


def _hub_pairs(named: DataFrame, near: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of HUBS stragglers of each group, drawn anew each turn, with all of the group that they may link with."""
    drawn = [F.min(F.struct(F.xxhash64("id", "group", F.lit(turn * HUBS + k)).alias("draw"), F.col("id"), F.col("n"), F.col("component"))) for k in range(HUBS)]
    hubs = near.groupBy("group").agg(F.array_distinct(F.transform(F.array(*drawn), lambda h: F.struct(h["id"].alias("a"), h["n"].alias("an"), h["component"].alias("ac")))).alias("h")).select(F.col("group").alias("g"), F.inline("h"))
    pool = _pool(named, near)
    return pool.join(hubs, (F.col("group") == F.col("g")) & (F.col("component") != F.col("ac")) & _able(F.col("n"), F.col("an"))).select("a", F.col("id").alias("b")).distinct()


def _blocks(named: DataFrame, near: DataFrame) -> DataFrame:
    """Block pairs (group, p, q, far, id, component, n) that hold each straggler with each of its group: near rows
    are the stragglers, far rows all."""
    pool = _pool(named, near)
    count = lambda members: F.ceil(F.greatest(F.count("*") / members, F.sum("n") / BLOCK_SHINGLES))
    sizes = pool.groupBy("group").agg(count(FAR_BLOCK).alias("ps")).join(near.groupBy("group").agg(count(NEAR_BLOCK).alias("qs")), "group")
    deal = lambda k: F.pmod(F.xxhash64("id", "group"), F.col(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    far = pool.join(sizes, "group").select("group", deal("ps").alias("p"), each("qs").alias("q"), F.lit(True).alias("far"), "id", "component", "n")
    return far.unionByName(near.join(sizes, "group").select("group", each("ps").alias("p"), deal("qs").alias("q"), F.lit(False).alias("far"), "id", "component", "n"))


def _check_blocks(table: pa.Table) -> pa.Table:
    """Links of the near rows with the far rows of other components, as many as join what meets the threshold."""
    far, ids, component = (table.column(c).to_numpy() for c in ("far", "id", "component"))
    data, offsets = textscan.utf8(table.column("text"))
    sets = list(shingle_sets(data, offsets))
    sizes = np.array([len(s) for s in sets])
    whole = np.flatnonzero(far)
    hashes, owner = np.concatenate([sets[i] for i in whole] or [np.zeros(0, _U)]), np.repeat(whole, sizes[whole])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    parent = {c: c for c in component.tolist()}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i in np.flatnonzero(~far).tolist():
        lo, hi = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
        count = hi - lo
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(ids))
        meets = far & (component != component[i]) & (both > 0) & (100 * both >= PERCENT * (sizes + sizes[i] - both))
        for j in np.flatnonzero(meets).tolist():
            x, y = top(int(component[i])), top(int(component[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block_links(named: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join what meets the threshold among the pairs of _blocks. A block pair goes only where sizes allow the threshold."""
    dealt = cut(_blocks(named, near), "blocks")
    key = ["group", "p", "q"]
    side = lambda far: dealt.where("far" if far else "not far").groupBy(*key).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    f, n = side(True).alias("f"), side(False).alias("n")
    able = f.join(n, key).where(f"100 * f.hi >= {PERCENT} * n.lo and 100 * n.hi >= {PERCENT} * f.lo").select(*key)
    rows = dealt.join(able, key).join(texts, "id").select(*key, "far", "id", "component", "text")
    return rows.groupBy(*key).applyInArrow(_check_blocks, "a long, b long")


def _labels(classes: DataFrame, given: DataFrame) -> DataFrame:
    """(id, component) of all classes that link with another one."""
    spots = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("centre"), F.count("*").alias("size")).where("size > 1")
    live = cut(spots.join(shared, "bucket"), "buckets")
    # the texts that any check needs; one text stands for its class
    need = live.select("id").distinct().join(classes.select("id", "doc_id", "text_key"), "id")
    texts = cut(given.join(need, ["doc_id", "text_key"]).groupBy("id").agg(F.min("text").alias("text")), "texts")
    pairs = cut(live.where((F.col("id") != F.col("centre.id")) & _able(F.col("n"), F.col("centre.n"))).select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = cut(_links(pairs, texts), "links")
    # in a bucket of two the star is all
    members = cut(live.where("size > 2").groupBy("id").agg(F.first("n").alias("n"), F.collect_set("bucket").alias("buckets")), "members")
    label, turn, before = components(links), 0, None
    while True:
        named, near = _stragglers(members, label)
        left = near.count()
        if not left:
            return label
        if before is not None and left > (1 - PAYS) * before:
            found = cut(_block_links(named, near, texts), "links")
            return components(links.unionByName(found))
        found = cut(_links(cut(_hub_pairs(named, near, turn), "pairs"), texts), "links")
        before, turn, links = left, turn + 1, links.unionByName(found)
        label = components(links)


def resolve(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id and top_key of each row: the text_key of
    the document that stands for the component, the least of its least doc_id. Of rows without a doc_id or
    without words the last two are null."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    rows = cut(given.mapInArrow(tidied(_sketch), "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"), "minhash")
    some = rows.where("doc_id is not null and n_shingles > 0")
    least = some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "bands")).alias("x"))
    classes = cut(least.select(F.monotonically_increasing_id().alias("id"), "digest", "x.doc_id", "x.text_key", F.col("x.n_shingles").alias("n"), "x.bands"), "classes")
    label = _labels(classes, given)
    linked = classes.join(label, "id").select("digest", "doc_id", "text_key", "component")
    tops = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("top"))
    alone = classes.join(label, "id", "left_anti").select("digest", F.struct("doc_id", "text_key").alias("top"))
    named = linked.join(tops, "component").select("digest", "top").unionByName(alone)
    out = some.join(named, "digest").select("doc_id", "text_key", "n_shingles", F.col("top.doc_id").alias("component_id"), F.col("top.text_key").alias("top_key"))
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("top_key"))
    return out.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Rows of equal sets are linked; sets link where
    100 * common >= 75 * united. A text that is null or without words has size 0 and its own doc_id as
    component. A null doc_id links with nothing: component_id null, kept false. Rows that repeat a doc_id
    keep their own sets and share a component only where they link; repeated rows get equal results. An empty
    table gives an empty table. Other columns are ignored.
    """
    out = resolve(docs).select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one that stands for it (of rows equal in doc_id and text, any).

    Rows without a doc_id or without words link with nothing and stay. Columns are those of docs.
    """
    found = cut(resolve(docs).where("component_id is not null"), "resolved")
    stands = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("top_key"))
    renamed = lambda df: df.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    gone = renamed(found.where(~stands))
    often = renamed(found.where(stands).groupBy("doc_id", "text_key").count().where("count > 1"))
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": F.xxhash64(F.coalesce("text", F.lit("")))})
    key = ["__doc", "__key"]
    once = keyed.join(gone.unionByName(often), key, "left_anti")
    one = keyed.join(often, key, "left_semi").dropDuplicates(key)
    return once.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
