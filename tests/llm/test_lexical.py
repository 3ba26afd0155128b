import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.llm import lexical, textscan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document with Python's integers."""
    docs = [(i, terms(t)) for i, t in docs if i is not None]
    n, length = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        rows = []
        for i, w in docs:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            rows += [(-score, i)] if score > 0 else []
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, n, words=60):
    names = [f"w{k}" for k in range(words)]
    odds = 1.0 / np.arange(1, words + 1)
    return [(int(i), " ".join(rng.choice(names, int(rng.integers(0, 40)), p=odds / odds.sum()))) for i in rng.permutation(n)]


def frame(spark, rows, column):
    df = spark.createDataFrame(rows, f"{column} long, text string")
    return df.withColumns({c: F.lit(3) for c in ("rank", "score", "shard", "row", "n", "term")})


def got(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


def test_terms_are_those_of_the_pattern():
    texts = ["", "A-b_C 9x", "é日本 Éa\x7fb", "x" * 5000, "--", "a\x80b", "[Z]@`{q}"]
    data, offsets = textscan.utf8(pa.array(texts))
    hashes, at = lexical.term_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(terms(t)) for t in texts]
    alone = {w: int(lexical.term_hashes(*textscan.utf8(pa.array([w])))[0][0]) for t in texts for w in terms(t)}
    assert hashes.tolist() == [alone[w] for t in texts for w in terms(t)] and len(set(alone.values())) == len(alone)


def cost(value, cuts):
    return sum((b - a) * max(value[a:b]) - sum(value[a:b]) for a, b in cuts) + len(cuts) * lexical.PRICE * sum(value) / len(value)


def test_block_boundaries_are_the_cheapest():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.integers(1, 1000, n)) if n % 2 else rng.integers(1, 1000, n) ** 2 for n in (1, 7, 8, 9, 64, 100, 333, 16)]
    size = np.array([len(x) for x in lists])
    ends = lexical.block_ends(np.concatenate(lists), np.cumsum(size) - size, size)
    for x, own in zip(lists, np.split(ends, np.cumsum(size)[:-1])):
        assert own[-1]
        at = [0, *(np.flatnonzero(own) + 1).tolist()]
        marks = [*range(0, len(x), lexical.CELL), len(x)]
        best = {0: 0.0}
        for j, b in list(enumerate(marks))[1:]:
            best[b] = min(best[a] + cost(x, [(a, b)]) for a in marks[max(0, j - lexical.LONGEST) : j])
        assert set(at) <= set(marks) and cost(x, list(zip(at, at[1:]))) == pytest.approx(best[len(x)])


def test_blocks_are_skipped_and_nothing_is_lost():
    """One rare term with a large share: all but few blocks of the frequent one can't reach the threshold."""
    rng = np.random.default_rng(4)
    n = 20_000
    rare = np.sort(rng.choice(n, 40, replace=False))
    term, doc = np.repeat([0, 1], [n, 40]), np.concatenate([np.arange(n), rare]).astype(np.int32)
    share = np.concatenate([rng.integers(1, 50, n), rng.integers(900, 1000, 40)])
    shard = lexical.Shard(term, doc, share)
    whole = np.bincount(doc, share, n).astype(np.int64)
    for wanted in ([0, 1], [1], [0], [5], [0, 1, 5]):
        own = np.bincount(doc[np.isin(term, wanted)], share[np.isin(term, wanted)], n).astype(np.int64)
        best = [i for i in np.lexsort((np.arange(n), -own)) if own[i] > 0][:10]
        docs, scores = shard.search(np.array(wanted), 10)
        assert docs.tolist() == best and scores.tolist() == own[best].tolist()
    shard.read = 0
    shard.search(np.array([0, 1]), 10)
    assert 0 < shard.read < len(doc) // 3 and whole.max() > 900


@pytest.mark.parametrize("postings,asked", [(2_000_000, 1 << 19), (300, 40)])
def test_search_equals_brute_force(shipped, monkeypatch, postings, asked):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "ASKED", asked)
    rng = np.random.default_rng(6)
    docs = corpus(rng, 300) + [(None, "w1 w2"), (1000, None), (1001, ""), (1002, "- -"), (5, "w3 W3 w50"), (5, "w3 W3 w50"), (1003, "W1 " * 20_000)]
    docs += [(2000 + k, "w40 w41 w42") for k in range(30)]
    items = [(k, " ".join(f"w{x}" for x in rng.choice(60, 6))) for k in range(20)] + [(30, None), (31, "none of them"), (32, "w40 w40 W41"), (33, "w1"), (33, "w2"), (None, "w3")]
    assert got(lexical.search(frame(shipped, docs, "doc_id"), frame(shipped, items, "item_id"))) == brute(docs, items)


def test_empty_tables(shipped):
    some, none = [(1, "a b")], []
    for docs, items in ((none, some), (some, none), (none, none)):
        assert got(lexical.search(frame(shipped, docs, "doc_id"), frame(shipped, items, "item_id"))) == []
