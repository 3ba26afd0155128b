import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from querent.llm import scan
from querent.llm.prefix_trie import trie


def brute(rows):
    """A node a row, from nested Python dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words(p)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def got(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(3) for c in ("depth", "at", "row", "n", "owner", "words", "mark", "last", "up")})


def test_trie_of_odd_conversations(shipped):
    rng = np.random.default_rng(8)
    rows = [(int(c), t, "user" if t % 2 else None, f"t{rng.integers(0, 2)} two  words") for c in rng.permutation(150) for t in range(int(rng.integers(1, 7)))]
    rows += [(-c, t, "user", f"n{t}") for c in range(1, 50, 3) for t in range(4)]
    rows += [(None, 0, "user", "x"), (200, None, "a", "null first"), (200, 0, "a", "b"), (200, 0, "a", "b"), (200, 0, None, None), (203, 5, "é", "  é\x1f"), (203, 5, "a", "tie")]
    rows += [(300 + k, 0, "user", "only one turn, of which a leading conversation has none") for k in range(30)]
    rows += [(c, t, "u", f"long {t}") for c in (400, 401, 402, 407) for t in range(90)] + [(402, t, "v", "") for t in range(90, 300)]
    rows += [(10_000 + 7 * k, t, "user", "copy") for k in range(300) for t in range(3)]  # one conversation is half of all
    assert got(trie(frame(shipped, rows))) == brute(rows)


def test_trie_of_a_caterpillar(shipped):
    """Each conversation hangs on the one before it, so sums go up through as many chains as there are."""
    rows = [(20 * k, t, "u", "x" if t < 40 - k else f"end {k}") for k in range(40) for t in range(42 - k)]
    assert got(trie(frame(shipped, rows))) == brute(rows)


def test_empty_table_has_no_node(shipped):
    assert got(trie(frame(shipped, []))) == []


def test_running_values_of_a_group_that_spans_tasks(shipped):
    rows = [(k % 3 if k % 5 == 0 else 7, k, 3 * k - 500, k * 7919) for k in range(4000)]
    df = shipped.createDataFrame(rows, "key long, n long, x long, y long")
    found = scan.running(df, "key", [F.col("key"), F.col("n").desc()], sums=("x",), xors=("y",)).collect()
    assert len(found) == len(rows)
    state = {}
    for r in sorted(found, key=lambda r: (r.key, -r.n)):
        at, x, y = state.get(r.key, (0, 0, 0))
        state[r.key] = at + 1, x + r.x, y ^ r.y
        assert (r["at"], r.run_x, r.run_y) == state[r.key]


def test_meet_joins_hot_and_cold_keys_once(shipped):
    left = shipped.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 400).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("most"))
    assert scan.meet(left, right, ["k"], "w", 5000).select("id", "k", "most").exceptAll(left.join(right, "k").select("id", "k", "most")).isEmpty()
    assert scan.meet(left, right, ["k"], "w", 5000).count() == 5000
