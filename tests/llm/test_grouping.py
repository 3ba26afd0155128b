import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from querent.llm import byte_bpe, grouping, textscan

ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "\na b", "a <|endoftext|> b", "don't  stop 's it's 'll", "x  y", "x  y z", "　a b", "a b　", "日本 語", "a\tb c", "a \tb", "é è", "word" * 500, "\x00 a b", "a\u0085 b", "\x1c a", " \n ", "x <| y", None, "a b" * 4000, "same text twice", "same text twice"]


@pytest.fixture(scope="module")
def vocabulary():
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizer(vocabulary, small):
    import pyarrow.parquet as pq

    texts = [t or "" for t in ODD + ODD[::-1] + pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()]
    own = byte_bpe.ByteTokenizer(vocabulary)
    assert own.plain
    for some in (texts, texts[::-1], texts[:40]):  # the second and third time from what is kept
        ids, at = own.encode(*textscan.utf8(pa.array(some)))
        for k, text in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == own.full.encode(text, add_special_tokens=False).ids, text[:40]


def test_a_hash_that_two_pieces_share_is_told(monkeypatch, vocabulary):
    monkeypatch.setattr(byte_bpe, "mix", lambda h: h * np.uint64(0))
    own = byte_bpe.ByteTokenizer(vocabulary)
    ids, at = own.encode(*textscan.utf8(pa.array(["a big cat", "the old dog of a man"])))
    assert ids[at[1] :].tolist() == own.full.encode("the old dog of a man").ids


def test_crossover_and_mutation_keep_every_piece_in_a_bin_that_holds_it():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 2049, int(rng.integers(1, 120)))
        population = grouping.beginners(sizes, rng)
        for child in (grouping.crossed(population[0], population[-1], sizes, rng), grouping.mutated(population[1], sizes, rng), *grouping.evolved(sizes, population, rng)):
            assert len(child) == len(sizes) and np.bincount(child, sizes).max() <= grouping.WINDOW
            assert child.max() + 1 == len(set(child.tolist())) >= grouping.fewest(sizes)


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(5)
    sizes = np.array([1024, 1024, 1500, 548, 700, 700, 648, 30])
    of = np.array([0, 0, 1, 1, 2, 2, 2, 3])
    child = grouping.crossed(np.arange(8), of, sizes, rng)
    assert any(set(np.flatnonzero(child == child[k]).tolist()) >= set(np.flatnonzero(of == of[k]).tolist()) and (of == of[k]).sum() > 1 for k in range(8))


def test_evolution_beats_its_beginners():
    rng = np.random.default_rng(1)
    found = []
    for seed in range(40):
        draw = np.random.default_rng(seed)
        sizes = draw.integers(300, 1100, 30)
        population = grouping.beginners(sizes, rng)
        before = min(grouping.worth(g, sizes) for g in population)
        for _ in range(4):
            population = grouping.evolved(sizes, population, rng)
        after = grouping.worth(population[0], sizes)
        assert after <= before
        found.append(after < before)
    assert any(found)


def plain(rows, vocabulary):
    """(doc_id, piece, start, length, crc) of each piece, by the tokenizer itself."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(vocabulary), []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=lambda r: (r[0] is None, r))


def check(out, rows, vocabulary):
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == plain(rows, vocabulary)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return bins


def test_packs_every_piece_once(shipped, vocabulary, monkeypatch):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(ODD * 3)] + [(1, "same id"), (1, "same id"), (1, "another")]
    docs = shipped.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, size string")
    out = grouping.pack_documents(docs, vocabulary).collect()
    bins = check(out, rows, vocabulary)
    assert len(bins) == -(-sum(r.length for r in out) // 2048)


def test_many_shards_and_levels_waste_no_more_than_one(shipped, vocabulary, small, monkeypatch):
    monkeypatch.setattr(grouping, "SHARD", 20)
    docs = shipped.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = grouping.pack_documents(docs, vocabulary, keep_ids=True).collect()
    bins = check(out, rows, vocabulary)
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 2
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)


def test_an_empty_table_gives_an_empty_one(shipped, vocabulary):
    assert grouping.pack_documents(shipped.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []
