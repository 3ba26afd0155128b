"""SentencePiece encoding and decoding: batched numpy Viterbi over words of equal length.

Texts are cut into words: between two neighbouring characters that no piece holds side by side, so no piece and
no merge crosses a cut. A worker keeps the ids of the words it has met. New words of the same number of code points
advance together: the hashes of all substrings up to the longest piece probe the hashes of the pieces, and at each
end position a maximum over the lengths that fit stores a backpointer. Under a unigram model the maximum is of summed
scores. Under a byte-pair model it is over what its merges can produce: a piece may follow the last piece of the best
path so far only if the two stay apart when their joined text is merged, which leaves one path, the encoding
of the merges. Characters without a piece become byte pieces, or the unknown id where there are none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import textscan
from querent.llm.byte_bpe import SpanCache, runs
from querent.llm.packing import _Lists

_U = np.uint64
SPACE = "▁"
SLOT_BITS, SIEVE_BITS = 21, 18
#: Words and characters (words x length) that are searched at once, and bytes of text whose new words are learned together.
WORDS, MATRIX, TEXTS = 4096, 400_000, 2_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model file's vocabulary and an encoder of its own."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids over 65,535 aren't supported")
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        own = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        self.ids = {self.text[i]: i for i in own}
        message = dict(_fields(model.serialized_model_proto()))
        trainer, normal = dict(_fields(message.get(2, b""))), dict(_fields(message.get(3, b"")))
        self.merges = trainer.get(3, 1) == 2
        self.prefix = normal.get(3, 1) == 1
        if normal.get(2) or normal.get(4, 1) == 1 or normal.get(5, 1) != 1:
            raise ValueError("only models that keep white space and change no character are supported")
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("the model's pieces cross words")
        self.longest = max(map(len, self.ids))
        # sorted hashes of the pieces, by which substrings are found
        lengths = np.array([len(self.text[i]) for i in own])
        keys = np.zeros(len(own), _U)
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            keys[rows] = self._hash(self._matrix([self.text[own[r]] for r in rows]), 0, size)
        order = np.argsort(keys)
        self.keys, self.found = keys[order], np.array(own)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.keys >> _U(64 - SIEVE_BITS)] = True
        self._pair_table()
        # decoding: each id's bytes end to end
        special_bytes = {i: bytes([b]) for b, i in self.bytes.items()}
        parts = [special_bytes.get(i, b"" if special[i] else self.text[i].replace(SPACE, " ").encode()) for i in range(n)]
        parts[self.unknown] = " ⁇ ".encode()
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.start = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        if self.merges:
            self._split_table()
            self.slot_key, self.slot_value = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)])
        self.cache = SpanCache(self._learn)

    @staticmethod
    def _matrix(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(_U)

    @staticmethod
    def _hash(points: np.ndarray, start: int, end: int) -> np.ndarray:
        return textscan.mix((points[:, start:end] * textscan.power_table(textscan._BASE, end - start)).sum(axis=1, dtype=_U) + _U(end - start))

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        some = np.flatnonzero(self.sieve[keys >> _U(64 - SIEVE_BITS)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        out[some[same]] = self.found[at[same]]
        return out

    def _pair_table(self) -> None:
        """Which characters stand side by side in a piece, by their numbers as first and as second of a pair; 0: never.
        Without byte pieces words are whole, as neighbouring unknown characters share an id."""
        pairs = sorted({t[k : k + 2] for t in self.ids for k in range(len(t) - 1)})
        self.first, self.second = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for table, place in ((self.first, 0), (self.second, 1)):
            own = sorted({ord(p[place]) for p in pairs})
            table[own] = np.arange(1, len(own) + 1)
        self.beside = np.zeros((int(self.first.max()) + 1, int(self.second.max()) + 1), bool)
        for p in pairs:
            self.beside[self.first[ord(p[0])], self.second[ord(p[1])]] = True

    def _cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a word may start at each character but the first."""
        if self.bytes:
            return ~self.beside[self.first[points[:-1]], self.second[points[1:]]]
        return (points[1:] == ord(SPACE)) & (points[:-1] != ord(SPACE))

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The pieces that merging makes of a short text, down to least: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > least:
            best, place = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, place = self.score[i], k
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def _split_table(self) -> None:
        """For merges: each piece's rank (characters -1), the two pieces that its last merge joins, its unmixed hash,
        and whether merging its text gives it."""
        n = len(self.text)
        self.rank, self.left, self.right = np.full(n, -1.0), np.arange(n), np.arange(n)
        self.raw, self.size, self.whole = np.zeros(n, _U), np.zeros(n, np.int64), np.zeros(n, bool)
        power = [int(x) for x in textscan.power_table(textscan._BASE, self.longest + 1)]
        for text, i in self.ids.items():
            self.size[i] = len(text)
            self.raw[i] = sum(ord(c) * power[k] for k, c in enumerate(text)) % 2**64
            parts = self.merged(text, 2) if len(text) > 1 else [text]
            if len(text) == 1:
                self.whole[i] = True
            elif len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids:
                self.rank[i], self.whole[i] = -self.score[i], True
                self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
        self.power = textscan.power_table(textscan._BASE, self.longest + 1)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As _undone, with answers kept in a table of fixed size that newer pairs overwrite."""
        key = (left + 1) * len(self.text) + right
        slot = (textscan.mix(key.astype(_U)) >> _U(64 - SLOT_BITS)).astype(np.int64)
        out, miss = self.slot_value[slot], np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            out[miss] = self._undone(left[miss], right[miss])
            # of pairs that want the same slot the last one written gets it whole: key and value go in one order
            self.slot_key[slot[miss]], self.slot_value[slot[miss]] = key[miss], out[miss]
        return out

    def _undone(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces stay as they are when their joined text is merged. left -1: nothing before.

        Their merges are undone, the later one first; if ever the two pieces at the border make a piece that would
        have merged before what has just been undone (or as early and further left), they don't stay apart.
        """
        out = self.whole[right].copy()
        live = np.flatnonzero(out & (left >= 0))
        a, b, limit = left[live], right[live], np.full(len(live), np.inf)
        while len(live):
            joined = self._probe(textscan.mix(self.raw[a] + self.power[np.minimum(self.size[a], self.longest)] * self.raw[b] + (self.size[a] + self.size[b]).astype(_U)))
            meets = (joined >= 0) & (self.size[a] + self.size[b] <= self.longest)
            clash = meets & (-self.score[joined] < limit)
            out[live[clash]] = False
            first = self.rank[a] > self.rank[b]
            go = ~clash & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b, first = live[go], a[go], b[go], first[go]
            limit = np.where(first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def best(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a matrix of code points end to end, and how many each row has; -1 - c for a character c
        without a piece."""
        n, size = points.shape
        sums = np.zeros((size + 1, n), _U)
        np.cumsum(points.T * textscan.power_table(textscan._BASE, size)[:, None], axis=0, out=sums[1:])
        inverse = textscan.power_table(textscan._INVERSE, size)[:, None]
        last = np.full((size + 1) * n, -2)  # -2: nothing, or a character that never merges
        back = np.zeros((size + 1) * n, np.int64)
        score, lowest = np.zeros((size + 1) * n), float(self.score.min()) - 10
        step = max(1, MATRIX // n)
        for low in range(0, size, step):
            high = min(size, low + step)
            # what fits with an end in low + 1 to high: its end, place (end x n + row), length and piece; -2 is a character without a piece
            fits = []
            for length in range(1, min(high, self.longest) + 1):
                a, b = max(low + 1 - length, 0), high + 1 - length
                piece = self._probe(textscan.mix((sums[a + length : b + length] - sums[a:b]) * inverse[a:b] + _U(length)).ravel())
                if length == 1:
                    piece[piece < 0] = -2
                at = np.flatnonzero(piece != -1)
                fits.append((at // n + a + length, at + (a + length) * n, np.full(len(at), length), piece[at]))
            ends, place, length, piece = map(np.concatenate, zip(*fits))
            order = np.argsort(ends, kind="stable")
            place, length, piece = place[order], length[order], piece[order]
            bound = np.concatenate(([0], np.cumsum(np.bincount(ends - low - 1, minlength=high - low))))
            for end in range(low + 1, high + 1):
                own = slice(bound[end - low - 1], bound[end - low])
                to, took, by = place[own], length[own], piece[own]
                start = to - took * n
                if self.merges:
                    good = by == -2
                    some = np.flatnonzero(~good)
                    good[some] = self._apart(np.maximum(last[start[some]], -1), by[some])
                else:
                    value = score[start] + np.where(by == -2, lowest, self.score[by])
                    top = np.full(n, -np.inf)
                    np.maximum.at(top, to - end * n, value)
                    good = value == top[to - end * n]
                    score[end * n : (end + 1) * n] = top
                # of equals the shortest, written last, stays
                pick = np.flatnonzero(good)[::-1]
                last[to[pick]], back[to[pick]] = by[pick], took[pick]
        # all words walk back together, a piece a step
        cut = np.zeros((n, size + 1), bool)
        rows, at = np.arange(n), np.full(n, size)
        while len(rows):
            cut[rows, at] = True
            at = at - back[at * n + rows]
            rows, at = rows[at > 0], at[at > 0]
        rows, at = np.divmod(np.flatnonzero(cut), size + 1)
        ids = last[at * n + rows]
        return np.where(ids != -2, ids, -1 - points[rows, at - 1].astype(np.int64)), cut.sum(axis=1)

    def _resolve(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as byte pieces; without those as the unknown id, once where several stand together."""
        bare = ids < 0
        if not bare.any():
            return ids, sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        if not self.bytes:
            ids = np.where(bare, self.unknown, ids)
            again = np.zeros(len(ids), bool)
            again[1:] = bare[1:] & (ids[:-1] == self.unknown) & (row[1:] == row[:-1])
            return ids[~again], np.bincount(row[~again], minlength=len(sizes))
        chars, number = np.unique(-1 - ids[bare], return_inverse=True)
        coded = [chr(c).encode("utf-8", "replace") for c in chars.tolist()]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        many = np.ones(len(ids), np.int64)
        many[bare] = length[number]
        out = np.repeat(ids, many)
        flat = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        out[np.repeat(bare, many)] = flat[runs((np.cumsum(length) - length)[number], length[number])]
        return out, np.bincount(row, many, len(sizes)).astype(np.int64)

    def _points(self, data: bytes) -> np.ndarray:
        points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        return np.where(points == 32, np.uint32(ord(SPACE)), points)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has; none depends on what stands beside it."""
        data = b"".join(words)
        points = self._points(data).astype(_U)
        ahead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        start = ahead[np.cumsum([0, *map(len, words)])]
        length = np.diff(start)
        order = np.argsort(length, kind="stable")
        lists = _Lists()
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            size = int(length[rows[0]])
            step = max(1, min(WORDS, MATRIX // size))
            for part in range(0, len(rows), step):
                own = rows[part : part + step]
                lists.put(own, *self._resolve(*self.best(points[start[own][:, None] + np.arange(size)])))
        return *lists.gather(np.arange(len(words))), np.zeros(len(words), bool)

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, other = self.cache.look_up(data, start, end)
        if other.any():  # words whose hash another word has
            lists = np.split(ids, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(other).tolist():
                lists[k] = self._learn([data[start[k] : end[k]].tobytes()])[0]
            ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' offsets in them."""
        coded = [((" " + t) if self.prefix and t else t).encode("utf-8", "replace") for t in texts]
        offsets, whole = np.cumsum([0, *map(len, coded)]), b"".join(coded)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        data = np.frombuffer(whole, np.uint8)
        starts = np.zeros(len(data), bool)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        before, low = np.zeros(0, np.uint32), 0
        while low < len(data):  # a long text part by part
            high = min(low + 2 * TEXTS, len(data))
            while high < len(data) and data[high] & 0xC0 == 0x80:
                high += 1
            points = np.concatenate([before, self._points(whole[low:high])])
            at = np.flatnonzero((data[low:high] & 0xC0) != 0x80)[len(before) == 0 :]
            starts[low + at[self._cuts(points)]] = True
            before, low = points[-1:], high
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(data))
        parts = [self._look_up(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a]) for a, b in textscan.blocks(np.append(start, len(data)), 2 * TEXTS)]
        ids, sizes = map(np.concatenate, zip(*parts))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids.astype(np.int64), ends[np.searchsorted(start, offsets)].astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids cut at offsets."""
        raw, ends = _gather(self.flat, self.start, ids)
        cuts = np.concatenate(([0], ends))[offsets]
        data = raw.tobytes()
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            text = data[lo:hi].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


def _gather(flat: np.ndarray, at: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[s]:at[s + 1]] of each spot end to end, and where each ends."""
    sizes = at[spots + 1] - at[spots]
    ends = np.cumsum(sizes)
    return flat[np.repeat(at[spots] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One per worker and file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (if kept), n_ids, ids_crc32 (little-endian 32-bit ids), decoded_crc32 (UTF-8 of the ids
    decoded again) and round_trip: whether that is the text.

    path: the model's file, the same on every machine. A text that is null or empty has no ids. U+2581 in
    a text means a space, as the model writes it, so it comes back as one. Repeated rows and null ids stay
    as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            data, offsets = textscan.utf8(batch.column("text"))
            for first, last in textscan.blocks(offsets, TEXTS):
                rows = batch.slice(first, last - first)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids, at = pieces.encode(texts)
                back = pieces.decode(ids, at)
                lists = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = {
                    "doc_id": rows.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    "n_ids": pa.array(np.diff(at)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in back], pa.int64()),
                    "round_trip": pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                }
                if not keep_ids:
                    del columns["ids"]
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id long, {'ids array<int>, ' if keep_ids else ''}n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
