"""Byte-level BPE over whole columns: each distinct piece of text between spaces is encoded once a worker.

No token of the vocabulary's split crosses a space that stands between two characters that are no white space, so
such a space and what follows it up to the next one encode alike wherever they stand. Texts where that doesn't hold
of every space, and texts with a special token, go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

from querent.llm.textscan import _BASE, _INVERSE, _RANDOM, mix, power_table

#: Fixed value: the split of this kind of vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and bytes of them, that a worker keeps.
CACHE, CACHE_BYTES = 1_500_000, 48_000_000
#: What may stand in pieces joined by spaces only if one is _bound: white space at an end, a special token, bytes that are no UTF-8.
_ODD = re.compile(r" \s|\s |<\||�")


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs end to end, each from its start."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class SpanCache:
    """What learn gives for spans of bytes, kept by their hash; a span whose bytes aren't those kept is told apart.

    learn: pieces to (ids end to end, how many each has, whether a piece has none of its own).
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.learn = learn
        self.reset()

    def reset(self) -> None:
        self.key, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size, self.odd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        whole = data.tobytes()
        ids, sizes, odd = self.learn([whole[a : a + n] for a, n in zip(start.tolist(), length.tolist())])
        place = np.searchsorted(self.key, keys)
        number = len(self.start) + np.arange(len(keys))
        self.key, self.number = np.insert(self.key, place, keys), np.insert(self.number, place, number)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.odd = np.concatenate([self.size, sizes]), np.concatenate([self.odd, odd])
        self.at = np.concatenate([self.at, len(self.bytes) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, data[runs(start, length)]])

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spans' ids end to end, how many each has, and which spans have to be told otherwise."""
        if len(self.key) > CACHE or len(self.bytes) > CACHE_BYTES:
            self.reset()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * power_table(_BASE, len(data)))])
        length = end - start
        hashed = mix((sums[end] - sums[start]) * power_table(_INVERSE, len(data) + 1)[start] + length.astype(np.uint64))
        keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, keys), max(len(self.key) - 1, 0))
        fresh = self.key[at] != keys if len(self.key) else np.ones(len(keys), bool)
        if fresh.any():
            self._add(keys[fresh], data, start[first[fresh]], length[first[fresh]])
        number = self.number[np.searchsorted(self.key, keys)][inverse]
        other = self.odd[number] | (self.length[number] != length)
        same = np.where(other, 0, length)
        differs = data[runs(start, same)] != self.bytes[runs(self.at[number], same)]
        if differs.any():
            other[np.searchsorted(np.cumsum(same), np.flatnonzero(differs), side="right")] = True
        sizes = np.where(other, 0, self.size[number])
        return self.ids[runs(self.start[number], sizes)], sizes, other


def alphabet() -> dict[str, int]:
    """Bytes by the characters that write them: printable ones by themselves, the others by those from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _bound(text: str) -> bool:
    """Whether the ids of a piece depend on what stands beside it, or need the tokenizer itself."""
    return not text or text[0].isspace() or text[-1].isspace() or _ODD.search(text) is not None


class ByteTokenizer:
    """The ids that the tokenizer in the file gives, with add_special_tokens off."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        code, special, setup = alphabet(), set(self.full.get_added_tokens_decoder()), str(self.full.pre_tokenizer)
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ranks = {bytes(code[c] for c in t): n for t, n in model["vocab"].items() if n not in special}
        # merging by number is merging in the file's order only where tokens are numbered in that order
        self.plain = self.full.normalizer is None and "use_regex=True" in setup and "add_prefix_space=False" in setup and merged == sorted(merged)
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.cache = SpanCache(self._learn)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a space."""
        odd, own = np.zeros(len(pieces), bool), pieces
        text = (b" " + b" ".join(own)).decode("utf-8", "replace")
        if _ODD.search(text + " "):
            odd = np.array([_bound(p.decode("utf-8", "replace")) for p in pieces])
            own = [p for p, o in zip(pieces, odd.tolist()) if not o]
            text = (b" " + b" ".join(own)).decode()
        sizes, ids = np.zeros(len(pieces), np.int64), np.zeros(0, np.int32)
        if own:
            ids = np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)) + 1
            sizes[~odd] = np.diff(ends, prepend=0)
        return ids, sizes, odd

    def _slow(self, text: bytes) -> np.ndarray:
        return np.array(self.full.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the texts' offsets in them."""
        whole, rows = data.tobytes(), len(offsets) - 1
        if not self.plain:
            return _joined([self._slow(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        space = np.flatnonzero(data == 32)
        row = np.searchsorted(offsets, space, side="right") - 1
        end = np.minimum(np.append(space[1:], len(data)), offsets[row + 1]) if len(space) else space
        ids, sizes, odd = self.cache.look_up(data, space + 1, end)
        slow = np.bincount(row[odd], minlength=rows) > 0
        some = np.bincount(row, sizes, rows).astype(np.int64)
        first = np.searchsorted(space, offsets[:-1])
        heads, lists, at = np.append(space, len(data))[first], [], 0
        for k, (lo, hi, head) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), heads.tolist())):
            text = whole[lo : min(head, hi)].decode("utf-8", "replace")
            own = ids[at : at + some[k]]
            at += int(some[k])
            if slow[k] or text and (text[-1].isspace() or _ODD.search(text)):
                lists.append(self._slow(whole[lo:hi]))
            else:
                lists.append(np.concatenate([np.array(self.fast.encode_ordinary(text), np.int32), own]) if text else own)
        return _joined(lists)


def _joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *lists]), np.cumsum([0, *map(len, lists)])


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One per worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]
