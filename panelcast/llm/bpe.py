"""Byte-level BPE with a rank queue of hierarchical bitmaps."""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.text import whole

# Bytes of pre-tokens already encoded that each Python worker remembers, and what an entry takes
# beside its characters and ids.
REMEMBERED_BYTES = 160 * 1024 * 1024
ENTRY_BYTES = 200
# Characters and bytes handled at once; they bound memory, not what is encoded.
SEGMENT = 1_000_000
ENCODED_AT_ONCE = 2_000_000
MERGED_AT_ONCE = 2_000_000

LOOSE_SPACE = re.compile(r" (?=\s|$)")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class RankQueue:
    """Positions by merge rank, the smallest rank first.

    Three levels of 64-bit words tell which ranks hold positions: a bit of one level stands for a
    word of the level below, so the next rank takes one find-first-set per level, however
    many positions wait.
    """

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.middle = [0] * ((n_ranks >> 12) + 1)
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions go to the buckets of their ranks; a rank below zero is none."""
        some = ranks >= 0
        ranks, positions = ranks[some], positions[some]
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
        elif not len(ranks):
            return
        starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[start:end])
                continue
            self.buckets[rank] = [positions[start:end]]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, np.ndarray]:
        """The smallest rank and all positions of its bucket, from left to right."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.middle[high]
        high = high << 6 | ((word & -word).bit_length() - 1)
        word = self.low[high]
        rank = high << 6 | ((word & -word).bit_length() - 1)
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.middle[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        chunks = self.buckets.pop(rank)
        positions = np.sort(chunks[0] if len(chunks) == 1 else np.concatenate(chunks))
        if len(positions) > 1:
            positions = positions[np.concatenate(([True], positions[1:] != positions[:-1]))]
        return rank, positions


class Codec:
    """The vocabulary of one rank file, and the pre-tokens met so far."""

    NONE = (1 << 20) - 1

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if max(self.tokens, default=0) >= self.NONE:
            raise ValueError("ranks must be below 2^20 - 1")
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.tokens, default=0) + 1)
        self.pair_keys = None
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.remembered = 0

    def _prepare(self) -> None:
        """Ranks of pairs of tokens, and of pairs of bytes."""
        ranks = self.ranks
        keys, joined = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    joined.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], 1 << 62)
        self.pair_ranks = np.append(np.array(joined, dtype=np.int32)[order], np.int32(-1))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self._rank_of(self.bytes[left], self.bytes[right]).astype(np.int32)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, all joined together in one queue.

        Of all adjacent pairs the one of least rank is joined, the leftmost first, until none has
        a rank. The pre-tokens lie one behind the other in a linked list in which no pair reaches
        over an end, so a bucket's positions can be joined at once. Should a join make a pair of
        a smaller rank, the order within its pre-token matters; such a one is done over by itself.
        """
        if self.pair_keys is None:
            self._prepare()
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(lengths.sum())
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        token = np.empty(n + 1, dtype=np.int32)
        token[:n] = self.bytes[raw]
        token[n] = self.NONE
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        ends = np.cumsum(lengths) - 1
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[ends[:-1] + 1] = n
        before[0] = n
        alive = np.ones(n, dtype=bool)
        waiting = np.full(n + 1, -1, dtype=np.int32)
        waiting[: n - 1] = self.byte_pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        waiting[ends] = -1
        queue = self.queue
        queue.push(waiting[:n], np.arange(n, dtype=np.int32))
        unruly: set[int] = set()
        while queue.top:
            rank, at = queue.pop()
            at = at[waiting[at] == rank]  # The others are stale: their pair has changed since.
            if not len(at):
                continue
            if len(at) > 1:
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if follows.any():
                    run = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(follows, 0, run))
                    at = at[(run - first) % 2 == 0]
            joined = after[at]
            end = after[joined]
            crowded = len(at) > 1 and (end[:-1] == at[1:]).any()
            # Where two joins meet, the pair that stands between them for a moment counts as well.
            between = self._rank_of(np.full(len(at), rank), token[end]) if crowded else None
            token[at] = rank
            after[at] = end
            before[end] = at
            alive[joined] = False
            waiting[joined] = -1
            left = before[at]
            right_rank = self._rank_of(token[at], token[end])
            left_rank = self._rank_of(token[left], token[at])
            waiting[at] = right_rank
            waiting[left] = left_rank
            waiting[n] = -1
            sooner = ((right_rank >= 0) & (right_rank < rank)) | (
                (left_rank >= 0) & (left_rank < rank)
            )
            if between is not None:
                sooner |= (between >= 0) & (between < rank)
            if sooner.any():
                unruly.update(owner[at[sooner]].tolist())
            queue.push(np.concatenate((right_rank, left_rank)), np.concatenate((at, left)))
        packed = token[:n][alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(pieces))) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops], stops)]
        for i in unruly:
            out[i] = self._merge_alone(pieces[i])
        return out

    def _merge_alone(self, piece: bytes) -> bytes:
        """As ``merge``, one join at a time: from each bucket its leftmost position only."""
        queue, n = self.queue, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waiting = [self.ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1, -1]
        queue.push(np.array(waiting[:n]), np.arange(n))
        while queue.top:
            rank, at = queue.pop()
            current = [i for i in at.tolist() if waiting[i] == rank]
            if not current:
                continue
            if len(current) > 1:
                queue.push(np.full(len(current) - 1, rank), np.array(current[1:]))
            i = current[0]
            joined = after[i]
            after[i] = end = after[joined]
            waiting[joined] = -1
            before[min(end, n - 1)] = i
            changed = [i] if before[i] < 0 else [i, before[i]]
            for j in changed:
                right = after[j]
                bound = after[right] if right < n else n + 1
                waiting[j] = self.ranks.get(piece[j:bound], -1) if right < n else -1
            queue.push(np.array([waiting[j] for j in changed]), np.array(changed))
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i = after[i]
        ids = [self.ranks[piece[i : after[i]]] for i in starts]
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        """Encode pre-tokens not met before, a bounded number of bytes at a time."""
        group, size = [], 0
        for piece in missing:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
                continue
            group.append((piece, raw))
            size += len(raw)
            if size >= MERGED_AT_ONCE:
                self.known.update(zip([p for p, _ in group], self.merge([r for _, r in group])))
                group, size = [], 0
        if group:
            self.known.update(zip([p for p, _ in group], self.merge([r for _, r in group])))

    def _forget(self) -> None:
        if self.remembered > REMEMBERED_BYTES:
            self.known.clear()
            self.spaced.clear()
            self.remembered = 0

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment of a bounded number of characters in all.

        A single space between two other characters always begins a match of the pattern, and
        whatever stands between two such spaces is split alike wherever it occurs. So a piece
        that was met before needs no second look at its matches.
        """
        cut, loose, missing = [], set(), set()
        for segment in segments:
            if LOOSE_SPACE.search(segment):
                pieces = self.pattern.findall(segment)
                missing.update(pieces)
                cut.append((pieces, None))
            else:
                first, *rest = segment.split(" ")
                pieces = self.pattern.findall(first)
                missing.update(pieces)
                loose.update(rest)
                cut.append((pieces, rest))
        split = {p: self.pattern.findall(" " + p) for p in loose - self.spaced.keys()}
        missing.update(*split.values())
        new = missing - self.known.keys()
        self._learn(new)
        known, spaced = self.known, self.spaced
        for piece, matches in split.items():
            spaced[piece] = b"".join([known[m] for m in matches])
        self.remembered += sum(ENTRY_BYTES + 4 * len(p) + len(known[p]) for p in new)
        self.remembered += sum(ENTRY_BYTES + 4 * len(p) + len(spaced[p]) for p in split)
        out = []
        for pieces, rest in cut:
            ids = [known[p] for p in pieces]
            if rest:
                ids += [spaced[p] for p in rest]
            out.append(b"".join(ids))
        self._forget()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0
        for i, text in enumerate(texts):
            for segment in segments_of(text):
                group.append((i, segment))
                size += len(segment)
                if size >= ENCODED_AT_ONCE:
                    for (j, _), ids in zip(group, self.encode_segments([s for _, s in group])):
                        out[j].append(ids)
                    group, size = [], 0
        for (j, _), ids in zip(group, self.encode_segments([s for _, s in group])):
            out[j].append(ids)
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def segments_of(text: str) -> Iterator[str]:
    """A long text cut before single spaces, where matches of the pattern begin anyway."""
    start = 0
    while len(text) - start > SEGMENT:
        found = LONE_SPACE.search(text, start + SEGMENT)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, kept between tasks."""
    name = "_byte_level_bpe"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (len(rank_file), hash(rank_file), pattern)
    if key not in kept.setdefault("codecs", {}):
        kept["codecs"][key] = Codec(rank_file, pattern)
    return kept["codecs"][key]


class ByteBpe:
    """Column functions for one vocabulary.

    ``path`` names a rank file on the driver (base64 token and rank per line); its bytes, a few MB
    at most whatever the corpus, are broadcast.
    """

    MOST_BYTES = 64 * 1024 * 1024

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read(self.MOST_BYTES + 1)
        if len(content) > self.MOST_BYTES:
            raise ValueError(f"a rank file of over {self.MOST_BYTES} bytes: {path}")
        shared = spark.sparkContext.broadcast(content)

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = codec(shared.value, pattern)
            for texts in batches:
                yield pd.Series(own.encode(texts.tolist()), dtype=object)

        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = codec(shared.value, pattern)
            for packed in batches:
                yield pd.Series([own.decode(p) for p in packed], dtype=object)

        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = codec(shared.value, pattern)
            for texts in batches:
                ids = own.encode(texts.tolist())
                yield pd.DataFrame({"ids": ids, "decoded": [own.decode(p) for p in ids]})

        self._both = F.pandas_udf(both, "ids binary, decoded binary")
        self._encode = F.pandas_udf(encode, "binary")
        self._decode = F.pandas_udf(decode, "binary")

    def encode(self, text: Column | str) -> Column:
        """Ids of a text as packed little-endian unsigned 32-bit integers.

        Each match of the pattern is encoded by itself, without special tokens. A null or empty
        text has no ids (an empty binary).
        """
        return self._encode(whole(text))

    def encode_and_decode(self, text: Column | str) -> Column:
        """``ids`` as of ``encode`` and ``decoded`` as of ``decode``, by one Python worker."""
        return self._both(whole(text))

    def decode(self, ids: Column | str) -> Column:
        """The bytes that packed ids stand for; null for null."""
        ids = F.col(ids) if isinstance(ids, str) else ids
        return F.when(ids.isNotNull(), self._decode(F.coalesce(ids, F.lit(b""))))


def n_tokens(ids: Column | str) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
