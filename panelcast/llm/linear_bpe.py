"""Merge-file BPE by backtracking over longest tokens, and decoding by an offset table."""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import LOOSE_SPACE, segments_of
from panelcast.llm.text import whole

# Fixed value: how byte-level vocabularies split a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bounds of what a worker remembers, in bytes and in pairs; results do not depend on them.
REMEMBERED_BYTES = 192 * 1024 * 1024
REMEMBERED_PAIRS = 1_000_000
ENTRY_BYTES = 200
DECODED_AT_ONCE = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary files of byte-level tokenizers:
    printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = (b for b in range(256) if chr(b) not in letters)
    return {**letters, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """The merges of one tokenizer file, checked to be of the kind that the encoder is exact for.

    Tokens are held as Latin-1 strings, a character per byte. A merge may use only tokens that
    single bytes or earlier merges make, and no two merges may make one token; then the order of
    the merges is the order in which tokens come to be.
    """

    def __init__(self, content: str | bytes):
        import ahocorasick

        file = json.loads(content)
        model = file["model"]
        self._refuse_others(file, model)
        letter = byte_letters()
        ids = {
            "".join(chr(letter[c]) for c in token): i for token, i in model["vocab"].items()
        }
        self.born = {ids[chr(b)]: -1 for b in range(256)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (
                "".join(chr(letter[c]) for c in part)
                for part in (merge.split(" ") if isinstance(merge, str) else merge)
            )
            pair, token = (ids[left], ids[right]), ids[left + right]
            if token in self.born or pair[0] not in self.born or pair[1] not in self.born:
                raise ValueError(f"merge {rank} is out of order or makes a token again")
            self.born[token], self.parts[token], self.merges[pair] = rank, pair, rank
        self._known_pairs: dict[int, bool] = {}
        # Tokens that the merges do not make of their own bytes never occur in an encoding.
        alive: set[int] = set()
        for i in sorted(self.born, key=self.born.__getitem__):
            if self._made(i, alive):
                alive.add(i)
        made = {t: i for t, i in ids.items() if i in alive}
        n = max([*ids.values(), *self.added.values()]) + 1
        self.size, self.shorter = [0] * n, [-1] * n
        self.automaton = ahocorasick.Automaton()
        for token, i in made.items():
            self.size[i] = len(token)
            self.automaton.add_word(token, (i, len(token) - 1))
            self.shorter[i] = next(
                (made[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in made), -1
            )
        self.automaton.make_automaton()
        spelled = {i: t.encode("latin-1") for t, i in ids.items()}
        spelled.update((i, t.encode()) for t, i in self.added.items())
        lengths = np.zeros(n + 2, dtype=np.int64)
        for i, raw in spelled.items():
            lengths[i + 1] = len(raw)
        self.starts = np.cumsum(lengths)  # The last token, n, is empty: ids that are none.
        self.spelling = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)

    def _refuse_others(self, file: dict, model: dict) -> None:
        before = file.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE"
            and not any(
                model.get(k)
                for k in (
                    "dropout",
                    "unk_token",
                    "continuing_subword_prefix",
                    "end_of_word_suffix",
                    "byte_fallback",
                    "ignore_merges",
                )
            )
            and file.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and (file.get("decoder") or {}).get("type") == "ByteLevel"
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are understood")
        self.added = {}
        for token in file.get("added_tokens") or []:
            if any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
                raise ValueError(f"added token with conditions: {token['content']!r}")
            self.added[token["content"]] = token["id"]

    def _made(self, token: int, alive: set[int]) -> bool:
        """Whether a token is the encoding of its own bytes: its two halves are of their own, and
        do not join across their border before the last merge does."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        if left not in alive or right not in alive:
            return False
        return not self._joined_before(left, right, self.born[token])

    def _joined_before(self, left: int, right: int, limit_left: int) -> bool:
        """Whether a merge reaches over the border of two tokens before they are complete.

        Going back in time, the younger of the two tokens at the border is taken apart; what
        stands at the border then had until that merge to join with its neighbour. Of equal
        merges the leftmost comes first: one that absorbs the left token comes before a join
        over the border, one that absorbs the right token after it.
        """
        merges, born, parts = self.merges, self.born, self.parts
        limit_right = limit_left
        while True:
            rank = merges.get((left, right))
            if rank is not None and rank < limit_left and rank <= limit_right:
                # At the start both limits are the same; there a join at the limit is the merge
                # of the two tokens itself.
                if not (rank == limit_right == limit_left):
                    return True
            if born[left] < 0 and born[right] < 0:
                return False
            if born[left] > born[right]:
                limit_left, left = born[left], parts[left][1]
            elif born[left] < born[right]:
                limit_right, right = born[right], parts[right][0]
            else:
                # The same token twice: the left one is complete first.
                limit_right, right = born[right], parts[right][0]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: encoded together, they stay as they are."""
        key = left << 32 | right
        known = self._known_pairs.get(key)
        if known is None:
            if len(self._known_pairs) >= REMEMBERED_PAIRS:
                self._known_pairs.clear()
            known = not self._joined_before(left, right, 1 << 62)
            self._known_pairs[key] = known
        return known

    def encode(self, raw: str) -> array:
        """Ids of one pre-token, given as Latin-1.

        The sequence found so far is always the encoding of the bytes it covers, as all neighbours
        fit. From its end the longest token is tried, then its shorter beginnings; where none
        leads on, the place is closed for good, and the token before gives way to a shorter one.
        """
        longest = [-1] * len(raw)
        for end, (token, reach) in self.automaton.iter(raw):
            longest[end - reach] = token
        fit, size, shorter, known = self.fit, self.size, self.shorter, self._known_pairs
        closed: set[int] = set()
        out, at, end = array("i"), 0, len(raw)
        while at < end:
            token = longest[at]
            while True:
                if token < 0:
                    closed.add(at)
                    token = out.pop()
                    at -= size[token]
                elif at + size[token] not in closed and (
                    not out or known.get(out[-1] << 32 | token) or fit(out[-1], token)
                ):
                    break
                token = shorter[token]
            out.append(token)
            at += size[token]
        return out


class LinearCodec:
    """A vocabulary and the words met so far, in one worker."""

    def __init__(self, content: str | bytes):
        import regex

        self.vocabulary = Vocabulary(content)
        self.pattern = regex.compile(PRE_TOKEN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.spaced: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.remembered = 0

    def _ids(self, piece: str) -> bytes:
        """Packed ids of one pre-token."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.vocabulary.encode(piece.encode().decode("latin-1")).tobytes()
            self._remember(self.known, piece, ids)
        return ids

    def _after_space(self, word: str) -> bytes:
        """Packed ids of what stands between two single spaces, with the space before it."""
        if word.isalpha():
            raw = (" " + word).encode().decode("latin-1")
            ids = self.vocabulary.encode(raw).tobytes()
        else:
            ids = b"".join(map(self._ids, self.pattern.findall(" " + word)))
        self._remember(self.spaced, word, ids)
        return ids

    def _remember(self, kept: dict[str, bytes], piece: str, ids: bytes) -> None:
        self.remembered += ENTRY_BYTES + 4 * len(piece) + len(ids)
        if self.remembered > REMEMBERED_BYTES:
            self.known.clear()
            self.spaced.clear()
            self.remembered = 0
        else:
            kept[piece] = ids

    def _plain(self, text: str) -> list[bytes]:
        """Packed ids of a text without added tokens.

        A single space between two other characters always begins a match of the pattern, and
        what stands between two such spaces is split alike wherever it occurs.
        """
        out = []
        for segment in segments_of(text):
            if LOOSE_SPACE.search(segment):
                out += map(self._ids, self.pattern.findall(segment))
                continue
            first, *rest = segment.split(" ")
            out += map(self._ids, self.pattern.findall(first))
            spaced = self.spaced
            for word in rest:
                out.append(spaced.get(word) or self._after_space(word))
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; added tokens are found first, as such."""
        if self.added is None:
            return b"".join(self._plain(text))
        out = []
        for i, part in enumerate(self.added.split(text)):
            if i % 2:
                out.append(array("i", [self.vocabulary.added[part]]).tobytes())
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from one run of all spellings by their offsets."""
        starts, spelling = self.vocabulary.starts, self.vocabulary.spelling
        none = len(starts) - 2
        parts = []
        for start in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[start : start + DECODED_AT_ONCE].astype(np.int64)
            part[(part < 0) | (part > none)] = none
            begin = starts[part]
            length = starts[part + 1] - begin
            before = np.cumsum(length) - length
            at = np.arange(int(length.sum()), dtype=np.int64)
            parts.append(spelling[at + np.repeat(begin - before, length)].tobytes())
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.spell(ids).decode("utf-8", "replace")


def linear_codec(content: bytes) -> LinearCodec:
    """One codec per worker process and file, kept between tasks."""
    name = "_linear_bpe"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (len(content), hash(content))
    if key not in kept.setdefault("codecs", {}):
        kept["codecs"][key] = LinearCodec(content)
    return kept["codecs"][key]


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), flat)


class LinearBpe:
    """Column functions for one tokenizer file.

    ``path`` names a file on the driver in the JSON format of the tokenizers library; its bytes, a
    few MB whatever the corpus, are broadcast.

    A null text counts as empty and has no ids. Texts are encoded whole: a long one is taken
    segment by segment, a long run without spaces in one linear pass. Each row stands by itself,
    so repeated rows, empty tables and further columns of any name make no difference.
    """

    MOST_BYTES = 64 * 1024 * 1024

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read(self.MOST_BYTES + 1)
        if len(content) > self.MOST_BYTES:
            raise ValueError(f"a tokenizer file of over {self.MOST_BYTES} bytes: {path}")
        shared = spark.sparkContext.broadcast(content)

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = linear_codec(shared.value)
            for texts in batches:
                yield _lists([codec.encode(t) for t in texts.to_pylist()])

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = linear_codec(shared.value)
            for lists in batches:
                yield pa.array(
                    [codec.decode(i.values.fill_null(-1).to_numpy()) for i in lists], pa.string()
                )

        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = linear_codec(shared.value)
            for texts in batches:
                packed = [codec.encode(t) for t in texts.to_pylist()]
                decoded = [codec.decode(np.frombuffer(p, dtype=np.int32)) for p in packed]
                yield pa.StructArray.from_arrays(
                    [_lists(packed), pa.array(decoded, pa.string())], names=["ids", "decoded"]
                )

        self._encode = F.arrow_udf(encode, "array<int>")
        self._decode = F.arrow_udf(decode, "string")
        self._both = F.arrow_udf(both, "ids array<int>, decoded string")

    def encode(self, text: Column | str) -> Column:
        """The ids of a text, added tokens found in it included."""
        return self._encode(whole(text))

    def encode_and_decode(self, text: Column | str) -> Column:
        """``ids`` as of ``encode`` and ``decoded`` as of ``decode``, by one Python worker."""
        return self._both(whole(text))

    def decode(self, ids: Column | str) -> Column:
        """The text that ids stand for, special tokens as they are spelled; ids that are none
        (null included) stand for nothing, bytes that are no UTF-8 for U+FFFD. Null for null."""
        ids = F.col(ids) if isinstance(ids, str) else ids
        empty = F.array().cast("array<int>")
        return F.when(ids.isNotNull(), self._decode(F.coalesce(ids, empty)))


def joined_ids(ids: Column | str) -> Column:
    """Decimal ids with commas between them."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(ids.cast("array<string>"), ",")
