"""Packing documents into training windows by best-fit decreasing.

Every document becomes ids and one end id. What is longer than a window is first cut into full
windows; the rest of it, or the whole short document, goes to the open window with the least room
that still takes it, the longest pieces first. Pieces are dealt evenly to groups of bounded size, and
each group is packed on its own, so no task ever sees more than a group.

A null or empty text is the end id alone. Repeated rows are packed once each; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetframe.llm.common import Memo, map_chunks, texts_of, vocabulary_path
from fleetframe.session import pin

WINDOW = 2048
END_ID = 1
# Pieces that one task packs; the few half-empty windows at the end of a group are its only cost.
GROUP_PIECES = 20_000
WORDS_KEPT = 1_000_000
WORD_KEPT_BYTES = 64

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


# Marks at the end of a word. After a letter or digit they are tokenized apart from it, so the word
# and its marks can be looked up on their own.
_MARKS = b".,!$%&*#"
_ENDS_PLAIN = re.compile(rb"(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])\Z")
# Words of lower-case Latin letters alone: already normal, and one piece for the merges.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it is printable in
    Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of texts, word by word.

    No token reaches across a space, tab or line break, so the ids of a text are those of its words
    in order, and the ids of frequent words are kept.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.words = Memo(self._word, WORDS_KEPT, WORD_KEPT_BYTES)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8")
        # The vocabulary has no upper case; only the names of special tokens tell the cases apart.
        words = (raw if b"<|" in raw else raw.lower()).split()
        return b"".join(self.words.all(words))

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if len(core) == len(word) or not _ENDS_PLAIN.search(core):
            return self._tokenized(word)
        return b"".join(self.words.all((core, word[len(core) :])))

    def _tokenized(self, word: bytes) -> bytes:
        if _LETTERS.fullmatch(word):
            ids = [t.id for t in self.merges.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def opened(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class OpenWindows:
    """Windows by remaining room: a segment tree over the room counts the windows below each node."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.stacks[room].append(window)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``size``, and its room."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            # Climb until a right neighbour has windows, then go down to its leftmost one.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not count[node]
        room = node - self.leaves
        self._add(room, -1)
        return self.stacks[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; the lengths come in falling order."""
    opened_windows, numbers, offsets, used = OpenWindows(window), [], [], 0
    for length in lengths:
        fit = opened_windows.take(length)
        if fit is None:
            number, room = used, window
            used += 1
        else:
            number, room = fit
        numbers.append(number)
        offsets.append(window - room)
        opened_windows.put(number, room - length)
    return numbers, offsets


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """The full windows and the rest of every document, with a checksum of their ids."""
    path = vocabulary

    def start():
        coder = opened(path or vocabulary_path("word_bpe_49k.json"))
        end_id = np.array([END_ID], dtype="<u4").tobytes()

        def step(columns):
            rows = []
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                ids = coder.ids(text) + end_id
                total = len(ids) // 4
                for low in range(0, total, window):
                    part = ids[4 * low : 4 * (low + window)]
                    rows.append((doc_id, low, len(part) // 4, zlib.crc32(part), total))
            return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows)))

        return step

    return map_chunks(texts_of(docs), start, PIECES)


def packed(
    docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut = pin(pieces(docs, vocabulary, window))
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        numbers, offsets = best_fit_decreasing(part["length"].tolist(), window)
        # Numbers of different groups never meet: the group is the remainder.
        part["sequence_id"] = np.array(numbers, dtype=np.int64) * groups + int(key[0])
        part["offset"] = offsets
        return part.drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(pack, PACKED)
