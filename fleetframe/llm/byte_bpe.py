"""Byte-level BPE: linear-time encoding by backtracking over longest matches, and decoding.

The ids equal those of merging by rank. A sequence of tokens is what merging gives exactly
if every two neighbours are what merging gives for their joined bytes. So the encoder takes
the longest token at each place, keeps it if it is compatible with the one before, and
otherwise tries the next shorter one or takes the last token back. Places from which the rest
was found to be impossible are marked, which bounds the work by the length.

A null or empty text has no ids. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from fleetframe.llm.common import Memo, map_chunks, texts_of, vocabulary_path

# Distinct pieces whose ids a worker keeps.
PIECES_KEPT = 1_200_000
PAIRS_KEPT = 2_000_000
# Pieces above this length are encoded without being kept.
PIECE_KEPT_CHARS = 64


class ByteBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves = self._halves()
        self.shorter = self._shorter()
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo(self.encode_piece, PIECES_KEPT, PIECE_KEPT_CHARS)

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes a token; single bytes have none.

        The last merge joins the two parts left when merging stops one rank earlier.
        """
        halves = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                left, right = self._merged(token, rank)
                halves[rank] = (left, right)
        return halves

    def _merged(self, token: bytes, below: int) -> list[int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                raise ValueError(f"rank {below} cannot be reached by merging")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _shorter(self) -> dict[int, int]:
        """For each token the longest other token that it starts with; -1 where there is none."""
        shorter = {}
        ranks = self.ranks
        for token, rank in ranks.items():
            shorter[rank] = next(
                (ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1
            )
        return shorter

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two tokens again."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges beside the border, the latest first, and look for a merge across the border
        that would have come before. Of equal ranks the leftmost is merged first."""
        ranks, of, halves = self.ranks, self.token_bytes, self.halves
        limit = len(ranks) + 1
        while True:
            if ranks.get(of[left] + of[right], limit) < limit:
                return False
            if max(left, right) not in halves:
                return True
            if left > right:
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if not n:
            return []
        longest = self._longest_at_all_places(piece)
        of, shorter, compatible = self.token_bytes, self.shorter, self.compatible
        dead = bytearray(n + 1)
        ids: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            end = place + len(of[token])
            if not dead[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                place = end
                if place < n:
                    token = longest[place]
                continue
            token = shorter[token]
            while token < 0:
                # Nothing fits here after the last token: take that one back.
                dead[place] = 1
                last = ids.pop()
                place -= len(of[last])
                token = shorter[last]
        return ids

    def _longest_at_all_places(self, piece: bytes) -> list[int]:
        """All matches of the automaton in one pass; the longest by its start."""
        best = [0] * len(piece)
        longest = [0] * len(piece)
        of = self.token_bytes
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            size = len(of[rank])
            start = end + 1 - size
            if size > best[start]:
                best[start], longest[start] = size, rank
        return longest

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        return np.array(self.encode_bytes(piece.encode("utf-8")), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces.all(pieces_of(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def _splitter():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _newer_characters() -> dict[int, str]:
    """Letters and digits of this regex module that the tokenizer's own tables do not have yet."""
    import tiktoken

    newer = "".join(
        c
        for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000)))
        if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)
    )
    single = {bytes([b]): b for b in range(256)}
    known = set()
    for kind in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding("own", pat_str=kind, mergeable_ranks=single, special_tokens={})
        known |= set(own.decode(own.encode_ordinary(newer)))
    return {ord(c): "\ue000" for c in newer if c not in known}


# Anything else may hold characters that were assigned lately.
_UNSETTLED = regex.compile(r"[^\u0000-\u0557\u2010-\u206f\u3000-\u9fff\uac00-\ud7a3]")


def pieces_of(text: str) -> list[str]:
    """The pieces that are merged separately."""
    split = _splitter()
    if text.isascii() or not _UNSETTLED.search(text):
        return split.findall(text)
    newer = _newer_characters()
    plain = text.translate(newer)
    return [text[m.start() : m.end()] for m in split.finditer(plain)]


@functools.cache
def opened(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the decoded bytes of every text."""
    path = vocabulary

    def start():
        coder = opened(path or vocabulary_path("byte_bpe_50k.tiktoken"))

        def step(columns):
            ids = [coder.encode(t) for t in columns["text"]]
            back = [coder.decode(i) for i in ids]
            return {
                "doc_id": columns["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids": ids if keep_ids else [None] * len(ids),
                "decoded": back if keep_ids else [None] * len(ids),
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            }

        return step

    ddl = "doc_id bigint, n_tokens bigint, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"
    return map_chunks(texts_of(docs), start, ddl)
