import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fleetframe.llm import packing
from fleetframe.llm.common import vocabulary_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def test_ids_as_the_tokenizer(tokenizer, bundled):
    coder = packing.opened(vocabulary_path("word_bpe_49k.json"))
    texts = [r["text"] for r in bundled("documents").select("text").collect()]
    rng = random.Random(5)
    pool = list("aeiou  \n\t\r\x0b\x0c'sté=+-—漢字 \x85\x1c😀ß0123٣İΣσ́̈　가ᄀ.!,") + ["<|endoftext|>", "'s", "THE!!"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == want, repr(text[:80])


def test_best_fit_against_a_plain_search():
    rng = random.Random(6)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        numbers, offsets = packing.best_fit_decreasing(lengths, 60)
        room = []
        for length, number, offset in zip(lengths, numbers, offsets):
            fits = [r for r in room if r >= length]
            if fits:
                assert room[number] == min(fits) and offset == 60 - room[number]
            else:
                assert number == len(room) and offset == 0
                room.append(60)
            room[number] -= length


def check(docs, rows, tokenizer, window=packing.WINDOW):
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = ids[r["doc_id"]][0]
        part = np.array(mine[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(mine)
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append((r["start"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for doc_id, copies in ids.items():
        assert sum(n for _, n in seen[doc_id]) == sum(map(len, copies))
    return sequences


def test_bundled_documents(tokenizer, bundled):
    docs = bundled("documents").select("doc_id", "text")
    sequences = check(docs, packing.packed(docs).collect(), tokenizer)
    held = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(held) / (len(held) * packing.WINDOW) > 0.97
    check(docs, packing.packed(docs, group_pieces=40).collect(), tokenizer)


def test_odd_rows(make_docs, odd_rows, tokenizer):
    docs = make_docs(odd_rows, clashing=True)
    check(docs, packing.packed(docs).collect(), tokenizer)
    assert packing.packed(make_docs([])).count() == 0
