import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from fleetframe.llm import byte_bpe
from fleetframe.llm.common import vocabulary_path
from tests.llm.conftest import by_id

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.opened(vocabulary_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(coder, reference, text):
    ids = coder.encode(text)
    return np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_random_texts(coder, reference):
    rng = random.Random(4)
    newer = [chr(c) for c in list(byte_bpe._newer_characters())[:40]]
    pool = newer + list("aeiou  \n\t'sté=+-—漢字 \x85\x1c😀ß0123٣")
    for i in range(3000):
        if i % 3 == 0:
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        elif i % 3 == 1:
            text = "".join(chr(rng.choice((rng.randint(0, 0x2FF), rng.randint(0xE000, 0x10FFFF)))) for _ in range(20))
        else:
            text = "".join(rng.choice("abcdeth =*-\n") for _ in range(rng.randint(0, 200)))
        assert same(coder, reference, text), repr(text)


def test_bundled_texts(coder, reference, bundled):
    for row in bundled("documents").select("text").collect():
        assert same(coder, reference, row["text"])


def test_long_pieces(coder, reference):
    for text in ("a" * 100_000, "=" * 50_000 + " " * 50_000, "ab" * 50_000):
        assert coder.decode(coder.encode(text)) == text.encode()
    assert same(coder, reference, "abc" * 500)


def test_query_columns_and_odd_rows(make_docs, odd_rows, coder):
    rows = byte_bpe.encoded(make_docs(odd_rows, clashing=True)).collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        assert row["n_tokens"] * 4 == len(row["ids"])
        assert row["ids_sha256"] == hashlib.sha256(row["ids"]).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(row["decoded"]).hexdigest()
    got = by_id(byte_bpe.encoded(make_docs([(1, None), (2, "two words")])))
    assert got[1]["n_tokens"] == 0 and bytes(got[2]["decoded"]) == b"two words"
    assert byte_bpe.encoded(make_docs([])).count() == 0
