import random

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicework.llm import bpe
from sluicework.llm import kernels as K
from sluicework.llm.secrets import PATTERN

CODEC = bpe.codec()
ORACLE = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def encode(texts):
    body, at = K.texts(pa.array(texts, pa.string()), lower=False)
    ids, count = CODEC.encode(body, at)
    assert (CODEC.decode(ids) == body).all()
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_perfect_hash():
    slots = CODEC.hash(CODEC.slot_key)
    assert sorted(slots.tolist()) == list(range(CODEC.hash.n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab's'tl lvrem.,12 \n\té ñ日🙂  ſ", max_size=25), min_size=1, max_size=5))
def test_pieces_and_merges(texts):
    assert encode(texts) == ORACLE.encode_ordinary_batch(texts)


def test_words_and_memory():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz '") for _ in range(2000)) for _ in range(5)]
    assert encode(texts) == ORACLE.encode_ordinary_batch(texts)
    assert encode(["x" * 3000]) == ORACLE.encode_ordinary_batch(["x" * 3000])


def test_odd_rows(odd, none):
    out = bpe.encode_documents(odd)
    assert out.columns == [c for c in odd.columns if c not in ("tokens", "n_tokens", "round_trip")] + ["tokens", "n_tokens", "round_trip"]
    rows = out.collect()
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.tokens or [])
        assert r.tokens == (None if r.text is None else ORACLE.encode_ordinary(r.text))
    back = bpe.decode_documents(out.drop("text")).collect()
    assert [r.text for r in back] == [r.text for r in rows]
    assert bpe.encode_documents(none).count() == 0
