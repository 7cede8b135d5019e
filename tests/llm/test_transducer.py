import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconlake.llm.transducer import BETWEEN, STATES, counter, scan, split_machine, token_counts

NAME = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))


def wanted(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_state_maps_compose_to_the_sequential_scan():
    machine = split_machine()
    classes = np.random.default_rng(5).integers(0, 10, 3000).astype(np.uint8)
    state, want = BETWEEN, []
    for c in classes:
        state = machine[c * STATES + state]
        want.append(state)
    assert scan(classes, machine).tolist() == want
    assert scan(classes[:1], machine).tolist() == want[:1]


CASES = [
    "", "   ", "a b \t\n x", "<|endoftext|>hi<|endoftext|><|startoftext|>", "<|endof text|>", "it's I'LL don't ’s",
    "日本語 テスト １２ ²³ Ⅷ", "é‍😀👍🏽", "\x00\x01\x1c\x1d\x85 x", "_a_b __ --", "ſs 'ſ 'S 've 'vx 'r 'l 'll'll's 'reS ''s !'s a's1's",
    " ΣΣ İI ǅ", "é Å", "don''t 'd'd'm' 'rev 'lle", "x" * 300, "'" * 99,
]


def test_cases():
    got = counter(NAME).count(CASES)
    assert got.tolist() == [wanted(t) for t in CASES]
    assert [counter(NAME).count_long(t) for t in CASES] == got.tolist()


@settings(max_examples=200, deadline=None)
@given(st.text("abstmdrvle'1.é \n", max_size=60))
def test_like_the_library(text):
    assert counter(NAME).count([text])[0] == wanted(text)


def test_words_like_the_library():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmé") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert counter(NAME).count(words).tolist() == [wanted(w) for w in words]


def test_a_worker_that_starts_anew(monkeypatch):
    import beaconlake.llm.transducer as module

    monkeypatch.setattr(module, "STATES_KEPT", 1)
    monkeypatch.setattr(module, "REMEMBERED", 2)
    texts = ["some words of a text", "and some more words", "some words"]
    assert [int(counter(NAME).count([t])[0]) for t in texts] == [wanted(t) for t in texts]


def test_whole_table(documents, texts):
    rows = token_counts(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), wanted(text))
        assert r.over_limit == (r.n_tokens > 2048)


def test_odd_rows(odd_documents, no_documents):
    want = sorted((r.doc_id or 0, wanted(r.text)) for r in odd_documents.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(odd_documents).collect()) == want
    assert token_counts(no_documents).collect() == []
