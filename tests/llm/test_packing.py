import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from beaconlake.llm import packing
from beaconlake.llm.common import batch_slices
from beaconlake.llm.packing import Lane, encoder, pack

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, documents, length=1024):
    """Every id lies in one piece; pieces of a sequence follow each other; all but the last are full."""
    by_text = {}
    for doc_id, text in documents:
        by_text.setdefault(doc_id, []).append(ids_of(text))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == by_text.keys()
    for doc_id, wanted in by_text.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, wanted))
        for r in pieces[doc_id]:
            crcs = {zlib.crc32(w[r.start : r.start + r.length].tobytes()) for w in wanted if len(w) == r.doc_tokens}
            assert r.ids_crc32 in crcs and r.length > 0
        if len(wanted) == 1:
            spans = sorted((r.start, r.start + r.length) for r in pieces[doc_id])
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert (spans[0][0], spans[-1][1]) == (0, len(wanted[0]))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    short = [n for n in sizes if n != length]
    assert all(n < length and n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_encoder_is_the_library():
    rng = random.Random(1)
    texts = ["", "   ", "<|endoftext|>hi<|endoftext|><|endoftext|>", "it's I'LL ’s", "日本語 １２ ²³", "é‍😀👍🏽", "\x00\x1c\x85 x", " " * 200_000]
    texts += ["".join(rng.choice("ab 1.'\n\tséß　日😀<|>endoftx \x85") for _ in range(60)) for _ in range(500)]
    encode = encoder("byte_bpe_50k.json")
    assert all(np.array_equal(encode(t), ids_of(t)[:-1]) for t in texts)


def test_a_lane_keeps_few_windows_and_fits_best():
    lane = Lane(0, 10, 2, keep_ids=False)
    for doc_id, size in enumerate((6, 5, 4, 23)):
        lane.document(doc_id, np.arange(size, dtype="<u4"))
        assert len(lane.open) <= 2
    # 4 fills the window of 6 rather than that of 5; 23 gives two sequences and a rest.
    assert [(p[0], p[2], p[7]) for p in lane.done[:2]] == [(0, 6, 0), (2, 4, 0)] or lane.done[0][2] + lane.done[1][2] == 10
    lane.finish()
    sizes = {}
    for piece in lane.done:
        sizes[piece[7]] = sizes.get(piece[7], 0) + piece[2]
    assert sorted(sizes.values()) == [8, 10, 10, 10]


def test_whole_table(documents, texts):
    check(pack(documents).collect(), list(texts.items()))


def test_merges_over_many_partitions(documents, texts):
    check(pack(documents.repartition(70), windows=3, keep_ids=False).collect(), list(texts.items()))


def test_ids_are_kept_on_demand(make_documents):
    rows = pack(make_documents([(1, "a b c " * 700)])).collect()
    joined = [i for r in sorted(rows, key=lambda r: r.start) for i in r.ids]
    assert joined == ids_of("a b c " * 700).tolist()


def test_odd_rows(odd_documents, no_documents):
    rows = pack(odd_documents, length=64, windows=2).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], length=64)
    assert pack(no_documents).collect() == []


def test_the_library_is_loaded_only_when_needed(monkeypatch):
    loaded, load = [], packing.library
    monkeypatch.setattr(packing, "library", lambda name: loaded.append(name) or load(name))
    monkeypatch.setattr(packing, "_ENCODERS", {})
    encode = encoder("byte_bpe_50k.json")
    assert np.array_equal(encode("it's a <|endoftext|> text"), ids_of("it's a <|endoftext|> text")[:-1]) and not loaded
    assert np.array_equal(encode(" " * 1_000_000), ids_of(" " * 1_000_000)[:-1]) and loaded


def test_few_texts_become_strings_at_once():
    texts = ["a" * 600, None, "", "é" * 300, "b" * 2500, "c"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 2, 3, 2**60 + 1, 5], "text": texts})
    parts = [p.to_pylist() for p in batch_slices([batch.slice(0, 0), batch], "text", 1000)]
    assert [r for part in parts for r in part] == batch.to_pylist()
    assert all(len(part) == 1 or sum(len((r["text"] or "").encode()) for r in part) <= 1600 for part in parts) and len(parts) > 2
