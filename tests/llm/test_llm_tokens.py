"""Token counts, piece encoding and packing against the public libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortloom.llm.batches import BoundedCache
from cohortloom.llm.bpe_count import counter, token_counts
from cohortloom.llm.packing import bin_patterns, fullest, pack, pack_documents, word_ids
from cohortloom.llm.piece_bpe import codec, encode_texts, encoding_digests

BYTES, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = [
    "a", " ", "\n", "b", "the", "  ", "\t", "<|endoftext|>", "<|startoftext|>", "é", "1", "'s", "!", "▁", "\x1c", "　", "😀", "\r\n", "<s>",
    "Straße", "İ", "W̊", "Σ", "ﬁ", "\x00", "supercalifragilistic", "0123456789",
]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return texts + ["", " ", "\n", "x" * 60_000, "a b\n" * 9_000, "ab" * 20_000]


def table(spark, texts):
    rows = [(i, x, "t", 1) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, piece int")


def test_counts_equal_the_library():
    texts = odd_texts(4000)
    library = Tokenizer.from_file(BYTES)
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter(BYTES).count(x) for x in texts] == expected


def test_count_table(spark):
    texts = [*odd_texts(50), None, "same text", "same text"]
    library = Tokenizer.from_file(BYTES)
    for row in token_counts(table(spark, texts), BYTES, limit=4).collect():
        x = texts[row.doc_id] or ""
        n = len(library.encode(x, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(x.encode()), n, n > 4)
    assert token_counts(table(spark, []), BYTES).count() == 0


def test_pieces_equal_the_library():
    texts = odd_texts(4000)
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    ids = library.encode(texts)
    assert [own.encode(x) for x in texts] == ids
    assert [own.decode(x) for x in ids] == library.decode(ids)
    own.verify()


def test_a_difference_from_the_library_stops_the_job():
    own = codec(PIECES)
    own.verify()
    own.fresh.append(("▁word", [1, 2, 3]))
    with pytest.raises(ValueError, match="differ"):
        own.verify()


def test_piece_tables(spark):
    texts = [*odd_texts(50), None, "same text", "same text"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    digests = {r.doc_id: r for r in encoding_digests(table(spark, texts), PIECES).collect()}
    for row in encode_texts(table(spark, texts), PIECES).collect():
        ids = library.encode(texts[row.doc_id] or "")
        assert (row.ids, row.decoded) == (ids, library.decode(ids))
        d = digests[row.doc_id]
        assert d.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encoding_digests(table(spark, []), PIECES).count() == 0


def test_word_ids_equal_the_library():
    rng = random.Random(8)
    texts = odd_texts(3000) + ["".join(chr(rng.choice([rng.randint(32, 255), rng.randint(1, 0x500), 97, 65])) for _ in range(12)) for _ in range(3000)]
    library = Tokenizer.from_file(WORDS)
    expected = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [word_ids(WORDS).encode(x) for x in texts] == expected


def test_fullest_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        chosen = fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(x) <= counts[x] for x in chosen)


def test_bins_use_every_piece_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)}
    used = {}
    for lengths, times in bin_patterns(counts, 100):
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_packing(spark, monkeypatch):
    from cohortloom.llm import packing

    monkeypatch.setattr(packing, "PIECES_PER_TASK", 7)
    texts = [*odd_texts(120), None, "x y z", "x y z"]
    library = Tokenizer.from_file(WORDS)
    found = pack_documents(table(spark, texts).drop("piece"), WORDS, limit=64).collect()
    by_doc, bins = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in enumerate(texts):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in pieces] == [(k, 64 * k) for k in range(-(-len(ids) // 64))]
        for r in pieces:
            cut = ids[r.start : r.start + 64]
            assert (r.length, r.ids_crc32) == (len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    total = 0
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
        total += end
    assert len(bins) <= -(-total // 64) + 1


def test_packing_edges(spark):
    empty = pack_documents(table(spark, []).drop("piece"), WORDS)
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 70)], "doc_id long, piece int, length long"), 64)


def test_cache_is_bounded():
    cache = BoundedCache(lambda x: x + 1, 3)
    assert [cache[x] for x in range(10)] == list(range(1, 11))
    assert len(cache) <= 3


def test_no_vocabulary_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = [f for _, _, files in os.walk(os.path.join(root, "cohortloom")) for f in files if f.endswith((".model", ".tiktoken"))]
    assert found == []
