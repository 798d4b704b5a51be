"""Piece ids and token counts against the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tablefit.llm import byte_pairs, pieces, token_counts

PIECES, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
PARTS = ["a", "aa", "the", " ", "  ", "\n", "▁", "\r", "\t", "é", "ß", "中", "😀", "\x00", "\u0301", "==", "....", "ing",
         "<|endoftext|>", "<s>", "\u00a0", "'s", "0"]


def odd_texts(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [" " * n for n in range(20)]


def test_pieces_equal_library():
    model, library = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in odd_texts(1500):
        ids = library.encode(text)
        assert list(model.rows([text])) == [(",".join(map(str, ids)), len(ids), library.decode(ids))]
        assert model.encode(text) == ids
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259)]) for _ in range(6)]
        assert model.decode(ids) == library.decode(ids)


def test_pieces_rows(spark, docs, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t in rows)
    found = pieces.encode_decode(docs, PIECES).select("doc_id", "n_tokens", pieces.id_array().alias("ids"), "decoded")
    got = found.collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert pieces.encode_decode(none, PIECES).count() == 0


def test_counts_equal_library():
    library, counter = Tokenizer.from_file(BYTES), token_counts.JsonCounter(BYTES)
    texts = odd_texts(1500)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_cache(spark, docs, rows, none, tmp_path):
    library, cache = Tokenizer.from_file(BYTES), str(tmp_path / "cache")
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50)
                   for d, t in rows)
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.count_tokens(docs, BYTES, cache, limit=50).collect()
        assert Counter(tuple(r) for r in got) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(none, BYTES, cache).count() == 0
    assert {r.tokenizer for r in stored.collect()} == {hashlib.sha256(open(BYTES, "rb").read()).hexdigest()}


def test_byte_pairs_equal_library(monkeypatch):
    library, model = Tokenizer.from_file(BYTES), byte_pairs.BytePairModel(BYTES)
    monkeypatch.setattr(byte_pairs, "KNOWN_BYTES", 100_000)  # the store is emptied many times
    newer = "\u0558a \u0558 a\U000323b1b \U00016ff61"  # letters and digits that the library doesn't know as such
    for text in [*odd_texts(1500), newer, "x" * 100_000, " " * 5000 + "a", "<|endoftext|>" * 3, "<|endoftext|", " \n a  b "]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(model.rows([text])) == [(",".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False))]
        assert model.encode(text) == ids
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(50257), rnd.randrange(256)]) for _ in range(6)]
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_byte_pairs_rows(spark, docs, rows, none):
    library = Tokenizer.from_file(BYTES)
    want = Counter((d, len(ids := library.encode(t or "", add_special_tokens=False).ids), ",".join(map(str, ids)), t or "")
                   for d, t in rows)
    assert Counter(tuple(r) for r in byte_pairs.encode_decode(docs, BYTES).collect()) == want
    assert byte_pairs.encode_decode(none, BYTES).count() == 0


def test_long_words_are_not_remembered():
    """Long unbroken strings pass without staying in memory; results are those of the libraries."""
    rnd = random.Random(3)
    blobs = ["".join(rnd.choice("abcXYZ019+/") for _ in range(10_000)) for _ in range(40)]
    texts = [f"the {a} and {b}\n{a[:50]}" for a, b in zip(blobs, blobs[1:])]
    piece_library, byte_library = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    piece_model, counter, pair_model = pieces.PieceModel(PIECES), token_counts.JsonCounter(BYTES), byte_pairs.BytePairModel(BYTES)
    assert [r[0] for r in piece_model.rows(texts)] == [",".join(map(str, piece_library.encode(t))) for t in texts]
    ids = [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counter.counts(texts) == list(map(len, ids))
    assert [r[0] for r in pair_model.rows(texts)] == [",".join(map(str, i)) for i in ids]
    for known in (piece_model.known_ids, piece_model.known_text, counter.known, pair_model.known_ids, pair_model.known_text):
        assert max(map(len, known), default=0) <= 256


def test_full_stores_are_emptied(monkeypatch):
    for module in (pieces, token_counts):
        monkeypatch.setattr(module, "KNOWN_BYTES", 20_000)
    piece_library, byte_library = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    piece_model, counter = pieces.PieceModel(PIECES), token_counts.JsonCounter(BYTES)
    for text in odd_texts(400):
        assert [r[0] for r in piece_model.rows([text])] == [",".join(map(str, piece_library.encode(text)))]
        assert counter.counts([text]) == [len(byte_library.encode(text, add_special_tokens=False).ids)]
