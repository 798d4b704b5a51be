"""The pipeline on the smallest tables, stage by stage."""

import hashlib

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tablefit.llm import queries
from tests.llm.test_duplicates import cut, jaccard, union, word_shingles
from tests.test_catalogue import TABLES, plain


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    states = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "piece_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        states.append(docs.collect())
    raw, good, single, short, clean, ids = states
    verdicts = {r.doc_id: r.keep for r in queries.judged(spark, folder).collect()}
    assert sorted(r.doc_id for r in good) == sorted(d for d, keep in verdicts.items() if keep)
    assert 0 < len(good) < len(raw)
    # One of each group of texts that five-word shingles make similar (0.8); all groups are found in this table.
    sets = {r.doc_id: word_shingles(r.text) for r in good}
    close = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    root = union(list(sets), close)
    assert sorted(r.doc_id for r in single) == sorted(set(root.values())) and len(single) < len(good)
    single = sorted(single, key=lambda r: r.doc_id)
    want = [(r.doc_id, c[2].decode(errors="ignore")) for r, c in zip(single, cut([r.text.encode() for r in single], 200))]
    assert sorted((r.doc_id, r.text) for r in short) == want
    assert all(r.n_chars == len(r.text) for r in short)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in short if any(item in r.text for item in items)}
    left = {r.doc_id for r in clean}
    assert left <= {r.doc_id for r in short} and not left & leaked
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in clean}
    for r in ids:
        assert list(r.ids) == library.encode(texts.pop(r.doc_id))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()
    assert not texts


def test_sql(spark, folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, folder)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted(tuple(plain(x) for x in row) for row in cursor.fetchall())
        assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
