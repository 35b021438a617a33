"""The pipeline and its stages against brute force, and the entry point."""

import collections

import numpy as np
from cases import SCHEMA, documents, sha
from pyspark.sql import functions as F
from test_operators import PIECE, base_spans, components_by_hand, contaminated_by_hand, fingerprint_by_hand

import __spark_entry__
import corpus_pipeline


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rows = [r for r in documents(n=60) if len(r[1] or "") < 4000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # a passage of the first document without a secret that the quality rules keep, which is the one of its group that stays
    first = min((r for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect() if r.doc_id is not None and "password" not in r.text), key=lambda r: r.doc_id)
    item = " ".join(first.text.split()[3:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "t")
        kept.append([tuple(r) for r in docs.select("doc_id", "text" if i < 4 else "piece_ids").collect()])
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    prints = [fingerprint_by_hand(t) for _, t in kept[0]]
    groups = collections.defaultdict(list)
    for (k, _), g in zip(kept[0], components_by_hand(prints), strict=True):
        groups[g].append(k)
    least = [min(g, key=lambda k: (k is None, k)) for g in groups.values()]
    assert sorted((k for k, _ in kept[1]), key=repr) == sorted(least, key=repr)
    clean = {r[0] for r in contaminated_by_hand(kept[1], [(1, item)]) if not r[5]}
    assert 0 < len(clean) < len(kept[1]) and {k for k, _ in kept[2]} == clean
    assert {k for k, _ in kept[3]} == clean and all(not base_spans(t) for _, t in kept[3]) and any("[SECRET]" in t for _, t in kept[3])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = dict(kept[3])
    for k, ids in kept[4]:
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(texts[k], add_bos=True, add_eos=True)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.ids_sha256) for r in out.collect()), key=repr) == sorted(((k, sha(bytes(ids))) for k, ids in kept[4]), key=repr)
    assert out.where(F.col("n_tokens") != F.octet_length("piece_ids") / 4).count() == 0


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
