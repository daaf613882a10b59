import os
import random
import zlib

import corpus_pipeline
from pulseframe.llm import toxicity
from tests.llm.helpers import contamination, near_components
from tests.llm.test_toxicity import corpus as toxic_corpus


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def write(spark, folder):
    draw = random.Random(6)
    item = words(draw, 30)
    texts = [words(draw, draw.choice([3, 30, 80])) for _ in range(60)]
    texts += texts[:5] + [t + " extra" for t in texts[10:15] if len(t.split()) > 20]
    texts += [f"{words(draw, 20)} {item} {words(draw, 10)}", None, "", " "]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, item


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    folder = os.fspath(tmp_path)
    rows, item = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(d, t) for d, t, *_ in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "exact_dedup":
            last = {}
            for d, t in kept:
                last[t or ""] = max(d, last.get(t or "", d))
            kept = [(d, t) for d, t in kept if last[t or ""] == d]
        elif name == "near_dedup":
            of = near_components(kept)
            kept = [(d, t) for d, t in kept if of[d][1] == d]
        elif name == "decontamination":
            kept = [(d, t) for d, t in kept if not contamination(t, [(0, item)])[-1]]
        assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _ in kept), name
    assert len(kept) < len(rows) - 6
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _ in kept)


def test_first_stage_drops_what_the_model_rejects(spark, tmp_path):
    rows = [(i, t) for i, t, _ in toxic_corpus(260)] + [(800, None), (801, "")]
    spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(260)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, TOXICITY string")
    train = [(i, t, y) for i, t, y in toxic_corpus(260) if zlib.crc32(str(i).encode()) % 5]
    score = toxicity.SubwordSoftmax().fit([t for _, t, _ in train], [y for _, _, y in train]).scorer()
    kept = corpus_pipeline.STAGES[0][1](spark, docs, os.fspath(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in rows if score(t or "") < 0.5)
    assert 0 < len(rows) - kept.count() < len(rows) / 2
