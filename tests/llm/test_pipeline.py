"""The pipeline against the plain versions of its stages, one after the other."""
import numpy as np
import public_tokenizers

import brute
import corpus_pipeline
from tablewright.llm import pieces, quality


def test_pipeline(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = [d for d in docs if brute.quality(d[1], quality.STOP_WORDS)["kept"]]
    docs = [(d, t, s) for (d, _, s), (t, _, _) in zip(docs, brute.drop_lines([t for _, t, _ in docs], 10))]
    named = brute.near_copies([(d, t) for d, t, _ in docs])
    docs = [x for x, (d, _, c) in zip(docs, named) if d == c]
    sizes = [len(brute.words(t)) for _, t, _ in docs]
    taken = brute.mixed([(d, s, n) for (d, _, s), n in zip(docs, sizes)])
    model = pieces.Pieces.load(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    want = {}
    for (d, t, _), n, k in zip(docs, sizes, taken):
        whole, part = divmod(k, n) if n else (0, 0)
        if k:
            want[d] = (whole, part, t)
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == want.keys()
    for d, (whole, part, text) in want.items():
        shown = [model.decode(r["piece_ids"]) for r in got[d]]
        cut = [t for t in shown if t != text]
        assert len(shown) - len(cut) == whole and len(cut) == (part > 0)
        assert all(text.startswith(t) and len(t.split()) == len(text[:len(t)].split()) and len(brute.words(t)) == part for t in cut)
        assert all(r["n_chars"] == len(t) and r["n_pieces"] == len(r["piece_ids"]) for r, t in zip(got[d], shown))
        assert all(model.score(np.array(r["piece_ids"], "<i4").tobytes()) == model.score(model.marked(pieces.MARK + pieces.symbols(t)))
                   for r, t in zip(got[d], shown))


def test_stage_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs.limit(20), sf_dir).columns == corpus_pipeline.COLUMNS
