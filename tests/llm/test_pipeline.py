import hashlib
from collections import Counter

import numpy as np

from .fixtures import words
from .test_models import plain_mix
from .test_text_operators import plain_base, plain_kept, plain_lines, plain_similar


def tuples(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_each_stage_equals_its_plain_version(spark, sf_dir, tmp_path):
    import sentencepiece

    import corpus_pipeline as p
    from larkspur.llm.queries import model_bytes

    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, f) in enumerate(p.STAGES):
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        stages.append((docs, docs := spark.read.parquet(str(tmp_path / str(i)))))
    for before, after in stages[:-1]:
        assert after.columns == before.columns == p.COLUMNS
    # quality rules
    rows = tuples(stages[0][0])
    kept = plain_kept(rows)
    assert sorted(tuples(stages[0][1])) == sorted(r for r in rows if kept[r[0]])
    assert all(not plain_base(r[1])[5] for r in tuples(stages[0][1]))
    # line dedup
    assert sorted(r[:2] for r in tuples(stages[1][1])) == [r[:2] for r in plain_lines(tuples(stages[1][0]), 10)]
    # near-duplicates
    rows = tuples(stages[2][0])
    classes = plain_similar(rows, 0.8)
    assert sorted(tuples(stages[2][1])) == sorted(r for r in rows if classes[r[0]] == r[0])
    # mixing
    rows = tuples(stages[3][0])
    used, _ = plain_mix(rows, 0.95, 4.0)
    have, want = Counter(r[0] for r in tuples(stages[3][1])), Counter()
    for (d, _), k in used.items():
        want[d] += k
    assert sum(((have - want) + (want - have)).values()) <= 3
    # tokens
    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    text = {r[0]: r[1] for r in tuples(stages[4][0])}
    for r in stages[4][1].collect():
        ids = model.encode(text[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert sum(len(words(t)) for t in text.values())


def test_stages_take_an_empty_table(spark, sf_dir):
    import corpus_pipeline as p

    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in p.STAGES:
        assert f(spark, empty, sf_dir).count() == 0
