import hashlib
import os

import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on what the stage before has kept, against brute force."""
    import corpus_pipeline
    from halcyon.llm import bpe, mixing
    from tests.llm.conftest import components_of, shingles_of
    from tests.llm.test_passages import runs_of

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        before = {r.doc_id: r.text for r in docs.collect()} if k < 4 else None
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = out.collect()
        if k < 4:
            assert out.columns == columns
        kept.append((before, after))
        last, docs = docs, out
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept[0]
    ids = {r.doc_id for r in after}
    known = [i for i in before if i in labels]
    assert sum((labels[i] == 1) != (i not in ids) for i in known) <= 0.05 * len(known)
    before, after = kept[1]
    sets = {i: shingles_of(t) for i, t in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(links, sets)
    assert {r.doc_id for r in after} == {i for i in sets if want[i] == i}
    before, after = kept[2]
    assert {r.doc_id for r in after} == set(before) and not runs_of({r.doc_id: r.text for r in after})
    before, after = kept[3]
    rows = spark.read.parquet(str(tmp_path / "2"))
    taken = {r.doc_id: r.taken for r in mixing.mix(rows).collect()}
    words = dict.fromkeys(taken, 0)
    for r in after:
        words[r.doc_id] += len(r.text.split())
    assert words == taken
    t = Tokenizer.from_file(bpe.default_tokenizer())
    digest = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in last.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in kept[4][1]) == digest
    texts = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()): r.text for r in last.collect()}
    for r in kept[4][1]:
        ids = t.encode(texts[r.doc_id, r.decoded_sha256], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_empty(spark):
    import corpus_pipeline
    assert corpus_pipeline.run(spark, SF).count() > 100
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
