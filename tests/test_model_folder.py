"""Saved models: whole versions or none, and the same answers from the loaded copies."""

import pytest

from halcyon.operators import isoforest as IF
from halcyon.operators import notemodels as NM
from halcyon.operators.clusters import fit_segments
from halcyon.operators.modeling import model_matrix
from halcyon.sources import models as M
from halcyon.streaming.scoring import fit_keywords


@pytest.fixture(scope="module")
def fitted(spark, small_claims):
    m, pre = model_matrix(small_claims)
    m = m.cache()
    iso, _ = IF.fit_isolation_forest(m, ["claim_key"], n_trees=5)
    models = {"pre": pre, "anomaly": iso, "segments": fit_segments(m, 2, 2), "keywords": fit_keywords(small_claims),
              "topics": NM.fit_topics(small_claims, k=2, max_iter=2)}
    return m, models


def test_loaded_models_answer_alike(spark, small_claims, fitted, tmp_path):
    m, models = fitted
    assert M.save_models(spark, str(tmp_path), models) == 1
    got = M.load_models(spark, str(tmp_path))
    assert set(got) == set(models) and got["pre"] == models["pre"]

    def answers(x):
        return (sorted(x["anomaly"].decision(m).select("claim_key", "decision").collect()),
                sorted(x["segments"].assign(m).select("claim_key", "cluster_id", "risk_label", "similar_members_count").collect()),
                sorted(x["keywords"].keywords(small_claims, "clinical_note").select("claim_key", "keywords").collect()),
                sorted(x["topics"].assign(small_claims).select("claim_key", "dominant_topic", "topic_label").collect()))
    assert answers(got) == answers(models)


def test_unfinished_versions_are_not_seen(spark, fitted, tmp_path, monkeypatch):
    _, models = fitted
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        M.load_models(spark, folder)
    M.save_models(spark, folder, {"pre": models["pre"]})
    whole = M._save

    def lost(spark, path, m):
        if path.endswith("segments"):
            raise RuntimeError("lost")
        whole(spark, path, m)
    monkeypatch.setattr(M, "_save", lost)
    with pytest.raises(RuntimeError):
        M.save_models(spark, folder, {"pre": models["pre"], "segments": models["segments"]})
    assert set(M.load_models(spark, folder)) == {"pre"}
    monkeypatch.undo()
    assert M.save_models(spark, folder, {"segments": models["segments"]}) == 2
    assert set(M.load_models(spark, folder)) == {"segments"} and set(M.load_models(spark, folder, 1)) == {"pre"}
    with pytest.raises(FileNotFoundError):
        M.load_models(spark, folder, 9)
