"""Combined claim scoring (X1) as one DataFrame transform, usable on a batch
table or on a stream.

Everything the scorer needs is static and small: the preprocessor literals,
the models, and the at most 1,001 score levels at which a percentile rank changes.
The row path is native expressions, ML transformers and the Arrow tree
walks, so it runs unchanged in ``readStream`` plans.

Requests carry no ``charges``: nothing on the path reads them, and the claim id is the
hash of the raw columns that are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halcyon.functions import notes as N
from halcyon.operators.approval import ApprovalModel
from halcyon.operators.clusters import Segmentation
from halcyon.operators.cost import CostModel
from halcyon.operators.features import FEATURES, Preprocessor, assemble
from halcyon.operators.ingest import request_to_claim, split_valid_claims, split_valid_rejected, with_claim_id
from halcyon.operators.isoforest import IsolationForest, flag_reason
from halcyon.operators.notemodels import IcdModel, fit_tfidf_stages, with_terms
from halcyon.operators.ranks import rank_of
from halcyon.sources.claims import RAW_COLUMNS

SCORE_DIGITS = 4


@dataclass
class KeywordModel:
    """Fitted note vectoriser for per-note top-10 keywords (no shuffle)."""
    stages: PipelineModel
    vocab: list

    def keywords(self, df: DataFrame, text: str, n: int = 10) -> DataFrame:
        t = self.stages.transform(with_terms(df, text, clean=True))
        w = vector_to_array("tfidf")
        vocab = F.array(*[F.lit(v) for v in self.vocab])
        pairs = F.filter(F.arrays_zip(w.alias("w"), F.sequence(F.lit(1), F.size(w)).alias("i")),
                         lambda p: p["w"] > 0)
        ranked = F.array_sort(pairs, lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1)
                              .otherwise(F.when(F.element_at(vocab, a["i"]) < F.element_at(vocab, b["i"]), -1)
                                         .otherwise(1)))
        kw = F.transform(F.slice(ranked, 1, n), lambda p: F.element_at(vocab, p["i"]))
        return t.withColumn("keywords", kw).drop("terms", "_tf", "_w", "tfidf")


def fit_keywords(notes: DataFrame, text: str = "clinical_note", max_terms: int = 5000) -> KeywordModel:
    st = fit_tfidf_stages(with_terms(notes.select(text), text, clean=True), "terms", max_terms)
    return KeywordModel(stages=st, vocab=list(st.stages[0].vocabulary))


@dataclass
class ClaimScorer:
    pre: Preprocessor
    cost: CostModel
    anomaly: IsolationForest
    levels: list              # (smallest training score, percentile rank), at most 1,001: ranks.rank_levels
    segments: Segmentation
    approval: ApprovalModel
    icd: IcdModel
    keywords: KeywordModel

    def score(self, claims: DataFrame, key: str = "claim_key") -> DataFrame:
        """One nested row per claim (X1): claim id, cost, anomaly, segment,
        approval and — when a non-empty note exists — NLP analysis."""
        base = with_claim_id(claims, [c for c in RAW_COLUMNS if c in claims.columns])
        m = assemble(self.pre.transform(base, targets=False), FEATURES)
        m = self.cost.predict(m).drop("prediction")
        m = self.anomaly.decision(m)
        m = m.withColumn("anomaly_score", F.round("decision", SCORE_DIGITS)) \
            .withColumn("flag_reason", flag_reason(F.col("decision"), F.col("is_anomaly"), self.anomaly.severe))
        m = m.withColumn("percentile_rank", rank_of(F.col("decision"), self.levels))
        m = self.segments.assign(m)
        m = self.approval.predict(m.drop("probability", "rawPrediction", "prediction"))
        has_note = F.col("clinical_note").isNotNull() & (F.length(F.trim("clinical_note")) > 0)
        m = self.icd.predict(m.drop("probability", "rawPrediction", "prediction"), "clinical_note")
        m = self.keywords.keywords(m, "clinical_note")
        ent = N.entities("clinical_note")
        nlp = F.when(has_note, F.struct(
            ent["conditions"].alias("extracted_conditions"), ent["medications"].alias("extracted_medications"),
            ent["procedures"].alias("extracted_procedures"), ent["vitals"].alias("vitals"),
            F.col("predicted_icd"), F.col("predicted_description").alias("icd_description"),
            F.col("icd_confidence"), N.urgency("clinical_note").alias("note_urgency"),
            ent["clinical_summary"].alias("clinical_summary"), F.col("keywords")))
        return m.select(
            key, "claim_id",
            F.struct("predicted_cost", "ci_lower", "ci_upper", "cost_tier", "model_used").alias("cost_prediction"),
            F.struct("is_anomaly", "anomaly_score", "percentile_rank", "flag_reason").alias("anomaly_detection"),
            F.struct("cluster_id", "risk_label", F.col("segment_risk_score").alias("risk_score"),
                     "similar_members_count").alias("risk_segmentation"),
            F.struct(F.col("approved_pred").alias("approved"), F.col("approval_probability").alias("probability"),
                     F.col("approval_confidence").alias("confidence"), "decision_factors").alias("approval_status"),
            nlp.alias("nlp_analysis"),
            *([F.col("claim_ts")] if "claim_ts" in claims.columns else []))


def score_requests(scorer: ClaimScorer, requests: DataFrame, key: str = "claim_key") -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): requests validated and made canonical (V8, V9), the valid ones turned into
    claims (V10) and scored (X1), the others with their reasons."""
    accepted, rejected = split_valid_rejected(requests)
    return scorer.score(request_to_claim(accepted), key), rejected


def score_valid_claims(scorer: ClaimScorer, claims: DataFrame, key: str = "claim_key") -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): claims that pass the request rules (V8) scored (X1), the others with their reasons."""
    accepted, rejected = split_valid_claims(claims)
    return scorer.score(accepted, key), rejected


def metric_columns() -> list:
    """predictions, anomalies flagged, notes analysed (X3): of a scored frame, also as an observation of one."""
    return [F.count(F.lit(1)).alias("predictions_total"),
            F.coalesce(F.sum(F.col("anomaly_detection.is_anomaly").cast("long")), F.lit(0).cast("long")).alias("anomalies_flagged"),
            F.count("nlp_analysis").alias("nlp_analyses_total")]


def scoring_metrics(scored: DataFrame) -> DataFrame:
    """The metrics of a scored table (X3, batch)."""
    return scored.agg(*metric_columns())
