"""Note models: ICD-10 code classifier (N12-N16, W3) and LDA topics.

Features are Spark ML stages end to end: tokens + bigrams (native array
expressions) -> ``CountVectorizerModel`` (top terms by corpus count) -> ``IDF`` ->
``ElementwiseProduct`` by (idf + 1) -> L2 ``Normalizer``.  MLlib's IDF is
ln((n+1)/(df+1)); multiplying the counts by idf + 1 gives the smooth idf
ln((n+1)/(df+1)) + 1, so the weights equal the SQL TF-IDF of ``text.py``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halcyon.functions.notes import clean_note
from halcyon.operators.analytics import icd_describe
from halcyon.operators.modeling import SEED, pieces, size_partitions, stratified_split
from halcyon.operators.stats import class_report, class_summary, weighted_ovr_auc
from halcyon.operators.text import english_stop_words, tokens, with_bigrams

# ---- fixed values: topic label rules, checked in order -----------------------
TOPIC_RULES = [
    ("Metabolic Disorders", ["diabetes", "insulin", "glucose", "hba1c", "metformin", "lipid", "hyperlipidemia",
                             "cholesterol", "ldl"]),
    ("Cardiovascular Disease", ["hypertension", "blood pressure", "cardiac", "heart", "ischemic", "ischaemic",
                                "angina", "ecg", "amlodipine", "systolic", "diastolic"]),
    ("Respiratory Conditions", ["cough", "respiratory", "bronchial", "copd", "asthma", "wheeze", "shortness",
                                "dyspnoea", "inhaler"]),
    ("Preventive Care", ["wellness", "annual", "routine", "examination", "screening", "preventive"]),
]
DEFAULT_TOPIC = "General Medicine"
# -----------------------------------------------------------------------------


def with_terms(df: DataFrame, text: str, out: str = "terms", clean: bool = False) -> DataFrame:
    """Token + bigram array column (a null text has none); tokens are projected once (the optimizer
    keeps a multiply-referenced regex projection instead of inlining it)."""
    src = F.coalesce(clean_note(text) if clean else F.col(text), F.lit(""))
    return df.withColumn("_tok", tokens(src, english_stop_words())) \
        .withColumn(out, with_bigrams(F.col("_tok"))).drop("_tok")


def fit_tfidf_stages(df: DataFrame, terms: str = "terms", max_terms: int = 5000,
                     out: str = "tfidf") -> PipelineModel:
    """CountVectorizer + IDF fitted once; the +1 of the smooth idf is folded in
    with an ElementwiseProduct built from the fitted idf vector (max_terms values)."""
    # the vocabulary by (count desc, term): ties do not depend on partitions
    counts = df.select(F.explode(terms).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    vocab = [r["t"] for r in counts.orderBy(F.desc("n"), "t").limit(max_terms).collect()]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=terms, outputCol="_tf")
    idf = IDF(inputCol="_tf", outputCol="_idf_raw")
    base = Pipeline(stages=[cv, idf]).fit(df)
    idf_vec = base.stages[1].idf.toArray()
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf_vec + 1.0), inputCol="_tf", outputCol="_w")
    norm = Normalizer(p=2.0, inputCol="_w", outputCol=out)
    return PipelineModel(stages=[base.stages[0], scale, norm])


# ----------------------------------------------------------------------------- ICD classifier

#: pieces of the regression's input, and rows for which there is one more
GRADIENT_PIECES, GRADIENT_ROWS = 32, 500_000


def gradient_pieces(n: int) -> int:
    """Pieces of ``n`` notes.  In every iteration each shuffles a gradient of classes x terms numbers, which stays on disk
    until the driver frees it, so large tables have larger pieces."""
    return min(pieces(n), GRADIENT_PIECES + n // GRADIENT_ROWS)


@dataclass
class IcdModel:
    pipeline: PipelineModel
    classes: list
    evaluation: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, text: str = "clinical_note") -> DataFrame:
        """code, description, confidence, 3 alternatives and the code->prob map."""
        p = self.pipeline.transform(with_terms(df, text)).withColumn("_probs", vector_to_array("probability"))
        classes = F.array(*[F.lit(c) for c in self.classes])
        pairs = F.arrays_zip(F.col("_probs").alias("p"), classes.alias("code"))
        ranked = F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
                              .otherwise(F.when(a["code"] < b["code"], -1).otherwise(1)))
        out = p.select("*", ranked[0]["code"].alias("predicted_icd"), F.array_max("_probs").alias("icd_confidence"),
                       F.transform(F.slice(ranked, 2, 3), lambda s: s["code"]).alias("alternative_codes"),
                       F.map_from_arrays(classes, F.col("_probs")).alias("all_probabilities"))
        out = icd_describe(out, "predicted_icd").withColumnRenamed("icd_description", "predicted_description")
        return out.drop("terms", "_tf", "_w", "tfidf", "rawPrediction", "probability", "prediction", "label_idx")


def fit_icd(notes: DataFrame, text: str = "clinical_note", label: str = "icd_code", key: str = "claim_key",
            max_terms: int = 3000, c: float = 1.0, max_iter: int = 1000) -> tuple[IcdModel, DataFrame]:
    """TF-IDF (1-2 grams, top 3,000) + multinomial logistic regression with
    C = 1 (regParam = 1 / (C * n)), stratified 80/20 (N12).
    Returns the model and the hold-out rows with predictions."""
    # only notes are shuffled and kept: their terms take many times the room and are made where they are read
    data = size_partitions(notes.select(key, text, label), key=key, pieces=gradient_pieces).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = (size_partitions(side, key=key, pieces=gradient_pieces).persist(StorageLevel.MEMORY_AND_DISK) for side in stratified_split(data, label, [key]))
    n = train.count()
    n_test = test.count()
    data.unpersist()
    terms = with_terms(train, text)
    tf = fit_tfidf_stages(terms, "terms", max_terms)
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(train)
    lr = LogisticRegression(featuresCol="tfidf", labelCol="label_idx", family="multinomial",
                            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=1e-8)
    feats = idx.transform(tf.transform(terms)).select("tfidf", "label_idx")
    lrm = lr.fit(feats)
    pipe = PipelineModel(stages=[tf, lrm])   # the label indexer is only needed to fit
    model = IcdModel(pipeline=pipe, classes=list(idx.labels))
    held = model.predict(test, text)
    rep = class_report(held, label, "predicted_icd")
    summ = class_summary(rep).first().asDict()
    summ["roc_auc_ovr_weighted"] = weighted_ovr_auc(held.withColumn("_pa", F.map_values("all_probabilities")),
                                                    label, sorted(model.classes), "_pa") \
        .first()["roc_auc_ovr_weighted"]
    summ.update({"num_samples": n + n_test, "num_classes": len(model.classes), "train_samples": n})
    model.evaluation = summ
    train.unpersist()
    return model, held


def sample_predictions(held: DataFrame, text: str = "clinical_note", key: str = "claim_key", n: int = 3) -> DataFrame:
    """3 example rows (N16): first 100 chars + '...', code, description,
    confidence (3 dp); chosen by key hash, a distributed top-k."""
    return held.orderBy(F.xxhash64(key, F.lit(SEED))).limit(n).select(
        F.concat(F.substring(text, 1, 100), F.lit("...")).alias("input"),
        F.col("predicted_icd").alias("predicted_code"), F.col("predicted_description").alias("predicted_desc"),
        F.round("icd_confidence", 3).alias("confidence"))


# ----------------------------------------------------------------------------- topics

def topic_label(top_terms_col) -> F.Column:
    """First matching rule over the joined top terms (substring test)."""
    s = F.lower(F.array_join(top_terms_col, " "))
    expr = None
    for label, words in TOPIC_RULES:
        cond = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: s.contains(w))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(DEFAULT_TOPIC))


@dataclass
class TopicModel:
    tfidf: PipelineModel
    lda: object
    labels: list   # (topic, label, top_terms)

    def topics(self, spark) -> DataFrame:
        return spark.createDataFrame(self.labels, "topic int, topic_label string, top_terms array<string>")

    def assign(self, df: DataFrame, text: str = "clinical_note") -> DataFrame:
        """dominant topic, its label and the topic probabilities."""
        t = self.lda.transform(self.tfidf.transform(with_terms(df, text, clean=True)))
        probs = vector_to_array("topicDistribution")
        t = t.withColumn("topic_probabilities", probs) \
            .withColumn("dominant_topic", (F.array_position(F.col("topic_probabilities"),
                                                            F.array_max("topic_probabilities")) - 1).cast("int"))
        lab = F.broadcast(self.topics(df.sparkSession).select(F.col("topic").alias("dominant_topic"), "topic_label"))
        return t.join(lab, "dominant_topic", "left").drop("terms", "_tf", "_w", "tfidf", "topicDistribution")


def fit_topics(notes: DataFrame, text: str = "clinical_note", k: int = 5, max_terms: int = 5000,
               max_iter: int = 20) -> TopicModel:
    """LDA with k topics (seed 42, online optimiser; every one of the ``max_iter``
    iterations reads all notes) on the TF-IDF of the cleaned notes (N9); topic labels from the top-10 terms (N10)."""
    data = size_partitions(notes.select(*[c for c in ("claim_key", text) if c in notes.columns])).persist(StorageLevel.MEMORY_AND_DISK)
    terms = with_terms(data, text, clean=True)
    tf = fit_tfidf_stages(terms, "terms", max_terms)
    vec = tf.transform(terms).select("tfidf")
    lda = LDA(k=k, seed=SEED, featuresCol="tfidf", optimizer="online", maxIter=max_iter, subsamplingRate=1.0).fit(vec)
    vocab = tf.stages[0].vocabulary
    desc = lda.describeTopics(10).collect()   # k rows x 10 term ids
    spark = notes.sparkSession
    rows = [(int(r["topic"]), [vocab[i] for i in r["termIndices"]]) for r in desc]
    lab = spark.createDataFrame(rows, "topic int, top_terms array<string>") \
        .select("topic", topic_label(F.col("top_terms")).alias("topic_label"), "top_terms").collect()
    data.unpersist()
    return TopicModel(tfidf=tf, lda=lda, labels=[(r["topic"], r["topic_label"], list(r["top_terms"])) for r in lab])
