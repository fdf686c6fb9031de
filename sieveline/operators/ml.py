"""Text features and models on pyspark.ml: fitted on the training split, chosen on validation, tested once."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.metrics import best_threshold, confusion, pr_auc, roc_auc, summary
from sieveline.operators.relevance import class_weights

WRAPPED = T.StructType([T.StructField("v", VectorUDT())])
FEATURES, WORD_SIZES, LETTER_SIZES = 10_000, (1, 2), (3, 5)


def _runs_of_words(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.expr("cast(array() as array<string>)"))


def word_grams(text: Column | str, sizes: tuple[int, int] = WORD_SIZES) -> Column:
    """Runs of words of the given sizes."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.flatten(F.array(*[_runs_of_words(words, n) for n in range(sizes[0], sizes[1] + 1)]))


def _runs_of_letters(words: Column, n: int) -> Column:
    return F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, n)))


def letter_grams(text: Column | str, sizes: tuple[int, int] = LETTER_SIZES) -> Column:
    """Runs of letters within blank-padded words; a word shorter than a run gives itself once."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.flatten(F.array(*[_runs_of_letters(padded, n) for n in range(sizes[0], sizes[1] + 1)])))


def vocabulary(df: DataFrame, grams: str, size: int = FEATURES) -> list[str]:
    """The most frequent grams of a corpus; ties in alphabetical order. A bounded list."""
    counts = df.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), "gram").limit(size).collect()]


def document_frequencies(df: DataFrame, grams: str, words: list[str]) -> list[float]:
    """Smoothed inverse document frequencies, ln((1 + n) / (1 + df)) + 1, by word."""
    n = df.count()
    held = df.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    known = {r[0]: r[1] for r in held.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in words], "gram string")), "gram").collect()}
    import math

    return [math.log((1 + n) / (1 + known.get(w, 0))) + 1 for w in words]


class TfIdf:
    """Sublinear tf times smoothed idf, of unit length; fitted on one frame, applied to any."""

    def __init__(self, name: str, grams: Column, size: int = FEATURES):
        self.name, self.grams, self.size = name, grams, size

    def fit(self, df: DataFrame) -> TfIdf:
        made = df.withColumn("__grams", self.grams)
        self.words = vocabulary(made, "__grams", self.size)
        self.idf = document_frequencies(made, "__grams", self.words)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """JVM transformers alone: counts, their logarithms, the weights, unit length."""
        counts = CountVectorizerModel.from_vocabulary(self.words, inputCol="__grams", outputCol="__counts").transform(df.withColumn("__grams", self.grams))
        plain = F.unwrap_udt("__counts")
        damped = plain.withField("values", F.transform(plain["values"], lambda n: 1 + F.log(n)))
        # built-ins unwrap a vector, and only a schema wraps one again
        logs = counts.withColumn("__logs", F.from_json(F.to_json(F.struct(damped.alias("v"))), WRAPPED)["v"])
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="__logs", outputCol="__weighed").transform(logs)
        return Normalizer(inputCol="__weighed", outputCol=self.name, p=2.0).transform(weighed).drop("__grams", "__counts", "__logs", "__weighed")


def text_features(train: DataFrame, frames: list[DataFrame], text: str = "text", size: int = FEATURES) -> tuple[list[TfIdf], list[DataFrame]]:
    """Word and letter blocks, fitted on train alone, joined in ``features`` of unit length."""
    blocks = [TfIdf("word_block", word_grams(text), size).fit(train), TfIdf("letter_block", letter_grams(text), size).fit(train)]
    assemble = Pipeline(stages=[VectorAssembler(inputCols=["word_block", "letter_block"], outputCol="__both"), Normalizer(inputCol="__both", outputCol="features", p=2.0)])
    out = []
    for f in frames:
        for b in blocks:
            f = b.transform(f)
        out.append(assemble.fit(f).transform(f).drop("__both", "word_block", "letter_block"))
    return blocks, out


def vector_features(train: DataFrame, frames: list[DataFrame], array: str = "embedding") -> list[DataFrame]:
    """Given vectors, standardised by the training split."""
    as_vector = lambda f: f.withColumn("__raw", array_to_vector(F.col(array).cast("array<double>")))
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(as_vector(train))
    return [scaler.transform(as_vector(f)).drop("__raw") for f in frames]


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


#: Models by name with their grids: SVM and logistic regression by C, naive Bayes by its smoothing.
GRIDS: dict[str, list[float]] = {"svm": [0.1, 1.0, 10.0], "logistic": [0.1, 1.0, 10.0], "bayes": [0.1, 0.5, 1.0]}


def estimator(name: str, value: float, n: int):
    """C is the inverse of the penalty for a sum over n rows; pyspark's regParam is for their mean."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "svm":
        return LinearSVC(regParam=1 / (value * n), maxIter=50, **common)
    if name == "logistic":
        return LogisticRegression(regParam=1 / (value * n), elasticNetParam=0.0, maxIter=100, **common)
    if name == "bayes":
        return NaiveBayes(modelType="multinomial", smoothing=value, **common)
    raise ValueError(f"no model is called {name}")


def scored(model, df: DataFrame) -> DataFrame:
    """Adds score: the margin of an SVM, the probability of class 1 of the others."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1])


def cut_of(name: str) -> float:
    return 0.0 if name == "svm" else 0.5


def evaluate(df: DataFrame, threshold: float, y: str = "label") -> dict[str, float]:
    rows = df.select(F.col(y).cast("int").alias("y_true"), "score", (F.col("score") >= threshold).cast("int").alias("y_pred"))
    return {**summary(confusion(rows)).first().asDict(), **pr_auc(rows).first().asDict(), **roc_auc(rows).first().asDict()}


def experiment(train: DataFrame, val: DataFrame, test: DataFrame, models: list[str] | None = None, grids: dict[str, list[float]] | None = None) -> list[dict]:
    """Per model: the grid value with the best validation macro-F1 (the first of equals), and its test metrics."""
    train = weighted(train).persist()
    n, out = train.count(), []
    for name in models or list(GRIDS):
        best = None
        for value in (grids or GRIDS)[name]:
            model = estimator(name, value, n).fit(train)
            macro = evaluate(scored(model, val), cut_of(name))["macro_f1"]
            if best is None or macro > best[0]:
                best = (macro, value, model)
        out.append({"model": name, "value": best[1], "val_macro_f1": best[0], **evaluate(scored(best[2], test), cut_of(name))})
    train.unpersist()
    return out


def multilabel_experiment(train: DataFrame, val: DataFrame, test: DataFrame, labels: list[str], values: list[float] | None = None) -> dict[str, dict]:
    """One SVM a label over features and an array column ``labels``; a label without both classes in training is refused."""
    out = {}
    for label in labels:
        of = lambda f, label=label: f.withColumn("label", F.array_contains("labels", label).cast("double"))
        if of(train).select("label").distinct().count() < 2:
            raise ValueError(f"training needs examples for and against {label}")
        out[label] = experiment(of(train), of(val), of(test), ["svm"], {"svm": values or GRIDS["svm"]})[0]
    return out


def save(model: PipelineModel, path: str, **meta: str) -> None:
    """The model, and beside it what it was made for; refuses a path that is there."""
    from pyspark.sql import SparkSession

    model.save(path)
    SparkSession.active().createDataFrame([tuple(meta.values())], list(meta)).write.json(f"{path}.meta")


def load(path: str, **wanted: str) -> PipelineModel:
    from pyspark.sql import SparkSession

    meta = SparkSession.active().read.json(f"{path}.meta").first().asDict()
    differing = [k for k, v in wanted.items() if meta.get(k) != v]
    if differing:
        raise ValueError(f"the model was made for another {', '.join(differing)}")
    return PipelineModel.load(path)


__all__ = ["GRIDS", "TfIdf", "best_threshold", "document_frequencies", "estimator", "evaluate", "experiment", "letter_grams", "load", "multilabel_experiment", "save", "scored", "text_features", "vector_features", "vocabulary", "weighted", "word_grams"]
