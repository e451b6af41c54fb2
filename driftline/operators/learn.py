"""Clustering, classification, splits and calibration on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core.facts import with_facts
from ..core.stage import stage
from ..core.stats import quantiles
from .intervals import merge_near, overlap_join, overlap_seconds


def scaled(df: DataFrame, columns: list[str], out: str = "scaled") -> DataFrame:
    """Standardised feature vector; rows with nulls are skipped."""
    stages = [VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol=out, withMean=True)]
    return Pipeline(stages=stages).fit(df).transform(df).drop("__raw")


def kmeans_pass(df: DataFrame, columns: list[str], k: int | None, max_k: int = 8, seed: int = 42) -> tuple[DataFrame, int]:
    """Cluster standardised features; with ``k=None`` the best silhouette up to ``max_k`` decides."""
    d = stage(scaled(df, columns))
    fit = lambda n: KMeans(featuresCol="scaled", predictionCol="cluster", k=n, seed=seed).fit(d)
    if k is None:
        ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster")
        k = max(range(2, max_k + 1), key=lambda n: ev.evaluate(fit(n).transform(d)))
    return fit(k).transform(d).drop("scaled"), k


def rank_clusters(df: DataFrame, primary: str, k: int, name: str = "cluster") -> DataFrame:
    """Cluster rank by the mean of a primary channel and the ordered key ``N_kM_``; the ranking is over k rows."""
    m = df.groupBy(name).agg(F.avg(primary).alias("__m"))
    m = m.withColumn("cluster_rank", F.dense_rank().over(W.partitionBy(F.lit(1)).orderBy("__m", name))).drop("__m")
    return df.join(m, name).withColumn("cluster_key", F.concat(F.col("cluster_rank").cast("string"), F.lit(f"_k{k}_")))


def select_pass(df: DataFrame, name: str | None, k: int | None) -> DataFrame:
    """Rows of a cluster pass: by name when any row has it, else by k."""
    has = df.agg(F.max(F.col("pass_name") == F.lit(name)).alias("__has")) if name else None
    if has is None:
        return df.where(F.col("k") == k)
    j = with_facts(df, has)
    return j.where(F.when(F.coalesce("__has", F.lit(False)), F.col("pass_name") == name).otherwise(F.col("k") == F.lit(k))).drop("__has")


def pca_projection(df: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    d = scaled(df, columns)
    m = PCA(k=n, inputCol="scaled", outputCol="__pc").fit(d)
    a = vector_to_array("__pc")
    return m.transform(d).withColumns({f"pc{i + 1}": a[i] for i in range(n)}).drop("scaled", "__pc")


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (classes · class size)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    t = c.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = with_facts(c, t).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(w, label)


#: Rows a task of a fit gets at the least: every pass of a fit sends a table of statistics per task, whatever its rows.
ROWS_A_FIT_TASK = 500


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly to the session's cores: a small file is one partition, which a fit of hundreds of trees or their scores would
    pass over in one task, again and again."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FIT_TASK))
    return df.repartition(tasks) if tasks > 1 else df


def _classifier(kind: str, trees: int, depth: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "__y", "weightCol": "weight"}
    if kind == "rf":
        return RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, maxDepth=depth, seed=seed, **common)
    if kind == "gbt":
        return GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), seed=seed, **common)
    if kind == "svm":
        return LinearSVC(**common)
    raise ValueError(f"unknown classifier {kind!r}")


class Classifier:
    """A fitted classifier with its label order; ``transform`` adds predicted_label and pred_confidence."""

    def __init__(self, pipeline, labels: list[str], confidence: float):
        self.pipeline, self.labels, self.confidence = pipeline, labels, confidence

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.pipeline.transform(df)
        names = F.array(*[F.lit(x) for x in self.labels])
        lab = F.get(names, F.col("prediction").cast("int"))
        if "probability" in p.columns:
            conf = F.array_max(vector_to_array("probability"))
            p = p.withColumn("pred_confidence", conf).withColumn("score", vector_to_array("probability")[1] if len(self.labels) > 1 else F.lit(1.0))
            lab = F.when(conf < self.confidence, "Unknown").otherwise(lab)
        else:
            margin = vector_to_array("rawPrediction")[1]
            p = p.withColumn("score", margin).withColumn("pred_confidence", F.lit(None).cast("double"))
        return p.withColumn("predicted_label", lab).drop("features", "rawPrediction", "probability", "prediction")


def train(df: DataFrame, columns: list[str], label: str, kind: str = "rf", trees: int = 500, confidence: float = 0.4, seed: int = 42, depth: int = 10) -> Classifier:
    """Balanced classifier; predictions under the confidence threshold become ``Unknown``.

    ``trees`` and ``depth`` are the run's parameters; the classes are listed on the driver, as the model lists them itself.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    labels = sorted(sizes)
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    rows = sum(sizes.values())
    weight = F.get(F.array(*[F.lit(rows / (len(labels) * sizes[x])) for x in labels]), y.cast("int"))  # as ``balance_weights``, without its join
    d = spread(df.select(*columns, label, y.cast("double").alias("__y"), weight.alias("weight")), rows)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), _classifier(kind, trees, depth, seed)]).fit(d)
    return Classifier(fitted, labels, confidence)


def stratify_key(df: DataFrame, dataset: str, label: str, min_class: int = 2) -> DataFrame:
    """``dataset||label`` strata, or the label alone for all rows when some composite class is too small."""
    comp = F.concat_ws("||", dataset, label)
    worst = df.groupBy(comp.alias("c")).count().agg((F.min("count") < min_class).alias("__small"))
    j = with_facts(df, worst)
    return j.withColumns({"stratum": F.when(F.col("__small"), F.col(label)).otherwise(comp),
                          "stratify_note": F.when(F.col("__small"), "composite_class_too_small").otherwise("composite")}).drop("__small")


def hash_split(df: DataFrame, id_col: str, test_share: float, seed: int = 42) -> DataFrame:
    """Test flag by a seeded hash of the row id: the share holds within every stratum in expectation, without any sort."""
    u = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_003)) / 1_000_003.0
    return df.withColumn("is_test", u < test_share)


def stratified_split(df: DataFrame, id_col: str, stratum: str, test_share: float, seed: int = 42) -> DataFrame:
    """Test flag that holds the share within every stratum: ids hashed below the stratum's exact quantile of hashes."""
    u = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)).cast("double")
    d = df.withColumn("__u", u)
    cut = quantiles(d, [stratum], "__u", {"__cut": test_share})
    return d.join(cut, stratum).withColumn("is_test", F.col("__u") < F.col("__cut")).select(*df.columns, "is_test")


def hash_folds(df: DataFrame, id_col: str, folds: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(folds)).cast("int"))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Leave-group-out folds: each group is in one fold and no fold is empty while there are groups enough.

    Groups (deployments, datasets) are numbered in hashed order; the numbering runs over one row per group.
    """
    g = df.select(group).distinct()
    n = F.row_number().over(W.orderBy(F.xxhash64(group), group)) - 1
    return df.join(g.withColumn("fold", F.pmod(n, F.lit(folds)).cast("int")), group)


def transfer(df: DataFrame, columns: list[str], label: str, dataset: str, source: str, target: str, **kw) -> DataFrame:
    """Scores of one dataset's rows by a model trained on another's."""
    return train(df.where(F.col(dataset) == source), columns, label, **kw).transform(df.where(F.col(dataset) == target))


def two_cluster_model(df: DataFrame, columns: list[str], label: Column, seed: int = 42) -> DataFrame:
    """Two clusters of standardised features; the one that matches the label better (F1) becomes class 1."""
    c, _ = kmeans_pass(df, columns, 2, seed=seed)
    best = best_cluster_by_f1(c, "cluster", label).select(F.col("cluster").alias("__best"))
    return with_facts(c, best).withColumn("predicted", (F.col("cluster") == F.col("__best")).cast("int")).drop("__best")


def at_once(jobs: list[Callable], most: int = 4) -> list:
    """Results of independent fits, a few at a time: each is a series of small Spark jobs that leave the cluster idle between them."""
    with ThreadPoolExecutor(min(most, max(len(jobs), 1))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def out_of_fold(df: DataFrame, columns: list[str], label: str, folds: int, **kw) -> DataFrame:
    """Scores of models that did not see the row's fold; one model per fold, fitted at once. They are written once, as what follows
    (a calibration) reads them many times."""
    df = stage(df)
    sizes = {r[0]: r[1] for r in df.groupBy("fold").count().collect()}
    parts = at_once([lambda i=i: train(df.where(F.col("fold") != i), columns, label, **kw).transform(spread(df.where(F.col("fold") == i), sizes.get(i, 0)))
                     for i in range(folds)])
    return stage(reduce(lambda a, b: a.unionByName(b), parts))


def platt(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sigmoid calibration of out-of-fold scores: ``calibrated`` probability of label 1."""
    va = VectorAssembler(inputCols=[score], outputCol="__s")
    m = Pipeline(stages=[va, LogisticRegression(featuresCol="__s", labelCol="__l", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__d")]).fit(
        df.withColumn("__l", F.col(label).cast("double")))
    return m.transform(df).withColumn("calibrated", vector_to_array("__p")[1]).drop("__s", "__p", "__r", "__d")


def tuned_out_of_fold(df: DataFrame, columns: list[str], label: str, id_col: str, folds: int, beta: float = 2.0, cap: float = 5.0, **kw) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows by models trained on the other folds, each on a downsample of its majority class, and the threshold
    with the best F-beta over these scores (one row). Labels are the strings 0 (majority) and 1; ``cap`` majority rows per other row."""
    from .peaks import best_threshold, threshold_sweep
    from .sampling import hash_downsample
    d = stage(hash_folds(df, id_col, folds))

    def one(i: int) -> DataFrame:
        seen = hash_downsample(d.where(F.col("fold") != i), label, "0", cap, id_col)
        return train(seen, columns, label, confidence=0.0, **kw).transform(d.where(F.col("fold") == i))

    parts = at_once([lambda i=i: one(i) for i in range(folds)])
    scores = stage(reduce(lambda a, b: a.unionByName(b), parts).withColumn("__y", F.col(label).cast("int")))
    return scores.drop("__y"), best_threshold(threshold_sweep(scores, "__y", "score", beta))


def forward_ablation(df: DataFrame, groups: dict[str, list[str]], label: str, id_col: str, trees: int = 500, seed: int = 42) -> list[tuple[str, float]]:
    """Add feature groups one by one, each time the one that helps accuracy most; a loop over configured groups, whose candidates are
    fitted at once."""
    d = stage(hash_split(df, id_col, 0.4, seed))
    done, used, left = [], [], dict(groups)

    def accuracy(cols: list[str]) -> float:
        p = train(d.where("NOT is_test"), cols, label, trees=trees, confidence=0.0, seed=seed).transform(d.where("is_test"))
        return p.agg(F.avg((F.col("predicted_label") == F.col(label)).cast("double"))).first()[0] or 0.0

    while left:
        scored = dict(zip(left, at_once([lambda cols=used + cols: accuracy(cols) for cols in left.values()])))
        best = max(scored, key=lambda g: (scored[g], g))
        used += left.pop(best)
        done.append((best, scored[best]))
    return done


def best_cluster_by_f1(df: DataFrame, cluster: str, label: Column) -> DataFrame:
    """The cluster whose membership matches the label best (F1), over one count per cluster."""
    tot = df.agg(F.count_if(label).alias("__pos"))
    g = with_facts(df.groupBy(cluster).agg(F.count_if(label).alias("tp"), F.count(F.lit(1)).alias("n")), tot)
    return g.select(cluster, F.try_divide(2.0 * F.col("tp"), F.col("n") + F.col("__pos")).alias("f1")).orderBy(F.desc("f1"), cluster).limit(1)


def window_labels(windows: DataFrame, events: DataFrame, keys: list[str], window_id: str, bin_s: float = 3600.0, default: str = "none") -> DataFrame:
    """Each window takes the label it overlaps longest (by name on ties).

    ``windows``: keys, id, w_start, w_end; ``events``: keys, e_start, e_end, label.
    """
    j = overlap_join(windows.select(*keys, window_id, "w_start", "w_end"), events.select(*keys, "e_start", "e_end", "label"), keys,
                     ("w_start", "w_end"), ("e_start", "e_end"), bin_s)
    s = j.groupBy(window_id, "label").agg(F.sum(overlap_seconds("w_start", "w_end", "e_start", "e_end")).alias("s"))
    best = s.groupBy(window_id).agg(F.min_by("label", F.struct(-F.col("s"), "label")).alias("label"), F.max("s").alias("overlap_s"))
    return windows.join(best, window_id, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def windows_to_states(predictions: DataFrame, axis, label: str, gap_s: float = 0.0) -> DataFrame:
    """Adjacent or near windows of one predicted label merged into state events. ``axis.ts`` is the window start."""
    ax = axis.with_(keys=(*axis.keys, label))
    return merge_near(predictions, ax, "window_end", gap_s)


def common_events(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Observed, cluster, algorithmic and supervised rows (start_ts, end_ts, label) in one event layout."""
    rows = [d.select(*keys, F.col("start_ts").alias("ts"), "end_ts", F.concat_ws(".", F.lit(m), "label").alias("key"), F.lit(m).alias("method"), F.lit("state").alias("type"))
            for m, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)
