"""Feature panels, class weights, classification metrics, calibration and federated averaging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.lineage import cut
from ..functions.rounds import by_group, codes, gathered, in_rounds, summed
from ..functions.scalars import safe_div
from .association import side


def select_panel(df: DataFrame, k: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """the k features of largest population variance among the rows given (training rows): two observations at least and
    some variance; ties by feature order."""
    v = df.groupBy(feature).agg(F.count(value).alias("n"), F.var_pop(value).alias("variance")).filter((F.col("n") >= 2) & (F.col("variance") > 0))
    order = [F.desc(F.round("variance", 9)), F.col(feature)]
    top = v.orderBy(*order).limit(k)  # each task keeps its own first k
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))  # k rows


def collapse_classes(df: DataFrame, least: int, label: str, train: str) -> DataFrame:
    """F16: labels with under `least` training rows become `other`."""
    n = df.groupBy(label).agg(F.count_if(F.col(train)).alias("__n"))
    return df.join(side(n), label).withColumn("class", F.when(F.col("__n") >= least, F.col(label).cast("string")).otherwise("other")).drop("__n")


def class_weights(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """n / (k count) of each class, k the number of classes in the whole table; 0 where a group lacks the class."""
    classes = df.select(label).distinct()
    k = classes.count()
    grid = df.select(*by).distinct().crossJoin(F.broadcast(classes) if k <= 10_000 else classes) if by else classes
    c = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    x = grid.join(c, [*by, label], "left")
    x = x.join(n, by) if by else x.crossJoin(n)
    return x.select(*by, label, F.coalesce(F.col("n") / (F.lit(k) * F.col("c")), F.lit(0.0)).alias("weight"))


def softmax_columns(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds probs, pred (the first of the largest) and conf of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("probs", F.transform(e, lambda x: x / total))
    return df.withColumn("conf", F.array_max("probs")).withColumn("pred", (F.array_position(logits, top) - 1).cast("int"))


def confusion(df: DataFrame, by: list[str], true: str = "y", pred: str = "pred") -> DataFrame:
    """rows by true and predicted class."""
    return df.groupBy(*by, true, pred).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, by: list[str], true: str = "y", bins: int = 15, sure: float = 0.9) -> DataFrame:
    """accuracy, balanced accuracy (classes present), macro F1 (all classes there are logits for; one that is neither true
    nor predicted counts 0), calibration error over equal bins of confidence, and share and accuracy of confident rows. Needs
    probs, pred and conf."""
    ok = (F.col("pred") == F.col(true)).cast("double")
    one = df.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("probs")).alias("__k"), F.avg(ok).alias("accuracy"), F.avg((F.col("conf") >= sure).cast("double")).alias("confident_rate"), F.avg(F.when(F.col("conf") >= sure, ok)).alias("confident_accuracy"))
    c = confusion(df, by, true)
    t = c.groupBy(*by, F.col(true).alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("pred") == F.col(true), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(*by, F.col("pred").alias("k")).agg(F.sum("n").alias("p"))
    f = t.join(p, [*by, "k"], "full").na.fill(0, ["t", "tp", "p"])
    f = f.groupBy(*by).agg(F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("balanced_accuracy"), F.sum(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    b = df.withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))).groupBy(*by, "bin").agg(F.count("*").alias("m"), F.avg("conf").alias("c"), F.avg(ok).alias("a"))
    ece = b.groupBy(*by).agg((F.sum(F.col("m") * F.abs(F.col("a") - F.col("c"))) / F.sum("m")).alias("ece"))
    out = one.join(f, by).join(ece, by) if by else one.crossJoin(f).crossJoin(ece)
    return out.withColumn("macro_f1", F.col("macro_f1") / F.col("__k")).drop("__k")


def class_recall(df: DataFrame, by: list[str], true: str = "y") -> DataFrame:
    """recall of each class."""
    return df.groupBy(*by, true).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col(true)).cast("double")).alias("recall"))


def temperature_grid(points: int = 161, low: float = 0.05, high: float = 20.0) -> list[float]:
    """A geometric grid with 1 added."""
    return sorted({*(low * (high / low) ** (i / (points - 1)) for i in range(points)), 1.0})


def fit_temperature(df: DataFrame, true: str = "y", logits: str = "logits") -> DataFrame:
    """the temperature of the grid with the least mean cross-entropy: one pass, all temperatures over batches of rows. Rows
    without a class, or without a logit, are left out."""
    temps = temperature_grid()
    z = F.col(logits).cast("array<double>")
    x = df.select(F.col(true).cast("int").alias("y"), z.alias("z")).filter(F.col("y").isNotNull() & (F.size(z) > 0) & F.forall(z, lambda v: v.isNotNull()))

    def losses(batches):
        total, n = np.zeros(len(temps)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy()
            if ((y < 0) | (y >= size)).any():
                raise ValueError("a class has no logit")
            gaps = np.full((batch.num_rows, size.max()), -np.inf)  # behind the largest, a row of logits filled up with none
            gaps[np.arange(size.max()) < size[:, None]] = lists.flatten().to_numpy()
            gaps = np.ascontiguousarray((gaps - gaps.max(1, keepdims=True)).T)
            own = gaps[y, np.arange(len(y))]
            for i, t in enumerate(temps):
                total[i] += (np.log(np.exp(gaps / t).sum(0)) - own / t).sum()
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(temps), pa.array(total), pa.array([n] * len(temps))], names=["temperature", "nll", "n"])

    m = x.mapInArrow(losses, "temperature double, nll double, n long").groupBy("temperature").agg((F.sum("nll") / F.sum("n")).alias("nll"))
    return m.agg(F.min_by("temperature", F.struct(F.round("nll", 12), "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def balanced_accuracy_interval(cm: DataFrame, true: str = "y", draws: int = 4000, seed: int = 0) -> DataFrame:
    """balanced accuracy and its 95 % interval, each class's correct rows redrawn from a binomial. What is drawn from has
    one row a class."""
    c = cm.groupBy(F.col(true).alias("k")).agg(F.sum("n").cast("long").alias("t"), F.sum(F.when(F.col("pred") == F.col(true), F.col("n")).otherwise(0)).cast("long").alias("hit"))

    def redraw(rows):
        rows = rows.sort_values("k")
        t, hit = rows["t"].to_numpy(), rows["hit"].to_numpy()
        rng = np.random.default_rng(seed)
        lo, hi = np.percentile(np.mean([rng.binomial(n, x / n, size=draws) / n for n, x in zip(t, hit, strict=True)], axis=0), [2.5, 97.5])
        return pd.DataFrame({"balanced_accuracy": [float((hit / t).mean())], "lo": [lo], "hi": [hi]})

    return c.filter("t > 0").groupBy().applyInPandas(redraw, "balanced_accuracy double, lo double, hi double")


def arm_gap(df: DataFrame, key: list[str], arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """the second arm's value minus the first's, by key."""
    a = df.filter(F.col(arm) == arms[0]).select(*key, F.col(value).alias("__a"))
    b = df.filter(F.col(arm) == arms[1]).select(*key, F.col(value).alias("__b"))
    return a.join(b, key).select(*key, (F.col("__b") - F.col("__a")).alias("gap"))


def fed_average(updates: DataFrame, by: list[str], params: str = "params", weight: str | None = None) -> DataFrame:
    """mean of the sites' parameter vectors, equal or weighted: (by, pos, value)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = updates.select(*by, w.alias("__w"), F.posexplode(params).alias("pos", "__v"))
    return x.groupBy(*by, "pos").agg(safe_div(F.sum(F.col("__w") * F.col("__v")), F.sum("__w")).alias("value"))


def fed_logistic(df: DataFrame, rounds: int, site: str = "site", x: str = "x", y: str = "y", steps: int = 20, rate: float = 0.5, test: str = "test", tasks: int | None = None) -> DataFrame:
    """F23 (action): federated logistic regression: local gradient steps at each site, averaged by rows, each round.

    All rounds are one stage: its tasks keep their rows on disk and exchange the sites' gradients in every step, so a site of any size
    stays distributed. Returns (round, n_test, accuracy), accuracy on the test rows before the first and after each round;
    null without test rows. A site without training rows has no part in the mean.
    """
    rows = df.select(F.col(site).alias("site"), F.concat(F.array(F.lit(1.0)), F.col(x)).alias("f"), F.col(y).cast("double").alias("y"), F.coalesce(test, F.lit(False)).alias("test"))

    def features(b):
        return b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def work(kept):
        names, p = set(), 0
        for b in kept:
            names |= set(b.column("site").unique().to_pylist())
            p = p or features(b).shape[1]
        seen = gathered((names, p))
        sites, p = sorted(set().union(*[v for v, _ in seen]), key=str), max((n for _, n in seen), default=0)
        at = {v: i for i, v in enumerate(sites)}
        held = lambda b: b.column("test").to_numpy(zero_copy_only=False).astype(bool)
        total = lambda part, width: summed(sum(map(part, kept), np.zeros((len(sites), width))))
        label = lambda b, rows: b.column("y").to_numpy(zero_copy_only=False)[rows]
        counts = total(lambda b: by_group(codes(b.column("site"), at)[~held(b)], len(sites), np.ones((int((~held(b)).sum()), 1))), 1)
        w = np.zeros(p)

        def score(r):
            right = lambda b: np.array([held(b).sum(), ((features(b)[held(b)] @ w > 0) == label(b, held(b))).sum()])
            n, ok = summed(sum(map(right, kept), np.zeros(2)))
            return r, int(n), float(ok / n) if n else None

        def gradient(b):
            train = ~held(b)
            f, of = features(b)[train], codes(b.column("site"), at)[train]
            e = 1 / (1 + np.exp(-np.einsum("ij,ij->i", f, local[of]))) - label(b, train)
            return by_group(of, len(sites), e[:, None] * f)

        yield score(0)
        for r in range(1, rounds + 1):
            local = np.tile(w, (len(sites), 1))
            for _ in range(steps):
                local -= rate * total(gradient, p) / np.maximum(counts, 1)
            w = (local * counts).sum(0) / max(counts.sum(), 1)
            yield score(r)

    schema = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("n_test", T.LongType()), T.StructField("accuracy", T.DoubleType())])
    return in_rounds(rows, work, schema, tasks)


def panel_pca(df: DataFrame, ids: str, feature: str, value: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """scores on the first components of a panel, missing values at their feature's mean, and their variance shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = df.groupBy(feature).agg(F.avg(value).alias("__m"))
    grid = df.select(ids).distinct().crossJoin(side(mean))
    full = grid.join(df.select(ids, feature, value), [ids, feature], "left").withColumn("__v", F.coalesce(value, "__m") - F.col("__m"))
    x = full.groupBy(ids).agg(F.array_sort(F.collect_list(F.struct(feature, "__v"))).alias("a")).select(ids, array_to_vector(F.col("a")["__v"]).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(x)
    s = model.transform(x).select(ids, vector_to_array("pc").alias("pc"))
    return s.select(ids, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)]), model.explainedVariance.toArray().tolist()


def class_feature_means(df: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """mean of each feature by class."""
    return df.groupBy(label, feature).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def with_total(df: DataFrame, name: str, sums: list[str], means: dict[str, str]) -> DataFrame:
    """site rows and a total row: sums, and means weighted by a column."""
    total = df.agg(*[F.sum(c).alias(c) for c in sums], *[(F.sum(F.col(c) * F.col(w)) / F.sum(w)).alias(c) for c, w in means.items()])
    rows = df.select(F.col(name).cast("string").alias(name), *sums, *means)
    return rows.unionByName(total.select(F.lit("total").alias(name), *sums, *means))


def round_table(df: DataFrame, row: str, site: str, value: str, sites: list) -> DataFrame:
    """one row per round with a column per site."""
    return df.groupBy(row).pivot(site, sites).agg(F.avg(value))

