"""Evaluating classifiers over tables of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def softmax(logits: Column) -> Column:
    """Probabilities of an array of scores, shifted by the greatest."""
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  # else computed again for each score
    exps = once(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return once(exps, lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def top_k(probabilities: Column, k: int) -> Column:
    """array of struct(p, class_index), best first, of equal ones the lower index first."""
    rows = F.transform(probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("class_index"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["p"].alias("p"), r["class_index"].alias("class_index")))


def review_decision(top: Column, own: Column, known: Column, *, threshold: float, margin: float = 0.15) -> Column:
    """What a reviewer should look at, by the first rule that holds."""
    p1, p2, c1 = top[0]["p"], F.coalesce(F.try_element_at(top, F.lit(2))["p"], F.lit(0.0)), top[0]["class_index"]
    return (F.when(~F.coalesce(known, F.lit(False)), "outside_target_classes").when((c1 != own) & (p1 >= threshold), "high_confidence_disagreement")
            .when(p1 < threshold, "low_confidence").when(p1 - p2 < margin, "small_margin").otherwise("ok"))


def model_gate(top: Column, target: Column, allowed: Column, *, min_confidence: float) -> tuple[Column, Column]:
    """(accepted, reason): one of the best three allowed, else the target among ``top`` confident enough."""
    best = F.transform(F.slice(top, 1, 3), lambda r: r["class_index"])
    of_target = F.coalesce(F.try_element_at(F.filter(top, lambda r: r["class_index"] == target), F.lit(1))["p"], F.lit(0.0))
    in_top = F.arrays_overlap(best, allowed)
    reason = F.when(in_top, "allowed_top3").when(of_target >= min_confidence, "target_confidence").otherwise("model_reject")
    return in_top | (of_target >= min_confidence), reason


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(truth, predicted, n) over all pairs of the listed classes (one column ``label``), zero cells included."""
    t, p = classes.select(F.col("label").alias(truth)), classes.select(F.col("label").alias(predicted))
    counts = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return t.join(F.broadcast(p)).join(counts, [truth, predicted], "left").na.fill(0, ["n"])  # a short list of classes


def classification_report(rows: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) by class, and rows accuracy, macro avg and weighted avg; 0 where undefined."""
    counted = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    each = counted.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").cast("int").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("x")).select("x.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    d = classes.join(each, "label", "left").na.fill(0)
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hit", "said"), zero), F.coalesce(F.try_divide("hit", "support"), zero)
    d = d.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), "support", "hit")
    macro = d.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), zero).alias(c)
    weighted = d.agg(F.lit("weighted avg").alias("label"), *[mean(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    hit = F.coalesce(F.try_divide(F.sum("hit"), F.sum("support")), zero)
    accuracy = d.agg(F.lit("accuracy").alias("label"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), F.sum("support").alias("support"))
    return d.drop("hit").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def per_class_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, total, correct, wrong, accuracy, most_predicted): of equal counts the lower class."""
    by = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    total = F.sum("n")
    return by.groupBy(truth).agg(
        total.alias("total"), hit.alias("correct"), (total - hit).alias("wrong"), F.round(hit / total, 4).alias("accuracy"),
        F.max_by(predicted, F.struct("n", -F.col(predicted))).alias("most_predicted"))


def mistake_ranking(rows: DataFrame, ident: str, truth: str, *, low_correct: int = 4, limit: int = 40) -> DataFrame:
    """(id, truth, rank, correct): for each class first its mistakes (surest first), then its least sure right answers, at most ``limit``.

    rows: id, truth, predicted, confidence, margin.  Only the first rows of each class
    are kept, by a limit pushed into the ranking.
    """
    right = F.col(truth) == F.col("predicted")
    wrong_rank = F.row_number().over(W.partitionBy(truth).orderBy(F.desc("confidence"), "margin", ident))
    right_rank = F.row_number().over(W.partitionBy(truth).orderBy("confidence", "margin", ident))
    wrong = rows.where(~right).withColumn("k", wrong_rank).where(F.col("k") <= limit).select(ident, truth, "k", F.lit(False).alias("correct"))
    ok = rows.where(right).withColumn("k", right_rank).where(F.col("k") <= low_correct).select(ident, truth, "k", F.lit(True).alias("correct"))
    both = wrong.unionByName(ok)
    rank = F.row_number().over(W.partitionBy(truth).orderBy("correct", "k"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit).select(ident, truth, "rank", "correct")


def early_stopping(history: DataFrame, run: str, epoch: str, accuracy: str, *, patience: int) -> DataFrame:
    """(run, epoch, accuracy, best, improved, waited, stopped): each epoch up to the stop; only a strictly better epoch is an improvement.

    Nulls never improve.  A run is one training history, so its rows fit one task.
    """
    past = W.partitionBy(run).orderBy(epoch)
    before = F.coalesce(F.max(accuracy).over(past.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0))
    d = history.select(run, epoch, accuracy).withColumn("improved", F.coalesce(F.col(accuracy) > before, F.lit(False)))
    d = d.withColumn("best", F.max(accuracy).over(past)).withColumn("k", F.row_number().over(past))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("k"))).over(past), F.lit(0))
    d = d.withColumn("waited", F.col("k") - last)
    stop = F.when((F.col("waited") >= patience) & F.lit(patience > 0), F.col("k"))
    d = d.withColumn("_stop", F.min(stop).over(W.partitionBy(run)))
    d = d.where(F.col("_stop").isNull() | (F.col("k") <= F.col("_stop")))
    return d.select(run, epoch, accuracy, "best", "improved", "waited", F.coalesce(F.col("k") == F.col("_stop"), F.lit(False)).alias("stopped"))


def epoch_means(batches: DataFrame, run: str, loss: str, correct: str, size: str) -> DataFrame:
    """(run, loss, accuracy): means weighted by batch size, 0 for no rows."""
    n = F.greatest(F.sum(size), F.lit(1))
    return batches.groupBy(run).agg((F.sum(F.col(loss) * F.col(size)) / n).alias("loss"), (F.sum(correct) / n).alias("accuracy"))


def focal_loss(probabilities: Column, label: Column, weights: Column | None = None, *, gamma: float = 2.0, smoothing: float = 0.0) -> Column:
    """(1 - p)**gamma times the weighted log loss, p being e to the minus unweighted log loss.

    With smoothing each class has that part of one, shared evenly, in the truth; weights
    (one for each class) weigh every class by its own.  Null for a label that is no class.
    """
    logs = F.transform(probabilities, lambda p: F.ln(p))
    part = lambda i: (F.lit(1.0 - smoothing) * (i == label).cast("double") + F.lit(smoothing) / F.size(probabilities))
    total = lambda w: F.aggregate(F.transform(logs, lambda x, i: -x * part(i) * (w[i] if w is not None else F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    if smoothing == 0.0:
        loss = -F.get(logs, label)
        weighted = loss * F.get(weights, label) if weights is not None else loss
    else:
        loss, weighted = total(None), total(weights)
    return F.when((label >= 0) & (label < F.size(probabilities)), F.pow(1 - F.exp(-loss), F.lit(gamma)) * weighted)
