"""Precision, recall, F1, confusion and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved

TRIPLE = ["s", "p", "o"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def compared(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """The union of two sets with flags g and x."""
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(predicted.select(*key).distinct().withColumn("x", F.lit(1)), key, "full_outer")
    return both.na.fill(0, ["g", "x"])


def counts() -> list[Column]:
    g, x = F.col("g"), F.col("x")
    return [F.sum(g * x).alias("tp"), F.sum(x * (1 - g)).alias("fp"), F.sum(g * (1 - x)).alias("fn")]


def triple_prf(gold: DataFrame, predicted: DataFrame, key: list[str] = TRIPLE) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of distinct rows."""
    total = compared(gold, predicted, key).agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts(), ("tp", "fp", "fn"), strict=True)])
    return total.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def set_prf(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """The same of arrays that each row has whole, so that nothing is joined: repeats within a row count once."""
    sets = rows.select(gold.alias("g"), predicted.alias("x"))
    total = sets.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(n) for n, c in (("tp", F.array_intersect("g", "x")), ("fp", F.array_except("x", "g")), ("fn", F.array_except("g", "x")))])
    return total.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def recall_by_relation(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(p, hit, total, recall)"""
    both = gold.select(*TRIPLE).distinct().join(predicted.select(*TRIPLE).distinct().withColumn("x", F.lit(1)), TRIPLE, "left")
    return both.groupBy("p").agg(F.count("x").alias("hit"), F.count("*").alias("total")).withColumn("recall", F.col("hit") / F.col("total"))


def number(c: Column, weight: Column | None) -> Column:
    """How many values there are, or the sum of weights."""
    return F.count(c) if weight is None else F.coalesce(F.sum(c), F.lit(0).cast("long"))


def label_report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from (gold, pred), with macro and weighted means and accuracy. A null prediction is an
    error, not a hit."""
    rows = saved(rows.groupBy("gold", "pred").agg(F.count("*").alias("n")))  # one pass; all else is made of these few
    labels = rows.select(F.explode(F.array("gold", "pred")).alias("label")).filter("label is not null").distinct()
    tp = rows.filter("gold = pred").groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("tp"))
    g = rows.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"))
    x = rows.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("given"))
    each = labels.join(tp, "label", "left").join(g, "label", "left").join(x, "label", "left").na.fill(0)
    each = each.select("label", *prf(F.col("tp"), F.col("given") - F.col("tp"), F.col("support") - F.col("tp")), "support", "tp")
    means = each.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "precision", "recall", "f1", "support")
    weighted = each.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support")
    hits = F.sum("tp") / F.sum("support")
    accuracy = each.agg(hits.alias("precision"), hits.alias("recall"), hits.alias("f1"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), "precision", "recall", "f1", "support")
    return each.drop("tp").unionByName(means).unionByName(weighted).unionByName(accuracy)


def binary_counts(weight: Column | None = None) -> list[Column]:
    """tn, fp, fn, tp over columns gold and pred (booleans). weight: how many rows each stands for."""
    n = lambda g, x: number(F.when((F.col("gold") == g) & (F.col("pred") == x), F.lit(1) if weight is None else weight), weight)
    return [n(False, False).alias("tn"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(True, True).alias("tp")]


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(tn, fp, fn, tp, applicable, skipped); rows without a prediction are skipped."""
    return rows.agg(*binary_counts(), F.count("pred").alias("applicable"), F.count(F.when(F.col("pred").isNull(), 1)).alias("skipped"))


def confusion_table(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(gold, one column for each predicted label)"""
    return rows.groupBy("gold").pivot("pred", labels).count().na.fill(0)


def binary_metrics(matrix: DataFrame) -> DataFrame:
    """The usual ratios of one confusion row; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p, r, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return matrix.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), p.alias("precision"), r.alias("recall"), spec.alias("specificity"), ratio(2 * p * r, p + r).alias("f1"),
        ratio(tn, tn + fn).alias("npv"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ((r + spec) / 2).alias("balanced_accuracy"), mcc.alias("mcc"),
    )


def f1_by(rows: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """(by…, n, precision, recall, f1) from gold and pred booleans; rows without a prediction don't count. weight: how many rows each
    stands for."""
    g = rows.filter("pred is not null").groupBy(*by).agg(number(F.lit(1) if weight is None else weight, weight).alias("n"), *binary_counts(weight))
    return g.select(*by, "n", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def reject_by_negative(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(neg_type, rejected, total, rate) over negatives with a prediction. weight: how many rows each stands for."""
    one = F.lit(1) if weight is None else weight
    g = rows.filter("not gold and pred is not null").groupBy("neg_type").agg(number(F.when(~F.col("pred"), one), weight).alias("rejected"), number(one, weight).alias("total"))
    return g.withColumn("rate", F.col("rejected") / F.col("total"))


def story_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(text, tp, fp, fn, precision, recall, f1): one row for each text of either side; four decimals."""
    g = compared(gold, predicted, ["text", *TRIPLE]).groupBy("text").agg(*counts())
    rounded = [F.round(c, 4).alias(n) for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)]
    return g.select("text", "tp", "fp", "fn", *rounded)


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with their number, from 1, in the order of a column. They are sorted by ranges and written once; a part's rows are
    numbered by their place in it and the sizes of the parts before, of which there are few."""
    place = F.monotonically_increasing_id()
    rows = saved(rows.orderBy(by).withColumn("_at", place))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + at + 1).drop("_at", "_part", "_before")


def per_story(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(story, sentence, tp, fp, fn, precision, recall, f1): the scores of each text, numbered in the order of the texts, which
    are cut at 80 characters."""
    ranked = numbered(story_scores(gold, predicted), "text", "n")
    return ranked.select(F.format_string("story_%03d", "n").alias("story"), F.substring("text", 1, 80).alias("sentence"), "tp", "fp", "fn", "precision", "recall", "f1")


def story_summary(stories: DataFrame) -> DataFrame:
    """(stories, perfect, precision, recall, f1, macro_f1) over `story_scores`."""
    g = stories.agg(F.count("*").alias("stories"), F.count(F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1)).alias("perfect"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    return g.select("stories", "perfect", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "macro_f1")


def compare_systems(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(system, tp, fp, fn, precision, recall, f1, rank) from predictions with a system column; equal F1 share a rank."""
    own = gold.select("text", *TRIPLE).distinct().withColumn("g", F.lit(1))
    total = own.agg(F.count("*").alias("total"))
    both = predicted.select("system", "text", *TRIPLE).distinct().join(own, ["text", *TRIPLE], "left")
    g = both.groupBy("system").agg(F.count("g").alias("tp"), F.count("*").alias("n")).crossJoin(total)  # one row
    g = g.select("system", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("total") - F.col("tp")).alias("fn"))
    g = g.select("system", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("f1"))))


def token_accuracy(rows: DataFrame) -> DataFrame:
    """(n, accuracy) over tokens with gold and pred tags."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)).alias("accuracy"))
