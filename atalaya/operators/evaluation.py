"""Stratified splits by hash order, ranks and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators.contract import count_flag
from atalaya.operators.favoritism import PAIR
from atalaya.operators.ordering import (
    global_row_number,
    hash_row_number,
    running_counts,
    value_counts,
)
from atalaya.operators.skew import hot_split_join
from atalaya.operators.splitting import GROUP, with_family
from atalaya.runtime import discard, materialize

# --- fixed values -----------------------------------------------------------
HOLDOUT_ONE_IN, VALIDATION_ONE_IN = 4, 3
MIN_GROUPS_PER_LABEL = 6
DECISION_THRESHOLD = 0.5
KEY_JOINT = "§"
# ----------------------------------------------------------------------------


def group_id(keys: Sequence[str]) -> Column:
    return F.concat_ws(KEY_JOINT, *keys)


def _hash_order(keys: Sequence[str], salt: str) -> Column:
    """Order that depends on key and salt only, equal in any engine with md5."""
    return F.md5(F.concat_ws(KEY_JOINT, *keys, F.lit(salt)))


def _numbered(groups: DataFrame, label: str, keys: Sequence[str], salt: str) -> DataFrame:
    hashed = groups.withColumn("_hash", _hash_order(keys, salt))
    return hash_row_number(hashed, [label], "_hash", keys, "_number").drop("_hash")


def stratified_folds(groups: DataFrame, folds: int, salt: str = "folds", keys: Sequence[str] = PAIR) -> DataFrame:
    """Adds `fold` 0..folds-1, dealt out inside each label in hash order."""
    numbered = _numbered(groups, "label", keys, salt)
    return numbered.withColumn("fold", F.pmod("_number", F.lit(folds)).cast("int")).drop("_number")


def _holdout(contracts: DataFrame, keys: Sequence[str], label: str, salt: str) -> DataFrame:
    grouped = contracts.groupBy(*keys).agg(
        F.max(F.col(label).cast("int")).alias("label"), F.count(F.lit(1)).alias("n_contratos")
    )
    # Written once: the numbering reads it twice.
    groups = materialize(grouped, "groups")
    numbered = _numbered(groups, "label", keys, salt)
    return numbered.withColumn("is_holdout", F.pmod("_number", F.lit(HOLDOUT_ONE_IN)) == 0).drop("_number")


def holdout_split_pair(contracts: DataFrame, label: str = "label_favoritismo") -> DataFrame:
    """Pairs with their label, contracts and whether they belong to the 25 percent holdout."""
    return _holdout(contracts, PAIR, label, "holdout-pair")


def holdout_split_family(contracts: DataFrame, label: str = "label_fraccionamiento", *, keyed: bool = False) -> DataFrame:
    """The same by supplier, entity and object family; `keyed` contracts have their family."""
    return _holdout(contracts if keyed else with_family(contracts), GROUP, label, "holdout-family")


def require_both_labels(assigned: DataFrame, minimum: int = MIN_GROUPS_PER_LABEL) -> dict[int, int]:
    """Groups with and without the label; refuses fewer than `minimum` of either, or other labels."""
    row = assigned.agg(
        count_flag(F.col("label") == 1).alias("with_label"), count_flag(F.col("label") == 0).alias("without"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if row["with_label"] + row["without"] < row["groups"]:
        raise GateError(f"{row['groups'] - row['with_label'] - row['without']} groups have a label other than 0 and 1")
    if min(row["with_label"], row["without"]) < minimum:
        raise GateError(f"{row['without']} groups of label 0 and {row['with_label']} of label 1; each needs {minimum}")
    return {0: row["without"], 1: row["with_label"]}


def split_assignment_join(
    contracts: DataFrame, assigned: DataFrame, keys: Sequence[str] = PAIR
) -> tuple[DataFrame, DataFrame]:
    """Contracts divided into development and holdout by the assignment of their group.

    A group that holds much of all contracts is spread over several tasks.
    """
    # Written once: both sides read it, and the division stays fixed.
    side = materialize(assigned.select(*keys, "is_holdout", "n_contratos"), "assignment")
    joined = hot_split_join(contracts, side.drop("n_contratos"), keys, side, "n_contratos")
    development = joined.where(~F.col("is_holdout")).drop("is_holdout")
    return development, joined.where(F.col("is_holdout")).drop("is_holdout")


def _validated(groups: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    numbered = _numbered(groups, "label", keys, f"validation-{int(seed)}")
    return numbered.withColumn("_validates", F.pmod("_number", F.lit(VALIDATION_ONE_IN)) == 0).drop("_number")


def validation_split(groups: DataFrame, seed: int, keys: Sequence[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """Development groups divided for one seed: two thirds to fit, one third to validate."""
    sided = _validated(groups, seed, keys)
    return tuple(sided.where(side).drop("_validates") for side in (~F.col("_validates"), F.col("_validates")))


def validation_sides(groups: DataFrame, seed: int, keys: Sequence[str] = GROUP) -> DataFrame:
    """The same division as one table that is written once; `_validates` tells the sides."""
    return materialize(_validated(groups, seed, keys), "validation")


def disjoint_split_check(development: DataFrame, holdout: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Number of groups that occur on both sides; it must be zero."""
    sides = development.select(*keys, F.lit(1).alias("_side")).unionByName(holdout.select(*keys, F.lit(2).alias("_side")))
    # Contracts of a group meet as at most one row per task; a null key is no group.
    groups = sides.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    return groups.agg(count_flag(F.col("_low") < F.col("_high")).cast("bigint").alias("n_compartidos"))


def union_train_batch(train: DataFrame, batch: DataFrame) -> DataFrame:
    """Training corpus and labelled batch; both must have the same columns."""
    return train.unionByName(batch, allowMissingColumns=False)


# --- metrics ------------------------------------------------------------------


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion_counts(predicted: DataFrame) -> DataFrame:
    """Counts and rates from `label` and `pred`; a rate without denominator is zero."""
    label, pred = F.col("label") == 1, F.col("pred") == 1
    counted = predicted.agg(
        F.count(F.lit(1)).alias("n"),
        count_flag(label).alias("positivos"),
        count_flag(label & pred).alias("tp"),
        count_flag(~label & pred).alias("fp"),
        count_flag(~label & ~pred).alias("tn"),
        count_flag(label & ~pred).alias("fn"),
    ).fillna(0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": _ratio(tp + F.col("tn"), F.col("n")),
        }
    )


def threshold_metrics(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Confusion counts of `score >= threshold`."""
    return confusion_counts(scored.withColumn("pred", (F.col("score") >= threshold).cast("int")))


def numbered_by_score(scored: DataFrame, score: str = "score", tie: str = "id") -> DataFrame:
    """Adds `rango`, 1 for the best score, ties by id; a distributed sort."""
    return global_row_number(scored, [F.desc(score), F.asc(tie)], "rango")


def count_positives(scored: DataFrame) -> int:
    return scored.agg(F.coalesce(count_flag(F.col("label") == 1), F.lit(0)).alias("n")).first()["n"]


def rank_predictions(scored: DataFrame, score: str = "score", tie: str = "id") -> DataFrame:
    """Marks as many of the best scores as there are positives (`pred` 0/1)."""
    positives = count_positives(scored)
    numbered = numbered_by_score(scored, score, tie)
    return numbered.withColumn("pred", (F.col("rango") <= positives).cast("int"))


def recall_at_k(scored: DataFrame, score: str = "score", tie: str = "id") -> DataFrame:
    """Positives among the k best scores over k, the number of positives; null without any."""
    ranked = rank_predictions(scored, score, tie)
    hits = ranked.agg(
        count_flag((F.col("label") == 1) & (F.col("pred") == 1)).alias("hits"),
        count_flag(F.col("label") == 1).alias("k"),
    )
    return hits.select("hits", "k", F.try_divide(F.col("hits"), F.col("k")).alias("recall_at_k"))


def auc_metrics(scored: DataFrame, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Areas under ROC and under precision-recall, in one row (per group).

    Both come from running counts over the distinct scores, best first, so no single
    task ranks all rows. ROC is the rank sum in which a tie counts one half. The
    precision-recall curve is joined by straight lines and starts at recall 0 with the
    precision of the best score.
    """
    return _areas(_score_counts(scored, score, list(groups)), list(groups))


def _score_counts(scored: DataFrame, score: str, groups: list[str]) -> DataFrame:
    """Rows of each label per distinct score, best first."""
    is_positive = F.col("label") == 1
    # Negated, so that "before" means a better score.
    descending = scored.select(*groups, "label", (-F.col(score).cast("double")).alias("_down"))
    return value_counts(
        descending, "_down", groups, counts={"pos": F.count_if(is_positive), "neg": F.count_if(~is_positive)}
    )


def _areas(counted: DataFrame, groups: list[str]) -> DataFrame:
    sides = ("pos", "neg")
    running = running_counts(counted, groups, sides)

    beaten = F.col("neg_total") - F.col("neg_before") - F.col("neg") / 2
    better = F.col("pos_before") + F.col("neg_before")
    precision_here = (F.col("pos_before") + F.col("pos")) / (better + F.col("pos") + F.col("neg"))
    precision_before = F.when(better > 0, F.try_divide(F.col("pos_before"), better)).otherwise(precision_here)
    return running.groupBy(*groups).agg(
        F.max("pos_total").alias("positivos"),
        F.max("neg_total").alias("negativos"),
        F.sum(F.col("pos") * beaten).alias("_wins"),
        F.sum(F.col("pos") * (precision_here + precision_before) / 2).alias("_area"),
    ).select(
        *groups,
        "positivos",
        "negativos",
        F.try_divide("_wins", F.col("positivos").cast("double") * F.col("negativos")).alias("auc_roc"),
        F.try_divide("_area", F.col("positivos")).alias("auc_pr"),
    )


def grid_metrics(scored: DataFrame, group: str) -> dict:
    """Area under precision-recall and recall@k of every setting in column `group`, for scored rows (group, id, label, score).

    All settings share one count of distinct scores. Only rows that tie at the last place are put in order by id.
    """
    counted = materialize(_score_counts(scored, "score", [group]).withColumn("n", F.col("pos") + F.col("neg")), "counts")
    try:
        totals = {r[group]: (r["n"], r["pos"]) for r in counted.groupBy(group).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
        if not totals or any(pos in (0, n) for n, pos in totals.values()):
            raise GateError("evaluation needs rows of both labels")
        areas = {r[group]: r["auc_pr"] for r in _areas(counted, [group]).collect()}
        wanted = F.coalesce(*[F.when(F.col(group) == F.lit(s), F.lit(pos)) for s, (_n, pos) in totals.items()])
        edges = running_counts(counted, [group], ("n", "pos"), wanted=lambda first, last, _total: (first < wanted) & (last >= wanted - 1)).collect()
    finally:
        discard(counted)
    hits = {}
    for r in edges:
        room = totals[r[group]][1] - r["n_before"]
        if room == r["n"]:
            inside = r["pos"]
        else:
            tied = scored.where((F.col(group) == F.lit(r[group])) & (F.col("score") == F.lit(-r["value"]))).select("id", "label")
            numbered = global_row_number(tied, [F.asc("id")], "rango")
            inside = numbered.agg(F.coalesce(count_flag((F.col("label") == 1) & (F.col("rango") <= room)), F.lit(0)).alias("h")).first()["h"]
        hits[r[group]] = r["pos_before"] + inside
    return {s: {"auc_pr": areas[s], "recall_at_k": hits[s] / pos} for s, (_n, pos) in totals.items()}


def holdout_metrics(scored: DataFrame, *, by_rank: bool = False) -> dict:
    """The seven metrics of a scored holdout (id, label, score) as scalars.

    `by_rank` predicts as many positives as there are; otherwise the cut is 0.5. The
    scored rows are written once, in order; everything else reads them from there.
    """
    numbered = numbered_by_score(scored.select("id", "label", "score"))
    positives = count_positives(numbered)
    ranked = F.col("rango") <= positives
    predicted = ranked if by_rank else F.col("score") >= DECISION_THRESHOLD
    counts = confusion_counts(numbered.withColumn("pred", predicted.cast("int"))).first()
    if not counts["n"] or counts["positivos"] in (0, counts["n"]):
        raise GateError("evaluation needs rows of both labels")
    hits = counts["tp"] if by_rank else numbered.agg(count_flag((F.col("label") == 1) & ranked).alias("h")).first()["h"]
    areas = auc_metrics(numbered).first()
    return {
        "accuracy": counts["accuracy"],
        "auc_pr": areas["auc_pr"],
        "auc_roc": areas["auc_roc"],
        "precision": counts["precision"],
        "recall": counts["recall"],
        "f1": counts["f1"],
        "recall_at_k": hits / counts["positivos"],
    }
