import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators import drift, evaluation, favoritism, isolation, models
from atalaya.plans import train


def labelled(spark, groups_per_label=8):
    rows = [(f"P{i}", "E1", i < groups_per_label, f"C{i}-{k}") for i in range(2 * groups_per_label) for k in range(3)]
    return spark.createDataFrame(rows, "id_proveedor string, id_entidad string, label_favoritismo boolean, id_contrato string")


def test_split_is_stratified_and_stable(spark):
    contracts = labelled(spark)
    assigned = evaluation.holdout_split_pair(contracts)
    assert evaluation.require_both_labels(assigned) == {0: 8, 1: 8}
    held = {(r["id_proveedor"], r["label"]) for r in assigned.where("is_holdout").collect()}
    again = evaluation.holdout_split_pair(contracts.repartition(7)).where("is_holdout")
    assert held == {(r["id_proveedor"], r["label"]) for r in again.collect()}
    assert len(held) == 4 and {label for _, label in held} == {0, 1}
    development, holdout = evaluation.split_assignment_join(contracts, assigned)
    assert development.count() + holdout.count() == 48
    assert evaluation.disjoint_split_check(development, holdout).first()["n_compartidos"] == 0
    with pytest.raises(GateError):
        evaluation.require_both_labels(evaluation.holdout_split_pair(labelled(spark, 3)))


def test_validation_and_folds(spark):
    groups = spark.createDataFrame([(f"P{i}", "E", "f", i % 2) for i in range(18)], "id_proveedor string, id_entidad string, objeto_familia string, label int")
    fit_rows, check_rows = evaluation.validation_split(groups, 11)
    assert (fit_rows.count(), check_rows.count()) == (12, 6)
    assert {r["label"] for r in check_rows.collect()} == {0, 1}
    folds = evaluation.stratified_folds(groups, 3).groupBy("label", "fold").count().collect()
    assert len(folds) == 6 and {r["count"] for r in folds} == {3}


def test_metrics_of_the_small_case(spark):
    scored = spark.createDataFrame([("a", 1, 0.95), ("b", 0, 0.80), ("c", 1, 0.70), ("d", 0, 0.10)], "id string, label int, score double")
    metrics = evaluation.holdout_metrics(scored)
    assert metrics["precision"] == pytest.approx(2 / 3) and metrics["recall"] == 1.0 and metrics["recall_at_k"] == 0.5
    assert metrics["auc_roc"] == 0.75 and metrics["accuracy"] == 0.75
    assert all(0 <= v <= 1 for v in metrics.values()) and len(metrics) == 7
    with pytest.raises(GateError):
        evaluation.holdout_metrics(scored.where("label = 1"))
    none = evaluation.recall_at_k(scored.where("label = 0")).first()
    assert none["recall_at_k"] is None


def test_rank_ties_go_by_id(spark):
    scored = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 0, 0.5)], "id string, label int, score double")
    marked = {r["id"]: r["pred"] for r in evaluation.rank_predictions(scored).collect()}
    assert marked == {"a": 1, "b": 0, "c": 0}


def test_union_needs_equal_columns(spark):
    with pytest.raises(Exception):
        evaluation.union_train_batch(spark.range(1), spark.range(1).withColumnRenamed("id", "x")).collect()


def pair_rows(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        label = int(i % 6 == 0)
        values = [float(rng.randint(1, 9)) for _ in favoritism.PAIR_FEATURES]
        values[4] = 0.9 if label else rng.random() * 0.4
        rows.append((f"P{i}", "E1", *values, label))
    columns = ", ".join(f"{c} double" for c in favoritism.PAIR_FEATURES)
    return spark.createDataFrame(rows, f"id_proveedor string, id_entidad string, {columns}, label int").cache()


def test_forest_learns_an_evident_signal(spark):
    rows = pair_rows(spark)
    weights = {r["label"]: r["peso"] for r in models.class_weights(rows).select("label", "peso").distinct().collect()}
    assert weights == {1: 120 / 40, 0: 120 / 200}
    model, tried = models.rf_tune(rows, {"numTrees": [5], "maxDepth": [2, 3]}, 3)
    assert tried.count() == 2 and tried.first()["auc_pr_cv"] > 0.95
    scored = models.score_pairs(rows, model)
    assert scored.where("score_riesgo_favoritismo not between 0 and 1").count() == 0
    top = favoritism.rank_favoritism(scored).limit(20).collect()
    assert sum(r["label"] for r in top) >= 18
    first = models.rf_importances(spark, model).first()
    assert first["variable"] == "pct_contratacion_directa"
    with pytest.raises(GateError, match="both classes"):
        models.class_weights(rows.where("label = 0"))


def test_distance_to_the_own_center(spark):
    rows = spark.createDataFrame([(0, Vectors.dense(3.0, 4.0)), (1, Vectors.dense(1.0, 1.0))], ["cluster", "features"])
    rows = rows.withColumn("cluster", F.col("cluster").cast("int"))
    found = models.centroid_distance(rows, [[0.0, 0.0], [1.0, 1.0]]).orderBy("cluster").collect()
    assert [r["score_anomalia"] for r in found] == [5.0, 0.0]


def test_isolation_forest_finds_outliers_and_is_repeatable(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(600)] + [("far1", 12.0, -12.0), ("far2", -15.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    scored = [
        isolation.isolation_forest(part, ["x", "y"], ["k"], trees=60, sample=64).orderBy(F.desc("score_aislamiento"))
        for part in (df, df.repartition(6))
    ]
    assert {r["k"] for r in scored[0].limit(2).collect()} == {"far1", "far2"}
    values = [{r["k"]: r["score_aislamiento"] for r in s.collect()} for s in scored]
    assert values[0] == values[1] and len(values[0]) == 602
    assert all(0 < v < 1 for v in values[0].values())
    pool = isolation.isolation_forest(df, ["x", "y"], ["k"], trees=5, sample=16)
    # Five trees of 16 rows give many equal scores; the mark never exceeds its share.
    assert pool.count() == 602 and 1 <= pool.where("anomalia = 1").count() <= 13


def test_isolation_by_levels(spark):
    """Large nodes are cut in Spark, and both ways of scoring give one result."""
    rng = random.Random(4)
    rows = [(f"k{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)] + [(f"far{i}", 15.0 + i, -12.0) for i in range(2)]
    rows += [(f"same{i}", 0.5, 0.5) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    forest = isolation.isolation_train(df, ["x", "y"], ["k"], trees=12, share=0.8, node_rows=60)
    assert forest.size == int(0.8 * 592) and forest.levels >= 3
    grown = forest.nodes.toPandas()
    # The repeated row can't be divided, so its node is one leaf above the bound.
    assert grown.groupby(["tree", "place"]).size().max() <= 2 * 60 and set(grown["tree"]) == set(range(12))
    sent = isolation.isolation_score(df, ["x", "y"], forest)
    joined = isolation.isolation_score(df, ["x", "y"], forest, sent_nodes=0)
    one, other = ({r["k"]: r["score_aislamiento"] for r in d.collect()} for d in (sent, joined))
    assert one == pytest.approx(other) and len(one) == 592
    assert {k for k, _ in sorted(one.items(), key=lambda kv: -kv[1])[:2]} == {"far0", "far1"}
    whole = isolation.isolation_score(df, ["x", "y"], isolation.isolation_train(df, ["x", "y"], ["k"], trees=12, share=0.8))
    assert {r["k"] for r in whole.orderBy(F.desc("score_aislamiento")).limit(2).collect()} == {"far0", "far1"}


def test_contamination(spark):
    scored = spark.createDataFrame([(f"k{i}", int(i >= 95), float(i)) for i in range(100)], "id string, label int, score double")
    marked = isolation.contamination_cut(scored, 0.05)
    assert marked.where("pred = 1").count() == 5
    best = isolation.choose_contamination([scored, scored]).first()
    assert best["contaminacion"] == "0.05" and best["f1_validacion_medio"] == 1.0


def test_psi_of_equal_shifted_and_constant_columns(spark):
    old = spark.createDataFrame([(float(i), 1.0) for i in range(100)], "x double, c double")
    same = {r["variable"]: r["psi"] for r in drift.psi(old, old, ["x", "c"]).collect()}
    assert same["x"] == pytest.approx(0) and same["c"] == pytest.approx(0)
    moved = drift.psi(old, old.withColumn("x", F.col("x") + 1000), ["x"]).first()["psi"]
    # All new rows in the last of ten bins: (0.9) ln(10) there, and nine bins against the floor.
    import math

    expected = (1 - 0.1) * math.log(10) + 9 * (1e-4 - 0.1) * math.log(1e-4 / 0.1)
    assert moved == pytest.approx(expected, rel=0.02)


def test_a_stored_baseline_replaces_the_old_rows(spark, tmp_path):
    rng = random.Random(9)
    old = spark.createDataFrame([(rng.gauss(0, 1), float(i % 3), None) for i in range(500)], "x double, c double, e double")
    new = spark.createDataFrame([(rng.gauss(0.5, 1), float(i % 2), 1.0) for i in range(300)], "x double, c double, e double")
    columns = ["x", "c", "e"]
    drift.psi_baseline(old, columns).write.parquet(f"{tmp_path}/base")
    stored = spark.read.parquet(f"{tmp_path}/base")
    assert stored.count() <= 10 + 3
    got = {r["variable"]: r["psi"] for r in drift.psi_against(stored, new, columns).collect()}
    assert got == pytest.approx({r["variable"]: r["psi"] for r in drift.psi(old, new, columns).collect()})
    # By numpy: ten bins by the old rows' quantiles; a column without old rows has no baseline.
    import numpy as np

    before, after = ([r["x"] for r in d.collect()] for d in (old, new))
    edges = np.quantile(before, [i / 10 for i in range(1, 10)])
    p, q = (np.maximum(np.bincount(np.searchsorted(edges, v, side="right"), minlength=10) / len(v), 1e-4) for v in (before, after))
    assert got["x"] == pytest.approx(float(((q - p) * np.log(q / p)).sum())) and set(got) == {"x", "c"}


def test_retraining_needs_labels_and_never_promotes(spark):
    reports = spark.createDataFrame([("a", "x", 0.3), ("b", "x", 0.1), ("c", "x", 0.9)], "lote string, variable string, psi double")
    recalls = spark.createDataFrame([("b", 0.5)], "lote string, recall_at_k double")
    labels = spark.createDataFrame([("a", False), ("b", True)], "lote string, tiene_labels boolean")
    found = {r["lote"]: r for r in drift.retrain_decision(reports, recalls, labels).collect()}
    assert found["a"]["retraining_required"] and not found["a"]["candidate_allowed"]
    assert found["b"]["trigger_recall"] and found["b"]["candidate_allowed"] and not found["b"]["trigger_drift"]
    assert not found["c"]["candidate_allowed"] and not any(r["automatic_promotion"] for r in found.values())


def test_recall_and_labels_of_a_batch(spark):
    schema = "id string, label int, score double"
    # Two positives; the tie at 0.5 goes to the smaller id, so one of them is among the best two.
    rows = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.5), ("c", 1, 0.9), ("d", 0, 0.1)], schema)
    assert drift.batch_recall(rows, "x").collect() == [("x", 0.5)] and drift.batch_labels(rows, "x").collect() == [("x", True)]
    partly = rows.unionByName(spark.createDataFrame([("e", None, 1.0)], schema))
    assert drift.batch_recall(partly, "x").first()["recall_at_k"] == 0.5 and not drift.batch_labels(partly, "x").first()["tiene_labels"]
    for nothing in (rows.where("label = 0"), rows.limit(0)):
        assert drift.batch_recall(nothing, "x").collect() == [("x", None)]
    assert drift.batch_labels(rows.limit(0), "x").collect() == [("x", False)]


def test_training_refuses_evidence_of_another_corpus():
    good = {"training_data_fingerprint_sha256": "x", "mejor_configuracion": {"k": 3}}
    assert train.require_evidence(good, "x", ["k"], "n") == {"k": 3}
    for evidence in (None, {**good, "training_data_fingerprint_sha256": "y"}, {**good, "mejor_configuracion": {}}):
        with pytest.raises(GateError):
            train.require_evidence(evidence, "x", ["k"], "n")


def group_rows(spark, n=90):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        label = int(i % 9 == 0)
        values = [rng.gauss(0, 1) + (9 if label else 0) for _ in models.GROUP_FEATURES]
        rows.append((f"P{i}", "E1", "f", *values, label))
    columns = ", ".join(f"{c} double" for c in models.GROUP_FEATURES)
    return spark.createDataFrame(rows, f"id_proveedor string, id_entidad string, objeto_familia string, {columns}, label int")


def test_cluster_tuning_reports_each_k(spark):
    found = models.kmeans_tune(group_rows(spark), [2, 3], [11]).collect()
    areas = [r["auc_pr_validacion_medio"] for r in found]
    assert sorted(r["k"] for r in found) == [2, 3] and areas == sorted(areas, reverse=True)
    assert all(0 <= r["recall_at_k_validacion_medio"] <= 1 for r in found)


def test_isolation_grid_ranks_outliers(spark):
    found = isolation.ranking_param_grid(group_rows(spark), {"arboles": [20], "proporcion": [0.1, 0.2]}, [11]).collect()
    assert {r["proporcion"] for r in found} == {0.1, 0.2}
    assert found[0]["auc_pr_medio"] > 0.9


def test_classifiers_are_compared_out_of_fold(spark):
    found = models.compare_classifiers(pair_rows(spark), 3).collect()
    assert {r["modelo"] for r in found} == {"regresion_logistica", "bosque_aleatorio", "potenciacion_gradiente"}
    assert found[0]["auc_pr"] > 0.9 and all(0 <= r[m] <= 1 for r in found for m in models.METRICS)


def test_grid_metrics_equal_those_of_each_setting(spark):
    rng = random.Random(4)
    rows = [(k, f"I{i:03}", int(rng.random() < 0.4), float(rng.randrange(6) + k)) for k in (2, 5) for i in range(80)]
    scored = spark.createDataFrame(rows, "k int, id string, label int, score double")
    found = evaluation.grid_metrics(scored, "k")
    for k in (2, 5):
        alone = evaluation.holdout_metrics(scored.where(F.col("k") == k), by_rank=True)
        assert found[k]["recall_at_k"] == alone["recall_at_k"] and found[k]["auc_pr"] == pytest.approx(alone["auc_pr"])
    with pytest.raises(GateError):
        evaluation.grid_metrics(scored.withColumn("label", F.lit(1)), "k")


def test_cluster_tuning_orders_its_rows_once_a_seed(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(models, "spread", lambda *a, own=models.spread: calls.append(1) or own(*a))
    models.kmeans_tune(group_rows(spark), [2, 3], [11])
    assert len(calls) == 1


def test_isolation_grid_grows_one_forest_a_share(spark, monkeypatch):
    sizes, grown, rows = [5, 12], [], group_rows(spark)
    monkeypatch.setattr(isolation, "isolation_train", lambda *a, own=isolation.isolation_train, **o: grown.append(o) or own(*a, **o))
    isolation.ranking_param_grid(rows, {"arboles": sizes, "proporcion": [0.5]}, [11])
    assert [o["trees"] for o in grown] == [12]
    # The first trees are the forest that a fit of fewer trees gives, sent to all tasks or met in joins.
    train = lambda n: isolation.isolation_train(rows, models.GROUP_FEATURES, models.GROUP, trees=n, share=0.5, seed=11, node_rows=20)
    whole, small = train(12), train(5)
    alone = {r["id_proveedor"]: r["score_aislamiento"] for r in isolation.isolation_score(rows, models.GROUP_FEATURES, small).collect()}
    for sent in (10**6, 0):
        nested = isolation._prefix_scores(rows, models.GROUP_FEATURES, whole, sizes, sent).collect()
        assert {r["id_proveedor"]: pytest.approx(r["_scores"][0]) for r in nested} == alone


def test_partitions_of_a_fit_do_not_follow_the_rows_without_end():
    from atalaya.runtime import fit_partitions

    assert [fit_partitions(n) for n in (0, 9_999, 25_000, 9_000_000, 64_000_001)] == [1, 1, 3, 64, 65]


def test_written_lines_are_joined_once(spark):
    from atalaya.checks.proxies import Tables

    plain = Tables(spark, "/root/testdata/sf0.001")
    kept = plain.written()
    assert "Join" not in kept.training._jdf.queryExecution().optimizedPlan().toString()
    assert kept.training.exceptAll(plain.training).isEmpty() and kept.training.count() == plain.training.count()


def test_grid_trees_are_grown_from_points_in_few_tasks(spark, monkeypatch):
    import numpy as np

    rows = group_rows(spark)
    again = rows.unionByName(rows.withColumn("id_proveedor", F.concat(F.lit("Q"), "id_proveedor")))
    sided = evaluation.validation_sides(again, 11)
    points, distinct = isolation._points(sided), again.select(*isolation.GROUP_FEATURES).distinct().count()
    counts = points.agg(F.count("_id").alias("n"), F.sum("_fitted").alias("f"), F.sum("_checked").alias("c")).first()
    assert counts["n"] == distinct < counts["f"] + counts["c"] == again.count()
    monkeypatch.setattr(isolation, "TASK_TREES", 2)
    forest = isolation.isolation_train(again, models.GROUP_FEATURES, models.GROUP, trees=5, share=0.5, written=False)
    assert forest.nodes is None
    kept = points.persist()
    by_order = [
        {r["_id"]: r["_scores"] for r in isolation._grow_and_score(df, models.GROUP_FEATURES, {0.5: forest, 1.0: forest}, [2, 5], 11).collect()}
        for df in (kept, kept.repartition(3).orderBy(F.desc("_id")))
    ]
    assert by_order[0] == by_order[1] and len(by_order[0]) == kept.where("_checked > 0").count()
    assert all(len(s) == 4 and all(0 < v < 1 for v in s) for s in by_order[0].values())
    # Points that fall while a tree grows end where the written tree has them; a point of weight 2 counts as two rows.
    x = np.random.default_rng(5).integers(0, 9, (200, 3)).astype(float)
    nodes = isolation._grow_by_level(x, np.random.default_rng(3), 6)
    fallen = isolation._fallen_depths(np.ascontiguousarray(x.T), np.ones(200, int), x.T.copy(), np.random.default_rng(3), 6)
    assert fallen.tolist() == isolation._depths(x, nodes[1:]).tolist()
    places, weight = np.unique(x, axis=0, return_counts=True)
    joined = isolation._fallen_depths(np.ascontiguousarray(places.T), weight, x.T.copy(), np.random.default_rng(3), 6)
    assert joined.tolist() == pytest.approx(fallen.tolist())
