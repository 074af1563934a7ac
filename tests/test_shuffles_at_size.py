"""Shuffles that grow no faster than the rows: partitions follow the rows, frequent keys are looked for once, sides are measured together."""

import pytest
from pyspark.sql import functions as F

from atalaya.functions.amounts import modality_flags
from atalaya.operators.evaluation import split_assignment_join
from atalaya.operators.favoritism import PAIR, fav_features
from atalaya.operators.preprocessing import apply_preprocessor, fit_preprocessor
from atalaya.operators.skew import hot_split_join
from atalaya.operators.splitting import GROUP, family_after_fill, frac_features, with_family, with_family_of_texts, with_known_family
from atalaya.plans.evaluate import MODEL_AMOUNT, _group_features, _pair_features, _prepared, _sided_by_family
from atalaya.runtime import SHUFFLE_ROWS, START_PARTITIONS, deal


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def _contracts(contracts):
    made = contracts([
        {
            "id_proveedor": f"P{i % 13}", "id_entidad": None if i % 17 == 0 else f"E{i % 3}", "id_funcionario": f"F{i % 5}", "monto": None if i % 7 == 0 else i * 10.0,
            "objeto": ["cemento", "acero", None][i % 5 % 3], "modalidad": "Contratación Directa" if i % 3 else None,
        }
        for i in range(300)
    ])
    return made.withColumn("label_favoritismo", F.col("id_proveedor") == "P1")


def test_partitions_follow_the_rows(spark):
    deal(spark, 9 * SHUFFLE_ROWS + 1)
    try:
        assert spark.conf.get(START_PARTITIONS) == "10"
    finally:
        deal(spark, 1)
    assert spark.conf.get(START_PARTITIONS, None) is None


def test_without_frequent_keys_facts_are_shuffled_once(spark, no_broadcast):
    facts = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = hot_split_join(facts, counts.withColumnRenamed("n", "m"), ["k"], counts, "n")
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where("m = 100").count() == 1000


def test_sides_measured_together_have_the_features_of_each_side(contracts):
    made = _contracts(contracts)
    assigned = made.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_contratos")).withColumn("is_holdout", F.col("id_proveedor").isin("P2", "P5", "P9"))
    features, state = _pair_features(made, assigned)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for side, holdout in zip(split_assignment_join(made, assigned, PAIR), (False, True), strict=True):
        alone = fav_features(apply_preprocessor(side, state), label="label_favoritismo", amount=MODEL_AMOUNT)
        together = features.where(F.col("is_holdout") == holdout).drop("is_holdout")
        assert together.columns == alone.columns
        assert rows(together) == rows(alone) != []


def test_activity_counts_days_whatever_the_time(contracts):
    made = contracts([{"fecha_contrato": "2024-01-01T23:00:00"}, {"fecha_contrato": "2024-01-03T01:00:00"}])
    features = fav_features(made.withColumns(modality_flags(F.col("modalidad"))))
    assert "_day" in features._jdf.queryExecution().executedPlan().toString()
    assert [r["dias_actividad"] for r in features.collect()] == [2]


def test_families_of_texts_are_those_of_rows(contracts):
    made = _contracts(contracts).withColumn("categoria_principal", F.when(F.col("monto") > 500, "Goods"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    whole = rows(with_family(made))
    assert rows(with_family_of_texts(made)) == whole != []
    assert rows(with_family_of_texts(made, most=1)) == whole
    assert rows(with_family_of_texts(made.drop("categoria_principal"))) == rows(with_family(made.drop("categoria_principal")))


def test_group_sides_have_the_features_of_their_contracts(contracts):
    """Families are made once a text; missing objects still move to the family of the most frequent one."""
    made = _contracts(contracts).withColumn("label_fraccionamiento", F.col("id_contrato").endswith("3"))
    sided, assigned = _sided_by_family(made)
    features, state = _group_features(sided.where("NOT is_holdout"), sided.where("is_holdout"))
    plain = [side.drop("objeto_familia") for side in split_assignment_join(with_family(made), assigned, GROUP)]
    (fit_rows, check_rows), expected = _prepared(plain[0], *plain)
    assert {k: v for k, v in state.items() if "location" not in k} == {k: v for k, v in expected.items() if "location" not in k}
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for got, side in zip(features, (fit_rows, check_rows), strict=True):
        assert rows(got) == rows(frac_features(side, label="label_fraccionamiento")) != []


def test_known_families_give_the_features_of_filled_contracts(contracts):
    """Training and scoring look families up before missing objects are filled."""
    made = _contracts(contracts).withColumn("categoria_principal", F.when(F.col("monto") > 500, "Goods"))
    state = fit_preprocessor(made)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for own in (made, made.drop("categoria_principal")):
        named = family_after_fill(apply_preprocessor(with_known_family(own), state))
        assert rows(frac_features(named, family="_family")) == rows(frac_features(apply_preprocessor(own, state))) != []
