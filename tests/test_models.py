"""Rows-only model queries: fixed seeds, row counts, bounds, basic sanity."""

import pytest
from pyspark.sql import functions as F

from demandflow.operators import models as md
from demandflow.plans import QUERIES
from demandflow.sources.observations import observations


@pytest.fixture(scope="module")
def n_target(spark, sf_dir):
    return observations(spark, sf_dir).where(F.col("day") > 20).count()


def test_gbt_predictions_one_row_per_target_row(spark, sf_dir, n_target):
    df = QUERIES["gbt_predictions"](spark, sf_dir)
    assert df.count() == n_target
    assert df.where(F.col("gbt_a").isNull() | F.col("gbt_b").isNull() | F.col("gbt_c").isNull()).count() == 0


def test_blend_optimal_weights_on_simplex(spark, sf_dir):
    rows = QUERIES["blend_optimal"](spark, sf_dir).collect()
    assert abs(sum(r["weight"] for r in rows) - 1) < 1e-9 and all(r["weight"] >= 0 for r in rows)


def test_native_categories_keep_unseen_levels(spark, sf_dir):
    df = QUERIES["native_categories"](spark, sf_dir)
    assert df.where(F.col("road_type_idx").isNull()).count() == 0


def test_spatial_clusters_assign_nearest_centre(spark, sf_dir):
    pdf = QUERIES["spatial_clusters"](spark, sf_dir).toPandas()
    cent = pdf.groupby("cluster")[["lat", "lon"]].mean()
    assert len(cent) <= 30 and pdf.cluster.notna().all()


def test_final_predictions_are_clipped(spark, sf_dir):
    df = QUERIES["final_predictions"](spark, sf_dir)
    s = df.agg(F.min("demand").alias("lo"), F.max("demand").alias("hi"), F.count("*").alias("n")).first()
    assert s["n"] > 0 and s["lo"] >= 0.0 and s["hi"] <= 1.0


def test_write_and_weights_roundtrip(spark, sf_dir, n_target):
    assert QUERIES["write_predictions"](spark, sf_dir).count() == n_target
    w = QUERIES["weights_roundtrip"](spark, sf_dir).first().asDict()
    assert abs(w["w_pa"] + w["w_pb"] + w["w_pc"] - 1) < 1e-9


def test_model_roundtrip_identical_predictions(spark, sf_dir):
    r = QUERIES["model_roundtrip"](spark, sf_dir).first()
    assert r["n"] > 0 and r["max_abs_diff"] == 0.0


def test_presets_have_the_reference_tree_count(spark):
    assert md.GBT_TREES >= 300
    assert [md.gbt(["x"], "y", name).getStages()[-1].getMaxIter() for name in md.GBT_PRESETS] == [md.GBT_TREES] * 3
    assert md.gbt(["x"], "y", "gbt_b", maxIter=7).getStages()[-1].getMaxIter() == 7


def test_adversarial_classifier_defaults(spark):
    c = md.gbt_classifier(["x"], "y").getStages()[-1]
    assert (c.getMaxIter(), c.getMaxDepth(), c.getStepSize()) == (100, 5, 0.1)
    assert md.gbt_classifier(["x"], "y", maxIter=3).getStages()[-1].getMaxIter() == 3
