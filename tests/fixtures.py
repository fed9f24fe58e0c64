"""Small in-test tables (schemas and values from the reproduced tests)."""

from postrank import schemas
from postrank.dims import FEATURE_NAMES, RANGE_FEATURES

SF = "/root/testdata/sf0.001"


def meta_row(category, has_media, mechanism, sample_size, test_r2, test_rmse, shap=None):
    shap = shap if shap is not None else [float(i + 1) / 10.0 for i in range(len(FEATURE_NAMES))]
    return (category, has_media, mechanism, sample_size, test_r2, test_rmse, *shap)


def ladder_metadata(spark):
    rows = [meta_row("Food & Cooking", "True", "question", 1000, 0.15, 11.0),
            meta_row("Food & Cooking", "True", "ALL", 1500, 0.12, 11.5),
            meta_row("Food & Cooking", "ALL", "question", 1200, 0.11, 11.8),
            meta_row("Food & Cooking", "ALL", "ALL", 3000, 0.09, 12.0),
            meta_row("ALL", "ALL", "ALL", 94859, 0.05, 12.5)]
    return spark.createDataFrame(rows, schemas.MODEL_METADATA)


def ladder_predictions(spark):
    k = ("Food & Cooking", "True", "question")
    rows = [(*k, "Cooking", 9, 0, 90.0), (*k, "Cooking", 10, 1, 50.0), (*k, "Baking", 18, 6, 80.0),
            (*k, "Baking", 2, 3, 40.0), (*k, "food", 12, 2, 30.0)]
    return spark.createDataFrame(rows, schemas.PREDICTIONS)


def contract_tables(spark):
    meta = spark.createDataFrame([
        meta_row("Food & Cooking", "ALL", "question", 4245, 0.19, 11.2),
        meta_row("Home & Interior", "ALL", "ALL", 9060, 0.04, 12.3),
        meta_row("Mental Health", "ALL", "showcase", 48, 0.018, 10.9)], schemas.MODEL_METADATA)
    preds = spark.createDataFrame([
        ("Food & Cooking", "ALL", "question", "Cooking", 9, 0, 62.4),
        ("Food & Cooking", "ALL", "question", "Baking", 18, 6, 59.8),
        ("Food & Cooking", "ALL", "question", "food", 12, 2, 55.3),
        ("Home & Interior", "ALL", "ALL", "HomeImprovement", 19, 3, 48.1),
        ("Home & Interior", "ALL", "ALL", "DIY", 10, 6, 45.0),
        ("Mental Health", "ALL", "showcase", "Anxiety", 21, 2, 40.0)], schemas.PREDICTIONS)
    nf = [f for f, _ in RANGE_FEATURES]

    def rng(cat, hm, mech, vals):
        return (cat, hm, mech, *[v for f in nf for v in vals.get(f, (None, None))])
    ranges = spark.createDataFrame([
        rng("Food & Cooking", "ALL", "question", {"title_length": (8.0, 14.0), "hour_of_day": (17.0, 9.0),
                                                  "day_of_week": (0.0, 0.0), "body_length": (5.0, 5.0),
                                                  "post_length_proxy": (float("nan"), 100.0)}),
        rng("Home & Interior", "ALL", "ALL", {"day_of_week": (1.0, 5.5)})], schemas.OPTIMAL_RANGES)
    return meta, preds, ranges


def requests(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.REQUESTS)
