"""Small dimension tables and fixed values.

Every list below is a fixed value that must equal the behaviour being
reproduced (category grouping of communities, keyword-to-category map and its
order, showcase phrases, day names, model feature names, range labels,
confidence thresholds). They are kept here, plainly and in their natural
order, and turned into tiny DataFrames that operators broadcast: each has a
size fixed by this file, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Ten categories, five target communities each (50 communities).
CATEGORY_COMMUNITIES: list[tuple[str, list[str]]] = [
    ("Skincare & Beauty", ["SkincareAddiction", "AsianBeauty", "30PlusSkinCare", "MakeupAddiction", "Makeup"]),
    ("Personal Finance", ["personalfinance", "financialindependence", "Frugal", "investing", "Debt"]),
    ("Food & Cooking", ["Cooking", "MealPrepSunday", "EatCheapAndHealthy", "Baking", "food"]),
    ("Fitness & Health", ["loseit", "xxfitness", "running", "weightlifting", "flexibility"]),
    ("Tech & Gadgets", ["gadgets", "homelab", "buildapc", "apple", "Android"]),
    ("Mental Health", ["mentalhealth", "Anxiety", "depression", "therapy", "selfimprovement"]),
    ("Relationships & Advice", ["relationship_advice", "AmItheAsshole", "dating_advice", "Marriage", "Divorce"]),
    ("Career & Work", ["cscareerquestions", "careerguidance", "jobs", "WorkReform", "remotework"]),
    ("Gaming", ["gaming", "pcgaming", "IndieGaming", "patientgamers", "gamedev"]),
    ("Home & Interior", ["malelivingspace", "femalelivingspace", "InteriorDesign", "DIY", "HomeImprovement"]),
]

# The canonical category names, in this order.
CATEGORIES: list[str] = [
    "Career & Work", "Fitness & Health", "Food & Cooking", "Gaming",
    "Home & Interior", "Mental Health", "Personal Finance",
    "Relationships & Advice", "Skincare & Beauty", "Tech & Gadgets",
]

# Keyword -> category, in this order (order breaks ties between categories
# with the same number of keyword hits: the category seen first wins).
CATEGORY_KEYWORDS: list[tuple[str, str]] = [
    ("cook", "Food & Cooking"), ("recipe", "Food & Cooking"), ("food", "Food & Cooking"),
    ("baking", "Food & Cooking"), ("meal", "Food & Cooking"), ("restaurant", "Food & Cooking"),
    ("game", "Gaming"), ("gaming", "Gaming"), ("xbox", "Gaming"), ("playstation", "Gaming"),
    ("nintendo", "Gaming"),
    ("skin", "Skincare & Beauty"), ("skincare", "Skincare & Beauty"), ("acne", "Skincare & Beauty"),
    ("moisturizer", "Skincare & Beauty"), ("lipstick", "Skincare & Beauty"), ("makeup", "Skincare & Beauty"),
    ("beauty", "Skincare & Beauty"), ("cosmetic", "Skincare & Beauty"), ("foundation", "Skincare & Beauty"),
    ("mascara", "Skincare & Beauty"), ("serum", "Skincare & Beauty"), ("sunscreen", "Skincare & Beauty"),
    ("perfume", "Skincare & Beauty"), ("fragrance", "Skincare & Beauty"), ("cologne", "Skincare & Beauty"),
    ("nail", "Skincare & Beauty"), ("haircare", "Skincare & Beauty"),
    ("invest", "Personal Finance"), ("budget", "Personal Finance"), ("savings", "Personal Finance"),
    ("retirement", "Personal Finance"), ("money", "Personal Finance"), ("rent", "Personal Finance"),
    ("mortgage", "Personal Finance"), ("apartment", "Personal Finance"), ("lease", "Personal Finance"),
    ("career", "Career & Work"), ("job", "Career & Work"), ("resume", "Career & Work"),
    ("interview", "Career & Work"), ("salary", "Career & Work"), ("side hustle", "Career & Work"),
    ("freelance", "Career & Work"), ("remote work", "Career & Work"),
    ("workout", "Fitness & Health"), ("gym", "Fitness & Health"), ("fitness", "Fitness & Health"),
    ("exercise", "Fitness & Health"), ("diet", "Fitness & Health"), ("yoga", "Fitness & Health"),
    ("pilates", "Fitness & Health"), ("stretching", "Fitness & Health"), ("running", "Fitness & Health"),
    ("cardio", "Fitness & Health"),
    ("mental", "Mental Health"), ("anxiety", "Mental Health"), ("therapy", "Mental Health"),
    ("depression", "Mental Health"), ("stress", "Mental Health"), ("burnout", "Mental Health"),
    ("overwhelmed", "Mental Health"), ("meditation", "Mental Health"),
    ("relationship", "Relationships & Advice"), ("dating", "Relationships & Advice"),
    ("breakup", "Relationships & Advice"), ("marriage", "Relationships & Advice"),
    ("tech", "Tech & Gadgets"), ("laptop", "Tech & Gadgets"), ("phone", "Tech & Gadgets"),
    ("software", "Tech & Gadgets"), ("coding", "Tech & Gadgets"),
    ("home", "Home & Interior"), ("interior", "Home & Interior"), ("furniture", "Home & Interior"),
    ("renovation", "Home & Interior"),
]

# Phrases that mark a request as a "showcase".
SHOWCASE_SIGNALS: list[str] = ["check out", "built", "made", "my project", "just finished"]

# Fuzzy keyword matching: minimum token length and similarity cutoff.
FUZZY_MIN_LEN = 5
FUZZY_CUTOFF = 0.8

# Day of week, Sunday = 0.
DAY_NAMES: list[str] = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# The 19 model features (the attribution columns are these names + "_shap").
FEATURE_NAMES: list[str] = [
    "hour_of_day", "day_of_week", "has_media", "post_length_proxy",
    "vader_compound", "nrc_joy", "nrc_trust", "nrc_fear", "nrc_surprise",
    "nrc_sadness", "nrc_disgust", "nrc_anger", "nrc_anticipation",
    "readability", "title_length", "body_length",
    "subreddit", "category", "engagement_mechanism",
]
NUMERIC_FEATURES: list[str] = FEATURE_NAMES[:16]
CATEGORICAL_FEATURES: list[str] = FEATURE_NAMES[16:]

# The eight emotions.
EMOTIONS: list[str] = ["joy", "trust", "fear", "surprise", "sadness", "disgust", "anger", "anticipation"]

# Features whose optimal range is shown, with their display label, in order.
RANGE_FEATURES: list[tuple[str, str]] = [
    ("title_length", "title length"),
    ("body_length", "body length"),
    ("post_length_proxy", "total length"),
    ("hour_of_day", "posting hour"),
    ("day_of_week", "posting day"),
]

# Confidence tiers.
R2_HIGH = 0.10
R2_LOW = 0.00
N_HIGH = 500
N_LOW = 100

# Driver controllability tags (community context is not controllable).
CONTROLLABLE: list[tuple[str, str]] = [
    ("hour_of_day", "timing"), ("day_of_week", "timing"), ("has_media", "media"),
    ("post_length_proxy", "length"), ("title_length", "length"), ("body_length", "length"),
    ("vader_compound", "framing/emotion"), ("readability", "framing"),
    ("nrc_joy", "emotion"), ("nrc_trust", "emotion"), ("nrc_fear", "emotion"),
    ("nrc_surprise", "emotion"), ("nrc_sadness", "emotion"), ("nrc_disgust", "emotion"),
    ("nrc_anger", "emotion"), ("nrc_anticipation", "emotion"),
    ("engagement_mechanism", "framing"),
]
NON_CONTROLLABLE: list[tuple[str, str]] = [
    ("subreddit", "community context"), ("category", "community context"),
]

# Segment key columns and the roll-up marker.
SEGMENT_KEYS: list[str] = ["category", "has_media", "engagement_mechanism"]
ALL = "ALL"

# ---------------------------------------------------------------------------
# Dimension DataFrames
# ---------------------------------------------------------------------------


def category_dim(spark: SparkSession) -> DataFrame:
    """community, community_lc, category (50 rows)."""
    rows = [(c, c.lower(), cat) for cat, comms in CATEGORY_COMMUNITIES for c in comms]
    schema = T.StructType([
        T.StructField("community", T.StringType(), False),
        T.StructField("community_lc", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def keyword_dim(spark: SparkSession) -> DataFrame:
    """ordinal, keyword, category (76 rows)."""
    rows = [(i, k, c) for i, (k, c) in enumerate(CATEGORY_KEYWORDS)]
    schema = T.StructType([
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("keyword", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def day_dim(spark: SparkSession) -> DataFrame:
    """day_of_week (Sunday=0), day_name (7 rows)."""
    schema = T.StructType([
        T.StructField("day_of_week", T.IntegerType(), False),
        T.StructField("day_name", T.StringType(), False),
    ])
    return spark.createDataFrame(list(enumerate(DAY_NAMES)), schema)


def feature_dim(spark: SparkSession) -> DataFrame:
    """feature_ordinal, feature, is_categorical, controllable (19 rows)."""
    ctrl = dict(CONTROLLABLE)
    non = dict(NON_CONTROLLABLE)
    rows = [(i, f, f in CATEGORICAL_FEATURES,
             f"CONTROLLABLE ({ctrl.get(f, 'other')})" if f not in non else f"NOT controllable ({non[f]})")
            for i, f in enumerate(FEATURE_NAMES)]
    schema = T.StructType([
        T.StructField("feature_ordinal", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("is_categorical", T.BooleanType(), False),
        T.StructField("controllable", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)
