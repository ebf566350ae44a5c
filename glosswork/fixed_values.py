"""Word lists, column lists, texts and constants that decide results.

They are data, not logic: a different value gives a different result table.
"""

# --- fixed values: missing-value tokens recognised in CSV text -----------------------------------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: words read as 1, as 0 and as missing when a column is turned into numbers ------
TRUE_WORDS = ("true", "yes", "y", "recommended")
FALSE_WORDS = ("false", "no", "n", "not recommended")

# --- fixed values: metadata columns never used as model features ----------------------------------
METADATA_COLUMNS = (
    "Unnamed: 0", "Clothing ID", "Title", "Review Text", "Rating", "Division Name",
    "Department Name", "Class Name", "row_index", "llm_overall_sentiment", "llm_confidence",
    "Recommended IND",
)

# --- fixed values: name rule of text-derived (labeller) features ----------------------------------
DERIVED_PREFIX = "llm_"
DERIVED_SUFFIXES = ("_present", "_polarity", "_intensity")

# --- fixed values: default theme codebook ----------------------------------------------------------
CODEBOOK = {
    "T1_PRODUCT_QUALITY": "Mentions fabric/material quality, stitching, durability, comfort.",
    "T2_FIT_SIZING": "Mentions fit, sizing accuracy, too small/large, tight/loose.",
    "T3_STYLE_APPEARANCE": "Mentions look, style, color, design, flattering/unflattering.",
    "T4_VALUE_FOR_MONEY": "Mentions price fairness or value.",
    "T5_DELIVERY_PACKAGING": "Mentions shipping, delivery speed, packaging condition.",
    "T6_DEFECT_DAMAGE": "Mentions damage, defect, stain, tear, poor finishing.",
    "T7_RETURN_REFUND": "Mentions return, exchange, refund process.",
    "T8_RECOMMENDATION": "Explicitly recommends or not recommends.",
    "T9_EXPECTATION_GAP": "Mentions mismatch vs description/photos.",
    "T10_EMOTIONAL_INTENSITY": "Strong emotional tone.",
}

# --- fixed values: wording of the labelling request ------------------------------------------------
PROMPT_INTRO = """You are a qualitative research assistant performing deductive thematic coding.

Use the fixed codebook below.
For each theme return:
0 = Absent
1 = Present

Return ONLY valid JSON with these exact keys."""

# --- fixed values: review text layout, its empty form, and the longest text sent to a labeller -----
EMPTY_REVIEW_TEXTS = ("", "Title:  | Review:")
MAX_CHARS = 1000

# --- fixed values: free-text rule, split, ensemble, clamp and explanation sizes --------------------
TEXT_MEAN_LENGTH = 25
FIRST_ROWS = 2000
TEST_SHARE = 0.20
SEED = 42
MEMBER_SALTS = (43, 44, 45, 46, 47)
TOP_DERIVED_FEATURES = 15
CLAMP_LOW, CLAMP_HIGH = 1.0, 5.0
BACKGROUND_ROWS = 80
PERTURBATIONS = 2500
INSTANCE_POSITION = 10

# --- fixed values: cumulative Poisson(1) probabilities for counts 0..5 ------------------------------
POISSON_CUTS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)

# --- fixed values: themes of the invented-prose tables: texts to look for (any of them), or a pattern
# --- and whether the text is lower-cased first
FIXTURE_THEMES = (
    ("T1_TABLE", ("|",), None, False),
    ("T2_SHOUTING", ("!!",), None, False),
    ("T3_INSULT", ("worthless", "stupid", "idiot", "moron"), None, True),
    ("T4_LICENSE", ("license", "licence", "copyright"), None, True),
    ("T5_SYMBOL_NOISE", (), r"[$&%#*]{3}", False),
    ("T6_NUMBERS", (), r"[0-9]{3}", False),
)
