"""Fixed values. Results depend on these exact constants, so they are stated once, here."""

# Heads of the dual predictor, and the sign of the prior shift on each head.
HEADS = ("success", "failure")

# Stop thresholds of the grid, and the primary one.
THRESHOLDS = (0.900, 0.925, 0.950, 0.975)
PRIMARY_THRESHOLD = 0.950

# Event detectors on step text.
TEST_PATTERN = (
    r"(?i)(pytest|python\s+-m\s+unittest|py\.test|\btox\b|manage\.py\s+test|nosetests|run_tests)"
)
EDIT_PATTERN = (
    r"(?i)(sed\s+-i|patch\s+-p\d|git\s+apply|apply_patch|str_replace|cat\s*>\s*\S+|"
    r"\btee\s+\S+|<<\s*'?EOF|>>\s*\S+\.(py|json|txt|md|toml|cfg))"
)
SUBMIT_MARKER = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"

# Detectors of the source schema audit (deliberately different from the two above).
AUDIT_TEST_PATTERN = (
    r"(?i)(pytest|python\s+-m\s+unittest|py\.test|\btox\b|manage\.py\s+test|nosetests)"
)
AUDIT_EDIT_PATTERN = (
    r"(?i)(sed\s+-i|patch\s+-p|git\s+apply|apply_patch|str_replace|<\s*<\s*'?EOF|cat\s*>|tee\s+\S+)"
)
AUDIT_PASS_PATTERN = r"(?i)(\d+\s+passed|PASSED|\bOK\b)"
AUDIT_FAIL_PATTERN = r"(?i)(\d+\s+failed|FAILED|FAILURES)"

# Word tokens of the text features.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Provider families by substring of the lower-cased label, first match wins.
PROVIDER_FAMILIES = (
    ("Anthropic", ("@anthropic", "claude")),
    ("Google/Gemini", ("gemini", "@google", "@gemini")),
    ("xAI", ("@xai", "grok")),
    ("OpenAI", ("@openai", "gpt-", "openai/")),
    ("Qwen/Alibaba", ("qwen",)),
    ("Moonshot", ("kimi", "moonshot")),
    ("Zhipu/Z.ai", ("glm", "z-ai")),
    ("MiniMax", ("minimax",)),
    ("DeepSeek", ("deepseek",)),
    ("Fireworks-hosted", ("fireworks",)),
    ("Together-hosted", ("together",)),
)
PROVIDER_OTHER = "Other/Unknown"

# Bins of the decision fraction.
FRACTION_BINS = ("0-0.25", "0.25-0.50", "0.50-0.75", "0.75-1.00")

# Two-sided 95 % normal quantile of the Wilson interval.
WILSON_Z = 1.959963984540054

# Clip of scores before the log-odds transform.
LOGIT_EPS = 1e-12

# Bootstrap: replicates and seeds.
REPLICATES = 2000
TARGET_REPLICATES = 5000
SEED = 42
TARGET_SEED = 42031
THRESHOLD_SEED = 42100
CELL_SEED = 43000

# Denominators and effect sizes used by the rule gates.
MIN_DECISIONS = 20
HALF_MIN_DECISIONS = 10
LARGE_GAP = 0.10
ROBUST_GAP = 0.08
COLLAPSE_GAP = 0.04
SIGN_EPS = 1e-9

# Coverage: eligibility of a (model, scaffold) combination.
LOW_COVERAGE = 0.70
COMBO_MIN_USABLE = 100
COMBO_MIN_SUCCESSES = 20
COMBO_MIN_FAILURES = 20
COMBO_MIN_TASKS = 30
CROSSED_MIN = 3
MIN_USABLE_FRACTION = 0.60
MAX_MISSINGNESS_GAP = 0.20
MIN_MODELS = 12
MIN_ADEQUATE_TARGETS = 8

# Text features.
MIN_DOCUMENT_FREQUENCY = 5
MAX_FEATURES = 30000
COMPONENTS = 64

# Folds.
MIN_STEPS_FOR_TRAINING = 5
VALID_MODELS_PER_TASK = 3
SAFE_TARGET_MIN_STEP = 10

# Rule gates: required values.
ERRORS_MIN = 10
DOMINANT_SHARE = 0.70
MODELS_WITH_ERROR_MIN = 3
LARGEST_MODEL_SHARE = 0.60
SIGNATURE_RATE = 0.50
ENRICHED_DIFFERENCE = 0.20
ONE_DIRECTION_DIFFERENCE = 0.30
ONE_DIRECTION_ERRORS = 30
HETEROGENEITY_RANGE = 0.15
HETEROGENEITY_CI = 0.05
STRONG_RHO = 0.50
LARGE_GAP_MODELS = 3
RESIDUAL_RANGE = 0.10
RESIDUAL_CI = 0.05
PAIR_FOLDS_MIN = 20
PAIR_MEDIAN_MIN = 0.05
PAIR_CI_MIN = 0.03
PERSISTENT_AGENTS_MIN = 2
TARGET_OCCURRENCES_MIN = 7
TARGET_GAP_MIN = 0.08
TARGET_SAME_SIGN_MIN = 0.80
JACKKNIFE_GAP_MIN = 0.06
HALF_FOLDS_MIN = 5
HALF_GAP_MIN = 0.06
THRESHOLD_GAP_MIN = 0.06
THRESHOLD_SAME_SIGN_MIN = 0.75
THRESHOLDS_PASSED_MIN = 3
DIAGNOSTIC_THRESHOLDS = (0.900, 0.925, 0.950)
SIGNAL_MODELS_MIN = 3
SIGNAL_LARGE_MIN = 2
SIGNAL_FAMILIES_MIN = 2
SIGNAL_THRESHOLDS_MIN = 2
