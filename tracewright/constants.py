"""Fixed values. They must equal the published protocol for results to agree."""

# Feature order of one channel.
TIME_FEATURES = ["zero_cross", "maxima", "minima", "rms", "skew", "kurt_excess"]
BAND_NAMES = ["delta", "theta", "alpha", "beta"]
SPECTRAL_FEATURES = (
    ["total_power_1_40", "peak_freq_1_40"]
    + [f"mean_band_{b}" for b in BAND_NAMES]
    + [f"norm_band_{b}" for b in BAND_NAMES]
)
FEATURES = TIME_FEATURES + SPECTRAL_FEATURES

# Frequency bands in Hz, both ends included.
TOTAL_RANGE = (1.0, 40.0)
BANDS = {"delta": (1.0, 3.0), "theta": (4.0, 8.0), "alpha": (9.0, 13.0), "beta": (14.0, 20.0)}
BAND_EPS = 1e-12
ZSCORE_EPS = 1e-14

# Windows and cleaning.
WINDOW_SEC = 1.0
STRIDE_SEC = 0.25
EDGE_PAD_SEC = 20.0
LOW_HZ, HIGH_HZ, TARGET_HZ = 0.5, 40.0, 80.0

# Annotations.
NOTE_PREFIX = "Note : "
POSITIVE_MARK, NEGATIVE_MARK = "*", "-"
SEGMENT_TYPES = ["PD", "NON_PD"]
IGNORE_LABEL = -1

# Channels: canonical order and renamed positions.
CANONICAL_CHANNELS = [
    "Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T7", "C3", "Cz",
    "C4", "T8", "P7", "P3", "Pz", "P4", "P8", "O1", "O2",
]
CHANNEL_ALIASES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}

# Detection report categories; the first three lead to interpolation.
INTERPOLATE_CATEGORIES = ["deviation", "correlation", "ransac"]
REPORT_CATEGORIES = ["deviation", "hf_noise", "correlation", "ransac"]

# Patient patterns.
PATIENT_PATTERNS = {
    "P20": "LPD", "P28": "LPD", "P36": "LPD", "P48": "GPD", "P49": "GPD",
    "P54": "GPD", "P55": "LRDA", "P58": "LPD", "P70": "GPD", "P73": "LPD",
}
PATTERN_GROUPS = {"LPD": ["P20", "P36", "P58", "P73"], "GPD": ["P48", "P49", "P54", "P70"]}
HOLDOUT_PATIENT = "P58"
EXCLUDED_PATIENT_NUMBER = 28

# Evaluation.
THRESHOLD = 0.5
SEED_ROWS, SEED_WEIGHT, RANDOM_SEED = 5, 15.0, 42
MAX_SHOTS = 20
METRICS = ["acc", "bacc", "f1", "precision", "recall", "roc_auc", "pr_auc"]
COUNTS = ["tp", "fp", "tn", "fn"]
FOCUS_FEATURES = ["total_power_1_40", "mean_band_theta"]
EMBEDDING_KEYS = ["X", "embeddings", "features", "emb"]
LABEL_KEYS = ["y", "labels", "label"]
