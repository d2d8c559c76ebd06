"""Weights, keywords, name patterns and method names."""

from __future__ import annotations

from itertools import product

# --- fixed values -----------------------------------------------------------
COMPONENTS = ("completeness", "continuity", "plausibility", "distribution", "stability", "correlation")
COMPONENT_LABELS = {
    "completeness": "Completeness",
    "continuity": "Continuity",
    "plausibility": "Outlier burden",
    "distribution": "Distribution shape",
    "stability": "Temporal stability",
    "correlation": "Cross-signal consistency",
}
# domain: weight per component, in the order of COMPONENTS
QUALITY_WEIGHTS = {
    "eye_tracking": (0.23, 0.24, 0.17, 0.12, 0.16, 0.08),
    "industrial": (0.17, 0.16, 0.23, 0.08, 0.25, 0.11),
    "energy": (0.20, 0.16, 0.12, 0.10, 0.30, 0.12),
    "physiological": (0.17, 0.22, 0.12, 0.09, 0.30, 0.10),
    "finance": (0.14, 0.10, 0.08, 0.30, 0.30, 0.08),
    "network": (0.18, 0.15, 0.20, 0.07, 0.27, 0.13),
}
# Ordinal priorities from which the weights can be rebuilt, same order.
PRIORITIES = {
    "eye_tracking": (6, 6, 4, 3, 4, 2),
    "industrial": (4, 4, 6, 2, 6, 3),
    "energy": (5, 4, 3, 2, 7, 3),
    "physiological": (4, 5, 3, 2, 7, 2),
    "finance": (3, 2, 2, 7, 7, 2),
    "network": (4, 3, 5, 2, 6, 3),
}
LOSS_PARTS = ("reconstruction", "clean_harm", "dynamics", "distribution", "frequency", "event", "detection", "retention")
LOSS_WEIGHTS = {
    "eye_tracking": (0.22, 0.15, 0.20, 0.08, 0.05, 0.15, 0.10, 0.05),
    "industrial": (0.15, 0.10, 0.10, 0.05, 0.10, 0.20, 0.20, 0.10),
    "energy": (0.15, 0.15, 0.10, 0.05, 0.25, 0.20, 0.05, 0.05),
    "physiological": (0.15, 0.15, 0.20, 0.05, 0.25, 0.15, 0.03, 0.02),
    "finance": (0.05, 0.25, 0.10, 0.20, 0.0, 0.30, 0.05, 0.05),
    "network": (0.10, 0.15, 0.10, 0.05, 0.05, 0.25, 0.20, 0.10),
}
DOMAIN_LABELS = {
    "eye_tracking": "Eye-tracking",
    "industrial": "Industrial sensors",
    "energy": "Energy",
    "physiological": "Physiological / wearable",
    "finance": "Finance",
    "network": "Network / system monitoring",
}
DOMAIN_KEYWORDS = {
    "eye_tracking": ("gaze", "pupil", "fixation", "saccade", "por", "eye"),
    "industrial": ("temperature", "pressure", "vibration", "flow", "rpm", "machine"),
    "energy": ("load", "power", "energy", "solar", "consumption", "demand"),
    "physiological": ("ecg", "eeg", "ppg", "heart", "pulse", "resp", "eda", "motion"),
    "finance": ("price", "return", "volume", "open", "close", "high", "low"),
    "network": ("cpu", "latency", "request", "error", "traffic", "memory", "packet"),
}
# Order in which signals of a domain are offered; matched with blanks as underscores.
SIGNAL_PRIORITY = {
    "eye_tracking": ("gaze_point_x", "gaze_point_y", "point_of_regard", "gaze_x", "gaze_y", "pupil", "gaze",
                     "fixation", "saccade"),
    "industrial": ("temperature", "pressure", "vibration", "flow", "rpm"),
    "energy": ("load", "power", "consumption", "demand", "solar", "temperature"),
    "physiological": ("ecg", "ppg", "pulse", "heart", "resp", "eda", "sensor", "motion"),
    "finance": ("log_return", "return", "price", "volume", "close", "open"),
    "network": ("request", "cpu", "latency", "error", "traffic", "memory"),
}
MISSING_TOKENS = (
    "", " ", "NA", "N/A", "na", "n/a", "null", "NULL", "None", "none",
    "-", "--", "---", "?", "nan", "NaN", "#VALUE!", "Inf", "-Inf",
    "infinity", "Infinity",
)
ID_PATTERNS = (
    "^unnamed", "^id$", "participant", "subject", "trial", "session", "export", "stimulus", "condition", "label",
    "target", "class", "^row$", "index", "^sample$", "sample_?id", "^frame$", "tracking ratio", "^missing$",
    "^validity", "^is_valid$", "^valid$",
)
TIME_PATTERNS = (
    "^timestamp$", "time", "recordingtime", "recording_time", "device_time", "system_time", "elapsed", "duration",
    "date", "clock",
)
# Compared after dropping everything but letters and digits, finest unit first.
RECORDING_COLUMNS = (
    "recording name", "recording id", "recordingid", "recording", "video",
    "session id", "sessionid", "session", "task", "trial",
    "participant", "participant id", "participantid", "subject", "subject id", "subjectid",
)
# Never turned into numbers, whatever their content.
LABEL_COLUMNS = (
    "participant", "participantid", "recording", "recordingid", "session", "sessionid", "subject", "subjectid",
)
# unit choice: seconds per unit
TIME_UNITS = {
    "seconds": 1.0,
    "milliseconds": 1e-3,
    "microseconds": 1e-6,
    "nanoseconds": 1e-9,
    "minutes": 60.0,
    "hours": 3600.0,
    "days": 86400.0,
}
# Tried in this order on the lower-cased column name.
UNIT_NAME_PATTERNS = (
    ("microseconds", "micro|(^|[^a-z])(us|usec|µs|μs)($|[^a-z])"),
    ("nanoseconds", "nano|(^|[^a-z])(ns|nsec)($|[^a-z])"),
    ("milliseconds", "milli|(^|[^a-z])(ms|msec)($|[^a-z])"),
    ("minutes", "minute|(^|_)min($|_)"),
    ("hours", "hour|(^|_)h($|_)"),
    ("days", "day|(^|_)d($|_)"),
    ("seconds", "second|(^|[^a-z])(s|sec)($|[^a-z])"),
)
METHODS = {
    "outlier": ("none", "zscore", "iqr", "mad", "winsorize", "isolation_forest"),
    "imputation": ("none", "mean", "median", "locf", "linear", "knn", "mice"),
    "scaling": ("none", "standard", "minmax", "robust"),
    "smoothing": ("none", "moving_median", "savgol", "butterworth"),
}
OUTLIER_FIRST = "outlier_imputation_scaling_smoothing"
IMPUTATION_FIRST = "imputation_outlier_scaling_smoothing"
# Saved order names of older runs; only their first two stages count.
LEGACY_ORDERS = {
    "outlier_imputation_smoothing_scaling": OUTLIER_FIRST,
    "imputation_outlier_smoothing_scaling": IMPUTATION_FIRST,
}
STAGE_VALIDATION = {
    "imputation": {"status": "candidate", "grouped_cv_mean": 0.5018, "majority": 0.7455, "holdout": 0.80},
    "outlier": {"status": "unstable", "grouped_cv_mean": 0.20, "majority": 0.64, "holdout": 0.0},
    "smoothing": {"status": "candidate", "grouped_cv_mean": 0.6267, "majority": 0.4933, "holdout": 0.0},
}
# Share of eye-tracking pilot scenarios won by each method.
EYE_TRACKING_SUPPORT = {
    "imputation": (("linear", 0.85), ("locf", 0.125), ("mean", 0.025)),
    "outlier": (("zscore", 0.70), ("iqr", 0.20), ("mad", 0.10)),
    "smoothing": (("moving_median", 0.50), ("none", 0.30), ("butterworth", 0.15), ("savgol", 0.05)),
}
# --- end of fixed values ------------------------------------------------------


def weight_map(table: dict[str, tuple], names: tuple[str, ...], domain: str) -> dict[str, float]:
    return dict(zip(names, table[domain]))


def full_grid() -> list[tuple[str, str, str, str, str]]:
    """(order, imputation, outlier, smoothing, scaling) of the 336 cleaning candidates."""
    orders = (IMPUTATION_FIRST, OUTLIER_FIRST)
    return [(o, i, x, s, "none") for o, i, x, s in
            product(orders, METHODS["imputation"], METHODS["outlier"], METHODS["smoothing"])]
