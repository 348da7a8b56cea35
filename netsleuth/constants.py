"""Constants.

FIXED VALUES — these must equal the reference's values for identical results
(labels, thresholds, port and address lists, rule-id spaces, model defaults).
"""

# --- fixed values (reference) -------------------------------------------
ANOMALY_PREDICTION = -1
NORMAL_PREDICTION = 1
LABEL_NORMAL = "normal"
LABEL_ANOMALY = "anomaly"
LABEL_UNKNOWN = "unknown"
MODE_NORMAL = "normal"
MODE_ANOMALY = "anomaly"
MODE_OFF = "off"

ANOMALY_THRESHOLD = -0.2          # fallback threshold when none is calibrated
DEFAULT_PERCENTILE = 0.98         # reference percentile for the external threshold
MIN_PRECISION_FOR_THRESHOLD = 0.95
MIN_SEVERITY_TO_DROP = 2
MIN_FREQ_TO_DROP = 5
ALERT_ONLY_PORTS = (53, 80, 123, 443)
LOCAL_SERVICES = ("10.0.2.3", "192.168.10.1")

MISSING_TIMESTAMP = "Desconocido"     # stored when an event has no timestamp
MISSING_SIGNATURE = "Sin firma"       # stored when an alert has no signature
DEFAULT_IP = "0.0.0.0"
DEFAULT_PROTO = "UNKNOWN"

# rule-id spaces: (base, modulus)
SID_FLOW_RULE = (3_000_000, 500_000)
SID_CONTEXT_RULE = (3_000_000, 900_000)
SID_SCAN_RULE = (2_000_000, 900_000)
SCAN_MIN_PORTS = 10               # strictly more distinct ports than this
CONTEXT_MIN_EVENTS = 10           # strictly more history rows than this
MANAGED_RULE_PREFIXES = ("drop ip", "alert ip")

# text formats of the generated rules (Spark format_string syntax)
FLOW_RULE_MESSAGE = '"ML anomaly (score: %s, len: %d, severity: %d, thr: %s)"'
FLOW_RULE_FORMAT = "%s %s %s %s -> %s %d (msg:%s; sid:%d; rev:1;)"
SCAN_RULE_FORMAT = 'alert ip %s any -> any any (msg:"Detected port scanning activity from %s"; sid:%d; rev:1;)'
CONTEXT_RULE_FORMAT = 'alert %s %s any -> any %d:%d (msg:"Suspicious port range access from %s"; sid:%d;)'
ANY_PORT = "any"
SCORE_ID_DECIMALS = 3                # score rounding inside the flow-rule id text

# fields hashed for event de-duplication, in order, joined by "|", missing as "None"
EVENT_HASH_FIELDS = (
    "event_type", "timestamp", "src_ip", "dest_ip", "proto", "src_port", "dest_port", "flow_id",
    "alert_signature", "dns_query", "tls_sni", "http_hostname", "http_url",
)
HASH_SEPARATOR = "|"
MISSING_IN_KEY = "None"
FALLBACK_ID_SEPARATOR = "-"          # md5("src-dest-timestamp")
SESSION_TIME_FORMAT = "yyyyMMdd-HHmm"  # "<label>-yyyyMMdd-HHmm"
SESSION_RANDOM_HEX = 16               # sha256("<mode>-<epoch seconds>")[:16]

# feature constants
ENTROPY_EPS = 1e-10
RARITY_EPS = 1e-6
NIGHT_BEFORE_HOUR = 7             # hour < 7 is night
NIGHT_AFTER_HOUR = 20             # hour > 20 is night
HOUR_DEVIATION = 3                # |hour - modal hour| > 3
PKT_STD_FACTOR = 2.0              # |len - mean| > 2 * std
ROLLING_FLAG_ROWS = 20            # flag-based failed ratio: last 20 rows
VELOCITY_ROWS = 5                 # inter-arrival mean: last 5 differences
CONN_WINDOW_SECONDS = 300         # trailing window (t - 5 min, t]

# isolation forest defaults
IFOREST_TREES = 100
IFOREST_MAX_SAMPLES = 256
IFOREST_CONTAMINATION = 0.05
IFOREST_SEED = 42

# threshold grids (reference): F1 sweep and constrained sweep
F1_SWEEP_GRID_COMPAT = (0.80, 0.995, 60)
MIN_PRECISION_GRID_COMPAT = (0.80, 0.999, 120)
# ---------------------------------------------------------------------------

# Our defaults mirror the reference grids into the low tail, because the score
# is "higher = more normal" and anomalies are ``score < threshold``.
F1_SWEEP_GRID = (0.005, 0.20, 60)
MIN_PRECISION_GRID = (0.001, 0.20, 120)
LOW_TAIL_PERCENTILE = 0.02
