"""Fixed values. They decide results, so they are stated once, as plain text, and passed as defaults."""

# --- fixed values: eras (label, first year, last year), inclusive and overlapping in 2001 -------------------
ERAS = [
    ("Central Counties", 1972, 1983),
    ("Mellon", 1984, 2001),
    ("Citizens", 2001, 2026),
]

# --- fixed values: free-text aliases, tried in this order ---------------------------------------------------
ALL_ALIASES = ("all", "any", "everything", "both")
ERA_ALIASES = [
    ("Central Counties", ("central counties", "central", "counties", "ccb", "cc")),
    ("Mellon", ("mellon",)),
    ("Citizens", ("citizens", "citizen")),
]

# --- fixed values: score blend and confidence tiers ---------------------------------------------------------
IMAGE_WEIGHT = 0.5
TEXT_WEIGHT = 0.5
TEXT_BOOST_FROM = 0.9
TEXT_BOOST_SLOPE = 2.5
WEAK_TEXT_BELOW = 0.3
WEAK_TEXT_FACTOR = 0.7
TEXT_SIM_LOW, TEXT_SIM_HIGH = 0.15, 0.35
TEXT_CENTER = 0.25
RARITY_CAP = 0.04
AUTO_AT = 0.85
GREEN_AT = 0.82
GREEN_GAP = 0.12
RED_BELOW = 0.65
MIN_AUTO_GAP = 0.05
AUTO_GUARD_MARGIN = 0.05
REFERENCE_NUDGE = 0.15
STAGE_AT = 0.50
PROMISING_AT = 0.45
NEEDED_AT = 0.60
READING_CONF_MIN = 0.70

# --- fixed values: contrast re-rank -------------------------------------------------------------------------
YEAR_WEIGHT = 0.05
ENTITY_WEIGHT = 0.05
CONTRAST_SCALE = 0.05
ENTITY_BASELINE = 0.82
MAX_PEERS = 10

# --- fixed values: words ignored when comparing slogans -----------------------------------------------------
STOPWORDS = ("a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "its", "is")

# --- fixed values: title words that mark something other than a button --------------------------------------
EXCLUDED_KEYWORDS = (
    "embroidered", "drifit", "hoodie", "sweatshirt", "stitched", "polo", "quarterzip", "quarter zip",
    "quarter-zip", "denim", "antigua", "jacket", "pullover", "shirt", "jersey", "vest",
    "enamel", "enameled", "brooch", "lanyard", "strap", "ornament", "christmas",
    "wooden", "cable", "badge reel", "map", "sticker", "decal",
)
EXCLUDED_CATEGORIES = ("11450",)
PLACEHOLDER_SLOGANS = ("slogan unknown",)

# --- fixed values: search terms -----------------------------------------------------------------------------
ITEM_TYPES = ("button", "pin", "badge", "pinback")
ERA_PREFIXES = ("Penn State", "PSU", "Nittany Lions")

# --- fixed values: limits that are part of a feature --------------------------------------------------------
MAX_PHOTOS = 4
CROPS_PER_PHOTO = 100
CROPS_PER_LISTING = 400
RUN_CAP_MAX = 1000
DIGEST_ROWS = 25
PENDING_DAYS = 7
DOUBLE_SEEN_CUTOFF = "2026-06-21"

# --- fixed values: readings ---------------------------------------------------------------------------------
CONFIDENCE_LABELS = {"low": 0.30, "medium": 0.60, "high": 0.90}
SIZE_CLASSES = ("small", "medium", "large")
OUTPUT_PREFIX = "pipeline/output/"
RESPONSE_SUFFIX = ".response.json"
OBJECT_PREFIX = "lots__"
STAGING_PREFIX = "reference/_staging/"
LABELS_PREFIX = "pipeline/labels/"
LABEL_SCHEMA = "detect_labels.v1"

# --- fixed values: marks ------------------------------------------------------------------------------------
ANCHOR_FRACTION = 0.75
MERGED_RATIO = 1.35
MIN_CIRCULARITY = 0.45
MIN_VOTE_WEIGHT = 0.05
MERGED_VOTE_WEIGHT = 0.40
LONE_VOTE_CONF = 0.60
GATE_AUTO_CONFIDENCE = 0.70
GATE_AUTO_LAYOUT = 0.85
GATE_SUGGEST_CONFIDENCE = 0.55
BG_DIFF_MAX_SPREAD = 18.0
BG_DIFF_BASE = 25.0
BG_DIFF_MULT = 3.0
FLOOD_MASK = 0.50
FLOOD_RESIDUAL = 0.42
DEFICIT_MIN_FRACTION = 0.60
SWAP_OFF_MASK = 0.50
SWAP_MIN_CONFIDENCE = 0.70
VETO_CENTER = 0.85
VETO_RADIUS = (0.7, 1.3)
LOW_RES_DIAMETER = 64
RADIUS_SCALES = (1.0, 0.66, 0.45, 0.30)
RADIUS_FLOOR = 9

# --- fixed values: defaults of log records that lack a field --------------------------------------------------
DEFAULT_CURRENCY = "USD"
DEFAULT_SOURCE = "scan"
