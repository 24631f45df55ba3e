"""Fixed values that results depend on: patterns, word lists, thresholds, statuses."""

# Replacements in normalization, in this order.
REPLACEMENTS = [
    ("fl. oz", "fl oz"),
    ("fl oz.", "fl oz"),
    ("fluid ounces", "fl oz"),
    ("fluid ounce", "fl oz"),
    ("alc by vol.", "alc by vol"),
    ("alc/ vol", "alc/vol"),
    ("alc /vol", "alc/vol"),
    ("alc / vol", "alc/vol"),
    ("by vol.", "by vol"),
]
DROPPED = r"[^a-z0-9%\s./()\-,:;]"
BLANKED = r"[^a-z0-9%./()\-,:;]+"  # runs of dropped characters and blanks
NUMBER = r"(\d+(?:\.\d+)?)"
ALCOHOL_IN_TEXT = NUMBER + r"\s*%\s*(?:alc/?\s*vol|alc\s+by\s+vol|alcohol\s+by\s+volume|by\s+vol(?:ume)?|abv|alcohol)?"
NET_EXPECTED = NUMBER + r"\s*(ml|milliliters?|milli?liters?|l|liters?|cl|oz|fl\s*oz)"
NET_IN_TEXT = NUMBER + r"\s*(ml|milliliters?|milli?liters?|l|liters?|cl|oz|fl\.?\s*oz)"
NET_ON_PAGE = NUMBER + r"\s*(milliliters?|ml|liters?|l|fl\.?\s*oz|ounces?|gal\.?|gallons?)"

# Groups of warning keywords.
WARNING_GROUPS = [
    ("header", ["government", "warning", "govern", "warn"]),
    ("authority", ["surgeon", "general"]),
    ("pregnancy", ["pregnan", "women", "birth", "drink"]),
    ("impairment", ["impair", "machinery", "operat", "drive"]),
    ("health", ["health", "problem"]),
]
WARNING_BOX_WORDS = ["government", "warning", "surgeon", "general", "pregnancy", "impairs"]

# Thresholds and confidences.
FOUND_CONFIDENCE = 0.99
ALCOHOL_TOLERANCE = 0.01
BRAND_OVERLAP = 0.8
TEXT_OVERLAP = 0.5
SHORT_BRAND = 5
LOW_CONFIDENCE = 0.75
WARNING_FOUND, WARNING_PARTIAL = 3, 2
BOX_COVERAGE, BOX_COVERAGE_WEIGHT = 0.4, 0.9
BOX_RECALL, BOX_RECALL_WEIGHT = 0.5, 0.7
BOX_COMPACT = 0.95
BOX_KEEP, BOX_CAP = 0.6, 2
WORD_CONFIDENCE = 30
STRIP_FRACTION = 0.28

FIELDS = ["brand_name", "alcohol_content", "net_contents"]
MATCH_STATUS = {"found": "match", "partial": "partial_match", "missing": "not_found"}
ENGINES = ["tesseract", "paddleocr"]

# Attempts after the first (full, 0, basic, 6): number, region, angle, preprocessing, page mode.
FIRST_ATTEMPT = (0, "full", 0, "basic", 6)
FALLBACKS = {
    "tesseract": [
        (1, "full", 90, "basic", 6),
        (2, "full", 270, "basic", 6),
        (3, "full", 0, "bilateral", 6),
        (4, "right_strip", 90, "basic", 6),
        (5, "right_strip", 270, "basic", 6),
        (6, "bottom_strip", 0, "basic", 6),
        (7, "bottom_strip", 0, "adaptive", 6),
    ],
    "paddleocr": [
        (1, "full", 90, "basic", 11),
        (2, "full", 270, "basic", 11),
        (3, "bottom_strip", 0, "basic", 11),
    ],
}

# Image types by content type.
EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/tiff": ".tif",
    "image/gif": ".gif",
    "image/bmp": ".bmp",
    "image/webp": ".webp",
}
UPLOAD_TYPES = ["image/jpeg", "image/png", "image/webp"]
CAPTCHA_EXACT, CAPTCHA_LOWER = "What code is in the image", "are you a human"
ATTACHMENT = "publicViewAttachment"
PAGE_LABELS = {"brand_name_detail": "BRAND NAME", "fanciful_name_detail": "FANCIFUL NAME", "net_contents": "NET CONTENTS", "alcohol_content": "ALCOHOL CONTENT"}
EXTRA_COLUMNS = ["brand_name_detail", "fanciful_name_detail", "net_contents", "alcohol_content", "image_path", "image_count", "fetch_status"]

# What the engines are called with.
WORD_ENGINE_OPTIONS = "--oem 3 --psm {psm} -c load_system_dawg=0 -c load_freq_dawg=0"
POLYGON_ENGINE_OPTIONS = {
    "ocr_version": "PP-OCRv4",
    "lang": "en",
    "use_doc_orientation_classify": False,
    "use_doc_unwarping": False,
    "use_textline_orientation": False,
    "enable_hpi": False,
}
