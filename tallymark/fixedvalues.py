"""Constants that must equal the specified ones for results to agree."""

# --- dataset provenance (fixed values) ---
FIELD_ORIGIN = "field_collected"
PROVENANCE_ORIGINS = ("dev_fixture", "public_dataset", "synthetic_generated", "field_collected")
NON_TRIAL_ORIGINS = ("dev_fixture", "public_dataset", "synthetic_generated")
# most severe first
ORIGIN_SEVERITY = ("dev_fixture", "public_dataset", "synthetic_generated")
FABRICATIONS = ("authentic", "script", "manual")

# --- document type prefix -> script; the prefix is itself the country code (fixed values) ---
SCRIPT_BY_PREFIX = {
    "alb": "latin",
    "aze": "latin",
    "esp": "latin",
    "est": "latin",
    "fin": "latin",
    "lva": "latin",
    "svk": "latin",
    "grc": "greek",
    "rus": "cyrillic",
    "srb": "cyrillic",
}

# --- targets and gates (fixed values) ---
TARGETS = {
    "cer_max": 0.21,
    "tpr_min": 0.88,
    "f1_min": 0.79,
    "sensitivity_min": 0.84,
    "accuracy_min": 0.80,
    "seconds_max": 60.0,
}
ROC_GATE_TPR = 0.88
ROC_GATE_FPR = 0.348
THIN_MARGIN = 0.01
COLLAPSE_STD = 1e-6
COLLAPSE_PATIENCE = 2
CER_KEEP_EPSILON = 1e-6
NEAR_HASH_DISTANCE = 6

# --- pair counts allowed for a trial set (fixed values) ---
SAME_BAND = (150, 250)
DIFF_BAND = (150, 250)
TOTAL_BAND = (300, 500)

# --- captures (fixed values) ---
CAPTURE_ORDER = ("photo", "scan", "video_frame")
DOCUMENT_NAMES = ("doc", "id", "photo", "document", "id_photo", "aadhaar_photo")
SELFIE_NAMES = ("selfie", "live", "capture", "webcam", "phone")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

# --- quality gates (fixed values) ---
QUALITY_GATES = {
    "min_face_side_px": 40.0,
    "min_laplacian_var": 50.0,
    "max_yaw_deg": 30.0,
    "max_pitch_deg": 25.0,
    "min_eye_distance_ratio": 0.05,
}

# --- public profile sources, their URL forms and address bases (fixed values) ---
PROFILE_SOURCES = ("github", "leetcode", "codeforces", "stackoverflow")
HANDLE_URL_PATTERNS = {
    "github": r"(?:https?://)?(?:www\.)?github\.com/([^/?#\s]+)",
    "leetcode": r"(?:https?://)?(?:www\.)?leetcode\.com/(?:u/|@)?([^/?#\s]+)",
    "codeforces": r"(?:https?://)?(?:www\.)?codeforces\.com/profile/([^/?#\s]+)",
    "stackoverflow": r"(?:https?://)?(?:www\.)?stackoverflow\.com/users/(?:\d+/)?([^/?#\s]+)",
}
HANDLE_LABEL_SUFFIX = r"\s*[:@]\s*([A-Za-z0-9_.-]+)"
HANDLE_STRIP = ".,;:)]}>"
DISCOVERY_PATTERNS = {
    "leetcode": r"(?:https?://)?(?:www\.)?leetcode\.com/(?:u/)?([A-Za-z0-9_-]+)",
    "codeforces": r"(?:https?://)?(?:www\.)?codeforces\.com/profile/([A-Za-z0-9_-]+)",
    "stackoverflow": r"(?:https?://)?(?:www\.)?stackoverflow\.com/users/\d+/([A-Za-z0-9_-]+)",
}
PROFILE_BASES = {
    "github": "https://github.com/",
    "leetcode": "https://leetcode.com/u/",
    "codeforces": "https://codeforces.com/profile/",
    "stackoverflow": "https://stackoverflow.com/users/",
}

# --- document type keywords, in order of precedence (fixed values) ---
DOC_TYPE_KEYWORDS = (
    ("degree_certificate", ("DEGREE", "UNIVERSITY", "BACHELOR", "MASTER")),
    ("employment_certificate", ("EMPLOYMENT", "EXPERIENCE CERTIFICATE", "WORKED AS")),
    ("transcript", ("TRANSCRIPT", "GRADE", "GPA", "SEMESTER")),
    ("identity_document", ("PASSPORT", "IDENTITY CARD", "DATE OF BIRTH", "NATIONALITY")),
)
WIDE_ASPECT = 1.4

# --- document keys of files (fixed values) ---
DATASET_TAGS = ("midv2020", "l3i_midv2020")
SOURCE_ID_PATTERN = r"^(?:auth|fg(?:_[A-Za-z0-9]+)*)_(\d{4})$"

# --- services expected to answer (fixed values) ---
EXPECTED_SERVICES = {"ocr": "ocr", "face": "face", "forgery": "forgery", "identity": "identity"}

# --- check-digit tables of the dihedral group D5 (fixed values) ---
CHECK_DIGIT_PRODUCT = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
CHECK_DIGIT_POSITION = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
