"""Fixed values.

Word lists, names, patterns and thresholds that the audits are defined by. They are data, not
logic: every value here has to equal the definition of the audit for its results to be right.
"""

# Characters a text value may carry at either end and that never count as content.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- products -------------------------------------------------------------------------------

# Products of the performance tables; anything else is "Other/Uncategorized".
OVERVIEW_PRODUCTS = [
    "Display", "Social Mirror", "Video", "CTV", "Native Display", "Native Video",
    "Social Mirror CTV", "Online Audio",
]

# Products of the placement tables (adds the short audio name).
PLACEMENT_PRODUCTS = OVERVIEW_PRODUCTS + ["Audio"]

# Lower-case products a creative export may carry; anything else leaked into the column.
CREATIVE_PRODUCTS = [
    "display", "social mirror", "social mirror ctv", "ctv", "native display", "native video",
    "online audio", "audio", "video", "ctv + video", "geo-framing", "geo-fencing",
    "connected tv", "dynamic", "website visitor id", "performance max", "pay-per-click",
    "youtube", "amazon premium display", "search engine optimization",
    "reputation management", "streaming audio", "spotify", "addressable geo-fencing",
]

# Placement products on which a low click rate is expected.
NO_CLICK_PLACEMENT_PRODUCTS = ["CTV", "Social Mirror CTV", "Online Audio", "Audio"]

# Creative products (lower case) on which clicks are not the point.
NO_CLICK_CREATIVE_PRODUCTS = [
    "ctv", "social mirror ctv", "online audio", "audio", "connected tv", "streaming audio",
]

# Products on which an exchange with a low click rate is flagged.
CLICK_EXCHANGE_PRODUCTS = ["Display", "Native Display", "Native Video", "Video", "Social Mirror"]

# Creative products (lower case) that need a video, and those that need a still image.
VIDEO_PRODUCTS = ["video", "ctv", "social mirror ctv", "native video", "connected tv"]
STILL_PRODUCTS = ["display", "native display"]

# --- block list -----------------------------------------------------------------------------

BLOCK_SENTINELS = ["block", "blocked"]
BLOCK_TABS = ["All Products", "CTV", "Audio", "Social Mirror"]
TAB_ALL = "All Products"
# Product -> the tab that blocks it (next to "All Products", which blocks every product).
PRODUCT_TABS = {"CTV": "CTV", "Online Audio": "Audio", "Social Mirror": "Social Mirror"}
# A block row without a date counts as blocked since this day.
BLANK_BLOCK_DATE = "1970-01-01"
BLOCKLIST_HEADER_WORDS = [
    "bundle id", "bundle id (app only)", "url/identifier", "domain or app", "type",
    "formatting", "formatted", "date added",
]
# Application inventory that carries a domain as its name.
APP_DOMAINS = ["cdn.desktop.aol.com"]

# --- null-like texts ------------------------------------------------------------------------

BLANK_PLACEMENTS = ["na", "nan", "none", "", "(not set)"]
BLANK_NAMES = ["na", "nan", "none", ""]
BLANK_DIMENSIONS = ["", "nan", "none", "(not in export)"]
BLANK_TEXTS = ["", "nan", "none", "null", "n/a", "na", "-", "#n/a", "0"]
PLACEHOLDER_NAMES = [
    "n/a", "na", "#n/a", "-", "--", "null", "none", "nan", "unknown", "untitled", "unnamed",
    "no name", "tbd", "test", "0", ".",
]
NOT_IN_EXPORT = "(not in export)"
NOT_SPECIFIED = "(not specified)"

# --- application and placement name patterns ------------------------------------------------

GAMING_APP = (
    r"(?iU)\b(puzzle|casino|slots?|bingo|solitaire|mahjong|bubble\s?(shoot|pop)|"
    r"block\s?(puzzle|blast|hexa|mania|party|craft|jam)|match\s?3|arcade|tycoon|clash|"
    r"sudoku|jackpot|poker|hexa|jewel\s?(blast|quest)|candy\s?crush|saga|idle\s|"
    r"trivia\s?crack|racing\s?game|ludo|tetris|2048|gacha|tower\s?defen|zombie|"
    r"battle\s?(royale|craft|land)|shooter|word\s?(trip|connect|search|cross|calm|link)|"
    r"gems?\s?(blast|crush)|gold\s?miner|dragon\s?(city|mania|blast)|"
    r"merge\s?(dragons|mansion|magic)|\.io\b|coin\s?master|spin\s?to\s?win)\b"
)
JUNK_APP = (
    r"(?iU)\b(photo\s?edit|beauty\s?cam|selfie|flashlight|battery\s?(saver|doctor)|cleaner|"
    r"booster|antivirus|qr\s?(scanner|code)|wallpaper|ringtone|keyboard|file\s?manager|"
    r"compass|magnifier|clean\s?master|du\s?battery)\b"
)
UNRESOLVED_APP = r"(?iU)^((com|net|org|io|app)\.[a-z0-9_.]+|\d{6,})$"

# Ordered placement rules: (category, concern, pattern); the first match decides.
PLACEMENT_RULES = [
    ("Photo/Beauty Editor App", "BLOCK",
     r"(?iU)\b(b612|beauty\s?plus|beautyplus|youcam|sweet\s?selfie|candy\s?camera|"
     r"natural\s?beauty|beauty\s?camera|selfie|photo\s?(&|and)?\s?video\s?edit|"
     r"photo\s?edit|retrica|meitu|facetune|cymera|z\s?camera|makeup\s?cam)"),
    ("Rewarded / Casual Game", "BLOCK",
     r"(?iU)\b(block!?\s?(puzzle|app)?|block\s?puzzle|bubble\s?shoot|woodoku|candy\s?crush|"
     r"match\s?3|solitaire|2048|mahjong|coin\s?master|slots?|casino|spin\s?to\s?win|"
     r"lucky\s?(spin|wheel|day)|scratch\s?(off|win)|idle\s|merge\s|\.io\b|jewel\s?blast)"),
    ("Utility-Junk App", "BLOCK",
     r"(?iU)\b(flashlight|battery\s?(saver|doctor)|du\s?battery|phone\s?clean|clean\s?master|"
     r"junk\s?clean|speed\s?boost|booster|antivirus|qr\s?(scanner|code)|wallpaper|"
     r"ringtone|keyboard|file\s?manager|compass|magnifier)"),
    ("Opaque / Unknown Inventory", "BLOCK",
     r"(?iU)^(unknown|n/?a|not\s?available|other|mobile|in-?app|app|display|video|untracked|"
     r"\(?not\s?set\)?)$"),
    ("Unresolved App Bundle", "BLOCK", r"(?iU)^(com|net|org|io)\.[a-z0-9_.]+$"),
    ("Kids / Coloring App", "REVIEW",
     r"(?iU)\b(coloring|nursery\s?rhyme|toddler|preschool|abc\s?kids|baby\s?game)\b"),
    ("Recognizable Publisher (audience-fit check)", "REVIEW",
     r"(?iU)\b(fox\s?news|cnn|msnbc|al\s?jazeera|nytimes|washington\s?post|usa\s?today|"
     r"weather\.com|accuweather|espn|yahoo|forbes|buzzfeed|daily\s?mail|hulu|roku|"
     r"pluto\s?tv|tubi|peacock|paramount|pandora|spotify|iheart)"),
]
BLANK_PLACEMENT_RULE = ("Blank / Missing Name", "BLOCK")
OTHER_PLACEMENT_RULE = ("Unclassified", "REVIEW")

# Streaming platforms that are never blocked on quality (lower-case parts of a name or id).
STREAMING_PLATFORMS = [
    "xumo", "fawesome", "pluto", "tubi", "plex", "roku channel", "samsung tv plus",
    "lg channels", "watchfree", "watch free", "vizio", "freevee", "sling", "telly", "philo",
    "directv", "fubo", "crackle", "local now", "scripps", "stirr",
]

COMPOSITE_ID = r"^(.*?)\s*\(([^()]+)\)\s*$"
STORE_ID = r"^\d{6,}$"
MOBILE_BUNDLE = r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+){2,}$"
PLATFORM_SUFFIX = r"\s*-\s*(android|ios|iphone|ipad)\s*$"
DSP_MARKER = r"TTD|DV360"

# Last labels of a site domain, and first labels of a reverse-domain application id.
SITE_TLDS = [
    "com", "net", "org", "co", "io", "tv", "us", "uk", "ca", "de", "fr", "es", "it", "nl",
    "se", "jp", "au", "in", "br", "mx", "fm", "gg", "me", "app", "edu", "gov", "info", "biz",
    "news",
]
BUNDLE_ROOTS = [
    "com", "net", "org", "co", "io", "tv", "jp", "de", "uk", "us", "air", "me", "app", "tw",
    "kr",
]

# --- creative names and sizes ---------------------------------------------------------------

UNNAMED_PREFIX = r"(?iU)^(copy of|untitled|new creative|creative\s*\d*)\b"
SIZE_TOKEN = r"(?U)(?<![\d.])(\d{2,4})\s?[xX×]\s?(\d{2,4})(?![\d.])"
VIDEO_FILE = r"(?iU)\.(?:mp4|mov|m4v|webm|avi)\b"
IMAGE_FILE = r"(?iU)\.(?:jpe?g|png|gif|webp|bmp)\b"
BANNER_SIZES = [
    "300x250", "728x90", "320x50", "300x600", "160x600", "336x280", "970x250", "970x90",
    "300x50", "320x100", "234x60", "468x60", "250x250", "200x200", "240x400", "580x400",
    "300x1050", "320x480", "480x320", "120x600", "180x150",
]
SOCIAL_SIZES = [
    "1080x1080", "1080x1920", "1200x628", "1080x1350", "1200x1200", "1920x1080", "1080x608",
    "600x600", "1080x566", "640x640", "1200x675",
]

# --- URL tagging ----------------------------------------------------------------------------

UTM_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id",
    "utm_source_platform",
]
UTM_CORE = ["utm_source", "utm_medium", "utm_campaign"]
OTHER_TRACKING_KEYS = [
    "gclid", "fbclid", "msclkid", "ttclid", "dclid", "wbraid", "gbraid", "cid", "mc_cid",
    "li_fat_id", "epik", "twclid", "sccid", "vmcid",
]

# --- creative checks: key -> (label, severity) ----------------------------------------------

CREATIVE_CHECKS = {
    "blank_creative": ("Blank creative name", "critical"),
    "sm_display_size": ("Social Mirror creative named with a display banner size", "critical"),
    "sm_social_size": ("Social Mirror creative with a size in its name", "info"),
    "format_mismatch": ("Creative format doesn't match the product", "warn"),
    "missing_preview": ("Missing preview image URL", "warn"),
    "missing_click_url": ("Missing clickthrough URL", "warn"),
    "no_utm": ("Clickthrough URL with no UTM codes", "info"),
    "missing_creative_id": ("Missing creative ID", "warn"),
    "id_name_conflict": ("One creative ID, several names", "warn"),
    "unmapped_product": ("Unrecognized product value", "warn"),
    "missing_bu": ("Missing business unit", "info"),
    "impossible_metrics": ("Impossible metrics", "warn"),
    "delivery_no_spend": ("Delivery with zero spend", "info"),
}

# --- files ----------------------------------------------------------------------------------

FILE_DATE = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
EXPORT_KINDS = ["sites", "apps", "ttddv", "creatives"]
CREATIVE_FILE_MARK = "creativeinsights"
COMBINED_FILE_MARK = "ttddv"
SITE_FILE_MARK = "site"
APP_FILE_MARK = "app"

# --- recommendation categories --------------------------------------------------------------

LOW_CTR_CATEGORY = "Low CTR / no conv"
HIGH_CTR_CATEGORY = "High CTR"
CLONE_CATEGORY = "Clone-family app"
FILTER_FIELDS = {"site": "Site Domain", "app": "App ID"}
