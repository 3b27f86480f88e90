"""Fixed values that results depend on: word lists, patterns and thresholds of the rules. Nothing here is logic."""

# Link texts that say nothing out of context.
GENERIC_LINK_TEXT = (
    "click here", "here", "read more", "more", "link", "this", "learn more", "details", "click", "more info", "go here", "this page", "url", "link here",
    "continue reading", "see more", "view more", "website", "web site", "read this", "full story", "read", "info", "the link", "this link", "this article",
    "this document", "this report", "this post", "click this link", "click the link", "click below", "click for more", "click here for more", "click to read",
    "click to read more", "click to learn more", "click for details", "tap here", "press here", "open link", "go to link", "more details", "find out more",
    "see details", "see here", "view this", "check it out", "check this out", "follow this link", "follow the link", "full article", "read here", "read on",
)
# The shorter list of the document-level scan.
GENERIC_LINK_LABELS = ("click here", "here", "read more", "learn more", "more", "link", "this")
# Header labels that say nothing.
GENERIC_HEADERS = ("column", "column 1", "column 2", "header", "n/a", "na", "value")
# Top-level domains that make a bare domain of a link text.
LINK_DOMAINS = "com|org|net|edu|gov|mil|int|io|co|us|uk|ca|au|de|fr|jp|cn|info|biz|app|dev|ai"
# Patterns of lines that read like headings, numbered or all in capitals.
NUMBERED_LINE = r"^(\d+(?:\.\d+){0,5})\s+.+$"
CAPITAL_LINE = r"^[A-Z0-9][A-Z0-9 \-:&,'\".]+$"
# Link targets that lead nowhere.
BROKEN_TARGETS = ("", "#", "http://", "https://")
PLACEHOLDER_TARGETS = ("http://", "https://", "www.", "mailto:")

# Image descriptions that describe nothing.
JUNK_ALT = (
    "n/a", "na", "n.a.", "none", "null", "nil", "blank", "empty", "tbd", "todo", "to do", "test", "temp", "tmp", "asdf", "xxx", "...", "--", "—",
    "no alt", "no alt text", "no description", "alt", "alt text", "alttext", "description", "desc", "caption", "title", "name",
)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "svg", "webp", "emf", "wmf", "heic", "ico")
IMAGE_WORDS = (
    "image", "picture", "photo", "photograph", "graphic", "graphics", "img", "pic", "figure", "drawing", "object", "chart", "diagram", "shape", "placeholder",
    "untitled", "content placeholder", "logo", "banner", "icon", "avatar", "thumbnail", "illustration", "artwork", "clipart", "clip art", "screenshot",
    "screen shot", "headshot", "snapshot", "image file",
)
CAMERA_PREFIXES = ("dscn", "dscf", "dsc", "imgp", "img", "gopr", "screen ?shot", "screenshot", "capture")
ALT_PATTERNS = (
    r"^(https?://|www\.|ftp://|file:|data:image/)", r"^([a-zA-Z]:[\\/]|\.{0,2}[\\/])\S+$", r"^\d{2,5}\s*[x×*]\s*\d{2,5}(\s*px)?$",
    r"^(image|picture|figure|graphic|photo|img)\b.*?\bshown\s+(in|on)\s+(the\s+)?(page|slide|sheet|document|deck|file)(\s*\d+)?\.?$",
    r"^(image|picture|figure|graphic|photo|img)\b.*?\b(page|slide|sheet)\s*\d+\.?$",
)
ALT_BANNED_PREFIXES = ("image of", "picture of", "photo of", "graphic of")
ALT_BANNED_VALUES = ("decorative", "n/a", "none", "no alt")
ALT_MAX_CHARS = 140

# Document titles that authoring tools put in.
GENERIC_TITLES = (
    "untitled", "untitled document", "untitled presentation", "untitled spreadsheet", "untitled form", "title", "document", "presentation",
    "powerpoint presentation", "microsoft word document", "microsoft powerpoint presentation", "microsoft excel worksheet", "new microsoft word document",
    "new microsoft powerpoint presentation", "new microsoft excel worksheet", "new document", "new presentation", "new spreadsheet", "blank", "blank document",
    "blank presentation", "blank spreadsheet", "slide 1", "spreadsheet", "workbook", "no title", "document title", "presentation title", "click to add title",
    "add title", "title here", "your title here", "type a title", "enter title here", "google docs", "google slides", "google sheets",
)
NUMBERED_TITLES = ("document", "presentation", "doc", "slide", "untitled", "book", "workbook", "sheet", "spreadsheet", "drawing", "form", "page", "copy")

# Function words that vote for a language, in the order that wins ties.
LANGUAGE_WORDS = (
    ("en", ("the", "and", "of", "to", "in", "is", "for", "with", "on")),
    ("fr", ("le", "la", "les", "de", "et", "une", "des", "pour")),
    ("es", ("el", "la", "los", "de", "y", "para", "una", "que")),
    ("de", ("der", "die", "das", "und", "von", "zu", "ein", "nicht")),
    ("it", ("il", "la", "le", "di", "e", "per", "un", "una")),
)
# Code point ranges of scripts that name a language; Han only where no kana or hangul occur.
SCRIPTS = (("ja", 0x3040, 0x30FF), ("ko", 0xAC00, 0xD7AF), ("ko", 0x1100, 0x11FF), ("ar", 0x0600, 0x06FF), ("he", 0x0590, 0x05FF), ("ru", 0x0400, 0x04FF),
           ("el", 0x0370, 0x03FF), ("th", 0x0E00, 0x0E7F), ("hi", 0x0900, 0x097F))
HAN = (0x4E00, 0x9FFF)

# Bands of reading ease, from the easiest down.
EASE_BANDS = ((90, "Very easy — 5th grade"), (80, "Easy — 6th grade"), (70, "Fairly easy — 7th grade"), (60, "Plain English — 8th–9th grade"),
              (50, "Fairly difficult — 10th–12th grade"), (30, "Difficult — college"), (None, "Very difficult — college graduate"))

# Score thresholds of grades.
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"), (None, "F"))

# Credits for a file, by format.
CREDIT_COSTS = {"pdf": 5, "docx": 3, "pptx": 4, "html": 3, "htm": 3}
DEFAULT_CREDIT_COST = 5

# Events that the audit log accepts.
AUDIT_EVENTS = ("analyze", "analyze_url", "scan_site", "remediate", "share_create", "share_view", "download", "manual_review_resolve", "auth_fail",
                "grant_credits", "spend_credits", "purchase_credits")
