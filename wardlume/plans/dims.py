"""Small dimension tables: rules, actions, criteria, policies, what each format's writer keeps. Fixed sizes, safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule, severity, WCAG 2.1 criteria, Section 508, PDF/UA, actions in order with flags (A applies itself, H human review, I needs inference).
RULES = (
    ("MISSING_ALT_TEXT", "error", "1.1.1", "E205.1", "7.1-4", "GENERATE_ALT_TEXT:HI"),
    ("DECORATIVE_IMAGE_WITH_ALT", "warning", "1.1.1", "E205.1", "7.1-4", "REMOVE_DECORATIVE_ALT_TEXT:A"),
    ("HEADING_LEVEL_JUMP", "warning", "1.3.1", "E207.2", "7.3-5", "NORMALIZE_HEADING_LEVEL:A"),
    ("SKIPPED_HEADING_LEVEL", "warning", "1.3.1", "E207.2", "7.3-5", "NORMALIZE_HEADING_LEVEL:A"),
    ("TABLE_MISSING_HEADERS", "error", "1.3.1", "E205.2", "7.3-5", "ADD_TABLE_HEADERS:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("TABLE_HEADER_SCOPE_INVALID", "warning", "1.3.1", "E205.2", "7.3-5", "SET_TABLE_HEADER_SCOPE:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("LIST_STRUCTURE_INVALID", "warning", "1.3.1", "E207.2", "7.3-3", "FIX_LIST_STRUCTURE:A"),
    ("LINK_TEXT_NON_DESCRIPTIVE", "warning", "2.4.4", "E205.4", "7.6-6", "IMPROVE_LINK_TEXT:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("LINK_NAME_MISSING", "error", "2.4.4 4.1.2", "E205.4", "7.18.1", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("IFRAME_TITLE_MISSING", "error", "4.1.2 2.4.1", "E205.4", "", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("INPUT_AUTOCOMPLETE_MISSING", "warning", "1.3.5", "E205.4", "", "SET_INPUT_AUTOCOMPLETE:H"),
    ("POSITIVE_TABINDEX", "warning", "2.4.3", "E205.4", "", "FIX_POSITIVE_TABINDEX:H"),
    ("LABEL_IN_NAME_MISMATCH", "error", "2.5.3", "E205.4", "", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("DOCUMENT_LANGUAGE_MISSING", "error", "3.1.1", "E207.1", "7.2-1", "SET_DOCUMENT_LANGUAGE:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("DOCUMENT_TITLE_MISSING", "warning", "2.4.2", "E207.4", "7.1-2", "SET_DOCUMENT_TITLE:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("READING_ORDER_AMBIGUOUS", "warning", "1.3.2", "E207.2", "7.3-5", "RESOLVE_READING_ORDER:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("HEADING_TEXT_EMPTY", "error", "2.4.6", "E207.2", "7.3-5", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("TABLE_CAPTION_MISSING", "warning", "1.3.1", "E205.2", "7.3-5", "GENERATE_TABLE_CAPTION:HI"),
    ("TABLE_COMPLEX_NEEDS_SUMMARY", "warning", "1.3.1", "E205.2", "7.5", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("TABLE_NESTED", "warning", "1.3.1", "E205.2", "7.5", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("LINK_TARGET_BROKEN", "warning", "2.4.4", "E205.4", "7.6-6", "FLAG_FOR_MANUAL_REVIEW:H"),
    ("LOW_CONTRAST_TEXT", "warning", "1.4.3", "E205.4", "", "FIX_CONTRAST:H FLAG_FOR_MANUAL_REVIEW:H"),
    ("FORM_FIELD_UNLABELED", "error", "3.3.2 4.1.2", "E205.4", "7.18-1", "FILL_FORM_FIELD_LABELS:A FLAG_FOR_MANUAL_REVIEW:H"),
    ("SLIDE_TITLE_MISSING", "error", "2.4.2 1.3.1", "E205.4", "", "SET_SLIDE_TITLE:A"),
    ("ALT_TEXT_NOT_DESCRIPTIVE", "warning", "1.1.1", "E205.1", "7.1-4", "GENERATE_ALT_TEXT:HI"),
    ("DOCUMENT_NO_HEADINGS", "warning", "2.4.6 1.3.1", "E207.2", "7.3-1", ""),
    ("SCANNED_DOCUMENT_NO_TEXT", "error", "1.1.1 1.4.5", "E205.1", "7.1-2", "ADD_OCR_TEXT_LAYER:A FLAG_FOR_MANUAL_REVIEW:H"),
    ("PDF_UNTAGGED", "error", "1.3.1", "E205.4", "7.1-2", "TAG_PDF_STRUCTURE:A"),
    ("TEXT_STYLED_AS_HEADING", "warning", "1.3.1", "E207.2", "", "PROMOTE_HEADING:A"),
    ("ANALYSIS_TRUNCATED", "error", "", "", "", "FLAG_FOR_MANUAL_REVIEW:H"),
)
# WCAG 2.1 criteria of levels A and AA.
CRITERIA = (
    ("1.1.1", "Non-text Content", "A"), ("1.2.1", "Audio-only and Video-only (Prerecorded)", "A"), ("1.2.2", "Captions (Prerecorded)", "A"),
    ("1.2.3", "Audio Description or Media Alternative (Prerecorded)", "A"), ("1.2.4", "Captions (Live)", "AA"), ("1.2.5", "Audio Description (Prerecorded)", "AA"),
    ("1.3.1", "Info and Relationships", "A"), ("1.3.2", "Meaningful Sequence", "A"), ("1.3.3", "Sensory Characteristics", "A"), ("1.3.4", "Orientation", "AA"),
    ("1.3.5", "Identify Input Purpose", "AA"), ("1.4.1", "Use of Color", "A"), ("1.4.2", "Audio Control", "A"), ("1.4.3", "Contrast (Minimum)", "AA"),
    ("1.4.4", "Resize Text", "AA"), ("1.4.5", "Images of Text", "AA"), ("1.4.10", "Reflow", "AA"), ("1.4.11", "Non-text Contrast", "AA"), ("1.4.12", "Text Spacing", "AA"),
    ("1.4.13", "Content on Hover or Focus", "AA"), ("2.1.1", "Keyboard", "A"), ("2.1.2", "No Keyboard Trap", "A"), ("2.1.4", "Character Key Shortcuts", "A"),
    ("2.2.1", "Timing Adjustable", "A"), ("2.2.2", "Pause, Stop, Hide", "A"), ("2.3.1", "Three Flashes or Below Threshold", "A"), ("2.4.1", "Bypass Blocks", "A"),
    ("2.4.2", "Page Titled", "A"), ("2.4.3", "Focus Order", "A"), ("2.4.4", "Link Purpose (In Context)", "A"), ("2.4.5", "Multiple Ways", "AA"), ("2.4.6", "Headings and Labels", "AA"),
    ("2.4.7", "Focus Visible", "AA"), ("2.5.1", "Pointer Gestures", "A"), ("2.5.2", "Pointer Cancellation", "A"), ("2.5.3", "Label in Name", "A"), ("2.5.4", "Motion Actuation", "A"),
    ("3.1.1", "Language of Page", "A"), ("3.1.2", "Language of Parts", "AA"), ("3.2.1", "On Focus", "A"), ("3.2.2", "On Input", "A"), ("3.2.3", "Consistent Navigation", "AA"),
    ("3.2.4", "Consistent Identification", "AA"), ("3.3.1", "Error Identification", "A"), ("3.3.2", "Labels or Instructions", "A"), ("3.3.3", "Error Suggestion", "AA"),
    ("3.3.4", "Error Prevention (Legal, Financial, Data)", "AA"), ("4.1.1", "Parsing", "A"), ("4.1.2", "Name, Role, Value", "A"), ("4.1.3", "Status Messages", "AA"),
)
# Rules that a criterion's verdict looks at.
CRITERION_RULES = {
    "1.1.1": "MISSING_ALT_TEXT DECORATIVE_IMAGE_WITH_ALT ALT_TEXT_NOT_DESCRIPTIVE SCANNED_DOCUMENT_NO_TEXT",
    "1.3.1": "HEADING_LEVEL_JUMP SKIPPED_HEADING_LEVEL TABLE_MISSING_HEADERS TABLE_HEADER_SCOPE_INVALID LIST_STRUCTURE_INVALID HEADING_TEXT_EMPTY TABLE_CAPTION_MISSING "
             "TEXT_STYLED_AS_HEADING PDF_UNTAGGED DOCUMENT_NO_HEADINGS SLIDE_TITLE_MISSING",
    "1.3.2": "READING_ORDER_AMBIGUOUS", "1.3.5": "INPUT_AUTOCOMPLETE_MISSING", "1.4.3": "LOW_CONTRAST_TEXT", "1.4.5": "SCANNED_DOCUMENT_NO_TEXT",
    "2.4.2": "DOCUMENT_TITLE_MISSING SLIDE_TITLE_MISSING", "2.4.1": "IFRAME_TITLE_MISSING", "2.4.3": "POSITIVE_TABINDEX", "2.5.3": "LABEL_IN_NAME_MISMATCH",
    "2.4.4": "LINK_TEXT_NON_DESCRIPTIVE LINK_TARGET_BROKEN LINK_NAME_MISSING", "2.4.6": "HEADING_TEXT_EMPTY DOCUMENT_NO_HEADINGS", "3.1.1": "DOCUMENT_LANGUAGE_MISSING",
    "3.3.2": "FORM_FIELD_UNLABELED", "4.1.2": "FORM_FIELD_UNLABELED LINK_NAME_MISSING IFRAME_TITLE_MISSING",
}
# Actions that each format's writer really saves, and those that need its confirmation.
PERSISTED = {
    "docx": "SET_DOCUMENT_TITLE SET_DOCUMENT_LANGUAGE NORMALIZE_HEADING_LEVEL PROMOTE_HEADING GENERATE_ALT_TEXT REMOVE_DECORATIVE_ALT_TEXT ADD_TABLE_HEADERS IMPROVE_LINK_TEXT "
            "FIX_LIST_STRUCTURE FILL_FORM_FIELD_LABELS FIX_CONTRAST GENERATE_TABLE_CAPTION",
    "pptx": "SET_DOCUMENT_TITLE SET_DOCUMENT_LANGUAGE SET_SLIDE_TITLE GENERATE_ALT_TEXT REMOVE_DECORATIVE_ALT_TEXT IMPROVE_LINK_TEXT ADD_TABLE_HEADERS FIX_LIST_STRUCTURE FIX_CONTRAST",
    "pdf": "SET_DOCUMENT_TITLE SET_DOCUMENT_LANGUAGE GENERATE_ALT_TEXT REMOVE_DECORATIVE_ALT_TEXT TAG_PDF_STRUCTURE ADD_OCR_TEXT_LAYER FILL_FORM_FIELD_LABELS",
    "html": "SET_DOCUMENT_TITLE SET_DOCUMENT_LANGUAGE GENERATE_ALT_TEXT NORMALIZE_HEADING_LEVEL IMPROVE_LINK_TEXT ADD_TABLE_HEADERS FILL_FORM_FIELD_LABELS FIX_LIST_STRUCTURE FIX_CONTRAST "
            "GENERATE_TABLE_CAPTION SET_INPUT_AUTOCOMPLETE FIX_POSITIVE_TABINDEX",
}
CONFIRMED = "FIX_CONTRAST GENERATE_TABLE_CAPTION TAG_PDF_STRUCTURE ADD_OCR_TEXT_LAYER".split()
# Actions that the free scan allows.
SCAN_ACTIONS = ("SET_DOCUMENT_TITLE SET_DOCUMENT_LANGUAGE NORMALIZE_HEADING_LEVEL IMPROVE_LINK_TEXT ADD_TABLE_HEADERS FILL_FORM_FIELD_LABELS FIX_LIST_STRUCTURE FIX_CONTRAST "
                "SET_INPUT_AUTOCOMPLETE FIX_POSITIVE_TABINDEX").split()
# Policy packs (id, weights of critical, serious, moderate and minor) and their severity overrides.
POLICIES = (("policy-508-wcag20-aa", 18.0, 8.0, 3.0, 1.0), ("policy-wcag22-aa-docs", 20.0, 9.0, 4.0, 1.0), ("policy-pdf-ua-focused", 22.0, 10.0, 3.0, 1.0))
POLICY_OVERRIDES = (
    ("policy-508-wcag20-aa", "PDF.MISSING_ALT_TEXT", "serious"), ("policy-508-wcag20-aa", "PDF.TAG_TREE_MISSING", "critical"), ("policy-508-wcag20-aa", "DOCX.METADATA_LANGUAGE_MISSING", "moderate"),
    ("policy-wcag22-aa-docs", "PDF.MISSING_ALT_TEXT", "serious"), ("policy-wcag22-aa-docs", "PDF.TAG_TREE_MISSING", "critical"), ("policy-wcag22-aa-docs", "PPTX.READING_ORDER", "serious"),
    ("policy-pdf-ua-focused", "PDF.TAG_TREE_MISSING", "critical"), ("policy-pdf-ua-focused", "PDF.MISSING_ALT_TEXT", "critical"), ("policy-pdf-ua-focused", "PDF.READING_ORDER", "serious"),
)


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r, s, w.split(), e.split(), p.split()) for r, s, w, e, p, _ in RULES]
    return spark.createDataFrame(rows, "rule_id string, severity string, wcag array<string>, s508 array<string>, pdf_ua array<string>")


def actions(spark: SparkSession) -> DataFrame:
    rows = [(r[0], i, a.partition(":")[0], "I" in f, "H" in f, "A" in f) for r in RULES for i, a in enumerate(r[5].split()) for f in [a.partition(":")[2]]]
    return spark.createDataFrame(rows, "rule_id string, pos int, action_code string, requires_ai boolean, requires_human_review boolean, is_auto_applicable boolean")


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CRITERIA)], "pos int, num string, title string, level string")


def criterion_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, r) for n, rs in CRITERION_RULES.items() for r in rs.split()], "num string, rule_id string")


def persisted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, a, a in CONFIRMED) for f, x in PERSISTED.items() for a in x.split()], "format string, action_code string, needs_confirmation boolean")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES), "policy_id string, critical double, serious double, moderate double, minor double")


def policy_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICY_OVERRIDES), "policy_id string, rule_id string, severity string")
