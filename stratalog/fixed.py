"""Fixed values that results depend on: patterns, word lists and labels."""

# How a commit message is told to come from a bot.
HUMAN_OVERRIDE = [r"^Fix\b"]
DOC_ONLY = [r"\bUpdate\s+release\s+notes\b"]
DOC_EXTENSIONS = [".html", ".htm", ".pdf", ".md", ".rst", ".mo", ".txt", ".csv"]
BOT_MESSAGES = [
    r"\[(?:skip\s*[-_ ]?\s*ci|ci\s*[-_ ]?\s*skip)\]",
    r"\bUpdate\s+versionDate\b",
    r"\bVersion\s+bump\b",
    r"\b(Bump|Auto-?update)\s+version\b",
    r"^Update\s+to\s+v\d",
    r"\bUpdate\s+version\b",
    r"\bUpdate\s+\.mailmap\b",
    r"\bUpdate\s+release\s+notes\b",
]

# Failure classes in the order in which they are tried.
FAILURES = [
    (r"loadFile|loadModel|could not (load|open)|package.*not found|failed to load", "Package load failure"),
    (r"extends.*not found|base.?class.*not|could not find.*base|unknown base", "Missing base class"),
    (r"class.*not found|not found in scope|could not find class|unknown class|lookup.*failed", "Missing referenced class"),
    (r"replaceable|redeclare|redeclaration|not replaceable", "Replaceable/redeclare conflict"),
    (r"restriction|operator.?record|illegal.*operator", "Operator-record restriction"),
    (r"type\s+error|type.*mismatch|incompatible.*type", "Type mismatch"),
    (r"savetotalmodel|save.*total.*model|timeout|timed out", "Canonicalization timeout"),
    (r"syntax|parse\s*error|unexpected token", "Syntax error"),
]
EMPTY_FAILURE = "Empty error / unknown"
OTHER_FAILURE = "Other"
REPORTED_FAILURES = {
    "Operator-record restriction": "FailOperatorRestriction",
    "Missing referenced class": "FailMissingClass",
    "Replaceable/redeclare conflict": "FailRedeclare",
    "Missing base class": "FailMissingBase",
    "Canonicalization timeout": "FailTimeout",
    "Package load failure": "FailPackageLoad",
}

# Annotations without effect on a simulation, and the own vendor.
NON_SEMANTIC = [
    "version", "versionDate", "versionBuild", "dateModified", "revisionId", "uses", "conversion", "obsolete",
    "preferredView", "defaultComponentName", "defaultComponentPrefixes", "Dialog", "choices", "choicesAllMatching",
    "colorSelector", "singleInstance", "showDiagramLabel", "connectorSizing",
    "absoluteValue", "inverseUnit",
    "Icon", "Diagram", "IconMap", "DiagramMap", "Placement", "Line", "Text", "Rectangle", "Polygon", "Ellipse",
    "Bitmap", "coordinateSystem", "graphics", "Documentation",
]
OWN_VENDOR = "OpenModelica"

# The name that an annotation item declares, and the vendor in such a name.
ITEM_KEY = r"^\s*([A-Za-z_$][A-Za-z0-9_$]*)"
VENDOR_KEY = "^__([A-Za-z0-9]+)_"

# Funnel reasons and the substrings by which reports bucket them.
EXCLUDED_BRANCH = "excluded branch"
NO_FILES = "no .mo files"
BOT_SIGNS = ["bot", "commit message matches", "author name contains", "author email contains"]

# Outcomes of canonical texts.
EMPTY_OUTPUT = "canonical output is empty (0 bytes)"
TRUNCATED_OUTPUT = "canonical output is truncated (no terminating 'end <class>;')"
FAILURE_TYPES = ["checkout_failed", "load_model_failed", "annotation_cleanup_failed", "no_classes", "canonical_no_output"]

# Labels of the step-3 scope.
ALL_SCOPE = "All experiment classes"
PILOT_SCOPE = "Pilot whitelist"
