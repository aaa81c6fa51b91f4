"""Fixed values.

These must equal the benchmark harness's vocabulary for results to line up:
label names, range names, sentence wording, status prefixes and name formats.
They are stated here once, in natural order, and used everywhere else.
"""

# --- fixed values: reason labels, default report order --------------------
REASON_LABELS = [
    "List_Comprehension", "Lambda_Expressions", "Generator_Expressions",
    "If Condition", "If Body", "Elif Condition", "Elif Body", "Else Reasoning",
    "Stream_Operations", "Loop Body", "Define Stop Criteria", "Super_Call",
]

# --- fixed values: all reason labels recognised in reason sentences -------
REASON_PATTERN_LABELS = [
    "If Condition", "If Body", "Elif Condition", "Elif Body", "Else Reasoning",
    "Pattern-Based Completion", "Define Stop Criteria", "Loop Body",
    "Generator_Expressions", "Super_Call", "List_Comprehension",
    "Lambda_Expressions", "Stream_Operations",
]

# --- fixed values: horizon labels, default report order -------------------
HORIZON_LABELS = [
    "Short-Range", "Medium-Range", "Long-Range", "Variable", "Global_Variable",
    "Function", "Class", "Library", "Interface",
]

RANGE_LABELS = ["Short-Range", "Medium-Range", "Long-Range"]
HORIZON_RANGES = RANGE_LABELS

# --- fixed values: definition kinds in horizon sentences -------------------
HORIZON_TYPES = ["Variable", "Function", "Class", "Library", "Global_Variable", "Interface"]

# --- fixed values: comprehension scopes in horizon sentences --------------
COMP_TYPES = ["List_Comprehension", "Generator_Expressions", "Lambda_Expressions", "Loop"]

# --- fixed values: run file names ------------------------------------------
GEN_MODES = ["no_afterlines", "with_afterlines", "no_instruction"]
RUN_NAME_PATTERN = r"([^_]+)_(no_afterlines|with_afterlines|no_instruction)_(.+?)_(\d{2}_\d{2}_\d{2}_\d{2})"

# --- fixed values: evaluation status prefixes -------------------------------
STATUS_SUCCESS = "Success"
STATUS_FAILURE = "Failure"
STATUS_COMPILE = "Error: Compilation error"
STATUS_RUNTIME = "Error"
STATUS_TIMEOUT = "Timeout"
STATUS_UNEXPECTED = "Unexpected error"

# --- fixed values: post-processing step names, default order ---------------
POST_STEPS = ["original_code", "cleaned_code", "trimmed_code", "indented_code"]

# --- fixed values: error bar ------------------------------------------------
Z95 = 1.96
RESAMPLES = 10000

# --- fixed values: scope types ----------------------------------------------
PY_SCOPES = ["local", "function", "class", "library", "list_comp", "generator_exp", "lambda", "loop", "global"]
JAVA_SCOPES = ["locals", "methods", "classes", "libraries", "globals", "interfaces", "loops",
               "lambda", "list_comp", "generator_exp"]

# --- fixed values: dependency sentences, Python scopes ---------------------
# scope -> (subject, middle); sentence =
#   "{subject} '{name}' used at line {use} {middle} {def} and has a {range} dependency."
PY_SENTENCE = {
    "function": ("Function", "is defined at line"),
    "class": ("Class", "is defined at line"),
    "library": ("Library", "is imported at line"),
    "list_comp": ("Variable", "is part of a List_Comprehension defined at line"),
    "generator_exp": ("Variable", "is part of a Generator_Expressions defined at line"),
    "lambda": ("Variable", "is part of a Lambda_Expressions defined at line"),
    "loop": ("Variable", "is part of a Loop defined at line"),
    "global": ("Global_Variable", "is defined at line"),
    "local": ("Variable", "is defined at line"),
}
PY_UNDEFINED = "Variable '{name}' used at line {use} is undefined and has a {range} dependency."

# --- fixed values: dependency sentences, Java scopes -----------------------
# "{subject} '{name}' used at line {use}{part} is defined at line {def} and has a {range} dependency."
JAVA_SENTENCE = {
    "methods": ("Function", ""),
    "classes": ("Class", ""),
    "libraries": ("Library", ""),
    "list_comp": ("Variable", " is part of a List_Comprehension"),
    "generator_exp": ("Variable", " is part of a Generator_Expression"),
    "lambda": ("Variable", " is part of a Lambda_Expression"),
    "loops": ("Variable", " is part of a Loop"),
    "globals": ("Global_Variable", ""),
    "locals": ("Variable", ""),
    "interfaces": ("Interface", ""),
}
REASON_SENTENCE = "'{reason}' detected at line {line}."

# Scopes whose use on the definition line is still reported.
COMPREHENSION_SCOPES = ["list_comp", "generator_exp", "lambda"]

# --- fixed values: sentence patterns ---------------------------------------
DISTANCE_PATTERN = r"(\w+) '.*?' used at line (\d+) is defined at line (\d+)"
HORIZON_PATTERN = (
    r"(Variable|Function|Class|Interface|Library|Global_Variable) '.*?' used at line \d+ "
    r"(?:is (?:imported|defined) at line \d+ and has a (Short-Range|Medium-Range|Long-Range) dependency\.|"
    r"is part of a (List_Comprehension|Generator_Expressions|Lambda_Expressions|Loop) defined at line \d+ "
    r"and has a (Short-Range|Medium-Range|Long-Range) dependency\.)"
)
REASON_PATTERN = (
    r"'(If Condition|If Body|Elif Condition|Elif Body|Else Reasoning|Pattern-Based Completion|"
    r"Define Stop Criteria|Loop Body|Generator_Expressions|Super_Call|List_Comprehension|"
    r"Lambda_Expressions|Stream_Operations)' detected at line \d+\."
)

# --- fixed values: verdicts of the output comparison, and the lines of a test runner's summary ---
FINAL_MATCHES = "Success: Final output matches the expected results."
FINAL_DIFFERS = "Failure: Final output does not match."
ALL_MATCHES = "Success: All Output matches the expected results."
ALL_DIFFERS = "Failure: All Output does not match."
TESTS_SUCCESSFUL = r"\[\s*(\d+) tests successful\s*\]"
TESTS_FOUND = r"\[\s*(\d+) tests found\s*\]"
