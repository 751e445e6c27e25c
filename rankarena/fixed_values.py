"""Texts, names and numbers that results depend on, kept in one place."""

# --- Fixed values: they must be exactly these for results to agree. ---

# Chat prompt of a contestant, in message order.
CONTESTANT_INTRO = "You are a contestant in an information retrieval SEO competition."
QUERIES_INTRO = "The competition involves %d queries: %s"
GOAL_INTRO = (
    "The goal is to have your document be ranked 1st (first) and win in the ranking done by a black "
    "box ranker in every single epoch."
)
REFERENCE_TEXT_INTRO = "All contestants got an initial reference text: '%s'."
GENERATE_REQUEST = "Generate a single text that addresses the information need for all queries."
OWN_RANK = "You were ranked %d%s in this epoch"
OPPONENTS_INTRO = "The ranked documents of your opponents in this epoch are as follows:\n "
TOP_DOCUMENT = "The document ranked 1 in this epoch was: %s"

# Fine-tuning prompt: query, then feature text.
FINE_TUNE_PROMPT = (
    "Given the query '%s', please write a superior feature text that better describes it "
    "than the following inferior feature text: '%s'.\n\nGenerated text: "
)

# Initial-document prompt: three sub-topics, then the scenario.
INITIAL_DOCUMENT_PROMPT = (
    "Given a scenario depicting the information need, write a short text that the person described in the "
    "scenario would like to read. "
    "The text should cover the following subtopics: '%s',"
    "'%s', '%s'\n\nScenario: %s\n\nGenerated text:"
)

# Bot names by (uses only the last round, what the bot is shown).
BOT_NAMES = {
    (False, "all"): "NMABOT",
    (False, "tops"): "NMTBOT",
    (False, "self"): "NMSBOT",
    (True, "all"): "MABOT",
    (True, "tops"): "MTBOT",
    (True, "self"): "MSBOT",
}

# Generation limits.
MAX_COMPLETION_TOKENS = 700
COMPLETION_TOKEN_STEP = 50
PROMPT_TOKEN_MARGIN = 200
CONTEXT_TOKENS = 4096
MAX_WORDS = 150

# Relevance grade that keeps a document out of the training pairs.
EXCLUDED_RELEVANCE = 3
TOP_POSITIONS = 4

# File formats.
NEURAL_FEATURE = 26
QUERY_ID_WIDTH = 3
RUN_TAG = "indri"
QUERY_TEXT_WRAPPER = "#combine( %s )"
FEATURE_NAME_LINE = "BertScore:26"

# Characters that Python's str.split() and str.strip() treat as white space,
# written as the inside of a regular-expression character class.
WHITE_SPACE = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Tokens of a (query, text) pair that the neural model reads, and how many of them are its own.
PAIR_TOKENS = 512
PAIR_SPECIAL_TOKENS = 3

# --- Own choices: the originals are not published, any change shifts feature values. ---

TOKEN = r"[\p{L}\p{N}]+"
BM25_K1 = 1.2
BM25_B = 0.75
ABSOLUTE_DISCOUNT = 0.7
DIRICHLET_MU = 2500.0
JELINEK_MERCER_LAMBDA = 0.7
