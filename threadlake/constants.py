"""Fixed values. They decide results, so they are stated plainly and in one place."""

# Body prefix that marks a command to the assistant (note the trailing space).
COMMAND_PREFIX = "@recall "

# Retrieval.
RRF_K = 60
LEG_LIMIT = 20
FUSED_LIMIT = 12
RERANK_POOL = 20
RERANK_KEEP = 6
SEARCH_LIMIT = 8
CONTEXT_TOKEN_BUDGET = 4000
SOURCE_OVERHEAD_TOKENS = 30
NEAR_DUP_CHARS = 300
SNIPPET_CHARS = 180
BM25_K1 = 1.2
BM25_B = 0.75

# Chunking.
CHUNK_CHARS = 2000
OVERLAP_CHARS = 300

# Deterministic embedder.
EMBED_DIMS = 64
EMBED_STEP = 0x6D2B79F5

# Caps of the chat surfaces.
SYNC_CAP = 200
CATCHUP_CAP = 200
DECISIONS_WINDOW = 200
DECISIONS_KEEP = 10
FEEDBACK_EXPORT_CAP = 1000
ACTIVE_ROOMS_CAP = 20
ONLINE_SNAPSHOT_CAP = 1000
HEADER_GAP_SECONDS = 180
TYPING_EXPIRY_SECONDS = 3
MAX_ROOMS_CREATED = 50
MAX_ROOMS_JOINED = 100
MAX_ACTIVE_TOKENS = 10

# Semantic answer cache.
CACHE_ENTRIES = 20
CACHE_SIMILARITY = 0.95
CACHE_TTL_SECONDS = 86_400

# Quota and breaker.
DAILY_TOKEN_QUOTA = 200_000
BREAKER_THRESHOLD = 5
BREAKER_WINDOW_SECONDS = 60
BREAKER_COOLDOWN_SECONDS = 30

# Sliding-window limits: (limit, window seconds, mute seconds).
MESSAGE_RATE = (10, 10, 10)
JOIN_RATE = (15, 10, 5)
CONNECT_RATE = (30, 60, 60)

# Ingestion retries before a row is dead-lettered.
MESSAGE_ATTEMPTS = 5
DOCUMENT_ATTEMPTS = 3

DECISION_PATTERN = (
    r"(?i)\b(decided|decision|agreed|approved|we are going with|shipping on|locked)\b"
)

# USD per million tokens: (model, in, out). Unknown models cost nothing.
PRICES = [
    ("claude-haiku-4-5-20251001", "1.00", "5.00"),
    ("claude-sonnet-4-6", "3.00", "15.00"),
    ("gpt-4o-mini", "0.15", "0.60"),
    ("text-embedding-3-small", "0.02", "0.00"),
    ("mock-chat-1", "0.00", "0.00"),
    ("mock-embed-1", "0.00", "0.00"),
]

# Columns that must never leave the source.
SECRET_COLUMNS = {
    "users": ("passwordHash",),
    "invites": ("tokenHash",),
    "pats": ("tokenHash",),
}

GHOST_USERNAME = "deleted"
GHOST_DISPLAY_NAME = "Deleted user"

# White space as a browser's trim() and \s see it, spelled so that both Java and
# RE2 accept it inside a character class.
WIDE_SPACE = (
    r"\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}\x{feff}"
)

# The same characters as a plain set, for trimming at both ends.
WIDE_SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
