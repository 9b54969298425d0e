"""Log grammar, error names and thresholds that results depend on.

They are contracts of the log format and of the published metrics, kept together as plain text.
"""

# Request bodies (matched against the whole, trimmed body).
WATCH_BODY = r"^GET /data/m/([^/\s?#]+)/([+-]?[0-9]+)\.mpg\z"
RATING_BODY = r"^GET /rate/([^/\s?#=]+)=([+-]?[0-9]+)\z"
SIGNUP_BODY = "GET /create_account"
RECOMMENDATION_BODY = r"^recommendation request ([^,]+),\s*status ([0-9]{3}),\s*result:\s*(.*)\z"
WATCH_PREFIX = "GET /data/m/"
RATING_PREFIX = "GET /rate/"
RECOMMENDATION_PREFIX = "recommendation request"
MOVIE_ID = r"^[^,\s\[\]]+\z"
DURATION = r"^([0-9]+(?:\.[0-9]+)?)\s*(ms|milliseconds?|s|seconds?|us|µs|microseconds?)\z"

MAX_LONG = 2**63 - 1
MAX_ID_DIGITS = 19

# Ratings, slates and models.
MIN_RATING, MAX_RATING = 1, 10
SLATE_SIZE = 20
DEFAULT_REGULARIZATION = 100.0
DEFAULT_POSITIVE_RATING = 6
DEFAULT_RELEVANT_RATING = 7
COLD_START_WEIGHTS = {"text": 0.50, "genre": 0.25, "collaborative": 0.20, "popularity": 0.05, "dislike": -0.35}
DISLIKED_EXAMPLE_WEIGHT = -0.5
VOCABULARY_SIZE = 30_000
MAX_DESCRIPTION = 2000

# Data quality.
QUALITY_SOURCES = ("kafka", "user_api", "movie_api", "recommendation_api")
MIN_SAMPLES = 50
DRIFT_THRESHOLD = 0.30
MAX_INVALID_FRACTION = 0.10
AGE_BANDS = (18, 30, 45, 60)
RUNTIME_BANDS = (1, 60, 120, 180)
COST_BANDS = (0.01, 0.1, 1, 10)
LATENCY_BANDS = (100, 400, 600)
MAX_AGE = 120

# Sessions, retention and assignment.
IDLE_SECONDS = 300
UNKNOWN_DAY = "9999-12-31"
ASSIGNMENT_BUCKETS = 10_000

# Redaction.
REDACTED = "[redacted]"
SECRET_PARTS = ("authorization", "password", "passwd", "secret", "apikey", "credential", "cookie",
                "sessionid", "sessionkey", "privatekey")
SECRET_ENDING = "token"
SECRET_NAMES = ("auth", "session")

# Genre names as people write them.
GENRE_ALIASES = {
    "Science Fiction": ["sci fi", "scifi", "science fiction"],
    "Comedy": ["comedy", "comedies"],
    "Animation": ["animation", "animated"],
    "Documentary": ["documentary", "documentaries"],
    "Romance": ["romance", "romantic"],
}
FUZZY_RATIO = 0.8

# Provider prices: token limit, tariffs in USD per million tokens, cache retention names.
MAX_PRICED_INPUT = 272_000
STANDARD_RETENTION, LONG_RETENTION = "30m", "12h"
