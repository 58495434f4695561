"""Values that decide results: word lists, thresholds, sizes and reply formats."""

# Spam lexicon. Matched as whole tokens and as substrings.
SPAM_WORDS = [
    "free", "win", "winner", "prize", "money", "cash", "credit", "buy",
    "discount", "offer", "limited", "deal", "cheap", "guarantee", "earn",
    "income", "profit", "investment", "roi", "return", "dollars", "euros",
    "crypto", "bitcoin", "btc", "eth", "ethereum", "token", "ico", "mining",
    "wallet", "blockchain", "altcoin", "binance", "coinbase", "exchange",
    "click", "subscribe", "link", "join", "urgent", "now", "amazing",
    "opportunity", "exclusive", "limited time", "act now", "don't miss",
    "best", "incredible", "revolutionary", "breakthrough", "miracle",
    "call", "contact", "email", "phone", "visit", "website", "dm", "pm",
    "message", "telegram", "whatsapp", "signal", "follow", "signup",
    "bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co", "is.gd",
]

# Friendly phrases that clear a short comment.
WHITELIST_PHRASES = [
    "great video", "thanks for sharing", "love this", "awesome content",
    "well done", "thank you", "good job", "nice video", "interesting",
    "learned a lot", "helpful", "subscribed", "keep it up", "looking forward",
    "appreciate", "informative", "enjoyed", "fantastic", "excellent",
]

# Stop words of the keyword reports.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i",
    "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
]

# English stop words of the term weights, Spark ML's list in its order.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've",
    "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's",
    "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]

# Spam decision policy.
SPAM_FLAG_ABOVE = 0.85          # is_spam needs a probability above this
RULE_FLAG_ABOVE = 0.75          # ... or above this together with the indicators
RULE_MIN_INDICATORS = 4
SHORT_TEXT_CHARS = 20           # shorter texts are never flagged
SHORT_TEXT_WORDS = 5
WHITELIST_MAX_CHARS = 100
WHITELIST_SCORE, WHITELIST_CONFIDENCE = 0.1, 0.9
UNTRAINED_SCORE = 0.5

# Content class thresholds (inclusive) and sentiment cut (exclusive).
CLASS_SPAM, CLASS_TOXIC = 0.85, 0.8
CLASS_QUESTIONABLE_TOXICITY, CLASS_QUESTIONABLE_SPAM = 0.5, 0.6
SENTIMENT_CUT = 0.05
TOXICITY_CONCERN_ABOVE = 0.3
DISPLAY_ALERT_ABOVE = 0.5

# Report and job sizes.
TOP_KEYWORDS = 10
TOP_COMMENTERS = 5
SAMPLE_ROWS = 5
TEXT_HEAD = 100
PAGE_SIZE = 50
MODERATION_BATCH = 10
RETRAIN_AFTER = 10
HISTORY_DAYS = 30
FOREST_TREES, FOREST_SEED, FOREST_MIN_LEAF = 100, 42, 2
MAX_TERMS, MIN_DOC_FREQ = 1000, 2
TOP_FEATURES_MODEL, TOP_FEATURES_VIDEO = 5, 10

# Defaults of absent API fields.
UNKNOWN_AUTHOR = "Unknown"
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_CHANNEL = "Unknown Channel"

# Output format of the reports. Sections in order with their scalar columns (those without any are filled
# by lists), what an empty section says, and the lines of a sample comment with their columns.
REPORT_SECTIONS = {
    "Overview": ["total_comments", "unique_authors"],
    "Classification Breakdown": [],
    "Moderation Actions": [],
    "Engagement Metrics": ["total_comments", "responded_comments", "response_rate", "unique_authors"],
    "Time Analysis": ["first_comment", "last_comment", "avg_hours_between", "most_active_hour"],
    "Top Commenters": [],
    "Keyword Analysis": ["total_word_count", "avg_words_per_comment"],
    "Emotional Analysis": ["avg_emotional_score", "max_emotional_score", "min_emotional_score",
                           "positive", "neutral", "negative"],
}
REPORT_NO_DATA = "No data available"
REPORT_TITLE, REPORT_TIME, REPORT_SAMPLES = "# Comment Analysis Summary", "Generated on: ", "## Sample Comments"
SAMPLE_LINES = {
    "author": "- Author: ", "classification": "  Classification: ", "mod_action": "  Action: ",
    "emotional_score": "  Emotional Score: ", "text": "  Text: ",
}
