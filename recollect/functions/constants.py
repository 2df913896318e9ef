"""Fixed values of the data model and the ranking."""

# Words that neither queries nor hashed vectors use.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "its", "that", "this", "why",
    "what", "how", "does", "do", "did", "when", "which", "who", "whom", "there", "then", "than", "so", "as", "at", "by", "from", "into", "instead", "rather",
    "not", "no", "any", "ever", "still", "just", "also", "would", "could", "should", "can", "will", "happened", "happens", "used", "use", "we", "our", "i", "you",
]
# Weights of the legs and of the tiers, floors and windows.
LEG_WEIGHTS = {"text": 1.0, "trigram": 0.5, "vector": 0.5}
RRF_K = 60
TIERS = ["short", "mid", "long"]
TIER_BOOST = {"short": 1.0, "mid": 1.1, "long": 1.25}
OUTCOMES = ["provisional", "confirmed", "rejected", "unused", "self"]
TRIGRAM_FLOOR = 0.35
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
IDLE_DAYS = {"short": 30, "mid": 90, "long": 180}
CREDIT_WINDOW_DAYS = 90
