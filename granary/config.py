"""Settings of the engine. The values that equal the reference's are fixed values, stated as text."""

from __future__ import annotations

#: Companies in order, with the names that stand for them in headlines and questions.
COMPANIES = {
    "NVDA": ["nvidia", "nvda"],
    "MSFT": ["microsoft", "msft"],
    "JPM": ["jpmorgan", "jp morgan", "jpmorgan chase", "jpm"],
}
#: Topics of headlines, first match wins.
TOPICS = {
    "earnings": ["earnings", "quarterly results", "beats", "misses", "revenue", "eps", "guidance"],
    "product": ["launch", "unveil", "announce", "release", "chip", "gpu", "model", "platform"],
    "regulatory": ["sec ", "antitrust", "regulator", "probe", "investigation", "lawsuit", "fine"],
    "analyst": ["price target", "upgrade", "downgrade", "analyst", "rating", "prediction", "forecast", "valuation"],
    "deal": ["acquisition", "acquire", "merger", "partnership", "stake in", "buyout", "joint venture"],
    "macro": ["tariff", "export", "china", "fed", "rates", "inflation"],
}
#: Words that the sparse index leaves out.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "at", "by", "with", "as", "is", "are", "was", "were",
    "be", "been", "being", "that", "this", "these", "those", "it", "its", "from", "we", "our", "us", "which", "such",
    "may", "will", "would", "could", "should", "has", "have", "had", "do", "does", "did", "but",
]
#: Host of redirecting links, widths and constants of retrieval, ranking and chunking.
REDIRECT_HOST = "news.google.com"
DENSE_TOP, SPARSE_TOP, RRF_K, FINAL_TOP = 30, 30, 60, 6
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
TARGET_TOKENS, OVERLAP_TOKENS = 480, 80
DUPLICATE_SIMILARITY, EVENT_SIMILARITY = 0.90, 0.75
MAX_PER_FEED, LOOKBACK_DAYS = 60, 7
MIN_COVERAGE, MIN_OVERLAP = 0.8, 0.5
