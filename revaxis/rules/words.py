"""Word lists used by the text, sentiment and classification functions."""

# Stopwords used when the caller gives no list of their own.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "this", "that", "these", "those", "i", "you", "he", "she",
    "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
)

# Sentiment words of the keyword boost.
POSITIVE_WORDS = (
    "excellent", "amazing", "great", "love", "perfect", "awesome", "fantastic", "brilliant", "wonderful",
    "outstanding", "superb", "incredible", "good", "nice", "helpful", "useful", "easy", "simple", "fast",
    "quick", "smooth", "reliable", "stable", "clean", "beautiful",
)
NEGATIVE_WORDS = (
    "terrible", "awful", "horrible", "hate", "worst", "bad", "poor", "useless", "broken", "annoying",
    "frustrating", "disappointing", "slow", "laggy", "buggy", "crash", "freeze", "confusing", "difficult",
    "hard", "complicated", "ugly", "outdated", "spam", "ads",
)

# Negators and intensity words of the published VADER method
# (a negator within three tokens scales a word's weight, an intensity word shifts it).
NEGATORS = (
    "not", "no", "never", "none", "nothing", "nowhere", "neither", "nor", "cannot", "cant", "can't", "dont",
    "don't", "doesnt", "doesn't", "didnt", "didn't", "isnt", "isn't", "wasnt", "wasn't", "wont", "won't",
    "without", "hardly", "rarely",
)
BOOSTERS = ("very", "really", "so", "extremely", "absolutely", "completely", "totally", "incredibly")
DAMPENERS = ("slightly", "somewhat", "barely", "partly", "kinda", "almost", "occasionally")

# Words that mark a general feature request.
REQUEST_INDICATORS = (
    "wish", "want", "need", "should add", "would be nice", "please add", "hope", "request", "suggest",
    "could you", "feature request",
)

# General terms of phrase highlighting.
HIGHLIGHT_TERMS = ("need", "want", "add", "feature", "would like", "should have", "missing", "wish", "hope")

# Words that make a sentence a complaint highlight.
NEGATIVE_INDICATORS = (
    "terrible", "awful", "horrible", "worst", "hate", "broken", "useless", "doesn't work", "not working",
    "can't", "won't", "never", "always", "frustrated", "disappointed", "angry", "annoyed",
)

# Phrases never reported as key phrases.
GENERIC_PHRASES = ("app", "good", "bad", "nice")
