"""Reviews derived from the ``events`` and ``documents`` tables, in Spark and in SQL.

The tables hold no app reviews, so every event becomes one: its keys, rating, votes and
time come from the event's columns and its text from a bank of sentences picked by the
event id. A third of the users belong to one app, so groups are skewed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revaxis.functions.matching import term_array
from revaxis.sources.normalize import normalize_reviews

SENTENCES = (
    "The app keeps crashing after the latest update and I lost data twice",
    "Love this feature, the clean design is beautiful and easy to use. Highly recommend to everyone",
    "Please add dark mode. I really need a night mode option for reading",
    "Worst ever. Total scam, they charged twice and refund never came. I want my money back",
    "Very slow loading and the screen is stuck, terrible performance since the new version",
    "Cannot login, password not working and the account locked message never goes away",
    "Great app! Works perfectly, fast and reliable. Exactly what I needed",
    "Too many ads and spam. The banner is annoying and I can't close the full screen promotion",
    "Confusing interface, hard to navigate the menu and the layout looks bad",
    "Battery drain is awful, my phone gets hot and the memory is always full",
    "I wish it could sync with my calendar and export data to a spreadsheet",
    "Customer service gave no response. Poor support and no help at all",
    "Fake profiles everywhere, bot accounts and a scammer alert every day. Is this fraud?",
    "It is better than instagram and similar to facebook but I prefer telegram",
    "Subscription expensive, considering to cancel. Price is high and not worth it",
    "Amazing and incredible, perfect game changer. Must have, can't live without it",
    "Frustrated and disappointed, waste of time. Uninstalling, goodbye, never again",
    "Good",
    "Nice app but the search needs a filter. Would be nice to have options in settings",
    "The problem is the sync button, you should fix the connection error soon. It is important",
    "Freezes on start, shuts down, not responding. Black screen again and again!",
    "   ",
    "Hidden bug: an error appears when I share photos. Glitch in the export dialog",
    "My payment failed but my credit card was billed 20 dollars. Billing error, urgent!",
    "Update broke after the new version, it was worse after each release and stopped working after that",
    "Security breach? My account hacked and personal info stolen, unauthorized charge on my card",
    "Excellent and wonderful, so smooth and stable. I am happy and satisfied",
    "Offline mode missing, hope they improve the wifi connection and backup restore soon",
    "Not bad but not great. Could be better, a minor issue with the font size and contrast",
    "Contact me at help@example.com or see https://example.com/faq for the solution @support_team",
    "Reminds me of slack, I might switch to notion because teams is better for work",
    "ok",
    "Notifications come late, please add an alert for messages and a home screen widget",
    "The workflow has too many steps and the process is complicated, difficult for my mother",
    "Loved it before, hate it now. Horrible interface, ugly buttons and outdated design",
    "Everything was deleted! My photos disappeared, files corrupted and the backup failed. This is a critical "
    "emergency because I used this app for work every single day and there is no way to restore anything, "
    "the support team is silent and the whole year is gone",
    "Quick response from the team, friendly help and useful tips. Thank you",
    "If only it had a widget it would be perfect for me. Just right otherwise",
    "Signal drops, the network is slow and my device shows a wrong version on android",
    "Simple, intuitive and user friendly. Makes sense from the first minute, no confusion",
    "Virus warning and malware popup after install! Suspicious activity, phishing links inside",
    "It doesn't work on my tablet, suggest a smaller layout if you could. The display is broken",
    "Angry and furious. Mad about the hidden cost, 5 dollar per month for nothing",
)
FOLLOW_UPS = (
    "",
    " Please fix it.",
    " The support team is slow",
    "! I need help with the login screen",
    ". Otherwise a great app, love it",
    ". Keeps crashing, keeps crashing",
    ", tell your friends",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_quoted(item) for item in items) + "]"


KEYS = {"events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread by its key over the session's partitions: the test files hold one row group each.

    The condition holds for all rows. Spark moves no filter below one on row numbers, so what queries
    ask of derived texts is worked out after the rows are spread, not by the few tasks that read
    the files.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in KEYS:
        return found
    spread = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEYS[name])
    return spread.where(F.monotonically_increasing_id() >= 0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw review dump, with the column names such dumps use."""
    block = F.floor(F.col("event_id") / 5).cast("int")

    def pick(bank, index):
        return F.get(term_array(bank), index % len(bank))

    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("reviewId"),
        F.when(F.col("user_id") % 3 == 0, "app0")
        .otherwise(F.concat(F.lit("app"), (F.col("user_id") % 7 + 1).cast("string"))).alias("appId"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("userName"),
        (F.col("event_id") % 5 + 1).cast("int").alias("score"),
        F.concat(
            pick(SENTENCES, block), pick(FOLLOW_UPS, F.floor(block / len(SENTENCES)).cast("int"))
        ).alias("content"),
        F.col("ts").cast("timestamp").alias("at"),
        F.floor(F.col("value") % 40).cast("bigint").alias("thumbsUpCount"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_reviews(raw_reviews(spark, sf_dir))


# The same reviews in SQL; `t` is the lower-cased text.
REVIEWS_SQL = f"""raw AS (
  SELECT CAST(event_id AS VARCHAR) AS review_id,
    CASE WHEN user_id % 3 = 0 THEN 'app0' ELSE 'app' || (user_id % 7 + 1) END AS app_id,
    'user' || user_id AS user_name,
    CAST(event_id % 5 + 1 AS INTEGER) AS rating,
    {_list(SENTENCES)}[CAST((event_id // 5) % {len(SENTENCES)} + 1 AS INTEGER)]
      || {_list(FOLLOW_UPS)}[CAST((event_id // 5 // {len(SENTENCES)}) % {len(FOLLOW_UPS)} + 1 AS INTEGER)] AS review,
    ts AS "at",
    CAST(floor(value % 40) AS BIGINT) AS thumbs_up
  FROM events),
reviews AS (SELECT *, lower(review) AS t FROM raw WHERE length(trim(review)) > 0)"""


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long multilingual reviews; a source is an app."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("source").alias("app_id"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        F.col("text").alias("review"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS app_id,
    CAST(doc_id % 5 + 1 AS INTEGER) AS rating, text AS review FROM documents)"""
