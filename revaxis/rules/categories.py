"""Classification rules: the default set and the per-app-type sets."""

from .model import category, merge_rules

# Default categories, their keywords, subcategory terms, alert
# thresholds and score multipliers. Order decides the first match.
DEFAULT_RULES = (
    category(
        "ux_issues", "UX Issues", 0.15, 0.8,
        ("ui", "interface", "design", "layout", "confusing", "hard to use", "difficult", "navigate", "menu"),
        ui_issues=("interface", "design", "layout", "ugly", "bad design", "looks bad", "visual"),
        navigation_issues=("navigate", "menu", "find", "lost", "confusing navigation", "hard to find"),
        flow_issues=("confusing", "difficult", "complicated", "hard to use", "user flow", "process"),
        feedback_issues=("feedback", "response", "notification", "alert", "confirmation"),
    ),
    category(
        "feature_requests", "Feature Requests", 0.1, 0.6,
        ("need", "want", "add", "feature", "would like", "should have", "missing", "wish", "hope"),
        dark_mode=("dark mode", "dark theme", "night mode", "black theme"),
        notifications=("notification", "alert", "remind", "push", "notify"),
        customization=("customize", "personal", "settings", "preferences", "options"),
        search=("search", "find", "filter", "lookup", "query"),
        sharing=("share", "export", "send", "social", "facebook", "twitter"),
        offline=("offline", "internet", "connection", "wifi", "data"),
        widgets=("widget", "home screen", "launcher", "shortcut"),
        integration=("integrate", "connect", "sync", "link", "import"),
        backup=("backup", "restore", "save", "export data", "sync"),
    ),
    category(
        "critical_complaints", "Critical Complaints", 0.02, 2.0,
        ("scam", "fraud", "fake", "steal", "money", "charge", "billing", "refund", "security", "hack"),
        fraud_scam=("scam", "fraud", "fraudulent", "cheat", "deceive", "steal money", "fake charges"),
        fake_profiles=("fake profile", "bot", "spam account", "artificial", "not real", "fake user"),
        security_issues=("hack", "security", "password", "breach", "stolen", "compromised", "unsafe"),
        money_issues=("charge", "billing", "refund", "money", "payment", "subscription", "unauthorized"),
        data_loss=("lost data", "deleted", "disappeared", "missing", "corrupted", "gone"),
        malware_virus=("virus", "malware", "trojan", "spyware", "malicious", "infected"),
    ),
    category(
        "tech_issues", "Technical Issues", 0.1, 1.2,
        ("crash", "bug", "error", "freeze", "slow", "lag", "glitch", "broken", "not working"),
        crashes=("crash", "crashed", "crashing", "force close", "shuts down", "stops working"),
        bugs=("bug", "glitch", "error", "issue", "problem", "broken"),
        freezes=("freeze", "frozen", "hang", "stuck", "unresponsive", "not responding"),
        performance_errors=("slow", "lag", "sluggish", "performance", "speed", "loading"),
        login_errors=("login", "sign in", "authentication", "password", "account"),
        sync_errors=("sync", "synchronize", "update", "refresh", "connection"),
    ),
    category(
        "battery_drain", "Battery & Performance", 0.08, 0.9,
        ("battery", "drain", "power", "cpu", "memory", "ram", "storage", "space"),
        battery_drain=("battery", "drain", "power", "dies fast", "battery life"),
        memory_issues=("memory", "ram", "storage", "space", "full", "low storage"),
        cpu_usage=("cpu", "processor", "hot", "heating", "warm", "performance"),
    ),
    category(
        "ads_spam", "Ads & Spam", 0.12, 0.7,
        ("ads", "advertisement", "spam", "pop up", "banner", "commercial", "promotion"),
        excessive_ads=("too many ads", "ad spam", "advertisement", "pop up", "banner"),
        intrusive_ads=("intrusive", "annoying ads", "full screen", "can't close", "forced ads"),
        spam_content=("spam", "junk", "unwanted", "irrelevant", "promotional"),
    ),
)

# Extra categories per app type.
APP_TYPE_RULES = {
    "social_media": (
        category(
            "privacy_concerns", "Privacy Concerns", 0.08, 1.5,
            ("privacy", "data", "tracking", "personal information", "share data"),
            data_tracking=("tracking", "data collection", "personal data", "privacy policy"),
            unwanted_sharing=("share without permission", "public profile", "data sharing"),
            account_security=("account hacked", "security breach", "unauthorized access"),
        ),
        category(
            "content_moderation", "Content Issues", 0.1, 1.3,
            ("inappropriate", "spam", "harassment", "bullying", "fake news"),
            harassment=("bullying", "harassment", "abuse", "toxic", "hate"),
            spam_content=("spam", "fake posts", "bot accounts", "irrelevant content"),
            inappropriate_content=("inappropriate", "offensive", "explicit", "disturbing"),
        ),
    ),
    "ecommerce": (
        category(
            "payment_issues", "Payment Problems", 0.05, 2.0,
            ("payment", "checkout", "credit card", "billing", "refund", "transaction"),
            payment_failures=("payment failed", "transaction error", "card declined"),
            billing_issues=("wrong charge", "duplicate charge", "billing error"),
            refund_problems=("refund denied", "no refund", "refund process"),
        ),
        category(
            "delivery_issues", "Delivery & Shipping", 0.12, 1.4,
            ("delivery", "shipping", "order", "tracking", "delayed", "lost package"),
            delayed_delivery=("late delivery", "delayed", "slow shipping"),
            lost_packages=("lost package", "not delivered", "missing order"),
            tracking_issues=("tracking not working", "no tracking", "tracking error"),
        ),
    ),
    "productivity": (
        category(
            "data_sync", "Data Synchronization", 0.08, 1.6,
            ("sync", "backup", "cloud", "data loss", "synchronization"),
            sync_failures=("sync failed", "not syncing", "sync error"),
            data_loss=("lost data", "data disappeared", "backup failed"),
            cloud_issues=("cloud not working", "cloud sync", "cloud storage"),
        ),
        category(
            "collaboration", "Collaboration Features", 0.1, 1.2,
            ("share", "collaborate", "team", "permissions", "access"),
            sharing_issues=("can't share", "sharing not working", "share failed"),
            permission_problems=("no access", "permission denied", "can't edit"),
            team_features=("team features", "collaboration", "group work"),
        ),
    ),
    "gaming": (
        category(
            "gameplay_issues", "Gameplay Problems", 0.15, 1.1,
            ("lag", "controls", "gameplay", "levels", "difficulty", "mechanics"),
            control_issues=("controls", "touch response", "input lag", "unresponsive"),
            level_issues=("level broken", "can't progress", "stuck on level"),
            game_mechanics=("unfair", "balance issues", "game mechanics", "difficulty"),
        ),
        category(
            "monetization", "In-App Purchases", 0.12, 1.0,
            ("pay to win", "expensive", "microtransactions", "purchase", "ads"),
            pay_to_win=("pay to win", "unfair advantage", "premium features"),
            expensive_items=("too expensive", "overpriced", "cost too much"),
            forced_purchases=("forced to buy", "can't progress without paying"),
        ),
    ),
}


def rules_for(app_type: str | None = None, custom=()):
    """Rules of one analysis: defaults, then the app type's, then the caller's own."""
    if app_type is not None and app_type not in APP_TYPE_RULES:
        raise ValueError(f"unknown app_type {app_type!r}; known: {sorted(APP_TYPE_RULES)}")
    return merge_rules(DEFAULT_RULES, APP_TYPE_RULES.get(app_type, ()), custom)
