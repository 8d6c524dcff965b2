"""Theme dictionaries: critical themes, segments, praise and complaints, theme names."""

# Critical negative themes -> (keywords, phrases).
CRITICAL_THEMES = {
    "Crashes & Bugs": (
        ("crash", "bug", "freeze", "hang", "broken", "error", "glitch", "stops working"),
        (
            "app crashes", "keeps crashing", "always crashes", "crashes constantly", "frozen screen",
            "app freezes", "stops responding", "not working", "broken feature", "major bug", "full of bugs",
            "buggy app",
        ),
    ),
    "Performance Issues": (
        ("slow", "lag", "loading", "timeout", "delayed", "stuck", "wait"),
        (
            "very slow", "too slow", "slow loading", "takes forever", "lag issues", "laggy app",
            "performance issues", "slow response", "stuck loading", "timeout error", "loading problems",
        ),
    ),
    "Login & Account Problems": (
        ("login", "password", "account", "authentication", "sign in", "verification"),
        (
            "cannot login", "login failed", "password not working", "login issues", "account locked",
            "verification problems", "sign in error", "authentication failed", "login not working",
        ),
    ),
    "Payment & Billing Issues": (
        ("payment", "billing", "charge", "money", "refund", "subscription", "premium"),
        (
            "billing problems", "wrong charge", "payment failed", "money issues", "refund request",
            "unwanted charges", "billing error", "payment not working", "subscription issues",
            "premium not working",
        ),
    ),
    "User Interface Problems": (
        ("confusing", "difficult", "hard to use", "navigation", "interface", "design"),
        (
            "confusing interface", "hard to navigate", "poor design", "bad UI", "difficult to use",
            "navigation problems", "interface issues", "unclear layout", "design problems",
        ),
    ),
    "Fake Profiles & Scams": (
        ("fake", "scam", "fraud", "catfish", "bot", "spam"),
        (
            "fake profiles", "too many fakes", "scam app", "fraudulent", "fake users", "catfish profiles",
            "spam messages", "bot accounts", "fake photos", "scammer alert",
        ),
    ),
    "Poor Customer Support": (
        ("support", "help", "customer service", "response", "contact"),
        (
            "no response", "poor support", "customer service issues", "no help", "support not helpful",
            "cannot contact", "no customer service", "support problems", "unresponsive support",
        ),
    ),
}

# Critical themes summed up as technical.
TECH_THEMES = ("Crashes & Bugs", "Performance Issues", "Login & Account Problems")

# Segmentation theme -> (name, {subcategory: terms}).
SEGMENT_THEMES = {
    "ux_issues": ("User Experience Issues", {
        "navigation": ("navigation", "navigate", "menu", "find", "lost", "confusing layout", "hard to find"),
        "interface": ("ui", "interface", "design", "layout", "buttons", "screen", "display"),
        "usability": ("usability", "user friendly", "easy to use", "difficult", "complicated", "intuitive"),
        "accessibility": ("accessibility", "font size", "contrast", "readable", "hard to see", "small text"),
        "flow": ("workflow", "process", "steps", "flow", "sequence", "order"),
    }),
    "tech_issues": ("Technical Issues", {
        "crashes": ("crash", "crashes", "crashed", "force close", "shuts down", "stops working"),
        "bugs": ("bug", "bugs", "glitch", "error", "broken", "not working"),
        "performance": ("slow", "lag", "laggy", "freeze", "frozen", "loading", "performance"),
        "compatibility": ("compatibility", "device", "version", "android", "ios", "phone"),
        "connectivity": ("connection", "network", "internet", "wifi", "offline", "sync"),
    }),
    "critical_negative": ("Critical Negative Complaints", {
        "fraud_scam": ("fraud", "scam", "fake", "cheat", "steal", "money stolen", "unauthorized"),
        "security": ("security", "privacy", "data breach", "hacked", "unsafe", "personal info"),
        "trust_issues": ("trust", "reliable", "dishonest", "misleading", "false advertising"),
        "data_loss": ("lost data", "deleted", "missing", "gone", "disappeared", "backup failed"),
        "billing": ("charged", "billing", "refund", "money", "payment", "subscription"),
    }),
    "positive_features": ("Praised Features", {
        "design": ("beautiful", "clean design", "attractive", "nice interface", "well designed"),
        "functionality": ("works well", "smooth", "fast", "efficient", "reliable", "stable"),
        "features": ("love this feature", "amazing", "awesome", "perfect", "exactly what i needed"),
        "ease_of_use": ("easy to use", "simple", "intuitive", "user friendly", "straightforward"),
    }),
    "feature_requests": ("Feature Requests", {
        "missing_features": ("wish", "need", "would like", "please add", "missing", "lack"),
        "improvements": ("improve", "better", "enhance", "upgrade", "update"),
        "customization": ("customize", "personalize", "settings", "options", "configure"),
        "integrations": ("integrate", "sync with", "connect to", "import", "export"),
    }),
}

# Segments whose examples are listed best rating first.
BEST_FIRST_SEGMENTS = ("positive_features", "feature_requests")

# Praise themes -> (name, multiplier, keywords).
PRAISE_THEMES = {
    "design_praise": ("Design & Interface Praise", 1.0, (
        "beautiful", "gorgeous", "stunning", "elegant", "clean design", "nice interface", "great ui",
        "looks good", "visually appealing", "attractive", "polished", "sleek",
    )),
    "functionality_praise": ("Functionality Appreciation", 1.2, (
        "works perfectly", "functions well", "reliable", "stable", "smooth", "efficient", "fast", "quick",
        "responsive", "seamless", "flawless", "consistent",
    )),
    "feature_love": ("Feature Appreciation", 1.1, (
        "love this feature", "amazing feature", "great feature", "useful feature", "helpful feature",
        "convenient", "powerful", "innovative", "brilliant",
    )),
    "ease_of_use": ("Ease of Use", 1.0, (
        "easy to use", "simple", "intuitive", "user friendly", "straightforward", "clear", "logical",
        "makes sense", "no confusion", "obvious",
    )),
    "performance_praise": ("Performance Excellence", 1.3, (
        "fast loading", "quick response", "no lag", "smooth performance", "optimized", "lightning fast",
        "instant", "speedy", "no delays", "snappy",
    )),
    "overall_satisfaction": ("Overall Satisfaction", 1.0, (
        "love it", "perfect", "excellent", "outstanding", "amazing", "fantastic", "wonderful", "great app",
        "best app", "highly recommend", "satisfied", "happy",
    )),
}

# Complaint themes -> (name, multiplier, keywords).
COMPLAINT_THEMES = {
    "usability_issues": ("Usability Problems", 1.2, (
        "confusing", "complicated", "hard to use", "difficult", "not intuitive", "unclear", "messy interface",
        "poor design", "bad ui", "hard to navigate",
    )),
    "performance_issues": ("Performance Problems", 1.5, (
        "slow", "laggy", "crashes", "freezes", "hangs", "unresponsive", "buggy", "glitchy", "not working",
        "broken", "unstable", "poor performance",
    )),
    "feature_complaints": ("Feature Complaints", 1.1, (
        "missing feature", "lacks", "doesnt have", "no option", "limited", "restricted", "basic", "primitive",
        "outdated", "behind competition", "feature poor",
    )),
    "functionality_issues": ("Functionality Problems", 1.4, (
        "not working", "broken", "fails", "error", "bug", "issue", "problem", "malfunction", "doesnt work",
        "stopped working", "unreliable",
    )),
    "design_complaints": ("Design & Interface Issues", 1.0, (
        "ugly", "bad design", "poor layout", "messy", "cluttered", "outdated design", "horrible interface",
        "looks bad", "unattractive", "unprofessional",
    )),
    "overall_dissatisfaction": ("Overall Dissatisfaction", 1.3, (
        "hate it", "terrible", "awful", "worst", "horrible", "disgusting", "disappointed", "regret", "waste",
        "uninstalling", "never again",
    )),
}

# Keyword clusters of complaints, first match wins.
COMPLAINT_CLUSTERS = {
    "Payment & Billing Problems": (
        "payment", "billing", "charge", "charged", "refund", "money", "cost", "price", "subscription", "cancel",
        "credit card", "paypal", "transaction", "purchase", "buy", "paid", "expensive", "free trial",
    ),
    "Login & Account Issues": (
        "login", "log in", "sign in", "signin", "account", "password", "username", "forgot password",
        "locked out", "can't access", "verification", "authenticate", "register", "signup",
    ),
    "App Crashes & Freezing": (
        "crash", "crashes", "freeze", "frozen", "hang", "stuck", "not responding", "closes", "shuts down",
        "stops working", "black screen",
    ),
    "Slow Performance": (
        "slow", "lag", "laggy", "loading", "performance", "speed", "responsive", "takes forever", "long time",
        "waiting",
    ),
    "Technical Bugs & Errors": (
        "bug", "error", "glitch", "broken", "not working", "doesn't work", "malfunction", "issue", "problem",
        "fail", "failed", "wrong",
    ),
    "User Interface Problems": (
        "interface", "ui", "design", "layout", "confusing", "hard to use", "navigation", "menu", "button",
        "click", "tap", "screen", "display",
    ),
    "Missing Features": (
        "feature", "add", "need", "want", "wish", "should have", "missing", "improvement", "better", "enhance",
        "update", "would like",
    ),
    "Customer Support Issues": (
        "support", "help", "service", "customer", "response", "reply", "contact", "assistance", "staff", "team",
        "representative", "no response",
    ),
    "Scam & Fraud Reports": (
        "scam", "fraud", "fake", "spam", "suspicious", "cheat", "steal", "money back", "rip off", "dishonest",
        "misleading",
    ),
}

# Fixed value: the name of what no theme names.
GENERAL_COMPLAINTS = "General Complaints"

# Theme names scored by occurrence counts over a cluster.
THEME_NAME_TERMS = {
    "Payment Failures": ("payment", "pay", "charge", "billing", "refund", "money"),
    "Login Problems": ("login", "sign in", "account", "password", "access"),
    "App Crashes": ("crash", "freeze", "hang", "stop", "close", "shut"),
    "Slow Performance": ("slow", "lag", "loading", "speed", "fast"),
    "Scam Reports": ("scam", "fraud", "fake", "spam", "cheat", "steal"),
    "Technical Bugs": ("bug", "error", "glitch", "broken", "not work"),
    "UI/UX Issues": ("confusing", "hard", "difficult", "interface", "design"),
    "Missing Features": ("need", "want", "add", "missing", "should have"),
    "Customer Service": ("support", "help", "service", "response", "contact"),
    "Data Loss": ("lost", "delete", "missing", "gone", "disappear"),
    "Subscription Issues": ("subscription", "cancel", "trial", "auto", "renew"),
    "Update Problems": ("update", "version", "new", "change", "different"),
}

# Second theme naming -> (weight, terms).
WEIGHTED_THEME_TERMS = {
    "Payment & Billing Issues": (1.5, (
        "payment", "pay", "charge", "billing", "refund", "money", "cost", "price", "transaction", "credit card",
    )),
    "Fraudulent Activity Reports": (2.0, (
        "scam", "fraud", "fake", "spam", "cheat", "steal", "suspicious", "illegal", "unauthorized",
    )),
    "Login & Authentication": (1.3, (
        "login", "sign in", "account", "password", "access", "verification", "authenticate", "locked",
    )),
    "App Performance Issues": (1.4, (
        "crash", "freeze", "hang", "stop", "close", "shut", "slow", "lag", "loading", "performance",
    )),
    "Technical Errors & Bugs": (1.2, (
        "bug", "error", "glitch", "broken", "not work", "malfunction", "issue", "problem",
    )),
    "User Experience Problems": (1.0, (
        "confusing", "hard", "difficult", "interface", "design", "navigation", "usability",
    )),
    "Feature Requests": (0.8, ("need", "want", "add", "missing", "should have", "improvement", "better", "enhance")),
    "Customer Support Issues": (1.1, (
        "support", "help", "service", "response", "contact", "customer service", "no response",
    )),
    "Data & Privacy Concerns": (1.3, (
        "lost", "delete", "missing", "gone", "disappear", "privacy", "data", "security",
    )),
    "Subscription & Account": (1.0, ("subscription", "cancel", "trial", "auto", "renew", "billing cycle", "premium")),
    "Update & Compatibility": (0.9, ("update", "version", "new", "change", "different", "compatibility", "device")),
}

# Phrase pattern -> theme name, first match wins.
PHRASE_THEMES = (
    ("payment|pay|charge|billing|refund|money|transaction", "Payment & Billing Issues"),
    ("credit card|paypal|bank", "Payment & Billing Issues"),
    ("scam|fraud|fake|cheat|steal|suspicious", "Fraudulent Activity Reports"),
    ("money back|rip off|dishonest", "Fraudulent Activity Reports"),
    ("app crash|keeps crash|always crash|freeze|hang", "App Performance Issues"),
    ("slow|lag|loading|performance|speed", "App Performance Issues"),
    ("login|sign in|account|password|access|verification", "Login & Authentication"),
    ("locked out|cannot access|forgot password", "Login & Authentication"),
    ("bug|error|glitch|broken|not work|malfunction", "Technical Errors & Bugs"),
    ("doesn work|stops working|not working", "Technical Errors & Bugs"),
    ("confusing|hard use|difficult|interface|design", "User Experience Problems"),
    ("navigation|menu|button|layout", "User Experience Problems"),
    ("customer|support|help|service|response|contact", "Customer Support Issues"),
    ("no response|poor support|unresponsive", "Customer Support Issues"),
    ("missing|need|want|add|should have|improvement", "Feature Requests"),
    ("better|enhance|update needed|would like", "Feature Requests"),
)

# Cluster label by words of the top phrase, first match wins.
CLUSTER_LABELS = (
    ("Technical Issues", ("crash", "bug", "error", "freeze")),
    ("Payment & Billing", ("payment", "billing", "charge", "money")),
    ("Login & Account", ("login", "account", "password")),
    ("Performance Issues", ("slow", "loading", "performance")),
)
