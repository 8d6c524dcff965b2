"""Regular expressions and word lists of the issue and business signals."""

# Severity patterns per level, in the order ties are decided.
SEVERITY_PATTERNS = {
    "critical": (
        r"\b(crash|crashes|crashing|frozen|freeze|freezes|not working|broken|unusable|lost.*data|data.*lost)\b",
        r"\b(can't.*open|won't.*start|completely.*broken|totally.*broken|doesn't.*work)\b",
        r"\b(refund|money.*back|fraud|scam|charged.*twice|unauthorized.*charge)\b",
    ),
    "severe": (
        r"\b(slow|lag|laggy|sluggish|battery.*drain|overheating|hot|very.*slow)\b",
        r"\b(bug|bugs|error|errors|glitch|glitches|problem|problems|issue|issues)\b",
        r"\b(annoying|frustrating|terrible|awful|hate.*it|worst.*app)\b",
    ),
    "minor": (
        r"\b(could.*be.*better|minor.*issue|small.*problem|slightly.*slow)\b",
        r"\b(would.*like|suggestion|feature.*request|improvement)\b",
    ),
}

# Issue flag patterns.
FLAG_PATTERNS = {
    "fraud_related": (
        r"\b(fraud|scam|scammer|fake|steal|stolen|unauthorized|illegal)\b",
        r"\b(suspicious.*activity|account.*hacked|identity.*theft)\b",
        r"\b(phishing|malware|virus|security.*breach)\b",
    ),
    "money_related": (
        r"\b(money|payment|pay|paid|charge|charged|bill|billing|refund|cost|price|expensive)\b",
        r"\b(credit.*card|debit.*card|transaction|purchase|buy|bought|subscription)\b",
        r"\b(\$\d+|\d+.*dollar|dollar.*\d+|free.*trial|premium|upgrade)\b",
    ),
    "update_related": (
        r"\b(update|updated|version|new.*version|latest.*version|upgrade|upgraded)\b",
        r"\b(after.*update|since.*update|new.*update|recent.*update)\b",
        r"\b(broke.*after|broken.*since|worse.*after|stopped.*working.*after)\b",
    ),
}

# Complaint theme tags.
COMPLAINT_TAGS = {
    "performance": r"\b(slow|lag|performance|speed|fast|quick)\b",
    "crashes": r"\b(crash|freeze|stuck|hang|quit)\b",
    "interface": r"\b(ui|interface|design|layout|button|menu)\b",
    "features": r"\b(feature|function|option|setting|tool)\b",
    "bugs": r"\b(bug|error|glitch|problem|issue)\b",
    "ads": r"\b(ad|ads|advertisement|banner|popup)\b",
    "payment": r"\b(pay|payment|charge|bill|money|cost|price)\b",
    "login": r"\b(login|log.*in|sign.*in|account|password)\b",
}

# Revenue risk, churn and advocacy patterns.
REVENUE_RISK = {
    "high": (
        "(cancel|uninstall|delete|refund|money back|subscription.*cancel)",
        "(switching to|using.*instead|found better|competitor)",
    ),
    "medium": (
        "(disappointed|waste.*money|not worth|regret|mistake)",
        "(considering.*cancel|thinking.*leaving|might.*switch)",
    ),
    "low": ("(price.*high|expensive|cost.*much|subscription.*expensive)",),
}
CHURN = (
    "(leaving|quit|done with|final.*time|last.*chance)",
    "(uninstalling|deleted|removed|bye|goodbye)",
    "(never.*again|worst.*ever|completely.*useless)",
)
ADVOCACY = (
    "(recommend|tell.*friends|share.*with|suggest.*to)",
    "(love.*app|best.*app|amazing|incredible|perfect)",
    "(must.*have|essential|can't.*live.*without)",
)

# Emotion patterns.
EMOTIONS = {
    "frustration": (
        "(frustrated|annoying|irritating|infuriating|fed up)",
        "(waste.*time|sick of|can't stand|driving.*crazy)",
    ),
    "excitement": (
        "(excited|thrilled|amazed|blown away|incredible)",
        "(game changer|revolutionary|mind blowing|outstanding)",
    ),
    "disappointment": (
        "(disappointed|let down|expected more|underwhelming)",
        "(not what.*hoped|thought.*better|hoped for more)",
    ),
    "satisfaction": (
        "(satisfied|pleased|happy|content|fulfilled)",
        "(exactly what|perfect|just right|exceeded.*expectations)",
    ),
    "anger": (
        "(angry|furious|mad|outraged|livid)",
        "(hate|despise|terrible|awful|worst ever)",
    ),
    "delight": (
        "(delighted|overjoyed|ecstatic|love love|adore)",
        "(fantastic|wonderful|brilliant|superb|excellent)",
    ),
}

# Competitors by category and the mention templates.
COMPETITORS = {
    "social_media": ("instagram", "facebook", "twitter", "tiktok", "snapchat"),
    "messaging": ("whatsapp", "telegram", "signal", "discord"),
    "productivity": ("notion", "slack", "teams", "zoom", "asana"),
    "entertainment": ("netflix", "spotify", "youtube", "twitch"),
}
MENTION_TEMPLATES = (
    "(better than {app}|{app} is better|compared to {app})",
    "(like {app}|similar to {app}|reminds me of {app})",
    "(switch to {app}|moving to {app}|prefer {app})",
)

# Comparison type by words, first match wins.
COMPARISON_TYPES = (
    ("competitor_advantage", ("better", "superior", "prefer")),
    ("our_advantage", ("worse", "not as good", "inferior")),
    ("feature_comparison", ("like", "similar", "reminds")),
    ("churn_signal", ("switch", "moving", "leaving")),
)

# Pain point with suggested solution -> (pattern, last group).
SOLUTION_PATTERNS = (
    (r"(.+?)(problem|issue|trouble).+?(should|need|want|fix|add|implement)(.+?)(?:[.!?]|$)", 4),
    (r"(.+?)(doesn't work|broken|fails).+?(if.*could|would be better|suggest)(.+?)(?:[.!?]|$)", 4),
    (r"(wish|hope|if only).+?(had|could|would)(.+?)(?:[.!?]|$)", 3),
)

# Urgency by words, first match wins.
URGENCY_WORDS = (
    ("critical", ("urgent", "immediate", "asap", "critical", "emergency")),
    ("high", ("important", "serious", "soon", "really need")),
    ("medium", ("would like", "hope", "suggestion", "nice to have")),
)

# Aspects and their keywords.
ASPECTS = {
    "user_interface": ("ui", "interface", "design", "layout", "look", "appearance"),
    "performance": ("speed", "fast", "slow", "lag", "performance", "responsive"),
    "features": ("feature", "function", "capability", "tool", "option"),
    "customer_support": ("support", "help", "customer service", "assistance"),
    "pricing": ("price", "cost", "expensive", "cheap", "subscription", "premium"),
    "reliability": ("reliable", "stable", "crash", "bug", "error", "work"),
}
