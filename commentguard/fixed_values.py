"""Word lists, tables and patterns that decide results.

Everything here is data.  The values have to be exactly these for a decision
to come out right, so they are stated in one place, in their natural order.
"""

# --- Domains -----------------------------------------------------------------

ACTIONS = ["allow", "flag_for_review", "flag_for_removal"]
CONTEXT_TYPES = ["main_review", "reply_to_review", "reply_to_comment", "topic_feed"]
TARGETS = [
    "movie_show", "acting_direction_script", "actor_public_work", "review_content",
    "reviewer_or_user", "community_identity", "protected_class", "unknown",
]
LABELS_PRIMARY = ["safe", "borderline", "unsafe"]
SEVERITIES = ["none", "low", "medium", "high", "critical"]
SOURCE_TYPES = ["open_source", "screenshot_inspired", "synthetic"]
SPLITS = ["train", "test", "eval"]
REVIEW_STATUSES = ["draft", "reviewed", "approved"]
RATINGS = ["Perfection", "Go For It", "Timepass", "Skip"]

REPLY_CONTEXTS = ["reply_to_review", "reply_to_comment"]
PERSON_OR_GROUP_TARGETS = ["reviewer_or_user", "community_identity", "protected_class"]
CONTENT_TARGETS = ["movie_show", "actor_public_work", "review_content"]
CRAFT_TARGETS = ["movie_show", "acting_direction_script", "actor_public_work", "review_content"]

ENUM_DOMAINS = {
    "context_type": CONTEXT_TYPES,
    "target_detected": TARGETS,
    "moderation_action": ACTIONS,
    "label_primary": LABELS_PRIMARY,
    "severity": SEVERITIES,
    "source_type": SOURCE_TYPES,
    "split": SPLITS,
    "review_status": REVIEW_STATUSES,
}
REQUIRED_FIELDS = [
    "example_id", "scenario_id", "text", "context_type", "target_detected",
    "moderation_action", "label_primary", "labels_multi", "source_type", "split",
    "rationale_short",
]
PROVENANCE_FIELDS = ["source_dataset", "source_url", "source_license"]

# --- Request defaults and limits ---------------------------------------------

REQUEST_DEFAULTS = {
    "context_type": "reply_to_review",
    "parent_review_rating": "Skip",
    "movie_rating_perfection_pct": 90.0,
    "movie_rating_skip_pct": 5.0,
    "model_toxicity_score": None,
}
FEED_CONTEXT = {
    "context_type": "reply_to_comment",
    "parent_review_rating": "Timepass",
    "movie_rating_perfection_pct": 50.0,
    "movie_rating_skip_pct": 20.0,
}
MAX_TEXT_CHARS = 2000
MAX_BATCH_ROWS = 256
CACHE_TTL_SECONDS = 3600
REVIEW_QUEUE_SIZE = 1000
RATE_LIMIT_SINGLE = 60
RATE_LIMIT_BATCH = 10
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

# --- Risk weights, thresholds, toxicity points -------------------------------

WEIGHT_PROFILES = {
    "current": {
        "reply_context_base": 0.4,
        "main_review_base": 0.05,
        "has_mention": 0.3,
        "negative_sentiment": 0.05,
        "toxicity_scale": 0.65,
        "flag_for_review_risk": 0.58,
        "flag_for_review_model": 0.80,
    },
    "v1": {
        "reply_context_base": 0.20,
        "main_review_base": 0.05,
        "has_mention": 0.15,
        "negative_sentiment": 0.15,
        "toxicity_scale": 0.45,
        "flag_for_review_risk": 0.62,
        "flag_for_review_model": 0.82,
    },
}
# A weight that a given table leaves out takes its value from here.
WEIGHT_FALLBACKS = WEIGHT_PROFILES["v1"]
WEIGHT_CLAMPS = {
    "reply_context_base": (0.05, 0.40),
    "has_mention": (0.05, 0.30),
    "negative_sentiment": (0.05, 0.30),
    "toxicity_scale": (0.30, 0.65),
}
TOXICITY_POINTS = {
    "profanity": 0.18,
    "soft": 0.35,
    "directed_attack": 0.30,
    "protected_abuse": 0.60,
    "severe": 0.65,
    "threat": 0.75,
}

# --- Sentences ---------------------------------------------------------------

EXPLANATIONS = {
    "allow_content": "Allowed because the negative language targets movie or review content rather than a user.",
    "allow": "Allowed because no severe abuse or user-directed attack was detected.",
    "flag_for_review": "Sent to review because the comment is aggressive, borderline, or aimed at people rather than movie craft.",
    "flag_for_removal": "Flagged for removal because the comment contains severe user-directed abuse or threat-like language.",
}
RATIONALES = {
    "allow_craft": "Allowed because the criticism targets movie or review content rather than a person.",
    "allow": "Allowed because no abusive target or severe abuse signal is present.",
    "flag_for_review": "Sent to review because the comment is aggressive, borderline, or aimed at people rather than movie craft.",
    "removal_harm": "Flagged for removal because it contains severe harmful language or threat-like wording.",
    "flag_for_removal": "Flagged for removal because the abuse targets a user, reviewer, or community.",
    "other": "Needs moderator review.",
}
UNIQUE_SUFFIXES = [
    "For me, that is the main issue.",
    "That is my honest take.",
    "I am only talking about the review context.",
    "This is about the discussion, not personal life.",
    "That is why the thread feels heated.",
    "The point is about the movie debate.",
    "This came up because of the rating difference.",
    "I still think people can disagree.",
    "That is how it reads in this thread.",
    "Context matters here.",
]

# --- Character tables and patterns -------------------------------------------
# The regular expressions use explicit classes instead of \w, \s and \b, so that
# they mean the same in every engine: a word character is a letter, a number or
# an underscore of any script, and white space is the Unicode set.

WORD = r"\p{L}\p{N}_"
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT_SEPARATORS = SPACE + r"._\-*@#$!|"

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"
CONFUSABLES_FROM = "\u0430\u0435\u043e\u0440\u0441\u0445\u04cf\u0456\u0443\u03b1\u03b5\u03bf"
CONFUSABLES_TO = "aeopcxiiyaeo"
LEET_FROM = "@$013457!|"
LEET_TO = "asoieastii"
DEVANAGARI = "[\u0900-\u097f]"
MENTION_TOKEN = "usermention"
TEXT_CAP = 280
PREVIEW_CHARS = 72
FEED_TEXT_CAP = 1000

# --- Word lists --------------------------------------------------------------

MOVIE_TERMS = [
    "movie", "film", "show", "series", "acting", "actor", "actress", "script", "story",
    "pacing", "direction", "dialogue", "dialogues", "screenplay", "editing", "vfx",
    "music", "song", "climax", "interval", "scene", "character", "plot", "performance",
    "cinematography", "color", "grading", "theatre", "ott", "hero", "villain", "dc",
    "marvel", "mcu", "dceu",
]
USER_TERMS = [
    "you", "your", "u", "ur", "tu", "tum", "tera", "teri", "tere", "aap", "reviewer",
    "user", "people", "fans", "fanbase", "comment", "comments", "log", "banda", "aadmi",
    "person", "kiddo", "buddy", MENTION_TOKEN,
]
GROUP_TARGET_PHRASES = [
    "perfection dene wale", "skip gang", "people in comments", "comment section",
    "fanbase", "fans of", "perfection wale", "skip wale",
]
DIRECTED_ATTACK_PHRASES = [
    "review dena band kar", "stop reviewing", "get some brain", "chup", "chup reh",
    "real id se aao", "attention seeker", "trash taste", "your taste is trash",
    "attention grab", "what s your problem", "whats your problem",
    "don t know history", "dont know history", "you don t know", "you dont know",
    "review nahi aata", "only a clown person", "only a idiot person",
    "only an idiot person", "only a gadha person", "only a bewakoof person",
    "only a stupid person", "only a dumb person", "only a mand-buddhi person",
    "only a tmkc person", "only a mkl person", "only a bkl person", "shut up",
    "you suck", "little shit", "asshole", "douche", "sadcase", "stay away",
    "tujh jaise", "tujh jaisa", "aukat nahi", "aukat nhi",
]
PROTECTED_ABUSE_PHRASES = [
    "nigger", "niggers", "negro", "kike", "spic", "chink", "gook", "raghead",
    "sandnigger", "faggot", "faggots", "fag", "dyke", "tranny", "trannies", "shemale",
    "queer", "chakka", "chakke", "hijra", "meetha", "meethe", "gandoo", "chamar",
    "chamars", "bhangi", "bhangis", "dhed", "neech jaat", "neech jaati", "neechi jaat",
    "caste abuse", "untouchable", "lower caste", "teri jaat", "jaat ka", "katua",
    "katuwa", "mulla", "mullas", "jihadi", "jihadis", "terrorist muslim",
    "muslims are terrorist", "muslims are terrorists", "pakistan chale jao",
    "pakistan ja", "go to pakistan", "anti national muslim", "all muslims are",
    "muslims should leave", "should leave this country", "should leave this platform",
    "go back to pakistan", "hindu kafir", "kafir hindu", "hindutva terrorist",
    "all hindus are", "stupid hindus", "khalistani", "sikh terrorist",
    "people from that community are disgusting", "people from that religion are",
    "attacking identity", "identity attack", "your religion is trash",
    "your caste is trash", "your community is disgusting", "hate your community",
    "hate your religion", "your people are disgusting", "your people should",
    "go back to your country", "go back where you came from", "not welcome here",
    "your kind", "subhuman", "vermin", "cockroach", "parasite", "disease",
]
SOFT_ABUSE = [
    "idiot", "clown", "stupid", "dumb", "fool", "moron", "loser", "bewakoof",
    "bevakoof", "gadha", "gadhe", "gadhi", "chomu", "chapri", "nalla", "nalle",
    "nalayak", "nikamma", "bekar", "besharam", "kamina", "kamine", "harami",
    "badtameez", "mand-buddhi", "attention seeker", "brain dead", "brain-dead",
    "trash taste", "get some brain", "review nahi aata", "chup reh", "real id se aao",
    "hater", "bc", "b c", "mc", "m c", "jhaat", "laure", "aukat", "berojgar",
    "berojgaar",
]
SEVERE_ABUSE = [
    "chutiya", "chutiyaa", "chutiye", "chutiy", "chutiyapa", "tmkc", "mkl", "bkl",
    "bsdk", "bhosdike", "teri maa", "maa chod", "maa chodh", "madarchod", "madar chod",
    "madarchodh", "bhadwa", "bhadva", "bhandwa", "lavde", "lawde", "laude", "lode",
    "loda", "lodaa", "choda", "chod", "chodunga", "chodega", "chodna", "behenchod",
    "behen chod", "bhenchod", "bhen chod", "behen ke lode", "bhosd", "randi", "randwa",
    "gandu", "gaand", "gand", "lund", "land muh", "whore", "fucked your mom",
]
THREAT_TERMS = [
    "i will find you", "dekh lunga", "hurt", "kill", "kys", "go die", "just die",
    "please die", "kill yourself", "mar ja", "marja", "jaa mar", "ja mar",
    "die if you like", "disappear", "hope you get hurt",
]
PROFANITY = [
    "shit", "fuck", "fucking", "bakwas", "ghatiya", "jhaat", "laure", "gaand", "gand",
    "lund", "loda", "bc", "mc",
]
POSITIVE_TERMS = [
    "good", "great", "liked", "love", "best", "amazing", "perfect", "perfection",
    "salute", "agree",
]
NEGATIVE_TERMS = [
    "bad", "weak", "boring", "worst", "trash", "shit", "bakwas", "ghatiya",
    "overhyped", "mess", "lazy", "flat", "dragged",
]
COMMUNITY_TERMS = [
    "community", "religion", "caste", "hindu", "muslim", "sikh", "christian", "dalit",
    "obc", "brahmin", "jain", "buddhist", "parsi", "jewish", "lgbtq", "queer",
    "transgender",
]
COMMUNITY_TERMS_FALLBACK = [
    "community", "religion", "caste", "hindu", "muslim", "sikh", "christian", "dalit",
    "lgbtq", "queer",
]
HATE_WORDS = ["disgusting", "leave", "hate", "dirty", "cheap", "identity"]
FAN_WORDS = ["fans", "fanbase", "people in comments", "perfection dene wale", "skip gang"]

LEXICON = {
    "movie": MOVIE_TERMS,
    "user": USER_TERMS,
    "group_target": GROUP_TARGET_PHRASES,
    "directed_attack": DIRECTED_ATTACK_PHRASES,
    "protected_abuse": PROTECTED_ABUSE_PHRASES,
    "soft": SOFT_ABUSE,
    "severe": SEVERE_ABUSE,
    "threat": THREAT_TERMS,
    "profanity": PROFANITY,
    "positive": POSITIVE_TERMS,
    "negative": NEGATIVE_TERMS,
    "community": COMMUNITY_TERMS,
    "hate_word": HATE_WORDS,
    "fan_word": FAN_WORDS,
}

# The first version of the policy used shorter lists.
LEXICON_V1 = {
    "movie": [
        "movie", "film", "show", "series", "acting", "actor", "actress", "script",
        "story", "pacing", "direction", "dialogue", "dialogues", "screenplay",
        "editing", "vfx", "music", "song", "climax", "interval", "scene", "character",
        "plot", "performance", "cinematography", "color", "grading", "theatre", "ott",
        "hero", "villain",
    ],
    "user": [
        "you", "your", "u", "ur", "tu", "tum", "tera", "teri", "tere", "aap",
        "reviewer", "user", "people", "fans", "fanbase", "comment", "comments", "log",
        "banda", "aadmi", "person", "kiddo", "buddy",
    ],
    "group_target": GROUP_TARGET_PHRASES,
    "directed_attack": [
        "review dena band kar", "stop reviewing", "get some brain", "chup",
        "chup reh", "real id se aao", "attention seeker", "trash taste",
        "your taste is trash", "attention grab", "what s your problem",
        "whats your problem", "don t know history", "dont know history",
        "you don t know", "you dont know", "review nahi aata", "only a clown person",
        "only a idiot person", "only an idiot person", "only a gadha person",
        "only a bewakoof person", "only a stupid person", "only a dumb person",
        "only a mand-buddhi person", "only a tmkc person", "only a mkl person",
        "only a bkl person", "shut up", "you suck", "little shit", "asshole",
        "douche", "sadcase",
    ],
    "protected_abuse": [
        "people from that community are disgusting", "should leave this platform",
        "caste abuse", "attacking identity", "faggot", "faggots", "nigger",
    ],
    "soft": [
        "idiot", "clown", "stupid", "dumb", "bewakoof", "gadha", "mand-buddhi",
        "attention seeker", "brain dead", "brain-dead", "trash taste",
        "get some brain", "review nahi aata", "chup reh", "real id se aao",
    ],
    "severe": [
        "chutiya", "tmkc", "mkl", "bkl", "teri maa", "madarchod", "bhosd", "randi",
        "whore", "fucked your mom",
    ],
    "threat": [
        "i will find you", "dekh lunga", "hurt", "kill", "go die", "just die",
        "please die", "die if you like", "disappear", "hope you get hurt",
    ],
    "profanity": ["shit", "fuck", "fucking", "bakwas", "ghatiya"],
    "positive": POSITIVE_TERMS,
    "negative": NEGATIVE_TERMS,
    "community": ["community", "religion", "caste", "hindu", "muslim"],
    "hate_word": HATE_WORDS,
    "fan_word": FAN_WORDS,
}

# Lists used when labelled examples are built.
HINGLISH_TOKENS = [
    "hai", "nahi", "tu", "tum", "bhai", "ye", "bekaar", "bakwas", "kar", "mat", "log",
]
EXAMPLE_PROFANITY = [
    "bewakoof", "gadha", "idiot", "clown", "mand-buddhi", "attention seeker",
    "chutiya", "tmkc", "mkl", "bkl", "shit", "fuck", "fucking",
]
GROUP_FLAG_KEYWORDS = ["mand-buddhi", "clown", "idiots"]
PROTECTED_FLAG_KEYWORDS = ["disgusting", "caste abuse", "should leave"]
OPEN_SOURCE_MARKERS = ["[link]", "[ip]", "wikipedia:", "talk:", "user:"]
POLICY_VERSION = "policy_v0.1"

# --- Policy rules ------------------------------------------------------------

POLICY_RULES = [
    {
        "id": "rule_hate_protected",
        "description": "Derogatory, abusive, or demeaning language explicitly directed at a protected class, religion, caste, or marginalized community.",
        "examples": [
            "These [community] people should be thrown out.",
            "Filthy [religion] needs to learn their place.",
            "Chamar",
            "Faggot",
        ],
        "action": "flag_for_removal",
        "category": "hate_or_identity_attack",
        "severity": "high",
    },
    {
        "id": "rule_threat_violence",
        "description": "Direct threats of physical harm, death, violence, or severe harassment against any individual or group.",
        "examples": [
            "I will hunt you down and kill you.",
            "Hope you die.",
            "Goli maar dunga",
        ],
        "action": "flag_for_removal",
        "category": "threat_or_violence",
        "severity": "critical",
    },
    {
        "id": "rule_personal_attack_severe",
        "description": "Severe personal insults, profound profanity, or sexually explicit abuse directed at another user or reviewer.",
        "examples": [
            "You are a motherfucker.",
            "Teri maa ki",
            "You absolute piece of human garbage.",
        ],
        "action": "flag_for_removal",
        "category": "personal_attack",
        "severity": "high",
    },
    {
        "id": "rule_harassment_soft",
        "description": "Soft abuse, mockery, or antagonistic insults directed at another user. Not severe enough for immediate removal but warrants review.",
        "examples": [
            "You are so dumb, why do you even post?",
            "Idiot reviewer doesn't know anything.",
            "Chutiya hai kya?",
        ],
        "action": "flag_for_review",
        "category": "harassment",
        "severity": "medium",
    },
    {
        "id": "rule_movie_criticism",
        "description": "Harsh, vulgar, or aggressive criticism that is directed entirely at a movie, its script, its characters, or the filmmaking process. No personal attacks against users.",
        "examples": [
            "This movie is utter shit.",
            "The director is terrible.",
            "Bakwas film hai, don't watch.",
        ],
        "action": "allow",
        "category": "non_abusive",
        "severity": "none",
    },
    {
        "id": "rule_general_profanity",
        "description": "General use of profanity or swear words that are not directed at anyone specifically, used for emphasis or frustration.",
        "examples": [
            "Fuck, that was a loud explosion.",
            "Shit happens.",
        ],
        "action": "allow",
        "category": "non_abusive",
        "severity": "none",
    },
    {
        "id": "rule_spam_promotional",
        "description": "Irrelevant promotional content, spam links, or repeated identical phrasing indicating bot behavior.",
        "examples": [
            "Click here to win an iPhone http://spam.link",
            "Buy cheap followers!",
        ],
        "action": "flag_for_review",
        "category": "spam",
        "severity": "low",
    },
]

# Devanagari letters and their romanisation by IAST, with ISO 15919
# for the letters that only modern languages have.  Space separated, in the
# order of the script's own table.
IAST_VOWELS = "अ a आ ā इ i ई ī उ u ऊ ū ऋ ṛ ऌ ḷ ऍ ê ऎ e ए e ऐ ai ऑ ô ऒ o ओ o औ au ॠ ṝ ॡ ḹ"
IAST_SIGNS = "ा ā ि i ी ī ु u ू ū ृ ṛ ॄ ṝ ॅ ê ॆ e े e ै ai ॉ ô ॊ o ो o ौ au ॢ ḷ ॣ ḹ"
IAST_CONSONANTS = (
    "क k ख kh ग g घ gh ङ ṅ च c छ ch ज j झ jh ञ ñ ट ṭ ठ ṭh ड ḍ ढ ḍh ण ṇ त t थ th द d ध dh न n ऩ ṉ "
    "प p फ ph ब b भ bh म m य y र r ऱ ṟ ल l ळ ḷ ऴ ḻ व v श ś ष ṣ स s ह h "
    "क़ q ख़ ḵẖ ग़ ġ ज़ z ड़ ṛ ढ़ ṛh फ़ f य़ ẏ"
)
IAST_NUKTA_PAIRS = "क़ q ख़ ḵẖ ग़ ġ ज़ z ड़ ṛ ढ़ ṛh फ़ f य़ ẏ"
IAST_OTHERS = "ँ m̐ ं ṃ ः ḥ ऽ ’ । . ॥ .. ० 0 १ 1 २ 2 ३ 3 ४ 4 ५ 5 ६ 6 ७ 7 ८ 8 ९ 9 ॐ oṃ"
VIRAMA, NUKTA = "्", "़"
