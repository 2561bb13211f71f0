"""Fixed values of the text channel, as plain tables."""

# Stopwords of the tokenizer.
STOPWORDS = (
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is",
    "are", "was", "were", "our", "we", "it", "its", "this",
    "that", "with", "at", "as", "be", "by", "has", "have", "had",
    "not", "just", "so", "than", "then", "need", "needs",
)

# Suffix -> replacement, tried in this order; a rule applies only if at least MIN_STEM letters stay.
SUFFIX_RULES = (
    ("ations", ""), ("ation", ""), ("atory", "ate"), ("edly", ""), ("ing", ""), ("ed", ""),
    ("ies", "y"), ("ives", "ive"), ("ly", ""), ("es", ""), ("s", ""),
)
MIN_STEM = 4

# Query-side synonyms.
SYNONYMS = {
    "adequacy": ("basel",),
    "impairment": ("provisioning", "ifrs9"),
    "submission": ("reporting",),
    "crime": ("aml",),
    "launched": ("formation", "setup"),
    "licensed": ("formation", "setup", "licensing"),
    "licensing": ("setup",),
    "custodian": ("administrator", "fund"),
    "responsible": ("esg",),
    "sustainability": ("esg",),
    "chargeback": ("fraud",),
    "verification": ("kyc", "kyb"),
    "concentration": ("diligence",),
    "handover": ("succession",),
    "transition": ("succession",),
    "vet": ("selection", "diligence"),
    "vetted": ("selection", "diligence"),
    "reimbursement": ("cycle", "billing"),
    "virtual": ("telehealth",),
    "remote": ("telehealth",),
    "drug": ("pharmacovigilance", "pv"),
    "underperforming": ("asset",),
    "yields": ("asset",),
    "register": ("lease",),
    "backlog": ("improvement", "operations"),
    "insurance": ("ifrs17",),
    "accounting": ("ifrs17", "reporting"),
}

# Seniority levels, availability phrases (first hit wins) and the grade bands of a 0-1 score.
SENIORITY = {"mid": 0, "senior": 1, "expert": 2}
AVAILABILITY_PHRASES = (
    ("immediately", 1.0),
    ("full-time capacity", 0.9),
    ("weekday evenings", 0.6),
    ("mondays to fridays", 0.5),
    ("3 days/week", 0.5),
    ("2 weeks' notice", 0.2),
)
AVAILABILITY_DECAY_DAYS = 60.0
BAND_CUTS = (0.175, 0.50, 0.825)
RELEVANCE_THRESHOLD = 40
GRADE_SCORE = {1: 33, 2: 67, 3: 100}
DEFAULT_PROMPT_VERSION = "rubric_0_3.v2-repro"
