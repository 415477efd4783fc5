"""Data constants that results depend on, stated as plain text.

Nothing here is logic. Every operator takes these as default parameters, so a caller
can pass their own series, intervals, section patterns, lexicon, stop words or template.
"""

# Economic series, id -> (name, category).
SERIES = {
    "DFF": ("Fed Funds Rate", "Interest Rates"),
    "GS10": ("10Y Treasury Yield", "Interest Rates"),
    "GS2": ("2Y Treasury Yield", "Interest Rates"),
    "CPIAUCSL": ("CPI (All Urban)", "Inflation"),
    "PCEPI": ("PCE Price Index", "Inflation"),
    "T10YIE": ("10Y Breakeven Inflation", "Inflation"),
    "GDP": ("GDP", "Growth"),
    "INDPRO": ("Industrial Production Index", "Growth"),
    "RSAFS": ("Retail Sales", "Growth"),
    "HOUST": ("Housing Starts", "Growth"),
    "UNRATE": ("Unemployment Rate", "Labor"),
    "PAYEMS": ("Nonfarm Payrolls", "Labor"),
    "ICSA": ("Initial Jobless Claims", "Labor"),
    "BAMLH0A0HYM2": ("HY Credit Spread", "Credit"),
    "BAMLC0A0CM": ("IG Credit Spread", "Credit"),
    "UMCSENT": ("Consumer Sentiment (UMich)", "Sentiment"),
    "VIXCLS": ("VIX (Market Volatility)", "Sentiment"),
}

# Recession intervals, inclusive on both ends.
RECESSIONS = [
    ("2001-03-01", "2001-11-30"),
    ("2007-12-01", "2009-06-30"),
    ("2020-02-01", "2020-04-30"),
]

# Section headers of an annual report, (key, alternatives in order of preference).
ANNUAL_SECTIONS = [
    ("business", [r"item\s*1\b(?!a)", r"description of business"]),
    ("risk_factors", [r"item\s*1a", r"risk factors"]),
    ("mda", [r"item\s*7\b(?!a)", r"management.{0,10}discussion", r"md&a"]),
    ("market_risk", [r"item\s*7a", r"quantitative.*market risk"]),
    ("financials", [r"item\s*8\b", r"financial statements"]),
]

# Section headers of a quarterly report.
QUARTERLY_SECTIONS = [
    ("mda", [r"item\s*2\b", r"management.{0,10}discussion"]),
    ("market_risk", [r"item\s*3\b", r"quantitative.*market risk"]),
    ("financials", [r"item\s*1\b(?!a)", r"financial statements"]),
    ("risk_factors", [r"item\s*1a", r"risk factors"]),
]

# Upper-case headers, matched case-sensitively when the catalogs above find too little.
UPPERCASE_SECTIONS = [
    ("business", [r"ITEM\s+1\b(?!A)"]),
    ("risk_factors", [r"ITEM\s+1A"]),
    ("mda", [r"ITEM\s+7\b(?!A)"]),
    ("market_risk", [r"ITEM\s+7A"]),
    ("financials", [r"ITEM\s+8\b"]),
]

# Valences of finance terms, laid over a base lexicon.
FINANCE_LEXICON = {
    "outperform": 2.5,
    "beat": 2.0,
    "exceeded": 2.0,
    "robust": 1.8,
    "record": 1.5,
    "accelerating": 1.5,
    "resilient": 1.5,
    "momentum": 1.2,
    "growth": 1.0,
    "profitable": 1.5,
    "profitability": 1.5,
    "innovative": 1.2,
    "synergies": 1.0,
    "upside": 1.3,
    "impairment": -2.5,
    "writedown": -2.5,
    "write-down": -2.5,
    "write-off": -2.5,
    "litigation": -1.8,
    "lawsuit": -1.8,
    "default": -2.5,
    "breach": -2.0,
    "headwind": -1.5,
    "headwinds": -1.5,
    "uncertainty": -1.5,
    "downturn": -1.8,
    "restructuring": -1.5,
    "layoff": -2.0,
    "layoffs": -2.0,
    "restatement": -3.0,
    "fraud": -3.5,
    "misconduct": -2.8,
    "decline": -1.5,
    "declining": -1.5,
    "deterioration": -2.0,
    "adverse": -1.5,
    "unfavorable": -1.5,
    "volatile": -1.3,
    "volatility": -1.3,
    "risk": -1.0,
    "risks": -1.0,
    "material weakness": -3.0,
    "going concern": -3.5,
    "liquidity": -0.5,
    "inflationary": -1.2,
    "macroeconomic": -0.5,
}

# Words of filings that carry no topic, added to the English stop words.
FILING_STOP_WORDS = [
    "company", "companies", "year", "years", "fiscal", "quarter",
    "annual", "period", "ended", "december", "january", "march", "june",
    "september", "item", "form", "sec", "report", "filing", "pursuant",
    "section", "herein", "thereof", "hereby", "thereto", "therein",
    "shall", "may", "including", "following", "certain", "however",
    "also", "approximately", "million", "billion", "thousand",
]

# Addresses that filing links are built from.
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data"
SITE_URL = "https://www.sec.gov"

# The wording a question and its context are set in.
ANSWER_TEMPLATE = """You are a financial analyst assistant with expertise in SEC filings.
Use the following excerpts from SEC filings to answer the question.
Be specific and cite evidence from the text. If the information is not in the context,
say so clearly rather than speculating.

Context:
{context}

Question: {question}

Answer:"""

# Bulleted context, for callers who prefer one line per passage.
BULLET_TEMPLATE = """Answer the query from the context items below. Reply with the answer only.

Context:
{context}

User Query:
{question}

Answer:"""

# Rule constants of the published rule-based sentiment model
# (Hutto and Gilbert, ICWSM 2014).
DEGREE_STEP = 0.293
CAPS_STEP = 0.733
NEGATION_FACTOR = -0.74
COMPOUND_ALPHA = 15.0
EXCLAMATION_STEP = 0.292
QUESTION_STEP = 0.18
QUESTION_CAP = 0.96
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
NEVER_SO_FACTOR = 1.25
# Phrases of that model whose valence is not that of their words.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "never", "none", "nope", "nor",
    "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "wasnt", "werent", "without",
    "wont", "wouldnt", "rarely", "seldom", "despite",
]
INTENSIFIERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly",
    "deeply", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally",
    "extreme", "extremely", "fully", "greatly", "highly", "hugely", "incredible", "incredibly",
    "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous",
    "tremendously", "unbelievably", "unusually", "utter", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "just enough", "kind of", "less", "little", "marginal",
    "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight",
    "slightly", "somewhat", "sort of",
]
