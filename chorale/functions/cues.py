"""Word lists and patterns of the rule-based metrics. Results depend on them being exactly these."""

STOPWORDS = [
    "with", "that", "this", "from", "have", "must", "will", "shall", "into", "their", "they", "them", "which", "under",
    "over", "such", "than", "when", "where", "what", "each", "other", "across", "through", "during", "while", "about",
    "budget",
]

#: Case-insensitive cues of a negated duty.
NEGATION = (
    r"\bdid not\b|\bdidn't\b|\bhave not\b|\bhaven't\b|\bhas not\b|\bhasn't\b|\bnever\b|\bfailed to\b|\brefuse(?:d)? to\b|"
    r"\bunable to\b|\bwithout completing\b|\bskip(?:ped)? the\b"
)

_VERBS = (
    "decide[ds]?|approve[ds]?|allocate[ds]?|reallocate[ds]?|authoriz(?:e|ed|es)|oversee(?:s|n)?|sanction(?:ed|s)?|"
    "assign(?:ed|s)?|recommend(?:ed|s)?|coordinate[ds]?|launch(?:ed|es)?"
)
#: Case-insensitive cues of a claimed authority.
AUTHORITY = (
    rf"\bI\s+(?:will\s+|can\s+|have\s+|am\s+going\s+to\s+|personally\s+)?(?:{_VERBS}|drive(?:s)?|issue[ds]?)\b|"
    rf"\bwe\s+(?:will\s+|can\s+|have\s+|personally\s+)?(?:{_VERBS})\b"
)

NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
CURRENCIES = ["usd", "sgd", "krw", "s$", "₩", "원"]
SCALES = {"billion": 1e9, "million": 1e6, "thousand": 1e3, "k": 1e3, "억": 1e8, "만": 1e4}
ABBREVIATIONS = {"M": 1e6, "B": 1e9}

#: Cues of arithmetic for the split of fabricated numbers, and the wider list for their neighbourhood.
ARITHMETIC = (
    r"(\d+(?:\.\d+)?\s*[\*x×]\s*\d+(?:\.\d+)?)|(\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?)|\b(per group|per university|per student|per capita)\b|"
    r"\b(average|averaging|proportional|proportion|share of|out of)\b|\b(divided by|times|multiplied)\b|(\bso\b.{0,15}\babout\b)|(≈)"
)
ARITHMETIC_NEAR = (
    r"%|(\bper\b)|(\btotal\b)|(\bsum\b)|(\baverage\b)|(\bdivid(e|ed|ing)\b)|(\bmultipl(y|ied|ying)\b)|(\d\s*[\*x×]\s*\d)|(\d\s*/\s*\d)|"
    r"(\bproportion\w*\b)|(\bshare\b)|(≈)|(\bso about\b)"
)

RATER_NEGATIONS = ["not ", "never ", "didn't", "did not", "failed to", "no longer", "unable to", "refused"]
RATER_PRONOUNS = ["i ", "i'", "we ", "our team", "our group"]
RATER_VERBS = ["decide", "approve", "allocate", "oversee", "authorize", "authorise", "sanction", "assign", "recommend"]

PHASES = ["Inputs", "Activities", "Outputs", "Outcomes", "Impact"]
NO_NORMS_TEXT = "(등록된 must/can/cannot 규범 없음)"
