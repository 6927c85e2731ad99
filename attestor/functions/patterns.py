"""Fixed values that results depend on: character tables, word lists, patterns and thresholds.

Patterns are Java regular expressions. W and NW stand for the ASCII word boundary before and after a word character,
because Java's \\b is not ASCII; WS is the white space class of the text views, SPACE the wider class of \\s in scripts.
"""

W, NW = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WS = r"[\u0020\u00a0\t\n\u000b\f\r\u2028\u2029\u202f\u3000]"
SPACE = r"[\t\n\u000b\f\r\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NEITHER = r"[^A-Za-z0-9_" + SPACE[1:]
#: The same. What most characters are is ruled out first by one table look-up.
ONE_OF_NEITHER = "(?![A-Za-z0-9_ ])" + NEITHER
#: Runs of either class. Visible ASCII is ruled out first by one table look-up; the class itself tries range after range.
WS_RUN, SPACE_RUN = r"(?![!-~])" + WS + "+", r"(?![!-~])" + SPACE + "+"
#: The members of SPACE, for functions that take characters.
SPACE_CHARS = "\t\n\u000b\f\r\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# --- Fixed values: characters folded in text views ---
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb"
DASHES = "\u2013\u2014\u2212\u2011\u2012\u2015"
ELLIPSIS = "\u2026"

# --- Fixed values: limits ---
QUOTE_SHORTEST, QUOTE_LONGEST, OCCURRENCES = 20, 2000, 50
CHUNK_TOKENS, WORDS, WORD_OVERLAP = 24_000, 200, 50
UPLOAD_BYTES, UPLOAD_BYTES_PY = 25 * 1024 * 1024, 50 * 1024 * 1024

# --- Fixed values: words that carry no meaning in a question ---
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself let's me more most
mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same say saying says she should
shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until
up very was wasn't we were weren't what when where which while who whom why with won't would wouldn't you your yours yourself
yourselves tell state states stated describe explain show showing give much many
""".split()

# --- Fixed values: headings ---
SMALL_WORDS = "a an the and or of to for in on with at by as you your its under between".split()
NUMBERED = rf"^(?:\((\d+(?:\.\d+)*)\)|(\d+(?:\.\d+)*)[.)]?){SPACE}+(\S.*)$"
LETTERED = rf"^(?:\(([A-Za-z])\)|([A-Za-z])[.)]){SPACE}+(\S.*)$"
LABELLED = rf"(?i)^(?:Section|Article|Clause){SPACE}+(\d+|[IVXLCivxlc]+|[A-Za-z]+)[.:)\-\s\u00a0]*(.*)$"
ALL_CAPS = r"^[A-Z0-9 ,'&/\-()]{4,80}$"

# --- Fixed values: categories of clauses, in order: heading patterns, body patterns ---
CATEGORIES = (
    ("liability", (r"\b(liab|limitation of liability|damages|cap on liability|consequential)\b",),
     (r"\bunlimited\s+liab", r"\bliability\s+shall\s+not\s+exceed\b", r"\b(limitation|limit)\s+of\s+liability\b", r"\baggregate\s+liability\b",
      r"\bindirect|consequential|punitive|special\s+damages\b", r"\bliable\s+for\s+any\s+loss\b")),
    ("indemnity", (r"\b(indemnif|hold\s+harmless|defense\s+and\s+indemnification)\b",),
     (r"\b(indemnif|hold\s+harmless|save\s+harmless)\b", r"\bdefend.{0,30}harmless\b", r"\bthird[- ]party\s+claims?\b")),
    ("termination", (r"\b(terminat|term\s+and\s+termination|cancellation|expiration)\b",),
     (r"\bterminate.{0,40}(for\s+cause|convenience|without\s+cause)\b", r"\bnotice\s+of\s+termination\b", r"\btermination\s+notice\b",
      r"\buncured\s+breach\b", r"\beffect\s+of\s+termination\b")),
    ("payment", (r"\b(payment|fees|invoicing|compensation|pricing|billing|charges|rates)\b",),
     (r"\b(undisputed\s+invoices?|pay\s+all\s+invoices?|interest\s+at\s+\d|due\s+date|late\s+payments?)\b",
      r"\b(net\s+\d+|payable\s+within\s+\d+\s+days)\b", r"\b(taxes\s+and\s+duties|reimbursement\s+of\s+expenses)\b")),
    ("confidentiality", (r"\b(confidential|non[- ]disclosure|proprietary\s+information|secrecy)\b",),
     (r"\b(confidential\s+information|proprietary\s+information|trade\s+secrets?)\b", r"\b(recipient|disclosing\s+party).{0,30}confidential",
      r"\bmaintain\s+(the\s+)?confidentiality\b")),
    ("governing_law", (r"\b(governing\s+law|applicable\s+law|jurisdiction|venue)\b",),
     (r"\bgoverned\s+by\s+and\s+construed\s+in\s+accordance\s+with\b",
      r"\blaws\s+of\s+(the\s+)?(United\s+Arab\s+Emirates|Dubai|England|Delaware|New\s+York|Singapore)\b",
      r"\bcourts\s+of\s+(Dubai|DIFC|ADGM|England|Delaware|London)\b", r"\bexclusive\s+jurisdiction\b")),
    ("dispute_resolution", (r"\b(dispute|dispute\s+resolution|arbitration|mediation|litigation)\b",),
     (r"\bbinding\s+arbitration\b", r"\b(DIFC-LCIA|LCIA|ICC|DIAC|AAA|UNCITRAL)\b", r"\barbitration\s+in\s+Dubai\b", r"\brules\s+of\s+arbitration\b")),
    ("warranties", (r"\b(warrant|representations?|disclaimer\s+of\s+warranties)\b",),
     (r"\b(warrant\s+and\s+represent|as[- ]is\s+basis|merchantability|fitness\s+for\s+a\s+particular\s+purpose)\b", r"\bno\s+other\s+warranties\b")),
    ("data_protection", (r"\b(data\s+protection|security|privacy|gdpr|customer\s+data)\b",),
     (r"\b(personal\s+data|customer\s+data|data\s+safeguards|security\s+measures)\b", r"\b(administrative,\s+physical,\s+and\s+technical\s+safeguards)\b")),
    ("intellectual_property", (r"\b(intellectual\s+property|ip\s+rights|patents?|copyrights?|trademarks?|ownership)\b",),
     (r"\b(ownership\s+of\s+deliverables|work\s+made\s+for\s+hire|ip\s+infringement)\b", r"\bretain\s+all\s+rights,\s+title\s+and\s+interest\b")),
)
#: Lower-cased words of which each match of a category's heading patterns, and of its body patterns, holds one. A text without them is not searched.
CATEGORY_WORDS = {
    "liability": ("liab|damages|consequential", "liab|indirect|consequential|punitive|damages"),
    "indemnity": ("indemnif|harmless", "indemnif|harmless|third"),
    "termination": ("terminat|cancellation|expiration", "terminat|uncured"),
    "payment": ("payment|fees|invoicing|compensation|pricing|billing|charges|rates", "invoice|interest|due|payment|net|payable|taxes|reimbursement"),
    "confidentiality": ("confidential|disclosure|proprietary|secrecy", "confidential|proprietary|secret"),
    "governing_law": ("law|jurisdiction|venue", "governed|laws|courts|jurisdiction"),
    "dispute_resolution": ("dispute|arbitration|mediation|litigation", "arbitration|lcia|icc|diac|aaa|uncitral"),
    "warranties": ("warrant|representation", "warrant|basis|merchantability|fitness"),
    "data_protection": ("data|security|privacy|gdpr", "data|security|safeguards"),
    "intellectual_property": ("intellectual|rights|patent|copyright|trademark|ownership", "ownership|hire|infringement|rights"),
}
CRITICAL = ("liability", "indemnity", "termination", "governing_law")
HIGH_RISK = ("liability", "payment", "termination", "indemnity", "governing_law")

# --- Fixed values: tokens whose change matters ---
AMOUNT = r"(?i)(?:AED|USD|EUR|GBP|\$|€|£|Dirhams?)\s*([\d,]+(?:\.\d+)?)|([\d,]+(?:\.\d+)?)\s*(?:AED|USD|EUR|GBP|Dirhams?)"
UNITS = rf"(?i){W}(\d+(?:,\d+)*(?:\.\d+)?)\s*(days?|business\s+days?|calendar\s+days?|months?|years?|weeks?|hours?){NW}"
PERCENT = rf"(?i){W}(\d+(?:\.\d+)?)\s*(?:%(?=[A-Za-z0-9_])|percent{NW})"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = rf"(?i){W}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}){NW}"
MODALS = rf"(?i){W}(shall\s+not|must\s+not|may\s+not|shall|must|may|will){NW}"
NEGATIONS = rf"(?i){W}(not|never|neither|nor|cannot|no\s+longer|no){NW}"
PLACES = rf"(?i){W}(Dubai|United\s+Arab\s+Emirates|UAE|DIFC|ADGM|Abu\s+Dhabi|England(?:\s+and\s+Wales)?|Delaware|New\s+York|California|Singapore|United\s+Kingdom){NW}"
UNLIMITED = rf"(?i){W}unlimited{NW}"

# --- Fixed values: key terms of legal documents ---
PARTIES = (
    r"(?:between|by and between)\s+([A-Z][A-Za-z\s,.]+?)(?:\s*\()",
    "(?:hereinafter|herein)\\s+(?:referred to as|called)\\s+[\"“]([^\"”]+)[\"”]",
    "\\((?:the\\s+)?[\"“]([A-Z][A-Za-z\\s]+)[\"”]\\)",
    r"(?:Party|Parties|Contractor|Client|Employer|Employee|Landlord|Tenant|Licensor|Licensee|Vendor|Purchaser|Buyer|Seller|Borrower|Lender|Lessor|Lessee|Plaintiff|Defendant|Petitioner|Respondent):\s*([A-Z][A-Za-z\s,.]+?)(?:\n|,\s*a\s)",
)
KEY_DATES = (
    rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:day of\s+)?(?:{MONTHS}),?\s+\d{{4}}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
)
MONEY = (
    r"(?i)\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|thousand|USD|dollars))?",
    r"(?i)(?:USD|US\s*Dollars?)\s*[\d,]+(?:\.\d{2})?",
    r"(?i)\b\d[\d,]*(?:\.\d{2})?\s+(?:dollars|USD)\b",
)
DEFINED = (
    "[\"“]([A-Z][A-Za-z\\s]{2,40})[\"”]\\s+(?:means|shall mean|refers to|is defined as)",
    "(?:the\\s+)?[\"“]([A-Z][A-Za-z\\s]{2,40})[\"”](?:\\s*\\))",
    "\\((?:the\\s+)?[\"“]([A-Z][A-Za-z\\s]{2,30})[\"”]\\)",
)
LAW = (
    r"(?:governed by|construed (?:in accordance with|under)|subject to)\s+(?:the\s+)?(?:laws?\s+of\s+)?(?:the\s+)?(?:State\s+of\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?:State\s+of|Commonwealth\s+of)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
)
REFERENCES = (r"\b\d+\s+U\.?S\.?C\.?\s*§?\s*\d+\b", r"\b\d+\s+[A-Z][a-z]+\.?\s+\d+\b", r"\b[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+", r"§\s*\d+[.\d]*")
#: Type, words of a file name (3 points each), words of the content (1 point each).
DOCUMENT_TYPES = (
    ("Contract", "contract|agreement|lease|nda|msa|sow|amendment",
     "hereby agrees|shall be binding|term of this agreement|representations and warranties|indemnif|governing law|entire agreement|counterparts|force majeure|whereas|now, therefore|witnesseth"),
    ("Pleading", "complaint|motion|brief|petition|answer|pleading",
     "comes now|respectfully|plaintiff|defendant|this court|jurisdiction|cause of action|prayer for relief|count i|wherefore|court of"),
    ("Memorandum", "memo|memorandum|opinion", "memorandum|legal analysis|issue presented|conclusion|discussion|brief answer|question presented"),
    ("Correspondence", "letter|email|notice|correspondence", "dear |sincerely|regards|please find|enclosed|pursuant to our conversation|i am writing"),
    ("Court Order", "order|judgment|ruling|decree", "it is hereby ordered|the court finds|so ordered|it is therefore|judgment is entered"),
    ("Corporate", "bylaws|articles|charter|resolution|minutes", "board of directors|shareholders|resolution|bylaws|articles of incorporation|corporate"),
    ("Regulatory", "regulation|compliance|filing|rule", "pursuant to regulation|compliance|regulatory|filing requirement|sec |federal register"),
)

# --- Where a search can begin, and what a text must hold for one ---
#: The first character of a match, as a class: one table look-up rules out most places. By pattern.
FIRST = {
    AMOUNT: "[AUEGD$\u20ac\u00a30-9,]", UNITS: "[0-9]", PERCENT: "[0-9]", DATES: "[0-9JFMASOND]", MODALS: "[SMW]", NEGATIONS: "[NC]", PLACES: "[DUAENCS]",
    PARTIES[0]: "[b]", PARTIES[1]: "[h]", PARTIES[2]: r"[(]", PARTIES[3]: "[PCELTVBSDR]", KEY_DATES[0]: "[JFMASOND]", KEY_DATES[1]: "[0-9]", KEY_DATES[2]: "[0-9]", KEY_DATES[3]: "[0-9]",
    MONEY[0]: "[$]", MONEY[1]: "[U]", MONEY[2]: "[0-9]", DEFINED[0]: "[\"\u201c]", DEFINED[1]: "[t\"\u201c]", DEFINED[2]: "[(]", LAW[0]: "[gcs]", LAW[1]: "[SC]", REFERENCES[0]: "[0-9]", REFERENCES[1]: "[0-9]", REFERENCES[2]: "[A-Z]", REFERENCES[3]: "\u00a7",
}
#: Lower-cased words of which each match holds one. By pattern.
HOLDS = {
    AMOUNT: "aed|usd|eur|gbp|$|\u20ac|\u00a3|dirham", UNITS: "day|month|year|week|hour", PERCENT: "%|percent", MODALS: "shall|must|may|will", UNLIMITED: "unlimited",
    PLACES: "dubai|united|uae|difc|adgm|abu|england|delaware|new|california|singapore",
}


def begun(pattern: str) -> str:
    """The pattern, tried only where its first character can be."""
    if pattern not in FIRST:
        return pattern
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}(?={FIRST[pattern]})(?:{pattern.removeprefix(flag)})"
