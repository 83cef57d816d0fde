"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

TOKEN = "[a-z0-9]+"

# Stop words of the index tokeniser.
INDEX_STOP = """a an and are as at be been being by for from has have had he her his i in is it its of on or
that the their there they this to was were what when where which who will with would you your""".split()

# Stop words of the reranker.
RERANK_STOP = """a an and are as at be by can did do does for from has have how in is it its of on or shall
that the their there these this to was were what when where which who why will with would""".split()

# Question words and stop words of query expansion.
QUESTION_WORDS = """what who whom whose when where why how which is are was were do does did can could shall
should will would may might list explain describe summarise summarize tell give""".split()
QUERY_STOP = """a an and any are as at be been by for from has have in into is it its of on or that the
their there this to was were with""".split()

# Stop words of answer composition.
ANSWER_STOP = """a an and are as at be by for from has have in is it its of on or shall that the their
there this to was were what which who will with would does do did how when where why""".split()

# Stop words of verification.
VERIFY_STOP = """a an and are as at be been by for from has have in is it its of on or shall that the
their there this to was were with would which who what when where why how also such any
each other than then these those into upon under over per may must can will not no""".split()

# Stop words and generic words of topic discovery.
TOPIC_STOP = """a an and are as at be been being by for from has have had he her his i in is it its of on
or that the their there they this to was were what when where which who will with would you
your shall may must not no such any each other than then these those into upon under over per
also both either neither if but so however therefore thus hence within without upon""".split()
TOPIC_GENERIC = """section clause page unit module chapter part article schedule annexure note notes example
following above below shall will must may can also given figure table marks question questions
answer answers explain define describe state list discuss""".split()

# Stop words of question generation.
STUDY_STOP = """a an and are as at be been by for from has have in is it its of on or shall that the their
there this to was were with would which who what when where why how not no such any each per
may must can will also both if but so however therefore thus within without upon under over""".split()

# Abbreviations that do not end a sentence.
ABBREVIATIONS = """no nos vs v cl cls sec secs s ss art arts para paras fig figs eq eqs ch chs pp p pg
rs usd inr mr mrs ms dr prof hon ltd pvt co inc jr sr st etc eg ie viz al ors anr
jan feb mar apr jun jul aug sep sept oct nov dec approx max min avg vol ed""".split()
BULLETS = "•·‣▪●⁃∙-"

# Words that make a line a heading.
HEADING_WORDS = "SCHEDULE ANNEXURE CLAUSE SECTION CHAPTER PART ARTICLE UNIT MODULE APPENDIX EXHIBIT".split()

# Synonyms of query expansion.
SYNONYMS = {
    "landlord": ("lessor", "owner", "vendor"),
    "lessor": ("landlord", "owner"),
    "tenant": ("lessee", "occupant"),
    "lessee": ("tenant", "occupant"),
    "buyer": ("purchaser", "vendee", "transferee"),
    "purchaser": ("buyer", "transferee"),
    "seller": ("vendor", "transferor"),
    "vendor": ("seller", "transferor"),
    "rent": ("rental", "lease amount", "monthly rent"),
    "deposit": ("security deposit", "advance"),
    "penalty": ("liquidated damages", "late fee", "interest"),
    "terminate": ("termination", "cancel", "rescind", "determine"),
    "notice": ("intimation", "written notice", "notice period"),
    "verdict": ("judgment", "holding", "decree", "order"),
    "judgment": ("judgement", "verdict", "decree", "holding"),
    "damages": ("compensation", "award", "restitution"),
    "appeal": ("appellant", "appellate", "revision"),
    "plaintiff": ("appellant", "petitioner", "claimant"),
    "defendant": ("respondent", "opposite party"),
    "law": ("statute", "act", "section", "provision"),
    "definition": ("means", "defined as", "refers to"),
    "formula": ("equation", "expression"),
    "advantage": ("benefit", "pro", "merit"),
    "drawback": ("limitation", "disadvantage", "con"),
    "difference": ("versus", "compared", "distinction"),
    "example": ("e.g.", "for instance", "illustration"),
    "steps": ("procedure", "algorithm", "process"),
    "area": ("built-up area", "carpet area", "square feet"),
    "maintenance": ("upkeep", "repairs", "charges"),
    "bcnf": ("boyce codd normal form", "boyce-codd"),
    "1nf": ("first normal form",),
    "2nf": ("second normal form",),
    "3nf": ("third normal form",),
    "4nf": ("fourth normal form", "multivalued dependency"),
    "fd": ("functional dependency",),
    "mvd": ("multivalued dependency",),
    "acid": ("atomicity", "consistency", "isolation", "durability"),
    "wal": ("write-ahead logging", "write ahead log"),
    "2pl": ("two-phase locking", "two phase locking"),
    "rera": ("real estate regulation and development act",),
    "tds": ("tax deducted at source", "deduct tax at source"),
    "cnn": ("convolutional neural network",),
}

# Questions rewritten as statements: pattern on the lower-cased question, and what takes its place.
DECLARATIVE = [
    (r"^who (?:is|are|was|were|has|have) (?:the )?(.*)$", "{} is"),
    (r"^who (?:must|shall|should|will|has to|have to) (.*)$", "shall {}"),
    (r"^what (?:is|are|was|were) (?:the )?(.*)$", "{} is"),
    (r"^what (?:does|do) (.*?) mean$", "{} means"),
    (r"^when (?:is|was|does|did|will) (?:the )?(.*)$", "{} date"),
    (r"^where (?:is|are|was|were) (?:the )?(.*)$", "{} located at"),
    (r"^how (?:much|many) (?:is|are|was|were)? ?(?:the )?(.*)$", "{} amount"),
    (r"^why (?:did|does|was|is) (?:the )?(.*)$", "because {}"),
    (r"^(?:can|could|may) (?:the )?(.*)$", "{} is permitted"),
    (r"^(?:list|explain|describe|summarise|summarize|tell me about) (?:the )?(.*)$", "{}"),
]

# Query routing.
TOPICS_ASKED = (
    r"\b((?:what|which)\s+(?:topics|sections|chapters|clauses)|list\s+(?:the\s+)?(?:topics|sections|chapters|clauses)|"
    r"what(?:'s|s)?\s*(?:is)?\s+(?:in|inside|covered)\b|what\s+(?:does|do)\s+(?:this|it|the\s+\w+)\s+cover|"
    r"what\s+(?:can|could|should)\s+i\s+ask|sections?\s+(?:in|of)\s+(?:this|the))\b"
)
SUMMARY_ASKED = (
    r"\b(summari[sz]e|summari[sz]ation|summary|tl;?dr|overview|abstract|gist|recap|synopsis|"
    r"key\s+(?:points?|takeaways?|ideas?|findings?|highlights?)|main\s+(?:points?|ideas?|findings?|argument|takeaways?)|"
    r"in\s+(?:short|brief|a\s+nutshell)|walk\s+me\s+through|brief\s+me|table\s+of\s+contents)\b"
)
EXPOSITORY = r"\b(explain|describe|summari[sz]e|outline|elaborate|tell\s+me|what(?:'s| is| are)?|whats)\b"
WHOLE_DOCUMENT = (
    r"\b(doc|docs|document|documents|pdf|pdfs|file|files|paper|notes?|deed|judgment|judgement|case|material|contents?|report|letter|"
    r"contract|agreement|invoice|memo|article|thesis|slides?|deck|attachment|everything|all\s+of\s+(?:this|it))\b"
)
POINTER = r"\b(this|these|it)\b"
SUMMARY_WORDS = "summarize summarise summary overview abstract gist recap synopsis tldr".split()
VERB_WORDS = "explain describe summarize summarise outline elaborate overview".split()
DOCUMENT_WORDS = "document documents pdf file paper notes deed judgment judgement material contents everything".split()
INTENT_WORDS = """a about all an and are as at be brief briefly can could describe detail details do does
elaborate everything explain file for give i in is it its me more notes of on or outline
paper pdf pdfs please summarise summarize tell that the these this to what whats which
document documents deed judgment judgement case material content contents you your
something anything much little bit short overview simple simply kindly just now here
whole entire full complete briefly quickly again rest generally basically main key
points point summary gist recap tldr abstract synopsis outline elaborate
doc docs files report letter contract agreement invoice memo article thesis
slides deck attachment""".split()

# Kinds of question and of sentence in answer composition.
WANTS_VALUE = (
    r"\b(how much|how many|how long|how far|what rate|what percentage|what amount|when|by when|which date|what date|"
    r"what is the (?:rent|fee|amount|deposit|rate|penalty|interest|area|duration|term|period|notice|price|cost|charge|escalation|tax))\b"
)
WANTS_PERSON = r"\b(who|whom|whose|which party|by whom)\b"
OBLIGATION = r"(?i)\b(shall|must|is liable|is responsible|shall bear|shall pay|agrees to)\b"
INSTRUCTION = (
    r"(?i)^\s*(?:explain|define|describe|differentiate|distinguish|compare|state|list|discuss|derive|prove|compute|calculate|show|write|give|"
    r"justify|outline|summarise|summarize)\b"
)
INTERROGATIVE = r"(?i)^\s*(?:\(?[ivxlc]+\)?[.)]\s*)?whether\b"
ISSUE_MARKER = r"(?i)^\s*\(?(?:i{1,3}|iv|v|vi{1,3}|ix|x)\)"
EXAM_MARKS = r"(?i)\(\s*\d+\s*marks?\s*\)"
LEADING_NOISE = r"(?i)^(?:\s*(?:\(\s*\d+\s*marks?\s*\)|[•·‣▪●⁃∙]|\d+(?:\.\d+)*[.)]|\(\s*[a-z0-9ivxlc]+\s*\)))+\s*"

# Facts worth asking for.
NUMBER_WORD = (
    "(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|"
    "twenty-one|twenty-five|thirty|thirty-three|forty|fifty|sixty|seventy|seventy-five|eighty|ninety|hundred)"
)
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
FACTS = [
    ("money", r"(?i)(?:Rs\.?|INR|USD|\$|₹)\s?[\d,]+(?:\.\d+)?"),
    ("percent", rf"(?i)(?:\d+(?:\.\d+)?|{NUMBER_WORD})\s?(?:%|per\s+cent|percent)"),
    ("date", rf"(?i)\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b|\b{MONTH}\s+\d{{4}}\b"),
    ("duration", rf"(?i)\b(?:\d+|{NUMBER_WORD})\s*\(?\d*\)?\s*(?:days?|months?|years?|weeks?|hours?)\b"),
    ("number", r"\b\d[\d,]*(?:\.\d+)?\b"),
]
#: What each match of a pattern of FACTS has, in lower case; where nothing is named, a digit.
FACT_SIGNS = {"money": ["rs", "inr", "usd", "$", "₹"], "percent": ["%", "cent"], "date": [], "duration": ["day", "month", "year", "week", "hour"], "number": []}
DEFINITIONS = [
    (r"(?i)^(.{4,70}?)\s+(?:is|are)\s+defined as\s+(.+)$", "What is {}?"),
    (r"(?i)^(?:A|An|The)\s+(.{4,60}?)\s+is\s+(.+)$", "What is {}?"),
    (r"(?i)^(.{4,60}?)\s+means\s+(.+)$", "What does {} mean?"),
    (r"(?i)^(.{4,60}?)\s+states that\s+(.+)$", "What does {} state?"),
]

# Typographic characters and what stands for them.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
APOSTROPHES = "‘’‚‛′ʼʹ՚＇"
QUOTES = "“”„‟″«»＂"
SPACES = "               　"
DELETED = "­​‌‍﻿"

REFUSAL = "I could not find this in the indexed documents, so I will not guess. Try rephrasing with wording closer to the document, or ingest the PDF that covers it."

# Limits and weights.
PAGE_LINES = 40
CHUNK_WORDS, OVERLAP_LINES, MIN_CHUNK_WORDS = 140, 2, 12
HASH_DIM = 384
TOP_DENSE = TOP_LEXICAL = 20
TOP_FINAL = 5
RRF_K = 60
BM25_K1, BM25_B = 1.5, 0.75
MIN_SCORE, LOW_SCORE = 0.10, 0.35
GROUNDED = 0.42
OVERLAP_RATIO = 0.75
MAX_VARIANTS = 5
