"""The words, limits, patterns and phrases the audit's results depend on."""

# --- limits -----------------------------------------------------------------------------------
THIN_PAGE_WORDS = 500
VERY_LOW_WORDS = 150
BLOCKED_STATUSES = [401, 403, 429, 503]
EXTRA_WORDS_TO_SWITCH = 100
EXCERPT_CHARS = 6000
LLMS_PREVIEW_CHARS = 800
ERROR_CHARS = 200
MAX_H1, MAX_H2, MAX_CTAS, MAX_FORMS, MAX_FIELDS = 5, 10, 25, 5, 15
MAX_CTA_CHARS = 60
MAX_CANDIDATES = 6
MAX_TURNS = 6
MAX_KEYWORDS, MIN_KEYWORDS = 5, 3
SUMMARY_CHARS = 700
ANALYST_NOTE_CHARS = 20000
LOG_LINES = 1500
RECENT_AUDITS = 6
TOP_PRIORITIES = 3
LOGIN_FAILURES, LOGIN_WINDOW_SECONDS = 5, 900
NOTE_SAVE_DELAY_MS = 700

# --- page types, in audit order: (key, label, link words, fallback paths) -----------------------
PAGE_TYPES = [
    ("pricing", "Pricing page",
     ["pricing", "fees", "rates", "plans", "cost"],
     ["/pricing", "/fees", "/plans", "/rates"]),
    ("compare", "Compare / calculator page",
     ["compare", "comparison", "calculator", "savings", " vs", "-vs-", "switch"],
     ["/compare", "/calculator", "/savings-calculator", "/pricing-calculator", "/switch"]),
    ("contact_sales", "Contact sales page",
     ["contact sales", "talk to sales", "contact-sales", "sales", "book a demo", "demo", "contact"],
     ["/contact-sales", "/sales", "/contact", "/demo", "/contact-us"]),
    ("signup", "Signup page",
     ["sign up", "signup", "sign-up", "get started", "register", "create account", "start free", "open account"],
     ["/signup", "/sign-up", "/register", "/get-started", "/start"]),
]

# --- patterns (Java regular expressions; U = Unicode classes) -----------------------------------
CTA_WORDS = (
    r"get started|start|sign ?up|join|try|free|demo|contact|talk|book|call|apply|"
    r"open (?:an )?account|create|request|quote|calculate|compare|see pricing|pricing|"
    r"switch|learn more|schedule|buy|subscribe|download"
)
CTA_PATTERN = rf"(?iU)\b(?:{CTA_WORDS})\b"
PRICE_PATTERN = (
    r"(?iU)[$€£]\s?\d[\d,.]*[kKmM]?\b|\b\d+(?:\.\d+)?\s?%"
    r"|\bper (?:month|transaction|user|seat|year)\b|/mo(?:nth)?\b"
)
CURRENCY_SIGNS = ["$", "€", "£"]
OBSERVATION_PATTERN = (
    r"(?sU)\*\*Observed:?\*\*:?\s*(.*?)\s*(?:→|->)\s*\*\*Why it matters:?\*\*:?\s*(.*?)"
    r"\s*(?:→|->)\s*\*\*Hypothesis to test:?\*\*:?\s*(.*)"
)
SCORE_PATTERN = (
    r"(?iUd)Impact:?\**\s*:?\s*(High|Med(?:ium)?|Low).*?Confidence:?\**\s*:?\s*(High|Med(?:ium)?|Low)"
    r".*?Speed:?\**\s*:?\s*(High|Med(?:ium)?|Low)"
)
ROOT_CAUSE_PATTERN = r"(?dU)Caused by \w+\((.*)\)\)?$"
VALID_HOST_PATTERN = r"^[a-z0-9.-]+\.[a-z]{2,}$"

# --- layers -------------------------------------------------------------------------------------
LAYER_TITLES = [
    "Layer 1 - Web Conversion",
    "Layer 2 - Paid Acquisition",
    "Layer 3 - Organic Search and AEO",
    "Layer 4 - Lifecycle and Post-Signup",
    "Layer 5 - Competitive Comparison",
]
LAYER_SHORT_NAMES = ["Web Conversion", "Paid Acquisition", "Organic & AEO", "Lifecycle", "Competitive"]
SCORE_LEVELS = {"High": 3, "Med": 2, "Low": 1}
SCORE_LETTERS = {"h": "High", "m": "Med", "l": "Low"}
EXIT_CODES = {"complete": 0, "out_of_credits": 2}

# --- report section words -----------------------------------------------------------------------
WORKING_WORDS = ["what's working", "what’s working", "working"]
OBSERVATION_WORDS = ["observation"]
PRIORITY_WORDS = ["priority"]
DATA_WORDS = ["data i", "data i’d", "before committing"]
SUMMARY_HEADINGS = ["summary|key findings|takeaways", "strength"]
NOT_RUN = "_Not run._"
NOT_COMPLETED = "could not be completed"

# --- response blocks ----------------------------------------------------------------------------
TOOL_CALL = "server_tool_use"
SEARCH_RESULT = "web_search_tool_result"
FETCH_RESULT = "web_fetch_tool_result"
TOOL_BLOCKS = [TOOL_CALL, SEARCH_RESULT, FETCH_RESULT]
DECLINED_MARK = "\n\n_(The model declined to complete this part of the audit.)_"
TRUNCATED_MARK = "\n\n_(Output truncated: max_tokens reached.)_"
WRITING_ACTIVITY = "Analyzing results and writing findings"
DEFAULT_COMPETITOR = "square"
# {rival} and {company} are filled per audit
FALLBACK_KEYWORDS = [
    "best payment processor for small business",
    "switch from {rival} payment processing",
    "interchange plus pricing",
    "lowest credit card processing fees",
    "{company} vs {rival}",
]

# --- phrases of the JavaScript-only findings ----------------------------------------------------
JS_LEAD_PRICING = "Pricing and other key content is"
JS_LEAD_OTHER = "Key content is"
JS_OBSERVED_1 = (
    "{lead} client-side injected via JavaScript. Visitors on slow connections or with JS disabled "
    "cannot see {details}."
)
JS_WHY_1 = "This creates conversion risk on first load."
JS_HYPOTHESIS_1 = (
    "Server-render (or pre-render) {shorts} on the {pages} so it is in the first HTML response; "
    "measure first-load bounce rate and pricing-to-signup conversion on mobile/slow-connection sessions before vs. after."
)
JS_OBSERVED_3 = "Key page content including {shorts} is JavaScript-rendered and not present in raw HTML."
JS_WHY_3 = (
    "This means AI crawlers, search engine bots, and tools like ChatGPT and Perplexity cannot reliably "
    "index this content. Any query asking about pricing or features will return outdated or "
    "third-party sourced figures rather than the live page content."
)
JS_HYPOTHESIS_3 = (
    "Ship {shorts} in the raw HTML (SSR/static rendering) and mirror key figures in llms.txt; re-run the "
    "same AI answer-engine probes and track whether answers quote the live figures and cite the company's own URLs."
)
JS_FOOTER = (
    "_Automated check - detected by comparing a plain HTTP fetch with a headless-browser render. {evidence}._"
)
JS_NOTES = "## Automated check: JavaScript-rendered content ({kind})\n\n{observed} {why}\n\n{footer}"
JS_BULLET = "- **Observed:** {observed} → **Why it matters:** {why} → **Hypothesis to test:** {hypothesis}"

# --- phrases of the report frame ----------------------------------------------------------------
REPORT_CHANNELS = (
    "Web conversion (homepage, pricing, compare/calculator, contact sales, signup), "
    "paid search, organic search, AI answer engines (AEO), lifecycle / signup flow, competitive positioning"
)
REPORT_METHOD = (
    "Public pages only; no accounts created and no forms submitted. Paid-search "
    "findings are limited to what is publicly observable and are labelled OBSERVED vs INFERRED."
)
FIELD_NOTES_HEADING = "## 6. Analyst Field Notes"
FIELD_NOTES_INTRO = "_Live observations added by the analyst, not AI-generated._"

# --- characters Python's str.strip()/split() treat as white space, and its line boundaries -------
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0          "
    "      　"
)
PY_SPACE_CLASS = r"[\s\x1c-\x1f]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
OTHER_LINE_BREAKS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
