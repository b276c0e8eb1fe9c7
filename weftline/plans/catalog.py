"""The catalog of checks: stage, category, the severities that a check can have, and its default evidence."""

from __future__ import annotations

from ..sources.inline import Inline

#: Prefix to (stage, category).
STAGES = {
    "ACC": ("reach", "access-discovery"),
    "REP": ("read", "representation-parity"),
    "ANS": ("extract", "answer-coverage"),
    "ENT": ("identify", "entity-consistency"),
    "FRS": ("trust", "freshness-consistency"),
    "OFF": ("cite", "offsite-visibility"),
    "REF": ("land", "referral-experience"),
}
#: Check to its severities.
CHECKS = {
    "ACC-ROBOTS-ROLE": "critical high", "ACC-ROBOTS-UNAVAILABLE": "high", "ACC-INDEX-CONTROL": "critical high", "ACC-NOARCHIVE-COPILOT": "high medium",
    "ACC-CANONICAL-CONFLICT": "high medium", "ACC-REDIRECT-LOOP": "high medium", "ACC-BOT-CHALLENGE": "high", "ACC-SITEMAP-ORPHAN": "medium low",
    "ACC-SITEMAP-INVALID": "medium", "ACC-HREFLANG-INCONSISTENT": "medium", "ACC-LLMS-TXT-ABSENT": "low", "ACC-LINK-ROT": "medium low", "ACC-FETCH-LATENCY": "high medium",
    "REP-KEY-FACT-LOSS": "high", "REP-STATE-ONLY-FACT": "medium", "REP-METADATA-CONTRAST": "medium", "REP-EXTRACTION-LOSS": "medium", "REP-NON-TEXT-LOCKIN": "high medium",
    "REP-TABLE-SEMANTICS": "medium", "REP-LINKS-SCRIPT-ONLY": "medium", "REP-HIDDEN-TEXT-SUSPECT": "medium",
    "ANS-QUESTION-UNANSWERED": "high medium low", "ANS-PASSAGE-INCOMPLETE": "medium low", "ANS-QUALIFIER-DETACHED": "medium low", "ANS-COMPARISON-UNREADABLE": "medium low", "ANS-BOILERPLATE-DROWNING": "medium low",
    "ENT-JSONLD-INVALID": "high medium", "ENT-STRUCTURED-VISIBLE-CONFLICT": "high", "ENT-NAME-INCONSISTENT": "medium low", "ENT-AMBIGUOUS-NAME": "medium low", "ENT-CORROBORATION-ABSENT": "medium",
    "FRS-LASTMOD-UNIFORM": "low", "FRS-CLAIM-CONFLICT": "high medium", "FRS-DATE-CONFLICT": "medium low", "FRS-IMPOSSIBLE-DATE": "medium", "FRS-STALE-VERSION": "medium low",
    "OFF-BRAND-ABSENT": "high medium low", "OFF-THIRD-PARTY-PREFERRED": "medium low", "OFF-FACT-STATED-WRONG": "high medium", "OFF-WRONG-ENTITY": "high medium",
    "REF-SOFT-404": "high", "REF-404-DEAD-END": "medium", "REF-PATH-DROP-REDIRECT": "high", "REF-COLLAPSED-ANSWER": "medium low", "REF-PERF-RISK": "low", "REF-OVERLAY-BLOCK": "medium", "REF-VIEWPORT-ABSENT": "medium low", "REF-FRAGMENT-UNSURVIVABLE": "medium low", "REF-ANSWER-NOT-CONFIRMED": "medium low",
}
SEVERITIES = ("critical", "high", "medium", "low")
EVIDENCE = {"ANS": "semantic-judgment", "OFF": "semantic-judgment", "FRS": "semantic-judgment"}

CATALOG = Inline(
    "catalog",
    "check_id string, stage string, category string, band string, evidence_quality string",
    tuple((c, *STAGES[c[:3]], band, EVIDENCE.get(c[:3], "direct-measurement")) for c, band in CHECKS.items()),
)
SURFACES = Inline("surfaces", "token string, role string", (
    ("OAI-SearchBot", "search-index"), ("Claude-SearchBot", "search-index"), ("PerplexityBot", "search-index"), ("Googlebot", "search-index"), ("Bingbot", "search-index"),
    ("GPTBot", "training"), ("ClaudeBot", "training"), ("CCBot", "training"), ("Google-Extended", "training"), ("ChatGPT-User", "user-fetch"), ("Claude-User", "user-fetch"), ("Perplexity-User", "user-fetch"),
))
