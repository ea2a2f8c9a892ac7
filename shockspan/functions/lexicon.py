"""Keyword lists for audiences, event types, regions and question intents.

Fixed values, in the order in which they are tried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

AUDIENCES = {
    "insurer": ["insur", "actuar", "underwrite", "reinsur"],
    "investor": ["investor", "portfolio", "real estate fund", "analyst", "fund manager"],
    "policymaker": ["mayor", "planner", "policy", "city council", "government", "agency director", "official"],
    "employer": ["owner", "employer", "ceo", "hr ", "hiring manager", "workforce manager", "operations manager"],
}
KNOWN_AUDIENCES = ["worker", "employer", "policymaker", "investor", "insurer", "unknown"]

STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "DC", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH",
    "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

EVENT_WORDS = [
    ("hurricane", "hurricane"),
    ("flood", "flood"),
    ("wildfire", "fire"),
    ("fire", "fire"),
    ("tornado", "tornado"),
    ("earthquake", "earthquake"),
    ("storm", "severe_storm"),
    ("severe storm", "severe_storm"),
]

REGIONS = {
    "southeast": ["FL", "GA", "NC", "SC", "VA", "AL", "MS", "TN"],
    "gulf_coast": ["FL", "LA", "TX", "MS", "AL"],
    "midwest": ["IL", "IN", "MI", "MN", "MO", "OH", "WI"],
    "west_coast": ["CA", "OR", "WA"],
    "northeast": ["NY", "PA", "MA", "CT", "RI"],
    "southwest": ["AZ", "TX", "NM", "CO", "UT"],
}

TOP_RANK = [
    "top 10", "top 5", "top ten", "top five", "top cities", "top states", "top sectors", "rank", "ranked", "ranking",
    "which sectors recover fastest", "which sectors recover slowest", "fastest recovery", "slowest recovery",
    "most at risk", "highest risk", "least risk", "safest sector", "compare sectors", "sector comparison",
]
TOP_RANK_ALSO = ["city", "state", "combined", "overall", "weighted", "10", "5", "ten", "five"]
SECTOR_RANK = [
    "which sector", "which industry", "recover fastest", "recover slowest", "recover quickest", "quickest recovery",
    "worst hit", "hardest hit", "most affected", "least affected", "bounce back",
]
PORTFOLIO = [
    "portfolio", "southeast", "gulf coast", "west coast", "midwest", "northeast", "across our", "across states",
    "multiple states", "all states", "real estate holdings", "our properties", "our exposure",
]
VARIANCE = [
    "variance", "reliable", "reliability", "confidence", "uncertain", "how accurate", "least reliable", "most reliable",
    "how sure", "how certain", "prediction accuracy", "model accuracy",
]
DEMAND_SURGE = [
    "gain workers", "gain jobs", "gaining jobs", "hiring", "increase jobs", "which sectors grow", "which sectors hire",
    "opportunity after", "benefit from disaster", "boom after", "construction boom", "who benefits", "which jobs increase",
]
PREPOSITION = [
    "pre-position", "preposition", "where should we", "deploy resources", "prioritize retraining", "where to focus",
    "resource allocation", "intervention priority", "forecast risk", "next 18 months", "next year risk", "upcoming risk",
    "prepare for",
]


@dataclass(frozen=True)
class Lexicon:
    """The lists that routing uses; replaceable as a whole or in part."""

    audiences: dict[str, list[str]] = field(default_factory=lambda: AUDIENCES)
    states: list[str] = field(default_factory=lambda: STATE_CODES)
    event_words: list[tuple[str, str]] = field(default_factory=lambda: EVENT_WORDS)
    default_event: str = "hurricane"
    regions: dict[str, list[str]] = field(default_factory=lambda: REGIONS)
    top_rank: list[str] = field(default_factory=lambda: TOP_RANK)
    top_rank_also: list[str] = field(default_factory=lambda: TOP_RANK_ALSO)
    sector_rank: list[str] = field(default_factory=lambda: SECTOR_RANK)
    portfolio: list[str] = field(default_factory=lambda: PORTFOLIO)
    variance: list[str] = field(default_factory=lambda: VARIANCE)
    demand_surge: list[str] = field(default_factory=lambda: DEMAND_SURGE)
    preposition: list[str] = field(default_factory=lambda: PREPOSITION)
