"""Question intent tagging (F32), as a batch job over a text column.

Off-topic hints are checked first; otherwise the intent whose matching phrase is
longest wins (the first intent / phrase in listed order on ties); otherwise
``unknown``. Matching is case-insensitive substring search over the whole text, in one
pass for any number of phrases: at each place of a text a single pattern, in which phrases
with a common beginning share it, finds the longest phrase that starts there.
A caller may give phrases and hints of their own.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must match the reference behaviour) -------------------------
KEYWORD_PHRASES = {
    "retention_overview": [
        "why is retention low", "why low retention",
        "retention dropping", "retention is dropping", "retention is going down",
        "retention bad", "retention is bad", "retention is low",
        "users not coming back", "churn",
    ],
    "where_users_drop": [
        "where do users drop", "where do they drop", "biggest drop",
        "funnel drop", "where are we losing", "dropoff",
    ],
    "top_events": [
        "top events", "most common events", "what are users doing",
        "what events", "biggest events",
    ],
    "growth_check": [
        "is growth", "are we growing", "dau", "users growing",
        "user growth", "active users",
    ],
    "aha_moment": [
        "aha moment", "what makes users retain", "what predicts retention",
        "magic moment", "key event",
    ],
}
OFF_TOPIC_HINTS = [
    "weather", "recipe", "joke", "movie", "music", "song", "stock", "crypto",
    "translate", "write me", "tell me a", "what's the news", "who is the",
    "capital of", "president of", "code for me", "fix my code",
]
# -----------------------------------------------------------------------------------


def _longest(words: Iterable[str]) -> str:
    """A pattern for the longest of ``words`` at one place; it never goes back over a shared beginning."""
    rest = defaultdict(set)
    ends = False
    for w in words:
        if w:
            rest[w[0]].add(w[1:])
        else:
            ends = True
    if not rest:
        return ""
    branches = "|".join(re.escape(c) + _longest(tails) for c, tails in sorted(rest.items()))
    return f"(?:{branches})" + ("?" if ends else "")


def intent_expr(text: Column, phrases: Mapping[str, Sequence[str]] = KEYWORD_PHRASES,
                off_topic: Sequence[str] = OFF_TOPIC_HINTS) -> Column:
    """The intent label of one question; phrases are in lower case, none is empty."""
    if not all(p for ps in (off_topic, *phrases.values()) for p in ps):
        raise ValueError("an empty phrase is in every text")
    # Hints first, then the longest phrase; listed order breaks ties (the first one seen wins).
    by_rank = [("off_topic", h) for h in off_topic] + sorted(
        ((intent, p) for intent, ps in phrases.items() for p in ps), key=lambda ip: -len(ip[1]))
    if not by_rank:
        return F.lit("unknown")
    rank: dict[str, int] = {}
    for i, (_, p) in enumerate(by_rank):
        rank.setdefault(p, i)
    # A phrase found at a place brings along those that are its own beginnings.
    best = {p: min(r for q, r in rank.items() if p.startswith(q)) for p in rank}
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?=({_longest(rank)}))"), F.lit(1))
    ranks = F.create_map(*[F.lit(x) for p, r in best.items() for x in (p, r)])
    first = F.array_min(F.transform(found, lambda p: ranks[p]))
    labels = F.array(*[F.lit(intent) for intent, _ in by_rank])
    return F.coalesce(F.get(labels, first), F.lit("unknown"))


def tag_intents(df: DataFrame, text_col: str = "text", out_col: str = "intent",
                phrases: Mapping[str, Sequence[str]] = KEYWORD_PHRASES,
                off_topic: Sequence[str] = OFF_TOPIC_HINTS) -> DataFrame:
    return df.withColumn(out_col, intent_expr(F.col(text_col), phrases, off_topic))
