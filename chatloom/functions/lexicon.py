"""Feedback lexicon: the single source for the Spark columns and the SQL text.

Each family is a list of patterns. A pattern counts once per text when it
matches anywhere as a whole word/phrase of the lower-cased text.  "Whole word"
uses Unicode word characters (letters, numbers, underscore) so every engine
(JVM regex, RE2, Python ``re``) draws the same boundary; all alternatives begin
and end with a word character, so the explicit boundary classes below are
equivalent to a Unicode-aware ``\\b`` on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These lists must equal the reference rule set exactly.
# ---------------------------------------------------------------------------
STRONG_POSITIVE = [
    r"thank(?:s| you)|perfect|excellent|amazing|brilliant|fantastic",
    r"exactly what i (?:wanted|needed)",
    r"love it|nailed it|spot on",
]
STRONG_NEGATIVE = [
    r"no+|wrong|incorrect|bad|awful|terrible",
    r"stop|don't do that|never do",
    r"try again|redo|not (?:right|correct|what i)",
]
MODERATE_POSITIVE = [
    r"good|great|nice|helpful|useful|appreciate",
    r"yes|correct|right|ok|okay",
]
MODERATE_NEGATIVE = [
    r"not (?:good|great|helpful|right)",
    r"issue|problem|error|mistake|fix|change",
]
INSTRUCTION = [
    r"always|never|remember|don't forget",
    r"important|crucial|critical|essential",
    r"from now on|going forward|in the future",
    r"prefer|want|need|should|must",
]
# Phrases that make a clearly-scored message a standing directive (golden rule 3).
DIRECTIVE_PHRASES = [
    "from now on",
    "going forward",
    "in the future",
    "always do",
    "never do",
    "remember to",
]
# ---------------------------------------------------------------------------

FAMILIES = {
    "strong_pos": STRONG_POSITIVE,
    "strong_neg": STRONG_NEGATIVE,
    "mod_pos": MODERATE_POSITIVE,
    "mod_neg": MODERATE_NEGATIVE,
    "instruction": INSTRUCTION,
}

_NON_WORD = r"[^\p{L}\p{N}_]"


def bounded(pattern: str) -> str:
    """Whole-word form of one pattern (same text works in JVM regex and RE2)."""
    return f"(?:^|{_NON_WORD})(?:{pattern})(?:$|{_NON_WORD})"


def _top_level_alternatives(pattern: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in pattern:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    return parts


def required_literals(pattern: str) -> list[str] | None:
    """Substrings of which every match of ``pattern`` contains at least one.

    Each top-level alternative contributes its literal prefix (up to the first
    group or metacharacter; a character made optional by ``?``/``*`` is dropped).
    Returns None when some alternative has no literal prefix (no prefilter).
    """
    lits = []
    for alt in _top_level_alternatives(pattern):
        lit = ""
        for i, ch in enumerate(alt):
            if ch in "()[]{}.\\^$|":
                break
            if ch in "?*":
                lit = lit[:-1]
                break
            if ch == "+":
                break
            lit += ch
        if not lit:
            return None
        lits.append(lit)
    return lits


def family_count(lower_text: Column, family: str) -> Column:
    """Number of patterns of ``family`` that match ``lower_text`` at least once.

    Each regex runs only when the text contains one of the literals every match
    needs (plain substring search), so texts without feedback words skip it.
    """
    terms = []
    for p in FAMILIES[family]:
        hit = lower_text.rlike(bounded(p))
        lits = required_literals(p)
        if lits:
            maybe = None
            for lit in lits:
                c = lower_text.contains(lit)
                maybe = c if maybe is None else (maybe | c)
            hit = F.when(maybe, hit).otherwise(F.lit(False))
        terms.append(hit.cast("int"))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def sql_family_count(lower_sql: str, family: str) -> str:
    """DuckDB SQL text for ``family_count`` (used only by the oracle)."""
    parts = [
        f"CAST(regexp_matches({lower_sql}, '{_sql_quote(bounded(p))}') AS INTEGER)"
        for p in FAMILIES[family]
    ]
    return "(" + " + ".join(parts) + ")"


def directive_hit(lower_text: Column) -> Column:
    cond = None
    for phrase in DIRECTIVE_PHRASES:
        c = F.instr(lower_text, phrase) > 0
        cond = c if cond is None else (cond | c)
    return cond


def sql_directive_hit(lower_sql: str) -> str:
    return "(" + " OR ".join(f"contains({lower_sql}, '{_sql_quote(p)}')" for p in DIRECTIVE_PHRASES) + ")"


def _sql_quote(s: str) -> str:
    return s.replace("'", "''")
