"""Ordered rules (name, pattern) matched against text: personal data, intents, declined answers, secrets.

Patterns are written in the common part of Java's and RE2's syntax, so that the same rule runs in Spark and in the SQL it is
checked with. A match is not part of a longer word or number: in Spark by looking around it; RE2 can't, so the SQL matches the characters
around it too (and replaces twice, as neighbours share them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSONAL = (
    ("pan", r"(?:[A-Za-z]{5}[0-9]{4}[A-Za-z])"),
    ("aadhaar", r"(?:(?:[0-9]{4}[ -]?){2}[0-9]{4}|(?:[Xx]{4}[ -]?){2}[0-9]{4})"),
    ("email", r"(?:[0-9A-Za-z_.+-]+@[0-9A-Za-z-]+\.[0-9A-Za-z.-]*[0-9A-Za-z])"),
    ("phone", r"(?:(?:\+?91[ -]?)?[6-9][0-9]{4}[ -]?[0-9]{5})"),
    ("otp", r"(?:(?i:otp|one.time pass(?:word|code)|verification code|passcode|secure code) *(?:(?i:is|was)|[:-])? *[0-9]{4,6})"),
    ("account_number", r"(?:(?i:folio|account|customer|demat) *(?:(?i:no\.?|number)|#)? *(?:(?i:is|was)|[:-])? *[0-9]{7,})"),
    ("long_number", r"(?:[0-9]{7,})"),
)
INTENTS = (
    ("advice", r"(?i:should (?:i|we|one)|recommend|suggest|advise|(?:good|right|best) time to (?:buy|invest|sell)|worth (?:buying|investing)|best (?:fund|scheme)s?|can i (?:buy|sell|invest))"),
    ("returns", r"(?i:(?:best|highest|lowest|compare|predict|forecast|expected|future|guaranteed)[^.?]*returns?|(?:will|would|could) (?:i|we|it|they) (?:get|earn|make|gain))"),
)
#: Own wording: a reply declines when it denies a verb of knowing or telling, says that something is not there, or names missing data.
_DENIED = r"(?:do(?:es)? not|don'?t|doesn'?t|did(?: not|n'?t)|can ?not|can'?t|could(?: not|n'?t)|(?:un|not )able to)"
DECLINED = (
    rf"(?i:{_DENIED} (?:[a-z]+ )?(?:know|find|locate|tell|say|answer|determine|confirm|contain|include|mention|state|cover|provide)"
    r"|(?:is|are|was|were)(?: not|n'?t) (?:[a-z]+ )?(?:available|mentioned|stated|specified|given|found|provided|covered|in the context)"
    r"|(?:there (?:is|are) no|no|not enough|insufficient) (?:[a-z]+ )?(?:information|data|details?|mention|figures?|answer)"
    r"|^not (?:available|mentioned|specified|stated|found|provided)|insufficient)"
)
SECRET = r"(?:sk-|gsk_|ghp_|xox[bp]-|AIza|hf_|AKIA)[0-9A-Za-z_-]{16,}"


def alone(pattern: str) -> str:
    return rf"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def alone_sql(pattern: str) -> str:
    return literal(rf"(^|[^0-9A-Za-z_])(?:{pattern})($|[^0-9A-Za-z_])")


def matches(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Names of the rules that match, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(alone(p)), F.lit(n)) for n, p in rules)))


def matches_sql(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, {alone_sql(p)}) THEN '{n}' END" for n, p in rules) + "], lambda x: x IS NOT NULL)"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def redact(text: Column, rules: tuple[tuple[str, str], ...] = PERSONAL, mark: str = "[redacted]") -> Column:
    """Every match of every rule, in the rules' order, replaced by ``mark``."""
    for _, p in rules:
        text = F.regexp_replace(text, alone(p), mark)
    return text


def redact_sql(text: str, rules: tuple[tuple[str, str], ...] = PERSONAL, mark: str = "[redacted]") -> str:
    for _, p in rules:
        for _ in range(2):
            text = f"regexp_replace({text}, {alone_sql(p)}, '\\1{mark}\\2', 'g')"
    return text


def verdict(text: Column) -> Column:
    """pii, advice, returns or allow: the first that applies; blank texts are allowed."""
    out = F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "allow").when(F.size(matches(text, PERSONAL)) > 0, "pii")
    for name, p in INTENTS:
        out = out.when(text.rlike(alone(p)), name)
    return out.otherwise("allow")


def verdict_sql(text: str) -> str:
    personal = " OR ".join(f"regexp_matches({text}, {alone_sql(p)})" for _, p in PERSONAL)
    intents = " ".join(f"WHEN regexp_matches({text}, {alone_sql(p)}) THEN '{n}'" for n, p in INTENTS)
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN 'allow' WHEN {personal} THEN 'pii' {intents} ELSE 'allow' END"
