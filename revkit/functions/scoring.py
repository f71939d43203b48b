"""Review-comment scoring (J1-J13) as native column expressions.

Every count is a regex count over the message; every score keeps the
reference's operation order so the doubles come out bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit.functions.text import count_sub, rcount

# Patterns and term lists of the comment scorer (RE2 syntax).
FILE_MENTION = r"(?i)[\/\\]?[\w-]+\.(py|js|go|java|cpp|ts|jsx|tsx)"
CODE_ELEMENT = r"(?i)(class|function|method|variable|import|module)\s+\w+"
TECHNICAL_TERMS = [
    "performance", "security", "scalability", "maintainability",
    "testing", "edge case", "error handling", "validation",
    "documentation", "optimization", "dependency", "interface",
]
BULLET = r"(?m)^[\s]*[•\-\*]\s"
NUMBERED = r"(?m)^[\s]*\d+[\.)]\s"
EXPLANATION = r"because|since|as|therefore|consequently|this means|in order to|which leads to|resulting in"
CODE_SPAN = r"```[^`]*```|`[^`]+`"
COMPARATIVE = r"instead of|rather than|compared to|current|suggested|alternative|better approach|improvement"
SENTENCE_SPLIT = r"[.!?]+\s+|\n"
SUGGESTION = r"(?i)suggest|consider|recommend|try|could|should|need to|must|important to|better to|preferable|advised"
INLINE_CODE = r"`[^`]+`"
BLOCK_CODE = r"```[^`]*```"
ACTION_ITEM = (
    r"(?i)(?:^|\n)\s*(?:\d+[.)\s]+|\*\s+|[-•]\s+)(?:.*?(?:move|add|remove|refactor|rename|extract|inline|implement|fix|update|change|simplify|optimize|delete|rewrite|convert|prevent|handle|include|exclude|ensure|verify|check|confirm|validate)[^.!?\n]*)"
)
TODO_MARKER = r"(?i)TODO:|FIXME:|BUG:|ISSUE:"
IMPLEMENTATION = (
    r"(?i)implement using|change to|replace with|switch to|move from|convert to|transform into|use the|apply the|following syntax|pattern|approach"
)
EMPTY_RECOMMENDATION = "No review comment provided. Please add detailed comments about the code."
DEFAULT_ASPECTS = ("Thoroughness", "Clarity", "Actionability")

# Whitespace as Go's strings.Fields sees it (unicode.IsSpace), for word counts.
_BLANKS = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_FIELD = f"[^{_BLANKS}]+"
#: More than LONG_SENTENCE words, in one pass that stops at the first one too many
#: and collects none. Runs of ASCII are taken as one piece.
LONG_SENTENCE = 25
_LONG = f"\\A[{_BLANKS}]*+(?:(?:[!-~]++|[^{_BLANKS}])++[{_BLANKS}]++){{{LONG_SENTENCE}}}+[^{_BLANKS}]"
#: As many matches as FILE_MENTION, which end at the same characters, but each starts
#: at the last character of the name, so no name is read again from each of its characters.
_FILE_ENDING = r"(?i)[\w-]\.(py|js|go|java|cpp|ts|jsx|tsx)"


def _d(c: Column) -> Column:
    return c.cast("double")


def features(m: Column) -> dict[str, Column]:
    """Raw counts behind the three aspect scores."""
    low = F.lower(m)
    sentences = F.split(m, "(?d)[.!?]+[\\t\\n\\f\\r ]+|\\n", -1)
    return {
        "file_refs": rcount(m, _FILE_ENDING),
        "code_elements": rcount(m, CODE_ELEMENT),
        "technical_terms": sum((F.contains(low, F.lit(t)).cast("int") for t in TECHNICAL_TERMS), F.lit(0)),
        "paragraphs": count_sub(m, "\n\n") + 1,
        "list_items": rcount(m, BULLET) + rcount(m, NUMBERED),
        "explanations": rcount(low, EXPLANATION),
        "code_spans": rcount(m, CODE_SPAN),
        "comparatives": rcount(low, COMPARATIVE),
        "long_sentences": F.size(F.filter(sentences, lambda s: (F.octet_length(s) > 2 * LONG_SENTENCE) & s.rlike(_LONG))),
        "suggestions": rcount(m, SUGGESTION),
        "inline_code": rcount(m, INLINE_CODE),
        "block_code": rcount(m, BLOCK_CODE),
        "action_items": rcount(m, ACTION_ITEM),
        "todo_items": rcount(m, TODO_MARKER),
        "implementation": rcount(m, IMPLEMENTATION),
    }


def thoroughness(m: Column, f: dict[str, Column] | None = None) -> Column:
    """J1."""
    f = f or features(m)
    score = (
        F.lit(30.0)
        + F.least(_d(f["file_refs"]) * 10.0, F.lit(20.0))
        + F.least(_d(f["code_elements"]) * 5.0, F.lit(15.0))
        + F.least(_d(f["technical_terms"]) * 5.0, F.lit(25.0))
    )
    return F.when(m == "", F.lit(0.0)).otherwise(F.least(score, F.lit(100.0)))


def clarity(m: Column, f: dict[str, Column] | None = None) -> Column:
    """J4."""
    f = f or features(m)
    structure = F.least(_d(f["paragraphs"]) * 0.7, F.lit(2.0))
    listing = F.least(_d(f["list_items"]) * 0.5, F.lit(2.0))
    score = (
        F.greatest(structure, listing)
        + F.least(_d(f["explanations"]) * 0.8, F.lit(2.5))
        + F.least(_d(f["code_spans"]) * 1.0, F.lit(2.5))
        + F.least(_d(f["comparatives"]) * 0.5, F.lit(1.5))
        + (F.lit(1.5) - F.least(_d(f["long_sentences"]) * 0.5, F.lit(1.5)))
    )
    return score / 10.0 * 100.0


def actionability(m: Column, f: dict[str, Column] | None = None) -> Column:
    """J10."""
    f = f or features(m)
    score = (
        F.least(_d(f["suggestions"]) * 0.6, F.lit(2.5))
        + F.least(_d(f["inline_code"]) * 0.7 + _d(f["block_code"]) * 1.5, F.lit(3.0))
        + F.least(_d(f["action_items"]) * 0.8 + _d(f["todo_items"]) * 1.0, F.lit(2.5))
        + F.least(_d(f["implementation"]) * 0.6, F.lit(2.0))
    )
    return score / 10.0 * 100.0


def aspect_selected(aspects: Column, name: str) -> Column:
    """Aspect list entries compared lower-cased, untrimmed."""
    return F.exists(aspects, lambda a: F.lower(a) == name)


def overall(m: Column, t: Column, c: Column, a: Column) -> Column:
    """J12 from the three aspect scores (mean of the positive ones, floor 30
    for comments of more than ten space-separated pieces)."""
    n = sum((F.when(x > 0, 1).otherwise(0) for x in (t, c, a)), F.lit(0))
    total = F.when(t > 0, t).otherwise(F.lit(0.0)) + F.when(c > 0, c).otherwise(F.lit(0.0)) + F.when(a > 0, a).otherwise(F.lit(0.0))
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    pieces = count_sub(m, " ") + 1
    return F.when(m == "", F.lit(0.0)).when((pieces > 10) & (mean < 30), F.lit(30.0)).otherwise(mean)


def recommendations(m: Column) -> Column:
    return F.when(m == "", F.array(F.lit(EMPTY_RECOMMENDATION))).otherwise(F.array().cast("array<string>"))


def quality_band(score: Column) -> Column:
    """B11."""
    return F.when(score >= 85, F.lit("🟢")).when(score >= 70, F.lit("🟡")).otherwise(F.lit("🔴"))
