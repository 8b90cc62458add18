"""Answers without filler, as column expressions over lines; code between fences is left alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: phrases that say nothing and what stands for them, in order; lines that say nothing; without regard to case ---
FILLER = (
    (r"^(?:Sure!?|Of course!?|Absolutely!?|Great question!?|Happy to help!?|I'd be happy to help\.?|Let me help you with that\.?|No problem!?|Certainly!?|You're welcome!?)\s*", ""),
    (r"^(?:Let me |I'll |I will |I'm going to |I can |I need to )(?:take a look|look at|review|examine|analyze|check|investigate)\b[^.]*\.\s*", ""),
    (r"^(?:Here(?:'s| is) (?:what|how|the|my|a|an)\b[^:]*:\s*)", ""),
    (r"\b(?:I think |I believe |It seems like |It looks like |It appears that |As far as I can tell,? |From what I can see,? |If I understand correctly,? )", ""),
    (r"^(?:Now,? |Next,? |Then,? |After that,? |Moving on,? |With that said,? |That being said,? |Having said that,? )(?:let(?:'s| us) )", ""),
    (r"(?:Let me know if (?:you (?:have|need)|there(?:'s| is)|that)\b[^.!]*[.!]?\s*$)", ""),
    (r"(?:Feel free to (?:ask|reach out|let me know)\b[^.!]*[.!]?\s*$)", ""),
    (r"(?:Hope (?:this|that) helps!?\s*$)", ""),
    (r"(?:Is there anything else\b[^.?!]*[.?!]?\s*$)", ""),
    (r"^(?:I see\.|I understand\.|Got it\.|Right\.|Okay\.)\s*", ""),
    (r"\bIn order to\b", "To"),
    (r"\bDue to the fact that\b", "Because"),
    (r"\bAt this point in time\b", "Now"),
    (r"\bFor the purpose of\b", "For"),
    (r"\bIn the event that\b", "If"),
    (r"\bWith regard to\b", "About"),
    (r"\bIt is important to note that\b", "Note:"),
    (r"\bAs (?:mentioned|noted|stated) (?:earlier|above|previously),?\s*", ""),
)
EMPTY_LINES = r"^(?:Sure(?:,| thing).*|I(?:'d| would) (?:be happy|love) to.*|Let me (?:know|explain|walk you through).*|(?:Here(?:'s| is) (?:a|the) (?:summary|breakdown|overview|explanation).*)|(?:To (?:summarize|recap|sum up):?.*)|(?:In (?:summary|conclusion):?.*))$"
ARTICLES = r"\b(?:the|a|an|just|simply|basically|essentially)\s+"
_SPACE = " \t\r"


def _line(line: Column, mode: str) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    short = reduce(lambda c, f: F.regexp_replace(c, "(?i)" + f[0], f[1]), FILLER[: 4 if mode == "lite" else None], bare)
    if mode == "ultra":
        short = F.regexp_replace(F.regexp_replace(short, ARTICLES, ""), r"\s{2,}", " ")
    short = F.btrim(short, F.lit(_SPACE))
    indent = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.when(bare == "", "").when(bare.rlike("(?i)" + EMPTY_LINES) | (short == ""), F.lit(None)).otherwise(F.concat(indent, short))


def prose(text: Column, mode: str = "full") -> Column:
    return F.array_join(F.array_compact(F.transform(F.split(text, "\n", -1), lambda x: _line(x, mode))), "\n")


def distilled(text: Column, mode: str = "full") -> Column:
    """A text without filler (lite: without pleasantries; ultra: without articles too); under 50 characters it stays."""
    parts = F.split(text, "```", -1)
    fenced = lambda k: (k % 2 == 1) & (k < F.size(parts) - 1)
    short = F.array_join(F.transform(parts, lambda p, k: F.when(fenced(k), p).otherwise(prose(p, mode))), "```")
    return F.when(F.length(text) < 50, text).otherwise(F.btrim(F.regexp_replace(short, "\n{3,}", "\n\n"), F.lit(_SPACE + "\n")))
