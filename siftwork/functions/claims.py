"""Claims of an answer held against its context: what a claim has that can be looked up, and what the context says to it.

Each function sees whole texts. A context is read once: its sentences become windows with their words, so that all
claims of an answer are looked up in them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# --- fixed values: words that tell nothing, words that start questions, words for numbers, verbs of claims, parts of names in code ---
PLAIN_WORDS = (
    "about", "after", "again", "against", "also", "although", "among", "another", "before", "being", "between", "both", "could", "does", "doing", "done", "each", "either", "every", "first", "from", "have", "into",
    "just", "last", "like", "made", "make", "many", "more", "most", "much", "only", "other", "over", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those",
    "very", "were", "what", "when", "where", "which", "while", "with", "would", "yes", "sure", "okay", "actually", "believe", "call", "use", "run", "read", "write", "return", "update", "create", "delete",
)
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "whose", "is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "would")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
CLAIM_VERBS = ("is", "are", "was", "were", "has", "have", "had", "uses", "returns", "contains", "supports", "requires", "equals", "means", "runs", "fails")
CODE_MARKS = ("()", "_", "::")
CODE_PARTS = ("function", "method", "class ", "module ", "import ", ".py", ".rs", ".js", ".ts")
LEAST_WINDOW, TOP_WINDOWS = 900, 4
SUPPORT, CONTRADICTION, ADEQUACY = 0.62, 0.70, 0.72

_PLAIN = frozenset(PLAIN_WORDS)
_WORD = re.compile(r"\b[A-Za-z][A-Za-z0-9_-]{3,}\b")
_NUMBER = re.compile(r"\$?\d[\d,]*(?:\.\d+)?%?")
_NAMES = (re.compile(r'"([^"]{2,90})"'), re.compile(r"\b([A-Z][A-Z0-9]{1,})\b"), re.compile(r"\b([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*){0,4})\b"))
_VERB = re.compile(rf" (?:{'|'.join(CLAIM_VERBS)}) ")


def content_words(text: str) -> frozenset[str]:
    return frozenset(map(str.lower, _WORD.findall(text))) - _PLAIN


def numbers(text: str) -> list[str]:
    """Digits without separators and leading zeros, then the words for numbers that occur."""
    out = [n for m in _NUMBER.findall(text) if (n := re.sub("[,$%]", "", m))]
    said = set(re.findall("[a-z]+", text.lower()))
    return [n.lstrip("0") or "0" if n.isdigit() else re.sub(r"^0+(?=.)", "", n) for n in out] + [str(k) for k, w in enumerate(NUMBER_WORDS) if w in said]


def entities(text: str) -> list[str]:
    """Quoted names, capitals and capitalised phrases, once each whatever their case and marks."""
    found = [m.strip() for m in _NAMES[0].findall(text)] + _NAMES[1].findall(text)
    found += [m for m in map(str.strip, _NAMES[2].findall(text)) if len(m) >= 3 and m.lower() not in _PLAIN]
    once: dict[str, str] = {}
    for name in found:
        if key := "".join(c for c in name.lower() if c.isalnum()):
            once.setdefault(key, name)
    return list(once.values())


def sentences(text: str) -> list[tuple[int, str]]:
    """(place, sentence): cut at line ends, and at space after an end mark."""
    out, start = [], 0
    for cut in [*re.finditer(r"(?<=[.!?])\s|\n", text), None]:
        piece = text[start : cut.start() if cut else len(text)]
        if bare := piece.strip():
            out.append((start + piece.index(bare), bare))
        start = cut.end() if cut else start
    return out


def windows(text: str, most: int = LEAST_WINDOW) -> list[str]:
    """The sentences, long ones in pieces of so many characters; a text without any is a window itself."""
    pieces = [s[k : k + most].strip() for _, s in sentences(text) for k in range(0, len(s), most)]
    return [p for p in pieces or [text[:most]] if p]


def plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() or c in "_%'-." else " " for c in text.lower()).split())


def share(items, there) -> float:
    """The share of the items that are there; 0 without items."""
    items = list(items)
    return sum(map(there, items)) / len(items) if items else 0.0


class Lookup(NamedTuple):
    """What a claim has that can be looked up."""

    words: frozenset[str]
    names: list[str]
    numbers: list[str]


class Window(NamedTuple):
    """A stretch of a context, as it is looked up in."""

    text: str
    low: str
    words: frozenset[str]


def lookup(claim: str) -> Lookup:
    return Lookup(content_words(claim), entities(claim), numbers(claim))


def window(text: str) -> Window:
    return Window(text, text.lower(), content_words(text))


def coverage(claim: Lookup, w: Window) -> tuple[float, float, float]:
    """The shares of a claim's names, numbers and words that a window has."""
    return share(claim.names, lambda n: n.lower() in w.low), share(claim.numbers, lambda n: n in w.low), share(claim.words, w.words.__contains__)


def adequacy(claim: Lookup, covered: tuple[float, float, float]) -> float:
    """The weighted share of what can be looked up that is there."""
    weights = (0.45 if claim.names else 0.0, 0.35 if claim.numbers else 0.0, 0.20 if claim.names or claim.numbers else 1.0)
    return min(1.0, max(0.0, sum(w * c for w, c in zip(weights, covered, strict=True)) / sum(weights)))


def best_windows(claim: Lookup, context: list[Window], top: int = TOP_WINDOWS) -> tuple[list[Window], float]:
    """The windows that say most to a claim, and how adequate they are, one by one or together."""
    scored = []
    for w in context:
        covered = coverage(claim, w)
        enough = adequacy(claim, covered)
        scored.append((-(3 * covered[0] + 2 * covered[1] + covered[2] + enough), -enough, -len(w.text.encode()), w))
    chosen = sorted(scored, key=lambda s: s[:3])[:top]
    both = Window("", "\n".join(s[3].low for s in chosen), frozenset().union(*(s[3].words for s in chosen)))
    return [s[3] for s in chosen], max([adequacy(claim, coverage(claim, both)), *(-s[1] for s in chosen)])


def quote_support(context: str, claim: str) -> float:
    """By both texts in plain form."""
    return 0.0 if not claim or claim not in context else 0.95 if len(claim.encode()) > 80 else 0.82


def slot_support(claim: Lookup, context: Window, enough: float) -> float:
    """Only where all numbers and most names are in the context."""
    names, found, words = coverage(claim, context)
    if claim.numbers and found < 1 or claim.names and names < 0.65:
        return 0.0
    return min(0.25 + 0.35 * enough + 0.20 * words, 0.74)


def local_verdict(claim: Lookup, chosen: list[Window], enough: float, quote: float, slot: float) -> tuple[str, float]:
    """What the best windows say by themselves: by quotes, then numbers, then slots."""
    if quote >= 0.82:
        return "entailment", min(quote, 0.85)
    if claim.numbers and enough >= 0.72:
        given = set(numbers("\n".join(w.text for w in chosen)))
        if given.issuperset(claim.numbers):
            return "entailment", 0.68
        if given:
            return "contradiction", 0.66
    return ("entailment", 0.66) if enough >= 0.88 and slot >= 0.70 else ("neutral", 0.35)


class Certificate(NamedTuple):
    place: int
    claim: str
    kind: str
    label: str
    support: float
    contradiction: float
    adequacy: float
    risk: float


def certify(support: float, contradiction: float, enough: float) -> tuple[str, float]:
    if contradiction >= CONTRADICTION:
        return "contradicted", 0.92
    if support >= SUPPORT:
        return "grounded", max(0.35 * (1 - support), 0.05)
    return ("unsupported", 0.80) if enough >= ADEQUACY else ("unknown", 0.55)


def looks_like_code(text: str) -> bool:
    low = text.lower()
    return any(m in text for m in CODE_MARKS) or any(p in low for p in CODE_PARTS)


def is_question(text: str) -> bool:
    first = re.search("[A-Za-z]+", text)
    return text.strip().endswith("?") or bool(first) and first[0].lower() in QUESTION_WORDS


def is_claim(sentence: str) -> bool:
    """No question, no mark of code, and something that can be true or false."""
    s = sentence.strip()
    if len(s) < 2 or is_question(s) or s.startswith("```") or s.lower() in ("json", "python"):
        return False
    return looks_like_code(s) or bool(entities(s) or numbers(s)) or bool(_VERB.search(s.lower()))


def claim_kind(text: str) -> str:
    return "code_ref" if looks_like_code(text) else "quantity" if numbers(text) else "proposition"


def analyse(context: str, output: str) -> list[Certificate]:
    """A certificate for each sentence of an output that claims something."""
    parts = [window(w) for w in windows(context)]
    whole, norm = window(context), plain(context)
    out = []
    for place, text in sentences(output):
        if not is_claim(text):
            continue
        claim = lookup(text)
        chosen, enough = best_windows(claim, parts)
        quote, slot = quote_support(norm, plain(text)), slot_support(claim, whole, enough)
        local, sure = local_verdict(claim, chosen, enough, quote, slot)
        support = max(quote, slot, sure if local == "entailment" else 0.0)
        against = sure if local == "contradiction" else 0.0
        label, risk = certify(support, against, enough)
        out.append(Certificate(place, text, claim_kind(text), label, round(support, 4), round(against, 4), round(enough, 4), round(risk, 4)))
    return out


def profile_of(output: str) -> str:
    """code, summary or rag, by how an answer looks."""
    low = output.lower()
    if any(p in low for p in ("```", ".py", ".rs", "function", "class ")):
        return "code"
    return "summary" if len(output.encode()) > 900 or sum(x.lstrip().startswith("- ") for x in output.split("\n")) >= 3 else "rag"


def suppressed(c: Certificate, profile: str) -> bool:
    strict = profile in ("code", "rag", "qa", "benchmark_qa") or c.risk >= 0.75
    return {"contradicted": True, "unsupported": profile not in ("chat", "dialogue"), "unknown": strict}.get(c.label, False)


def rewrite(output: str, certificates: list[Certificate], mode: str, profile: str | None = None) -> str:
    """The answer under a policy: audit leaves it, annotate marks claims that would go, strict takes them out."""
    profile = profile or profile_of(output)
    gone = [c for c in certificates if suppressed(c, profile)]
    if mode == "audit" or not gone:
        return output
    out, at = [], 0
    for c in sorted(gone, key=lambda c: c.place):
        out.append(output[at : c.place])
        at = c.place + len(c.claim)
        out.append(f"{c.claim} [{c.label}]" if mode == "annotate" else "")
    return "".join([*out, output[at:]]).strip()


def longest_common(a: str, b: str) -> int:
    """The length in bytes of the longest run that both have, by a suffix automaton of the second."""
    x, automaton = a.encode(), SuffixAutomaton(b.encode())
    return max(automaton.matches(x), default=0)


class SuffixAutomaton:
    """All runs of bytes of a text, in states and links linear in its length."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in data:
            new = self._add(self.size[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] > self.size[p] + 1:
                    copy = self._add(self.size[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q], q = copy, copy
                self.link[new] = q
            else:
                self.link[new] = 0
            last = new

    def _add(self, size: int, edges: dict[int, int], link: int = 0) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def matches(self, data: bytes) -> list[int]:
        """For each byte the length of the longest run that ends there and that the text has."""
        out, state, n = [], 0, 0
        for c in data:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


CERTIFICATES = T.ArrayType(
    T.StructType(
        [T.StructField("place", T.IntegerType()), T.StructField("claim", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("label", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("support", "contradiction", "adequacy", "risk")]
    )
)


@pandas_udf(CERTIFICATES)
def certificates(contexts: pd.Series, outputs: pd.Series) -> pd.Series:
    return pd.Series([[c._asdict() for c in analyse(x or "", y or "")] for x, y in zip(contexts, outputs, strict=True)])


def rewritten(mode: str):
    @pandas_udf(T.StringType())
    def run(contexts: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else rewrite(y, analyse(x or "", y), mode) for x, y in zip(contexts, outputs, strict=True)], dtype=object)

    return run


annotated, strict = rewritten("annotate"), rewritten("strict")


@pandas_udf(T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())])))
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"place": p, "text": s} for p, s in sentences(t or "")])


@pandas_udf(T.ArrayType(T.StringType()))
def context_windows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: windows(t or ""))


@pandas_udf(T.DoubleType())
def longest_share(claims: pd.Series, contexts: pd.Series) -> pd.Series:
    """The share of a claim that the longest run it has in common with the context covers, whatever their case."""
    out = []
    for a, b in zip(claims, contexts, strict=True):
        a, b = (a or "").lower(), (b or "").lower()
        out.append(longest_common(a, b) / len(a.encode()) if a and b else 0.0)
    return pd.Series(out)


@pandas_udf(T.DoubleType())
def quoted_share(claims: pd.Series, contexts: pd.Series) -> pd.Series:
    """The share of a claim's characters that the longest run it has in common with the context covers, whatever their case."""
    out = []
    for a, b in zip(claims, contexts, strict=True):
        x, y = [ord(c) for c in (a or "").lower()], [ord(c) for c in (b or "").lower()]
        out.append(max(SuffixAutomaton(y).matches(x), default=0) / len(a) if x and y else 0.0)
    return pd.Series(out)
