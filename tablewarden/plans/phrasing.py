"""Optional rephrasing of findings by a callable, behind guards; no model comes with this library."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from tablewarden.plans.findings import Finding

MOST_FINDINGS, SECONDS, SHORTEST, LONGEST = 15, 8.0, 10, 400
_ECHOES = ("rewrite the", "rephrase", "as an ai", "sentence:", "instruction")


def humanise(issue: str) -> str:
    return issue.replace("_", " ")


def first_sentence(text: str) -> str:
    text = text.strip().strip('"').strip()
    m = re.search(r"(?<=[^\s.][.!?])(?=\s|$)", text)
    return (text[: m.start()] if m else text.splitlines()[0] if text else "").strip()


def is_usable(text: str) -> bool:
    return SHORTEST <= len(text) <= LONGEST and not any(e in text.lower() for e in _ECHOES)


def leaks_code(text: str) -> bool:
    """Holds a word of small letters joined by underscores, as internal codes are."""
    return any("_" in w.strip("_") and w.strip("_").replace("_", "").isalpha() and w.islower() for w in re.findall(r"\w+", text))


def keeps_facts(text: str, finding: Finding) -> bool:
    """The percentage's whole part and, of any example, one of its sides survive."""
    numbers = re.findall(r"\d+", text)
    sides = [s.strip() for s in (finding.example or "").split(" vs ") if s.strip()]
    return str(int(finding.percentage)) in numbers and (not sides or any(s in text for s in sides))


def phrase(finding: Finding, model: Callable[[str], str] | None) -> str | None:
    """A checked rephrasing, or None to keep the template's sentence."""
    if model is None:
        return None
    try:
        text = first_sentence(model(f"Rewrite the sentence in plain words and keep every number and name: {finding.sentence}"))
    except Exception:  # a phrasing model must never fail a scorecard
        return None
    return text if is_usable(text) and not leaks_code(text) and keeps_facts(text, finding) else None


def phrase_all(findings: list[Finding], model: Callable[[str], str] | None, clock: Callable[[], float] = time.monotonic) -> None:
    """The first findings, until the time is spent; the clock is read before each."""
    start = clock()
    for f in findings[:MOST_FINDINGS] if model else ():
        if clock() - start > SECONDS:
            break
        f.phrased = phrase(f, model)
