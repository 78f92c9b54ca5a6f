"""Text comparison that Spark's expressions can't state: word error rate, longest common substring, best window."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

_WORD = re.compile(r"[a-z0-9']+")


def bare(text: str | None) -> str:
    """Without white space, in lower case."""
    return "".join((text or "").split()).lower()


def word_error_rate(ref: str | None, hyp: str | None) -> float:
    """Edits between the Latin words of two texts over the words of the first; 0 or 1 if that has none."""
    r, h = _WORD.findall((ref or "").lower()), _WORD.findall((hyp or "").lower())
    if not r:
        return 1.0 if h else 0.0
    row = list(range(len(h) + 1))
    for i, a in enumerate(r, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(h, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1] / len(r)


def overlap(text: str | None, prompt: str | None) -> float:
    """Length of the longest common substring of two letters at least, over the text's length; by bisection over lengths."""
    t, p = bare(text), bare(prompt)
    if not t or not p:
        return 0.0

    def common(n: int) -> bool:
        have = {t[i : i + n] for i in range(len(t) - n + 1)}
        return any(p[i : i + n] in have for i in range(len(p) - n + 1))

    low, high = 0, min(len(t), len(p))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if common(mid) else (low, mid - 1)
    return low / len(t) if low >= 2 else 0.0


# Phrases that recognisers are known to invent.
BANNED = ("讨论科技、气候、河流与历史", "讨论科技、气候、河流", "科技、气候、河流与历史")


def hallucinated(text: str | None, prompt: str | None, banned: tuple[str, ...] = BANNED, most: float = 0.45) -> tuple[bool, float, str]:
    """Does a transcript hold a banned phrase, repeat its prompt, or repeat itself in the prompt's words? With the score and
    the first reason that holds."""
    t, p = bare(text), bare(prompt)
    if (said := next((b for b in banned if bare(b) and bare(b) in t), None)) is not None:
        return True, 1.0, f"banned:{said[:24]}"
    share = overlap(text, prompt)
    if p and share >= most:
        return True, share, "prompt_overlap"
    parts = (p[i : i + n] for n in (8, 6, 4) if n * 4 > len(t) for i in range(len(p) - n + 1)) if len(t) >= 12 else ()
    if (said := next((x for x in parts if t.count(x) >= 2), None)) is not None:
        return True, 0.9, f"repeat:{said}"
    return False, share, "ok"


def hinted(text: str | None, hint: str | None, least: float = 0.55, most: float = 0.92) -> str | None:
    """Each phrase of the hint replaces the window of the text that is most like it, if it is like it but not the same."""
    if not text or not hint:
        return text
    for phrase in re.split(r"[，,、；;。\s]+", hint):
        p, t = bare(phrase), bare(text)
        if len(p) < 4 or p in t:
            continue
        best, span = 0.0, (0, 0)
        match = SequenceMatcher(autojunk=False)
        match.set_seq2(p)
        for i in range(len(t) - 2):
            for n in range(max(len(p) - 2, 3), min(len(p) + 3, len(t) - i) + 1):
                match.set_seq1(t[i : i + n])
                if match.real_quick_ratio() > best and match.quick_ratio() > best and (r := match.ratio()) > best:
                    best, span = r, (i, i + n)
        if least <= best < most:
            places = [k for k, c in enumerate(text) if not c.isspace()]
            text = text[: places[span[0]]] + phrase + text[places[span[1] - 1] + 1 :]
    return text
