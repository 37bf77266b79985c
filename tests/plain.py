"""Plain Python versions of what SQL cannot express."""

import re
import unicodedata
from difflib import SequenceMatcher


def normalized(text: str) -> str:
    ascii_only = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", ascii_only).split())


def title_score(ref: str, block: str) -> float:
    ref, block = normalized(ref), normalized(block)
    if not ref or not block:
        return 0.0
    if ref == block:
        return 1.0
    own, other = ({w for w in t.split() if len(w) >= 4} for t in (ref, block))
    overlap = len(own & other) / max(1, len(own))
    if ref in block or block in ref:
        overlap = max(overlap, 0.95)
    ratio = SequenceMatcher(None, ref, block).ratio()
    return max(ratio, 0.65 * ratio + 0.35 * overlap)


def author_score(authors: str, block: str) -> float:
    names = list(dict.fromkeys(n for a in authors.split(";") if (n := normalized(a.strip().split(",")[0]))))[:6]
    text = normalized(block)
    tokens = {w for w in text.split() if len(w) >= 3}
    parts = lambda n: [w for w in n.split() if len(w) >= 3]
    return sum(n in text or (bool(parts(n)) and set(parts(n)) <= tokens) for n in names) / len(names) if names else 0.0
