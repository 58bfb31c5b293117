"""Phrases to patterns: rule tables list plain words, and these functions say how Hebrew text may carry them.

A word may have up to two one-letter prefixes (and, the, in, to, from, as, that). A word that ends in ``*`` may go on. Words
of a phrase stand side by side, and a phrase neither begins nor ends inside a word. A pattern knows which letters a text must hold to match
(``needs``), so that most texts are passed over by a search for a few plain strings.
"""

from __future__ import annotations

import re

PREFIX_LETTERS, MOST_PREFIXES = "ושהבלמכ", 2
PREFIX = f"[{PREFIX_LETTERS}]{{0,{MOST_PREFIXES}}}"
QUOTES = str.maketrans({'"': '["״”]', "'": "['׳’]"})


class Pattern(str):
    """A pattern with ``needs``: plain patterns that are all found in every text in which it is found; none if that is not known."""

    needs: tuple[str, ...]

    def __new__(cls, text: str, needs: tuple[str, ...] = ()):
        out = super().__new__(cls, text)
        out.needs = needs
        return out


def _needs(*patterns: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for p in patterns for n in getattr(p, "needs", ())))


def _stem(word: str) -> str:
    """The longest run of a word that stands in the text as it is."""
    return max(re.split(r"[\"'*]+", word), key=len)


def _one_of(stems: set[str]) -> str:
    """A search for any of the stems, without those that hold another."""
    kept = sorted(s for s in stems if not any(t != s and t in s for t in stems))
    return "|".join(re.escape(s) if s.lower() == s.upper() else f"(?iu:{re.escape(s)})" for s in kept)


def _word(word: str) -> str:
    return PREFIX + re.escape(word.rstrip("*")).translate(QUOTES) + (r"\p{L}*" if word.endswith("*") else "")


def any_of(*phrases: str) -> str:
    """One of the phrases, the longest first."""
    told = (r"\s+".join(map(_word, p.split())) for p in sorted(phrases, key=len, reverse=True))
    ends = [{_stem(p.split()[at]) for p in phrases} for at in (0, -1)]  # each phrase's first word, and its last
    return Pattern(rf"(?iu)(?<!\p{{L}})(?:{'|'.join(told)})(?!\p{{L}})", tuple(dict.fromkeys(_one_of(e) for e in ends if e and all(e))))


def one_sentence(*patterns: str) -> str:
    """A sentence or line that states all of the patterns, in any order."""
    return Pattern(r"(?:^|(?<=[.\n]))" + "".join(rf"(?=[^.\n]*{p})" for p in patterns), _needs(*patterns))


def then(first: str, second: str, most: int = 60) -> str:
    """The first pattern and behind it, in the same sentence and within ``most`` characters, the second."""
    return Pattern(rf"(?:{first}[^.\n]{{0,{most}}}{second})", _needs(first, second))


def near(one: str, other: str, most: int = 60) -> str:
    """Both patterns in one sentence, in either order, within ``most`` characters."""
    return Pattern(f"(?:{then(one, other, most)}|{then(other, one, most)})", _needs(one, other))


def either(*patterns: str) -> str:
    known = [_needs(p) for p in patterns]
    return Pattern(f"(?:{'|'.join(patterns)})", ("|".join(dict.fromkeys(min(n, key=len) for n in known)),) if all(known) else ())
