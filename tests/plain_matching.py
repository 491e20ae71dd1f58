"""Scores of pairs in plain Python, which the columns of operators/pairing.py must equal."""

from collections import Counter
from difflib import SequenceMatcher

import numpy as np

from folioscope.functions.matching import Person, person, title_key

TITLE_SHARE, WORD_SHARE = 0.75, 0.65
CONTAINED_SCORE, CONTAINED_LENGTH = 0.96, 1.35
CLOSE_NAME = 0.65


def joined(p: Person) -> str:
    return p.family.replace(" ", "")


def fits(a: Person, b: Person) -> bool:
    """Whether given words agree: they are equal, or one is the other's initial."""
    short, long = sorted((a.given, b.given), key=len)
    return short != "" and (short == long or (len(short) == 1 and long[0] == short))


def likeness(a: Person, b: Person) -> float:
    """1 for one surname and given words that agree; else the share of words with a partner, if a whole word has one.

    A word's partner is an equal word, else an initial of the other name that no equal word takes.
    """
    if not a.words or not b.words:
        return 0.0
    if joined(a) and joined(a) == joined(b) and fits(a, b):
        return 1.0
    left, right = Counter(a.words), Counter(b.words)
    equal = left & right
    if not any(len(word) > 1 for word in equal):
        return 0.0
    # Of one letter the initials left over are all on one side: equal ones have met already.
    kinds = [Counter((w[0], len(w) == 1) for w in (side - equal).elements()) for side in (left, right)]
    letters = {letter for kind in kinds for letter, _ in kind}
    initials = sum(min(kinds[0][x, True], kinds[1][x, False]) + min(kinds[1][x, True], kinds[0][x, False]) for x in letters)
    return (equal.total() + initials) / max(len(a.words), len(b.words))


def name_similarity(a: str, b: str) -> float:
    return likeness(person(a), person(b))


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """The table of similarities: a row for each name of a, a column for each of b."""
    return np.array([[likeness(person(x), person(y)) for y in b] for x in a]).reshape(len(a), len(b))


def assigned(table: np.ndarray) -> float:
    """Sum of the similarities when each name has at most one partner: the greatest goes first, of equals the last one."""
    left, total = table.copy(), 0.0
    while left.size and left.max() > 0:
        row, column = divmod(left.size - 1 - int(left.ravel()[::-1].argmax()), left.shape[1])
        total += float(left[row, column])
        left[row, :] = left[:, column] = 0
    return total


def overlap(a: set, b: set) -> float:
    """Shared part of two sets, of two empty ones all of it."""
    return len(a & b) / len(a | b) if a or b else 1.0


def families(names: list[str], compact: bool = False) -> set[str]:
    return {p.family.replace(" ", "") if compact else p.family for p in map(person, names)} - {""}


def author_similarity(a: list[str], b: list[str], compact: bool = False) -> float:
    """Partners among the longer list; where some name is a single word, surnames in common may count for more."""
    paired = assigned(likenesses(a, b)) / max(len(a), len(b)) if a and b else 0.0
    short = any(len(person(name).words) < 2 for name in [*a, *b])
    return max(paired, overlap(families(a, compact), families(b, compact))) if short else paired


def author_coverage(a: list[str], b: list[str]) -> float:
    """Partners among the shorter list."""
    return min(1.0, assigned(likenesses(a, b)) / min(len(a), len(b))) if a and b else 0.0


def title_similarity(a: str, b: str) -> float:
    """Of two keys: words in common and equal runs of characters."""
    if a and a.replace(" ", "") == b.replace(" ", ""):
        return 1.0
    return WORD_SHARE * overlap(set(a.split()), set(b.split())) + (1 - WORD_SHARE) * SequenceMatcher(None, a, b).ratio()


def record_score(title_a: str, authors_a: list[str], title_b: str, authors_b: list[str]) -> float:
    """Title and authors of two records; a title within the other, or the same one, counts for more."""
    a, b = title_key(title_a), title_key(title_b)
    short, long = sorted((a.replace(" ", ""), b.replace(" ", "")), key=len)
    within = short != "" and short in long and len(long) <= CONTAINED_LENGTH * len(short)
    title = max(title_similarity(a, b), CONTAINED_SCORE if within else 0.0)
    people = author_similarity(authors_a, authors_b)
    if short and short == long:
        left, right = families(authors_a, True), families(authors_b, True)
        same = not left.isdisjoint(right) or bool((likenesses(authors_a, authors_b) >= CLOSE_NAME).any())
        people = 1.0 if same else max(people, author_similarity(authors_a, authors_b, compact=True))
    return TITLE_SHARE * title + (1 - TITLE_SHARE) * people
