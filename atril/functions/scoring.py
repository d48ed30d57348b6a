"""Facts of one (reference, hypothesis) pair of token lists: edits, terms, degenerate output."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import isqrt
from operator import eq

from .lexicon import FUNCTION_WORDS
from .normalizer import tokenize

#: Words of reference rows times words of the hypothesis whose cells are held at once, in bits.
_HELD = 1 << 27


@dataclass(frozen=True)
class Terms:
    """Gold terms as token tuples, their words without function words, and the tokens of each term asked for."""

    tuples: frozenset[tuple[str, ...]]
    vocabulary: frozenset[str]
    asked: tuple[tuple[str, ...], ...]

    def spans(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Occurrences from left to right, the longest first, without overlap."""
        sizes = sorted({len(t) for t in self.tuples}, reverse=True)
        out, at = [], 0
        while at < len(tokens):
            size = next((n for n in sizes if at + n <= len(tokens) and tuple(tokens[at : at + n]) in self.tuples), 0)
            if size:
                out.append((at, at + size))
            at += size or 1
        return out


@lru_cache(maxsize=20_000)
def terms_of(terms: tuple[str, ...], normalized: bool = True) -> Terms:
    asked = tuple(tuple(tokenize(t) if normalized else filter(None, t.split(" "))) for t in terms)
    tuples = frozenset(filter(None, asked))
    return Terms(tuples, frozenset(w for t in tuples for w in t if w not in FUNCTION_WORDS), asked)


def _rows(ref: list[str], where: dict[str, int], ups: int, downs: int, full: int, lefts: list[int], aboves: list[int]) -> tuple[int, int]:
    """Rows of the cost table as bits (Hyyrö's form of Myers' algorithm), from one row's differences to the last one's.

    ups, downs: where a cell costs one more, or less, than its left neighbour. ``lefts`` gets a row's ups, ``aboves``
    where a cell costs one more than the one above it.
    """
    for word in ref:
        met = where.get(word, 0)
        free = (((met & ups) + ups) ^ ups) | met | downs
        above = (downs | ~(free | ups)) & full
        below = ups & free
        aboves.append(above)
        above = above << 1 | 1
        ups = (below << 1 | ~(free | above)) & full
        downs = above & free & full
        lefts.append(ups)
    return ups, downs


def edits(ref: list[str], hyp: list[str], term_words: frozenset[int] = frozenset(), vocabulary: frozenset[str] = frozenset()) -> tuple[list[int], int]:
    """Substitutions, deletions, insertions, errors on term words and on others; and the bit set of equal reference words.

    Unit costs. Ties go to equal, then insertion, then deletion, then substitution; that choice depends on a cell's
    costs alone, so differences of neighbouring costs suffice to walk back from the end. The whole table is aligned;
    one block of its rows is held at a time, and the blocks before are made again from their first row.
    """
    full, where = (1 << len(hyp)) - 1, {}
    for j, word in enumerate(hyp):
        where[word] = where.get(word, 0) | 1 << j
    block = max(isqrt(len(ref)) + 1, _HELD // (len(hyp) + 1))
    starts = [(full, 0)]
    for at in range(0, len(ref) - block, block):
        starts.append(_rows(ref[at : at + block], where, *starts[-1], full, [], []))
    s = d = i = term = 0
    same = bytearray(b"0" * len(ref))
    k, j = len(ref), len(hyp)
    while k and j:
        first = (k - 1) // block * block
        lefts, aboves = [], []
        _rows(ref[first:k], where, *starts[first // block], full, lefts, aboves)
        while k > first and j:
            if ref[k - 1] == hyp[j - 1]:
                k, j = k - 1, j - 1
                same[-1 - k] = 49
            elif lefts[k - 1 - first] >> j - 1 & 1:
                i, j = i + 1, j - 1
                term += hyp[j] in vocabulary
            else:
                if aboves[k - 1 - first] >> j - 1 & 1:
                    d += 1
                else:
                    s, j = s + 1, j - 1
                k -= 1
                term += k in term_words
    d, i = d + k, i + j
    term += sum(w in vocabulary for w in hyp[:j]) + sum(w in term_words for w in range(k))
    return [s, d, i, term, s + d + i - term], int(same or b"0", 2)


def loops(tokens: list[str]) -> set[tuple[str, ...]]:
    """Grams of 1 to 8 tokens that stand back to back: four times for one token, else three."""
    found, n = set(), len(tokens)
    for size in range(1, 9):
        need = 4 if size == 1 else 3
        if b"\1" * (size * (need - 1)) not in bytes(map(eq, tokens, tokens[size:])):
            continue
        run = [0] * (n + 1)  # how many tokens from here on equal those ``size`` later
        for k in range(n - size - 1, -1, -1):
            run[k] = run[k + 1] + 1 if tokens[k] == tokens[k + size] else 0
        at = 0
        while at + size * need <= n:
            times = 1 + run[at] // size
            if times >= need:
                found.add(tuple(tokens[at : at + size]))
            at += times * size if times >= need else 1
    return found


def repeat_rate(tokens: list[str]) -> float:
    """Share of 5-grams that repeat another."""
    grams = list(zip(*(tokens[k:] for k in range(5)), strict=False))
    return 1.0 - len(set(grams)) / len(grams) if grams else 0.0


# The share of repeated 5-grams that makes a loop, and how much longer than the reference a text runs away.
REPEATED = 0.05
RUNAWAY_TIMES, RUNAWAY_WORDS = 2, 10


def runs_away(ref: list[str], hyp: list[str]) -> bool:
    return len(hyp) > RUNAWAY_TIMES * len(ref) + RUNAWAY_WORDS


def degenerate(ref: list[str], hyp: list[str]) -> tuple[list[str], dict]:
    """Flags ("empty", "loop") and what the loop consists of."""
    fresh, rate, runaway = loops(hyp), repeat_rate(hyp), runs_away(ref, hyp)
    fresh -= loops(ref) if fresh else set()
    looped = bool(fresh) or runaway or (rate > REPEATED and rate > repeat_rate(ref) + REPEATED)
    flags = ["empty"] * (not hyp and bool(ref)) + ["loop"] * looped
    detail = {"tandem": [" ".join(g) for g in sorted(fresh)][:3], "rep5": round(rate, 3), "runaway": runaway} if looped else {}
    return flags, detail


def contains(tokens: list[str], span: list[str] | tuple[str, ...]) -> bool:
    return bool(span) and f" {' '.join(span)} " in f" {' '.join(tokens)} "


#: What facts consist of: counts of edits, counts of terms, degenerate flags. Terms ask for an alignment, flags do not.
PARTS = ("edits", "terms", "flags")
FIELDS = ("n_ref", "n_hyp", "s", "d", "i", "term_n", "term_hits", "terms_not_in_ref", "term_words", "term_word_errors", "other_words", "other_word_errors")


def facts(ref: list[str], hyp: list[str], gold: tuple[str, ...], normalized: bool = True) -> tuple[list[int], list[str], dict]:
    """FIELDS, degenerate flags and their detail. A clip without gold terms counts neither term nor other words."""
    term_part = [0] * 7
    words, vocabulary, spans = frozenset(), frozenset(), []
    gold = tuple(dict.fromkeys(gold))
    if gold:
        terms = terms_of(gold, normalized)
        spans, vocabulary = terms.spans(ref), terms.vocabulary
        words = frozenset(k for a, b in spans for k in range(a, b) if ref[k] not in FUNCTION_WORDS)
    (s, d, i, term, other), same = edits(ref, hyp, words, vocabulary)
    if gold:
        hits = sum(all(same >> k & 1 for k in range(a, b)) for a, b in spans)
        absent = sum(not contains(ref, t) for t in terms.asked)
        term_part = [len(spans), hits, absent, len(words), term, len(ref) - len(words), other]
    return [len(ref), len(hyp), s, d, i, *term_part], *degenerate(ref, hyp)
