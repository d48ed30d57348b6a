"""Facts of many short pairs at once: words are numbers, and a row of the alignment's table is a few bit sets a pair.

``facts_of`` gives what ``scoring.facts`` gives. Pairs of up to LONGEST words a side go through here in blocks of like
length; longer ones are aligned by ``scoring.edits``, which holds a bounded part of the table.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import scoring
from .lexicon import FUNCTION_WORDS
from .normalizer import tokenize

#: Words of a side: as many as the bits of a set, less one.
LONGEST = 63
BLOCK = 2048
#: Terms of a clip that are looked for at once; pairs with more are done one by one.
TERMS = 64
ONE = np.uint64(1)


class Rows(NamedTuple):
    """Rows of words, one after the other, and the number of words of each."""

    words: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return self.sizes.cumsum() - self.sizes

    def table(self, of: np.ndarray, starts: np.ndarray, missing: int) -> np.ndarray:
        """The rows ``of``, padded with ``missing`` to 32 or 64 words."""
        sizes = self.sizes[of]
        width = 32 if sizes.max(initial=0) <= 32 else 64
        at = np.arange(width)
        if not len(self.words):
            return np.full((len(of), width), missing, np.int32)
        return np.where(at < sizes[:, None], self.words[np.minimum(starts[of][:, None] + at, len(self.words) - 1)], np.int32(missing))


class Column(NamedTuple):
    """Rows of strings as an Arrow array of all words and the number of each row's."""

    words: pa.Array
    sizes: np.ndarray


def column_of(rows: list) -> Column:
    return Column(pa.array(list(chain.from_iterable(rows)), pa.string()), np.fromiter(map(len, rows), np.int64, len(rows)))


def listed(rows: pa.Array) -> Column:
    """A column of lists; null is empty."""
    return Column(rows.flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def spaced(texts: pa.Array) -> Column:
    """Texts split at spaces; null is empty."""
    parts = listed(pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " "))
    kept = pc.not_equal(parts.words, "")
    of = np.repeat(np.arange(len(parts.sizes)), parts.sizes)[kept.to_numpy(zero_copy_only=False)]
    return Column(parts.words.filter(kept), np.bincount(of, minlength=len(parts.sizes)))


def _bits(found: np.ndarray) -> np.ndarray:
    """Each row's truths as a set of bits."""
    return np.packbits(found, axis=1, bitorder="little").view(f"<u{found.shape[1] // 8}")[:, 0].astype(np.uint64)


def _below(n: np.ndarray) -> np.ndarray:
    """The ``n`` lowest bits."""
    return (ONE << n.astype(np.uint64)) - ONE


def edits_of(ref: np.ndarray, hyp: np.ndarray, n_ref: np.ndarray, n_hyp: np.ndarray, in_term: np.ndarray, in_vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Substitutions, deletions, insertions, errors on term words, a row each; and the met reference words (bits).

    ``scoring.edits`` for all pairs in step: the rows' differences as bits, then the way back from the end. Ties go to
    equal, insertion, deletion, substitution.
    """
    height, full = int(n_ref.max(initial=0)), _below(n_hyp)
    ups, downs = full.copy(), np.zeros(len(full), np.uint64)
    mets, lefts, aboves = np.zeros((3, max(height, 1), len(full)), np.uint64)
    for k in range(height):
        met = mets[k] = _bits(hyp == ref[:, k, None])
        free = (((met & ups) + ups) ^ ups) | met | downs
        above = aboves[k] = (downs | ~(free | ups)) & full
        below = ups & free
        above = above << ONE | ONE
        ups = lefts[k] = (below << ONE | ~(free | above)) & full
        downs = above & free & full
    counts, same = np.zeros((4, len(full)), np.int64), np.zeros(len(full), np.uint64)
    s, d, i, term = counts
    k, j, pairs = n_ref.copy(), n_hyp.copy(), np.arange(len(full))
    while (open_ := (k > 0) & (j > 0)).any():
        row, here, there = np.maximum(k - 1, 0), (np.maximum(k, 1) - 1).astype(np.uint64), (np.maximum(j, 1) - 1).astype(np.uint64)
        equal = open_ & ((mets[row, pairs] >> there & ONE) > 0)
        rest = open_ & ~equal
        added = rest & ((lefts[row, pairs] >> there & ONE) > 0)
        rest &= ~added
        lost = rest & ((aboves[row, pairs] >> there & ONE) > 0)
        other = rest & ~lost
        same |= equal.astype(np.uint64) << here
        s += other
        d += lost
        i += added
        term += np.where(added, in_vocabulary >> there & ONE, np.where(rest, in_term >> here & ONE, np.uint64(0))).astype(np.int64)
        k -= equal | rest
        j -= equal | added | other
    d += k
    i += j
    term += np.bitwise_count(in_vocabulary & _below(j)).astype(np.int64) + np.bitwise_count(in_term & _below(k))
    return counts, same


def _run(bits: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` bits in a row are set."""
    held = 1
    while held < n:
        step = min(held, n - held)
        bits, held = bits & bits >> np.uint64(step), held + step
    return bits > 0


def _may_loop(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a row of the table (padded with a negative number) has words back to back or a repeated 5-gram."""
    found, longest = np.zeros(len(words), bool), int(sizes.max(initial=0))
    for size in range(1, min(9, longest)):
        equal = np.zeros(words.shape, bool)
        equal[:, :-size] = (words[:, :-size] == words[:, size:]) & (words[:, size:] >= 0)
        found |= _run(_bits(equal), size * (3 if size == 1 else 2))
    if longest >= 5:
        mixed = np.zeros((len(words), longest - 4), np.uint64)
        for k in range(5):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[:, k : longest - 4 + k].astype(np.uint64)
        mixed = np.where(words[:, 4:longest] >= 0, mixed, np.arange(longest - 4, dtype=np.uint64) | ONE << np.uint64(63))
        mixed.sort(1)
        found |= (mixed[:, 1:] == mixed[:, :-1]).any(1)
    return found


def _coded(*columns: Column) -> tuple[list[Rows], pa.Array]:
    """Words of all columns as numbers, alike, and the words that these stand for."""
    whole = pa.concat_arrays([c.words.cast(pa.string()) for c in columns]).dictionary_encode()
    numbers, ends = whole.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([len(c.words) for c in columns])
    return [Rows(n, c.sizes) for n, c in zip(np.split(numbers, ends[:-1]), columns, strict=True)], whole.dictionary


def may_loop(rows: list[list[str]]) -> np.ndarray:
    """Whether a row of up to LONGEST words may have a loop; those for which not have none."""
    (coded,), _ = _coded(column_of(rows))
    return _may_loop(coded.table(np.arange(len(rows)), coded.starts, -1), coded.sizes)


def _distinct(terms: Column) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each term, those that a row repeats once."""
    of = np.repeat(np.arange(len(terms.sizes)), terms.sizes)
    if not len(of):
        return of, terms.words
    number = terms.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.sort(np.unique(of * (int(number.max()) + 1) + number, return_index=True)[1])
    return of[first], terms.words.take(pa.array(first))


def facts_in(ref: Column, hyp: Column, terms: Column, normalized: bool = True, parts: tuple[str, ...] = scoring.PARTS) -> tuple[np.ndarray, list[list[str]], list[dict]]:
    """``scoring.facts`` of each pair: FIELDS (a row a pair), degenerate flags and their detail. Of parts that are not asked
    for nothing is to be read; sizes are always there."""
    if "terms" not in parts:
        terms = Column(terms.words.slice(0, 0), np.zeros(len(ref.sizes), np.int64))
    aligned = "edits" in parts or "terms" in parts
    term_row, texts = _distinct(terms)
    asked = column_of([tokenize(t) for t in texts.to_pylist()]) if normalized else spaced(texts)
    (refs, hyps, golds), words = _coded(ref, hyp, asked)
    common = np.append(pc.is_in(words, pa.array(sorted(FUNCTION_WORDS))).to_numpy(zero_copy_only=False), False)
    n, n_ref, n_hyp = len(ref.sizes), ref.sizes, hyp.sizes
    n_terms = np.bincount(term_row, minlength=n)
    first_term, ref_at, hyp_at, gold_at = n_terms.cumsum() - n_terms, refs.starts, hyps.starts, golds.starts
    counts, flags, details = np.zeros((n, len(scoring.FIELDS)), np.int64), [[]] * n, [{}] * n
    told = words.to_pylist()
    said = lambda rows, at, k: [told[w] for w in rows.words[at[k] : at[k] + rows.sizes[k]]]
    short = (n_ref <= LONGEST) & (n_hyp <= LONGEST) & (n_terms <= TERMS)
    for k in np.flatnonzero(~short).tolist():
        gold = tuple(texts.slice(int(first_term[k]), int(n_terms[k])).to_pylist())
        counts[k], flags[k], details[k] = scoring.facts(said(refs, ref_at, k), said(hyps, hyp_at, k), gold, normalized)
    order = np.flatnonzero(short)
    order = order[np.lexsort((n_hyp[order], n_ref[order]))]
    for at in range(0, len(order), BLOCK):
        of = order[at : at + BLOCK]
        ours, theirs = refs.table(of, ref_at, -1), hyps.table(of, hyp_at, -2)
        in_term, in_vocabulary, absent, starts, found = (np.zeros(len(of), np.uint64) for _ in range(5))
        looked, spans = [], []
        for slot in range(int(n_terms[of].max())):
            there = n_terms[of] > slot
            term = np.where(there, first_term[of] + slot, 0)
            size = np.where(there, golds.sizes[term], 0)
            met = np.where(size > 0, ~np.uint64(0), np.uint64(0))
            for m in range(int(np.minimum(size, LONGEST + 1).max())):
                word = np.where(m < size, golds.words[np.minimum(gold_at[term] + m, len(golds.words) - 1)], -3)
                met &= np.where(m < size, _bits(ours == word[:, None]) >> np.uint64(min(m, 63)), ~np.uint64(0))
            for m in range(int(size.max())):
                word = np.where(m < size, golds.words[np.minimum(gold_at[term] + m, len(golds.words) - 1)], -3)
                in_vocabulary |= np.where((word >= 0) & ~common[word], _bits(theirs == word[:, None]), np.uint64(0))
            met[size > LONGEST] = 0
            absent += there & (met == 0)
            starts |= met
            looked.append((met, size.astype(np.uint64)))
        while starts.any():
            lowest = starts & (~starts + ONE)
            size = np.zeros(len(of), np.uint64)
            for met, n_words in looked:
                size = np.where((met & lowest) > 0, np.maximum(size, n_words), size)
            spans.append((lowest << size) - lowest)
            found += lowest > 0
            in_term |= spans[-1]
            starts &= ~((lowest << size) - ONE)
        if spans:
            in_term &= _bits((ours >= 0) & ~common[ours])
        edits, same = edits_of(ours, theirs, n_ref[of], n_hyp[of], in_term, in_vocabulary) if aligned else (np.zeros((4, len(of)), np.int64), None)
        hits = sum((((same & s) == s) & (s > 0)).astype(np.int64) for s in spans) if spans else 0
        gold, n_words, wrong = n_terms[of] > 0, np.bitwise_count(in_term).astype(np.int64), edits[:3].sum(0)
        part = [found, hits, absent, n_words, edits[3], np.where(gold, n_ref[of] - n_words, 0), np.where(gold, wrong - edits[3], 0)]
        counts[of] = np.stack([n_ref[of], n_hyp[of], *edits[:3], *(np.broadcast_to(np.asarray(p, np.int64), len(of)) for p in part)], 1)
        if "flags" not in parts:
            continue
        empty = n_hyp[of] == 0
        for k in of[empty & (n_ref[of] > 0)].tolist():
            flags[k] = ["empty"]
        odd = ~empty & (_may_loop(theirs, n_hyp[of]) | (n_hyp[of] > scoring.RUNAWAY_TIMES * n_ref[of] + scoring.RUNAWAY_WORDS))
        for k in of[odd].tolist():
            flags[k], details[k] = scoring.degenerate(said(refs, ref_at, k), said(hyps, hyp_at, k))
    return counts, flags, details


def facts_of(refs: list[list[str]], hyps: list[list[str]], golds: list[tuple[str, ...]], normalized: bool = True) -> list[tuple[list[int], list[str], dict]]:
    """``scoring.facts`` of each pair."""
    counts, flags, details = facts_in(column_of(refs), column_of(hyps), column_of(golds), normalized)
    return list(zip(counts.tolist(), flags, details, strict=True))
