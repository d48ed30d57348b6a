"""Language model with Katz backoff, of any order (three by default).

Counts up to ``K`` are discounted by Good-Turing: r* = (r + 1) E(r + 1) / E(r), where E, the expected counts of counts, is
the line fitted to their logarithms (``discounts``), as single ones are too uneven to be used themselves; counts above K
stay. The unigram level gives what its discounts free to one class of unknown words. At each higher level a history gives
what its discounts free to the words that it was not seen with, in proportion to the next lower level's probability, with
backoff weights normalised exactly over all words and the unknown class. A history whose discounts free nothing gets one
virtual count.

Plan, one exchange a level: documents go into chunks of about 5 MB, split once and written. Each chunk sends its distinct words (as hashes with
training counts) to the word table's parts, which number the words and answer with ids and counts. For each higher level
it sends its distinct n-grams with training counts and with the counts of their last n - 1 words to the parts of that
level's table, dealt by history. A part sums the counts, keeps the n-grams that were seen in training as its share of the
stored table, and answers each chunk with the counts of what it sent and the sums of its histories. Last, the chunk evaluates its
n-grams from the lowest level up: seen ones by their discounted counts, others by backoff, and sums them over each text.
Histories that make up over a thousandth of all training tokens (fewer than a thousand a level), and the beginnings of
texts, are dealt by the next word too; their sums meet on the driver. A history's sums are whole numbers, to which the
discounts of all parts apply later. N-grams and answers travel as compressed columns. All counts come from all training
documents.

``fit`` gives a ``Model``: its tables lie in the shared folder, partitioned by part, and hold (n-gram, count) in compact
form; ``Model.table`` and ``Model.backoffs`` show them as rows with probabilities and backoff weights. ``score`` asks these
tables for any documents. ``fit_and_score`` does both in one exchange a level.

Words are told apart by 64-bit XXH64. Null texts are empty (one token, the end); a null doc_id has the text "" and so is
held out. Very long texts count whole. Without training documents every token has probability 1. Repeated rows count and
come back as often as they occur; an empty table gives no rows; columns other than doc_id and text are not read, whatever
their names. A chunk that came out differently when redone would stop the job (its name holds a digest of its words).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Buckets, chunked, dealt, forget, numbered, pack, pack_ints, unpack, unpack_ints, written

ORDER = 3
K = 5
#: Sums of a history: n-grams of each count to K, the tokens of the others; the same for the counts of their last words.
SUMS = 2 * K + 2
#: The end of a text as a word: white space is in no word. Ids of words begin at 1; 0 stands before a text.
END = b"\n"
#: A history with over one in so many training tokens is dealt by its next words too.
HOT = 1000
CHUNK = 5 << 20
#: Bytes of input a part at most, which a worker holds some twenty times; the session's shuffle partitions give more parts
#: where input is small. With larger workers, raise both this and CHUNK, so that a chunk's share for a part stays whole.
PART_BYTES = 64 << 20
#: Shares in which the parts of a level are worked off at most, and bytes of input (as Spark estimates it) a share at least.
ROUNDS, ROUND_BYTES = 6, 32 << 20
#: Slope of the counts of counts where fewer than two are there, and the flattest that is used: r* < r below it only.
SLOPE, FLATTEST = -2.0, -1.05


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to K (0 unused) from the counts of counts n[1] to n[K + 1]: Katz's, of expected counts r**b.

    b: the slope of the least-squares line through the logarithms, FLATTEST at most.
    """
    r = np.arange(1, K + 1)
    some = np.flatnonzero(n[1 : K + 2] > 0) + 1
    b = min(FLATTEST, float(np.polyfit(np.log(some), np.log(n[some]), 1)[0])) if len(some) > 1 else SLOPE
    shared = (K + 1.0) ** (b + 1)
    return np.concatenate([[0.0], ((1 + 1 / r) ** (b + 1) - shared) / (1 - shared)])


def discounted(c: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, factors[np.minimum(c, K)], 1.0)


def weighed(sums: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Discounted tokens of rows of K + 1 sums."""
    out = sums[:, K].astype(float)
    for r in range(1, K + 1):
        out += sums[:, r - 1] * (r * factors[r])
    return out


def classes_of(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """K + 1 sums of counts ``n`` for each of ``size`` groups."""
    some = np.flatnonzero(n > 0)
    n = n[some]
    place = of[some] * (K + 1) + np.minimum(n, K + 1) - 1
    return np.bincount(place, np.where(n > K, n, 1), size * (K + 1)).astype(np.int64).reshape(size, K + 1)


def ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many ``bits`` in their order, and where each was. Key and place are sorted as one number where they fit in
    one, which takes a third of the time."""
    places = max(len(key) - 1, 0).bit_length()
    if bits + places > 63:
        order = np.argsort(key)
        return key[order], order
    both = key << places
    both |= np.arange(len(key))
    both.sort()
    order = both & ((1 << places) - 1)
    both >>= places
    return both, order


def distinct(key: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in their order, a place of each, and which of them each key is."""
    key, order = ranked(key, bits)
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = new.cumsum() - 1
    return key[new], order[new], inverse


@dataclass(frozen=True)
class Unigrams:
    """The lowest level: N tokens, V words, documents learnt from, discounts, and the unknown class's probability."""

    tokens: int = 0
    words: int = 0
    documents: int = 0
    factors: np.ndarray = field(default_factory=lambda: np.zeros(K + 1))
    unknown: float = 1.0
    total: float = 1.0

    @classmethod
    def of(cls, tokens: int, words: int, documents: int, n: np.ndarray) -> Unigrams:
        if not tokens:
            return cls()
        d, r = discounts(n), np.arange(K + 1)
        freed = float(((1 - d) * r * n[: K + 1])[1:].sum())
        return cls(tokens, words, documents, d, freed / tokens, tokens) if freed > 0 else cls(tokens, words, documents, d, 1 / (tokens + 1), tokens + 1)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.factors) / self.total, self.unknown)


@dataclass
class Model:
    """A fitted model: ``ways`` parts; for each level its table (way, a: columns, b: counts, c: counts of the last words),
    discounts, and the sums of hot histories."""

    order: int
    ways: int
    unigrams: Unigrams = field(default_factory=Unigrams)
    tables: dict[int, DataFrame] = field(default_factory=dict)
    factors: dict[int, np.ndarray] = field(default_factory=dict)
    shared: dict[int, dict[tuple, np.ndarray]] = field(default_factory=dict)

    @property
    def hot_from(self) -> float:
        return self.unigrams.tokens / HOT

    def discount(self, n: int) -> np.ndarray:
        return self.unigrams.factors if n == 1 else self.factors[n]

    def words(self) -> DataFrame:
        """(id, hash, count, probability) of each word."""
        ways, level = self.ways, self.unigrams

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for way, a, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    hashes, count = unpack(a[0], np.uint64), unpack_ints(counts)
                    ids = np.arange(len(hashes)) * ways + way + 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes.view(np.int64)), pa.array(count), pa.array(level.probability(count))], ["id", "hash", "count", "probability"])

        return self.tables[1].select("way", "a", "b").mapInArrow(run, "id long, hash long, count long, probability double")

    def _rows(self, n: int) -> DataFrame:
        """(history, word, count, kept, lower) of level ``n``; kept and lower: discounted counts of the n-gram and of its last n - 1 words."""
        own, low = self.discount(n), self.discount(n - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, counts, lower in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    cols, count = _unpacked(a), unpack_ints(counts)
                    flat = np.stack(cols[:-1], 1)
                    history = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n - 1, dtype=np.int32)), pa.array(flat.reshape(-1)))
                    below = discounted(unpack_ints(lower), low)
                    yield pa.RecordBatch.from_arrays([history, pa.array(cols[-1]), pa.array(count), pa.array(discounted(count, own)), pa.array(below)], ["history", "word", "count", "kept", "lower"])

        return self.tables[n].select("a", "b", "c").mapInArrow(run, "history array<long>, word long, count long, kept double, lower double")

    def _histories(self, n: int) -> DataFrame:
        sums = self._rows(n).groupBy("history").agg(F.sum("count").alias("seen"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower"))
        return sums.withColumn("total", F.when(F.col("kept") >= F.col("seen") * (1 - 1e-12), F.col("seen") + 1).otherwise(F.col("seen").cast("double")))

    def table(self, n: int) -> DataFrame:
        """(history array<long>, word, count, probability) of the n-grams of level ``n``, two or more."""
        return self._rows(n).join(self._histories(n).select("history", "total"), "history").select("history", "word", "count", (F.col("kept") / F.col("total")).alias("probability"))

    def backoffs(self, n: int) -> DataFrame:
        """(history array<long>, backoff) of the histories of level ``n``."""
        own = self._histories(n)
        if n > 2:
            below = self._histories(n - 1).select(F.col("history").alias("short"), F.col("total").alias("below"))
            own = own.join(below, F.slice(own["history"], 2, n - 2) == below["short"])
        else:
            own = own.withColumn("below", F.lit(float(self.unigrams.total)))
        return own.select("history", ((1 - F.col("kept") / F.col("total")) / (1 - F.col("lower") / F.col("below"))).alias("backoff"))


# Columns of n-grams: a history that several n-grams in a row have goes once, with their number; the first word of
# histories goes as differences, which are small where n-grams are sorted.


def _packed(cols: list[np.ndarray]) -> list[bytes]:
    opens = _runs(cols[:-1])
    first, *rest = (c[opens] for c in cols[:-1])
    moved = np.diff(first, prepend=np.int64(0))
    return [pack_ints(np.diff(np.append(opens, len(cols[0]))) - 1), pack_ints(moved << 1 ^ moved >> 63), *map(pack_ints, rest), pack_ints(cols[-1])]


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    more, moved, *rest, word = map(unpack_ints, blobs)
    return [*(np.repeat(c, more + 1) for c in ((moved >> 1 ^ -(moved & 1)).cumsum(), *rest)), word]


def _distinct(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows in lexicographic order, and which of them each row is."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in cols]
    if sum(bits) < 64:
        key = np.zeros(len(cols[0]), np.int64)
        for c, n in zip(cols, bits, strict=True):
            key = key << n | c
        return distinct(key, sum(bits))[1:]
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], 0)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = new.cumsum() - 1
    return order[new], inverse


def _runs(cols: list[np.ndarray], breaks: np.ndarray | None = None) -> np.ndarray:
    """Where rows of ``cols`` differ from the row before, or ``breaks`` does."""
    n = len(cols[0])
    if not n:
        return np.zeros(0, np.int64)
    changed = np.any([c[1:] != c[:-1] for c in (*cols, *(() if breaks is None else (breaks,)))], 0)
    return np.flatnonzero(np.concatenate([[True], changed]))


def _stretches(way: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(way, start, end) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(way)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(way)], strict=True):
        if b > a:
            yield int(way[a]), int(a), int(b)


def _mixed(cols: list[np.ndarray]) -> np.ndarray:
    """A hash of each row."""
    out = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in columns.values()], names=list(columns))


# Chunks.


@dataclass
class Chunk:
    """Texts as positions in a word list in the order of first occurrence, where frequent words have small numbers; place:
    where each word lies once they are dealt ``ways`` ways by hash, the order of ``hashes``."""

    name: str
    ids: list
    held: np.ndarray
    sizes: np.ndarray
    positions: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    way: np.ndarray


def _sequences(positions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with an end (word 0) after each, and where each text begins."""
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.zeros(starts[-1], np.int64)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    tokens[inner] = positions
    return tokens, starts


def _chunks(batches: Iterator[pa.RecordBatch], ways: int) -> Iterator[Chunk]:
    task = TaskContext.get().partitionId()
    for k, rows in enumerate(chunked(batches, CHUNK)):
        sizes, found, words = numbered([text.lower() for _, text in rows])
        words.insert(0, END)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        way = (hashes % np.uint64(ways)).astype(np.int64)
        order = np.lexsort((hashes, way))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        positions = found.astype(np.uint32) + np.uint32(1)
        held = np.array([held_out(i) for i, _ in rows], bool)
        digest = hashlib.sha1(hashes[order].tobytes() + positions.tobytes()).hexdigest()
        yield Chunk(f"{task}-{k}-{digest}", [i for i, _ in rows], held, sizes, positions, place, hashes[order], way[order])


@dataclass
class Level:
    """A chunk's distinct n-grams. They rank by their history's rank in the level below and by their word, and are dealt in
    the order of their parts; place: where each lies then, order: the rank of each that lies there.

    ranked: their words, by rank; ranks: which of them each token ends. As they are dealt: first, a token that ends each;
    history: the run of n-grams with one history that each lies in; opens: where these runs begin; hot: of each history,
    whether its sums are shared; seen: of each history, its count; count: of each n-gram.
    """

    ranked: list[np.ndarray]
    ranks: np.ndarray
    first: np.ndarray
    way: np.ndarray
    history: np.ndarray
    opens: np.ndarray
    seen: np.ndarray
    hot: np.ndarray
    place: np.ndarray
    order: np.ndarray
    count: np.ndarray | None = None
    own: np.ndarray | None = None
    lower: np.ndarray | None = None

    def ended(self, tokens: np.ndarray) -> np.ndarray:
        """Where the n-grams lie that ``tokens`` end."""
        return self.place[self.ranks[tokens]]


def _next(below: Level, tokens: np.ndarray, starts: np.ndarray, ids: np.ndarray, model: Model) -> Level:
    """The n-grams of a chunk from its (n - 1)-grams, whose counts are known. ``way`` is twice the part, and one more for hot histories."""
    none, bits = len(below.count), len(ids).bit_length()
    key = np.empty(len(tokens), np.int64)
    key[1:] = below.ranks[:-1]
    key[starts[:-1]] = none
    key <<= bits
    key |= tokens
    key, first, inverse = distinct(key, none.bit_length() + bits)
    rank, word = key >> bits, ids[key & ((1 << bits) - 1)]
    known = [np.append(c, 0)[rank] for c in below.ranked]
    seen = np.append(below.count[below.place], model.unigrams.documents)[rank]
    hot = (seen > model.hot_from) | (rank == none)
    way = (_mixed([*known, np.where(hot, word, 0)]) >> np.uint64(20)) % np.uint64(model.ways)
    way = (way * np.uint64(2) + hot).astype(np.uint16 if model.ways < 1 << 15 else np.int64)
    order = np.argsort(way, kind="stable").astype(np.int32)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    way, rank = way[order].astype(np.int32), rank[order]
    opens = _runs([rank], way)
    history = np.repeat(np.arange(len(opens), dtype=np.int32), np.diff(np.append(opens, len(rank))))
    own = order[opens]
    return Level([*known, word], inverse, first[order], way, history, opens, seen[own].astype(float), hot[own], place, order)


OUT = "kind string, chunk string, way int, a array<binary>, b binary, c binary, stats array<double>"
_OUT = [("kind", pa.string()), ("chunk", pa.string()), ("way", pa.int32()), ("a", pa.list_(pa.binary())), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.float64()))]
ASK = "way int, part int, chunk string, a array<binary>, b binary, c binary"


def _out(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_OUT)], names=[n for n, _ in _OUT])


def _asked(out: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["way", "part", "chunk", "a", "b", "c"])


def _way_of(*tables: pa.Table) -> int:
    return next(t["way"][0].as_py() for t in tables if t.num_rows)


def _word_part(ways: int):
    """A part of the word table: numbers words by falling count; words of a stored table keep their numbers."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        way, known = _way_of(asked, stored), stored.num_rows
        hashes = [*(unpack(x[0], np.uint64) for x in stored["a"].to_pylist()), *(unpack(x[0], np.uint64) for x in asked["a"].to_pylist())]
        counts = np.concatenate([*map(unpack_ints, stored["b"].to_pylist()), *map(unpack_ints, asked["b"].to_pylist())])
        every, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts).astype(np.int64)
        order = np.lexsort((first, ~(total > 0))) if known else np.argsort(-total, kind="stable")
        rank = np.empty(len(total), np.int64)
        rank[order] = np.arange(len(total))
        rows: list[tuple] = [("table", "sums", way, None, None, None, [float(total.sum()), float((total > 0).sum()), *(float((total == r).sum()) for r in range(1, K + 2))])]
        if not known:
            seen = order[total[order] > 0]
            rows.append(("table", None, way, [pack(every[seen])], pack_ints(total[seen]), None, None))
        at = sum(map(len, hashes[:known]))
        for chunk, h in zip(asked["chunk"].to_pylist(), hashes[known:], strict=True):
            own = inverse[at : at + len(h)]
            at += len(h)
            rows.append(("answer", chunk, way, [pack_ints(rank[own])], pack_ints(total[own][np.argsort(rank[own])]), None, None))
        return _out(rows)

    return run


def _gram_part(n: int):
    """A part of the table of n-grams: counts, histories' sums, and answers to what the chunks asked. Blocks with an odd
    ``part`` are of hot histories, of which this part has a share: its sums are told."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        way, known, blocks = _way_of(asked, stored), stored.num_rows, [*stored.to_pylist(), *asked.to_pylist()]
        parts = [_unpacked(r["a"]) for r in blocks]
        sizes = [len(p[0]) for p in parts]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(n)]
        del parts
        first, inverse = _distinct(cols)
        cols = [c[first] for c in cols]
        total = np.bincount(inverse, np.concatenate([unpack_ints(r["b"]) for r in blocks])).astype(np.int64)
        lower = np.concatenate([unpack_ints(r["c"]) for r in blocks])[first]
        opens = _runs(cols[:-1])
        of = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(first))))
        seen = total > 0
        sums = np.concatenate([classes_of(of, total, len(opens)), classes_of(of, np.where(seen, lower, 0), len(opens))], 1)
        rows: list[tuple] = [("table", "sums", way, None, None, None, [float((total == r).sum()) for r in range(1, K + 2)])]
        if not known and seen.any():
            rows.append(("table", None, way, _packed([c[seen] for c in cols]), pack_ints(total[seen]), pack_ints(lower[seen]), None))
        at, hot = sum(sizes[:known]), set()
        for r, size in zip(blocks[known:], sizes[known:], strict=True):
            own = inverse[at : at + size]
            at += size
            runs = of[own][_runs([of[own]])]
            if r["part"] % 2:
                hot.update(runs.tolist())
            told = [] if r["part"] % 2 else [*map(pack_ints, np.ascontiguousarray(sums[runs].T))]
            rows.append(("answer", r["chunk"], r["part"], told, pack_ints(total[own]), None, None))
        rows += [("table", "hot", way, None, None, None, [*(float(c[opens[k]]) for c in cols[:-1]), *map(float, sums[k])]) for k in sorted(hot)]
        return _out(rows)

    return run


@dataclass
class _State:
    """A chunk as it is known after some levels."""

    row: dict
    tokens: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    levels: list[Level]

    @property
    def learnt(self) -> np.ndarray:
        return np.repeat(~np.array(self.row["held"], bool), np.array(self.row["sizes"], np.int64) + 1)


def _restored(texts: pa.Table, answers: pa.Table, model: Model, upto: int) -> _State:
    """A chunk with the levels to ``upto`` as the parts answered."""
    row = texts.to_pylist()[0]
    by_level: dict[int, list[dict]] = {}
    for r in answers.sort_by("way").to_pylist():
        by_level.setdefault(r["level"], []).append(r)
    ids, count = [], []
    for r in by_level.get(1, []):
        rank = unpack_ints(r["a"][0])
        ids.append(rank * model.ways + r["way"] + 1)
        count.append(np.empty(len(rank), np.int64))
        count[-1][np.argsort(rank)] = unpack_ints(r["b"])
    if sum(map(len, ids)) != row["words"]:
        raise RuntimeError(f"chunk {row['chunk']} was not built alike twice: give the operator a written table")
    ids, count = np.concatenate(ids), np.concatenate(count)
    order = np.argsort(ids)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tokens, starts = _sequences(unpack_ints(row["positions"]), np.array(row["sizes"], np.int64))
    tokens, ids, none, same = place[unpack_ints(row["place"])][tokens], ids[order], np.zeros(0, np.int64), np.arange(len(ids))
    levels = [Level([ids], tokens, none, none, none, none, none, none, same, same, count[order])]
    for n in range(2, upto + 1):
        level = _next(levels[-1], tokens, starts, ids, model)
        told = by_level.get(n, [])
        level.count = np.concatenate([unpack_ints(r["b"]) for r in told])
        sums = np.zeros((SUMS, len(level.opens))).T  # a column's numbers lie together
        cold, hot = np.flatnonzero(~level.hot), np.flatnonzero(level.hot)
        told = [r["a"] for r in told if r["a"]]
        for k in range(SUMS):
            own = np.concatenate([np.zeros(0, np.int64), *(unpack_ints(a[k]) for a in told)])
            if len(level.count) != len(level.first) or len(own) != len(cold):
                raise RuntimeError(f"chunk {row['chunk']} was not built alike twice: give the operator a written table")
            sums[cold, k] = own
        if len(hot):
            names = [c[level.order[level.opens[hot]]] for c in level.ranked[:-1]]
            first, inverse = _distinct(names)
            shared, none = model.shared.get(n, {}), np.zeros(SUMS)
            sums[hot] = np.stack([shared.get(tuple(int(c[k]) for c in names), none) for k in first])[inverse]
        level.own, level.lower = sums[:, : K + 1], sums[:, K + 1 :]
        levels.append(level)
    return _State(row, tokens, starts, ids, levels)


def _probabilities(state: _State, model: Model) -> np.ndarray:
    """Probability of each token, from the lowest level up."""
    words = state.levels[0]
    p, total, of = model.unigrams.probability(words.count), np.full(1, float(model.unigrams.total)), np.zeros(len(words.count), np.int64)
    below = words
    for n, level in enumerate(state.levels[1:], 2):
        last = below.ended(level.first)  # the n-gram's last n - 1 words
        kept = weighed(level.own, model.factors[n])
        whole = np.where(kept >= level.seen * (1 - 1e-12), level.seen + 1, level.seen)
        lower = weighed(level.lower, model.discount(n - 1)) / total[of[last[level.opens]]]
        backoff = np.where(level.own.sum(1) > 0, (1 - kept / whole) / (1 - lower), 1.0)
        p = np.where(level.count > 0, discounted(level.count, model.factors[n]) / whole[level.history], backoff[level.history] * p[last])
        below, total, of = level, whole, level.history
    return p[below.place][below.ranks]


def _asks(n: int, model: Model, learn: bool):
    """A chunk's n-grams of level ``n``, with their training counts and those of their last n - 1 words."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        state = _restored(texts, told, model, n - 1)
        level = _next(state.levels[-1], state.tokens, state.starts, state.ids, model)
        counts = np.bincount(level.ranks, state.learnt if learn else np.zeros(len(state.tokens)), len(level.first)).astype(np.int64)[level.order]
        lower = state.levels[-1].count[state.levels[-1].ended(level.first)]
        cols = [c[level.order] for c in level.ranked]
        return _asked([(w // 2, w, state.row["chunk"], _packed([c[i:j] for c in cols]), pack_ints(counts[i:j]), pack_ints(lower[i:j])) for w, i, j in _stretches(level.way)])

    return run


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _run(docs: DataFrame, order: int, model: Model | None) -> tuple[Model, DataFrame]:
    """The exchanges, which fit a model where none is given, and the scores."""
    spark, rows = docs.sparkSession, docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType
    arrow_id, learn = to_arrow_type(id_type), model is None
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rounds = max(1, min(ROUNDS, size // ROUND_BYTES))
    if learn:
        model = Model(order, max(dealt(spark), min(-(-size // PART_BYTES), 1 << 20)))
    ways = model.ways

    kinds = {"kind": pa.string(), "way": pa.int32(), "chunk": pa.string(), "a": pa.list_(pa.binary()), "b": pa.binary(), "doc_ids": pa.list_(arrow_id), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "positions": pa.binary(), "place": pa.binary(), "words": pa.int32()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, ways):
            tokens, _ = _sequences(c.positions, c.sizes)
            learnt = np.bincount(c.place[tokens], np.repeat(~c.held, c.sizes + 1) if learn else np.zeros(len(tokens)), len(c.hashes)).astype(np.int64)
            out = [{"kind": "ask", "way": w, "chunk": c.name, "a": [pack(c.hashes[i:j])], "b": pack_ints(learnt[i:j])} for w, i, j in _stretches(c.way)]
            out.append({"kind": "text", "chunk": c.name, "doc_ids": c.ids, "held": c.held.tolist(), "sizes": c.sizes.tolist(), "positions": pack_ints(c.positions), "place": pack_ints(c.place), "words": len(c.hashes)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in kinds.items()], list(kinds))

    answers = Buckets(spark, "chunk")

    def exchange(asked: DataFrame, part, n: int) -> tuple[DataFrame, str]:
        """What the parts of level ``n`` tell, and where it is written."""
        if learn:
            none = pa.table([pa.array([], t) for t in (pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary())], names=["way", "a", "b", "c"])
            made = asked.groupBy("way").applyInArrow(lambda t: part(t, none), OUT)
        else:
            met = model.tables[n].join(F.broadcast(asked.select("way").distinct()), "way", "left_semi")  # parts nobody asks say nothing
            made = asked.groupBy("way").cogroup(met.groupBy("way")).applyInArrow(part, OUT)
        return written(made, f"level{n}", "kind")

    def answered(asked: DataFrame, part, n: int) -> DataFrame:
        """An exchange; the answers among what it told go to the other answers, in the chunks' buckets."""
        told, path = exchange(asked, part, n)
        answers.append(told.where("kind = 'answer'").select("chunk", "way", "a", "b", F.lit(n).alias("level")).repartition(answers.n, "chunk"))
        forget(spark, f"{path}/kind=answer")
        return told.where("kind = 'table'")

    def in_rounds(asked: DataFrame, part, n: int) -> DataFrame:
        """The exchange of what is written first, a share of the parts at a time: only that share is in a shuffle at once."""
        if rounds == 1 or n < 3:
            return answered(asked, part, n)
        made, path = written(asked.withColumn("round", F.col("way") % rounds), f"ask{n}", "round")
        told = []
        for k in range(rounds):
            told.append(answered(made.where(F.col("round") == k).drop("round"), part, n))
            forget(spark, f"{path}/round={k}")
        return reduce(DataFrame.unionAll, told)

    def keep(told: DataFrame, n: int) -> DataFrame:
        """The part of ``told`` that is the model's table becomes that."""
        if learn:
            model.tables[n] = told.where("chunk is null").select("way", "a", "b", "c")
        return told

    def summed(told: DataFrame, n: int) -> np.ndarray:
        found = told.where("chunk = 'sums'").select(*(F.sum(F.col("stats")[k]) for k in range(n))).first()
        return np.array([x or 0.0 for x in found])

    every_id = id_type.simpleString()
    held = Buckets(spark, "chunk", "kind")
    held.append(rows.mapInArrow(split, f"kind string, way int, chunk string, a array<binary>, b binary, doc_ids array<{every_id}>, held array<boolean>, sizes array<long>, positions binary, place binary, words int"))
    made = held.read()
    texts = made.where("kind = 'text'").select("chunk", "doc_ids", "held", "sizes", "positions", "place", "words")
    told = keep(answered(made.where("kind = 'ask'").select("way", F.col("way").alias("part"), "chunk", "a", "b", F.lit(None).cast("binary").alias("c")), _word_part(ways), 1), 1)
    forget(spark, f"{held.path()}/kind=ask")
    if learn:
        sums = summed(told, K + 3)
        mine = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).cast("long")
        model.unigrams = Unigrams.of(int(sums[0]), int(sums[1]), rows.select(mine.alias("t")).agg(F.sum("t")).first()[0] or 0, np.array([0, *sums[2:]]))
    for n in range(2, order + 1):

        told = keep(in_rounds(texts.groupBy("chunk").cogroup(answers.read().groupBy("chunk")).applyInArrow(_asks(n, replace(model, tables={}), learn), ASK), _gram_part(n), n), n)
        if learn:
            model.factors[n] = discounts(np.append(0.0, summed(told, K + 1)))
            hot = told.where("chunk = 'hot'").groupBy(*(F.col("stats")[k].alias(f"x{k}") for k in range(n - 1))).agg(*(F.sum(F.col("stats")[n - 1 + k]) for k in range(SUMS)))
            model.shared[n] = {tuple(map(int, r[: n - 1])): np.array(r[n - 1 :]) for r in hot.collect()}  # HOT and one at most

    now = replace(model, tables={})

    def scored(texts: pa.Table, told: pa.Table) -> pa.Table:
        state, level = _restored(texts, told, now, order), now.unigrams
        counts = state.levels[0].count[state.tokens]
        base = np.log10((counts + 0.1) / (level.tokens + 0.1 * (level.words + 1)))
        per_text = lambda x: np.add.reduceat(x, state.starts[:-1])
        return _table(
            {
                "doc_id": (state.row["doc_ids"], arrow_id),
                "held_out": (state.row["held"], pa.bool_()),
                "n_tokens": (np.diff(state.starts), pa.int64()),
                "n_known": (per_text((counts > 0).astype(np.int64)), pa.int64()),
                "train_tokens": (np.full(len(state.starts) - 1, level.tokens), pa.int64()),
                "base_score": (per_text(base), pa.float64()),
                "score": (per_text(np.log10(_probabilities(state, now))), pa.float64()),
            }
        )

    return model, texts.groupBy("chunk").cogroup(answers.read().groupBy("chunk")).applyInArrow(scored, f"doc_id {every_id}, {SCORES}")


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the documents (doc_id, text) that are not held out."""
    return _run(docs, order, None)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    return _run(docs, model.order, model)[1]


def fit_and_score(docs: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """Both for the same documents, in one exchange a level."""
    return _run(docs, order, None)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: scores of every document."""
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
