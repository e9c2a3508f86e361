"""Passages of held-out texts inside a corpus, by spaced seeds.

Words are hashed; a seed is the hash of the words that a fixed mask shows in a window
of SPAN words, the others being ignored.  Corpus windows that hit a bitmap of the test
items' seeds are kept with the words around them, joined to the seeds exactly, and the
overlaps along each hit's diagonal are verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.llm.looks import SAME_SHAPE, canonical
from presencia.operators.skew import salted_lookup
from presencia.session import materialise, spread

#: Words in a window, and the positions that each mask looks at.
SPAN = 12
MASKS = ((0, 1, 3, 4, 6, 8, 9, 11), (0, 2, 3, 5, 7, 8, 10, 11))
#: Bits of the bitmap for each distinct seed, and its least and greatest size (128 MB): with more seeds it only lets more windows through.
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 30
#: Words kept on either side of a hit, and least words of a kept passage.
CONTEXT, PASSAGE = 64, 1024
#: Distinct seeds that are broadcast at most (16 MB); more are joined by a shuffle.
MAX_SEEDS = 1_000_000
#: Passages of one item that one task verifies.
HOT_PASSAGES = 20_000
#: Score of an equal and of a substituted word in a tolerant overlap.
EQUAL, SUBSTITUTED = 1, -3

_WORD = re.compile(r"[^\W_]+")


@cache
def _folds() -> dict[str, str]:
    """Small letters that have another letter's shape, or whose capitals have, as that letter: words compare without case."""
    pairs = [p for forms in SAME_SHAPE for p in zip(*forms, strict=True)]
    small = {other: form for form, other in pairs if other.casefold() == other}
    return {low: form.lower() for form, other in pairs if len(low := other.casefold()) == 1 and low != form.lower()} | small


@cache
def _foldable() -> re.Pattern[str]:
    return re.compile(f"[{''.join(_folds())}]")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and without differences that are not seen."""
    folded = canonical(text).casefold()
    if not folded.isascii():
        folds = _folds()
        folded = _foldable().sub(lambda m: folds[m[0]], folded)
    return _WORD.findall(folded)


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def seeds(hashes: np.ndarray) -> np.ndarray:
    """Seed hashes of all windows, a row for each mask."""
    n = max(0, len(hashes) - SPAN + 1)
    out = np.zeros((len(MASKS), n), np.uint64)
    for m, mask in enumerate(MASKS):
        for k, at in enumerate(mask):
            out[m] = out[m] * np.uint64(0x9E3779B97F4A7C15) + (hashes[at : at + n] ^ (hashes[at : at + n] >> np.uint64(29))) * np.uint64(2 * k + 0xBF58476D1CE4E5B9)
        out[m] ^= out[m] >> np.uint64(32)
        out[m] = out[m] * np.uint64(0x94D049BB133111EB) + np.uint64(m)
        out[m] ^= out[m] >> np.uint64(29)
    return out


def bitmap_bits(n_seeds: int) -> int:
    """The size of the bitmap for a number of seeds: a power of two within fixed bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n_seeds) * BITS_PER_SEED - 1).bit_length()))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(bits - 1)
    return h & size, (h >> np.uint64(32)) & size


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_hashes(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([w.view(np.int64) for w in found], pa.list_(pa.int64())),
             pa.array([np.unique(seeds(w)).view(np.int64) for w in found], pa.list_(pa.int64()))],
            names=["item_id", "item_words", "seeds"],
        )


def _passages(hit: np.ndarray, n: int, longest: int) -> Iterator[tuple[int, int]]:
    """Stretches of words around the hit windows, in pieces that share the ``longest`` item's words with the next, so each overlap lies in one."""
    size, shared = max(PASSAGE, 4 * longest), longest + SPAN
    start = end = -1
    spans = []
    for at in hit.tolist():
        lo, hi = max(0, at - CONTEXT), min(n, at + SPAN + CONTEXT)
        if start >= 0 and lo <= end:
            end = hi
        else:
            if start >= 0:
                spans.append((start, end))
            start, end = lo, hi
    if start >= 0:
        spans.append((start, end))
    for lo, hi in spans:
        while hi - lo > size:
            yield lo, lo + size
            lo += size - shared
        yield lo, hi


def _scan(bitmap, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                 pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                names=["doc_id", "start", "doc_words", "hits"],
            )
            out.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = word_hashes(text.as_py() or "")
                if len(hashes) < SPAN:
                    continue
                found = seeds(hashes)
                one, two = _probes(found, len(bits) * 8)
                there = ((bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                there &= ((bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(there.any(axis=0))
                if not len(at):
                    continue
                for lo, hi in _passages(at, len(hashes), longest):
                    inside = there[:, lo : hi - SPAN + 1]
                    hits = np.unique(found[:, lo : hi - SPAN + 1][inside])
                    if len(hits):
                        out.append((doc, lo, hashes[lo:hi].view(np.int64), hits.view(np.int64)))
                if len(out) >= 512:
                    yield flush()
        yield flush()

    return run


def overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Longest run of equal words, and words and substitutions of the best tolerant overlap, on all diagonals with a hit."""
    if len(doc) < SPAN or len(item) < SPAN:
        return 0, 0, 0
    marks = np.zeros(len(doc) + len(item), bool)
    for d, i in zip(seeds(doc), seeds(item), strict=True):
        order = np.argsort(d, kind="stable")
        left, right = np.searchsorted(d[order], i, "left"), np.searchsorted(d[order], i, "right")
        for at in np.flatnonzero(right > left):
            marks[order[left[at] : right[at]] - at + len(item)] = True
    run = length = subs = best = 0
    for diagonal in np.flatnonzero(marks) - len(item):
        lo = max(0, diagonal)
        a, b = doc[lo : diagonal + len(item)], item[lo - diagonal :]
        n = min(len(a), len(b))
        equal = a[:n] == b[:n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        if len(edges):
            run = max(run, int((edges[1::2] - edges[::2]).max()))
        total = np.concatenate([[0], np.cumsum(np.where(equal, EQUAL, SUBSTITUTED))])
        floor = np.minimum.accumulate(total)
        end = int(np.argmax(total - floor))
        score = int(total[end] - floor[end])
        if score > best:
            start = int(np.flatnonzero(total[: end + 1] == floor[end])[-1])
            best, length, subs = score, end - start, int(n and (~equal[start:end]).sum())
    return run, length, subs


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            overlap(d.values.to_numpy(zero_copy_only=False).view(np.uint64), i.values.to_numpy(zero_copy_only=False).view(np.uint64))
            for d, i in zip(batch.column(2), batch.column(3), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], pa.int32()) for k in range(3)]],
            names=["item_id", "doc_id", "equal_words", "overlap_words", "substitutions"],
        )


def leaks(corpus: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``item_id, doc_id, equal_words, overlap_words, substitutions`` of each item and document that share a seed.

    ``equal_words`` is the longest run of consecutive words equal in both (all of at least
    SPAN are found; shorter ones only beside a hit); ``overlap_words`` and
    ``substitutions`` describe the best overlap in which equal words count EQUAL and
    substituted ones SUBSTITUTED.  Null and
    empty texts, and items or documents of fewer than SPAN words, share nothing; repeated
    ids give a row for each pair of ids.

    Scale: one map-only pass over the corpus with a bitmap of a size by the seeds, within fixed bounds; only passages
    around hits are kept, in pieces of a few times the longest item; seeds are broadcast only up to MAX_SEEDS.  Hits of a common seed and
    passages of a common item are dealt over sub-keys.
    """
    known = materialise(
        items.select(F.col(item_id).cast("bigint"), F.col(item_text)).mapInArrow(_item_words, "item_id bigint, item_words array<bigint>, seeds array<bigint>"),
        "items",
    )
    seeded = materialise(known.select("item_id", F.explode("seeds").alias("seed")).distinct(), "seeds")
    n_seeds = seeded.count()
    longest = known.agg(F.max(F.size("item_words")).alias("n")).first()["n"] or 0
    size = bitmap_bits(n_seeds)
    probe = F.explode(F.array(F.col("seed").bitwiseAND(size - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(size - 1)))
    bits = seeded.select(probe.alias("bit"))
    pieces = bits.groupBy(F.expr("bit div 32768").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    bitmap = bytearray(size // 8)
    for r in pieces.toLocalIterator():  # at most MOST_BITS / 8 bytes in all
        bitmap[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = r["bits"]
    spark = corpus.sparkSession
    shown = spark.sparkContext.broadcast(bytes(bitmap))
    passages = materialise(
        spread(corpus.select(F.col(doc_id).cast("bigint"), F.col(doc_text)))
        .mapInArrow(_scan(shown, longest), "doc_id bigint, start int, doc_words array<bigint>, hits array<bigint>"),
        "passages",
    )
    hits = passages.select("doc_id", "start", F.explode("hits").alias("seed"))
    if n_seeds <= MAX_SEEDS:
        met = hits.join(F.broadcast(seeded), "seed")
    else:
        met = salted_lookup(hits, seeded.join(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed"), ["seed"], "n", F.struct("doc_id", "start"))
    pairs = materialise(met.select("doc_id", "start", "item_id").distinct(), "pairs")
    held = known.join(pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id").select("item_id", "item_words", "n")
    both = salted_lookup(pairs.join(passages.select("doc_id", "start", "doc_words"), ["doc_id", "start"]), held, ["item_id"], "n", F.struct("doc_id", "start"), hot_rows=HOT_PASSAGES)
    verified = both.select("item_id", "doc_id", "doc_words", "item_words").mapInArrow(
        _verify, "item_id bigint, doc_id bigint, equal_words int, overlap_words int, substitutions int"
    )
    best = F.max(F.struct((F.col("overlap_words") - 4 * F.col("substitutions")).alias("s"), "overlap_words", (-F.col("substitutions")).alias("x")))
    return (
        verified.groupBy("item_id", "doc_id").agg(F.max("equal_words").alias("equal_words"), best.alias("b"))
        .select("item_id", "doc_id", "equal_words", "b.overlap_words", (-F.col("b.x")).alias("substitutions"))
    )


def leaked(found: DataFrame, words_: int = SPAN) -> Column:
    """Whether a row of :func:`leaks` has ``words_`` consecutive words in common."""
    return found["equal_words"] >= words_
