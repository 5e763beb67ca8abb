"""Spelling variants: one-edit neighbourhoods over a reduced alphabet, checked on the words.

Letters are hashed to a few symbols, so an edit of a word is at most one edit of its reduced
word. For every reduced word its one-edit neighbourhood is generated and joined with the
vocabulary's reduced words. Of the two words of a pair exactly one generates it: the longer one
by a deletion (which stands for the insertion of the other), and of two equally long ones the
one whose symbol is raised (which stands for the lowering of the other); words with the same
reduced word meet by that. A key is a 64-bit hash of the edited reduced word, taken from prefix
sums, so a word of ``L`` letters costs ``O(kL)`` numbers however long it is. The number of
symbols ``k`` grows with the vocabulary: a key meets few words at any size, and results do not
depend on it. A set of letters (each by its parity) goes with the key and drops nearly all false
candidates in the join; what is left is compared exactly on the words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import encoded, map_arrow, materialised, mix, slices, text_of

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000
#: Neighbour keys generated at once.
KEYS = 2_000_000
_LETTER = "A-Za-zÀ-ÿ"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, id_column: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slips: int = 0) -> DataFrame:
    """Words of all whole texts with their number: (word, n).

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with only A-Z lower-cased.
    With ``slips`` a word whose crc32 of ``<id>:<word>`` that number divides loses one letter in
    that document (letter ``crc32 % length``); rows without an id keep theirs.
    """
    run_of = re.compile(f"[{_LETTER}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches, "_text"):
            for name, text in zip(batch.column("_id").to_pylist(), encoded(batch, "_text")):
                mark = None if name is None or not slips else zlib.crc32(f"{name}:".encode())
                for word in run_of.findall(text.lower().decode("utf-8", "replace")):
                    if mark is not None:
                        h = zlib.crc32(word.encode(), mark)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) >= COUNTED:
                    yield counted()
        if seen:
            yield counted()

    rows = docs.select(F.col(id_column).cast("string").alias("_id"), text_of().alias("_text"))
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: enough that short reduced words are shared by few words."""
    return max(4, min(64, math.ceil((words / 64) ** (1 / MIN_LENGTH))))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _FACTOR, dtype=np.uint64)
    down = np.full(n, np.uint64(pow(int(_FACTOR), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _finish(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


class Reduced:
    """Reduced words of one batch of words, laid end to end."""

    def __init__(self, words: list[str], k: int):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.k = k
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.end = np.cumsum(self.length)
        self.begin = self.end - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.at = np.arange(len(letters)) - self.begin[self.word]
        self.symbol = (mix(letters) % np.uint64(k)).astype(np.int64)
        self.up, self.down = _powers(int(self.length.max(initial=0)) + 2)
        terms = np.concatenate((np.zeros(1, np.uint64), (self.symbol.astype(np.uint64) + np.uint64(1)) * self.up[self.at]))
        self.sums = np.cumsum(terms, dtype=np.uint64)
        self.hash = self.sums[self.end] - self.sums[self.begin]
        self.code = _finish(self.hash, self.length)
        mask = np.zeros(len(words), dtype=np.uint64)
        if len(letters):
            bit = np.uint64(1) << (mix(letters + np.uint64(7)) % np.uint64(64))
            filled = self.length > 0
            mask[filled] = np.bitwise_xor.reduceat(bit, self.begin[filled])
        self.mask = mask.view(np.int64)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of every word with one symbol less; equal results of one run once."""
        new = np.ones(len(self.symbol), dtype=bool)
        new[1:] = (self.symbol[1:] != self.symbol[:-1]) | (self.at[1:] == 0)
        at = np.flatnonzero(new)
        word = self.word[at]
        rest = (self.sums[self.end[word]] - self.sums[at + 1]) * self.down[1] + (self.sums[at] - self.sums[self.begin[word]])
        return word, _finish(rest, self.length[word] - 1)

    def raised(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of every word with one symbol raised by ``step``."""
        at = np.flatnonzero(self.symbol + step < self.k)
        word = self.word[at]
        return word, _finish(self.hash[word] + np.uint64(step) * self.up[self.at[at]], self.length[word])


def near_pairs(vocabulary: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of ids of words that differ by exactly one inserted, deleted or replaced letter, once each.

    ``vocabulary`` has id and word and stands in a written table, its words are distinct.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            own = Reduced(batch.column("word").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.code), pa.array(own.mask)], names=["id", "key", "letters"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 256 << 10):
            own = Reduced(batch.column("word").to_pylist(), k)
            ids = batch.column("id").to_numpy()
            for word, key in (own.deletions(), *(own.raised(step) for step in range(1, k))):
                for s in range(0, len(word), KEYS):
                    at = word[s : s + KEYS]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(key[s : s + KEYS]), pa.array(own.mask[at])], names=["id", "key", "letters"])

    schema = "id long, key long, letters long"
    words = vocabulary.select("id", "word")
    codes = map_arrow(words, coded, schema)
    keys = map_arrow(words, neighbours, schema)
    other = codes.select(F.col("id").alias("b"), "key", F.col("letters").alias("of_b"))
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("of_b"))) <= 2
    # The merge hint keeps every side out of memory: both grow with the vocabulary.
    moved = keys.join(other.hint("merge"), (keys["key"] == other["key"]) & alike).select(F.col("id").alias("a"), "b")
    same = codes.join(other.hint("merge"), (codes["key"] == other["key"]) & alike & (codes["id"] < F.col("b"))).select(F.col("id").alias("a"), "b")
    met = moved.unionByName(same)
    first = vocabulary.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    second = vocabulary.select(F.col("id").alias("b"), F.col("word").alias("word_b"))
    one = F.levenshtein("word_a", "word_b", 1) == 1
    found = met.join(first, "a").join(second, "b").where(one)
    # Keys are hashes: two edits of a word may collide, so a pair may come twice.
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) for every (word, form): the last word that forms lead to.

    A form has at least ``ratio`` times its word's number, so no chain is longer than the
    logarithm of ``most``, the largest number; every round doubles the steps taken.
    """
    longest = max(1, math.ceil(math.log(max(2, most), ratio)))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        now = now.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        now = materialised(now, "spelling-roots")
    return now


def variants(
    docs: DataFrame, id_column: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
    slips: int = 0, symbols: int | None = None,
) -> DataFrame:
    """One row per word of all whole texts: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest number (ties: the smallest in code-point order) where
    that number is at least ``ratio`` times the word's; ``root`` follows forms to the last word
    and is the word itself without a form. Null and empty texts have no words; repeated rows
    count each time; rows without an id are counted like others. A table without words gives no
    rows. Other columns are ignored, whatever their names. ``symbols`` fixes the size of the
    reduced alphabet, which otherwise follows from the number of words.
    """
    counted = word_counts(docs, id_column, min_length, min_count, slips)
    vocabulary = materialised(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    total, most = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    pairs = materialised(near_pairs(vocabulary, symbols or symbols_for(total)), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(vocabulary.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other")), "b")
    best = near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("other"))
    formed = F.col("other.less") <= F.lit(-ratio) * F.col("n")
    joined = vocabulary.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("other.word")).alias("form"), F.when(formed, -F.col("other.less")).alias("form_n"),
    )
    words = materialised(joined, "spelling-forms")
    last = roots(words.where("form IS NOT NULL"), most, ratio)
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
