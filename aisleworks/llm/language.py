"""Language identification of mixed text: script ranges, word scores, Viterbi over the words.

Training counts letter trigrams (word edges included) and scripts per language over all given
rows. A word's script narrows its candidates to the languages written in it; its score in each
is the sum of its trigrams' log probabilities. Viterbi with a fixed penalty for a change of
language labels the words, and equal neighbours form spans. The model is a table of fixed
size per language (trigrams are hashed), so it may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import map_arrow, slices, text_of

#: Hashed trigrams per language.
BUCKETS = 1 << 15
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: Every value of the label column is a language; more of them than this are refused, never dropped.
LANGUAGES = 256
#: A language is written in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Characters handled at once; one text is never cut.
_SLICE = 4 << 20

#: First and last code point of the main Unicode blocks of each script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF))),
)
OTHER = len(SCRIPTS)
WIDTH = BUCKETS + len(SCRIPTS) + 1


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its script."""
    if not _TABLES:
        script = np.full(0x110000, OTHER, dtype=np.uint8)
        for code, (_, blocks) in enumerate(SCRIPTS):
            for first, last in blocks:
                script[first : last + 1] = code
        _TABLES["letters"], _TABLES["script"] = _letters(), script
    return _TABLES["letters"], _TABLES["script"]


class Words:
    """Words (runs of letters) of several texts as arrays over one sequence of code points."""

    def __init__(self, texts: list[str]):
        letters, scripts = _tables()
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        # Lower-casing one by one keeps positions; the few letters that grow keep their case.
        lowered = "\n".join(t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts)
        self.points = np.frombuffer(("\n" + lowered + "\n\n").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        edges = np.concatenate(([1], 1 + np.cumsum(sizes)))
        is_letter = letters[self.points]
        change = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        self.starts, self.ends = change[0::2], change[1::2]
        self.first = np.searchsorted(self.starts, edges)
        self.text_start = edges[:-1]
        self.script = scripts[self.points[self.starts]].astype(np.int64) if len(self.starts) else np.empty(0, dtype=np.int64)
        # Trigrams end at each letter and at the edge after the word; edges are one symbol.
        plain = np.where(is_letter, self.points, 32).astype(np.uint64)
        before = np.where(plain[1:-1] == 32, np.uint64(32), plain[:-2])
        grams = (plain[2:] * np.uint64(0x9E3779B1) + plain[1:-1] * np.uint64(0x85EBCA77) + before * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        self.bucket = np.concatenate(([0, 0], (grams >> np.uint64(64 - 15)).astype(np.int64)))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of ``table`` rows over the trigrams of each word: those ending at start .. end."""
        if not len(self.starts):
            return np.zeros((0, table.shape[1]), dtype=np.float32)
        lengths = self.ends - self.starts + 1
        begin = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts - begin, lengths)
        return np.add.reduceat(table[self.bucket[at]], begin, axis=0)

    def gram_positions(self, a: int, b: int) -> np.ndarray:
        """Buckets of all trigrams of words ``a`` to ``b``."""
        lengths = self.ends[a:b] - self.starts[a:b] + 1
        begin = np.cumsum(lengths) - lengths
        return self.bucket[np.arange(int(lengths.sum())) + np.repeat(self.starts[a:b] - begin, lengths)]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per word. ``first``: the first word of each text, and the number of words.

    Texts go in step, longest first, so one step handles one word of every text that has it.
    """
    words, labels = scores.shape
    out = np.zeros(words, dtype=np.int64)
    if not words or labels == 1:
        return out
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], first[:-1][order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    best_before = np.zeros(words, dtype=np.int16)
    switched = np.zeros((words, labels), dtype=bool)
    value = scores[starts[: active[0]]].astype(np.float64)
    for t in range(1, longest):
        k = int(active[t])
        if k < len(value):  # these texts ended with the word before
            out[starts[k : len(value)] + t - 1] = value[k:].argmax(axis=1)
            value = value[:k]
        top = value.argmax(axis=1)
        jump = (value[np.arange(k), top] - penalty)[:, None]
        at = starts[:k] + t
        best_before[at] = top
        move = jump > value
        switched[at] = move
        value = np.where(move, jump, value) + scores[at]
    out[starts[: len(value)] + longest - 1] = value.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        at = starts[: int(active[t])] + t
        after = out[at]
        out[at - 1] = np.where(switched[at, after], best_before[at], after)
    return out


class Model:
    """Trigram log probabilities and scripts of the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        share = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.table = np.ascontiguousarray(np.log(share).T.astype(np.float32))
        written = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
        written[:, ~written.any(axis=0)] = True  # a script nobody writes narrows nothing
        self.barred = np.where(written, 0, -1e6).astype(np.float32).T.copy()

    def scores(self, words: Words) -> np.ndarray:
        return words.sums(self.table) + self.barred[words.script]


def fit(docs: DataFrame, label: str = "lang", languages: int = LANGUAGES) -> Model:
    """Count all rows of ``docs`` with a label, in jobs of its own while a query is built.

    All label values are learned; a table with more than ``languages`` of them raises ValueError.
    Counts of fixed size per language come back to the driver.
    """
    labelled = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_lang"), text_of().alias("_text"))
    names = sorted(r[0] for r in labelled.select("_lang").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"more than {languages} values in column {label}: set languages higher, or clean the labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(names)}
        total = np.zeros((len(names), WIDTH), dtype=np.int64)
        for batch in slices(batches, "_text", _SLICE):
            known = [(place[k], t) for k, t in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()) if k in place]
            known.sort(key=lambda x: x[0])
            if not known:
                continue
            words = Words([t for _, t in known])
            owner = np.array([k for k, _ in known])
            for k in np.unique(owner):
                at = np.flatnonzero(owner == k)
                a, b = words.first[at[0]], words.first[at[-1] + 1]
                total[k, :BUCKETS] += np.bincount(words.gram_positions(a, b), minlength=BUCKETS)
                total[k, BUCKETS:] += np.bincount(words.script[a:b], weights=words.ends[a:b] - words.starts[a:b], minlength=WIDTH - BUCKETS).astype(np.int64)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, at, total[k, at])], names=["k", "at", "n"])

    counts = np.zeros((len(names), WIDTH), dtype=np.int64)
    if names:
        got = map_arrow(labelled, run, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("k").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Model(names, counts)


SPANS = "array<struct<start:bigint,end:bigint,lang:string,letters:bigint>>"


def label_spans(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), penalty: float = SWITCH) -> DataFrame:
    """``keep`` and ``spans``: language, characters start to end, number of letters.

    Null texts, texts without letters and an untrained model give no spans. Texts are read as
    a whole. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("spans", T._parse_datatype_string(SPANS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.languages, pa.string())
        for batch in slices(batches, "_text", _SLICE):
            words = Words(batch.column("_text").to_pylist())
            n = batch.num_rows
            if model.languages and len(words.starts):
                label = viterbi(model.scores(words), words.first, penalty)
                opens = np.ones(len(label), dtype=bool)
                opens[1:] = label[1:] != label[:-1]
                opens[words.first[:-1][words.first[:-1] < len(label)]] = True
                begin = np.flatnonzero(opens)
                last = np.append(begin[1:], len(label)) - 1
                owner = np.searchsorted(words.first, begin, side="right") - 1
                letters = np.add.reduceat(words.ends - words.starts, begin)
                fields = [pa.array(words.starts[begin] - words.text_start[owner]), pa.array(words.ends[last] - words.text_start[owner]), names.take(pa.array(label[begin])), pa.array(letters)]
                offsets = np.searchsorted(owner, np.arange(n + 1))
            else:
                fields = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())]
                offsets = np.zeros(n + 1, dtype=np.int64)
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "end", "lang", "letters"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], spans], names=[f.name for f in schema])

    return map_arrow(docs.select(*keep, text_of().alias("_text")), run, schema)


def main_language(languages: list[str], spans: Column) -> tuple[Column, Column]:
    """The language with most letters (first by name among equals) and its share of them."""
    if not languages:
        return F.lit("und"), F.lit(0.0)
    def count(name) -> Column:
        return F.aggregate(F.filter(spans, lambda s: s["lang"] == name), F.lit(0).cast("long"), lambda a, s: a + s["letters"])
    each = F.transform(F.array(*[F.lit(x) for x in languages]), lambda name, i: F.struct(count(name).alias("n"), (-i).alias("i"), name.alias("lang")))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["letters"])
    best = F.array_max(each)
    return F.when(total > 0, best["lang"]).otherwise(F.lit("und")), F.when(total > 0, best["n"] / total).otherwise(F.lit(0.0))


def predict(docs: DataFrame, folds: int = 5, id_column: str = "doc_id", label: str = "lang", penalty: float = SWITCH) -> DataFrame:
    """id, held_out, lang_pred, score, n_spans; trained on the rows that are not held out.

    A row is held out where the CRC-32 of its id as text is divisible by ``folds``. Rows with a
    null id or label are predicted but not learned from. ``und`` with score 0 stands for texts
    without letters, and for all texts where nothing could be learned.
    """
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % folds
    model = fit(docs.where(remainder != 0), label)
    name, score = main_language(model.languages, F.col("spans"))
    return label_spans(docs, model, (id_column,), penalty).select(
        id_column, F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), name.alias("lang_pred"), score.alias("score"), F.size("spans").alias("n_spans")
    )
