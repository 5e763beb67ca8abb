"""Token counts without ids: pieces per distinct pre-token, times its frequency per document.

A task keeps one vocabulary of pre-tokens (a new one beyond ``VOCABULARY``) and writes its
documents in blocks of about ``BLOCK_BYTES``: the frequencies as a sparse matrix in variable-length
bytes, numbered by the vocabulary. The pre-tokens of all vocabularies are brought together, each
is tokenised once, and the piece counts go back to the vocabularies; a matrix product then gives
the counts of the documents. A frequent pre-token is one row per vocabulary, never one per
document, so no key is hot, and what a task holds is one block and one vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import encoded, map_arrow, materialised, slices, text_of

BLOCK_BYTES = 12 << 20
#: Words and pre-tokens of one vocabulary; a block may run over it.
VOCABULARY = 400_000
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class PreTokens:
    """The pre-tokens of one word. White space is dropped by the vocabulary's pattern, so the
    words between ASCII spaces can be treated one by one, and equal words once."""

    #: Mark of a special token's string among the pre-tokens; it is one id.
    SPECIAL = "\0"

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def of(self, word: bytes) -> list[str]:
        text = word.decode("utf-8", "replace")
        out: list[str] = []
        while self.special and (hit := self.special.search(text)):
            out += self._plain(text[: hit.start()])
            out.append(self.SPECIAL + hit.group())
            text = text[hit.end() :]
        return out + self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, pretoken: str) -> int:
        if pretoken.startswith(self.SPECIAL):
            return 1
        return len(self.tokenizer.model.tokenize(pretoken))


def var_bytes(values: np.ndarray) -> bytes:
    """Numbers below 2^35 in groups of seven bits, the lowest first; the high bit says that more follow."""
    values = values.astype(np.uint64)
    more = [values >= np.uint64(1 << 7 * k) for k in range(1, 5)]
    size = 1 + sum(m.astype(np.int64) for m in more)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(5):
        own = np.ones(len(values), dtype=bool) if k == 0 else more[k - 1]
        low = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[own] + k] = low | ((size[own] > k + 1).astype(np.uint64) << np.uint64(7))
    return out.tobytes()


def from_var_bytes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.int64)
    end = np.flatnonzero(data < 128)
    start = np.append(0, end[:-1] + 1)
    shift = np.arange(len(data)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), start)


class _Vocabulary(dict):
    """Numbers of words in order of appearance, and their pre-tokens, numbered likewise."""

    def __init__(self, cut: PreTokens):
        super().__init__()
        self.cut, self.pretokens, self.flat, self.sizes = cut, {}, [], []

    def __missing__(self, word: bytes) -> int:
        own = [self.pretokens.setdefault(p, len(self.pretokens)) for p in self.cut.of(word)]
        self.flat += own
        self.sizes.append(len(own))
        self[word] = number = len(self)
        return number

    def matrix(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pre-token, times) by document, then pre-token."""
        words = [t.split() for t in texts]
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = np.fromiter((n for own in words for n in map(self.__getitem__, own)), dtype=np.int64, count=int(count.sum()))
        # Words of each document, then pre-tokens.
        pair, times = np.unique(np.repeat(np.arange(len(texts)), count) * (len(self) + 1) + number, return_counts=True)
        owner, word = pair // (len(self) + 1), pair % (len(self) + 1)
        flat, sizes = np.array(self.flat, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        begin, each = np.cumsum(sizes) - sizes, sizes[word] if len(word) else np.empty(0, dtype=np.int64)
        total = np.cumsum(each)
        term = flat[np.arange(total[-1] if len(total) else 0) + np.repeat(begin[word] - (total - each), each)]
        width = len(self.pretokens) + 1
        pair, inverse = np.unique(np.repeat(owner, each) * width + term, return_inverse=True)
        return pair // width, pair % width, np.bincount(inverse, weights=np.repeat(times, each), minlength=len(pair)).astype(np.int64)


def _blocks(docs: DataFrame, path: str, id_column: str) -> DataFrame:
    """Rows of blocks (without ``vocab``) and rows of vocabularies (``vocab`` from number ``at`` on)."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([
        T.StructField("vocabulary", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_bytes", T.ArrayType(T.LongType())),
        T.StructField("n_terms", T.BinaryType()), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("at", T.IntegerType()), T.StructField("vocab", T.ArrayType(T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, name = PreTokens(path), TaskContext.get().partitionId() << 24
        known, types = _Vocabulary(cut), None

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *values), types)], names=[f.name for f in schema])

        def vocabulary() -> Iterator[pa.RecordBatch]:
            all_ = list(known.pretokens)
            for s in range(0, len(all_), 1 << 16):
                yield row(None, None, None, None, None, s, all_[s : s + (1 << 16)])

        for batch in slices(batches, "_text", BLOCK_BYTES):
            if len(known) > VOCABULARY or len(known.pretokens) > VOCABULARY:
                yield from vocabulary()
                known, name = _Vocabulary(cut), name + 1
            ids = batch.column(id_column)
            types = [pa.int64(), pa.list_(ids.type), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int32(), pa.list_(pa.string())]
            texts = encoded(batch, "_text")
            owner, term, times = known.matrix(texts)
            first = np.ones(len(owner), dtype=bool)
            first[1:] = owner[1:] != owner[:-1]
            gap = np.where(first, term, np.diff(term, prepend=0))  # from pre-token to pre-token of a document
            yield row(
                ids.to_pylist(), [len(t) for t in texts], var_bytes(np.bincount(owner, minlength=len(texts))),
                var_bytes(gap * 2 + (times > 1)), var_bytes(times[times > 1]), None, None,
            )
        if known.pretokens:
            yield from vocabulary()

    return materialised(map_arrow(docs.select(id_column, text_of().alias("_text")), run, schema), "token-blocks")


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Tokens of every document as the tokenizer file at ``path`` gives them.

    Columns: the id, n_bytes, n_tokens. Null and empty texts have 0 of both. Repeated rows come
    out as often as they come in. Strings of special tokens count as one token, as the library
    does by default; no begin or end tokens are added. An empty table gives no rows; other
    columns are ignored.
    """
    stored = _blocks(docs, path, id_column)
    blocks = stored.where("vocab IS NULL").drop("vocab", "at")
    listed = stored.where("vocab IS NOT NULL").select("vocabulary", "at", F.posexplode("vocab").alias("pos", "pretoken"))
    listed = listed.select("vocabulary", (F.col("at") + F.col("pos")).alias("pos"), "pretoken")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal pre-tokens come one after the other: each is tokenised once."""
        cut = PreTokens(path)
        before, known = None, 0
        for batch in batches:
            counts = []
            for pretoken in batch.column("pretoken").to_pylist():
                if pretoken != before:
                    before, known = pretoken, cut.pieces(pretoken)
                counts.append(known)
            # Back to the vocabularies: one row per vocabulary and batch, not one per pre-token.
            owner, pos, got = batch.column("vocabulary").to_numpy(), batch.column("pos").to_numpy(), np.array(counts, dtype=np.int64)
            order = np.lexsort((pos, owner))
            ids, begin = np.unique(owner[order], return_index=True)
            places, amounts = np.split(pos[order], begin[1:]), np.split(got[order], begin[1:])
            columns = [[var_bytes(np.diff(p, prepend=0)) for p in places], [var_bytes(a) for a in amounts]] if len(ids) else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x, pa.binary()) for x in columns]], names=["vocabulary", "pos", "pieces"])

    sorted_ = listed.repartition("pretoken").sortWithinPartitions("pretoken")
    counted = map_arrow(sorted_, pieces, "vocabulary long, pos binary, pieces binary").groupBy("vocabulary").agg(
        F.collect_list(F.struct("pos", "pieces")).alias("counts")
    )
    schema = T.StructType([docs.schema[id_column], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids").flatten()
                got = row.column("counts").flatten()
                parts = [(np.cumsum(from_var_bytes(p)), from_var_bytes(a)) for p, a in zip(got.field("pos").to_pylist(), got.field("pieces").to_pylist())]
                weight = np.zeros(1 + max((int(p[-1]) for p, _ in parts if len(p)), default=0), dtype=np.int64)
                for place, amount in parts:
                    weight[place] = amount
                n_terms, gap, many = (from_var_bytes(row.column(c)[0].as_py()) for c in ("n_terms", "terms", "times"))
                times = np.ones(len(gap), dtype=np.int64)
                times[gap % 2 == 1] = many
                upto = np.concatenate(([0], np.cumsum(gap // 2)))
                start = np.cumsum(n_terms) - n_terms
                term = upto[1:] - np.repeat(upto[start], n_terms)
                owner = np.repeat(np.arange(len(ids)), n_terms)
                tokens = np.bincount(owner, weights=weight[term] * times, minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, row.column("n_bytes").flatten(), pa.array(tokens)], names=[f.name for f in schema])

    return map_arrow(blocks.join(counted, "vocabulary", "left"), product, schema)
