"""Periodic runs of words, found on a grammar of each text.

A run is a longest stretch of words with a smallest period ``q`` and at least ``max(least, 3q)``
words. Every word of a run occurs three times in it, so texts are first reduced to stretches of
words that do. A stretch is compressed by Re-Pair: pairs of symbols that occur twice become
nonterminals, the most frequent first. Pairs that do not touch a more frequent one are replaced
in the same round, in all texts of a batch at once.

Every run lies in a lowest node of the derivation, whose boundary it crosses. So each nonterminal
is looked at once, in one of its places: for the words at its boundary the runs of the expansion
that cross it are found by extending matches at a distance of ``q`` to both sides (names of
2^k-grams compare stretches exactly). Boundaries of the start rule see the whole stretch. The
runs of a nonterminal then hold in every place of the derivation; what lies inside a longer run
of the same period is merged into it.

Spark splits the documents; no row needs another, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import encoded, map_arrow, mix, slices, text_of

LEAST, PERIODS = 24, 3
#: Candidate periods extended at once.
AT_ONCE = 1_000_000


class _Codes(dict):
    """Numbers of values in order of appearance."""

    def __missing__(self, value):
        self[value] = code = len(self)
        return code


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` items per row: the row of each item and its number there."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def stretches(word: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a run can hold, and the stretch of each.

    A stretch is ``least`` or more consecutive words of one text, each of which occurs at least
    ``PERIODS`` times in the stretch.
    """
    at, group = np.arange(len(word)), owner
    while len(at):
        _, code, times = np.unique(group * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        keep = times[code] >= PERIODS
        at, old = at[keep], group[keep]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (old[1:] != old[:-1])
        group = np.cumsum(new) - 1
        long = np.bincount(group, minlength=1)[group] >= least if len(at) else np.zeros(0, dtype=bool)
        at, group = at[long], group[long]
        if keep.all() and long.all():
            break
    return at, group


class Grammar:
    """Re-Pair grammars of many texts, laid end to end, without symbols in common.

    Symbols below ``terminals`` are words of a text. A nonterminal has ``left`` and ``right``, a
    size in words and a place in which it occurs. ``root`` and ``root_at`` list the symbols of
    all start rules by place.
    """

    def __init__(self, symbol: np.ndarray, text: np.ndarray):
        self.terminals = int(symbol.max(initial=-1)) + 1
        self.size = np.ones(self.terminals, dtype=np.int64)
        self.place = np.zeros(self.terminals, dtype=np.int64)
        self.left = self.right = np.full(self.terminals, -1, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(len(symbol))
        while len(symbol):
            met = text[1:] == text[:-1]
            key = np.where(met, symbol[:-1] * len(self.size) + symbol[1:], -1)
            # Of overlapping pairs (a a in a a a) every second counts.
            number = np.arange(len(key))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            even = (number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0
            distinct, code = np.unique(key, return_inverse=True)
            times = np.bincount(code[even], minlength=len(distinct))
            times[distinct < 0] = 0
            alive = times[code] >= 2
            touched = np.zeros(len(symbol), dtype=bool)
            touched[:-1] |= alive
            touched[1:] |= alive
            # A pair that does not occur twice never will: such symbols stand in the start rule.
            done.append((symbol[~touched], at[~touched]))
            if not alive.any():
                break
            rank = np.empty(len(distinct), dtype=np.int64)
            rank[np.lexsort((mix(distinct.view(np.uint64)), times))] = np.arange(len(distinct))
            weight = np.where(alive & even, rank[code], -1)
            taken = weight >= 0
            taken[1:] &= weight[1:] > weight[:-1]
            taken[:-1] &= weight[:-1] > weight[1:]
            taken &= np.bincount(code[taken], minlength=len(distinct))[code] >= 2
            where = np.flatnonzero(taken)
            _, first, new = np.unique(code[where], return_index=True, return_inverse=True)
            first = where[first]
            made = len(self.size) + new
            size = self.size[symbol[first]] + self.size[symbol[first + 1]]
            self.left, self.right = np.append(self.left, symbol[first]), np.append(self.right, symbol[first + 1])
            self.place, self.size = np.append(self.place, at[first]), np.append(self.size, size)
            # Dead pairs part a text: no later pair may join what is not side by side.
            split = np.zeros(len(symbol), dtype=np.int64)
            split[1:] = ~alive
            symbol[where] = made
            touched[where + 1] = False
            text = np.cumsum(split)[touched]
            symbol, at = symbol[touched], at[touched]
        symbols, places = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in zip(*done)) if done else (np.empty(0, dtype=np.int64),) * 2
        order = np.argsort(places, kind="stable")
        self.root, self.root_at = symbols[order], places[order]

    def places(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Every place in the derivations of nonterminals of at least ``least`` words: (symbol, place)."""
        symbol, at = self.root, self.root_at
        found = []
        while len(symbol):
            keep = (symbol >= self.terminals) & (self.size[symbol] >= least)
            symbol, at = symbol[keep], at[keep]
            found.append((symbol, at))
            left, right = self.left[symbol], self.right[symbol]
            symbol, at = np.concatenate((left, right)), np.concatenate((at, at + self.size[left]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2


class Matches:
    """How far equal words reach from two positions of a text, by names of 2^k-grams.

    A position has a name on level ``k`` where its 2^k-gram occurs again in the text.
    """

    def __init__(self, symbol: np.ndarray, text: np.ndarray):
        self.names: list[np.ndarray] = []
        n, k = len(symbol), 0
        at, code = np.arange(n), symbol
        while True:
            _, code, times = np.unique(code, return_inverse=True, return_counts=True)
            again = times[code] >= 2
            at, code = at[again], code[again]
            names = np.full(n, -1, dtype=np.int64)
            names[at] = code
            self.names.append(names)
            if not len(at):
                break
            ahead = at + (1 << k)
            inside = ahead < n
            at, ahead = at[inside], ahead[inside]
            both = (names[ahead] >= 0) & (text[at] == text[ahead])
            at, ahead = at[both], ahead[both]
            code = names[at] * (int(names.max()) + 1) + names[ahead]
            k += 1
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n = n

    def sorted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._sorted:
            at = np.flatnonzero(self.names[k] >= 0)
            key = self.names[k][at] * self.n + at
            order = np.argsort(key, kind="stable")
            self._sorted[k] = key[order], at[order]
        return self._sorted[k]

    def between(self, k: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``low <= p < high`` with the 2^k-gram of ``at``: (row of ``at``, p)."""
        keys, places = self.sorted(k)
        name = np.where((at >= 0) & (at < self.n), self.names[k][np.clip(at, 0, max(0, self.n - 1))], -1)
        low, high = np.clip(low, 0, self.n), np.clip(high, 0, self.n)
        a, b = np.searchsorted(keys, name * self.n + low), np.searchsorted(keys, name * self.n + high)
        row, nth = spread(np.where(name >= 0, np.maximum(b - a, 0), 0))
        return row, places[a[row] + nth]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            names = np.append(self.names[k], -1)
            own = names[np.minimum(i, self.n)]
            step = np.where((own >= 0) & (own == names[np.minimum(j, self.n)]), 1 << k, 0)
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before ``i`` and ``j``."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            own = np.where(a >= 0, self.names[k][np.maximum(a, 0)], -1)
            step = np.where((own >= 0) & (b >= 0) & (own == self.names[k][np.maximum(b, 0)]), 1 << k, 0)
            i -= step
            j -= step
        return start - i


def crossing(matches: Matches, at: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs inside ``low <= p < high`` that hold the words on both sides of ``at``: (row, start, end, period).

    The longer side of a run has ``max(least / 2, 3q / 2)`` words, so ``max(least / 2 - q, q / 2)``
    words at the boundary match those ``q`` away: a gram of fixed length for each octave of ``q``.
    """
    gram = max(0, (least // 6).bit_length() - 1)  # 2^gram <= least / 6, the least of both over q
    found = []
    for c in range(len(matches.names)):
        k = gram + c
        q_low, q_high = (1, 4 << k) if c == 0 else (2 << k, 4 << k)
        if k >= len(matches.names):
            break
        for side in (0, 1):
            own = at if side == 0 else at - (1 << k)
            a, b = (at + q_low, np.minimum(at + q_high, high)) if side == 0 else (np.maximum(own - q_high + 1, low), own - q_low + 1)
            for s in range(0, len(at), AT_ONCE // 8):
                part = slice(s, s + AT_ONCE // 8)
                row, other = matches.between(k, own[part], a[part], b[part])
                row += s
                for t in range(0, len(row), AT_ONCE):
                    r, p = row[t : t + AT_ONCE], other[t : t + AT_ONCE]
                    q = np.abs(p - own[r])
                    one, two = (at[r], at[r] + q) if side == 0 else (at[r] - q, at[r])
                    start = one - np.minimum(matches.behind(one, two), one - low[r])
                    end = two + np.minimum(matches.ahead(one, two), high[r] - two)
                    keep = (end - start >= np.maximum(least, PERIODS * q)) & (start < at[r]) & (end > at[r])
                    found.append((r[keep], start[keep], end[keep], q[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 4


def smallest(group: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per stretch: a stretch with several periods has the smallest (the others are its multiples)."""
    order = np.lexsort((period, end, start, group))
    group, start, end, period = (x[order] for x in (group, start, end, period))
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return group[new], start[new], end[new], period[new]


def runs(word: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of many texts: (start, end, period) by start, then period; positions in ``word``.

    ``word`` has the words' numbers, text after text; ``owner`` the text of each.
    """
    where, text = stretches(word, owner, least)
    if not len(where):
        return (np.empty(0, dtype=np.int64),) * 3
    _, symbol = np.unique(text * (int(word.max()) + 1) + word[where], return_inverse=True)
    grammar, matches = Grammar(symbol.copy(), text), Matches(symbol, text)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    last = np.append(first[1:], len(text))

    rules = np.arange(grammar.terminals, len(grammar.size))
    rules = rules[grammar.size[rules] >= least]
    low = grammar.place[rules]
    row, start, end, period = crossing(matches, low + grammar.size[grammar.left[rules]], low, low + grammar.size[rules], least)
    row, start, end, period = smallest(row, start, end, period)
    start, end = start - low[row], end - low[row]
    symbols, at = grammar.places(least)
    # The runs of a nonterminal, once for each of its places.
    begin, stop = np.searchsorted(row, np.arange(len(rules))), np.searchsorted(row, np.arange(len(rules)), side="right")
    number = np.searchsorted(rules, symbols)
    place, nth = spread(stop[number] - begin[number]) if len(rules) else (np.empty(0, dtype=np.int64),) * 2
    own = begin[number[place]] + nth if len(rules) else place
    inside = (at[place] + start[own], at[place] + end[own], period[own]) if len(own) else (own, own, own)

    cuts = grammar.root_at
    cuts = cuts[~np.isin(cuts, first, assume_unique=True)]
    own_text = text[cuts]
    top = crossing(matches, cuts, first[own_text], last[own_text], least)
    start, end, period = (np.concatenate(x) for x in zip(inside, top[1:]))
    _, start, end, period = smallest(np.zeros(len(start), dtype=np.int64), start, end, period)
    # Merge: within one period, what a longer stretch holds goes.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = end + period * (len(where) + 1)
    before = np.concatenate(([-1], np.maximum.accumulate(reach)[:-1])) if len(reach) else reach
    keep = reach > before
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return where[start], where[start] + end - start, period


def strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period."""
    best = 0
    for i in range(1, len(start)):
        mine, other = length[i] * period[best], length[best] * period[i]
        if mine > other or (mine == other and (start[i], period[i]) < (start[best], period[best])):
            best = i
    return best


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", least: int = LEAST, with_text: bool = False, with_runs: bool = False) -> DataFrame:
    """One row per document with its periodic runs.

    Columns: the id, n_runs, start, length, period and exponent_milli of the run of greatest
    exponent (null without runs), runs_sha256 (of ``start,length,period`` lines), collapsed_sha256
    (of the words that no run repeats, joined by spaces) and, if asked for, collapsed (that text)
    and runs (an array of structs). Words are what stands between ASCII white space, compared byte
    for byte. Null and empty texts have no words and no runs; repeated rows give repeated
    results, an empty table gives none. Other columns are ignored, whatever their names.
    """
    whole = ["runs array<struct<start:bigint,length:bigint,period:bigint>>"] if with_runs else []
    schema = T.StructType([docs.schema[id_column], *T._parse_datatype_string(", ".join([
        "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
        *(["collapsed string"] if with_text else []), *whole,
    ])).fields])
    fields = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            codes, words = _Codes(), [t.split() for t in encoded(batch, "_text")]
            count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            edges = np.concatenate(([0], np.cumsum(count)))
            word = np.fromiter((codes[w] for own in words for w in own), dtype=np.int64, count=int(edges[-1]))
            start, end, period = runs(word, np.repeat(np.arange(len(words)), count), least)
            bounds = np.searchsorted(start, edges)
            rows: list[tuple] = []
            for i, own in enumerate(words):
                a, b = bounds[i], bounds[i + 1]
                s, n, q = ((x[a:b]).tolist() for x in (start - edges[i], end - start, period))
                if s:
                    change = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(change, np.array(s) + np.array(q), 1)
                    np.add.at(change, np.array(s) + np.array(n), -1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    best = strongest(s, n, q)
                    top = (s[best], n[best], q[best], 1000 * n[best] // q[best])
                else:
                    top = (None,) * 4
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q)).encode()
                text = b" ".join(own)
                rows.append((len(s), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(), text, [dict(zip(("start", "length", "period"), r)) for r in zip(s, n, q)]))
            *plain, texts, found = zip(*rows)
            columns = [batch.column("_id"), *[pa.array(x, pa.int64()) for x in plain[:5]], *[pa.array(x, pa.string()) for x in plain[5:]]]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            if with_runs:
                columns.append(pa.array(found, pa.list_(fields)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_arrow(docs.select(F.col(id_column).alias("_id"), text_of().alias("_text")), run, schema)


def with_cycles(docs: DataFrame, id_column: str = "doc_id", every: int = 10) -> DataFrame:
    """Documents of which every tenth, by a hash of its id, ends in a cycle of its own words.

    With ``h = crc32(id)``, ``g = h div 10`` and ``n`` words, the words from ``a = g % n`` on
    repeat the ``p = 1 + (n - a) div (3 + g % 8)`` words there. Such texts are joined by single
    spaces; all others, and rows without an id or without words, stay as they are.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g = F.floor(h / every).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("long")
    times = F.ceil((n - a) / p).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), cycle), F.lit(1), n.cast("int")), " ")
    return docs.withColumn("text", F.when((h % every == 0) & (n > 0), text).otherwise(F.col("text")))
