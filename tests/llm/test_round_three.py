"""Token files, periodic runs and spelling variants against plain brute force; edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aisleworks.llm import packing, periods, spelling, token_files
from aisleworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some wörds, <|endoftext|> of text　here!  and\n\nmore [UNK] 12345 don't " * 3000
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", None, "a", 7), (4, "one two", None, "a", 7),
    (4, "another text of this id", "en", None, 9), (None, "no id at all, nothing here", "de", "b", 1), (None, "no id at all, nothing here", "de", "b", 1), (5, LONG, "en", "b", 1),
    (6, "é" * 100_000, "fr", None, 1), (6, "é" * 100_000, "fr", None, 1), (7, "é" * 99_999, "fr", None, 1), (7, "é" * 99_999, "fr", None, 1),
    (8, "\x00 a\x0bb   \U0001f600\U0001f468‍\U0001f469 漢字 123", "zh", "c", 1), (9, "a b c " * 5000, "en", "c", 1),
]
CLASHES = ["1 AS _text", "2 AS _id", "3 AS _hash", "4 AS n", "5 AS ids", "6 AS start", "7 AS word", "8 AS id", "9 AS _row", "10 AS runs", "11 AS key"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, COLUMNS).selectExpr("*", *CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


# --- token files ------------------------------------------------------------------------------


def files_of(docs, **settings):
    path = public_tokenizers.path
    return token_files.write(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **settings)


def expected_ids(text):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def check_files(rows, got):
    """``rows`` as (id, text); ids in ascending order, null first, gapless starts."""
    want = defaultdict(Counter)
    for name, text in rows:
        want[name][expected_ids(text)] += 1
    have, at = defaultdict(Counter), 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        have[r.doc_id][bytes(r.ids)] += 1
        at += r.n_tokens
    assert have == want
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_files_round_trip(spark, documents):
    files = files_of(documents)
    got = token_files.read_documents(spark, files, documents.schema["doc_id"].dataType, with_ids=True).collect()
    check_files([(r.doc_id, r.text) for r in documents.collect()], got)
    bound = {tuple(r) for r in QUERIES["op11_token_files"](spark, SF).collect()}
    assert bound == {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got}


def test_token_files_hold_equal_sequences_and_masks(spark, documents):
    files = files_of(documents, length=128)
    shards = token_files.manifest(spark, files).orderBy("shard").collect()
    assert sum(r.n_documents for r in shards) == documents.count()
    for r in shards:
        sequences = token_files.Sequences(f"{files.path}/files/{r.name}.sequences.arrow")
        assert len(sequences) == r.n_sequences == -(-r.n_tokens // 128)
        ids, mask = zip(*(sequences.sequence(i) for i in range(len(sequences))))
        assert all(len(x) == len(y) == 128 and not x.flags.owndata for x, y in zip(ids, mask))  # views into the mapped file
        ids, mask = np.concatenate(ids), np.concatenate([x.to_numpy(zero_copy_only=False) for x in mask])
        assert ids.dtype == np.uint16
        assert mask[: r.n_tokens].all() and not mask[r.n_tokens :].any() and not ids[r.n_tokens :].any()
        assert (ids == sequences.tokens(0, len(ids))).all()
        with pytest.raises(IndexError):
            sequences.sequence(len(sequences))


def test_files_of_lost_attempts_are_not_read(spark, documents):
    files = files_of(documents)
    name = token_files.manifest(spark, files).first().name
    for kind in ("sequences", "documents"):
        with open(f"{files.path}/files/000000-lost-{0}.{kind}.arrow", "wb") as half:
            half.write(b"ARROW1 half a file")
    assert token_files.read_documents(spark, files, documents.schema["doc_id"].dataType).count() == documents.count()
    assert "lost" not in name


def test_token_files_edges(spark, edges, empty):
    got = token_files.read_documents(spark, files_of(edges), edges.schema["doc_id"].dataType, with_ids=True).collect()
    check_files([r[:2] for r in EDGES], got)
    assert token_files.read_documents(spark, files_of(empty), empty.schema["doc_id"].dataType).count() == 0


def test_pieces_are_told_apart_by_their_bytes():
    """Words whose polynomial hashes modulo 2^64 agree for every multiplier."""
    path = public_tokenizers.path
    encoder = packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for n in (1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        texts = [one, one.translate(str.maketrans("ab", "ba")), f"x {one}", f"x {one.translate(str.maketrans('ab', 'ba'))}"]
        for group in (texts, texts[::-1]):
            assert [x.tolist() for x in encoder.batch([t.encode() for t in group])] == [whole.encode(t, add_special_tokens=False).ids for t in group]


def test_pieces_of_one_hash(monkeypatch):
    """Every piece falls into one of two groups; ids stay those of the tokenizer."""
    path = public_tokenizers.path
    encoder = packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "range_hashes", lambda data, starts, ends: (np.arange(len(starts)) % 2).astype(np.uint64))
    texts = ["", "one two three two one", "a", "one two  three, don't\n\nlonger words at the end of the batch"]
    for group in (texts, texts[::-1]):
        assert [x.tolist() for x in encoder.batch([t.encode() for t in group])] == [whole.encode(t, add_special_tokens=False).ids for t in group]


# --- periodic runs ------------------------------------------------------------------------------


def brute_runs(words, least=24):
    found = set()
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                part = words[i : j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def rewritten(name, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if name is None or not words:
        return words
    h = zlib.crc32(str(name).encode())
    if h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_row(words):
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2])) if found else (None, None, None)
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_of_the_query_as_brute_force(spark, documents):
    want = {r.doc_id: expected_row(rewritten(r.doc_id, r.text)) for r in documents.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > 10


def made_up(rnd):
    n, k, kind = rnd.randrange(260), rnd.choice([1, 2, 3, 5, 20]), rnd.randrange(6)
    words = [rnd.randrange(k) for _ in range(n)]
    if kind == 1:
        words += [rnd.randrange(k) for _ in range(rnd.randrange(1, 30))] * rnd.randrange(3, 9) + words[:5]
    if kind == 2:
        words = (([0] * rnd.randrange(1, 40) + [1]) * rnd.randrange(3, 6) + [rnd.randrange(3)]) * rnd.randrange(1, 5)
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        words = b[:n]
    if kind == 4:
        words = [bin(i).count("1") % 2 for i in range(n)]
    if kind == 5:
        words = [rnd.randrange(k) for _ in range(rnd.randrange(1, 12))] * rnd.randrange(20)
        for _ in range(rnd.randrange(4)):
            if words:
                words[rnd.randrange(len(words))] = 99
    return words


@pytest.mark.parametrize("least", [3, 6, 9, 24, 48])
def test_runs_of_made_up_texts(least):
    rnd, seen = random.Random(least), 0
    for _ in range(40):
        texts = [made_up(rnd) for _ in range(rnd.randrange(1, 9))]
        word = np.array([w for t in texts for w in t], dtype=np.int64)
        base = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(int)
        start, end, period = periods.runs(word, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
        want = sorted((s + base[i], n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t, least))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want
        seen += len(want)
    assert seen > 100


def test_runs_edges(edges, empty):
    got = periods.periodic_runs(edges, with_text=True, with_runs=True).collect()
    assert len(got) == len(EDGES)
    for r in got:
        if r.doc_id in (5, 9):
            assert (r.n_runs, r.start, r.period) == (1, 0, 10 if r.doc_id == 5 else 3)
            assert r.runs[0].length == r.length and len(r.collapsed.split()) < 30
        else:
            assert r.n_runs == 0 and r.start is None and r.runs == [] and r.runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert Counter(r.collapsed for r in got)["one two"] == 2
    assert periods.periodic_runs(periods.with_cycles(empty)).count() == 0
    assert periods.periodic_runs(periods.with_cycles(edges)).count() == len(EDGES)


# --- spelling variants --------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected_words(rows, slips=31):
    counts = Counter()
    for name, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{name}:{word}".encode())
            if slips and name is not None and h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected_variants(counts):
    words, out = sorted(counts), {}
    lengths = defaultdict(list)
    for w in words:
        lengths[len(w)].append(w)
    for w in words:
        near = [v for d in (-1, 0, 1) for v in lengths.get(len(w) + d, ()) if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * counts[w] else None
        out[w] = [form, w, counts[w], len(near), counts[form] if form else None]
    for w in words:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def variant_rows(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_of_the_query_as_brute_force(spark, documents):
    want = expected_variants(expected_words([(r.doc_id, r.text) for r in documents.collect()]))
    frame = QUERIES["op13_spelling_variants"](spark, SF)
    assert variant_rows(frame) == want and frame.count() == len(want)
    assert sum(v[0] is not None for v in want.values()) > 5


@pytest.mark.parametrize("symbols", [4, 7])
def test_variants_of_made_up_words(spark, symbols):
    rnd = random.Random(symbols)
    letters, counts = "abcéÿ", Counter()
    for _ in range(60):
        base, n = "".join(rnd.choice(letters) for _ in range(rnd.randrange(7, 10))), rnd.choice([2, 30, 500])
        counts[base] += n
        for _ in range(12):
            at, kind = rnd.randrange(len(base)), rnd.randrange(3)
            counts[base[:at] + (rnd.choice(letters) if kind else "") + base[at + (kind < 2) :]] += rnd.choice([1, 2, 3, 20])
    text = [w for w, n in counts.items() for _ in range(n)]
    rnd.shuffle(text)
    docs = spark.createDataFrame([(i, " ".join(text[i::20])) for i in range(20)], "doc_id long, text string")
    want = expected_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert variant_rows(spelling.variants(docs, symbols=symbols)) == want
    assert max(len({v[1] for v in want.values()}), 1) < len(want)


def test_variants_edges(spark, edges, empty):
    got = variant_rows(spelling.variants(edges, slips=31))
    assert got == expected_variants(expected_words([r[:2] for r in EDGES]))
    assert got["nothing"][2] == 2 and got["é" * 100_000][3] == got["é" * 99_999][3] == 1
    assert spelling.variants(empty).count() == 0
    chain = spark.createDataFrame([(1, "aaaaaaa " * 2 + "aaaaaab " * 20 + "aaaaabb " * 200 + "aaaabbb " * 2000)], "doc_id long, text string")
    assert {w: v[1] for w, v in variant_rows(spelling.variants(chain)).items()} == dict.fromkeys(["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"], "aaaabbb")
