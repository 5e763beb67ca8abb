"""The other operators for training text against brute force, the tokenizer files and edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aisleworks.llm import itq, language, mixing, packing, rules, simhash, templates, token_counts
from aisleworks.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some wörds, <|endoftext|> of text　here!  and\n\nmore [UNK] 12345 don't " * 3000
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", None, "a", 7), (4, "one two", None, "a", 7),
    (4, "another text of this id", "en", None, 9), (None, "no id at all", "de", "b", 1), (5, LONG, "en", "b", 1), (6, "é" * 100_000, "fr", None, 1),
    (7, "\x00 a\x0bb   ퟿ \U0001f600\U0001f468‍\U0001f469 漢字 123", "zh", "c", 1), (8, "a b c " * 5000, "en", "c", 1),
]
CLASHES = ["1 AS _text", "2 AS source_size", "3 AS fp", "4 AS n", "5 AS spans", "6 AS size", "7 AS ids", "8 AS part", "9 AS kept"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, COLUMNS).selectExpr("*", *CLASHES)


def pack(docs, **settings):
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **settings)


def check_packing(texts, pieces):
    """``texts`` without ids that repeat: every id in one piece, gapless full windows."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_window) == list(range(len(by_window)))
    for window, own in by_window.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or (window == len(by_window) - 1 and at < 2048)


def test_packing_round_trip(spark, documents):
    check_packing({r.doc_id: r.text for r in documents.collect()}, QUERIES["op1_packing"](spark, SF).collect())


def test_packing_edges(edges):
    rows = {f"{i}": r for i, r in enumerate(EDGES)}
    named = edges.sparkSession.createDataFrame([(k, r[1], r[3]) for k, r in rows.items()], "doc_id string, text string, source string")
    check_packing({k: r[1] for k, r in rows.items()}, pack(named).collect())
    assert pack(edges).selectExpr("sum(length) n").first().n == pack(named).selectExpr("sum(length) n").first().n
    assert pack(edges.limit(0)).count() == 0


def test_packing_holds_target_proportions(spark):
    rows = [(i, "some words of text " * 300, "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = defaultdict(Counter)
    for r in pack(docs, weights={"a": 5, "b": 2, "c": 1}).collect():
        mix[r.sequence_id][r.source] += r.length
    for window in range(5):
        assert all(abs(mix[window][s] - 2048 * w / 8) <= 2 for s, w in (("a", 5), ("b", 2), ("c", 1)))


def expected_counts(rows):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return Counter((i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_token_counts_as_the_tokenizer(spark, documents, edges):
    got = QUERIES["op4_token_counts"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected_counts([(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(edges, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected_counts([r[:2] for r in EDGES])
    assert token_counts.count_tokens(edges.limit(0), path).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    lettered = got.text.map(lambda t: t is not None and any(c.isalpha() for c in t))
    assert ((got.lang_pred == "und") == ~lettered).all() and got.score.between(0, 1).all()
    held = got[got.held_out & lettered & got.lang.notna()]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.95


def test_language_spans_of_mixed_text(spark, documents):
    texts = {r.lang: r.text for r in documents.where("length(text) between 600 and 4000").dropna(subset=["lang"]).collect()}
    names = sorted(texts)[:2]
    parts = [texts[n][:600] for n in names]
    model = language.fit(documents)
    spans = language.label_spans(spark.createDataFrame([(1, "\n".join(parts))], "doc_id long, text string"), model).first().spans
    assert {s.lang for s in spans} >= set(names)
    for name, at in zip(names, (0, 601)):
        inside = [s for s in spans if s.start >= at - 40 and s.end <= at + 641]
        assert sum(s.letters for s in inside if s.lang == name) >= 0.8 * sum(s.letters for s in inside)


def test_language_edges(edges):
    got = language.predict(edges).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.predict(edges.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language.predict(edges.limit(0)).count() == 0


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / weights for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check_mix(rows, got):
    size = Counter((i, len(WORD.findall(t or "")), s) for i, t, s in rows)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == size
    sizes = Counter()
    for (_, n, s), k in size.items():
        sizes[s] += n * k
    target, taken, largest = expected_targets(dict(sizes)), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return taken, target, largest


def test_mixing_reaches_targets_and_reruns_agree(documents):
    for sf, near in (("0.001", 0.12), ("0.01", 0.02)):  # 10 and 50 documents a source
        docs = documents.sparkSession.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        got = mixing.mix(docs).collect()
        taken, target, largest = check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
        assert all(target[s] - min(near * target[s], largest[s]) <= taken[s] <= target[s] for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_edges(edges):
    got = mixing.mix(edges).collect()
    taken, target, largest = check_mix([(r[0], r[1], r[3]) for r in EDGES], got)
    assert all(target[s] - 2 * largest[s] <= taken[s] <= target[s] + 1e-6 for s in target)
    out = mixing.mixed_documents(edges)
    assert out.columns == edges.columns
    copies = Counter((r.doc_id, r.source, r.size) for r in got for _ in range(r.copies))
    assert Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect()) == copies
    assert mixing.mix(edges.limit(0)).count() == 0 and mixing.mixed_documents(edges.limit(0)).count() == 0


def vector_truth(rows):
    """Links, components by comparing all pairs; (vec_id, vector) with invalid ones apart."""
    def valid(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ids = [i for i, v in rows if valid(v)]
    m = np.array([v for _, v in rows if valid(v)], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    return ids, near


def test_vectors_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, near = vector_truth(rows)
    got = {r.vec_id: r for r in QUERIES["op7_embedding_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {i for i, _ in rows}
    found = np.array([got[i].n_links for i in ids])
    true = near.sum(axis=1)
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    at = {i: k for k, i in enumerate(ids)}
    root = np.arange(len(ids))
    while True:  # smallest index reachable over true links
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (new == root).all():
            break
        root = new
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and r.component_id <= i
        if i in at:
            assert root[at[r.component_id]] == root[at[i]]
        else:
            assert r.n_links == 0 and r.component_id == i


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_edges(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.02, 16)]) for i in range(1, 30)]
    rows += [(40 + i, [float(x) for x in base]) for i in range(20)]
    rows += [(70, None), (71, [0.0] * 16), (72, [None] + [1.0] * 15), (73, [float("nan")] * 16), (74, [float("inf")] + [1.0] * 15), (75, [float(-x) for x in base])]
    ids, near = vector_truth(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS rep", "3 AS _v", "4 AS key")
    got = {r.vec_id: r for r in itq.near_vectors(docs).collect()}
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(axis=1).tolist()))
    assert all(got[i].component_id == (1 if i < 70 else i) for i in got)
    assert itq.near_vectors(docs.limit(0)).count() == 0


def rule_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_as_brute_force(spark, documents, edges):
    for docs in (documents, edges):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = rules.judge(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *rule_counts(t)) for i, t in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.judge(edges.limit(0)).count() == 0


def test_rules_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(SQL["op8_quality_rules"]).df()
    got = QUERIES["op8_quality_rules"](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)


def print_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def check_prints(rows, got):
    prints = {(i, t): print_of(t) for i, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{prints[i, t]:016x}") for i, t in rows)
    distinct = sorted(set(prints.values()))
    root = {p: min((i for (i, t), q in prints.items() if q == p and i is not None), default=math.inf) for p in distinct}
    while True:
        new = {p: min(root[q] for q in distinct if (p ^ q).bit_count() <= 2) for p in distinct}
        if new == root:
            break
        root = new
    for r in got:
        want = root[int(r.fingerprint, 16)]
        assert r.component_id == (None if want == math.inf else want)


@pytest.mark.parametrize("block", [512, 3])
def test_simhash_as_brute_force(spark, documents, edges, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    check_prints([(r.doc_id, r.text) for r in documents.collect()], simhash.near_duplicates(documents).collect())
    rows = [(r[0], r[1]) for r in EDGES if r[0] is not None]
    check_prints(rows, simhash.near_duplicates(edges.where("doc_id IS NOT NULL")).collect())
    assert simhash.near_duplicates(edges).count() == len(EDGES) and simhash.near_duplicates(edges.limit(0)).count() == 0


def test_exploded_fingerprints_are_not_broadcast(spark):
    """The planner sizes the cells of all fingerprints like the fingerprints: too little by a factor of 33."""
    prints = spark.range(4000).selectExpr("id AS rep", "xxhash64(id) AS fp")
    assert "BroadcastHashJoin" not in simhash.links(prints, "rep")._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_at_two_bits(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = {b: None for b in base}
    for b in base:
        for _ in range(3):
            p, q = (int(x) for x in rng.choice(63, 2, replace=False))
            prints[b ^ (1 << p)] = prints[b ^ (1 << p) ^ (1 << q)] = None
    distinct = list(prints)
    rows = spark.createDataFrame(list(enumerate(distinct)), "rep long, fp long")
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def joined(pairs):
        root[:] = range(len(distinct))
        for i, j in pairs:
            a, b = sorted((find(i), find(j)))
            root[b] = a
        return [find(i) for i in range(len(distinct))]

    want = joined((i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= 2)
    assert joined((r.a, r.b) for r in simhash.links(rows, "rep").collect()) == want


def page(host, k, body, extra=""):
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
    return (
        k, f"http://{host}/{k}",
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{menu}<header>Site name</header>"
        f"<div class='ad'>Buy now</div><article><h1>Title {k}</h1>{body}</article>{extra}<div id='comments'><p>reader says {k}</p></div>"
        f"<form><input name='q'><button>Search</button></form><footer>Imprint 2020</footer></body></html>",
    )


def test_pages_main_text(spark):
    rows = [page("one.example", k, f"<p>First &amp; text {k}\n of  words&nbsp;here.</p><p>Second <b>part</b> {k * 7}.</p>") for k in range(1, 9)]
    rows += [(9, "http://one.example/9", "<html><body><nav>Home</nav><!-- <article> --><div class='text'><p>Laid out otherwise.</p></div></body></html>")]
    rows += [page("two.example", 20, "<p>A lone page &#228; &lt;b&gt;</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(docs).collect()}
    for k in range(1, 9):
        assert got[k] == f"Title {k}\nFirst & text {k} of words here.\nSecond part {k * 7}."
    assert got[9] == "Laid out otherwise."
    assert got[20] == "Title 20\nA lone page ä <b>"


def plain(host, k, text, tail=""):
    """A page without article or main, with boilerplate that only repetition shows."""
    return (
        k, f"http://{host}/{k}",
        f"<html><body><div class='top'>Daily Gazette of Somewhere</div><div class='wrap'><div class='story post-{k}'><h1>Head {k}</h1>"
        f"<div class='zz'><span>Pass it on</span> to your friends</div>{text}<p>All rights are with us.</p></div>"
        f"<div class='xy'>Most read this week: <ul><li>Something we wrote once</li></ul></div></div>{tail}</body></html>",
    )


def test_pages_by_template(spark):
    body = {k: "".join(f"<p>Part {i} of story {k} has words {k * i} and more of its own.</p>" for i in range(3, 6)) for k in range(1, 15)}
    lines = {k: [f"Part {i} of story {k} has words {k * i} and more of its own." for i in range(3, 6)] for k in body}
    rows = [plain("plain.example", k, body[k]) for k in range(1, 9)]
    # Copies of one page are one page: they outnumber the others, yet their story is no template.
    rows += [(100 + k, f"http://plain.example/copy{k}", rows[0][2]) for k in range(30)]
    # Comments set as articles, and a notice without a telling name inside the article.
    talk = "<div class='comments'>" + "<article><p>I read it and have a lot to say about all of it, as ever.</p></article>" * 9 + "</div>"
    rows += [
        (200 + k, f"http://talk.example/{k}", f"<html><body><article class='c{k}'><div class='qq'>Our shop has moved house</div>{body[k]}</article>{talk}</body></html>")
        for k in range(1, 9)
    ]
    # A paragraph that most pages share, without an element of its own, stays; so does a page of template blocks alone.
    shared = "<p>This very paragraph is in most of these stories.</p>"
    rows += [
        (300 + k, f"http://shared.example/{k}", f"<html><body><article>{shared if k < 7 else ''}{body[k]}</article></body></html>") for k in range(1, 9)
    ]
    # The article's place differs from page to page.
    rows += [(400 + k, f"http://moved.example/{k}", f"<html><body><div>Other words</div><div class='kind{chr(96 + k)}'><article>{body[k]}</article></div></body></html>") for k in range(1, 9)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text.split("\n") for r in templates.extract(docs).collect()}
    for k in range(1, 9):
        assert got[k] == [f"Head {k}", *lines[k]]
        assert got[200 + k] == lines[k]
        assert got[300 + k] == ["This very paragraph is in most of these stories."] * (k < 7) + lines[k]
        assert got[400 + k] == lines[k]
    assert all(got[100 + k] == got[1] for k in range(30))


def test_pages_edges(spark):
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    rows = [
        (1, None, None), (2, "http://a.example/1", ""), (3, "not an address", "plain text only"), (3, "not an address", "plain text only"),
        (None, "http://a.example/2", "<p>unclosed <b>tags"), (5, "http://a.example/3", deep), (6, "http://a.example/4", "<article>" + "<p>word & more</p>" * 20_000 + "</article>"),
        (7, "http://a.example/5", "<article><p>a < b &unknown; &#0; &#x110000; </article"), (8, None, "<"),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS main", "3 AS words", "4 AS page", "5 AS text")
    got = templates.extract(docs).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "plain text only" and text[None] == "unclosed tags"
    assert text[1] == text[2] == "" and text[5] == "deep" and text[6] == "\n".join(["word & more"] * 20_000)
    assert templates.extract(docs.limit(0)).count() == 0


def test_pages_hold_no_markup(spark):
    got = QUERIES["op10_html_extraction"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "track(" not in r.text and "margin:0" not in r.text for r in got)
    assert all(line == " ".join(line.split()) and line for r in got if r.text for line in r.text.split("\n"))
