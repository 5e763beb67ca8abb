"""Co-training, paragraph deduplication and the pipeline: brute force, held-out accuracy, edge cases."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from aisleworks.llm import cotraining, paragraphs, passages
from aisleworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def edge_rows():
    long = " ".join(words(60, 1))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)),
        (4, long, None, "a", None), (None, long + "\nown line", "en", None, 5), (5, "\n\n \t", "de", "b", 4), (6, "é" * 200_000, "fr", "b", 200_000),
        (7, " ".join(words(30_000, 2)), "en", "c", 9),
    ]


def tokens(line):
    return [t.encode() for t in line.lower().split()]


def shingle_set(t, k=5):
    return {tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))}


def brute_force(rows):
    """Clusters of paragraphs by comparing all pairs: place -> first place, for repeated ones."""
    places = [(i, k, tokens(line)) for i, text in rows for k, line in enumerate((text or "").split("\n")) if len(tokens(line)) >= paragraphs.MIN_WORDS]
    sets = [shingle_set(p[2]) for p in places]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    size = Counter(find(i) for i in range(len(places)))
    first = {}
    for i, p in enumerate(places):
        first[find(i)] = min(first.get(find(i), p[:2]), p[:2])
    return {p[:2]: first[find(i)] for i, p in enumerate(places) if size[find(i)] > 1}


def near_copies():
    rng = np.random.default_rng(4)
    base = words(80, 9)
    rows = []
    for i in range(40):
        line = list(base)
        line[rng.integers(80)] = f"edit{i}"
        rows.append((i, " ".join(words(30, 100 + i)) + "\n" + " ".join(line)))
    rows += [(50 + i, " ".join(words(200, 500 + i))) for i in range(5)]
    return [*rows, (60, rows[0][1].upper()), (61, "short line\n" + rows[1][1])]


@pytest.mark.parametrize("block", [256, 4])
def test_paragraphs_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    rows = near_copies()
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_force(rows)
    assert {(r.doc_id, r.paragraph): (r.keeper_id, r.keeper_paragraph) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.paragraph) == (r.keeper_id, r.keeper_paragraph)) for r in got)
    assert not {r.doc_id for r in got} & set(range(50, 55))


def test_paragraphs_on_documents_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op2_substring_dedup"](spark, SF).collect()
    got = {(r.doc_id, r.paragraph): (r.keeper_id, r.keeper_paragraph) for r in found if r.kind == "paragraph"}
    assert got == brute_force(rows)
    check_passages(rows, [r for r in found if r.kind == "passage"])


def check_passages(rows, got):
    """Every run of 57 words that two documents share is hit; every word of a span is in a run of 9 that another document holds."""
    bags = {i: tokens(t or "") for i, t in rows}
    grams = {k: {} for k in (9, 57)}
    for i, w in bags.items():
        for k, seen in grams.items():
            for at in range(len(w) - k + 1):
                seen.setdefault(tuple(w[at : at + k]), set()).add(i)
    covered = {i: set() for i in bags}
    for r in got:
        covered[r.doc_id].update(range(r.start, r.start + r.n_words))
        assert r.n_words >= passages.LEAST and r.start + r.n_words <= len(bags[r.doc_id])
    for i, w in bags.items():
        shared = {p for at in range(len(w) - 8) if grams[9][tuple(w[at : at + 9])] != {i} for p in range(at, at + 9)}
        assert covered[i] <= shared
        runs = [at for at in range(len(w) - 56) if grams[57][tuple(w[at : at + 57])] != {i}]
        missed = [at for at in runs if not covered[i] & set(range(at, at + 57))]
        assert len(missed) <= 0.02 * len(runs)  # a hit needs spans of LEAST words; units alone hit all


def planted(n_words, seed):
    """40 pairs of documents that share one passage, in other lines and surroundings, and 20 clean ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(40):
        passage = words(n_words, seed * 1000 + i)
        for j in range(2):
            text = [*words(int(rng.integers(0, 90)), seed + 7 * i + j + 100_000), *passage, *words(int(rng.integers(0, 90)), seed + 7 * i + j + 200_000)]
            cuts = set(rng.integers(0, max(1, len(text)), 6).tolist())
            rows.append((2 * i + j, "".join(w + ("\n" if k in cuts else " ") for k, w in enumerate(text))))
    return rows + [(1000 + i, " ".join(words(150, seed + 300_000 + i))) for i in range(20)]


@pytest.mark.parametrize("n_words", [51, 60, 90])
def test_passages_within_lines(spark, n_words):
    rows = planted(n_words, n_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.passages(docs).collect()
    check_passages(rows, got)
    hit = {r.doc_id for r in got}
    assert len(hit) >= 0.97 * 80 and not any(i >= 1000 for i in hit)
    assert all(r.kept == (r.doc_id % 2 == 0) and r.keeper_id == r.doc_id // 2 * 2 for r in got)
    after = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    text = dict(rows)
    for r in got:
        if r.kept:
            assert after[r.doc_id] == text[r.doc_id]
        else:
            left = tokens(after[r.doc_id])
            assert len(left) < len(tokens(text[r.doc_id])) and set(left) <= set(tokens(text[r.doc_id]))


def test_spans_and_lines_are_cut():
    text = "one two  three\nfour five\n\nsix\tseven eight"
    assert paragraphs.cut_text(text, set(), [(1, 1)]) == "one three\nfour five\n\nsix\tseven eight"
    assert paragraphs.cut_text(text, set(), [(2, 3)]) == "one two  \n\nsix\tseven eight"
    assert paragraphs.cut_text(text, {0}, [(5, 2)]) == "four five\n\neight"
    assert paragraphs.cut_text(text, {0, 1, 2, 3}, []) == ""
    assert paragraphs.cut_text(text, set(), [(0, 8)]) == ""


def test_passages_edges(spark):
    docs = spark.createDataFrame(edge_rows(), COLUMNS).selectExpr("*", "1 AS h", "2 AS _id", "3 AS start", "4 AS kept", "5 AS _text")
    got = passages.passages(docs).collect()
    check_passages([(i, t) for i, t in {(r[0], r[1]) for r in edge_rows()} if i is not None], [r for r in got if r.doc_id is not None])
    assert passages.passages(docs.limit(0)).count() == 0


def test_names_of_columns_do_not_matter(spark):
    plain = spark.createDataFrame(edge_rows(), COLUMNS)
    clash = plain.selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS _cut", "4 AS _lines", "5 AS _spans", "6 AS __id", "7 AS _first", "8 AS _source", "9 AS _copies")
    for stage in (corpus_pipeline.one_of_each_group, corpus_pipeline.without_repeated_passages, corpus_pipeline.mixed_sources):
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns
        key = lambda r: (str(r.doc_id), str(r.text))
        assert sorted(map(key, out.collect())) == sorted(map(key, stage(spark, plain, SF).collect()))


def test_repeats_are_cut_once(spark):
    docs = spark.createDataFrame(edge_rows(), COLUMNS).selectExpr("*", "1 AS h", "2 AS body", "3 AS _cut_")
    out = paragraphs.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    text = {(r.doc_id, r.text) for r in rows}
    long = " ".join(words(60, 1))
    assert (None, long + "\nown line") in text and (4, "") in text and (3, "") in text and (1, None) in text
    assert {r.n_chars for r in rows if r.doc_id == 4} == {0}


def test_cotraining_views_and_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = cotraining.classify(docs, train).join(held, "doc_id").selectExpr("avg(int((quality = 1) = kept)) a", "count(*) n").first()
    assert got.n > 100 and got.a >= 0.97


def test_cotraining_teaches_the_other_view():
    rng = np.random.default_rng(1)
    good = rng.random(600) < 0.8
    text = np.where(good, 1.0, -1.0)[:, None] + rng.normal(0, 0.3, (600, 3))
    page = np.where(good, 1.0, -1.0)[:, None] + rng.normal(0, 0.3, (600, 2))
    quality = np.where(np.arange(600) < 60, good.astype(float), np.nan)
    model = cotraining.cotrain(text, page, quality)
    odds = [x @ model[k][0] + model[k][1] for x, k in ((text, "text"), (page, "page"))]
    assert all(((o > 0) == good).mean() > 0.95 for o in odds)


def test_classifier_edges(spark):
    docs = spark.createDataFrame(edge_rows(), COLUMNS).selectExpr("*", "0 AS score", "1 AS _text", "2 AS kept")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 0), (5, None), (7, 1)], "doc_id long, quality int")
    rows = cotraining.classify(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 and r.kept is not None for r in rows)
    none = cotraining.classify(docs, labels.limit(0)).collect()
    assert len(none) == len(edge_rows()) and all(r.kept for r in none)
    assert cotraining.classify(docs.limit(0), labels).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert paragraphs.repeated(empty).count() == 0 and paragraphs.without_repeats(empty).count() == 0


def numbered(text):
    """Words with their number and line."""
    return [(n, k, w) for n, (k, w) in enumerate((k, w) for k, line in enumerate(text.split("\n")) for w in line.split())]


def linked_documents(rows):
    """Smallest ids of the groups of documents that a Jaccard similarity of 0.8 links, over all pairs."""
    sets = [(i, shingle_set(tokens(text or ""))) for i, text in rows]
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for k, (i, a) in enumerate(sets):
            for j, b in sets[:k]:
                common = len(a & b)
                if common and root[i] != root[j] and common >= 0.8 * (len(a) + len(b) - common):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {r for i, r in root.items() if r == i}


def test_edited_copies_go(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = words(120, 77)
    for i in range(600):
        line = list(base)
        line[(i * 7) % 120] = f"edit{i}"
        rows.append((10_000 + i, " ".join(line)))
    rows += [(20_000, " ".join(words(12, 5))), (20_001, " ".join(words(12, 5)).upper() + "\n"), (20_002, ""), (20_003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(linked_documents(rows))


def test_near_copies_come_from_simhash(spark, monkeypatch):
    """Without any MinHash candidate the pairs that SimHash links, and only those alike, still go."""
    from aisleworks.llm import near_copies as operator

    drawn = np.random.default_rng(1)
    monkeypatch.setattr(operator, "bands", lambda hashes, edges: drawn.integers(0, 1 << 62, (len(edges) - 1, operator.BANDS), dtype=np.uint64))
    long = words(3000, 5)
    edited = [*long[:1500], "edit", *long[1501:]]
    # The same line over and over gives one fingerprint, whatever follows in a few words: alike in bits only.
    line = words(9, 6) * 60
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(words(300, 7))), (4, " ".join([*line, *words(30, 8)])), (5, " ".join([*line, *words(30, 9)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 5] == sorted(linked_documents(rows))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialised(stage(spark, before, SF), f"test-{name}")
        assert after.columns == docs.columns
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in after.collect()} == linked_documents(rows)
        if name == "substring_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            cut = {p for p, first in brute_force(rows).items() if p != first}
            spans = {}
            for r in passages.passages(before).where("NOT kept").collect():
                spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
            want = {i: None if t is None else [w for k, _, w in numbered(t) if k not in spans.get(i, ()) and (i, _) not in cut] for i, t in rows}
            assert {r.doc_id: None if r.text is None else r.text.split() for r in after.collect()} == want
            untouched = {i for i, t in rows if i not in spans and not any((i, k) in cut for k in range((t or "").count("\n") + 1))}
            assert {r.doc_id: r.text for r in after.collect() if r.doc_id in untouched} == {i: t for i, t in rows if i in untouched}
        before = after
    pieces = corpus_pipeline.packed(spark, before, SF).collect()
    assert sum(r.length for r in pieces) > 0 and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert all(n == 2048 for s, n in fill.items() if s != max(fill))


def test_stages_leave_no_copies_of_texts_and_units(spark):
    """What a stage wrote on the way goes as soon as its readers are written; the results stay whole."""
    from urllib.parse import urlparse

    from aisleworks.llm.common import discard
    from aisleworks.session import shared_folder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = Path(urlparse(shared_folder(spark)).path) / "aisleworks"
    before = {p.name for p in folder.glob("*")}
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    out = corpus_pipeline.without_repeated_passages(spark, kept, SF)
    new = {p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before}
    assert not new & {"documents", "document-bands", "bodies", "paragraphs", "paragraph-classes", "paragraph-roots", "units"}
    assert out.count() == kept.count() > 0
    with pytest.raises(ValueError):
        discard(docs)
    assert docs.count() > 0


def test_units_go_on_only_where_their_hash_repeats(spark):
    """One exchange of hashes and counts before the places are compared."""
    text = " ".join(words(200, 7))
    df = spark.createDataFrame([(1, text), (2, "x " + text + " y"), (3, " ".join(words(200, 8))), (4, text), (4, text)], "doc_id long, text string")
    found = passages.passages(df)
    (scanned,) = [f for f in found.inputFiles() if "/repeated-units-" in f][:1]
    assert spark.read.parquet(scanned.rsplit("/", 1)[0]).select("_id").distinct().count() == 3  # of 1, 2 and 4, not of 3
    assert {(r.doc_id, r.kept, r.keeper_id) for r in found.collect()} == {(1, True, 1), (2, False, 1), (4, False, 1)}


def test_pipeline_edges(spark):
    docs = spark.createDataFrame(edge_rows(), COLUMNS)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.materialised(stage(spark, rows, SF), f"edge-{name}")
        rows.count()


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    """A table of a few rows leaves no file for every partition of the shuffles."""
    from aisleworks.llm import common, near_copies

    files = []
    for module in (common, near_copies, paragraphs, passages):
        def written(df, purpose, put=module.materialised):
            table = put(df, purpose)
            files.append((purpose, len(table.inputFiles())))
            return table

        monkeypatch.setattr(module, "materialised", written)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
        corpus_pipeline.without_repeated_passages(spark, kept, SF)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"edges", "document-classes", "bodies", "unit-classes"} <= {purpose for purpose, _ in files}
    assert {purpose: n for purpose, n in files if n > 8} == {}


def test_large_tables_of_near_copies_are_not_broadcast(spark, monkeypatch):
    """With every table taken for a large one, no join of the stage goes through the driver; the rows stay the same."""
    from aisleworks.llm import common, near_copies, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in near_copies.first_ids(docs).collect())
    plans = []

    def written(df, purpose, put=common.materialised):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return put(df, purpose)

    for module in (common, near_copies, simhash):
        monkeypatch.setattr(module, "by_merge", lambda df, rows, each=0: df.hint("merge"))
        if module is not simhash:
            monkeypatch.setattr(module, "materialised", written)
    got = near_copies.first_ids(docs)
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert sorted(r.doc_id for r in got.collect()) == want
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 5
    assert [purpose for purpose, plan in plans if "Broadcast" in plan] == []


@pytest.mark.parametrize("few", [1 << 16, 40])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    """Rounds in one task and rounds with exchanges, and those that go over from one to the other."""
    from aisleworks.llm import common

    monkeypatch.setattr(common, "TASK_ROWS", few)
    pairs = np.random.default_rng(11).integers(0, 300, (150, 2)).tolist() + [[400 + i, 401 + i] for i in range(60)]
    root = {x: x for pair in pairs for x in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in pair and pair[0] != pair[1] for pair in pairs)}
    for rows in (None, len(pairs), 1):
        got = common.components(spark.createDataFrame([tuple(p) for p in pairs], "a long, b long").repartition(5), rows=rows).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
