"""Vectors of several lengths, rows without ids, longer codes; letters and labels of languages."""

import numpy as np
import pytest

from aisleworks.llm import itq, language


def truth(rows):
    """Per row: links to other rows of its length and the smallest id reachable, over all pairs."""
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and len(a) == len(b):
                near[i, j] = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    reach = near | np.eye(len(rows), dtype=bool)
    for k in range(len(rows)):
        reach |= reach[:, [k]] & reach[[k], :]
    ids = np.array([np.inf if i is None else i for i, _ in rows])
    least = [ids[r].min() for r in reach]
    return near.sum(axis=1).tolist(), [None if np.isinf(x) else int(x) for x in least]


def test_vectors_of_all_lengths_and_without_ids(spark):
    rng = np.random.default_rng(8)
    rows = []
    for dims, copies in ((8, 60), (5, 9), (1, 4), (3, 1), (64, 2)):  # 64: two near vectors and nothing else
        base = rng.standard_normal(dims)
        for i in range(copies):
            rows.append((1000 * dims + i, [float(x) for x in base + rng.normal(0, 0.01, dims)]))
    lone, bridge = [3.0, -4.0, 0.0, 0.0, 1.0, 9.0], [float(x) for x in np.array(rows[0][1]) * 2]
    rows += [(None, bridge), (None, bridge), (None, lone), (None, lone), (None, [x * 1.01 for x in lone]), (7, [1.0, -1.0, 2.0, 0.5, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dims", "2 AS hashed", "3 AS first_id")
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in itq.near_vectors(frame.repartition(3)).collect())
    links, least = truth(rows)
    assert got == sorted((repr(i), n, repr(c), i == c) for (i, _), n, c in zip(rows, links, least))


def test_codes_grow_with_the_table_and_keep_their_recall(spark):
    assert itq.shape(500) == (20, 12)
    before = (20, 12)
    for n in (10**6, 10**7, 10**8, 10**9):
        tables, bits = itq.shape(n)
        assert bits > before[1] and tables > before[0] and n / 2**bits <= itq.BUCKET
        before = tables, bits
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    links, _ = truth([(i, np.array(v, dtype=float)) for i, v in rows])
    for bits in (12, 17):
        got = {r.vec_id: r.n_links for r in itq.near_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), least_bits=bits).collect()}
        assert all(got[i] <= n for (i, _), n in zip(rows, links)) and sum(got.values()) >= 0.9 * sum(links)


def test_letters_beyond_the_second_plane_and_too_many_labels(spark):
    rare = chr(0x30000) * 5 + " " + chr(0x31350) * 5
    rows = [(i, text, lang) for i in range(40) for text, lang in ((rare, "zh"), ("plain words here", "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    spans = language.label_spans(spark.createDataFrame([(1, rare)], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["zh"] and sum(s.letters for s in spans) == 10
    with pytest.raises(ValueError, match="more than 1 values"):
        language.fit(docs, languages=1)
