"""Every query gets ``k`` neighbours as long as there are so many other vectors."""

import numpy as np

from terrafolio.llm import ann


def test_queries_of_small_lists_find_enough(spark):
    # a third exact copies, tight clusters, and isolated vectors whose lists hold few others
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 16)), 700, axis=0), np.repeat(rng.standard_normal((20, 16)), 60, axis=0) + 1e-3 * rng.standard_normal((1200, 16)), 5 * rng.standard_normal((60, 16))])
    vectors = ann.usable(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    index = ann.fit(vectors)
    for one in (index, ann.AnnIndex(index.rotation, index.centres, 1, index.params)):
        found = {}
        for r in ann.search(vectors, vectors.where("vec_id % 10 = 0 or vec_id >= 1900"), one).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert found.keys() == {i for i in range(1960) if i % 10 == 0 or i >= 1900}
        assert all([k for k, _ in sorted(v)] == [1, 2, 3, 4, 5] and len({i for _, i in v} - {q}) == 5 for q, v in found.items())


def test_copies_do_not_lower_the_probes(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 16))
    frame = lambda rows: ann.usable(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    plain = ann.fit(frame(x)).probes
    assert ann.fit(frame(np.concatenate([x, np.repeat(x[:1], 4000, axis=0)]))).probes >= plain / 2


def test_repeated_ids_count_once_across_lists(spark):
    x = np.eye(16)
    rows = [(i, v) for i, v in enumerate(x)] + [(7, v) for v in x[8:]]
    vectors = ann.usable(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>"))
    found = ann.search(vectors, vectors.where("vec_id = 0"), ann.fit(vectors)).collect()
    assert len({r["vec_id"] for r in found}) == len(found) == 5
