"""The pipeline: stages in order, columns kept, every stage takes effect and loses nothing else."""
import collections

import corpus_pipeline as cp
from conftest import SF
from tubelens.llm import toxicity
from tubelens.llm.common import documents, table
from test_text_operators import near_by_force


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    docs = documents(spark, SF)
    steps = [docs]
    for _, f in cp.STAGES:
        steps.append(spark.createDataFrame(f(spark, steps[-1], SF).collect(), f(spark, steps[-1], SF).schema))
    before, tox, exact, near, clean, last = ({r.doc_id: r for r in s.collect()} for s in steps)
    assert all(s.columns == docs.columns for s in steps[:-1])
    score = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()}
    assert set(tox) == {d for d in before if not score[d]}
    last_of = {}
    for d in sorted(tox):
        last_of[tox[d].text] = d
    assert set(exact) == set(last_of.values())
    ids = sorted(exact)
    comp = near_by_force([exact[d].text for d in ids], 5)
    assert set(near) == {ids[i] for i, (_, c) in enumerate(comp) if c == i}
    assert set(clean) <= set(near) and set(last) == set(clean)


def test_run_equals_stages(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert collections.Counter(type(r.n_tokens) for r in rows) == {int: len(rows)}
