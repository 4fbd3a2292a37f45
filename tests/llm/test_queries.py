"""Registered queries against their SQL, and the pipeline stage by stage."""

import collections
import os

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from gridmeter.llm import bpe, registry, toxicity  # noqa: E402
from tools.check_oracle import compare, duck  # noqa: E402

from .test_operators import classes_by_force, goal_by_force, odd, texts, WORD  # noqa: E402, F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    n, problems = compare(spark, duck(SF), SF, registry.QUERIES[name], registry.SQL[name], types=True)
    assert n > 0 and not problems, problems


def test_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES] == list(range(1, len(registry.QUERIES) + 1))


def test_native_queries_run_no_python(spark):
    for name in ("op2_mixing", "op3_secrets", "op6_exact_dedup"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        out[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == before.columns
    before, after = out["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - bad
    before, after = out["exact_dedup"]
    least = {}
    for i, t in texts(before):
        k = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", t))
        least[k] = min(least.get(k, i), i)
    assert sorted(i for i, _ in texts(after)) == sorted(least.values())
    before, after = out["ngram_jaccard"]
    want = {c for _, _, c in classes_by_force(texts(before), 5, 80, 100)}
    assert sorted(i for i, _ in texts(after)) == sorted(want)
    before, after = out["mixing"]
    size, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before.collect():
        size[r.source] += len(WORD.findall(r.text))
        most[r.source] = max(most[r.source], len(WORD.findall(r.text)))
    for r in after.collect():
        taken[r.source] += len(WORD.findall(r.text))
    goal = goal_by_force(dict(size))
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in size)
    before, after = out["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    want = collections.Counter()
    for i, x in texts(before):
        ids = library.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in after.collect()) == want


def scratch(spark):
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith("gridmeter-")} if os.path.isdir(top) else set()


@pytest.mark.parametrize("some", [lambda d: d, lambda d: d.limit(0)])
def test_pipeline_run_on_odd_tables(spark, odd, tmp_path, some):  # noqa: F811
    """Nulls in any column, repeated ids and rows, long texts, clashing names; and no rows at all."""
    folder = str(tmp_path)
    some(odd).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, None, i % 2) for i in range(40)] + [(None, 1, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = scratch(spark)
    got = P.run(spark, folder)
    left = {x for x in scratch(spark) - before}
    assert len(left) == 1 and left.pop().startswith("gridmeter-pipeline-mixing")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        assert name == "bpe" or docs.columns == names
    key = lambda d: collections.Counter((r.doc_id, r.n_tokens, r.decoded) for r in d.collect())
    rows = key(got)
    assert rows == key(docs) and bool(rows) == (some(odd).count() > 0)
