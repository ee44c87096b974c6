from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from glossalith.llm.mixing import pivotal_mix

from .test_dedup import brute_components
from .test_outputs import brute_pairs, expected_tokens


def test_stages_equal_their_brute_force(spark, sf_dir):
    """Every stage against a plain version of it, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    work, at = corpus_pipeline.Workspace(spark, "test"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at[name] = docs
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if name != "token_output":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert 0.6 * before <= docs.count() <= before
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = lambda name: [(r.doc_id, r.text) for r in at[name].collect()]
    near = rows("near_dedup")
    assert {i for i, _ in rows("decontamination")} == {i for (i, _), (c, n) in zip(near, brute_components(near, 80), strict=True) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {i for i, _ in rows("mixing")} == {i for i, _ in rows("decontamination")} - {i for i, _ in brute_pairs(rows("decontamination"), items)}
    plan = {r.doc_id: r for r in pivotal_mix(at["mixing"]).collect()}
    taken = Counter(i for i, _ in rows("token_output"))
    assert all(taken[i] == r.copies + (2 * r.extra_words >= max(r["size"], 1)) for i, r in plan.items())
    assert sorted(map(tuple, docs.collect())) == sorted(expected_tokens(rows("token_output")))
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


@pytest.fixture
def odd_dir(spark, sf_dir, tmp_path):
    """Tables with rows of every odd kind, and with columns whose names the stages use themselves."""

    def make(empty=False):
        usual = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
        item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
        other = "there is nothing like this line of words in any other text of the table"
        odd = [(900, None), (901, ""), (902, " \n"), (903, "x " * 60_000), (903, "x " * 60_000), (904, "y" * 100_000), (None, other), (None, f"so {item} it is"), (None, None), (905, f"so {item} it is"), (906, "one two"), (906, "three four"), (907, "tie"), (908, "tie"), (907, "tie")]
        rows = spark.createDataFrame([(i, t, None, s, None) for k, (i, t) in enumerate(odd) for s in [None if k % 2 else "odd"]], usual.schema)
        docs = usual.unionByName(rows).withColumns({c: F.lit("mine") for c in ("place", "times", "copy", "score", "id", "node", "size", "label", "kept", "run", "leaked")})
        (docs.limit(0) if empty else docs).write.parquet(str(tmp_path / "documents.parquet"))
        for name in ("labels", "benchmark"):
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (table.limit(0) if empty else table).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def test_stages_with_odd_rows(spark, odd_dir):
    folder = odd_dir()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, work, left = docs.columns, corpus_pipeline.Workspace(spark, "test"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.save(stage(spark, docs, folder), f"{k}-{name}")
        left[name] = docs
        if name != "token_output":
            assert docs.columns == columns and docs.filter("place <> 'mine' or score <> 'mine'").count() == 0
    ids = {name: Counter((r.doc_id, (r.text or "").strip()[:12]) for r in df.collect()) for name, df in list(left.items())[:4]}
    assert ids["near_dedup"][903, "x x x x x x "] == 1 and ids["near_dedup"][907, "tie"] + ids["near_dedup"][908, "tie"] == 1
    assert ids["near_dedup"][900, ""] == ids["near_dedup"][901, ""] == ids["near_dedup"][None, ""] == 1 and ids["near_dedup"][906, "one two"] == ids["near_dedup"][906, "three four"] == 1
    assert sum(n for (i, t), n in ids["near_dedup"].items() if t.startswith("so ")) == 1 and not any(t.startswith("so ") for _, t in ids["decontamination"])
    assert ids["decontamination"][None, "there is not"] == 1
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and not any(i in (900, 901, 902) for i, _ in ids["mixing"])
    assert left["token_output"].count() == sum(ids["mixing"].values())


def test_stages_of_an_empty_table(spark, odd_dir):
    assert corpus_pipeline.run(spark, odd_dir(empty=True)).collect() == []


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
