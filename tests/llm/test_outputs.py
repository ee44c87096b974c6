import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossalith.llm.common import Workspace
from glossalith.llm import decontaminate as dec
from glossalith.llm.decontaminate import Index, contaminated_pairs, decontaminate
from glossalith.llm.mixing import capped_targets, cyclic_weights, mixed_rows, pivotal_mix
from glossalith.llm.queries import END_ID, ORACLES, op3_token_output, op6_mixing, op7_decontamination, tokenizer_path
from glossalith.llm.token_output import encode_documents, ids_crc32, read_tokens, token_metadata, write_tokens

from ..compare import connect, same


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_is_an_exact_round_trip(spark, sf_dir, docs):
    got = [tuple(r) for r in op3_token_output(spark, sf_dir).orderBy("start").collect()]
    assert got == expected_tokens([(r.doc_id, r.text) for r in docs.collect()])


def test_token_edge_cases(spark, documents):
    rows = [(5, None), (1, ""), (2, "a\u00a0b\u2003c \x1c d\x85e"), (2, "Ab <|endoftext|> 'S don't"), (9, "y" * 100_000), (-3, "é e\u0301 \u0301 ẞ İ ΟΔΟΣ x"), (None, "n")]
    path = Workspace(spark, "test").path("ids")
    write_tokens(encode_documents(documents(rows).repartition(3), tokenizer_path(), END_ID, shards=2), path)
    got = [tuple(r) for r in ids_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == expected_tokens(rows)
    assert [tuple(r)[:1] + tuple(r)[1:] for r in read_tokens(spark, path, 2, 5).select("doc_id", "start").orderBy("start").collect()] == [g[:2] for g in got if g[0] is not None and 2 <= g[0] <= 5]
    assert token_metadata(spark, path).count() == len(rows)
    empty = Workspace(spark, "test").path("ids")
    write_tokens(encode_documents(documents(rows).limit(0), tokenizer_path(), END_ID), empty)
    assert read_tokens(spark, empty).count() == 0


def test_token_files_are_delta_encoded_with_page_indexes(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = Workspace(spark, "test").path("ids")
    write_tokens(encode_documents(docs, tokenizer_path(), END_ID, shards=1), path)
    meta = pq.ParquetFile(glob.glob(path.removeprefix("file://") + "/part-*")[0]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = columns["ids.list.element"]
    assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_offset_index and columns["doc_id"].has_column_index


def test_a_range_of_ids_reads_its_pages_only(spark, documents):
    path = Workspace(spark, "test").path("ids")
    rows = documents([(i, f"word{i} and more") for i in range(30_000)]).select("doc_id", "text")
    write_tokens(encode_documents(rows, tokenizer_path(), END_ID, shards=1), path, page_bytes=4096)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        part = spark.read.parquet(path).filter("doc_id between 12000 and 12009").select("doc_id", "ids")
        assert part.count() == 10
        got = part.collect()
        leaves = part._jdf.queryExecution().executedPlan().collectLeaves()
        read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(got) == 10 and read <= 3 * 4096
    assert read_tokens(spark, path, 12_000, 12_009).select("start").orderBy("start").first()[0] == token_metadata(spark, path).filter("doc_id = 12000").first().start


def test_mixed_rows_with_repeated_and_null_ids(documents):
    """Rows come back by their own number: as many as the plan takes, none multiplied by another of the same id."""
    rows = [(1, "a b c", None, "s"), (1, "d e f", None, "s"), (1, "d e f", None, "s"), (None, "g h", None, "s"), (None, "i j", None, None), (2, None, None, "s"), (2, "", None, None)] + [(None, f"k{i} l m n", None, "t") for i in range(300)]
    docs = documents(rows).withColumns({"place": F.lit("mine"), "times": F.lit(7), "copy": F.lit(None), "size": F.lit(1)})
    plan, kept = pivotal_mix(docs, group_rows=20, fan_in=3), mixed_rows(docs, group_rows=20, fan_in=3)
    whole = sum(r.copies + (2 * r.extra_words >= max(r["size"], 1)) for r in plan.collect())
    assert kept.count() == whole and kept.columns == docs.columns and kept.filter("place <> 'mine' or text is null or text = ''").count() == 0
    check_mix(plan)
    again = mixed_rows(docs.repartition(13), group_rows=20, fan_in=3)
    shape = lambda df: sorted(((r.doc_id, r.source, len(r.text)) for r in df.collect()), key=repr)
    assert shape(kept) == shape(again)


def test_no_group_holds_all_rows_of_one_id(spark, documents, monkeypatch):
    from glossalith.llm import mixing

    docs = documents([(None if i % 2 else i, "a b c", None, "s") for i in range(4000)] + [(9000 + i, "d e", None, "t") for i in range(500)])
    sizes = []
    real = mixing.Workspace.save
    monkeypatch.setattr(mixing.Workspace, "save", lambda self, df, name, **o: (lambda t: (sizes.append(t.groupBy("source", "group").count().agg(F.max("count")).first()[0]) if name == "level0" else None, t)[1])(real(self, df, name, **o)))
    assert pivotal_mix(docs, group_rows=200).count() == 4500
    assert sizes and max(sizes) < 400


def test_targets_share_the_total_under_the_limit():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 5}
    weights = cyclic_weights(list(sizes))
    assert weights == {"a": 1, "b": 2, "c": 3, None: 1}
    targets = capped_targets(sizes, weights)
    assert targets["a"] == 30 and targets[None] == 15 and sum(targets.values()) == pytest.approx(2015) and targets["c"] == pytest.approx(1.5 * targets["b"])
    assert capped_targets({"a": 0}, {"a": 1}) == {"a": 0.0} and capped_targets({}, {}) == {}


def check_mix(plan):
    by = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 1 for r in by.collect())
    assert plan.filter("taken > 3 * size or taken < 0").count() == 0


def test_mix_reaches_its_targets_and_agrees_with_itself(docs):
    plan = pivotal_mix(docs, group_rows=7, fan_in=2)
    check_mix(plan)
    again = pivotal_mix(docs.repartition(11), group_rows=7, fan_in=2)
    key = lambda p: sorted((r.doc_id, r.taken) for r in p.collect())
    assert key(plan) == key(again) and plan.filter("extra_words > 0").count() <= 20


def test_mix_copies_are_fair(documents):
    """Over seeds, a document is taken as often as its probability says."""
    rows = [(i, "w " * (1 + i % 5), None, "a" if i % 2 else "b") for i in range(40)]
    df, taken = documents(rows), np.zeros(40)
    for seed in range(30):
        for r in pivotal_mix(df, seed=seed).collect():
            taken[r.doc_id] += (r.copies + (r.extra_words > 0) * r.extra_words / max(r["size"], 1)) / 30
    ratio = {r.source: r.target / r.source_size for r in pivotal_mix(df).collect()}
    for s, k in (("a", 1), ("b", 0)):
        assert abs(taken[k::2].mean() - ratio[s]) < 0.1 and abs(taken[k::2] - ratio[s]).max() < 0.45


def test_mix_edge_cases(documents):
    rows = [(1, None, None, None), (2, "", None, "a"), (3, "w " * 20_000, None, "a"), (3, "w", None, "a"), (3, "w", None, "a"), (None, "x y", None, None), (4, "z", None, "b")]
    plan = pivotal_mix(documents(rows))
    assert plan.count() == 7
    check_mix(plan)
    empty = documents(rows).limit(0)
    assert pivotal_mix(empty).collect() == [] and mixed_rows(empty).collect() == []
    kept = mixed_rows(documents([(1, "a b c d", None, "s"), (2, "a b", None, "t")]))
    assert kept.columns == documents(rows).columns


def test_mix_query_contract(spark, sf_dir):
    got = op6_mixing(spark, sf_dir)
    assert dict(got.dtypes)["taken"] == "bigint" and got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def plain_words(text):
    """Words of the task's pattern, A-Z lowered, marks at their edges cut: written apart from the operator."""
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [x for w in words if (x := re.sub(r"^[.,;:!?\"'()\[\]{}<>|*#$%&_-]+|[.,;:!?\"'()\[\]{}<>|*#$%&_-]+$", "", w))]


def share(part, text):
    """Share of a part's distinct runs of five words (of all its words, if fewer) that stand in the text."""
    k = min(5, len(part))
    runs = {" ".join(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
    line = f" {' '.join(text)} "
    return sum(f" {r} " in line for r in runs) / len(runs) if runs else 1.0


def brute_pairs(docs, items):
    have = [(i, plain_words(t)) for i, t in docs]
    out = []
    for k, t in items:
        ends = [m.end() for m in re.finditer(r"[.!?][\x20\x09-\x0d]+(?=.)", (t or "").strip(), re.DOTALL)]
        cut = (t.strip()[: ends[-1]], t.strip()[ends[-1] :]) if ends else (t, t)
        whole, *parts = (plain_words(p) for p in (t, *cut))
        if whole:
            out += [(i, k) for i, w in have if share(whole, w) >= 0.8 and all(share(p, w) >= 0.5 for p in parts)]
    return sorted(out, key=repr)


def found_pairs(docs, items, **options):
    return sorted(((r.doc_id, r.item_id) for r in contaminated_pairs(docs, items, **options).collect()), key=repr)


def test_decontamination_equals_brute_force(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted(((r.doc_id, r.item_id) for r in op7_decontamination(spark, sf_dir).collect()), key=repr)
    assert got == brute_pairs([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_decontamination_equals_its_sql(spark, sf_dir):
    same(op7_decontamination(spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLES["op7_decontamination"]).df())


@pytest.mark.parametrize("index_bytes", [1 << 20, 3000])
def test_every_document_that_holds_an_item_whole_is_found(spark, sf_dir, docs, index_bytes):
    """The planted truth: an item's words stand in the text, one after the other."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(40).collect()]
    planted = [(1000 + k, f"{texts[k % 40][1]} {t} {texts[(k + 7) % 40][1]}") for k, t in items]
    table, known = spark.createDataFrame(texts + planted, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(1000 + k, k) for k, _ in items} <= set(found_pairs(table, known, index_bytes=index_bytes))
    kept = {r.doc_id for r in decontaminate(table, known, index_bytes=index_bytes).collect()}
    held = {i for i, _ in brute_pairs(texts + planted, items)}
    assert kept == {i for i, _ in texts + planted} - held and len(kept) > 20


ITEMS = [(1, "What is the tall red tower that stands by the old river bridge? The ancient keep of Carn."), (2, "one two three four five six seven eight nine ten."), (3, None), (4, ""), (5, "tiny"), (2, "one two three four five six seven eight nine ten."), (6, "Which of the many rivers of the north is the longest? Ob."), (7, "Who? The man who came to dinner on that night. ***")]


@pytest.mark.parametrize("index_bytes", [1 << 20, 40])
def test_decontamination_edge_cases(spark, documents, index_bytes):
    filler = " ".join(f"f{i}" for i in range(500))
    q = ITEMS[0][1]
    texts = [
        (1, f"{filler} {q} {filler}"), (2, f"{filler} {q.upper().replace(' ', '!! ')}"), (3, q.split("?")[0] + "? unrelated answer here entirely"), (4, None), (5, ""), (6, filler * 20), (7, "x " * 3 + ITEMS[1][1]), (7, "x " * 3 + ITEMS[1][1]),
        (None, ITEMS[1][1]), (None, "clean"), (8, "A TINY. one"), (9, f"{filler} {ITEMS[6][1]}"), (10, f"{ITEMS[6][1][:-3]}Elbe or Don."), (11, "- " * 90 + ITEMS[6][1].replace(" ", " * ") + " -" * 90), (12, ITEMS[7][1]), (1, filler),
    ]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(1)})
    got = found_pairs(documents(texts), items, index_bytes=index_bytes)
    assert got == sorted([(1, 1), (2, 1), (7, 2), (7, 2), (7, 2), (7, 2), (None, 2), (None, 2), (8, 5), (9, 6), (11, 6), (12, 7)], key=repr) == brute_pairs(texts, ITEMS)
    left = decontaminate(documents(texts), items, index_bytes=index_bytes)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 10, None], key=repr) and left.columns == documents(texts).columns
    assert contaminated_pairs(documents(texts), items.limit(0)).count() == contaminated_pairs(documents(texts).limit(0), items, index_bytes=index_bytes).count() == 0
    assert decontaminate(documents(texts).limit(0), items, index_bytes=index_bytes).count() == 0


def test_index_in_blocks_gives_the_same_scores(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = lambda **k: sorted((r.doc_id, r.item_id, round(r.bm25, 9), r.shared_shingles) for r in contaminated_pairs(docs, items, **k).collect())
    assert rows(index_bytes=2000) == rows()


def test_shorter_texts_of_an_item_are_found_as_by_brute_force(spark):
    """Items cut and edited at random, with shingles that repeat: retrieval loses none that verification accepts."""
    rng = np.random.Generator(np.random.PCG64(8))
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words[: 4 if k % 5 == 0 else 60], rng.integers(3, 45)))) for k in range(60)]
    docs = []
    for i in range(600):
        w = items[i % 60][1].split()
        for _ in range(rng.integers(0, 3)):
            w[rng.choice([0, len(w) - 1, rng.integers(0, len(w))])] = "edit"
        a, b = rng.integers(0, 1 + len(w) // 5, 2)
        docs.append((i, " ".join(["pad"] * int(rng.integers(0, 30)) + w[a : len(w) - b])))
    got = found_pairs(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == brute_pairs(docs, items) and 100 < len(got)


def test_a_block_of_postings_may_have_any_size():
    items = [(k, f"a b c d e x{k} y{k % 7}") for k in range(200)]
    idf = {w.encode(): 1.0 + len(w) for _, t in items for w in t.split()}
    for block in (1, 3, 32, 500):
        index = Index(items, idf, 7.0, block=block)
        assert [k for k, _ in index.search({index.terms[w] for w in (b"a", b"b", b"c", b"d", b"e", b"x9", b"y2")}, 1 - 1e-9)] == [9]


def test_wand_returns_all_above_the_threshold():
    rng = np.random.Generator(np.random.PCG64(2))
    words = [f"w{i}" for i in range(120)]
    items = [(k, " ".join(rng.choice(words, rng.integers(5, 30)))) for k in range(300)]
    index = Index(items, {w.encode(): 1 + i / 50 for i, w in enumerate(words)}, 15.0)
    for _ in range(60):
        terms = {t for t in rng.integers(0, len(index.upper), rng.integers(1, 60)).tolist()}
        scores = np.zeros(300)
        for t in terms:
            for k, x in index.postings[t]:
                scores[k] += x
        for threshold in (0.3, 0.6):
            assert sorted(k for k, _ in index.search(terms, threshold)) == np.flatnonzero(scores >= threshold).tolist() or np.isclose(scores, threshold).any()


def test_passages_with_essential_terms():
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (0, 1, 9, 10, 11, 37, 200, 50_000):
        codes = rng.integers(0, 200, n).astype(np.int32)
        starts = list(range(0, max(1, n - 10), 10))
        assert dec.passages(codes, 10, 5) == [s for s in starts if (codes[s : s + 20] < 5).any()]
