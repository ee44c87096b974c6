"""Operators on small tables: the cases that a plain port would get wrong, and the sources and sinks."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glossalith.functions.script import LATIN
from glossalith.operators import corpus, dictionary, evidence, morph, ngrams, quality, search
from glossalith.sources import readers, sinks
from glossalith.streaming import lines as stream


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_self_pairs_are_kept(spark):
    pairs = ngrams.pair_counts(table(spark, [(["a", "a", "b"],)], "tokens array<string>"), 3)
    assert tuples(pairs) == [("a", "a", 1), ("a", "b", 2)]


def test_window_is_in_positions(spark):
    occ = table(spark, [(1, 10, 1), (1, 20, 10), (1, 30, 11)], "line_id int, word_id int, position int")
    assert tuples(ngrams.band_pairs(occ, 2), "a", "b") == [(20, 30)]
    assert tuples(ngrams.adjacent_pairs(occ), "a", "b") == [(10, 20), (20, 30)]


@pytest.mark.parametrize("pair,a,b,n,expected", [(3, 10, 20, 100, 0.584963), (2, 10, 20, 100, 0.0), (10**6, 4 * 10**9, 5 * 10**9, 3 * 10**12, -2.736966)])
def test_pmi_in_doubles(spark, pair, a, b, n, expected):
    row = spark.range(1).select(ngrams.pmi(*(F.lit(x).cast("bigint") for x in (pair, a, b, n))).alias("p")).first()
    assert round(row.p, 6) == pytest.approx(expected, abs=1e-6)


def test_top_k_is_per_first_word_after_the_threshold(spark):
    lines = table(spark, [(["a", f"w{i:03}"],) for i in range(60) for _ in range(5)] + [(["a", "rare"],)], "tokens array<string>")
    got = ngrams.collocations(lines, window=1, min_count=5, top=50)
    assert got.count() == 50 and not got.filter("word_b = 'rare'").count()


def test_partner_lists_a_self_pair_once(spark):
    pairs = table(spark, [("a", "a", 5), ("a", "b", 3)], "word_a string, word_b string, n int")
    assert tuples(ngrams.partners(pairs)) == [("a", "a", 5), ("a", "b", 3), ("b", "a", 3)]


def test_populated_words(spark):
    got = morph.populate(table(spark, [("ਸਤਿ",), ("abc",)], "gurmukhi string"))
    assert tuples(got, "gurmukhi", "ipa_display", "search_fold") == sorted([("ਸਤਿ", "sət̪ɪ", "ਸਤ"), ("abc", "", None)], key=repr)


def test_bare_stems_do_not_count_in_group_size(spark):
    words = table(spark, [("ਨਾਮ",), ("ਨਾਮੁ",), ("ਨਾਮਾ",)], "gurmukhi string")
    assert tuples(morph.stem_groups(words), "gurmukhi", "stem_group_size") == [("ਨਾਮਾ", 2), ("ਨਾਮੁ", 2)]


def test_item_without_details_counts_its_padded_row(spark):
    got = quality.per_source_counts(table(spark, [(1,), (2,)], "id int"), table(spark, [(1, "x")], "id int, s string"), "id", "id", "s")
    assert tuples(got) == [(1, "x", 1), (2, None, 1)]


def test_strict_lookup_fails_on_a_stray_token(spark):
    words = table(spark, [("a", 1)], "word string, word_id bigint")
    assert corpus.strict_lookup(table(spark, [("a",)], "word string"), words, ["word"], "word_id").first().word_id == 1
    with pytest.raises(PySparkException, match="unresolved token: b"):
        corpus.strict_lookup(table(spark, [("b",)], "word string"), words, ["word"], "word_id", "token").collect()


def test_verb_without_known_ending_keeps_the_pos_confidence(spark):
    senses = table(spark, [("ਲਿਖਿ", 1, "ਕ੍ਰਿ- x"), ("ਕਰਣਾ", 1, "ਕ੍ਰਿ- x"), ("ਕਰਣਾ", 2, "ਕ੍ਰਿਯਾ- y")], "gurmukhi string, sense_number int, definition_text string")
    assert tuples(morph.rule_grammar(senses), "gurmukhi", "sense_number", "verb_form", "confidence") == [("ਕਰਣਾ", 1, "infinitive", 0.72), ("ਲਿਖਿ", 1, None, 0.9)]


def test_heat_counts_each_open_flag(spark):
    flags = table(spark, [(1, "open"), (1, "open"), (1, "closed")], "word_id int, status string")
    occ, lines = table(spark, [(1, 7)], "word_id int, line_id int"), table(spark, [(7, 3)], "id int, ang int")
    assert tuples(quality.heatmap(flags, occ, lines)) == [(3, 2)]


def test_buckets_without_weight_are_zero(spark):
    got = quality.heat_buckets(table(spark, [(3, 4), (25, 2), (99, 9)], "ang int, weight int"), last=40)
    assert tuples(got) == [(0, 4, 1.0), (1, 0, 0.0), (2, 2, 0.5), (3, 0, 0.0)]
    assert tuples(quality.heat_buckets(table(spark, [], "ang int, weight int"), last=20), "ratio") == [(0.0,), (0.0,)]


def test_only_value_ignores_nulls(spark):
    rows = table(spark, [(1, "imported"), (1, None), (2, "imported"), (2, "scraped"), (3, None)], "k int, v string")
    assert tuples(quality.only_value(rows, "k", "v", "imported")) == [(1,)]


def test_search_tiers_and_wild_cards(spark):
    words = table(spark, [(1, "a%b", 5, ""), (2, "axb", 9, ""), (3, "xa%", 1, "")], "id int, gurmukhi string, frequency int, search_fold string")
    asked = table(spark, [("a%",)], "q string")
    assert tuples(search.search(asked, words), "id", "match") == [(1, "prefix")]
    assert tuples(search.search(asked, words, raw_pattern=True), "id", "match") == [(1, "prefix"), (2, "prefix")]
    assert tuples(search.search(table(spark, [("%",), (" ",)], "q string"), words), "id", "match") == [(1, "contains"), (3, "contains")]


def test_search_of_many_words_equals_a_plain_reading(spark):
    import itertools

    spelt = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("abA", repeat=n)] + ["qzab", "qqZABz", "yyyyzab", "xzzz", "zzab"]
    words = [(i, w, (i * 7) % 13, w.lower().replace("a", "")) for i, w in enumerate(spelt)]
    asked = ["a", "b", "Ab", "bba", "aaaa", "abab", "c", "bb", " ba ", "zab", "zzz", "zabz", "yyyyzabz"]
    for limit in (3, 20):
        expected = []
        for q in (x.strip() for x in asked):
            fold = search_fold_of(spark, q)
            tier = {i: 1 if w.lower().startswith(q.lower()) else 2 if fold and f.startswith(fold) else 3 if q.lower() in w.lower() else 9 for i, w, _, f in words}
            best = min(tier.values())
            hits = [(tier[i], -n, i) for i, _, n, _ in words if tier[i] < 3 or tier[i] == 3 == best]
            expected += [(q, i) for _, _, i in sorted(hits)[:limit]]
        got = search.search(table(spark, [(q,) for q in asked], "q string"), table(spark, words, "id int, gurmukhi string, frequency int, search_fold string"), limit=limit)
        assert tuples(got, "q", "id") == sorted(expected, key=repr)


def search_fold_of(spark, q):
    from glossalith.functions.script import fold_key

    return table(spark, [(q,)], "q string").select(fold_key(F.col("q"))).first()[0]


def test_page_out_of_bounds_is_empty(spark):
    lines = table(spark, [(1, 1, 1, 5, "x", 0)], "id int, source_fk int, shabad_id int, ang int, gurmukhi string, line_no int")
    shabads = table(spark, [(1, "r", "w")], "id int, raag_english string, writer_english string")
    assert search.page_view(lines, shabads, 1, 5).count() == 1
    assert search.page_view(lines, shabads, 1, 0).count() == search.page_view(lines, shabads, 1, 1431).count() == 0


def test_word_profiles_list_all_lexemes(spark):
    words = table(spark, [(1, "a"), (2, "b"), (3, "c")], "id int, gurmukhi string")
    grammar = table(spark, [(1, 1, "noun", None, None, None, "R")], "id int, word_id int, pos string, gender string, number string, gram_case string, rule_code string")
    rules = table(spark, [("R", "t", False)], "rule_code string, title string, verified boolean")
    definitions = table(spark, [(1, 2, 1, "y"), (1, 1, 1, "x")], "word_id int, dict_source_id int, sense_number int, definition_text string")
    etymology = table(spark, [], "word_id int, order_index int, origin_language string")
    forms = table(spark, [(9, 1, None), (9, 2, "direct"), (8, 1, None), (8, 3, None)], "lexeme_id int, word_id int, inflection_desc string")
    bigrams, pairs = table(spark, [(1, 2, 5)], "w1_id int, w2_id int, pair_count int"), table(spark, [(1, 1, 0.5)], "word_a_id int, word_b_id int, pmi double")
    writers = table(spark, [(1, 4, "w", 3)], "word_id int, writer_id int, writer string, frequency int")
    row = search.word_profiles(words, grammar, rules, definitions, etymology, forms, bigrams, pairs, writers).filter("word_id = 1").first()
    assert [d.definition_text for d in row.definitions] == ["x", "y"] and row.caveats == ["R"]
    assert [v.variant_id for v in row.variants] == [2, 3] and len(row.collocations) == 1 and row.etymology is None


def test_occurrence_page_groups_by_first_appearance(spark):
    occ = table(spark, [(1, 10, 0), (1, 11, 0), (1, 12, 0)], "word_id int, line_id int, position int")
    lines = table(spark, [(10, 1, 5, 1, "x"), (11, 1, None, 1, "y"), (12, 1, 5, 2, "z")], "id int, source_fk int, shabad_id int, ang int, gurmukhi string")
    sources, shabads = table(spark, [(1, "G", "g")], "id int, code string, name string"), table(spark, [(5, "Asa", "w")], "id int, raag_english string, writer_english string")
    notes = table(spark, [(10, "b", "2"), (10, "a", "1")], "line_id int, source_code string, body string")
    page = search.occurrence_page(occ, lines, sources, shabads, notes, 1, order=("b",))
    assert tuples(page, "line_id", "raag", "group_no") == [(10, "Asa", 1), (11, "Unknown", 2), (12, "Asa", 1)]
    assert [c.body for c in page.filter("line_id = 10").first().commentaries] == ["2", "1"]


def test_ingest_makes_linked_tables(spark):
    schema = "source_fk bigint, verse_id bigint, shabad_id bigint, ang int, line_no int, gurmukhi string, translations struct<bdb: string, ms: string>, writer_english string, writer_id bigint, raag_english string"
    verses = table(spark, [(1, 1, 5, 1, 1, "ab cd ab", (None, "m"), "w", 1, "r"), (2, 1, 5, 9, 1, "cd", ("b", "m"), "w", 1, "r")], schema)
    made = corpus.ingest(verses, LATIN)
    assert tuples(made["words"], "gurmukhi", "frequency") == [("ab", 2), ("cd", 2)]
    assert tuples(made["lines"], "source_fk", "translation_en") == [(1, "m"), (2, "b")]
    assert made["word_occurrences"].count() == 4 and made["shabads"].count() == 1


def test_curation_and_spelling_merge(spark):
    words = table(spark, [(1, "teh"), (2, "the"), (3, "abc")], "id int, gurmukhi string")
    senses = table(spark, [(1, 1, "x"), (2, 1, "y"), (2, 2, "z")], "word_id int, sense_number int, text string")
    decisions = table(spark, [(1, "correct", "the"), (3, "correct", "abd")], "word_id int, action string, spelling string")
    kept, moved = dictionary.merge_spelling(words, senses, decisions)
    assert tuples(kept, "id", "gurmukhi", "spelling_reviewed") == [(2, "the", False), (3, "abd", True)]
    assert tuples(moved) == [(2, 1, "y"), (2, 2, "z"), (2, 3, "x")]
    flags = table(spark, [(7, "definitions", 4)], "id int, target_table string, target_id int")
    target = table(spark, [(4, "unreviewed", None), (5, "unreviewed", None)], "id int, review_status string, curation_note string")
    pushed = table(spark, [(7, "approved", "n")], "id int, review_status string, note string")
    assert tuples(evidence.curate(target, flags, pushed, "definitions"), "id", "review_status") == [(4, "approved"), (5, "unreviewed")]


def test_senses_from_landed_entries(spark):
    entries = table(spark, [(0, "ਕ", True, "ਕ", None, [(1, "old")]), (1, "ਕ", True, "ਕ", None, [(1, "ਸੰ. new")]), (2, "ਖ", False, None, None, None)], "seq int, gurmukhi string, found boolean, entry_gurmukhi string, source_url string, senses array<struct<sense_number: int, definition_text: string>>")
    parsed = dictionary.parse_definitions(table(spark, [(0, "ਕ", 1, "ਸੰ. new")], "seq int, gurmukhi string, sense_number int, definition_text string"))
    got = dictionary.ingest_senses(entries, parsed, table(spark, [(1, "ਕ")], "id int, gurmukhi string"))
    assert tuples(got, "word_id", "sense_number", "definition_text") == [(1, 1, "ਸੰ. new")]
    assert got.first().cross_refs == {"origin_lang": "sa"}


def test_glossary_editions(spark):
    words = table(spark, [(1, "ਕ")], "id int, gurmukhi string")
    pages = table(spark, [("ਕ", "10", True, "b"), ("ਕ", "9", True, "a"), ("ਕ", "11", True, "a"), ("ਖ", "1", True, "c")], "gurmukhi string, wn_id string, found boolean, meaning string")
    assert tuples(dictionary.glossary_senses(pages, words), "meaning", "sense_number") == [("a", 1), ("b", 2)]
    first, other = table(spark, [("ਕ", "x")], "term string, wn string"), table(spark, [("k2", "x", 2), ("k1", "x", 1)], "term string, wn string, ord int")
    assert dictionary.pair_editions(first, other, words).first().roman == "k1"
    defs = table(spark, [(["ਸ਼", "ਗ"],)], "t array<string>").select(F.struct(F.transform("t", lambda x: F.struct(x.alias("target"))).alias("xrefs")).alias("parsed"))
    assert tuples(dictionary.existing_targets(defs, table(spark, [("ਸ਼",)], "gurmukhi string"))) == [("ਸ਼",)]


def test_readers(spark, tmp_path):
    page = {"source": {"sourceId": "G", "pageNo": 1}, "count": 1, "page": [{"verseId": 3, "shabadId": 1, "verse": {"unicode": "x"}, "pageNo": 1, "lineNo": 2, "translation": {"en": {"bdb": None, "ms": "m"}}, "writer": {"writerId": 1, "english": "w"}, "raag": {"english": "r"}}]}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text(json.dumps(page))
    assert tuples(readers.corpus_pages(spark, str(tmp_path / "pages")), "verse_id", "gurmukhi", "translations.ms") == [(3, "x", "m")]
    (tmp_path / "bani.json").write_text(json.dumps({"baniInfo": {"baniID": 2}, "verses": [{"verse": {"verseId": 5, "pageNo": 1, "lineNo": 1}}, {"verse": {"pageNo": 1}}]}))
    assert tuples(readers.bani_verses(spark, str(tmp_path / "bani.json")), "bani_id", "verse_id") == [(2, 5)]
    (tmp_path / "shabad.json").write_text(json.dumps({"shabadInfo": {"shabadId": 4}, "verses": [{"verseId": 7, "pageNo": 1, "lineNo": 2, "verse": {"unicode": "x"}}, {"pageNo": 1}]}))
    assert tuples(readers.shabad_verses(spark, str(tmp_path / "shabad.json")), "shabad_id", "verse_id", "gurmukhi") == [(4, 7, "x")]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert tuples(readers.json_lines(spark, str(tmp_path / "rows.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "value": 1}\n{"key": "b", "value": null}\n{"key": "a", "value": 2}\n{"key": "c", "val')
    cache = readers.lookup_cache(spark, str(tmp_path / "cache.jsonl"))
    assert tuples(cache) == [("a", "2"), ("b", None)]
    wanted = table(spark, [("a",), ("z",), ("z",)], "key string")
    assert tuples(readers.cache_misses(wanted, cache)) == [("z",)] and readers.pending(wanted, cache, "key").count() == 2
    senses = table(spark, [("k", [(1, "x")], 0), ("k", [(1, "y")], 1)], "gurmukhi string, senses array<struct<sense_number: int, t: string>>, seq int")
    assert tuples(readers.side_map(senses), "t") == [("y",)]


def test_sinks_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, [(1, "a"), (2, "a")], "id int, scope string")
    sinks.upsert(rows, path, ["id"])
    for _ in range(2):
        sinks.upsert(table(spark, [(2, "b"), (3, "b")], "id int, scope string"), path, ["id"])
    assert tuples(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (3, "b")]
    for _ in range(2):
        sinks.scoped_replace(table(spark, [(9, "b")], "id int, scope string"), path, {"scope": "b"})
    assert tuples(spark.read.parquet(path)) == [(1, "a"), (9, "b")]
    for _ in range(2):
        sinks.append_absent(table(spark, [(9, "z"), (8, "z")], "id int, scope string"), path, ["id"])
    assert tuples(spark.read.parquet(path)) == [(1, "a"), (8, "z"), (9, "b")]
    words = str(tmp_path / "words")
    rows.write.parquet(words)
    sinks.teardown(spark, {"t": path, "words": words}, "scope", "a")
    assert tuples(spark.read.parquet(path)) == [(8, "z"), (9, "b")] and spark.read.parquet(words).count() == 2
    parts = str(tmp_path / "parts")
    for _ in range(2):
        sinks.replace_partitions(rows.withColumn("code", F.lit("x")), parts, ["code"])
    sinks.replace_partitions(rows.withColumn("code", F.lit("y")), parts, ["code"])
    assert spark.read.parquet(parts).count() == 4


def test_a_batch_holds_at_least_one_row(spark):
    rows = table(spark, [("a",), ("c",), ("b",)], "k string")
    assert tuples(sinks.batches(rows, "k", 2)) == [("a", 0), ("b", 0), ("c", 1)]
    with pytest.raises(ValueError):
        sinks.batches(rows, "k", 0)


def test_a_table_is_swapped_and_the_old_one_goes(spark, tmp_path):
    path = tmp_path / "t"
    for n in (1, 2):
        sinks.replace_table(table(spark, [(n,)], "n int"), str(path))
    assert tuples(spark.read.parquet(str(path))) == [(2,)] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_stream_counts_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for k in range(2):
        table(spark, [(k, "s", "ab cd ab")], "line_id bigint, source string, line string").withColumn("at", F.to_timestamp(F.lit("2024-01-01"))).coalesce(1).write.mode("append").parquet(str(inbox))
        query = stream.append_occurrences(stream.line_stream(spark, str(inbox)), out, str(tmp_path / "checkpoint"), LATIN)
        query.awaitTermination()
        stream.compact(spark, out)
    assert tuples(stream.frequencies(spark, out), "word", "frequency") == [("ab", 4), ("cd", 2)]
    assert spark.read.parquet(f"{out}/occurrences").count() == 6
    counts = stream.windowed_counts(stream.line_stream(spark, str(inbox)), script=LATIN)
    assert counts.isStreaming


def test_refresh_is_idempotent(spark, tmp_path):
    from glossalith.plans.refresh import refresh

    words = table(spark, [(1, "ਨਾਮੁ"), (2, "ਨਾਮਾ"), (3, "ਗੁਰ")], "id bigint, gurmukhi string")
    occ, lines = table(spark, [(1, 7), (1, 8), (2, 7)], "word_id bigint, line_id bigint"), table(spark, [(7, 1, 4, "w"), (8, 2, None, None)], "id bigint, source_fk bigint, writer_id bigint, writer string")
    definitions = table(spark, [(1, 5)], "word_id bigint, dict_source_id bigint")
    root = str(tmp_path)
    for _ in range(2):
        refresh(spark, root, words, occ, lines, definitions)
    assert tuples(spark.read.parquet(f"{root}/words"), "id", "frequency", "in_corpus") == [(1, 2, True), (2, 1, True), (3, 0, False)]
    assert tuples(spark.read.parquet(f"{root}/word_source_stats")) == [(1, 5, 1), (2, None, 1), (3, None, 1)]
    assert spark.read.parquet(f"{root}/word_stem_groups").count() == 2 and spark.read.parquet(f"{root}/word_writer_stats").count() == 2


def test_functions_in_sql(spark):
    from glossalith.functions.register import register

    register(spark)
    assert spark.sql("select display_ipa('ਸਤਿ') a, match_fold('kərm') b, devanagari_slp1('धर्म') c").first() == ("sət̪ɪ", "karm", "Darma")
    assert [r.value for r in spark.sql("select * from grammar_facts('ਕੋਟੁ = ਕਿਲ੍ਹਾ (ਨਾਂਵ ਇਕ-ਵਚਨ) ।')").collect()] == ["singular", "noun"]
    assert [r.part for r in spark.sql("select * from sense_parts('ਸੰ. गुर ਧਾ- ਯਤਨ.')").collect()] == ["language", "pos", "residue"]


def test_evidence_of_items_without_numbers_equals_the_sql(spark, tmp_path):
    from glossalith.plans.evidence_queries import evidence_merge
    from glossalith.plans.registry import ORACLES

    from .compare import connect, same

    rows = [
        # a null order leads nothing while another is there, a null line has a rule, ranks take nulls last
        (None, 1, 3, 1, "R", "F"), (5, 1, 4, 1, "R", "F"),
        (7, 2, 1, None, "N", "F"), (7, 2, 2, 2, "N", "F"),
        (None, 4, 5, 1, "A", "O"), (9, 4, 6, 1, "A", "F"), (None, 4, 9, 4, "A", "F"),
        (None, None, None, None, None, None), (None, 5, 1, 1, "R", "O"),
    ]
    table(spark, rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    same(evidence_merge(spark, str(tmp_path)).toPandas(), connect(str(tmp_path)).sql(ORACLES["evidence_merge"]).df())
