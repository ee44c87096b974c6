"""The operators over their whole tables, with the parameters of production, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bucket_of, table

# The rules of op4 as (host, path, verdict).
URL_RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]
END_ID = 2
#: Schemas of the calls that conversations hold: a call's text is neither empty nor long, and comes early.
TURN = {"text": ("string", True, {"minLength": 1, "maxLength": 600}), "turn": ("integer", True, {"minimum": 0, "maximum": 8})}
CALL_SCHEMAS = {"user": TURN, "system": TURN, "none": TURN}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    scorer = train(docs, table(spark, sf_dir, "labels"), lambda i: bucket_of(i, 5) != 0)
    scored = score_documents(docs, scorer, extra={"held_out": bucket_of(F.col("doc_id"), 5) == 0})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    from .language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, lambda i: bucket_of(i, 4) != 2)
    return identify(docs, model, extra={"held_out": bucket_of(F.col("doc_id"), 4) == 2})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written token files."""
    from .token_output import encode_documents, ids_crc32, read_tokens, write_tokens

    path = Workspace(spark, "tokens").path("ids")
    write_tokens(encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID), path)
    return ids_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    from .url_filter import judge_urls

    # trust should not go far along domains: half of it is left after a step
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, damping=0.5).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pivotal_mix

    return pivotal_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    from .decontaminate import contaminated_pairs

    found = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared_shingles")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import conversation_calls, link_tool_calls

    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, CALL_SCHEMAS)
    return linked.select(F.col("group_id").alias("conv_id"), "call_id", "name", "status", "depth", F.sha2("record", 256).alias("record_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate; the forest has not learned from those held out."""
    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"), train_filter=lambda i: bucket_of(i, 5) != 0)
    return found.withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .odd_sketch import near_dedup

    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_token_output, op4_url_filter, op5_exact_dedup, op6_mixing, op7_decontamination, op8_tool_calls, op9_secrets, op10_near_dedup, pipeline)}

_BLANK = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Distinct 5-word shingles of a list of words w; fewer words are one, none gives an empty list.
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END"
_WORDS = f"list_filter(string_split_regex({_LOWER.format('text')}, '{_BLANK}'), lambda x: x <> '')"
_NORMAL = "list_filter(list_transform({words}, lambda x: trim(x, '.,;:!?\"''()[]{{}}<>|*#$%&_-')), lambda x: x <> '')".format(words=_WORDS)



def _url_sql(rounds: int = 60) -> str:
    """The rules, the host edges and the two walks, a table for every round (half of what moves is left after each)."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    fold = _LOWER.format("{}")
    walk = "".join(
        f""",
        r{k} AS MATERIALIZED (SELECT r.kind, r.host, r.seed, 0.5 * r.seed + 0.5 * (coalesce(f.flow, 0) + l.lost * r.seed) AS score FROM r{k - 1} r
            LEFT JOIN (SELECT e.kind, e.dst AS host, sum(x.score * e.share) AS flow FROM r{k - 1} x JOIN edges e ON e.kind = x.kind AND e.src = x.host GROUP BY 1, 2) f ON f.kind = r.kind AND f.host = r.host
            JOIN (SELECT x.kind, sum(CASE WHEN o.src IS NULL THEN x.score ELSE 0 END) AS lost FROM r{k - 1} x LEFT JOIN (SELECT DISTINCT kind, src FROM edges) o ON o.kind = x.kind AND o.src = x.host GROUP BY 1) l ON l.kind = r.kind)"""
        for k in range(1, rounds + 1)
    )
    return f"""
        WITH cut AS (SELECT row_number() OVER () AS rid, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        placed AS (SELECT rid, page_id, html, coalesce({fold.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        rules AS (SELECT * FROM (VALUES {rules}) t(h, p, verdict)),
        fits AS (SELECT rid, h || '/' || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC, h || '/' || p DESC, verdict DESC) AS k
                 FROM placed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, '/' || p)),
        hit AS (SELECT placed.*, rule, verdict FROM placed LEFT JOIN fits ON fits.rid = placed.rid AND k = 1),
        seeds AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS trust, count(*) FILTER (WHERE verdict = 'block') AS distrust FROM hit WHERE host <> '' GROUP BY 1),
        href AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/"''?#\\s>]+)', 1))) AS dst FROM placed WHERE host <> ''),
        found AS (SELECT src, {fold.format('dst')} AS dst FROM href),
        own AS (SELECT * FROM found WHERE src <> dst AND dst <> ''),
        named AS (SELECT DISTINCT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM (SELECT host FROM placed UNION SELECT dst FROM own)),
        chain AS (SELECT host, l, unnest(range(1, len(l) - 1)) AS i FROM named WHERE len(l) > 2 AND NOT regexp_full_match(host, '[0-9.:\\[\\]a-f]*')),
        steps AS (SELECT DISTINCT CASE WHEN i = 1 THEN host ELSE array_to_string(l[i:], '.') END AS a, array_to_string(l[i + 1:], '.') AS b FROM chain),
        links AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, count(*) AS n FROM own GROUP BY 1, 2 UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) GROUP BY 1, 2),
        ways AS (SELECT 't' AS kind, src, dst, n FROM links UNION ALL SELECT 'd', dst, src, n FROM links),
        edges AS MATERIALIZED (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways),
        hosts AS (SELECT host FROM seeds UNION SELECT src FROM links UNION SELECT dst FROM links),
        r0 AS MATERIALIZED (SELECT kind, host, seed, seed AS score FROM (SELECT 't' AS kind, host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0.0)::DOUBLE AS seed FROM hosts LEFT JOIN seeds USING (host)
                            UNION ALL SELECT 'd', host, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0.0)::DOUBLE FROM hosts LEFT JOIN seeds USING (host))){walk},
        scores AS (SELECT host, sum(score) FILTER (WHERE kind = 't') AS t, sum(score) FILTER (WHERE kind = 'd') AS d FROM r{rounds} GROUP BY 1)
        SELECT page_id, hit.host, path, rule, coalesce(verdict, CASE WHEN t + d > 0 AND round(d / (t + d), 6) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM hit LEFT JOIN scores ON scores.host = hit.host
    """


ORACLES: dict[str, str] = {
    "op4_url_filter": _url_sql(),
    "op7_decontamination": f"""
        WITH parted AS (SELECT item_id, text, string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark WHERE text IS NOT NULL),
        parts AS (SELECT item_id, 'whole' AS part, text FROM parted UNION ALL SELECT item_id, 'question', CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], ' ') ELSE text END FROM parted
                  UNION ALL SELECT item_id, 'answer', CASE WHEN len(s) > 1 THEN s[len(s)] ELSE text END FROM parted),
        spelt AS (SELECT item_id, part, {_NORMAL} AS w FROM parts),
        doc AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT doc_id, {_NORMAL} AS w FROM documents WHERE text IS NOT NULL)),
        long AS (SELECT item_id, part, unnest({_SHINGLES}) AS g FROM spelt WHERE len(w) >= 5),
        size AS (SELECT item_id, part, count(*) AS n FROM long GROUP BY 1, 2),
        doc_gram AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM doc WHERE len(w) >= 5),
        hits AS (SELECT doc_id, item_id, part, count(*) AS k FROM doc_gram JOIN long USING (g) GROUP BY 1, 2, 3),
        short AS (SELECT item_id, part, ' ' || array_to_string(w, ' ') || ' ' AS line FROM spelt WHERE len(w) BETWEEN 1 AND 4),
        held AS (SELECT doc_id, item_id, n AS item_shingles, k AS shared_shingles FROM hits JOIN size USING (item_id, part) WHERE part = 'whole' AND k >= 0.8 * n
                 UNION ALL SELECT doc_id, item_id, 1, 1 FROM short JOIN doc ON contains(doc.line, short.line) WHERE part = 'whole'),
        broken AS (SELECT h.doc_id, h.item_id FROM held h JOIN size z ON z.item_id = h.item_id AND z.part <> 'whole' LEFT JOIN hits x ON x.doc_id = h.doc_id AND x.item_id = h.item_id AND x.part = z.part WHERE coalesce(x.k, 0) < 0.5 * z.n
                   UNION ALL SELECT h.doc_id, h.item_id FROM held h JOIN short s ON s.item_id = h.item_id AND s.part <> 'whole' JOIN doc ON doc.doc_id = h.doc_id WHERE NOT contains(doc.line, s.line))
        SELECT doc_id, item_id, item_shingles, shared_shingles FROM held ANTI JOIN broken USING (doc_id, item_id)
    """,
    "op10_near_dedup": f"""
        WITH RECURSIVE sets AS (SELECT doc_id, {_SHINGLES} AS g FROM (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents)),
        flat AS (SELECT doc_id, unnest(g) AS g FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.g) + len(y.g) - k)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM sets LEFT JOIN low USING (doc_id)
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op8_tool_calls": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'none') AS role, text, conv_id || ':' || turn AS id FROM conversations),
        calls AS (SELECT * FROM t WHERE role <> 'assistant'),
        results AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS id FROM t WHERE role = 'assistant'),
        gaps AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 0 ELSE 1 END AS fresh FROM calls),
        chains AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM gaps),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1 AS depth FROM chains)
        SELECT p.conv_id, p.id AS call_id, p.role AS name, CASE WHEN r.id IS NULL THEN 'no_result' WHEN p.text IS NULL OR length(p.text) NOT BETWEEN 1 AND 600 OR p.turn NOT BETWEEN 0 AND 8 THEN 'invalid_arguments' ELSE 'linked' END AS status, p.depth,
               sha256(json_object('arguments', json_object('text', p.text, 'turn', p.turn), 'id', p.id, 'name', p.role, 'result', r.text)::VARCHAR) AS record_sha256
        FROM placed p LEFT JOIN results r ON p.id = r.id
        UNION ALL
        SELECT r.conv_id, r.id, NULL, 'orphan_result', NULL, sha256(json_object('id', r.id, 'result', r.text)::VARCHAR)
        FROM results r WHERE r.id NOT IN (SELECT id FROM calls)
    """,
}
