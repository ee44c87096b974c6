"""Secret scans: candidates by pattern, false positives removed by a random forest over their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MARKS = r"A-Za-z0-9_+/=@:.\-"
# Words that announce a secret, and the formats by which known findings are labelled.
ANNOUNCE = r"(?i)(key|token|secret|passw(or)?d|pwd|auth|credential|bearer)"
_ANNOUNCED, _QUOTE = r"(?i:key|token|secret|passw(?:or)?d|pwd|auth|credential|bearer)[\w\-]{0,24}", r"\\?[\"'`]?"
#: What makes a run without a digit, or of 8 to 11 characters, a candidate: a known format in it; an announcing word with
#: = or : in it; such a word before it, up to 24 further letters of its name and 12 blanks on each side of the mark away.
_KNOWN = rf"(?=[{MARKS}]{{19}})(?=[{MARKS}]*?(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|(?:gh[pousr]_|xox[abp]-|sk-)[A-Za-z0-9\-]{{16}}))"
_WITHIN = rf"(?=[{MARKS}]*?[=:][{MARKS}]{{8}})(?=[{MARKS}]*?{_ANNOUNCED}[=:]{{1,2}}[{MARKS}]{{8}})"
_BEFORE = rf"(?<=[=:>][\s\\\"'`]{{0,14}})(?<={_ANNOUNCED}{_QUOTE}\s{{0,12}}[=:]{{1,2}}>?\s{{0,12}}{_QUOTE})"
#: A run of at least 12 such characters that holds a digit, or of at least 8 that is known or announced.
CANDIDATE = rf"(?<![{MARKS}])(?=[{MARKS}]{{8}})(?:(?=[{MARKS}]*[0-9])[{MARKS}]{{12,}}|(?:{_KNOWN}|{_BEFORE}|{_WITHIN})[{MARKS}]{{8,}})"
KNOWN_SECRET = [r"^AKIA[0-9A-Z]{16}[.,:]?$", r"^(gh[pousr]_|xox[abp]-|sk-)[A-Za-z0-9\-]{16,}"]
KEYED_SECRET = r"(?i)^(password|passwd|pwd|secret|token|api_?key)\s*[=:]\S{8,}"
KEYED_BEFORE = r"(?i)(password|passwd|pwd|secret|token|api_?key)\\?[\"'`]?\s*(=\s*\\?[\"'`]?|:\s*\\?[\"'`])$"
QUOTED_VALUE = r"^[0-9a-zA-Z+/=_\-]{16,}$"
FEATURES = ["length", "digits", "uppers", "hexes", "turns", "transitions", "distinct", "vowel_turns", "coverage", "slashes", "dots", "at", "announced", "assigned", "quoted", "self_announced", "neighbour_digits", "before_rate", "after_rate"]
#: Log probability of a transition that the model's words don't have.
UNSEEN = -9.0
#: Documents that a neighbouring word's rate of secrets is drawn towards the common rate by.
PRIOR = 4.0
FOLDS = 5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, start (0-based), token, before and after (24 characters of context)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text__")).filter(F.col("text__").rlike(CANDIDATE))
    parts = cut.select("id", F.split("text__", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text__", F.lit(CANDIDATE), F.lit(0)).alias("tokens"))
    cells = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.right(F.get("gaps", i), F.lit(24)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(24)).alias("after"), (F.length(F.get("gaps", i)) + F.length(t)).alias("span"), F.length(t).alias("n")))
    # starts as running sums of gaps and tokens
    started = F.aggregate(cells, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, c: F.struct((s["at"] + c["span"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + c["span"] - c["n"])).alias("starts")))["starts"]
    found = parts.select("id", cells.alias("c"), started.alias("s")).select("id", F.explode(F.arrays_zip("c", "s")).alias("x"))
    return found.select("id", F.col("x.s").alias("start"), F.col("x.c.token").alias("token"), F.col("x.c.before").alias("before"), F.col("x.c.after").alias("after"))


def vocabulary(docs: DataFrame, text_col: str = "text", min_documents: int = 3) -> DataFrame:
    """(word, n): lower-case words of four or more letters that at least min_documents documents have, and how many."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![\w])[a-z]{4,}(?![\w])"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents)


def _pairs(text: Column) -> Column:
    """The neighbouring characters of a text: letters in lower case, a digit as 0, other marks as a full stop."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", ".")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))


def transition_model(words: DataFrame) -> DataFrame:
    """(pair, logp) of words (word, n): how likely a character follows another in ordinary words. At most 28 * 28 rows."""
    counts = words.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    of = counts.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("n").alias("all"))
    return counts.join(of, F.left("pair", F.lit(1)) == F.col("first")).select("pair", F.log((F.col("n") + 0.1) / (F.col("all") + 2.8)).alias("logp"))


def featured(found: DataFrame, words: DataFrame, transitions: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES but the rates of neighbouring words. coverage: share of the token's characters in
    letter runs that the vocabulary has; transitions: mean log probability of the token's character transitions."""
    tokens = found.select("token").distinct()
    runs = F.array_distinct(F.regexp_extract_all(F.lower("token"), F.lit("[a-z]{4,}"), F.lit(0)))
    covered = tokens.select("token", F.explode(runs).alias("word")).join(words, "word").groupBy("token").agg(F.sum(F.length("word")).alias("covered"))
    steps = tokens.select("token", F.explode(_pairs(F.col("token"))).alias("pair")).join(F.broadcast(transitions), "pair", "left")  # at most 784 rows
    steps = steps.groupBy("token").agg(F.avg(F.coalesce("logp", F.lit(UNSEEN))).alias("transitions"))
    found = found.join(steps, "token")
    n, token = F.length("token"), F.col("token")
    share = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    return found.join(covered, "token", "left").withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "hexes": share("[0-9a-f]"),
            "turns": F.regexp_count(token, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / n,
            "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
            "vowel_turns": share("(?i)[aeiou][^aeiou]"),
            "coverage": F.least(F.lit(1.0), F.coalesce(F.col("covered") / n, F.lit(0.0))),
            "slashes": F.regexp_count(token, F.lit("/")).cast("double"),
            "dots": F.regexp_count(token, F.lit("[.:]")).cast("double"),
            "at": F.regexp_count(token, F.lit("@")).cast("double"),
            "announced": F.col("before").rlike(ANNOUNCE).cast("double"),
            "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "quoted": F.col("before").rlike("[\"']$").cast("double"),
            "self_announced": token.rlike(ANNOUNCE + "[=:]").cast("double"),
            "neighbour_digits": F.regexp_count(F.concat("before", "after"), F.lit("[0-9]")).cast("double"),
        }
    )


def format_label() -> Column:
    """1 for findings of a known format (a provider's key, an assignment to a secret's name, a quoted value after one),
    else 0: the labels when no reviewed findings are given."""
    token = F.col("token")
    known = F.lit(False)
    for pattern in KNOWN_SECRET:
        known = known | token.rlike(pattern)
    return (known | token.rlike(KEYED_SECRET) | F.col("before").rlike(KEYED_BEFORE) | (token.rlike(QUOTED_VALUE) & (F.col("announced") == 1) & (F.col("assigned") == 1))).cast("double")


def _neighbours(rows: DataFrame, sample: DataFrame, base: float) -> DataFrame:
    """Adds before_rate and after_rate: the share of secrets among the sample's candidates with the same word next to them,
    drawn towards the base rate. The sample's rows are in FOLDS parts, each of which is rated by the others, so that no
    row's own label shows in its rate."""
    fold = F.pmod(F.xxhash64("order__", F.lit(2)), F.lit(FOLDS))
    for side, pattern in (("before", r"([a-z]+)[^a-z]*$"), ("after", r"^[^a-z]*([a-z]+)")):
        word = F.regexp_extract(F.lower(side), pattern, 1)
        parts = sample.groupBy(word.alias("word__"), fold.alias("fold__")).agg(F.sum("label").alias("pos__"), F.count(F.lit(1)).alias("all__"))
        whole = parts.groupBy("word__").agg(F.sum("pos__").alias("pos_all__"), F.sum("all__").alias("all_all__"))
        rows = rows.withColumn("word__", word).withColumn("fold__", F.when(F.col("in_sample"), fold))
        rows = rows.join(F.broadcast(whole), "word__", "left").join(F.broadcast(parts), ["word__", "fold__"], "left")  # rows per word of the sample
        count = lambda total, own: F.coalesce(total, F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
        rate = (count("pos_all__", "pos__") + PRIOR * base) / (count("all_all__", "all__") + PRIOR)
        rows = rows.withColumn(f"{side}_rate", rate).drop("word__", "fold__", "pos__", "all__", "pos_all__", "all_all__")
    return rows


def scan_secrets(docs: DataFrame, label: Column | None = None, findings: DataFrame | None = None, train_filter=None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, trees: int = 20, depth: int = 6, threshold: float = 0.5, min_documents: int = 3, seed: int = 3) -> DataFrame:
    """One row per candidate: id, start, token_sha256, length, probability, is_secret.

    findings: labelled findings (id, start, is_secret), of which those count that are candidates; the rest of the
    candidates is unlabelled. Without them, label: a column over the candidates' features, 1 for a true finding;
    format_label() if None. train_filter: a function of the id column, true for documents to learn from. The forest is
    trained on at most 1.25 * max_labelled labelled candidates, drawn by a hash of place and token; every candidate is
    scored, by its length and characters, their transitions against those of the corpus's words, the share that
    dictionary words cover, path marks, and the words next to it. A sample with one class gives that class to all; one
    without any, no secrets. Null and empty texts have no candidates; long texts and tokens are read whole; repeated rows
    give repeated findings, scored alike; findings that repeat count once, as secret if any says so. Rows with a null id
    have candidates but no labelled findings. An empty table gives an empty result. Other columns are not read.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ws = Workspace(docs.sparkSession, "secrets")
    found = ws.save(candidates(docs, id_col, text_col), "found")
    known = ws.save(vocabulary(docs, text_col, min_documents), "vocabulary")
    wanted = found.select(F.explode(F.regexp_extract_all(F.lower("token"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    words = known.select("word").join(wanted, "word", "left_semi")
    rows = featured(found, words, transition_model(known))  # both are read by this one job, so neither is written
    if findings is not None:
        told = findings.groupBy(F.col("id").alias("f_id"), F.col("start").alias("f_start")).agg(F.max(F.col("is_secret").cast("int")).cast("double").alias("label"))
        rows = rows.join(told, (F.col("id") == F.col("f_id")) & (F.col("start") == F.col("f_start")), "left").drop("f_id", "f_start")
    else:
        rows = rows.withColumn("label", (label if label is not None else format_label()).cast("double"))
    teaches = F.col("label").isNotNull() & (F.coalesce(train_filter(F.col("id")), F.lit(False)) if train_filter else F.lit(True))
    rows = ws.save(rows.withColumn("teaches", teaches).withColumn("order__", F.xxhash64("id", "start", "token", "before", "after")), "featured")
    ws.drop("vocabulary")
    n = rows.filter("teaches").count()
    share = int(min(1.0, max_labelled / max(n, 1)) * (1 << 30))
    rows = rows.withColumn("in_sample", F.col("teaches") & (F.pmod(F.xxhash64("order__", F.lit(1)), F.lit(1 << 30)) < share))
    drawn = rows.filter("in_sample")
    # equal rows are drawn together: a fixed order and a last limit bound the sample even then
    sample = ws.save(drawn.orderBy("order__", *(c for c in FEATURES if not c.endswith("_rate")), "label").limit(max_labelled * 5 // 4), "sample")
    classes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    base = classes.get(1.0, 0) / max(1, sum(classes.values()))
    if len(classes) > 1:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features__")
        taught = _neighbours(sample, sample, base).select(*FEATURES, "label").repartition(1).sortWithinPartitions(*FEATURES, "label")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features__", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(assembled.transform(ws.save(taught, "taught")))
        scored = forest.transform(assembled.transform(_neighbours(rows, sample, base))).withColumn("p__", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    else:
        scored = rows.withColumn("p__", F.lit(base))
    return scored.select(F.col("id").alias(id_col), "start", F.sha2("token", 256).alias("token_sha256"), F.col("length").cast("int").alias("length"), F.col("p__").alias("probability"), (F.col("p__") >= threshold).alias("is_secret"))
