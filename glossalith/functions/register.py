"""The parsers for use in SQL: scalar functions and table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .grammar_notes import grammar_facts_sql
from .phonetics import display_ipa, match_fold_sql, transliterate_devanagari
from .sense_parser import TIDY, SenseParser


class SenseParts:
    """Table function sense -> (part, marker, value): its languages, parts of speech, pointers and residue."""

    def __init__(self) -> None:
        self.parser = SenseParser()

    def eval(self, sense: str) -> Iterator[tuple]:
        parsed = self.parser.parse(sense)
        for o in parsed["language_origins"]:
            yield "language", o["marker"], o["language"]
        for p in parsed["pos"]:
            yield "pos", p["marker"], p["pos"]
        for x in parsed["xrefs"]:
            yield "xref", None, x["target"]
        residue = parsed["residue"]
        for pattern, by in TIDY:
            residue = re.sub(pattern, by, residue)
        yield "residue", None, residue


def register(spark: SparkSession) -> None:
    """Registers display_ipa, match_fold, devanagari_iast, devanagari_slp1, grammar_facts and sense_parts."""
    scalars = {"display_ipa": display_ipa, "devanagari_iast": transliterate_devanagari, "devanagari_slp1": lambda t: transliterate_devanagari(t, "slp1")}
    for name, function in scalars.items():
        spark.udf.register(name, F.udf(lambda value, f=function: f(value), "string", useArrow=True))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION match_fold(sound STRING) RETURNS STRING RETURN {match_fold_sql('sound')}")
    facts = f"SELECT f.headword, f.attribute, f.value, f.snippet FROM (SELECT explode({grammar_facts_sql('body')}) AS f)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION grammar_facts(body STRING) RETURNS TABLE (headword STRING, attribute STRING, value STRING, snippet STRING) RETURN {facts}")
    spark.udtf.register("sense_parts", F.udtf(SenseParts, returnType="part string, marker string, value string"))
