"""Pronunciation, transliteration and sound matching: stateful per character, so Arrow-batched over distinct words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sounds by letter and sign, and the nasal before each place of articulation.
SOUNDS = {
    "ਅ": "ə", "ਸ": "s", "ਹ": "ɦ", "ਕ": "k", "ਖ": "kʰ", "ਗ": "g", "ਘ": "g", "ਙ": "ŋ", "ਚ": "t͡ʃ", "ਛ": "t͡ʃʰ", "ਜ": "d͡ʒ", "ਝ": "d͡ʒ", "ਞ": "ɲ",
    "ਟ": "ʈ", "ਠ": "ʈʰ", "ਡ": "ɖ", "ਢ": "ɖ", "ਣ": "ɳ", "ਤ": "t̪", "ਥ": "t̪ʰ", "ਦ": "d̪", "ਧ": "d̪", "ਨ": "n̪", "ਪ": "p", "ਫ": "pʰ", "ਬ": "b", "ਭ": "b", "ਮ": "m",
    "ਯ": "j", "ਰ": "ɾ", "ਲ": "l", "ਵ": "ʋ", "ੜ": "ɽ",
    "ਾ": "aː", "ਿ": "ɪ", "ੀ": "iː", "ੁ": "ʊ", "ੂ": "uː", "ੇ": "eː", "ੈ": "ɛː", "ੋ": "oː", "ੌ": "ɔː",
    "ਆ": "aː", "ਇ": "ɪ", "ਈ": "iː", "ਉ": "ʊ", "ਊ": "uː", "ਏ": "eː", "ਐ": "ɛː", "ਓ": "oː", "ਔ": "ɔː", "ੱ": "geminate",
}
NASAL_BEFORE = {
    "ŋ": "ਕਖਗਘਙ",
    "ɲ": "ਚਛਜਝਞਯ",
    "ɳ": "ਟਠਡਢਣੜ",
    "m": "ਪਫਬਭਮਵ",
    "Ṽ": "ਹ",
}
DENTAL, SCHWA = "n̪", "ə"
SIGNS, NASALS, ADDAK, VIRAMA = "ਾਿੀੁੂੇੈੋੌ", "ਂੰ", "ੱ", "੍"
_NASAL = {c: sound for sound, letters in NASAL_BEFORE.items() for c in letters}
#: One unit of writing at a time: addak, virama, nasal or sign alone, or a letter with what it carries.
_UNIT = re.compile(rf"(?P<addak>{ADDAK})|(?P<virama>{VIRAMA})|(?P<nasal>[{NASALS}])|(?P<sign>[{SIGNS}])|(?P<letter>[^{ADDAK}{VIRAMA}{NASALS}{SIGNS}])(?:(?P<vowel>[{SIGNS}])(?P<then>[{NASALS}])?|(?P<cut>{VIRAMA}))?", re.DOTALL)


def display_ipa(word: str | None, final_schwa: bool = False) -> str | None:
    """Display IPA of a word: letters with their signs, an inherent schwa where none follows, doubling after addak,
    nasals by the place of what follows. One final schwa is dropped unless final_schwa."""
    if word is None:
        return None
    out = []
    for m in _UNIT.finditer(word):
        after = word[m.end() : m.end() + 1]
        nasal = _NASAL.get(after, DENTAL)
        if m["addak"]:
            out.append(SOUNDS.get(after, ""))
        elif m["nasal"]:
            out.append(nasal)
        elif m["sign"]:
            out.append(SOUNDS[m["sign"]])
        elif m["letter"]:
            sound = SOUNDS.get(m["letter"], "")
            out.append(sound)
            if m["vowel"]:
                out.append(SOUNDS[m["vowel"]] + (nasal if m["then"] else ""))
            elif not m["cut"] and sound:
                out.append(SCHWA)
    ipa = "".join(out)
    return ipa.removesuffix(SCHWA) if not final_schwa else ipa


# IPA letters in plain Latin, and the digraphs that count as one sound, in order.
PLAIN = {"ə": "a", "ɾ": "r", "ɦ": "h", "ʊ": "u", "ɪ": "i", "ʰ": "h", "ʱ": "h", "ŋ": "n", "ɲ": "n", "ʃ": "sh"}
DIGRAPHS = [("tsh", "c"), ("sh", "s"), ("kh", "x"), ("ai", "e"), ("au", "o")]


def _base_letters() -> dict[str, str]:
    """ASCII letters by the composed letters that decompose to them, as Unicode has it."""
    return {chr(i): base for i in range(0x80, 0x3000) if (base := unicodedata.normalize("NFD", chr(i))[0]).isascii() and base.isalpha()}


def match_fold_sql(sound: str) -> str:
    """SQL: IPA or romanised text as bare ASCII letters, so that both spellings of a sound meet."""
    one = _base_letters() | {k: v for k, v in PLAIN.items() if len(v) == 1}
    folded = f"translate(lower(translate({sound}, '{''.join(one)}', '{''.join(one.values())}')), '{''.join(k for k in PLAIN if len(PLAIN[k]) == 1)}', '{''.join(v for v in PLAIN.values() if len(v) == 1)}')"
    for mark, plain in PLAIN.items():
        if len(plain) > 1:
            folded = f"replace({folded}, '{mark}', '{plain}')"
    folded = f"regexp_replace({folded}, '[^a-z]', '')"
    for pair, single in DIGRAPHS:
        folded = f"replace({folded}, '{pair}', '{single}')"
    return folded


# Devanagari in IAST and in SLP1.
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", zip("k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(), "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh", strict=True), strict=True))
_VOWELS = dict(zip("अआइईउऊऋॠऌएऐओऔ", zip("a ā i ī u ū ṛ ṝ ḷ e ai o au".split(), "aAiIuUfFxeEoO", strict=True), strict=True))
_VOWEL_SIGNS = dict(zip("ािीुूृॄॢेैोौ", zip("ā i ī u ū ṛ ṝ ḷ e ai o au".split(), "AiIuUfFxeEoO", strict=True), strict=True))
_OTHER = {"ं": ("ṃ", "M"), "ः": ("ḥ", "H"), "ँ": ("m̐", "~"), "ऽ": ("'", "'")}


def transliterate_devanagari(text: str | None, scheme: str = "iast") -> str | None:
    """Devanagari in IAST or SLP1; other characters stay."""
    if text is None:
        return None
    k, out = ("iast", "slp1").index(scheme), []
    for i, c in enumerate(text):
        after = text[i + 1 : i + 2]
        if c in _CONSONANTS:
            out.append(_CONSONANTS[c][k] + ("" if after in _VOWEL_SIGNS or after == "्" else "a"))
        elif c != "्":
            out.append(next((t[c][k] for t in (_VOWELS, _VOWEL_SIGNS, _OTHER) if c in t), c))
    return "".join(out)


def _mapped(function, column: Column | str) -> Column:
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(function)

    return F.pandas_udf(mapped, "string")(column)


def ipa_column(words: Column | str, final_schwa: bool = False) -> Column:
    return _mapped(lambda w: display_ipa(w, final_schwa), words)


def match_fold_column(texts: str) -> Column:
    """The fold of the column of that name."""
    return F.expr(match_fold_sql(f"`{texts}`"))


def devanagari_column(texts: Column | str, scheme: str = "iast") -> Column:
    return _mapped(lambda t: transliterate_devanagari(t, scheme), texts)


def over_distinct(df: DataFrame, column: str, function, out: str) -> DataFrame:
    """Adds out = function(column), computed once for each distinct value."""
    values = df.select(F.col(column).alias("value__")).distinct().withColumn(out, function("value__"))
    return df.join(values, df[column].eqNullSafe(F.col("value__")), "left").drop("value__")


def best_by_sound(results: DataFrame, key: list[str], target: str, roman: str = "roman", order: str = "ord") -> DataFrame:
    """Of each key's results the one whose romanisation sounds most like target; of equals the earlier; when none has a
    romanisation, the first. Comma-separated romanisations count by their nearest. Distances are between ASCII folds."""
    from pyspark.sql import Window

    parts = results.withColumn("part__", F.explode_outer(F.split(roman, ",")))
    folded = parts.withColumn("distance__", F.levenshtein(match_fold_column("part__"), match_fold_column(target)))
    nearest = folded.groupBy(*results.columns).agg(F.min("distance__").alias("distance__"))
    ranked = nearest.withColumn("rank__", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("distance__").asc_nulls_last(), order)))
    return ranked.filter("rank__ = 1").drop("rank__", "distance__")
