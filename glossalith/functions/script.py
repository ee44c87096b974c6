"""Scripts as data, and the column functions that depend on one: tokens, search folds, stems, numerals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the corpus' producers count it, and the six Gurmukhi letters that decompose.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
DECOMPOSED = {
    "\u0a33": "\u0a32\u0a3c",
    "\u0a36": "\u0a38\u0a3c",
    "\u0a59": "\u0a16\u0a3c",
    "\u0a5a": "\u0a17\u0a3c",
    "\u0a5b": "\u0a1c\u0a3c",
    "\u0a5e": "\u0a2b\u0a3c",
}


@dataclass(frozen=True)
class Script:
    """What the operators need to know of a script. Classes are the inside of a regex's brackets."""

    letters: str
    edges: str
    matras: str = ""
    marks: str = ""
    digits: str = "0123456789"
    block: str = ""
    fold_drop: str = ""
    fold_from: str = ""
    fold_to: str = ""
    fold_final: str = ""
    group_tail: str = ""


# Fixed values of Gurmukhi: vowel signs, trailing marks, and the spelling variants that one search key unites.
GURMUKHI = Script(
    letters=r"\x{0A05}-\x{0A39}\x{0A3E}-\x{0A4C}\x{0A74}",
    edges=r"\x{0964}\x{0965}|~",
    matras=r"\x{0A3E}\x{0A3F}\x{0A40}\x{0A41}\x{0A42}\x{0A47}\x{0A48}\x{0A4B}\x{0A4C}",
    marks=r"\x{0A02}\x{0A70}\x{0A71}\x{0A3C}\x{0A4D}",
    digits="੦੧੨੩੪੫੬੭੮੯",
    block=r"\x{0A00}-\x{0A7F}",
    fold_drop=r"\x{0A3C}\x{0A71}\x{0A03}\x{0A51}\x{0A75}\x{200C}\x{200D}",
    fold_from="ਟਠਡਢਣੜੀੂੈੌਈਊਐਔਂਁ",
    fold_to="ਤਥਦਧਨਰਿੁੇੋਇਉਏਓੰੰ",
    fold_final=r"\x{0A41}\x{0A3F}",
    # the stem groups' own class: some vowel signs and marks, and letters that a decomposed nukta leaves behind
    group_tail=r"\x{0A3E}\x{0A3F}\x{0A40}\x{0A41}\x{0A02}\x{0A70}\x{0A3C}\x{0A15}\x{0A16}\x{0A17}\x{0A1C}\x{0A21}\x{0A22}\x{0A2B}",
)
LATIN = Script(letters=r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}", edges=r".,;:!?\"'()|~")


def tokenize(text: Column, script: Script = GURMUKHI) -> Column:
    """Tokens of a text: runs of anything but white space, edge marks stripped, those without a letter of the script left
    out. One pass finds each run from its first to its last character that is no edge mark; null gives null."""
    core = f"[^{SPACE}{script.edges}]"
    return F.filter(F.regexp_extract_all(text, F.lit(f"{core}(?:[^{SPACE}]*{core})?"), F.lit(0)), lambda t: t.rlike(rf"[{script.letters}]"))


def nfd(text: Column) -> Column:
    """Canonical decomposition within the Gurmukhi block."""
    for whole, parts in DECOMPOSED.items():
        text = F.replace(text, F.lit(whole), F.lit(parts))
    return text


def fold_key(text: Column, script: Script = GURMUKHI) -> Column:
    """Lossy search key: spelling variants meet. Text of other scripts folds to the empty string.

    Long vowels become short before the final short vowel is dropped, so final long ones go as well.
    """
    kept = F.regexp_replace(F.regexp_replace(nfd(text), rf"[{script.fold_drop}]", ""), rf"[^{script.block} ]", "")
    return F.regexp_replace(F.translate(F.trim(kept), script.fold_from, script.fold_to), rf"[{script.fold_final}]$", "")


def final_vowel(form: Column, script: Script = GURMUKHI) -> Column:
    """The vowel sign that ends a form, past trailing marks; null for a bare form."""
    return F.nullif(F.regexp_extract(_trimmed(form), rf"([{script.matras}])[{script.marks}]*$", 1), F.lit(""))


def stem(form: Column, script: Script = GURMUKHI) -> Column:
    """The form without its trailing marks and then at most one vowel sign."""
    return F.regexp_replace(F.regexp_replace(_trimmed(form), rf"[{script.marks}]+$", ""), rf"[{script.matras}]$", "")


def group_stem(form: Column, script: Script = GURMUKHI) -> Column:
    """The stem of the stem groups: any run of their own class of trailing characters goes. Not stem()."""
    return F.regexp_replace(form, rf"[{script.group_tail}]+$", "")


def _trimmed(form: Column) -> Column:
    return F.regexp_replace(form, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def to_int(text: Column, script: Script = GURMUKHI) -> Column:
    """A numeral in the script's or ASCII digits as an integer; anything else is null."""
    ascii_ = F.translate(text, script.digits, "0123456789")
    return F.when(ascii_.rlike("^[0-9]+$"), ascii_.try_cast("int"))
