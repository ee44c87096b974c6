"""Grammar statements in commentaries, as one SQL expression over the marks of a text: quoted words, lemmas, brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The script's range, grammatical terms (never headwords themselves), predicates, tags and reach.
GUR = "਀-੿"
TERMS = ("ਨਾਂਵ", "ਪੜਨਾਂਵ", "ਵਿਸ਼ੇਸ਼ਣ", "ਕਿਰਿਆ", "ਲਿੰਗ", "ਵਚਨ", "ਕਾਰਕ", "ਪੁਲਿੰਗ", "ਸ਼ਬਦ", "ਲਫ਼ਜ਼")
SINGULAR, PLURAL = r"ਇਕ[\s-]*ਵਚਨ", r"ਬਹੁ[\s-]*ਵਚਨ"
PREDICATES = [
    (r"ਇਸਤ੍ਰੀ[\s-]*ਲਿੰਗ", "gender", "feminine"),
    (r"ਪੁਲਿੰਗ", "gender", "masculine"),
    (SINGULAR, "number", "singular"),
    (PLURAL, "number", "plural"),
    (r"ਕਰਤਾ[\s]*ਕਾਰਕ", "gram_case", "direct"),
]
POS_TAGS = [("ਪੜਨਾਂਵ", "pronoun"), ("ਵਿਸ਼ੇਸ਼ਣ", "adjective"), ("ਨਾਂਵ", "noun")]
REACH = 28
QUOTES, DANDA, GENITIVE = "['‘’]", "।", rf"(?<![{GUR}])(?:ਦਾ|ਦੇ|ਦੀ)(?![{GUR}])"
#: Characters of context on each side of a statement.
CONTEXT = 8

FACT = "struct<headword: string, attribute: string, value: string, snippet: string>"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marks(text: str, pattern: str) -> str:
    """SQL: the matches of a pattern as array<struct<a, b, w>>, places from 0: running sums over the gaps between them."""
    hits, gaps = f"regexp_extract_all({text}, {literal(pattern)}, 0)", f"split({text}, {literal(pattern)}, -1)"
    nothing = "named_struct('at', 0, 'found', cast(array() AS array<struct<a: int, b: int, w: string>>))"
    met = "named_struct('a', s.at + length(x.`1`), 'b', s.at + length(x.`1`) + length(x.`0`), 'w', x.`0`)"
    step = f"if(x.`0` IS NULL, s, named_struct('at', {met}.b, 'found', concat(s.found, array({met}))))"
    return f"aggregate(arrays_zip({hits}, {gaps}), {nothing}, (s, x) -> {step}, s -> s.found)"


def _fact(word: str, attribute: str, value: str, start: str, end: str) -> str:
    first = f"greatest({start} - {CONTEXT}, 0)"
    snippet = f"regexp_replace(substring(e.text, {first} + 1, {end} + {CONTEXT} - {first}), '^\\\\s+|\\\\s+$', '')"
    return f"named_struct('headword', {word}, 'attribute', {attribute}, 'value', {value}, 'snippet', {snippet})"


def _nearest(found: str, mark: str) -> str:
    return f"array_max(filter({found}, y -> y.b <= {mark}.a))"


def grammar_facts_sql(body: str) -> str:
    """SQL: array of the facts that a commentary states outright, without repeats.

    A predicate speaks of the nearest quoted word that ends before it, if it is close, in the same sentence, no
    genitive stands between and the word isn't a term of grammar. Tags in brackets without a quote speak of the
    nearest `WORD =` before them, in the same sentence. The marks are found once and bound as e.
    """
    terms = f"array({', '.join(map(literal, TERMS))})"
    bound = f"array(named_struct('text', t, 'quoted', {marks('t', f'{QUOTES}[{GUR}]+{QUOTES}')}, 'lemmas', {marks('t', rf'[{GUR}]+\s*=')}, 'brackets', {marks('t', r'\([^)]*\)')}))"
    said = []
    for pattern, attribute, value in PREDICATES:
        paired = f"transform({marks('e.text', pattern)}, m -> named_struct('m', m, 'q', {_nearest('e.quoted', 'm')}))"
        word = "substring(p.q.w, 2, length(p.q.w) - 2)"
        holds = f"p.q IS NOT NULL AND NOT array_contains({terms}, {word}) AND p.m.a - p.q.b <= {REACH} AND NOT substring(e.text, p.q.b + 1, p.m.a - p.q.b) RLIKE {literal(f'{DANDA}|{GENITIVE}')}"
        said.append(f"transform(filter({paired}, p -> {holds}), p -> {_fact(word, literal(attribute), literal(value), 'p.q.a', 'p.m.b')})")
    paired = f"transform(e.brackets, m -> named_struct('m', m, 'q', {_nearest('e.lemmas', 'm')}))"
    word = f"regexp_extract(p.q.w, {literal(f'^[{GUR}]+')}, 0)"
    tag = lambda attribute, value: f"named_struct('attribute', {literal(attribute)}, 'value', {value})"
    number = [f"if(p.m.w RLIKE {literal(pattern)}, {tag('number', literal(value))}, NULL)" for pattern, value in ((SINGULAR, "singular"), (PLURAL, "plural"))]
    pos = f"CASE {' '.join(f'WHEN contains(p.m.w, {literal(w)}) THEN {literal(v)}' for w, v in POS_TAGS)} END"
    tags = f"filter(array({', '.join(number)}, {tag('pos', pos)}), g -> g.value IS NOT NULL)"
    holds = f"p.q IS NOT NULL AND NOT p.m.w RLIKE {literal(QUOTES)} AND NOT array_contains({terms}, {word}) AND NOT contains(substring(e.text, p.q.b + 1, p.m.a - p.q.b), '{DANDA}')"
    said.append(f"flatten(transform(filter({paired}, p -> {holds}), p -> transform({tags}, g -> {_fact(word, 'g.attribute', 'g.value', 'p.q.a', 'p.m.b')})))")
    every = f"flatten(transform(transform(array(coalesce({body}, '')), t -> {bound}[0]), e -> concat({', '.join(said)})))"
    key = "named_struct('h', x.headword, 'a', x.attribute, 'v', x.value)"
    keyed = f"array(named_struct('facts', f, 'keys', transform(f, x -> {key})))"
    first = f"transform(array({every}), f -> transform({keyed}, k -> filter(k.facts, (x, i) -> array_position(k.keys, {key}) = i + 1))[0])[0]"
    return f"cast({first} AS array<{FACT}>)"


def grammar_facts_column(bodies: str) -> Column:
    """The facts of the commentaries in the column of that name."""
    return F.expr(grammar_facts_sql(f"`{bodies}`"))
