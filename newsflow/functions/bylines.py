"""Bylines to author names.

One entry's bylines go in as an array and its authors come out as an array, inside one row: no shuffle, no
Python worker. The helpers below return SQL text (see ``fragments``). Candidate lists are arrays, guards are ``forall``/``exists``, "first wins" is an
``array_position`` test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.fragments import group, in_list, let, lit, matches, non_empty, over, sub, when
from newsflow.functions.identity import identity_key, word_key_sql
from newsflow.functions.text import WHITE_SPACE, WHITE_SPACE_CLASS

# ---- fixed values: patterns and word lists (Java syntax; i = ignore case, U = Unicode classes) -----
ROLE = (
    r"(?:correspondance|correspondant(?:e)?|correspondent|special correspondent"
    r"|envoy(?:e|é)e?\s+sp(?:e|é)cial(?:e)?)"
)
PLACE = r"(?:in|at|a|à|au|aux|en|dans|depuis|sur)"
GAP = r"(?:\s*[,/-]\s*|\s+)"

SEPARATOR_PHRASE = r"(?iU)\b(?:edited by|executive producers? are|executive producer is)\b"
LIST_SPLIT = r"(?U)\s*[;,]\s*"
CONJUNCTION_SPLIT = r"(?iU)\s*(?:&|\band\b|\bet\b)\s*"
LEADING_PREFIX = (
    r"(?iU)^(?:(?:de notre|notre|propos recueillis par|recueilli(?:e|es|s)? par|reported by"
    r"|text(?:\s+by)?|texte(?:\s+de)?)\s+)+"
)
LEADING_BYLINE = r"(?iU)^(?:(?:par|by)\s+)+"
PARENTHESES = r"(?U)\s*\([^()]*\)"
LEADING_WITH = r"(?iU)^(?:avec|with)\s+(.+)\z"
TRAILING_WITH = r"(?iU)^(.+?)\s+(?:avec|with)\s+(.+)\z"
ROLE_LABEL = rf"(?iU)^{ROLE}\b"
ROLE_LOCATION = rf"(?iU)^{ROLE}\s+{PLACE}\s+.+\z"
TRAILING_ROLE = rf"(?iU)^(.+?){GAP}{ROLE}\b.*\z"
TRAILING_LOCATION = rf"(?iU)^(.+?){GAP}{PLACE}\s+.+\z"
EDITORIAL_LABEL = (
    r"(?iU)^(?:a|an|the|un|une|le|la|les)\s+.+\b(?:reporter|editor|staff|team|desk|bureau|newsroom"
    r"|redaction|rédaction|editorial)\b.*\z"
)
DOMAIN = (
    r"(?iU)(?:^|[\s(])(?:www\.)?[a-z0-9-]+\.(?:com|fr|org|net|io|co|info|tv|fm|be|ch|de|uk|eu)(?:\z|[\s)])"
)
NAME_WORD = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-'’][A-Za-zÀ-ÖØ-öø-ÿ]+)*\z"
INITIALS = r"^(?:[A-Za-zÀ-ÖØ-öø-ÿ]\.)+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]\.)*\z"

PREPOSITIONS = ["in", "at", "a", "au", "aux", "en", "dans", "depuis", "sur"]
CUTOFFS = [
    *PREPOSITIONS,
    "aumonier", "aumoniere", "diocese", "editor", "editors", "edited", "executive", "producer", "producers", "reporter",
    "regional", "regionale", "special", "speciale", "speciales", "specialiste", "correspondance", "correspondant",
    "correspondante", "hospital", "hopital", "bureau",
]
PARTICLES = ["de", "du", "des", "del", "della", "di", "da", "van", "von", "bin", "ibn", "al", "la", "le"]
# -------------------------------------------------------------------------------------------------


_WORDS = tuple(dict.fromkeys([*CUTOFFS, *PARTICLES, "text"]))
_NONE = "CAST(array() AS array<string>)"


def _key(c: str) -> str:
    return word_key_sql(c, _WORDS)


def _trim(c: str) -> str:
    return f"btrim({c}, {lit(WHITE_SPACE)})"


def display_name(c: str) -> str:
    """Trim, drop surrounding double then single quotes, collapse whitespace; NULL when nothing is left."""
    bare = f"""btrim(btrim({_trim(c)}, '"'), "'")"""
    runs = f"{WHITE_SPACE_CLASS}{{2,}}|[{WHITE_SPACE_CLASS}&&[^ ]]"
    return let(bare, lambda t: when(f"{t} != ''", f"btrim({sub(t, runs, ' ')})"))


def is_role(c: str) -> str:
    return matches(c, ROLE_LABEL)


def is_discardable(c: str) -> str:
    """Text that names nobody: a label, a bare role, a web domain or a place fragment."""
    place = let(
        f"split({c}, ' ', 2)[0]",
        lambda t: f"({t} = lower({t}) AND coalesce({in_list(_key(t), PREPOSITIONS)}, false))",
    )
    return (
        f"(coalesce({_key(c)} = 'text', false) OR ({is_role(c)} AND NOT {matches(c, ROLE_LOCATION)})"
        f" OR {matches(c, EDITORIAL_LABEL)} OR {matches(c, DOMAIN)} OR (contains({c}, ' ') AND {place}))"
    )


def is_standalone(c: str) -> str:
    """Two or more words, or one short upper-case word such as an agency name."""
    compact = f"length({sub(c, '[^A-Za-z0-9]+', '')}) BETWEEN 1 AND 10"
    lower = matches(c, r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")
    return f"(NOT {is_discardable(c)} AND (contains({c}, ' ') OR ({compact} AND NOT {lower})))"


def is_named(c: str) -> str:
    return f"(NOT {is_role(c)} AND {is_standalone(c)})"


def _prefer(found: str, fallback: str, test: Callable[[str], str]) -> str:
    """display_name(found) when it exists and passes the test, else the fallback."""
    return let(display_name(found), lambda t: when(f"{t} IS NOT NULL AND {test(t)}", t, fallback))


def _without_parentheses(c: str) -> str:
    """Remove bracketed parts from the inside out; a text with n opening brackets needs at most n rounds."""
    rounds = f"sequence(1, size(split({c}, {lit('[(]')})) - 1)"
    peeled = f"aggregate({rounds}, {c}, (t, n) -> {sub('t', PARENTHESES, '')})"
    return display_name(when(f"contains({c}, '(')", peeled, c))


def _drop_with(c: str) -> str:
    def keep(t: str) -> str:
        return f"NOT {is_discardable(t)}"

    right = _prefer(group(c, TRAILING_WITH, 2), c, keep)
    return when(matches(c, TRAILING_WITH), _prefer(group(c, TRAILING_WITH, 1), right, keep), c)


def _drop_role(c: str) -> str:
    return when(matches(c, TRAILING_ROLE), _prefer(group(c, TRAILING_ROLE, 1), c, is_named), c)


def _drop_location(c: str) -> str:
    located = f"NOT {is_role(c)} AND {matches(c, TRAILING_LOCATION)}"
    return when(located, _prefer(group(c, TRAILING_LOCATION, 1), c, is_named), c)


def _cut_descriptor(c: str) -> str:
    """Keep only the name words at the start when a descriptor word stands behind the first word."""
    listed = in_list("k", CUTOFFS)
    keys = over("filter", over("transform", f"split({c}, ' ')", _key), lambda k: f"{k} IS NOT NULL")
    cue = let(keys, lambda ks: f"exists(slice({ks}, 2, size({ks})), k -> {listed})")
    return when(f"NOT {is_role(c)} AND {cue}", f"coalesce({_leading_name(c)}, {c})", c)


def _leading_name(c: str) -> str:
    """The name words at the start, up to the first descriptor; NULL when there are none."""
    trimmed = over("transform", f"split({c}, ' ')", lambda w: f"btrim({w}, ',;:/')")
    words = over("filter", trimmed, lambda w: f"{w} != ''")
    tokens = over("transform", words, lambda w: f"struct({w} AS w, {_key(w)} AS k)")

    def ends(t: str, i: str) -> str:
        name_like = f"({matches(f'{t}.w', INITIALS)} OR {matches(f'{t}.w', NAME_WORD)})"
        fits = f"(({in_list(f'{t}.k', PARTICLES)} AND {i} > 0) OR {name_like})"
        return f"({t}.k IS NULL OR {in_list(f'{t}.k', CUTOFFS)} OR NOT {fits})"

    def head(ts: str) -> str:
        stop = f"array_position({over('transform', ts, ends, indexed=True)}, true)"
        return let(stop, lambda p: when(f"{p} = 0", ts, f"slice({ts}, 1, CAST(greatest({p} - 1, 0) AS INT))"))

    def without_tail(ts: str) -> str:
        flags = over("transform", ts, lambda t: in_list(f"{t}.k", PARTICLES))
        last = f"array_position(reverse({flags}), false)"
        return let(last, lambda p: when(f"{p} > 0", f"slice({ts}, 1, CAST(size({ts}) - {p} + 1 AS INT))"))

    kept = let(let(tokens, head), without_tail)
    return display_name(f"array_join({over('transform', kept, lambda t: f'{t}.w')}, ' ')")


# A candidate becomes a name by passing these in order; NULL means it names nobody.
CLEANING: list[Callable[[str], str]] = [
    display_name,
    lambda t: display_name(sub(t, LEADING_PREFIX, "")),
    lambda t: display_name(sub(t, LEADING_BYLINE, "")),
    _without_parentheses,
    lambda t: _trim(sub(t, LEADING_WITH, "$1")),
    _drop_with,
    _drop_role,
    _drop_location,
    _cut_descriptor,
    display_name,
    lambda t: when(f"NOT {is_discardable(t)}", t),
]


def candidate_options(bylines: str) -> str:
    """Bylines -> [{line, options}]: per listed part itself and, behind it, its parts around "and"/"et"/"&"."""

    def parts(byline: str) -> str:
        prepared = sub(non_empty(_trim(byline)), SEPARATOR_PHRASE, " ; ")
        named = over("transform", f"coalesce(split({prepared}, {lit(LIST_SPLIT)}), {_NONE})", display_name)
        return over("filter", named, lambda p: f"{p} IS NOT NULL")

    def options(part: str) -> str:
        around = over("transform", f"split({part}, {lit(CONJUNCTION_SPLIT)})", display_name)
        several = f"concat(array({part}), {over('filter', around, lambda p: f'{p} IS NOT NULL')})"
        return when(matches(part, CONJUNCTION_SPLIT), several, f"array({part})")

    def line(byline: str, i: str) -> str:
        return over("transform", parts(byline), lambda p: f"struct({i} AS line, {options(p)} AS options)")

    return f"flatten({over('transform', f'coalesce({bylines}, {_NONE})', line, indexed=True)})"


def over_options(step: Callable[[str], str], c: str) -> str:
    return over(
        "transform", c, lambda x: f"struct({x}.line AS line, {over('transform', f'{x}.options', step)} AS options)"
    )


def choose_options(cleaned: str) -> str:
    """Take the conjunction parts when there are several and all can stand alone, else the whole part."""

    def chosen(options: str) -> str:
        around = f"slice({options}, 2, size({options}))"
        alone = over("forall", around, lambda p: f"coalesce({is_standalone(p)}, false)")
        return when(f"size({options}) > 2 AND {alone}", around, f"slice({options}, 1, 1)")

    def names(x: str) -> str:
        return over("transform", chosen(f"{x}.options"), lambda n: f"struct({x}.line AS line, {n} AS name)")

    return over("filter", f"flatten({over('transform', cleaned, names)})", lambda x: f"{x}.name IS NOT NULL")


def suppress_roles(named: str) -> str:
    """Drop a role label when a named candidate stands before it in the same byline."""

    def keep(x: str, i: str) -> str:
        shadow = over("exists", f"slice({named}, 1, {i})", lambda y: f"{y}.line = {x}.line AND NOT {is_role(f'{y}.name')}")
        return f"NOT {is_role(f'{x}.name')} OR NOT {shadow}"

    return over("transform", over("filter", named, keep, indexed=True), lambda x: f"{x}.name")


def clean_names(df: DataFrame, names: str) -> DataFrame:
    """Run the cleaning steps over an array<string> column; names that do not survive become NULL."""
    for step in CLEANING:
        df = df.withColumn(names, F.expr(over("transform", names, step)))
    return df


def with_candidates(df: DataFrame, bylines: str, out: str) -> DataFrame:
    """Candidates of an array of bylines after one cleaning pass and role suppression."""
    df = df.withColumn(out, F.expr(candidate_options(bylines)))
    for step in CLEANING:
        df = df.withColumn(out, F.expr(over_options(step, out)))
    return df.withColumn(out, F.expr(choose_options(out))).withColumn(out, F.expr(suppress_roles(out)))


def with_identity_dedup(df: DataFrame, names: str) -> DataFrame:
    """Keep the first spelling of every identity; NULL names and names without an identity are dropped."""
    keys = "__keys"
    df = df.withColumn(keys, F.transform(names, identity_key))
    kept = f"filter({names}, (n, i) -> coalesce(array_position({keys}, get({keys}, i)) = i + 1, false))"
    return df.withColumn(names, F.expr(kept)).drop(keys)


def with_authors(df: DataFrame, bylines: str, out: str = "authors") -> DataFrame:
    """Authors of every row from its array of bylines: cleaned twice, first spelling and order kept.

    Each step is its own projection only so that the analyser sees small expressions; the optimizer joins
    them again and no step shuffles.
    """
    return with_identity_dedup(clean_names(with_candidates(df, bylines, out), out), out)
