"""The English stemmer (Porter2) as columns: suffixes go by the regions R1 and R2 of a word, with exception lists.

A step looks for the longest of its suffixes; only that one is judged.  What is left of a word is a struct of
the word and the places where its regions begin, which do not move.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the rules are not for: whole stems, and words that stay once a plural is off. Fixed values.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
              "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings that R1 follows. Fixed values.
BEGINNINGS = "^(gener|commun|arsen)"
#: A vowel run and the consonant that ends it; a short syllable at the end. y after a vowel or in front is written Y.
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
#: Steps: rules of suffixes, region (0: the word), what the stem before must match ('!': must not), what comes instead. Fixed values.
PLURALS = (("sses", 0, "", "ss"), ("ied ies", 0, "..", "i"), ("ied ies", 0, "", "ie"), ("us ss", 9, "", ""), ("s", 0, "[aeiouy].", ""))
ENDINGS = (("eed eedly", 1, "", "ee"), ("ed edly ing ingly", 0, "[aeiouy]", ""))
AFTER_ENDINGS = (("at", 0, "", "ate"), ("bl", 0, "", "ble"), ("iz", 0, "", "ize"), *((c + c, 0, "", c) for c in "bdfgmnprt"))
LAST_Y = (("y", 0, ".[^aeiouy]$", "i"),)
DERIVED = (("tional", 1, "", "tion"), ("enci", 1, "", "ence"), ("anci", 1, "", "ance"), ("abli", 1, "", "able"), ("entli", 1, "", "ent"), ("izer ization", 1, "", "ize"), ("ational ation ator", 1, "", "ate"),
           ("alism aliti alli", 1, "", "al"), ("fulness fulli", 1, "", "ful"), ("ousli ousness", 1, "", "ous"), ("iveness iviti", 1, "", "ive"), ("biliti bli", 1, "", "ble"), ("ogi", 1, "l$", "og"), ("lessli", 1, "", "less"), ("li", 1, "[cdeghkmnrt]$", ""))
DERIVED_TWICE = (("tional", 1, "", "tion"), ("ational", 1, "", "ate"), ("alize", 1, "", "al"), ("icate iciti ical", 1, "", "ic"), ("ful ness", 1, "", ""), ("ative", 2, "", ""))
BARE = (("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", 2, "", ""), ("ion", 2, "[st]$", ""))
LAST = (("e", 2, "", ""), ("e", 1, "!" + SHORT, ""), ("l", 2, "l$", ""))


def by_suffix(rules: Iterable[tuple]) -> list[tuple[str, list[tuple]]]:
    """(suffix, its rules (region, stem, instead) in order), the longest suffix first."""
    each = [(suffix, rule) for suffixes, *rule in rules for suffix in suffixes.split()]
    each.sort(key=lambda r: (-len(r[0]), r[0]))
    return [(suffix, [tuple(r[1]) for r in same]) for suffix, same in groupby(each, key=lambda r: r[0])]


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _step(word: str, state: str, rules: tuple) -> str:
    arms = []
    for suffix, ways in by_suffix(rules):
        size = f"length({word}) - {len(suffix)}"
        before = f"substring({word}, 1, {size})"
        inner = ""
        for region, pattern, instead in ways:
            held = {0: "true", 1: f"{size} >= {state}.r1", 2: f"{size} >= {state}.r2", 9: "false"}[region]
            if pattern:
                held += f" AND {'NOT ' if pattern[0] == '!' else ''}{before} RLIKE '{pattern.lstrip('!')}'"
            inner += f" WHEN {held} THEN {before} || '{instead}'"
        arms.append(f"WHEN endswith({word}, '{suffix}') THEN CASE{inner} ELSE {word} END")
    return f"CASE {' '.join(arms)} ELSE {word} END"


def _region(text: str) -> str:
    return f"CASE WHEN {text} RLIKE '{REGION}' THEN length(regexp_extract({text}, '{REGION}', 0)) ELSE length({text}) END"


def _state(word: str, r1: str, r2: str) -> str:
    return f"named_struct('w', {word}, 'r1', {r1}, 'r2', {r2})"


def _then(state: str, rules: tuple) -> str:
    return _let(state, "s", _state(_step("s.w", "s", rules), "s.r1", "s.r2"))


def _without_ending(state: str) -> str:
    """The step of -ed and -ing, and what it leaves: a letter less where doubled, an e more where short."""
    mended = f"CASE WHEN m <> x THEN m WHEN length(x) <= s.r1 AND x RLIKE '{SHORT}' THEN x || 'e' ELSE x END"
    cut = f"CASE WHEN x = s.w OR s.w RLIKE 'eed(ly)?$' THEN x ELSE {_let(_step('x', 's', AFTER_ENDINGS), 'm', mended)} END"
    return _let(state, "s", _state(_let(_step("s.w", "s", ENDINGS), "x", cut), "s.r1", "s.r2"))


def english_stem(term: str) -> Column:
    """The stem of a column of lower-cased words; words of one or two letters stay, null stays null.

    Written as one SQL expression: column by column, building it would take the driver longer than running it."""
    marked = f"regexp_replace(regexp_replace({term}, '^y', 'Y'), '([aeiouy])y', '$1Y')"
    first = _let(marked, "w", _state("w", f"CASE WHEN w RLIKE '{BEGINNINGS}' THEN length(regexp_extract(w, '{BEGINNINGS}', 0)) ELSE {_region('w')} END", "0"))
    state = _let(first, "s", _state("s.w", "s.r1", "s.r1 + " + _let("substring(s.w, s.r1 + 1)", "t", _region("t"))))
    rest = _without_ending("p")
    for rules in (LAST_Y, DERIVED, DERIVED_TWICE, BARE, LAST):
        rest = _then(rest, rules)
    kept = ", ".join(f"'{w}'" for w in KEPT)
    stem = _let(_then(state, PLURALS), "p", f"CASE WHEN p.w IN ({kept}) THEN p.w ELSE translate({rest}.w, 'Y', 'y') END")
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())
    return F.expr(f"CASE WHEN length({term}) <= 2 THEN {term} ELSE CASE {term} {known} ELSE {stem} END END")
