"""Names of entities and predicates: normalisation, keywords, search patterns, type inference.

All are column expressions; a null gives a null or, where said, an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CLOSEST_PREDICATES, DEFAULT_PREDICATE, NAME_RULES, PREDICATE_KEYWORDS, STOP_WORDS, TYPE_KEYWORDS


#: White space of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.trim(x, F.lit(WHITE))


def blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def words(x: Column) -> Column:
    """Runs of anything but white space; none for a blank text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def first_of(rules: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    return F.coalesce(*(F.when(test, value) for test, value in rules))


def lookup(table: Mapping[str, str], key: Column) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(entries, key)


def normalize_entity_name(name: Column, rules: Mapping[str, str] = NAME_RULES, stop_words: Iterable[str] = tuple(STOP_WORDS)) -> Column:
    """The canonical name: an exact rule, else the first rule whose key is inside, else the name without stop words. Blank gives ''."""
    clean = F.translate(F.lower(strip(name)), "`–—", "'--")
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules.items()))
    any_rule = "|".join(re.escape(k) for k in rules)  # most names meet no rule: one test tells

    def canonical(x: Column) -> Column:
        inside = F.try_element_at(F.filter(table, lambda r: F.contains(x, r["k"])), F.lit(1))["v"]
        left = F.array_join(F.filter(words(x), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words)), " ")
        return F.when(x == "", "").when(x.rlike(any_rule), F.coalesce(lookup(rules, x), inside)).otherwise(F.coalesce(F.nullif(left, F.lit("")), x))

    # the cleaned name is made once, as the entry of an array, and not once for each use
    return F.coalesce(F.element_at(F.transform(F.array(clean), canonical), 1), F.lit(""))


def normalize_names(names: Column, rules: Mapping[str, str] = NAME_RULES) -> Column:
    """The list form: (nome_originale, nome_normalizzato) of every name in order, without those that normalise to nothing."""
    pairs = F.transform(names, lambda n: F.struct(n.alias("nome_originale"), normalize_entity_name(n, rules).alias("nome_normalizzato")))
    return F.filter(pairs, lambda p: p["nome_normalizzato"] != "")


def search_terms(terms: Column, names: Column) -> Column:
    """Search terms and entity names as one list: lower case, each once, without empty ones; a null list counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(terms, none), F.coalesce(names, none)), F.lower), lambda t: t != ""))


def collapse_name(name: Column) -> Column:
    """Lower case with single spaces: the plainer normaliser of the node and edge format."""
    return strip(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def keywords(text: Column, stop_words: Iterable[str] = tuple(STOP_WORDS)) -> Column:
    """Normalised words of more than two characters outside the stop words, each once, in first-seen order."""
    stops = F.array(*(F.lit(w) for w in stop_words))
    kept = F.filter(words(F.lower(text)), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))
    return F.coalesce(F.array_distinct(F.filter(F.transform(kept, lambda w: normalize_entity_name(w)), lambda w: w != "")), F.array().cast("array<string>"))


def search_patterns(name: Column, rules: Mapping[str, str] = NAME_RULES) -> Column:
    """The name, its canonical form, all keys with that form, and the form's longer words, each once."""
    canonical = normalize_entity_name(name, rules)
    variants = F.transform(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules.items())), lambda r: r["v"] == canonical), lambda r: r["k"])
    parts = F.filter(words(canonical), lambda w: F.length(w) > 2)
    every = F.concat(F.array(F.lower(name), canonical), variants, parts)
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != "")))


def safe_predicate(predicate: Column) -> Column:
    """A predicate as an identifier: spaces to underscores, no apostrophes, no accents."""
    return F.translate(predicate, " àèìòùÉ'", "_aeiouE")


def _by_keyword(text: Column, table: Mapping[str, Iterable[str]]) -> Column:
    low = F.lower(text)
    tests = []
    for value, keys in table.items():
        test = F.lit(False)
        for key in keys:
            test = test | F.contains(low, F.lit(key))
        tests.append((test, F.lit(value)))
    return first_of(tests)


def infer_entity_type(name: Column) -> Column:
    return F.coalesce(_by_keyword(name, TYPE_KEYWORDS), F.lit("Unknown"))


def infer_relation_type(predicate: Column) -> Column:
    return F.coalesce(_by_keyword(predicate, PREDICATE_KEYWORDS), predicate)


def closest_predicate(predicate: Column) -> Column:
    low = F.lower(predicate)
    return F.coalesce(first_of((F.contains(low, F.lit(k)), F.lit(v)) for k, v in CLOSEST_PREDICATES.items()), F.lit(DEFAULT_PREDICATE))


def section_name(title: Column, chunk_id: Column) -> Column:
    """The section's title, or a name made of the chunk's number."""
    suffix = F.try_element_at(F.split(chunk_id, "_"), F.lit(-1))
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.concat(F.lit("SezioneSconosciuta_"), suffix))
