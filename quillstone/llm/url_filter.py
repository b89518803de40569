"""URL filter: rules on hosts and paths, then a weighted vocabulary.

The vocabulary's terms are found in one pass by an Aho-Corasick automaton over
the lower-cased url; a term counts only between characters that are neither
letters nor digits. Each term has a weight; a url is blocked if its distinct
terms reach LIMIT together. A strict term has that weight alone, a soft one a
part of it. The vocabulary is a parameter, and may be read from a table.

Defined results: a null url, or one without `://`, has an empty host and path,
fits no rule, and is judged by its terms (a null url has none: allow). Of rules
that are equally long the first by name holds. Very long urls are judged whole.
Each row gives one row, repeated rows and null ids included; an empty table
gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import lean, pieces

#: (host, path, verdict); the longest that fits holds.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "spam", "warez", "escort", "escorts", "hentai", "camgirls", "keygen", "crackz", "phishing")
SOFT = ("cheap", "pills", "free", "bet", "bets", "betting", "win", "winner", "ads", "track", "farm", "deal", "deals", "loan", "loans", "adult", "click", "clicks", "poker", "slots", "jackpot", "pharma", "pharmacy", "sex", "nude", "dating", "replica", "discount", "torrent", "torrents", "payday", "bonus")
#: Distinct soft terms that block.
SOFT_HITS = 2
#: The weight at which a url is blocked.
LIMIT = 1.0
#: Weights by term: a strict term blocks alone, SOFT_HITS soft ones together.
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, LIMIT / SOFT_HITS)}
#: Terms of a vocabulary that are sent to the tasks at most.
MOST_TERMS = 1_000_000


def vocabulary(terms: DataFrame) -> dict[str, float]:
    """Weights from a table (term, weight) of at most MOST_TERMS rows; terms in lower case, of equal ones the heaviest."""
    rows = terms.where("term is not null and term <> '' and weight is not null").groupBy(F.lower("term").alias("term")).agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r["term"]: float(r["weight"]) for r in rows}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as text, or null."""
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in rules]
    ordered = sorted(zip(rules, fits, strict=True), key=lambda x: (-len(x[0][0] + x[0][1]), x[0][:2]))
    return reduce(lambda case, x: case.when(x[1], F.lit(x[0][0] + x[0][1])), ordered[1:], F.when(ordered[0][1], F.lit("".join(ordered[0][0][:2])))) if ordered else F.lit(None).cast("string")


def terms_in(automaton, url: str) -> dict[str, float]:
    """The distinct terms of a lower-cased url, with their weights."""
    found: dict[str, float] = {}
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if not (start and url[start - 1].isalnum()) and not (end + 1 < len(url) and url[end + 1].isalnum()):
            found[term] = weight
    return found


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, weights: Mapping[str, float] = VOCABULARY) -> DataFrame:
    """page_id, host, path, rule, verdict, the numbers of distinct strict and soft terms, and their weight."""
    kind = pages.schema["page_id"].dataType.simpleString()
    weights = dict(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        for b in lean(batches):
            for at, urls in pieces(b.column(4)):
                hits = [terms_in(automaton, u.lower()) if u and len(automaton) else {} for u in urls.to_pylist()]
                strict = pa.array([sum(w >= LIMIT for w in h.values()) for h in hits], pa.int64())
                soft = pa.array([sum(w < LIMIT for w in h.values()) for h in hits], pa.int64())
                weight = pa.array([math.fsum(h.values()) for h in hits], pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(urls)) for c in b.columns[:4]), strict, soft, weight], ["page_id", "host", "path", "rule", "n_strict", "n_soft", "weight"])

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"), "url").select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "url")
    found = found.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, n_strict long, n_soft long, weight double")
    by_rule = reduce(lambda case, r: case.when(F.col("rule") == r[0] + r[1], r[2]), rules, F.when(F.lit(False), ""))
    by_terms = F.when(F.col("weight") >= LIMIT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_terms).alias("verdict"), "n_strict", "n_soft", "weight")
