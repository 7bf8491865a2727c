"""URL verdicts: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import rows, workers

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
STRICT = ["casino", "porn", "xxx", "viagra", "spam", "phishing", "warez"]
SOFT = ["ads", "bet", "bets", "bonus", "cheap", "deal", "farm", "free", "jackpot", "loan", "pills", "poker", "track", "win"]
#: Distinct soft terms that reject a url.
SOFT_HITS = 2


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _hits(strict: list[str], soft: list[str]):
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32())])

    def word(c: str) -> bool:
        return "a" <= c <= "z" or "0" <= c <= "9"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, terms in enumerate((strict, soft)):
            for t in terms:
                found.add_word(t, (kind, t))
        if len(found):
            found.make_automaton()
        for batch in batches:
            counts = ([], [])
            for url in batch.column("low").to_pylist():
                own = (set(), set())
                for end, (kind, term) in found.iter(url) if url and len(found) else ():
                    first = end + 1 - len(term)
                    if (first == 0 or not word(url[first - 1])) and (end + 1 == len(url) or not word(url[end + 1])):
                        own[kind].add(term)
                for k in (0, 1):
                    counts[k].append(len(own[k]))
            yield rows(schema, **{c: batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")}, strict_hits=counts[0], soft_hits=counts[1])
    return run


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the distinct strict and soft terms found.

    A term counts where no letter a-z or digit touches it. Without a fitting rule a url is blocked by one
    strict term or by ``soft_hits`` distinct soft ones. Null urls have empty host and path, no hits, and
    are allowed; rows with a null page_id and repeated rows each have a result; further columns are ignored.
    """
    workers(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), lower_ascii(url).alias("low"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hits = own.withColumns({"rule": name, "ruled": verdict}).mapInArrow(_hits(list(strict), list(soft)), "page_id long, host string, path string, rule string, ruled string, strict_hits int, soft_hits int")
    rejected = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_hits)
    return hits.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "strict_hits", "soft_hits")


def _any(terms: list[str]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, does) AS (VALUES {", ".join(map(str, RULES))}),
f AS (SELECT page_id, host, path, low, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(does, length(rhost || rpath)) AS does
  FROM (SELECT row_number() OVER () AS n, * FROM p) q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n, page_id, host, path, low),
h AS (SELECT *, {_any(STRICT)} AS strict_hits, {_any(SOFT)} AS soft_hits FROM f)
SELECT page_id, host, path, rule, coalesce(does, CASE WHEN strict_hits >= 1 OR soft_hits >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits FROM h
"""
