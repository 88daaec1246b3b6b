"""URL filter in DataFrame functions alone: rules are indexed by their rarest literal token, a URL's tokens fetch candidates, and only those run their regular expressions.

Two kinds of rules: domain rules (host and path prefix, the longest wins) and
pattern rules (regular expressions over the URL after ``://``). Each rule
names literal tokens that a matching URL must hold; it lies in the index under
the one that the fewest rules hold. The index is a constant array of buckets,
so a lookup costs the same for any number of rules and nothing is shuffled.

Null URLs and URLs without ``://`` have empty host and path, no rule, and the
verdict allow. Each row is judged by itself; only the key and the URL are read,
other columns (whatever their names) are not carried.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Verdict, host, path prefix
DOMAIN_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Verdict, name, regular expression over host, path and query, tokens that any match holds.
PATTERN_RULES = [
    ("block", "admin", r"/(?:wp-admin|wp-login\.php)(?:[/?#]|$)", ["wp"]),
    ("block", "login", r"/login(?:[/?#.]|$)", ["login"]),
    ("block", "cart", r"/cart/checkout(?:[/?#]|$)", ["cart", "checkout"]),
    ("block", "casino", r"(?:^|[./_-])casino(?:[./_-]|$)", ["casino"]),
    ("block", "poker", r"(?:^|[./_-])poker(?:[./_-]|$)", ["poker"]),
    ("block", "adult", r"(?:^|[./_-])xxx(?:[./_-]|$)", ["xxx"]),
    ("block", "torrent", r"(?:^|[./_-])torrent(?:[./_?-]|$)", ["torrent"]),
    ("block", "session", r"[?&]phpsessid=", ["phpsessid"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[^A-Za-z0-9]+"
INDEX = "array<array<struct<token:string,name:string,pattern:string,verdict:string,domain:boolean>>>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    domain: bool


def domain_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains. A token at the open end of the path may be cut, so it is no literal."""
    name = f"{host}{path}"
    tokens = [t for t in re.split(SEPARATORS, name) if t]
    if re.match(r"[A-Za-z0-9]", path[-1:]) and tokens:
        tokens = tokens[:-1]
    return Rule(verdict, name, f"^(?:[^/?#]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def rules(domains=DOMAIN_RULES, patterns=PATTERN_RULES) -> list[Rule]:
    return [domain_rule(*d) for d in domains] + [Rule(v, n, p, tuple(t), False) for v, n, p, t in patterns]


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def index(of: list[Rule]) -> tuple[Column, int]:
    """The constant index and its number of buckets. A rule without any literal is in bucket 0 under the empty token, which every URL has."""
    from zlib import crc32

    held = Counter(t for r in of for t in set(r.tokens))
    buckets = 2 * len(of) + 1
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for r in of:
        token = min(r.tokens, key=lambda t: (held[t], -len(t), t), default="")
        table[crc32(token.encode()) % buckets].append({"token": token, "name": r.name, "pattern": r.pattern, "verdict": r.verdict, "domain": r.domain})
    return F.from_json(F.lit(json.dumps(table)), INDEX), buckets


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all after ``://`` with that host."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", of: list[Rule] | None = None) -> DataFrame:
    """key, host, path, rule, verdict, and the pattern that blocked (null: none)."""
    table, buckets = index(rules() if of is None else of)
    host, path, whole = split_url(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"), whole.alias("whole"))
    tokens = F.array_union(F.split("whole", SEPARATORS), F.array(F.lit("")))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.element_at(table, bucket(t, buckets) + 1), lambda r: r["token"] == t)))
    # a domain rule sees host and path only
    fits = F.filter("fetched", lambda r: F.regexp_like(F.when(r["domain"], F.concat("host", "path")).otherwise(F.col("whole")), r["pattern"]))
    best = F.array_max(F.transform(F.filter("fits", lambda r: r["domain"]), lambda r: F.struct(F.length(r["name"]).alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    worst = F.array_min(F.transform(F.filter("fits", lambda r: ~r["domain"] & (r["verdict"] == "block")), lambda r: r["name"]))
    judged = parts.withColumn("fetched", fetched).withColumn("fits", fits).withColumn("best", best).withColumn("pattern", worst)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "pattern")


def oracle(domains=DOMAIN_RULES, patterns=PATTERN_RULES) -> str:
    """DuckDB SQL for the rows of ``judge_urls`` over pages."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [f"SELECT {quoted(h + p)} AS name, {quoted(v)} AS verdict, {quoted(h)} AS h, {quoted(p)} AS p" for v, h, p in domains]
    names = " ".join(f"WHEN regexp_matches(whole, {quoted(p)}) THEN {quoted(n)}" for _, n, p, _ in sorted(patterns, key=lambda x: x[1]))
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's') AS tail FROM cut),
whole AS (SELECT page_id, host, path, host || tail AS whole FROM parts),
rules AS ({" UNION ALL ".join(fits)}),
hosts AS (SELECT DISTINCT host, path FROM whole),
best AS (SELECT host, path, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM (SELECT page_id, w.host AS host, w.path AS path, rule, verdict, CASE {names} END AS pattern FROM whole w LEFT JOIN best b ON w.host = b.host AND w.path = b.path)"""
