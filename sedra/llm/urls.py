"""URL filters as a sort-merge range join, by DataFrame functions only.

A host is turned into a canonical key: its labels reversed, each followed by a dot. A rule's host and all
its subdomains are then one interval of keys, from `net.example.` up to `net.example/`. Rules and URLs are
sorted together; the sweep carries the stack of the rules whose intervals are open. The stack changes only
where an interval begins or ends, so these events carry it, and a URL takes the last event's. Of the rules
on the stack whose path the URL's path begins with, the longest wins (host and path together; of equals,
the longer host).

URLs are dealt to partitions by a hash of their id and URL, and every partition gets all events: a host that
holds a third of the URLs is no hot key. The rules are a parameter; more than `max_rules` are refused, which
bounds what each partition receives.

A null URL and one without `://` have an empty host and path, and no rule. Repeated rows get a row each.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
DEFAULT = "allow"


def reversed_host(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def events(rules) -> list[dict]:
    """Where the stack of open rules changes: key, kind (0: an interval ends, 1: one begins) and the stack from there on."""
    hosts: dict[str, list[Rule]] = {}
    for r in rules:
        hosts.setdefault(reversed_host(r.host), []).append(r)
    out: list[dict] = []
    open_: list[str] = []
    ends = lambda key: key[:-1] + "/"

    def stack():
        return [{"host": r.host, "path": r.path, "rule": r.name, "verdict": r.verdict} for key in open_ for r in hosts[key]]

    def close(until):
        while open_ and (until is None or not until.startswith(open_[-1])):
            end = ends(open_.pop())
            out.append({"key": end, "kind": 0, "stack": stack()})

    for key in sorted(hosts, key=lambda k: k.encode()):
        close(key)
        open_.append(key)
        out.append({"key": key, "kind": 1, "stack": stack()})
    close(None)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # in lower case (A-Z only), and from there up to ? or #."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = DEFAULT, max_rules: int = 100_000) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages."""
    rules = tuple(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; every partition receives them all, and {max_rules} are the most")
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(id_col, url_col), F.lit(n)).alias("part"))
    labels = F.reverse(F.split("host", r"\."))
    rows = rows.withColumn("key", F.concat(F.array_join(labels, "."), F.lit("."))).withColumn("kind", F.lit(2))
    entry = "array<struct<host:string,path:string,rule:string,verdict:string>>"
    marks = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(events(rules))), f"array<struct<key:string,kind:int,stack:{entry}>>")).alias("e"))
    marks = marks.select("e.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
    both = rows.withColumn("stack", F.lit(None).cast(entry)).unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(r["host"]).alias("h"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
