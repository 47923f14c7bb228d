"""robots.txt as data: one row a rule, and a join that applies the longest one (RFC 9309)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "host string, allow boolean, pattern string"


def rules_of(body: str | None, agent: str = "*") -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups for an agent. Broken lines don't count; an empty disallow allows everything."""
    out, agents, in_rules = [], [], False
    for line in (body or "").splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            agents = [] if in_rules else agents
            agents.append(value.lower())
            in_rules = False
        elif key in ("allow", "disallow"):
            in_rules = True
            if agent.lower() in agents and value:
                out.append((key == "allow", value))
    return out


def regex_of(pattern: str) -> str:
    """A pattern's regular expression: * is any text, $ at its end the end."""
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in pattern.removesuffix("$").split("*"))
    return f"^{body}{'$' if end else ''}"


def parse_robots(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, allow, pattern from host, body. Hosts without rules give no row, which allows everything."""

    def run(batches):
        for b in batches:
            rows = [(h, a, p) for h, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for a, p in rules_of(body, agent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["host", "allow", "pattern"])

    return robots.select("host", "body").mapInArrow(run, RULES)


def _regex(pattern: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))


def allowed(urls: DataFrame, rules: DataFrame, host: str = "host", target: str = "target") -> DataFrame:
    """urls (host, and target: path with query) with a column allowed. A host's rules travel to its URLs as one array, so there
    is one join on the host and no row for each pair of URL and rule."""
    ordered = F.sort_array(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", _regex(F.col("pattern")).alias("re"))), asc=False)
    mine = rules.groupBy(F.col("host").alias("_host")).agg(ordered.alias("_rules"))
    # longest first, and of equally long ones those that allow
    first = F.try_element_at(F.filter("_rules", lambda r: F.regexp_like(F.col(target), r["re"])), F.lit(1))
    return urls.join(mine, F.col(host) == F.col("_host"), "left").withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_host", "_rules")
