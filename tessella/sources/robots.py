"""robots.txt: groups of rules by agent, and what they allow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from tessella.functions import urls

RULES = "array<struct<agent: string, allow: boolean, pattern: string, ordinal: int, crawl_delay: double, request_rate: double>>"


def parse(text: str | None) -> list[tuple]:
    """(agent, allow, pattern, ordinal, crawl_delay, request_rate) for each agent and rule; pattern is null in rows of politeness."""
    out: list[tuple] = []
    agents: list[str] = []
    open_ = False
    for n, line in enumerate((text or "").lstrip("﻿").splitlines()):
        name, sep, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name == "user-agent":
            if not open_:
                agents = []
            agents.append(value.lower())
            open_ = True
        elif name in ("allow", "disallow", "crawl-delay", "request-rate"):
            open_ = False
            for agent in agents:
                if name in ("allow", "disallow"):
                    if value:
                        out.append((agent, name == "allow", value, n, None, None))
                elif name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                    out.append((agent, None, None, n, float(value), None))
                elif name == "request-rate" and (m := re.fullmatch(r"(\d+)\s*/\s*(\d+)\s*[smh]?", value)) and int(m[1]):
                    out.append((agent, None, None, n, None, int(m[2]) / int(m[1])))
    return out


def rules(spark: SparkSession, text: str) -> DataFrame:
    """The rules of one file (small: search engines read its first 500 KiB) as rows."""
    return spark.createDataFrame(parse(text[: 512 << 10]), "agent string, allow boolean, pattern string, ordinal int, crawl_delay double, request_rate double")


def rules_of_sites(robots: DataFrame) -> DataFrame:
    """site, rules from site, body: many sites' files at once."""
    return robots.select("site", F.explode(udf(lambda t: parse(t[: 512 << 10]) if t else [], RULES)("body")).alias("r")).select("site", "r.*")


def regex_of(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: `*` is anything, `$` at the end is the end, all else is itself."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def for_agent(all_rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the groups that name the agent most exactly, all of them together; else those for everybody."""
    a = agent.lower()
    named = all_rules.where((F.col("agent") != "*") & F.lit(a).startswith(F.col("agent")))
    best = named.agg(F.max(F.length("agent")).alias("n"))
    own = named.crossJoin(F.broadcast(best)).where(F.length("agent") == F.col("n")).drop("n")
    every = all_rules.where("agent = '*'").crossJoin(F.broadcast(best)).where("n is null").drop("n")
    return own.unionByName(every)


def allowed(pages: DataFrame, agent_rules: DataFrame, url: str = "url") -> DataFrame:
    """The pages with `allowed`: the longest rule that fits decides, Allow on a tie; none allows.  The rules of one file are sent to all tasks."""
    u = F.col(url)
    path = F.concat(F.when(urls.path(u) == "", "/").otherwise(urls.path(u)), F.when(urls.query(u) != "", F.concat(F.lit("?"), urls.query(u))).otherwise(""))
    listed = agent_rules.where("pattern is not null").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", regex_of(F.col("pattern")).alias("regex"))).alias("rules"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.rlike(F.col("match_path"), r["regex"])), lambda r: F.struct(r["n"], r["allow"])))
    return pages.withColumn("match_path", path).crossJoin(F.broadcast(listed)).withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "match_path")


def delay(agent_rules: DataFrame) -> DataFrame:
    """One row: the seconds to wait between requests, the greater of both ways to say it."""
    return agent_rules.agg(F.greatest(F.max("crawl_delay"), F.max("request_rate")).alias("delay"))


#: Crawlers that gather for language models.
AI_AGENTS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "Google-Extended", "PerplexityBot", "anthropic-ai", "CCBot", "Bytespider", "Amazonbot", "Applebot-Extended", "Meta-ExternalAgent", "cohere-ai")


def ai_access(spark: SparkSession, text: str) -> DataFrame:
    """agent, allowed (the root), named (whether a group names it)."""
    found = parse(text)
    site = spark.createDataFrame([("https://site/",)], "url string")
    named = {a for a, *_ in found}
    out = None
    for agent in AI_AGENTS:
        one = allowed(site, for_agent(rules(spark, text), agent)).select(F.lit(agent).alias("agent"), "allowed", F.lit(agent.lower() in named).alias("named"))
        out = one if out is None else out.unionByName(one)
    return out
