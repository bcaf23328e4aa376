"""Search and extraction over stored documents by declared specifications.

A specification that can't be read is an error before anything runs, never "nothing found".  Documents whose
fetch failed are in neither part of a share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.html import parse


def java_regex(pattern: str, case_sensitive: bool = False) -> str:
    """The pattern in the dialect of the engine, checked; words and spaces are Unicode's."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {pattern!r}: {e}") from None
    if re.search(r"\(\?P=|\(\?\(", pattern):
        raise ValueError(f"not supported here: {pattern!r}")
    return ("(?U)" if case_sensitive else "(?Uiu)") + re.sub(r"\(\?P<", "(?<", pattern)


@dataclass(frozen=True)
class Filter:
    """kind: contains, not_contains, regex or not_regex; scope: raw or text."""

    pattern: str
    kind: str = "contains"
    scope: str = "text"
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("contains", "not_contains", "regex", "not_regex") or self.scope not in ("raw", "text"):
            raise ValueError(f"unknown filter: {self.kind} in {self.scope}")
        if not self.pattern:
            raise ValueError("a filter needs a pattern")
        if "regex" in self.kind:
            java_regex(self.pattern)

    def hit(self) -> Column:
        body = F.coalesce(F.col("html" if self.scope == "raw" else "text"), F.lit(""))
        if "regex" in self.kind:
            return body.rlike(java_regex(self.pattern, self.case_sensitive))
        return body.contains(self.pattern) if self.case_sensitive else F.lower(body).contains(self.pattern.lower())


def run_filter(documents: DataFrame, spec: Filter) -> tuple[DataFrame, DataFrame]:
    """documents: url, ok, html, text.  The urls found; and one row: count, share (4 digits), considered, excluded."""
    fetched = documents.where(F.coalesce("ok", F.lit(False)))
    hits = fetched.where(spec.hit()).select("url").distinct()
    found = fetched.select("url").distinct().join(hits, "url", "left_anti") if spec.kind.startswith("not_") else hits
    counts = documents.agg(F.countDistinct(F.when(F.coalesce("ok", F.lit(False)), F.col("url"))).alias("considered"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("excluded"))
    one = found.agg(F.count(F.lit(1)).alias("count")).crossJoin(counts)
    return found, one.select("count", F.when(F.col("considered") > 0, F.bround(F.col("count") / F.col("considered"), 4)).alias("share"), "considered", "excluded")


def extract_regex(documents: DataFrame, name: str, pattern: str, group: int = 0, case_sensitive: bool = False) -> DataFrame:
    """url, name (an array of all matches), name_budget_exceeded (never: whole documents are read, without a limit)."""
    rx = java_regex(pattern, case_sensitive)
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rx), F.lit(group))
    return documents.where(F.coalesce("ok", F.lit(False))).select("url", found.alias(name), F.lit(False).alias(f"{name}_budget_exceeded"))


@dataclass(frozen=True)
class Rule:
    """kind: text, attribute, structured, presence or count; op: equals, contains, matches (with * and ?) or exists."""

    name: str
    kind: str
    target: str
    op: str = "exists"
    value: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("text", "attribute", "structured", "presence", "count") or self.op not in ("equals", "contains", "matches", "exists"):
            raise ValueError(f"unknown rule: {self.kind} {self.op}")

    def holds(self, value: Column) -> Column:
        if self.op == "exists":
            return value.isNotNull() & (value != "")
        if self.op == "equals":
            return value == self.value
        if self.op == "contains":
            return value.contains(self.value)
        return value.rlike(glob_regex(self.value))


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def run_rules(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """url, rule, found, value: over parsed pages; target: a parsed field, or for structured rules a path like $.name in their JSON-LD."""
    if len(rules) > 100:
        raise ValueError("over 100 rules")
    out = []
    for r in rules:
        if r.kind == "structured":
            value = F.filter(F.transform("jsonld", lambda j, r=r: F.get_json_object(j, r.target)), lambda v: v.isNotNull())[0]
        elif r.kind == "count":
            value = F.size(r.target).cast("string")
        else:
            value = F.col(r.target).cast("string")
        out.append(F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.holds(value), F.lit(False)).alias("found"), value.alias("value")))
    return parsed.select("url", F.explode(F.array(*out)).alias("r")).select("url", "r.*")


SELECTOR = re.compile(r"^(?P<tag>[a-z][a-z0-9]*|\*)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)(?:=['\"]?(?P<val>[^'\"\]]*)['\"]?)?\])?$")


def compiled(selector: str) -> list[dict]:
    """A chain of simple selectors (tag, #id, .class, [attribute], [attribute=value]), each below the one before."""
    out = []
    for part in selector.split():
        m = SELECTOR.match(part)
        if not m or not part:
            raise ValueError(f"not a selector that is read here: {selector!r}")
        out.append(m.groupdict())
    if not out:
        raise ValueError("an empty selector")
    return out


def extract_elements(documents: DataFrame, name: str, selector: str, attribute: str | None = None) -> DataFrame:
    """url, name: the texts (or an attribute) of the elements that the selector names."""
    chain = compiled(selector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"url": batch["url"], name: [elements(h, chain, attribute) if isinstance(h, str) else [] for h in batch["html"]]})

    return documents.where(F.coalesce("ok", F.lit(False))).select("url", "html").mapInPandas(run, f"url string, `{name}` array<string>")


def elements(html: str, chain: list[dict], attribute: str | None) -> list[str]:
    from tessella.functions.html import VOID, Tokens

    def fits(want: dict, tag: str, a: dict[str, str]) -> bool:
        return (
            (want["tag"] in (None, "*", tag))
            and (want["id"] is None or a.get("id") == want["id"])
            and (want["cls"] is None or want["cls"] in a.get("class", "").split())
            and (want["attr"] is None or want["attr"] in a and (want["val"] is None or a[want["attr"]] == want["val"]))
        )

    class Finder(Tokens):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.stack: list[tuple[str, int]] = []  # open elements, with how much of the chain they and those above fit
            self.open: list[tuple[int, list[str]]] = []
            self.found: list[list[str]] = []

        def handle_starttag(self, tag: str, attrs: list) -> None:
            a = {k: self.as_written(v or "") for k, v in attrs}
            at = self.stack[-1][1] if self.stack else 0
            if at == len(chain) - 1 and fits(chain[-1], tag, a):
                text: list[str] = [a.get(attribute, "")] if attribute else []
                self.found.append(text)
                if not attribute and tag not in VOID:
                    self.open.append((len(self.stack), text))
            if tag not in VOID:
                self.stack.append((tag, at + 1 if at < len(chain) - 1 and fits(chain[at], tag, a) else at))

        def handle_endtag(self, tag: str) -> None:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    while self.open and self.open[-1][0] >= k:
                        self.open.pop()
                    break

        def handle_data(self, data: str) -> None:
            for _, text in self.open:
                text.append(self.as_written(data))

    f = Finder()
    f.feed(html)
    return [" ".join("".join(t).split()) for t in f.found]


def with_text(documents: DataFrame) -> DataFrame:
    """The documents with their visible text where it isn't there yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[t if isinstance(t, str) else ((parse(u, h) or {}).get("text") if isinstance(h, str) else None) for u, h, t in zip(batch["url"], batch["html"], batch["text"])])

    return documents.select("url", "ok", "html", "text").mapInPandas(run, "url string, ok boolean, html string, text string")
