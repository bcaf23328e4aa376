"""Access logs: Common, Combined and W3C lines as rows, and which crawler asked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import urls
from tessella.schemas import LOGS

LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) ([^" ]+)[^"]*" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
#: Crawlers by patterns that are searched for in agent names, in order; the first that fits counts.
BOTS: tuple[tuple[str, str, str], ...] = (
    (r"Googlebot[^)]*Mobile|Mobile[^)]*Googlebot", "Googlebot Smartphone", "googlebot"),
    (r"Googlebot-Image", "Googlebot Image", "googlebot"),
    (r"Googlebot-Video", "Googlebot Video", "googlebot"),
    (r"Googlebot-News", "Googlebot News", "googlebot"),
    (r"AdsBot-Google-Mobile", "AdsBot Google Mobile", "googlebot"),
    (r"AdsBot-Google", "AdsBot Google", "googlebot"),
    (r"Mediapartners-Google", "Mediapartners (AdSense)", "googlebot"),
    (r"Google-InspectionTool", "Google InspectionTool", "googlebot"),
    (r"Google-Extended", "Google-Extended (Gemini)", "ai"),
    (r"GoogleOther", "GoogleOther", "googlebot"),
    (r"APIs-Google", "APIs-Google", "googlebot"),
    (r"FeedFetcher-Google", "FeedFetcher-Google", "googlebot"),
    (r"Googlebot", "Googlebot", "googlebot"),
    (r"BingPreview", "BingPreview", "bingbot"),
    (r"adidxbot", "AdIdxBot (Bing Ads)", "bingbot"),
    (r"bingbot", "Bingbot", "bingbot"),
    (r"msnbot", "MSNBot", "bingbot"),
    (r"YandexMobileBot", "YandexMobileBot", "yandexbot"),
    (r"YandexImages", "YandexImages", "yandexbot"),
    (r"YandexBot", "YandexBot", "yandexbot"),
    (r"Yandex(?:Accessibility|Metrika|Webmaster|[A-Za-z]+)?", "Yandex (other)", "yandexbot"),
    (r"DuckDuckBot|DuckDuckGo-Favicons-Bot", "DuckDuckBot", "search"),
    (r"Baiduspider", "Baiduspider", "search"),
    (r"Sogou web spider", "Sogou", "search"),
    (r"Exabot", "Exabot", "search"),
    (r"Applebot", "Applebot", "search"),
    (r"SeznamBot", "SeznamBot", "search"),
    (r"PetalBot", "PetalBot", "search"),
    (r"GPTBot", "GPTBot (OpenAI)", "ai"),
    (r"OAI-SearchBot", "OAI-SearchBot (OpenAI)", "ai"),
    (r"ChatGPT-User", "ChatGPT-User", "ai"),
    (r"ClaudeBot|Claude-Web|anthropic-ai", "ClaudeBot (Anthropic)", "ai"),
    (r"PerplexityBot", "PerplexityBot", "ai"),
    (r"CCBot", "CCBot (Common Crawl)", "ai"),
    (r"Bytespider", "Bytespider (ByteDance)", "ai"),
    (r"Amazonbot", "Amazonbot", "ai"),
    (r"facebookexternalhit|facebookcatalog|meta-externalagent", "Facebook", "social"),
    (r"Twitterbot", "Twitterbot", "social"),
    (r"LinkedInBot", "LinkedInBot", "social"),
    (r"Slackbot", "Slackbot", "social"),
    (r"WhatsApp", "WhatsApp", "social"),
    (r"TelegramBot", "TelegramBot", "social"),
    (r"Discordbot", "Discordbot", "social"),
    (r"Pinterest(?:bot)?", "Pinterestbot", "social"),
    (r"AhrefsBot", "AhrefsBot", "seo-tool"),
    (r"SemrushBot", "SemrushBot", "seo-tool"),
    (r"MJ12bot", "MJ12bot (Majestic)", "seo-tool"),
    (r"DotBot", "DotBot (Moz)", "seo-tool"),
    (r"rogerbot", "rogerbot (Moz)", "seo-tool"),
    (r"BLEXBot", "BLEXBot", "seo-tool"),
    (r"DataForSeoBot", "DataForSeoBot", "seo-tool"),
    (r"Screaming Frog SEO Spider", "Screaming Frog", "seo-tool"),
    (r"\b(bot|crawler|spider|crawl)\b", "Other bot", "other"),
)


def parsed(lines: DataFrame) -> DataFrame:
    """Common and Combined lines as rows; what isn't one is left out (see malformed)."""
    at = lambda k: F.regexp_extract("value", LINE, k)
    time = F.coalesce(F.try_to_timestamp(at(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(F.concat(at(2), F.lit(" +0000")), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    blank = lambda c: F.when(~c.isin("", "-"), c)
    rows = lines.where(F.col("value").rlike(LINE)).select(at(1).alias("ip"), time.alias("time"), at(3).alias("method"), at(4).alias("path"), at(5).cast("int").alias("status"), at(6).try_cast("bigint").alias("bytes"), blank(at(7)).alias("referer"), blank(at(8)).alias("user_agent"))
    return rows


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def malformed(lines: DataFrame) -> DataFrame:
    """One row: how many lines couldn't be read."""
    return lines.where(~F.col("value").rlike(LINE) & (F.trim("value") != "") & ~F.col("value").startswith("#")).agg(F.count(F.lit(1)).alias("malformed"))


def read_w3c(spark: SparkSession, path: str) -> DataFrame:
    """W3C logs: what a line's words are is said by the last `#Fields:` line above it, so a file is read in order, by one task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                names: list[str] = []
                for line in bytes(content).decode("utf-8", "replace").splitlines():
                    if line.startswith("#Fields:"):
                        names = line[8:].split()
                    elif line and line[0] != "#" and names:
                        v = dict(zip(names, line.split()))
                        get = lambda k, v=v: None if v.get(k) in (None, "-") else v[k]
                        query = get("cs-uri-query")
                        number = lambda k: int(get(k)) if (get(k) or "").isdigit() else None
                        rows.append((get("c-ip"), f"{v.get('date', '')} {v.get('time', '')}", get("cs-method"), (get("cs-uri-stem") or "") + (f"?{query}" if query else ""), number("sc-status"), number("sc-bytes"), get("cs(Referer)"), (get("cs(User-Agent)") or "").replace("+", " ") or None))
            yield pd.DataFrame(rows, columns=["ip", "time", "method", "path", "status", "bytes", "referer", "user_agent"]).astype({"status": "Int32", "bytes": "Int64"})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, LOGS.replace("time timestamp", "time string"))
    return raw.withColumn("time", F.try_to_timestamp("time", F.lit("yyyy-MM-dd HH:mm:ss")))


def bot(agent: Column) -> Column:
    """(name, family) of the crawler; null for others, and for agents that are blank or `-`."""

    def place(a: Column) -> Column:
        out = F.when(F.coalesce(a, F.lit("-")).isin("", "-"), F.lit(None))
        for k, (pattern, _, _) in enumerate(BOTS):
            out = out.when(a.rlike(f"(?i){pattern}"), k)
        return out

    names, families = (F.array(*[F.lit(b[k]) for b in BOTS]) for k in (1, 2))
    named = lambda k: F.when(k.isNotNull(), F.struct(F.get(names, k).alias("name"), F.get(families, k).alias("family")))
    return urls.let(urls.let(agent, place), named)


def with_bots(logs: DataFrame) -> DataFrame:
    b = bot(F.col("user_agent"))
    return logs.withColumns({"bot": b["name"], "family": F.coalesce(b["family"], F.lit("other")), "section": urls.section(F.regexp_replace("path", r"[?#].*$", "")), "status_class": F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))})


def rollup(logs: DataFrame) -> dict[str, DataFrame]:
    """by_bot, by_status, by_section, daily, and the span; exact, so `truncated` is always false."""
    rows = with_bots(logs)
    hits = F.count(F.lit(1)).alias("hits")
    return {
        "by_bot": rows.where("bot is not null").groupBy("family", "bot").agg(hits, F.sum("bytes").alias("bytes"), F.countDistinct("ip").alias("ips"), F.min("time").alias("first"), F.max("time").alias("last")),
        "by_status": rows.groupBy("family", "status_class").agg(hits),
        "by_section": rows.groupBy("family", "section").agg(hits),
        "daily": rows.groupBy("family", F.to_date("time").alias("day")).agg(hits),
        "span": rows.agg(hits, F.min("time").alias("first"), F.max("time").alias("last"), F.lit(False).alias("truncated")),
    }


def top_paths(logs: DataFrame, n: int = 20) -> DataFrame:
    """family, path, hits, rank: the paths asked for most; ties by path."""
    from tessella.operators.rollups import top

    counted = with_bots(logs).groupBy("family", "path").agg(F.count(F.lit(1)).alias("hits"))
    return top(counted, ["family"], [F.col("hits").desc(), F.col("path")], n)
