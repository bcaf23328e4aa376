"""Raw responses against rendered documents: what shows only after scripts have run.

Facts of a document: url, words, links (internal ones), images (array), title, h1, canonical, jsonld_types (array),
html_bytes.  A rendered document that lacks all landmarks of the raw one, at a fraction of its size, wasn't
captured, and nothing is said about it but that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words under which a body is empty, the share of a raw response under which a document may be incomplete, the share of a gain that is reported.
EMPTY_WORDS, INCOMPLETE_SHARE, GAIN_SHARE = 50, 0.5, 0.3
#: Ids of the elements into which applications are mounted.
SHELLS = ("root", "app", "__next", "__nuxt", "q-app", "main-app")


def empty_shell(html: Column) -> Column:
    """The id of the first mount point that is empty in the raw response; null for none."""
    out = None
    for name in SHELLS:
        met = F.coalesce(html, F.lit("")).rlike(rf"(?is)<div[^>]+id=[\"']{name}[\"'][^>]*/?>\s*</div>")
        out = F.when(met, name) if out is None else out.when(met, name)
    return out


def incomplete(raw: Column, rendered: Column) -> Column:
    """Whether the rendered document wasn't captured."""
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    lost = ~text(rendered["title"]) & ~text(rendered["h1"]) & ~text(rendered["canonical"]) & (F.coalesce(rendered["links"], F.lit(0)) <= 0)
    had = text(raw["title"]) | (F.coalesce(raw["links"], F.lit(0)) > 0)
    sizes = (F.coalesce(raw["html_bytes"], F.lit(0)) > 0) & (F.coalesce(rendered["html_bytes"], F.lit(0)) < raw["html_bytes"] * INCOMPLETE_SHARE)
    return lost & had & sizes


def findings(raw: Column, rendered: Column, shell: Column) -> Column:
    """The findings of one pair of facts, in order, as codes."""
    n = lambda c: F.coalesce(c, F.lit(0))
    t = lambda c: F.coalesce(c, F.lit(""))
    array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    words, links = n(rendered["words"]) - n(raw["words"]), n(rendered["links"]) - n(raw["links"])
    rules = {
        "empty_shell": shell.isNotNull(),
        "no_copy_in_response": shell.isNull() & (n(raw["words"]) < EMPTY_WORDS) & (n(rendered["words"]) > EMPTY_WORDS),
        "copy_after_scripts": (n(raw["words"]) >= EMPTY_WORDS) & (words > 0) & (words / F.greatest(n(rendered["words"]), F.lit(1)) >= GAIN_SHARE),
        "links_after_scripts": (links > 0) & (n(rendered["links"]) > 0) & ((links / F.greatest(n(rendered["links"]), F.lit(1)) >= GAIN_SHARE) | (n(raw["links"]) == 0)),
        "title_changes": t(raw["title"]) != t(rendered["title"]),
        "h1_differs": (t(raw["h1"]) != t(rendered["h1"])) & (t(rendered["h1"]) != ""),
        "canonical_changes": t(raw["canonical"]) != t(rendered["canonical"]),
        "types_after_scripts": F.size(F.array_except(array(rendered["jsonld_types"]), array(raw["jsonld_types"]))) > 0,
        "images_after_scripts": F.size(F.array_except(array(rendered["images"]), array(raw["images"]))) > 0,
    }
    every = F.filter(F.array(*[F.when(rule, code) for code, rule in rules.items()]), lambda x: x.isNotNull())
    unavailable = F.filter(F.array(F.lit("render_unavailable"), F.when(shell.isNotNull(), "empty_shell")), lambda x: x.isNotNull())
    return F.when(incomplete(raw, rendered), unavailable).when(F.size(every) == 0, F.array(F.lit("all_clear"))).otherwise(every)


def type_changes(raw: Column, rendered: Column) -> Column:
    """(added, removed) types of structured data."""
    a, b = (F.coalesce(x["jsonld_types"], F.array().cast("array<string>")) for x in (raw, rendered))
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def compared(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """raw: facts and shell; rendered: facts.  url, findings, types_added, types_removed of pages that both sides have."""
    names = ("words", "links", "images", "title", "h1", "canonical", "jsonld_types", "html_bytes")
    a = raw.select("url", F.struct(*names).alias("raw"), "shell")
    b = rendered.select("url", F.struct(*names).alias("rendered"))
    changes = type_changes(F.col("raw"), F.col("rendered"))
    return a.join(b, "url").select("url", findings(F.col("raw"), F.col("rendered"), F.col("shell")).alias("findings"), changes["added"].alias("types_added"), changes["removed"].alias("types_removed"))
