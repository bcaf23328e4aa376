"""Thresholds and switches of an audit, with their defaults; validated as a whole."""

from __future__ import annotations

import copy
from typing import Any

from tessella.plans.registry import CHECKS, SEVERITY_RANK

#: Default thresholds, requirements, weights and task settings.
DEFAULTS: dict[str, Any] = {
    "thresholds": {
        "title_max_chars": 60, "title_max_px": 561, "title_min_chars": 30, "desc_max_chars": 160, "desc_max_px": 985, "desc_min_chars": 70,
        "h1_max_chars": 70, "h2_max_chars": 70, "thin_content_words": 200, "low_text_ratio_pct": 10, "url_max_chars": 115, "crawl_depth_max": 4,
        "click_depth_max": 10, "orphan_inlinks_min": 1, "response_time_max_s": 1.5, "large_html_abs_kb": 200, "large_html_x_median": 3.0,
        "dom_depth_max": 32, "dom_nodes_max": 1500, "img_max_kb": 150, "img_alt_max_chars": 100, "sitemap_lastmod_stale_days": 365,
        "sitemap_desync_pct_warn": 20, "templated_title_share": 0.6, "bytes_per_word_x_median": 4.0, "readability_flesch_min": 30,
        "avg_words_per_sentence_max": 25, "high_external_outlinks": 100, "high_outlinks": 300, "redirect_hop_cap": 20,
        "link_score_low_ratio": 0.25, "near_duplicate_similarity": 0.92, "compression_min_bytes": 1400,
    },
    "requirements": {"require_canonical": True, "require_h2": False, "require_hreflang": False, "require_structured_data": False, "require_og": False},
    "tasks": {
        "include_severities": ["critical", "warning", "notice"], "group_by": "check", "priority_map": {"critical": "P1", "warning": "P2", "notice": "P3"},
        "effort_map": {"critical": "high", "warning": "medium", "notice": "low"}, "max_urls_per_task": 25, "min_occurrences": 1, "include_checks": [], "exclude_checks": [],
    },
    "checks": {},
    "severity_overrides": {},
    "weights": {"critical": 5, "warning": 2, "notice": 0.5},
}


class Settings:
    """Defaults with changes laid over them; unknown checks and severities are errors, not ignored."""

    def __init__(self, changes: dict[str, Any] | None = None) -> None:
        self.values = _laid_over(DEFAULTS, changes or {})
        named = [*self.values["checks"], *self.values["severity_overrides"], *self.values["tasks"]["include_checks"], *self.values["tasks"]["exclude_checks"]]
        if unknown := [c for c in named if c not in CHECKS]:
            raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
        given = [*self.values["severity_overrides"].values(), *(c["severity"] for c in self.values["checks"].values() if "severity" in c)]
        if unknown := [s for s in given if s not in SEVERITY_RANK]:
            raise ValueError(f"unknown severities: {', '.join(unknown)}")
        if self.values["tasks"]["group_by"] not in ("check", "issue"):
            raise ValueError("tasks are grouped by check or by issue")

    def threshold(self, name: str) -> float:
        return self.values["thresholds"][name]

    def requires(self, name: str) -> bool:
        return bool(self.values["requirements"][f"require_{name}"])

    def enabled(self, check: str) -> bool:
        return self.values["checks"].get(check, {}).get("enabled", True)

    def severity(self, check: str) -> str:
        return self.values["severity_overrides"].get(check) or self.values["checks"].get(check, {}).get("severity") or CHECKS[check].severity


def _laid_over(base: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for k, v in changes.items():
        out[k] = _laid_over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
