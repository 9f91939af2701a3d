"""Rule, service, checklist, liability and finding catalogues.

Catalogues are small YAML files read on the driver. Where an expression needs one as a
whole (all keywords of a document type, all services), it becomes a literal of the plan;
where a join needs it, it becomes a DataFrame of known size that is broadcast.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import LEVEL_RANK, norm_keyword

HERE = Path(__file__).parent / "catalogues"


@lru_cache(maxsize=None)
def _yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def _load(path, default) -> dict:
    return _yaml(str(path or HERE / default))


def rules(path=None) -> list[dict]:
    """Enabled rules in catalogue order; an unknown level reads as medium."""
    out = []
    for pos, r in enumerate(_load(path, "rules.yml").get("rules", [])):
        if not r.get("enabled", True):
            continue
        level = str(r.get("risk_level", "")).strip().lower()
        title = str(r.get("title") or r["id"])
        out.append({
            "rule_pos": pos, "rule_id": str(r["id"]), "title": title,
            "risk_level": level if level in LEVEL_RANK else "medium", "score": int(r.get("score") or 0),
            "legal_basis": str(r.get("legal_basis") or ""),
            "recommendation": str(r.get("recommendation") or ""),
            "explanation": str(r.get("client_friendly_explanation") or ""),
            "report_phrase": str(r.get("report_phrase") or ""),
        })
    return out


RULES_DDL = ("rule_pos int, rule_id string, title string, risk_level string, score int, legal_basis string, "
             "recommendation string, explanation string, report_phrase string")


def load_rules(spark: SparkSession, path=None) -> DataFrame:
    return spark.createDataFrame(rules(path), RULES_DDL)


def trackers(path=None) -> list[dict]:
    out = []
    for pos, p in enumerate(_load(path, "trackers.yml").get("providers", [])):
        def texts(key):
            v = p.get(key) or []
            return [str(x) for x in ([v] if isinstance(v, str) else v) if str(x)]

        out.append({
            "provider_pos": pos, "provider_name": str(p.get("provider_name") or "unknown"),
            "category": str(p.get("category") or "other"),
            "country_hint": str(p.get("country_hint") or "unknown"),
            "legal_risk": str(p.get("legal_risk") or "low"),
            "disclose": bool(p.get("should_be_disclosed_in_policy", True)),
            "cookie_check": bool(p.get("should_trigger_cookie_check", False)),
            "cross_border": bool(p.get("should_trigger_cross_border_check", False)),
            "domains": texts("domains"), "patterns": texts("patterns"),
        })
    return out


TRACKERS_DDL = ("provider_pos int, provider_name string, category string, country_hint string, legal_risk string, "
                "disclose boolean, cookie_check boolean, cross_border boolean, domains array<string>, "
                "patterns array<string>")


def load_trackers(spark: SparkSession, path=None) -> DataFrame:
    return spark.createDataFrame(trackers(path), TRACKERS_DDL)


def cookie_names(path=None) -> list[dict]:
    return [
        {"name_pos": i, "name": str(c["name"]), "provider": str(c.get("provider") or ""),
         "category": str(c.get("category") or "unknown")}
        for i, c in enumerate(_load(path, "trackers.yml").get("tracking_cookie_names", []))
        if c.get("name")
    ]


COOKIES_DDL = "name_pos int, name string, provider string, category string"


def load_cookie_names(spark: SparkSession, path=None) -> DataFrame:
    return spark.createDataFrame(cookie_names(path), COOKIES_DDL)


def checklists(path=None) -> dict[str, list[dict]]:
    """Items per document type; types without a list of their own borrow one."""
    def item(pos, x):
        def get(short, long, default=""):
            return x.get(short, x.get(long, default)) or default

        return {
            "item_pos": pos, "item_id": str(get("i", "id")), "label": str(get("l", "label")),
            "risk_if_missing": str(get("r", "risk_if_missing", "medium")),
            "applies_when": str(get("w", "applies_when", "always")).strip().lower(),
            "special": str(get("s", "special")),
            "keywords": [str(k) for k in get("k", "keywords", [])],
            "norm_keywords": [norm_keyword(str(k)) for k in get("k", "keywords", [])],
        }

    lists = {t: [item(i, x) for i, x in enumerate(xs)]
             for t, xs in _load(path, "checklists.yml").get("checklists", {}).items()}
    for kind, source in (("user_agreement", "offer"), ("special_consent", "consent"),
                         ("distribution_consent", "consent")):
        if not lists.get(kind) and source in lists:
            lists[kind] = lists[source]
    return lists


ITEM_DDL = ("item_pos int, item_id string, label string, risk_if_missing string, applies_when string, "
            "special string, keywords array<string>, norm_keywords array<string>")


def load_checklists(spark: SparkSession, path=None) -> DataFrame:
    rows = [{"doc_type": t, **x} for t, xs in checklists(path).items() for x in xs]
    return spark.createDataFrame(rows, "doc_type string, " + ITEM_DDL)


def liability(path=None) -> list[dict]:
    data = _load(path, "liability.yml")
    rows = [{"kind": str(x.get("kind") or ""), "label": str(x["label"]).strip(),
             "basis": str(x.get("basis") or ""), "amount": str(x.get("amount") or "")}
            for x in data.get("items", []) if x.get("label")]
    return rows + [{"kind": k, "label": v, "basis": None, "amount": None}
                   for k, v in (data.get("other_kinds") or {}).items()]


def load_liability(spark: SparkSession, path=None) -> DataFrame:
    rows = [x for x in liability(path) if x["basis"] is not None]
    return spark.createDataFrame(rows, "kind string, label string, basis string, amount string")


def load_packages(spark: SparkSession, path=None) -> DataFrame:
    data = _load(path, "packages.yml")
    by_id = {str(p["id"]): p for p in data.get("packages", [])}
    rows = [
        {"package_pos": i, "package_id": k, "title": by_id[k].get("title", ""),
         "duration": by_id[k].get("duration", ""), "description": by_id[k].get("description", ""),
         "price_key": by_id[k].get("price_key") or k, "items": [str(x) for x in by_id[k].get("items") or []]}
        for i, k in enumerate(k for k in map(str, data.get("order") or by_id) if k in by_id)
    ]
    return spark.createDataFrame(
        rows, "package_pos int, package_id string, title string, duration string, description string, "
              "price_key string, items array<string>")


def findings(path=None) -> dict:
    return _load(path, "findings.yml")


def literal(rows, ddl: str) -> Column:
    """A catalogue as one constant of type array<struct<ddl>>; Catalyst folds it at planning."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{typed(ddl)}>>")


def typed(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in ddl.split(",")))
