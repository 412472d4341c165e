"""Declared schemas of all tables. Readers never infer types."""

from __future__ import annotations

ISSUE = "check string, msg string, hard boolean, suggest struct<q: string, lang: string>"
DECISION = "struct<action: string, qid: string, query: string, lang: string, confidence: double, reason: string>"
TRACE = (
    "array<struct<step: string, query: string, lang: string, by: string, added: array<string>, "
    f"queries: array<struct<q: string, lang: string>>, reason: string, decision: {DECISION}, "
    "issues: array<struct<check: string, msg: string, hard: boolean, suggest: struct<q: string, lang: string>>>>>"
)

MENTION = (
    "id string, doc_id string, text string, mention string, type string, start int, end int, gold string, source string, "
    "category string, sitelinks int"
)
RUN = (
    "id string, mention string, text string, type string, category string, gold string, qid string, initial_qid string, "
    "label string, corrected boolean, flagged boolean, rounds int, confidence double, reason string, "
    f"candidates array<string>, llm_calls double, seconds double, trace {TRACE}"
)
ENTITY = (
    "qid string, label_ar string, label_en string, label_fr string, desc_ar string, desc_en string, "
    "aliases_ar array<string>, aliases_en array<string>, aliases_fr array<string>, p31 array<string>, "
    "facts map<string, array<string>>, sitelinks int, arwiki string"
)
POOLED_REVIEW = ("id", "group", "text", "mention", "type", "category", "options", "option_info", "sources", "status", "accepted", "annotator", "carried")
SINGLE_REVIEW = (
    "id", "group", "text", "mention", "type", "category", "gold", "gold_label", "gold_desc", "agent", "agent_label", "agent_desc",
    "search", "search_label", "search_desc", "initial", "checks_fired", "agent_reason", "verdict", "correct_qid", "error_type",
)
LABELS = "id string, accepted array<string>, unclear boolean"
CASES = "seq long, key string, mention string, type string, wrong string, right string, checks array<string>, why string, context string"
CLAIM = "struct<rank: string, mainsnak: struct<datavalue: struct<type: string, value: string>>>"
RAW_ENTITY = (
    "id string, labels map<string, struct<value: string>>, descriptions map<string, struct<value: string>>, "
    f"aliases map<string, array<struct<value: string>>>, claims map<string, array<{CLAIM}>>, sitelinks map<string, struct<title: string>>"
)
