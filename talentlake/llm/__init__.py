"""Operators of a training-data pipeline: WARC, near and exact dedup, personal
data, language-model scoring, decontamination, mixing, toxicity, HTML
extraction and chat formatting. Nothing else in the library imports this
subpackage; its queries are collected in :mod:`talentlake.llm.catalog`."""
