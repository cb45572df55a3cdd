"""Registered queries and their SQL."""

from __future__ import annotations

from ozalid.plans import q_data, q_images, q_questions, q_scoring, q_sources, q_volumes

MODULES = (q_questions, q_scoring, q_data, q_volumes, q_images, q_sources)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
