"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from ozalid.llm import q_canonical, q_cube, q_cutoff, q_garbled, q_groups, q_mix, q_overlap, q_percentiles, q_tokens

MODULES = (q_garbled, q_cube, q_overlap, q_groups, q_canonical, q_percentiles, q_tokens, q_mix, q_cutoff)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
