"""The library's tools: one DataFrame function each."""

from caselake.operators.graph import evidence_paths as get_claim_evidence
from caselake.operators.graph import timeline as get_timeline
from caselake.operators.intake import admit, route
from caselake.operators.relational import evidence_gaps as detect_evidence_gaps
from caselake.operators.relational import visible_documents
from caselake.operators.retrieval import explicit_links, implicit_links, match_evidence, query_extractions, query_kg
from caselake.operators.retrieval import hybrid_search as search_sections
from caselake.operators.retrieval import link_evidence as link_evidence_batch

__all__ = ["admit", "detect_evidence_gaps", "explicit_links", "get_claim_evidence", "get_timeline", "implicit_links", "link_evidence_batch", "match_evidence", "query_extractions", "query_kg", "route", "search_sections", "visible_documents"]
