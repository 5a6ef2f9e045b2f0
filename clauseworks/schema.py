"""Schemas of the entities and the parameters that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

PAGE_ITEM_TYPES = ("chapter_header", "section_header", "new_subsection", "continuation")

PAGE_ITEM = "doc string, page int, item int, type string, content string, id string"
SUBSECTION = "document_name string, document_summary string, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>"
CHUNK = (
    "id string, text string, doc_name string, document_summary string, chapter string, section string, subsection_id string, page_numbers string, bm25_text string,"
    "subsection_text string, is_split boolean, full_subsection_text string, chunk_index int, total_chunks int, context_summary string, seq int, prev_ids array<string>, next_ids array<string>"
)
VECTOR = "index_name string, namespace string, id string, values array<float>, meta string"
LEDGER = "index_name string, namespace string, document string, chunk_fingerprint string, chunk_count int, embedder string, model string, dimension int, indexed_at timestamp"
GAP_ANALYSIS = "reasoning string, sufficient boolean, missing_info string, followup_queries array<string>"


@dataclass(frozen=True)
class Config:
    """Retrieval and chunking parameters with their defaults."""

    top_k: int = 30
    rerank_top_k: int = 20
    relevance_threshold: float = 0.01
    mmr_lambda: float = 0.7
    rrf_k: int = 60
    pool_factor: int = 3
    pool_least: int = 60
    count_bonus: float = 0.25
    level_bonus: float = 0.10
    levels: tuple[tuple[str, int], ...] = (("doc_name", 3), ("chapter", 4), ("section", 5))
    sibling_level: str = "section"
    siblings_per_group: int = 5
    high: float = 0.65
    low: float = 0.30
    moderate: float = 0.40
    max_hops: int = 2
    chunk_size: int = 2048
    chunk_overlap: int = 204
    neighbor_window: int = 2
    two_call: bool = False
    max_rounds: int = 1
    post_processing: tuple[str, ...] = field(default=("dedupe", "relevance_filter"))

    @property
    def pool(self) -> int:
        return max(self.top_k * self.pool_factor, self.pool_least)
