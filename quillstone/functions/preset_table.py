"""Named chunking presets and the run-time settings of each strategy, by the settings' public names."""

from __future__ import annotations

PRESETS = {
    "fast": ("simple", {"max_length": 256, "overlap": 25}),
    "balanced": ("section", {"max_section_length": 1500, "preserve_subsections": True}),
    "comprehensive": ("section", {"max_section_length": 2500, "preserve_subsections": True, "include_front_matter": True, "sentence_window_size": 5}),
    "adaptive": ("smart_size", {"base_chunk_words": 80, "min_chunk_words": 25, "max_chunk_words": 180, "importance_multiplier": 1.4, "preserve_complete_clauses": True, "overlap_words": 5}),
    "semantic": ("semantic", {"breakpoint_threshold_type": "percentile", "breakpoint_threshold_value": 75, "min_chunk_sentences": 2, "max_chunk_sentences": 15, "preserve_paragraph_boundaries": True}),
    "semantic_focused": ("semantic", {"breakpoint_threshold_type": "percentile", "breakpoint_threshold_value": 85, "min_chunk_sentences": 3, "max_chunk_sentences": 12, "preserve_paragraph_boundaries": True}),
    "semantic_comprehensive": ("semantic", {"breakpoint_threshold_type": "percentile", "breakpoint_threshold_value": 65, "min_chunk_sentences": 2, "max_chunk_sentences": 20, "preserve_paragraph_boundaries": True}),
    "insurance_semantic": ("semantic", {"breakpoint_threshold_type": "percentile", "breakpoint_threshold_value": 70, "min_chunk_sentences": 2, "max_chunk_sentences": 15, "preserve_paragraph_boundaries": True}),
    "graph": ("graph", {"max_chunk_size": 512, "community_size": 50, "enable_hierarchical": True}),
    "graph_simple": ("graph", {"max_chunk_size": 256, "community_size": 30, "enable_hierarchical": False}),
    "graph_comprehensive": ("graph", {"max_chunk_size": 1024, "community_size": 100, "enable_hierarchical": True}),
    "hybrid_balanced": ("hybrid", {"max_chunk_words": 200, "min_chunk_words": 50, "overlap_words": 15, "semantic_threshold": 0.75, "include_cross_references": True}),
    "hybrid_comprehensive": ("hybrid", {"max_chunk_words": 300, "min_chunk_words": 75, "overlap_words": 25, "semantic_threshold": 0.7, "include_cross_references": True, "preserve_tables": True}),
}

RUN_TIME = {
    "simple": {"max_length": 512},
    "section": {"max_section_length": 2000, "preserve_subsections": True, "include_front_matter": False, "sentence_window_size": 5},
    "smart_size": {"base_chunk_words": 105, "min_chunk_words": 50, "max_chunk_words": 280, "importance_multiplier": 1.6, "preserve_complete_clauses": True, "overlap_words": 5},
    "semantic": {"breakpoint_threshold_type": "percentile", "breakpoint_threshold_value": 75, "min_chunk_sentences": 2, "max_chunk_sentences": 15, "preserve_paragraph_boundaries": True},
    "graph": {"max_chunk_size": 512, "community_size": 50, "enable_hierarchical": True},
    "semantic_graph": {"max_chunk_size": 512, "similarity_threshold": 0.75, "min_community_size": 3, "enable_hierarchical": False, "semantic_window": 5, "entity_weight": 1.5, "sequential_weight": 0.8},
    "hybrid": {"max_chunk_words": 500, "min_chunk_words": 50, "overlap_words": 20, "semantic_threshold": 0.75, "include_cross_references": True, "preserve_tables": False},
}
