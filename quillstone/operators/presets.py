"""Chunking by name: presets, run-time settings, their validation, and what each strategy is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.preset_table import PRESETS, RUN_TIME
from quillstone.operators import chunking, document_tasks

#: Public name of a setting and the parameter of our chunker that it sets.
PARAMETERS = {
    "simple": {"max_length": "most", "overlap": "overlap"},
    "section": {"max_section_length": "most", "min_section_length": "least"},
    "smart_size": {"base_chunk_words": "base", "min_chunk_words": "least", "max_chunk_words": "most", "importance_multiplier": "factor", "overlap_words": "overlap"},
    "semantic": {"breakpoint_threshold_value": "percent", "min_chunk_sentences": "least", "max_chunk_sentences": "most"},
    "graph": {"enable_hierarchical": "hierarchical"},
    "semantic_graph": {"max_chunk_size": "most", "similarity_threshold": "threshold", "min_community_size": "least", "entity_weight": "entity_weight", "sequential_weight": "next_weight", "enable_hierarchical": "hierarchical"},
    "hybrid": {"max_chunk_words": "most", "overlap_words": "overlap", "semantic_threshold": "threshold"},
}

ABOUT = {
    "simple": "words packed up to a length, or paragraphs",
    "section": "headings open sections; long ones by subsection or sentence",
    "smart_size": "sentences packed to a size that follows their importance",
    "semantic": "cuts where the meaning of neighbouring sentences shifts",
    "graph": "passages around entities that relations tie",
    "semantic_graph": "sentences and entities tied by similarity, entities and order",
    "hybrid": "typed sections, by meaning if long, with chunks for references and for cover with its exclusions",
    "policy": "headings with levels and pages; pieces below a quality go",
}


def preset(name: str, **changes) -> tuple[str, dict]:
    """Strategy and settings of a preset, with changes. An unknown name is an error that lists the known ones."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    strategy, settings = PRESETS[name]
    return strategy, {**settings, **changes}


def run_time(strategy: str, **changes) -> dict:
    if strategy not in RUN_TIME:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(RUN_TIME)}")
    return {**RUN_TIME[strategy], **changes}


def problems(strategy: str, settings: dict) -> list[str]:
    """What is wrong with settings; empty if nothing is. Settings that are left out are not judged."""
    s = settings
    rules = {
        "simple": (("max_length", lambda v: v > 0), ("overlap", lambda v: 0 <= v < s.get("max_length", v + 1))),
        "section": (("max_section_length", lambda v: v > 0), ("min_section_length", lambda v: 0 <= v < s.get("max_section_length", v + 1)), ("sentence_window_size", lambda v: v > 0)),
        "smart_size": (
            ("min_chunk_words", lambda v: v > 0),
            ("max_chunk_words", lambda v: v > s.get("min_chunk_words", 0)),
            ("base_chunk_words", lambda v: s.get("min_chunk_words", v) <= v <= s.get("max_chunk_words", v)),
            ("importance_multiplier", lambda v: v > 0),
            ("overlap_words", lambda v: 0 <= v < s.get("min_chunk_words", v + 1)),
        ),
        "semantic": (
            ("min_chunk_sentences", lambda v: v > 0),
            ("max_chunk_sentences", lambda v: v > s.get("min_chunk_sentences", 0)),
            ("breakpoint_threshold_type", lambda v: v in ("percentile", "fixed")),
            ("breakpoint_threshold_value", lambda v: 0 <= v <= (1 if s.get("breakpoint_threshold_type") == "fixed" else 100)),
            ("buffer_size", lambda v: v >= 0),
        ),
        "hybrid": (
            ("max_chunk_words", lambda v: v > 0),
            ("min_chunk_words", lambda v: 0 < v < s.get("max_chunk_words", v + 1)),
            ("overlap_words", lambda v: v >= 0),
            ("semantic_threshold", lambda v: 0 <= v <= 1),
        ),
    }
    return [f"{strategy}: {name} = {s[name]!r} is out of range" for name, good in rules.get(strategy, ()) if name in s and not good(s[name])]


def describe(strategy: str) -> dict:
    """Name, what it does, its run-time settings, and the presets that use it."""
    return {"name": strategy, "about": ABOUT[strategy], "settings": dict(RUN_TIME.get(strategy, {})), "presets": [n for n, (s, _) in PRESETS.items() if s == strategy]}


def chunk(docs: DataFrame, strategy: str, settings: dict) -> DataFrame:
    """doc_id, chunk_ord, chunk_id, text of the documents' chunks (doc_id, text). Settings without an effect on our chunkers are accepted; wrong ones are an error."""
    wrong = problems(strategy, settings)
    if wrong:
        raise ValueError("; ".join(wrong))
    known = {PARAMETERS[strategy][k]: v for k, v in settings.items() if k in PARAMETERS[strategy]}
    if strategy == "simple":
        rows = chunking.chunked(docs, chunking.word_chunks(F.col("text"), known.get("most", 512)), "simple")
        rows = chunking.with_overlap(rows, known["overlap"]) if known.get("overlap") else rows
        return rows.select("doc_id", "chunk_ord", "chunk_id", "text")
    return document_tasks.chunk_documents(docs, strategy, **known).select("doc_id", "chunk_ord", "chunk_id", "text")


def chunk_by_preset(docs: DataFrame, name: str, **changes) -> DataFrame:
    return chunk(docs, *preset(name, **changes))
