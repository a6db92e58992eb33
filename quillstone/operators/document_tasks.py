"""Chunkers that scan one document with state: adaptive size, sections, meaning, entity graphs, hybrid, and policy preprocessing.

Each function maps a text to its chunks; documents are independent, so Spark spreads them and nothing depends on order
between documents. They run in Arrow batches (see chunk_documents); whatever needs no state is done by expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lexicon as X
from quillstone.functions import text as T
from quillstone.functions.embed import embed
from quillstone.session import ship, spread


@dataclass
class Chunk:
    text: str
    section: str = ""
    cover: str = "general"
    confidence: float = 1.0
    extra: dict[str, str] = field(default_factory=dict)


def _any(patterns) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE | re.MULTILINE)


#: Characters that stand for ASCII letters in any case, but not when in lower case.
_ODD = frozenset("ſıİ")


def _lowered(text: str) -> str | None:
    """The text as Quick looks at it; None where that would not do."""
    return text.lower() if text.isascii() or _ODD.isdisjoint(text) else None


def _needed(parts) -> set[str] | None:
    """Strings in lower case of which each match of a parsed pattern holds one, the longest such set; None where there is none."""
    found, run = [], ""
    for op, value in [*parts, (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append({run.lower()})
            run = ""
        if op is re._constants.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op is re._constants.BRANCH:
            each = [_needed(v) for v in value[1]]
            found.append(None if None in each else set().union(*each))
        elif op is re._constants.MAX_REPEAT and value[0]:
            found.append(_needed(value[2]))
    return max((f for f in found if f), key=lambda f: min(map(len, f)), default=None)


class Quick:
    """A pattern in any case that is only tried where one of the strings that each of its matches holds is there."""

    def __init__(self, pattern: re.Pattern):
        self.pattern, self.needs = pattern, tuple(sorted(_needed(re._parser.parse(pattern.pattern, pattern.flags)) or ()))

    def may(self, low: str | None) -> bool:
        return low is None or not self.needs or any(map(low.__contains__, self.needs))

    def search(self, text: str, low: str | None) -> bool:
        return self.may(low) and bool(self.pattern.search(text))

    def finditer(self, text: str) -> Iterator[re.Match]:
        return self.pattern.finditer(text) if self.may(_lowered(text)) else iter(())


#: What no match of the entities and relations goes beyond: they hold words, blanks, and numbers with points and commas.
_BARRIER = re.compile(r"[^\w\s€.,]|[.,](?!\d)")


def stretches(text: str) -> list[tuple[str, str | None]]:
    return [(s, _lowered(s)) for s in _BARRIER.split(text)]


def matches(quick: Quick, parts: list[tuple[str, str | None]]) -> Iterator[re.Match]:
    """The matches of a pattern in the stretches of a text, as in the whole text."""
    return (m for s, low in parts if quick.may(low) for m in quick.pattern.finditer(s))


_SIGNAL = {k: _any(p) for k, p in X.SIGNALS.items()}
_QUICK_SIGNAL = {k: Quick(p) for k, p in _SIGNAL.items()}
_CAPS = re.compile(X.CAPS_DEFINITION, re.MULTILINE)
_CLAUSE = re.compile("|".join(f"(?:{p})" for p in X.CLAUSES), re.MULTILINE)
_CLAUSE_WORD = _any(X.CLAUSES_ANY_CASE)
_BREAK = re.compile(r"\b(?:SECTION|ARTICLE|CHAPTER)\b", re.IGNORECASE)
_CUT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def limited(x: float) -> float:
    return min(1.0, max(0.0, x))


def split_sentences(text: str, abbreviations: tuple[str, ...] = X.ABBREVIATIONS) -> list[str]:
    """Sentences; one that ends in an abbreviation takes the next (one only)."""
    parts = [s for s in (p.strip() for p in _CUT.split(text)) if s]
    out, i = [], 0
    while i < len(parts):
        take = 2 if i + 1 < len(parts) and parts[i].lower().endswith(abbreviations) else 1
        out.append(" ".join(parts[i : i + take]))
        i += take
    return out


def cover_of(text: str, table: dict[str, tuple[str, ...]]) -> str:
    low = text.lower()
    return next((k for k, terms in table.items() if any(t in low for t in terms)), "general")


# ---------------------------------------------------------------- adaptive size


def signals(text: str) -> dict[str, bool]:
    low = _lowered(text)
    found = {k: p.search(text, low) for k, p in _QUICK_SIGNAL.items()}
    found["definition"] |= ":" in text and bool(_CAPS.search(text))
    return found


def complexity(text: str, found: dict[str, bool], sentences: int = 1) -> float:
    weight = {"amount": 0.3, "condition": 0.2, "exclusion": 0.25, "coverage": 0.2, "definition": 0.15}
    score = sum(w for k, w in weight.items() if found[k])
    words = len(text.split()) / max(1, sentences)
    score += 0.1 if words > 30 else -0.1 if words < 10 else 0.0
    if sum(map(text.count, ",(;")) / max(1, sentences) > 3:
        score += 0.1
    return limited(score)


def clarity(text: str, found: dict[str, bool]) -> float:
    n = len(text.split())
    score = 1.0 + (0.1 if found["amount"] or found["coverage"] else 0.0) - (0.2 if n < 5 else 0.1 if n > 50 else 0.0)
    return limited(score + (0.05 if _CLAUSE.search(text) or _CLAUSE_WORD.search(text) else 0.0))


def target_words(importance: float, base: int, least: int, most: int, factor: float) -> int:
    scale = factor if importance > 0.6 else 1.2 if importance > 0.3 else 0.8
    return max(least, min(most, int(base * scale)))


def _goes_on(last: str, new: str) -> bool:
    end = re.sub(r"[.,;:()]+\s*$", "", last.lower().strip())
    return end.endswith(X.CONTINUES) or new.lower().strip().startswith(X.CONTINUING)


def _boundary(sentence: str) -> bool:
    return bool(_CLAUSE.match(sentence) or _CLAUSE_WORD.match(sentence) or _BREAK.search(sentence))


def smart_size(text: str, base: int = 105, least: int = 50, most: int = 280, factor: float = 1.6, overlap: int = 5) -> list[Chunk]:
    groups: list[list[str]] = []
    open_: list[str] = []
    size, importance = 0, 0.0
    for s in split_sentences(text):
        n, weight = len(s.split()), complexity(s, signals(s))
        goal = target_words(max(importance, weight), base, least, most, factor)
        if not open_ or size < least:
            split = False
        elif size + n > most:
            split = True
        elif size > goal:
            split = not _goes_on(open_[-1], s)
        else:
            split = size > least and _boundary(s)
        if split:
            groups.append(open_)
            open_, size, importance = [], 0, 0.0
        open_.append(s)
        size, importance = size + n, max(importance, weight)
    if open_:
        groups.append(open_)
    out, before = [], ""
    for g in groups:
        body = " ".join(g)
        found = signals(body)
        tail = " ".join(before.split()[-overlap:]) if overlap and before else ""
        extra = {"target_words": str(target_words(complexity(body, found, len(g)), base, least, most, factor)), "actual_words": str(len(body.split()))}
        out.append(Chunk(f"{tail} {body}" if tail else body, cover=cover_of(body, X.SMART_COVER), confidence=clarity(body, found), extra=extra))
        before = body
    return out


# ---------------------------------------------------------------- sections

_HEADING, _SUB = _any(X.HEADINGS), re.compile("|".join(f"(?:{p})" for p in X.SUBSECTIONS))


def heading_type(line: str) -> str:
    return next((k for k, terms in X.HEADING_TYPES.items() if any(t in line.lower() for t in terms)), "general")


def _sections(text: str, least: int) -> list[tuple[str, str, str]]:
    """title, kind, body."""
    out, title, kind, body = [], "General Content", "general", []
    for line in [*text.split("\n"), None]:
        stop = line is None or (line.strip() and _HEADING.match(line.strip()))
        if stop:
            whole = "\n".join(body).strip()
            if len(whole) >= least:
                out.append((title, kind, whole))
            if line is not None:
                title, kind, body = " ".join(line.split()), heading_type(line), []
        else:
            body.append(line)
    return out


def _by_markers(body: str) -> list[str]:
    pieces, open_ = [], []
    for line in body.split("\n"):
        if _SUB.match(line.strip()) and len("\n".join(open_)) > 100:
            pieces.append("\n".join(open_).strip())
            open_ = []
        open_.append(line)
    pieces.append("\n".join(open_).strip())
    return [p for p in pieces if p]


def pack(parts: list[str], most: int, size: Callable[[str], int], glue: str) -> list[str]:
    out: list[str] = []
    open_, used = [], 0
    for p in parts:
        n = size(p)
        if open_ and used + n > most:
            out.append(glue.join(open_))
            open_, used = [], 0
        open_.append(p)
        used += n
    return out + [glue.join(open_)] if open_ else out


def section(text: str, most: int = 2000, least: int = 50) -> list[Chunk]:
    out = []
    for title, kind, body in _sections(text, least):
        whole = f"{title}\n\n{body}"
        pieces = [whole]
        if len(whole) > most:
            pieces = _by_markers(body)
            if len(pieces) < 2 or any(len(p) > most for p in pieces):
                pieces = pack([s.strip() for s in re.split(r"[.!?]+\s+", body) if s.strip()], most, lambda s: len(s) + 1, "\n")
            pieces[0] = f"{title}\n\n{pieces[0]}"
        for i, p in enumerate(pieces):
            low = title.lower()
            cover = cover_of(title, X.SECTION_COVER)
            if cover == "general":
                cover = next((k for k, terms in X.SECTION_COVER.items() if sum(t in p.lower() for t in terms) >= 2), kind)
            score = 1.0 + 0.1 * (kind in ("section", "chapter", "article")) + 0.1 * any(k in low for k in ("coverage", "guarantee", "benefit", "assicur")) - 0.2 * (len(p) < 100) + 0.1 * bool(re.search(r"[a-z]\)\s|^\d+\.\s|^•\s", p, re.MULTILINE))
            out.append(Chunk(p, title, cover, limited(score), {"section_type": kind, "piece": str(i)}))
    return out


# ---------------------------------------------------------------- meaning


def semantic(text: str, percent: float = 75.0, least: int = 2, most: int = 15) -> list[Chunk]:
    """Sentences between which meaning shifts, at paragraph ends; runs over most are cut."""
    sentences, ends = [], []
    for paragraph in text.split("\n\n"):
        own = split_sentences(paragraph, X.MORE_ABBREVIATIONS)
        sentences += own
        ends += [False] * (len(own) - 1) + [True] * bool(own)
    if not sentences:
        return []
    breaks = []
    if len(sentences) > 1:
        vectors = embed(sentences)
        distance = 1 - (vectors[:-1] * vectors[1:]).sum(1)
        limit, last = np.percentile(distance, percent), 0
        for i in np.flatnonzero(distance > limit).tolist():
            if i + 1 - last >= least and ends[i]:
                breaks.append(i + 1)
                last = i + 1
    cuts, start = [], 0
    for stop in [*breaks, len(sentences)]:
        cuts += [(a, min(a + most, stop)) for a in range(start, stop, most)]
        start = stop
    out = []
    for a, b in cuts:
        body = re.sub(r"\n{3,}", "\n\n", " ".join(s + "\n\n" * e for s, e in zip(sentences[a:b], ends[a:b], strict=True))).strip()
        out.append(Chunk(body, cover=cover_scored(body), extra={"sentences": str(b - a), "coherence": f"{coherence(body):.4f}"}))
    return out


def cover_scored(text: str) -> str:
    low = text.lower()
    found = {k: len(_SIGNAL[k].findall(text)) if _QUICK_SIGNAL[k].may(_lowered(text)) else 0 for k in ("exclusion", "definition")}
    bonus = {"exclusions": found["exclusion"], "definitions": found["definition"]}
    scores = {k: 2 * sum(t in low for t in terms) + bonus.get(k, 0) for k, terms in X.SEMANTIC_COVER.items()}
    best = max(scores, key=lambda k: scores[k])
    return best if scores[best] else "general"


def coherence(text: str) -> float:
    """Mean of even sentence lengths, repeated terms, and linking words."""
    sizes = [len(s.split()) for s in re.split(r"[.!?]+", text) if s.strip()]
    even = 1 / (1 + float(np.var(sizes)) / 100) if sizes else 0.0
    terms = Counter(w for w in text.lower().split() if len(w) > 3)
    again = sum(n > 1 for n in terms.values()) / len(terms) if terms else 0.0
    links = sum(w in text.lower() for w in ("however", "therefore", "furthermore", "moreover", "additionally", "consequently"))
    return (even + again + min(1.0, links / 3)) / 3


# ---------------------------------------------------------------- graphs


def components(n: int, edges: Iterator[tuple[int, int]]) -> list[list[int]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups: dict[int, list[int]] = {}
    for x in range(n):
        groups.setdefault(find(x), []).append(x)
    return list(groups.values())


_ENTITY = {k: Quick(_any(p)) for k, p in X.ENTITIES.items()}
_SENTENCE_ENTITY = {k: Quick(_any(p)) for k, p in X.SENTENCE_ENTITIES.items()}
_RELATION = {k: Quick(re.compile(p, re.IGNORECASE)) for k, p in X.RELATIONS.items()}


def merged_spans(spans: list[tuple[int, int]], gap: int = 100) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] < gap:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def graph(text: str, hierarchical: bool = True) -> list[Chunk]:
    """Entities linked by two-word relations; each component of two or more is a chunk of the passages around them."""
    parts = stretches(text)
    names = sorted({m.group(0).lower() for p in _ENTITY.values() for m in matches(p, parts)})
    place = {n: i for i, n in enumerate(names)}
    edges = {(place[a], place[b]) for p in _RELATION.values() for a, b in ((m.group(1).lower(), m.group(2).lower()) for m in matches(p, parts)) if a in place and b in place and a != b}
    groups = [g for g in components(len(names), iter(sorted(edges))) if len(g) > 1]
    low, out = text.lower(), []
    for g in groups:
        spans = [(m.start(), m.end()) for i in g for m in re.finditer(re.escape(names[i]), low)]
        body = "\n....\n".join(text[max(0, a - 50) : b + 50].strip() for a, b in merged_spans(spans))
        inner = sum(a in g and b in g for a, b in edges)
        degree = Counter(x for e in edges for x in e)
        centre = max(g, key=lambda i: (degree[i], -i))
        extra = {"entities": ", ".join(names[i] for i in g), "density": f"{2 * inner / (len(g) * (len(g) - 1)):.4f}", "central": names[centre]}
        out.append(Chunk(body, cover=cover_of(extra["entities"], X.SMART_COVER), confidence=0.9, extra=extra))
    if hierarchical and len(groups) > 3:
        known = [names[i] for g in groups for i in g]
        best = [s for s in split_sentences(text) if sum(n in s.lower() for n in known) >= 2][:10]
        if best:
            out.append(Chunk(" ".join(best), cover="summary", confidence=0.9, extra={"communities": str(len(groups))}))
    return out


#: Sentences whose similarities to all others are held at a time.
ROWS = 256


def semantic_graph(text: str, threshold: float = 0.75, most: int = 512, least: int = 3, entity_weight: float = 1.5, next_weight: float = 0.8, hierarchical: bool = False, compat: bool = False) -> list[Chunk]:
    """Sentences and repeated entities linked by similarity, shared entities, containment and order; components are chunks.

    As neighbours are always linked, a document's sentences form one component with the entities tied to them. It is cut
    into chunks of most words; compat keeps the first one only, as has been observed; hierarchical adds a summary for
    each cluster of like chunks. Similarities are taken ROWS sentences at a time, so memory follows their number.
    """
    sentences = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text)) if len(s) >= 10]
    n = len(sentences)
    if not n:
        return []
    parts = stretches(text)
    mentions = Counter(m.group(0).lower() for p in _SENTENCE_ENTITY.values() for m in matches(p, parts))
    entities = sorted(e for e, c in mentions.items() if c >= 2)
    vectors = embed([*sentences, *entities])
    low = [s.lower() for s in sentences]
    holders = [np.array([i for i, s in enumerate(low) if name in s], np.int64) for name in entities]
    ties = [float(vectors[i] @ vectors[n + e]) for e, own in enumerate(holders) for i in own.tolist()]
    tied = sum(any(float(vectors[i] @ vectors[n + e]) > 0.5 for i in own.tolist()) for e, own in enumerate(holders))
    weights = [t * entity_weight for t in ties if t > 0.5]
    edges, total = len(weights), sum(weights)
    for a in range(0, n, ROWS):
        rows = np.arange(a, min(a + ROWS, n))
        apart = np.arange(n)[None] - rows[:, None]
        near = vectors[rows] @ vectors[:n].T
        linked = near > threshold
        weight = np.where(linked, near / (1 + np.maximum(apart, 0) / 10), 0.0)
        for own in holders:
            every = np.ix_(own[(own >= a) & (own <= rows[-1])] - a, own)
            weight[every] = np.where(linked[every], weight[every] + 0.2, entity_weight)
            linked[every] = True
        here = rows[rows < n - 1]
        weight[here - a, here + 1] = np.maximum(np.where(linked[here - a, here + 1], weight[here - a, here + 1], 0.0), next_weight)
        linked[here - a, here + 1] = True
        linked &= apart > 0
        edges, total = edges + int(linked.sum()), total + float(weight[linked].sum())
    size = n + tied
    words = " ".join(sentences).split()
    if size < least or not words:
        return []
    mean = total / edges if edges else 0.0
    extra = {"sentences": str(n), "mean_weight": f"{mean:.4f}", "density": f"{2 * edges / (size * (size - 1)):.4f}"}
    bodies = [" ".join(words[i : i + most]) for i in range(0, most if compat else len(words), most)]
    out = [Chunk(b, cover=cover_of(b, X.SMART_COVER), confidence=min(mean, 1.0), extra=dict(extra)) for b in bodies]
    return out + cluster_summaries(out) if hierarchical else out


def dense_clusters(vectors: np.ndarray, eps: float = 0.3) -> list[list[int]]:
    """Clusters of density search with two points as its least: components of pairs within eps; single points are noise. Distances are taken ROWS points at a time."""
    square = (vectors**2).sum(1)

    def near() -> Iterator[tuple[int, int]]:
        for a in range(0, len(vectors), ROWS):
            apart = np.sqrt(np.maximum(square[a : a + ROWS, None] + square[None] - 2 * vectors[a : a + ROWS] @ vectors.T, 0))
            for i, j in zip(*np.nonzero(apart <= eps), strict=True):
                yield a + int(i), int(j)

    return [g for g in components(len(vectors), near()) if len(g) > 1]


def cluster_summaries(chunks: list[Chunk], eps: float = 0.3) -> list[Chunk]:
    """For each cluster of chunks of like meaning one more, of their first sentences; chunks that are like no other have none."""
    if len(chunks) < 2:
        return []
    out = []
    for g in dense_clusters(embed([c.text for c in chunks]), eps):
        firsts = [(split_sentences(chunks[i].text) or [chunks[i].text])[0] for i in g]
        out.append(Chunk(" ".join(firsts), cover="summary", confidence=min(chunks[i].confidence for i in g), extra={"chunks": ", ".join(map(str, g))}))
    return out


# ---------------------------------------------------------------- hybrid

_TYPED = [(re.compile(p, re.IGNORECASE), t) for p, t in X.HYBRID_HEADINGS]
_REFERENCE = _any(X.REFERENCES)


def _hybrid_sections(text: str) -> list[tuple[str, str, str]]:
    out: list[list] = []
    for line in text.split("\n"):
        kind = next((t for p, t in _TYPED if line.strip() and p.match(line)), None)
        if kind:
            out.append([line, kind, []])
        elif out:
            out[-1][2].append(line)
    rows = [(h, k, "\n".join(b).strip()) for h, k, b in out]
    return [(h, k, b) for h, k, b in rows if len(f"{h} {b}".split()) >= 10]


def hybrid(text: str, most: int = 500, overlap: int = 20, threshold: float = 0.75) -> list[Chunk]:
    """Typed sections; long ones by meaning; chunks for cross-references and for cover with its exclusions; overlap throughout. Without headings there are none."""
    rows = _hybrid_sections(text)
    out: list[Chunk] = []
    for header, kind, body in rows:
        whole = f"{header}\n{body}"
        pieces = [whole]
        if len(whole.split()) > most:
            pieces, open_ = [], []
            sentences = [s for s in split_sentences(body) if len(s) > 10]
            vectors, mean, size = embed(sentences), None, 0
            for s, v in zip(sentences, vectors, strict=True):
                alike = mean is None or float(v @ mean) / max(float(np.linalg.norm(mean)), 1e-10) >= threshold
                if open_ and (not alike or size + len(s.split()) > most):
                    pieces.append(" ".join(open_))
                    open_, mean, size = [], None, 0
                open_.append(s)
                size += len(s.split())
                mean = v if mean is None else mean + (v - mean) / len(open_)
            if open_:
                pieces.append(" ".join(open_))
        for p in pieces:
            score = 1.0 + 0.1 * (kind in ("section", "chapter", "article")) + 0.15 * (kind in ("coverage", "exclusion")) - 0.2 * (len(p.split()) < 50) + 0.05
            out.append(Chunk(p, header, cover_of(p, X.SMART_COVER), limited(score), {"kind": kind}))
    for header, _, body in rows:
        for m in _REFERENCE.finditer(body):
            number = next(g for g in m.groups() if g)
            context = body[max(0, m.start() - 100) : m.end() + 100]
            target = next(((h, b) for h, _, b in rows if number in h), None)
            if target and any(t in context.lower() for t in X.IMPORTANT):
                out.append(Chunk(f"Cross-reference from {header} to {target[0]}\n{context}\n{key_sentences(target[1])}", header, "cross_reference", 0.9, {"target": target[0]}))
    covers = [(h, b) for h, k, b in rows if k != "exclusion" and any(t in f"{h} {b[:200]}".lower() for t in X.COVERS)]
    for h, b in covers:
        kind = cover_of(f"{h} {b}", X.SMART_COVER)
        for eh, ek, eb in rows:
            related = h in eb or eh in b or any(t in f"{eh} {eb}".lower() for t in X.SMART_COVER.get(kind, ()))
            if ek == "exclusion" and related:
                out.append(Chunk(f"Coverage: {h}\n{key_sentences(b)}\nExclusion: {eh}\n{key_sentences(eb)}", h, kind, 0.95, {"exclusion": eh}))
    texts = [c.text for c in out]
    for before, c in zip(texts, out[1:], strict=False):
        words = before.split()
        if len(words) > overlap:
            c.text = " ".join(words[-overlap:]) + "\n[...]\n" + c.text
    return out


def key_sentences(text: str, n: int = 3) -> str:
    """The n sentences with most key terms (earlier first on ties), in text order."""
    sentences = [s for s in split_sentences(text) if len(s) > 10]
    rank = sorted(range(len(sentences)), key=lambda i: (-sum(t in sentences[i].lower() for t in X.KEY_TERMS), i))[:n]
    return " ".join(sentences[i] for i in sorted(rank))


# ---------------------------------------------------------------- policy preprocessing

_LEVELS = (
    (1, re.compile(r"^(?:SECTION|SEZIONE|CHAPTER|CAPITOLO)\b", re.IGNORECASE)),
    (2, re.compile(r"^(?:ARTICLE|ARTICOLO|ART\.?)\s*\d+", re.IGNORECASE)),
    (1, re.compile(r"^[A-ZÀ-Ü][A-ZÀ-Ü \-']{5,}$")),
    (3, re.compile(r"^\d+(?:\.\d+)*[.)]?\s+\S")),
    (1, re.compile(r"^(?:What|Che cosa|How|Come|When|Quando)\b.*\?", re.IGNORECASE)),
)
_PAGE = re.compile(r"^-{3}\s*(?:Page|Pagina)\s+(\d+)\s*-{3}$", re.IGNORECASE)
_IGNORE = re.compile(r"^\d+$|^[^A-Za-z0-9]+$|https?://|www\.|\S+@\S+|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$")


def quality(text: str) -> float:
    """Points for length, sentences, structure and terms."""
    words = text.split()
    score = 0.2 * (150 <= len(text) <= 1500) + 0.2 * bool(re.search(r"[.!?]\s*$", text)) + 0.2 * (len(words) >= 25)
    score += 0.2 * bool(re.search(r"[.;:]", text)) + 0.2 * (len(set(w.lower() for w in words)) > len(words) / 2)
    return min(1.0, score)


def readability(text: str) -> float:
    sentences = [s for s in re.split(r"[.!?]+", text) if s.strip()]
    words = text.split()
    if not sentences or not words:
        return 0.0
    mean = len(words) / len(sentences)
    score = 0.9 if mean <= 15 else 0.7 if mean <= 25 else 0.5 if mean <= 35 else 0.3
    return limited(score + 0.1 * (len(sentences) > 2) - 0.2 * (sum(len(w) > 12 for w in words) / len(words) > 0.2))


def preprocess(text: str, most: int = 1000, least: int = 150, needed: float = 0.6) -> list[Chunk]:
    """Headings by level with the page they stand on; long bodies by sentences; pieces that are too short or poor go. Without headings, one stretch for each page."""
    elements: list[list] = []
    page, title, level, body, seen = 1, "", 0, [], False
    path: list[tuple[int, str]] = []

    def flush() -> None:
        whole = "\n".join(body).strip()
        if len(whole) >= least:
            elements.append([title, level, page, whole, " > ".join(t for _, t in path)])

    for line in text.split("\n"):
        bare = line.strip()
        mark = _PAGE.match(bare)
        if mark:
            page = int(mark.group(1))
            continue
        found = next((n for n, p in _LEVELS if p.match(bare)), 0) if 3 <= len(bare) <= 200 else 0
        if found:
            flush()
            seen = True
            path = [x for x in path if x[0] < found] + [(found, bare)]
            title, level, body = bare, found, []
        elif len(bare) >= 3 and not _IGNORE.search(bare):
            body.append(bare)
    flush()
    out = []
    for title, level, page, whole, where in elements:
        pieces = [whole] if len(whole) <= most else pack(split_sentences(whole), most, lambda s: len(s) + 1, " ")
        for p in pieces:
            score = quality(p)
            if least <= len(p) <= 1.2 * 1500 and score >= needed:
                out.append(Chunk(p, title, cover_of(p, X.SMART_COVER), score, {"page": str(page), "level": str(level), "path": where, "readability": f"{readability(p):.2f}", "structured": str(seen).lower()}))
    return out


# ---------------------------------------------------------------- registry and driver

STRATEGIES: dict[str, Callable[..., list[Chunk]]] = {"section": section, "smart_size": smart_size, "semantic": semantic, "graph": graph, "semantic_graph": semantic_graph, "hybrid": hybrid, "policy": preprocess}

COLUMNS = ("doc_id", "strategy", "chunk_ord", "chunk_id", "text", "word_count", "section", "coverage_type", "has_amounts", "has_conditions", "has_exclusions", "confidence_score", "extra")


def register(name: str, strategy: Callable[..., list[Chunk]]) -> None:
    """Add a strategy: a function of a text (and its settings) to chunks."""
    STRATEGIES[name] = strategy


def chunk_documents(docs: DataFrame, strategy: str, **settings) -> DataFrame:
    """Chunks of every document by a registered strategy. A null text has none. docs: doc_id, text."""
    scan = STRATEGIES[strategy]
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for i, c in enumerate(scan(t, **settings))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2].text for r in rows], pa.string()),
                    pa.array([r[2].section for r in rows], pa.string()),
                    pa.array([r[2].cover for r in rows], pa.string()),
                    pa.array([r[2].confidence for r in rows], pa.float64()),
                    pa.array([list(r[2].extra.items()) for r in rows], pa.map_(pa.string(), pa.string())),
                ],
                ["doc_id", "chunk_ord", "text", "section", "coverage_type", "confidence_score", "extra"],
            )

    made = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, "doc_id long, chunk_ord int, text string, section string, coverage_type string, confidence_score double, extra map<string,string>")
    full = made.withColumns({"strategy": F.lit(strategy), "chunk_id": F.concat_ws("_", "doc_id", F.lit(strategy), "chunk_ord"), "word_count": F.size(T.tokens(F.col("text"))), **T.flags(F.col("text"), "hybrid")})
    return full.select(*COLUMNS)
