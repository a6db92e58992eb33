"""Patterns and terms that tell the structure and quality of policy texts, in English and Italian."""

from __future__ import annotations

# Rewrites of run-together markers, in order; {1} and {2} stand for groups. Any case, line by line.
MARKER_REWRITES = (
    (r"(--- Page \d+ ---)\s*([A-Z])", "{1}\n{2}"),
    (r"(--- Page \d+ ---)\s*(SECTION\s+[A-Z\d]+)", "{1}\n{2}"),
    (r"(--- Page \d+ ---)\s*(ARTICLE\s+\d+)", "{1}\n{2}"),
    (r"(--- Page \d+ ---)\s*(What\s+)", "{1}\n{2}"),
    (r"(Pag\.\s*\d+\s*di\s*\d+)\s*([A-ZÀÈÉÌÒÙ][a-zàèéìòù])", "{1}\n{2}"),
    (r"(Pag\.\s*\d+\s*di\s*\d+)\s*(Che\s+cosa)", "{1}\n{2}"),
    (r"(--- Page \d+ ---)\s*(Che\s+cosa)", "{1}\n{2}"),
    (r"(\d+\s*di\s*\d+)\s*([A-ZÀÈÉÌÒÙ][a-zàèéìòù])", "{1}\n{2}"),
    (r"(Pag\.\s*\d+\s*di\s*\d+)\s*(SEZIONE)", "{1}\n{2}"),
    (r"(Pag\.\s*\d+\s*di\s*\d+)\s*(ARTICOLO)", "{1}\n{2}"),
    (r"Che\s+cosa\s+è\s*assicurat", "Che cosa è assicurat"),
    (r"Che\s+cosa\s+NON\s+è\s*assicurat", "Che cosa NON è assicurat"),
    (r"Ci\s+sono\s+limiti\s+di\s*copertura", "Ci sono limiti di copertura"),
    (r"What\s+is\s+insured", "What is insured"),
    (r"What\s+is\s+NOT\s+insured", "What is NOT insured"),
    (r"Are\s+there\s+coverage\s*limits", "Are there coverage limits"),
    (r"([.!?])\s*([A-ZÀÈÉÌÒÙ])", "{1}\n{2}"),
    (r"(\w)\s*\n\s*([a-zàèéìòù])", "{1} {2}"),
)
# Page markers that are still run together, case as written.
PAGE_REWRITES = (
    (r"--- Page (\d+) --([^-])", "--- Page {1} ---\n{2}"),
    (r"(Pag\.\s*\d+\s*di\s*\d+)([A-ZÀÈÉÌÒÙ])", "{1}\n{2}"),
)
# Rewrites for reading, in order.
READING_REWRITES = (
    (r"([.!?])(\w)", "{1} {2}"),
    (r"\s+", " "),
    (r"\s+([.,;:!?])", "{1}"),
    (r"(\d)\s+([.,])\s*(\d)", "{1}{2}{3}"),
)

LIST_ITEM = r"^\s*[•\-*\d+.)]\s"
LONG_LIST = r"^\s*[•\-*\d+.)]\s+.*(\n\s*[•\-*\d+.)]\s+.*){2,}"
QUESTION_ANSWER = r"\?[^\n]*\n[^\n?]*[^?]\n"
DEFINES = r"significa|significa che|definisce|definition|means|refers to"
PROCEDURE = r"procedura|procedure|modalità|step|fase|point"
PROCEDURE_OR_HOW = r"procedura|procedure|modalità|step|fase|point|come|how"
TERMS = r"condizione|condition|clausola|clause|termine|term"

SECTION_MARKS = r"^\s*(?:SECTION|SEZIONE|PARTE|CAPITOLO)"
ARTICLE_MARKS = r"^\s*(?:ARTICLE|ARTICOLO|ART\.)"

DOMAIN_TERMS = {
    "it": ("assicurato", "polizza", "garanzia", "copertura", "sinistro", "premio", "rimborso", "indennizzo", "esclusioni", "assistenza", "viaggio", "bagaglio"),
    "en": ("insured", "policy", "coverage", "claim", "premium", "reimbursement", "exclusions", "assistance", "travel", "baggage", "benefits"),
}
TABLE_HEADER_WORDS = ("OPTION", "AMOUNT", "TYPE", "NAME", "COVERAGE", "LIMIT", "PREMIUM", "COPERTURA", "GARANZIA", "LIMITE", "PREMIO", "TIPO", "NOME", "IMPORTO")

# Sentence ends, clause ends (see operators/splitting.py).
SENTENCE_ENDS = (
    r"([.!?]+)\s+(?=[A-ZÀÈÉÌÒÙ])",
    r"([.!?]+)\s+(?=(?:Il|La|Lo|Gli|Le|Un|Una|Che|Come|Quando|Dove|Perché|Se)\s)",
    r"([.!?]+)\s+(?=(?:The|A|An|What|How|When|Where|Why|If)\s)",
    r";\s*(?=\n|\s*[A-ZÀÈÉÌÒÙ])",
)
CLAUSE_ENDS = (
    r",\s+(?=(?:che|il quale|la quale|dove|quando|come|perché|mentre|anche se|tuttavia|inoltre|quindi|pertanto)\s)",
    r";\s+",
    r":\s+(?=[A-ZÀÈÉÌÒÙ])",
    r"\s+(?:e|o|ma|però|tuttavia|inoltre|quindi|pertanto|mentre)\s+",
    r"\s+–\s+",
    r"\s+—\s+",
    r",\s+(?=(?:which|who|where|when|how|because|while|although|however|furthermore|therefore|thus)\s)",
    r"\s+(?:and|or|but|however|furthermore|therefore|thus|while)\s+",
)

# Context windows in tokens by part of a model's name, first match.
MODEL_LIMITS = (("gpt-4", 8192), ("gpt-4-32k", 32768), ("gpt-4o", 128000), ("gpt-3.5", 4096), ("phi-4", 100000), ("qwen", 62768), ("qwen-2.5-72b", 32768))

# Words that make one of a document's first lines its title.
TITLE_WORDS = ("INSURANCE", "ASSICURAZIONE", "CONTRACT", "CONTRATTO", "POLICY", "POLIZZA", "CONDITIONS", "CONDIZIONI", "TRAVEL", "VIAGGIO", "PROTECTION", "PROTEZIONE")
