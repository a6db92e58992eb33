"""Word lists and patterns that results depend on. Data only; one evaluator serves all strategies."""

from __future__ import annotations

# Typographic marks and what stands for them.
MARKS = ("‘’“”–—… ­", "''\"\"--. -")

# Amounts (patterns, any case), conditions and exclusions (substrings of lower-cased text), by lexicon.
FLAGS = {
    "simple": (
        (r"€\s*\d+", r"CHF\s*\d+", r"\d+\s*EUR", r"\d+\s*CHF", r"maximum.*\d+", r"\d+%", r"\d+\.\d+"),
        ("if", "when", "unless", "provided that", "subject to", "conditional", "depends on", "only if", "in case of", "se", "quando", "solo se", "purché"),
        ("not covered", "excluded", "exception", "does not apply", "limitation", "restriction", "not eligible", "shall not", "non coperto", "escluso", "eccezione", "limitazione"),
    ),
    "hybrid": (
        (r"€\s*\d+", r"EUR\s*\d+", r"CHF\s*\d+", r"\d+\s*(?:€|EUR|CHF)", r"(?:maximum|limit|up to).*\d+"),
        ("if", "when", "provided that", "subject to", "must", "shall", "required", "only if", "unless", "condition", "prerequisite"),
        ("not covered", "excluded", "exception", "does not apply", "limitation", "restriction", "not eligible", "exclusion"),
    ),
}

# Content classes of sentences (any case).
SIGNALS = {
    "amount": (r"€\s*\d+(?:[.,]\d+)?", r"CHF\s*\d+(?:[.,]\d+)?", r"\d+(?:[.,]\d+)?\s*(?:€|EUR|CHF)", r"(?:up to|maximum|limit of|fino a)\s*€?\s*\d+", r"option\s+\d+\s*€\s*\d+"),
    "condition": (r"\b(?:if|when|unless|provided that|subject to|conditional)\b", r"\b(?:se|quando|purché|solo se)\b", r"\b(?:only if|in case of|depends on)\b", r"\b(?:must|shall|required|mandatory)\b"),
    "exclusion": (r"\b(?:not covered|excluded|exception|does not apply)\b", r"\b(?:limitation|restriction|not eligible|shall not)\b", r"\b(?:non coperto|escluso|eccezione|limitazione)\b", r"\b(?:exclude|except|but not|other than)\b"),
    "coverage": (r"\b(?:covered|insured|guarantee|benefit|indemnity)\b", r"\b(?:assicurato|coperto|garanzia|beneficio)\b", r"\b(?:pays|reimburse|compensate|indemnify)\b", r"\b(?:what is (?:covered|insured)|che cosa è assicurato)\b"),
    "definition": (r"\b(?:means|defined as|refers to|definition)\b", r"\b(?:significa|definito come|si riferisce a)\b"),
}
CAPS_DEFINITION = r"^[A-Z][A-Z\s]+:"
# Beginnings of clauses: the first three as written, the others in any case.
CLAUSES = (r"^\s*[a-z]\)\s+", r"^\s*\d+\.\s+", r"^\s*[A-Z]\.\s+")
CLAUSES_ANY_CASE = (r"^\s*\bArticle\s+\d+\b", r"^\s*\bSection\s+[A-Z]\b")
CONTINUES = ("and", "or", "but", "however", "provided that", "subject to", "unless", "if", "when", "where")
CONTINUING = ("and", "or", "but", "however", "therefore", "thus")

ABBREVIATIONS = ("e.g.", "i.e.", "art.", "sec.", "etc.", "vs.", "cf.")
MORE_ABBREVIATIONS = ("art.", "sec.", "cap.", "par.", "e.g.", "i.e.", "vs.", "etc.", "cf.", "p.", "pp.", "vol.", "no.", "ltd.", "inc.", "corp.", "co.", "llc.", "spa.", "srl.")

# Section headings (any case), and words of a heading that give its type, first match.
HEADINGS = (
    r"^SECTION\s+[A-Z](?:\s*[-–]\s*.*)?$",
    r"^CHAPTER\s+\d+(?:\s*[-–]\s*.*)?$",
    r"^ART\.?\s*\d+(?:\.\d+)?(?:\s*[-–]\s*.*)?$",
    r"^ARTICLE\s+\d+(?:\.\d+)?(?:\s*[-–]\s*.*)?$",
    r"^SEZIONE\s+[A-Z](?:\s*[-–]\s*.*)?$",
    r"^CAPITOLO\s+\d+(?:\s*[-–]\s*.*)?$",
    r"^ARTICOLO\s+\d+(?:\.\d+)?(?:\s*[-–]\s*.*)?$",
    r"^(?:Che cosa è assicurato\?|What is insured\?).*$",
    r"^(?:Che cosa NON è assicurato\?|What is NOT insured\?).*$",
    r"^(?:Assistenza in Viaggio|Travel Assistance).*$",
    r"^(?:Spese mediche|Medical Expenses).*$",
    r"^(?:Bagaglio|Baggage).*$",
    r"^(?:Annullamento|Cancellation).*$",
    r"^(?:Interruzione|Interruption).*$",
    r"^(?:Ritardo|Delay).*$",
    r"^(?:Esclusioni|Exclusions).*$",
    r"^(?:Limitazioni|Limitations).*$",
    r"^(?:Ci sono limiti|Are there limits).*$",
)
HEADING_TYPES = {
    "section": ("section", "sezione"),
    "chapter": ("chapter", "capitolo"),
    "article": ("article", "articolo", "art"),
    "exclusions": ("esclusioni", "exclusions"),
    "coverage": ("assicurato", "insured", "covered"),
    "cancellation": ("annullamento", "cancellation"),
    "baggage": ("bagaglio", "baggage"),
    "medical": ("mediche", "medical"),
    "assistance": ("assistenza", "assistance"),
}
SUBSECTIONS = (r"^[a-z]\)\s+", r"^\d+\.\s+", r"^•\s+", r"^-\s+", r"^[A-Z]+\.\s+", r"^ARTICLE\s+\d+", r"^ART\.?\s+\d+")

# Terms of kinds of cover, by strategy.
SECTION_COVER = {
    "medical": ("mediche", "medical", "spese mediche", "health"),
    "baggage": ("bagaglio", "baggage", "luggage"),
    "cancellation": ("annullamento", "cancellation", "cancel"),
    "delay": ("ritardo", "delay", "flight delay"),
    "assistance": ("assistenza", "assistance", "help"),
    "exclusions": ("esclusioni", "exclusions", "not covered"),
    "definitions": ("definitions", "definizioni", "glossary"),
    "general_conditions": ("conditions", "condizioni", "terms"),
}
SMART_COVER = {
    "medical": ("medical", "mediche", "hospital", "doctor", "treatment"),
    "baggage": ("baggage", "bagaglio", "luggage", "suitcase"),
    "cancellation": ("cancellation", "annullamento", "cancel", "trip"),
    "delay": ("delay", "ritardo", "late", "postpone"),
    "assistance": ("assistance", "assistenza", "help", "support"),
    "exclusions": ("exclusion", "esclusione", "not covered", "except"),
    "definitions": ("definition", "definizione", "means", "refers to"),
}
SEMANTIC_COVER = {
    "medical": ("medical", "mediche", "hospital", "doctor", "treatment", "spese mediche"),
    "baggage": ("baggage", "bagaglio", "luggage", "suitcase", "bagagli"),
    "cancellation": ("cancellation", "annullamento", "cancel", "trip cancellation"),
    "delay": ("delay", "ritardo", "late", "postpone", "flight delay"),
    "assistance": ("assistance", "assistenza", "help", "support", "emergency"),
    "exclusions": ("exclusion", "esclusione", "not covered", "except", "excluded"),
    "definitions": ("definition", "definizione", "means", "refers to", "glossary"),
}

# Entities (any case) and relations between two words.
ENTITIES = {
    "coverage_type": (r"\b(?:medical|baggage|cancellation|delay|assistance)\s+(?:coverage|insurance)\b", r"\b(?:trip|travel|flight)\s+(?:cancellation|interruption|delay)\b"),
    "monetary_amount": (r"(?:€|EUR|CHF|USD)\s*\d+(?:,\d{3})*(?:\.\d{2})?", r"\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:€|EUR|CHF|USD)"),
    "person_type": (r"\b(?:insured|policyholder|beneficiary|traveler|companion)\b", r"\b(?:spouse|children|family member|relative)\b"),
    "condition": (r"\b(?:if|when|provided that|subject to|in case of)\b", r"\b(?:must|shall|required|mandatory)\b"),
    "exclusion": (r"\b(?:excluded|not covered|exception|limitation)\b", r"\b(?:does not apply|not eligible)\b"),
    "time_period": (r"\b\d+\s*(?:hours?|days?|weeks?|months?)\b", r"\b(?:within|after|before|during)\s*\d+\s*(?:hours?|days?)\b"),
}
SENTENCE_ENTITIES = {
    "coverage_type": ENTITIES["coverage_type"],
    "monetary_amount": ENTITIES["monetary_amount"],
    "condition": ENTITIES["condition"][:1],
    "exclusion": ENTITIES["exclusion"][:1],
}
RELATIONS = {
    "covers": r"(\w+)\s+(?:covers?|includes?)\s+(\w+)",
    "excludes": r"(\w+)\s+(?:excludes?|does not cover)\s+(\w+)",
    "requires": r"(\w+)\s+(?:requires?|needs?)\s+(\w+)",
    "applies_to": r"(\w+)\s+(?:applies? to|for)\s+(\w+)",
    "limited_to": r"(\w+)\s+(?:limited to|up to)\s+(\w+)",
}

# Typed headings of hybrid sections (any case), cross-references, and what makes one important.
HYBRID_HEADINGS = (
    (r"^SECTION\s+[A-Z](?:\s*[-–]\s*(.*))?$", "section"),
    (r"^CHAPTER\s+\d+(?:\s*[-–]\s*(.*))?$", "chapter"),
    (r"^ARTICLE?\s*\d+(?:\.\d+)?(?:\s*[-–]\s*(.*))?$", "article"),
    (r"^SEZIONE\s+[A-Z](?:\s*[-–]\s*(.*))?$", "section"),
    (r"^CAPITOLO\s+\d+(?:\s*[-–]\s*(.*))?$", "chapter"),
    (r"^ARTICOLO?\s*\d+(?:\.\d+)?(?:\s*[-–]\s*(.*))?$", "article"),
    (r"^(?:What is |Che cosa è )?(?:insured|assicurato|covered|coperto).*\??$", "coverage"),
    (r"^(?:What is NOT |Che cosa NON è )?(?:insured|assicurato|covered|coperto).*\??$", "exclusion"),
    (r"^(?:Exclusions?|Esclusioni?)(?:\s*[-–]\s*(.*))?$", "exclusion"),
    (r"^(?:Definitions?|Definizioni?)(?:\s*[-–]\s*(.*))?$", "definition"),
    (r"^\s*[a-z]\)\s+(.*)$", "subsection"),
    (r"^\s*\d+\.\s+(.*)$", "subsection"),
    (r"^\s*[A-Z]\.\s+(.*)$", "subsection"),
    (r"^\s*[-•]\s+(.*)$", "subsection"),
)
REFERENCES = (
    r"(?:see|vedere|cfr\.?)\s+(?:article|articolo|section|sezione)\s+(\d+(?:\.\d+)?)",
    r"(?:as per|secondo|come da)\s+(?:article|articolo|section|sezione)\s+(\d+(?:\.\d+)?)",
    r"(?:refer to|riferimento a)\s+(?:article|articolo|section|sezione)\s+(\d+(?:\.\d+)?)",
)
IMPORTANT = ("exclusion", "condition", "requirement", "limit", "deductible")
COVERS = ("covered", "insured", "coperto", "assicurato", "guarantee", "benefit")
KEY_TERMS = ("must", "shall", "covered", "not covered", "excluded", "required", "maximum", "limit", "€", "eur", "chf")

# Words that speak for a language.
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "is", "by", "with", "for"),
    "it": ("il", "di", "che", "e", "per", "con", "non", "del"),
    "fr": ("le", "la", "de", "et", "les", "des", "un", "du"),
    "de": ("der", "die", "das", "und", "ist", "den", "mit", "von"),
    "es": ("el", "los", "las", "y", "en", "que", "con", "una"),
}
