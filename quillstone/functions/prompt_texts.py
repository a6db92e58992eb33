"""Prompt templates by name. The names and placeholders are fixed values; the texts are our own."""

from __future__ import annotations

# Names of answer prompts, of relevance prompts and of verification prompts.
ANSWER_NAMES = (
    "standard", "detailed", "precise", "precise_v2", "precise_v2_1", "precise_v2_2", "precise_v3", "precise_v4",
    "precise_v2_qwen", "precise_v3_qwen", "precise_v4_qwen", "precise_v3_phi-4_v2", "precise_v5", "precise_v5_qwen",
)
RELEVANCE_NAMES = ("relevance_filter_v1", "relevance_filter_v2")
VERIFICATION_NAMES = ("phi4", "qwen")
ELIGIBILITY = ("Yes", "No - Unrelated event", "No - condition(s) not met")

_TASK = "You judge claims against the passages of one insurance policy."
_SHAPE = '{"answer": {"eligibility": "' + "|".join(ELIGIBILITY) + '", "outcome_justification": "<words of the passages, or empty>", "payment_justification": "<words of the passages that state a sum, or null>"}}'
_JSON = "Reply with one JSON object of this form and nothing else:\n" + _SHAPE
_PARTS = "{{PERSONA}}\nQuestion: {{QUESTION}}\nPassages:\n{{CONTEXT}}"
_VERBATIM = "Quote passages word for word; do not shorten, join or reword them."
_STEPS = "First find passages on the event. Without any, the event is unrelated. Then test each condition they name against the question. Only then decide."
_CONDITIONS = "If a passage covers the event but the question shows that a stated condition fails, choose the third outcome and quote that condition."
_EXCLUSIONS = "An exclusion that fits the event outweighs a cover that fits it."
_SUMS = "Give a sum only if a passage states it for this very cover: limits, shares and deductibles count as sums."
_SILENT = "Think in silence: no notes before or after the object."
_CHAT = "Obey this order strictly: read the passages, decide, write the object."

ANSWERS = {
    "standard": (_TASK, _JSON),
    "detailed": (_TASK, _STEPS, _CONDITIONS, _SUMS, _JSON),
    "precise": (_TASK, _VERBATIM, _JSON),
    "precise_v2": (_TASK, _VERBATIM, _CONDITIONS, _JSON),
    "precise_v2_1": (_TASK, _VERBATIM, _CONDITIONS, _SUMS, _JSON),
    "precise_v2_2": (_TASK, _VERBATIM, _CONDITIONS, _EXCLUSIONS, _SUMS, _JSON),
    "precise_v3": (_TASK, _STEPS, _VERBATIM, _CONDITIONS, _SUMS, _JSON),
    "precise_v4": (_TASK, _STEPS, _VERBATIM, _CONDITIONS, _EXCLUSIONS, _SUMS, _JSON),
    "precise_v2_qwen": (_CHAT, _TASK, _VERBATIM, _CONDITIONS, _SILENT, _JSON),
    "precise_v3_qwen": (_CHAT, _TASK, _STEPS, _VERBATIM, _CONDITIONS, _SILENT, _JSON),
    "precise_v4_qwen": (_CHAT, _TASK, _STEPS, _VERBATIM, _CONDITIONS, _EXCLUSIONS, _SUMS, _SILENT, _JSON),
    "precise_v3_phi-4_v2": (_TASK, _STEPS, _VERBATIM, _CONDITIONS, _SUMS, _SILENT, _JSON),
    "precise_v5": (_TASK, _STEPS, _VERBATIM, _EXCLUSIONS, _CONDITIONS, _SUMS, _SILENT, _JSON),
    "precise_v5_qwen": (_CHAT, _TASK, _STEPS, _VERBATIM, _EXCLUSIONS, _CONDITIONS, _SUMS, _SILENT, _JSON),
}
_RELEVANCE_SHAPE = 'Reply with {"is_relevant": true or false, "reason": "<one sentence>"} and nothing else.'
RELEVANCE = {
    "relevance_filter_v1": ("Could any insurance policy of this kind say something on the question? Judge the subject, not the cover.", _RELEVANCE_SHAPE),
    "relevance_filter_v2": ("Decide whether the passages and the question share a subject. Greetings, thanks and questions on other matters do not.", "In doubt, answer true.", _RELEVANCE_SHAPE),
}
_VERIFY_SHAPE = _SHAPE[:-1] + ', "verification": {"status": "confirmed|corrected", "changes_made": "<what was changed, or none>"}}'
_VERIFY_PARTS = "Question: {{USER_QUESTION}}\nPassages:\n{{POLICY_CONTEXT}}\nEarlier answer:\n{{PREVIOUS_RESULT}}"
_VERIFY = "Check an earlier answer to a claim. A quotation that is not in the passages word for word is emptied; a sum that is not becomes null; an approval that nothing supports becomes unrelated."
VERIFICATION = {
    "phi4": (_VERIFY, "Leave a right answer as it is and say confirmed, otherwise say corrected.", "Reply with one JSON object:\n" + _VERIFY_SHAPE),
    "qwen": (_CHAT, _VERIFY, "Say confirmed if nothing changes and corrected if anything does.", _SILENT, "Reply with one JSON object:\n" + _VERIFY_SHAPE),
}


def get_prompt(name: str) -> str:
    """The template of that name, with its placeholders. An unknown name is an error that lists the known ones."""
    if name in ANSWERS:
        return "\n".join(ANSWERS[name]) + "\n" + _PARTS
    if name in RELEVANCE:
        return "\n".join(RELEVANCE[name]) + "\nQuestion: {{QUESTION}}\nPassages:\n{{CONTEXT}}"
    raise ValueError(f"no prompt {name!r}; there are {', '.join((*ANSWERS, *RELEVANCE))}")


def prompt_or_standard(name: str) -> str:
    return get_prompt(name if name in ANSWERS or name in RELEVANCE else "standard")


def verification_prompt(model: str) -> str:
    """By family of the model's name; the first kind for others."""
    kind = "qwen" if "qwen" in model.lower() and "phi" not in model.lower() else "phi4"
    return "\n".join(VERIFICATION[kind]) + "\n" + _VERIFY_PARTS
