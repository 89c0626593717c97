"""Word sets of rule-based extraction, and the table from word forms to verb lemmas."""

from __future__ import annotations

from collections.abc import Iterable

# The verbs that results must agree on.
BASE_VERBS = [
    "analyze", "approve", "archive", "ask", "assign", "book", "build", "call", "cancel", "close", "complete", "contact",
    "create", "delete", "deliver", "deploy", "download", "email", "escalate", "find", "hire", "launch", "make", "meet",
    "move", "notify", "open", "order", "pay", "plan", "process", "provide", "purchase", "read", "receive", "refund",
    "reject", "remind", "request", "resolve", "review", "run", "schedule", "send", "ship", "sign", "submit", "tell",
    "test", "train", "transfer", "update", "upload", "use", "want", "work", "write",
]
# Irregular forms and their verbs.
IRREGULAR = {
    "asked": "ask", "bought": "purchase", "built": "build", "called": "call", "cancelled": "cancel",
    "canceled": "cancel", "did": "do", "done": "do", "found": "find", "made": "make", "met": "meet", "paid": "pay",
    "ran": "run", "read": "read", "sent": "send", "told": "tell", "wrote": "write", "written": "write",
}
# Auxiliary verbs.
AUXILIARIES = [
    "am", "are", "be", "been", "being", "can", "could", "did", "do", "does", "had", "has", "have", "is", "may", "might",
    "must", "shall", "should", "was", "were", "will", "would",
]
# Determiners.
DETERMINERS = [
    "a", "an", "the", "this", "that", "these", "those",
]
# Discourse words.
DISCOURSE = [
    "also", "next", "now", "please", "then",
]
# Coordinators.
COORDINATORS = [
    "and", "but", "or", "then",
]
# Prepositions that open a qualifier.
PREPOSITIONS = [
    "after", "at", "before", "by", "during", "for", "from", "in", "into", "on", "through", "to", "with", "without",
]
# Signs that end a clause.
CLAUSE_PUNCTUATION = [
    ",", ";", ":", ".", "!", "?",
]
# Signs trimmed at the end.
TRAILING_PUNCTUATION = [
    ",", ";", ":", ".", "!", "?", ")", "]", "}",
]
# Signs trimmed at the beginning.
LEADING_PUNCTUATION = [
    ",", ";", ":", "(", "[", "{",
]
# Negation words.
NEGATIONS = [
    "never", "no", "not", "without",
]


def normalize_verbs(verbs: Iterable[str]) -> list[str]:
    """Additional verbs stripped, folded and without repeats; an empty one is an error."""
    cleaned = []
    for verb in verbs:
        if not isinstance(verb, str):
            raise TypeError("additional verbs must be strings")
        if not (folded := verb.strip().casefold()):
            raise ValueError("additional verbs cannot be empty")
        cleaned.append(folded)
    return list(dict.fromkeys(cleaned))


#: Endings in the order in which they are tried: ending, least length of the word, and the rules that give
#: lemmas from the word without the ending. "undouble" takes one of two equal last letters away.
ENDINGS = (
    ("ied", 4, ("+y",)),
    ("ing", 5, ("+", "+e", "undouble")),
    ("ed", 4, ("+e", "+", "undouble")),
    ("es", 4, ("+", "+e")),
    ("s", 3, ("+",)),
)


def lemma_of(form: str, vocabulary: set[str]) -> str | None:
    """The lemma of a form: irregular forms first, then the word itself, then the endings in order."""
    if form in IRREGULAR:
        return IRREGULAR[form] if IRREGULAR[form] in vocabulary else None
    if form in vocabulary:
        return form
    for ending, least, rules in ENDINGS:
        if not form.endswith(ending) or len(form) < least:
            continue
        stem = form.removesuffix(ending)
        for rule in rules:
            if rule != "undouble":
                candidate = stem + rule[1:]
            elif len(stem) > 2 and stem[-1] == stem[-2]:
                candidate = stem[:-1]
            else:
                continue
            if candidate in vocabulary:
                return candidate
    return None


def forms_of(verb: str) -> set[str]:
    """Every form that could have ``verb`` as its lemma."""
    forms = {verb} | {form for form, lemma in IRREGULAR.items() if lemma == verb}
    for ending, _, rules in ENDINGS:
        for rule in rules:
            if rule == "undouble":
                forms.add(verb + verb[-1] + ending)
            elif verb.endswith(rule[1:]):
                forms.add(verb.removesuffix(rule[1:]) + ending)
    return forms


def lexicon(additional_verbs: Iterable[str] = ()) -> dict[str, str]:
    """Form to lemma for the base verbs and the additional ones: the inverse of :func:`lemma_of`."""
    vocabulary = set(BASE_VERBS) | set(normalize_verbs(additional_verbs))
    table = {form: lemma_of(form, vocabulary) for verb in vocabulary for form in forms_of(verb)}
    return {form: lemma for form, lemma in sorted(table.items()) if lemma is not None}
