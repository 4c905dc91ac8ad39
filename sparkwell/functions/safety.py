"""Guardrails: patterns that block, rewrite or warn, alone and in a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Case-insensitive patterns of attempts to override instructions.
INJECTION = (
    r"ignore.*previous.*instructions", r"forget.*previous.*prompt", r"system.*prompt", r"skip.*to.*next", r"\[inst\]", r"\[/inst\]", r"<system>",
    r"</system>", r"role.*switch", r"act.*as", r"pretend.*to.*be", r"jailbreak", r"do.*anything.*now",
)
#: Of attempts to leave the assistant's role.
JAILBREAK = (
    r"you.*are.*now", r"forget.*who.*you.*are", r"no.*longer.*bound", r"pretend.*you.*don't.*know", r"as.*an.*ai.*you.*should", r"let's.*roleplay", r"simulate.*being",
)
#: Of attempts to read the prompt.
LEAKAGE = (
    r"what.*system.*prompt", r"what.*are.*your.*instructions", r"show.*me.*prompt", r"reveal.*system.*message", r"what.*are.*your.*rules", r"how.*are.*you.*programmed",
    r"what.*are.*your.*constraints", r"system.*prompt.*now",
)
#: Of instructions hidden in documents.
EMBEDDED = (
    r"\[inst\]", r"\[/inst\]", r"<inst>", r"</inst>", r"instruction override:", r"ignore.*previous.*content", r"execute.*this.*command", r"system.*command:", r"hidden.*instruction:",
)
#: Personal data in the order it is replaced.
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "cpf": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "creditCard": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
}


def matched(text: Column, patterns) -> Column:
    """Array of the patterns that match, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in patterns]))


#: Where a match of a kind can begin: at the first letter of a run of its letters, or after the match before. Else each letter of a long run is tried.
BEGINS = {"email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))"}


def without_pii(text: Column) -> Column:
    """Struct (kinds, redacted): kinds are looked for in the text itself, replacements follow each other."""
    patterns = {kind: BEGINS.get(kind, "") + pattern for kind, pattern in PII.items()}
    kinds = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]))
    redacted = text
    for kind, pattern in patterns.items():
        redacted = F.regexp_replace(redacted, pattern, f"[REDACTED_{kind.upper()}]")
    return F.struct(kinds.alias("kinds"), redacted.alias("redacted"))


def without_embedded(text: Column) -> Column:
    """The text with instructions hidden in it replaced."""
    for pattern in EMBEDDED:
        text = F.regexp_replace(text, f"(?i){pattern}", "[CONTENT_SANITIZED]")
    return text


def unsupported_length(answer: Column, context: Column, role: Column) -> Column:
    """Whether an assistant's answer is over three times as long as its context and never refers to it."""
    refers = answer.rlike(r"(?i)according to|based on|the document|retrieved|source|cited")
    return (role == "assistant") & (F.length(answer) > 3 * F.length(context)) & ~refers


#: The guardrails that block, in the order of the chain.
BLOCKS = {"prompt-injection": INJECTION, "jailbreak": JAILBREAK, "prompt-leakage": LEAKAGE}


def guard(texts: DataFrame, text: str = "text", *, blocks: dict = BLOCKS, stop: bool = False, context: str | None = None, role: Column | None = None) -> DataFrame:
    """Adds ``blocked_by``, ``sanitized``, ``warned`` and ``decision`` by the chain of all guardrails.

    Later guardrails see what earlier ones left. Of several that block the last one is named, or with ``stop`` the first, after which nothing is
    sanitised. With a ``context``, answers (of ``role``, the assistant if none is given) that are long beside it and name no source are
    warned of. Decision: block, else sanitize if the text changed, else review if there is a warning, else allow.
    """
    blocker = F.lit(None).cast("string")
    for name, patterns in reversed(blocks.items()) if stop else blocks.items():
        blocker = F.when(F.size(matched(F.col(text), patterns)) > 0, name).otherwise(blocker)
    clean = without_pii(without_embedded(F.col(text)))["redacted"]
    guarded = texts.withColumn("blocked_by", blocker)
    guarded = guarded.withColumn("sanitized", F.when(F.col("blocked_by").isNotNull(), F.col(text)).otherwise(clean) if stop else clean)
    warned = F.lit(False) if context is None else unsupported_length(F.col(text), F.col(context), F.lit("assistant") if role is None else role)
    guarded = guarded.withColumn("warned", warned)
    decision = F.when(F.col("blocked_by").isNotNull(), "block").when(F.col("sanitized") != F.col(text), "sanitize").when(F.col("warned"), "review").otherwise("allow")
    return guarded.withColumn("decision", decision)
