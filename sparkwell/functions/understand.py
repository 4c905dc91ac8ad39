"""Rules over the words of a query: intent, rewriting, expansion, retrieval plan, model routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc, rounded, stem, trimmed, words

#: Words that rewriting drops.
FILLERS = (
    "please tell me about can you could would should what is are was were how do does did the a an i my in on at to for of with"
    " just want know need give explain describe"
).split()

#: What a word of a query is expanded with.
SYNONYMS = {
    "rag": ["retrieval augmented generation", "retrieval-augmented generation"],
    "llm": ["large language model", "language model", "language model inference"],
    "embedding": ["embedding vector", "vector representation", "semantic vector"],
    "chunk": ["document chunk", "text chunk", "segment"],
    "vector": ["embedding", "vector representation"],
    "retrieval": ["document retrieval", "information retrieval", "search"],
    "inference": ["model inference", "llm inference", "generation"],
    "fine": ["fine-tuning", "finetuning", "model fine-tuning"],
    "tuning": ["fine-tuning", "finetuning"],
    "lora": ["low-rank adaptation", "parameter-efficient fine-tuning"],
    "quantization": ["model quantization", "weight quantization", "int8", "int4"],
    "grounding": ["grounded generation", "factual grounding", "source grounding"],
    "hallucination": ["hallucination", "confabulation", "factual error"],
    "cosine": ["cosine similarity", "dot product similarity"],
    "similarity": ["cosine similarity", "semantic similarity", "vector similarity"],
    "token": ["input token", "output token", "tokenization"],
    "context": ["context window", "prompt context", "input context"],
    "prompt": ["prompt template", "instruction", "system prompt"],
    "agent": ["ai agent", "autonomous agent", "planning agent"],
    "memory": ["conversation memory", "episodic memory", "long-term memory"],
    "evaluation": ["eval", "evaluation", "benchmark", "assessment"],
    "eval": ["evaluation", "benchmark", "quality assessment"],
}

#: Intents in the order they are tried, with their patterns and confidences.
INTENTS = (
    ("comparative", r"\b(vs|versus|compared to|compare|difference between|better than|worse than|pros and cons|trade.?off)\b", 0.9),
    ("procedural", r"\b(how (do|to|can|should|would)|steps (to|for)|guide (to|for)|implement|configure|set up|install|create|build|run|execute|deploy)\b", 0.85),
    ("factual", r"\b(what (is|are|was|were)|define|definition|explain|meaning( of)?|describe)\b|^(what|who|where|when|which)\b", 0.8),
    ("exploratory", r"\b(tell me about|overview|survey|summary of|all about|explore|learn about|understand)\b", 0.75),
)

#: Patterns of the retrieval plan's categories.
CATEGORIES = {
    "factual": r"\b(what|who|where|when|which|define|explain)\b",
    "conversational": r"\b(hello|hi|hey|thanks|thank you|good morning|good afternoon)\b",
    "memory": r"\b(previous|earlier|last time|before|remember)\b",
    "analytical": r"\b(compare|trade.?off|analy[sz]e|pros and cons|impact|difference)\b",
    "summarization": r"\b(summarize|summary|overview|tldr)\b",
    "relational": r"\b(relat|depend|connected|link|graph|path|why does|how does)\b",
}

#: Keywords of routing, found inside words too.
ROUTING = {
    "reasoning": ["why", "explain", "compare", "tradeoff", "reason", "because", "how", "difference"],
    "ambiguous": ["maybe", "could", "might", "or", "versus", "unclear"],
    "comparative": ["compare", "vs", "versus", "better", "worse", "difference"],
    "procedural": ["steps", "how to", "implement", "configure", "setup", "run"],
}


def rewrite(query: Column) -> Column:
    """The query lower-cased without punctuation and filler words; null if nothing remains or nothing changed."""
    plain = F.regexp_replace(F.lower(nfkc(query)), r"[^a-z0-9_\s'-]", " ")
    kept = F.filter(F.split(trimmed(plain), r"\s+"), lambda w: (w != "") & ~w.isin(FILLERS))
    text = F.array_join(kept, " ")
    return F.when((text != "") & (text != F.lower(trimmed(query))), text)


def expand(query: Column) -> Column:
    """Synonyms of the query's words or of their stems, each once, in order."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of = lambda w: F.coalesce(table[w], table[stem(w)], F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(words(query), of)))


def intent(query: Column) -> Column:
    """Struct (intent, confidence) by the first pattern that matches; an empty query is unknown with 0."""
    found = F.struct(F.lit("unknown").alias("intent"), F.lit(0.5).alias("confidence"))
    for name, pattern, confidence in reversed(INTENTS):
        found = F.when(query.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return F.when(trimmed(query) == "", F.struct(F.lit("unknown").alias("intent"), F.lit(0.0).alias("confidence"))).otherwise(found)


def processed(query: Column, given: Column | None = None) -> Column:
    """Struct (original, rewritten, expanded, intent, confidence) of a query: trimmed, rewritten, expanded as rewritten, its intent told from the original.

    An intent that the caller gives takes the place of the one found, if there is such an intent; the confidence stays that of what was found. An empty
    or null query is unknown with 0, without expansions.
    """
    text = trimmed(F.coalesce(query, F.lit("")))
    found = intent(text)
    kind = found["intent"] if given is None else F.when(given.isin(*[name for name, _, _ in INTENTS], "unknown") & (text != ""), given).otherwise(found["intent"])
    more = F.when(text != "", expand(F.coalesce(rewrite(text), text))).otherwise(F.array().cast("array<string>"))
    return F.struct(text.alias("original"), rewrite(text).alias("rewritten"), more.alias("expanded"), kind.alias("intent"), found["confidence"].alias("confidence"))


def plan(query: Column, graph: bool = True, raptor: bool = True, hyde: bool = True, grounded: bool = True) -> Column:
    """Struct (complexity, ambiguity, risk, mode, execution_mode) of the retrieval that suits a query."""
    has = {name: query.rlike(f"(?i){pattern}") for name, pattern in CATEGORIES.items()}
    n = F.size(words(query))
    heavy = (n >= 8) | has["analytical"] | has["summarization"]
    nothing = ~(has["factual"] | has["conversational"] | has["memory"] | has["relational"] | heavy)
    low_risk = has["conversational"] | nothing
    high = (n >= 11) | has["analytical"] | has["summarization"] | (has["relational"] & heavy)
    complexity = F.when(high, "high").when((n >= 7) | has["relational"], "medium").otherwise("low")
    one = lambda flag, x: F.when(flag, x).otherwise(0.0)
    ambiguity = F.least(F.lit(1.0), F.when(n <= 4, 0.35).otherwise(0.1) + one(query.rlike(r"(?i)\b(it|this|that|they|them)\b"), 0.35) + one(has["memory"], 0.15))
    risk = F.least(F.lit(1.0), F.when(has["factual"], 0.45).otherwise(0.1) + one(has["relational"], 0.25) + one(has["analytical"], 0.2) + one(low_risk, -0.15))
    mode = (
        F.when(has["relational"] & F.lit(graph), "FULL_PIPELINE" if hyde else "GRAPH_RAG")
        .when(has["analytical"] & F.lit(graph and raptor), "FULL_PIPELINE")
        .when(has["factual"] & (rounded(ambiguity, 6) >= 0.35) & F.lit(hyde), "HYDE_RAG")
        .when(heavy, "HYBRID_RAG")
        .when(has["conversational"] & low_risk, "DIRECT_LLM")
        .otherwise("STANDARD_RAG")
    )
    run = F.when((mode == "DIRECT_LLM") & F.lit(grounded), "STANDARD_RAG").otherwise(mode)
    return F.struct(
        complexity.alias("complexity"), rounded(ambiguity, 6).alias("ambiguity"), rounded(risk, 6).alias("risk"), mode.alias("mode"), run.alias("execution_mode")
    )


def cost_level(complexity: Column, explicit: Column | None = None) -> Column:
    """How much a plan costs: by an estimate, if there is one, or by the query's complexity."""
    given = F.lit(0.0) if explicit is None else F.coalesce(explicit, F.lit(0.0))
    return F.when((given >= 0.7) | (complexity == "high"), "high").when((given >= 0.3) | (complexity == "medium"), "medium").otherwise("low")


def retrieval_query(query: Column, memory: Column | None = None) -> Column:
    """What is searched for: the query rewritten, or as it is, then its expansions, then what memory adds."""
    used = F.coalesce(rewrite(query), trimmed(query))
    return trimmed(F.concat_ws(" ", used, F.array_join(expand(used), " "), F.lit("") if memory is None else memory))


def routing_features(query: Column) -> Column:
    """Struct (tokens, reasoning, ambiguous, comparative, procedural, intent, complexity)."""
    low = F.lower(trimmed(query))
    has = {}
    for name, keys in ROUTING.items():
        flag = F.lit(False)
        for key in keys:
            flag = flag | low.contains(key)
        has[name] = flag
    tokens = F.greatest(F.lit(1), F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")))
    one = lambda flag, x: F.when(flag, x).otherwise(0.0)
    score = F.least(F.lit(1.0), tokens / 28 + one(has["reasoning"], 0.28) + one(has["ambiguous"], 0.2) + one(has["comparative"], 0.2))
    kind = F.when(has["comparative"], "comparative").when(has["procedural"], "procedural").when(has["ambiguous"], "ambiguous").when(has["reasoning"], "reasoning").otherwise("simple")
    return F.struct(tokens.alias("tokens"), *[has[n].alias(n) for n in ROUTING], kind.alias("intent"), rounded(score, 3).alias("complexity"))


#: The models that routing chooses among.
CHEAP, BALANCED, STRONG = "local-extractive", "ollama", "groq"


def route(features: Column, cheap: Column | None = None, quality: Column | None = None, forced: Column | None = None) -> Column:
    """The model that suits the features, before anything is retrieved; one of the three that is ``forced`` goes before all else."""
    no = F.lit(False)
    return (
        F.when(F.lit(None).isin(CHEAP) if forced is None else forced.isin(CHEAP, BALANCED, STRONG), forced if forced is not None else F.lit(None).cast("string"))
        .when(no if cheap is None else cheap, CHEAP).when(no if quality is None else quality, STRONG)
        .when((features["tokens"] <= 10) & (features["complexity"] < 0.35), CHEAP)
        .when(features["reasoning"] | features["comparative"], STRONG)
        .otherwise(BALANCED)
    )


def refine(model: Column, top: Column, spread: Column, ratio: Column, docs: Column, n: Column, kind: Column) -> Column:
    """Struct (model, triggers): a stronger model after weak retrieval, a cheaper one after strong retrieval for simple queries."""
    strong = (top >= 0.82) & (spread >= 0.18) & (ratio >= 0.8) & (kind == "simple")
    signs = {"weak-top-hit": top < 0.45, "tight-score-band": spread < 0.08, "low-grounded-ratio": ratio < 0.5, "narrow-evidence": (docs <= 1) & (n <= 2)}
    weak = F.lit(False)
    for sign in signs.values():
        weak = weak | sign
    told = F.array_compact(F.array(*[F.when(sign, name) for name, sign in signs.items()], F.when(strong, "high-confidence-retrieval")))
    return F.struct(F.when(weak, STRONG).when(strong, CHEAP).otherwise(model).alias("model"), told.alias("triggers"))


def cache_threshold(query: Column, kind: Column, variance: Column, quality: Column) -> Column:
    """Similarity that a cached answer needs: more for short factual queries, less for vague or long ones, more where cached answers were poor."""
    tokens = F.size(F.filter(F.split(trimmed(query), r"\s+"), lambda w: w != ""))
    base = (
        F.when(kind.isin("factual", "procedural") & (tokens <= 10) & (variance <= 0.45), 0.95)
        .when(kind.isin("unknown", "exploratory", "comparative") | (tokens > 18) | (variance >= 0.65), 0.85)
        .otherwise(0.9)
    )
    return rounded(F.when(quality < 0.45, F.least(F.lit(0.97), base + 0.03)).otherwise(base), 2)


def routing_confidence(features: Column, model: Column, top: Column | None = None, spread: Column | None = None) -> Column:
    """How sure routing is of its model: more for clear intents, less for a cheap model and a complex query, moved a little by what was retrieved."""
    kind = features["intent"]
    boost = F.when(kind == "simple", 0.2).when(kind.isin("reasoning", "comparative"), 0.28).otherwise(0.18)
    penalty = F.when((model == CHEAP) & (features["complexity"] > 0.5), 0.2).otherwise(0.0)
    seen = F.lit(0.0) if top is None else F.greatest(F.lit(-0.12), F.least(F.lit(0.12), top * 0.1 + spread * 0.08))
    return rounded(F.greatest(F.lit(0.4), F.least(F.lit(0.98), F.lit(0.6) + boost - penalty + seen)), 2)
