"""Scores as columns: ranking, standing, admission, forgetting, tools, lexical entailment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge.functions import text as t

# Fixed values.
BM25_K1, BM25_B, BM25_LENGTH = 1.2, 0.75, 256.0
RRF_K, MEMORY_FUSION_K = 60, 10
MEMORY_ARM_WEIGHTS = {"colbert": 6.0, "colbert_ctx": 2.0}
TYPE_PRIORS = {
    "policy": 0.85, "shared": 0.75, "belief": 0.8, "entity_summary": 0.8, "observation": 0.7, "knowledge_rag": 0.7, "skill": 0.75, "task": 0.6, "work": 0.6, "episodic": 0.55,
    "outcome": 0.6, "failure": 0.65, "artifact": 0.5, "agent": 0.45, "tool": 0.35, "conversation": 0.3, "working": 0.2, "summary": 0.6, "derived": 0.6, "custom": 0.6,
}
NOVELTY = {"create": 1.0, "supersede": 0.9, "update": 0.85, "contradict": 0.9, "merge": 0.5, "reinforce": 0.25, "ignore": 0.0}
LIFETIME_WEIGHTS = {"long_term": 1.0, "short_term": 0.65, "archival": 0.4, "ephemeral": 0.2}
ADMISSION = {"worthiness": 0.35, "confidence": 0.3, "score": 0.4, "band": 0.08}
ANTONYMS = [
    (
        "increase increased increases increasing rise rises rose risen rising grew grow grows growth higher up gain gains gained improved improve improves improvement",
        "decrease decreased decreases decreasing fall falls fell fallen falling decline declined declines drop dropped drops shrank shrink lower down loss losses lost worsened worsen deteriorated",
    ),
    ("profit profits profitable", "loss losses unprofitable"),
    ("approved approve approves approval accepted accept", "rejected reject rejects denied"),
    ("more", "less fewer"),
    ("above exceeded exceed exceeds", "below missed miss misses"),
    ("won win wins", "lost lose loses"),
    ("opened open opens", "closed close closes"),
    ("started start starts began begin", "ended end ends"),
    ("true correct", "false incorrect"),
    ("always", "never"),
    ("positive", "negative"),
    ("faster", "slower"),
    ("expanded expand expands", "contracted contract contracts"),
]
# Ends of fixed values.


def lookup(values: dict[str, float], key: Column, other: float) -> Column:
    """A fixed table's value for a key."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def bm25_weight(tf: Column, length: Column) -> Column:
    """A term's weight in a document, against a fixed mean length."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / BM25_LENGTH))


def idf(n: Column, df: Column) -> Column:
    """The inverse document frequency that search servers use with BM25."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_idf(n: Column, df: Column) -> Column:
    """Weight of a question's word over the messages that are read."""
    return F.log(1 + (n + 1) / (1 + df))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where a norm is 0 or lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def standing_factor(confidence: Column, reinforcement: Column) -> Column:
    """The bounded factor that a memory's confidence and reinforcement put on its score."""
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(confidence)
    shift = 0.3 * (sure - 0.5) + 0.03 * F.log2(F.greatest(F.lit(1), F.coalesce(reinforcement, F.lit(1))).cast("double"))
    return 1 + F.greatest(F.lit(-0.15), F.least(F.lit(0.15), shift))


def forgetting_score(importance: Column, idle_days: Column, uses: Column, half_life: float = 30.0) -> Column:
    """Importance, halved every half life of disuse, times what use has strengthened."""
    return F.round(F.greatest(importance, F.lit(0.0)) * F.pow(F.lit(0.5), F.greatest(idle_days, F.lit(0.0)) / half_life) * (1 - F.pow(F.lit(0.5), uses.cast("double"))), 6)


def recency(age_days: Column) -> Column:
    """1 now, falling in a line to a half after a year."""
    return F.greatest(F.lit(0.5), 1 - 0.5 * F.greatest(age_days, F.lit(0.0)) / 365.0)


def worthiness(kind: Column, confidence: Column, hinted: Column, transient: Column, generic: Column) -> Column:
    base = 0.6 * lookup(TYPE_PRIORS, kind, 0.5) + 0.4 * confidence
    base = F.when(hinted, F.greatest(base, F.lit(0.8))).otherwise(base)
    return F.round(F.least(F.lit(1.0), base * F.when(transient, 0.4).otherwise(1.0) * F.when(generic, 0.5).otherwise(1.0)), 4)


def utility(lifetime: Column, importance: Column, age_days: Column) -> Column:
    return F.round(F.least(F.lit(1.0), lookup(LIFETIME_WEIGHTS, lifetime, 0.5) * F.greatest(importance, F.lit(0.05)) * recency(age_days)), 4)


def admission_score(worth: Column, decision: Column, confidence: Column, use: Column) -> Column:
    return F.round(0.4 * worth + 0.2 * lookup(NOVELTY, decision, 0.5) + 0.2 * F.round(confidence, 4) + 0.2 * use, 4)


def admission_verdict(worth: Column, decision: Column, confidence: Column, score: Column, bounds=ADMISSION) -> Column:
    """ADMIT, DEFER or REJECT, by the first rule that holds."""
    return (
        F.when(worth < bounds["worthiness"], "REJECT")
        .when(F.round(confidence, 4) < bounds["confidence"], "REJECT")
        .when(decision.isin("reinforce", "merge"), "ADMIT")
        .when(score < bounds["score"] - bounds["band"], "REJECT")
        .when(score < bounds["score"], "DEFER")
        .otherwise("ADMIT")
    )


def tool_score(relevance: Column, rate: Column, in_plan: Column, is_next: Column, recent: Column) -> Column:
    return relevance * (1 + 0.5 * (rate - 0.5)) + 0.5 * in_plan.cast("double") + 1.0 * is_next.cast("double") + 0.1 * recent.cast("double")


def tool_confidence(score: Column) -> Column:
    return 1 - F.exp(-score)


def confidence_after(start: Column, steps: Column) -> Column:
    """Confidence after each step in turn, held between .05 and 1 at every one."""
    return F.aggregate(steps, start.cast("double"), lambda c, d: F.least(F.lit(1.0), F.greatest(F.lit(0.05), c + d)))


def procedure_status(support: Column, rate: Column, idle_days: Column, rejected: Column) -> Column:
    """A rejected plan stays so; a decayed one retires; two runs and six tenths of success make it active."""
    decayed = (rate < 0.5) | (F.coalesce(idle_days, F.lit(0.0)) > 60)
    return F.when(rejected, "rejected").when(decayed, "retired").when((support >= 2) & (rate >= 0.6), "active").otherwise("candidate")


def polarity_conflict(claim: Column, evidence: Column) -> Column:
    """A word of the claim has its opposite in the evidence, which lacks the word itself, and the claim lacks the opposite."""
    opposite: dict[str, set[str]] = {}
    for left, right in ANTONYMS:
        for a, b in ((left.split(), right.split()), (right.split(), left.split())):
            for w in a:
                opposite.setdefault(w, set()).update(b)
    table = F.create_map(*(x for w, o in sorted(opposite.items()) for x in (F.lit(w), t.words_in(sorted(o)))))
    none = F.array().cast("array<string>")

    def clashes(w: Column) -> Column:
        other = F.coalesce(F.try_element_at(table, w), none)
        return F.arrays_overlap(other, evidence) & ~F.array_contains(evidence, w) & ~F.arrays_overlap(other, claim)

    return F.exists(claim, clashes)


def number_conflict(claim: Column, evidence: Column) -> Column:
    """Each side has a number that the other lacks."""
    return (F.size(F.array_except(claim, evidence)) > 0) & (F.size(F.array_except(evidence, claim)) > 0)


def grounding_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({t.GROUNDING_WORD})"), 1)


def conflict_names(claim: Column, evidence: Column) -> Column:
    """Which of number, negation and polarity a claim and a text differ in."""
    found = F.array(
        F.when(number_conflict(t.number_values(claim), t.number_values(evidence)), "number"),
        F.when(t.has_negation(claim, t.GROUNDING_NEGATIONS) != t.has_negation(evidence, t.GROUNDING_NEGATIONS), "negation"),
        F.when(polarity_conflict(grounding_words(claim), grounding_words(evidence)), "polarity"),
    )
    return F.array_compact(found)


def lexical_nli(premise: Column, claim: Column) -> Column:
    """A struct of entailment, neutral and contradiction from shared words and named conflicts."""
    share = t.coverage(claim, premise)
    clash = (share >= 0.5) & (F.size(conflict_names(claim, premise)) > 0)
    against = F.when(clash, F.least(F.lit(0.95), 0.6 + 0.35 * share)).otherwise(F.round(0.05 * (1 - share), 4))
    for_ = F.when(clash, F.round((1 - F.least(F.lit(0.95), 0.6 + 0.35 * share)) * 0.2, 4)).otherwise(F.least(F.lit(0.95), F.round(share, 4)))
    blank = F.size(t.content_tokens(claim)) == 0
    e, c = F.when(blank, 0.0).otherwise(for_), F.when(blank, 0.0).otherwise(against)
    return F.struct(e.alias("entailment"), F.round(1 - e - c, 4).alias("neutral"), c.alias("contradiction"))
