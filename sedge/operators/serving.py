"""A question's candidates from arms to answer: final scores, floors, exact hits, expansion, companions, bridges, gaps, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import text as t
from sedge.operators import retrieval

# Fixed values.
FUSION_K, SESSION, SPEAKER, TIME, PERIOD, SESSION_DEPTH = 10, 0.3, 1.0, 1.0, 3.0, 50
ARM_WEIGHTS = {"colbert": 6.0, "colbert_ctx": 2.0}
FLOOR, RELATED, UNDER_FLOOR = 0.20, 0.4, 5
EDGES = {"DEFINED_BY": (0.55, 0), "FOOTNOTE": (0.55, 1), "CROSS_REFERENCE": (0.5, 2), "PARENT": (0.35, 3), "PREVIOUS": (0.3, 4), "NEXT": (0.3, 4)}
REQUIRED = ["DEFINED_BY", "FOOTNOTE", "CROSS_REFERENCE"]
EXPANSION = 8
ASKED = {
    "phone": (r"(?i)\b(?:phone|telephone|call)\b.*\bnumber\b|\bphone\b", r"\+?\d[\d ()\-]{6,}\d"),
    "email": (r"(?i)\be-?mail\b", r"[\w.+-]+@[\w-]+\.[\w.]+"),
    "amount": (r"(?i)\bhow much\b|\b(?:price|cost|amount|budget)\b", r"\d"),
    "serial": (r"(?i)\b(?:serial|part|model) (?:number|no)\b", r"\b(?=\w*\d)[A-Z0-9][\w\-]{3,}\b"),
    "expiry": (r"(?i)\b(?:expir\w+|valid until|due)\b", r"\b(?:\d{4}-\d{2}-\d{2}|(?:19|20)\d{2})\b"),
}
GLOSSARY = {"sku": "stock keeping unit", "po": "purchase order", "oos": "out of stock", "aov": "average order value", "moq": "minimum order quantity", "eta": "estimated time of arrival"}
# Ends of fixed values.
#: Questions are numbered within groups of about so many.
QUERY_GROUP = 4096


def memory_scores(arms: DataFrame, facts: DataFrame) -> DataFrame:
    """query, id, score, rank: reciprocal ranks of arms by weight, the best of the session, and what speaks for an item.

    arms: query, arm, id, rank; facts: query, id, session, speaks, timed, dated (whether the question names the speaker, asks
    when and the text tells, or names a period that the text is in).
    """
    weight = F.create_map(*(F.lit(x) for kv in ARM_WEIGHTS.items() for x in kv))
    base = arms.groupBy("query", "id").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("arm")), F.lit(1.0)) / (FUSION_K + F.col("rank"))).alias("score"))
    best = retrieval.session_best(base.join(facts, ["query", "id"]), SESSION_DEPTH)
    unit = 1.0 / (FUSION_K + 1)
    total = F.col("score") + SESSION * F.col("session_best") + unit * (SPEAKER * F.col("speaks").cast("int") + TIME * F.col("timed").cast("int") + PERIOD * F.col("dated").cast("int"))
    scored = best.select("query", "id", F.round(total, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))))


def by_standing(ranked: DataFrame, factor: Column) -> DataFrame:
    """ranked again by score times standing; ties keep their place."""
    order = Window.partitionBy("query").orderBy(F.desc("weighed"), F.asc("rank"))
    return ranked.withColumn("weighed", F.round(F.col("score") * factor, 9)).withColumn("rank", F.row_number().over(order)).drop("weighed")


def current_first(ranked: DataFrame) -> DataFrame:
    """Earlier values behind all current ones, else in the order they had."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("earlier_value").cast("int"), "rank")))


def above_floor(items: DataFrame, floor: float = FLOOR) -> DataFrame:
    """query, id, rank, under of the items to pack: those near enough to the question, and if its best memory is close, the first few
    memories under the floor. items: query, id, rank, kind, similarity, companion, exact."""
    below = F.col("similarity").isNotNull() & (F.col("similarity") < floor) & ~F.col("companion") & ~F.col("exact")
    best = F.max(F.when(F.col("kind") == "memory", F.col("similarity"))).over(Window.partitionBy("query"))
    marked = items.withColumn("under", below).withColumn("best", F.coalesce(best, F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query", "under", "kind").orderBy("rank"))
    kept = marked.withColumn("n", place).where(~F.col("under") | ((F.col("kind") == "memory") & (F.col("best") >= RELATED) & (F.col("n") <= UNDER_FLOOR)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("under").cast("int"), "rank"))).select("query", "id", "rank", "under")


def exact_hits(queries: DataFrame, *tables: DataFrame) -> DataFrame:
    """query, id, kind, score 1 of rows whose identifier the question states. tables: id, kind."""
    named = queries.select("query", F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:chk|sum|mem|doc|ent|rel)_[0-9A-Za-z]{4,})\b"), 1)).alias("id")).distinct()
    rows = tables[0].select("id", "kind")
    for other in tables[1:]:
        rows = rows.union(other.select("id", "kind"))
    return named.join(rows, "id").select("query", "id", "kind", F.lit(1.0).alias("score"))


def selected(candidates: DataFrame, documents: list[str] | None = None, kinds: list[str] | None = None, observed: tuple | None = None) -> DataFrame:
    """Candidates of the selected documents and kinds, and of the observed range; those without a time are out of any range."""
    if documents:
        candidates = candidates.where(F.col("document").isNull() | F.col("document").isin(documents))
    if kinds:
        candidates = candidates.where(F.col("kind").isin(kinds))
    if observed:
        candidates = candidates.where(F.coalesce(F.col("observed_at").between(*(F.lit(x) for x in observed)), F.lit(False)))
    return candidates


def expanded(seeds: DataFrame, edges: DataFrame, texts: DataFrame, budget: int = EXPANSION) -> DataFrame:
    """query, id, edge, seed, score of neighbours that join a question's seeds: by kind of edge, then by seed; none twice, and none
    whose text is there already. seeds: query, id, rank; edges: src, dst, kind; texts: id, hash."""
    score = F.create_map(*(x for k, (v, _) in EDGES.items() for x in (F.lit(k), F.lit(v))))
    first = F.create_map(*(x for k, (_, p) in EDGES.items() for x in (F.lit(k), F.lit(p))))
    met = seeds.select("query", F.col("id").alias("seed"), "rank").join(edges.where(F.col("kind").isin(list(EDGES))), F.col("seed") == F.col("src"))
    have = seeds.join(texts, "id").select("query", "id", "hash")
    new = met.select("query", "seed", "rank", F.col("dst").alias("id"), F.col("kind").alias("edge")).join(texts, "id").join(have.select("query", "id"), ["query", "id"], "left_anti").join(have.select("query", "hash"), ["query", "hash"], "left_anti")
    order = [F.try_element_at(first, F.col("edge")), "rank", F.desc(F.try_element_at(score, F.col("edge"))), "id"]
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy("query", "hash").orderBy(*order))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= budget).select("query", "id", "edge", "seed", F.try_element_at(score, F.col("edge")).alias("score"), "place")


def _numbered(packed: DataFrame) -> DataFrame:
    """query, block, bit of every distinct question but null: 64 to a block as far as they go, the same numbers whenever they are computed."""
    asked = packed.where(F.col("query").isNotNull()).select("query").distinct()
    many = max(1, -(-asked.count() // QUERY_GROUP))
    place = F.row_number().over(Window.partitionBy("part").orderBy("query")) - 1
    rows = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(many))).withColumn("place", place)
    numbers = rows.select("query", (F.floor(F.col("place") / 64) * many + F.col("part")).alias("block"), (F.col("place") % 64).alias("bit"))
    return F.broadcast(numbers) if many == 1 else numbers


def missing_companions(packed: DataFrame, edges: DataFrame, below: DataFrame) -> DataFrame:
    """query, seed, needs: definitions, footnotes and references that packed rows need and neither they nor anything below them supply.

    below: node, part (every node with all that is under it, itself included). Questions go as bits, 64 to a word, so a row, an
    edge or a node passes an exchange once for a block of questions and not once for each. A null question is supplied by none.
    """
    numbers = _numbered(packed)
    bits = F.bit_or(F.expr("shiftleft(1L, coalesce(bit, 0))")).alias("bits")
    held = packed.join(numbers, "query", "left").groupBy("id", F.coalesce("block", F.lit(-1)).alias("block")).agg(bits)  # used twice as it is, so one exchange
    have = below.join(held, F.col("part") == F.col("id")).groupBy("node", "block").agg(F.bit_or("bits").alias("have"))
    needed = edges.where(F.col("kind").isin(REQUIRED)).join(held, F.col("src") == F.col("id")).groupBy(F.col("src").alias("seed"), F.col("dst").alias("needs"), "block").agg(F.bit_or("bits").alias("bits"))
    left = needed.join(have.withColumnRenamed("block", "b"), (F.col("needs") == F.col("node")) & (F.col("block") == F.col("b")), "left")
    have_not = F.bitwise_not(F.when(F.col("block") >= 0, F.col("have")).otherwise(F.lit(None).cast("long")))
    lacking = left.withColumn("lacks", F.coalesce(F.col("bits").bitwiseAND(have_not), "bits")).where("lacks <> 0")
    single = lacking.select("seed", "needs", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("lacks", i) == 1)).alias("bit"))
    return single.join(numbers, ["block", "bit"], "left").select("query", "seed", "needs")


def followed(ranked: DataFrame, replaced: DataFrame, hops: int = 4) -> DataFrame:
    """query, id, rank with the chain of replacements of each earlier value put before it, a bounded number of steps. replaced: id, by."""
    chain = ranked.select("query", F.col("id").alias("at"), "rank", F.lit(0).alias("hop"))
    out = chain
    for hop in range(1, hops + 1):
        chain = chain.join(replaced.select(F.col("id").alias("at"), "by"), "at").select("query", F.col("by").alias("at"), "rank", F.lit(hop).alias("hop"))
        out = out.union(chain)
    first = out.groupBy("query", F.col("at").alias("id")).agg(F.min(F.struct("rank", (-F.col("hop")).alias("back"))).alias("p"))
    return first.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("p.rank", "p.back", "id")).alias("rank"))


def bridges(ranked: DataFrame, texts: DataFrame, questions: DataFrame, top: int = 10) -> DataFrame:
    """query, bridge, text: of a question's first memories the one with most words that the question lacks while sharing one; its new
    words are the next query."""
    asked = questions.select("query", t.tokens(F.col("text")).alias("q"))
    near = ranked.where(F.col("rank") <= top).join(texts, "id").join(asked, "query").withColumn("w", t.tokens(F.col("text")))
    fresh = F.array_except("w", "q")
    kept = near.where(F.arrays_overlap("w", "q") & (F.size(fresh) > 0)).withColumn("fresh", fresh)
    order = Window.partitionBy("query").orderBy(F.desc(F.size("fresh")), "rank")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query", F.col("id").alias("bridge"), F.array_join(F.array_sort("fresh"), " ").alias("text"))


def entity_arms(base: DataFrame, per_subject: DataFrame) -> DataFrame:
    """query, id, score, rank: a question's own list, counted twice, with one list for each subject it names."""
    return retrieval.fuse([(base, 2.0, "base"), (per_subject, 1.0, "subject")])


def grounded_in(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """query, overlaps: whether any evidence shares a content stem with the question; a question of no content words overlaps nothing."""
    stems = lambda df, key: df.select(key, F.explode_outer(F.transform(t.tokens(F.col("text")), t.stem)).alias("stem"))
    hit = stems(questions, "query").where("stem is not null").join(stems(evidence, "query"), ["query", "stem"]).select("query").distinct().withColumn("overlaps", F.lit(True))
    return questions.select("query").join(hit, "query", "left").select("query", F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


def unanswered(question: Column, evidence: Column) -> Column:
    """Kinds of value that a question asks for and the evidence states none of, and codes of it that the evidence doesn't know."""
    gaps = [F.when(question.rlike(ask) & ~F.coalesce(evidence.rlike(value), F.lit(False)), F.lit(kind)) for kind, (ask, value) in ASKED.items()]
    unknown = F.transform(F.array_except(t.codes(question), t.codes(F.coalesce(evidence, F.lit("")))), lambda c: F.concat(F.lit("code "), c))
    return F.concat(F.array_compact(F.array(*gaps)), unknown)


def expand_glossary(text: Column) -> Column:
    """A question with the long form behind each short form that it uses."""
    out = text
    for short, long in GLOSSARY.items():
        out = F.regexp_replace(out, rf"(?i)\b({short})\b", f"$1 ({long})")
    return out


def passages(texts: DataFrame, weights: DataFrame, room: int) -> DataFrame:
    """id, passage: the sentences of a long text that hold most of a question's weight and fit, in their own order, gaps marked.

    texts: id, text; weights: id, word, weight. Sentences are taken by weight as long as all before them fit.
    """
    parts = texts.select("id", F.posexplode(t.sentences(F.col("text"))).alias("n", "s"))
    told = parts.select("id", "n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("word")).join(weights, ["id", "word"]).groupBy("id", "n").agg(F.sum("weight").alias("w"))
    used = F.sum(F.length("s") + 3).over(Window.partitionBy("id").orderBy(F.desc(F.coalesce("w", F.lit(0.0))), "n").rowsBetween(Window.unboundedPreceding, 0))
    kept = parts.join(told, ["id", "n"], "left").withColumn("used", used).where(F.col("used") <= room - 4)
    line = Window.partitionBy("id").orderBy("n")
    gap = F.when(F.col("n") != F.coalesce(F.lag("n").over(line), F.lit(-1)) + 1, F.lit("… ")).otherwise(F.lit(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"])
    return kept.withColumn("piece", F.concat(gap, "s")).groupBy("id").agg(F.array_join(ordered, " ").alias("passage"))


def section_texts(tree: DataFrame, id_col: str = "doc_id", hops: int = 6) -> DataFrame:
    """id_col, section, n, text: each heading with all text below it, in order. A block has at most six ancestors, so six joins find them."""
    rows = tree.select(id_col, "ordinal", "parent", "kind", "text")
    up = rows.where("kind <> 'heading' and parent is not null").select(id_col, "ordinal", "text", F.col("parent").alias("section"))
    heads = rows.where("kind = 'heading'").select(id_col, F.col("ordinal").alias("section"), F.col("parent").alias("over"))
    out = up
    for _ in range(hops - 1):
        up = up.join(heads, [id_col, "section"]).where("over is not null").select(id_col, "ordinal", "text", F.col("over").alias("section"))
        out = out.union(up)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return out.groupBy(id_col, "section").agg(F.count("*").alias("n"), F.array_join(ordered, "\n").alias("text"))


def entity_summaries(relations: DataFrame, most: int = 12) -> DataFrame:
    """entity, summary, source: an entity's facts as one line, and a digest of them that tells when to write it anew."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), "predicate", "object"))
    kept = relations.withColumn("n", place).where(F.col("n") <= most)
    fact = F.concat_ws(" ", F.replace(F.col("predicate"), F.lit("_"), F.lit(" ")), "object")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", fact.alias("f")))), lambda x: x["f"])
    line = F.concat(F.col("subject"), F.lit(": "), F.array_join(ordered, "; "))
    return kept.groupBy("subject").agg(line.alias("summary")).select(F.col("subject").alias("entity"), "summary", F.sha2("summary", 256).alias("source"))


def people(beliefs: DataFrame, limit: int) -> DataFrame:
    """The people that most proofs are about."""
    return beliefs.groupBy("person").agg(F.sum("proofs").alias("proofs")).orderBy(F.desc("proofs"), F.asc("person")).limit(limit)


def recent_or_exact(rows: DataFrame, by: str, kinds: dict[str, int], wanted: DataFrame) -> DataFrame:
    """by, id: the newest few rows of each kind, and those with a wanted hash, each once."""
    limit = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    place = F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc("at"), F.desc("id")))
    newest = rows.withColumn("n", place).where(F.col("n") <= F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit(0))).select(by, "id")
    return newest.union(rows.join(wanted, [by, "hash"], "left_semi").select(by, "id")).distinct()


def idle(rows: DataFrame, at: str, now: Column, days: float) -> DataFrame:
    return rows.where(F.col(at) <= now - F.make_dt_interval(F.lit(int(days))))


def retained(rows: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Rows that their tenant's policy still keeps; without a policy all stay. policies: tenant, kind, days."""
    kept = rows.join(policies, ["tenant", "kind"], "left")
    return kept.where(F.col("days").isNull() | (F.datediff(now, F.col("at")) <= F.col("days"))).drop("days")


def reflection_groups(memories: DataFrame) -> DataFrame:
    """tenant, owner, scope, audience, ids of what may be thought about together."""
    audience = F.array_join(F.array_sort("keys"), ",")
    return memories.groupBy("tenant", "owner", "scope", audience.alias("audience")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("at").alias("newest"))


def folded(commands: DataFrame) -> DataFrame:
    """id, content, status after a log of commands: remember, correct, retract, restore, forget; the last of each kind of effect counts.

    commands: id, n (order), command, content.
    """
    rows = commands.groupBy("id").agg(
        F.max_by("content", F.when(F.col("command").isin("remember", "correct"), F.col("n"))).alias("content"),
        F.max_by("command", F.when(F.col("command").isin("remember", "retract", "restore", "forget"), F.col("n"))).alias("last"),
        F.max(F.when(F.col("command") == "forget", 1).otherwise(0)).alias("gone"),
    )
    status = F.when(F.col("gone") == 1, "FORGOTTEN").when(F.col("last") == "retract", "RETRACTED").otherwise("CURRENT")
    return rows.select("id", F.when(status != "FORGOTTEN", F.col("content")).alias("content"), status.alias("status"))


def scope_keys(granted: DataFrame) -> DataFrame:
    """subject, threads, workspaces, groups that relation tuples grant."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("object").startswith(f"{kind}:"), F.substring_index("object", ":", -1))))
    return granted.groupBy("subject").agg(of("thread").alias("threads"), of("workspace").alias("workspaces"), of("group").alias("groups"))


def forbidden(tools: DataFrame, rules: DataFrame) -> DataFrame:
    """tool, rule of tools that a standing rule names as never to be used. tools: tool; rules: rule, text."""
    barred = rules.where(F.col("text").rlike(r"(?i)\b(?:never|do not|don't|must not)\b")).select("rule", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]{3,})"), 1)).alias("word"))
    return tools.select("tool", F.lower("tool").alias("word")).join(barred, "word").select("tool", "rule").distinct()


def tool_entities(calls: DataFrame, names: DataFrame) -> DataFrame:
    """tool, entity, kind, n: entities that a tool's arguments name, or identify by a value. calls: tool, inputs; names: entity, name, is_id."""
    said = calls.select("tool", F.explode("inputs").alias("i")).select("tool", F.lower(F.trim("i.value")).alias("name"))
    met = said.join(names.select("entity", F.lower("name").alias("name"), "is_id"), "name")
    return met.groupBy("tool", "entity", F.when(F.col("is_id"), "identified_by").otherwise("used_entity").alias("kind")).agg(F.count("*").alias("n"))
