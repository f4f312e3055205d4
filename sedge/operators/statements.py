"""How statements relate: subjects, replacement over conversations, restated rules, questions' slots, beliefs, checks of rewritten text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sedge.functions import scores as s
from sedge.functions import text as t
from sedge.functions.python import flat_map

# Fixed values.
LEGAL_FORMS = "inc ltd llc gmbh ag sa bv corp plc kg nv oy ab srl spa".split()
SUPERSEDES, EARLIER, CHANGED = 0.90, 0.85, 0.40
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11)}
SAME_FRAME = 0.5
DOCUMENT_FACTS = [
    ("acquired", r"([A-Z][\w&.\- ]{1,40}?) (?:has )?acquired ([A-Z][\w&.\- ]{1,40}?)(?= in | for |[.,;]|$)", 0.8),
    ("merged_with", r"([A-Z][\w&.\- ]{1,40}?) merged with ([A-Z][\w&.\- ]{1,40}?)(?= in |[.,;]|$)", 0.8),
    ("founded_in", r"([A-Z][\w&.\- ]{1,40}?) was founded in (\d{4})", 0.85),
    ("headquartered_in", r"([A-Z][\w&.\- ]{1,40}?) is headquartered in ([A-Z][\w.\- ]{1,30}?)(?=[.,;]|$)", 0.8),
    ("operates_in", r"([A-Z][\w&.\- ]{1,40}?) operates in ([A-Z][\w.\- ]{1,30}?)(?=[.,;]|$)", 0.8),
    ("driven_by", r"([A-Z][\w\- ]{1,40}?) (?:was|were|is) (?:mainly |largely )?driven by ([\w\- ]{2,60}?)(?=[.,;]|$)", 0.75),
    ("excludes", r"([A-Z][\w\- ]{1,40}?) excludes? ([\w\- ]{2,60}?)(?=[.,;]|$)", 0.85),
    ("has_value", r"([A-Z][\w\- ]{1,40}?) (?:was|were|is|amounted to|reached|rose to|fell to|increased to|decreased to) ((?:EUR|USD|GBP|CHF) ?\d[\d.,]*(?: (?:thousand|million|billion))?|\d[\d.,]*%)", 0.8),
]
# Ends of fixed values.
#: Of one person, about so many questions and messages are weighed in one place.
CHAT_QUESTIONS, CHAT_MESSAGES = 16384, 32768


def identifiers(subject: Column) -> Column:
    """Parts of a subject that carry a digit, in their bare form: they tell one thing from another of its kind."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(subject), F.lit(r"#?([a-z\-]*\d[\w\-]*)"), 1), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))))


def _parts(subject: Column) -> tuple[Column, Column, Column]:
    words = F.filter(F.regexp_extract_all(F.lower(subject), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.rlike(r"\d") & ~w.isin("the", "a", "an", "of", "my", "our"))
    legal = F.array_sort(F.filter(words, lambda w: w.isin(LEGAL_FORMS)))
    plain = F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(LEGAL_FORMS)), t.stem)))
    return identifiers(subject), plain, legal


def same_subject(a: Column, b: Column) -> Column:
    """SAME, POSSIBLE or DIFFERENT. Unlike identifiers are never one thing; a short form or a typo is possible at most."""
    (ids_a, words_a, legal_a), (ids_b, words_b, legal_b) = _parts(a), _parts(b)
    both_ids = (F.size(ids_a) > 0) & (F.size(ids_b) > 0)
    legal = (F.size(legal_a) > 0) & (F.size(legal_b) > 0) & (legal_a != legal_b)
    initials = lambda x: F.lower(F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\b(\p{L})"), 1), lambda c: F.lower(c)), ""))
    flat = lambda w: F.array_join(w, " ")
    near = (F.levenshtein(flat(words_a), flat(words_b)) <= 1) & (F.length(flat(words_a)) > 3)
    part = (F.size(words_a) > 0) & (F.size(words_b) > 0) & ((F.size(F.array_except(words_a, words_b)) == 0) | (F.size(F.array_except(words_b, words_a)) == 0))
    short = (F.lower(F.trim(a)) == initials(b)) | (F.lower(F.trim(b)) == initials(a))
    return (
        F.when((both_ids & (ids_a != ids_b)) | legal, "DIFFERENT")
        .when((words_a == words_b) & (ids_a == ids_b) & (F.size(words_a) + F.size(ids_a) > 0), "SAME")
        .when((near & (ids_a == ids_b)) | part | short, "POSSIBLE")
        .otherwise("DIFFERENT")
    )


def anchors(text: Column) -> Column:
    """Names and identifiers that a statement is about."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![.!?]\s)(?<!^)\b([A-Z][\p{L}]{2,})\b"), 1), lambda x: F.lower(x))
    return F.array_distinct(F.concat(names, t.codes(text)))


def value_changed(old: Column, new: Column) -> Column:
    """Each states a number that the other lacks."""
    return s.number_conflict(t.number_values(old), t.number_values(new))


def replaced(said: DataFrame, change: str = r"(?i)\b(no longer|instead of|switched to|moved to|changed to|from now on|used to|now|update:|correction:|actually)\b") -> DataFrame:
    """id, by, grade of statements that a later one of the same person, about the same name or identifier, replaces.

    said: id, person, at, text. Pairs meet on (person, anchor), so those that share none are never looked at. A strong
    contradiction supersedes; a weaker one, or a change of value between statements that share an anchor, makes an earlier value.
    """
    flat = said.select("id", "person", "at", "text", F.explode(anchors(F.col("text"))).alias("anchor"))
    a, b = (flat.select("person", "anchor", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "at", "text"))) for side in ("old", "new"))
    pairs = a.join(b, ["person", "anchor"]).where((F.col("old_at") < F.col("new_at")) | ((F.col("old_at") == F.col("new_at")) & (F.col("old_id") < F.col("new_id")))).drop("anchor").distinct()
    against = s.lexical_nli(F.col("old_text"), F.col("new_text"))["contradiction"]
    cued = F.col("new_text").rlike(change) | value_changed(F.col("old_text"), F.col("new_text"))
    grade = F.when(against >= SUPERSEDES, "SUPERSEDED").when((against >= EARLIER) | (cued & (against >= CHANGED)), "EARLIER")
    told = pairs.withColumn("grade", grade).where("grade is not null")
    order = Window.partitionBy("old_id").orderBy(F.desc("grade"), F.desc("new_at"), F.desc("new_id"))
    return told.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("old_id").alias("id"), F.col("new_id").alias("by"), "grade")


def frame(text: Column) -> Column:
    """The stems of a statement without its values and names: equal for a rule and its restatement with other values."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\b[\w\-]*\d[\w\-]*\b", " "), r"(?<=\s)[A-Z][\p{L}]+", " ")
    return F.array_sort(F.transform(t.tokens(bare), t.stem))


def restated(rules: DataFrame) -> DataFrame:
    """rules with earlier_value: those of one person whose frame a later rule has with other words. Equal instants have no order.

    rules: id, person, at, text.
    """
    framed = rules.withColumn("_f", F.array_join(frame(F.col("text")), " "))
    line = Window.partitionBy("person", "_f")
    newest = F.max("at").over(line)
    last = framed.withColumn("_newest", newest).withColumn("_words", F.max(F.when(F.col("at") == F.col("_newest"), t.normalize(F.col("text")))).over(line))
    return last.withColumn("earlier_value", (F.col("_f") != "") & (F.col("at") < F.col("_newest")) & (t.normalize(F.col("text")) != F.col("_words"))).drop("_f", "_newest", "_words")


def answers_slot(questions: DataFrame, memories: DataFrame) -> DataFrame:
    """query, id, earlier_value of memories that hold the slot a question names: every identifier and name of it, one of its words,
    and a figure or name that the question lacks; the newest is the value, those of unlike values before it are earlier.

    questions: query, person, text; memories: id, person, at, text.
    """
    asked = questions.select("query", "person", t.tokens(F.col("text")).alias("words"), anchors(F.col("text")).alias("names"), t.figures(F.col("text")).alias("figures"))
    held = memories.select("id", "person", "at", t.tokens(F.col("text")).alias("has"), F.array_union(anchors(F.col("text")), F.transform(t.tokens(F.col("text")), lambda x: x)).alias("named"), t.figures(F.col("text")).alias("told"), t.normalize(F.col("text")).alias("n"), frame(F.col("text")).alias("frame"))
    met = asked.select("query", "person", "words", "names", "figures", F.explode("words").alias("word")).join(held.select("*", F.explode("has").alias("word")), ["person", "word"]).dropDuplicates(["query", "id"])
    fits = met.where((F.size(F.array_except("names", "named")) == 0) & (F.size(F.array_except("told", "figures")) > 0))
    line = Window.partitionBy("query").orderBy(F.desc("at"), F.desc("id"))
    top = fits.withColumn("_told", F.first("told").over(line)).withColumn("_frame", F.first("frame").over(line))
    alike = F.size(F.array_intersect("frame", "_frame")) >= SAME_FRAME * F.least(F.size("frame"), F.size("_frame"))
    return top.select("query", "id", (alike & (F.array_sort("told") != F.array_sort("_told"))).alias("earlier_value"))


def periods_of(question: str, year: int, month: int) -> list[tuple[str, str]]:
    """(first day, last day) of the months, years and seasons that a question names, as ISO days; a month without a year is any year's (--MM)."""
    low, out = question.lower(), []

    def days(y: int, a: int, b: int) -> tuple[str, str]:
        last = 31 if b in (1, 3, 5, 7, 8, 10, 12) else 30 if b != 2 else 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28
        return f"{y:04d}-{a:02d}-01", f"{y:04d}-{b:02d}-{last:02d}"

    names = "|".join(MONTHS)
    taken = []
    for m in re.finditer(rf"\b({names})\b(?:\s+(?:of\s+)?(\d{{4}}))?", low):
        n = MONTHS.index(m[1]) + 1
        if m[1] == "may" and not m[2] and not re.search(r"\b(?:in|of|since|last|until|during)\s+$", low[: m.start()]):
            continue  # the verb
        out.append(days(int(m[2]), n, n) if m[2] else (f"--{n:02d}", f"--{n:02d}"))
        taken.append(m.span())
    for m in re.finditer(rf"\b({'|'.join(SEASONS)})\s+(?:of\s+)?(\d{{4}})\b", low):
        out.append(days(int(m[2]), *SEASONS[m[1]]))
        taken.append(m.span())
    for m in re.finditer(r"\b((?:19|20)\d{2})\b", low):
        if not any(a <= m.start() < b for a, b in taken):
            out.append(days(int(m[1]), 1, 12))
    for words, shift in (("last month", -1), ("this month", 0), ("next month", 1)):
        if words in low:
            n = year * 12 + month - 1 + shift
            out.append(days(n // 12, n % 12 + 1, n % 12 + 1))
    for words, shift in (("last year", -1), ("this year", 0), ("next year", 1)):
        if words in low:
            out.append(days(year + shift, 1, 12))
    return out


def periods(questions: DataFrame, id_col: str, text_col: str, now: Column) -> DataFrame:
    """id_col, first, last."""
    rows = questions.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.year(now), F.month(now))
    return flat_map(rows, lambda i, x, y, m: [(i, *p) for p in periods_of(x or "", y, m)], f"{id_col} long, first string, last string")


def belief_plan(held: DataFrame, proposed: DataFrame) -> DataFrame:
    """key, action (keep, update, retire or add) for a person's beliefs. Both: person, key, text; a key that isn't proposed again retires."""
    both = held.select("person", "key", F.col("text").alias("was")).join(proposed.select("person", "key", F.col("text").alias("now")), ["person", "key"], "full_outer")
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "retire").when(t.normalize(F.col("was")) == t.normalize(F.col("now")), "keep").otherwise("update")
    return both.select("person", "key", action.alias("action"), "now")


def belief_state(beliefs: DataFrame, sources: DataFrame, memories: DataFrame) -> DataFrame:
    """belief, state: deleted where all its sources are forgotten, stale where one was replaced or forgotten, else current.

    sources: belief, id; memories: id, status.
    """
    told = sources.join(memories, "id", "left").groupBy("belief").agg(F.count_if(F.coalesce(F.col("status") == "CURRENT", F.lit(False))).alias("live"), F.count_if(F.coalesce(F.col("status") == "SUPERSEDED", F.lit(False))).alias("old"), F.count("*").alias("n"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "deleted").when(F.col("live") + F.col("old") == 0, "deleted").when(F.col("live") < F.col("n"), "stale").otherwise("current")
    return beliefs.select("belief").join(told, "belief", "left").select("belief", state.alias("state"))


def grounded(rewritten: Column, source: Column) -> Column:
    """A rewritten statement may be kept: every figure and name of it is in its source, and it negates where that does."""
    return (F.size(F.array_except(t.figures(rewritten), t.figures(source))) == 0) & (F.size(F.array_except(anchors(rewritten), F.array_union(anchors(source), F.transform(t.words(source), lambda x: x)))) == 0) & (t.has_negation(rewritten) == t.has_negation(source))


def document_facts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, sentence, subject, predicate, object, period, confidence that a document's sentences state; the period is the sentence's own year."""
    said = rows.select(id_col, F.posexplode(t.sentences(F.col(text_col))).alias("sentence", "content"))
    found = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.struct(F.trim(F.regexp_extract("content", p, 1)).alias("subject"), F.lit(name).alias("predicate"), F.trim(F.regexp_extract("content", p, 2)).alias("object"), F.lit(c).alias("confidence"))) for name, p, c in DOCUMENT_FACTS)))
    year = F.nullif(F.regexp_extract("content", r"\b((?:FY\s?)?(?:19|20)\d{2})\b", 1), F.lit(""))
    return said.select(id_col, "sentence", year.alias("period"), F.explode(found).alias("f")).select(id_col, "sentence", "f.subject", "f.predicate", "f.object", "period", "f.confidence")


def replay_layers(messages: DataFrame, whole: int, text_only: int, thread: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """messages with layer: the newest units whole, those before as text, the rest as steps; a question and its answers stay together."""
    line = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    units = messages.withColumn("unit", F.sum((F.col(role) == "user").cast("int")).over(line))
    back = F.max("unit").over(Window.partitionBy(thread)) - F.col("unit")
    return units.withColumn("layer", F.when(back < whole, "whole").when(back < whole + text_only, "text").otherwise("steps"))


def earlier_chats(messages: DataFrame, questions: DataFrame, share: float = 0.5) -> DataFrame:
    """query, thread, at, weight of assistant messages within a share of the best match of a question, by its words' rarity.

    messages: thread, at, role, text, person (a thread is one person's); questions: query, person, text. Blocks of a person's questions meet blocks of the
    messages in one place and every pair is weighed there, first for the best of each question, then for what is near it, so only
    the texts' words and the bests are exchanged, not the pairs.
    """
    found = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) > 1))
    asked = questions.where("person is not null").select("query", "person", F.explode(found(F.col("text"))).alias("word"))
    said = messages.where("person is not null").select("person", F.explode(found(F.col("text"))).alias("word"))
    n = messages.groupBy("person").agg(F.count("*").cast("double").alias("n"), F.ceil(F.count_if(F.col("role") == "assistant") / CHAT_MESSAGES).alias("parts"))
    sizes = n.join(questions.groupBy("person").agg(F.ceil(F.count("*") / CHAT_QUESTIONS).alias("blocks")), "person")
    df = said.groupBy("person", "word").agg(F.count("*").cast("double").alias("df"))
    words = asked.join(df, ["person", "word"]).join(sizes, "person").where("parts > 0").groupBy("person", "query", "parts", "blocks").agg(F.collect_list(F.struct("word", s.query_idf(F.col("n"), F.col("df")).alias("w"))).alias("words"))
    block, part = F.pmod(F.xxhash64("query"), "blocks").cast("int").alias("block"), F.pmod(F.xxhash64("thread", "at"), "parts").cast("int").alias("part")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    sides = words.select("person", "query", F.col("words.word").alias("words"), F.col("words.w").alias("w"), block, all_of("parts").alias("part"))
    texts = messages.where("role = 'assistant'").join(sizes, "person").select("person", "thread", "at", F.array_join(found(F.col("text")), " ").alias("said"), part, all_of("blocks").alias("block"))
    kind = {c: f.schema[c].dataType for f, c in ((questions, "query"), (messages, "thread"), (messages, "at"))}

    def weighed(schema: T.StructType, row):
        arrow = to_arrow_schema(schema)

        def run(asked: pa.Table, told: pa.Table) -> pa.Table:
            if not asked.num_rows or not told.num_rows:
                return arrow.empty_table()
            known = {w for words in asked["words"].to_pylist() for w in words}
            places, at, lists = {}, [], {}
            keys = list(zip(told["thread"].to_pylist(), told["at"].to_pylist()))
            for key, text in zip(keys, told["said"].to_pylist()):
                at.append(places.setdefault(key, len(places)))
                for w in known.intersection((text or "").split(" ")):
                    lists.setdefault(w, []).append(at[-1])
            lists = {w: np.array(v) for w, v in lists.items()}
            add = np.add.at if len(places) < len(keys) else lambda total, i, w: total.__setitem__(i, total[i] + w)
            threads, ats = (pa.array([k[i] for k in places], told.schema.field(c).type) for i, c in enumerate(("thread", "at")))
            out = [[] for _ in arrow]
            bests = asked["best"].to_pylist() if "best" in asked.column_names else [None] * asked.num_rows
            for query, words, w, best in zip(asked["query"].to_pylist(), asked["words"].to_pylist(), asked["w"].to_pylist(), bests):
                total, hit = np.zeros(len(places)), False
                for word, x in zip(words, w):
                    if word in lists:
                        add(total, lists[word], x)
                        hit = True
                if hit:
                    for chunks, new, f in zip(out, row(query, threads, ats, np.round(total, 6), best), arrow):
                        chunks.append(pa.array(new, f.type) if not isinstance(new, pa.Array) else new.cast(f.type))
            return pa.Table.from_arrays([pa.chunked_array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

        return run

    def best_of(query, threads, ats, total, _):
        return [query], [float(total.max())]

    def near(query, threads, ats, total, best):
        i = np.flatnonzero((total >= share * best) & (total > 0))
        return [query] * len(i), threads.take(pa.array(i)), ats.take(pa.array(i)), total[i]

    by = ["person", "block", "part"]
    met = lambda left, schema, row: left.groupBy(*by).cogroup(texts.groupBy(*by)).applyInArrow(weighed(schema, row), schema)
    best = met(sides, T.StructType().add("query", kind["query"]).add("best", "double"), best_of).groupBy("query").agg(F.max("best").alias("best"))
    hits = T.StructType().add("query", kind["query"]).add("thread", kind["thread"]).add("at", kind["at"]).add("weight", "double")
    known = sides.join(best.withColumnRenamed("query", "q"), F.col("query").eqNullSafe(F.col("q"))).drop("q")
    return met(known, hits, near)
