import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window
from shuffled import written

from sedge.functions import text as t
from sedge.operators import memory
from sedge.plans import registry

COLUMNS = "id string, scope string, owner string, subject string, predicate string, object string, content string"


def every_pair(new, held):
    """The ladder over all pairs of a scope."""
    f = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in df.columns), t.normalized_hash(F.col("content")).alias(p + "hash"), F.lower(F.trim("subject")).alias(p + "slot"), memory.clean_object(F.col("object")).alias(p + "value"), t.tokens(F.col("content")).alias(p + "words"), F.array_sort(t.figures(F.col("content"))).alias(p + "figures"), t.has_negation(F.col("content")).alias(p + "negated"))
    x = f(new, "").join(f(held, "h_"), F.col("scope") == F.col("h_scope"))
    slot = (F.col("slot") == F.col("h_slot")) & (F.col("predicate") == F.col("h_predicate"))
    values, single = (F.col("value") != "") & (F.col("h_value") != ""), memory.single_valued(F.col("predicate"))
    share = t.jaccard(F.col("words"), F.col("h_words"))
    foreign = (F.col("owner") != F.col("h_owner")) & F.col("h_shared") & ~F.col("negates")
    close = (share >= memory.LEXICAL) & (F.col("figures") == F.col("h_figures")) & (F.col("negated") == F.col("h_negated"))
    step = lambda n, d, s: F.struct(F.lit(n).alias("rung"), F.lit(d).alias("decision"), F.round(s, 4).alias("score"))
    own = F.when(F.col("hash") == F.col("h_hash"), step(1, "REINFORCE", F.lit(1.0))).when(slot & values & (F.col("value") == F.col("h_value")), step(2, "REINFORCE", F.lit(0.98))).when(slot & values & single & foreign, step(3, "CONTRADICT", F.lit(0.9))).when(slot & values & single, step(3, "SUPERSEDE", F.lit(0.95)))
    own = own.when(slot & F.col("negates") & (share >= memory.OVERLAP), step(4, "SUPERSEDE", 0.8 + share / 5)).when(close & (share == 1.0), step(5, "REINFORCE", share)).when(close, step(5, "MERGE", share))
    order = Window.partitionBy("id").orderBy("own.rung", (F.col("owner") != F.col("h_owner")).cast("int"), F.desc("own.score"), "h_id")
    best = x.withColumn("own", own).where("own is not null").withColumn("n", F.row_number().over(order)).where("n = 1")
    return {r.id: (r.decision, r.target, r.score) for r in best.select("id", "own.decision", F.col("h_id").alias("target"), "own.score").collect()}


def test_ladder_equals_every_pair(spark):
    rng = random.Random(3)
    words = "pump hall seven needs filter weeks plan green tea morning depot gates open berlin munich works steel rain cold blue door lamp table chair".split()

    def one(k, side):
        base = rng.sample(words, rng.choice([0, 2, 12, 14, 14]))
        said = " ".join(base + rng.choice([[], [], ["7"], ["8"], ["not"]]))
        return (f"{side}{k}", rng.choice(["s", "s", "z", None]), rng.choice(["u", "v", None]), rng.choice(["Pump", " pump ", "user"]), rng.choice(["city", "role", "note", "likes"]), rng.choice(["", "the Tea", "tea", "coffee", None]), rng.choice([said, said, None]), rng.random() < 0.4)

    held = [one(k, "h") for k in range(70)]
    new = [one(k, "n") for k in range(90)]
    texts = [r[6] for r in held if r[6] and len(r[6].split()) > 11]
    new += [(f"x{k}", rng.choice("sz"), "u", "a", f"p{k}", "", rng.choice([s, s + " extra", s.replace(" ", "  "), " ".join(reversed(s.split()))]), False) for k, s in enumerate(texts)]
    a, b = spark.createDataFrame(new, COLUMNS + ", negates boolean"), spark.createDataFrame(held, COLUMNS + ", shared boolean")
    want = every_pair(a, b)
    got = memory.consolidate(a, b).collect()
    assert len(got) == len(new) and {r.id: (r.decision, r.target, r.score) for r in got if r.decision != "CREATE"} == want
    assert {d for d, _, _ in want.values()} == {"REINFORCE", "CONTRADICT", "SUPERSEDE", "MERGE"}


def test_texts_do_not_go_into_joins(spark):
    folder = "/root/testdata/sf0.01"
    got, size = written(spark, lambda: registry.queries()["consolidation"](spark, folder).collect())
    assert len(got) == 1 and size < 4_000_000
