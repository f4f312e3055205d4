"""Text queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import text as t
from sedge.plans.sql import frame, plan

_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_DUCK_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9](?:[a-z0-9''+\-./@]*[a-z0-9])?')"
_DUCK_TOKENS = f"list_distinct(list_filter({_DUCK_WORDS}, lambda w: length(w) > 1 AND w NOT IN ({_STOP})))"
_DUCK_NORMAL = r"regexp_replace(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '[ .!?;:]+$', '')"
_DUCK_STEM = "CASE WHEN length(w) > 6 AND suffix(w, 'ing') THEN w[:-4] WHEN length(w) > 5 AND suffix(w, 'ed') THEN w[:-3] WHEN length(w) > 5 AND suffix(w, 'es') THEN w[:-3] WHEN length(w) > 4 AND suffix(w, 's') THEN w[:-2] ELSE w END"


def _votes() -> str:
    out = []
    for i, (lang, own) in enumerate(t.disjoint_function_words().items()):
        listed = ", ".join("'" + w.replace("'", "''") + "'" for w in own)
        mark = f" + CASE WHEN regexp_matches(low, '[{t.MARKER_LETTERS[lang]}]') THEN 2 ELSE 0 END" if lang in t.MARKER_LETTERS else ""
        out.append(f"{{'n': len(list_filter(w, lambda x: x IN ({listed}))){mark}, 'first': {str(lang == 'en').lower()}, 'ord': {-i}, 'lang': '{lang}'}}")
    for lang in ("tr", "pl"):
        out.append(f"{{'n': CASE WHEN regexp_matches(low, '[{t.MARKER_LETTERS[lang]}]') THEN 2 ELSE 0 END, 'first': false, 'ord': -99, 'lang': '{lang}'}}")
    return f"list_max([{', '.join(out)}])"


PLANS = {
    "normalised_hash": frame("documents", lambda d: d.select("doc_id", t.normalized_hash(F.col("text")).alias("hash"), F.length(t.normalize(F.col("text"))).alias("n")), f"SELECT doc_id, sha256({_DUCK_NORMAL}) AS hash, length({_DUCK_NORMAL}) AS n FROM documents"),
    "english_tokens": frame("documents", lambda d: d.select("doc_id", F.size(t.tokens(F.col("text"))).alias("n"), F.sha2(F.array_join(F.array_sort(t.tokens(F.col("text"))), " "), 256).alias("hash")), f"SELECT doc_id, len({_DUCK_TOKENS}) AS n, sha256(array_to_string(list_sort({_DUCK_TOKENS}), ' ')) AS hash FROM documents"),
    "light_stems": frame("documents", lambda d: d.select(F.explode(F.transform(t.tokens(F.col("text")), t.stem)).alias("stem")).groupBy("stem").agg(F.count("*").alias("n")), f"WITH w AS (SELECT unnest({_DUCK_TOKENS}) AS w FROM documents) SELECT {_DUCK_STEM} AS stem, count(*) AS n FROM w GROUP BY 1"),
    "figures": frame(
        "documents",
        lambda d: d.select("doc_id", F.size(t.numbers(F.col("text"))).alias("n"), F.array_join(F.array_sort(t.numbers(F.col("text"))), " ").alias("found")),
        r"SELECT doc_id, len(f) AS n, array_to_string(list_sort(f), ' ') AS found FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', ''))) AS f FROM documents)",
    ),
    "negation": frame("conversations", lambda d: d.select("conv_id", "turn", t.has_negation(F.col("text")).alias("negated")), r"SELECT conv_id, turn, list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), ['not','no','never','none','nobody','nothing','neither','nor','n''t','cannot']) OR contains(lower(text), 'n''t') AS negated FROM conversations"),
    "sentences": frame(
        "documents",
        lambda d: d.select("doc_id", F.size(t.sentences(t.strip_turn_prefix(F.col("text")))).alias("n"), F.sha2(F.array_join(t.sentences(t.strip_turn_prefix(F.col("text"))), "|"), 256).alias("hash")),
        r"""SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS hash FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
        lambda x: trim(regexp_replace(trim(x), '^[-•*# ]+|[-•*# ]+$', '', 'g'))), lambda x: regexp_matches(x, '\p{L}')) AS s FROM documents)""",
    ),
    "token_estimate": frame(
        "documents",
        lambda d: d.select("doc_id", t.estimate_tokens(F.col("text")).alias("n")),
        r"""SELECT doc_id, CAST(greatest(1, CASE WHEN strlen(text) = length(text) THEN length(text) // 4 + nl ELSE (a + 4 * nl + 4 * (strlen(text) - a)) // 4 END) AS BIGINT) AS n FROM
        (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS nl, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents)""",
    ),
    "script_letters": frame(
        "documents",
        lambda d: d.select("doc_id", t.detect_script(F.col("text")).alias("script"), F.get(t.script_counts(F.col("text")), F.lit(0))["n"].alias("n")),
        r"""SELECT doc_id, CASE WHEN n > 0 THEN 'latin' ELSE 'other' END AS script, n FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '\p{L}')[:512], lambda x: regexp_matches(x, '\p{Latin}'))) AS n FROM documents)""",
    ),
    "lang_vote": frame(
        "documents",
        lambda d: d.groupBy("lang", t.latin_language(F.col("text")).alias("vote")).agg(F.count("*").alias("n")),
        f"""SELECT lang, CASE WHEN v.n > 0 THEN v.lang WHEN regexp_matches(low, '[äöü]') THEN 'de' WHEN strlen(text) = length(text) THEN 'en' ELSE 'und' END AS vote, count(*) AS n FROM
        (SELECT lang, text, low, {_votes()} AS v FROM (SELECT lang, text, lower(text) AS low, regexp_extract_all(lower(text), '\\p{{L}}+(?:''\\p{{L}}+)?')[:200] AS w FROM documents)) GROUP BY 1, 2""",
    ),
    "task_patterns": frame("events part", lambda e, p: e.select(t.task_pattern(F.concat_ws(" ", F.lit("Order"), "event_type", F.date_format("ts", "yyyy-MM-dd"), F.lit("for EUR"), F.format_string("%.0f", "value"), F.lit("mail a.b@c.org"), F.lit("see https://x.y/z"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")), "SELECT 'order ' || event_type || ' {date} for {money} mail {email} see {url}' AS pattern, count(*) AS n FROM events GROUP BY 1"),
    "code_shapes": frame("part", lambda p: p.groupBy(t.shape(F.col("p_brand")).alias("brand"), t.shape(F.col("p_name")).alias("shape")).agg(F.count("*").alias("n")), "SELECT regexp_replace(regexp_replace(p_brand, '[A-Za-z]', 'a', 'g'), '[0-9]', '9', 'g') AS brand, regexp_replace(regexp_replace(p_name, '[A-Za-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM part GROUP BY 1, 2"),
    "props_fields": plan(
        "events",
        "SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
        "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    ),
}
