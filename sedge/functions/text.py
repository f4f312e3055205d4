"""Text functions as columns: normal forms, tokens, figures, sentences, token estimates, scripts, languages, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "a an the and or but if then of to in on at by for with from as is are was were be been being it its this that these those there here i me my we our you your they them he she his her do does did done have has had"
    " having not no so than too very can will would should could may might must shall into onto about please"
).split()
GROUNDING_STOP_WORDS = (
    "a an the and or but if then of to in on at by for with from as is are was were be been being it its this that these those there here i me my we our you your they them he she his her do does did done have has had"
    " having so than too very can will would should could may might must shall into onto about please which who whom whose what when where while also both each such per via any some all"
).split()
NEGATIONS = "not no never none nobody nothing neither nor n't cannot".split()
GROUNDING_NEGATIONS = "not no never none nobody nothing neither nor".split()
WORD = r"[a-z0-9](?:[a-z0-9'+\-./@]*[a-z0-9])?"
NUMBER = r"\d+(?:[.,]\d+)*"
GROUNDING_WORD = r"[a-z0-9](?:[a-z0-9'\-/]*[a-z0-9])?"
GROUNDING_NUMBER = r"(?<![A-Za-z\d])\d+(?:[.,]\d+)*"
TURN_PREFIX = r"(?U)^\s*\[(?=[^\]\n]{0,60}\])(?![^\]\n]*:\s)(?=[^\]\n]*(?:\d{1,2}:\d{2}|(?:19|20)\d{2}))[^\]\n]*\][ \t]*(?:[^\W\d_][\w.'\-]*(?:[ \t][^\W\d_][\w.'\-]*){0,2}:[ \t]+)?"
MARKER_LETTERS = {"de": "ß", "es": "ñ¿¡", "pt": "ãõ", "fr": "œæ", "tr": "ığş", "pl": "łąęśźżń"}
FUNCTION_WORDS = {
    "en": "the and is are to of you my it that for with have this not we they be at what where who when why how which does did do i i'm your from will would there",
    "de": "der die das und ist nicht ich du sie es ein eine mit auf für den dem zu von wir mein meine habe bin im auch aber wo wer wie wann warum wohnt arbeitet sind",
    "es": "el la los las y es que en un una por para con mi yo se del al está soy tengo pero muy dónde qué quién cuándo cómo vive trabaja son",
    "fr": "le les et est je tu il elle nous vous pas pour avec dans du des mon ma suis qui sur au où quand comment pourquoi quel quelle habite travaille sont",
    "it": "il è di che per non sono mi ho della gli io ma anche dove chi quando come perché vive lavora",
    "pt": "o os é um uma não eu meu minha do da em no na mas muito sou tenho onde quem quando como mora trabalha são",
    "nl": "het een van ik niet dat op te voor zijn ook maar wij waar wie wanneer hoe woont werkt",
}
CURRENCY = "(?:EUR|USD|GBP|CHF|JPY|INR|CAD|AUD)"
PLACEHOLDERS = [
    ("url", r"\bhttps?://\S+"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("money", rf"\b{CURRENCY}\s?[\d,.]+\b|\B[$€£]\s?[\d,.]+\b|\b\d[\d,.]*\s?{CURRENCY}\b"),
    ("date", r"(?i)\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:Q[1-4]|FY)\s?\d{2,4}\b"),
    ("id", r"\b(?=[\w-]*\d)[A-Za-z][\w-]{2,}\b"),
    ("num", r"\b\d[\d,.]*\b"),
]
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Han", "Kana", "Hangul"]
# Ends of fixed values.


def words_in(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the end: equal for statements that differ in nothing else."""
    flat = F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))
    return F.regexp_replace(flat, r"[ .!?;:]+$", "")


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def folded(text: Column) -> Column:
    """Lower case and single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def tokens(text: Column) -> Column:
    """The set of words of two letters or more that aren't stop words."""
    return F.array_distinct(F.filter(F.array_except(words(text), words_in(STOP_WORDS)), lambda w: F.length(w) > 1))


def stem(word: Column) -> Column:
    """Cut one of ing, ed, es, s where more than three letters stay."""
    out = word
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when((F.length(word) > len(suffix) + 3) & word.endswith(suffix), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def numbers(text: Column) -> Column:
    """The set of numbers, without the commas that group thousands."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "")))


def number_values(text: Column) -> Column:
    """The set of numbers that no letter precedes, as the text of their double value, where they have one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({GROUNDING_NUMBER})"), 1), lambda n: F.regexp_replace(n, ",", ""))
    return F.array_distinct(F.transform(found, lambda n: F.coalesce(n.try_cast("double").cast("string"), n)))


def codes(text: Column) -> Column:
    """Names of letters and digits, such as WO-K3, in their bare lower-case form behind a #."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)((?<![\w-])(?=[\w-]*[^\W\d_])(?=[\w-]*\d)\w[\w-]*\w(?![\w-]))"), 1)
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.lit("#"), F.regexp_replace(F.lower(c), "[^0-9a-z]", ""))))


def figures(text: Column) -> Column:
    """Numbers and codes: statements that differ in one are never one statement."""
    return F.array_union(numbers(text), codes(text))


def has_negation(text: Column, negations=NEGATIONS) -> Column:
    low = F.lower(text)
    return F.arrays_overlap(F.regexp_extract_all(low, F.lit("([a-z']+)"), 1), words_in(negations)) | low.contains("n't")


def content_tokens(text: Column) -> Column:
    """Stems of content words of ASCII texts, and numbers by value."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({GROUNDING_WORD})"), 1)
    kept = F.filter(F.array_except(found, words_in(GROUNDING_STOP_WORDS)), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))
    return F.array_union(F.transform(kept, stem), number_values(text))


def coverage(claim: Column, evidence: Column) -> Column:
    """Share of the claim's content tokens that the evidence has; 0 for a claim without any."""
    a, b = content_tokens(claim), content_tokens(evidence)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def strip_turn_prefix(text: Column) -> Column:
    """Without a transcript's head such as [2024-01-02] Ada L: ."""
    return F.regexp_replace(text, TURN_PREFIX, "")


def sentences(text: Column) -> Column:
    """Parts between sentence ends of many scripts and line breaks, bullets taken off, those without letters left out."""
    parts = F.split(text, r"(?<=[.!?])\s+|(?<=[。！？।॥؟۔])\s*|\n+")
    trimmed = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[-•*# ]+|[-•*# ]+$", "")))
    return F.filter(trimmed, lambda s: s.rlike(r"\p{L}"))


def estimate_tokens(text: Column) -> Column:
    """A planning estimate: four ASCII characters a token and one more a line; a token for each byte of other characters."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    ascii_text = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    plain = F.floor(F.length(text) / 4) + lines
    mixed = F.floor((F.length(ascii_text) + 4 * lines + 4 * (F.octet_length(text) - F.length(ascii_text))) / 4)
    return F.greatest(F.lit(1).cast("long"), F.when(F.octet_length(text) == F.length(text), plain).otherwise(mixed)).cast("long")


def script_counts(text: Column, sample: int = 512) -> Column:
    """An array of (letters, script) over the first letters of the text, most first."""
    letters = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"(\p{L})"), 1), 1, sample), "")
    pattern = {s: rf"\p{{Is{s}}}" for s in SCRIPTS} | {"Kana": r"[\p{IsHiragana}\p{IsKatakana}]"}
    found = F.array(*(F.struct(F.regexp_count(letters, F.lit(pattern[s])).alias("n"), F.lit(-i).alias("order"), F.lit(s.lower()).alias("script")) for i, s in enumerate(SCRIPTS)))
    return F.sort_array(F.filter(found, lambda x: x["n"] > 0), asc=False)


def detect_script(text: Column, sample: int = 512) -> Column:
    """The script of most letters; other for letters of none that is named, none without letters."""
    first = F.get(script_counts(text, sample), F.lit(0))
    return F.when(first.isNotNull(), first["script"]).when(text.rlike(r"\p{L}"), F.lit("other")).otherwise(F.lit("none"))


def disjoint_function_words() -> dict[str, list[str]]:
    sets = {lang: set(w.split()) for lang, w in FUNCTION_WORDS.items()}
    return {lang: sorted(own - set().union(*(s for other, s in sets.items() if other != lang))) for lang, own in sets.items()}


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _among(values: list[str]):
    return lambda w: w.isin(values)


def _language_votes(low: Column, found: Column) -> Column:
    """The struct of most votes; words that no language has are left out before the languages are counted."""
    own_words = disjoint_function_words()
    marked = {lang: F.when(low.rlike(f"[{letters}]"), 2).otherwise(0) for lang, letters in MARKER_LETTERS.items()}

    def count(known: Column) -> Column:
        votes = []
        for i, (lang, own) in enumerate(own_words.items()):
            n = F.size(F.filter(known, _among(own)))
            votes.append(F.struct((n + marked[lang] if lang in marked else n).alias("n"), F.lit(lang == "en").alias("first"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")))
        for lang in ("tr", "pl"):
            votes.append(F.struct(marked[lang].alias("n"), F.lit(False).alias("first"), F.lit(-99).alias("order"), F.lit(lang).alias("lang")))
        return F.array_max(F.array(*votes))

    return _once(F.filter(found, _among(sorted(set().union(*own_words.values())))), count)


def latin_language(text: Column, sample: int = 200) -> Column:
    """The language of a Latin text by marker letters (2) and function words of one language (1 each), English first among equals."""
    words_of = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)([^\W\d_]+(?:'[^\W\d_]+)?)"), 1)
    head = 20 * sample  # the first words are nearly always in so many characters; only then is the rest not read

    def vote(low: Column) -> Column:
        whole = lambda h: F.when((F.size(h) > sample) | (F.length(low) <= head), h).otherwise(words_of(low))
        found = F.slice(_once(words_of(F.substring(low, 1, head)), whole), 1, sample)
        plain = F.when(low.rlike("[äöü]"), "de").when(F.octet_length(text) == F.length(text), "en").otherwise("und")
        return _once(_language_votes(low, found), lambda best: F.when(best["n"] > 0, best["lang"]).otherwise(plain))

    return F.when(~text.rlike(r"\p{L}"), "und").otherwise(_once(F.lower(text), vote))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets, 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def task_pattern(text: Column, limit: int = 300) -> Column:
    """A task with its values replaced by typed placeholders, the most specific first, in lower case."""
    typed = reduce(lambda t, x: F.regexp_replace(t, x[1], "{" + x[0] + "}"), PLACEHOLDERS, F.substring(F.trim(text), 1, 2 * limit))
    return F.substring(F.lower(F.trim(F.regexp_replace(typed, r"\s+", " "))), 1, limit)


def shape(code: Column) -> Column:
    """Letters as a, digits as 9."""
    return F.regexp_replace(F.regexp_replace(code, "[A-Za-z]", "a"), "[0-9]", "9")
