"""Query rewriting by rules: what a question refers to, substitution, the last N meetings, and the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from . import matching

#: Pronouns, by person.
FIRST_PERSON = "i me my mine we us our ours".split()
THIRD_PERSON = "he she they him her them".split()
#: Time phrases that are resolved to a day.
#: May is a month only beside a number.
_MONTH = "|".join(m for m in dates.MONTHS if m != "may")
TIME = (
    r"(?i)\b(today|(?:the\s+)?day\s+before\s+yesterday|yesterday|tomorrow|\d+\s+(?:day|week|month|year)s?\s+ago|(?:last|past|next)\s+(?:week|month|year)|\d{4}-\d{2}-\d{2}"
    rf"|\d{{1,2}}\s+(?:{_MONTH}|may)(?:\s+\d{{4}})?|(?:{_MONTH}|may)\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?|(?:{_MONTH}|may)\s+\d{{4}}|(?:{_MONTH}))\b"
)
#: Phrases that name the latest meetings; the number is in a group of its own.
LATEST = r"(?i)\b(?:last|recent|past|previous)\s+(?:(\d+)\s+)?meetings?\b"
#: What needs the corpus, and what needs none.
CORPUS_WORDS = r"(?i)\b(meetings?|transcripts?|action items?|minutes|discuss\w*|said|mention\w*|decid\w*|agreed|agenda)\b"
GENERAL = r"(?i)^\s*(?:what is an?|define|explain|write|translate|how do i)\b"
RELATIVE = r"(?i)\b(?:last|past|recent|previous)\b|\byesterday\b|\btoday\b|\b\d+\s+(?:day|week|month)s?\s+ago\b"


def pronouns(text: Column) -> Column:
    """Pronouns of the text in lower case, in order, repeats included."""
    listed = "|".join(FIRST_PERSON + THIRD_PERSON)
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({listed})\b"), F.lit(1)), F.lower)


def time_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TIME), F.lit(1))


def detect(questions: DataFrame, participants: Column) -> DataFrame:
    """Add persons, pronouns and time_terms to questions (column text)."""
    return questions.withColumn("persons", matching.named_in(F.col("text"), participants)).withColumn("pronouns", pronouns(F.col("text"))).withColumn("time_terms", time_terms(F.col("text")))


def ambiguity(questions: DataFrame, participants: Column, user: str) -> DataFrame:
    """What detect() adds, is_ambiguous, and mapping: who or what each pronoun and part of a name stands for.

    A pronoun of the first person is the user; one of the third is the only participant, if there is but one.
    """
    rows = detect(questions, participants)
    real = F.filter(participants, lambda p: ~F.lower(p).isin(*matching.PLACEHOLDERS))
    only = F.when(F.size(real) == 1, F.element_at(real, 1))
    said = F.transform(F.array_distinct("pronouns"), lambda p: F.struct(p.alias("term"), F.when(p.isin(*FIRST_PERSON), F.lit(user)).otherwise(only).alias("meaning")))
    named = F.transform("persons", lambda p: F.struct(p.alias("term"), p.alias("meaning")))
    return rows.withColumn("is_ambiguous", (F.size("pronouns") > 0) | (F.size("time_terms") > 0)).withColumn("mapping", F.concat(said, named))


def resolve(detected: DataFrame, user: str, today: str) -> DataFrame:
    """Add resolved: first-person pronouns become the user, time terms a day, and parts of names the full name.

    The longest time terms go first. A name that already stands in full stays.
    """
    mine = "|".join(FIRST_PERSON)
    text = F.regexp_replace("text", rf"(?i)\b(?:{mine})\b", user)
    day = F.to_date(F.lit(today))
    ordered = F.array_sort("time_terms", lambda a, b: F.length(b) - F.length(a))
    named = F.transform(ordered, lambda t: F.struct(t.alias("term"), dates.resolve(t, day).alias("day")))
    text = F.aggregate(named, text, lambda acc, t: F.when(t["day"].isNotNull(), F.replace(acc, t["term"], t["day"])).otherwise(acc))

    def expand(acc: Column, person: Column) -> Column:
        part = F.filter(F.split(person, r"\s+"), lambda x: (F.length(x) >= 3) & F.contains(F.lower(acc), F.lower(x)))
        pattern = F.concat(F.lit(r"(?i)\b"), F.try_element_at(part, F.lit(1)), F.lit(r"\b"))
        return F.when(F.contains(F.lower(acc), F.lower(person)) | (F.size(part) == 0), acc).otherwise(F.regexp_replace(acc, pattern, person))

    return detected.withColumn("resolved", F.aggregate("persons", text, expand))


def latest(text: Column, default: int = 3) -> Column:
    """How many of the latest meetings a question asks for; null if it does not.

    `last meeting` is one, a number is itself, the plural without a number is the default.
    """
    found, n = F.regexp_extract(text, LATEST, 0), F.regexp_extract(text, LATEST, 1)
    return F.when(found == "", F.lit(None).cast("int")).when(n != "", n.cast("int")).when(found.rlike(r"(?i)^last\s+meeting$"), 1).otherwise(default)


def with_latest(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add n, ids (the latest meetings in order) and rewritten, in which the phrase for them is their ids.

    With a column person, the meetings are that person's where it is not null. The catalog's latest meetings are ranked
    once for all questions and once for each person asked for; only as many as the largest number asked for are joined.
    """
    asked = questions.withColumn("n", latest(F.col("text")))
    if "person" not in asked.columns:
        asked = asked.withColumn("person", F.lit(None).cast("string"))
    most = asked.agg(F.max("n")).first()[0] or 0
    order = [F.desc("date"), F.col("meeting_id")]
    place = F.row_number().over(Window.partitionBy("person").orderBy(*order))
    newest = catalog.orderBy(*order).limit(most).select(F.lit(None).cast("string").alias("person"), "meeting_id", "date")
    named = asked.filter("n is not null and person is not null").select("person").distinct()
    theirs = catalog.select(F.explode(F.array_distinct("participants")).alias("person"), "meeting_id", "date").join(named, "person", "left_semi")
    ranked = newest.unionByName(theirs).withColumn("place", place).filter(F.col("place") <= most)
    keyed = asked.select("question_id", F.col("person").alias("who"), "n").filter("n is not null")
    one = F.struct("place", F.col("meeting_id").cast("string").alias("id"))
    ids = keyed.join(ranked, F.col("who").eqNullSafe(F.col("person")) & (F.col("place") <= F.col("n"))).groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["id"]).alias("ids"))
    joined = asked.join(ids, "question_id", "left")
    changed = F.regexp_replace(F.col("text"), F.lit(LATEST), F.concat(F.lit("meetings "), F.array_join("ids", ", ")))
    return joined.withColumn("rewritten", F.when(F.col("ids").isNotNull(), changed).otherwise(F.col("text")))


def rewrite_latest(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """question_id, n, rewritten and relevant_meeting_ids: the phrase for the latest meetings becomes their ids.

    Other questions are unchanged, with no ids.
    """
    return with_latest(questions, catalog).select("question_id", "n", "rewritten", F.coalesce(F.array_join("ids", ", "), F.lit("")).alias("relevant_meeting_ids"))


def plan(questions: DataFrame) -> DataFrame:
    """Add need_rag, need_rewrite and answer_mode: the corpus is asked unless a question is plainly general."""
    general = F.col("text").rlike(GENERAL) & ~F.col("text").rlike(CORPUS_WORDS)
    mine = F.exists(pronouns(F.col("text")), lambda p: p.isin(*FIRST_PERSON))
    return questions.withColumn("need_rag", ~general).withColumn("need_rewrite", mine | F.col("text").rlike(RELATIVE)).withColumn("answer_mode", F.when(general, "direct").otherwise("rag"))
