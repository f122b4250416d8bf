"""Meeting catalog: flat rows (meeting_id, datetime, date, participants, topics, action_tasks) and queries over them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..sources import index
from ..sources.scratch import cut, folder
from . import matching

DEFAULT_N = 3


def flatten(meetings: DataFrame) -> DataFrame:
    """Date as written with its parts, and joined strings, from meetings with arrays."""
    date = dates.local_date(F.col("datetime"))
    return meetings.select(
        "meeting_id",
        "datetime",
        date.alias("date"),
        dates.part(date, 0).alias("year"),
        dates.part(date, 1).alias("month"),
        dates.part(date, 2).alias("day"),
        "participants",
        F.array_join("participants", ", ").alias("participants_str"),
        "topics",
        F.array_join("topics", "; ").alias("topics_str"),
        "action_tasks",
        F.array_join("action_tasks", "; ").alias("action_tasks_str"),
    )


def last_n(catalog: DataFrame, n: int | None = DEFAULT_N, person: str | None = None) -> DataFrame:
    """The n latest meetings, of one person if given; n of 0 or None is the default. Undated ones come last."""
    rows = catalog if person is None else by_person(catalog, person)
    return rows.orderBy(F.desc("date"), "meeting_id").limit(n or DEFAULT_N)


def by_person(catalog: DataFrame, name: str) -> DataFrame:
    """Meetings with a participant of exactly this name."""
    return catalog.filter(F.array_contains("participants", name))


def by_date_range(catalog: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Meetings from start to end, both included. An undated one passes if there is an end only."""
    return catalog.filter(in_range(start, end))


def by_year_month(catalog: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Meetings of a year and month; 0 or None does not filter."""
    return catalog.filter(in_month(year, month))


def in_range(start: str | None = None, end: str | None = None) -> Column:
    """Whether a meeting is in by_date_range."""
    since = F.lit(True) if start is None else F.col("date") >= start
    return since if end is None else since & (F.col("date") <= end)


def in_month(year: int | None = None, month: int | None = None) -> Column:
    """Whether a meeting is in by_year_month."""
    own = F.col("year") == year if year else F.lit(True)
    return own & (F.col("month") == month) if month else own


def asked_of(catalog: DataFrame, wanted: dict[str, Column], name: str) -> DataFrame:
    """The meetings that fit each of some predicates, with its name in a column: one pass over the catalog for all."""
    fits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wanted.items()]))
    return catalog.filter(reduce(or_, wanted.values())).select("*", F.explode(fits).alias(name))


def participants(catalog: DataFrame) -> DataFrame:
    """Distinct participants."""
    return catalog.select(F.explode("participants").alias("participant")).distinct()


def person_counts(catalog: DataFrame) -> DataFrame:
    """participant, n_meetings and the date of the latest."""
    rows = catalog.select(F.explode(F.array_distinct("participants")).alias("participant"), "date")
    return rows.groupBy("participant").agg(F.count("*").alias("n_meetings"), F.max("date").alias("last_date"))


def query(catalog: DataFrame, query_type: str, **given) -> DataFrame:
    """One of the catalog's query types by name."""
    types = {
        "last_n_meetings": lambda: last_n(catalog, given.get("n")),
        "last_n_meetings_by_person": lambda: last_n(catalog, given.get("n"), given["name"]),
        "filter_by_person": lambda: by_person(catalog, given["name"]),
        "filter_by_date_range": lambda: by_date_range(catalog, given.get("start"), given.get("end")),
        "filter_by_year_month": lambda: by_year_month(catalog, given.get("year"), given.get("month")),
        "all_participants": lambda: participants(catalog),
        "person_counts": lambda: person_counts(catalog),
    }
    if query_type not in types:
        raise ValueError(f"unknown query type {query_type!r}; known: {', '.join(types)}")
    return types[query_type]()


#: What a call may ask for, and what each needs.
CALLS = ("find_person", "last_n_meetings", "date_from_relative", "filter_by_person", "filter_by_date", "filter_by_date_range", "get_all_participants")
#: Columns of the rows that calls give.
RESULT = ("call_id", "query_type", "place", "meeting_id", "date", "name", "score", "error")


def tool_rows(calls: DataFrame, catalog: DataFrame, today: str) -> DataFrame:
    """What a batch of catalog calls finds, a row for each thing found, numbered by place from 1.

    calls: call_id, query_type and what the type needs of n, person_name, fuzzy_name, date_str, year, month, start_date
    and end_date. find_person gives the three participants nearest to a name as typed, with scores; last_n_meetings the
    n latest meetings, of a person if one is named (n of 0 or null is three); date_from_relative the day that a phrase
    means; filter_by_person, filter_by_date and filter_by_date_range meetings by date, latest first; and
    get_all_participants every name. A call without what it needs, or of another type, gives one row with an error.

    The catalog is computed once, and what calls need of it is kept in the shared folder. Meetings are ranked once within
    their day; calls by date meet the counts of days, so no task ranks all meetings of a call.
    """
    known = calls.withColumn("query_type", F.coalesce("query_type", F.lit("null")))
    wants = {"find_person": "fuzzy_name", "date_from_relative": "date_str", "filter_by_person": "fuzzy_name"}
    problem = F.when(~F.col("query_type").isin(*CALLS), F.concat(F.lit("Unknown query_type: "), "query_type"))
    for kind, column in wants.items():
        problem = problem.when((F.col("query_type") == kind) & (F.coalesce(column, F.lit("")) == ""), f"{column} is required")
    no_range = (F.coalesce("start_date", F.lit("")) == "") & (F.coalesce("end_date", F.lit("")) == "")
    problem = problem.when((F.col("query_type") == "filter_by_date_range") & no_range, "At least one of start_date or end_date is required")
    known = cut(known.withColumn("error", problem))
    good = known.filter("error is null")

    def of(kind: str) -> DataFrame:
        return good.filter(F.col("query_type") == kind)

    def rows(found: DataFrame) -> DataFrame:
        kinds = {"place": "int", "meeting_id": catalog.schema["meeting_id"].dataType.simpleString(), "date": "string", "name": "string", "score": "double", "error": "string"}
        return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast(kinds[c]).alias(c) for c in RESULT])

    place = folder(catalog.sparkSession, "meetings")
    catalog.select("meeting_id", "date", "year", "month", "participants").write.parquet(place)
    meetings = catalog.sparkSession.read.parquet(place)
    latest = Window.partitionBy("call_id").orderBy(F.desc("date"), "meeting_id")

    def placed(found: DataFrame) -> DataFrame:
        return rows(found.withColumn("place", F.row_number().over(latest)))

    people = meetings.select("meeting_id", "date", F.explode(F.array_distinct("participants")).alias("person"))
    asked = of("find_person")
    near = matching.matches(asked.select(F.col("fuzzy_name").alias("name")), people.select(F.col("person").alias("candidate")), 3)
    found = asked.select("call_id", "query_type", "fuzzy_name").join(near.withColumnRenamed("name", "fuzzy_name"), "fuzzy_name")
    parts = [rows(found.select("call_id", "query_type", F.col("rank").alias("place"), F.col("candidate").alias("name"), "score"))]

    asked = of("last_n_meetings").select("call_id", "query_type", "person_name", F.coalesce(F.nullif("n", F.lit(0)), F.lit(DEFAULT_N)).alias("n"))
    most = asked.agg(F.max("n")).first()[0] or 0
    # The latest of all, and of each person asked for, are ranked once for all calls.
    newest = meetings.orderBy(F.desc("date"), "meeting_id").limit(most).select("meeting_id", "date", F.lit(None).cast("string").alias("person"))
    theirs = people.join(asked.select(F.col("person_name").alias("person")).distinct(), "person", "left_semi").select("meeting_id", "date", "person")
    ranked = newest.unionByName(theirs).withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("date"), "meeting_id"))).filter(F.col("place") <= most)
    parts.append(rows(asked.join(ranked, F.col("person_name").eqNullSafe(F.col("person")) & (F.col("place") <= F.col("n")))))

    day = dates.resolve(F.col("date_str"), F.to_date(F.lit(today)))
    parts.append(rows(of("date_from_relative").select("call_id", "query_type", F.lit(1).alias("place"), day.alias("date"))))

    parts.append(placed(of("filter_by_person").select("call_id", "query_type", F.col("fuzzy_name").alias("person")).join(people, "person")))

    same = ("date", "year", "month")
    days = cut(meetings.groupBy(*same).agg(F.count("*").alias("held")))
    by_day = meetings.select("meeting_id", *same, F.row_number().over(Window.partitionBy(*same).orderBy("meeting_id")).alias("in_day"))

    def of_days(wanted: DataFrame) -> DataFrame:
        """All meetings of the days (those columns and held) that calls want, latest first."""
        later = Window.partitionBy("call_id").orderBy(F.desc("date"), "year", "month").rowsBetween(Window.unboundedPreceding, -1)
        wanted = wanted.select("call_id", "query_type", *[F.col(c).alias(f"own_{c}") for c in same], F.coalesce(F.sum("held").over(later), F.lit(0)).alias("before"))
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in same])
        return rows(by_day.join(wanted, on).withColumn("place", (F.col("before") + F.col("in_day")).cast("int")))

    # A call without year or month wants all that the catalog has.
    asked = of("filter_by_date").select("call_id", "query_type", F.nullif("year", F.lit(0)).alias("own_year"), F.nullif("month", F.lit(0)).alias("own_month"))
    fits = (F.coalesce("own_year", "year").eqNullSafe(F.col("year"))) & (F.coalesce("own_month", "month").eqNullSafe(F.col("month")))
    parts.append(of_days(asked.join(days, fits)))

    asked = of("filter_by_date_range").select("call_id", "query_type", F.nullif("start_date", F.lit("")).alias("since"), F.nullif("end_date", F.lit("")).alias("until"))
    inside = F.coalesce(F.col("date") >= F.col("since"), F.lit(True)) & F.coalesce(F.col("date") <= F.col("until"), F.lit(True))
    parts.append(of_days(asked.join(days.filter("date is not null"), inside)))

    names = index_of(people.select(F.col("person").alias("name")).filter("name is not null").distinct(), "name")
    parts.append(rows(of("get_all_participants").select("call_id", "query_type").withColumn("one", F.lit(1)).join(names.withColumn("one", F.lit(1)), "one")))

    parts.append(rows(known.filter("error is not null").select("call_id", "query_type", "error")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def index_of(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their place in order, from 1, without one task for all."""
    return index.numbered(names.withColumnRenamed(column, "chunk_id"), 1).select(F.col("chunk_id").alias(column), F.col("ordinal").cast("int").alias("place"))


def tool_results(calls: DataFrame, catalog: DataFrame, today: str) -> DataFrame:
    """call_id, query_type, count and result, a JSON object with what tool_rows finds for each call.

    Lists are in order of place. A call's whole result is one row, as its caller wants it.
    """
    one = F.struct("place", "meeting_id", "date", "name", "score")
    found = tool_rows(calls, catalog, today).groupBy("call_id", "query_type").agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), one))).alias("items"), F.max("error").alias("error"))
    rows = calls.select("call_id", F.coalesce("query_type", F.lit("null")).alias("query_type")).join(found, ["call_id", "query_type"], "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast(found.schema["items"].dataType)))
    listed = lambda c: F.filter(F.transform("items", lambda x: x[c]), lambda x: x.isNotNull())
    count = F.size("items")
    result = F.struct("query_type", listed("meeting_id").alias("meeting_ids"), listed("date").alias("dates"), listed("name").alias("names"), listed("score").alias("scores"), count.alias("count"), "error")
    return rows.select("call_id", "query_type", count.alias("count"), F.to_json(result).alias("result"))
