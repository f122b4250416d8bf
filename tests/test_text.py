from pyspark.sql import functions as F

from lodestrand.functions import dates
from lodestrand.functions import text as T


def value(spark, expression, **columns):
    row = [tuple(columns.values())]
    schema = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame(row, schema).select(expression.alias("x")).first()["x"]


def test_tokens_of_any_script(spark):
    assert value(spark, T.tokens(F.col("t")), t="Élan vital, naïve_x 42! don't 会议") == ["élan", "vital", "naïve_x", "42", "don", "t", "会议"]
    assert value(spark, T.tokens(F.col("t")), t="") == []
    assert value(spark, T.tokens(F.col("t")), t=None) == []


def test_topics_lose_asterisks_and_fall_back(spark):
    text = "- **[S001-T01] Topic: Roadmap**\n  x\n- **[S001-T02] Topic: **\n- [S001-T03] Topic:  Hiring *"
    assert value(spark, T.topics(F.col("t")), t=text) == ["Roadmap", "Hiring"]
    assert value(spark, T.topics(F.col("t"), F.array(F.lit("a"))), t="nothing") == ["a"]


def test_assignee_is_the_first_name_that_fits(spark):
    names = F.array(F.lit("Ann Lee"), F.lit("Ann"), F.lit("Bo"))
    assert value(spark, T.assignee(F.col("t"), names), t="ann to write") == "Ann Lee"
    assert value(spark, T.assignee(F.col("t"), names), t="BO to write to Ann") == "Bo"
    assert value(spark, T.assignee(F.col("t"), names), t="write it") is None
    assert value(spark, T.assignee(F.col("t"), names), t=" to write") is None


def test_references_ignore_stray_marks(spark):
    text = "M000-T01\nReference: M001-T01, M001-T02)\n  Reference: M001-A01, M001-T01"
    assert value(spark, T.references(F.col("t")), t=text) == ["M001-T01", "M001-T02", "M001-A01", "M001-T01"]
    assert value(spark, T.references(F.col("t")), t="M9-T9 Reference: M1-T1 Reference: M2-A2") == ["M1-T1", "M2-A2"]
    assert value(spark, T.summary_ids(F.col("t")), t="[S001-T01] x [S002-A03] (S1-T1)") == ["S001-T01", "S002-A03"]


def test_paragraph_ranges(spark):
    def expand(t):
        return value(spark, T.paragraph_range(F.col("t")), t=t)

    assert expand("P005-P003") == ["#P003", "#P004", "#P005"]
    assert expand("P001-P003,P002") == ["#P001", "#P002", "#P003"]
    assert expand("Pxx, P004, P7-") == ["#P004"]
    assert expand("P005–P006, P1200") == ["#P005", "#P006", "#P1200"]
    assert expand("") == []


def test_entry_keys_and_fences(spark):
    entry = "- **Topic Title:** A\n  - Topic id: M001-T01\n  - Reference: P001\n"
    assert value(spark, T.entry_id(F.col("t")), t=entry) == "M001-T01"
    assert value(spark, T.entry_reference(F.col("t")), t=entry) == "P001"
    assert value(spark, T.entry_reference(F.col("t")), t="x\n   Reference: P9") == "P9"
    assert value(spark, T.entry_reference(F.col("t")), t="said Reference: P7\n- Reference: P8") == "P8"
    assert value(spark, T.entry_reference(F.col("t")), t="said Reference: P7") == "P7"
    assert value(spark, T.entry_reference(F.col("t")), t="Reference: P7") is None
    assert value(spark, T.entry_id(F.col("t")), t="none") is None
    assert value(spark, T.without_fence(F.col("t")), t='a ```json\n{"x": 1}\n``` b') == '{"x": 1}'
    assert value(spark, T.without_fence(F.col("t")), t=" plain ") == "plain"
    assert value(spark, T.file_number(F.col("t")), t="/a/b/data014.md") == 14
    assert value(spark, T.numbered(F.col("t"), F.lit(7)), t="dataXXX.md") == "data007.md"


def test_local_date_is_never_moved(spark):
    def day(t):
        return value(spark, dates.local_date(F.col("t")), t=t)

    assert day("2025-11-30T01:36:00+08:00") == "2025-11-30"
    assert day("2025-11-30T01:36:00Z") == "2025-11-30"
    assert day("2025-11-30 09:00") == "2025-11-30"
    assert day(None) == "" and day("") == ""
    assert value(spark, dates.part(dates.local_date(F.col("t")), 1), t="2025-11-30T01:00:00Z") == 11
    assert value(spark, dates.part(dates.local_date(F.col("t")), 0), t=None) is None


def test_days_in_words(spark):
    def day(t):
        return value(spark, dates.resolve(F.col("t"), F.lit("2024-03-31")), t=t)

    assert day("Yesterday") == "2024-03-30"
    assert day("2 weeks ago") == "2024-03-17"
    assert day("last month") == "2024-02-29"
    assert day("next week") == "2024-04-07"
    assert day("on 2023-01-02") == "2023-01-02"
    assert day("some day") is None
    assert day("3 years ago") == "2021-03-31"
    assert day("the day before yesterday") == "2024-03-29"


def test_months_by_name(spark):
    def day(t, today="2024-03-31"):
        return value(spark, dates.resolve(F.col("t"), F.lit(today)), t=t)

    assert day("November 2025") == "2025-11-30" and day("November") == "2024-11-30"
    assert day("February") == "2024-02-29" and day("february 2023", "2024-03-15") == "2023-02-15"
    assert day("5 June 2023") == day("June 5, 2023") == day("June 5th 2023") == "2023-06-05"
    assert day("May 7") == "2024-05-07" and day("31 april") == "2024-04-30"
    assert day("monthly") is None and day("0 May") is None and day(None) is None
