"""The registry of the library's own queries. Each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as meetings
from ..operators import agent, chunking, evaluate, filters, indexed, matching, render, retrieval, rewrite
from ..sources import index
from ..sources.meetings import paired
from . import standins as S
from .oracle import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "q20_hybrid_topk"
#: Cells of up to 100 that q19 looks into: the tables' vectors have no clusters, and fewer find less than nine tenths.
PROBES = 48


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def q01_paragraph_index(spark, sf_dir):
    rows = chunking.lines(S.read(spark, sf_dir, "documents"), "doc_id")
    return chunking.paragraph_index(rows, "doc_id").select("doc_id", "line_no", "is_start", "paragraph")


@query
def q02_paragraph_tag_transcript(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations")
    spoken = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("turn", spoken.alias("said"))))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "\n\n").alias("text"))
    rows = chunking.paragraph_index(chunking.lines(docs, "conv_id"), "conv_id")
    return chunking.tagged(rows, "conv_id")


@query
def q03_extract_topics(spark, sf_dir):
    found = T.topics(F.col("summary_text"), F.col("participants"))
    return S.summaries(spark, sf_dir).select("conv_id", F.posexplode(found).alias("topic_no", "topic"))


@query
def q04_extract_actions_assignee(spark, sf_dir):
    rows = S.summaries(spark, sf_dir).select("conv_id", "participants", F.posexplode(T.actions(F.col("summary_text"))).alias("action_no", "task"))
    number = F.concat(F.format_string("M%03d", "conv_id"), F.format_string("-A%02d", F.col("action_no") + 1))
    return rows.select("conv_id", number.alias("action_id"), "task", T.assignee(F.col("task"), F.col("participants")).alias("assignee"))


@query
def q05_participant_names(spark, sf_dir):
    names = F.filter(F.transform("participants", lambda p: T.strip(p)), lambda n: n != "")
    return S.summaries(spark, sf_dir).select(F.explode(names).alias("participant")).distinct()


@query
def q06_extract_summary_ids(spark, sf_dir):
    return S.summaries(spark, sf_dir).select("conv_id", F.posexplode(T.summary_ids(F.col("summary_text"))).alias("place", "summary_id"))


@query
def q07_extract_references(spark, sf_dir):
    return S.summaries(spark, sf_dir).select("conv_id", F.posexplode(T.references(F.col("summary_text"))).alias("place", "reference"))


@query
def q08_expand_paragraph_ranges(spark, sf_dir):
    key = F.col("o_orderkey").cast("int")
    text = F.format_string("P%03d–P%03d, P%d,x%d, P%03d-P%03d", key % 1200 + 4, key % 1200, key % 7, key % 5, key % 13, key % 13 + 2)
    rows = S.read(spark, sf_dir, "orders").select("o_orderkey", text.alias("reference"))
    return rows.select("o_orderkey", F.posexplode(T.paragraph_range(F.col("reference"))).alias("place", "paragraph"))


@query
def q09_entry_split(spark, sf_dir):
    found = chunking.entries(S.entry_texts(spark, sf_dir), "conv_id")
    return found.select("conv_id", "entry_no", "entry", T.entry_id(F.col("entry")).alias("entry_id"), T.entry_reference(F.col("entry")).alias("reference"))


@query
def q10_metadata_chunk_text(spark, sf_dir):
    rows = S.meetings(spark, sf_dir)
    text = chunking.metadata_text(F.array_join("topics", "; "), F.transform("action_tasks", lambda t: F.when(F.contains(t, F.lit(" N ")), F.lit("")).otherwise(t)))
    return rows.select("meeting_id", F.concat(F.col("meeting_id").cast("string"), F.lit("_metadata")).alias("chunk_id"), text.alias("text"))


@query
def q11_bullet_overlap_chunks(spark, sf_dir):
    return S.bulleted(spark, sf_dir).select("doc_id", F.posexplode(chunking.bullet_chunks(F.col("text"), 1200)).alias("chunk_no", "chunk"))


@query
def q12_markdown_sections(spark, sf_dir):
    return chunking.sections(S.entry_texts(spark, sf_dir), "conv_id")


@query
def q13_meeting_level_chunks(spark, sf_dir):
    rows = S.entry_texts(spark, sf_dir).select(F.format_string("data%03d", "conv_id").alias("meeting_id"), F.lit("Talk").alias("title"), F.lit(None).cast("string").alias("datetime"), F.col("text").alias("meeting_level_text"))
    return chunking.meeting_level(rows).withColumn("paragraph_indices", F.array_join("paragraph_indices", ","))


@query
def q14_recursive_split(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query
def q15_tokenize_term_stats(spark, sf_dir):
    return index.term_stats(S.texts(spark, sf_dir))


@query
def q16_bm25_topk(spark, sf_dir):
    return retrieval.bm25(S.texts(spark, sf_dir), S.queries(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


@query
def q17_dense_topk_exact(spark, sf_dir):
    return retrieval.dense(S.chunks(spark, sf_dir), S.queries(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


@query
def q18_embedding_normalise(spark, sf_dir):
    rows = S.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", retrieval.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.size("u").alias("dims"), F.round(retrieval.norm(F.col("embedding")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query
def q19_dense_topk_ivf(spark, sf_dir):
    return retrieval.ivf(S.chunks(spark, sf_dir), S.queries(spark, sf_dir), 10, probes=PROBES).select("query_id", "chunk_id", "score", "rank")


@query
def q20_hybrid_topk(spark, sf_dir):
    return retrieval.hybrid(S.texts(spark, sf_dir), S.queries(spark, sf_dir), 10, candidates=20, vectors=S.vectors(spark, sf_dir))


@query
def q21_hybrid_alpha_sweep(spark, sf_dir):
    asked = S.queries(spark, sf_dir)
    dense, sparse = retrieval.dense(S.vectors(spark, sf_dir), asked, 10), retrieval.bm25(S.texts(spark, sf_dir), asked, 10)
    found = None
    for alpha in (0.0, 0.3, 0.6, 1.0):
        own = retrieval.fuse(dense, sparse, 10, alpha).select(F.lit(alpha).alias("alpha"), "query_id", "chunk_id", "rank", "hybrid_score")
        found = own if found is None else found.unionByName(own)
    return found


@query
def q22_dense_filtered(spark, sf_dir):
    return retrieval.dense(S.chunks(spark, sf_dir), S.queries(spark, sf_dir), 10, S.scope(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query
def q23_bm25_filtered_local_stats(spark, sf_dir):
    return retrieval.bm25(S.texts(spark, sf_dir), S.queries(spark, sf_dir), 10, S.scope(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query
def q24_hybrid_meeting_filter_failopen(spark, sf_dir):
    return retrieval.hybrid(S.texts(spark, sf_dir), S.queries(spark, sf_dir), 10, scope=S.scope(spark, sf_dir), fail_open=True, vectors=S.vectors(spark, sf_dir))


def _entries(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("entry_id", F.format_string("M%03d", (F.col("chunk_id") % 12).cast("int")))


@query
def q25_hybrid_entry_filter_failclosed(spark, sf_dir):
    wanted = S.scope(spark, sf_dir).select("query_id", F.format_string("M%03d", (F.col("query_id") % 15).cast("int")).alias("entry_id"))
    return retrieval.by_entry(_entries(S.texts(spark, sf_dir)), S.queries(spark, sf_dir), wanted, 10, vectors=_entries(S.chunks(spark, sf_dir).drop("text")))


@query
def q26_hierarchical_search(spark, sf_dir):
    named = F.array(*[F.format_string("M%03d", ((F.col("chunk_id") + i) % 12).cast("int")) for i in (0, 5)])
    levels = lambda rows: (rows.filter("level = 'es'"), rows.filter("level = 'fr'").withColumn("references", named), _entries(rows.filter("level = 'en'")))
    return retrieval.hierarchical(*levels(S.texts(spark, sf_dir)), S.queries(spark, sf_dir), vectors=levels(S.chunks(spark, sf_dir).drop("text")))


@query
def q27_nested_filter_search(spark, sf_dir):
    lines = S.read(spark, sf_dir, "lineitem").join(S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    lines = lines.join(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    action = F.struct(F.col("p_name").alias("task"), F.col("l_returnflag").alias("status"), F.struct(F.col("s_name").alias("name"), F.array("l_linestatus", "l_returnflag").alias("aliases")).alias("assignee"))
    nested = lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.collect_list(action).alias("actions"))
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority")
    vectors = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    docs = vectors.join(orders, "chunk_id").join(nested, "chunk_id").withColumn("meeting_id", F.lit(""))
    fits = filters.compile(docs, {"actions.task": "red widget", "actions.status": ["A", "R"], "actions.assignee.aliases": "F", "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})
    return retrieval.dense(docs.filter(fits), S.queries(spark, sf_dir), 5).select("query_id", "chunk_id", "score", "rank")


@query
def q28_context_render(spark, sf_dir):
    hits = retrieval.dense(S.chunks(spark, sf_dir), S.queries(spark, sf_dir), 20)
    dated = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datetime"))
    named = hits.join(S.texts(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(dated.filter("chunk_id % 3 <> 0"), "chunk_id", "left")
    return render.contexts(named, 15)


@query
def q29_outline_render(spark, sf_dir):
    turns = S.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("point")))
    parts = turns.groupBy("conv_id", "role").agg(points.alias("bullet_points"))
    outlines = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("role").alias("topic_name"), "bullet_points"))).alias("second_level_topics"))
    return outlines.select("conv_id", render.outline(F.format_string("Conversation %d", "conv_id"), F.col("second_level_topics")).alias("outline"))


def _catalog(spark, sf_dir) -> DataFrame:
    return meetings.flatten(S.meetings(spark, sf_dir))


@query
def q30_catalog_flatten(spark, sf_dir):
    return _catalog(spark, sf_dir).drop("participants", "topics", "action_tasks")


@query
def q31_last_n_meetings(spark, sf_dir):
    return meetings.last_n(_catalog(spark, sf_dir), 10).select("meeting_id", "date", "participants_str")


@query
def q32_last_n_for_person(spark, sf_dir):
    return meetings.last_n(_catalog(spark, sf_dir), 0, "Supplier#000000001").select("meeting_id", "date", "participants_str")


@query
def q33_filter_by_person(spark, sf_dir):
    return meetings.by_person(_catalog(spark, sf_dir), "Supplier#000000002").select("meeting_id", "date", "topics_str")


@query
def q34_filter_by_date_range(spark, sf_dir):
    wanted = {"start": ("2000-06-01", None), "end": (None, "1996-02-29"), "both": ("1998-01-01", "1998-03-31")}
    return meetings.asked_of(_catalog(spark, sf_dir).select("meeting_id", "date"), {mode: meetings.in_range(*ends) for mode, ends in wanted.items()}, "mode")


@query
def q35_filter_by_year_month(spark, sf_dir):
    wanted = ((1997, 3), (1996, 0), (0, 12))
    return meetings.asked_of(_catalog(spark, sf_dir).select("meeting_id", "year", "month", "day"), {f"{year}-{month}": meetings.in_month(year, month) for year, month in wanted}, "asked")


@query
def q36_all_participants(spark, sf_dir):
    return meetings.participants(_catalog(spark, sf_dir))


@query
def q37_person_meeting_counts(spark, sf_dir):
    return meetings.person_counts(_catalog(spark, sf_dir))


def _names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts = S.read(spark, sf_dir, "part")
    swapped = F.concat(F.regexp_extract("p_name", r"^\S+\s+(\S+)", 1), F.lit(" "), F.substring("p_name", 1, 3))
    return parts.select(swapped.alias("name")).distinct(), parts.select(F.col("p_name").alias("candidate")).distinct()


@query
def q38_fuzzy_best_match(spark, sf_dir):
    return matching.best_match(*_names(spark, sf_dir))


@query
def q39_fuzzy_all_matches(spark, sf_dir):
    return matching.matches(*_names(spark, sf_dir), k=5)


def _detected(spark, sf_dir) -> DataFrame:
    return rewrite.detect(S.questions(spark, sf_dir), S.persons())


@query
def q40_detect_pronouns_persons(spark, sf_dir):
    return _detected(spark, sf_dir).select("question_id", *[F.array_join(c, ", ").alias(c) for c in ("persons", "pronouns", "time_terms")])


@query
def q41_resolve_entities(spark, sf_dir):
    return rewrite.resolve(_detected(spark, sf_dir), S.USER, S.TODAY).select("question_id", "resolved")


@query
def q42_last_n_pattern_rewrite(spark, sf_dir):
    return rewrite.rewrite_latest(S.questions(spark, sf_dir), _catalog(spark, sf_dir))


@query
def q43_planner_flags(spark, sf_dir):
    return rewrite.plan(S.questions(spark, sf_dir)).drop("text")


@query
def q44_retrieval_metrics(spark, sf_dir):
    labelled = S.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    wanted = asked.join(labelled.select(F.col("vec_id").alias("query_id"), "label"), "query_id", "left")
    hits = retrieval.dense(S.chunks(spark, sf_dir), S.queries(spark, sf_dir), 10)
    metrics = ["precision", "recall", "reciprocal_rank"]
    return evaluate.summary(evaluate.metrics_by_label(hits, wanted, labelled.withColumnRenamed("vec_id", "chunk_id"), 10), metrics)


@query
def q45_index_stats(spark, sf_dir):
    return index.stats(S.chunks(spark, sf_dir), ["en", "fr", "de", "es", "none"])


@query
def q46_incremental_new_chunks(spark, sf_dir):
    chunks = S.texts(spark, sf_dir)
    old = chunks.filter("meeting_id < 'src15'")
    both = index.upsert(old, index.unseen(chunks, old)).withColumn("length", F.length("text"))
    return both.groupBy("meeting_id", "level").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_chars"))


@query
def q47_pair_files_join(spark, sf_dir):
    both, only = paired(S.read(spark, sf_dir, "documents").select("doc_id", "lang"), S.read(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", F.lit("both").alias("side"), "lang", "quality").unionByName(only, allowMissingColumns=True)


@query
def q48_json_props_parse(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.filter("p._bad is null").groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def q49_summary_level_chunks(spark, sf_dir):
    rows = S.summaries(spark, sf_dir).select(F.format_string("data%03d", "conv_id").alias("meeting_id"), F.lit("Talk").alias("title"), F.lit(None).cast("string").alias("datetime"), "summary_text")
    found = chunking.summary_level(rows)
    return found.withColumn("summary_ids", F.array_join("summary_ids", ",")).withColumn("references", F.array_join("references", ","))


@query
def q50_reference_graph(spark, sf_dir):
    turns = S.entry_texts(spark, sf_dir)
    listed = chunking.entries(turns, "conv_id").select("conv_id", T.entry_id(F.col("entry")).alias("entry_id"), F.explode(T.paragraph_range(T.entry_reference(F.col("entry")))).alias("paragraph"))
    cited = S.summaries(spark, sf_dir).select("conv_id", F.explode(F.array_distinct(T.references(F.col("summary_text")))).alias("entry_id"))
    said = S.read(spark, sf_dir, "conversations").select("conv_id", F.format_string("#P%03d", (F.col("turn") + 1).cast("int")).alias("paragraph"), F.length("text").alias("n_chars"))
    return cited.join(listed, ["conv_id", "entry_id"]).join(said, ["conv_id", "paragraph"]).select("conv_id", "entry_id", "paragraph", "n_chars")


@query
def q51_extractive_answers(spark, sf_dir):
    hits = retrieval.bm25(S.texts(spark, sf_dir), S.queries(spark, sf_dir), 3)
    return render.answers(S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), hits.join(S.texts(spark, sf_dir).select("chunk_id", "text"), "chunk_id"))



@query
def q52_ask(spark, sf_dir):
    done = agent.ask(S.asked(spark, sf_dir), S.dated_texts(spark, sf_dir), S.talks(spark, sf_dir), S.persons(), S.USER, S.TODAY, vectors=S.vectors(spark, sf_dir))
    return _asked_columns(done)


def _asked_columns(done: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("chunks", lambda c: F.concat(c["chunk_id"].cast("string"), F.lit("@"), c["datetime"])), " ")
    return done.select("question_id", "need_rag", "need_rewrite", "answer_mode", "rewritten", F.array_join("meeting_ids", ", ").alias("meetings"), "skipped", "total_chunks", F.coalesce(listed, F.lit("")).alias("chunks"), "answer")


@query
def q53_index_bm25(spark, sf_dir):
    chunks = S.summaries_of_sources(spark, sf_dir)
    store, late = S.saved_index(spark), F.coalesce(F.col("meeting_id") >= "src15", F.lit(True))
    store.add(chunks.filter(~late))
    store.add(chunks.filter(late))
    return indexed.bm25(store, "summary", S.queries(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


@query
def q54_index_replaced_and_removed(spark, sf_dir):
    chunks = S.summaries_of_sources(spark, sf_dir)
    store = S.saved_index(spark)
    stale = chunks.withColumn("text", F.upper(F.substring("text", 1, 200))).withColumn("embedding", F.when(F.col("chunk_id") % 2 == 0, F.reverse("embedding")))
    store.add(stale)
    store.add(chunks)
    store.remove(chunks.filter("meeting_id = 'src3'"))
    return indexed.search_meetings(store, S.queries(spark, sf_dir), S.scope(spark, sf_dir), 10)


#: The languages of documents as levels.
AS_LEVELS = {"es": "metadata", "fr": "summary", "en": "meeting", "de": "chunk"}


def _levels(spark, sf_dir) -> DataFrame:
    """Documents as chunks of all levels, with entries and what refers to them."""
    level = F.element_at(F.create_map(*[F.lit(x) for pair in AS_LEVELS.items() for x in pair]), F.col("level"))
    named = F.array(*[F.format_string("M%03d", ((F.col("chunk_id") + i) % 12).cast("int")) for i in (0, 5)])
    return _entries(S.chunks(spark, sf_dir)).withColumn("level", level).withColumn("references", named)


@query
def q55_index_levels(spark, sf_dir):
    store = S.saved_index(spark)
    store.add(_levels(spark, sf_dir))
    return store.stats()


@query
def q56_index_hierarchical(spark, sf_dir):
    store = S.saved_index(spark)
    store.add(_levels(spark, sf_dir))
    return indexed.hierarchical(store, S.queries(spark, sf_dir))


@query
def q57_index_filtered_knn(spark, sf_dir):
    lines = S.read(spark, sf_dir, "lineitem").join(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    action = F.struct(F.col("p_name").alias("task"), F.col("l_returnflag").alias("status"))
    nested = lines.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.array_sort(F.collect_list(action)).alias("actions"))
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority")
    store = S.saved_index(spark)
    store.add(S.summaries_of_sources(spark, sf_dir).join(orders, "chunk_id", "left").join(nested, "chunk_id", "left"))
    sources = [f"src{i}" for i in range(0, 20, 2)]
    return indexed.knn(store, "summary", S.queries(spark, sf_dir), 5, {"actions.task": "red widget", "actions.status": ["A", "R"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, sources, ("meeting_id", "o_orderpriority"))


@query
def q58_index_ask(spark, sf_dir):
    chunks = S.dated_chunks(spark, sf_dir).withColumn("level", F.lit("summary"))
    store = S.saved_index(spark)
    store.add(chunks)
    done = agent.ask(S.asked(spark, sf_dir), store, S.talks(spark, sf_dir), S.persons(), S.USER, S.TODAY)
    return _asked_columns(done)


@query
def q59_catalog_tool_calls(spark, sf_dir):
    calls = S.tool_calls(spark, sf_dir).filter("query_type <> 'find_person'")
    return meetings.tool_rows(calls, _catalog(spark, sf_dir), S.TODAY).drop("score")


@query
def q60_find_person_calls(spark, sf_dir):
    calls = S.tool_calls(spark, sf_dir).filter("query_type = 'find_person'")
    return meetings.tool_rows(calls, _catalog(spark, sf_dir), S.TODAY).select("call_id", "place", "name", "score", "error")
