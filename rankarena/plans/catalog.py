"""Queries over the test tables, one or more for each operator of the library."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.functions import ids, scores, text
from rankarena.operators import corpus, ensemble, features, neural, pairs, prompts, ranking, rounds, term_store, terms, training
from rankarena.plans import competition as arena
from rankarena.sources import map_files, quoted_csv, results, sinks, tables, trec
from rankarena.sources.scratch import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    # Rounding to twelve digits first takes off the noise of the summation order, which decides exact halves;
    # adding zero turns a negative zero into a plain one.
    return df.withColumns({c: F.round(F.round(c, 12), digits) + F.lit(0.0) for c in names})


# Identifiers and scalar functions


@query
def decode_docno(spark: SparkSession, sf_dir: str) -> DataFrame:
    docnos = arena.entries(spark, sf_dir).select("docno")
    return docnos.select("docno", *[c.alias(n) for n, c in ids.docno_parts(F.col("docno"), strict=True).items()])


@query
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = arena.table(spark, sf_dir, "orders")
    epoch = F.format_string("EPOCH-%02d-%d-%d", F.lit(1), F.col("o_custkey"), F.col("o_orderkey"))
    return orders.select(
        "o_orderkey",
        ids.canonical_query_id(F.col("o_custkey")).alias("query_id"),
        ids.zero_fill(F.col("o_custkey").cast("string"), F.length(F.col("o_orderkey").cast("string"))).alias("filled"),
        ids.epoch_to_round(epoch).alias("docno"),
        ids.last_segment(epoch).alias("author"),
        ids.internal_doc_id(ids.internal_docno(F.col("o_orderkey").cast("string"))).alias("doc_id"),
    )


@query
def word_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = arena.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    flagged = ranking.candidates_within_limit(messages)
    return flagged.select("conv_id", "turn", text.word_count(F.col("text")).alias("words"), "accepted")


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = arena.table(spark, sf_dir, "documents")
    body = F.col("text")
    return documents.select(
        "doc_id",
        text.strip(body).alias("stripped"),
        text.escape_markup(body).alias("escaped"),
        text.single_quotes(text.remove_backslashes(body)).alias("requoted"),
        text.unquoted_literal(body).alias("literal"),
    )


@query
def rank_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = arena.entries(spark, sf_dir, authors=arena.WIDE_AUTHORS)
    return wide.select("docno", F.concat(F.col("pos").cast("string"), text.ordinal_suffix(F.col("pos"))).alias("place"))


@query
def bot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arena.entries(spark, sf_dir)
    kind = F.when(F.col("pos") == 1, "tops").when(F.col("pos") == 2, "self").otherwise("all")
    return rows.select("docno", ids.bot_name_column(kind, F.col("qrel") == 1).alias("bot"))


@query
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = arena.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    scored = vectors.select(
        "vec_id",
        scores.relevance_from_logits(F.col("v")).alias("score"),
        scores.relevance_from_logits(F.slice("v", 1, 1)).alias("single"),
    )
    return _rounded(scored, ["score", "single"])


@query
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = arena.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    overall = features.normalise_scores(prices).select("o_orderkey", F.col("score").alias("overall"))
    per_customer = features.normalise_scores(prices, scope_cols=["o_custkey"])
    return _rounded(per_customer.join(overall, "o_orderkey"), ["score", "overall"])


@query
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = arena.table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id", scores.completion_tokens(scores.estimated_tokens(F.col("text"))).alias("max_tokens")
    ).withColumn("skipped", F.col("max_tokens") <= 0)


# Files


@query
def trectext_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arena.competition(spark, sf_dir).select("docno", "text")
    path = scratch_path(spark, "trectext")
    sinks.write_trectext(docs, path)
    return trec.read_trectext(spark, path)


@query
def assemble_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the competition as its five files, read these and join them again."""
    comp = arena.competition(spark, sf_dir)
    narrow = arena.entries(spark, sf_dir)
    path = scratch_path(spark, "corpus")
    sinks.write_trectext(comp, f"{path}/documents")
    epochs = narrow.withColumn("docno", F.regexp_replace("docno", "^ROUND", "EPOCH"))
    sinks.write_judgements(epochs, f"{path}/quality", value="qrel")
    sinks.write_judgements(narrow, f"{path}/relevance", value="ksrel")
    sinks.write_judgements(narrow, f"{path}/positions", value="pos")
    # Query ids without their zeros, the way query files have them.
    asked = arena.queries_table(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("int").cast("string"))
    sinks.write_queries(asked, f"{path}/queries")
    return corpus.assemble_corpus(
        docs=trec.read_trectext(spark, f"{path}/documents"),
        quality=trec.read_judgements(spark, f"{path}/quality", value="qrel", epoch_docnos=True),
        relevance=trec.read_judgements(spark, f"{path}/relevance", value="ksrel"),
        positions=trec.read_judgements(spark, f"{path}/positions", value="pos"),
        queries=trec.read_queries(spark, f"{path}/queries"),
    )


@query
def qrels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = arena.entries(spark, sf_dir).withColumn("docno", F.regexp_replace("docno", "^ROUND", "EPOCH"))
    path = scratch_path(spark, "qrels")
    sinks.write_judgements(epochs, path, value="qrel")
    return trec.read_qrels(spark, path)


@query
def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "run")
    sinks.write_working_set(arena.entries(spark, sf_dir), path)
    return trec.read_run(spark, path)


@query
def svmlight_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    rows = _corpus_features(spark, sf_dir).withColumn("label", F.lit(0))
    sinks.write_features(rows, path, with_label=False)
    return _rounded(trec.read_features(spark, path), schema.FEATURE_COLUMNS)


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv_table(arena.competition(spark, sf_dir), path)
    return tables.read_csv_table(spark, path, schema.COMPETITION)


def _csv_pairs(spark: SparkSession, found: DataFrame) -> DataFrame:
    path = scratch_path(spark, "csv-pairs")
    sinks.write_csv_table(found.select(*schema.PAIRS.names), path)
    return quoted_csv.read_quoted_csv(spark, path, schema.PAIRS)


@query
def csv_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of improvements as a file with prompts and completions, and back."""
    return _csv_pairs(spark, improvement_pairs(spark, sf_dir))


@query
def csv_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_pairs(spark, sf_dir)
    back = _csv_pairs(spark, found.withColumns({c: F.lit(0) for c in ("delta", "delta_2", "delta_3")}))
    return back.select(*found.columns)


@query
def epoch_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "epochs")
    states = arena.epoch_history(spark, sf_dir, bot_type="all").unionByName(
        arena.epoch_history(spark, sf_dir, bot_type="tops")
    )
    sinks.write_epoch_states(states, path)
    return tables.read_epoch_states(spark, path)


@query
def epoch_map_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files for each field, and back."""
    path = scratch_path(spark, "maps")
    fields = map_files.write_epoch_map_files(arena.epoch_history(spark, sf_dir, bot_type="all"), path)
    return map_files.read_epoch_map_lines(spark, path, fields=fields)


@query
def generated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come back in two runs, the first of which is repeated: topics with the documents that fit."""
    path = scratch_path(spark, "results")
    topics = arena.topics_table(spark, sf_dir)
    # The text of a document stands in for what is generated for its topic.
    made = topics.select("topic_id", F.col("backstory").alias("doc"))
    first = made.where(F.pmod(F.xxhash64("topic_id"), F.lit(2)) == 0)
    for batch, some in (("run-1", first), ("run-1", made.limit(0)), ("run-2", made)):
        waiting = results.waiting_topics(topics, path)
        results.commit_batch(some.join(waiting.select("topic_id"), "topic_id", "left_semi"), path, batch)
    told = results.read_results(spark, path).select("topic_id", "accepted")
    return results.topics_with_documents(topics, results.read_results(spark, path)).join(told, "topic_id").select("topic_id", "topic_title", "doc", "accepted")


@query
def topics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "topics")
    sinks.write_topics(arena.topics_table(spark, sf_dir), path)
    topics = tables.read_topics(spark, path)
    return topics.select(
        "topic_id", "topic_title", F.array_join("queries", "|").alias("queries"), "description", "backstory"
    )


@query
def queries_xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.queries_xml_lines(arena.queries_table(spark, sf_dir))


# Corpus and rounds


@query
def query_docnos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.query_docnos(arena.entries(spark, sf_dir))


@query
def working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_lines(corpus.working_set(arena.entries(spark, sf_dir)))


@query
def last_round_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.field_texts(arena.competition(spark, sf_dir))


@query
def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reference_texts(arena.competition(spark, sf_dir))


@query
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.winners(arena.entries(spark, sf_dir)).select("query_id", "round_number", "author_id", "docno")


@query
def contested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.contested(arena.entries(spark, sf_dir))
    return rows.select("query_id", "round_number", "docno")


@query
def field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.field_sizes(arena.entries(spark, sf_dir))


@query
def query_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.query_index(arena.competition(spark, sf_dir))


@query
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.participants(arena.entries(spark, sf_dir))


@query
def rank_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = rounds.rank_deltas(arena.entries(spark, sf_dir))
    return deltas.select("docno", "pos", "delta", "delta_2", "delta_3")


@query
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.trajectories(rounds.rank_deltas(arena.entries(spark, sf_dir)))


@query
def trajectory_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.trajectory_spans(arena.entries(spark, sf_dir))


# Pairs


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.rank_deltas(arena.asked_entries(spark, sf_dir))


@query
def improvement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.improvement_pairs(_deltas(spark, sf_dir), texts=arena.texts(spark, sf_dir))


@query
def dropped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows form no pair for want of another text, counted while the pairs are computed."""
    told = []
    for name, made in (
        ("improvements", lambda c: pairs.improvement_pairs(_deltas(spark, sf_dir), texts=arena.texts(spark, sf_dir), counts=c)),
        ("improvements_by_lag", lambda c: pairs.improvement_pairs(_deltas(spark, sf_dir), texts=arena.texts(spark, sf_dir), match_lag=True, counts=c)),
        ("tops", lambda c: pairs.top_pairs(arena.asked_entries(spark, sf_dir), texts=arena.texts(spark, sf_dir), counts=c)),
    ):
        counts = Observation(name)
        # The pairs are computed as a whole, and not kept.
        made(counts).write.format("noop").mode("overwrite").save()
        told.append((name, counts.get["rows"], counts.get["without_other_text"]))
    return spark.createDataFrame(told, "pairs string, rows bigint, dropped bigint")


@query
def improvement_pairs_match_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.improvement_pairs(_deltas(spark, sf_dir), texts=arena.texts(spark, sf_dir), match_lag=True, clean_all=True)


@query
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.top_pairs(arena.asked_entries(spark, sf_dir), texts=arena.texts(spark, sf_dir))


@query
def top_pairs_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, texts = (f(spark, sf_dir, authors=arena.WIDE_AUTHORS) for f in (arena.asked_entries, arena.texts))
    return pairs.top_pairs(wide, texts=texts, legacy=True, direction="worse_to_better")


@query
def finetune_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arena.competition(spark, sf_dir)
    cleaned = text.remove_backslashes(F.col("text"))
    return rows.select("docno", text.fine_tune_prompt(cleaned, F.col("query")).alias("prompt"))


@query
def near_top_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = arena.entries(spark, sf_dir, authors=arena.WIDE_AUTHORS)
    return wide.where(pairs.near_top(legacy=True)).select("docno", "pos", "ksrel")


# Learning to rank


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.competition(spark, sf_dir).select("docno", "query_id", "round_number", "text")


def _corpus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ltr_features(
        docs=_docs(spark, sf_dir),
        queries=arena.queries_table(spark, sf_dir),
        scores=arena.embedding_scores(spark, sf_dir),
        mode="test",
    )


@query
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.doc_lengths(terms.forward_index(_docs(spark, sf_dir)))


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(terms.build_index(_docs(spark, sf_dir)).terms, ["idf"])


@query
def term_stats_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of an index to which rounds are added one after another."""
    path, docs = scratch_path(spark, "term-store"), _docs(spark, sf_dir)
    # Parts of the competition; each round has many documents.
    for part in range(3):
        term_store.add_round(docs.where(F.col("round_number") % 3 == part), path, part)
    return _rounded(term_store.open_index(spark, path).terms, ["idf"])


@query
def scoped_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(terms.build_index(_docs(spark, sf_dir), scope_cols=ranking.FIELD).terms, ["idf"])


@query
def ltr_features_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_corpus_features(spark, sf_dir), schema.FEATURE_COLUMNS)


@query
def ltr_features_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.ltr_features(
        docs=_docs(spark, sf_dir),
        queries=arena.queries_table(spark, sf_dir),
        scores=arena.embedding_scores(spark, sf_dir),
        scope_cols=ranking.FIELD,
        mode="test",
    )
    return _rounded(rows, schema.FEATURE_COLUMNS)


@query
def ltr_train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = arena.entries(spark, sf_dir).select("query_id", "docno", F.col("qrel").alias("rel"))
    rows = features.ltr_features(
        docs=_docs(spark, sf_dir),
        queries=arena.queries_table(spark, sf_dir),
        scores=arena.embedding_scores(spark, sf_dir),
        qrels=labels,
    )
    rows = _rounded(rows, schema.FEATURE_COLUMNS)
    return rows.select(sinks.feature_line(rows, decimals=6).alias("value"))


@query
def training_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files of documents, queries and judgements to a file of labelled rows, the way a ranker is prepared."""
    path = scratch_path(spark, "training-file")
    sinks.write_trectext(arena.competition(spark, sf_dir), f"{path}/documents")
    epochs = arena.entries(spark, sf_dir).withColumn("docno", F.regexp_replace("docno", "^ROUND", "EPOCH"))
    sinks.write_judgements(epochs, f"{path}/qrels", value="qrel")
    sinks.write_queries(arena.queries_table(spark, sf_dir), f"{path}/queries")
    read = trec.read_trectext(spark, f"{path}/documents")
    docs = read.select("docno", *[c.alias(n) for n, c in ids.docno_parts(F.col("docno"), strict=True).items() if n != "author_id"], "text")
    rows = features.ltr_features(
        docs=docs,
        queries=trec.read_queries(spark, f"{path}/queries").withColumn("query_id", ids.canonical_query_id(F.col("query_id"))),
        scores=arena.embedding_scores(spark, sf_dir),
        qrels=trec.read_qrels(spark, f"{path}/qrels"),
    )
    sinks.write_features(_rounded(rows, schema.FEATURE_COLUMNS), f"{path}/features", decimals=6)
    return spark.read.text(f"{path}/features")


@query
def neural_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features.normalise_scores(arena.embedding_scores(spark, sf_dir), scope_cols=ranking.FIELD)
    return _rounded(scored, ["score"])


def _ensemble_scores(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    rows = _corpus_features(spark, sf_dir)
    model = arena.example_model(spark)
    return ensemble.score_ensemble(rows, model, keep=["query_id", "docno"], strategy=strategy)


@query
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scores(spark, sf_dir, "auto")


@query
def ensemble_scores_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scores(spark, sf_dir, "arrays")


@query
def ensemble_scores_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scores(spark, sf_dir, "joins")


@query
def ensemble_scores_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scores(spark, sf_dir, "blocks")


def load_vowel_scorer() -> neural.Scorer:
    """Stands in for a model: two logits, the second one is the share of vowels in query and text."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        inputs = [q + t for q, t in zip(queries, texts, strict=True)]
        return np.array([[0.0, sum(map(i.count, "aeiou")) / max(len(i), 1)] for i in inputs])

    return score


@query
def neural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_of = neural.query_document_pairs(_docs(spark, sf_dir), arena.queries_table(spark, sf_dir))
    return _rounded(neural.neural_scores(pairs_of, load_vowel_scorer, keep=["docno"]), ["score"])


@query
def rank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_fields(
        docs=_docs(spark, sf_dir),
        queries=arena.queries_table(spark, sf_dir),
        model=arena.example_model(spark),
        scores=arena.embedding_scores(spark, sf_dir),
    )


def _judged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the documents that ``labels`` has, with their quality as label."""
    judged = arena.entries(spark, sf_dir).join(arena.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    labels = judged.select("query_id", "docno", F.col("qrel").alias("rel"))
    rows = features.ltr_features(
        docs=_docs(spark, sf_dir).join(judged.select("docno"), "docno", "left_semi"),
        queries=arena.queries_table(spark, sf_dir),
        scores=arena.embedding_scores(spark, sf_dir),
        qrels=labels,
    )
    return _rounded(rows, schema.FEATURE_COLUMNS)


@query
def trained_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a trained ensemble ranks the judged documents of queries that it hasn't seen, beside each feature alone."""
    rows = written(_judged_features(spark, sf_dir), "judged")
    unseen = F.pmod(F.xxhash64("query_id"), F.lit(4)) == 0
    model = training.train_ensemble(
        rows.where(~unseen), scope_cols=["query_id"], settings=training.Settings(trees=12, depth=4, learning_rate=0.2)
    )
    scored = ensemble.score_ensemble(rows.where(unseen), model, keep=["query_id", "docno", "label", *schema.FEATURE_COLUMNS])
    rankers = {"ensemble": "score"} | {c: c for c in schema.FEATURE_COLUMNS}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("ranker"), F.col(c).alias("score")) for name, c in rankers.items()]))
    told = scored.select("query_id", "docno", "label", each.alias("r")).select("query_id", "docno", "label", "r.*")
    by_field = training.ndcg(told, scope_cols=["ranker", "query_id"])
    return by_field.groupBy("ranker").agg(F.count(F.lit(1)).alias("fields"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


# Competition steps and prompts


@query
def epoch_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = arena.competition(spark, sf_dir).select(
        "query_id", F.col("round_number").alias("epoch"), "author_id", "text"
    )
    return ranking.epoch_step(
        field=field,
        candidates=arena.candidate_texts(spark, sf_dir),
        queries=arena.queries_table(spark, sf_dir),
        model=arena.example_model(spark),
        load_scorer=load_vowel_scorer,
    )


@query
def opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = arena.epoch_history(spark, sf_dir, bot_type="all")
    return ranking.opponents(states).select("query_id", "epoch", "author_id", "rank")


def _history_prompts(spark: SparkSession, sf_dir: str, bot_type: str, markov: bool, epoch: int | str | None) -> DataFrame:
    return prompts.history_prompts(
        arena.epoch_history(spark, sf_dir, bot_type=bot_type, markov=markov),
        corpus.reference_texts(arena.competition(spark, sf_dir)),
        bot_type=bot_type,
        markov=markov,
        epoch=epoch,
    )


@query
def history_prompts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "all", False, None)


@query
def history_prompts_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "tops", False, None)


@query
def history_prompts_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "self", False, None)


@query
def history_prompts_all_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "all", True, prompts.EVERY)


@query
def history_prompts_tops_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "tops", True, prompts.EVERY)


@query
def history_prompts_self_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_prompts(spark, sf_dir, "self", True, prompts.EVERY)


@query
def history_prompts_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six bots and all epochs, from one written table of states."""
    path = scratch_path(spark, "states")
    sinks.write_epoch_states(arena.epoch_histories(spark, sf_dir), path, by_bot=False, compression="gzip")
    references = corpus.reference_texts(arena.asked_entries(spark, sf_dir), texts=arena.texts(spark, sf_dir))
    return prompts.all_prompts(tables.read_epoch_states(spark, path), references)


@query
def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.token_budgets(_history_prompts(spark, sf_dir, "all", True, prompts.EVERY))


@query
def sendable_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = prompts.sendable_prompts(_history_prompts(spark, sf_dir, "all", True, prompts.EVERY))
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return packed.select("query_id", "bot", "epoch", "max_tokens", "skipped", told.alias("conversation"))


@query
def initial_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prompts.initial_prompts(arena.topics_table(spark, sf_dir))
    return made.select("topic_id", "description", "prompt")


@query
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = arena.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("topic_id"))
    return prompts.initial_prompts(arena.topics_table(spark, sf_dir), done=done).select("topic_id", "prompt")
