import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.functions.ids import bot_name
from rankarena.operators import prompts

TEXTS = {
    (1, "BOT"): "my first\ntext",
    (1, "04"): "it's \"quoted\"",
    (1, "07"): "back\\slash, it's",
    (2, "BOT"): "my second text",
    (2, "04"): "tab\there",
    (2, "07"): "plain",
}
RANKS = {(1, "BOT"): 3, (1, "04"): 1, (1, "07"): 2, (2, "BOT"): 1, (2, "04"): 3, (2, "07"): 2}


def history(spark, name):
    values = [
        ("001", e, name, name if a == "BOT" else a, t, RANKS[(e, a)]) for (e, a), t in TEXTS.items()
    ]
    return spark.createDataFrame(values, schema.EPOCH_STATE)


def references(spark):
    return spark.createDataFrame([("001", "a query", "reference")], "query_id string, query string, reference_text string")


REQUEST = ("user", "Generate a single text that addresses the information need for all queries.")
OPENING = [
    ("system", "You are a contestant in an information retrieval SEO competition."),
    ("system", "The competition involves 1 queries: a query"),
    ("system", "The goal is to have your document be ranked 1st (first) and win in the ranking done by a black "
               "box ranker in every single epoch."),
    ("system", "All contestants got an initial reference text: 'reference'."),
    REQUEST,
]
FIRST = [("assistant", "my first\ntext"), ("system", "You were ranked 3rd in this epoch")]
SECOND = [("assistant", "my second text"), ("system", "You were ranked 1st in this epoch")]
TOLD = "The ranked documents of your opponents in this epoch are as follows:\n "
# What is told of epochs 1 and 2, by kind of bot.
EPOCHS = {
    "self": ([*FIRST, REQUEST], [*SECOND, REQUEST]),
    "tops": (
        [*FIRST, ("system", "The document ranked 1 in this epoch was: it's \"quoted\""), REQUEST],
        [*SECOND, ("system", "The document ranked 1 in this epoch was: my second text"), REQUEST],
    ),
    "all": (
        [
            *FIRST,
            ("system", TOLD + r"{ranked 1: it\s quoted\n\n, ranked 2: back\\slash, its\n\n}"),
            REQUEST,
        ],
        [*SECOND, ("system", TOLD + r"{ranked 2: plain\n\n, ranked 3: tab\there\n\n}"), REQUEST],
    ),
}


def expected_messages(kind, epochs):
    return OPENING + [message for e in epochs for message in EPOCHS[kind][e - 1]]


@pytest.mark.parametrize("kind", ["all", "tops", "self"])
@pytest.mark.parametrize("markov", [False, True])
@pytest.mark.parametrize("epoch", [None, 1, 2])
def test_history_prompts(spark, kind, markov, epoch):
    name = bot_name(kind, markov)
    made = prompts.history_prompts(history(spark, name), references(spark), bot_type=kind, markov=markov, epoch=epoch)
    target = epoch or 3
    epochs = range(max(target - 1, 1) if markov else 1, target)
    told = {}
    for r in sorted(made.collect(), key=lambda r: (r.seq, r.part)):
        assert (r.query_id, r.bot, r.epoch) == ("001", name, target)
        role, content = told.get(r.seq, (r.role, ""))
        assert role == r.role
        told[r.seq] = (role, content + r.content)
    assert [told[s] for s in sorted(told)] == expected_messages(kind, epochs)
    packed = prompts.sendable_prompts(made).first()
    assert [(m.role, m.content) for m in packed.messages] == expected_messages(kind, epochs)


@pytest.mark.parametrize("kind", ["all", "tops", "self"])
@pytest.mark.parametrize("markov", [False, True])
def test_every_epoch_at_once(spark, kind, markov):
    states = history(spark, bot_name(kind, markov))
    several = prompts.history_prompts(states, references(spark), bot_type=kind, markov=markov, epoch=prompts.EVERY)
    columns = several.columns
    one_by_one = [
        r
        for epoch in (1, 2, 3)
        for r in rows(
            prompts.history_prompts(states, references(spark), bot_type=kind, markov=markov, epoch=epoch), *columns
        )
    ]
    assert sorted(rows(several, *columns)) == sorted(one_by_one)
    # The other bots have no states, so they have no prompts.
    assert sorted(rows(prompts.all_prompts(states, references(spark)), *columns)) == sorted(one_by_one)


def test_prompts_that_do_not_fit_are_flagged(spark):
    made = prompts.history_prompts(history(spark, "NMABOT"), references(spark), bot_type="all")
    short = made.select("query_id", "bot", "epoch", "seq", "part", "role", "content")
    long = short.where("seq = 0").withColumn("query_id", F.lit("002")).withColumn("content", F.repeat(F.lit("x"), 20000))
    both = short.unionByName(long)
    assert rows(prompts.token_budgets(both), "query_id", "skipped") == [("001", False), ("002", True)]
    packed = {r.query_id: r for r in prompts.sendable_prompts(both).collect()}
    assert (packed["001"].skipped, packed["002"].skipped, packed["002"].messages) == (False, True, None)
    assert len(packed["001"].messages) == 13
    counted = prompts.token_budgets(long, tokens=F.lit(3247)).first()
    assert (counted.prompt_tokens, counted.max_tokens, counted.skipped) == (3247, 600, False)


def test_initial_prompts_resume(spark):
    topics = spark.createDataFrame(
        [("1", "t", ['a "x"', "b", "c"], 'say "d"', 'I "want"'), ("2", "t", ["a", "b", "c"], "d", "s")], schema.TOPICS
    )
    made = prompts.initial_prompts(topics, done=topics.where("topic_id = 2"))
    row = made.collect()
    assert [r.topic_id for r in row] == ["1"]
    assert "'a 'x'','b', 'c'" in row[0].prompt and "Scenario: I 'want'" in row[0].prompt and row[0].description == "say 'd'"


def test_messages_are_made_before_they_are_repeated(spark):
    made = prompts.history_prompts(history(spark, "NMABOT"), references(spark), bot_type="all", epoch=prompts.EVERY)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    told = [line.rsplit("[", 1)[1].split("#")[0] for line in plan.splitlines() if "Generate explode" in line]
    # From the top: the opening's messages for each epoch; then the epochs of each message of a state.
    assert told == ["m", "target", "target", "m"]


def test_states_of_all_bots_take_little_space(spark):
    import glob
    import os

    from rankarena.plans.catalog import QUERIES

    sf_dir, shared = "/root/testdata/sf0.001", spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{shared}/states-*"))
    made = QUERIES["history_prompts_every"](spark, sf_dir)
    (path,) = set(glob.glob(f"{shared}/states-*")) - before
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    # Six bots have a state of each text.
    assert size < 2 * text
    assert {r["bot"] for r in made.select("bot").distinct().collect()} == {bot_name(kind, m) for kind in ("all", "tops", "self") for m in (False, True)}


def test_all_bots_at_once_are_each_alone(spark):
    bots = [(kind, markov) for kind in ("all", "tops", "self") for markov in (False, True)]
    # The last bot has an epoch less than the others.
    states = [history(spark, bot_name(*b)).where(F.col("epoch") < (3 if b != bots[-1] else 2)) for b in bots]
    alone = [
        prompts.history_prompts(s, references(spark), bot_type=kind, markov=markov, epoch=prompts.EVERY)
        for s, (kind, markov) in zip(states, bots, strict=True)
    ]
    together = states[0]
    for s in states[1:]:
        together = together.unionByName(s)
    columns = alone[0].columns
    assert sorted(rows(prompts.all_prompts(together, references(spark)), *columns)) == sorted(r for a in alone for r in rows(a, *columns))


def test_reference_texts_by_docno(spark):
    from rankarena.operators import corpus
    from rankarena.plans import competition as arena

    sf_dir = "/root/testdata/sf0.001"
    found = corpus.reference_texts(arena.asked_entries(spark, sf_dir), texts=arena.texts(spark, sf_dir))
    assert rows(found) == rows(corpus.reference_texts(arena.competition(spark, sf_dir)))
