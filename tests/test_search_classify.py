import random

from pyspark.sql import functions as F

from memloom.operators import classify, ordered, search


def test_running_equals_a_plain_sum_whatever_the_bucket(spark):
    r = random.Random(5)
    rows = [(i, r.choice([1, 2, None]), r.choice([None, *range(60)]), r.choice([None, 1, 4])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, s int, v int")
    got = {x.id: x.t for x in ordered.running(df, "g", ["s", "id"], {"t": F.col("v")}, bucket=7).collect()}
    want = {}
    for g in (1, 2, None):
        total = 0
        for i, _, _, v in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
            total += v or 0
            want[i] = total
    assert got == want
    assert ordered.running(df.limit(0), "g", ["s", "id"], {"t": F.col("v")}).count() == 0


def test_anchors_keep_the_longest(spark):
    names = spark.createDataFrame([("cache",), ("Summary Cache",), ("queue",), ("x",), (None,)], "name string")
    assert {r.name for r in search.anchors(names, "Why is the summary cache slow?").collect()} == {"Summary Cache"}


def test_verdicts(spark):
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "zz"]), (3, ["q"]), (4, ["q"])], "q_id int, expect array<string>")
    a = spark.createDataFrame([(1, "A and B"), (2, "only a"), (3, None)], "q_id int, answer string")
    assert {r.q_id: r.verdict for r in search.verdicts(q, a).collect()} == {1: "PASS", 2: "WEAK", 3: "FAIL", 4: "FAIL"}


def test_transcript_layouts(spark):
    rows = [(1, "User: hi\nthere\n\nAssistant: yo"), (2, "### user\r\nhi\r\n\r\n### tool\r\nout"), (3, "Human:\nq\n\n\nAI:\na"), (4, "[system] s\n[user] u"), (5, "no labels"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {}
    for r in classify.transcript_turns(df, "id", "content").orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got == {1: [("user", "hi\nthere"), ("assistant", "yo")], 2: [("user", "hi"), ("tool", "out")], 3: [("user", "q"), ("assistant", "a")], 4: [("system", "s"), ("user", "u")]}


def test_scaffolding_chains_labels_and_budget(spark):
    df = spark.createDataFrame([(1, 1, 0, "user", "<thinking>hm\nhm</thinking>Let me check the file.\nThe queue is full."), (2, 1, 1, "assistant", "y" * 50)], "id long, episode_id long, sequence int, role string, text string")
    assert df.filter("id = 1").select(classify.without_scaffolding(F.col("text")).alias("t")).first().t == "The queue is full."
    chains = classify.classified(df)
    assert chains.first().chain == "Ops>Queues"
    assert [(r.subject, r.parent, r.depth) for r in classify.chain_links(chains).orderBy("depth").collect()] == [("Ops", None, 0), ("Queues", "Ops", 1)]
    names = spark.createDataFrame([("A>B",), ("x 2025-01-02",), ("plain",)], "n string")
    assert [r.v for r in names.select(classify.session_label(F.col("n")).alias("v")).collect()] == [True, True, False]
    paths = spark.createDataFrame([("C:\\Work\\Notes\\",)], "p string")
    assert paths.select(classify.work_subject(F.col("p")).alias("v")).first().v == "notes"
    assert [r.id for r in classify.running_budget(df, 40, 75).collect()] == [1]
