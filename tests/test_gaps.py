from types import SimpleNamespace

from memloom.operators import gaps


def test_cleaned_answer():
    text = "[thinking] a\n1. b\n\n2. c\n\nThe cache is stale.\n[Bash] ls\nGreat question!\nLet me check the file. It holds two rows."
    assert gaps.cleaned_answer(text) == "The cache is stale.\n It holds two rows."
    assert gaps.cleaned_answer("[thinking] only\nthis") == "" and gaps.cleaned_answer("Sure!\nLet me check.") == ""


def test_candidates_keep_long_novel_and_short_known(spark):
    long = "zebra quartz violin meadow lantern copper saddle orchid tunnel glacier pepper anchor velvet marble falcon timber"
    answer = "the harbour desk answered at length about nothing listed here"
    rows = [
        (1, 1, 1, 0, "user", long), (2, 1, 1, 1, "assistant", answer),  # long, density 0
        (3, 1, 2, 0, "user", "why indigogrid"), (4, 1, 2, 1, "assistant", "indigogrid holds the vector index of every archive"),  # short user turn, known word
        (5, 2, 3, 0, "user", long), (6, 2, 3, 1, "assistant", answer),  # workspace without facts
        (7, 1, 4, 0, "user", "please tell me all about the lantern and meadow and velvet now"), (8, 1, 4, 1, "assistant", "Let me check the whole archive for that and then some more."),  # answer comes to nothing
        (9, 1, 5, 0, "user", "hello there how is the weather with all of you people today it seems"),  # density 0, 14 distinct words and the label
        (10, 1, 6, 0, "user", "lantern meadow velvet marble falcon timber saddle orchid tunnel"),  # density 0, short
        (11, 1, 7, 0, "user", long + " known quote"),  # covered by the quote
    ]
    turns = spark.createDataFrame(rows, "id long, workspace_id long, episode_id long, sequence int, role string, text string")
    facts = spark.createDataFrame([(1, 1, 7, "indigogrid", "holds", "vector", "User: " + long + " known quote")], "hint_id long, workspace_id long, episode_id long, subject string, predicate string, object_value string, source_quote string")
    got = {(r.episode_id, r.pair): r for r in gaps.candidates(SimpleNamespace(turns=turns, facts=facts)).collect()}
    # Workspace 1 knows the words of its fact; the exchange that the fact is about is too near to it.
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1)}
    assert all(r.novelty == 1 for r in got.values()) and got[2, 1].density > 0 and got[3, 1].density == 0 and got[5, 1].density == 0 and all(r.priority is not None for r in got.values())


def test_novelty_is_the_largest_cosine_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(gaps, "BLOCK", 2)
    words = "zebra quartz violin meadow lantern copper saddle orchid tunnel glacier pepper anchor".split()
    texts = [" ".join(words[i % 12] + str(i // 4) for i in range(k, k + 18)) for k in range(5)]
    turns = spark.createDataFrame([(2 * i + j, 1, 1, 2 * i + j, role, texts[i] if j == 0 else "an answer that is long enough to stay in the exchange") for i in range(5) for j, role in enumerate(("user", "assistant"))],
                                  "id long, workspace_id long, episode_id long, sequence int, role string, text string")
    facts = spark.createDataFrame([(i, 1, 1, "s", "p", "o", q) for i, q in enumerate([texts[2], "nothing alike", "", texts[4][:60], None])], "hint_id long, workspace_id long, episode_id long, subject string, predicate string, object_value string, source_quote string")
    said = gaps.exchanges(turns)
    got = {r.pair: r.nearest for r in gaps._novelty(said, facts, gaps.embed.hashed).collect()}
    vectors = gaps.embed.hashed([q or "s p o" for q in [texts[2], "nothing alike", "", texts[4][:60], None]])
    want = {r.pair: float((vectors @ gaps.embed.hashed([r.said[: gaps.EMBEDDED_CHARS]])[0]).max()) for r in said.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_coverage_by_quotes(spark):
    rows = [(1, 1, "We said that the harbour desk, in short, keeps a long list of boats."), (2, 1, "xthe harbour desk keeps nothing today at all, sorry"), (3, 1, "tiny quote inside of this longer turn here"), (4, 1, "nothing of it in this one, whatever one says"), (5, 1, "ok")]
    turns = spark.createDataFrame(rows, "id long, episode_id long, text string")
    quotes = ["that the harbour desk, in short, keeps a long li", "the harbour desk keeps nothing", "tiny quote", "", None, "harbour desk keeps a"]
    facts = spark.createDataFrame([(1, q) for q in quotes] + [(2, "ok")], "episode_id long, source_quote string")
    got = gaps.coverage(SimpleNamespace(turns=turns, facts=facts)).collect()
    assert [(r.turns, r.substantive, r.covered, r.verdict) for r in got] == [(5, 4, 3, "skip")]
