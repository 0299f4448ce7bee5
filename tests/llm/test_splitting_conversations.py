import random

import pytest

from memloom.llm import components as C
from memloom.llm import conversations as V
from memloom.llm import splitting as S
from memloom.scratch import Scratch


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg한é") for _ in range(r.randint(1, 12)))
    for _ in range(40):
        parts = [" ".join(word() for _ in range(r.randint(1, 400))) + r.choice([". ", "\n", "\n\n", "\r\n", "\n# ", "\nUser: ", "\n```\n"]) for _ in range(r.randint(1, 60))]
        yield "".join(parts)
    yield "x" * 20_001
    yield "é" * 5_000
    yield "\n" * 9_000


def test_pieces_round_trip():
    for text in texts():
        spans = S.pack(text)
        assert "".join(text[a:b] for a, b in spans) == text
        for n, (a, b) in enumerate(spans):
            assert b > a and (b - a if n == 0 else b - a + S.OVERLAP) <= S.LIMIT
        if len(text) <= S.LIMIT:
            assert len(spans) == (1 if text else 0)


def test_cuts_fall_on_boundaries_and_limit_is_not_above():
    text = "\n\n".join("Sentence number one is here. " * 30 for _ in range(12))
    assert all(text[a - 2 : a] == "\n\n" for a, _ in S.pack(text)[1:])
    assert S.pack("y" * 4000) == [(0, 4000)]
    assert len(S.pack("y" * 4001)) == 2
    with pytest.raises(ValueError):
        S.pack("y" * 50, limit=10, overlap=10)


def _documents():
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(["river", "lamp", "stone", "garden", "copper"]) for _ in range(n)) + "."
    for _ in range(60):
        out = []
        for _ in range(r.randint(2, 14)):
            k = r.random()
            if k < 0.35:
                out.append("#" * r.randint(1, 3) + " " + line(3))
            elif k < 0.5:
                out.append("```sh\n" + "\n".join(r.choice(["# step ", "- run ", "## "]) + str(i) for i in range(r.randint(3, 420))) + "\n```")
            elif k < 0.65:
                out.append("\n".join("  " * (i % 3) + "- " + line(r.randint(2, 60)) for i in range(r.randint(2, 25))))
            else:
                out.append(line(r.randint(5, 900)))
        yield "\n\n".join(out) + "\n"


def _fences(text):
    at, out = None, []
    for a, b in S._lines(text, 0, len(text)):
        if text[a:b].startswith("```"):
            at = a if at is None else out.append((at, b))
    return out


def _sections(text):
    """(start, end) of every section, by an independent walk over the lines outside of fences."""
    inside, marks = False, []
    for a, b in S._lines(text, 0, len(text)):
        if text[a:b].startswith("```"):
            inside = not inside
        elif not inside and text[a] == "#":
            marks.append((a, len(text[a:b]) - len(text[a:b].lstrip("#"))))
    for i, (a, rank) in enumerate(marks):
        yield a, next((x for x, other in marks[i + 1 :] if other <= rank), len(text))


def test_structure_is_respected():
    room = S.LIMIT - S.OVERLAP
    seen = 0
    for text in _documents():
        spans = S.pack(text)
        assert "".join(text[a:b] for a, b in spans) == text
        cuts = {a for a, _ in spans[1:]}
        for a, b in _fences(text):
            if b - a <= room - 200:  # a heading may stand before it
                assert not any(a < c < b for c in cuts)
                seen += 1
        for a, b in _sections(text):
            if b - a <= room:
                # A section that fits is in one piece, whole.
                assert not any(a < c < b for c in cuts)
            else:
                # What is left of a larger one is not joined with what follows it.
                assert b in cuts or b == len(text)
    assert seen > 20


def test_siblings_are_merged_up_to_the_limit():
    text = "".join(f"# part {i}\n\n{'word ' * 150}\n\n" for i in range(12))
    spans = S.pack(text)
    assert len(spans) == 3 and all(text[a:].startswith("# part") for a, _ in spans)
    nested = "# top\n\n" + "".join(f"- item {i}\n" + "".join(f"  - sub {i}.{j} {'x ' * 90}\n" for j in range(24)) for i in range(3))
    assert all(text_.lstrip().startswith(("# top", "- item", "- sub")) for text_ in (nested[a:b] for a, b in S.pack(nested)))
    deep = "".join("  " * i + "- a\n" for i in range(400))
    assert "".join(deep[a:b] for a, b in S.pack(deep)) == deep


def test_split_items_repeats_nulls_overlap(spark):
    rows = [(1, "a" * 3000 + " " + "b" * 3000, 0), (1, "a" * 3000 + " " + "b" * 3000, 0), (2, "short", 1), (3, None, 2), (None, "z" * 9000, 3)]
    df = spark.createDataFrame(rows, "id long, text string, piece int")
    got = S.split_items(df, "id", "text").orderBy("piece").collect()
    assert {r.record_id for r in got} == {1} and [r.piece for r in got] == list(range(len(got)))
    for before, after in zip(got, got[1:]):
        assert after.text.startswith(before.text[-200:]) and len(after.text) <= 4000
    assert S.split_items(df.limit(0), "id", "text").count() == 0


TURN = "id long, workspace_id long, episode_id long, sequence int, role string, text string, ts timestamp, created_at timestamp, conversation string"


def turns(spark, rows):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, 1, e, s, r, x, t + dt.timedelta(minutes=m), t, "clash") for i, e, s, r, x, m in rows], TURN)


def test_problems(spark):
    rows = [
        (1, 1, 0, "user", "hi", 0), (2, 1, 1, "Assistant ", "yo", 0), (3, 1, 1, "AI", "yo", 0),
        (4, 2, 0, "user", "　 \n", 0), (5, 2, 1, "tool", "x", 0),
        (6, 3, 2, "user", "q", 0), (7, 3, 4, "assistant", "a", 0),
        (8, 4, 0, "user", "q", 0), (9, 4, 0, "user", "other", 0), (10, 4, 1, "bot", "a", 0),
        (11, 5, 0, "user", "q", 0), (12, 5, 1, None, "a", 0), (13, 5, 2, "n/a", "a", 0),
        (14, 6, 0, "user", "q", 0), (15, 6, 1, "assistant", "a", 0), (16, 6, 2, "user", "again", 0), (17, 6, 3, "assistant", " ", 0),
        (18, 7, 0, "user", None, 0), (19, 7, 0, "user", "q", 0), (20, 7, 1, "model", "a", 0),
        (21, None, 0, "user", "lost", 0), (22, 8, 0, "assistant", "only", 0),
    ]
    got = {(r.episode_id, r.problem) for r in V.broken(turns(spark, rows)).collect()}
    assert got == {(2, "empty"), (3, "gap"), (4, "conflict"), (5, "bad_role"), (5, "no_reply"), (6, "no_reply"), (7, "conflict")}
    good = V.conversations(turns(spark, rows)).filter("episode_id is not null").collect()
    assert {r.episode_id for r in good} == {1, 8}
    assert sorted((r.position, r.role) for r in good if r.episode_id == 1) == [(0, "user"), (1, "assistant")]
    assert V.broken(turns(spark, rows).limit(0)).count() == 0


def test_rows_without_identifier_are_joined_by_replies_and_quotes(spark):
    rows = [(1, None, 0, "user", "how is it", 0), (2, None, 1, "assistant", "fine", 5), (3, None, 2, "user", "good", 9), (4, None, 1, "assistant", "too late", 999), (5, None, 7, "user", "> too late\nyes", 5000)]
    got = {r.id: r.conversation for r in V.rebuild(turns(spark, rows)).collect()}
    assert got == {1: "m1", 2: "m1", 3: "m1", 4: "m4", 5: "m4"}


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(1, 120), r.randint(1, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {x.node: x.component for x in C.components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert C.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_rebuilding_without_identifiers(spark):
    """Known conversations with their identifiers taken away: pairs of messages put together rightly."""
    from collections import Counter

    from pyspark.sql import functions as F

    known = spark.read.parquet("/root/testdata/sf0.001/turns.parquet").filter("episode_id is not null and sequence is not null").dropDuplicates(["id"])
    true = {r.id: r.episode_id for r in known.select("id", "episode_id").collect()}
    found = {r.id: r.conversation for r in V.rebuild(known.withColumn("episode_id", F.lit(None).cast("long"))).select("id", "conversation").collect()}
    pairs = lambda marks: sum(n * (n - 1) // 2 for n in Counter(marks).values())
    both = pairs((true[i], found[i]) for i in found)
    assert both / pairs(found.values()) > 0.95 and both / pairs(true[i] for i in found) > 0.8
