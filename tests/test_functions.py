import pytest
from pyspark.sql import functions as F

from memloom.functions import text as X


def value(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(("text", "low"), [(None, True), ("", True), ("   ", True), ("too short", True), ("a" * 49, True), ("a" * 50, False), ("jsonl-agent-720ba8 ", True), (" 12 ", True), ("1" * 60, True), ("The team agreed to keep both versions until the review is over.", False)])
def test_quality_gate(spark, text, low):
    assert value(spark, X.low_quality_summary, text) is low


_TOOLS = ["[Read] file.py", "[Bash] ls", "[Write] x.txt", "[Edit] x.txt", "[Grep] foo", "[Glob] *.py", "[TodoWrite] todo", "[WebFetch] http://x", "[WebSearch] q", "[tool_result] ok", "[TOOL_RESULT] ok", "[TOOL_USE] thing", "[결과] 응"]


@pytest.mark.parametrize(
    ("text", "cleaned", "removed"),
    [
        ("hello\n[tool_use: Read] /etc/hosts\nworld", "hello\nworld", ["[tool_use: Read] /etc/hosts"]), ("user said\n" + "\n".join(_TOOLS) + "\nend", "user said\nend", _TOOLS), ("I used [Bash] inside a sentence.", "I used [Bash] inside a sentence.", []),
        ("   [Bash] ls\nkeep this", "keep this", ["   [Bash] ls"]), ("hello\n[Bash] ls\n", "hello\n", ["[Bash] ls"]), ("", "", []), ("[TOOL_USE foo\nx", "x", ["[TOOL_USE foo"]), ("[Task] list of things", "[Task] list of things", []),
        ("1   foo\n2     bar\nnormal\n 358          · 한국어\n123→x\n  500  |  baz\n  77\n본문", "normal\n본문", ["1   foo", "2     bar", " 358          · 한국어", "123→x", "  500  |  baz", "  77"]), ("1. first\n2. second", "1. first\n2. second", []), ("123 | content", "", ["123 | content"]), ("  42", "", ["  42"]),
        ("Unknown skill: foo", "", ["Unknown skill: foo"]), ("  Unknown skill: foo\nbar\n", "", ["  Unknown skill: foo\nbar"]), ("<ide_selection>a\nb</ide_selection>\nask", "ask", []), ("<system-reminder>secret\nx</system-reminder>kept", "kept", []), ("<command-name>/x</command-name> <command-args>y</command-args>go", "go", []),
        ("<task-notification><result>done well</result></task-notification>", "done well\n".rstrip("\n"), []), ("<task-notification><id>1</id><status>ok</status><result>done\nwell</result><x/></task-notification>\nnext", "done\nwell\nnext", []), ("<task-notification><id>1</id></task-notification>only this", "only this", []),
        ("a\r\n[Bash] ls\r\nb", "a\nb", ["[Bash] ls"]), ("[Bash] ls\n", "", ["[Bash] ls"]),
    ],
)
def test_sanitizer(spark, text, cleaned, removed):
    got = value(spark, X.sanitized, text)
    assert (got.cleaned, got.removed) == (cleaned, removed)
    again = value(spark, X.sanitized, got.cleaned)
    assert again.cleaned == got.cleaned and not again.removed


def test_sanitizer_modes(spark):
    got = value(spark, lambda t: X.sanitized(t, "raw"), "[Bash] ls\nhello")
    assert (got.cleaned, got.removed) == ("[Bash] ls\nhello", [])
    assert value(spark, X.sanitized, None).cleaned is None
    with pytest.raises(ValueError, match="mode"):
        X.sanitized(F.lit("x"), "other")


@pytest.mark.parametrize(
    ("predicate", "kind"),
    [("prefers", "preference"), ("Dislikes_step", "preference"), ("decided_on", "decision"), ("decide_error", "decision"), ("선택", "decision"), ("bug_recall", "error"), ("how_to_run", "procedure"), ("process", "procedure"), ("uses_db", "relation"), ("depends_on", "relation"), ("의존", "relation"), ("age", "fact"), (None, "fact")],
)
def test_fragment_types_by_predicate(spark, predicate, kind):
    assert value(spark, X.fragment_type, predicate) == kind


@pytest.mark.parametrize(("text", "boost"), [("It broke because of x", 1), ("We found it, however late", 2), ("The bug is that it uses a wrong key", 3), ("plain words", 0), ("Actually it doesn’t", 2), ("sincerely refound", 0)])
def test_signal_boost(spark, text, boost):
    assert value(spark, X.signal_boost, text) == boost


def test_queries_are_expanded(spark):
    alias, script = {"js": "javascript", "db": "db"}, {"자비스": "Jarvi"}
    got = value(spark, lambda t: X.preprocessed(t, alias, script), "  The JS db, 자비스 JS of ＤＢ ")
    assert got.keywords == ["JS", "db", "자비스", "JS", "ＤＢ"] and got.terms == ["JS", "javascript", "db", "자비스", "Jarvi", "ＤＢ"]
    assert got.any_of == "JS OR javascript OR db OR 자비스 OR Jarvi OR ＤＢ" and got.normalized == "the js db, 자비스 js of db"
    assert value(spark, lambda t: X.preprocessed(t, alias, script), "of the").any_of == "of the"
    assert value(spark, lambda t: X.resolved_path(t, "/Base/dir"), "..\\Notes/./a.md") == "/base/notes/a.md" and value(spark, lambda t: X.resolved_path(t, "/b"), "C:\\x\\y") == "c:/x/y"


def test_fuzzy_ratio(spark):
    assert X.fuzzy_ratio("new york", "york new") == 100 and X.fuzzy_ratio("abc", "xxabcxx") == 100 and X.fuzzy_ratio("", "") == 100 and X.fuzzy_ratio("abc", "") == 0
    assert abs(X.fuzzy_ratio("kitten", "sitting") - 200 / 3) < 1e-9 and value(spark, lambda t: X.fuzzy(t, F.lit("ab")), None) is None and value(spark, lambda t: X.fuzzy(t, F.lit("b a")), "a b") == 100


def test_tokens_keywords_density(spark):
    assert value(spark, X.token_estimate, "abcdefgh한글") == 3
    assert value(spark, X.token_estimate, None) == 0
    assert value(spark, X.keywords, "The queue, the QUEUE and a schema of 검색화면에서!") == ["queue", "QUEUE", "schema", "검색화면"]
    assert value(spark, X.keywords, None) == []
    assert value(spark, lambda t: X.density(X.keywords(t), F.array(F.lit("queue"))), "queue schema") == 0.5
    assert value(spark, lambda t: X.density(X.keywords(t), F.array(F.lit("queue"))), "") == 0.0


def test_small_functions(spark):
    assert value(spark, lambda t: X.snippet(t, "NEEDLE"), "x" * 300 + "needle" + "y" * 500).startswith("...")
    assert value(spark, lambda t: X.snippet(t, "none"), "short") == "short"
    assert value(spark, lambda t: X.occurrences(t, F.lit("ab")), "abAB ab") == 3
    assert value(spark, lambda t: X.path_stem(t), "C:\\Work\\Notes.JSONL") == "notes"
    assert value(spark, X.chain, "A > B>>C ") == ["A", "B", "C"]
    assert value(spark, X.relation_type, " Depends-On") == "depends_on"
    assert value(spark, X.relation_type, "whatever") == "related_to"
    assert value(spark, lambda t: X.decay(F.lit(90.0), t), "decision") == 0.5
    assert value(spark, lambda t: X.decay(F.lit(None).cast("double"), t), "fact") == 1.0
    assert value(spark, lambda t: X.cross_script(t, F.lit("Kim")), "김지후") is True
    assert value(spark, lambda t: X.conflict_class(F.lit(0.8), F.lit(0.0), F.lit(0.95)), "x") == "duplicate"
    assert value(spark, lambda t: X.conflict_class(F.lit(0.1), F.lit(0.9), F.lit(0.95)), "x") == "auto_resolve"
    assert abs(value(spark, lambda t: X.hybrid_score(F.lit(1.0), F.lit(0.5), F.lit(False)), "x") - 0.7) < 1e-9
    assert len(value(spark, lambda t: X.fragment_content(t, F.lit("a"), F.lit("b"), F.lit("c")), "q" * 600)) == 500
    assert value(spark, lambda t: X.fragment_content(t, F.lit("a"), F.lit("b"), F.lit("c")), "short") == "a b c"


def test_python_functions(spark):
    assert value(spark, lambda t: X.normalize_name(t, {"js": "javascript"}), "  ＪＳ ") == "javascript"
    assert value(spark, lambda t: X.normalize_name(t, {}), None) is None
    assert value(spark, lambda t: X.grounded(F.lit("the cache expired"), t), "Then the cache expired at noon") is True
    assert value(spark, lambda t: X.grounded(F.lit("the cashe expired"), t), "Then the cache expired at noon") is True
    assert value(spark, lambda t: X.grounded(F.lit("nothing alike 123"), t), "Then the cache expired at noon") is False
    assert value(spark, lambda t: X.grounded(F.lit(""), t), "") is False
