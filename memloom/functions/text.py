"""Scalar text functions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fragment types by parts of a predicate, in the order in which they are tried; anything else is a fact.
FRAGMENT_WORDS = {
    "preference": ["prefer", "선호", "like", "dislike", "좋아", "싫어", "sentiment"],
    "decision": ["decide", "chose", "결정", "선택", "switch", "change"],
    "error": ["error", "bug", "fail", "에러", "버그", "실패"],
    "procedure": ["step", "process", "how_to", "방법", "절차", "procedure"],
    "relation": ["relates", "depends", "uses", "관계", "의존", "사용"],
}
#: Half-life of a fragment in days, by type.
HALF_LIFE_DAYS = {"preference": 120.0, "decision": 90.0, "fact": 60.0, "error": 60.0, "relation": 60.0, "procedure": 30.0}
DEFAULT_HALF_LIFE = 60.0
#: Openings of tool lines, which a sanitizer drops; the first two need no closing bracket.
TOOL_OPENINGS = ["[tool_use:", "[TOOL_USE", "[tool_result]", "[TOOL_RESULT]", "[결과]", "[Read]", "[Bash]", "[Write]", "[Edit]", "[Grep]", "[Glob]", "[TodoWrite]", "[WebFetch]", "[WebSearch]"]
#: Lines left over from numbered listings: an arrow, two blanks or more, a bar, or nothing after the number.
NUMBERED_LINE = r"\d+(?:→|\s{2,}\S.*$|\s*\|.*$|\s*$)"
#: Tags whose content is no speech.
WRAPPERS = ["ide_opened_file", "ide_selection", "local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args", "system-reminder"]
#: Texts that are nothing but noise, each from its start to its end.
SOLO_NOISE = [
    "Unknown skill:.*", r"Todos have been modified successfully\. Ensure that you continue to use the todo list.*", r"\[?결과\]?\s*Command running in background with ID:.*",
    r"In plan mode, you should:.*?ExitPlanMode.*?approval\.\s*", r"Your plan has been saved to:\s*\S+\s*",
]
RELATION_TYPES = ["supports", "contradicts", "depends_on", "part_of", "related_to"]
#: Words that carry no topic.
STOPWORDS = "the a an of in on at to for with and or but is are was were be been has have had do does did will would what which who when where why how".split()
#: Korean particles.
PARTICLES = "의 는 이 가 을 를 에 에서 에게 에서부터 부터 까지 으로 로 와 과 도 만 뿐 이나 나 든지 라도 마저 조차 뿐만 처럼 같이 보다 하고 하고는".split()
#: Markers of a decision, of a discovery and of a correction, words and phrases in any case.
DECISION_MARKERS = "because|since|the reason|the issue is|the problem is|the bug is|the fix is|the root cause|turns out|it turns out|this is why|instead of|rather than|we should|we need to|the correct|actually,?|in fact,?|specifically,?"
DISCOVERY_MARKERS = "found|discovered|noticed|realized|identified|confirmed|turned out|the test (failed|passed) because|this file|this function|contains|defines|implements|references|depends on|uses"
CORRECTION_MARKERS = "doesn['’]t|does not|won['’]t|will not|can['’]t|cannot|didn['’]t|failed|broken|incorrect|wrong|missing|instead|however|but\\s+actually|on second thought"


def token_estimate(text: Column) -> Column:
    """A quarter token per ASCII character and half a token per other one, each rounded down; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.floor(plain / 4) + F.floor((F.length(text) - plain) / 2)).cast("long")


def low_quality_summary(summary: Column) -> Column:
    """Null, blank, or shorter than 50 characters once trimmed; ids and bare numbers are always that short."""
    bare = F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", "")
    return (F.length(bare) < 50) | bare.rlike(r"^[0-9]+$") | bare.rlike(r"^jsonl-agent-[0-9a-f]+$")


def keywords(text: Column) -> Column:
    """Topic words as written, in order, repeats kept: marks to blanks, stopwords out, particles cut, two letters at least."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s가-힣]", " "), r"(?U)\s+"), lambda w: F.length(w) > 0)
    spoken = F.filter(words, lambda w: ~F.lower(w).isin(STOPWORDS))
    # The longest particle that leaves two characters or more of the word.
    longest = sorted(PARTICLES, key=len, reverse=True)
    cut = F.transform(spoken, lambda w: F.regexp_replace(w, f"(?s)^(.{{2,}}?)(?:{'|'.join(longest)})$", "$1"))
    return F.filter(cut, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(STOPWORDS))


def fragment_keywords(subject: Column, predicate: Column, value: Column, content: Column, most: int = 20) -> Column:
    """The triple and then the keywords of a fragment's content, the first of each spelling, case ignored."""
    every = F.filter(F.concat(F.array_compact(F.array(subject, predicate, value)), keywords(content)), lambda w: F.length(w) > 0)
    low = F.transform(every, lambda w: F.lower(w))
    return F.slice(F.filter(every, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def expanded(words: Column, aliases: dict[str, str], other_script: dict[str, str]) -> Column:
    """Each word followed by its names in another script and by its alias, the first of each spelling, case ignored."""
    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")

    def names(w: Column) -> Column:
        alias = lookup(aliases, F.lower(w))
        return F.array_compact(F.array(w, lookup(other_script, w), F.when(alias != F.lower(w), alias)))

    every = F.flatten(F.transform(words, names))
    return F.filter(every, lambda w, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(w)) == i + 1)


def preprocessed(query: Column, aliases: dict[str, str], other_script: dict[str, str]) -> Column:
    """Struct (normalized, keywords, terms, any_of) of a search: ``any_of`` joins the terms by OR, or is the query itself."""
    words = keywords(query)
    terms = expanded(words, aliases, other_script)
    return F.struct(
        F.lower(F.trim(compatible(query))).alias("normalized"), words.alias("keywords"), terms.alias("terms"),
        F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(query).alias("any_of"),
    )


def compatible(text: Column) -> Column:
    """A text in compatible form (NFKC), which SQL has no function for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)

    return run(text)


def density(words: Column, known: Column) -> Column:
    """Share of the distinct words that are known; 0 for no words."""
    distinct = F.array_distinct(words)
    return F.when(F.size(distinct) == 0, 0.0).otherwise(F.size(F.array_intersect(distinct, known)) / F.size(distinct))


def sanitized(text: Column, mode: str = "cleaned") -> Column:
    """Struct (cleaned, removed): wrapper tags, noise, tool lines and line-number leaks are taken out of a turn's text.

    A notification gives way to its result's body, wherever in it that stands.  A text that is nothing but noise comes
    out empty, with itself as what was removed; a final line feed stays unless nothing else does.  Mode 'raw' changes
    nothing; null stays null.
    """
    if mode == "raw":
        return F.struct(text.alias("cleaned"), F.array().cast("array<string>").alias("removed"))
    if mode != "cleaned":
        raise ValueError(f"mode is 'cleaned' or 'raw', not {mode!r}")
    # Each notification is marked, its body kept with a line feed, the rest dropped.
    told = F.regexp_replace(text, r"(?s)<task-notification>(?:(?!</task-notification>).)*?<result>((?:(?!</task-notification>).)*?)</result>(?:(?!</task-notification>).)*</task-notification>\s*", "$1\n")
    told = F.regexp_replace(told, r"(?s)<task-notification>.*?</task-notification>\s*", "")
    bare = F.regexp_replace(told, rf"(?s)<({'|'.join(WRAPPERS)})>.*?</\1>\s*", "")
    noise = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "").rlike(rf"(?s)^(?:{'|'.join(SOLO_NOISE)})$")
    lines = F.split(bare, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)  # no line after the last line feed
    opening = "|".join("\\Q" + x + "\\E" for x in TOOL_OPENINGS)
    bad = lambda line: line.rlike(rf"(?U)^\s*(?:{opening}|{NUMBERED_LINE})")
    kept = F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")
    kept = F.when(text.endswith("\n") & (kept != "") & ~kept.endswith("\n"), F.concat(kept, F.lit("\n"))).otherwise(kept)
    return F.struct(
        F.when(noise, "").otherwise(kept).alias("cleaned"),
        F.when(noise, F.array(F.regexp_replace(bare, r"\n+$", ""))).otherwise(F.filter(lines, bad)).alias("removed"),
    )


def fragment_type(predicate: Column) -> Column:
    """The type of the first group of which a part occurs in the predicate, case ignored; null counts as a fact."""
    low = F.lower(F.coalesce(predicate, F.lit("")))
    out = F.lit("fact")
    for kind, parts in reversed(FRAGMENT_WORDS.items()):
        out = F.when(low.rlike("|".join(parts)), kind).otherwise(out)
    return out


def relation_type(name: Column) -> Column:
    bare = F.translate(F.lower(F.trim(name)), "- ", "__")
    return F.when(bare.isin(RELATION_TYPES), bare).otherwise("related_to")


def fragment_content(quote: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """The quote without outer blanks if it says enough, else the triple; at most 500 characters."""
    bare = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    body = F.when(F.length(bare) >= 10, bare).otherwise(F.concat_ws(" ", subject, predicate, value))
    return F.when(F.length(body) > 500, F.concat(F.substring(body, 1, 497), F.lit("..."))).otherwise(body)


def snippet(text: Column, term: str, width: int = 400, before: int = 100) -> Column:
    """A window around the first occurrence of a term, with ellipses where text is cut; the head if it doesn't occur."""
    return snippet_at(text, F.locate(term.lower(), F.lower(text)), width, before)


def snippet_at(text: Column, at: Column, width: int = 400, before: int = 100) -> Column:
    """A window of ``width`` characters from ``before`` characters ahead of place ``at`` (from 1; 0: from the start)."""
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(F.length(text) > start + width - 1, "...").otherwise(""))


def occurrences(text: Column, term: Column) -> Column:
    low, t = F.lower(text), F.lower(term)
    return F.when(F.length(t) > 0, (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).otherwise(0).cast("long")


def decay(days: Column, kind: Column) -> Column:
    """Halves with each half-life of the type; null or negative days count as 0."""
    half = F.create_map(*[F.lit(x) for kv in HALF_LIFE_DAYS.items() for x in kv])
    return F.pow(F.lit(0.5), F.greatest(F.coalesce(days, F.lit(0)), F.lit(0)) / F.coalesce(F.element_at(half, kind), F.lit(DEFAULT_HALF_LIFE)))


def normalized_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(normalized_path(path), "/"), -1), r"\.[^.]*$", "")


def resolved_path(path: Column, base: str) -> Column:
    """A path below ``base`` unless it is absolute, normalized, with '.' and '..' taken out."""
    plain = normalized_path(path)
    whole = F.when(plain.rlike("^(/|[a-z]:/)"), plain).otherwise(F.concat(F.lit(base.rstrip("/").lower() + "/"), plain))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def chain(spec: Column) -> Column:
    """'A>B>C' as an array of trimmed names, blanks dropped."""
    return F.filter(F.transform(F.split(spec, ">"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def signal_boost(text: Column) -> Column:
    """0 to 3: one each for markers of a decision, of a discovery and of a correction."""
    hit = lambda words: text.rlike(rf"(?i)\b({words})\b").cast("int")
    return hit(DECISION_MARKERS) + hit(DISCOVERY_MARKERS) + hit(CORRECTION_MARKERS)


def cross_script(a: Column, b: Column) -> Column:
    """One side holds Hangul and no Latin letters, the other the reverse."""
    hangul = lambda c: c.rlike("[가-힣ㄱ-ㅣ]")
    latin = lambda c: c.rlike("[A-Za-z]")
    return (hangul(a) & ~latin(a) & latin(b) & ~hangul(b)) | (hangul(b) & ~latin(b) & latin(a) & ~hangul(a))


def hybrid_score(fuzzy: Column, cosine: Column, crossed: Column) -> Column:
    return F.when(crossed, 0.05 * fuzzy + 0.95 * cosine).otherwise(0.40 * fuzzy + 0.60 * cosine)


def conflict_class(entailment: Column, contradiction: Column, cosine: Column) -> Column:
    return (
        F.when(entailment >= 0.70, F.when(cosine >= 0.92, "duplicate").when(cosine >= 0.70, "refinement").otherwise("separate"))
        .when(contradiction >= 0.85, "auto_resolve").when(contradiction >= 0.70, "review").otherwise("separate")
    )


def normalize_name(name: Column, aliases: dict[str, str], other_script: dict[str, str] | None = None) -> Column:
    """Trimmed, compatible form; the name in another script if listed, else lower case and its alias; null stays null."""
    scripts = other_script or {}

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        def one(name: str) -> str:
            plain = unicodedata.normalize("NFKC", name.strip())
            return scripts[plain].lower() if plain in scripts else aliases.get(plain.lower(), plain.lower())

        return names.map(lambda n: one(n) if isinstance(n, str) else None)

    return run(name)


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: how well the shorter text matches the best stretch of the longer one."""
    from difflib import SequenceMatcher

    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        at = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[at : at + len(short)], autojunk=False).ratio())
    return 100 * best


def fuzzy_ratio(a: str, b: str) -> float:
    """0 to 100: the best of the plain ratio, that of the sorted words, and the partial one.

    A ratio is twice the longest common subsequence over the summed lengths, as edit-distance libraries define it.
    """
    return max(_ratio(a, b), _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), _partial(a, b))


def _ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text to a stretch of its length in the longer one, shorter stretches at the ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    return max(_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def fuzzy(a: Column, b: Column) -> Column:
    """``fuzzy_ratio`` of two columns; null if one is null."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quote is found in a text, word for word or with a partial ratio of 75; empty quotes or texts are not."""

    @F.pandas_udf("boolean")
    def run(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for q, t in zip(quotes, texts, strict=True):
            q, t = (q or "").strip().lower(), (t or "").strip().lower()
            out.append(bool(q and t) and (q in t or partial_ratio(q, t) >= 75))
        return pd.Series(out, dtype="boolean")

    return run(quote, text)
