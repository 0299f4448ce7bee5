import math
import random
import re
from collections import Counter

import held_out
import pytest

from memloom.llm import languages as G
from memloom.llm import mixing as M
from memloom.llm import personal as P
from memloom.llm import personal_training as T

TEXT = [
    ("Contact: Ingrid Varilmark, +1 813 555 0199, ingrid.v@lumen.example.", ["name", "phone", "email"]), ("Mr. HÉLÈNE KREVEMESCU moved to 638 West Otterby Court Apt 39, Orlingham last month.", ["name", "address"]), ("윤도현 씨가 확인했습니다.", ["name"]),
    ("Her passport reads 590499-4840049 and her phone is 07700 900372.", ["id_number", "phone"]), ("mailto:kim dot vary at mail dot example dot org", ["email"]), ("Le colis part au 72 bis, impasse de la Grive Bleue, 00466 Estermoor.", ["address"]),
    ("The build id is 355.098.9030.", []), ("Order QX-200-027815 was split.", []), ("Pull it from git@forge:tools/recall and pin @types/turns@4.2.1.", []), ("Thornevale Street 84 is a chart title.", []), ("Nedozir & Sons sent the invoice.", []), ("2025-12-11T09:35:14Z ERROR [a.b] id=76064 took=7492ms", []), ("", []), (None, []),
]


@pytest.mark.parametrize(("text", "kinds"), TEXT)
def test_details(text, kinds):
    assert [k for *_, k in P.details(text)] == kinds


def test_offsets_and_masking(spark):
    text = "😀 Call Wilhelmina Dalabzir on +49 30 23125 594 now"
    (a, b, _), (c, *_) = P.details(text)
    assert text[a:b] == "Wilhelmina Dalabzir" and text[c] == "+"
    assert P.redacted(text, P.details(text)) == "😀 Call [NAME] on [PHONE] now"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (None, text, "x")], "id long, text string, field string")
    assert sorted((r.record_id, r.pii_type, r.start_char) for r in P.find(df, "id", "text", "turns.text").collect()) == [(1, "name", a), (1, "phone", c)]
    assert {r.record_id: r.text for r in P.mask(df, "id", "text", "f").collect()} == {1: "😀 Call [NAME] on [PHONE] now", 2: None}
    assert P.find(df.limit(0), "id", "text", "f").count() == 0


def _score(fresh, n=1500, seed=8):
    r, count = random.Random(seed), Counter()
    for _ in range(n):
        text, true = held_out.sample(r, fresh)
        got = set(P.details(text))
        count.update(("hit", t) for *_, t in got & true)
        count.update(("found", t) for *_, t in got)
        count.update(("want", t) for *_, t in true)
    return {t: (count["hit", t] / count["found", t], count["hit", t] / count["want", t]) for t in ("name", "email", "phone", "id_number", "address")}


@pytest.mark.parametrize("fresh", [False, True])
def test_held_out_accuracy(fresh):
    """Whole spans and types, given names outside every list: precision and recall over 0.9 for each type."""
    assert {t: x for t, x in _score(fresh).items() if min(x) < 0.9} == {}


def test_held_out_is_apart():
    listed = P._KNOWN | {w.lower() for w in [*T.UNLISTED, *T.LISTED]}
    assert not {g.lower() for g in [*held_out.GIVEN, *held_out.FRESH_GIVEN]} & listed
    assert not {f.lower() for f in [*held_out.FAMILY, *held_out.FRESH_FAMILY]} & {f.lower() for f in T.FAMILIES}
    training = "\n".join([*T.POSITIVE, *T.NEGATIVE])
    stretches = [x.strip() for t in [*held_out.SENTENCES, *held_out.FRESH, *held_out.NOTHING] for x in re.split(r"\{\w+\}", t)]
    assert [x for x in stretches if len(x) >= 14 and x in training] == []


UNSEEN = [
    ("Priya Raghunathan and Kwame Mensah met at noon", ["Priya Raghunathan", "Kwame Mensah"]), ("Chiara Bianchi will present", ["Chiara Bianchi"]), ("The candidate, Hiroshi Tanaka", ["Hiroshi Tanaka"]), ("I spoke with Aisha Okafor", ["Aisha Okafor"]), ("김철수 대리가 왔다", ["김철수"]),
    ("Robert Smith met Olga Petrova", ["Robert Smith", "Olga Petrova"]), ("The kettle is on and the Garden Gate is shut.", []), ("정리해 주세요. 이번 주에는 조용하다.", []),
]


@pytest.mark.parametrize(("text", "names"), UNSEEN)
def test_unseen_people(text, names):
    assert [text[a:b] for a, b, t in P.details(text) if t == "name"] == names


def test_long_details_are_masked_whole():
    local = " dot ".join(["longwindedness"] * 14)
    spelled = f"{local} at {' dot '.join(['subdomainpart'] * 6)} dot example dot org"
    assert len(spelled) > 300 and P.redacted(f"Write to {spelled}, please.", P.details(f"Write to {spelled}, please.")) == "Write to [EMAIL], please."
    town = "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch"
    street = f"12 {'Extraordinarily' * 4} {'Uncommonly' * 5} {'Longstreetname' * 4} Avenue, {town} 12345"
    assert len(street) > 200 and P.redacted(f"Ship it to {street}.", P.details(f"Ship it to {street}.")) == "Ship it to [ADDRESS]."


def test_gradient():
    maker = T.Maker(123)
    text, true = next(x for x in iter(maker.sample, None) if len(x[1]) > 1)
    run = max(P.chains(P.proposals(text)), key=len)
    w = {f: 0.1 * math.sin(i) for i, f in enumerate(sorted({f for *_, fs in run for f in fs}))}
    value, grad = T.gradient(run, true, w)
    for f in list(grad)[:12]:
        near, _ = T.gradient(run, true, w | {f: w.get(f, 0.0) + 1e-5})
        assert abs((near - value) / 1e-5 - grad[f]) < 1e-2


def test_best_segments_is_the_best_of_all():
    import itertools

    run = [(0, 3, "name", ["a"]), (2, 6, "phone", ["b"]), (4, 8, "name", ["c"]), (6, 9, "email", ["d"]), (0, 9, "address", ["e"])]
    w = {"a": 1.0, "b": 2.5, "c": 1.2, "d": 0.4, "e": 2.8, "phone>email": 0.3, "name>name": -0.5}

    def total(chosen):
        last, out = "O", 0.0
        for a, b, t, f in chosen:
            out += w[f[0]] + w.get(f"{last}>{t}", 0.0)
            last = t
        return out

    legal = [c for n in range(6) for c in itertools.combinations(sorted(run), n) if all(x[1] <= y[0] for x, y in zip(c, c[1:]))]
    best = max(legal, key=total)
    assert P.best_segments(run, w) == [x[:3] for x in best]


@pytest.mark.parametrize(("mean", "most"), [(0.3, 1), (1.4, 2), (0.05, 4), (3.9, 4), (2.0, 2), (0.0, 3), (900.0, 2000), (1999.0, 2000), (1200.0, 1300)])
def test_cut_poisson_has_its_mean(mean, most):
    steps = M.cut_poisson(mean, most)
    assert len(steps) == most and abs(sum(1 - c for c in steps) - mean) < 1e-6 and steps == sorted(steps)


def test_mix(spark):
    rows = [(i, f"some words number {i} " * (1 + i % 7), "Wiki " if i % 3 else "diary", "clash") for i in range(600)] + [(900, None, "wiki", "x"), (901, "a b", None, "x"), (902, "a b", "faq", "x"), (None, "a", "wiki", "x"), (0, "some words number 0 ", "diary", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    goals = spark.createDataFrame([("wiki", 0.5, 1), ("diary", 0.5, 3), ("none", 0.0, 1), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, shares = M.mixed(docs, goals)
    got = mix.collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and {r.source for r in got} == {"wiki", "diary"}
    assert max(r.copy for r in got if r.source == "wiki") == 1 and max(r.copy for r in got if r.source == "diary") <= 3
    table = {r.source: r for r in shares.collect()}
    assert abs(table["wiki"].share - 0.5) < 0.03 and abs(table["diary"].share - 0.5) < 0.03 and table["gone"].share == 0
    assert [r.place_key for r in got] == sorted(r.place_key for r in got)
    assert [(r.doc_id, r.copy) for r in M.mixed(docs, goals)[0].collect()] == [(r.doc_id, r.copy) for r in got]
    mix, shares = M.mixed(docs.limit(0), goals)
    assert mix.count() == 0 and all(r.share == 0 for r in shares.collect())


@pytest.fixture(scope="module")
def net():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/lang_samples.parquet").to_pylist()
    return G.trained(tuple((r["lang"], r["text"]) for r in t if r["sample_id"] % 4)), [(r["lang"], r["text"]) for r in t if r["sample_id"] % 4 == 0]


def test_held_out_languages(net):
    model, held = net
    pieces = [(lang, p) for lang, text in held for *_, p in G.passages(text)]
    kind, _ = G.classify(model, [p for _, p in pieces])
    assert sum(model.classes[k] == lang for k, (lang, _) in zip(kind, pieces)) / len(pieces) > 0.93
    kind, _ = G.classify(model, G.lines_without_language(200, seed=77))
    assert sum(model.classes[k] == G.NONE for k in kind) > 180


def test_passages_cover_wrapped_prose_and_skip_logs():
    text = "User: The first sentence is\nbroken over lines. A second one follows it!\n\n```\n2025-01-01T00:00:00Z INFO x\n$ run --job\n```\n- Eine kleine Liste steht hier.\n1\tNumbered line with some words"
    got = list(G.passages(text))
    assert [p for *_, p in got] == ["The first sentence is broken over lines.", "A second one follows it!", "Eine kleine Liste steht hier.", "Numbered line with some words"]
    assert all(text[a] == p[0] and 0 <= a < b <= len(text) for a, b, p in got)
    assert list(G.passages("")) == [] and list(G.passages("\n \n")) == []


def test_mislabelled(spark):
    en = "I would rather warm the cache first than trust a steady test harness again. After 366 minutes the permission check stopped because the parser choked on tabs."
    de = "Kannst du bitte einen kleinen Test schreiben, bevor Harrowridge wieder startet? Nach 261 Minuten war klar, dass der Filter umgekehrt war."
    rows = [(1, en, "en"), (2, en, "en-US"), (3, en, None), (4, en, "de"), (5, en + " " + de, "en"), (6, "{\"k\": 1}\n$ run --x", None), (7, None, "en"), (8, "  ", ""), (9, de, "und"), (None, en, "de"), (10, de, "GER")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, label string")
    samples = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    assert {tuple(r) for r in G.mislabelled(docs, samples).collect()} == {(3, "en"), (4, "en"), (5, "en"), (5, "de"), (9, "de")}
    assert G.spans(docs.filter("doc_id = 5"), samples).count() == 2
    assert G.segments(docs.limit(0), samples).count() == 0


def test_passages_of_heading_lines(net):
    text = "# Indigopath La línea de tiempo sustituye un tema huérfano porque el reloj iba adelantado. ¿Puedes guardar las dos versiones?\nEvery tangled check hides a tidy index\n\n- ## Heronindex\nbehind it.\n> ### Umberhub O leitor de mensagens substitui a ligação errada.\n# $ run --job\n####### not a heading"
    got = list(G.passages(text))
    assert [p for *_, p in got] == ["Indigopath La línea de tiempo sustituye un tema huérfano porque el reloj iba adelantado.", "¿Puedes guardar las dos versiones?", "Every tangled check hides a tidy index", "Heronindex", "behind it.", "Umberhub O leitor de mensagens substitui a ligação errada.", "####### not a heading"]
    assert all(text[a:b] == p for a, b, p in got)
    model, _ = net
    kind, _ = G.classify(model, [got[0][2], got[5][2]])
    assert [model.classes[k] for k in kind] == ["es", "pt"]
