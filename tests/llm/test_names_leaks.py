import pytest

from memloom.llm import leakage as L
from memloom.llm import names as N

SAME = [
    ("Samantha Falibek", "Falibek, Samantha"), ("Samantha Falibek", "Sam Falibek"), ("Benjamin Primurson", "Btnjamin Poimurson"), ("Søren Brenakzir", "soren.brenakzir"), ("Jürgen Dalurescu", "JürgenDalurescu"), ("Jürgen Dalurescu", "juergen dalurescu"),
    ("Bartholomew Garoetti", "Bartholomew J. Garoetti"), ("William Torilbek, PhD", "Ms William Torilbek"), ("김지후", "Kim Jihu"), ("김 지후", "KIM, Jihoo"), ("Søren Nedelinho", "Søren Nelelinho"),
    ("Fenosetti & Norunova Logistics GmbH", "Fenosetti and Norunova Logistics"), ("Dalelfield Research Institute", "Dalelfield Res. Inst."), ("Univ. of Gareldov & Ruskutson", "Gareldov & Ruskutson University LLC"),
    ("Corutberg International Energy Services A.G.", "CorutbergInternationalEnergyServices"), ("Nedurgate Health Partners Limited", "Neduurgate Health Ptnrs Ltd"), ("Varurmoor & Dravenstad Data Systems Ltd", "The Varurmoor & Dravenstad Data Systems (VDDS)"),
]
OTHER = [
    ("Samantha Falibek", "Samantha Falenberg"), ("Josephine Falilorn", "Theodore Falilorn"), ("Nedurgate Health Partners", "Nedurgate Software"), ("Halornak Software Inc.", "Halornak Software GmbH"), ("김지후", "이지후"), ("Margaret Rosoinho", "Robert Rosoinho"), ("", "x"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert N.compare(a, b) == N.compare(b, a) == 2


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert N.compare(a, b) == N.compare(b, a) == 0


def test_initials_acronyms_and_index():
    assert N.compare("S. Falibek", "Samantha Falibek") == 1 and N.compare("M. Norosrick", "Peggy Norosrick") == 1 and N.compare("S. Falibek", "Robert Falibek") == 0
    assert N.compare("F.N.L.", "Fenosetti & Norunova Logistics") == 1 and N.compare("PES", "Primutado Energy Services GmbH") == 1
    for a, b in (("rosovik", "rosvoik"), ("rosovik", "rosoviks"), ("trelosescu", "treloescux")):
        assert N.deletes(a) & N.deletes(b) and N.distance(a, b) <= 2


def test_linked(spark):
    rows = [
        (1, 3, "Rosovik, R.", "person"), (2, 3, "Robert Rosovik", "Person"), (3, 3, "Rob Rosovik", None), (3, 3, "Rob Rosovik", None), (4, 3, "Robret Rosovik", "other"), (5, 4, "Robert Rosovik", "person"),
        (6, 3, "Q. Twins", "person"), (7, 3, "Quentin Twins", "person"), (8, 3, "Quirin Twins", "person"), (9, 3, "Kestrelnote", "product"), (10, 3, "Kestrelnotes", "product"), (11, 3, " ", "person"), (12, 3, None, "person"), (13, None, "Robert Rosovik", "person"), (14, 3, "Robert Rosovik", "person"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "hint_id long, workspace_id long, name string, entity_type string, id string")
    assert {tuple(r) for r in N.pairs(N.linked(df)).collect()} == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b}
    assert N.linked(df.limit(0)).count() == 0


ITEM = "According to the Torimark note, Coradko wanted a quiet chess clock rather than the surprising one from Faligburn near the river."


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (ITEM, True), (f"Intro. {ITEM.upper()} End", True), ("> " + ITEM.replace("a quiet", "a\n> quiet"), True), (ITEM.replace(" ", " ​"), True), (ITEM.replace(" ", ""), True), ("1\tAccording to the Torimark note, Coradko\n2\twanted a quiet chess clock\n3\trather than the surprising one from Faligburn", True),
        (ITEM.replace("note", "<b>note</b>").replace("the", "t\\u0068e"), True), (ITEM.replace("quiet", "loud"), True), ("**" + ITEM.replace(", ", "**, __") + "__", True), ("wanted a quiet chess clock rather than the surprising", False),
        ("(" + ", ".join(reversed(ITEM.split())) + ")", False), ("According to the Other note, Somebody wanted a loud market stall rather than the plain one from Elsewhere near the bridge.", False), ("", False),
    ],
)
def test_leak(text, found):
    assert bool(L.search(L.Items([(5, ITEM)]), ["before", text, "after"])) is found


def test_leaks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " + ITEM, 0), (2, "nothing of it", 0), (3, None, 0), (None, ITEM, 0), (1, "x " + ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short to count"), (9, None)], "item_id long, text string")
    n = len(L.words_of(ITEM))
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, 7, n, 0, 1)]
    monkeypatch.setattr(L, "PACK_CHARS", 10)  # items in several packs
    monkeypatch.setattr(L, "SHARD_CHARS", 10)  # a shard for each document
    monkeypatch.setattr(L, "SENT_CHARS", 0)  # packs are not broadcast
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, 7, n, 0, 1)]
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in L.without_leaks(docs, items).collect()} == {2, 3, None}


def test_long_words_of_wide_letters():
    """Three words of eight Hangul syllables are longer than any fixed key; one changed word of thirteen is a leak still."""
    import random

    r = random.Random(3)
    words = ["".join(chr(0xAC00 + r.randrange(11172)) for _ in range(8)) for _ in range(13)]
    changed = [*words[:6], "".join(reversed(words[6])), *words[7:]]
    items = L.Items([(1, " ".join(words))])
    assert [x[:2] for x in L.search(items, ["앞말 " + " ".join(changed) + " 뒷말"])] == [(0, 0)]
    assert [x[:2] for x in L.search(items, ["".join(changed)])] == [(0, 0)]
    assert L.search(items, [" ".join(words[:5]) + " " + " ".join(reversed(words[5:]))]) == []


def test_suffix_array_and_matches_against_brute_force():
    import random

    r = random.Random(8)
    vocabulary = ["ab", "abc", "b", "ca", "cabab", "x" * 30]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(12)]
    texts += [texts[0], texts[1] + " ab", ""]
    items = L.Items([(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(12, 30)))) for i in range(4)])
    shard = L.Shard(texts)
    shard.sort(items.longest)
    depth = shard.depth
    suffixes = [shard.raw[p : p + depth].split(b"\0")[0] for p in shard.order]
    assert sorted(shard.order.tolist()) == shard.places.tolist()
    assert all(a[: items.longest] <= b[: items.longest] for a, b in zip(suffixes, suffixes[1:]) if len(a) < depth or len(b) < depth or a != b)
    want = set()
    for s in range(len(items.owner)):
        own, k = int(items.owner[s]), int(items.place[s])
        raw, at = items.raw[own], int(items.starts[own][k])
        for p in shard.places.tolist():
            n = 0
            while at + n < len(raw) and raw[at + n] == shard.raw[p + n]:
                n += 1
            if n >= items.size[s]:
                want.add((own, k, p, n))
    assert {tuple(x[1:]) for x in L.followed(items, shard, L.hits(items, shard)).tolist()} == want and want


def test_a_document_of_boilerplate_is_compared_in_windows():
    start = " ".join(ITEM.split()[:6])
    assert L.search(L.Items([(5, ITEM)]), [" ".join([start] * 3000)]) == []
    assert [x[:2] for x in L.search(L.Items([(5, ITEM)]), [" ".join([start] * 3000) + " " + ITEM + " " + " ".join([start] * 3000)])] == [(0, 0)]


def test_index_is_as_wide_as_the_comparison(spark):
    for a, b in (("krevvemson", "krevemsn"), ("keladbreg", "keladbeerg"), ("halerik", "hlaerkk"), ("~kimminsu", "+kimminsu")):
        assert N.deletes(a) & N.deletes(b)
    rows = [(1, 3, "Tariq Krevvemson"), (2, 3, "Tariq Krevemsn"), (3, 3, "Robert Keladbreg"), (4, 3, "Robert Keladbeerg"), (5, 3, "Ingrid Hlaerik"), (6, 3, "Ingrid Halerkk"), (7, 3, "김지후"), (8, 3, "Kim Jihu")]
    df = spark.createDataFrame([(*r, "person") for r in rows], "hint_id long, workspace_id long, name string, entity_type string")
    assert {tuple(r) for r in N.pairs(N.linked(df)).collect()} == {(1, 2), (3, 4), (5, 6), (7, 8)}


def test_long_names_are_compared():
    a, b = "Maria da Conceicao Teresa Sofia Almeida Brandao Vasques Queiroz", "Maria da Conceicao Teresa Sofia Almeida Brandao Vasquez Queiroz"
    assert len(N.parse(a).tokens) > 6 and N.compare(a, b) == 2
    assert N.compare("Jan Kowalczyk", "Jan Kovalcsyk") == 2 and N.deletes("kowalczyk") & N.deletes("kovalcsyk")


def test_frequent_keys_lose_nothing(spark, monkeypatch):
    """All keys taken as frequent: the same links as with none."""
    hints = spark.read.parquet("/root/testdata/sf0.01/entity_hints.parquet")
    few = {tuple(r) for r in N.linked(hints).select("id", "entity").collect()}
    monkeypatch.setattr(N, "HOT", 0)
    assert {tuple(r) for r in N.linked(hints).select("id", "entity").collect()} == few and len(few) > 300


def test_accepted_persons_share_a_sign():
    for a, b in SAME:
        x, y = N.parse(a), N.parse(b)
        if x.kind == y.kind == "person":
            shared = [(k, m) for k in x.keys for m in y.keys if N.deletes(k) & N.deletes(m)]
            assert any(N.further(x, k, True) & N.further(y, m, False) or k[0] == "+" for k, m in shared), (a, b)
