"""Linking the spellings of one person or organisation within a workspace.

Method: the tokens of all names are put into a symmetric-delete neighbourhood index, which finds tokens within a small
edit distance; names that share a near token are candidates; a candidate pair is decided by an optimal assignment of its
tokens that permits initials, nicknames and abbreviations.  Spellings joined by full names form components (large-star
and small-star joins); spellings that only give an initial or an acronym join a component if exactly one fits.

Keys are tokens that tell bearers apart: given names, titles, legal forms and line-of-business words are no keys, so a
frequent one makes no hot group.

Defined results: rows with a null id, workspace or name, or a blank name, are left out; exact spellings count once, with
their smallest id; an initial that fits several bearers is linked to none of them; names of other kinds (by the types
that most of their spellings carry) give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import components
from memloom.scratch import Scratch

#: Given names with their short forms.
NICKNAMES = {
    "alexander": "alex al sandy xander lex sasha", "andre": "", "anneliese": "anne anni liesel annelie lisl", "bartholomew": "bart barth bat tolly",
    "beatriz": "bea bia trixie triz beatrice", "benjamin": "ben benny benji", "charlotte": "charlie lottie lotte char carlotta", "concepcion": "concha conchita chita conchi",
    "dominic": "dom nic nick domi", "edmund": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza lisa betsy libby bess lizzy elsie lisbeth",
    "francesca": "fran frankie francie cesca chesca franca", "francois": "frank fran", "friedrich": "fritz fred freddy fried rich", "gregory": "greg gregor",
    "guillermo": "memo guille guillo willy", "helene": "lena leni nell ellie hella", "ignatius": "iggy nate iggie ignaz", "ingrid": "inga inge",
    "isabelle": "belle isa izzy bella bel", "johannes": "hans johann jan joe hannes john", "josephine": "jo josie joey fina posy josy", "jurgen": "juergen jorg",
    "katherine": "kate kathy kat katie kay kathie kitty cathy", "leonard": "leo len lenny leon", "margaret": "peggy meg maggie marge margie daisy greta madge rita peg mags",
    "marisol": "mari sol", "mattias": "matt matty mats mattie", "maximilian": "max maxi maxim", "nathaniel": "nate nat nathan natty", "nuria": "nuri",
    "oksana": "oksanka ksenia sana ksana oxana", "penelope": "penny pen nell poppy", "robert": "rob bob bobby bert robbie robin", "rosalind": "roz ros rosie lindy rosa linda",
    "samantha": "sam sammy sammie", "soren": "soeren", "tariq": "tarik", "thaddeus": "thad tad teddy thady ted", "theodore": "ted teddy theo dory",
    "victoria": "vicky vic tori vicki tory vickie", "wilhelmina": "mina willa minnie billie wilma helmina willie", "william": "bill will billy willy liam wills willie",
    "yusuf": "yus joe yousef", "zoe": "zo",
}
#: Words that go with a name but are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame frau herr mme mlle monsieur madame sr sra srta senor senora don dona phd md msc mba esq jr ii iii dipl ing she he they her him them his".split())
PARTICLES = frozenset("de da do dos das del della di du la le van von der den ter zu zum el al y e".split())
#: Legal forms by the form they stand for.
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "llc": "llc", "inc": "inc", "incorporated": "inc", "gmbh": "gmbh", "mbh": "gmbh", "gesellschaft": "", "ag": "ag", "aktiengesellschaft": "ag",
    "sa": "sa", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "plc": "plc", "bv": "bv", "nv": "nv", "kg": "kg", "sl": "sl", "srl": "srl", "sarl": "sarl", "lda": "lda", "llp": "llp",
}
#: Lines of business, with usual short forms that are no plain abbreviation.
BUSINESS = {
    "international": "intl int", "textile": "txt tex", "works": "wks", "research": "res", "institute": "inst", "data": "", "travel": "trvl", "agency": "agcy", "health": "hlth", "software": "sw swe",
    "systems": "sys", "partners": "ptnrs ptrs", "glass": "", "energy": "engy nrg", "manufacturing": "mfg mfr", "instruments": "instr", "university": "univ uni", "consulting": "cons cnsltg", "services": "svcs svc srvcs",
    "logistics": "log lgstcs", "foods": "fds", "publishing": "pub publ", "house": "hse", "group": "grp", "marine": "mar", "supply": "sup sply", "bank": "bk", "trading": "trdg", "holding": "hldg", "holdings": "hldgs",
    "industries": "ind inds", "solutions": "soln solns", "technologies": "tech technol", "technology": "tech", "associates": "assoc", "association": "assn assoc", "brothers": "bros", "engineering": "eng engr", "national": "natl",
    "laboratories": "labs lab", "hospital": "hosp", "college": "coll", "department": "dept", "foundation": "fdn found", "center": "ctr", "centre": "ctr", "media": "", "design": "", "transport": "trans", "shipping": "shpg", "insurance": "ins",
}
SMALL = frozenset("and und et y e of the for de der die das la le".split())
#: Korean family names in Hangul and their usual Latin spellings.
KOREAN_FAMILY = {
    "김": "kim gim", "이": "lee yi rhee ri", "박": "park pak bak", "최": "choi choe", "정": "jung jeong chung", "강": "kang gang", "조": "cho jo", "윤": "yoon yun", "장": "jang chang", "임": "lim im",
    "한": "han", "오": "oh", "서": "seo suh", "신": "shin sin", "권": "kwon gwon", "황": "hwang", "안": "ahn an", "송": "song", "류": "ryu yoo", "홍": "hong", "전": "jeon", "고": "ko go", "문": "moon mun", "양": "yang", "손": "son", "배": "bae", "백": "baek", "허": "heo", "남": "nam", "심": "shim", "노": "noh", "하": "ha", "유": "yu yoo",
}
_FAMILY_OF = {spelling: spellings.split()[0] for spellings in KOREAN_FAMILY.values() for spelling in spellings.split()}
_LEADS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
_TAILS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")
_FULL = {short: {g for g, s in NICKNAMES.items() if short in s.split()} for s in NICKNAMES.values() for short in s.split()} | {}
for _given in NICKNAMES:
    _FULL.setdefault(_given, set()).add(_given)
_SHORT_BUSINESS: dict[str, set[str]] = {}
for _word, _shorts in BUSINESS.items():
    for _s in [_word, *_shorts.split()]:
        _SHORT_BUSINESS.setdefault(_s, set()).add(_word)
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without diacritics; Hangul stays composed."""
    text = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    out = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", out)


def romanised(word: str) -> str:
    out = []
    for c in word:
        n = ord(c) - 0xAC00
        out.append(_LEADS[n // 588] + _VOWELS[n % 588 // 28] + _TAILS[n % 28] if 0 <= n < 11172 else c)
    return "".join(out)


def sound(word: str) -> str:
    """Skeleton that is the same for the usual Latin spellings of a Korean given name."""
    for a, b in (("yeo", "yu"), ("woo", "u"), ("wu", "u"), ("oo", "u"), ("eo", "u"), ("eu", "u"), ("ee", "i"), ("weon", "won"), ("won", "un"), ("sh", "s"), ("ck", "k"), ("-", "")):
        word = word.replace(a, b)
    return word


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two tokens; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


class Name(NamedTuple):
    kind: str  # person, organisation, acronym, korean
    tokens: tuple[str, ...]
    legal: str
    keys: tuple[str, ...]


def _tokens(text: str) -> list[str]:
    text = re.sub(r"\([^)]*\)", " ", text)
    if not re.search(r"\s", text.strip()):
        text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[a-zà-ÿ])(?=[À-ÖØ-Þ])", " ", text)
    text = re.sub(r"(?<![^\W_])((?:[^\W\d_]\.){2,}[^\W\d_]?)(?![^\W_])", lambda m: m[1].replace(".", ""), text)
    return re.findall(r"[^\W_]+", fold(text.replace("'", "").replace("’", "")))


@lru_cache(maxsize=200_000)
def parse(raw: str) -> Name:
    text = unicodedata.normalize("NFKC", raw).strip()
    bare = re.sub(r"[\s()]", "", text)
    if re.fullmatch(r"(?:[A-Z]\.?){2,7}", bare) and not re.search(r"\s[A-Z]\b.*[a-z]", text):
        letters = bare.replace(".", "").lower()
        return Name("acronym", (letters,), "", (f"={letters}",))
    hangul = re.sub(r"\s+", "", re.sub(r"(?:님|씨)$", "", text))
    if re.fullmatch(r"[가-힣]{2,5}", hangul):
        family, given = hangul[0], hangul[1:]
        if family in KOREAN_FAMILY:
            latin = (KOREAN_FAMILY[family].split()[0], sound(romanised(given)))
            return Name("korean", latin, "", (f"~{latin[0]}{latin[1]}",))
        return Name("korean", ("", hangul), "", (f"~{hangul}",))
    words = _tokens(text)
    legal = ""
    core = []
    business = any(w in _SHORT_BUSINESS and len(w) > 2 for w in words) or "&" in text
    for i, w in enumerate(words):
        if i and w in LEGAL and (business or i == len(words) - 1):
            legal = LEGAL[w] or legal
            continue
        core.append(w)
    if legal or business:
        core = [w for w in core if w not in SMALL] or core
        keys = [w for w in core if w not in _SHORT_BUSINESS and len(w) > 2]
        initials = "".join(w[0] for w in core)
        # Acronyms are matched on initials; the line of business may be shortened, so the initials of the full words hold.
        return Name("organisation", tuple(core), legal, tuple(dict.fromkeys([*keys, f"={initials}", "+" + "".join(core)])))
    core = [w for w in core if w not in TITLES] or core
    if len(core) in (2, 3) and any(w in _FAMILY_OF for w in core) and not any(w in _FULL for w in core):
        family = next(w for w in ([core[0], core[-1]] if core[0] in _FAMILY_OF else [core[-1], core[0]]) if w in _FAMILY_OF)
        rest = list(core)
        rest.remove(family)
        given = sound("".join(rest))
        if len(given) > 1:
            latin = (_FAMILY_OF[family], given)
            return Name("korean", latin, "", (f"~{latin[0]}{latin[1]}",))
    core = [w for w in core if w not in PARTICLES] or core
    long = [w for w in core if len(w) > 1]
    keys = [w for w in long if w not in _FULL]
    if len(keys) > 1:
        # A misspelt given name is none of the known ones; as a key it would be as good as useless.
        rest = [w for w in keys if not any(abs(len(g) - len(w)) < 2 and distance(g, w, 1) < 2 for g in NICKNAMES)]
        keys = rest or keys
    return Name("person", tuple(core), "", tuple(dict.fromkeys([*(keys or long), "+" + "".join(core)])))


#: Bearers of one key in a workspace up to which all of them are compared.
HOT = 64


def _limit(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 7 else 2


@lru_cache(maxsize=500_000)
def _person_cost(a: str, b: str) -> float:
    """0 for equal, below 1 for nicknames and initials, edits otherwise; 9 if the tokens can't be the same."""
    if a == b:
        return 0.0
    fa, fb = _FULL.get(a, set()), _FULL.get(b, set())
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        firsts = {other[0]} | {g[0] for g in _FULL.get(other, set())}
        return 0.5 if one in firsts else 9.0
    if fa and fb:
        return 0.2 if fa & fb else 9.0
    d = distance(a, b)
    if d > _limit(a, b):
        a2, b2 = (x.replace("ue", "u").replace("oe", "o").replace("ae", "a") for x in (a, b))
        d = 0.2 if a2 == b2 else 9.0
    if d >= 9 and (fa or fb):
        # A misspelt full name against a nickname.
        known, typed = (fa, b) if fa else (fb, a)
        if any(distance(g, typed) <= _limit(g, typed) for g in known):
            return 1.2
    return float(d)


def _abbreviates(short: str, full: str) -> bool:
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    at = 0
    for c in short:
        at = full.find(c, at) + 1
        if not at:
            return False
    return True


@lru_cache(maxsize=500_000)
def _business_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    wa, wb = _SHORT_BUSINESS.get(a, set()), _SHORT_BUSINESS.get(b, set())
    if wa and wb:
        return 0.2 if wa & wb else 9.0
    if wa or wb:
        known, typed = (wa, b) if wa else (wb, a)
        if any(_abbreviates(typed, w) for w in known) and len(typed) <= 5:
            return 0.3
        return min([9.0, *(float(d) for w in known if (d := distance(w, typed)) <= _limit(w, typed))])
    d = distance(a, b)
    return float(d) if d <= _limit(a, b) else 9.0


def _assign(a: tuple[str, ...], b: tuple[str, ...], cost) -> tuple[float, list[tuple[int, int, float]]]:  # noqa: ANN001
    """Cheapest assignment of every token of the shorter name to one of the longer."""
    if len(a) > len(b):
        total, pairs = _assign(b, a, cost)
        return total, [(j, i, c) for i, j, c in pairs]
    grid = [[cost(x, y) for y in b] for x in a]
    if len(a) <= 4 and len(b) <= 6:
        best, chosen = 99.0, ()
        for places in permutations(range(len(b)), len(a)):
            total = sum(grid[i][j] for i, j in enumerate(places))
            if total < best:
                best, chosen = total, places
        return best, [(i, j, grid[i][j]) for i, j in enumerate(chosen)]
    # Long names: the optimum over subsets of the longer side, token by token.
    state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in grid:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, places) in state.items():
            for j, c in enumerate(row):
                if c < 9 and not used >> j & 1 and total + c < new.get(used | 1 << j, (99.0, ()))[0]:
                    new[used | 1 << j] = (total + c, (*places, j))
        state = new
    if not state:
        return 99.0, []
    total, places = min(state.values())
    return total, [(i, j, grid[i][j]) for i, j in enumerate(places)]


def compare(x: str, y: str) -> int:
    """2 if two spellings mean the same bearer, 1 if one gives only an initial or an acronym that fits, else 0."""
    a, b = parse(x), parse(y)
    if "acronym" in (a.kind, b.kind):
        if a.kind == b.kind:
            return 2 * (a.tokens == b.tokens)
        short, full = (a, b) if a.kind == "acronym" else (b, a)
        if full.kind != "organisation" or len(full.tokens) < 2:
            return 0
        return int("".join(t[0] for t in full.tokens) == short.tokens[0])
    if a.kind == b.kind == "korean":
        (fa, ga), (fb, gb) = a.tokens, b.tokens
        if fa and fb and fa != fb:
            return 0
        return 2 * (distance(ga, gb) <= (0 if min(len(ga), len(gb)) < 4 else 1) and bool(fa) == bool(fb))
    if "korean" in (a.kind, b.kind):
        typed, other = (a, b) if a.kind == "korean" else (b, a)
        joined = "".join(other.tokens)
        return 2 * (other.kind == "person" and (sound(joined) in (typed.tokens[0] + typed.tokens[1], typed.tokens[1] + typed.tokens[0])))
    glued = "".join(a.tokens), "".join(b.tokens)
    if "organisation" in (a.kind, b.kind):
        if a.legal and b.legal and a.legal != b.legal:
            return 0
        if glued[0] == glued[1] and len(glued[0]) > 5:
            return 2
        if len(a.tokens) != len(b.tokens):
            return 0
        total, pairs = _assign(a.tokens, b.tokens, _business_cost)
        if total > 2.9 or any(c >= 9 for *_, c in pairs):
            return 0
        own = [(i, j, c) for i, j, c in pairs if a.tokens[i] not in _SHORT_BUSINESS and b.tokens[j] not in _SHORT_BUSINESS]
        return 2 * bool(own)
    if glued[0] == glued[1] and len(glued[0]) > 5:
        return 2
    if min(len(a.tokens), len(b.tokens)) < 2:
        return 0
    # A further given name or its initial may be missing on one side, not more.
    if abs(len(a.tokens) - len(b.tokens)) > 1:
        return 0
    total, pairs = _assign(a.tokens, b.tokens, _person_cost)
    if any(c >= 9 for *_, c in pairs) or sum(c for *_, c in pairs if c >= 1) > 2.9:
        return 0
    full = [(a.tokens[i], b.tokens[j]) for i, j, c in pairs if len(a.tokens[i]) > 1 and len(b.tokens[j]) > 1]
    family = [p for p in full if not (p[0] in _FULL or p[1] in _FULL)]
    if not full or (not family and len(full) < 2):
        return 0
    return 2 if len(full) >= 2 else 1


def deletes(token: str) -> set[str]:
    """The token with as many letters left out as ``_limit`` permits edits; '~' marks Korean keys, '+' glued ones."""
    most = 0 if token[0] == "=" else min(1, _limit(token, token)) if token[0] in "+~" else _limit(token, token)
    out = {token}
    for n in range(1, most + 1):
        out |= {"".join(c for i, c in enumerate(token) if i not in gone) for gone in combinations(range(len(token)), n)}
    return out


def further(name: Name, key: str, left: bool) -> set[str]:
    """What a name shares with another one that ``compare`` accepts, beside tokens near ``key``, as signs of the left or right side.

    Persons: a part of a further token or of a full form of it, its spelling without umlauts, or, if one side only has an
    initial, that letter.  Where an organisation is one of the two: as many tokens.
    """
    person = name.kind == "person"
    out = {f"{'p' if person == left else 'o'}N{len(name.tokens)}"}
    if not person:
        return out | {f"N{len(name.tokens)}"}
    rest = list(name.tokens)
    if key in rest:
        rest.remove(key)
    for t in rest:
        full = _FULL.get(t, set())
        if len(t) == 1:
            out |= {f"{'i' if left else 'f'}{t}", f"I{t}"}
        else:
            out |= {f"{'f' if left else 'i'}{c}" for c in {t[0], *(g[0] for g in full)}}
            out |= {f"F{d}" for g in {t, *full} for d in deletes(g)} | {"U" + t.replace("ue", "u").replace("oe", "o").replace("ae", "a")}
    return out


@lru_cache(maxsize=100_000)
def parts_of(token: str) -> np.ndarray:
    """``deletes`` as 64-bit numbers; a name's tokens come again in other workspaces."""
    return np.array([xxhash.xxh64_intdigest(d) for d in deletes(token)], np.uint64).view(np.int64)


def spellings(hints: DataFrame) -> DataFrame:
    """(workspace_id, name, id, wanted, other): each exact spelling once, with how often its type was right and not."""
    kind = F.lower(F.trim("entity_type"))
    wanted = kind.rlike("^(pers|orga|org$|company|human|people|firm)")
    other = kind.isin("concept", "product", "procedure", "theme", "episode_topic", "topic", "tool", "event", "location", "place", "project", "decision")
    return (
        hints.filter(F.col("hint_id").isNotNull() & F.col("workspace_id").isNotNull() & (F.length(F.trim("name")) > 0))
        .groupBy("workspace_id", "name")
        .agg(
            F.min("hint_id").cast("long").alias("id"),
            F.coalesce(F.sum(wanted.cast("int")), F.lit(0)).alias("wanted"),
            F.coalesce(F.sum(other.cast("int")), F.lit(0)).alias("other"),
        )
    )


def linked(hints: DataFrame) -> DataFrame:
    """(workspace_id, id, name, entity): all spellings with the entity they mean; entity is the smallest id."""
    scratch = Scratch(hints.sparkSession, "names")
    names = scratch.write(spellings(hints), "spellings")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, k, i, p.kind == "acronym") for w, n, i in zip(batch["workspace_id"], batch["name"], batch["id"], strict=True) for p in [parse(n)] for k in p.keys]
            yield pd.DataFrame(rows, columns=["workspace_id", "key", "id", "short"])

    keys = scratch.write(names.select("workspace_id", "name", "id").mapInPandas(keyed, "workspace_id long, key string, id long, short boolean"), "keys")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [parts_of(k) for k in batch["key"]]
            again = np.repeat(np.arange(len(made)), [len(m) for m in made])
            yield pd.DataFrame({"workspace_id": batch["workspace_id"].to_numpy()[again], "part": np.concatenate(made) if made else np.zeros(0, np.int64), "key": batch["key"].to_numpy()[again]})

    # The parts are many times the keys, so the work is spread before it: a number given keeps it from being merged again.
    spread = 4 * hints.sparkSession.sparkContext.defaultParallelism
    # The index is made once and joined with itself; a part is a number, and two that share one by chance are told apart below.
    parts = keys.select("workspace_id", "key").distinct().repartition(spread, "workspace_id", "key").mapInPandas(index, "workspace_id long, part long, key string")
    parts = scratch.write(parts, "parts")
    near = (
        parts.join(parts.select("workspace_id", "part", F.col("key").alias("key_b")), ["workspace_id", "part"])
        .filter("key <= key_b").select("workspace_id", "key", "key_b").distinct()
    )
    # Bearers of one key are paired where they are few.  A frequent key's bearers must share a further part as well: what a
    # comparison needs beside the key (``further``), so nothing is lost and no group's pairs are all made.
    sizes = keys.groupBy("workspace_id", "key").agg(F.count(F.lit(1)).alias("n"))
    near = scratch.write(
        near.join(sizes, ["workspace_id", "key"]).join(sizes.select("workspace_id", F.col("key").alias("key_b"), F.col("n").alias("n_b")), ["workspace_id", "key_b"]), "near"
    )
    few = near.filter(F.col("n") * F.col("n_b") <= HOT * HOT)
    many = near.filter(F.col("n") * F.col("n_b") > HOT * HOT).select("workspace_id", "key", "key_b")
    a = keys.select("workspace_id", "key", F.col("id").alias("x"), F.col("short").alias("short_x"))
    b = keys.select("workspace_id", F.col("key").alias("key_b"), F.col("id").alias("y"), F.col("short").alias("short_y"))
    # Equal initials join an acronym to the names that it may stand for, not those names to each other.
    apt = "x <> y and (not startswith(key, '=') or short_x or short_y)"
    plain = few.join(a, ["workspace_id", "key"]).join(b, ["workspace_id", "key_b"]).filter(apt).select("x", "y")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, k, i, s, left) for w, k, i, n in zip(batch["workspace_id"], batch["key"], batch["id"], batch["name"], strict=True) for left in (True, False) for s in further(parse(n), k, left)]
            yield pd.DataFrame(rows, columns=["workspace_id", "key", "id", "sign", "left"])

    hot = scratch.write(many.select("workspace_id", "key").unionByName(many.select("workspace_id", F.col("key_b").alias("key"))).distinct(), "hot")
    owned = keys.join(hot, ["workspace_id", "key"], "left_semi").join(names.select("id", "name"), "id").select("workspace_id", "key", "id", "name")
    signs = scratch.write(owned.mapInPandas(signed, "workspace_id long, key string, id long, sign string, left boolean"), "signs")
    left = signs.filter("left").select("workspace_id", "key", F.col("id").alias("x"), "sign")
    right = signs.filter("not left").select("workspace_id", F.col("key").alias("key_b"), F.col("id").alias("y"), "sign")
    both = many.filter("not startswith(key, '=')").join(left, ["workspace_id", "key"]).join(right, ["workspace_id", "key_b", "sign"]).filter("x <> y").select("x", "y")
    # Acronyms of one frequent set of initials are few beside the names.
    initials = many.filter("startswith(key, '=')").join(a.filter("short_x"), ["workspace_id", "key"]).join(b, ["workspace_id", "key_b"]).filter("x <> y").select("x", "y")
    pairs = plain.unionByName(both).unionByName(initials).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    text = lambda s, n: names.select(F.col("id").alias(s), F.col("name").alias(n))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grade = [compare(x, y) for x, y in zip(batch["a"], batch["b"], strict=True)]
            out = batch[["u", "v"]].assign(grade=grade)
            yield out[out["grade"] > 0]

    links = scratch.write(
        pairs.join(text("u", "a"), "u").join(text("v", "b"), "v").select("u", "v", "a", "b").mapInPandas(decide, "u long, v long, grade int"), "links"
    )
    sure = components(links.filter("grade = 2"), scratch)
    first = scratch.write(
        names.select("id").join(sure, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("entity")), "first"
    )
    # Components that only give an initial or an acronym: those with a weak link whose own spellings are all short.
    end = lambda c, e: first.select(F.col("id").alias(c), F.col("entity").alias(e))
    weak = links.filter("grade = 1").join(end("u", "eu"), "u").join(end("v", "ev"), "v").filter("eu <> ev").select("eu", "ev").distinct()

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = [p.kind == "acronym" or (p.kind == "person" and sum(len(t) > 1 for t in p.tokens) < 2) for p in map(parse, batch["name"])]
            yield pd.DataFrame({"id": batch["id"], "short": short})

    shapes = names.select("id", "name").mapInPandas(shape, "id long, short boolean").join(first, "id").groupBy("entity").agg(F.min("short").alias("short"))
    both = weak.unionByName(weak.select(F.col("ev").alias("eu"), F.col("eu").alias("ev"))).distinct()
    full = shapes.filter("not short").select(F.col("entity").alias("ev"))
    lone = both.join(shapes.filter("short").select(F.col("entity").alias("eu")), "eu").join(full, "ev")
    fits = lone.groupBy("eu").agg(F.count(F.lit(1)).alias("n"), F.min("ev").alias("to")).filter("n = 1")
    joined = first.join(fits, F.col("entity") == F.col("eu"), "left").select("id", F.coalesce("to", "entity").alias("entity"))
    placed = names.join(joined, "id")
    votes = placed.groupBy("entity").agg(F.sum("wanted").alias("w"), F.sum("other").alias("o"), F.min("id").alias("least"))
    kept = votes.filter("w > o or (w = 0 and o = 0)").select("entity", "least")
    return placed.join(kept, "entity").select("workspace_id", "id", "name", F.col("least").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """(hint_id_a, hint_id_b): all pairs of spellings of one entity, the smaller id first."""
    a = entities.select("entity", F.col("id").alias("hint_id_a"))
    b = entities.select("entity", F.col("id").alias("hint_id_b"))
    return a.join(b, "entity").filter("hint_id_a < hint_id_b").select("hint_id_a", "hint_id_b")
