"""Personal details in free text: found by a semi-Markov conditional random field, replaced by typed placeholders.

Segments of bounded length are proposed for each type (name, email, phone, id_number, address) by their shape alone:
runs of two to five capitalised words with initials, particles or a comma, Hangul words that open with a family name,
runs of digits, spelled-out addresses.  Word lists propose nothing there (they do for names in lower case only, which
have no shape); being listed is one feature among many.  Everything between the segments is left outside.

A segment is scored by features of the whole span (its form, the shape of its digits, case, endings and length of its
words, listed given names, house number and postcode, what stands to its left and right); dynamic programming over the
proposed boundaries chooses segments and types jointly, and sums over all segmentations when the weights are trained
(``personal_training``).  The weights are a small table next to this file, made by that script from generated sentences.

How common a word is comes from the vocabularies of public tokenizers (``VOCABULARIES``, read on the driver and sent to
the tasks; 41,000 words, whatever the data): a word that is one token in lower case, only with a capital, or not at all.

Defined results: offsets count Unicode code points from 0; null and empty texts hold nothing; rows with a null id are
left out, repeated ids count once; a placeholder replaces exactly the detail, the rest of the text stays as it was.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.names import BUSINESS, KOREAN_FAMILY, NICKNAMES, PARTICLES, fold
from memloom.tables import once_by_key

#: Common given names of many countries, lower case; a feature of a span, and what proposes names in lower case.
GIVEN = frozenset(
    (
        "ali amara amina ana anders andrea anjali anna antonio astrid aylin bianca brian bruno camille carlos carmen chidi christian christina claire clara daniel david deepak diego dimitri elena emily emma enrique erik esra fabio fatima femi fernanda "
        "giovanni giulia grace hannah hans hassan heike helga henrik hugo ibrahim ines isabel ivan jack jakub james jana javier jennifer joao jonas jorge jose juan julia julien karen karl katarzyna kenji kevin klaus kofi lars laura layla leila liam linda lucas lucia "
        "luis magnus manuel maria marie marta martin matteo mehmet mei michael miguel mohammed monika naomi natalia nikolai noah olga oliver omar oscar pablo patricia paul paula pedro peter pierre piotr rafael rahul ravi rosa ruth sanjay sara sergio simon sofia sophie "
        "stefan susan sven tatiana thomas tiago tomasz ulrike valentina vera viktor wei yara yuki yusra zofia zuzana"
    ).split()
)
#: Words that announce a person, a telephone or an identity number.
PERSON_CUES = frozenset(
    (
        "mr mrs ms miss mx dr prof sir madam frau herr mme mlle m monsieur madame sr sra srta senor senora señor señora senhor senhora don doña dona dhr mevr mevrouw meneer "
        "by from with to and colleague author speaker contact attn attention cc dear hi hello regards sincerely thanks candidate patient director manager engineer nurse teacher neighbour chairman chairwoman name named called signed tell ask call meet met "
        "kollege kollegin autor leiter leiterin gruß grüße von mit laut bitte naam naar van met volgens beste groeten nom avec selon par cher chère bonjour nombre con según por hola estimado estimada nome com segundo olá caro cara prezado"
    ).split()
)
PHONE_CUES = frozenset("tel phone call text sms dial ring fax mobile cell whatsapp hotline telefon telefono teléfono telefone téléphone tél handy móvil movil celular gsm ruf anruf appelez appeler llamar llame llama ligar ligue bel bellen mobiel telefoon 번호 전화 연락처 휴대폰 unter au al no op on".split())
ID_CUES = frozenset("passport ssn tax taxpayer insurance nino nhs social security identity id card licence license documento documentos dni nie nif cpf rg pièce piece carte ausweis personalausweis ausweisnummer steuernummer reisepass identiteit identiteitsnummer bsn burgerservicenummer paspoort document pasaporte passaporte passeport 주민 등록 주민등록번호 여권 number nummer numéro número".split())
#: Words before numbers that belong to things.
THING_CUES = frozenset("order invoice ticket build part item batch lot row rows page code sku serial model version track tracking parcel case sensor port score ratio commit hash checksum line room flight train seat shelf bin box isbn ean bestellung rechnung auftrag zeile seite commande facture ligne pedido factura línea fatura linha bestelling factuur regel release revision patch range between from chapter figure table".split())
#: Frequent words of the seven languages that no family name is spelled like.
COMMON = frozenset(
    (
        "a about after again all also always am an and any are as at be because been before both but by can could did do does done each every few first for from get gets had has have he hello her here him his how i if in into is it its just last let like made many may more most must my "
        "never new next no not now of off on one only or other our out over please said same see she should so some still such than thanks that the their them then there these they this those to today tomorrow too under until up very was we were what when where which while who why will with would yes yesterday you your "
        "aber alle als am auch auf aus bei beim bis da dann das dass dem den der des die dies diese dieser doch ein eine einem einen einer er es für gestern heute hier ich ihr im immer ist ja jede jeder kein keine mein mit morgen nach nicht noch nur oder ohne sehr sein seine seit sich sie sind so und uns unser unsere vom von vor war warum was wann weil wenn wer wie wir wo zum zur zwei "
        "au aux avec ce ces cette chaque dans de des du elle en est et hier il je la le les leur mais mon ne nos notre nous on ou où par pas pour quand que qui sa sans se ses si son sont sur un une vous "
        "al ayer como con cuando del donde el ella ellos entre era es esa ese esta este hay hoy la las lo los más mi muy nada ni nos o para pero por porque qué se sin su sus también un una y ya "
        "ao aos até com como da das do dos e ela ele em essa esse esta este foi hoje isso já mais mas na nas no nos não nossa nosso o onde ontem os ou pela pelo por porque quando são se sem seu sua também um uma "
        "aan als bij dan dat deze die dit door een en er gisteren heeft het hij hun ik in is je maar met mijn morgen naar niet nog nu of om onze ook op te toen tot uit van vandaag veel voor waar wat wel wie wij worden zijn zo"
    ).split()
)
#: Words after which a noun stands.
DETERMINERS = frozenset("the a an our my your his her their this that every each der die das den dem des ein eine einen einem einer unser unsere unserem unseren mein meine meinem dein ihre seine diese dieser jede le la les un une mon ma mes notre votre son sa leur ce cette el los las una mi mis nuestra nuestro su esta este o os as um uma meu minha nossa nosso esta este de het een mijn onze ons jouw haar zijn deze".split())
#: Korean endings that a given name is not.
KOREAN_ENDINGS = frozenset("에서 에는 에도 에게 에만 으로 로는 부터 까지 하지 하고 하는 하면 해서 해야 했다 한다 된다 되어 되는 되지 됩니 합니 입니 습니 이다 이나 이라 이고 이며 처럼 보다 마다 조차 밖에 라도 지만 는데 들은 들이 들을 들의 에요 어서 아서 어요 아요 리고 러나 면서 려고 리는 리지".split())
#: Words of places and of things with names, in which capitals mean no person.
THING_WORDS = frozenset(
    "north south east west new old great upper lower san santa saint st los las mount mont lake lago river rio city port cape island islands street avenue road park hotel station airport bridge square museum church school university college hospital bank group team project release version act chapter section part figure table report plan review summary notes update guide manual policy state states kingdom republic sea ocean valley forest theme edition studio cloud server engine".split()
)
ORG_AFTER = re.compile(r"\s*(?:&|\+)\s|\s+(?:and|und|et|y|e|en)\s+(?:[A-Z][a-z]+\s+)?(?:Software|Logistics|Foods|Systems|Sons|Partners|Works|Group|Co\b)|\s+(?:GmbH|Ltd|LLC|Inc|AG|S\.A|Corp|PLC|BV|B\.V|SARL|Lda|Road|Street|Works|Software|Logistics|Group|theme|Foods|Systems|University|Institute|Bank|Hotel|Avenue|School)\b")
_GIVEN = sorted({*NICKNAMES, *GIVEN})
_W = r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)?"
_PART = r"(?:(?i:van(?: den?| der| het)?|von(?: der| dem)?|de(?: la| las| los)?|da|do|dos|das|del|di|du|la|le|ter|ten|zu) )"
_AFTER = re.compile(rf" ((?:[^\W\d_]\.? ){{0,2}}{_PART}{{0,2}})({_W})(?![\w@])")
_AFTER2 = re.compile(rf" ({_W}) ({_W})(?![\w@])")
_BEFORE_COMMA = re.compile(rf"(?<![\w@.+-])({_PART}{{0,2}}({_W})), $")
_BEFORE = re.compile(rf"(?<![\w@.+-])({_W}) $")
_MIDDLE = re.compile(r" [^\W\d_]\.(?! ?[^\W\d_]\w)| [^\W\d_]\.(?=\s+(?:[a-z]|[A-Z][a-z]+\b))")
_INITIAL = re.compile(r"(?<![\w.@])[^\W\d_a-zà-ÿ]\.")
_FROM_INITIAL = re.compile(rf"[^\W\d_a-zà-ÿ]\.(?: ?[^\W\d_a-zà-ÿ]\.)? ({_PART}{{0,2}}{_W})(?![\w@])")
_PAIR = re.compile(rf"\.? ?({_W},? (?:[^\W\d_]\. )?{_PART}{{0,2}}{_W})(?![\w@])")
_PAIR_BEFORE = re.compile(rf"(?<![\w@.+-])({_W},? (?:[^\W\d_]\. )?{_PART}{{0,2}}{_W})$")
_CAP = r"(?:[A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩЀ-Я][^\W\d_]+|[ODLN]['’][A-ZÀ-Þ][^\W\d_]+)(?:['’-](?!s\b)[^\W\d_]+)*"
_LINK = rf"(?: (?:[A-ZÀ-ÖØ-Þ]\. )?{_PART}{{0,2}}|, )"
_CAPITALISED = re.compile(rf"(?<![\w@.+/&#='’-]){_CAP}(?:{_LINK}{_CAP})+(?![\w@])")
_CAPITAL = re.compile(_CAP)
_FAMILIES = "|".join(KOREAN_FAMILY)
#: Korean titles and particles that may follow a name within its word.
_KO_TITLES = "씨|님|군|양|선생|교수|박사|과장|대리|부장|팀장|사장|차장|실장|원장|기자|의원|작가|간호사"
_KO_AFTER = "에게서|에게는|에게|한테서|한테|께서는|께서|께|이라고|라고|이라는|라는|이랑|랑|하고|입니다|이다|이에요|예요|인데|부터|까지|이가|이는|이를|이의|이도|이와|은|는|이|가|을|를|의|와|과|도|만|로"
_HANGUL_NAME = re.compile(rf"(?<![가-힣])(?:(?:{_FAMILIES}|남궁|황보|제갈|선우)[가-힣]{{2}}|(?:남궁|황보|제갈|선우|{_FAMILIES}) [가-힣]{{2}}(?= ?(?:{_KO_TITLES}))|(?:{_FAMILIES})[가-힣](?=(?: ?(?:씨|님))(?![가-힣]{{2}})))(?=((?:{_KO_TITLES})?님?)((?:{_KO_AFTER})?)(?![가-힣]))")
_KO_TITLE_NEXT = re.compile(rf" ?(?:{_KO_TITLES})")
_AT_SIGN = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|At)\s?[\])}]\s?)"
_AT_WORD = r" (?:at|AT) "
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?| (?:dot|DOT) )"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_DOMAIN = rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}(?![\w@+%])"
# Spelled with a bare 'at', a domain must not itself stand before the true separator.
_EMAIL = re.compile(rf"(?<![\w.+-])[\w%+-]+(?:{_DOT}[\w+%-]+)*(?:{_AT_SIGN}{_DOMAIN}|{_AT_WORD}{_DOMAIN}(?!{_AT_SIGN}|{_AT_WORD}|-))")
_RUN = re.compile(r"(?<![\w.,/=#@-])(?:\+ ?)?\(?\d(?:\d|[ .\-/()]{1,2}(?=[\d(])){5,26}+(?![\w])(?:,? ?(?:ext\.?|x\.?|Ext\.?|poste|Durchwahl) ?\d{1,5})?")
_CODE = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?)(?![\w-])")
_TOWN = r"(?:[A-ZÀ-Ý][\wà-ÿ'’-]+(?: [A-ZÀ-Ý][\wà-ÿ'’-]+)?)"
_US = re.compile(
    r"(?<![\w.,/=#-])\d{1,5}[A-Za-z]?,? (?:(?:[NSEW]{1,2}\.?|North|South|East|West) )?(?:[A-Z][\w'’-]+\.? ){1,3}(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Blvd|Boulevard|Drive|Dr|Court|Ct|Place|Pl|Terrace|Crescent|Cres|Mews|Way|Square|Sq|Close|Parkway|Pkwy|Row|Hill|Gardens|Circle|Highway)\b(?:(?<=St)\.|(?<=Ave)\.|(?<=Blvd)\.|(?<=Rd)\.|(?<=Dr)\.|(?<=Ln)\.|(?<=Pl)\.|(?<=Ct)\.)?"
    rf"(?:,? (?:Apt|Suite|Unit|Flat|#)\.? ?\w+)?(?:(?:,\s?| ?\r?\n){_TOWN}(?: \d{{4,5}})?)?", re.ASCII)
_STREET_NO = re.compile(r"(?<![\w.,/=#-])[A-Z][\w'’-]+ (?:Street|Lane|Road|Avenue|Drive|Court|Place|Terrace|Mews|Way) \d{1,4}[a-z]?(?![\w.])")
_DE = re.compile(rf"(?<![\w./=#-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|kamp|gasse|platz|allee|ring|damm|ufer|steig|stieg|pfad|chaussee|graben)|(?:Am|An der|Im|Zum|Zur|Auf der) [A-ZÄÖÜ][\wäöüß-]+) \d{{1,4}} ?[a-z]?(?![\w])(?:,? \d{{4,5}} {_TOWN})?")
_NL = re.compile(rf"(?<![\w./=#-])[A-Z][\w'’-]*(?:straat|laan|kade|weg|plein|gracht|singel|dijk|steeg|pad|dreef|hof|markt) \d{{1,4}} ?(?:[a-z]|bis)?(?![\w])(?:,? \d{{4}} ?[A-Z]{{2}} {_TOWN})?")
_IBERIAN = re.compile(rf"(?<![\w./=#-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Paseo|Plaza|Camino|Ronda|Travesía|Callejón|Rua|R\.|Travessa|Praça|Alameda|Largo|Estrada|Beco)(?: (?:de|del|da|do|das|dos|la|las|los|el|[A-ZÀ-Ý][\wà-ÿ'’-]*)){{1,5}},? ?(?:n\.?º ?)?\d{{1,4}}(?![\w])(?:, ?\d{{1,2}}\.?º ?[A-Z]?)?(?:,? \d{{4,5}}(?:-\d{{3}})? {_TOWN})?")
_FR = re.compile(rf"(?<![\w./=#-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|impasse|chemin|boulevard|place|allée|quai|cours|route|passage|square|sentier|ruelle)(?: (?:de la|de l['’]|du|des|de|la|le|les|d['’]))? ?[A-ZÀ-Ý][\wà-ÿ'’-]*(?: [A-ZÀ-Ý][\wà-ÿ'’-]*)*(?:,? \d{{5}} {_TOWN})?")
_KO = re.compile(r"(?<![가-힣])[가-힣]{1,5}(?:특별시|광역시|시|도|군) (?:[가-힣]{1,5}(?:구|군|시|읍|면|동) ){0,2}[가-힣\d]{1,7}(?:대로|로|길)(?: ?\d{1,4}번길)? ?\d{1,4}(?:-\d{1,4})?(?!\d)")
_POST = re.compile(r"\b\d{4,5}(?:-\d{3})?\b(?: ?[A-Z]{2}\b)?")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")

#: What stands before or after a name in lower case; what an address is written with.
_CUE_WORDS = "mr. mrs. ms. dr. prof. frau herr mme mlle sr. sra. dhr. mevr. mevrouw|call|ask|tell|meet|contact:|cc:|attn:|name:|from:|signed:|thanks,|regards,"
_FOLLOWING = [" wrote:", " said", " asked", " called", " schrieb", " sagte", " a dit", " dijo", " disse", " zei"]
_STREET_WORDS = {
    "us": " street, st, lane, ln, road, rd, avenue, ave, blvd, boulevard, drive, dr, court, ct, place, pl, terrace, crescent, cres, mews, way, square, close, parkway, row, hill, gardens, circle, highway",
    "de": "straße,strasse,str.,weg ,kamp ,gasse ,platz ,allee ,ring ,damm ,ufer ,steig ,stieg ,pfad ,chaussee ,graben ,am , an der ,im ,zum ,zur ,auf der ",
    "nl": "straat,laan ,kade ,gracht ,singel ,dijk ,steeg ,dreef ,plein ,pad ,hof ,markt ",
    "ib": "calle ,c/,avenida ,avda,av.,paseo ,plaza ,camino ,ronda ,travesía ,callejón ,rua ,r. ,travessa ,praça ,alameda ,largo ,estrada ,beco ",
    "fr": " rue , avenue , impasse , chemin , boulevard , place , allée , quai , cours , route , passage , square , sentier , ruelle ",
}


def _build() -> ahocorasick.Automaton:
    words: dict[str, list[tuple[str, int]]] = {}
    for name in _GIVEN:
        words.setdefault(name, []).append(("given", len(name)))
    for mark in ("@", " dot ", "[dot]", "(dot)", "(at)", "[at]", "{at}"):
        words.setdefault(mark, []).append(("email", len(mark)))
    for part in _CUE_WORDS.split("|"):
        for cue in part.split() if part.startswith("mr.") else [part]:
            words.setdefault(cue, []).append(("cue", len(cue)))
    for phrase in _FOLLOWING:
        words.setdefault(phrase, []).append(("after", len(phrase)))
    for form, listed in _STREET_WORDS.items():
        for word in listed.split(","):
            words.setdefault(word, []).append((form, len(word)))
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, tuple(kinds))
    out.make_automaton()
    return out


_finder = _build()
#: Vocabularies of public tokenizers whose whole words tell common words from names.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_words: frozenset[str] = frozenset()


def common_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """The words of three letters and more that are tokens of their own."""
    out = set()
    for path in paths:
        for line in Path(path).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and len(token) > 3:
                word = token[1:].decode("utf-8", "ignore")
                if word.isalpha():
                    out.add(word)
    return frozenset(out)


def use_words(words: frozenset[str]) -> None:
    """Set the words that this process tells names from."""
    global _words  # noqa: PLW0603
    _words = words


def _rarity(word: str) -> str:
    """l: a common word; c: common with a capital only; -: neither."""
    return "l" if word.lower() in _words else "c" if word.capitalize() in _words else "-"


def _case(word: str) -> str:
    return "U" if word.isupper() and len(word) > 1 else "T" if word[0].isupper() else "l"


def _words_left(text: str, at: int) -> tuple[str, str]:
    near = _TOKEN.findall(text[max(0, at - 40) : at].rpartition("\n")[2])
    return (near[-1].lower() if near else "^"), (near[-2].lower() if len(near) > 1 else "^")


def _word_right(text: str, at: int) -> str:
    m = _TOKEN.search(text, at, at + 30)
    return "$" if not m or "\n" in text[at : m.start()] else m[0].lower()


def _cues(text: str, at: int) -> set[str]:
    near = text[max(0, at - 48) : at].rpartition("\n")[2]
    return {w.lower() for w in _TOKEN.findall(near)[-4:]}


def _mask(word: str) -> str:
    return "9" if word.isdigit() else word


def _edge(text: str, at: int, left: bool) -> str:
    """What touches a span: start or end of the line, a mark, or a word by its case."""
    near = text[max(0, at - 3) : at].rpartition("\n")[2].rstrip(" ") if left else text[at : at + 3].partition("\n")[0].lstrip(" ")
    if not near:
        return "^" if left else "$"
    c = near[-1 if left else 0]
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


def _hangul_features(text: str, a: int, b: int, form: str, ending: str) -> list[str]:
    family, given = text[a], text[a + 1 : b].strip()
    title = bool(_KO_TITLE_NEXT.match(text, b))
    l1, _ = _words_left(text, a)
    r1 = _word_right(text, b + len(ending))
    out = ["k", f"k:form={form}", f"k:title={title}", f"k:family={family}", f"k:end={ending}", f"k:end={ending}:title={title}", f"k:left={_edge(text, a, True)}", f"k:right={_edge(text, b + len(ending), False)}", f"k:l1={_mask(l1)}", f"k:r1={_mask(r1)}", f"k:given={given}"]
    if len(given) == 2:
        out.append(f"k:word={given in KOREAN_ENDINGS}")
        out += [f"k:g1={given[0]}", f"k:g2={given[1]}"]
    return out


def _name_features(text: str, a: int, b: int, form: str) -> list[str]:
    span = text[a:b]
    words = re.findall(r"[^\W\d_]+", span)
    long = [w for w in words if len(w) > 1 and w.lower() not in PARTICLES]
    plain = [fold(w) for w in long]
    known = [w in _KNOWN for w in plain]
    l1, l2 = _words_left(text, a)
    r1 = _word_right(text, b)
    cue = bool({l1, l2} & PERSON_CUES) or l1 == "." and l2 in PERSON_CUES
    left, right = _edge(text, a, True), _edge(text, b, False)
    n = min(2, sum(known))
    low = [w.lower() for w in long]
    common = [w in COMMON for w in low]
    thing = [w in THING_WORDS or w in _BUSINESS for w in low]
    rare = [_rarity(w) for w in long]
    out = [
        "n", f"n:form={form}", f"n:case={''.join(sorted({_case(w) for w in long}))}", f"n:known={n}", f"n:known@={''.join('01'[k] for k in known[:4])}:{left == 'A' or left == 'a'}", f"n:form={form}:known={n}", f"n:words={len(words)}", f"n:r1={_mask(r1)}", f"n:l1={_mask(l1)}",
        f"n:cue={cue}", f"n:form={form}:cue={cue}", f"n:known={n}:cue={cue}", f"n:left={left}:known={n}", f"n:left={left}:form={form}", f"n:right={right}", f"n:left={left}:right={right}", f"n:common={sum(common)}", f"n:things={sum(thing)}",
        f"n:det={l1 in DETERMINERS}:words={len(long)}:{left == 'A'}", f"n:det={l1 in DETERMINERS}:form={form}:known={n}",
    ]
    if ORG_AFTER.match(text, b):
        out.append("n:org")
    if any(w in PHONE_CUES or w in THING_CUES or w in ID_CUES for w in low):
        out.append("n:label")
    if words and words[0].lower() in PARTICLES:
        out += ["n:lead", f"n:lead:{words[0].lower()}", f"n:lead:{l1}"]
    if any(re.search(r"[a-zà-ÿ][A-Z]", w) and not re.match(r"(?:Mc|Mac|De|Di|Le|La|O)[A-Z]", w) for w in long):
        out.append("n:camel")
    if text[b : b + 2] and text[b] in "-'’&@_/":
        out.append("n:glued'" if text[b : b + 2] in ("'s", "’s") else "n:glued")
    if long:
        g, f = (-1, 0) if "," in form else (0, -1)
        first, last = plain[g], plain[f]
        start = left in "^.!?:*-#\"("
        out += [
            f"n:start={start}:known0={known[g]}", f"n:first-common={common[0]}", f"n:last-common={common[-1]}", f"n:given={first[-2:]}", f"n:given={first[-3:]}", f"n:given<{first[:2]}", f"n:family={last[-3:]}", f"n:family={last[-2:]}",
            f"n:sizes={min(9, len(first))}:{min(9, len(last))}", f"n:vowels={_vowels(first)}:{_vowels(last)}",
            f"n:rare={''.join(rare[:4])}", f"n:rare={rare[g]}{rare[f]}:known={n}", f"n:rare={rare[g]}{rare[f]}:cue={cue}", f"n:plain={rare.count('l')}:{len(rare)}", f"n:rare={rare[g]}{rare[f]}:start={start}",
            *(f"n:w={w}" for w in low),
        ]
    return out


def _vowels(word: str) -> int:
    return round(4 * sum(c in "aeiouy" for c in word) / len(word))


def _number_features(text: str, a: int, b: int, tag: str) -> list[str]:
    span = re.sub(r",? ?(?:ext|x|Ext|poste|Durchwahl)\.? ?\d+$", "", text[a:b])
    digits = re.sub(r"\D", "", span)
    shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", span))
    l1, l2 = _words_left(text, a)
    near = _cues(text, a)
    us = re.fullmatch(r"(?:\+?1)?([2-9]\d\d)([2-9]\d\d)(\d{4})", digits)
    phone, ident, thing = bool(near & PHONE_CUES), bool(near & ID_CUES), bool(near & THING_CUES)
    out = [
        tag, f"{tag}:shape={shape}", f"{tag}:digits={min(15, len(digits))}", f"{tag}:plus={span[0] == '+'}", f"{tag}:zero={digits[:1] == '0'}", f"{tag}:l1={_mask(l1)}", f"{tag}:l2={_mask(l2)}", f"{tag}:r1={_mask(_word_right(text, b))}", f"{tag}:right={_edge(text, b, False)}",
        f"{tag}:phone={phone}:id={ident}:thing={thing}", f"{tag}:thing={thing}", f"{tag}:shape={shape}:id={ident}:phone={phone}", f"{tag}:left={_edge(text, a, True)}", f"{tag}:us={bool(us)}", f"{tag}:shape={shape}:us={bool(us)}", f"{tag}:letters={'A' in shape}", f"{tag}:groups={len(re.findall(r'9+', shape))}",
    ]
    if len(span) != b - a:
        out.append(f"{tag}:ext")
    if re.match(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./]", span) or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", span):
        out.append(f"{tag}:date")
    if re.match(r"\d\.\d{4,}", span):
        out.append(f"{tag}:decimal")
    return out


def _address_features(text: str, a: int, b: int, form: str) -> list[str]:
    span = text[a:b]
    l1, _ = _words_left(text, a)
    return ["a", f"a:form={form}", f"a:post={bool(_POST.search(span[3:]))}", f"a:form={form}:l1={_mask(l1)}", f"a:r1={_mask(_word_right(text, b))}", f"a:line={chr(10) in span}", f"a:form={form}:comma={',' in span}"]


#: Words of context around the place where a detail may be.
LEAST_LEFT, LEAST_RIGHT = 6, 12


def _around(text: str, at: int, patterns: tuple, left: int, right: int) -> Iterator[tuple[re.Pattern, re.Match]]:
    """Matches of the patterns that hold the place ``at``.

    Patterns are tried on a stretch around the place, widened to blanks; a match that comes near an end of the stretch
    might go on behind it, so the stretch is doubled until none does: it bounds the work, not the length of a match.
    """
    while True:
        a, b = max(0, at - left), min(len(text), at + right)
        # At least so many words on either side, however long they are.
        few = LEAST_LEFT - len(text[a:at].split())
        while a > 0 and (few > 0 or not text[a - 1].isspace()):
            a -= 1
            few -= text[a].isspace()
        few = LEAST_RIGHT - len(text[at:b].split())
        while b < len(text) and (few > 0 or not text[b].isspace()):
            few -= text[b].isspace()
            b += 1
        found = [(p, m) for p in patterns for m in p.finditer(text, a, b) if m.start() <= at < m.end()]
        short_left = a > 0 and any(m.start() < a + 24 for _, m in found)
        short_right = b < len(text) and any(m.end() > b - 40 for _, m in found)
        if not short_left and not short_right:
            yield from found
            return
        left, right = left * (1 + short_left), right * (1 + short_right)


def proposals(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments (start, end, type, features); bounded in length by their forms.

    One pass of a keyword automaton finds the places where a detail may be, and patterns are only matched around them.
    """
    out: dict[tuple[int, int, str], list[str]] = {}
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, kinds in _finder.iter(low):
        for kind, size in kinds:
            hits.setdefault(kind, []).append((end - size + 1, end + 1))
    taken: list[tuple[int, int]] = []
    done = 0
    for a, _ in hits.get("email", ()):
        if a < done:
            continue
        for _, m in _around(text, a, (_EMAIL,), 90, 130):
            if m.start() < done:
                continue
            taken.append(m.span())
            done = m.end()
            out[*m.span(), "email"] = ["e", f"e:plain={'@' in m[0]}", f"e:spaces={' ' in m[0]}", f"e:brackets={'[' in m[0] or '(' in m[0]}", f"e:l1={_words_left(text, m.start())[0]}", f"e:slash={text[max(0, m.start() - 2):m.start()] == '//'}", f"e:next={text[m.end():m.end() + 1] == ':'}"]

    def inside(at: int) -> bool:
        return any(x <= at < y for x, y in taken)

    def address(a: int, b: int, form: str) -> None:
        """An address, and what is left of it where its end may belong to what follows."""
        ends = {b}
        if text[b - 1] == ".":
            ends.add(b - 1)
        if m := _SECOND_TOWN.search(text, a, b):
            ends.add(m.start())
        if (at := text.rfind("\n", a, b)) > a:
            ends.add(a + len(text[a:at].rstrip()))
        for end in ends:
            last = _TOKEN.findall(text[max(a, end - 30) : end])[-1]
            more = _word_right(text, end)
            out[a, end, "address"] = _address_features(text, a, end, form) + [f"a:cut={end != b}", f"a:ends={len(ends)}:cut={end != b}:line={chr(10) in text[a:end]}", f"a:last={_rarity(last)}:cut={end != b}", f"a:cut={end != b}:more={_rarity(more)}:{_edge(text, end, False)}"]

    def name(a: int, b: int, form: str) -> None:
        if (a, b, "name") not in out:
            out[a, b, "name"] = _name_features(text, a, b, form)

    # Names in lower case have no shape: a listed given name, or a word around which names stand, proposes them.
    for a, b in hits.get("given", ()):
        if not text[a].islower() or (a and (low[a - 1].isalnum() or low[a - 1] in "@._+-")) or (b < len(low) and (low[b].isalnum() or low[b] in "@_+")) or inside(a):
            continue
        if text[b : b + 1] == "-" and (m := _HYPHENED.match(text, b)):
            b = m.end()
        if (m := _AFTER.match(text, b)) and m[2].lower() not in COMMON:
            name(a, m.end(), "g+" + ("i" if "." in m[1] else "p" if m[1] else ""))
        if (m := _AFTER2.match(text, b)) and not {m[1].lower(), m[2].lower()} & COMMON:
            name(a, m.end(), "g+2")
        before = text[max(0, a - 64) : a]
        if before.endswith(", ") and (m := _BEFORE_COMMA.search(before)):
            name(a - len(before) + m.start(1), b, "w,g")
        elif before.endswith(" ") and (m := _BEFORE.search(before)) and m[1].lower() not in COMMON:
            name(a - len(before) + m.start(1), b, "wg")
    for a, b in hits.get("cue", ()):
        if (not a or not low[a - 1].isalnum()) and (m := _PAIR.match(text, b)) and m.start(1) > b and text[m.start(1)].islower() and not inside(m.start(1)) and not COMMON & set(m[1].replace(",", "").split()):
            name(m.start(1), m.end(1), "c," if "," in m[1] else "c")
    for a, b in hits.get("after", ()):
        before = text[max(0, a - 64) : a]
        if (b >= len(low) or not low[b].isalnum()) and (m := _PAIR_BEFORE.search(before)) and m[1].islower() and not COMMON & set(m[1].replace(",", "").split()):
            name(a - len(before) + m.start(1), a, "s," if "," in m[1] else "s")
    for m in _INITIAL.finditer(text):
        if n := _FROM_INITIAL.match(text, m.start()):
            name(n.start(), n.end(), "iw" + ("-" if "-" in n[1] else ""))
            if more := _ONE_MORE.match(text, n.end()):
                name(n.start(), more.end(), "iww")
        before = text[max(0, m.start() - 64) : m.start()]
        if before.endswith(", ") and (n := _BEFORE_COMMA.search(before)):
            for start in {n.start(1), n.start(2)}:
                name(m.start() - len(before) + start, m.end(), "w,i")
    if not text.isascii():
        for m in _HANGUL_NAME.finditer(text):
            a, b = m.span()
            if (a, b, "name") not in out:
                form = ("k1" if b - a == 2 else "k ") if b - a != 3 else "k"
                out[a, b, "name"] = _hangul_features(text, a, b, form, m[1] + m[2])
        for m in _KO_NUMBER.finditer(text):
            for _, n in _around(text, m.start() - 1, (_KO,), 30, 30):
                address(*n.span(), "ko")
    for m in _CAPITALISED.finditer(text):
        words = [n.span() for n in _CAPITAL.finditer(text, *m.span())]
        for i, (a, _) in enumerate(words):
            if inside(a):
                continue
            commas = 0
            for j in range(i + 1, min(i + MOST_WORDS, len(words))):
                end = words[j][1]
                between = text[words[j - 1][1] : words[j][0]]
                commas += between == ", "
                if commas > 1:
                    break
                before = _PARTICLES_BEFORE.search(text, max(0, a - 16), a)
                for start in {a, before.start() if before else a}:
                    name(start, end, f"u{j - i + 1}" + ("," if commas else "i" if "." in between else "p" if between != " " else "") + ("P" if start != a else ""))
                    if commas and (n := _MIDDLE.match(text, end)):
                        name(start, n.end(), f"u{j - i + 1},i")
    for m in _RUN.finditer(text):
        if inside(m.start()):
            continue
        a, b = m.start(), m.start() + len(m[0].rstrip(" .-/("))
        out[a, b, "phone"] = _number_features(text, a, b, "p")
        out[a, b, "id_number"] = _number_features(text, a, b, "i")
    for m in _CODE.finditer(text):
        out[*m.span(), "id_number"] = _number_features(text, *m.span(), "i")
    for form, patterns in _STREETS:
        for a, b in hits.get(form, ()):
            if form in ("us", "de") and b < len(low) and low[b].isalpha() and low[b - 1] != " ":
                continue
            for pattern, m in _around(text, a, patterns, 50, 120):
                address(*m.span(), "no" if pattern is _STREET_NO else form)
    return [(a, b, t, f) for (a, b, t), f in sorted(out.items(), key=lambda x: x[0])]


_STREETS = [("us", (_US, _STREET_NO)), ("de", (_DE,)), ("nl", (_NL,)), ("ib", (_IBERIAN,)), ("fr", (_FR,))]
_HYPHENED = re.compile(rf"-{_W}")
_SECOND_TOWN = re.compile(r"(?<=[\wà-ÿ]) [A-ZÀ-Ý][\wà-ÿ'’-]+$")
_ONE_MORE = re.compile(rf" {_CAP}(?![\w@])")
_PARTICLES_BEFORE = re.compile(rf"(?<!\w){_PART}{{1,2}}$")
#: Capitalised words that one name may have.
MOST_WORDS = 5
_KO_NUMBER = re.compile(r"(?<=[로길]) ?\d")
_KNOWN = {*GIVEN, *NICKNAMES, *(s for v in NICKNAMES.values() for s in v.split())}
_BUSINESS = {w for w in BUSINESS if len(w) > 3}
#: Segments further apart than this do not influence each other.
NEAR = 3


def chains(cands: list[tuple[int, int, str, list[str]]]) -> Iterator[list[tuple[int, int, str, list[str]]]]:
    """Candidates cut into independent runs."""
    run: list[tuple[int, int, str, list[str]]] = []
    end = -1
    for c in cands:
        if run and c[0] > end + NEAR:
            yield run
            run = []
        run.append(c)
        end = max(end, c[1]) if len(run) > 1 else c[1]
    if run:
        yield run


def best_segments(run: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Viterbi over the boundaries of one run: segments and outside stretches; transitions between near segments."""
    marks = sorted({x for a, b, *_ in run for x in (a, b)})
    place = {x: i for i, x in enumerate(marks)}
    states: list[dict[str, tuple[float, tuple]]] = [{} for _ in marks]
    states[0]["O"] = (0.0, ())
    starts: dict[int, list] = {}
    for a, b, t, f in run:
        starts.setdefault(place[a], []).append((place[b], t, sum(weights.get(x, 0.0) for x in f), (a, b, t)))
    for i, here in enumerate(states):
        if i + 1 < len(states):
            for last, (score, path) in here.items():
                to = states[i + 1]
                if score > to.get(last, (-math.inf,))[0]:
                    to[last] = (score, path)
        for j, t, s, segment in starts.get(i, ()):
            for last, (score, path) in here.items():
                total = score + s + weights.get(f"{last}>{t}", 0.0)
                if total > states[j].get(t, (-math.inf,))[0]:
                    states[j][t] = (total, (path, segment))
    _, path = max(states[-1].values(), key=lambda x: x[0])
    out = []
    while path:
        path, segment = path
        out.append(segment)
    return out[::-1]


@lru_cache(maxsize=1)
def trained() -> dict[str, float]:
    return json.loads(resources.files("memloom.llm").joinpath("personal_weights.json").read_text())


def details(text: str | None, weights: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every personal detail, in order."""
    if not text:
        return []
    weights = trained() if weights is None else weights
    if not _words:
        use_words(common_words())
    return [s for run in chains(proposals(text)) for s in best_segments(run, weights)]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(df: DataFrame, id_col: str, text_col: str, field: str, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(field, record_id, pii_type, start_char, end_char), one row for each detail."""
    rows = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).cast("string").alias("body")).filter(
        F.col("record_id").isNotNull() & (F.length("body") > 0)
    )

    words = df.sparkSession.sparkContext.broadcast(common_words(vocabularies))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_words(words.value)
        for batch in batches:
            got = [(field, i, t, a, b) for i, body in zip(batch["record_id"], batch["body"], strict=True) for a, b, t in details(body)]
            yield pd.DataFrame(got, columns=["field", "record_id", "pii_type", "start_char", "end_char"])

    kind = "field string, record_id long, pii_type string, start_char int, end_char int"
    # Redelivered rows give the same details, which are far smaller than the texts, so they are dropped afterwards.
    return rows.mapInPandas(run, kind).dropDuplicates(["record_id", "pii_type", "start_char"])


def mask(df: DataFrame, id_col: str, text_col: str, field: str, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(field, record_id, text, details): every text with its details replaced, one row for each id."""
    rows = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).cast("string").alias("body")).filter(F.col("record_id").isNotNull())

    words = df.sparkSession.sparkContext.broadcast(common_words(vocabularies))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_words(words.value)
        for batch in batches:
            found = [details(body) if isinstance(body, str) else [] for body in batch["body"]]
            text = [redacted(body, f) if isinstance(body, str) else None for body, f in zip(batch["body"], found, strict=True)]
            yield pd.DataFrame({"field": field, "record_id": batch["record_id"], "text": text, "details": [len(f) for f in found]})

    return once_by_key(rows, "record_id").mapInPandas(run, "field string, record_id long, text string, details int")
