"""A second generator of labelled sentences, independent of the one that ``personal`` is trained with.

Its sentences, given names, family names, streets and towns occur neither in ``personal_training`` nor in the lists of
``personal`` and ``names`` (``test_held_out_is_apart`` checks that).  SENTENCES with GIVEN and FAMILY were looked at while
the training was set up; the FRESH ones were written afterwards and only measured.
"""

import random

GIVEN = (
    "Priya Kwame Chiara Hiroshi Aisha Bogdan Siobhan Thandiwe Eirik Ludmila Yannick Solveig Ignacio Perpetua Cosimo Wiebke Detlef Saoirse Tendai Oluwaseun Ximena Leocadia Casimir Vesna Zdenka Radoslav Isolde Hartmut Gudrun Maarten Sjoerd Femke Liesbeth Geertje Apolline Ghislain Maelle Loic "
    "Perrine Aurelien Iker Itziar Nahia Gonzalo Xoan Branca Lidia Afonso Tomé Delfina Rogerio Kwesi Adaeze Babatunde Nneka Zanele Sipho Farhad Shirin Kaveh Nasrin Suresh Lakshmi Vikram Gayatri Takeshi Haruka Sakura Daichi Bao Thuy Quoc Anong Somchai Arnel Rosalinda Ingvild Torbjorn Ragnhild Jarmo Outi"
).split()
FAMILY = (
    "Raghunathan Mensah Tanaka Okafor Stoica Gallagher Ndlovu Haugen Sokolova Lemaire Bergström Etxeberria Villanueva Montalto Paulsen Dreyer Fitzpatrick Moyo Adeyemi Cifuentes Brandao Wojcik Kovacevic Blazek Petrov Lindqvist Achterberg Zijlstra Postma Veenstra Terpstra Rousselot Delacroix Bonnard Guichard "
    "Arrieta Goikoetxea Carballo Seixas Queiroz Valadares Boateng Obi Eze Mahlangu Khumalo Tehrani Farrokhzad Venkatesan Subramanian Chaudhary Kobayashi Matsumoto Yamaguchi Pham Ngo Srisai Bautista Dimaculangan Rasmussen Eikeland Solberg Lehtonen Rautio O'Sullivan McAllister"
).split()
KOREAN = [f + g for f in "김이박최정조윤임한송" for g in ("철수", "영희", "동건", "미란", "상우", "혜진", "기태", "보람", "슬기", "한별")]
STREET = "Maplewood Rosehill Larch Quarry Beacon Abbey Priory Sycamore Magnolia Lavender".split()
TOWN = "Portland Norwich Rouen Gijón Aveiro Haarlem Kassel Tampere Salem Dundee".split()
SENTENCES = """
{name} and {name} had breakfast at eight.|{name} is going to open the workshop.|My interview was with {name} in Hall B.|The finalist, {name}, could not come.|I phoned {name} about the leaking tap.|Invitations went out to {name}, {name} and {name}.|Nobody has seen {name} since Sunday.|{name} objected to the second clause.|Sincerely yours,\n{name}|Hello {name}, your bike is ready.|Editor: {name}|Witness: {name}
We asked whether {name} had locked up.|{name}'s bicycle was stolen.|A letter for {name} lay on the mat.|This desk belongs to {name}.|Please welcome {name}!|It seems that {name} forgot the keys.|Mr {name} will see you now.|Dr. {name} operates on Fridays.|The prize goes to {name} for her essay.|Both {name} and her brother are late.|Yours truly, {name}|photo by {name}|Under {name} the choir grew.
Reach me on {phone}.|My landline is {phone}.|Hotline: {phone}|{phone} (evenings only)|Questions? {email}|Kindly reply to {email} by Friday.|{email} bounced again.|Applicant's tax number: {id}|Passport {id} expires soon.|SSN: {id}|The identity card reads {id}.|Parcels for {address} come at noon.|My parents still live at {address}.|Registered office: {address}|Turn left and you are at {address}.|Please forward my mail to {address}.
Gestern traf {name} ein.|Der Vertrag wurde von {name} unterschrieben.|Frau {name} leitet die Schule.|Rückfragen an {name}, Tel. {phone}.|Unsere Ärztin {name} ist verreist.|Meine Anschrift lautet {address}.|Die Reisepassnummer ist {id}.|Le contrat est signé par {name}.|Madame {name} dirige l'école.|Mon adresse est {address}.|Appelez le {phone} le matin.|Notre médecin {name} est en voyage.|El contrato lo firmó {name}.
Mi dirección es {address}.|La doctora {name} está de viaje.|Llame al {phone} por la mañana.|O contrato foi assinado por {name}.|Minha morada é {address}.|A médica {name} está viajando.|Het contract is getekend door {name}.|Mijn adres is {address}.|Onze huisarts {name} is op reis.|{ko}가 문을 열었다.|어제 {ko}을 만났다.|{ko} 대리가 왔다.|책임자는 {ko}입니다.|{ko} 교수님이 강연한다.|연락은 {phone} 번으로 주세요.|제 주소는 {address}입니다.
""".strip().replace("\n{", "\0{").replace("\n", "|").replace("\0", "\n").split("|")
NOTHING = """
The Weekly Digest arrives on Thursdays.|Central Station was renovated in 2019.|Buy two Red Onions and a Green Pepper.|Invoice 2024-118-77 covers March and April.|Flight 1180 left from Gate 22 at 14:05:33.|Microsoft Office and Adobe Reader need an update.|The Grand Hotel has 212 rooms.|Error 404 in module Core Parser|Der Große Saal bleibt bis Montag geschlossen.|Die Neue Zeitung erscheint morgen.|La Casa Blanca está cerrada.|Le Petit Journal paraît demain.|Het Oude Huis staat leeg.
Please see Section Four of the Annual Report.|Version 3.14.15 fixes the Login Screen.|Table 7 lists 120 450 300 entries.|Room 12-34-56 is the code for the locker|Kanban Board and Sprint Goal|Lake Superior and Niagara Falls are cold.|Deutsche Bahn fährt wieder.|Order no. 88121-4471 was cancelled.|The ratio fell from 0.55512345 to 0.3.|Every Good Boy Deserves Fudge|The Great Gatsby is a novel.|이번 달 보고서를 정리했습니다.|하지만 서버가 느려졌다.|고객 문의는 오전에 받습니다.|전체 회의는 오후에 있다.|정원에 꽃이 피었다.
git commit --amend in Main Branch|pip install pkg@2.0.1|See @property and @override|8/12/2024 and 2024-12-08|Batch 553-112-9|Item 4432 of 9981|North Wind, South Wind|Quarterly Sales Figures, Second Draft|Tuesday Evening, Upper Deck|Thank you, Good Night|New Zealand and South Korea signed.|Use Case Diagram (Draft)|Black Coffee, White Sugar
""".strip().replace("\n", "|").split("|")


FRESH_GIVEN = "Mireille Evangelos Stavroula Dagmar Roswitha Lothar Annelore Jurgita Vytautas Agnes Bartolomeo Ottavia Fiorella Eustache Clothilde Anselmo Encarnacion Fermin Amaro Quiteria Hendrikje Klaasje Wolter Obinna Folasade Thabo Lerato Javad Mehrnaz Rajesh Padma Noboru Chihiro Trung Malee".split()
FRESH_FAMILY = "Papadimitriou Anagnostou Vanderbilt Kazlauskas Petrauskas Abruzzo Ferrarese Montagnier Lachapelle Echeverria Olazabal Figueiredo Magalhaes Rietveld Oosterhuis Nwosu Adebayo Molefe Dlamini Rostami Ghorbani Krishnamurthy Deshpande Fujimoto Nakagawa Dang Vuong Thaksin Grunewald Hoffmeister".split()
FRESH = """
The keynote was given by {name}.|Have you heard from {name} lately?|{name} moved the deadline again.|I borrowed the drill from {name}.|Questions go to {name} until Friday.|Her lawyer, {name}, replied at once.|Congratulations to {name} on the award!|We lost to {name} in the final.|Hotel booked for {name} and {name}.|Kind regards\n{name}|{name} doubts the numbers.|Approved: {name}|The bill was paid by {name} in cash.|Meeting moved, says {name}.
Leider musste {name} absagen.|Die Rechnung ging an {name}.|Unser Trainer {name} ist zufrieden.|Merci à {name} pour les photos.|Le dossier de {name} est complet.|Hemos hablado con {name} esta mañana.|El coche de {name} está en el taller.|A proposta de {name} foi aceite.|Falei com {name} sobre o seguro.|De fiets van {name} staat buiten.|Vraag het aan {name} of bel {phone}.|{ko} 씨가 자리를 비웠다.|새 담당자는 {ko}입니다.|{ko}에게 열쇠가 있다.
Leave a message at {phone}.|Mail the draft to {email} tonight.|Her ID is {id}.|The van stops at {address}.|Numer telefonu: {phone}|Unter {phone} sind wir immer da.|Wir ziehen in die {address} um.|Nous sommes au {address} depuis mai.
""".strip().replace("\n", "|").replace("\\n", "\n").split("|")


def sample(r: random.Random, fresh: bool = False) -> tuple[str, set[tuple[int, int, str]]]:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    up = lambda: r.choice("ABCDEFGHJKLMNPRSTW")

    given, family, sentences = (FRESH_GIVEN, FRESH_FAMILY, FRESH) if fresh else (GIVEN, FAMILY, SENTENCES)

    def name() -> str:
        g, f = r.choice(given), r.choice(family)
        return r.choice([f"{g} {f}"] * 6 + [f"{f}, {g}", f"{g[0]}. {f}", f"{g} {up()}. {f}", f"{g} {f}-{r.choice(family)}", f"{g} de {f}", f"{g} {f}".upper()])

    makers = {
        "name": name, "ko": lambda: r.choice(KOREAN),
        "email": lambda: r.choice(["{0}.{1}@{2}.org", "{1}_{0}@{2}.co.uk", "{0}{3}@{2}.example", "{0} dot {1} at {2} dot com", "{0}.{1} [at] {2} [dot] net"]).format(r.choice(GIVEN).lower().replace("é", "e"), r.choice(FAMILY).lower().replace("ö", "o").replace("'", ""), r.choice(["quillmail", "northpost", "uni-arden"]), d(2)),
        "phone": lambda: r.choice([f"+1 503 28{d(1)} {d(4)}", f"(617) 49{d(1)}-{d(4)}", f"+44 7{d(3)} {d(6)}", f"+49 {d(3)} {d(7)}", f"0{r.randint(1, 5)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"010-{d(4)}-{d(4)}", f"06-{d(8)}", f"+351 91{d(1)} {d(3)} {d(3)}"]),
        "id": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{up()}{up()} {d(2)} {d(2)} {d(2)} C", f"{d(8)}{up()}", f"Y{d(7)}{up()}", f"8{d(1)}0{r.randint(1, 9)}1{d(1)}-2{d(6)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"]),
        "address": lambda: r.choice([
            f"{r.randint(2, 990)} {r.choice(STREET)} {r.choice(['Street', 'Road', 'Lane', 'Avenue'])}" + r.choice(["", f", {r.choice(TOWN)}", f", {r.choice(TOWN)} {d(5)}"]), f"{r.choice(['Uhland', 'Goethe', 'Berg'])}{r.choice(['straße', 'weg', 'allee'])} {r.randint(1, 150)}, {d(5)} {r.choice(TOWN)}", f"{r.randint(1, 90)} rue {r.choice(['Voltaire', 'des Tilleuls', 'de la Poste'])}, {d(5)} {r.choice(TOWN)}",
            f"Calle {r.choice(['del Pozo', 'Real', 'Cervantes'])} {r.randint(1, 90)}, {d(5)} {r.choice(TOWN)}", f"Rua {r.choice(['do Carmo', 'Garrett'])}, {r.randint(1, 90)}, {d(4)}-{d(3)} {r.choice(TOWN)}", f"{r.choice(['Linde', 'Hoof'])}{r.choice(['straat', 'laan'])} {r.randint(1, 90)}, {d(4)} {up()}{up()} {r.choice(TOWN)}",
        ]),
    }
    parts: list[tuple[str, str | None]] = []
    for _ in range(r.randint(1, 3)):
        if r.random() < 0.4:
            parts.append((r.choice(NOTHING), None))
        else:
            for chunk in r.choice(sentences).replace("{", "\0{").replace("}", "}\0").split("\0"):
                if chunk.startswith("{"):
                    kind = chunk[1:-1]
                    made = r.choice(["서울특별시 마포구 양화로 45", "대전광역시 서구 둔산대로 117"]) if kind == "address" and parts and "제 주소" in parts[-1][0] else makers[kind]()
                    parts.append((made, {"ko": "name", "id": "id_number"}.get(kind, kind)))
                elif chunk:
                    parts.append((chunk, None))
        parts.append((r.choice([" ", "\n", "\n\n"]), None))
    text, true = "", set()
    for chunk, kind in parts:
        if kind:
            true.add((len(text), len(text) + len(chunk), kind))
        text += chunk
    return text, true
