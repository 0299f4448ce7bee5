"""Training of the weights of ``personal`` on generated, labelled sentences.

    python -m memloom.llm.personal_training

The log-likelihood of the labelled segmentation under the semi-Markov model is climbed by AdaGrad; the sum over all
segmentations of a run is computed by the forward algorithm over the proposed boundaries, its gradient by the backward
one.  Features that name a word or a word's ending are left out at random while training, so that a name in words never
seen is scored by its shape and surroundings.

The sentences, names, streets and towns are made here, independently of any table that the operator is applied to.
``tests/llm/held_out.py`` holds a second generator, with other sentences and with given names outside every list.
"""

from __future__ import annotations

import json
import math
import random
from pathlib import Path

from memloom.llm import personal
from memloom.llm.names import NICKNAMES

#: Given names the model may know (listed) and may not know (none of them listed).
LISTED = sorted(personal.GIVEN - set(NICKNAMES))
UNLISTED = (
    "marek ilona anika paulo denise owen yara agnieszka jakob ondrej vaclav milena dragan goran jelena mirko bojan istvan zoltan eszter gabor ilse gerhard birgit annika sigrid olaf mikkel freja aino eero pekka matthieu aurelie thibault odile gianni "
    "lorenzo paola rui duarte pilar rocio alvaro emeka ngozi kwabena leyla reza parisa arash meera arjun kavita naoko haruto jun xin minh linh thanh siti budi dewi brenda keith sharon gemma callum fergus niamh aoife eilidh gwen rhys"
).split()
FAMILIES = (
    "Dvorak Novak Horvat Petrovic Nagy Szabo Schmidt Becker Krause Jansen Visser Bakker Dubois Moreau Lefevre Rossi Ferreira Almeida Costa Garcia Moreno Navarro Diallo Haddad Rahman Sharma Patel Iyer Gupta Sato Suzuki Nguyen Tran Chen Wang Smith Jones Brown Taylor Walker "
    "Clarke Murphy Kelly O'Brien Larsen Nilsson Virtanen Kowalska Wisniewski Popescu Ionescu Papadakis Yilmaz Demir Hussain Ahmed Khan Silva Santos Pereira Lopez Martinez Gomez Hernandez Fontaine Girard Mercier Vogel Keller Huber Wagner Bauer Maes Peeters Claes Dijkstra Hoekstra "
    "Andersson Johansson Korhonen Nieminen Okonkwo Abebe Mwangi Banerjee Reddy Kapoor Fernandez Ruiz Castro Barbosa Teixeira Marchetti Romano Conti Sorensen Halvorsen McDonald MacLeod Fraser Campbell Hughes Edwards Whitfield Thornton Ashworth Bellamy"
).split()
KOREAN_FIRST = list("민서지현도하수은준예유시주승태영동재성채다윤소나가세연정혜미상경진용철창병기종광명희순보슬한초아새로가람옥복금인선덕춘봉대원")
KOREAN_SECOND = list("준우연서윤현민진희영호수아은지원혁훈빈율성석환철숙자정미경식규태린인나람국배권주훤별기란화남옥순복선심례분임금봄솔빛름롬울이")
KOREAN_PLAIN = list("해한할함하된될되는은을를의에서로게고며면지도만까부터다라자기음것들점때중등후전내외용별당식적화률량체형판표본문류료제출검토리려져졌았었겠습니까요죠네군데든거래싶않없있같많좋크작새옛말글책집길물불산강")
KOREAN_PARTICLES = "은 는 이 가 을 를 의 에게 께 와 과 도 만 한테 씨는 씨가 님이 님께 님은 대리가 과장은 팀장이 이라고 라고 입니다 이다 하고 이랑".split()
#: Adverbs that open sentences, often before a comma.
ADVERBS = "Normalmente Geralmente Recentemente Obviamente Possivelmente Raramente Certamente Actualmente Generalmente Probablemente Claramente Evidemment Finalement Rapidement Rarement Certainement Malheureusement Normally Ultimately Unfortunately Clearly Recently Rarely Normalerweise Erfreulicherweise Möglicherweise Vermutlich Waarschijnlijk Eigenlijk Natuurlijk Uiteindelijk Enfin Ensuite Luego Entonces Depois Então Später Danach Daarna Meanwhile Instead Still".split()
#: Slots of positive sentences that are no details.
WORD_SLOTS = ("low", "Fill", "Proper", "word", "product", "small", "adverb", "kn")
KOREAN_LATIN_FAMILY = "Kim Lee Park Choi Jung Kang Cho Yoon Jang Lim Han Oh Seo Shin Kwon Hwang Ahn Song Ryu Hong".split()
KOREAN_LATIN_GIVEN = "Min Seo Ji Hyun Do Ha Su Eun Jun Ye Yu Si Ju Seung Tae Young Dong Jae Sung Chae Yoon So Na Woo Hee Ho Won Bin Kyung Jin Mi".split()
STREETS = "Oak Elm Cedar Church Station Victoria Mill Queen King Park Green Bridge Harbour Orchard Chestnut Juniper Lincoln Wellington Nelson Albert Windmill Rosemary Hawthorn Cobbler Foundry".split()
TOWNS = "Leeds York Bristol Cardiff Dresden Leipzig Bremen Utrecht Leiden Zwolle Lyon Nantes Rennes Toulouse Sevilla Murcia Bilbao Braga Coimbra Évora Austin Denver Tucson Boise Dayton Albany Basel Graz Linz Gent Namur Córdoba".split()
LATIN = "abcdefghijklmnopqrstuvwxyz"

POSITIVE = """
{name} presented the budget.|Our new colleague {name} starts in June.|Lunch with {name} went on until two.|Minutes taken by {name}|cc: {name}, {name}|Attendees: {name}, {name} and {name}|{name} (on leave) passed it to {name}.|According to {name} the pump leaks.|Speaker: {name}
Thanks, {name}|Regards,\n{name}|Dear {name},|Hi {name}, the boiler is back.|Write to {email} or ring {phone}.|e-mail: {email}|{name} <{email}>|Phone {phone}|mobile {phone} / home {phone}|Fax: {phone}|Please dial {phone} after nine.|WhatsApp {phone}|His social security number is {id}.
National insurance: {id}|ID card {id}|taxpayer {id}, second reminder|passport no. {id}|Deliver it to {address}.|Address: {address}|She lives in {address}.|Office: {address}|We moved from {address} to {address}.|We interviewed {name} and {name}.|It was painted by {name} in spring.|{name}'s proposal won.
The patient {name} came on Monday.|{name} has resigned.|who is {name}?|Prof. {name} lectured on mosses.|Mrs {name} rang twice.|I talked to {name} about the roof.|Could {name} look at the drains?|The winner, {name}, gets a book.|{name} will chair the meeting.|{name} met {name} at noon.|The cake is from {name}.|In the end {name} paid.
Last week {name} broke a cup.|{name} and {name} disagree.|Then {name} left.|We thank {name} for the soup.|- {name}|* {name}: bread, {name}: cheese|"{name}" stood on the envelope.|Reviewed by: {name} ({email})|{name}, {address}|{name}\n{address}\n{phone}|ask for {name}, room 4|{name} was born in Ghent.|My sister {name} sings.|Nobody believed {name}.|tel:{phone}|mailto:{email}|<mailto:{email}?subject=rent>|cc={email}&x=1|Send the keys to {email}, please.
licence of {name}: {id}|{id} is my tax number|{name}, id {id}|The card {id} was found on the stairs.|{name} owes {name} a coffee.|Is {name} still in {address}?|I saw {name} wave.|Only {name} knew.|Why did {name} cancel?|That is {name}.|{name} agreed.|{name} signs for it.|Bring it round to {address} before six.|Her address is {address}, second floor.|The surveyor went to {address} on foot.
Ring {name} at {phone}.|text {name} on {phone}|You get {name} under {phone} only.|Erreichbar ist {name} unter {phone}.|Bitte {name} auf {phone} anrufen.|Joignez {name} au {phone}.|Marque a {name} en el {phone}.|Telefone a {name} pelo {phone}.|Bereik {name} op {phone}.|{ko} 님 휴대폰 {phone} 으로 문자 주세요.|Numéro {id} de {name}|Número {id} de {name}|Nummer {id} von {name}|The number {id} is on the card of {name}.|{id} steht im Ausweis.|Id of {name}: {id}|번호 {id} 입니다.|Herr {name} hat angerufen.|Frau {name} ist krank.|Laut {name} fehlt das Mehl.|{name} kommt etwas später.|Ansprechpartner: {name}|Viele Grüße\n{name}|Anschrift: {address}|Telefon: {phone}|Sie ist in der {address} gemeldet.|Personalausweis {id}|Steuernummer {id}|Mail an {email} genügt.|Das hat {name} entschieden.|Wir haben {name} und {name} eingeladen.|Mit {name} war nichts zu machen.|Der Kuchen ist von {name}.|Am Montag hat {name} gekündigt.|Kennst du {name}?|Unser Nachbar {name} gießt die Blumen.|{name} wohnt in der {address}.|Ruf {name} an: {phone}|Der Brief an {name} kam zurück.
Madame {name} est absente.|Selon {name}, il pleut.|{name} a cassé la tasse.|Bonjour {name}, merci pour la soupe.|Adresse : {address}|Tél. {phone}|Elle habite au {address}.|Carte d'identité {id}|Écrivez à {email}.|Le gâteau vient de {name}.|Hier {name} est partie.|Nous avons vu {name} au marché.|Votre voisine {name} chante.|{name} et {name} sont d'accord.
La señora {name} llamó dos veces.|Según {name}, falta pan.|{name} rompió la taza.|Hola {name}, gracias por la sopa.|Dirección: {address}|Teléfono {phone}|Vive en {address}.|DNI {id}|Escribe a {email}.|El pastel es de {name}.|Ayer {name} se fue.|Vimos a {name} en el mercado.|Mi vecino {name} canta.|{name} y {name} están de acuerdo.
A senhora {name} ligou cedo.|Segundo {name}, falta farinha.|{name} quebrou a xícara.|Olá {name}, obrigado pela sopa.|Endereço: {address}|Telefone {phone}|Mora na {address}.|CPF {id}|Escreva para {email}.|O bolo é de {name}.|Ontem {name} saiu.|Vimos {name} na feira.|{name} e {name} concordam.
Mevrouw {name} belde twee keer.|Volgens {name} regent het.|{name} brak het kopje.|Beste {name}, bedankt voor de soep.|Adres: {address}|Telefoon {phone}|Zij woont aan de {address}.|BSN {id}|Mail naar {email} volstaat.|De taart is van {name}.|Gisteren ging {name} weg.|We zagen {name} op de markt.|{name} en {name} zijn het eens.
{ko}가 회의를 열었다.|{ko}이 전화를 받았다.|{ko} 씨는 내일 옵니다.|{ko} 과장이 서명했다.|{ko} 선생님께 여쭤 보세요.|담당자: {ko}|어제 {ko}와 점심을 먹었다.|{ko}에게 열쇠를 맡겼다.|이번 주 당번은 {ko}입니다.|{ko}, {ko} 두 사람이 참석했다.|작성자 {ko}|{ko}의 제안이 통과됐다.|우리는 {ko}를 만났다.|{ko} 님, 감사합니다.|발표는 {ko} 대리가 한다.|주소: {address}|전화 {phone}|주민등록번호 {id}|메일은 {email} 로 보내 주세요.|그는 {address}에 산다.|{ko}한테 물어봐.|연락처 {phone} ({ko})|{ko}도 같은 생각이다.
{Fill} {name} {low} {low}.|{Fill} {name} {low} {phone}.|{Fill} {low} {name} {low}|{low} {low} {name} {low} {low}.|{low} {name} {low} {low}.|{Fill} {low} {low} {name}.|{low} {low} {name}, {low} {low}|{low} {low} {name}!|{Fill}, {name} {low} {low}.|{adverb}, {name} {low} {low}.|{adverb} {name} {low}.|{small} {Fill} {name} {low} {low}.|{small} {Proper} {name} {low} {low}.|{small} {word} {name} {low}.|{low} {small} {word} {name} {low}.|{small} {word} {name}, {low} {low}|{small} {low} {Fill} {name} {low}.|{Fill}: {name}|{low}: {name}|{Proper}: {name}|{word} {low} {low} {name} {low}.|{name} {low} {low} {low}.|{name} {low} {Fill} {low}.|{name} {low} {product} {low}.|{name}: {low} {low} {low}|{low} {name} {low} {name} {low}.|{name} {low} {phone} {low}|{low} {phone} {low} {low}|{low} {id} {low} {name}.|{low} {low} {email} {low}.|{email} {low} {low}|{email} {low}.|{email}|{phone} {low} {low}|{name}, Tel. {phone}|{name}, phone {phone}|{low} {name}, Tel {phone}|{name}, mobile: {phone}|{name}, ID {id}|{low} {low} {address} {low}.|{Fill} {low} {address}.|{Fill} {address}
{low} van {name}|{low} de {name}|{low} von {name}|{low} di {name}.|{low} da {name} {low}|boek van {name}.|Brief von {name}.|nota de {name}|carta de {name}.|{low} van {name}. {word} {low} {low}.|{low} von {name} {low}.|{low} de {name}, {low} {low}.|{kn} {ko} {kn}|{kn} {ko}, {kn}|{ko}은 {kn} {kn}.|{kn} {ko}가 {kn}.|The register gives {id} as number for {name}.|{id} {low} {low}|number {id} {low} {low}
call {name} tomorrow|tell {name} that the oven is on|thanks, {name}|cc: {name}|signed: {name}|{name} said no|{name} wrote: see below
""".strip().replace("\n", "|").replace("\\n", "\n").split("|")
NEGATIVE = """
{org} raised its prices.|{org} and {org} merged.|The {org} invoice is overdue.|We bank with {org}.|{title} is out.|# {title}|## {title} {n}|See {title}, page {n}.|{title}: {title}|The {title} of {date}|{place} is far.|We flew to {place} via {place}.|In {place} it snowed.|Install {app} first.|{app} crashed on {date}.|{app} and {app} differ.|Open {app}, then {app}.|{product} {n}.{n1} replaces {product}.|{product}, {product} and {product} agree.|Now {product} sleeps.
{given} agreed.|{given} said hello.|ask {given}|The {given} theme is blue.|Project {given} ends on {date}.|Mr {family} rang.|Dr. {family} is in.|Ms. {family}, please sit.|Hotel {word} is full.|Lake {word} froze.|Mount {word} is high.|{word} University opens.|The {word} River rose.|{word} Street is closed.|{word} Avenue theme|The {word} Road exhibition|{month} {n1}, 20{d2}|Monday Morning Meeting|Happy New Year|Good Morning|Best Wishes|Dear Customer,|Dear All,|To Whom It May Concern
{adverb}, {product} {low} {low} {low}.|{adverb}, {word} {low} {low}.|{adverb}, {Proper} {low}.|{adverb} {product} {low} {low}.|{adverb}, {Proper} {low} {Proper}.|{kn} {kn} {kn}.|{kn}, {kn} {kn}|{kn} {kn} {kn} {kn} {kn}.|{kn}|{kn} {word} {kn} {kn}.|{Fill}, {word} {low} {low} {low}.|{Fill}, {product} {low} {low}.|{Fill}, {Proper} {low} {low}.|{Proper}, {Proper} {low} {low}|{small} {low} {low} {product} {small} {Proper} {low}.|{low} {product} {Proper} {low}|{low} {Proper} {Proper} {low}.|{small} {Proper} {small} {low}|{Proper} {small} {low} {low}|{small} {Proper} {product} {low}|{Proper} {product} {low} {low}.|{Fill} {product} {low} {low}|{small} {Fill} {low} {Proper} {word}.|{word} Street {n}|{word} Street {n} {low} {low}.|{Fill} Road {n1}{n1}|the {Fill} Lane {n} {low}|{product} den {Proper} {low}|{low} {product} den {Proper} {low}.|{low} {product} der {Proper}|{product} de {Fill} {low}|{word} la {Fill} {low}|{Proper} der {Proper} {low}|{Fill} de {Fill} {low}|{low} {Fill} do {Fill}|{product} het {Fill}|{low} {product} la {low}|{product} le {Fill}|{thing} no. {num}|{thing} number {num} {low}|{thing} nr. {num}|{thing} #{num}|{n1}/{d2}/20{d2} {low}|{thing} {num}|{thing} {num} is done.|the {thing} {num} of {date}|{thing}: {num}|{num} {low} {low}|{low} {low} {num}.|tell {low} {low} {low}|ask {low} {low}|call {low} {low} again|{low} {low} said {low}|thanks, {low} {low}|cc: {low} {low}|from: {low} {low}|meet {low} {low}|{word} {low} {low} and {low} {low}, {word} {low}.|{Fill}, {Fill} {Fill}|{low} {Fill} {Fill} {low}|The {Fill} {Fill} {low}.|a {Fill} {Fill}|{small} {Fill} {Fill} {low}|{Fill} and {Fill}|{Fill} of the {Fill}|{Fill} {Fill}, {low}|{low}, {Fill} {Fill}.|Order {d4}-{d4}-{d2} shipped.|Invoice {d3}-{d2}-{d4}|Ticket {d4}-{d2}-{d4}|Part {d3} {d2} {d4}|Lot {d6}-{d7}|Build {d3}.{d3}.{d4}|Version {d2}.{d2}.{d4}|Rows {d3}-{d4} moved.|Serial {d9}|Tracking {d9}{d4}|ISBN 978-{d1}-{d3}-{d5}-{d1}|Score {d2}-{d2}-{d2}|Ratio 0.{d6}|pi is 3.14159-{d2}|page {d3}-{d3}|{date} {hour}:{d2}|{date}T{hour}:{d2}:{d2}Z INFO [a.b] id={d5} ms={d4}|from {date} to {date}|on {d2}.{d2}.20{d2}|on {d2}/{d2}/20{d2}|10.{d2}.{d1}.{d2}|192.168.{d1}.{d2}:80{d2}|{d3} {d3} {d3} copies|{d2} {d2} {d2} {d2} {d2} are the bytes|{d1}, {d1}, {d2} and {d3}|budget {d3} {d3} {d3}|{d3},{d3},{d3} rows|1{d3}-{d3}-{d4} is the part code|box {d8}|batch {d4}-{d4}|commit {d7}|sum {d9}{d6}|line {d4} of {n}|the years 19{d2}-20{d2}|#{d6}|{d4} {d4} {d4} {d4} steps|revision {d3}-{d4}|case {d2}-{d4}-{d3}|case {d3}-{d3}-{d4}|range {d4}-{d4}|shelf {d3}.{d3}.{d4}|model {d3}-{d3}-{d4}|{d2}-{d2}-{d2}-{d2}
$ run --n={d3} --out=/tmp/{low}.txt|git clone git@host:{low}/{low}.git|ssh://git@{low}/{low}|npm i {low}@{d1}.{d2}.{d1}|@{low}\ndef {low}(x, y={d2}): return x|use @{low} before @{low}|{low}@{d1}x.png|see @{low} and @{low}|import {low}.{low}|{{"{low}": {d3}, "{low}": "{low}"}}|at {low}/{low}.py:{d3}|def Get{word}(This, That): pass|https://{low}.example/{low}?id={d6}&n={d9}|class {word}{word}({word}):|SELECT {low} FROM {low} WHERE {low} = {d4};|uuid {d8}-{d4}-{d4}|{low} at {low} we stop|meet at {low} dot|x@y|look at {d3} dot {d2}|{low}_{low} = {d4}
{title} ({title})|{caps}|{caps} {caps}|{caps} {caps} {caps}|{Fill} {Fill}|"{title}"|{title} - {title}|{n}. {title}|Chapter {n}: {title}|{small} {word} ist alt.|{small} {word} und {word} sind neu.|{small} {word} {low} gut.|{word}: {low}|{word} {low} {low}.|{word}. {word} {low}.|{word}, {word}, {word}|Then {word} {low}.|{small} {word} {low} {word}.|{word} / {word}|{word} & {word}|- {word} {low}\n- {word} {low}
""".strip().replace("\n", "|").replace("\\n", "\n").split("|")
#: Words of plain sentences, by language: openings, subjects, verbs, objects, ends. Korean is given as whole sentences.
PLAIN = {
    "en": ("Today|Yesterday|In spring|After lunch|Sometimes|Again|At night|Meanwhile|Next week|However,", "the kettle|our bakery|the old tram|a yellow kite|the garden gate|every violin|the librarian|my bicycle|a heavy parcel|the choir", "lost|painted|carried|repaired|forgot|found|sold|borrowed|cleaned|opened", "three spoons|the wooden ladder|a jar of honey|the winter coats|two tickets|the broken lamp|an umbrella|a bag of flour|the blue curtains|the last candle", "without a sound|before the storm|near the harbour|for nothing|by mistake|with great care|in the attic|because it rained|as usual|once more"),
    "de": ("Heute|Gestern|Im Frühling|Nach dem Essen|Manchmal|Trotzdem|Nachts|Inzwischen|Nächste Woche|Leider", "hat der Wasserkessel|hat unsere Bäckerei|hat die alte Straßenbahn|hat ein gelber Drachen|hat das Gartentor|hat jede Geige|hat die Bibliothek|hat mein Fahrrad|hat ein schweres Paket|hat der Chor", "die drei Löffel|die Holzleiter|ein Glas Honig|die Wintermäntel|zwei Fahrkarten|die kaputte Lampe|einen Regenschirm|einen Sack Mehl|die blauen Vorhänge|die letzte Kerze|die Zeitung Nummer|das Ergebnis der Prüfung|den Antrag auf Urlaub", "am Hafen|im Keller|vor dem Sturm|ohne Grund|mit großer Sorgfalt|auf dem Dachboden|wegen des Regens|wie immer|aus Versehen|beim Umzug", "verloren|gestrichen|getragen|repariert|vergessen|gefunden|verkauft|geliehen|geputzt|geöffnet"),
    "fr": ("Aujourd'hui|Hier|Au printemps|Après le repas|Parfois|Encore une fois|La nuit|Entre-temps|Cependant,|Enfin", "la bouilloire|notre boulangerie|le vieux tramway|un cerf-volant jaune|le portail|chaque violon|la bibliothèque|mon vélo|un gros colis|la chorale", "a perdu|a peint|a porté|a réparé|a oublié|a trouvé|a vendu|a emprunté|a nettoyé|a ouvert", "trois cuillères|l'échelle en bois|un pot de miel|les manteaux d'hiver|deux billets|la lampe cassée|un parapluie|un sac de farine|les rideaux bleus|la dernière bougie", "sans bruit|avant l'orage|près du port|pour rien|par erreur|avec grand soin|au grenier|à cause de la pluie|comme toujours|de nouveau"),
    "es": ("Hoy|Ayer|En primavera|Después de comer|A veces|Otra vez|De noche|Mientras tanto|Sin embargo,|Por fin", "la tetera|nuestra panadería|el viejo tranvía|una cometa amarilla|la verja|cada violín|la biblioteca|mi bicicleta|un paquete pesado|el coro", "perdió|pintó|llevó|reparó|olvidó|encontró|vendió|pidió|limpió|abrió", "tres cucharas|la escalera de madera|un tarro de miel|los abrigos de invierno|dos entradas|la lámpara rota|un paraguas|un saco de harina|las cortinas azules|la última vela", "sin ruido|antes de la tormenta|cerca del puerto|por nada|por error|con mucho cuidado|en el desván|por la lluvia|como siempre|una vez más"),
    "pt": ("Hoje|Ontem|Na primavera|Depois do almoço|Às vezes|De novo|À noite|Entretanto|No entanto,|Enfim", "a chaleira|a nossa padaria|o velho elétrico|uma pipa amarela|o portão|cada violino|a biblioteca|a minha bicicleta|um pacote pesado|o coro", "perdeu|pintou|levou|consertou|esqueceu|achou|vendeu|pediu|limpou|abriu", "três colheres|a escada de madeira|um frasco de mel|os casacos de inverno|dois bilhetes|a lâmpada quebrada|um guarda-chuva|um saco de farinha|as cortinas azuis|a última vela", "sem barulho|antes da tempestade|perto do porto|por nada|por engano|com muito cuidado|no sótão|por causa da chuva|como sempre|mais uma vez"),
    "nl": ("Vandaag|Gisteren|In de lente|Na de lunch|Soms|Opnieuw|'s Nachts|Intussen|Volgende week|Helaas", "heeft de ketel|heeft onze bakkerij|heeft de oude tram|heeft een gele vlieger|heeft het tuinhek|heeft elke viool|heeft de bibliotheek|heeft mijn fiets|heeft een zwaar pakket|heeft het koor", "drie lepels|de houten ladder|een pot honing|de winterjassen|twee kaartjes|de kapotte lamp|een paraplu|een zak meel|de blauwe gordijnen|de laatste kaars", "bij de haven|in de kelder|voor de storm|zonder reden|met veel zorg|op zolder|door de regen|zoals altijd|per ongeluk|bij de verhuizing", "verloren|geschilderd|gedragen|gerepareerd|vergeten|gevonden|verkocht|geleend|gepoetst|geopend"),
}
KOREAN = """
이번 주에는 비가 많이 왔다.|하지만 우산을 가져오지 않았다.|전체 목록은 벽에 붙어 있습니다.|고객이 문을 두드렸다.|정리하지 않은 책이 많다.|서류는 서랍에 넣어 두세요.|신청서를 다시 내야 합니다.|안내문을 읽어 보세요.|장소가 바뀌었습니다.|조사가 끝나면 알려 드리겠습니다.|한국어로 써 주세요.|문제가 생기면 멈추세요.|양식을 채워 주세요.|손님이 돌아갔다.|배송이 늦어집니다.|백업은 밤에 돕니다.|남은 빵을 나눠 먹었다.|심사가 길어졌다.|노트를 잃어버렸다.|유지하기 어렵다.|강의를 들었다.|최근에 이사했다.
박물관은 월요일에 쉰다.|김치를 담갔다.|권한이 없습니다.|황사가 심하다.|송금이 끝났다.|홍보가 부족하다.|허용된 크기를 넘었다.|임시로 막아 두었다.|윤곽이 보인다.|류트 소리가 들린다.|오늘은 일찍 닫습니다.|이유를 모르겠다.|정확히 세 개가 남았다.|전화기를 껐다.|고양이가 잔다.|하나만 골라 주세요.|주소를 확인하세요.|이메일을 보냈다.|조용히 해 주세요.|강아지도 왔다.|서울에서 만나자.|안경을 찾았다.|오전에 시작한다.|신호가 약하다.|장갑을 샀다.|한동안 쉬었다.|문서를 고쳤다.|양파와 마늘을 볶는다.|배터리가 없다.|백화점에 갔다.|남쪽으로 갔다.|노래를 불렀다.|유리를 닦았다.|최선을 다했다.|이것은 새 연필이다.|정말로 그렇다.|전에는 달랐다.|고장이 났다.|하루에 한 번 물을 준다.|임대료가 올랐다.|이전에는 없던 일이다.|정보를 찾는다.|조건이 같다.|한편 다른 팀은 쉬었다.|강조할 점이 있다.|신규 회원을 받는다.|권장 크기를 쓴다.|정기 점검이 있다.|고정된 값이다.|이상한 소리가 났다.|하위 목록을 본다.|전송이 실패했다.|서로 다르다.|안정된 상태다.|이어서 설명한다.|조금만 기다려.|장기 계획을 세웠다.|문장을 나눈다.|배경이 어둡다.|노력을 했다.|오류를 고쳤다.|이제는 괜찮다.|전부터 그랬다.|이에게는 없다.|하면서 배운다.|고르지 못했다.|서로를 돕는다.|강하게 민다.|조건에는 없다.|문에서 만났다.|남에게 준다.|배에서 내렸다.|장에는 빵이 있다.|손으로 썼다.|양을 줄였다.|유용한 도구다.|오래된 값을 지운다.|신중하게 본다.|임의로 고른다.|허락을 받았다.|백 개가 넘는다.|주기적으로 돈다.|심각한 오류다.|노란 표시를 누른다.|하위에서 찾는다.|이전하려면 멈춰야 한다.|조정하기로 했다.|전달하겠습니다.|고치려고 한다.|한참을 걸었다.|이렇게 끝났다.|정확하게 맞다.|전혀 모른다.|이미 끝났다.|조금씩 늘었다.|하나씩 지운다.
""".strip().replace("\n", "|").split("|")
SMALL = "Der Die Das Den Dem Des Ein Eine Einen Kein Keine Jeder Diese Mein Unser Ihr Im Am Zum Zur Vom Beim Nach Mit Bei Seit Ohne Dass Wenn Weil Und Ich Wir The This Our Each Every El La Los Las Un Una Le Les Une O A Os As Um Uma De Het Een".split()
PLACES = "New York|San Francisco|Los Angeles|Hong Kong|Buenos Aires|Rio Grande|Cape Town|United States|South Africa|North Sea|Black Forest|Mexico City|Santa Clara|Tel Aviv|Costa Rica|Great Britain|East London|Lake Garda|Mount Etna|Port Louis|Sierra Leone|Las Vegas|Salt Lake City|Bad Homburg|Den Haag|São Paulo".split("|")
APPS = "Visual Studio|Google Cloud|Apache Spark|Spark SQL|Machine Learning|Open Source|Python Notebook|Power Point|Red Hat|Data Frame|Deep Learning|Android Studio|Internet Explorer|Kernel Panic|Git Lab|Pull Request|Unit Test|Query Planner|Access Token|Error Handling|Type Hint|User Story|Release Candidate|Root Cause|Time Zone|Hash Join|Write Ahead Log".split("|")
BUSINESS_KINDS = "GmbH Ltd LLC Inc AG Corp PLC BV".split()
BUSINESS_LINES = "Software Logistics Foods Systems Partners Energy Consulting Services Publishing Bank Trading Engineering Insurance Media Transport".split()


class Maker:
    """Labelled sentences; ``unlisted`` is the share of given names outside every list."""

    def __init__(self, seed: int, unlisted: float = 0.55):
        self.r, self.unlisted = random.Random(seed), unlisted
        personal.use_words(personal.common_words())
        self.common = sorted(w for w in personal._words if w.islower() and w not in personal._KNOWN)
        self.proper = sorted(w for w in personal._words if w[0].isupper() and w[1:].islower() and w.lower() not in personal._words and w.lower() not in personal._KNOWN)
        self.vocabulary = sorted({w.strip(",.'") for parts in PLAIN.values() for p in parts for w in p.replace("|", " ").split() if len(w) > 2})

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def any_word(self) -> str:
        """A word of any make: consonants and vowels in turn."""
        r = self.r
        out = "".join(r.choice("b c d f g h j k l m n p r s t v w z br ch dr gr kr sh st th tr fl qu".split()) + r.choice("a e i o u ae ee ia ou y".split()) for _ in range(r.randint(1, 3)))
        return (out + r.choice("n r s l t k m d nd ck tz ng sh rd lt nn x".split() + [""] * 6)).capitalize()

    def family(self) -> str:
        k = self.r.random()
        if k < 0.4:
            return self.r.choice(FAMILIES)
        stem = self.any_word()
        return stem if k < 0.6 else stem + self.r.choice("son sen berg mann stein er ini etti ez es ov ova ski ska ic escu ian oglu wala nen quist dottir ton ley field ard eau".split())

    def given(self) -> str:
        r = self.r
        if r.random() >= self.unlisted:
            return r.choice(LISTED).capitalize()
        return r.choice(UNLISTED).capitalize() if r.random() < 0.4 else self.any_word()

    def ko(self) -> str:
        r = self.r
        return r.choice("김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허남심노하유") + r.choice(KOREAN_FIRST) + r.choice(KOREAN_SECOND)

    def name(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.05:
            g = r.choice(KOREAN_LATIN_GIVEN) + r.choice(["-", "", " "]) + r.choice(KOREAN_LATIN_GIVEN).lower()
            if " " in g:
                g = g.title()
            return f"{r.choice(KOREAN_LATIN_FAMILY)} {g}" if r.random() < 0.6 else f"{g} {r.choice(KOREAN_LATIN_FAMILY)}"
        if k < 0.09:
            return self.ko()
        g, f = self.given(), self.family()
        k = r.random()
        if k < 0.08:
            f = f"{r.choice(['van', 'de', 'dos', 'von', 'da', 'del', 'van der', 'de la', 'di'])} {f}"
        elif k < 0.16:
            f = f"{f}-{self.family()}"
        elif k < 0.22:
            f = f"{f} {self.family()}"
        if r.random() < 0.08:
            g = f"{g}{r.choice(['-', ' '])}{self.given()}"
        k = r.random()
        if k < 0.16:
            out = f"{f}, {g}" + (f" {r.choice(LATIN).upper()}." if r.random() < 0.15 else "")
        elif k < 0.30:
            out = f"{g[0]}. {f}"
        elif k < 0.35:
            out = f"{f}, {g[0]}."
        elif k < 0.45:
            out = f"{g} {r.choice(LATIN).upper()}. {f}"
        elif k < 0.5 and f[0].isupper():
            out = f"{f} {g}"
        else:
            out = f"{g} {f}"
        k = r.random()
        return out.upper() if k < 0.08 else out.lower() if k < (0.22 if g.lower() in personal.GIVEN else 0.1) and "." not in out else out

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.family().lower().replace("'", "")
        local = r.choice([f"{g}.{f}", f"{f}-{g}", f"{f}{r.randint(10, 99)}", f"{g}_{f}", f"{g[0]}{f}", f"{g}.{f}+news", f"{g}", f"info.{f}"])
        local = local.encode("ascii", "ignore").decode()
        domain = r.choice(["", "mail.", "post.", "office."]) + r.choice([self.any_word().lower(), "acme", "bluehill"]) + r.choice(["", "-online", "net"]) + r.choice([".com", ".org", ".net", ".de", ".fr", ".co.uk", ".io", ".example", ".edu", ".test"])
        k = r.random()
        if k < 0.6:
            out = f"{local}@{domain}"
        elif k < 0.68:
            out = f"{local} @ {domain}"
        elif k < 0.76:
            out = f"{local}{r.choice(['(at)', ' (at) ', '{at}'])}{domain}"
        elif k < 0.88:
            out = f"{local.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}"
        else:
            out = f"{local.replace('.', ' [dot] ')} [at] {domain.replace('.', ' [dot] ')}"
        return out.upper() if r.random() < 0.08 and "@" in out else out

    def phone(self) -> str:
        d, r = self.digits, self.r
        a, b = f"{r.randint(2, 9)}{d(2)}", f"{r.randint(2, 9)}{d(2)}"
        return r.choice([
            f"+1 {a} {b} {d(4)}", f"+1{a}{b}{d(4)}", f"({a}) {b}-{d(4)}", f"{a}-{b}-{d(4)}", f"{a}.{b}.{d(4)}", f"{a} {b}-{d(4)} ext. {d(3)}", f"1-{a}-{b}-{d(4)}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"020 7{d(3)} {d(4)}", f"+44 20 7{d(3)} {d(4)}", f"01{d(3)} {d(6)}",
            f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", f"06.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 1{d(2)} {d(7)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(3)} {d(6)}", f"0{d(3)}/{d(6)}", f"+49/{d(2)}/{d(5)}-{d(3)}", f"0049 {d(2)} {d(5)} {d(3)}",
            f"010-{d(4)}-{d(4)}", f"+82 10-{d(4)}-{d(4)}", f"02-{d(4)}-{d(4)}", f"+34 {r.choice('679')}{d(2)} {d(3)} {d(3)}", f"+31 6 {d(8)}", f"06-{d(8)}", f"020-{d(7)}", f"+55 11 9{d(4)}-{d(4)}", f"(11) 9{d(4)}-{d(4)}", f"+351 9{d(2)} {d(3)} {d(3)}",
        ])

    def id(self) -> str:
        d, r = self.digits, self.r
        up = lambda n: "".join(r.choice(LATIN).upper() for _ in range(n))
        day = f"{d(2)}{r.choice(['0', '1'])}{r.randint(0, 2)}{r.randint(10, 28)}"
        if r.random() < 0.2:
            return self.any_id()
        return r.choice([
            f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{up(2)}{d(6)}{r.choice('ABCD')}", f"{r.choice('XYZ')}{d(7)}{up(1)}", f"{r.choice('XYZ')}-{d(7)}-{up(1)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{day}-{r.randint(1, 4)}{d(6)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
            f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}", f"{d(8)}{up(1)}", f"{d(8)}-{up(1)}", f"{up(1)}{d(8)}", f"{up(2)}{d(7)}",
        ])

    def any_id(self) -> str:
        """A number of a country unknown here; its label is what tells it."""
        out = ""
        while not 8 <= sum(c.isdigit() for c in out) <= 14:
            out = self.any_number()
        return out

    def address(self) -> str:
        d, r = self.digits, self.r
        n, town = r.randint(1, 1999), r.choice(TOWNS)
        us = f"{n}{r.choice(['', '', '', 'A', 'B'])} {r.choice(['', '', 'N. ', 'S ', 'West ', 'East '])}{r.choice(STREETS)} {r.choice('Street St. Lane Road Rd Ave. Avenue Blvd Court Place Terrace Crescent Mews Way Drive Close Hill Square'.split())}"
        us += r.choice(["", "", f" Apt {r.randint(1, 60)}", f", Flat {r.randint(1, 20)}"]) + r.choice(["", f", {town}", f", {town} {d(5)}", f"\n{town} {d(5)}"])
        n = r.randint(1, 199)
        de = f"{r.choice('Garten Bahnhof Schiller Wald Kirch Rosen'.split())}{r.choice('straße weg gasse platz allee ring str.'.split())} {n}{r.choice(['', 'a', ' b'])}" + r.choice(["", f", {d(5)} {town}", f", {d(5)} {town}"])
        nl = f"{r.choice('Kerk Dorps Tulpen Molen School'.split())}{r.choice('straat laan kade weg plein gracht'.split())} {n}" + r.choice(["", f", {d(4)} {r.choice(LATIN).upper()}{r.choice(LATIN).upper()} {town}"])
        es = f"{r.choice(['Calle', 'Avenida', 'Paseo', 'Plaza', 'C/'])} {r.choice(['de la Luna', 'del Mar', 'Mayor', 'San Antonio', 'de los Olivos'])} {n}" + r.choice(["", f", {r.randint(1, 6)}º {r.choice('ABCD')}"]) + r.choice(["", f", {d(5)} {town}"])
        pt = f"{r.choice(['Rua', 'Avenida', 'Travessa', 'Largo'])} {r.choice(['das Flores', 'da Liberdade', 'do Sol', 'Augusta'])}, {n}" + r.choice(["", f", {d(4)}-{d(3)} {town}", f", {d(5)}-{d(3)} {town}"])
        fr = f"{n}{r.choice(['', ' bis'])}{r.choice(['', ','])} {r.choice(['rue', 'avenue', 'impasse', 'chemin', 'boulevard', 'place'])} {r.choice(['de la Gare', 'des Lilas', 'du Moulin', 'Pasteur', 'Victor Hugo'])}" + r.choice(["", f", {d(5)} {town}"])
        ko = f"{r.choice(['서울특별시', '부산광역시', '수원시', '전주시'])} {r.choice(['중구', '강남구', '해운대구', '완산구'])} {r.choice(['세종대로', '봄꽃로', '은행나무길', '한강로'])} {n}"
        return r.choice([us, us, us, de, de, nl, es, pt, fr, ko])

    # Slots that are words: common ones in either case, any ones, Korean ones that open like a name.
    def low(self) -> str:
        return self.common_word() if self.r.random() < 0.85 else self.any_word().lower()

    def Fill(self) -> str:  # noqa: N802
        return self.common_word().capitalize()

    def Proper(self) -> str:  # noqa: N802
        return self.r.choice(self.proper)

    def word(self) -> str:
        k = self.r.random()
        return self.any_word() if k < 0.4 else self.Proper() if k < 0.6 else self.Fill()

    def product(self) -> str:
        return self.any_word() + self.r.choice("base pad board flow kit desk".split()) if self.r.random() < 0.5 else self.common_word().capitalize() + self.common_word()

    def small(self) -> str:
        return self.r.choice(SMALL)

    def adverb(self) -> str:
        return self.r.choice(ADVERBS)

    def kn(self) -> str:
        """A Korean word that is no name, often one that opens with a family name."""
        r = self.r
        if r.random() < 0.25:  # a stem of one syllable with an ending
            return r.choice("이박정강조윤장임한오서신권황안송류전고문양손배백남심노하유") + r.choice(sorted(personal.KOREAN_ENDINGS)) + r.choice(["", "", "는", "도", "만"])
        stem = r.choice("김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허남심노하유") if r.random() < 0.8 else r.choice(KOREAN_PLAIN)
        return stem + "".join(r.choice(KOREAN_PLAIN if r.random() < 0.7 else KOREAN_FIRST) for _ in range(r.choice([1, 2, 2, 2, 3]))) + r.choice(["", "", "", "은", "을", "이", "가", "에", "로", "의", "과", "도"])

    def any_number(self) -> str:
        """Groups of digits of any make."""
        r = self.r
        mark = r.choice("-. /")
        return mark.join(self.digits(r.choice([2, 3, 3, 4, 5])) for _ in range(r.randint(2, 4)))

    def combo(self) -> list[tuple[str, str]]:
        """Two to four details next to each other."""
        r = self.r
        kinds = r.sample(["name", "phone", "email", "address", "id"], r.randint(2, 4))
        mark = r.choice([", ", "; ", " / ", " | ", " - ", "\n", " "])
        out: list[tuple[str, str | None]] = [(r.choice(["", "", "Contact: ", "see ", "From: ", "Kontakt: ", "- "]), None)]
        for kind in kinds:
            out += [(getattr(self, kind)(), {"id": "id_number"}.get(kind, kind)), (mark, None)]
        return out[:-1] + [(r.choice(["", ".", ",", "."]), None)]

    def common_word(self) -> str:
        r = self.r
        return r.choice(self.common) if r.random() < 0.75 else r.choice(self.vocabulary)

    def plain(self) -> str:
        """A sentence without details, sometimes with its words or their case in disorder."""
        r = self.r
        if r.random() < 0.22:
            return " ".join(r.choice(KOREAN) for _ in range(r.randint(1, 2)))
        text = " ".join(r.choice(part.split("|")) for part in PLAIN[r.choice(list(PLAIN))]) + r.choice([".", ".", "!", "?", ":"])
        if r.random() < 0.25:
            words = text.split(" ")
            for _ in range(r.randint(1, 3)):
                i, j = r.randrange(len(words)), r.randrange(len(words))
                words[i], words[j] = words[j], words[i]
                if r.random() < 0.3:
                    words[i] = words[i].capitalize()
            text = " ".join(words)
        return text

    def fields(self) -> dict[str, str]:
        d, r = self.digits, self.r
        title = lambda: " ".join(self.common_word().capitalize() if r.random() < 0.85 else r.choice(self.proper) for _ in range(r.randint(2, 4)))
        org = r.choice([f"{self.family()} & {self.family()}", f"{self.family()} {r.choice(BUSINESS_LINES)}", f"{self.family()} and {self.family()} {r.choice(BUSINESS_LINES)} {r.choice(BUSINESS_KINDS)}", f"{self.family()} {r.choice(BUSINESS_LINES)} {r.choice(BUSINESS_KINDS)}", f"{self.any_word()} {r.choice(BUSINESS_KINDS)}"])
        return {
            "org": org, "family": self.family(), "given": self.given(), "n": str(r.randint(1, 2000)), "n1": str(r.randint(0, 9)), "date": f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", "hour": str(r.randint(10, 23)), "month": r.choice("March April June October December".split()),
            "title": title(), **{k: getattr(self, k)() for k in ("word", "low", "Fill", "Proper", "product", "small", "adverb", "kn")}, "place": r.choice(PLACES), "app": r.choice(APPS), "caps": self.common_word().upper(), "num": self.any_number(), "thing": r.choice(sorted(personal.THING_CUES)).capitalize() if r.random() < 0.5 else r.choice(sorted(personal.THING_CUES)), **{f"d{k}": d(k) for k in range(1, 10)},
        }

    def sample(self) -> tuple[str, set[tuple[int, int, str]]]:
        """A text of one to three lines and its true segments."""
        parts: list[tuple[str, str | None]] = []
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.random()
            spoken = ""
            if kind < 0.42:
                for chunk in self.r.choice(POSITIVE).replace("{", "\0{").replace("}", "}\0").split("\0"):
                    if chunk.startswith("{"):
                        key = chunk[1:-1]
                        parts.append((getattr(self, key)(), {"id": "id_number", "ko": "name", **dict.fromkeys(WORD_SLOTS)}.get(key, key)))
                        spoken = key
                    elif chunk:
                        # A Korean name before a blank often carries a particle.
                        ending = self.r.choice(KOREAN_PARTICLES) if spoken == "ko" and chunk[0] in " ." and self.r.random() < 0.6 else ""
                        parts.append((ending + chunk, None))
                        spoken = ""
            elif kind < 0.55:
                parts += self.combo()
            elif kind < 0.8:
                template = self.r.choice(NEGATIVE)
                while "{" in template.replace("{{", ""):
                    # Each slot anew, so that two of one kind differ.
                    fields = self.fields()
                    at = template.replace("{{", "\0\0").index("{")
                    end = template.index("}", at)
                    template = template[:at] + fields[template[at + 1 : end]] + template[end + 1 :]
                parts.append((template.replace("{{", "{").replace("}}", "}"), None))
            else:
                parts.append((self.plain(), None))
            parts.append((self.r.choice([" ", " ", "\n", "\n\nUser: ", "\n- "]), None))
        text, true = "", set()
        for chunk, kind in parts:
            if kind:
                true.add((len(text), len(text) + len(chunk), kind))
            text += chunk
        return text, true


#: Features that name a word or part of one; each is left out of a training example with the chance LEFT_OUT.
LEXICAL = ("n:r1=", "n:l1=", "n:w=", "n:given", "n:family", "k:given=", "k:l1=", "k:r1=", "p:l1=", "p:l2=", "i:l1=", "i:l2=", "p:r1=", "i:r1=", "a:r1=", "a:form=us:l1=", "e:l1=")
LEFT_OUT = 0.5
LEAST_SEEN = 12
#: What a name is given in advance, since one that stays in the text costs more than a word masked in vain.
MISSED_COSTS = 1.5


def gradient(run: list, true: set[tuple[int, int, str]], w: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Log-likelihood of the true segmentation of a run and its gradient."""
    marks = sorted({x for a, b, *_ in run for x in (a, b)})
    place = {x: i for i, x in enumerate(marks)}
    arcs = [(place[a], place[b], t, f, (a, b, t) in true, sum(w.get(x, 0.0) for x in f)) for a, b, t, f in run]
    by_start: dict[int, list] = {}
    for arc in arcs:
        by_start.setdefault(arc[0], []).append(arc)
    labels = ["O", *sorted({t for _, _, t, *_ in arcs})]
    n = len(marks)
    add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    fwd = [dict.fromkeys(labels, -math.inf) for _ in range(n)]
    fwd[0]["O"] = 0.0
    for i in range(n):
        for last, s in fwd[i].items():
            if s == -math.inf:
                continue
            if i + 1 < n:
                fwd[i + 1][last] = add(fwd[i + 1][last], s)
            for _, j, t, _, _, score in by_start.get(i, ()):
                fwd[j][t] = add(fwd[j][t], s + score + w.get(f"{last}>{t}", 0.0))
    back = [dict.fromkeys(labels, -math.inf) for _ in range(n)]
    back[-1] = dict.fromkeys(labels, 0.0)
    for i in range(n - 2, -1, -1):
        for last in labels:
            s = back[i + 1][last]
            for _, j, t, _, _, score in by_start.get(i, ()):
                s = add(s, score + w.get(f"{last}>{t}", 0.0) + back[j][t])
            back[i][last] = s
    total = back[0]["O"]
    grad: dict[str, float] = {}
    for i, j, t, f, _, score in arcs:
        for last, s in fwd[i].items():
            if s > -math.inf:
                p = math.exp(min(0.0, s + score + w.get(f"{last}>{t}", 0.0) + back[j][t] - total))
                if p > 1e-9:
                    for x in [*f, f"{last}>{t}"]:
                        grad[x] = grad.get(x, 0.0) - p
    gold, last = 0.0, "O"
    for _, _, t, f, is_true, score in sorted(arcs, key=lambda x: x[0]):
        if is_true:
            gold += score + w.get(f"{last}>{t}", 0.0)
            for x in [*f, f"{last}>{t}"]:
                grad[x] = grad.get(x, 0.0) + 1.0
            last = t
    return gold - total, grad


def train(samples: int = 120_000, rounds: int = 3, seed: int = 5, rate: float = 0.3, decay: float = 3e-4) -> dict[str, float]:
    maker = Maker(seed)
    data = []
    for _ in range(samples):
        text, true = maker.sample()
        data += [(run, true) for run in personal.chains(personal.proposals(text))]
    # Words and endings met in a few examples only tell nothing about others.
    count: dict[str, int] = {}
    for run, _ in data:
        for *_, f in run:
            for x in f:
                count[x] = count.get(x, 0) + 1
    data = [([(a, b, t, [x for x in f if count[x] >= LEAST_SEEN]) for a, b, t, f in run], true) for run, true in data]
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(rounds):
        maker.r.shuffle(data)
        for run, true in data:
            some = [(a, b, t, [x for x in f if not (x.startswith(LEXICAL) and maker.r.random() < LEFT_OUT)]) for a, b, t, f in run]
            _, grad = gradient(some, true, w)
            for x, g in grad.items():
                g -= decay * w.get(x, 0.0)
                seen[x] = seen.get(x, 0.0) + g * g
                w[x] = w.get(x, 0.0) + rate * g / math.sqrt(seen[x] + 1e-6)
    for x in ("n", "k"):
        w[x] = w.get(x, 0.0) + MISSED_COSTS
    return {x: round(v, 3) for x, v in sorted(w.items()) if abs(v) >= 0.2}


def main() -> None:
    weights = train()
    Path(__file__).with_name("personal_weights.json").write_text(json.dumps(weights, ensure_ascii=False, indent=0) + "\n")
    print(f"{len(weights)} weights")


if __name__ == "__main__":
    main()
