"""Invented sentences with labelled personal data of many shapes, and sentences that only look like it, to train pii.py on.

A sentence is a template with slots; slots are filled by generators of open vocabulary: names are made
of random syllables, of a few common ones or in other scripts, numbers are random digits in national
forms. Every HELD-th template is left out of training and only used to measure.
"""

import random
import string

from engram.llm.pii import KINDS

HELD = 5

GIVEN = "John Mary Barack Angela Emmanuel Tim Anna Peter Maria José Luis Carmen Sophie Pierre Jean Marie Hans Jürgen Klaus Ingrid Giulia Marco Ahmed Fatima Wei Mei Raj Priya Olga Ivan Yuki Kenji Minsu Jiwoo Sean Siobhán Lars Astrid Paulo Ana Zoë Chloé Noah Emma Liam Olivia David Sarah Michael Linda James Patricia Łukasz Agnieszka Björn Åsa".split()
FAMILY = "Smith Jones Obama Merkel Macron Cook Patel Müller Schmidt Schneider Fischer Weber García Martínez López Sánchez Dubois Moreau Laurent Lefèvre Rossi Bianchi Kowalski Nowak Żak Ivanov Petrov Kim Lee Park Choi Tanaka Suzuki Chen Wang Zhang Nguyen Singh Kumar Khan Hassan Silva Santos Costa Jansen Visser Nielsen Hansen Johansson Virtanen Horváth Yılmaz Cohen Levy Brown Taylor Wilson Evans Walker Wright".split()
TITLES = ("Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "Mr", "Dr", "Herr", "Frau", "Sr.", "Sra.", "Don", "Doña", "Mme", "M.", "Sir", "Dr. med.", "Prof. Dr.", "Judge", "Captain", "Rev.")
PARTICLES = ("van", "van der", "von", "de", "de la", "del", "di", "da", "dos", "bin", "al", "ter", "le")
KO_FAMILY, KO_GIVEN = "김이박최정강조윤장임한오서신권황안송류홍", "민서지우현준수영진호은하윤도연재희성경아혜정태나라"
CYR_GIVEN, CYR_FAMILY = "Иван Ольга Сергей Наталья Дмитрий Анна Алексей Мария".split(), "Иванов Петрова Смирнов Кузнецова Попов Соколова Лебедев Новикова".split()
GR = "Γιώργος Παπαδόπουλος|Μαρία Νικολάου|Νίκος Γεωργίου|Ελένη Δημητρίου".split("|")
CJK = "山田太郎|佐藤花子|王小明|李娜|张伟|鈴木一郎|田中美咲|陈静".split("|")
WORDS = "report index draft ticket cluster release gateway parser summary outline archive window review meeting window plan update backup snapshot schedule invoice sample station valley harbor garden kernel planet copper winter signal marble".split()
LATIN = "bcdfghjklmnprstvwz"
CITIES = "London Paris Berlin Madrid Boston Chicago Houston Leeds Bristol Lyon Nantes Hamburg Köln München Sevilla Valencia Roma Torino Utrecht Wien Zürich Kraków Porto Dublin Oslo Springfield Riverside Portland Auckland".split()


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def shaped(rng: random.Random, shape: str) -> str:
    """9 a digit, A a capital, a a small letter; the rest stands."""
    return "".join(rng.choice("0123456789") if c == "9" else rng.choice(string.ascii_uppercase) if c == "A" else rng.choice(string.ascii_lowercase) if c == "a" else c for c in shape)


def syllables(rng: random.Random) -> str:
    ends = ("", "", "son", "er", "i", "ov", "sen", "ez", "ard", "mann", "ley", "o", "ko", "a", "ini", "ski", "wick", "stad", "ette", "quist", "shaw", "ton", "field", "berg")
    vowels = ("a", "e", "i", "o", "u", "ar", "en", "il", "or", "ai", "ee", "ö", "é", "ü", "an", "on")
    return ("".join(rng.choice(LATIN) + rng.choice(vowels) for _ in range(rng.randint(1, 3))) + rng.choice(ends)).capitalize()


def given(rng: random.Random) -> str:
    return rng.choice(GIVEN) if rng.random() < 0.5 else syllables(rng)


def family(rng: random.Random) -> str:
    f = rng.choice(FAMILY) if rng.random() < 0.4 else syllables(rng)
    r = rng.random()
    if r < 0.05:
        return rng.choice(("O'", "O’", "Mc", "Mac", "D'", "Fitz")) + f
    if r < 0.12:
        return f"{f}-{syllables(rng)}"
    if r < 0.2:
        return f"{rng.choice(PARTICLES)} {f}"
    return f


def name(rng: random.Random) -> str:
    r = rng.random()
    initial = lambda: rng.choice(string.ascii_uppercase + "ÅÉŁÖŽ") + "."
    if r < 0.42:
        return f"{given(rng)} {family(rng)}"
    if r < 0.5:
        return f"{rng.choice(TITLES)} {family(rng)}"
    if r < 0.57:
        return f"{rng.choice(TITLES)} {given(rng)} {family(rng)}"
    if r < 0.63:
        return f"{given(rng)} {initial()} {family(rng)}"
    if r < 0.68:
        return f"{initial()} {family(rng)}" if rng.random() < 0.7 else f"{initial()} {initial()} {family(rng)}"
    if r < 0.72:
        return f"{family(rng).upper()}, {given(rng)}"
    if r < 0.75:
        return f"{family(rng)}, {given(rng)}"
    if r < 0.79:
        return f"{given(rng)} {given(rng)} {family(rng)}"
    if r < 0.82:
        return f"{given(rng)} {family(rng)} {family(rng)}"
    if r < 0.85:
        return f"{given(rng)} {family(rng)}".upper()
    if r < 0.88:
        return f"{given(rng)}\n{family(rng)}" if rng.random() < 0.3 else f"{given(rng)} {family(rng)} {rng.choice(('Jr.', 'Sr.', 'III', 'PhD'))}"
    if r < 0.93:
        return rng.choice(KO_FAMILY) + "".join(rng.choice(KO_GIVEN) for _ in range(2))
    if r < 0.97:
        return f"{rng.choice(CYR_GIVEN)} {rng.choice(CYR_FAMILY)}"
    return rng.choice(GR) if rng.random() < 0.5 else rng.choice(CJK)


PHONES = ("+9 999 999 9999", "+99 99 9999 9999", "+99 999 9999999", "+99 9 99 99 99 99", "+999 99 999 9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "+1 (999) 999-9999", "0099 99 99999 999", "09 99 99 99 99", "09.99.99.99.99", "0999 999999", "099/9999999", "099 99999-99", "010-9999-9999", "02-999-9999", "+82 10 9999 9999", "09999 999 999", "999 99 99 99", "+34 999 999 999", "+39 99 99999999", "+7 (999) 999-99-99", "8 999 999 99 99", "9999 9999", "999-9999", "9999999999", "+999999999999", "999 999 999")
IDS = ("999-99-9999", "999 99 9999", "999.99.9999", "999-99-9999", "999999-9999999", "999999-9999999", "AA 99 99 99 A", "AA999999A", "99999999A", "A9999999A", "99 999 999 999", "9 99 99 99 999 999 99", "999.999.999-99", "999 999 999", "9999 9999 9999", "AAAAAA99A99A999A", "999999-9999", "99999999999", "999999999", "9999999999999")
MARKED = set(IDS[:9]) | {IDS[11], IDS[12], IDS[15]}  # need no word that announces them
STREETS_EN = ("Street", "St", "St.", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Dr", "Court", "Blvd", "Way", "Place", "Terrace", "Close", "Square", "Row", "Crescent")


def phone(rng: random.Random) -> str:
    p = shaped(rng, rng.choice(PHONES[:-4] if rng.random() < 0.8 else PHONES))
    return p + (rng.choice((" ext. {}", " x{}", ", ext {}", " Durchwahl {}", " poste {}", " 내선 {}")).format(digits(rng, rng.randint(2, 4))) if rng.random() < 0.12 else "")


def email(rng: random.Random) -> str:
    low = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum()) or "x"
    local = rng.choice((low(given(rng)), f"{low(given(rng))}.{low(family(rng))}", f"{low(given(rng))[0]}{low(family(rng))}", f"{low(family(rng))}{digits(rng, 2)}", f"{low(given(rng))}_{low(family(rng))}", f"{low(given(rng))}+{rng.choice(WORDS)}", f"{low(given(rng))}-{low(family(rng))}"))
    parts = [low(syllables(rng))] if rng.random() < 0.8 else [rng.choice(("mail", "post", "team")), low(syllables(rng))]
    parts.append(rng.choice(("com", "org", "net", "io", "de", "fr", "co.uk", "kr", "example", "edu", "test", "eu")))
    r = rng.random()
    if r < 0.62:
        whole = f"{local}@{'.'.join(parts)}"
    else:
        at = rng.choice((" at ", " [at] ", "(at)", " (at) ", "[at]", " AT ", " {at} ", "＠", " @ ", " <at> ", " at "))
        dot = rng.choice((".", " dot ", " [dot] ", "(dot)", " DOT ", " {dot} ", " . ")) if at not in ("＠", " @ ") else "."
        whole = local + at + dot.join(parts)
    return whole.upper() if rng.random() < 0.06 else whole


def street(rng: random.Random) -> str:
    return rng.choice((syllables(rng), rng.choice(FAMILY), f"{syllables(rng)} {rng.choice(WORDS).capitalize()}", rng.choice(WORDS).capitalize(), rng.choice(("High", "Main", "Church", "Station", "Park", "Oak", "Pennsylvania", "Elm"))))


def address(rng: random.Random) -> str:
    n = str(rng.randint(1, 999)) + rng.choice(("", "", "", "a", "B"))
    city = rng.choice(CITIES) if rng.random() < 0.6 else syllables(rng)
    gap = rng.choice((", ", ", ", ", ", "\n", ",\n"))
    r = rng.random()
    if r < 0.3:
        flat = rng.choice(("", "", "", f"Flat {rng.randint(1, 40)}, ", f"Apt {rng.randint(1, 40)}, ", f"Unit {rng.randint(1, 40)}, "))
        tail = rng.choice(("", "", f"{gap}{city}", f"{gap}{city}, {shaped(rng, 'AA 99999')}", f"{gap}{city} {shaped(rng, 'A9 9AA')}", f"{gap}{city} {digits(rng, 5)}", f", Apt {rng.randint(1, 99)}{gap}{city}"))
        return f"{flat}{n} {street(rng)} {rng.choice(STREETS_EN)}{rng.choice(('', '', '', ' NW', ' SE'))}{tail}"
    if r < 0.5:
        de = rng.choice((street(rng) + rng.choice(("straße", "str.", "weg", "gasse", "allee", "platz", "ring")), "Am " + syllables(rng), street(rng) + " " + rng.choice(("Straße", "Weg", "Allee"))))
        return f"{de} {n}{rng.choice(('', f'{gap}{digits(rng, 5)} {city}', f'{gap}{digits(rng, 4)} {city}'))}"
    if r < 0.66:
        return f"{n}{rng.choice((' bis', ',', '', ''))} {rng.choice(('rue', 'avenue', 'boulevard', 'bd', 'place', 'quai', 'impasse', 'chemin'))} {rng.choice(('de ', 'du ', 'des ', 'de la ', ''))}{street(rng)}{rng.choice(('', f'{gap}{digits(rng, 5)} {city}'))}"
    if r < 0.82:
        kind = rng.choice(("Calle", "Avenida", "Plaza", "Paseo", "Via", "Viale", "Corso", "Rua", "C/", "ul.", "ulica"))
        return f"{kind} {street(rng)}{rng.choice((', ', ' ', ', nº '))}{n}{rng.choice(('', f'{gap}{digits(rng, 5)} {city}', f'{gap}{city}'))}"
    if r < 0.94:
        road = rng.choice(("테헤란", "세종대", "강남대", "한강", "중앙", "삼성", "월드컵", "해운대")) + rng.choice(("로", "길", "대로"))
        region = rng.choice(("", "서울특별시 강남구 ", "부산광역시 해운대구 ", "서울시 마포구 ", "대전 유성구 "))
        return f"{region}{road} {rng.randint(1, 400)}{rng.choice(('', '-' + str(rng.randint(1, 30)), f', {rng.randint(1, 30)}동 {rng.randint(101, 2500)}호', f' {rng.randint(1, 20)}층'))}"
    return f"ул. {rng.choice(('Ленина', 'Садовая', 'Мира', 'Пушкина'))}, д. {rng.randint(1, 99)}{rng.choice(('', ', кв. ' + str(rng.randint(1, 99)), ', Москва'))}"


def bare_id(rng: random.Random) -> str:
    return shaped(rng, rng.choice(sorted(MARKED)))


def said_id(rng: random.Random) -> str:
    return shaped(rng, rng.choice(IDS))


#: {n}ame, {e}mail, {p}hone, {i}d by its shape alone, {j} id after a word that announces it, {a}ddress, {w}ord, {d}igits, {t}itle-case words, {c}ity, {k} a decoy.
POSITIVE = (
    "{n} wrote the {w}.", "Please ask {n} about it.", "The {w} was signed by {n} and {n}.", "{n} and {n} met in {c}.", "Met {n} yesterday to discuss the {w}.", "Thanks to {n}, the {w} is ready.", "Contact: {n} <{e}>", "{n}, {p}", "Attendees: {n}, {n}, {n}", "Regards,\n{n}", "{n} signed it.", "Assigned to {n} ({e})",
    "cc {n}", "According to {n}, the {w} is late.", "Is {n} in {c} today?", "{n}'s {w} is overdue.", "{n} said: call me at {p}.", "Dear {n}, thank you for the {w}.", "The patient, {n}, lives at {a}.", "Speaker: {n} (moderator {n})", "Author: {n}", "Reviewed-by: {n} <{e}>", "We hired {n} in March.", "President {n} visited {c}.", "It was {n} who found the {w}.",
    "Call {p} now.", "Tel. {p}", "Tel: {p}, fax: {p}", "Phone {p} (mornings)", "Reach me on {p} or {e}.", "My number is {p}.", "Text {p} if the {w} fails.", "Mobile: {p}", "Hotline {p}, mail {e}", "ring {n} on {p} after six", "WhatsApp {p}", "The desk answers at {p} until five.",
    "Write to {e} please.", "Mail {e} and {e} about the {w}.", "E-mail: {e}", "Send the {w} to {e}.", "{e} bounced again.", "His address is {e}, hers {e}.", "forward it to {e} or phone {p}", "Questions? {e}", "Sender <{e}>", "you can reach {n} at {e}",
    "My SSN is {j}.", "SSN {j}", "SSN: {j}, born 1980", "Her social security number is {j}.", "ID number {j} belongs to {n}.", "National insurance no. {j}", "The file shows {i} for {n}.", "passport holder {n}, national ID {j}", "Identity number: {j}", "Tax identification number {j} of {n}", "{n} ({i})", "Please verify {i} before Friday.", "{i} was entered twice.", "The form of {n} lists {i}.", "NINO {j}", "Social security: {j}",
    "Ship it to {a}.", "He lives at {a}, next to the {w}.", "Address: {a}", "The office at {a} is closed.", "Deliver to {n}, {a}.", "{n}\n{a}", "We moved to {a} last year.", "Please come to {a} at noon.", "Invoices go to {a}; call {p}.", "Her home is {a}.", "Return the {w} to {a}.", "Meet us at {a}.",
    "Bitte {n} anrufen: {p}.", "Ansprechpartner: {n}, Tel. {p}", "Die Anschrift lautet {a}.", "{n} wohnt in der {a}.", "Schreiben Sie an {e}.", "Die Sozialversicherungsnummer von {n} ist {j}.", "Der Vertrag mit {n} liegt vor.", "Steuer-ID: {j}", "Rückfragen an {n} ({e}).", "Laut {n} ist der Bericht fertig.", "Ausweisnummer {j}",
    "Appelez {n} au {p}.", "Son adresse est {a}.", "Écrivez à {e}.", "Numéro de sécurité sociale : {j}", "Le dossier de {n} est complet.", "{n} habite {a}.", "Merci à {n} pour le rapport.", "Tél. : {p}", "D’après {n}, tout est prêt.", "Joindre {n} par courriel : {e}",
    "Llame a {n} al {p}.", "La dirección es {a}.", "Escriba a {e}.", "El DNI de {n} es {j}.", "{n} vive en {a}.", "Gracias a {n} por el informe.", "Teléfono: {p}", "Número de la seguridad social {j}", "Según {n}, el archivo está listo.", "Correo: {e}",
    "담당자는 {n}입니다.", "{n} 씨에게 {p}로 연락하세요.", "주소: {a}", "이메일은 {e} 입니다.", "주민등록번호 {j}", "주민번호는 {i}입니다.", "전화번호: {p}", "{n} 님이 문서를 보냈습니다.", "{n} 교수의 주소는 {a}입니다.", "문의: {n}, {e}", "배송지는 {a} 입니다.",
    "Позвоните {n} по номеру {p}.", "Адрес: {a}", "Автор: {n}", "Bel {n} op {p}.", "Scrivere a {e} o chiamare {p}.", "Il signor {n} abita in {a}.", "Kontakt: {n}, {p}", "Adres: {a}", "O CPF de {n} é {j}.", "PESEL {j}",
)
NEGATIVE = (
    "Build {k} passed.", "See {k} for details.", "Version {k} needs port {d}.", "Updated to {k} yesterday.", "The {w} at {k} failed.", "{k}", "Error {d} in {k}", "Install {k} first.", "It took {k} to run.", "Roll back to {k}, then retry {k}.", "Release {k} of the {w}", "Ticket {k} is open.", "From {k} to {k}", "Order {k} was shipped.", "Measured {k} and {k}.",
    "The {t} release is out.", "Open the {t} page.", "{t}", "We use {t} for the {w}.", "Ask the {t} team.", "{t}: {w} and {w}", "Travel from {c} to {c} takes {d} hours.", "Welcome to {c}!", "On {y} the {w} starts.", "{y} was quiet.", "My SSN and my phone number are private.", "Never store an SSN, e-mail or phone number.", "Please sign the {w} at the desk.", "Dr. is a title, Mr. too.",
    "The {w} has {d} rows and {d} columns.", "Run step {d} of {d}.", "Page {d}, line {d}.", "Chapter {d}: {t}", "Set x to {d}, y to {d}.", "Total {d} of {d} ({d} %)", "user admin on host {w}-{d}", "ssh root@{w}{d}", "Log in as {w}@{w}-{d}:{d}", "git clone git@{w}.test:{w}/{w}.git", "The @{w} decorator and @{w}/{w} package", "Follow @{w}{d} there.", "look at the {w} dot by dot", "meet at noon at the {w}",
    "Der Schlüssel {k} ist abgelaufen.", "Das Projekt {t} läuft.", "Die Version {k} ist neu.", "Am {y} beginnt die Wartung.", "La version {k} est prête.", "Le projet {t} avance.", "La versión {k} está lista.", "El proyecto {t} sigue.", "버전 {k} 배포 완료.", "{d}번 항목을 확인했습니다.", "프로젝트 {t} 시작", "{d}월 {d}일 회의", "Section {d} {t}", "Street names are not stored.", "The road is {d} km long.", "Platz {d} ist frei.",
    "No one at {t} replied.", "{t} and {t} merged last year.", "Listen to {t} by {t}.", "The {t} Award goes to the {w}.", "In {c}, {c} and {c} it rained.", "{t} Inc. raised {d} million.", "Each {w} got {d} points.", "Row {k} duplicates row {k}.",
)
DECOYS = ("9.9.9", "v9.9.99", "99.9.99999", "20999999.9", "99.99.9999", "2099-99-99", "2099-99-99T99:99:99Z", "99:99:99", "99/99/2099", "192.168.99.99", "10.9.9.99:8080", "aaaa:99a9::9a", "999999", "99999999", "9999999999999", "aa99a9a9", "9a9a9a9a-9a9a-9a9a-9a9a-9a9a9a9a9a9a", "AAA-9999", "AA-99-9999-99", "#99999", "$9,999.99", "9 999,99 €", "99.9 %", "9.99e-9", "0x9a9a", "978-9-99-999999-9", "99 MB", "9999 ms", "A99-999", "rev 99999", "99-99", "9999-9999 rows", "99.9999, -9.9999", "1799999999", "179999999999 ms", "sha256:9a9a9a9a9a9a", "999/999", "INV-2099-99999", "port 9999", "99x99", "redis@9.9", "numpy==9.9.9", "KB999999", "99°99'99\"N", "Q9 2099", "99.9.99999.999")


def titled(rng: random.Random) -> str:
    first = ("Blue", "Getting", "Vector", "Product", "Machine", "Memory", "Green", "North", "Open", "Data", "Silver", "Quick", "Service", "Release", "San", "New", "Night", "User", "Change", "Annual", "Golden", "Project", "Model", "Risk", "South")
    last = ("Heron", "Started", "Store", "Manager", "Learning", "Index", "Notes", "York", "Francisco", "Guide", "Review", "Board", "Bridge", "Engine", "Report", "Window", "Team", "Council", "Platform", "Larkspur", "Gate", "Summit", "University", "Hospital", "Bank")
    words = [rng.choice(first), *(rng.choice(last) for _ in range(rng.choice((1, 1, 2))))]
    return " ".join(words)


def dated(rng: random.Random) -> str:
    return rng.choice(("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Montag", "Mardi", "Lunes")) + rng.choice(("", f", {rng.randint(1, 28)} May", f" March {rng.randint(1, 28)}"))


FILL = {
    "n": ("name", name), "e": ("email", email), "p": ("phone", phone), "i": ("id_number", bare_id), "j": ("id_number", said_id), "a": ("address", address),
    "w": (None, lambda r: r.choice(WORDS)), "d": (None, lambda r: str(r.randint(0, 10 ** r.randint(1, 4)))), "t": (None, titled), "c": (None, lambda r: r.choice(CITIES)), "k": (None, lambda r: shaped(r, r.choice(DECOYS))), "y": (None, dated),
}
assert {kind for kind, _ in FILL.values()} - {None} == set(KINDS)


def templates(held: bool) -> tuple[list[str], list[str]]:
    """Templates with and without personal data: those left out of training, or all others."""
    pick = lambda given: [t for k, t in enumerate(given) if (k % HELD == 2) == held]
    return pick(POSITIVE), pick(NEGATIVE)


def sentence(template: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    while (a := template.find("{", at)) >= 0:
        text += template[at:a]
        kind, make = FILL[template[a + 1]]
        piece = make(rng)
        if kind:
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece
        at = a + 3
    return text + template[at:], spans


def example(positive: list[str], negative: list[str], carriers: list[str], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """Some sentences in a row: of the templates, and plain ones of `carriers` between them."""
    text, spans = "", []
    for _ in range(rng.randint(1, 4)):
        r = rng.random()
        if r < 0.25 and carriers:
            piece, found = rng.choice(carriers), []
        else:
            piece, found = sentence(rng.choice(positive if r < 0.7 else negative), rng)
        gap = "" if not text else rng.choice((" ", " ", "\n", "\n\n"))
        at = len(text) + len(gap)
        text += gap + piece
        spans += [(a + at, b + at, k) for a, b, k in found]
    return text, spans
