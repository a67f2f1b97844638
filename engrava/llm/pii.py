"""Problem 2: personal information in free text. Skip-chain conditional random field over candidate spans, loopy message passing."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Lexicons (fixed values): given names, titles, particles, words that begin sentences or stand before a name without being part of it.
GIVEN = """Amadou Anna Beatriz Bruno Celine Claire Corin Dag Elena Esme Eva Farid Greta Hamza Hans Ilse Ines Ivan James Jean John Jorin Jose
Juan Julia Karl Katya Lena Lev Luca Maria Marek Mary Mirela Nadim Nina Olga Omar Orla Paul Pavel Peter Pierre Quirin Rhea Robert Rosa
Soren Sofia Tamsin Thomas Tomasz Ulla Viggo Wanda Xenia Yara Yusuf Zora""".split()
TITLES = r"(?:Mrs?|Ms|Mx|Dr|Prof|Mme|Mlle|Herr|Frau|Señora|Señor|Señorita|Sra|Sr|Doña|Don|Signora|Signor|Madame|Monsieur)"
PARTICLES = r"(?:(?:de\sla|de|del|della|di|da|van\sder|van\sden|van|von|bin|al)[ \-]|al-|O['’]|D['’]|Mc|Mac)"
NOT_GIVEN = set(
    """About According Agent Also Alle An And Any Apt Applicant April As Asked At August Avenue Bitte But Build By Calle Call Checklist Checksum Clone Commit
    Contact Contactar Copper Das December Decided Decision Dear Der Die Do Each Ein Eine El Ella En Epoch Error Falta February Fixed Flat For Form Friday From
    Für Get GET Handler He Hello Hi I If Il In It January July June Keep Known La Las Le Learned Les Los Lost Main March May Measured Meet Memory Merged Monday
    My Nach Ne New Next No November October Offen On Open Or Order Our Para Pinned Ping Plan Please Pour Prefers Range Reached Reflection Remember Reste Rolled
    Saturday Se Section September Sessions She Ship Since So Someone Sunday Tests That The Then There These They This Those Thursday To Trace Tras Tuesday Un Una Une
    Use User Users Was We Wednesday What When Where Which While Who Why Wir With You Écrire Agent Après On""".split()
)
UP, LOW = r"A-ZÀ-ÖØ-ÞŁŚŻŠŽ", r"a-zß-öø-ÿłśżšž"
WORD_CAP = rf"[{UP}][{LOW}]+"
SURNAME = rf"{PARTICLES}*{WORD_CAP}(?:[{UP}][{LOW}]+)?(?:-{WORD_CAP})?"
SURNAME_CAPS = rf"(?:(?:DE\sLA|DE|VAN|VON|AL)[ \-]|O['’])*[{UP}]{{3,}}(?:-[{UP}]{{3,}})?"
STREET = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Close|Court|Ct|Lane|Ln|Drive|Dr|Place|Pl|Square|Sq|Way|Terrace|Crescent|Parkway|Row|Mews)"
GAP = r"(?:\s*,\s*|\s+|\s*\\n\s*|\s*,?\s*\n\s*)"
TOWN = rf"{WORD_CAP}(?:[ \-]{WORD_CAP})?"
TOWN1 = WORD_CAP

EMAIL = re.compile(
    r"(?<![\w.+\-%])[\w][\w.+\-]*(?:@|%40|\s?[(\[{]\s?(?:at|AT|At)\s?[)\]}]\s?|\s(?:AT|at)\s(?=\S+\s(?:DOT|dot)\s))[A-Za-z0-9\-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT|Dot)\s?[)\]}]\s?|\s(?:DOT|dot)\s)[A-Za-z0-9\-]+)+"
)
NUMBER = re.compile(r"(?<![\w@])(?:[A-Z]{1,2} ?)?\+?\(?\d(?:(?:[ .\-/]|[ ]?\(|\)[ \-]?)?\d){5,20}(?:[ \-]?[A-Z](?![\w]))?(?:,? ?(?:ext|x|Ext|poste|Durchwahl)\.? ?\d{1,6})?(?!\w)")
ADDRESS = re.compile(
    rf"""(?:{WORD_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm)\s\d+\s?[a-z]?(?:,|\sin){GAP}?\s?(?:D-)?\d{{5}}\s{TOWN1}
    |\d+(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:d[eu](?:\sla|s)?\s|d'|des\s)?{WORD_CAP}(?:[ \-]{WORD_CAP})?{GAP}\d{{5}}\s{TOWN1}
    |(?:Calle|Avenida|Av\.|Plaza|Paseo|Camino|C/)\s(?:de\s(?:la\s)?)?{WORD_CAP}\s\d+(?:,\s?\d+\s?[º°ª]\s?[A-Z]?)?{GAP}\d{{5}}\s{TOWN1}
    |(?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\s\w+,\s)?\d+[A-Za-z]?\s{WORD_CAP}(?:\s{WORD_CAP})?\s{STREET}\b\.?(?:,\s(?:Apt|Flat|Unit|Suite|Apartment)\.?\s\w+)?{GAP}{TOWN1}(?:,?\s\d{{5}}(?:-\d{{4}})?(?!\d))?
    |P\.?\s?O\.?\s?Box\s\d+{GAP}{TOWN1}(?:,?\s\d{{5}}(?!\d))?
    |[一-鿿]{{2,12}}(?:省|市|区|县)[一-鿿]{{1,12}}(?:路|街|道|巷)\d+号(?:[一-鿿\d]{{0,12}}(?:室|楼|单元))?
    |{WORD_CAP}\s(?:of|de)\s\w+\s\d+)""",
    re.X,
)
NAME = re.compile(
    rf"""(?P<title>(?<![\w@]){TITLES}\.?[ ](?:{WORD_CAP}[ ](?:[{UP}]\.[ ])?)?{SURNAME}(?!\w))
    |(?P<tcaps>(?<![\w@]){TITLES.replace("Señora|Señor|", "SEÑORA|SEÑOR|Señora|Señor|")}\.?[ ]{SURNAME_CAPS}(?!\w))
    |(?P<caps>(?<![\w@])[{UP}]{{3,}}[ ](?:[{UP}]\.[ ])?{SURNAME_CAPS}(?!\w))
    |(?P<last>(?<![\w@'’]){SURNAME},[ ]{WORD_CAP}(?:\s[{UP}]\.)?(?!\w))
    |(?P<icaps>(?<![\w@.])[{UP}]\.[ ](?:[{UP}]\.[ ])?{SURNAME_CAPS}(?!\w))
    |(?P<initial>(?<![\w@.])[{UP}]\.[ ]?(?:[{UP}]\.[ ]?)?{SURNAME}(?!\w))
    |(?P<full>(?<![\w@]){WORD_CAP}[ ](?:[{UP}]\.[ ])?{SURNAME}(?!\w))""",
    re.X,
)
GIVEN_SET = {g for g in GIVEN} | {g.upper() for g in GIVEN}


def name_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Candidates for names. A match that begins with a word that can't be a name is tried again behind that word."""
    at = 0
    while m := NAME.search(text, at):
        form = m.lastgroup
        first = re.split(r"[ ,]", m.group(), maxsplit=1)[0]
        if form == "full" and first in NOT_GIVEN:
            at = m.start() + len(first)
            continue
        if form == "full" and first not in GIVEN_SET:
            # two capital words of which the second is a given name: a word before a name, or a surname list
            rest = NAME.search(text, m.start() + len(first))
            if rest and rest.start() <= m.end() and re.split(r"[ ,]", rest.group(), maxsplit=1)[0] in GIVEN_SET:
                m, form = rest, rest.lastgroup
        if form == "caps" and first.capitalize() in NOT_GIVEN:
            at = m.start() + len(first)
            continue
        if form == "last":
            given = re.split(r",\s", m.group())[1].split()[0]
            # a capital word behind an unknown given name: that begins a full name of its own
            if given in NOT_GIVEN or first in NOT_GIVEN or (given not in GIVEN_SET and re.match(rf"[ ](?:[{UP}]\.[ ])?[{UP}]", text[m.end() : m.end() + 8])):
                at = m.start() + len(first)
                continue
        yield m.start(), m.end(), form
        at = m.end()


class Node:
    """A candidate span: its place, the kinds it may be of besides none, and its features."""

    __slots__ = ("start", "end", "options", "features", "same")

    def __init__(self, start: int, end: int, options: tuple[str, ...], features: list[str], same: str):
        self.start, self.end, self.options, self.features, self.same = start, end, ("O", *options), features, same


BEFORE = re.compile(r"[\w#%&/\"'.:=(-]+")


def around(text: str, start: int, end: int) -> list[str]:
    words = [w.lower().strip("\"'(.:") for w in BEFORE.findall(text[max(0, start - 40) : start])[-2:]]
    prev = words[-1] if words else "^"
    prev = re.sub(r".*(?=(?:phone|tel|id|ssn|addr|mail|name|to|contact)[=:\"]*$)", "", prev)
    follow = re.match(r"\W*(\w*)", text[end : end + 24])
    return [f"b={prev}", f"bb={' '.join(words)}", f"a={follow.group(1).lower() if follow else ''}", f"l={text[start - 1 : start]}", f"r={text[end : end + 1]}"]


def shape(s: str) -> str:
    return re.sub(r"[a-zß-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "0", s)))


def candidates(text: str) -> list[Node]:
    """All candidates of a whole text from left to right; longer kinds first, so that what lies inside them is no candidate."""
    nodes: list[Node] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    if "@" in text or "%40" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            s = m.group()
            host = re.split(r"@|%40|(?i:[(\[{]?\s?\bat\b\s?[)\]}]?)", s)[-1]
            last = re.split(r"[.\s\])}]", host.rstrip(".-"))[-1]
            f = ["email", f"tld={'alpha' if last.isalpha() and len(last) > 1 else 'other'}", f"repo={text[m.end() : m.end() + 1] == ':' and text[m.end() + 1 : m.end() + 2].isalpha()}", f"git={s.startswith('git@')}", f"sign={'@' if '@' in s else 'other'}"]
            nodes.append(Node(m.start(), m.end(), ("email",), f, s.lower()))
            taken.append(m.span())
    for m in ADDRESS.finditer(text):
        if free(*m.span()):
            s = m.group()
            f = ["address", f"post={bool(re.search(r'[0-9]{5}', s))}", f"town={bool(re.search(rf'{WORD_CAP}$|[0-9]{{5}}$|号', s))}", f"of={bool(re.match(rf'{WORD_CAP} (?:of|de) [a-z]', s))}", f"digits={bool(re.search(r'[0-9]', s))}"]
            nodes.append(Node(m.start(), m.end(), ("address",), f, s.lower()))
            taken.append(m.span())
    for m in NUMBER.finditer(text):
        if free(*m.span()):
            s, end = m.group(), m.end()
            if s.endswith(")") and s.count(")") > s.count("("):
                s, end = s[:-1], end - 1
            digits = re.sub(r"\D", "", re.sub(r"(?i)(?:ext|x|poste).*", "", s))
            core = re.sub(r"(?i),? ?(?:ext|x|poste).*", "", s)
            f = [f"shape={shape(core)}", f"n={len(digits)}", f"plus={'+' in s}", f"ext={core != s}", f"nine={digits[:1] == '9'}", f"letter={bool(re.match('[A-Z]', core))}{bool(re.search('[A-Z]$', core))}", f"sep={''.join(sorted(set(re.sub(r'[0-9A-Z]', '', core))))}", f"zeros={digits[:2] == '00'}"]
            context = around(text, m.start(), end)
            f += context + [f"shape={shape(core)}&{context[0]}"]
            nodes.append(Node(m.start(), end, ("phone", "id_number"), f, digits))
            taken.append((m.start(), end))
    for a, b, form in name_spans(text):
        if free(a, b):
            s = text[a:b]
            words = re.findall(r"[^\W\d_]+", s)
            surname = words[0] if form == "last" else words[-1]
            given = words[-1] if form == "last" else words[0]
            f = [f"form={form}", f"given={given in GIVEN_SET or words[-1] in GIVEN_SET}", f"form={form}&given={given in GIVEN_SET}", f"end3={surname[-3:].lower()}", f"end4={surname[-4:].lower()}", f"init={bool(re.search(r'[A-Z][.]', s))}", f"long={len(words) > 2}"]
            if "caps" in form:
                f.append(f"form={form}&loud={text[max(0, a - 20) : a].isupper()}{text[b : b + 20].isupper()}&given={given in GIVEN_SET}")
            f += around(text, a, b)
            nodes.append(Node(a, b, ("name",), f, surname.lower()))
            taken.append((a, b))
    nodes.sort(key=lambda n: n.start)
    return nodes


class Field:
    """Skip-chain conditional random field. Neighbouring candidates are linked in a chain; equal or similar ones by skip edges."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.w = weights

    def unary(self, node: Node) -> list[float]:
        return [sum(self.w.get((f, y), 0.0) for f in node.features) for y in node.options]

    @staticmethod
    def edges(nodes: list[Node]) -> list[tuple[int, int, str]]:
        out = [(i, i + 1, "chain") for i in range(len(nodes) - 1)]
        last: dict[tuple, int] = {}
        for i, n in enumerate(nodes):
            key = (n.options, n.same)
            if key in last and last[key] != i - 1:
                out.append((last[key], i, "skip"))
            elif key in last:
                out[last[key]] = (last[key], i, "skip")  # the chain edge between equal neighbours is a skip edge as well
            last[key] = i
        return out

    def pair(self, kind: str, a: str, b: str) -> float:
        return self.w.get((f"{kind}:{a}", b), 0.0)

    def labels(self, nodes: list[Node], rounds: int = 6) -> list[str]:
        """Most probable labels by sum-product message passing; exact on a chain, loopy where skip edges close circles."""
        u = [self.unary(n) for n in nodes]
        if len(nodes) == 1:
            return [nodes[0].options[max(range(len(u[0])), key=u[0].__getitem__)]]
        edges = self.edges(nodes)
        table = [[[self.pair(k, a, b) for b in nodes[j].options] for a in nodes[i].options] for i, j, k in edges]
        if not any(x for t in table for row in t for x in row):
            return [n.options[max(range(len(x)), key=x.__getitem__)] for n, x in zip(nodes, u)]
        msg = {}
        at: list[list[tuple[int, int]]] = [[] for _ in nodes]
        for e, (i, j, _) in enumerate(edges):
            msg[e, 0], msg[e, 1] = [0.0] * len(u[j]), [0.0] * len(u[i])  # towards j, towards i
            at[j].append((e, 0))
            at[i].append((e, 1))
        for _ in range(rounds):
            new = {}
            for e, (i, j, _k) in enumerate(edges):
                for side, (src, dst) in enumerate(((i, j), (j, i))):
                    belief = [u[src][a] + sum(msg[m][a] for m in at[src] if m != (e, 1 - side)) for a in range(len(u[src]))]
                    out = []
                    for b in range(len(u[dst])):
                        v = [belief[a] + (table[e][a][b] if side == 0 else table[e][b][a]) for a in range(len(belief))]
                        top = max(v)
                        out.append(top + math.log(sum(math.exp(x - top) for x in v)))
                    norm = max(out)
                    new[e, side] = [x - norm for x in out]
            done = max(abs(a - b) for k in new for a, b in zip(new[k], msg[k])) < 1e-4
            msg = new
            if done:
                break
        out = []
        for i, n in enumerate(nodes):
            belief = [u[i][a] + sum(msg[m][a] for m in at[i]) for a in range(len(u[i]))]
            out.append(n.options[max(range(len(belief)), key=belief.__getitem__)])
        return out


# ---- training: sentences made here, with their labels; a bounded, documented sample of SENTENCES documents.
SENTENCES = 3000
SUFFIX = "mann berg sen dottir ström quist wick ford elli ez idze aux owski ard son ova ini escu".split()


def _word(r: random.Random, n: int = 2) -> str:
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice("lmnrsx") for _ in range(n))


def _d(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "0" else r.choice("ABCFGMRTWY") if c == "L" else c for c in pattern)


def _name(r: random.Random) -> str:
    s = _word(r, 1).capitalize() + r.choice(["", r.choice("bdklmnt")]) + (r.choice(SUFFIX) if r.random() < 0.8 else r.choice("aeiou") + r.choice("bdfgklmnprstvz"))
    if r.random() < 0.15:
        s += "-" + _word(r).capitalize()
    if r.random() < 0.15:
        s = r.choice(["van ", "de la ", "al-", "O'", "van O'"]) + s
    g, mid = r.choice(GIVEN) if r.random() < 0.8 else _word(r, r.choice([1, 2])).capitalize() + r.choice(["", "a", "e", "u"]), r.choice(["", "", f"{r.choice('ABCDEHKL')}. "])
    x = r.random()
    if x < 0.5:
        return f"{g} {mid}{s}"
    if x < 0.62:
        return f"{r.choice('ABCDEKNOQSTVXY')}. {s}"
    if x < 0.78:
        return r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Mme ", "Frau ", "Herr ", "Señora ", "Señor "]) + s
    if x < 0.9:
        return f"{s}, {g}"
    return r.choice([f"{g} {s}", f"{g} {s}", f"{r.choice('ABCDEKNOQSTVXY')}. {s}"]).upper()


def _phone(r: random.Random) -> str:
    return _d(r, r.choice(["+1 000 555 0000", "(000) 555-0000", "000-555-0000", "000.555.0000", "000 555 0000 ext. 000", "000 555 0000", "0005550000", "001 000/555/0000", "+1-000-555-0000", "+44 20 7946 0000", "+44 (0)1632 960 000", "01632 960000", "+49 (0)30 23125-000", "030 23125 000", "0491 570 000", "01.99.00.00.00", "+33 1 99 00 00 00", "+34 600 000 000"]))


def _id(r: random.Random) -> str:
    return _d(r, r.choice(["SSN 900-00-0000", "900-00-0000", "ssn=900000000", "social security number 900 00 0000", "NIR 0 00 00 00 000 000 00", "Steuer-ID 00 000 000 000", "passport no. X00000000", "nino QQ000000L", "NI number QQ 00 00 00 L", "national id: 00-0000-000", "DNI 00000000-L", "NIE X0000000L", "身份证 000000000000000000"]))


def _address(r: random.Random) -> str:
    n, t, z, w = r.randint(2, 990), _word(r).capitalize(), _d(r, "00000"), _word(r).capitalize()
    return r.choice([f"{w}straße {n}, {z} {t}", f"{w}weg {n}b in {z} {t}", f"{n} rue de {w}, {z} {t}", f"{n} bis rue de {w}, {z} {t}", f"Calle {w} {n}, 3º B, {z} {t}", f"{n} {w} Avenue, Apt 3A, {t}", f"{n} {w} Street\n{t}, {z}", f"Flat {n}, {n} {w} St, {t}", f"{n} {w} Close, {t} {z}", f"P.O. Box {n}, {t} {z}"])


def _email(r: random.Random) -> str:
    u, d = r.choice([_word(r), f"{r.choice(GIVEN)}.{_word(r)}", f"{_word(r)}+{_word(r)}", f"{_word(r)}{r.randint(1, 99)}"]), _word(r)
    return r.choice([f"{u}@{d}.example", f"{u}@mail.{d}.test", f"{u}%40{d}.invalid", f"{u} [at] {d} [dot] example", f"{u} (at) {d}.co.example", f"{u} AT mail DOT {d} DOT test", f"{u}@{d}.com"])


def _decoy(r: random.Random) -> str:
    w, n = _word(r), r.randint(2, 99)
    if r.random() < 0.12:  # capital words in a list and words in capital letters that are no names
        a, b = _word(r).capitalize(), _word(r).capitalize()
        return r.choice([f"We compared {a}, {b} and {w}.", f"In {a}, {b} was slow.", f"Services {a}, {b} restarted {w}.", f"{a.upper()} {b.upper()} in {w} is a constant.", f"The log says {a.upper()} {b.upper()} for {w}.", f"THE {w.upper()} WITH A {b.upper()} {a.upper()}.", f"{a.upper()} COVERS THE {b.upper()} {w.upper()}. NEXT", f"{a.upper()} EN LA {b.upper()} DE {w.upper()}.", f"SELECT {a.upper()} FROM {b.upper()} WHERE {w} = 1."])
    return r.choice([f"Order {_d(r, '000-00-00000')} and part {_d(r, '000-00-00000')} belong to {w}.", f"Build {_d(r, '0000000000')} finished at {_d(r, '2025-00-00 00:00:00')}.", f"Build {_d(r, '000000000')} finished at {_d(r, '2025-00-00 00:00:00')}.", f"Range {_d(r, '000000-0000')} in {w} is a byte offset.", f"Epoch {_d(r, '00000000000')} was stored in src/{w}.py as text.", f"Checksum {_d(r, '000 00 0000')} printed by {w} is not stable.", f"Checksum {_d(r, '000 0 0000')} printed by {w} is not stable.", f"Commit {_d(r, '0000')}af{_d(r, '000')} touches lines {_d(r, '120-00-0000')} of src/{w}.py.", f"Commit a1f touches lines {_d(r, '120-0-0000')} of {w}.", f"Trace id {_d(r, '000000000000')} came from 10.{n}.{n}.13 port {_d(r, '0000')}.", f"Main Loop step {n}, Avenue of retries {n}, see {w}.", f"{r.choice(['Quiet Harbor', 'Silver Anchor', 'Red Falcon'])} and {r.choice(['Amber Signal', 'Blue Meadow', 'Green Summit'])} are the next two releases of {w}.", f"The {r.choice(['Copper Lantern', 'Iron Bridge', 'Golden Path'])} milestone blocks src/{w}.py.", f"Clone git@git.{w}.example:team/{w}.git before running {w}.", f"Pinned {w}@{n}.2.3 because {w} needs it.", f"WATCH THE {w.upper()} RETRY FOR {n} S. {r.choice(['ASKED TO', 'PLAN:', 'FIXED', 'TESTS FOR', 'KEEP', 'MERGED'])} {_word(r).upper()}.", f"Invoice {_d(r, '0000000000')} and ticket {_d(r, '000-000-0000')} were closed.", f"Der Nutzer möchte {w} sehen. Die Rechnung Nummer {_d(r, '00000000')} fehlt.", f"Bitte {w.capitalize()} Lomtan prüfen.", f"For {w.capitalize()} Release {n} see the log at {_d(r, '2024-00-00 00:00')}.", f"Measured {_d(r, '0000')} ms and {_d(r, '0000000')} rows for {w}."])


FRAMES = ["My name is {name} and I live at {address}.", "Reached {name} by phone ({phone}), agreed to drop {w}.", "Applicant {name}, {id_number}, call back on {phone}.", "Form row: {name}; {id_number}; {address}", "contact={email} phone={phone} job={w}", '{{"full_name": "{name}", "tel": "{phone}", "ref": "{w}"}}', '{{"mail":"{email}","addr":"{address}"}}', "{name} <{email}> reviewed {w}.", "Die Rechnung geht an {name}, {address}.", "Bitte {name} unter {phone} anrufen, wenn {w} fertig ist.", "Écrire à {email} ou appeler le {phone} pour {w}.", "Contactar con {name} ({id_number}) antes de borrar {w}.", "请联系 {name}，电话 {phone}，邮箱 {email}。", "Meet at {address} for the {w} workshop, ask for {name}.", "Ship the dev board to {name}, {address}.", "User shared {id_number} by accident while testing {w}.", "verify {id_number} against {w} before export", 'log: signup ok uid=4 mail={email} id="{id_number}"', "cc {email}; tel {phone}", "call me on {phone} after the {w} page is done", "Contact for {w}: {name}, phone {phone}.", "According to {name} the bounded lease belongs to {w}.", "{name} said {w} is fine, {name} disagreed.", "The escalation owner is {name}; backup is {name}.", "Ping {name} at {email} once {w} is merged.", "{phone}", "New office address is {address} from next month.", "GET /invite?to={email}&ref={w}", "{address}", "{name}"]
MAKE = {"name": _name, "phone": _phone, "id_number": _id, "address": _address, "email": _email, "w": _word}


def made(n: int = SENTENCES, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Documents of one to four sentences with the spans of their kinds."""
    r = random.Random(seed)
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.45:
                text += _decoy(r)
            else:
                for piece in re.split(r"(\{\w+\})", r.choice(FRAMES)):
                    if re.fullmatch(r"\{\w+\}", piece) and piece[1:-1] in MAKE:
                        v = MAKE[piece[1:-1]](r)
                        if piece != "{w}":
                            spans.append((len(text), len(text) + len(v), piece[1:-1]))
                        text += v
                    else:
                        text += piece.replace("{{", "{").replace("}}", "}")
            text += r.choice([" ", "\n"])
        yield text, spans


def fit(n: int = SENTENCES, seed: int = 7, passes: int = 6, rate: float = 0.4, shrink: float = 1e-3) -> Field:
    """Weights by ascending the pseudo-likelihood: each label given its neighbours' true ones, over the made documents."""
    w: dict[tuple[str, str], float] = {}
    docs = []
    for text, spans in made(n, seed):
        nodes = candidates(text)
        truth = []
        for node in nodes:
            best = max(spans, key=lambda s: min(node.end, s[1]) - max(node.start, s[0]), default=None)
            over = best and min(node.end, best[1]) - max(node.start, best[0]) > 0.5 * (node.end - node.start)
            truth.append(best[2] if over and best[2] in node.options else "O")
        if nodes:
            docs.append((nodes, truth, Field.edges(nodes)))
    r = random.Random(seed)
    for step in range(passes):
        eta = rate / (1 + step)
        r.shuffle(docs)
        for nodes, truth, edges in docs:
            near: list[list[tuple[str, int]]] = [[] for _ in nodes]
            for i, j, kind in edges:
                near[i].append((kind, j))
                near[j].append((kind, i))
            for i, node in enumerate(nodes):
                keys = []
                for y in node.options:
                    k = [(f, y) for f in node.features]
                    k += [(f"{kind}:{y}", truth[j]) if i < j else (f"{kind}:{truth[j]}", y) for kind, j in near[i]]
                    keys.append(k)
                s = [sum(w.get(k, 0.0) for k in ks) for ks in keys]
                top = max(s)
                p = [math.exp(x - top) for x in s]
                z = sum(p)
                for y, ks, q in zip(node.options, keys, p):
                    g = eta * ((y == truth[i]) - q / z) / 4
                    if abs(g) > 1e-6:
                        for k in ks:
                            w[k] = w.get(k, 0.0) * (1 - shrink * eta) + g
    return Field({k: round(v, 4) for k, v in w.items() if abs(v) > 1e-3})


def spans_of(text: str, field: Field) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found in a whole text, from left to right, without overlaps."""
    nodes = candidates(text)
    if not nodes:
        return []
    return [(n.start, n.end, y) for n, y in zip(nodes, field.labels(nodes)) if y != "O"]


def redacted(text: str, field: Field) -> str:
    out, at = [], 0
    for a, b, kind in spans_of(text, field):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def tables_of(memories: DataFrame, turns: DataFrame) -> list[DataFrame]:
    return [
        memories.select(F.lit("memories").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("updated_at").alias("version"), "text"),
        turns.select(F.lit("turns").alias("tbl"), F.col("turn_id").cast("string").alias("rec_id"), F.col("ingested_at").alias("version"), "text"),
    ]


def occurrences(tables: list[DataFrame], field: Field | None = None) -> DataFrame:
    """(tbl, rec_id, pii_kind, nth): one row for each occurrence in the latest version of each record.

    tables: frames (tbl, rec_id, version, text). Whole texts are read where they lie; only counts are shuffled to choose a
    record's latest version (of equal versions the one with more). Null and empty texts have no occurrences; rows without an
    id are left out.
    """
    rows = reduce(DataFrame.unionAll, tables).where("rec_id is not null")
    model = rows.sparkSession.sparkContext.broadcast((field or fit()).w)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Field(model.value)
        for b in batches:
            found = [[0] * len(KINDS) for _ in range(len(b))]
            for row, t in zip(found, b["text"]):
                if t:
                    for _, _, kind in spans_of(t, f):
                        row[KINDS.index(kind)] += 1
            yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec_id"], "version": b["version"], **{k: [r[i] for r in found] for i, k in enumerate(KINDS)}})

    c = rows.mapInPandas(count, "tbl string, rec_id string, version timestamp, " + ", ".join(f"{k} int" for k in KINDS))
    last = c.groupBy("tbl", "rec_id").agg(F.max(F.struct("version", *KINDS)).alias("m"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("pii_kind"), F.col(f"m.{k}").alias("n")) for k in KINDS])).alias("x")
    each = last.select("tbl", "rec_id", kinds).where("x.n > 0")
    return each.select("tbl", "rec_id", "x.pii_kind", F.explode(F.expr("sequence(1L, cast(x.n as bigint))")).alias("nth"))


def redact(tables: list[DataFrame], field: Field | None = None) -> DataFrame:
    """(tbl, rec_id, version, text): every row with its text redacted; nulls stay null. No shuffle."""
    rows = reduce(DataFrame.unionAll, tables)
    model = rows.sparkSession.sparkContext.broadcast((field or fit()).w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Field(model.value)
        for b in batches:
            yield b.assign(text=[redacted(t, f) if t else t for t in b["text"]])

    return rows.mapInPandas(run, "tbl string, rec_id string, version timestamp, text string")
