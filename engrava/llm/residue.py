"""Problem 9: template residue and error-page text. Labelled exemplars, an inverted index, TF-IDF containment over passage windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled exemplars (fixed values). SLOT stands for any unfilled slot, NAME for any file, symbol or project name,
# NUM for a number. The first group stands in place of content; the second only writes about such things.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
lorem ipsum dolor sit amet velit magna massa sapien libero viverra felis quis nulla nisl urna vitae augue porta pretium dapibus mattis cursus tempor aliqua
""".strip().splitlines()
RESIDUE = """
blah blah blah
foo bar baz foo bar
asdf qwer asdf
xxxx xxx xxxxx xx
test test test NUM
text text text text
sample paragraph
content coming soon
this is dummy copy for layout checks only
replace this block with your own words
texte factice pour la mise en page
texto de relleno sustituir antes de publicar
blindtext der später ersetzt wird
hier steht bald der richtige inhalt
示 例 文 字 请 替 换
tbd tbd tbd
you need to enable javascript to run this app
please enable javascript to view this dashboard
we re sorry but the memory viewer doesn t work properly without javascript enabled
veuillez activer javascript pour continuer
active javascript en su navegador para ver el panel
bitte aktivieren sie javascript um die seite zu sehen
diese anwendung funktioniert nicht ohne skripte
scripts désactivés
请 启 用 javascript 以 查 看 此 页 面
未 检 测 到 脚 本 支 持
scripts are disabled
no script support found
this site requires js
scripting is switched off in your browser
switch it on to read this page
your client does not run scripts
checking that your browser runs scripts
if nothing appears allow scripts for this host
this view of NAME is built in the browser and stays empty without them
this wiki needs scripts
turn them on and reload
your browser blocks scripts so the notes cannot be loaded
NUM not found
NUM forbidden
NUM bad gateway
NUM service unavailable
NUM gateway time out
NUM internal server error
NUM gateway timeout
NUM gateway NAME
the wiki page you asked for does not exist or was moved
access denied
you lack permission to view this note
please contact the owner
request failed with status NUM
something went wrong on our side
oops something went wrong
the team was told
the requested export could not be rendered
too many requests
slow down and retry in NUM seconds
your session has expired
please sign in again to read this page
NUM the memory service is down for maintenance
fatal could not connect to database at NUM
code NUM message internal trace
traceback most recent call last
keyerror body
upstream closed the connection
nothing lives at this address
the note could not be loaded
the wiki is offline right now
this memory was removed by its owner
you are not allowed to open this session
the server took too long to answer
accès refusé à cette session
la note n a pas pu être chargée
acceso denegado
acceso denegado a esta sesión
no se pudo cargar la nota
die notiz konnte nicht geladen werden
zugriff verweigert
zugriff auf diese sitzung verweigert
无 法 加 载 此 笔 记
访 问 被 拒 绝
服 务 器 内 部 错 误 请 稍 后 再 试
""".strip().splitlines()
MENTIONS = """
body hello SLOT
the snippet above shows how values are filled
in the template we write SLOT and NAME fills it before the page is stored
der platzhalter SLOT wird von NAME vor dem speichern ersetzt
a lint rule of NAME rejects notes that still hold SLOT or similar marks
""".strip().splitlines()

#: Words that head or close an error message in any of its forms (fixed values); they weigh as little as a number does.
AROUND = "error erreur fehler http status code request id fatal noscript html head title body hr proxy p 错 误".split()
#: Containment from which a window counts as covered by an exemplar, and how much of the window must be the exemplar's.
COVER, OF_WINDOW = 0.75, 0.75

# Unfilled slots, as bracketed or marked words: the grammars of template languages and the ways in which people write them.
#: A name in a slot, of any length: words joined by an underline, point or hyphen. ELEMENTS are no slots but markup.
#: In plain square brackets a single word is mostly an editor's mark ([cut], [sic]), so of those only the listed ones count.
WORDS = r"\p{L}[\p{L}\p{N}]+(?:[_.\-][\p{L}\p{N}]+)*+"
ELEMENTS = r"""a|abbr|address|article|aside|audio|b|base|blockquote|body|br|button|canvas|caption|center|cite|code|col|colgroup|dd|del|details|dfn|dialog|div|dl|dt|em|
embed|fieldset|figcaption|figure|font|footer|form|h\d|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|map|mark|meta|meter|nav|noscript|object|ol|
optgroup|option|output|p|param|picture|pre|progress|q|s|samp|script|section|select|small|source|span|strong|style|sub|summary|sup|svg|table|tbody|td|template|textarea|
tfoot|th|thead|time|title|tr|track|tt|u|ul|var|video|wbr|xml|think|thinking|reasoning""".replace("\n", "")
SLOT_FORMS = [
    r"\{\{[{#/^>&!~\-]?\s*[\p{L}_][^{}\n]*\}?\}\}", r"\{%-?\s*[\p{L}_][^{}%\n]*%\}", r"<%[=\-]?\s*[\p{L}_][^<>%\n]*%>",
    r"[$#]\{\s*[\p{L}_][^{}\n]*\}", r"\{[\p{L}_][\p{L}\p{N}_.\-]*\}", r"\$[\p{L}_][\p{L}\p{N}_.]*\$", r"%\([\p{L}_][\p{L}\p{N}_.]*\)s",
    r"(?<![\p{L}\p{N}%])%[\p{Lu}_][\p{Lu}\p{N}_]+%(?![\p{L}\p{N}%])",
    r"@@[\p{L}_][\p{L}\p{N}_.]*@@", r"\[\[[\p{L}_][\p{L}\p{N}_. ]*\]\]", r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_.]*?__(?![\p{L}\p{N}_])", r"«[\p{L}_][\p{L}\p{N}_.]*»",
    r"(?<![\p{L}\p{N}_])(?i:todo)_[\p{L}][\p{L}\p{N}_.]*", r"(?<![\p{L}\p{N}])(?i:x{2}[./]x{2}[./]x{4}(?:\s*/\s*n\.\s*n\.)?)", r"(?<![\p{L}\p{N}])(?i:tbd(?:\s+tbd)+)(?![\p{L}\p{N}])",
    r"\[(?i:insert|enter|describe|your|add|fill|hier|texto|à|待)[^\[\]\n]*\]", r"\((?i:fill\s+in|insert)\s[^()\n]*\)", r"<(?i:enter|insert|fill|your|describe|add)\s[^<>\n]*>",
    rf"(?<![\p{{L}}\p{{N}}\])!])\[(?=[^\]]*[_.\-]|(?i:title|date|owner|scope|summary|body|link|project|evidence)\]){WORDS}\](?![(\[:])", rf"(?<![\p{{L}}\p{{N}}])<(?!(?i:{ELEMENTS})>){WORDS}>(?!.*</)",
    r"<(?i:title|body|summary|link)>",
]
SLOT = regex.compile("|".join(SLOT_FORMS))
#: Markup whose names are also names of slots: a page's own body, title or summary element isn't one.
MARKUP = regex.compile(r"(?i)</?(?:html|head|body|title|hr|p|h[1-6]|footer|summary|link)\s*/?>")
NAMED = regex.compile(r"`[^`\n]*`|src/[\w/]+\.\w+|[\p{L}\p{N}]+(?:[_\-.]|::)[\p{L}\p{N}_\-.:]*[\p{L}\p{N}]|(?<!\p{L})(?!JavaScript)\p{L}*\p{Ll}\p{Lu}\p{L}*|#\d+|(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{8,}(?![\p{L}\p{N}])")
TOKEN = regex.compile(r"SLOT|NAME|NUM|\p{N}+|\p{Han}|(?:(?!\p{Han})\p{L})+")
#: Windows: lines, and in them sentences; and sentences that go on in the next line.
SENTENCE = regex.compile(r"(?<=[.!?。！？])(?=\s|\p{Han}|<)|(?<=>)(?=\s*[^\s<])")
#: A fence that is never closed ends at the first blank line.
FENCE = regex.compile(r"```.*?```|```(?:(?!\n[ \t]*\n).)*", regex.S)


def tokens(window: str) -> list[str]:
    """Words of a window in lower case; slots, names and numbers by their class; Han characters one by one."""
    return ["NUM" if t[0].isdigit() else t if t in ("SLOT", "NAME", "NUM") else t.lower() for t in TOKEN.findall(window)]


class Exemplars:
    """The exemplars, and the inverted index from their tokens to them."""

    def __init__(self, idf: dict[str, float]):
        self.idf, self.rest = idf, max(idf.values(), default=1.0)
        self.items = [("filler", tokens(x)) for x in FILLER] + [("residue", tokens(x)) for x in RESIDUE] + [("mention", tokens(x)) for x in MENTIONS]
        self.items = [(label, set(t), sum(self.weight(x) for x in set(t))) for label, t in self.items]
        self.index: dict[str, list[int]] = {}
        for i, (_, t, _) in enumerate(self.items):
            for x in t:
                self.index.setdefault(x, []).append(i)

    def weight(self, token: str) -> float:
        return self.idf.get(token, self.rest)

    def anchors(self) -> set[str]:
        """Tokens of which every covered window holds at least one: of each exemplar the heaviest, that together outweigh what may be missing."""
        out: set[str] = set()
        for label, have, mass in self.items:
            if label == "mention":
                continue
            if label == "filler":
                out |= {t for t in have if len(t) > 3 and t not in ("SLOT", "NAME", "NUM")}
                continue
            left = (1 - COVER) * mass
            for t in sorted(have - {"SLOT", "NAME", "NUM"}, key=lambda t: (-self.weight(t), t)):
                out.add(t)
                left -= self.weight(t)
                if left < 0:
                    break
        return out

    def best(self, window: list[str]) -> tuple[float, float]:
        """The containment of the best residue and the best mention in a window; for residue also most of the window must be its own."""
        have = set(window)
        got: dict[int, float] = {}
        for x in have & self.index.keys():
            w = self.weight(x)
            for i in self.index[x]:
                got[i] = got.get(i, 0.0) + w
        residue = mention = 0.0
        whole = sum(self.weight(x) for x in have) or 1.0
        union: set[str] = set()
        for i, w in got.items():
            label, words, mass = self.items[i]
            if label == "mention":
                mention = max(mention, w / mass)
            elif label == "filler":  # any words of it in any order, if the window is all its own
                if len(have) >= 3 and w / whole >= 0.9:
                    residue = max(residue, w / whole)
            elif w / mass >= COVER:  # several exemplars may share a window
                union |= words
                residue = max(residue, w / mass) if w / whole >= OF_WINDOW else residue
        if not residue and union and sum(self.weight(x) for x in have & union) / whole >= OF_WINDOW:
            residue = COVER
        return residue, mention


@lru_cache(maxsize=1)
def vocabulary() -> frozenset[str]:
    return frozenset(t for x in FILLER + RESIDUE + MENTIONS for t in tokens(x)) - {"SLOT", "NAME", "NUM"}


#: What begins or marks a slot, in lower case (fixed values); only lines that hold one are looked at for slots.
SLOT_MARKS = ["{", "<", "$", "%", "@@", "[", "__", "«", "todo_", "xx.", "xx/", "tbd", "(fill", "(insert"]


class Scorer:
    """Scores whole texts. Lines that hold neither an anchor token of an exemplar nor a mark of a slot can't be covered."""

    def __init__(self, idf: dict[str, float]):
        import ahocorasick

        self.ex = Exemplars(idf)
        self.find = ahocorasick.Automaton()
        for t in self.ex.anchors():
            self.find.add_word(t, len(t))
        for t in SLOT_MARKS:
            self.find.add_word(t, 0)
        self.find.make_automaton()

    def __call__(self, text: str) -> tuple[int, int, float]:
        """(windows covered by residue, unfilled slots outside mentions, highest containment)."""
        low = text.lower()
        if len(low) != len(text):  # lower case of a few letters is longer; positions must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        covered, slots, top, done = 0, 0, 0.0, -1
        fences, wrapped = None, -1
        for at, size in self.find.iter(low):
            if at < done or (size and low[at - size : at - size + 1].isalpha() and at >= size and low[at].isascii()) or (size and low[at].isascii() and low[at + 1 : at + 2].isalpha()):
                continue
            begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            done = end if end >= 0 else len(text)
            if fences is None:
                fences = [m.span() for m in FENCE.finditer(text)] if "```" in text else []
            code = any(a <= at < b for a, b in fences)
            c, n, t = self.line(text[begin:done], code)
            covered, slots, top = covered + c, slots + n, max(top, t)
            if c or n or code:
                continue
            before, after = text.rfind("\n", 0, max(0, begin - 1)) + 1, text.find("\n", done + 1)
            for a, middle, b in ((before, begin - 1, done), (begin, done, after if after >= 0 else len(text))):
                if 0 <= a < middle < b and a > wrapped:
                    t = self.across(text[a:middle], text[middle + 1 : b])
                    if t:
                        covered, top, wrapped = covered + 1, max(top, t), a
        return covered, slots, top

    def across(self, upper: str, lower: str) -> float:
        """Containment of the sentence that begins in the upper line and goes on in the lower one; 0 if none does."""
        upper, lower = SENTENCE.split(upper.rstrip())[-1], SENTENCE.split(lower.lstrip())[0]
        if not upper.strip() or not lower or upper[-1] in ".!?。！？" or regex.match(r"[#>|\-*+]|\d+[.)]|```", lower):
            return 0.0
        covered, _, top = self.line(f"{upper} {lower}", False)
        return top if covered else 0.0

    def line(self, line: str, code: bool) -> tuple[int, int, float]:
        covered, slots, top = 0, 0, 0.0
        for window in SENTENCE.split(line):
            plain = MARKUP.sub(" ", window)
            has_slot = SLOT.search(regex.sub(r"`[^`\n]*`", " NAME ", plain)) is not None
            marked = SLOT.sub(" SLOT ", plain.replace("`", " ") if has_slot else plain)
            residue, mention = self.ex.best(tokens(NAMED.sub(" NAME ", marked)))
            if has_slot:
                if not code and mention < 0.6:
                    slots, top = slots + 1, 1.0
            elif residue and mention < COVER and not code:
                covered, top = covered + 1, max(top, residue)
        return covered, slots, top


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each token of the exemplars occurs, and the number of documents, over all of them.

    Partial counts per task, summed by token; the result has as many rows as the exemplars have tokens.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, df, n = vocabulary(), {}, 0
        find = regex.compile(r"\p{Han}|(?:(?!\p{Han})\p{L})+")
        han = any(regex.match(r"\p{Han}", w) for w in words)
        for b in batches:
            for t in b["t"]:
                n += 1
                low = t.lower()
                found = set(low.translate(SPLIT).split()) if low.isascii() or not han else set(find.findall(low))
                for w in found & words:
                    df[w] = df.get(w, 0) + 1
        yield pd.DataFrame({"token": ["", *df], "n": [n, *df.values()]})

    rows = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = {r["token"]: r["n"] for r in rows}
    return {k: v for k, v in out.items() if k}, out.get("", 0)


SPLIT = {i: " " for i in range(128) if not chr(i).isalpha()}


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, covered, slots, score): one row for each document with residue; score is the highest containment.

    Two passes over the documents (frequencies, then windows) without a shuffle of texts. Every window of every whole text
    is looked up. Null, empty and blank texts give no row; a row that occurs twice gives two rows.
    """
    df, n = document_frequency(docs, text)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 0.1 for t in vocabulary()}
    top = max(idf.values(), default=1.0)
    idf |= {"SLOT": 0.5, "NAME": 0.5, "NUM": 0.5} | dict.fromkeys(AROUND, 0.2)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(idf)
        for b in batches:
            out = [(k, *c) for k, t in zip(b["k"], b["t"]) if (c := score(t))[0] or c[1]]
            yield pd.DataFrame(out, columns=["k", "covered", "slots", "score"]) if out else b[["k"]].iloc[:0].assign(covered=0, slots=0, score=0.0)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInPandas(run, f"k {kind}, covered int, slots int, score double").withColumnRenamed("k", key)


def found(docs: DataFrame) -> DataFrame:
    return scores(docs).select("doc_id").distinct()
