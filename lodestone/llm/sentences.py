"""Problem 8: sentence units of texts in any language and script, with their places.

Candidates are generated by one scan: line structure (blank lines, items of lists), white space
between Thai characters, terminators, and the delimiters around them, kept on a stack. The
full stops and ellipses among them, which alone are ambiguous, are classified by a
maximum-entropy (logistic) model with features of the tokens on either side: the token,
its class (initial, digits by their number, with dots inside, kind of abbreviation), length, case,
script, and what follows. It is trained here on reliable boundaries: stops at the end of a
paragraph with the first token of another one, against stops after titles and before numbers of
references, before small letters after an abbreviation or a short token that the sample never has without its stop, and before other punctuation. The
sample of documents it is fitted on is bounded by ``SAMPLE``; every text is split as a whole.

Null, empty and blank texts, and texts without a letter or digit, have no units. Offsets
count code points. Repeated rows come out as often as they stand, other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import bounded_sample
from lodestone.session import table

#: Documents on which the model is fitted, at most.
SAMPLE = 1500
SIZE = 1 << 16
#: A reporting verb stands among so many words behind a quotation, or twice as many letters of a script without spaces.
REPORTED_WITHIN = 16

# Abbreviations that stand before a name, before a number, and that may stand last.
TITLES = frozenset(
    "dr mr mrs ms prof rev lt gen col capt sgt st mt hon gov sen rep fr hr mgr mm m sra srta sr d dña ste proff adm cmdr pres messrs mme mlle me "
    "проф акад доц г-н г-жа ул пос гор им ст डॉ प्रो श्री श्रीमती पं कु أ د م vs cf i.e e.g z.b d.h u.a lt vgl geb gest ca env approx aprox p.ej p bzw sog inkl ggf evtl "
    "ee см напр т.е т.к тыс ок нач кон сев юж ver v ed eds hrsg c.-à-d c.a viz incl str bes al.i ing dipl lic arq ดร พ.ศ ค.ศ".split()
)
REFERENCES = frozenset(
    "fig figs sec secs app no nos vol vols p pp ch chap art arts al núm num n nr abb tab s bd kap abs ziff pág pag págs cap caps t par §  стр рис гл табл разд ст п पृ सं चित्र रु क्र ref refs eq eqs item ann anm anh rn sp ex".split()
)
LAST = frozenset(
    "etc usw inc ltd co corp jr sr p.m a.m u.s u.k u.s.a e.u ph.d m.sc b.sc m.a b.a ff f s.a ee.uu т.д т.п др руб г гг в вв млн млрд min hrs hr sec ca bzw al dept dist est a.d b.c d.c m.d u.n uu a d c ss jh chr jan feb mar apr jun jul aug sep sept oct nov dec mio mrd st tel".split()
)
# Beginnings of verbs that report speech.
REPORTS = re.compile(
    r"\b(?:said|says|asked|asks|wrote|writes|shouted|replied|answered|added|cried|whispered|noted|told|warned|explained|remarked|called|"
    r"sagt\w*|fragt\w*|schrieb|schreibt|rief|meint\w*|antwortet\w*|erklärt\w*|flüsterte|ergänzte|"
    r"dit|demand\w+|écri\w+|cria|répond\w+|ajouta|expliqua|murmura|déclara|affirma|"
    r"dijo|pregunt\w+|escribi\w+|grit\w+|respondi\w+|añadi\w+|explic\w+|declar\w+|afirm\w+|"
    r"сказал\w*|спросил\w*|написал\w*|ответил\w*|крикнул\w*|добавил\w*|заметил\w*|произнес\w*)\b"
    r"|[说說问問道写寫喊答]|^\s*(?:と|って)|पूछा|कहा|लिखा|बोला|बोली|سأل|قال|كتب|صرخ|أجاب|أضاف|ถาม|กล่าว|พูด"
)
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", '"': '"'}
QUOTES = frozenset("“„«「『\"")
CLOSERS = ")]}）］】”“»」』》\"’'"
STRONG = frozenset("!?。！？؟।॥｡")
EVENT = re.compile(r"(?P<term>[.!?…。！？؟।॥｡]+)|(?P<delim>[()\[\]{}（）［］【】“”„«»「」『』《》\"])|(?P<thai>(?<=[฀-๿])\s+(?=[฀-๿]))")
BLANK = re.compile(r"\r?\n(?:[^\S\n]*\n)+")
ITEM = re.compile(r"[^\S\n]*(?:[-*•‣◦–—·▪●○■□➤+]|\(?\d{1,3}[.)]|[٠-٩०-९๐-๙]{1,3}[.)])[^\S\n]+\S")
BREAKS = frozenset("()[]{}\"“”„«»‘¿¡（）「」『』,;:/–—")
AFTER = re.compile(r"(\s*)([(\[{\"“„«‘'¿¡（「『—–*_\s]*)([^\W_]*)(.?)", re.S)
NEXT = re.compile(r"\s*")
CLAUSE_END = re.compile(r"[.!?。！？؟।…]")
CLAUSE_WORDS = re.compile(rf"(?:\s*\S+){{0,{REPORTED_WITHIN}}}")
CLAUSE_LETTERS = re.compile(rf"(?:\W*\w){{0,{2 * REPORTED_WITHIN}}}")
SAYS = frozenset("说說问問道写寫喊答")
ALNUM = re.compile(r"[^\W_]")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


#: Words before an ordinal.
ORDINAL = frozenset("die der das dem den des am vom zum zur im ein eine einer einem einen jede jeder jeden und bis".split())


def token_start(text: str, start: int, at: int, kept: list[int]) -> int:
    """Where the token that ends before ``at`` begins. ``kept`` has the last stop asked for and its token's start, so that a token full of stops is walked through once."""
    i = at
    while i > start and text[i - 1] not in BREAKS and not text[i - 1].isspace():
        i -= 1
        if i == kept[0] and kept[1] >= start:
            i = kept[1]
            break
    kept[:] = at, i
    return i


def token_before(text: str, start: int, at: int, kept: list[int] | None = None) -> str:
    """The token that a stop at ``at`` stands behind; of a short number, with the word before it."""
    token = text[token_start(text, start, at, kept if kept is not None else [-1, -1]) : at]
    if token and not token.isascii():
        token = CJK.sub(" ", token).rpartition(" ")[2]
    for mark in "'’":
        token = token.rpartition(mark)[2] or token
    if token.isdigit():
        i = at - len(token)
        while i > start and (text[i - 1].isdigit() or text[i - 1] in ".,\u00a0\u202f'"):
            i -= 1
        while not text[i].isdigit():
            i += 1
        if at - i > len(token):
            return text[i:at]
        if len(token) < 3:
            j = at - len(token)
            while j > start and not text[j - 1].isalnum() and text[j - 1] != "_":
                j -= 1
            i = j
            while i > start and text[i - 1].isalpha():
                i -= 1
            return f"{text[i:j].lower()} {token}" if i < j else token
        return token
    return token if ALNUM.search(token) else ""


VOWELS = frozenset("aeiouyäöüáéíóúàèêâîôûëïаеёиоуыэюя")


def _class_before(token: str) -> str:
    low = token.lower()
    if not token:
        return "none"
    if " " in token:
        word = token.partition(" ")[0]
        return "ordinal" if word in ORDINAL else "counted" if word in REFERENCES else "digits"
    if token.isdigit():
        return f"digits{min(len(token), 5)}"
    bare = low.lstrip("-'’")
    if bare in TITLES:
        return "title" if bare not in LAST else "titlelast"
    if bare in REFERENCES:
        return "reference"
    if bare in LAST:
        return "last"
    if 2 <= len(token) <= 4 and token[0].isupper() and token[1:].islower() and not VOWELS & set(low):
        return "title"  # letters cut out of a word, such as Pvt
    if len(token) == 1:
        return "initial" if token.isupper() or not (token.isupper() or token.islower()) else "letter"
    if "." in token:
        if re.fullmatch(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,3}", token):
            return "dotted"
        return "number" if token[-1].isdigit() else "name"
    if any(c.isdigit() for c in token):
        return "number"
    return "short" if len(token) <= 2 else "word"


def _class_after(gap: str, opened: str, word: str, then: str) -> str:
    if not word:
        return "open" if opened.strip() else ("end" if not then else "sign" + then)
    c = word[0]
    if c.isdigit():
        return "digit"
    if then == "." and word.lower() in LAST:
        return "abbreviation"
    if c.isupper() or c.istitle():
        return "upper" if len(word) > 1 or then != "." else "capital."
    if c.islower():
        return "mixed" if any(x.isupper() for x in word) else "lower"
    return "uncased"


class BoundaryModel:
    """Maximum-entropy model of full stops; answers are kept by their features' values."""

    def __init__(self) -> None:
        self.weights = np.zeros(SIZE)
        self.bias = 0.0
        self.starters: dict[str, int] = {}
        self.abbreviations: frozenset[str] = frozenset()
        self.words: frozenset[str] = frozenset()
        self.kept: dict[tuple, bool] = {}

    def __getstate__(self):
        return (self.weights, self.bias, self.starters, self.abbreviations, self.words)

    def __setstate__(self, state):
        self.weights, self.bias, self.starters, self.abbreviations, self.words = state
        self.kept = {}

    def features(self, mark: str, before: str, gap: str, opened: str, word: str, then: str) -> list[int]:
        b, a = _class_before(before), _class_after(gap, opened, word, then)
        low, nxt = before.lower().partition(" ")[0], word.lower()
        if b in ("word", "short"):
            b = "seen" if low in self.abbreviations else b if low in self.words or len(low) > 5 else "strange"
        s = self.starters.get(nxt, 0)
        e = "ellipsis" if len(mark) > 1 or mark == "…" else "stop"
        names = [
            "e" + e, f"b{e}{b}", f"a{e}{a}", f"c{e}{b}|{a}", f"w{low}", f"wa{low}|{a}", f"s{s}", f"bs{b}|{s}", f"as{a}|{s}", f"bas{b}|{a}|{s}",
            f"l{min(len(before), 8)}", f"o{bool(opened.strip())}|{b}",
        ]
        if s:
            names.append(f"n{nxt}")
            names.append(f"bn{b}|{nxt}")
        return [zlib.crc32(x.encode()) & (SIZE - 1) for x in names]

    def ends(self, mark: str, before: str, gap: str, opened: str, word: str, then: str) -> bool:
        nxt = word if word.lower() in self.starters or len(word) < 2 else ("Xx" if word[0].isupper() else word)
        key = (mark, before if len(before) < 4 or not before[0].isdigit() else "0" * min(len(before), 5) + before[-1:], opened.strip()[:1], nxt, then if not word or len(word) == 1 else "")
        got = self.kept.get(key)
        if got is None:
            got = bool(self.weights[self.features(mark, before, gap, opened, word, then)].sum() + self.bias > 0)
            if len(self.kept) < 500_000:
                self.kept[key] = got
        return got


def _inside_token(text: str, at: int, end: int, before: str) -> bool:
    """Whether a single stop with no space after it belongs to a number, version, name of a file or the like."""
    m = re.compile(r"([^\W\d_]+)(\.?)(\S?)").match(text, at + 1, end)
    if not m:
        # digits or signs follow: no end, but for a closing or opening mark, which the caller has seen
        return True
    word, dot, then = m.groups()
    if CJK.match(word):
        return True
    if not word[0].isupper() or len(word) > 1 and word[1].isupper() and len(word) < 4:
        return True
    if dot and then and then not in ".…\"”»)":
        return True  # config.Name.yaml
    tail = before.rpartition(".")[2]
    if len(tail) < 2 and not tail.isdigit():
        return True  # U.K, Ph.D
    return False


class Splitter:
    def __init__(self, model: BoundaryModel) -> None:
        self.model = model

    def units(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        at = 0
        for m in BLANK.finditer(text):
            self._block(text, at, m.start(), out)
            at = m.end()
        self._block(text, at, len(text), out)
        return out

    def _add(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start and ALNUM.search(text, start, end):
            out.append((start, end))

    def _block(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        if start >= end:
            return
        if "\n" not in text[start:end] and not ITEM.match(text, start, end):
            self._prose(text, start, end, out)
            return
        # Runs of lines: each item with the lines that go on with it, and the prose between items.
        at, part, item, prior = start, start, False, ""
        while at < end:
            stop = text.find("\n", at, end)
            stop = end if stop < 0 else stop + 1
            line = text[at:stop]
            if ITEM.match(line):
                marker = line.lstrip()[:1]
                if at == start or item or not (marker.isdigit() or marker in "–—-") or prior[-1:] in ".!?:…。！？;" or prior[-1:] in CLOSERS:
                    self._add(text, part, at, out) if item else self._prose(text, part, at, out)
                    part, item = at, True
            if line.strip():
                prior = line.rstrip()
            at = stop
        self._add(text, part, end, out) if item else self._prose(text, part, end, out)

    def _prose(self, text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        unit = start
        stack: list[tuple[str, bool]] = []  # what closes it, and whether it opened the unit
        skip = start
        last = {w: text.rfind(w, start, end) for w in CLOSERS}
        kept = [-1, -1]
        looked, said = start, False  # whether the unit so far has a letter or digit, as far as it was looked through
        for m in EVENT.finditer(text, start, end):
            at, stop = m.span()
            if at < skip:
                continue
            kind = m.lastgroup
            if kind == "thai":
                if not stack:
                    self._add(text, unit, at, out)
                    unit = stop
                continue
            if kind == "delim":
                c = text[at]
                if stack and c in stack[-1][0]:
                    _, first = stack.pop()
                    if stack:
                        continue
                    k = at - 1
                    while k > unit and text[k].isspace():
                        k -= 1
                    if text[k] in ".…" or text[k] in STRONG:
                        if self._ends_closed(text, at, stop, end, c, first, text[k], k, unit):
                            to = self._closing(text, stop, end)
                            self._add(text, unit, to, out)
                            unit = skip = to
                    continue
                want = OPENERS.get(c)
                if want is None:
                    continue
                if any(last[w] > at for w in want):
                    if looked < unit:
                        looked, said = unit, False
                    said = said or ALNUM.search(text, looked, at) is not None
                    looked = at
                    stack.append((want, not said))
                continue
            if stack:
                continue
            mark = m.group()
            to = self._closing(text, stop, end)
            if self._ends(text, at, stop, to, end, mark, unit, kept):
                self._add(text, unit, to, out)
                unit = skip = to
        self._add(text, unit, end, out)

    def _closing(self, text: str, at: int, end: int) -> int:
        """After the closing marks at this place that aren't also opening ones before a word."""
        while at < end and text[at] in ")]}）］】”»」』》’'\"“":
            if text[at] in "\"“'’" and at + 1 < end and not text[at + 1].isspace() and text[at + 1] not in CLOSERS + ".,;:!?":
                break
            at += 1
        return at

    def _ends_closed(self, text: str, at: int, stop: int, end: int, closer: str, first: bool, last: str, k: int, unit: int) -> bool:
        """Whether a unit ends after a quotation or bracket that a terminator stands last in."""
        gap, opened, word, then = AFTER.match(text, stop, end).groups()
        begin = NEXT.match(text, stop, end).end()
        if begin == end:
            return True
        rest = text[begin : begin + 2]
        if rest[0] in ",;:.!?…、，；：。！？؟،؛।" or rest[0] in ")]}）」』" or (rest[0] in "—–-" and closer in "»”“\"」』"):
            return False
        cls = _class_after(gap, opened, word, then)
        if closer in ")]}）］】":
            return first
        if first:
            if cls == "lower":
                return False
            stopped = CLAUSE_END.search(text, begin, end)
            upto = stopped.start() if stopped else end
            near = CLAUSE_WORDS.match(text, begin, upto) if not CJK.match(rest[0]) else CLAUSE_LETTERS.match(text, begin, upto)
            found = REPORTS.search(near.group())
            if found and not opened.strip():
                if CJK.match(rest[0]):
                    # the reporting verb stands at the clause's end
                    return not (rest.startswith(("と", "って")) or text[begin:upto].rstrip()[-1:] in SAYS)
                return False
            return True
        if rest.startswith(("と", "って")):
            return False
        return cls != "lower"

    def _ends(self, text: str, at: int, stop: int, to: int, end: int, mark: str, unit: int, kept: list[int]) -> bool:
        after = text[to : to + 1] if to < end else ""
        if any(c in STRONG for c in mark):
            return after not in ",;:，；：、)" or after == ""
        gap, opened, word, then = AFTER.match(text, to, end).groups()
        if not gap and not opened and not word and not then:
            return True  # the end of the block
        if NEXT.match(text, to, end).end() == end:
            return True
        prev, nxt = text[at - 1 : at], (opened.strip() + word)[:1]
        if "฀" <= prev <= "๿" or "฀" <= (word[:1] or " ") <= "๿":
            return False
        before = token_before(text, unit, at, kept)
        single = mark == "."
        if single and not gap and to == stop:
            if opened and opened.strip() and not opened.strip()[0] in "*_—–":
                pass
            elif _inside_token(text, at, end, before):
                return False
        if not single and CJK.match(prev or " "):
            return False  # an ellipsis inside a sentence without spaces
        if then in ",;:" and not word:
            return False
        if CJK.match(prev or " ") and single:
            return bool(gap)
        return self.model.ends("." if single else "…", before, gap, opened, word, then)


def examples(text: str, rng: random.Random, starts: list[tuple[str, str, str]], plain: Counter | None = None) -> Iterator[tuple[tuple, int]]:
    """Reliable boundaries of a text, and reliable stops that are none, as arguments of ``features``."""
    for block in BLANK.split(text):
        if ITEM.match(block) or len(block) < 30:
            continue
        core = block.rstrip()
        if core.endswith((".", "…")) and starts:
            mark = "." if not core.endswith(("..", "…")) else "…"
            before = token_before(core, 0, len(core.rstrip(".…")))
            for _ in range(2):
                opened, word, then = rng.choice(starts)
                yield (mark, before, " ", opened, word, then), 1
            opened, word, then = rng.choice(starts)
            if rng.random() < 0.5:  # sentences may start with a small letter
                yield (mark, before, " ", opened, word.lower(), then), 1 if mark == "." else 0
        for m in re.finditer(r"\.{1,3}|…", core):
            at, stop = m.span()
            if stop >= len(core):
                continue
            gap, opened, word, then = AFTER.match(core, stop).groups()
            if not gap or at == 0 or CJK.match(core[at - 1]):
                continue
            before = token_before(core, 0, at)
            mark = "." if m.group() == "." else "…"
            b, a = _class_before(before), _class_after(gap, opened, word, then)
            if mark == "…":
                if a == "lower":
                    yield (mark, before, gap, opened, word, then), 0
                elif a == "upper":
                    yield (mark, before, gap, opened, word, then), 1
            elif plain is not None and a == "lower" and b in ("word", "short") and not plain[before.lower()] and len(before) <= 5:
                yield (mark, before, gap, opened, word, then), 0  # never seen without its stop
            elif b == "title" or (b == "reference" and a in ("digit", "capital.")):
                yield (mark, before, gap, opened, word, then), 0
            elif b in ("last", "titlelast") and a == "abbreviation":
                yield (mark, before, gap, opened, word, then), 0
            elif a == "lower" and b in ("titlelast", "last", "initial", "dotted", "reference", "short", "seen", "letter"):
                yield (mark, before, gap, opened, word, then), 0
                # The same with a token that is in no list, so that the model doesn't learn the lists alone.
                if before.isalpha() and before.isascii() and len(before) > 1:
                    for _ in range(3):
                        made = "".join(rng.choice("bcdfghjklmnpqrstvwxz" if i % 2 else "aeiou") for i in range(rng.randint(3, 5)))
                        yield (mark, made.title() if rng.random() < 0.5 else made, gap, opened, word, then), 0
            elif b == "ordinal" or (a == "lower" and b in ("digits", "digits1", "digits2")):
                yield (mark, before, gap, opened, word, then), 0
            elif b == "initial" and a in ("upper", "capital."):
                yield (mark, before, gap, opened, word, then), 0


def fit(texts: list[str], seed: int = 11, epochs: int = 5) -> BoundaryModel:
    rng = random.Random(seed)
    texts = [t for t in texts if t]
    starts: list[tuple[str, str, str]] = []
    stops, plain, small = Counter(), Counter(), Counter()
    at_end: set[str] = set()
    for t in texts:
        for block in BLANK.split(t):
            if ITEM.match(block) or len(block) < 30:
                continue
            _, opened, word, then = AFTER.match(block.lstrip()).groups()
            if word and not CJK.match(word) and not "฀" <= word[0] <= "๿":
                starts.append((opened, word, then))
            core = block.rstrip()
            if core.endswith("."):
                at_end.add(core[token_start(core, 0, len(core) - 1, [-1, -1]) : len(core) - 1].lower())
            for m in re.finditer(r"([^\W\d_]{2,12})(\.?)(\s+[a-zß-ÿа-я])?", block):
                w = m.group(1).lower()
                if m.group(2):
                    stops[w] += 1
                    small[w] += m.group(3) is not None
                else:
                    plain[w] += 1
    model = BoundaryModel()
    # Tokens that nearly always have a stop, often before a small letter, and never at a paragraph's end.
    model.abbreviations = frozenset(w for w, n in stops.items() if n >= 4 and plain[w] <= n // 20 and small[w] >= n // 3 and w not in at_end)
    model.words = frozenset(plain)
    first = Counter(w.lower() for _, w, _ in starts)
    model.starters = {w: (2 if n >= 8 else 1) for w, n in first.items() if n >= 3}
    rows, labels = [], []
    for t in texts:
        for args, y in examples(t, rng, starts, plain):
            rows.append(model.features(*args))
            labels.append(y)
    if not rows:
        return model
    y = np.array(labels, dtype=np.float64)
    grad2, order, gen = np.full(SIZE, 1e-6), np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        gen.shuffle(order)
        for chunk in np.array_split(order, max(1, len(order) // 64)):
            flat = np.concatenate([rows[i] for i in chunk])
            owner = np.repeat(np.arange(len(chunk)), [len(rows[i]) for i in chunk])
            z = np.bincount(owner, weights=model.weights[flat], minlength=len(chunk)) + model.bias
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chunk]
            g = np.bincount(flat, weights=err[owner], minlength=SIZE)
            at = np.unique(flat)
            grad2[at] += g[at] ** 2
            model.weights[at] -= 0.2 * (g[at] / np.sqrt(grad2[at]) + 1e-3 * model.weights[at])
            model.bias -= 0.02 * err.mean()
    return model


def split_column(df: DataFrame, ident: str, text: str, model: BoundaryModel) -> DataFrame:
    """``(ident, sent_start, sent_end)``: one row for each unit, with no shuffle."""
    kind = df.schema[ident].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        for b in batches:
            owners, starts, ends = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                u = splitter.units(t)
                owners += [i] * len(u)
                starts += [x[0] for x in u]
                ends += [x[1] for x in u]
            ids = b.column(0).take(pa.array(owners, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[ident, "sent_start", "sent_end"])

    return df.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, sent_start bigint, sent_end bigint")


def train(df: DataFrame, text: str, sample: int = SAMPLE) -> BoundaryModel:
    """The model of at most ``sample`` documents, by the hash of their text; without any, no stop before more text ends a unit."""
    some = df.filter(F.length(text) > 0).select(F.col(text).alias("t"))
    return fit(bounded_sample(some, "t", sample))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return split_column(docs, "doc_id", "text", train(docs, "text"))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Letters and digits of each document that lie in its units, which don't overlap: all of them, but for stretches that are no unit."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    u = p8_found(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("sent_start", "sent_end")).alias("u"))  # the units of one text
    inside = F.expr("aggregate(transform(u, x -> length(regexp_replace(substring(text, cast(x.sent_start + 1 as int), cast(x.sent_end - x.sent_start as int)), '[^\\\\p{L}\\\\p{N}]+', ''))), 0, (a, x) -> a + x)")
    return docs.join(u, "doc_id").select("doc_id", inside.cast("long").alias("n_letters"))


QUERIES = {"p8_found": p8_found, "p8_covered": p8_covered}
SQL = {
    "p8_covered": "SELECT doc_id, length(regexp_replace(text, '[^\\pL\\pN]+', '', 'g')) AS n_letters FROM documents WHERE length(regexp_replace(text, '[^\\pL\\pN]+', '', 'g')) > 0",
}
