"""Problem 3: broken prompt and response pairs.

Each pair gets at most one defect, tested in this order:

* ``empty``: null, no letter or digit at all, or a placeholder for a missing value.
* ``refusal``: an automaton over the phrases of ``REFUSALS`` reads the response, and another over classes of words,
  which takes a sentence where the answerer, a denial and an act of answering meet; what is left
  without the sentences that it hits and closing courtesies must be next to nothing.
* ``copy``: the response is read through a suffix automaton of the prompt's words; the runs of
  two or more words that it finds must cover nearly all of the response, and of the prompt
  its beginning too, so that a sentence which the prompt asks to repeat isn't a copy.
* ``language``: votes of frequent function words, and scripts, for prompt and response;
  prompts that ask for a translation are left out. The request is looked for in each sentence of
  the whole prompt outside its quotations: a verb that asks, not the word translation alone.
* ``truncated``: the last sentence of a response in sentences is read with a stack of
  delimiters, and a logistic model of sentence ends decides whether it is complete. The model is
  trained here on sentences of the responses that another sentence follows, and on the same
  sentences broken off; its sample is bounded by ``SAMPLE`` responses. Whole texts are judged.

Null prompts are blank prompts: only what needs no prompt is tested. Repeated rows give one
row. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import WORD, bounded_sample, words
from lodestone.session import table

#: Responses of which the model of sentence ends is trained, at most.
SAMPLE = 4_000
#: Weight of a whole sentence against one broken off: where both read alike, it counts as whole.
WHOLE = 4.0
#: Weights of the model of sentence ends.
SIZE = 1 << 18

# Placeholders for a missing value, as bare forms.
PLACEHOLDERS = frozenset(
    "na nan null none nil tbd tba blank empty undefined missing notavailable noanswer nodata novalue todo placeholder "
    "notapplicable unavailable void unspecified nullnull naan keineangabe leer sansobjet vide vacio vacío sindatos noresponse answerhere "
    "notprovided noanswerprovided answermissing nonegiven xxx ka".split()
)
# Phrases of refusals in words, by language.
REFUSALS = """
able to answer|unable to answer|unable to help|unable to assist|unable to respond|unable to provide|able to help|able to assist|able to respond
won t be able to|will not be able to|can t help|cannot help|can not help|can t answer|cannot answer|can not answer|can t assist|cannot assist|can not assist
can t respond|cannot respond|can t provide|cannot provide|can t give|cannot give|can t discuss|cannot discuss|can t comment|cannot comment|can t say|must decline|have to decline|i decline
decline to answer|decline to discuss|decline to respond|i must refuse|i refuse|i d rather not|i would rather not|i prefer not|allowed to answer|allowed to discuss|permitted to answer
no response can be given|no answer can be given|not given anything that would let me|you will have to ask somebody else|have to ask someone else|my guidelines
keep me from replying|keep me from answering|i m not allowed|i am not allowed|i m not permitted|i am not permitted|i don t feel comfortable|not comfortable answering|against my guidelines|beyond what i
outside of what i am|outside what i|i have no answer|i have nothing to say|i do not know the answer|i don t know the answer|not in a position to|i can not do that|i can t do that|i cannot do that
ich kann diese frage nicht|kann ich nicht helfen|kann ich nicht beantworten|kann ich nicht antworten|nicht helfen|nicht beantworten|diese bitte ablehnen|muss ich ablehnen|ich muss ablehnen|anfrage ablehnen|möchte ich mich nicht äußern
möchte mich dazu nicht äußern|darf ich hierzu nicht|darf ich nicht|keine auskunft|auskunft darf ich|ist es mir nicht möglich|ist mir nicht möglich|meine richtlinien|meine vorgaben|bin ich nicht befugt|bin nicht befugt|jemand anderen fragen|nicht weiterhelfen|liegt mir nichts vor|ich kann dazu nichts|kann ich nichts sagen|ich darf diese|ich darf dazu|ist mir nicht erlaubt|außerhalb dessen was ich
je ne peux pas répondre|je ne peux pas vous aider|je ne peux pas aider|je ne peux répondre|ne peux pas y répondre|je dois refuser|je dois décliner|je préfère ne pas|je suis autorisé|je ne suis pas autorisé|m est impossible de|je ne suis pas en mesure|mes consignes|mes directives
aucune réponse ne peut|je ne saurais répondre|je refuse de|je n ai pas le droit|il ne m est pas possible|je ne peux rien dire|je ne peux pas donner|demander à quelqu un d autre|vous adresser à quelqu un
no puedo responder|no puedo contestar|no puedo ayudar|no puedo dar|debo rechazar|tengo que rechazar|prefiero no|no me es posible|no estoy autorizado|no se me permite|mis normas|mis directrices|mis instrucciones|no me está permitido|no puedo hablar|lo que puedo responder|lo que se me permite
no me permiten|me impiden|no soy capaz de responder|no estoy en condiciones|tendrá que preguntar|preguntar a otra persona|no puedo atender|resulta imposible|me es imposible|no me corresponde|no tengo permiso
я не могу ответить|не могу помочь|вынужден отказать|我无法回答|我不能回答|无法提供帮助|お答えできません|回答できません|لا أستطيع الإجابة|मैं उत्तर नहीं दे सकता
"""
# Words that stand beside a refusal without being an answer.
COURTESY = re.compile(
    r"something else|anything else|consult|specialist|sorry|apolog|unfortunately|as an assistant|please|thank|leider|tut mir leid|entschuldig|wenden sie|fachmann|fachleute|fachperson|noch etwas|désolé|malheureusement|regrette|"
    r"spécialiste|autre chose|veuillez|lo siento|por desgracia|lamentablemente|disculp|especialista|consulte|algo más|otra cosa|perdón|understand|hope|verständnis|compréhension|comprensión",
    re.I,
)
# Frequent function words, by language.
STOPWORDS = {
    "en": "the of and to in is was were that for with on as by at from an which would this had not are be it who what when where how they their did does after before why under into because been than then there these those while should could its about no yes do over".split(),
    "de": "der die das und zu den des dem ist war ein eine einer einem einen mit von auf für im nicht als auch nach bei aus dass sich wird wurde wer wie wann warum am um zum zur oder aber sie ich es an so vor über unter seit ohne durch obwohl trotzdem diese dieser".split(),
    "fr": "le la les des du et un une est était dans que qui pour avec sur au aux par en ce cette il elle ne pas plus sous à a d l qu n s se ses son sa quel quelle comment pourquoi quand où avant après selon sans chez mais ou puis bien".split(),
    "es": "el la los las de del y un una es era en que con por para se su sus al lo no como más pero fue ha qué quién cuándo cómo dónde sin sobre antes después según tras muy o entre le cuando desde aunque esta este".split(),
}
VOTES = {w: [k for k, v in STOPWORDS.items() if w in v] for v0 in STOPWORDS.values() for w in v0}
TRANSLATE = re.compile(r"\b(translat\w*|übersetz\w*|tradui\w*|traduz\w*|traduc\w*|tradur\w*|tradú\w*|перев[ео]\w*|say|sagt|dit|dice)\b|[译譯訳]|แปล|अनुवाद|ترجم", re.I)
_LANGUAGE = (
    r"(?:(?:the |el |le |l['’]|o |das |lo )?(?:english|french|german|spanish|russian|chinese|mandarin|japanese|arabic|hindi|thai|italian|portuguese|korean|dutch|polish|turkish|latin|greek|hebrew|ukrainian|swedish|danish|czech|"
    r"englisch|französisch|deutsch|spanisch|russisch|chinesisch|japanisch|arabisch|thailändisch|italienisch|portugiesisch|koreanisch|niederländisch|polnisch|türkisch|latein|griechisch|"
    r"anglais|français|allemand|espagnol|russe|chinois|japonais|arabe|thaï|italien|portugais|coréen|néerlandais|polonais|turc|grec|"
    r"inglés|francés|alemán|español|castellano|ruso|chino|japonés|árabe|tailandés|italiano|portugués|coreano|neerlandés|polaco|turco|latín|griego)(?:e|en|es)?\b"
    r"|(?:my|your|another|any other|meine|ihre|eine andere|une autre|otro|otra|su|mi|votre|ma)\s+(?:own\s+)?(?:language|sprache|langue|lengua|idioma)\b)"
)
_TARGET = rf"\b(?:into|to|in|ins|nach|en|vers|al|a|à|au)\s+{_LANGUAGE}|\bl['’]{_LANGUAGE}|\bна\s+(?:\w+ск(?:ий|ом)\b|хинди\b|иврит\b|латынь\b)"
_LEAD = r"^[\W\d_]*(?:(?:please|kindly|now|then|first|next|finally|also|and|just|task|bitte|nun|jetzt|dann|und|s['’]il (?:vous|te) pla[iî]t|veuillez|merci de|maintenant|puis|et|por favor|ahora|luego|y|пожалуйста|теперь|затем|и)\b\W*)*"
_VERB = r"(?:translate|übersetzen|übersetze|übersetz|traduis|traduisez|traduire|traduce|traduzca|traduzcan|traducid|traducir|tradúce\w*|tradúzca\w*|traduza|traduzir|traduci|traducete|tradurre)\b"
_NOUN = r"(?:translation|übersetzung|traduction|traducción|tradução|traduzione)\b"
# Sentences that ask for a translation, in small letters. The first need no language.
ASKS = re.compile(
    rf"{_LEAD}{_VERB}|{_LEAD}переведи(?:те)?\b(?=.*(?:\bна\b|текст|предложени|фраз|отрыв|абзац|слов|это))"
    rf"|\b(?:please|kindly|(?:can|could|would|will) (?:you|someone|anyone)(?: please| kindly)?|help me(?: to)?|help us(?: to)?)\W+translate\b"
    rf"|\b(?:bitte|kannst du|können sie|könnten sie|könntest du|würden sie)\b.*\bübersetz(?:en|e)\b|\b(?:veuillez|merci de|(?:peux|pouvez|pourriez|pourrais)[- ](?:tu|vous))\W+(?:me\W+)?traduire\b"
    rf"|\b(?:por favor|puedes|puede|podrías|podría)\W+(?:usted\W+)?traduc(?:ir\w*|e)\b"
    r"|请[^。！？]*(?:翻译|译)(?!记忆)|翻[译譯](?=成|为|為|到|一下|下面|以下|下列|这|這|上[文面述])|[译譯](?:成|为|為)|把[^。！？]*翻[译譯](?!记忆)|翻訳(?=して|し、|せよ|しなさい|をお願い|をして|を頼)|訳(?=して|せ|しなさい)"
    r"|(?:ช่วย|โปรด|กรุณา|จง)แปล|แปล.*เป็น|अनुवाद\s*(?:करें|कीजिए|कीजिये|करो|कर\b|करना|दें|दीजिए|चाहिए)|^\W*ترجم(?:ي|وا)?\b|\bترجم(?:ي|وا)?\b.*\bإلى\b|(?:يرجى|الرجاء|من فضلك)\W+ترجمة|\bترجمة\b.*\bإلى\s+(?:اللغة\b|ال\w+ية\b)"
)
# The rest need a target language: a verb amid a sentence, and requests for the noun.
_AMID = re.compile(
    r"(?:\b(?:and|then|now|you|also|just|first|or|me|us|must|should)|[,;)–—-])\s*translate\b|\b(?:you|your|me|us|i|please|task|asked|goal)\b.*\bto translate\b"
    r"|\b(?:übersetze|übersetzen|übersetz|traduis|traduisez|traduire|traduzca|traducid|traducir|traduza|traduzir|tradurre)\b|\b(?:переведи(?:те)?|перевести)\b"
)
_SAY = re.compile(r"^\W*(?:how (?:do|would|can|does) (?:you|one|i|we) say|wie sagt man|comment dit[- ]on|cómo se dice)\b")
_TARGETED = re.compile(_TARGET)
_WANTED = re.compile(
    rf"{_LEAD}(?:give|provide|write|make|produce|prepare|offer|add|show|send|i need|i want|i would like|i['’]d like|what is|what['’]s|(?:can|could|would|will) you|gib|geben sie|schreibe|schreiben sie|erstelle|erstellen sie|wie lautet|was ist|ich brauche|"
    rf"donne|donnez|écris|écrivez|fais|faites|propose|proposez|quelle est|il me faut|da|dé|dame|deme|déme|escribe|escriba|haz|haga|cuál es|necesito|quiero)\b.*"
    rf"(?:{_NOUN}(?!\s+memor).*(?:{_TARGET})|{_LANGUAGE}\s+{_NOUN}(?!\s+memor)|{_NOUN}\s+(?:(?!memor)\w+\s+)?{_LANGUAGE})|{_LEAD}(?:сделай(?:те)?|дай(?:те)?|напиши(?:те)?)\b.*\bперевод\b"
)
QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|‘[^‘’]*’(?!\w)|(?<!\w)\"[^\"]*\"(?!\w)|「[^「」]*」|『[^『』]*』")
CLAUSES = re.compile(r"[.!?…:\n。！？：؟।]+")
SCRIPT = re.compile(r"(?P<cyr>[Ѐ-ӿ])|(?P<ara>[؀-ۿ])|(?P<dev>[ऀ-ॿ])|(?P<tha>[฀-๿])|(?P<kan>[぀-ヿ])|(?P<han>[一-鿿])|(?P<lat>[A-Za-zÀ-ɏ])")
FOREIGN = re.compile(r"[Ѐ-ӿ؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿]")
LIST_LINE = re.compile(r"^\s*(?:[-*•‣◦–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s")
OPEN, CLOSE = "([{“„«‘", ")]}”“»’"
ENDS = re.compile(r"(?<=[.!?…])[\"”»“’)\]]*\s+(?=[\"“«„(\[¿¡]*\s?[A-ZÀ-ÞА-Я0-9])|(?<=[。！？])[”」』）]*")


class PhraseAutomaton:
    """Phrases of words as an automaton with failure links (over words, so none starts inside one)."""

    def __init__(self, phrases: list[str]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.hit = [False]
        for p in phrases:
            at = 0
            for w in p.split():
                if w not in self.go[at]:
                    self.go[at][w] = len(self.go)
                    self.go.append({})
                    self.hit.append(False)
                at = self.go[at][w]
            self.hit[at] = True
        self.fail = [0] * len(self.go)
        queue = [s for s in self.go[0].values()]
        for s in queue:
            for w, t in self.go[s].items():
                f = self.fail[s]
                while f and w not in self.go[f]:
                    f = self.fail[f]
                self.fail[t] = self.go[f][w] if w in self.go[f] and self.go[f][w] != t else 0
                self.hit[t] |= self.hit[self.fail[t]]
                queue.append(t)

    def found(self, ws: list[str]) -> bool:
        at = 0
        for w in ws:
            while at and w not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(w, 0)
            if self.hit[at]:
                return True
        return False


_PHRASES = [p.strip() for p in REFUSALS.replace("\n", "|").split("|") if p.strip()]
REFUSAL = PhraseAutomaton([p for p in _PHRASES if p.isascii() or not re.search("[一-鿿぀-ヿ]", p)])
REFUSAL_CJK = re.compile("|".join(re.escape(p) for p in _PHRASES if re.search("[一-鿿぀-ヿ]", p)))


class SuffixAutomaton:
    """All runs of a sequence, as the smallest automaton that reads them."""

    def __init__(self, items: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(items):
            cur = self._state(self.length[last] + 1, i)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, self.end[q])
                    self.next[clone] = dict(self.next[q])
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, end: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def covered(self, ws: list[str], least: int) -> tuple[list[bool], set[int]]:
        """Which of ``ws`` lie in runs of ``least`` or more that the sequence has; and the places there."""
        runs: list[tuple[int, int, int]] = []  # last place, length, last place in the sequence
        at = n = 0
        for i, w in enumerate(ws):
            before = (i - 1, n, self.end[at])
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at = self.next[at][w]
                n += 1
            if n <= before[1] and before[1] >= least:
                runs.append(before)  # it could not go on
        if n >= least:
            runs.append((len(ws) - 1, n, self.end[at]))
        here, there = [0] * (len(ws) + 1), [0] * (max(self.end) + 2)
        for last, k, end in runs:
            here[last - k + 1] += 1
            here[last + 1] -= 1
            there[end - k + 1] += 1
            there[end + 1] -= 1
        inside, depth = [], 0
        for x in here[:-1]:
            depth += x
            inside.append(depth > 0)
        places, depth = set(), 0
        for i, x in enumerate(there):
            depth += x
            if depth > 0:
                places.add(i)
        return inside, places


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """Nothing but the prompt, perhaps with labels, slips or said twice."""
    if len(prompt) < 3 or len(response) < 0.6 * len(prompt):
        return False
    known = set(prompt)
    if sum(w in known for w in response) < 0.7 * len(response):
        return False
    least = 2
    inside, places = SuffixAutomaton(prompt).covered(response, least)
    head = prompt[: max(3, min(6, len(prompt) // 3))]
    of_head = len(places & set(range(len(head)))) / len(head)
    new = len(response) - sum(inside)
    # Labels and slips: a few words, in proportion to the length.
    return new <= 2 + 0.2 * len(response) and len(places) >= 0.75 * len(prompt) and of_head >= 0.5


def is_empty(response: str | None) -> bool:
    bare = "".join(WORD.findall((response or "").lower()))
    return not bare or (len(bare) <= 20 and bare in PLACEHOLDERS)


def sentences(text: str) -> list[str]:
    return [s for s in ENDS.split(text.strip()) if s and s.strip()]


# Words of the answerer, of a denial, and of acts of answering, by language.
ANSWERER = {"en": "i we me my us assistant", "de": "ich wir mir mich uns", "fr": "je j me m nous", "es": "yo me mi nosotros puedo debo tengo prefiero lamento siento voy podemos"}
DENIAL = {
    "en": "not t cannot unable never nothing no unanswered refuse decline refrain avoid pass", "de": "nicht kein keine keinen keinerlei nichts unmöglich ablehnen verweigern unbeantwortet",
    "fr": "pas aucune aucun rien jamais impossible refuser refuse décliner décline réponse", "es": "no nada nunca ninguna ningún imposible rechazar negar declinar",
}
ACT = {
    "en": "answer answering respond responding response reply replying help assist provide share discuss discussing comment say tell address advise speak talk into unanswered question questions request topic information access",
    "de": "beantworten antworten antwort helfen auskunft sagen äußern mitteilen weiterhelfen information informationen zugriff eingehen frage unbeantwortet anfrage",
    "fr": "répondre réponse aider fournir dire discuter commenter information informations accès question aborder parler demande", "es": "responder contestar respuesta ayudar decir proporcionar hablar comentar información acceso pregunta solicitud",
}
#: Of each word, by language, the classes that it has: 1 for the answerer, 2 for a denial, 4 for an act.
CLASSES: dict[str, dict[str, int]] = {}
for _bit, _of in ((1, ANSWERER), (2, DENIAL), (4, ACT)):
    for _k, _v in _of.items():
        for _w in _v.split():
            CLASSES.setdefault(_w, {})[_k] = CLASSES.get(_w, {}).get(_k, 0) | _bit
#: Words of the longest sentence that the automaton of classes takes.
SAID = 30


def declines(sw: list[str]) -> bool:
    """Whether a sentence's words bring the automaton of classes, whose state is the set of classes met, to its end in one language."""
    if len(sw) > SAID:
        return False
    state = dict.fromkeys(ANSWERER, 0)
    for w in sw:
        for k, bits in CLASSES.get(w, {}).items():
            state[k] |= bits
    return 7 in state.values()


def _refuses(s: str, sw: list[str]) -> bool:
    return REFUSAL.found(sw) or declines(sw) or REFUSAL_CJK.search(s) is not None


def is_refusal(response: str, ws: list[str]) -> bool:
    met = dict.fromkeys(ANSWERER, 0)
    for w in ws:
        for k, bits in CLASSES.get(w, {}).items():
            met[k] |= bits
    if not (REFUSAL.found(ws) or REFUSAL_CJK.search(response) or (7 in met.values() and any(declines(words(x)) for x in sentences(response)))):
        return False
    rest = 0
    for s in sentences(response):
        sw = words(s)
        if not (_refuses(s, sw) or COURTESY.search(s)):
            rest += len(sw)
    return rest <= 6


def language(text: str, ws: list[str]) -> str | None:
    """A language or script by votes; null where the votes are few or close."""
    scripts = Counter(m.lastgroup for m in SCRIPT.finditer(text)) if FOREIGN.search(text) else Counter({"lat": 1})
    other = {k: n for k, n in scripts.items() if k != "lat"}
    if sum(other.values()) > 0.3 * sum(scripts.values()) and sum(other.values()) >= 5:
        if other.get("kan", 0) >= 0.1 * sum(other.values()):
            return "kan"
        return max(other, key=lambda k: other[k])
    votes: Counter[str] = Counter()
    for w in ws:
        for k in VOTES.get(w, ()):
            votes[k] += 1 / len(VOTES[w])
    top = votes.most_common(2)
    if not top or top[0][1] < 2 or (len(top) > 1 and top[0][1] < 1.5 * top[1][1]):
        return None
    return top[0][0]


def asks_translation(prompt: str) -> bool:
    """Whether a sentence of the prompt, outside what it quotes, asks for a translation."""
    if not TRANSLATE.search(prompt):
        return False
    outside = QUOTED.sub(" ", prompt)
    if not WORD.search(outside):
        outside = prompt  # wholly quoted
    for s in CLAUSES.split(outside.lower()):
        if ASKS.search(s) or _WANTED.search(s) or ((_AMID.search(s) or _SAY.search(s)) and _TARGETED.search(s)):
            return True
    return False


# --- sentence ends ---------------------------------------------------------------------------


@dataclass
class EndModel:
    """Logistic model of whether a text's last sentence is complete."""

    vocabulary: frozenset[str]
    weights: np.ndarray
    bias: float

    def features(self, sentence: str) -> list[int]:
        stack: list[str] = []
        straight = 0
        for c in sentence:
            if c in "([{“„«":
                if c == "“" and stack and stack[-1] == "„":
                    stack.pop()
                else:
                    stack.append(c)
            elif c in ")]}”»":
                if stack:
                    stack.pop()
                else:
                    straight += 2
            elif c == '"':
                straight += 1
        core = sentence.strip().rstrip(".!?…,;:-–—'’ \t\n")
        closing = core[-1:] if core[-1:] in ')]}”»“"' else ""
        raw = WORD.findall(core)
        known = self.vocabulary
        seq, keys = [], []
        for w in raw:
            low = w.lower()
            if low[0].isdigit():
                low = "0"
            elif low not in known:
                low = "N" if w[0].isupper() else "r"
            elif len(keys) < 3:
                keys.append(low)
            seq.append(low)
        n = len(seq)
        names = [f"open{len(stack)}{straight % 2}", f"close{closing}{len(stack)}", f"n{min(n, 30) // 3}", f"k{' '.join(keys[:2])}"]
        tail = seq[-4:]
        for k in range(1, 5):
            names.append(f"t{k}" + " ".join(tail[-k:]))
        key = " ".join(keys[:2])
        names += [f"x{key}|{' '.join(tail[-2:])}", f"y{keys[0] if keys else ''}|{' '.join(tail[-2:])}", f"z{key}|{tail[-1] if tail else ''}"]
        for w in set(seq):
            names.append("b" + w)
            names.append(f"p{key}|{w}")
        names += [f"g{a} {b}" for a, b in zip(seq, seq[1:])]
        return [zlib.crc32(x.encode()) & (SIZE - 1) for x in names]

    def score(self, sentence: str) -> float:
        """Log-odds that the sentence is broken off."""
        return float(self.weights[self.features(sentence)].sum() + self.bias)


def broken(sentence: str, rng: random.Random) -> str | None:
    """The sentence broken off at a random place that takes away a word or more."""
    spots = [m.start() for m in re.finditer(r"\s+", sentence)]
    if len(spots) < 3:
        return None
    if rng.random() < 0.7:
        return sentence[: rng.choice(spots[2:])]
    start = spots[2]
    limit = spots[-1] + 1
    return sentence[: rng.randrange(start, limit)] if limit > start else None


def fit_ends(texts: list[str], seed: int = 7, epochs: int = 6) -> EndModel:
    """Trained on sentences that another sentence follows, whole and broken off."""
    rng = random.Random(seed)
    whole = [s for t in texts if t and not any(LIST_LINE.match(x) for x in t.split("\n")) for s in sentences(t)[:-1] if len(words(s)) >= 4]
    seen = Counter(w for s in whole for w in set(words(s)))
    least = max(3, len(whole) // 2000)
    model = EndModel(frozenset(w for w, k in seen.items() if k >= least and not w[0].isdigit()), np.zeros(SIZE), 0.0)
    rows: list[list[int]] = []
    labels: list[int] = []
    for s in whole:
        rows.append(model.features(s))
        labels.append(0)
        rows.append(model.features(s.rstrip(".!?… ")))
        labels.append(0)
        for _ in range(2):
            if b := broken(s, rng):
                rows.append(model.features(b + rng.choice(["", "", ".", "…", ",", ";", "..."])))
                labels.append(1)
    if not rows:
        return model
    grad2 = np.full(SIZE, 1e-6)
    order = np.arange(len(rows))
    gen = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    for epoch in range(epochs):
        if epoch == 2:
            # A sentence broken off where it could have ended reads as a whole one: no example of either.
            z = np.array([model.weights[r].sum() for r in rows]) + model.bias
            order = np.flatnonzero((y == 0) | (z > -1))
        gen.shuffle(order)
        for chunk in np.array_split(order, max(1, len(order) // 64)):
            flat = np.concatenate([rows[i] for i in chunk])
            owner = np.repeat(np.arange(len(chunk)), [len(rows[i]) for i in chunk])
            z = np.bincount(owner, weights=model.weights[flat], minlength=len(chunk)) + model.bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chunk]) * np.where(y[chunk] > 0, 1.0, WHOLE)
            g = np.bincount(flat, weights=err[owner], minlength=SIZE)
            at = np.unique(flat)
            grad2[at] += g[at] ** 2
            model.weights[at] -= 0.2 * (g[at] / np.sqrt(grad2[at]) + 1e-4 * model.weights[at])
            model.bias -= 0.02 * err.mean()
    model.weights = model.weights.astype(np.float32)
    return model


#: Log-odds from which a last sentence counts as broken off.
BROKEN_FROM = 3.0
# Words with which a sentence doesn't end.
DANGLING = frozenset(
    "the a an of with and or which because from than that if but nor our their der die das dem den des ein eine einer einem einen und oder mit für von weil dass zum zur am im "
    "la le les des du de et ou avec dans pour qui que un une au aux el los las del y o con para una por al lo".split()
)


def is_truncated(response: str, ws: list[str], model: EndModel) -> bool:
    if len(ws) < 4 and not re.search("[一-鿿぀-ヿ]", response):
        return False
    if any(LIST_LINE.match(x) for x in response.strip().split("\n")):
        return False
    if re.search("[一-鿿぀-ヿ฀-๿]", response) and len(SCRIPT.findall(response)) < 2 * len(re.findall("[一-鿿぀-ヿ฀-๿]", response)):
        return len(ws[-1] if ws else "") >= 3 and not re.search(r"[。！？!?.][”」』）\"]*\s*$", response) and bool(re.search("[。！？]", response) or len(response) > 12)
    parts = sentences(response)
    last = parts[-1] if parts else ""
    lw = words(last)
    if len(parts) == 1 and sum(w in VOTES for w in lw) < 2 and len(lw) < 5:
        return False  # a bare name or label
    if len(lw) < 3 and len(parts) > 1 and not any(w in VOTES for w in lw):
        return False
    return model.score(last) + 4.0 * (lw[-1:] != [] and lw[-1] in DANGLING) >= BROKEN_FROM


def defect(prompt: str | None, response: str | None, model: EndModel, task: str | None = None) -> str | None:
    if is_empty(response):
        return "empty"
    rw, pw = words(response), words(prompt)
    if is_refusal(response, rw):
        return "refusal"
    if is_copy(pw, rw):
        return "copy"
    if task != "translate":
        a, b = language(prompt or "", pw), language(response, rw)
        if a and b and a != b and not asks_translation(prompt or ""):
            return "language"
    if is_truncated(response, rw, model):
        return "truncated"
    return None


# --- Spark -----------------------------------------------------------------------------------


def best_answer(answers: Column, scores: Column) -> Column:
    """The answer with the highest score, the first of equals; the first where no score is given."""
    top = F.array_position(scores, F.array_max(scores))
    place = F.when(F.array_max(scores).isNull(), F.lit(1)).otherwise(top)
    return F.when(F.size(answers) > 0, F.try_element_at(answers, place.cast("int")))


def judged(df: DataFrame, model: EndModel) -> DataFrame:
    """``(rec_table, rec_id, defect)`` of ``df(rec_table, rec_id, prompt, response, task)``, with no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            t, i, p, r, k = (c.to_pylist() for c in b.columns)
            found = [(t[j], i[j], d) for j in range(len(t)) if (d := defect(p[j], r[j], m, k[j]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.string()) for n in range(3)], names=["rec_table", "rec_id", "defect"])

    return df.select("rec_table", "rec_id", "prompt", "response", "task").mapInArrow(run, "rec_table string, rec_id string, defect string")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").select(
        F.lit("queries").alias("rec_table"), F.col("id").alias("rec_id"), F.col("query").alias("prompt"),
        best_answer(F.col("answers"), F.col("answer_scores")).alias("response"), F.lit(None).cast("string").alias("task"),
    )
    t = table(spark, d, "text_pairs").select(
        F.lit("text_pairs").alias("rec_table"), F.col("pair_id").alias("rec_id"), F.col("inputs").alias("prompt"), F.col("targets").alias("response"), F.lower("task").alias("task")
    )
    return q.unionByName(t)


def train(df: DataFrame, sample: int = SAMPLE) -> EndModel:
    """The model of sentence ends of at most ``sample`` responses with several words, by the hash of their text."""
    return fit_ends(bounded_sample(df.filter(F.length("response") > 60).select("response"), "response", sample))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d)
    return judged(df, train(df)).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of defective records by table and defect."""
    return p3_found(spark, d).groupBy("rec_table", "defect").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL: dict[str, str] = {}
