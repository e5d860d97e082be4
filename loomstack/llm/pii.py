"""Problem 3: personal data inside free text, found and replaced by typed placeholders.

Regular expressions propose spans; checksums (Luhn, mod 97, ISO 7064, the weighted sums of national numbers) and nearby context words
move the score of a span, and a span counts from THRESHOLD on. Types are tried from the most to the least specific and a span taken
by one is closed to the next, so that a name inside an e-mail address is no name. Names need evidence: known name parts, or words nearby
that speak of a person (labels, titles, salutations, relations, verbs of talking and meeting, in the four languages of the corpus); words that
are only capitalised are no names.

One pass of Arrow batches, no shuffle but the final distinct, which is local to the rows of one content. Rows without any trigger
(Aho-Corasick automata over known name parts and context words, and expressions for digits and contexts) leave the pass at once.

Defined results: null and empty texts give no rows and stay as they are; texts of any length are read whole; a value that occurs
several times in a field is reported once; repeated content ids are treated as one content; an empty name list leaves names to
context alone; a name list of any size gives the same result: up to MAX_NAME_PARTS it goes to every task, a longer one is joined with the
words of the texts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.runtime import table

THRESHOLD = 0.6
#: The list of known name parts is a dictionary, sent to every task; beyond this size it is joined with the words of the texts instead.
MAX_NAME_PARTS = 50_000

# ---- shapes -----------------------------------------------------------------------------------------------------------------
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+'\-]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.%+\-@/]){_LOCAL}@{_LABEL}(?:\.{_LABEL})+")
EMAIL_SPELT = re.compile(
    rf"(?<![\w.%+\-@/]){_LOCAL}\s*[\[({{]\s*at\s*[\])}}]\s*{_LABEL}(?:(?:\.|\s*[\[({{]\s*dot\s*[\])}}]\s*){_LABEL})+", re.I)
_IN_URL = re.compile(r"://[^\s/\"']*$")
#: Endings that make name@2x.png a file and not a mailbox.
FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp ico css js ts tsx jsx py go rb gd json yaml yml toml md txt html xml sh lock".split())

_EXT = r"(?:,?\s*(?:ext\.?|extension|x|Durchwahl|poste)\s*\d{1,5})?"
PHONES = tuple(re.compile(p + _EXT + r"(?![\w])(?!\.\d)") for p in (
    r"(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,7}",  # +44 20 7946 0186
    r"(?<![\w+.\-/])00\d{1,3}(?:[ .\-/]\(?\d{1,5}\)?){2,7}",  # 001-512-555-0126
    r"(?<![\w+.\-/])(?:1[ .\-])?\(\d{3}\) ?\d{3}[ .\-]\d{4}",  # (303) 555-0127
    r"(?<![\w+.\-/])(?:1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}",  # 415.555.0194
    r"(?<![\w+.\-/])0\d(?:([ .\-])\d{2})(?:\1\d{2}){3}",  # 01.99.00.45.22
    r"(?<![\w+.\-/])0\d{2,4}/ ?\d{3,8}(?:-\d{1,4})?",  # 030/23125-171
    r"(?<![\w+.\-/])0\d{2,4} \d{3,4} \d{3,4}",  # 020 7946 0186
    r"(?<![\w+.\-/])0\d{1,4}-\d{1,4}-\d{4}",  # 03-0173-0065
    r"(?<![\w+.\-/])1?[2-9]\d{2}[2-9]\d{6}",  # 14155550169
    r"(?<![０-９])０[０-９]{1,4}[－‐−\-][０-９]{1,4}[－‐−\-][０-９]{4}(?![０-９])",
))
BARE_PHONE = re.compile(r"1?\d{10}$")
PHONE_CONTEXT = re.compile(r"(?:phone|tel|call|ring|fax|mobil|連絡先|電話|whatsapp)[^\n]{0,24}$", re.I)
NOT_PHONE_CONTEXT = re.compile(r"(?:ssn|passport|national id|id_no|steuer-id|iban|ticket)\W{0,12}(?:number\W)?$", re.I)

ID_CONTEXT = re.compile(
    r"(?:ssn|social security|passport|national id|identity (?:card|number)|id[_ ]?(?:no|number)|steuer-?id|tax id|nino|nir|personalausweis|マイナンバー|個人番号)\W{0,4}(?:(?:number|no|is|nr)\W{1,3})?['\"]?$", re.I)

# ---- places -----------------------------------------------------------------------------------------------------------------
# Words that open a sentence and so cannot be the second word of a town.
OPENERS = frozenset(
    "A An And As At Add After All Also Before Because Bitte Build But By Call Can Check Clone Code Column Commit Could Das Decorate Dem Den Der Des Die "
    "Did Do Does Done Each Ein Eine Elle Er Es Explique Fix For From Had Has Have He Her His How I Ich If Il Im In Is It Its Ja Keep Kontakt La Le Les Let "
    "Look Make Mit Move My Nein New Next No Not Now Nous Nur Of Offset On Or Our Pinned Please Remove Rename Run See Send She Should Sie Signed So Steuer "
    "Tel That The Their Then There These They This Those To Try Two Undo Une Un Und Use Vous Warum Was We When Where Which Who Why Wie Wir With You Your Écrire Ship".split())
_TOWN_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-Za-zÀ-ÿ][a-zß-öø-ÿ]*)*(?![A-Za-zÀ-ÿ])"
_STREET_EN = r"(?:Street|Str|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Ter|Close|Crescent|Cres|Row|Quay|Parkway|Pkwy|Alley|Hill|Walk|Highway|Hwy)"
ADDRESS_EN = re.compile(
    rf"(?<![\w.])\d{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+\.? ){{1,4}}?{_STREET_EN}\b\.?(?: [NSEW]{{1,2}}\b)?(?:,? (?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|No)\.? ?#?\w{{1,6}})?, (?={_TOWN_WORD})")
_TOWN_EN = re.compile(rf"({_TOWN_WORD})(?: ({_TOWN_WORD}))?(?: ({_TOWN_WORD}))?")
_ZIP = re.compile(r",? (?:[A-Z]{2} )?\d{5}(?:-\d{4})?(?![\w])")
_TOWN_1 = rf"(?:(?:Bad|Sankt|St\.|Saint|Sainte|La|Le|Les|Neu|Alt|Groß|Klein) )?{_TOWN_WORD}"
ADDRESS_DE = re.compile(
    r"(?<![\w\-])(?:(?:Am|An|Im|In|Zum|Zur|Auf|Unter|Obere[rn]?|Untere[rn]?|Alte[rn]?|Neue[rn]?|Hohe[rn]?|Lange|Große[rn]?|Kleine[rn]?)(?: (?:der|dem|den))? )?"
    rf"[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*(?: (?:Straße|Str\.|Weg|Allee|Platz))?\.? \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_TOWN_1}")
ADDRESS_FR = re.compile(
    r"(?<![\w.])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|impasse|quai|place|chemin|allée|cours|route|passage|square|sentier|villa)"
    rf"(?: [\w'’À-ÿ\-]+){{1,6}}, (?:F-)?\d{{5}} {_TOWN_1}")
#: Streets that open with their kind and close with their number, as in Spanish, Italian and Portuguese.
ADDRESS_ES = re.compile(
    r"(?<![\w])(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Rua|Travessa|Largo)(?: (?:de|del|de la|de los|da|do|dos|das|della|dei|di))?"
    rf"(?: [A-ZÀ-ÖØ-Þ][\w'’\-]+){{1,4}},? (?:n[.º°]{{0,2}} ?)?\d{{1,4}}[A-Za-z]?, (?:\d{{5}}|\d{{4}}-\d{{3}}) {_TOWN_1}")
ADDRESS_JA = re.compile(
    r"(?:〒?[0-9０-９]{3}[-－][0-9０-９]{4}[ 　]?)?[一-鿿々ヶ]{2,3}?[都道府県][一-鿿々ヶぁ-ゖァ-ヺー]{1,24}?[0-9０-９]{1,4}(?:(?:[-－‐−]|丁目|番地?)[0-9０-９]{1,4}){0,3}号?")

# ---- names ------------------------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]{2,})*")
HAN = "一-鿿々ヶ"
_TITLE = r"\b(?:dr|prof|mr|mrs|(?<!\d)(?<!\d )ms|herrn?|frau|mme|mlle)\.? "
STRONG_LEFT = re.compile(
    r"(?:\b(?:full_?|user_?|first_?|last_?)?name[\"']?\s*[:=]\s*[\"']?|\bfor user |\bbelongs to |\btalked to |\bcustomer: |担当は ?|(?:signed-off|co-authored|reviewed|acked|tested)-by: "
    rf"|\b(?:kontakt|contact|ansprechpartner): |--owner[ =][\"']?|--author[ =][\"']?|{_TITLE})$", re.I)
#: Ways to speak of or to a person; they introduce only words that are written like names.
SPOKEN = (
    r"\b(?:client|patient|ansprechpartnerin|attn|assignee|owner|author|reporter|requester|recipient|sender|employee|mitarbeiter(?:in)?|kund(?:e|in)|responsable|auteur|cliente): "
    r"|(?:reported|suggested|requested)-by: "
    r"|\b(?:my|our|his|her|their|your|the) (?:colleague|coworker|co-worker|manager|boss|friend|neighbou?r|teammate|client|customer|patient|sister|brother|wife|husband|mother|father|doctor|lawyer|landlord|tenant|intern|assistant)(?: called| named|,)? "
    r"|\b(?:meine?|unsere?|der|die|seine?|ihre?) (?:kolleg(?:e|in)|chef(?:in)?|freund(?:in)?|kund(?:e|in)|nachbar(?:in)?|schwester|bruder|frau|mann|ärztin|arzt) "
    r"|\b(?:mon|ma|notre|son|sa|votre) (?:collègue|cheff?e?|amie?|voisine?|cliente?|patron(?:ne)?|sœur|frère|femme|mari|médecin) "
    r"|\b(?:dear|hello|hi|hey|hallo|liebe|lieber|guten tag|bonjour|bonsoir|cher|chère|thanks|thank you|danke|merci|regards|cheers|sincerely|grüßen?|cordialement),? "
    r"|\b(?:spoke|speak|speaking|talked|talk|talking|met|meet|meeting|chatted|chat|lunch|interview|appointment) (?:to|with) "
    r"|\b(?:assigned|reports|escalated|handed over|addressed|introduced) to |\bon behalf of |\bmy name is |\bich heiße |\bje m'appelle |\bnamens |\bnommée? "
    r"|\b(?:written|reported|owned|approved|reviewed|managed|signed|requested|filed|hired|taught) (?:by|with) "
    r"|\b(?:ask|asked|told|tell|emailed|phoned|invited?|pinged|contacted|remind|notified|met) "
    r"|\b(?:sprach|spreche|gesprochen|telefoniert|treffen) mit |\b(?:frage?|fragt|rufe?|informiere?|traf) "
    r"|\bcc:? |\baccording to |\bloop(?:ing)? in |\b(?:ping|meeting|interviewed|interviewing|interview|visiting) |\b(?:call|calls|chats|discussion|discussions) with |\b(?:feedback|message|mail|letter|reply|voicemail|news|question) from |\b(?:voicemail|appointment|invoice) for "
    r"|\b(?:laptop|desk|phone|account|badge|office|address|file) of |\b(?:best|kind|warm) regards,\s|\b(?:nachricht|antwort|brief|frage) von |\bwarte auf |\b(?:discussion|entretien|réunion) avec |\b(?:message|lettre|réponse) de |\b(?:madame|monsieur|señora?|signora?|sra?\.) "
    r"|\b(?:parlé|parler|discuté|rendez-vous) (?:à|avec) |\b(?:joindre|contacter|appeler|rencontrer|rencontré|demandez à|prévenir) ")
SPOKEN_LEFT = re.compile(rf"(?:{SPOKEN})$", re.I)
WEAK_LEFT = re.compile(r"(?:\bvon |\bby |\bfrom |\bwith |echo [\"'])$", re.I)
TITLE_LEFT = re.compile(rf"{_TITLE}$", re.I)
#: What follows a person, written in any way.
_RIGHT = r"['’]s machine| id_no| street=| ?さん| <|, reachable| asked for this| darf nicht"
RIGHT = re.compile(_RIGHT + r"|;|\"")
#: What people do and own; it follows only words that are written like names.
SAID = (r"['’]s (?:laptop|desk|phone|account|badge|inbox|calendar|office|house|birthday|manager|e-?mail|passport|report|review|comment|shift)\b"
        r"| (?:said|says|asked|wrote|told|replied|promised|agreed|mentioned|complained|apologi[sz]ed|joined us|called me|emailed|lives (?:in|at)|works (?:at|for))\b"
        r"| (?:(?:is|was|will be) (?:out|away|back|on leave|on holiday|on vacation|on call|sick|absent|late|ill)|will (?:join|call|attend|reply|review)|approved|signed|resigned|retired|phoned|attended|objected|and I|needs access|has the)\b"
        r"| (?:sagte?|schrieb|meinte|fragte|wohnt|arbeitet|bittet)\b| (?:a (?:dit|écrit|demandé|appelé)|habite|travaille)\b| ?(?:様|氏|先生)")
SAID_RIGHT = re.compile(SAID)
TITLES = frozenset("dr prof mr mrs ms herr herrn frau mme mlle sir madam".split())
STOP_NAMES = OPENERS | frozenset("User Name Owner Phone Address Street Mail Email Error Worker Branch Relay Server Session Team Test File World There All Everyone Folks Again Much Very Me Him Them Us Support Engineering Security Studio Cloud Code Hub".split())


@dataclass(frozen=True)
class Lexicon:
    """Known name parts, folded to lower case."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    cjk: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(parts: list[tuple[str, str]]) -> "Lexicon":
        g = frozenset(p.lower() for p, k in parts if p and k == "given")
        f = frozenset(p.lower() for p, k in parts if p and k == "family")
        alt = lambda xs: "|".join(sorted((re.escape(x) for x in xs if re.match(f"[{HAN}]", x)), key=len, reverse=True)) or r"(?!)"
        fam, giv = alt(f), alt(g)
        sep = "[ 　]?"
        return Lexicon(g, f, {
            "known": re.compile(f"(?:{fam}){sep}(?:(?:{giv})|[{HAN}]{{2,3}}(?![{HAN}]))|(?<![{HAN}])[{HAN}]{{2,4}}?{sep}(?:{giv})"),
            "any": re.compile(f"[{HAN}]{{2,4}}[ 　][{HAN}]{{1,4}}(?![{HAN}])|[{HAN}]{{4,8}}(?![{HAN}])")})


# ---- checksums --------------------------------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97_iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iso7064_mod11_10(digits: str) -> bool:
    p = 10
    for c in digits[:-1]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def weighted11(digits: str) -> bool:
    r = sum(int(c) * w for c, w in zip(digits, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2))) % 11
    return (0 if r <= 1 else 11 - r) == int(digits[-1])


def icao_check(text: str) -> bool:
    return sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(text[:-1])) % 10 == int(text[-1])


#: (shape, score of the bare shape, validator of the compact value)
IDS = (
    (re.compile(r"(?<![\w.\-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), 0.2, mod97_iban),
    (re.compile(r"(?<![\w.\-])(?:\d{4}[ \-]){3}\d{4}(?![\w\-])|(?<![\w.\-])\d{15,16}(?![\w\-])"), 0.1, luhn),
    (re.compile(r"(?<![\w.\-])[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?(?![\w\-])"), 0.6, lambda s: len(s) == 15 and 97 - int(s[:13]) % 97 == int(s[13:])),
    (re.compile(r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])"), 0.6, None),
    (re.compile(r"(?<![\w.\-])\d{3} \d{2} \d{4}(?![\w\-])"), 0.5, None),
    (re.compile(r"(?<![\w.\-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"), 0.6, None),
    (re.compile(r"(?<![\w.\-])[A-Z]\d{3}[A-Z]{3}\d{3}(?!\w)|(?<![\w.\-])[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}\d(?!\w)"), 0.4, icao_check),
    (re.compile(r"(?<![\w.\-])\d{12}(?![\w\-])"), 0.2, weighted11),
    (re.compile(r"(?<![\w.\-])\d{11}(?![\w\-])"), 0.2, iso7064_mod11_10),
)


class Spans:
    """Non-overlapping spans of one text, kept in order."""

    def __init__(self) -> None:
        self.at: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.at, (b,))  # the spans that start before b; the last of them ends last
        return not k or self.at[k - 1][1] <= a

    def add(self, a: int, b: int, kind: str) -> None:
        bisect.insort(self.at, (a, b, kind))


def _mails(t: str, s: Spans) -> None:
    if "@" in t:
        for m in EMAIL.finditer(t):
            end = m.end()
            tail, domain = t[end:end + 2], m.group().rpartition("@")[2]
            last = domain.rpartition(".")[2].lower()
            repository = tail[:1] == ":" and tail[1:2].strip() != "" or _IN_URL.search(t[max(0, m.start() - 100):m.start()]) is not None
            if last.isalpha() and len(last) > 1 and last not in FILE_ENDINGS and not repository:
                s.add(m.start(), end, "EMAIL")
            else:
                s.add(m.start(), end, "")  # closed to other types
    if "at" in t:
        for m in EMAIL_SPELT.finditer(t):
            if s.free(*m.span()):
                s.add(*m.span(), "EMAIL")


def _addresses(t: str, s: Spans) -> None:
    for m in ADDRESS_EN.finditer(t):
        town = _TOWN_EN.match(t, m.end())
        end = town.end(1)
        zipped = _ZIP.match(t, end)
        if not zipped and town.group(2) and town.group(2) not in OPENERS:
            end = town.end(2)
            zipped = _ZIP.match(t, end)
            if not zipped and town.group(3) and _ZIP.match(t, town.end(3)):
                end, zipped = town.end(3), _ZIP.match(t, town.end(3))
        end = zipped.end() if zipped else end
        if s.free(m.start(), end):
            s.add(m.start(), end, "ADDRESS")
    for rx in (ADDRESS_ES, ADDRESS_DE, ADDRESS_FR, ADDRESS_JA):
        for m in rx.finditer(t):
            if s.free(*m.span()):
                s.add(*m.span(), "ADDRESS")


def _ids(t: str, s: Spans) -> None:
    for rx, base, valid in IDS:
        for m in rx.finditer(t):
            if not s.free(*m.span()):
                continue
            compact = re.sub(r"[ \-]", "", m.group())
            before = t[max(0, m.start() - 40):m.start()]
            score = base
            if valid and valid(compact):
                score += 0.4 if len(compact) > 12 else 0.15
            if ID_CONTEXT.search(before):
                score += 0.5
            elif before.endswith(";") or (PHONE_CONTEXT.search(before) and BARE_PHONE.match(compact)):
                score += 0.5 if before.endswith(";") else -0.5
            if score >= THRESHOLD:
                s.add(*m.span(), "ID_NUMBER")


def _phones(t: str, s: Spans) -> None:
    for rx in PHONES:
        for m in rx.finditer(t):
            v = m.group()
            end = m.end() - (v.endswith(")") and v.count("(") < v.count(")"))
            n = sum(c.isdigit() for c in re.split(r"\s*(?:ext|x|Durch|poste)", v)[0])
            if not 9 <= n <= 15 or not s.free(m.start(), end):
                continue
            before = t[max(0, m.start() - 40):m.start()]
            base = 0.5 if BARE_PHONE.match(v) else 0.7
            score = base - 0.5 * bool(NOT_PHONE_CONTEXT.search(before)) + 0.2 * bool(PHONE_CONTEXT.search(before))
            if score >= THRESHOLD:
                s.add(m.start(), end, "PHONE")


def _style(w: str) -> str:
    if w.isupper() and len(w) > 1:
        return "U"
    if w.islower():
        return "l"
    return "W" if w[:1].isupper() and all(p[1:].islower() for p in re.split(r"['’\-]", w)) else "?"


def _names(t: str, s: Spans, lex: Lexicon) -> None:
    for m in lex.cjk["known"].finditer(t):
        if s.free(*m.span()):
            s.add(*m.span(), "NAME")
    for m in lex.cjk["any"].finditer(t):
        if s.free(*m.span()) and (STRONG_LEFT.search(t[max(0, m.start() - 30):m.start()]) or RIGHT.match(t, m.end()) and t[m.end()] != ";" or SAID_RIGHT.match(t, m.end())):
            s.add(*m.span(), "NAME")
    toks = [m for m in TOKEN.finditer(t)]
    i = 0
    while i + 1 < len(toks):
        hit = _name_at(t, toks, i, s, lex)
        i = hit if hit else i + 1


def _name_at(t: str, toks: list, i: int, s: Spans, lex: Lexicon) -> int:
    """Index after the name that starts at token i, or 0."""
    a, b = toks[i], toks[i + 1]
    x, y = a.group(), b.group()
    sep = t[a.end():b.start()]
    last, initial = i + 1, len(x) == 1 and x.isupper() and sep == ". "
    if not initial and sep == " " and len(y) == 1 and y.isupper() and i + 2 < len(toks) and t[b.end():toks[i + 2].start()] == ". ":
        last = i + 2
        b = toks[last]
        y = b.group()
    elif not initial and sep not in (" ", ", "):
        return 0
    if ord(x[0]) > 0x24F or ord(y[0]) > 0x24F:
        return 0
    style = _style(y) if initial else _style(x)
    if style == "?" or _style(y) != style and not initial or initial and style == "l":
        return 0
    lx, ly = x.lower(), y.lower()
    if sep == ", ":
        known = (lx in lex.family) + (ly in lex.given)
    elif initial:
        known = 1 + (ly in lex.family) if ly in lex.family else 0
    else:
        known = (lx in lex.given) + (ly in lex.family) or 2 * (lx in lex.family and ly in lex.given)
    if lx in TITLES or known < 2 and (x.title() in STOP_NAMES and not initial or y.title() in STOP_NAMES):
        return 0
    if not s.free(a.start(), b.end()):
        return 0
    if known < 2:
        before = t[max(0, a.start() - 40):a.start()]
        if (style == "W" or initial) and len(y) > 2 and (initial or len(x) > 1) and (SPOKEN_LEFT.search(before) or SAID_RIGHT.match(t, b.end())):
            s.add(a.start(), b.end(), "NAME")
            return last + 1
        before = before[-30:]
        strong = STRONG_LEFT.search(before) is not None
        right = RIGHT.match(t, b.end()) is not None
        weak = right or WEAK_LEFT.search(before) is not None
        if known == 1 and not (style != "l" or strong or weak):
            return 0
        if known == 1 and sep == ", " and not (strong or weak):
            return 0
        if known == 0 and style == "l" and not (right and (strong or WEAK_LEFT.search(before)) or TITLE_LEFT.search(before)):
            return 0
        if known == 0 and not (strong or right and (WEAK_LEFT.search(before) or t[b.end():b.end() + 2] != '"')):
            return 0
        if known == 0 and not strong and t[b.end():b.end() + 1] in ";\"" and not WEAK_LEFT.search(before):
            return 0
    s.add(a.start(), b.end(), "NAME")
    return last + 1


def detect(text: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the personal data in ``text``, in order."""
    if not text:
        return []
    s = Spans()
    _mails(text, s)
    _addresses(text, s)
    _ids(text, s)
    _phones(text, s)
    _names(text, s, lex)
    return [x for x in s.at if x[2]]


def redact(text: str | None, lex: Lexicon) -> str | None:
    """``text`` with every span replaced by its placeholder, such as [EMAIL]; the rest stays as written."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in detect(text, lex):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


# ---- trigger ----------------------------------------------------------------------------------------------------------------
# What each part of detect() cannot do without; the trigger has to hold wherever detect() finds something, so a change there needs one here.
#: Openings of the addresses, numbers and phones; a phone has 9 digits with at most three signs between two of them.
SHAPES = re.compile(
    r"\d(?:[ .\-/()]{0,3}\d){8}|[０-９]{2}|, (?:[DF]-)?(?:\d{5}|\d{4}-\d{3}) [A-ZÀ-ÖØ-Þ]|"
    rf"\d[A-Za-z]? (?:[A-Z][a-z]+\.? ){{1,4}}?{_STREET_EN}\b|[都道府県][一-鿿々ヶぁ-ゖァ-ヺー]{{1,24}}?[0-9０-９]|"
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{3}[A-Z]{3}\d{3}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}\d")
SPELT_AT = re.compile(r"[\[({]\s*at\s*[\])}]", re.I)
_LETTER = r"[^\W\d_]"
#: Names of unknown parts: every left context with a letter behind it, every right context with a letter ahead, and a weak left one with a closing sign.
#: Left contexts are searched in the characters before a name, where a word may begin that is cut in the text; only ``name`` reaches that far.
#: Their $ also matches ahead of a line end.
LABELLED = re.compile(
    rf"name[\"']?\s*[:=]\s*[\"']?\n?{_LETTER}|(?:\bfor user |\bbelongs to |\btalked to |\bcustomer: |担当は ?|(?:signed-off|co-authored|reviewed|acked|tested)-by: "
    rf"|\b(?:kontakt|contact|ansprechpartner): |--(?:owner|author)[ =][\"']?|\b(?:dr|prof|mr|mrs|ms|herrn?|frau|mme|mlle)\.? )\n?{_LETTER}", re.I)
FOLLOWED = re.compile(rf"{_LETTER}(?:{_RIGHT})", re.I)
QUOTED_HAN = re.compile(rf"[{HAN}]\"")
WEAK = re.compile(rf"(?:\bvon |\bby |\bfrom |\bwith |echo [\"'])\n?{_LETTER}(?:{_LETTER}|['’\-])*(?:,? |\. )(?:{_LETTER}\. )?{_LETTER}(?:{_LETTER}|['’\-])*[;\"]", re.I)
#: The ways of SPOKEN_LEFT ahead of a letter that is no small one.
SPOKEN_TO = re.compile(rf"(?i:{SPOKEN})\n?(?![a-z]){_LETTER}")
#: For each of these the words, in lower case, one of which stands wherever it matches, and whether they begin as words do.
CUES = (
    (("name", "担当は", "-by: ", "--owner", "--author"), False),
    (("for user ", "belongs to ", "talked to ", "customer: ", "kontakt: ", "contact: ", "ansprechpartner: ", *(f"{t}{dot} " for t in ("dr", "prof", "mr", "mrs", "ms", "herr", "herrn", "frau", "mme", "mlle") for dot in ("", "."))), True),
    (("s machine", " id_no", " street=", "さん", " <", ", reachable", " asked for this", " darf nicht"), False),
    (('"',), False),
    (("von ", "by ", "from ", "with "), True),
    (("echo '", 'echo "'), False),
    (("-by: ",), False),
    ((*(f"{w}: " for w in ("client", "patient", "ansprechpartnerin", "attn", "assignee", "owner", "author", "reporter", "requester", "recipient", "sender", "employee", "mitarbeiter", "mitarbeiterin", "kunde", "kundin", "responsable", "auteur", "cliente")), "-by: ",
     "colleague", "coworker", "co-worker", "manager", "boss", "friend", "neighbo", "teammate", "client", "customer", "patient", "sister", "brother", "wife", "husband", "mother", "father", "doctor", "lawyer", "landlord", "tenant", "intern ", "intern,", "intern called",
     "intern named", "assistant", "kolleg", "chef", "freund", "kund", "nachbar", "schwester", "bruder", " frau ", " mann ", "ärztin", "arzt", "collègue", "ami ", "amie ", "voisin", "patron", "sœur", "frère", "femme", "mari ", "médecin",
     "dear", "hello", "hi ", "hi,", "hey", "hallo", "liebe", "guten tag", "bonjour", "bonsoir", "cher ", "cher,", "chère", "thank", "danke", "merci", "regards", "cheers", "sincerely", "grüße", "cordialement",
     *(f"{v} {w} " for v in ("spoke", "speak", "speaking", "talked", "talk", "talking", "met", "meet", "meeting", "chatted", "chat", "lunch", "interview", "appointment") for w in ("to", "with")),
     "assigned to ", "reports to ", "escalated to ", "handed over to ", "addressed to ", "introduced to ", "on behalf of ", "my name is ", "ich heiße ", "je m'appelle ", "namens ", "nommé",
     *(f"{v} {w} " for v in ("written", "reported", "owned", "approved", "reviewed", "managed", "signed", "requested", "filed", "hired", "taught") for w in ("by", "with")),
     "ask ", "asked ", "told ", "tell ", "emailed ", "phoned ", "invite", "pinged ", "contacted ", "remind ", "notified ", "met ", *(f"{v} mit " for v in ("sprach", "spreche", "gesprochen", "telefoniert", "treffen")), "frag ", "frage ", "fragt ", "ruf ", "rufe ",
     "informier", "traf ", *(f"{v} {w} " for v in ("parlé", "parler", "discuté", "rendez-vous") for w in ("à", "avec")), "joindre ", "contacter ", "appeler ", "rencontrer ", "rencontré ", "demandez à ", "prévenir ",
      "cc ", "cc: ", "according to ", "loop in ", "looping in ", "ping ", "meeting ", "interviewed ", "interviewing ", "interview ", "visiting ", *(f"{w} with " for w in ("call", "calls", "chats", "discussion", "discussions")),
      *(f"{w} from " for w in ("feedback", "message", "mail", "letter", "reply", "voicemail", "news", "question")), "voicemail for ", "appointment for ", "invoice for ", *(f"{w} of " for w in ("laptop", "desk", "phone", "account", "badge", "office", "address", "file")),
      *(f"{w} von " for w in ("nachricht", "antwort", "brief", "frage")), "warte auf ", *(f"{w} avec " for w in ("discussion", "entretien", "réunion")), *(f"{w} de " for w in ("message", "lettre", "réponse")), "madame ", "monsieur ", "señor ", "señora ", "signor ", "signora ", "s. ", "sr. ", "sra. "), True),
    ((*(f"s {w}" for w in ("laptop", "desk", "phone", "account", "badge", "inbox", "calendar", "office", "house", "birthday", "manager", "email", "e-mail", "passport", "report", "review", "comment", "shift")), "様", "氏", "先生",
     *(f" {w}" for w in ("said", "says", "asked", "wrote", "told", "replied", "promised", "agreed", "mentioned", "complained", "apologi", "joined us", "called me", "emailed", "lives in", "lives at", "works at", "works for", *(f"{v} {w}" for v in ("is", "was", "will be") for w in ("out", "away", "back", "on leave", "on holiday", "on vacation", "on call", "sick", "absent", "late", "ill")),
                         "will join", "will call", "will attend", "will reply", "will review", "approved", "signed", "resigned", "retired", "phoned", "attended", "objected", "and i", "needs access", "has the", "sagt", "schrieb", "meinte", "fragte", "wohnt",
                         "arbeitet", "bittet", "a dit", "a écrit", "a demandé", "a appelé", "habite", "travaille"))), False))
#: The expression that each group of cues calls for.
CONTEXTS = (LABELLED, LABELLED, FOLLOWED, QUOTED_HAN, WEAK, WEAK, SPOKEN_TO, SPOKEN_TO, SAID_RIGHT)
#: Letters that equal i and s when case is ignored, but not in lower case.
_AS_ASCII = str.maketrans("İıſ", "iis")


def trigger(lex: Lexicon):
    """Predicate: may the text hold personal data at all? It holds for every text in which detect() finds something."""
    import ahocorasick

    known, cues = ahocorasick.Automaton(), ahocorasick.Automaton()
    for w in (*lex.given, *lex.family, "\0\0"):
        known.add_word(w, 1)
    kinds: dict[str, tuple[int, int]] = {}  # groups in which the cue counts anywhere, and as the beginning of a word
    for k, (words, bounded) in enumerate(CUES):
        for w in words:
            loose, bound = kinds.get(w, (0, 0))
            kinds[w] = (loose, bound | 1 << k) if bounded and w[0].isalnum() else (loose | 1 << k, bound)
    for w, (loose, bound) in kinds.items():
        cues.add_word(w, (loose, bound, len(w)))
    known.make_automaton()
    cues.make_automaton()
    searches = {}  # distinct expressions with the groups that call for them
    for k, rx in enumerate(CONTEXTS):
        searches[rx.search] = searches.get(rx.search, 0) | 1 << k

    def test(t: str) -> bool:
        if "@" in t or SHAPES.search(t) or SPELT_AT.search(t):
            return True
        low = t.lower()
        if next(known.iter(low), None) is not None:
            return True
        if not t.isascii():
            low = t.translate(_AS_ASCII).lower()
        mask = 0
        for end, (loose, bound, n) in cues.iter(low):
            mask |= loose
            if bound & ~mask and (end < n or not (low[end - n].isalnum() or low[end - n] == "_")):
                mask |= bound
        return bool(mask) and any(mask & groups and search(t) is not None for search, groups in searches.items())

    return test


def lexicon(name_parts: DataFrame) -> Lexicon | None:
    """The dictionary of name parts, or None if it is too long to go to every task."""
    rows = name_parts.select("name_part", "part_kind").where("name_part is not null").distinct().limit(MAX_NAME_PARTS + 1).collect()
    return None if len(rows) > MAX_NAME_PARTS else Lexicon.of([(r[0], r[1]) for r in rows])


_HAN_RUN = re.compile(f"[{HAN}]+")


def words(text: str | None) -> set[str]:
    """Everything in a text that may be a name part, in lower case: words, and up to four Chinese characters in a row."""
    if not text:
        return set()
    out = {m.group().lower() for m in TOKEN.finditer(text)}
    for m in _HAN_RUN.finditer(text):
        r = m.group()
        out.update(r[i:i + n] for n in range(1, 5) for i in range(len(r) - n + 1))
    return out


FIELDS = ("text", "command")


def with_parts(contents: DataFrame, name_parts: DataFrame) -> DataFrame:
    """``contents`` (id, text, command) with ``parts``, the known name parts among each content's own words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, *texts in zip(*(batch.column(n).to_pylist() for n in ("id", *FIELDS))) if i is not None for w in set().union(*map(words, texts))]
            ids, found = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "word"])

    c = contents.select("id", *FIELDS)
    known = name_parts.where("name_part is not null").select(F.lower("name_part").alias("word"), F.col("part_kind").alias("kind")).distinct()
    held = c.mapInArrow(scan, "id long, word string").join(known, "word").groupBy("id").agg(F.collect_set(F.struct("word", "kind")).alias("parts"))
    return c.join(held, "id", "left")


def _readers(lex: Lexicon | None):
    """Function from the parts of a row to (trigger, lexicon)."""
    if lex is not None:
        both = trigger(lex), lex
        return lambda parts: both
    plain = Lexicon.of([])
    none = trigger(plain), plain

    def read(parts):
        return ((lambda t: True), Lexicon.of([(p["word"], p["kind"]) for p in parts])) if parts else none

    return read


def _prepared(contents: DataFrame, names: Lexicon | DataFrame) -> tuple[DataFrame, Lexicon | None]:
    lex = names if isinstance(names, Lexicon) else lexicon(names)
    c = contents.select("id", *FIELDS)
    return (c.withColumn("parts", F.lit(None).cast("array<struct<word:string,kind:string>>")), lex) if lex is not None else (with_parts(c, names), None)


def mentions(contents: DataFrame, names: Lexicon | DataFrame) -> DataFrame:
    """(content_id, field, pii_type, value), one row per value, type, field and content. ``names``: a lexicon, or the table of name parts."""
    schema = pa.schema([("content_id", pa.int64()), ("field", pa.string()), ("pii_type", pa.string()), ("value", pa.string())])
    rows, lex = _prepared(contents.where("text is not null or command is not null"), names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _readers(lex)
        for batch in batches:
            found: list[tuple] = []
            ids, parts = batch.column("id"), batch.column("parts").to_pylist()
            for name in FIELDS:
                for k, value in enumerate(batch.column(name).to_pylist()):
                    if value:
                        test, known = read(parts[k])
                        if test(value):
                            seen = {(kind, value[a:b]) for a, b, kind in detect(value, known)}
                            found += [(ids[k].as_py(), name, kind, v) for kind, v in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([], [], [], []), schema)], schema=schema)

    return rows.mapInArrow(scan, "content_id long, field string, pii_type string, value string").distinct()


def redacted(contents: DataFrame, names: Lexicon | DataFrame) -> DataFrame:
    """(id, text, command) of all contents, personal data replaced."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("command", pa.string())])
    rows, lex = _prepared(contents, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _readers(lex)

        def clean(value, parts):
            if not value:
                return value
            test, known = read(parts)
            return redact(value, known) if test(value) else value

        for batch in batches:
            parts = batch.column("parts").to_pylist()
            cols = [pa.array([clean(v, p) for v, p in zip(batch.column(n).to_pylist(), parts)], pa.string()) for n in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), *cols], schema=schema)

    return rows.mapInArrow(scan, "id long, text string, command string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(table(spark, sf_dir, "event_contents", "id", "text", "command"), table(spark, sf_dir, "name_parts"))
