"""Personal details in free text: a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import bisect
import math
import random
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

#: Common given names of several languages. Standing here is one feature of a name among others; no name is left out for not standing here.
GIVEN = frozenset(
    "adam adrian agnes ahmed aisha alan albert alex alexander alice amina amy ana andre andrea andrew anita anna anne antonio arthur barbara beatriz ben boris brian bruno camila carl carla carlos carmen caroline catherine chen chris christine claire clara claudia daniel david diana diego dmitri edward elena elias elif elisa elizabeth elsa emil emily emma eric erik eva fatima felix fernando fiona francesca frank frida gabriel george giulia greta hana hannah hans harry hassan helen helena henry hugo ibrahim ines ingrid irene isabel ivan jack jacob james jan jana jane javier jean jennifer jessica joan johan john jonas jorge jose joseph juan julia karen karl kate kenji kofi kwame lars laura leila lena leo leon li lin linda lisa louis lucas lucia luis maja marco margaret maria marie mark marta martin mary mateo maya mei michael miguel milan mohammed monica nadia natalia nicolas nina noel nora oliver olga omar oscar pablo paul pedro peter petra philip rafael ravi rebecca richard robert rosa ruth samuel sara sarah sergei simon sofia sophie stefan susan tariq tatiana theo thomas tim tomas vera victor viktor walter wei william yasmin yuki yusuf zanele zoe".split()
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|M|Sr|Sra|Ing|Rev)"
#: Words of firms, places, offices and dates: a sign against a person's name, as a feature.
_NOT_NAME = frozenset(
    "street road lane avenue way close terrace square court holdings group limited ltd inc plc gmbh company corporation capital partners bank university college institute ministry council committee office department board airport station bridge river lake mountain north south east west new old january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday foods energy water media systems mining pharma chemicals logistics materials robotics instruments shipping textiles timber version quarter invoice filing index daily review registry online press service id no school hotel park mill hospital church union trust fund index bay island valley county city port hall house centre center times post news agency".split()
)
#: Words that begin sentences and never stand in a name; runs of capitalised words end at them.
_NEVER = frozenset(
    "a about after again all also although among an and another any are as at be because been before below between both but by can could do each either even every few for from further had has have he her here his how however i if in instead into is it its just like many may meanwhile more most mr mrs ms dr prof my no nobody none nor not of on once one only or other our out over papers per please rivals several she since so some such than that the their them then there these they this those though through to too under unless until up upon us via was we were what when whenever where whereas whether which while who whose why will with within without would yet you your der die das ein eine und im in am auf von zu le la les un une et en du des el los las y una del call write mail parcels contact dear signed tel phone fax email".split()
)
#: What people are called by what they do: a sign of a name beside it, as a feature.
_ROLES = frozenset("director manager president chairman chairwoman chair chief officer secretary treasurer auditor accountant lawyer attorney judge plaintiff defendant witness claimant applicant analyst editor author reporter spokesman spokeswoman spokesperson minister mayor senator professor teacher doctor nurse engineer architect founder owner partner head executive consultant adviser advisor clerk buyer seller tenant landlord captain driver contact trustee".split())
_PARTICLE = r"(?:de|van|von|der|da|di|du|bin|ibn|el|al|dos|den|ter|zu)"
_JOIN = re.compile(rf" |, | {_PARTICLE}(?: (?:la|der|den))? ")
_UP = "A-ZÀ-ÖØ-ÞĆČĎĐĘĚĞĪİŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽΑ-ΩА-ЯЁ"
_CAP = re.compile(rf"(?<![\w@.+\-])(?:[{_UP}]\.|[{_UP}][\w’']*(?:-[{_UP}][\w’']*)*)")
_WORD, _LOWER = re.compile(r"\w+"), re.compile(r"(?<!\w)[a-zß-öø-ÿ][\w]+")
_TITLED = re.compile(rf"\b{_TITLE}\.? $", re.I)
_CAP_BEFORE, _CAP_AFTER, _COMMA_CAP = re.compile(rf"[{_UP}][\w.’-]*,? $"), re.compile(rf" (?:[{_UP}]\.|[{_UP}][\w’-]+)"), re.compile(rf", (?:[{_UP}]\.|[{_UP}]\w+)")
_NUMBER = re.compile(r"(?<![\w.,+(\-])(?:[A-Z]{1,3}[ \-]?)?[+(]?\d(?:(?: ?\(|\) ?|[ .\-/])?\d){5,19}(?:[ \-]?[A-Z])?(?![\w])")
_PLAIN_MAIL = re.compile(r"[\w.+%\-]{1,64} ?@ ?(?:[\w\-]+\.)+[A-Za-z]{2,24}")
_HIDDEN_MAIL = re.compile(r"[\w.+%\-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|<at>| at |\[@\]|\(@\)) ?[\w\-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\[\.\]|\(\.\)) ?|\.)[\w\-]+){1,4}", re.I)
_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Way|Close|Terrace|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Square|Sq\.?|Place|Row|Crescent|Gardens|Grove|Hill|Walk|Mews|Parade|Quay)"
_NAME = rf"[{_UP}][\w’'\-]+(?: [{_UP}][\w’'\-]+){{0,2}}"
_UNIT = r"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Room|No\.?) ?\w{1,5},? )"
_STREETS = (
    ("en", re.compile(rf"(?<![\w.,]){_UNIT}?\d{{1,5}} ?[a-zA-Z]?,? {_NAME} {_KIND}(?!\w)")),
    ("fr", re.compile(rf"(?<![\w.,]){_UNIT}?\d{{1,5}}(?: ?(?:bis|ter|[a-z]))?,? (?:rue|avenue|boulevard|place|quai|chemin|allée|impasse) (?:(?:du|de la|de l['’]|des|de|d['’]) ?)?{_NAME}")),
    ("de", re.compile(rf"(?<!\w)[{_UP}][\w’'\-]*(?:stra(?:ss|ß)e|str\.|straat|weg|gasse|platz|allee|gatan|gate|vej|laan|gracht|plein) \d{{1,5}}(?: ?[a-z](?!\w))?")),
    ("es", re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Viale|Corso|Piazza|Rua|Ulica|ul\.) (?:(?:de la|de los|del|de|da|do) )?{_NAME},? \d{{1,5}}(?: ?[a-z](?!\w))?")),
)
_RUN = re.compile(rf"(?<!\w)[{_UP}][\w’'\-]*+")
_FORM = re.compile(r"\d+|[A-Za-z]+|[^\w]")


def _shape(text: str) -> str:
    """Letters and the lengths of digit runs: 'XA1234567' as 'LL7', '+44 20 7946' as '+2 2 4'."""
    return "".join(str(len(m)) if m.isdigit() else "L" * len(m) if m.isalpha() else m for m in _FORM.findall(text))


def _words_before(text: str, at: int) -> list[str]:
    return re.findall(r"[\w@#]+|[^\w\s]", text[max(0, at - 40) : at].lower())[-3:]


def _words_after(text: str, at: int) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", text[at : at + 40].lower())[:3]


def _number_segments(text: str, out: dict) -> None:
    for m in _NUMBER.finditer(text):
        whole = m.group()
        starts, ends = [m.start()], [m.end()]
        p = re.match(r"[A-Z]{1,3}[ \-]?(?=[+(\d])", whole)
        if p:
            starts.append(m.start() + p.end())
        e = re.search(r"[ \-]?[A-Z]$", whole)
        if e:
            ends.append(m.start() + e.start())
        # a run of digit groups may hold two numbers
        gaps = list(re.finditer(r" (?=[+(\d])", whole))
        starts += [m.start() + g.end() for g in gaps]
        ends += [m.start() + g.start() for g in gaps]
        for a in dict.fromkeys(starts):
            for b in dict.fromkeys(ends):
                digits = sum(c.isdigit() for c in text[a:b])
                if b - a >= 7 and 6 <= digits <= 16 and text[b - 1].isalnum():
                    out[a, b, "phone"] = out[a, b, "id_number"] = None


def _name_segments(text: str, out: dict) -> None:
    """Every run of two to four capitalised words, initials among them, joined by single spaces, a particle or one comma."""
    caps = [(m.start(), m.end(), m.group()) for m in _CAP.finditer(text)]
    n = len(caps)
    for lo in range(n):
        if caps[lo][2].lower().rstrip(".") in _NEVER and not caps[lo][2].endswith("."):
            continue
        comma = 0
        for hi in range(lo + 1, min(n, lo + 4)):
            gap = text[caps[hi - 1][1] : caps[hi][0]]
            if not _JOIN.fullmatch(gap):
                break
            w = caps[hi][2]
            if w.lower() in _NEVER:
                break
            comma += gap == ", "
            if comma > 1:
                break
            if w[-1] != "." or comma:  # initials end a name only after a family name
                out[caps[lo][0], caps[hi][1], "person_name"] = None


def _streets(text: str):
    """Matches of the street forms. Names with the kind in them are tried once per run of word characters, at its first capital, so time stays linear however long a run is."""
    for form, pattern in _STREETS:
        if form == "de":
            yield from filter(None, (pattern.match(text, r.start()) for r in _RUN.finditer(text)))
        else:
            yield from pattern.finditer(text)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Segments that may be a detail, with a type: several boundaries and types for each place, bounded in length."""
    out: dict[tuple[int, int, str], None] = {}
    if "@" in text:
        for m in _PLAIN_MAIL.finditer(text):
            out[m.start(), m.end(), "email"] = None
    if "at" in text or "AT" in text or "@" in text:
        at = 0
        while m := _HIDDEN_MAIL.search(text, at):
            at = re.compile(r"[\w.+%\-]+").match(text, m.start()).end()  # another address may begin after the first word
            out[m.start(), m.end(), "email"] = None
            parts = list(re.finditer(r" dot | ?\[dot\] ?| ?\(dot\) ?|\.", m.group(), re.I))
            for p in parts[1:]:
                out[m.start(), m.start() + p.start(), "email"] = None
    _number_segments(text, out)
    for m in _streets(text):
        out[m.start(), m.end(), "street_address"] = None
        u = re.match(_UNIT, m.group())
        if u and len(u.group()) < len(m.group()):
            out[m.start() + u.end(), m.end(), "street_address"] = None
        tail = re.search(r" [a-z]$|\.$", m.group())
        if tail:
            out[m.start(), m.start() + tail.start(), "street_address"] = None
    _name_segments(text, out)
    return sorted(out)


def _fold(word: str) -> str:
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss").replace("å", "a")))


class Context:
    """What the features of a text's segments share: its addresses, its words in lower case, and where other details may stand."""

    def __init__(self, text: str, segments: list[tuple[int, int, str]]):
        runs = [r for a, b, kind in segments if kind == "email" for r in map(_fold, re.split(r"[^A-Za-z]+", re.split(r"@| at |[\[({]at", text[a:b])[0]))]
        self.mails = {*runs, *(r[1:] for r in runs)}  # an initial may stand before a family name
        self.low = set(_LOWER.findall(text)) if any(kind == "person_name" for _, _, kind in segments) else set()
        others = [(a, b) for a, b, kind in segments if kind != "person_name"]
        self.starts, self.ends = sorted(a for a, _ in others), sorted(b for _, b in others)

    def mailed(self, words: list[str]) -> bool:
        return bool(self.mails) and any(len(f) > 3 and f in self.mails for w in words for f in map(_fold, w.split("-")))

    def near(self, a: int, b: int) -> tuple[bool, bool]:
        """Whether another detail may end shortly before, or begin shortly after."""
        i, j = bisect.bisect_right(self.ends, a) - 1, bisect.bisect_left(self.starts, b)
        return i >= 0 and a - self.ends[i] <= 14, j < len(self.starts) and self.starts[j] - b <= 26


def features(text: str, a: int, b: int, kind: str, context: Context) -> list[str]:
    """Features of a whole segment: its form, its words, and what stands on either side."""
    s = text[a:b]
    before, after = _words_before(text, a), _words_after(text, b)
    prev, nxt = before[-1] if before else "", after[0] if after else ""
    prev2 = before[-2] if len(before) > 1 else ""
    out = ["bias", f"prev={prev}", f"next={nxt}", f"prev2={prev2} {prev}", f"next2={' '.join(after[:2])}"]
    if kind in ("phone", "id_number"):
        shape = _shape(s)
        digits = sum(c.isdigit() for c in s)
        seps = "".join(sorted(set(c for c in s if not c.isalnum())))
        out += [f"shape={shape}", f"digits={digits}", f"seps={seps}", f"letters={''.join(c for c in shape if c == 'L')}", f"groups={len(re.findall(r'[0-9]+', s))}", f"head={s[0] if s[0] in '+(' else '0' if s[0] == '0' else 'L' if s[0].isalpha() else '9'}"]
        out += [f"tailL={s[-1].isalpha()}", f"plain={s.isdigit()}"]
        if a and text[a - 1] in "-/." or re.search(r"\d[ ]$", text[max(0, a - 2) : a]):
            out.append("cut before")
        if re.match(r"[ \-./]?\d|-\w|[ ][A-Z](?!\w)", text[b : b + 3]):
            out.append("cut after")
        if re.search(r"[A-Z]{1,3}[ \-]?$", text[max(0, a - 4) : a]):
            out.append("letters left out")
        if re.match(r"(?:1[89]|20)\d\d[-./]\d\d[-./]\d\d$|\d\d[-./]\d\d[-./](?:19|20)\d\d$", s):
            out.append("date")
        if digits == 9 and re.match(r"9\d\d[- ]\d\d[- ]\d{4}$|\d{3}[- ]\d\d[- ]\d{4}$", s):
            out.append("3-2-4")
    elif kind == "street_address":
        name = next((k for k, p in _STREETS if p.fullmatch(s)), "none")
        out += [f"form={name}", f"unit={bool(re.match(_UNIT, s))}", f"unit before={bool(re.search(_UNIT + '$', text[max(0, a - 16) : a]))}", f"rest={bool(re.match(r' [a-z](?!\w)', text[b : b + 3]))}"]
        if s[-1] == "." or text[b : b + 1] == ".":
            short = bool(re.search(r"(?:St|Rd|Ave|Ln|Blvd|Ct|Sq|Dr)\.?$", s))
            kind_of = re.search(r"(\w+)\.?$", s)
            out.append(f"stop in={s[-1] == '.'} short={short} two={text[b : b + 1] == '.'}")
            out.append(f"stop in={s[-1] == '.'} kind={kind_of.group(1) if kind_of and short else ''} two={text[b : b + 1] == '.'}")
    elif kind == "email":
        out += [f"@={'@' in s}", f"spaced={' ' in s}", f"dots={min(3, s.count('.'))}", f"spoken={bool(re.search(r'[ (\[]dot[ )\]]', s, re.I))}", f"marked={bool(re.search(r'[\[({]at[\])}]', s, re.I))}", f"more={bool(re.match(r'(?: dot |\.\w| ?\(dot|\w)', text[b : b + 6], re.I))}", f"cut={bool(a and (text[a - 1].isalnum() or text[a - 1] in '.+-_'))}"]
    else:
        parts = [p for p in re.split(r",? ", s) if p[:1].isupper()]
        low = [p.lower() for p in parts]
        role = "".join("i" if len(p) == 2 and p[1] == "." else "x" if q in _NOT_NAME else "g" if q in GIVEN or q.split("-")[0] in GIVEN else "f" for p, q in zip(parts, low))
        title = bool(_TITLED.search(text, max(0, a - 7), a))
        comma = "," in s
        near_before, near_after = context.near(a, b)
        jobs = (bool(_ROLES & set(_words_before(text, a))), bool(_ROLES & set(_WORD.findall(text[b : b + 45].lower())[:5])))
        line = a == 0 or text[a - 1] == "\n" or text[max(0, a - 2) : a] in (". ", "? ", "! ")
        out += [f"role={role}", f"comma={comma} {role}", f"title={title}", f"title role={title} {role}", f"upper={s.isupper()}", f"n={len(parts)}", f"bad={role.count('x')}", f"listed={'g' in role}", f"initial={'i' in role}"]
        out += [f"mailed={context.mailed(parts)}", f"near={near_before} {near_after}", f"jobs={jobs}", f"starts={line}", f"starts={line} next={nxt}", f"starts={line} {role}", f"mark={text[b : b + 1] if text[b : b + 1] in ',.:;()' else ''}", f"label={prev == ':'}", f"comma the={bool(re.match(r', (?:the|a|an|who|which) ', text[b : b + 8]))}"]
        out.append(f"cap before={bool(_CAP_BEFORE.search(text, max(0, a - 25), a)) and not title}")
        out.append(f"cap after={bool(_CAP_AFTER.match(text, b))}")
        out.append(f"comma cap after={bool(_COMMA_CAP.match(text, b))} {role}")
        out.append(f"is name of={bool(re.match(r' (?:is|was) the name| street| road', text[b : b + 12].lower()))}")
        out.append(f"common={sum(q in context.low for q in low)}")
        if role[-1] == "f":
            out.append(f"end={low[-1][-3:]}")
    return [f"{kind}|{x}" for x in out]


def _lattice(segments):
    """Ends of segments in order, and for each end the segments that stop there."""
    cuts = sorted({x for a, b, _ in segments for x in (a, b)})
    place = {c: k for k, c in enumerate(cuts)}
    by_end = [[] for _ in cuts]
    for k, (a, b, _) in enumerate(segments):
        by_end[place[b]].append((place[a], k))
    return by_end


def decode(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The set of non-overlapping segments with the highest score: dynamic programming over the ends of candidates."""
    segments = candidates(text)
    if not segments:
        return []
    get, context = weights.get, Context(text, segments)
    scores = [sum(get(f, 0.0) for f in features(text, a, b, kind, context)) for a, b, kind in segments]
    by_end = _lattice(segments)
    best, back = [0.0] * len(by_end), [None] * len(by_end)
    for j in range(len(by_end)):
        if j:
            best[j] = best[j - 1]
        for i, k in by_end[j]:
            if scores[k] > 0 and best[i] + scores[k] > best[j]:
                best[j], back[j] = best[i] + scores[k], (i, k)
    out, j = [], len(by_end) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append(segments[k])
            j = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def _marginals(segments, scores) -> list[float]:
    """Probability of every segment under the field: forward and backward sums over the lattice."""
    by_end = _lattice(segments)
    n = len(by_end)
    by_start = [[] for _ in range(n)]
    for j in range(n):
        for i, k in by_end[j]:
            by_start[i].append((j, k))
    fwd, bwd = [0.0] * n, [0.0] * n
    for j in range(1, n):
        fwd[j] = fwd[j - 1]
        for i, k in by_end[j]:
            fwd[j] = _log_add(fwd[j], fwd[i] + scores[k])
    for i in range(n - 2, -1, -1):
        bwd[i] = bwd[i + 1]
        for j, k in by_start[i]:
            bwd[i] = _log_add(bwd[i], bwd[j] + scores[k])
    out = [0.0] * len(segments)
    for j in range(n):
        for i, k in by_end[j]:
            out[k] = math.exp(min(0.0, fwd[i] + scores[k] + bwd[j] - fwd[n - 1]))
    return out


_LISTED = tuple(sorted(g.title() for g in GIVEN))


def _generated(rng: random.Random):
    """A labelled text of our own making: parts that are details, and parts that only look like them."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllable = lambda: rng.choice(("bra", "kel", "mo", "tir", "vas", "lun", "gre", "ost", "pim", "dor", "sø", "hän", "fré", "zu", "ach", "wil"))
    stem = lambda: (syllable() + syllable() + rng.choice(("", syllable()))).title()
    family = lambda: stem() + rng.choice(("sen", "mann", "ov", "ez", "ik", "elli", "ara", "ski", "son", "s", "en", "ow", "ak", ""))
    listed = lambda: rng.choice(_LISTED)
    given = lambda: rng.choice(_LISTED) if rng.random() < 0.4 else stem() + rng.choice(("", "", "a", "e", "o", "in", "is", "el", "ia", "us"))
    up = lambda: rng.choice("ABCDEFGHIJKLMNOPRSTUVWZ")

    def person():
        f, g = family(), given()
        if rng.random() < 0.1:
            f = f"{f}-{family()}"
        s = rng.choice((f"{g} {f}",) * 5 + (f"{f}, {g}", f"{f}, {g}", f"{g[0]}. {f}", f"{up()}. {up()}. {f}", f"{g} {up()}. {f}", f"{f}, {up()}."))
        if rng.random() < 0.05:
            s = f"{g} {rng.choice(('van', 'de', 'von', 'di', 'van der', 'de la'))} {f}"
        if rng.random() < 0.12:
            s = s.upper()
        return s

    def email():
        f, g = family().lower(), given().lower()
        local = rng.choice((f"{g}.{f}", f"{g[0]}{f}", f"{f}{d(2)}", f"{f}_{g}", f"{g}+news", f"{g}-{f}"))
        local = re.sub(r"[^\x00-\x7f]", "o", local)
        name = re.sub(r"[^\x00-\x7f]", "o", stem().lower()) + rng.choice(("foods", "group", "mail", "-online"))
        tail = rng.choice(("example", "test", "invalid", "com", "org", "co.example", "co.uk"))
        if rng.random() < 0.15:
            local = local.upper()
        at = rng.choice(("@",) * 4 + (" @ ", " (at) ", " [at] ", " at ", "(at)", "[at]"))
        if at.strip(" ()[]") == "at" and rng.random() < 0.5 or at == " at ":
            return f"{local}{at}{name} dot {tail.replace('.', ' dot ')}"
        return f"{local}{at}{name}.{tail}"

    def phone():
        return rng.choice((f"+1 {d(3)}-555-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"+4420{d(8)}", f"020 {d(4)} {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 (0)30 {d(5)} {d(3)}", f"0049 30 {d(8)}", f"+49 30 {d(7)}", f"030/{d(7)}", f"+34 {d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"+39 06 {d(8)}", f"0{d(3)} {d(6)}", f"+{d(11)}"))

    def number():
        return rng.choice((f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"{d(6)}-{d(4)}", f"{up()}{up()}{d(6)}{up()}", f"{up()}{up()} {d(2)} {d(2)} {d(2)} {up()}", f"{up()}{up()}{d(7)}", f"ID-{d(3)}.{d(3)}.{d(3)}-{up()}", f"{d(8)}{up()}", f"{up()}{d(8)}", f"{up()}-{d(7)}-{up()}"))

    def street():
        n, s = str(rng.randint(1, 299)), stem()
        s = rng.choice((s, rng.choice(("Church", "Park", "Mill", "Bridge", "Station", "Garden", "Forge", "Market"))))
        return rng.choice((f"{n} {s} {rng.choice(('Street', 'Road', 'Lane', 'Avenue', 'Way', 'Close', 'Terrace', 'St.', 'St.', 'Rd', 'Blvd', 'Ave', 'Drive'))}", f"{n}{rng.choice('abc')} {s} {rng.choice(('Street', 'Road', 'Lane', 'Close', 'St.'))}", f"Flat {rng.randint(1, 9)}, {n} {s} {rng.choice(('Street', 'Way', 'Road', 'St.', 'Blvd', 'Rd'))}", f"{n}, rue du {s}", f"{n} rue de la {s}", f"{s}strasse {n}", f"{s}strasse {n} {rng.choice('abc')}", f"{s}straße {n}{rng.choice('abc')}", f"{s}straat {n}", f"Calle {s} {n}", f"Calle de {s} {n}"))

    title = lambda: rng.choice(("",) * 4 + ("Mr ", "Ms ", "Dr. ", "Prof. ", "Mrs ", "Mr. "))
    trade = lambda: rng.choice(("Holdings", "Foods", "Group", "Water", "Media", "Capital", "Logistics", "Bank", "Steel", "Motors", "Press", "Brewery", "Partners", "Airlines", "Insurance", "Farms", "Software", "Daily", "Trust"))
    firm = lambda: rng.choice((f"{stem()} {trade()}",) * 4 + (f"{stem()} & {stem()} {trade()}", f"{stem()} {stem()} {trade()}", f"{stem()} {trade()} Ltd", f"{stem()}-{stem()} {trade()}"))
    town = lambda: stem() + rng.choice(("ton", "wick", "ham", "berg", "dal", "ville", "stad"))
    place = lambda: rng.choice((town(), f"{rng.choice(('North', 'New', 'Lake', 'Port', 'Mount', 'San'))} {town()}", f"{town()} {rng.choice(('Bay', 'Valley', 'Island', 'Bridge', 'Park', 'Airport', 'Harbour', 'Castle'))}"))
    ship = lambda: rng.choice((f"{listed()} {stem()}", f"{listed()} {rng.choice(('Star', 'Maria', 'Queen'))}", f"{stem()} Star"))
    job = lambda: rng.choice(("engineer", "judge", "head nurse", "editor", "mayor", "lawyer", "owner", "night clerk", "director of the school", "captain", "teacher", "chief of staff", "analyst"))
    did = lambda: rng.choice(("sold", "bought", "opened", "shipped", "reported", "moved", "raised", "cut", "made", "ran", "owns", "hired", "reviewed", "settled", "launched", "is based in", "operates", "reduced"))
    thing = lambda: rng.choice(("shares", "a plant", "two ships", "its costs", "the mill", "a loan", "the line", "old stock", "a new site"))
    months = ("January", "March", "May", "August", "October")
    year = lambda: rng.randint(1990, 2024)
    P, E, T, N, S = (("person_name", person), ("email", email), ("phone", phone), ("id_number", number), ("street_address", street))
    frames = (
        # people
        lambda: [title(), P, f" {rng.choice(('said', 'told the court', 'wrote', 'added', 'agreed', 'explained', 'recalled', 'says', 'thinks so', 'joined, and said'))} that the plan was sound."], lambda: [f"“It rained,” {rng.choice(('said', 'wrote', 'says', 'added'))} ", title(), P, f", the {job()}."], lambda: ["According to ", title(), P, ", it rained."],
        lambda: [title(), P, f", {rng.choice(('a', 'the', 'our'))} {job()}, left in {year()}."], lambda: [f"The {job()}, ", title(), P, ", has left."], lambda: [f"{rng.choice(('Its', 'Their', 'The new'))} {job()} is ", title(), P, "."], lambda: [title(), P, f" {rng.choice(('was born in', 'lives in', 'grew up in', 'died in', 'moved to', 'retired to'))} {place()}."],
        lambda: [title(), P, f" {rng.choice(('became', 'was hired as', 'was named', 'served as', 'worked as', 'is', 'was', 'retired as', 'started as', 'was sworn in as', 'came in as', 'joined us as', 'signed on as'))} {job()} in {year()}."], lambda: [title(), P, " and ", title(), P, f" {rng.choice(('met', 'married', 'agreed', 'left', 'wrote the book'))} in {year()}."], lambda: ["The book by ", title(), P, f" came out in {year()}."], lambda: [f"{rng.choice(('Author', 'Attn', 'Buyer', 'Applicant', 'Tenant', 'Name', 'Patient', 'Sent by', 'Attention', 'Prepared by', 'From', 'To', 'By', 'Witness', 'Signature'))}: ", title(), P, rng.choice(("", "", "\n", ", ", "."))], lambda: [f"{rng.choice(('By', 'From', 'Witness', 'Signature', 'Approved'))}: ", P, f" {firm()} {did()} {thing()}."],
        lambda: ["Dear ", title(), P, ",\n"], lambda: ["Yours, ", P, "\n"], lambda: ["The house belongs to ", title(), P, "."], lambda: ["They thanked ", title(), P, f" for {thing()}."], lambda: ["A letter was handed to ", title(), P, " at ", S, f", {town()}."], lambda: [f"It is held {rng.choice(('by', 'for', 'on behalf of', 'in trust for'))} ", title(), P, rng.choice((".", " since then."))], lambda: ["We spoke with ", title(), P, " on ", T, "."], lambda: [f"{rng.choice(('The card of', 'A friend of', 'The account of', 'The estate of', 'The words of', 'On the advice of'))} ", title(), P, rng.choice((".", f" {did()} {thing()}.", " is known."))], lambda: ["Ring ", T, " and speak to ", title(), P, "."], lambda: [f"There is a {rng.choice(('parcel', 'letter', 'room', 'call', 'seat'))} for ", title(), P, rng.choice((".", f" at {firm()}."))], lambda: [f"{rng.choice(('ID', 'SSN', 'Tax no.', 'Card', 'Identity number', 'Insurance no.', 'Licence'))} ", N, " was issued to ", title(), P, "."], lambda: [f"Guest: ", title(), P, ", ", S, f", {rng.choice(('ID', 'card', 'no.'))} ", N, ", tel ", T, ", mail ", E], lambda: [title(), P, ", ", S, ", ", T], lambda: [title(), P, " (", E, ") will help."], lambda: ["For help reach ", title(), P, " on ", T, " or ", E, "."], lambda: [title(), P, f" {rng.choice(('lives', 'stays', 'was seen'))} at ", S, "."], lambda: [title(), P, f", on ", T, ", can answer."], lambda: [f"Patient: ", title(), P, ", ", S, ", card ", N, ", ", E],
        lambda: [f"{rng.choice(('Ask', 'Call', 'See', 'Email', 'Visit'))} ", title(), P, rng.choice((".", f" in {place()}.", " before noon."))], lambda: ["The papers were given to ", title(), P, " last week."], lambda: [title(), P, f" of {firm()} {did()} {thing()}."],
        # other details
        lambda: ["Call ", T, " for more."], lambda: ["tel ", T], lambda: ["tel ", T, f" {rng.randint(11, 999)} {stem().lower()} people came, and {d(2)} left."], lambda: ["Send it to ", S, f", {town()}, or to ", E, "."], lambda: ["Mail ", E, " or ring ", T, "."], lambda: [f"{rng.choice(('Card', 'ID', 'Document', 'SSN', 'Person no.', 'Owner'))} ", N, rng.choice((" was found.", "; home ", " is valid, says the clerk."))], lambda: [f"{stem().title()} {stem().lower()}, ID ", N, ", phone ", T, "."], lambda: ["The number ", N, " is that of a person; home ", S, "."], lambda: ["Goods go to ", S, " only."], lambda: ["Residence: ", S, ". ", f"{stem()} stayed."], lambda: ["They live at ", S, "."], lambda: ["Passport ", N, " and tax number ", N, "."], lambda: ["Contact: ", E, " / ", T, "."],
        # none
        lambda: [f"{firm()} {did()} {thing()}."] , lambda: [f"{firm()} {did()} {thing()} near {place()}."], lambda: [f"{firm()} {did()} {d(3)} {stem().lower()} units in {rng.choice(months)} {year()} for {d(3)}.{d(1)} million."], lambda: [f"In {rng.choice(months)} {year()}, {firm()} moved to {place()}, where {d(3)} people work."], lambda: [f"About {firm()}\n"], lambda: [f"{place()}: {stem().lower()} sold\n"], lambda: [f"{stem().title()} {stem().lower()} for {firm()}\n"], lambda: [f"Why the {stem().lower()} of {place()} matters\n"], lambda: [f"The talks in {place()} with {firm()} ended."], lambda: [f"{rng.choice(('Since', 'Under', 'While', 'After', 'Once'))} {firm()} {did()} {thing()}, {firm()} {did()} {thing()}."], lambda: [f"The {place()} {stem().lower()} and the {stem()} {stem()} {rng.choice(('line', 'plant', 'index', 'fund', 'prize'))} grew."], lambda: [f"It was made by {firm()} for {firm()}, a maker in {place()}, {place()}."], lambda: [f"{rng.choice(('Earlier', 'Later', 'Today', 'Elsewhere', 'Overall', 'Recently', 'Instead', 'Abroad'))}, {firm()} {did()} {thing()}."], lambda: [f"{rng.choice(('By', 'From', 'Witness', 'Signature', 'Name'))}: ", title(), P, f" {rng.choice(('Money', 'Work', 'Talks', 'Prices', 'Rent', 'Repairs', 'Letters', 'Nothing', 'Plans', 'Goods', 'Trade'))} {rng.choice(('on', 'in', 'for', 'with', 'came', 'from', 'was'))} {stem().lower()} {thing()}."], lambda: [f"{firm()}, {rng.choice(('a', 'the'))} {rng.choice(('maker', 'firm', 'lender', 'grower'))} of {thing()}, {did()} {thing()}."],
        lambda: [f"The ship {ship()} left {place()}; the {ship()} is late."], lambda: [f"{listed()} is the name of the {stem()} vessel."], lambda: [f"{listed()} {rng.choice(('Holdings', 'Foods', 'Shipping', 'Road', 'Bank', 'Street', 'Bridge', 'Island'))} met {firm()} in {place()}."], lambda: [f"{listed()} {stem()} {trade()} {did()} {thing()}."], lambda: [f"The {stem()} Street index closed at {d(4)}.{d(2)} points."], lambda: [f"Between {d(2)} and {d(3)} cars use the {stem()} Road bypass."], lambda: [f"They met at the {stem()} Mill on {stem()} Lane, then went home."], lambda: [f"The {rng.choice(('Ministry', 'Institute', 'University', 'Court', 'Port'))} of {place()} {did()} {thing()}."], lambda: [f"{stem()} {rng.choice(('University', 'Institute', 'Court', 'Council', 'Hospital'))} {did()} {thing()}."],
        lambda: [f"Invoice {d(3)}-{d(3)}-{d(5)} was paid in {year()}."], lambda: [f"Filing no. {d(4)}-{d(3)}-{d(2)} covers {d(1)},{d(3)},{d(3)} shares."], lambda: [f"Order {d(8)} left on {year()}-0{rng.randint(1, 9)}-{d(2)}."], lambda: [f"It ended on {year()}-0{rng.randint(1, 9)}-{d(2)}."], lambda: [f"Output rose from {d(2)} {d(4)} to {d(2)} {d(4)} tonnes."], lambda: [f"Version {d(1)}.{d(2)}.{d(1)} runs at {d(3)}.{d(3)}.{d(2)}.{d(1)}."], lambda: [f"The handle @{stem().lower()} was given up."], lambda: [f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)} sold {d(3)},{d(3)} copies."], lambda: [f"Account {d(4)} {d(4)} {d(4)} {d(4)} was closed; see table {d(1)}.{d(2)}."], lambda: [f"{firm()} {rng.choice(('bid', 'sold', 'made', 'shipped', 'held'))} {d(3)} {d(3)} {d(3)} {rng.choice(('units', 'shares', 'parts', 'tonnes', 'bottles'))}."], lambda: [f"Sales came to {d(3)} {d(3)} {d(3)} in {year()}."], lambda: [f"Batch {up()}{up()}{d(5)} of {stem()} No. {d(6)} was tested."],
    )
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        for part in rng.choice(frames)():
            if isinstance(part, tuple):
                s = part[1]()
                spans.append((len(text), len(text) + len(s), part[0]))
                text += s
            else:
                text += part
        text += rng.choice((" ", " ", "\n"))
    return text, spans


@lru_cache(maxsize=2)
def fit(seed: int = 5, texts: int = 5000, epochs: int = 5) -> dict[str, float]:
    """Weights by maximum likelihood (stochastic gradient, adaptive steps) on generated labelled texts."""
    rng = random.Random(seed)
    data = []
    for _ in range(texts):
        text, spans = _generated(rng)
        segments = candidates(text)
        if segments and set(spans) <= set(segments):
            gold, context = set(spans), Context(text, segments)
            data.append(([features(text, *s, context) for s in segments], segments, [s in gold for s in segments]))
    w: dict[str, float] = defaultdict(float)
    g2: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, segments, gold in data:
            scores = [sum(w[f] for f in fs) for fs in feats]
            for fs, p, y in zip(feats, _marginals(segments, scores), gold):
                g = y - p
                if abs(g) > 1e-3:
                    for f in fs:
                        g2[f] += g * g
                        w[f] += 0.25 * g / math.sqrt(g2[f]) - 1e-5 * w[f]
    return {f: x for f, x in w.items() if abs(x) > 1e-3}


def find(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The details of a text of any length: candidates and their lattice are those of the whole text, so none is parted."""
    return decode(text, weights)


def redact(text: str, weights: dict[str, float]) -> str:
    """The text with every detail replaced by the placeholder of its type."""
    out, at = [], 0
    for a, b, kind in find(text, weights):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def find_details(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every detail found: (key, pii_type, pii_text, start), in one pass without a shuffle.

    The model is fitted once on the driver from generated labelled texts and sent to the
    tasks (a few thousand weights). Null and empty texts have no rows, copies of a row give
    copies; texts of any length are read whole. Rows with a null key are kept.
    """
    weights = df.sparkSession.sparkContext.broadcast(fit())

    def run(batches):
        import pyarrow as pa

        w = weights.value
        for b in batches:
            rows = [(i, kind, t[x:y], x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x, y, kind in find(t, w)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["id", "pii_type", "pii_text", "start"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, pii_type string, pii_text string, start int").withColumnRenamed("id", key)


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's text with placeholders: (key, text under its own name); null stays null."""
    weights = df.sparkSession.sparkContext.broadcast(fit())

    def run(batches):
        import pyarrow as pa

        w = weights.value
        for b in batches:
            out = [None if t is None else redact(t, w) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    out = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, text string")
    return out.toDF(key, text)
