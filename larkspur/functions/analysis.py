"""Text analysis: char filters, tokenizers, token filters and analyzers.

`analyze` is the plain-Python definition, used on small inputs and inside Arrow functions. `tokens`
gives the same tokens as a JVM-side Column for the components that expressions can say; others run as a
vectorised Arrow function.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words and the articles that French elides.
STOP_EN = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've
    they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't
    hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's
    there's when's where's why's how's a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very""".split()
)
# The Snowball project's stop words of Danish, Swedish, Norwegian, Dutch and Russian.
STOP_DA = frozenset(
    """og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da
    fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres
    efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle
    hos blive mange ad bliver hendes været thi jer sådan""".split()
)
STOP_SV = frozenset(
    """och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har
    inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina
    här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss din
    dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt vem vilket
    sitta sådana vart dina vars vårt våra ert era vilkas""".split()
)
STOP_NO = frozenset(
    """og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha hadde
    hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blei blitt
    kunne inn når være kom noen noe ville dere som deres kun ja etter ned skulle denne for deg si sine sitt mot å meget
    hvorfor dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem vors hvis både
    bare enn fordi før mange også slik vært være båe begge siden dykk dykkar dei deira deires deim di då eg ein eit eitt elles
    honom hjå ho hoe henne hennar hennes hoss hossen ikkje ingi inkje korleis korso kva kvar kvarhelst kven kvi kvifor me
    medan mi mine mykje no nokon noka nokor noko nokre si sia sidan so somt somme um upp vere vore verte vort varte
    vart""".split()
)
STOP_NL = frozenset(
    """de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit
    zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen
    omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd
    doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere""".split()
)
STOP_RU = frozenset(
    """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о
    из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя
    ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь
    будет ж тогда кто этот говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас
    были куда зачем сказать всех никогда сегодня можно при наконец два об другой хоть после над больше тот через эти нас про
    всего них какая много разве сказала три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им
    более всегда конечно всю между""".split()
)
ELISION_FR = frozenset("l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split())
_CLASSES = {
    "letter": r"\p{L}", "digit": r"\p{Nd}", "number": r"\p{N}", "space": r"\p{Z}\s", "whitespace": r"\p{Z}\s", "punct": r"\p{P}",
    "punctuation": r"\p{P}", "symbol": r"\p{S}", "control": r"\p{Cc}", "mark": r"\p{M}", "graphic": r"\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}", "print": r"\p{L}\p{M}\p{N}\p{P}\p{S} ",
}


# -- char filters --------------------------------------------------------------------------------------------


def ascii_fold(s: str) -> str:
    table = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ı": "i"}
    return "".join(c for c in unicodedata.normalize("NFKD", "".join(table.get(c, c) for c in s)) if not unicodedata.combining(c))


def char_filter(name: str, o: dict):
    if name in ("ascii_folding", "asciifolding"):
        return ascii_fold
    if name in ("html", "html_strip"):
        return lambda s: html.unescape(re.sub(r"<[^>]*>", " ", s))
    if name == "zero_width_non_joiner":
        return lambda s: s.replace("\u200c", " ")
    if name in ("regexp", "pattern", "pattern_replace"):
        return lambda s: regex.sub(o["pattern"], re.sub(r"\$\{?(\d+)\}?", r"\\g<\1>", o.get("replacement", "")), s)
    if name == "mapping":
        pairs = [tuple(x.strip() for x in m.split("=>", 1)) for m in o["mappings"]]

        def run(s: str) -> str:
            for a, b in pairs:
                s = s.replace(a, b)
            return s

        return run
    raise ValueError(f"unknown char filter {name}")


# -- tokenizers ----------------------------------------------------------------------------------------------


class Token(str):
    """A token's text, its place in the text it comes from, its kind, and how many places it is after the last one."""

    start, end, kind, keyword, step = 0, 0, "AlphaNumeric", False, 1


def _kind(t: str) -> str:
    if regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", t):
        return "Ideographic"
    return "Numeric" if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else "AlphaNumeric"


def made(t: str, start: int, kind: str | None = None) -> Token:
    out = Token(t)
    out.start, out.end, out.kind = start, start + len(t), kind or _kind(t)
    return out


def like(x: str, t: str, **how) -> Token:
    """A token of text t in the place of x."""
    out = Token(t)
    if isinstance(x, Token):
        out.start, out.end, out.kind, out.keyword, out.step = x.start, x.end, x.kind, x.keyword, x.step
    for k, v in how.items():
        setattr(out, k, v)
    return out


def _found(pattern: str):
    p = regex.compile(pattern)
    return lambda s: [made(m.group(), m.start()) for m in p.finditer(s) if m.group()]


def _grams(s: str, lo: int, hi: int, classes: list[str], edge: bool) -> list[str]:
    parts = [(m.group(), m.start()) for m in regex.finditer(f"[{''.join(_CLASSES[c] for c in classes)}]+", s)] if classes else [(s, 0)]
    return [made(w[i : i + n], at + i) for w, at in parts for i in ([0] if edge else range(len(w))) for n in range(lo, hi + 1) if i + n <= len(w)]


def _path(s: str, o: dict) -> list[str]:
    d, r, skip = o.get("delimiter", "/"), o.get("replacement", o.get("delimiter", "/")), int(o.get("skip", 0))
    whole = s
    parts = s.split(d)
    if parts and parts[-1] == "":
        parts = parts[:-1]
    lead = parts and parts[0] == ""
    body = parts[1:] if lead else parts
    body = body[skip:]
    out, from_ = [], len(whole) - len(d.join(body)) - (len(d) if whole.endswith(d) and body else 0)
    for k in range(len(body)):
        t = Token((r if lead or skip else "") + r.join(body[: k + 1]))
        t.start, t.end, t.step = max(0, from_ - len(d)) if lead or skip else from_, from_ + len(d.join(body[: k + 1])), int(k == 0)
        out.append(t)
    return out


_URL = r"(?:https?|ftp)://[^\s<>\"']+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[@#]?[\w]+(?:['’][\w]+)*"
_WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.:·][\p{L}\p{M}\p{N}_]+)*"


def tokenizer(name: str, o: dict):
    if name in ("standard", "unicode"):
        cjk = r"[\p{Han}\p{Hiragana}]"
        return _found(rf"{cjk}|(?:(?!{cjk})[\p{{L}}\p{{M}}\p{{N}}_])+(?:['’.:·](?:(?!{cjk})[\p{{L}}\p{{M}}\p{{N}}_])+)*")
    if name in ("letter", "simple"):
        return _found(r"\p{L}+")
    if name in ("lower_case", "lowercase"):
        return lambda s, f=_found(r"\p{L}+"): [like(t, t.lower()) for t in f(s)]
    if name in ("single", "keyword"):
        return lambda s: [made(s, 0)] if s else []
    if name == "whitespace":
        return _found(r"\S+")
    if name in ("regexp", "pattern"):
        return _found(o.get("pattern") or r"[0-9A-Za-z_]+")
    if name == "character":
        return _found(f"[{_CLASSES[o.get('char', o.get('class', 'letter'))]}]+")
    if name == "char_group":
        sep = "".join(_CLASSES.get(c) or re.escape(c) for c in o["tokenize_on_chars"])
        return _found(f"[^{sep}]+")
    if name in ("ngram", "edge_ngram"):
        return lambda s: _grams(s, int(o.get("min_gram", 1)), int(o.get("max_gram", 2)), o.get("token_chars", []), name == "edge_ngram")
    if name == "path_hierarchy":
        return lambda s: _path(s, o)
    if name == "web":
        return _found(_URL)
    if name == "exception":
        return _found("|".join(f"(?:{p})" for p in o.get("patterns", [])) + "|" + _WORD)
    if name in ("gse_standard", "gse_search"):
        words = set(o.get("words", []))

        def placed(s: str) -> list[str]:
            at, out = 0, []
            for t in _max_match(s, words):
                at = max(at, s.lower().find(t, at))
                out.append(made(t, at))
                at += len(t)
            return out

        return placed
    raise ValueError(f"unknown tokenizer {name}")


def _max_match(s: str, words: set[str]) -> list[str]:
    """Longest dictionary word at each place, else one character; other scripts by words."""
    out, most = [], max(map(len, words), default=1)
    for part in regex.findall(r"\p{Han}+|[\p{L}\p{N}]+", s):
        if not regex.match(r"\p{Han}", part):
            out.append(part.lower())
            continue
        i = 0
        while i < len(part):
            n = next((n for n in range(min(most, len(part) - i), 1, -1) if part[i : i + n] in words), 1)
            out.append(part[i : i + n])
            i += n
    return out


# -- token filters -------------------------------------------------------------------------------------------


def porter(w: str) -> str:
    """Porter's algorithm of 1980 for English."""
    if len(w) < 3 or not w.isascii():
        return w
    kind = lambda s: "".join("c" if c not in "aeiou" and not (c == "y" and i and s[i - 1] not in "aeiou") else "v" for i, c in enumerate(s))
    m = lambda s: len(re.findall("v+c+", kind(s)))
    has_v = lambda s: "v" in kind(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and kind(s)[-1] == "c"
    cvc = lambda s: kind(s)[-3:] == "cvc" and s[-1] not in "wxy"
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if has_v(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and has_v(w[:-1]):
        w = w[:-1] + "i"
    two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    for table in (two, three):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


# The names that languages have beside their codes.
LANGUAGES = {
    "arabic": "ar", "sorani": "ckb", "danish": "da", "german": "de", "english": "en", "spanish": "es", "persian": "fa", "finnish": "fi", "french": "fr", "hindi": "hi",
    "hungarian": "hu", "italian": "it", "dutch": "nl", "norwegian": "no", "portuguese": "pt", "romanian": "ro", "russian": "ru", "swedish": "sv", "turkish": "tr",
}
_STOP = {"en": STOP_EN, "da": STOP_DA, "sv": STOP_SV, "no": STOP_NO, "nl": STOP_NL, "ru": STOP_RU, "cjk": frozenset(), "none": frozenset()}


def _stop_words(v) -> frozenset[str]:
    out: set[str] = set()
    for x in [v] if isinstance(v, str) else v or ["_english_"]:
        if x.strip("_") != x and (known := _STOP.get(LANGUAGES.get(x.strip("_"), x.strip("_")))) is not None:
            out |= known
        elif re.fullmatch("_[a-z]+_", x):
            raise ValueError(f"no stop words of {x} are known: list them")
        else:
            out.add(x)
    return frozenset(out)


def _shingles(t: list[str], o: dict) -> list[str]:
    """Each token, then the shingles that end in it; a removed token's place holds the filler."""
    lo, hi, sep, filler = int(o.get("min_shingle_size", 2)), int(o.get("max_shingle_size", 2)), o.get("token_separator", " "), o.get("filler_token", "_")
    row: list[tuple[str, str | None]] = []
    for x in t:
        row += [(filler, None)] * (getattr(x, "step", 1) - 1) if row else []
        row.append((x, x))
    out: list[str] = []
    for i, (_, x) in enumerate(row):
        if x is not None and o.get("output_original", True):
            out.append(x)
        for n in range(lo, hi + 1):
            if i + 1 >= n:
                part = [y for y, _ in row[i + 1 - n : i + 1]]
                real = [y for _, y in row[i + 1 - n : i + 1] if isinstance(y, Token)]
                out.append(like(x or part[0], sep.join(part), kind="Shingle", step=0, **({"start": real[0].start, "end": real[-1].end} if real else {})))
    return out


def _bigrams(t: list[str], single: bool) -> list[str]:
    """Pairs of neighbouring ideographs; one without a neighbour stays alone. Text between them parts neighbours."""
    cjk = regex.compile(r"^[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]$")
    near = lambda a, b: cjk.match(a) and cjk.match(b) and (not isinstance(a, Token) or a.end == b.start)
    out: list[str] = []
    for i, x in enumerate(t):
        if not cjk.match(x):
            out.append(x)
            continue
        after = i + 1 < len(t) and near(x, t[i + 1])
        alone = not after and not (i and near(t[i - 1], x))
        if single or alone:
            out.append(like(x, x, kind="Single"))
        if after:
            out.append(like(x, x + t[i + 1], kind="Double", step=int(not single), **({"end": t[i + 1].end} if isinstance(x, Token) else {})))
    return out


def _stopped(t: list[str], stop: frozenset[str]) -> list[str]:
    """t without stop words; what follows one is that many places further."""
    out, lost = [], 0
    for x in t:
        if x in stop:
            lost += getattr(x, "step", 1)
        else:
            out.append(like(x, x, step=x.step + lost) if lost and isinstance(x, Token) else x)
            lost = 0
    return out


def _camel(t: str) -> list[str]:
    return regex.findall(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|[^\p{L}\p{N}]+", t)


# The letters that normalisers rewrite, and the articles that Italian and Irish elide.
ELISION_IT = frozenset("c l all dall dell nell sull coll pell gl agl dagl degl negl sugl un m t s v d".split())
ELISION_GA = frozenset("d m b".split())
_NORMAL = {
    "ar": str.maketrans("آأإىة", "ااايه", "ـًٌٍَُِّْ"),
    "fa": str.maketrans("یېےکۀہ", "يييكهه", "ٔ"),
    "ckb": str.maketrans("يىكة", "ییکە", "ـًٌٍَُِّْ"),
    "hi": str.maketrans("ँऑआईऊॠऐऔीूॄॢैौ", "ंओअइउऋएओिुृृेो", "़‌‍"),
}


def normalise(lang: str, w: str) -> str:
    """Letter variants of a language written as one."""
    if lang == "de":
        w = re.sub("(?<![aeiouyq])ue", "u", w.replace("ae", "a").replace("oe", "o"))
        return w.translate(str.maketrans("äöü", "aou")).replace("ß", "ss")
    return w.translate(_NORMAL[lang])


def light_stem(lang: str, w: str) -> str:
    """Savoy's light stemmers of German, Spanish and Italian, and his minimal one of French."""
    n = len(w)
    if lang == "fr":
        if n < 6:
            return w
        if w.endswith("x"):
            return w[:-2] + "l" if w.endswith("aux") else w[:-1]
        for end in "sreé":
            w = w.removesuffix(end)
        return w[:-1] if w[-1] == w[-2] else w
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c) or c == "\u0303" and lang == "es")
    w, n = unicodedata.normalize("NFC", w), len(w)
    if lang == "de":
        for cut in (("ern", 6), ("em", 5), ("en", 5), ("er", 5), ("es", 5), ("e", 4)), (("est", 6), ("er", 5), ("en", 5)):
            end = next((e for e, least in cut if len(w) >= least and w.endswith(e)), "")
            if not end and len(w) >= (4 if cut[0][0] == "ern" else 5):
                tail = "s" if cut[0][0] == "ern" else "st"
                end = tail if w.endswith(tail) and w[-len(tail) - 1] in "bdfghklmnt" else ""
            w = w[: len(w) - len(end)]
        return w
    if lang == "es":
        if n < 5:
            return w
        if w[-1] in "oae":
            return w[:-1]
        if w.endswith("eses"):
            return w[:-2]
        if w.endswith("ces"):
            return w[:-3] + "z"
        return w[:-2] if w[-1] == "s" and w[-2] in "oae" else w
    if n < 6:  # Italian
        return w
    if w[-1] in "ei":
        return w[:-2] if w[-2] in "ih" else w[:-1]
    return w[:-2] if w[-1] in "ao" and w[-2] == "i" else w[:-1] if w[-1] in "ao" else w


# The endings that the Snowball stemmers of the Nordic languages drop, step by step.
_NORDIC = {
    "da": (
        "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split(),
        "abcdfghjklmnoprtvyzå", "gd dt gt kt".split(), "ig lig elig els".split(), {"løst": "løs"}),
    "sv": (
        "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(),
        "bcdfghjklmnoprtvy", "dd gd nn dt gt kt tt".split(), "lig ig els".split(), {"löst": "lös", "fullt": "full"}),
    "no": (
        "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split(),
        "bcdfghjlmnoprtvyz", "dt vt".split(), "leg eleg ig eig lig elig els lov elov slov hetslov".split(), {}),
}


def nordic_stem(lang: str, w: str) -> str:
    """Snowball's stemmers of Danish, Swedish and Norwegian: endings of the part behind the first vowel and consonant."""
    drop, before_s, pairs, kinds, swaps = _NORDIC[lang]
    vowels = "aeiouyæåø" if lang != "sv" else "aeiouyäåö"
    m = re.search(f"[{vowels}][^{vowels}]", w)
    if not m or len(w) < 3:
        return w
    start = max(3, m.end())

    def ending(ends) -> str:
        return max((e for e in ends if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")

    extra = ["erte", "ert"] if lang == "no" else []
    e = ending([*drop, *extra, "s"])
    if e in extra and e:
        w = w[: len(w) - len(e)] + "er"
    elif e == "s":
        c, behind = w[-2], w[-3:-2]
        if c in before_s or lang == "no" and c == "k" and behind and behind not in vowels:
            w = w[:-1]
    else:
        w = w[: len(w) - len(e)]
    if ending(pairs):
        w = w[:-1]
    if lang == "da" and w.endswith("igst"):
        w = w[:-2]
    e = ending([*kinds, *swaps])
    w = w[: len(w) - len(e)] + swaps.get(e, "")
    if lang == "da":
        if e in kinds and ending(pairs):
            w = w[:-1]
        if len(w) > start and w[-1] == w[-2] and w[-1] not in vowels:
            w = w[:-1]
    return w


# The endings of Snowball's Russian stemmer; those of a pair's first list stand behind а or я.
_RU = {
    "gerund": ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()),
    "reflexive": ([], "ся сь".split()),
    "adjective": ([], "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()),
    "participle": ("ем нн вш ющ щ".split(), "ивш ывш ующ".split()),
    "verb": (
        "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
        "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()),
    "noun": ([], "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()),
    "derived": ([], "ост ость".split()),
    "greatest": ([], "ейш ейше".split()),
}


def russian_stem(w: str) -> str:
    """Snowball's Russian stemmer: endings behind the first vowel, those of derived nouns behind two syllables."""
    vowels = "аеиоуыэюя"
    w = w.replace("ё", "е")
    first = re.search(f"[{vowels}]", w)
    if not first:
        return w
    rv = first.end()
    two = re.search(f"[{vowels}][^{vowels}]", w)
    r2 = re.search(f"[{vowels}][^{vowels}]", w[two.end() :]) if two else None
    deep = two.end() + r2.end() if two and r2 else len(w)

    def cut(x: str, kind: str, least: int = rv) -> str:
        behind, free = _RU[kind]
        e = max((e for e in (*behind, *free) if x.endswith(e) and len(x) - len(e) >= least), key=len, default="")
        if e in behind and e and not (len(x) - len(e) > least and x[-len(e) - 1] in "ая"):
            return x
        return x[: len(x) - len(e)]

    out = cut(w, "gerund")
    if out == w:
        w = cut(w, "reflexive")
        out = cut(w, "adjective")
        out = cut(out, "participle") if out != w else cut(w, "verb")
        out = cut(w, "noun") if out == w else out
    if len(out) > rv and out[-1] == "и":
        out = out[:-1]
    out = cut(out, "derived", deep)
    short = cut(out, "greatest")
    if short.endswith("нн") and len(short) - 2 >= rv:
        return short[:-1]
    return out[:-1] if short == out and out.endswith("ь") and len(out) > rv else short


def token_filter(name: str, o: dict):
    each = lambda f: lambda t: [like(x, f(x)) for x in t]
    many = lambda f: lambda t: [like(x, y, step=getattr(x, "step", 1) if i == 0 else 0) for x in t for i, y in enumerate(f(x))]
    own = lambda f: each(lambda x: x if getattr(x, "keyword", False) else f(x))
    num = lambda k, d: int(o.get(k) or d)
    if name == "apostrophe":
        return each(lambda x: re.split("['’]", x)[0])
    if name in ("camel_case", "camelcase"):
        return many(_camel)
    if name in ("dict", "dictionary"):
        words, lo, hi, least = set(o["words"]), num("min_subword_size", 2), num("max_subword_size", 15), num("min_word_size", 5)

        def split(x: str) -> list[str]:
            out = [x]
            if len(x) >= least:
                for i in range(len(x)):
                    hits = [x[i : i + n] for n in range(lo, min(hi, len(x) - i) + 1) if x[i : i + n] in words]
                    out += hits[-1:] if o.get("only_longest_match") else hits
            return out

        return many(split)
    if name in ("edge_ngram", "ngram"):
        lo, hi, back = num("min_gram", 1), num("max_gram", 2), o.get("side") == "back"
        if name == "ngram":
            return many(lambda x: [x[i : i + n] for i in range(len(x)) for n in range(lo, hi + 1) if i + n <= len(x)])
        return many(lambda x: [x[len(x) - n :] if back else x[:n] for n in range(lo, hi + 1) if n <= len(x)])
    if name in ("elision", "elision_fr", "elision_ga", "elision_it"):
        arts = frozenset(o.get("articles") or {"elision_it": ELISION_IT, "elision_ga": ELISION_GA}.get(name, ELISION_FR))
        return each(lambda x: next((x[m.end() :] for m in [re.match(r"(\w+)['’]", x)] if m and m.group(1).lower() in arts), x))
    if name in ("keyword", "keyword_marker"):
        marks = set(o.get("keywords", []))
        return lambda t: [like(x, x, keyword=True) if x in marks else x for x in t]
    if name == "length":
        lo, hi = num("min", 1), num("max", 2)
        return lambda t: [x for x in t if lo <= len(x) <= hi]
    if name in ("lower_case", "lowercase"):
        return each(str.lower)
    if name in ("upper_case", "uppercase"):
        return each(str.upper)
    if name in ("porter", "stemmer", "stemmer_en"):
        return own(porter)
    if m := re.fullmatch("(?:normalization|normalizer)_(ar|ckb|de|fa|hi)|(ar|ckb|de|fa|hi)_normalization", name):
        return each(lambda x: normalise(m[1] or m[2], x))
    if m := re.fullmatch("stemmer_(de|es|it|fr)(?:_light|_minimal)?|(de|es|it|fr)_(?:light|minimal)_stemmer", name):
        return own(lambda x: light_stem(m[1] or m[2], x))
    if m := re.fullmatch("stemmer_(da|no|sv)|(da|no|sv)_stemmer", name):
        return own(lambda x: nordic_stem(m[1] or m[2], x))
    if name in ("stemmer_ru", "ru_stemmer"):
        return own(russian_stem)
    if name == "possessive_en":
        return each(lambda x: re.sub("['’]s$", "", x, flags=re.I))
    if name == "reverse":
        return each(lambda x: x[::-1])
    if name in ("regexp", "pattern_replace"):
        return each(lambda x: regex.sub(o["pattern"], re.sub(r"\$\{?(\d+)\}?", r"\\g<\1>", o.get("replacement", "")), x))
    if name == "shingle":
        return lambda t: _shingles(t, o)
    if name in ("stop", "gse_stop"):
        stop = _stop_words(o.get("stopwords"))
        return lambda t: _stopped(t, stop)
    if name == "trim":
        return each(str.strip)
    if name == "truncate":
        return each(lambda x: x[: num("length", 10)])
    if name == "unicodenorm":
        return each(lambda x: unicodedata.normalize(o.get("form", "NFC").upper(), x))
    if name == "unique":
        return lambda t: list(dict.fromkeys(t))
    if name == "cjk_bigram":
        return lambda t: _bigrams(t, bool(o.get("output_unigram")))
    if name == "cjk_width":
        return each(lambda x: unicodedata.normalize("NFKC", x) if regex.search(r"[\uff00-\uffef]", x) else x)
    raise ValueError(f"unknown token filter {name}")


ANALYZERS: dict[str, dict] = {
    "standard": {"tokenizer": "standard", "token_filter": ["lower_case"]},
    "simple": {"tokenizer": "letter", "token_filter": ["lower_case"]},
    "keyword": {"tokenizer": "keyword"},
    "web": {"tokenizer": "web", "token_filter": ["lower_case", "stop"]},
    "regexp": {"tokenizer": "regexp", "token_filter": ["lower_case"]},
    "pattern": {"tokenizer": "regexp", "token_filter": ["lower_case"]},
    "stop": {"tokenizer": "letter", "token_filter": ["lower_case", "stop"]},
    "whitespace": {"tokenizer": "whitespace"},
    "en": {"tokenizer": "standard", "token_filter": ["possessive_en", "lower_case", "stop", "porter"]},
    "cjk": {"tokenizer": "standard", "token_filter": ["cjk_width", "lower_case", "cjk_bigram"]},
    "de": {"tokenizer": "standard", "token_filter": ["lower_case", "de_normalization", "de_light_stemmer"]},
    "fr": {"tokenizer": "standard", "token_filter": ["elision_fr", "lower_case", "fr_minimal_stemmer"]},
    "es": {"tokenizer": "standard", "token_filter": ["lower_case", "es_light_stemmer"]},
    "it": {"tokenizer": "standard", "token_filter": ["elision_it", "lower_case", "it_light_stemmer"]},
    "ar": {"tokenizer": "standard", "token_filter": ["lower_case", "ar_normalization"]},
    "ckb": {"tokenizer": "standard", "token_filter": ["ckb_normalization", "lower_case"]},
    "fa": {"tokenizer": "standard", "char_filter": ["zero_width_non_joiner"], "token_filter": ["lower_case", "ar_normalization", "fa_normalization"]},
    "hi": {"tokenizer": "standard", "token_filter": ["lower_case", "hi_normalization"]},
    "gse_standard": {"tokenizer": "gse_standard", "token_filter": ["lower_case"]},
    "gse_search": {"tokenizer": "gse_search", "token_filter": ["lower_case"]},
}


for _lang in ("da", "no", "ru", "sv"):
    ANALYZERS[_lang] = {"tokenizer": "standard", "token_filter": ["lower_case", {"type": "stop", "stopwords": f"_{_lang}_"}, f"{_lang}_stemmer"]}
ANALYZERS["nl"] = {"tokenizer": "standard", "token_filter": ["lower_case", {"type": "stop", "stopwords": "_nl_"}]}  # no stemmer here, nor for the next
for _lang in ("fi", "hu", "pt", "ro", "tr"):  # neither stop words nor stemmers: give a token_filter of your own
    ANALYZERS[_lang] = {"tokenizer": "standard", "token_filter": ["lower_case"]}


def _named(x, custom: dict | None) -> tuple[str, dict]:
    if isinstance(x, dict):
        return x["type"], x
    o = (custom or {}).get(x)
    return (o["type"], o) if o else (x, {})


def analyze(text: str, spec: str | dict = "standard", settings: dict | None = None) -> list[str]:
    """Tokens of text under an analyzer's name or its definition (tokenizer, token_filter or filter, char_filter)."""
    return [str(t) for t in analyze_tokens(text, spec, settings)]


def analyze_tokens(text: str, spec: str | dict = "standard", settings: dict | None = None) -> list[Token]:
    """Tokens with their places, kinds and steps. Places count in the text that the character filters leave."""
    s = settings or {}
    if isinstance(spec, dict) and "analyzer" in spec:
        spec = spec["analyzer"]
    if isinstance(spec, str):
        spec = (s.get("analyzer") or {}).get(spec) or ANALYZERS[LANGUAGES.get(spec, spec)]
    if "type" in spec and "tokenizer" not in spec:
        base = dict(ANALYZERS[LANGUAGES.get(spec["type"], spec["type"])])
        if spec.get("pattern"):
            base["tokenizer"] = {"type": "regexp", "pattern": spec["pattern"]}
        filters = list(base.get("token_filter", []))
        if spec.get("lowercase") is False:
            filters.remove("lower_case")
        if spec.get("stopwords"):
            filters = [f for f in filters if f != "stop"] + [{"type": "stop", "stopwords": spec["stopwords"]}]
        spec = base | {"token_filter": filters + list(spec.get("token_filter") or spec.get("filter") or []), "char_filter": list(base.get("char_filter", [])) + list(spec.get("char_filter") or [])}
    for c in spec.get("char_filter") or []:
        text = char_filter(*_named(c, s.get("char_filter")))(text)
    out = tokenizer(*_named(spec.get("tokenizer", "standard"), s.get("tokenizer")))(text)
    for f in spec.get("token_filter") or spec.get("filter") or []:
        out = token_filter(*_named(f, s.get("token_filter") or s.get("filter")))(out)
    return [t if isinstance(t, Token) else Token(t) for t in out if t != ""]


TOKENS = "array<struct<token:string,start_offset:int,end_offset:int,position:int,type:string,keyword:boolean>>"


def analyze_rows(df: DataFrame) -> DataFrame:
    """Rows (name, request, settings, text), request and settings as JSON, plus `tokens`: an analysis request each.

    Offsets count bytes of UTF-8; position is the step from the token before.
    """
    import json

    import pyarrow as pa

    struct = pa.struct([("token", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("position", pa.int32()), ("type", pa.string()), ("keyword", pa.bool_())])

    def run(it):
        for b in it:
            out = []
            for request, settings, text in zip(*(b.column(c).to_pylist() for c in ("request", "settings", "text")), strict=True):
                size = lambda i, t=text or "": len(t[:i].encode())
                out.append([{"token": str(t), "start_offset": size(t.start), "end_offset": size(t.end), "position": t.step, "type": t.kind, "keyword": t.keyword} for t in analyze_tokens(text or "", json.loads(request), json.loads(settings or "{}"))])
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(struct))], names=[*b.schema.names, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "tokens")
    return df.drop("tokens").mapInArrow(run, f"{fields}, tokens {TOKENS}")


_CJK_JVM = r"[\p{IsHan}\p{IsHiragana}]"
_RUN_JVM = r"(?:(?!" + _CJK_JVM + r")[\p{L}\p{M}\p{N}_])+"
_STANDARD_JVM = _CJK_JVM + "|" + _RUN_JVM + "(?:['\u2019.:\u00b7]" + _RUN_JVM + ")*"


def tokens(text: Column, name: str = "regexp") -> Column:
    """Tokens as a JVM-side array column, for the analyzers that expressions can say."""
    t = F.coalesce(text, F.lit(""))
    low = lambda a: F.transform(a, F.lower)
    if name in ("regexp", "pattern"):
        return low(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)))
    if name == "standard":
        return low(F.regexp_extract_all(t, F.lit(_STANDARD_JVM), F.lit(0)))
    if name == "simple":
        return low(F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)))
    if name == "stop":
        return F.filter(tokens(text, "simple"), lambda x: ~x.isin(*sorted(STOP_EN)))
    if name == "whitespace":
        return F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))
    if name == "keyword":
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
    return analyze_udf(name)(t)


def analyze_udf(spec: str | dict, settings: dict | None = None):
    """An Arrow function from strings to tokens, for analyzers that expressions can't say."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else analyze(x, spec, settings))

    return run


def shingle_tokens(t: Column, n: int = 2, sep: str = " ") -> Column:
    """Joined runs of n tokens."""
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), sep)))


def edge_ngrams(t: Column, lo: int, hi: int) -> Column:
    """Prefixes of lo to hi characters of each token."""
    return F.flatten(F.transform(t, lambda x: F.transform(F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda n: n <= F.char_length(x)), lambda n: F.substring(x, F.lit(1), n))))
