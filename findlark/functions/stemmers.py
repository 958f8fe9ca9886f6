"""Snowball stemmers written from the published algorithm descriptions: English (Porter2) and Russian."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(f"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short(w: str) -> bool:
    """Ends in a short syllable."""
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    w = word.replace("’", "'").replace("‘", "'")
    if len(w) <= 2:
        return word
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = w.removeprefix("'")
    w = re.sub(r"^y", "Y", w)
    w = re.sub(f"(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif re.search(f"[{_V}]", w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif _short(w) and len(w) <= r1:
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    if w[-4:-3] == "l":
                        w = w[:-1]
                elif s == "li":
                    if w[-3:-2] and w[-3] in "cdeghkmnrt":
                        w = w[:-2]
                else:
                    w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_RV = "аеиоуыэюя"
_GERUND = re.compile(r"(?:(?<=[ая])(?:вшись|вши|в)|ывшись|ившись|ывши|ивши|ыв|ив)$")
_REFLEXIVE = re.compile(r"(?:ся|сь)$")
_ADJECTIVE = re.compile(r"(?:ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)$")
_PARTICIPLE = re.compile(r"(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$")
_VERB = re.compile(
    r"(?:(?<=[ая])(?:ешь|нно|ете|йте|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)"
    r"|уйте|ейте|ите|или|ыли|ила|ыла|ена|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)$"
)
_NOUN = re.compile(r"(?:иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|и|ы|ь|ю|я|а|е|й|о|у)$")


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RV}]", w)
    if not m:
        return w
    at = m.end()
    head, rv = w[:at], w[at:]
    m = re.search(f"[{_RV}][^{_RV}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"[{_RV}][^{_RV}]", w[r1:])
    r2 = r1 + m.end() if m else len(w)

    def cut(pattern: re.Pattern, s: str) -> str | None:
        m = pattern.search(s)
        return s[: m.start()] if m else None

    got = cut(_GERUND, rv)
    if got is None:
        rv = _REFLEXIVE.sub("", rv)
        got = cut(_ADJECTIVE, rv)
        if got is not None:
            part = cut(_PARTICIPLE, got)
            got = got if part is None else part
        else:
            got = cut(_VERB, rv)
            if got is None:
                got = cut(_NOUN, rv)
    rv = rv if got is None else got
    rv = rv.removesuffix("и")
    m = re.search(r"ость?$", rv)
    if m and len(head) + m.start() >= r2:
        rv = rv[: m.start()]
    if rv.endswith(("ейше", "ейш")):
        rv = rv.removesuffix("ейше").removesuffix("ейш")
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif rv.endswith("ь"):
        rv = rv[:-1]
    return head + rv
