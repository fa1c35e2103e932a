"""Stemmers of other languages by the published Snowball descriptions: regions R1 and R2, then steps of endings.

R1 is what follows the first consonant behind a vowel, R2 the same within R1. An ending goes only where it stands in the
region that its step names. Languages without one of these descriptions here keep the light stemmers of `text`.
"""

from __future__ import annotations

import re


def region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region behind the first consonant behind a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def longest(word: str, endings: str) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings.split() if word.endswith(e)), key=len, default="")


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{vowels}])[uy](?=[{vowels}])", lambda m: m[0].upper(), w)
    first = region(w, vowels)
    second, first = region(w, vowels, first), max(3, first)
    e = longest(w, "em ern er e en es s")
    if e and len(w) - len(e) >= first and (e != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = longest(w, "en er est st")
    if e and len(w) - len(e) >= first and (e != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: -len(e)]
    e = longest(w, "end ung ig ik isch lich heit keit")
    at = len(w) - len(e)
    if e and at >= second:
        if e in ("end", "ung"):
            w = w[:at]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= second:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if w[:at].endswith("e") else w[:at]
        elif e in ("lich", "heit"):
            w = w[:at]
            w = w[:-2] if w.endswith(("er", "en")) and len(w) - 2 >= first else w
        else:
            w = w[:at]
            inner = longest(w, "lich ig")
            w = w[: len(w) - len(inner)] if inner and len(w) - len(inner) >= second else w
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


def _north(word: str, vowels: str, plain: str, before_s: str) -> tuple[str, int]:
    """First step of the Scandinavian stemmers: an ending in R1 goes, or an s behind certain letters."""
    first = max(3, region(word, vowels))
    e = longest(word, f"{plain} s")
    if e and len(word) - len(e) >= first and (e != "s" or word[-2:-1] in tuple(before_s)):
        return word[: -len(e)], first
    return word, first


def swedish(word: str) -> str:
    w, first = _north(word, "aeiouyäåö", "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "bcdfghjklmnoprtvy")
    if len(w) - 2 >= first and w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    e = longest(w, "lig ig els löst fullt")
    if e and len(w) - len(e) >= first:
        w = w[:-1] if e in ("löst", "fullt") else w[: -len(e)]
    return w


def norwegian(word: str) -> str:
    vowels = "aeiouyæåø"
    first = max(3, region(word, vowels))
    e = longest(word, "erte ert")
    if e and len(word) - len(e) >= first:
        w = word[: len(word) - len(e) + 2]
    elif word.endswith("ks") and len(word) - 1 >= first:
        w = word if word[-3:-2] in tuple(vowels) else word[:-1]
    else:
        w, first = _north(word, vowels, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", "bcdfghjlmnoprtvyz")
    if len(w) - 2 >= first and w.endswith(("dt", "vt")):
        w = w[:-1]
    e = longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov")
    return w[: -len(e)] if e and len(w) - len(e) >= first else w


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    w, first = _north(word, vowels, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "abcdfghjklmnoprtvyzå")

    def shortened(w: str) -> str:
        return w[:-1] if len(w) - 2 >= first and w.endswith(("gd", "dt", "gt", "kt")) else w

    w = shortened(w)
    w = w[:-2] if w.endswith("igst") else w
    e = longest(w, "ig lig elig els løst")
    if e and len(w) - len(e) >= first:
        w = w[:-1] if e == "løst" else shortened(w[: -len(e)])
    if len(w) - 2 >= first and len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels:
        w = w[:-1]
    return w


def dutch(word: str) -> str:
    vowels = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(rf"^y|(?<=[{vowels}])y|(?<=[{vowels}])i(?=[{vowels}])", lambda m: m[0].upper(), w)
    first = region(w, vowels)
    second, first = region(w, vowels, first), max(3, first)

    def undoubled(w: str) -> str:
        return w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    def without_en(w: str, size: int) -> str:
        rest = w[: len(w) - size]
        return undoubled(rest) if len(rest) >= first and rest and rest[-1] not in vowels and not rest.endswith("gem") else w

    def without_e(w: str) -> tuple[str, bool]:
        ok = w.endswith("e") and len(w) - 1 >= first and w[-2:-1] not in tuple(vowels)
        return (undoubled(w[:-1]), True) if ok else (w, False)

    e = longest(w, "heden ene en se s")
    if e == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= first else w
    elif e in ("en", "ene"):
        w = without_en(w, len(e))
    elif e and len(w) - len(e) >= first and w[len(w) - len(e) - 1] not in vowels + "j":
        w = w[: -len(e)]
    w, gone = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= second and w[-5] != "c":
        w = w[:-4]
        w = without_en(w, 2) if w.endswith("en") else w
    e = longest(w, "end ing ig lijk baar bar")
    if e and len(w) - len(e) >= second:
        rest = w[: -len(e)]
        if e in ("end", "ing"):
            w = rest[:-2] if rest.endswith("ig") and not rest.endswith("eig") and len(rest) - 2 >= second else undoubled(rest)
        elif e == "ig":
            w = w if rest.endswith("e") else rest
        elif e == "lijk":
            w = without_e(rest)[0]
        elif e == "baar" or gone:
            w = rest
    if len(w) >= 4 and w[-3] == w[-2] and w[-2] in "aeou" and w[-4] not in vowels and w[-1] not in vowels + "I":
        w = w[:-2] + w[-1]
    return w.replace("I", "i").replace("Y", "y")


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = word
    first = region(w, vowels)
    second = region(w, vowels, first)
    if len(w) < 2:
        third = len(w)
    elif w[1] not in vowels:  # behind the next vowel
        third = next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    elif w[0] in vowels:  # behind the next consonant
        third = next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    else:
        third = min(3, len(w))
    bare = str.maketrans("áéíóú", "aeiou")

    def ends(e: str, region_at: int) -> bool:
        return bool(e) and len(w) - len(e) >= region_at

    # attached pronouns
    e = longest(w, "me se sela selo selas selos la le lo las les los nos")
    if ends(e, third):
        rest = w[: -len(e)]
        head = longest(rest, "iéndo ándo ár ér ír ando iendo ar er ir yendo")
        if head and len(rest) - len(head) >= third and (head != "yendo" or rest.endswith("uyendo")):
            w = rest[: len(rest) - len(head)] + head.translate(bare)
    before = w
    e = longest(w, "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
    if e == "amente" and ends(e, first):
        w = w[:-6]
        if w.endswith("iv") and ends("iv", second):
            w = w[:-2]
            w = w[:-2] if w.endswith("at") and ends("at", second) else w
        elif longest(w, "os ic ad") and ends("os", second):
            w = w[:-2]
    elif e and e != "amente" and ends(e, second):
        w = w[: -len(e)]
        if e in ("logía", "logías"):
            w += "log"
        elif e in ("ución", "uciones"):
            w += "u"
        elif e in ("encia", "encias"):
            w += "ente"
        elif e in "adora ador ación adoras adores aciones ante antes ancia ancias".split():
            w = w[:-2] if w.endswith("ic") and ends("ic", second) else w
        elif e == "mente":
            inner = longest(w, "ante able ible")
            w = w[: len(w) - len(inner)] if ends(inner, second) else w
        elif e in ("idad", "idades"):
            inner = longest(w, "abil ic iv")
            w = w[: len(w) - len(inner)] if ends(inner, second) else w
        elif e in ("iva", "ivo", "ivas", "ivos"):
            w = w[:-2] if w.endswith("at") and ends("at", second) else w
    if w == before:
        e = longest(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos")
        if ends(e, third) and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            short = "en es éis emos"
            e = longest(w, f"{short} arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")
            if ends(e, third):
                w = w[: -len(e)]
                if e in short.split() and w.endswith("gu"):
                    w = w[:-1]
    e = longest(w, "os a o á í ó e é")
    if ends(e, third):
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= third:
            w = w[:-1]
    return w.translate(bare)


STEMMERS = {"de": german, "sv": swedish, "no": norwegian, "da": danish, "nl": dutch, "es": spanish}
