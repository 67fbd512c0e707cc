"""Syllables by hyphenation-style patterns.

A pattern is a piece of a word ('.' is its border) with a digit before letters. Every
place of a word takes the highest digit of all patterns that fit there; where the
digit before a vowel is odd a syllable's vowel begins. Without a pattern a vowel behind
a consonant begins one (1), a vowel behind a vowel does not (0), or does (1) where the language
divides neighbouring vowels. ``C`` stands for each consonant.
"""

from __future__ import annotations

import unicodedata

VOWELS = frozenset("aeiouyàâäáãåæèéêëíîïìòóôöõøœùúûüÿ")
CONSONANTS = "bcdfghjklmnpqrstvwxzßç"

# Where English joins, divides or drops vowels.
EN = """
C2e. C2es. C2ed. .th3e. .b3e. .h3e. .sh3e. .m3e. .w3e. bl3e cl3e dl3e fl3e gl3e kl3e pl3e sl3e tl3e zl3e br3e. cr3e. gr3e. tr3e. br3es. cr3es. gr3es. tr3es.
s3es. z3es. x3es. ch3es. sh3es. c3es. g3es. t3ed. d3ed. dr3ed. cr3ed.
C2ement l3ement .c3ement C2eful C2eless C2ely. C2eness .som2e .som4eC lik2ew ther2ef wher2e .saf2et nin2et .bus2ines
i3a ci4a ti4a gi4a si4a. si4an rri4ag lli4am li4ament i3o ti4o si4o ci4o gi4o xi4o uni4on lli4on ni4on. ni4ons i3u
i3enc .sci5enc ci4enc ti4enc i3ent ci4ent ti4ent fri4end i3ety i3et. di3et soci3et li3er. pi3er. ni3er. rri3er di3er. i3est. .pri4est i3i
u3a qu4a gu4a su4a u3o qu4o cru3el fu3el du3el influ3en flu3en ru3in flu3id tu3it nu3it u3um
e3a. .Ce4a. .ple4a. .fle4a. cre3a re3al the3at ide3al line3ar nucle3ar e3an. .me4an. .le4an. .be4an. .cle4an. oce4an .re3ac re3eva re3ele e3o pe4op ge4o ce4ous le4op e3um nucle3us e3ing .re3in .re4in. .re4ins
o3ing hero3ic po3et po3em co3ef co3ex co3ali .co3op .co3ord a3o na3ï na3iv a3ic. y3i y3e y3a y3o
"""
# Where German joins vowels (others divide) or divides what looks joined.
DE = """
e5um. i4e e4i a4i a4u ä4u e4u a4a e4e o4o e4y a4y u4i. q4u ei5e ei5u eu5e äu5e au5e ie5i ee5i Ci5en. .wi6en. kni6en. .be5en .be5eh .be5ein .be5inh .ge5eh .ge5ei .ge5en
"""
# Where French divides vowels (others join) or leaves an e mute.
FR = """
é3a é3o é3i é3u é3e é4e. é4es. u3é qu4é gu4é a3ï o3ï ï3e a3o o3é o3é cli3ent.
C2e. C2es. C2ent. m3ent. rm4ent. souv3ent. .v3ent. c3ent. arg3ent. urg3ent. .ag3ent. id3ent. ud3ent. és3ent. abs3ent. .tal3ent. i4e. i4es. u4e. u4es.
"""


def _parsed(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for pattern in text.split():
        for c in CONSONANTS if "C" in pattern else ("",):
            letters, digits = "", []
            for x in pattern.replace("C", c):
                if x.isdigit():
                    digits.append((len(letters), int(x)))
                else:
                    letters += x
            out.setdefault(letters, []).extend(digits)
    return out


PATTERNS = {"en": _parsed(EN), "de": _parsed(DE), "fr": _parsed(FR), "other": {}}
LONGEST = {k: max(map(len, p), default=0) for k, p in PATTERNS.items()}


def _is_vowel(w: str, k: int, lang: str) -> bool:
    c = w[k]
    if c == "y":  # a consonant before a vowel, unless behind a consonant
        return not (k + 1 < len(w) and w[k + 1] in VOWELS and (k == 0 or w[k - 1] in VOWELS))
    if c == "u" and k and w[k - 1] == "q":
        return False
    return c in VOWELS


def syllables(word: str, lang: str) -> int:
    """Syllables of a word, at least one; ``lang``: 'en', 'de', 'fr' or 'other'."""
    w = unicodedata.normalize("NFC", word).lower()
    patterns, most = PATTERNS[lang], LONGEST[lang]
    vowel = [_is_vowel(w, k, lang) for k in range(len(w))]
    hiatus = lang == "de"
    level = [int(v and (k == 0 or not vowel[k - 1] or hiatus)) for k, v in enumerate(vowel)]
    framed = f".{w}."
    for a in range(len(framed)):
        for b in range(a + 2, min(len(framed), a + most) + 1):
            for place, digit in patterns.get(framed[a:b], ()):
                k = a + place - 1
                if 0 <= k < len(w) and digit > level[k]:
                    level[k] = digit
    return max(1, sum(v and x % 2 for v, x in zip(vowel, level)))
