"""Keyed permutations that turn a value into another of the same form."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import lru_cache

ROUNDS = 6
#: Alphabets whose letters only take each other's place.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x3B1, 0x3C2))), "".join(map(chr, range(0x391, 0x3A2))), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430)))]
PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}


@lru_cache(1 << 16)
def letters_like(c: str) -> tuple[str, int] | None:
    """The characters that may take a digit's or letter's place, and which of them it is. Beyond the alphabets these are the letters of its case in
    its 128 code points; None for what stays, such as letters whose case can't be changed and changed back."""
    if c in PLACE:
        alphabet, place = PLACE[c]
        return alphabet, place
    if not c.isalpha():
        return None
    kind, first = unicodedata.category(c), ord(c) & ~127
    steady = lambda x: len(x.lower()) == len(x.upper()) == 1 and x.upper().lower() == x.lower() and x.lower().upper() == x.upper()
    own = "".join(x for x in map(chr, range(first, first + 128)) if x not in PLACE and unicodedata.category(x) == kind and steady(x))
    return (own, own.index(c)) if c in own and len(own) > 1 else None


def keyed(key: bytes, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "big")


def _network(x: int, bits: int, key: bytes, tweak: str, back: bool) -> int:
    half = bits // 2
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (keyed(key, tweak, str(bits), str(r), str(left)) & mask), left
        else:
            left, right = right, left ^ (keyed(key, tweak, str(bits), str(r), str(right)) & mask)
    return left << half | right


def permuted(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1 (a Feistel network, walked until it is back in range), or its inverse."""
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    x = _network(x, bits, key, tweak, back)
    while x >= n:
        x = _network(x, bits, key, tweak, back)
    return x


def moved(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1 that leaves nothing in its place: one step along a keyed cycle through all values."""
    return permuted((permuted(x, n, key, tweak) + 1) % n, n, key, tweak, back=True) if n > 1 else x


#: Characters permuted together.
HELD = 256


def chained(step: Callable[[str, bytes, str], str], text: str, key: bytes, tweak: str) -> str:
    """step for each HELD characters; those before are part of the tweak, so that still no two texts become one."""
    out = []
    for at in range(0, max(1, len(text)), HELD):
        out.append(step(text[at : at + HELD], key, tweak))
        if at + HELD < len(text):
            tweak = f"{keyed(key, tweak, text[at : at + HELD]):x}"
    return "".join(out)


def same_form(text: str, key: bytes, tweak: str) -> str:
    """Another string with a digit, a small or a capital letter of the same script at each such place; the rest stays."""
    return chained(_same_form, text, key, tweak)


def hexadecimal(text: str, key: bytes, tweak: str) -> str:
    """Another string of as many small hex digits."""
    return chained(lambda t, k, w: f"{moved(int(t, 16), 16 ** len(t), k, f'{w} {len(t)}'):0{len(t)}x}", text, key, tweak)


def _same_form(text: str, key: bytes, tweak: str) -> str:
    """Another string with a digit, a small or a capital letter of the same script at each such place; the rest stays.

    Strings of one form are permuted, so two never become one, and none stays as it is.
    """
    like = [letters_like(c) for c in text]
    at = [i for i, of in enumerate(like) if of]
    sizes = [len(like[i][0]) for i in at]
    x, n = 0, 1
    for i, size in zip(at, sizes):
        x, n = x * size + like[i][1], n * size
    form = "".join(of[0][0] if of else c for c, of in zip(text, like, strict=True))
    x = moved(x, n, key, f"{tweak}\0{form}")
    out = list(text)
    for i, size in zip(reversed(at), reversed(sizes)):
        x, digit = divmod(x, size)
        out[i] = like[i][0][digit]
    return "".join(out)


#: Syllables of made-up names: by script, consonants and vowels, how names of women and men end, and how others don't.
#: No two endings can be taken for each other or for syllables, so what stands before them can be read back.
SCRIPTS = {
    "latin": ("b d f g k l m n p r s t v z br dr gl kr st tr".split(), "a e i o u".split(), ["a", "ia", "elle"], ["o", "us", "an", "ert"], "snt"),
    "cyrillic": ("б в г д з к л м н п р с т ф".split(), "а е и о у".split(), ["а", "ия"], ["ан", "ор", "ей"], "нр"),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο υ".split(), ["α", "ια", "ινη"], ["ος", "ης", "ας"], "σ"),
}
#: Letters of a script's names, fewest first, so that common names stay short.
LETTERS = {
    "latin": ("".join(map(chr, range(97, 123))), "".join(map(chr, [*range(97, 123), 39, 45, 0x2019, *range(0xDF, 0x180)]))),
    "cyrillic": ("".join(map(chr, range(0x430, 0x450))) + "ё", "".join(map(chr, [*range(0x430, 0x460), 39, 45, 0x2019]))),
    "greek": ("".join(map(chr, range(0x3AC, 0x3CF))), "".join(map(chr, [*range(0x3AC, 0x3CF), 39, 45, 0x2019]))),
}
#: Names of more letters are numbered by a hash of 128 bits.
LONGEST = 64


def script_of(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def number_of(word: str, key: bytes) -> int:
    """A number that no other word of the script has."""
    tiers = LETTERS[script_of(word)]
    if len(word) > LONGEST:
        return 4 * keyed(key, "long name", word) + 3
    tier = next((n for n, letters in enumerate(tiers) if all(c in letters for c in word)), 2)
    size = len(tiers[tier]) if tier < 2 else 0x110000
    x = 0
    for c in word:  # shorter words first, so the length is told as well
        x = x * size + (tiers[tier].index(c) if tier < 2 else ord(c)) + 1
    return 4 * x + tier


#: Endings of names of women, by script. All other words count as men's names.
FEMALE = {"latin": ("a", "ah", "elle", "ette", "ine", "anne", "ise", "ice"), "cyrillic": ("а", "я"), "greek": ("α", "η", "ω")}


def gender_of(word: str) -> str:
    """f or m, by the word's own ending: wherever it stands, and after whatever title, it counts alike."""
    return "f" if word.lower().endswith(FEMALE[script_of(word)]) else "m"


def name(word: str, key: bytes, tweak: str, gender: str | None) -> str:
    """A made-up name in the word's script and capitals, with an ending of its gender if that is known.

    Numbers of words are permuted among those of as many syllables, so two words never become one, whatever their genders.
    """
    consonants, vowels, female, male, others = SCRIPTS[script_of(word)]
    old = word.lower()
    x, space, count = number_of(old, key), len(consonants) * len(vowels), 3
    while x >= space**count:
        count += 1
    least = space ** (count - 1) if count > 3 else 0
    x = least + permuted(x - least, space**count - least, key, f"name {tweak} {script_of(word)} {count}")
    syllables = []
    for _ in range(count):
        x, place = divmod(x, space)
        syllables.append(consonants[place % len(consonants)] + vowels[place // len(consonants)])
    y, end = divmod(keyed(key, "name", tweak, old), 12)
    endings = female if gender == "f" else male if gender == "m" else None
    last = [c for c in consonants if endings or len(c) == 1 and c not in others]
    out = "".join(syllables) + last[y % len(last)] + (endings[end % len(endings)] if endings else "")
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[:1].isupper() else out


def cached(f: Callable[[str, str], str], size: int = 1 << 16) -> Callable[[str, str], str]:
    return lru_cache(size)(f)
