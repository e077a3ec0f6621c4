"""Personal data replaced by keyed surrogates of the same type and form, the same one for the same entity everywhere."""

from __future__ import annotations

import datetime
import ipaddress
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import quoted, written
from quillmark.llm.surrogates import cached, gender_of, hexadecimal, keyed, moved, name, same_form

#: Runs of characters that a number can stand in, and the kinds of numbers, in the order in which a place is tried.
RUN = re.compile(r"[+(\d][\d().+ -]{6,}", re.A)
NUMBERS = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{13,19})(?![\w]|-\d)"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|-\d)"
    r")",
    re.A,
)
EMAIL = re.compile(r"[\w.%+\-]{1,64}@[^\W_](?:[\w\-]{0,62}\.){1,8}[^\W\d_][\w\-]{1,62}")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SIX = re.compile(r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*(?:\.\d+){0,3}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}")
MAC = re.compile(r"[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}")
ASSIGNED = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_\-./+=]{12,})")
MARKED = re.compile(r"((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,}|eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,})")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END")
BIRTH = re.compile(r"(?i:date of birth|birth ?date|born on|dob|geboren am|geburtsdatum|née? le|nacid[oa] el|fecha de nacimiento|date de naissance)[:, ]{0,3}(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d])")
#: Titles, and what else stands before a name: phrases, greetings (a comma or the like must follow) and endings of letters.
TITLES = [
    "Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Mlle", "Госпожа", "г-жа", "Κυρία", "κα",
    "Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "г-н", "Κύριος", "κ", "Dr", "Prof", "Professor", "Doctor", "Доктор", "Δρ",
]
PHRASES = ["my name is", "My name is", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "меня зовут", "Меня зовут"]
#: The same in languages that write no space or no capitals; a name of Han or Hangul letters follows at once, or words follow.
BARE_PHRASES = ["我叫", "我的名字是", "我的名字叫", "我是叫", "私の名前は", "제 이름은", "내 이름은", "اسمي", "שמי", "ชื่อของฉันคือ"]
GREETINGS = ["Dear", "Hi", "Hello", "Hey", "Liebe", "Lieber", "Hallo", "Querida", "Querido", "Hola", "Cher", "Chère", "Bonjour"]
CLOSINGS = ["Regards,", "regards,", "Sincerely,", "sincerely,", "Grüße,", "Grüßen,", "Cordialement,", "Saludos,"]
#: What follows a greeting and is no name.
NO_NAMES = {"All", "Sir", "Madam", "World", "Team", "Everyone", "Everybody", "Friends", "Colleagues", "There", "Zusammen", "Welt", "Mundo", "Monde", "Todos", "Tous", "Ladies", "Customer"}
#: Words of street addresses.
AFTER_NAME = ["Street", "Avenue", "Road", "Lane", "Boulevard", "Drive"]
BEFORE_NAME = ["rue", "avenue", "boulevard", "place", "Calle", "Avenida", "Plaza"]
JOINED = ["straße", "strasse", "gasse", "allee"]
CAPITAL = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
STREET = re.compile(
    rf"(?<!\w)\d{{1,5}} (?:{CAPITAL} ){{1,3}}(?:{'|'.join(AFTER_NAME)})(?!\w)"
    rf"|(?<!\w)\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:de la |de |du |des |d'|l')?{CAPITAL}"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza) (?:de la |de |del )?{CAPITAL},? \d{{1,4}}(?!\w)"
    rf"|(?<!\w){CAPITAL}(?:{'|'.join(JOINED)}) \d{{1,4}}[a-z]?(?!\w)"
)
WORD = re.compile(r"[^\W\d_][\w'’-]*")
POSSESSIVE = re.compile(r"['’]s$")
ENTITY = "struct<kind:string,start:int,end:int,surrogate:string,entity:long>"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049


def hints() -> ahocorasick.Automaton:
    """What makes a closer look worth its time, with the kind of look; one pass over a text finds all of them."""
    out = ahocorasick.Automaton()
    of: dict[str, str] = {}
    of |= dict.fromkeys(["token", "secret", "password", "passwd", "key"], "assigned") | dict.fromkeys(["Token", "Secret", "Password", "Passwd", "Key", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "KEY"], "assigned")
    of |= dict.fromkeys(["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ"], "marked") | {"-----BEGIN ": "pem"}
    of |= dict.fromkeys(["irth", "orn on", "dob", "DOB", "Dob", "eboren am", "eburtsdatum", "né le", "née le", "acido el", "acida el", "acimiento", "aissance"], "birth")
    of |= dict.fromkeys([*(w + " " for w in BEFORE_NAME), *(" " + w for w in AFTER_NAME), *(w + " " for w in JOINED)], "street")
    of |= dict.fromkeys(BARE_PHRASES, "bare")
    of |= dict.fromkeys(GREETINGS, "greeting") | dict.fromkeys(CLOSINGS, "closing") | dict.fromkeys(PHRASES, "phrase") | dict.fromkeys(TITLES, "title")
    for word, kind in of.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


HINTS = hints()


def luhn(digits: str) -> int:
    """What the Luhn sum lacks to a multiple of ten, with the last digit counted in: 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def account_check(country: str, body: str) -> int:
    """The two check digits of an account number, 2 to 98."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def day_of(text: str) -> datetime.date | None:
    """The date of 2001-02-03, 3.2.2001 or 2/3/2001 (month first), if there is one from 1900 to 2099."""
    a, b, c = map(int, re.split(r"[-./]", text))
    try:
        day = datetime.date(a, b, c) if "-" in text else datetime.date(c, b, a) if "." in text else datetime.date(c, a, b)
    except ValueError:
        return None
    return day if 0 <= day.toordinal() - FIRST_DAY < DAYS else None


#: Letters of names that are written without spaces.
SOLID = re.compile("[\u3400-\u9fff\uf900-\ufaff]+|[\uac00-\ud7a3]+")


def caseless(word: str) -> bool:
    """Whether a word's script has no capitals."""
    return word[0].isalpha() and word[0].lower() == word[0].upper()


def solid_name(text: str, at: int) -> tuple[int, int] | None:
    """A name of Han or Hangul letters that begins there: a run of two to four, or three of a longer one."""
    m = SOLID.match(text, at)
    return (at, m.end() if m.end() - at <= 4 else at + 3) if m and m.end() - at > 1 else None


def name_at(text: str, at: int, most: int = 3) -> tuple[int, int] | None:
    """Up to so many words with a capital that begin there, without titles before them or a genitive's end."""
    start = end = None
    n = 0
    while n < most and (m := WORD.match(text, at)) and (m[0][0].isupper() or caseless(m[0])):
        if caseless(m[0]) and n == 2:
            break
        dot = text[m.end() : m.end() + 1] == "."
        if m[0] in TITLES:
            at = m.end() + dot + 1
            continue
        start, end, n = m.start() if start is None else start, m.end(), n + 1
        initial = dot and len(m[0]) == 1
        if text[m.end() + initial : m.end() + initial + 1] not in (" ", " "):
            break
        at = m.end() + initial + 1
    if start is None:
        return None
    return start, end - len(p[0]) if (p := POSSESSIVE.search(text[start:end])) else end


def hinted(text: str) -> Iterator[tuple[int, int, str]]:
    for last, (kind, length) in HINTS.iter(text):
        start, end = last + 1 - length, last + 1
        if kind == "assigned":
            at = start - 4 if text[max(0, start - 4) : start].lower() in ("api_", "api-") else start - 3 if text[max(0, start - 3) : start].lower() == "api" else start
            if (not at or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := ASSIGNED.match(text, at)):
                yield m.start(1), m.end(1), "secret"
        elif kind == "marked":
            if (not start or not text[start - 1].isalnum()) and (m := MARKED.match(text, start)):
                yield m.start(1), m.end(1), "secret"
        elif kind == "pem":
            if (m := PEM.match(text, start)) and (body := m[1].strip()):
                begin = m.end(1) - len(m[1].lstrip())
                yield begin, begin + len(body), "secret"
        elif kind == "birth":
            for m in BIRTH.finditer(text, max(0, start - 20), min(len(text), end + 40)):
                if day_of(m[1]):
                    yield m.start(1), m.end(1), "birth"
        elif kind == "street":
            for m in STREET.finditer(text, max(0, start - 80), min(len(text), end + 80)):
                yield m.start(), m.end(), "street"
        elif kind == "bare":
            at = end + (text[end : end + 1] in (" ", "\u00a0", "\u3000"))
            if found := solid_name(text, at) or (name_at(text, at) if at > end else None):
                yield *found, "name"
        elif not start or not (text[start - 1].isalnum() or text[start - 1] == "_"):
            dot = kind == "title" and text[end : end + 1] == "."
            gap = 0
            while gap < 3 and text[end + dot + gap : end + dot + gap + 1] in (" ", " ", *("\n\r" if kind == "closing" else "")):
                gap += 1
            if gap and (found := name_at(text, end + dot + gap, 4 if kind == "closing" else 3)):
                words = text[found[0] : found[1]].split()
                if kind == "greeting" and (text[found[1] : found[1] + 1] not in (",", "!", ":", "\n") or words[0] in NO_NAMES):
                    continue
                yield *found, "name"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    for run in RUN.finditer(text):
        at = run.start()
        while (m := NUMBERS.search(text, at, min(len(text), run.end() + 2))) and m.start() < run.end():
            kind, value = m.lastgroup, m[0]
            if kind != "card" or luhn(re.sub(r"\D", "", value)) == 0:
                found.append((m.start(), m.end(), kind))
            at = m.end()
    if "@" in text:
        for m in EMAIL.finditer(text):
            found.append((m.start(), m.end(), "email"))
            if before := re.search(rf"((?:{CAPITAL} ){{1,2}}{CAPITAL}) ?[<(]$", text[max(0, m.start() - 80) : m.start()]):
                shift = max(0, m.start() - 80)
                found.append((shift + before.start(1), shift + before.end(1), "name"))
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if (not m.start() or not text[m.start() - 1].isalnum()) and int(value[2:4]) == account_check(value[:2], value[4:]):
            found.append((m.start(), m.end(), "iban"))
    if ":" in text or "-" in text:
        for m in SIX.finditer(text):
            if kind := six_kind(m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]):
                found.append((m.start(), m.end(), kind))
    found += hinted(text)
    if names := [text[a:b] for a, b, k in found if k == "name"]:
        words = {w.rstrip(".") for n in names for w in n.split()}
        words = {x for w in words if len(w) > 1 for x in (w, w.upper())}
        found += again(text, words)
    out: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def again(text: str, words: set[str]) -> Iterator[tuple[int, int, str]]:
    """Where else words of names stand, those beside each other together. One pass over the text's words, however many names it has; names
    written without spaces are found inside runs as well."""
    start = end = None
    for m in WORD.finditer(text):
        own = POSSESSIVE.sub("", m[0])
        if own not in words or m.start() and text[m.start() - 1] in "'’-_" or m.start() and text[m.start() - 1].isalnum():
            continue
        if start is not None and text[end : m.start()] in (" ", "\u00a0"):
            end = m.start() + len(own)
            continue
        if start is not None:
            yield start, end, "name"
        start, end = m.start(), m.start() + len(own)
    if start is not None:
        yield start, end, "name"
    for w in (w for w in words if SOLID.fullmatch(w)):
        at = -1
        while (at := text.find(w, at + 1)) >= 0:
            yield at, at + len(w), "name"


def six_kind(value: str, before: str, after: str) -> str | None:
    """Whether this is an IPv6 or a MAC address."""
    if before.isalnum() or after.isalnum() or before in (":", "-") and before or after in ("-",) and after:
        return None
    if MAC.fullmatch(value):
        return "mac"
    if value.count(":") < 2 or sum(map(bool, value.split(":"))) < 3:  # a::b is rather a name in a program
        return None
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return "ip6"


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: letters without their case, and numbers without their punctuation."""
    if kind in ("card", "phone", "iban", "mac"):
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    if kind == "ip6":
        return str(int(ipaddress.IPv6Address(value)))
    if kind == "birth":
        return str(day_of(value))
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value) if kind in ("email", "name", "street") else value


PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ|")


class Surrogates:
    """Replacements under a key."""

    def __init__(self, key: bytes):
        self.key = keyed(key, "surrogates").to_bytes(16, "big")
        self.of = cached(self._of)
        self.word = cached(lambda word, _: same_form(word, self.key, "initial") if len(word) == 1 else same_form(word, self.key, "name") if caseless(word) else name(word, self.key, "", gender_of(word)))

    def __call__(self, kind: str, value: str) -> str:
        if kind == "name":
            return re.sub(WORD, lambda m: self.word(m[0], ""), value)
        if kind == "street":
            return self.street(value)
        new = self.of(kind, canonical(kind, value))
        if kind in ("card", "phone", "iban"):  # the digits go where digits were
            rest = iter(new)
            return "".join(next(rest) if c.isalnum() else c for c in value)
        if kind == "email":
            return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(value, new, strict=True))
        if kind == "mac":
            new = value[2].join(new[i : i + 2] for i in range(0, 12, 2))
            return new if value.upper() == value else new.lower()
        if kind == "ip6":
            new = ipaddress.IPv6Address(int(new))
            new = new.exploded if len(value) == 39 else str(new)
            return new.upper() if value.upper() == value and value.lower() != value else new
        if kind == "birth":
            day = datetime.date.fromisoformat(new)
            return new if "-" in value else f"{day:%d.%m.%Y}" if "." in value else f"{day:%m/%d/%Y}"
        return new

    def street(self, value: str) -> str:
        number = re.search(r"\d+", value)[0]
        value = value.replace(number, same_form(number, self.key, "house" + re.sub(r"\d+", "", value).lower()))

        def word(m: re.Match) -> str:
            if m[0] in AFTER_NAME + BEFORE_NAME or not m[0][0].isupper():
                return m[0]
            end = next((j for j in JOINED if m[0].endswith(j)), "")
            return self.word(m[0][: len(m[0]) - len(end)], "") + end

        return re.sub(WORD, word, value)

    def _of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, domain = value.partition("@")
            host, _, top = domain.rpartition(".")
            return f"{same_form(local, self.key, 'local')}@{same_form(host, self.key, 'host')}.{top}"
        if kind == "ip":
            x = moved(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, self.key, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "ip6":
            return str(moved(int(value), 1 << 128, self.key, "ip6"))
        if kind == "mac":
            return f"{moved(int(value, 16), 1 << 48, self.key, 'mac'):012X}"
        if kind == "birth":
            x = datetime.date.fromisoformat(value).toordinal() - FIRST_DAY
            return str(datetime.date.fromordinal(moved(x, DAYS, self.key, "birth") + FIRST_DAY))
        if kind == "card":  # the issuer's first digit stays, and the check digit is right
            body = value[0] + same_form(value[1:-1], self.key, "card" + value[0])
            return body + str(luhn(body + "0"))
        if kind == "phone":
            keep = min(2, len(value) - 7)
            return value[: max(0, keep)] + same_form(value[max(0, keep) :], self.key, "phone" + value[: max(0, keep)])
        if kind == "iban":
            body = same_form(value[4:], self.key, "iban" + value[:2])
            return f"{value[:2]}{account_check(value[:2], body):02d}{body}"
        prefix, hexed = kind = self._kind(value)
        if hexed:
            return hexadecimal(value, self.key, "secret")
        while True:  # the permutation goes on until the secret is of the old one's kind again, so that none of another kind becomes the same
            value = prefix + same_form(value[len(prefix) :], self.key, "secret" + prefix)
            if self._kind(value) == kind:
                return value

    @staticmethod
    def _kind(value: str) -> tuple[str, bool]:
        return PREFIX.match(value)[0], re.fullmatch("[0-9a-f]+", value) is not None


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[dict]]:
    out, at, found = [], 0, []
    length = 0
    for start, end, kind in entities(text):
        new = surrogates(kind, text[start:end])
        out += [text[at:start], new]
        length += start - at
        entity = keyed(surrogates.key, "entity", kind, canonical(kind, text[start:end])) & (1 << 63) - 1
        found.append({"kind": kind, "start": length, "end": length + len(new), "surrogate": new, "entity": entity})
        length, at = length + len(new), end
    return ("".join([*out, text[at:]]) if found else text), found


def collisions(rewritten: DataFrame) -> DataFrame:
    """(kind, surrogate) that different entities of rewritten rows got; none, if their kinds are permuted as they should be."""
    each = rewritten.select(F.explode("entities").alias("e")).select("e.kind", F.lower("e.surrogate").alias("surrogate"), "e.entity")
    same = F.when(F.col("kind").isin("card", "phone", "iban", "mac"), F.regexp_replace("surrogate", "[^0-9a-z]", "")).otherwise(F.col("surrogate"))
    sides = each.groupBy("kind", same.alias("surrogate")).agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    return sides.where("a != b").select("kind", "surrogate")


def checked(docs: DataFrame, key: bytes, *, attempts: int = 3) -> DataFrame:
    """`replace`, written, and looked through for collisions; with one, all is done again under another key. Permutations leave none to find."""
    for n in range(attempts):
        done = written(replace(docs, keyed(key, "attempt", str(n)).to_bytes(16, "big") if n else key))
        if not collisions(done).limit(1).count():
            return done
    raise ValueError(f"two entities shared a surrogate under each of {attempts} keys")


def rewriter(key: bytes) -> Callable[[Column], Column]:
    """A column function of text: struct(text, entities)."""

    @F.pandas_udf(f"text string, entities array<{ENTITY}>")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(key)
        for texts in batches:
            rows = [(None, []) if t is None else replaced(t, surrogates) for t in texts]
            yield pd.DataFrame(rows, columns=["text", "entities"])

    return replace


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text rewritten and entities(kind, start, end, surrogate, entity): places in the new text; entity is a keyed
    number of what stood there.

    E-mail addresses, phone numbers, valid card and account numbers, IPv4, IPv6 and MAC addresses, social security numbers, secrets
    and private keys, dates of birth, street addresses, and names: after a title, a greeting, "my name is" and the like, before
    an address of e-mail, under a letter, and wherever else the words of such a name stand in the same text; in scripts without capitals
    after a title or "my name is". Letters of any script take part; those without a neighbour of their case in their 128 code points stay. Surrogates keep
    kind, script, capitals, punctuation, length and check digits of what they replace; a made-up name keeps script, capitals and the
    gender that the old word's ending tells, whatever title is before it, so it is the same in all documents. All kinds are
    permuted within their form, and names among those of as many syllables, so two entities never become one (`collisions`
    looks for such). Null texts stay null, and repeated rows come out alike. A column `entities` is replaced; columns of other
    names stay.
    """
    new = rewriter(key)(docs["text"])
    both = docs.select(F.struct(*(docs[quoted(c)].alias(str(n)) for n, c in enumerate(docs.columns))).alias("old"), new.alias("new"))
    columns = [F.col("new.text").alias("text") if c == "text" else F.col(f"old.`{n}`").alias(c) for n, c in enumerate(docs.columns) if c != "entities"]
    return both.select(*columns, "new.entities")
