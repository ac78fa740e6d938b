"""Personal data by a semi-Markov conditional random field.

Base patterns give certain spans. Around what is left that could name a person or open a door (runs with digits, what stands
after a key word, numbers in groups, addresses written out, names after a title, streets, accounts), a window of atoms
(words, single marks, single spaces) is labelled as a whole: segments of at most ``MAX_ATOMS`` atoms, single atoms and whole
runs of any length are candidates of every kind, scored by features of the whole span, and one dynamic program over the
window chooses boundaries and kinds together. All eight kinds compete for a span: an address of a machine in its long form,
a card number with other marks, an e-mail address spelt out and a national telephone number are labelled with the kinds of
the base patterns. Weights maximise the conditional likelihood of windows made from a fixed seed, by the forward-backward
sums of the same lattice; they are a few hundred numbers, trained once in a process, and go with the tasks.

Out of reach: names without a title or other lead, streets in languages other than English, German, French and Spanish,
and numbers of national registers but for the United States, Britain and Spain, unless a key word names them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import prepare, released, texts

KINDS = ("email", "ip", "card", "phone", "secret", "account", "name", "address")
BASE_KINDS = KINDS[:4]
MAX_ATOMS, MAX_CHARS, MIN_CHARS = 20, 160, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = b"0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, leftmost and not overlapping within a kind, in order."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:  # the local part is what stands before the sign, as far as the last match
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38 and 12 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- windows and candidate segments

_ATOM = re.compile(r"[^\W_]+|\s|[^\w\s]|_")
_KEYWORD = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api|key|auth|credential)")
#: What may hold more than the base patterns find: a whole run of eight or more (with a digit, which is tested apart), a key
#: with a known prefix, digits in groups, or what stands after a key word (a digit is asked for only where no mark or "is"
#: comes before). Each is searched by itself, so that a run hides nothing inside it.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,}")
_INSIDE = tuple(map(re.compile, (r"\bAKIA[A-Z0-9]{16}\b", r"(?<![0-9.])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"(?<![0-9.,])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){2,5}(?![0-9])")))
_KEYED = re.compile(
    r"(?i)(?:password|passwd|passphrase|(?<![a-z])pass|pwd|secret|token|auth|credentials?|(?:(?<![a-z])|(?<=api)|(?<=access)|(?<=private)|(?<=secret))key)"
    r"[\"']?(?P<mark>\s{0,3}(?:[:=]|=>|:=)\s{0,3}|\s{1,3}is\s{1,3}|\s)(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s\"'`<>]+))"
)
_LED = re.compile(r"(?i)(?:(?P<strong>pass(?:word|wd|phrase)?|pwd|secret|credentials?)|token|auth|key)[\"']?(?:\s{0,3}(?:[:=]|=>|:=)\s{0,3}|\s{1,3}is\s{1,3})[\"']?$")
_NO_VALUE = re.compile(r"(?i)none|null|true|false|required|optional|string|\S*\(.*|\S*\[.*|\$.*|https?:.*|(?:too|very|not|never|always|stored|invalid|incorrect|wrong|empty|missing|expired).*")
MIN_KEYED = 4
#: Forms that the base patterns do not know: e-mail addresses spelt out, long and broken addresses of machines, card numbers
#: with other marks, accounts, and streets. A window opens at each; what it is, features of whole spans decide.
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?| dot |\.)"
_SPELT = re.compile(rf"(?i)(?:\s?[\[({{<]\s?(?:at|@)\s?[\])}}>]\s?|(?<=[a-z0-9]) at (?=[a-z0-9-]+ dot [a-z]{{2}}))[\w-]+(?:{_DOT}[\w-]+)+")
_TOP = re.compile(r"(?i)[\W_](?:com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|pt|ch|at|be|us|ca|au|in|jp|br)$")
_SIX = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
_BROKEN = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\.)[0-9]{1,3}){2}(?![0-9])")
_MARKED = re.compile(r"(?<![0-9])[0-9]{4}([./_\xa0])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_REGISTER = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![\w-])")
_ACCOUNT_LED = re.compile(r"(?i)(?:\bSSN|social security(?: number)?|passport(?: number| no\.?)?|\bIBAN|account (?:number|no\.?)|national insurance(?: number)?|\bNINO|\bDNI|tax id|driver'?s licen[cs]e(?: number)?)[ \t]{0,3}(?:[:#=]|is|number)?[ \t]{0,3}(?=[A-Z0-9])")
_KINDS_OF_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way|Terrace|Highway"
_STREET = re.compile(
    rf"(?<![\w])(?:[0-9]{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:[A-Z0-9][\w'.-]* ){{1,4}}(?:{_KINDS_OF_STREET})\b"
    r"|[0-9]{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|quai) [\w'-]+|[A-ZÄÖÜ][\w-]+(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?"
    r"|(?:Calle|Avenida|Plaza|Paseo) (?:(?:[\w.]+,? ){1,4}|(?:(?!Calle|Avenida|Plaza|Paseo)(?:[A-ZÀ-Þ][\w.]*|de|del|la|las|los|el|y),? )+)(?:n\.?º ?)?[0-9]{1,4})"
)
#: The fixed part of a long street: words with capitals or digits are taken before it, back to the nearest house number.
_STREET_END = re.compile(rf"(?<= )(?:{_KINDS_OF_STREET})\b")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?,?")
#: What may follow a street: a part of a town, a flat, a town, a state, a post code.
_PLACE = re.compile(r"(?:,? (?:[NS][EW]?|[EW]|Apt\.? ?\w{1,5}|Suite \w{1,5}|#\w{1,5}|[A-Z][a-zé]+|[A-Z]{2}|[0-9]{5}(?:-[0-9]{4})?|[A-Z]{1,2}[0-9]{1,2}[A-Z]? [0-9][A-Z]{2}|de|la|du|des)(?!\w))+")
_STREET_WORD = re.compile(r"\b(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way|Terrace|Highway|rue|avenue|boulevard|place|chemin|allée|quai|Calle|Avenida|Plaza|Paseo)\b|(?:straße|strasse|str\.|weg|platz|allee|gasse)(?= |$)")
#: What leads to a name: a title or a phrase (strong), or a form of address or a field (weak).
_NAME_LED = re.compile(r"(?:(?P<strong>\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herrn?|Frau|Mme|Monsieur|Madame|Sra?|Señora?)\b\.?|(?i:\bmy name is|\bsigned by|\bname is))|(?P<weak>(?i:\b(?:full |first |last |customer |patient |contact |user)?name ?[:=]|\b(?:patient|contact|attn|from|to) ?:)|\b(?:Dear|Regards,|Sincerely,|Hi|Hello)))[ \t\n]{1,2}(?=[A-ZÀ-Þ])")
_NAME = re.compile(r"[A-ZÀ-Þ](?:[^\W\d_]|['’])*+(?:-[A-ZÀ-Þ][^\W\d_]*+)*+(?![\w])\.?")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herrn?|Frau|Mme|Monsieur|Madame|Sra?|Señora?)\b")
#: Words before what is a digest of data and opens nothing.
_DIGEST_LED = re.compile(r"(?i)\b(?:commit|revision|rev|tree|blob|parent|digest|checksum|etag|md5|sha-?(?:1|224|256|384|512)|integrity)(?:sum)?[\"']?\s{0,2}[:=# ]\s{0,2}[\"']?$")
#: Words of a name that are tried.
NAME_WORDS = 4
_PARTICLE = re.compile(r"(?:de|da|di|del|della|van|von|der|den|la|le|bin|al) ")
_NO_NAME = frozenset("The This That These Those It He She We You They I A An Sir Madam All Team Customer Customers Friend Friends Everyone Colleague Colleagues Client Editor Support Mom Dad There January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
#: Strings without which there is no lead to a name, no address spelt out and no key word; the last three in lower case.
_TITLES = tuple(x.encode() for x in "Mr Ms Mx Dr Prof Herr Frau Mme Monsieur Madame Sr Señor Dear Regards Sincerely Hi Hello".split())
_FIELDS = (b"name", b"signed by", b"patient", b"contact", b"attn", b"from:", b"from :", b"to:", b"to :")
_WAYS = (b"[at", b"[ at", b"(at", b"( at", b"{at", b"{ at", b"<at", b"< at", b"[@", b"[ @", b"(@", b"( @", b"{@", b"{ @", b"<@", b"< @", b" dot ")
_WORDS = (b"pass", b"pwd", b"secret", b"token", b"auth", b"credential", b"key")
_DIGIT = re.compile(r"[0-9]")
_CHUNK = re.compile(r"\S{1,60}")
#: Candidates that are scored at once, so that a long window takes little memory.
BLOCK = 4096


class Cover:
    """The stretches that spans cover, merged, so that a test is one binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in spans:  # in order of start
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a

    def covers(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and self.ends[i] >= b

    def inside(self, a: int, b: int) -> bool:
        """Whether no stretch crosses an end of (a, b)."""
        i, j = bisect_left(self.starts, a) - 1, bisect_left(self.starts, b) - 1
        return (i < 0 or self.ends[i] <= a) and (j < 0 or self.ends[j] <= b)

    def left(self, a: int, b: int) -> list[tuple[int, int]]:
        """What of (a, b) is not covered."""
        out, i = [], max(0, bisect_right(self.starts, a) - 1)
        while i < len(self.starts) and self.starts[i] < b:
            if self.starts[i] > a:
                out.append((a, self.starts[i]))
            a = max(a, self.ends[i])
            i += 1
        return [*out, (a, b)] if a < b else out


def names(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a name after each lead: its first words with capitals, up to NAME_WORDS of them; a title
    after a form of address leads to the name itself."""
    out = []
    for m in _NAME_LED.finditer(text):
        at = a = m.end()
        if m["weak"] and _TITLE.match(text, at):
            continue
        for _ in range(NAME_WORDS):
            if not (word := _NAME.match(text, at)):
                break
            b = word.end()
            if text[b - 1] == "." and b - at > 3:  # an initial keeps its dot, a last word does not
                b -= 1
            out.append((a, b))
            if text[b : b + 1] != " ":
                break
            at = b + 1
            while particle := _PARTICLE.match(text, at):
                at = particle.end()
    return out


def streets(text: str) -> list[tuple[int, int]]:
    """(start, end) of streets; one with many words is found from its last one back, no further than the street before."""
    out, end = [m.span() for m in _STREET.finditer(text)], 0
    known = {b for _, b in out}
    for m in _STREET_END.finditer(text):
        at = m.start()
        while m.end() not in known and at > end and text[at - 1] == " ":
            a = text.rfind(" ", end, at - 1) + 1 or end
            while a < at and text[a] in "(\"'\n\t":
                a += 1
            word = text[a : at - 1]
            if not word or "\n" in word or not (word[0].isupper() or word[0].isdigit()) or word[-1] in ".;:!?" and len(word) > 3:
                break
            at = a
            if _HOUSE.fullmatch(word):
                out.append((a, m.end()))
                break
        end = m.end()
    return sorted(out)


def spelt(text: str) -> list[tuple[int, int]]:
    """(start, end) of e-mail addresses spelt out, with what stands before the sign."""
    out, end = [], 0
    for m in _SPELT.finditer(text):
        a = m.start()
        while a > end and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        out.append((a, m.end()))
        end = m.end()
    return out


class Hints:
    """What a text (UTF-8) may hold, by searches for plain strings: the patterns of what it cannot hold need not run."""

    def __init__(self, text: bytes) -> None:
        low = text.lower()
        self.digits = len(text.translate(None, _DIGITS)) < len(text)
        self.hex = self.digits or b"::" in text
        self.named = any(x in text for x in _TITLES) or any(x in low for x in _FIELDS)
        self.spelt = any(x in low for x in _WAYS)
        self.keyed = any(x in low for x in _WORDS)
        self.some = self.hex or self.named or self.spelt or self.keyed or b"@" in text or b"AKIA" in text


def triggers(text: str, cover: Cover, hints: Hints | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of what opens a window, base spans aside, and of what of it is a candidate as it is, of any length:
    runs, keyed values, beginnings of names, and forms with a pattern."""
    hints = hints or Hints(text.encode())
    runs: list[tuple[int, int]] = []
    if hints.digits:
        runs += [t for m in _RUN.finditer(text) if _DIGIT.search(text, *(t := m.span())) and not cover.covers(*t)]
    for m in _KEYED.finditer(text) if hints.keyed else ():
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            b = a + len(text[a:b].rstrip(".,;:)]}"))
        if b - a >= MIN_KEYED and (m["mark"].strip() or _DIGIT.search(text, a, b)) and not cover.covers(a, b):
            runs.append((a, b))
    if hints.named:
        runs += [t for t in names(text) if not cover.touches(*t)]
    whole = (_SIX, _BROKEN, _MARKED, _IBAN, _REGISTER) if hints.digits else (_SIX,) if hints.hex else ()
    runs += [t for p in whole for m in p.finditer(text) if not cover.touches(*(t := m.span()))]
    parts = [*(_INSIDE if hints.digits else _INSIDE[:1]), *((_ACCOUNT_LED,) if hints.digits else ())]
    inside = [t for p in parts for m in p.finditer(text) if not cover.touches(*(t := m.span()))]
    runs += [t for t in spelt(text) if not cover.touches(*t)] if hints.spelt else []
    for a, b in streets(text) if hints.digits else ():
        place = _PLACE.match(text, b)
        inside.append((a, place.end() if place else b))
        runs += [t for t in ((a, b), inside[-1]) if not cover.touches(*t)]
    runs = sorted(set(runs))
    return sorted(runs + inside), runs


def windows(text: str, opened: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the stretches to label: the triggers, in order, with two chunks on each side."""
    out: list[tuple[int, int]] = []
    for start, b in opened:
        a = start
        for _ in range(2):  # to the left over marks and the two chunks before
            while a and text[a - 1].isspace() and start - a < 60:
                a -= 1
            while a and not text[a - 1].isspace() and start - a < 60:
                a -= 1
        right = _CHUNK.search(text, b)
        b = min(right.end() if right and right.start() - b < 3 else b, b + 60)
        while out and a <= out[-1][1]:
            a, b = min(a, out[-1][0]), max(b, out.pop()[1])
        out.append((a, b))
    return out


def atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, start, end)]


def candidates(text: str, spans: list[tuple[int, int]], cover: Cover, runs: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(first atom, atom after the last) of the segments that may be an entity, in order of the first.

    They have up to MAX_ATOMS atoms and MAX_CHARS characters, a digit, and no part of a base span; a single atom has any
    length, and ``runs`` are candidates as they are, with the base spans that lie inside them.
    """
    whole: dict[int, set[int]] = {}
    for a, b in runs:
        if text[a:b].strip("_+/-"):
            if _RUN.fullmatch(text, a, b):
                b = a + len(text[a:b].rstrip("_+/-"))
                a = b - len(text[a:b].lstrip("_+/-"))
            # a run ends inside an atom where other letters follow: then with the whole atom
            i, j = bisect_right(spans, a, key=lambda x: x[0]) - 1, bisect_left(spans, b, key=lambda x: x[1]) + 1
            if cover.inside(spans[i][0], spans[j - 1][1]):
                whole.setdefault(i, set()).add(j)
    out = []
    for i, (a, _) in enumerate(spans):
        ends = whole.get(i, set())
        if text[a].isalnum() or text[a] in "+(":
            for j in range(i + 1, min(len(spans), i + MAX_ATOMS) + 1):
                b = spans[j - 1][1]
                if b - a > MAX_CHARS and j > i + 1:
                    break
                if b - a < MIN_CHARS or not text[b - 1].isalnum() or cover.touches(a, b) or j in ends:
                    continue
                if _DIGIT.search(text, a, b) or text.startswith("AKIA", a) or _SPELT.search(text, a, b):
                    out.append((i, j))
        out += [(i, j) for j in sorted(ends)]
    return out


def street_from(text: str, a: int, b: int) -> int:
    """Where a street that begins at ``a`` ends; 0 where none does. One of many words is looked for in the span alone."""
    if text[a].isdigit() and " " not in text[a:b] or not text[a].isalnum():
        return 0
    if m := _STREET.match(text, a):
        return m.end()
    if (house := _HOUSE.match(text, a, b)) and text[house.end() : house.end() + 1] == " " and (m := _STREET_END.search(text, a, b)):
        return m.end() if (0, m.end() - a) in streets(text[a : m.end()]) else 0
    return 0


def _six(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole span and its neighbourhood."""
    s = text[a:b]
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    marks, letters = {c for c in set(s) if not c.isalnum()}, upper + lower > 0
    before, after = text[max(0, a - 24) : a], text[b : b + 1]
    tight = before.rstrip(" :=\"'(")
    run = not marks
    out = ["bias", f"len{min(len(s) // 4, 10)}", f"digits{min(digits // 3, 7)}", "space" if " " in marks else "solid", f"marks{min(len(marks), 4)}"]
    out += [f"has{c}" for c in "@.-+()/_=:" if c in marks]
    if run:
        out.append("run")
        shape = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and digits < len(s) else "digits" if digits == len(s) else "upper" if not lower else "mixed"
        out += [f"run_{shape}", f"run_{shape}_{min(len(s) // 4, 10)}"]
        if s.startswith("AKIA") and len(s) == 20:
            out.append("key_prefix")
        if digits and upper + lower and not re.fullmatch(r"[^\W\d_]+\d{1,4}", s):
            out.append("interleaved")
    if digits > 6 and upper + lower == 0 and {*marks} <= set(" -.()+"):
        out += ["number", f"number{digits}"]
        if re.fullmatch(r"(?:\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}", s):
            out.append("phone_shape")
        if re.fullmatch(r"0\d(?:[ .-]\d\d){4}|\(?0\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}", s):
            out.append("national_shape")
        if re.fullmatch(r"[12]\d{3}[ .-]\d\d[ .-]\d\d|(?:[12]\d{3}[ .-])+[12]\d{3}", s):
            out.append("date_shape")
    if s.count(".") == 3 and re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        out.append("ip_shape")
    if "@" in marks and re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", s):
        out.append("email_shape")
    if 12 <= digits <= 19 and upper + lower == 0:
        out.append("card_luhn" if luhn(_only_digits(s)) else "card_off")
    if _KEYWORD.search(tight[-12:]):
        out.append("keyword")
        out.append("keyword_tight" if before[-1:] in "=:\"'" else "keyword_near")
    if m := _LED.search(text, max(0, a - 24), a):
        out += ["led", "led_pass" if m["strong"] else "led_key", f"led_{'letters' if s.isalpha() else 'digits' if s.isdigit() else 'both' if s.isalnum() else 'marks'}"]
        if s.isalpha():
            out.append(f"led_{'pass' if m['strong'] else 'key'}_{'lower' if s.islower() else 'upper' if s.isupper() else 'mixed'}")
        if _NO_VALUE.fullmatch(s):
            out.append("no_value")
    if run and digits and len(s) > 23 and _DIGEST_LED.search(text, max(0, a - 24), a):
        out.append("digest_led")
    if len(s) < MIN_CHARS:
        out.append("short")
    if before[-1:] in "\"'" and before and after in ("\"", "'"):
        out.append("quoted")
    if before[-1:].isalnum() or after.isalnum():
        out.append("cut_word")
    if before[-1:] in "._-/+=@" and before or after in ("@", "_", "/", "="):
        out.append("cut_mark")
    if after and not after.isspace() and not after.isalnum() and text[b + 1 : b + 2].isalnum() and after not in ".,;:)]}\"'":
        out += [] if not upper + lower else ["goes_on_run" if run else "goes_on_marks"]
    if after == ":" and text[b + 1 : b + 2].isalnum() or before[-1:] == ":" and text[max(0, a - 2) : a - 1].isalnum():
        out.append("cut_colon")
    if letters and _KEYWORD.search(s):
        out.append("keyword_inside")
    if letters and _SPELT.search(s):
        out += ["spelt", "spelt_whole" if re.fullmatch(rf"(?i)[\w.+-]+{_SPELT.pattern[4:]}", s) else "spelt_part"]
        out.append(f"spelt_{'marked' if re.search('[\\[({<@]', s) else 'plain'}_{'known' if _TOP.search(s) else 'other'}")
        out.append("spelt_cut" if re.match(rf"(?i){_DOT}\w", text[b : b + 12]) else "spelt_end")
    if s.count(":") > 1 and _SIX.fullmatch(s):
        out.append(f"six_{'right' if _six(s) else 'off'}_{min(max(map(len, s.split(':'))), 3)}")
    if _BROKEN.fullmatch(s):
        out.append("ip_broken" if all(int(x) < 256 for x in re.findall("[0-9]+", s)) else "ip_off")
    if _MARKED.fullmatch(s):
        out.append("card_marked")
    if _IBAN.fullmatch(s):
        turned = "".join(str(int(c, 36)) for c in (s[4:] + s[:4]).replace(" ", ""))
        out.append("iban_right" if int(turned) % 97 == 1 else "iban_off")
    if _REGISTER.fullmatch(s):
        out += ["register", "register_dashed" if "-" in s else "register_solid"]
    if _ACCOUNT_LED.search(text, max(0, a - 40), a + 1) and _ACCOUNT_LED.search(text[max(0, a - 40) : a] + "0", 0) and re.search(r"(?i)(?:number|no\.?|SSN|IBAN|passport|NINO|DNI|id|security|insurance|licen[cs]e)[ \t]*(?:[:#=]|is)?[ \t]*$", text[max(0, a - 40) : a]):
        out += ["account_led", "account_led_group" if re.fullmatch(r"[A-Z0-9]+(?:[ -][A-Z0-9]*[0-9][A-Z0-9]*)*", s) else "account_led_other"]
    if end := street_from(text, a, b):
        out += ["street", "street_cut" if b < end else "street_end" if b == end else "street_more"]
        rest = s[end - a :]
        if rest:
            place = _PLACE.match(text, end)
            out.append("street_over" if not place or place.end() < b else "place_whole" if place.end() == b else "place_part")
    elif letters and _STREET_WORD.search(s):
        out.append("street_word")
    if not digits and s[:1].isupper():
        if leads := [*_NAME_LED.finditer(text[max(0, a - 24) : a] + "X")]:  # the last one is the nearest
            if (m := leads[-1]).end() == min(a, 24):
                words = re.findall(r"[^\W\d_][\w'’.-]*", s)
                out += ["name_led", "name_strong" if m["strong"] else "name_weak", f"name_words{min(len(words), 4)}"]
                out.append("name_never" if words[0] in _NO_NAME else "name_odd" if any(w.isupper() and len(w) > 3 for w in words) else "name_plain")
                out.append("name_goes_on" if re.match(r" (?:(?:de|da|di|del|van|von|der|den|la|le|bin|al) )*[A-ZÀ-Þ]", text[b : b + 16]) else "name_ends")
    if len(s) > 64:
        cut = (before[-1:].isalnum() or before[-1:] in "_+/-") and before or after.isalnum() or after and after in "_+/-"
        out.append("long_part" if cut else "long_whole")
    return out


class Model:
    """Weights by feature and kind; plain numbers, so it goes with a task."""

    def __init__(self, index: dict[str, int], weights: np.ndarray) -> None:
        self.index, self.weights = index, weights

    def scores(self, text: str, spans: list[tuple[int, int]], found: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((len(found), len(KINDS)))
        for k, (i, j) in enumerate(found):
            rows = [self.index[f] for f in features(text, spans[i][0], spans[j - 1][1]) if f in self.index]
            out[k] = self.weights[rows].sum(0)
        return out

    def decode(self, text: str, cover: Cover, hints: Hints | None = None) -> list[tuple[int, int, int]]:
        """(start, kind index, end) of the entities that the best segmentation of each window holds."""
        out = []
        opened, runs = triggers(text, cover, hints)
        at = 0
        for start, end in windows(text, opened):
            spans = atoms(text, start, end)
            first = at
            while at < len(runs) and runs[at][0] < end:
                at += 1
            found = candidates(text, spans, cover, runs[first:at])
            best, back, reached = [0.0] * (len(spans) + 1), [(-1, 0)] * (len(spans) + 1), 0
            for k in range(0, len(found), BLOCK):
                block = found[k : k + BLOCK]
                scores = self.scores(text, spans, block)
                for (i, j), top, kind in zip(block, scores.max(1).tolist(), scores.argmax(1).tolist(), strict=True):
                    while reached < i:  # an atom outside scores 0
                        reached += 1
                        if best[reached - 1] >= best[reached]:
                            best[reached], back[reached] = best[reached - 1], (-1, 0)
                    if best[i] + top > best[j]:
                        best[j], back[j] = best[i] + top, (i, kind)
            while reached < len(spans):
                reached += 1
                if best[reached - 1] >= best[reached]:
                    best[reached], back[reached] = best[reached - 1], (-1, 0)
            j = len(spans)
            while j:
                i, kind = back[j]
                if i < 0:
                    j -= 1
                else:
                    out += [(a, kind, b) for a, b in cover.left(spans[i][0], spans[j - 1][1])]
                    j = i
        return out


# ---- training on windows made from a seed


def _made(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A made-up passage and its entities."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 2)) + digits(2)
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n - 2)) + digits(2)
    entity = rng.choice(["key", "password", "hex", "token", "phone", "phone", *["none"] * 9])
    lead, kind, body, tail = rng.choice(["", "", word() + " "]), None, "", ""
    if entity == "key":
        kind, body = "secret", "AKIA" + rng.choice([alnum(16), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))])
    elif entity == "password":
        lead += rng.choice(["password=", "passwd=", "pwd: ", "password: ", "secret=", "token="])
        kind, body = "secret", rng.choice([hexa(rng.randint(12, 20)) + "7", mixed(rng.randint(10, 20))])
    elif entity == "hex":
        lead += rng.choice(["api_key = \"", "secret_key=\"", "token: \"", "key='", "\""])
        kind, body, tail = "secret", hexa(rng.choice([32, 40, 40, 64])), lead[-1]
    elif entity == "token":
        lead += rng.choice(["token ", "key ", "auth: "])
        kind, body = "secret", mixed(rng.randint(24, 40))
    elif entity == "phone":
        kind, body = "phone", rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
    else:
        body = rng.choice([
            f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"{digits(8)}", f"{digits(10)}", f"{word()}{digits(4)}", f"v1.{digits(1)}.{digits(2)}-{word()}",
            f"{digits(4)}-{digits(4)}", f"{word()}-{word()}{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{word()}_{word()}_{digits(2)}", f"{digits(3)}/{digits(3)}/{digits(4)}",
            f"{word()}{word()}{digits(1)}", f"http://{word()}.org/{word()}/{digits(5)}", f"{digits(12)}", f"ISBN {digits(3)}-{digits(10)}", f"{digits(20)}", f"key {word()}{digits(2)}x",
        ])
    head = " ".join(word() for _ in range(rng.randint(0, 3)))
    text = (head + " " if head else "") + lead
    start = len(text)
    text += body + tail + rng.choice(["", ".", ",", ""]) + " " + word()
    return text, [(start, kind, start + len(body))] if kind else []


def _made_long(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A made-up passage with a long run, which is a secret, holds one, or is data."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + figures
    n = rng.randint(70, 420)
    head = " ".join(some(lower, rng.randint(2, 9)) for _ in range(rng.randint(0, 3)))
    text = head + " " if head else ""
    lead = rng.choice(["SessionToken=", "token: ", "secret=", "api_key = \"", "auth: ", "private_key='", "password="])
    what = rng.randrange(7)
    if what < 3:
        chars = rng.choice([mixed, mixed + "+/", mixed + "+/", mixed + "-_", figures + "abcdef"])
        text += lead
        start = len(text)
        text += some(mixed, 1) + some(chars, n - 2) + some(figures, 1)
        gold = [(start, "secret", len(text))]
        text += lead[-1] if lead[-1] in "\"'" else ""
    elif what == 3:
        text += some(lower, n) + "/"
        start = len(text)
        kind = rng.choice(["secret", "secret", "phone"])
        text += "AKIA" + some(lower.upper() + figures, 16) if kind == "secret" else f"{some(figures, 3)}-{some(figures, 3)}-{some(figures, 4)}"
        gold = [(start, kind, len(text))]
        text += "/" + some(lower, rng.randint(5, 40))
    else:
        text += rng.choice([some(figures, n), "-".join(some(lower, 6) for _ in range(n // 7)) + "-2", "/".join(some(lower, 5) for _ in range(n // 6)) + "/7", "data:image/png;base64," + some(mixed + "+/", n) + "4", "_".join(some(figures, 3) for _ in range(n // 4)), (some(lower, 2) + "1/") * (n // 4)])
        gold = []
    return text + rng.choice(["", ".", ","]) + " " + some(lower, 4), gold


def _made_keyed(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A made-up passage with a value after a key word, or with digits in groups."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda least=3: some(lower, rng.randint(least, 9))
    d = lambda n: some(figures, n)
    lead, kind, tail = "", None, ""
    strong, weak = rng.choice(["password", "Password", "passwd", "pwd", "pass", "secret", "db_password", "credentials"]), rng.choice(["token", "key", "auth", "api_key", "access_token", "key"])
    what = rng.randrange(9)
    if what < 3:
        kind = "secret"
        lead = strong + rng.choice([": ", "=", " = ", ":", " is ", ": \"", "='"])
        body = rng.choice([word(5) + d(rng.randint(1, 4)), word(5).title() + word(4).title(), some(lower, 2) + d(2) + some(lower, 2) + d(1), word(6), word(4) + rng.choice("!@#$%&*-_") + word(4), word(4).title() + rng.choice("!@#$%&*") + d(3), some(lower + lower.upper() + figures + "!@#$%", rng.randint(8, 18)), d(rng.randint(4, 9))])
        tail = lead[-1] if lead[-1] in "\"'" else ""
    elif what == 3:
        kind = "secret"
        lead = weak + rng.choice([": ", "=", " = ", "=\""])
        body = rng.choice(["", "", some(lower, 3) + "_", some(lower, 2) + "-"]) + some(lower + lower.upper() + figures, rng.randint(12, 30)) + d(2)
        tail = lead[-1] if lead[-1] in "\"'" else ""
    elif what == 4:
        lead = rng.choice([strong, weak, weak]) + rng.choice([": ", "=", " = ", " is "])
        body = rng.choice(["None", "null", "required", "optional", "true", "string", word() + "()", word() + "(" + word() + ")", "os." + word() + "[" + word() + "]", "$" + word(), "https://" + word() + ".org/" + word(), "not " + word(), "too " + word(), "stored", "invalid"])
    elif what == 5:
        lead = weak + rng.choice([": ", "=", " = ", " is ", " "])
        body = rng.choice([word(4), word(4), word(4).title(), word(4) + "_" + word(), word(4) + " " + word(), d(4), "the " + word(4)])
    elif what < 8:
        kind = "phone"
        lead = rng.choice(["call ", "tel ", "phone: ", word() + " ", ""])
        body = rng.choice([f"{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"])
    else:
        body = rng.choice([f"{rng.randint(10, 99)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"19{d(2)} 20{d(2)} 20{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(4)} {d(4)} {d(4)}", f"{d(5)} {d(5)} {d(5)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"{d(2)} {d(3)} {d(2)} {d(3)} {d(2)}"])
    text = " ".join(word() for _ in range(rng.randint(0, 3)))
    text += (" " if text else "") + lead
    start = len(text)
    return text + body + tail + rng.choice(["", ".", ","]) + " " + word(), [(start, kind, start + len(body))] if kind else []


def _made_forms(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A made-up passage with a form that the base patterns do not know, or one that only looks like it."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, upper, figures = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda least=3: some(lower, rng.randint(least, 9))
    cap = lambda: word().title()
    d = lambda n: some(figures, n)
    lead, kind, tail = rng.choice(["", word() + " "]), None, ""
    what = rng.randrange(16)
    if what == 14:
        lead += rng.choice(["commit ", "sha256:", "SHA-1: ", "md5 = ", "revision ", "checksum: ", "sha256sum ", "digest=", "tree "])
        body = some("0123456789abcdef", rng.choice([32, 40, 40, 64]) - 1) + d(1)
    elif what == 15:
        kind, few = "address", rng.randint(5, 8)
        body = f"{d(4)} {' '.join(cap() for _ in range(few))} {rng.choice(['Street', 'Boulevard', 'Avenue', 'Road'])}" + rng.choice(["", f", Apt {d(2)}, {cap()}, {some(upper, 2)} {d(5)}", f", {cap()}, {some(upper, 2)} {d(5)}"])
    elif what == 0:
        kind = "email"
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" [at] ", "."), ("[@]", ".")])
        body = word() + rng.choice(["", "." + word(), d(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "de"])
    elif what == 1:
        kind = "ip"
        body = rng.choice([":".join(some("0123456789abcdef", 4) for _ in range(8)), f"{some('23456789abcdef', 4)}:{some('0123456789abcdef', 3)}::{some('0123456789abcdef', 3)}", f"fe80::{some('0123456789abcdef', 4)}:{some('123456789abcdef', 3)}", "[.]".join(str(rng.randint(0, 255)) for _ in range(4))])
    elif what == 2:
        kind, mark = "card", rng.choice("./_\xa0")
        digits = "4" + d(14)
        digits += next(x for x in figures if luhn(digits + x))
        body = mark.join(digits[i : i + 4] for i in range(0, 16, 4))
    elif what == 3:
        kind = "account"
        bban = rng.choice([d(18), some(upper, 4) + d(14)])
        country = rng.choice(["DE", "GB", "FR", "ES"])
        check = 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
        body = f"{country}{check:02}{bban}"
        body = rng.choice([body, " ".join(body[i : i + 4] for i in range(0, len(body), 4))])
    elif what == 4:
        kind = "account"
        lead += rng.choice(["SSN ", "SSN: ", "social security number ", "passport number ", "passport no. ", "account number: ", "DNI ", "national insurance number "])
        body = rng.choice([f"{d(3)}-{d(2)}-{d(4)}", d(8) + some(upper, 1), some(upper, 2) + d(6) + "A", some(upper, 1) + d(8), d(8), d(9), d(10)])
    elif what == 5:
        kind, body = "account", f"{d(3)}-{d(2)}-{d(4)}"
    elif what in (6, 7):
        kind = "address"
        body = rng.choice([
            f"{d(3)} {cap()} {rng.choice(['Street', 'St', 'Avenue', 'Road', 'Lane', 'Blvd', 'Drive'])}", f"{d(2)} {cap()} {cap()} {rng.choice(['Street', 'Avenue', 'Road'])}", f"{d(4)} {cap()} {rng.choice(['Street', 'Ave'])}, {cap()}, {some(upper, 2)} {d(5)}",
            f"{d(2)} rue {cap()}", f"{cap()}straße {d(2)}", f"{cap()}weg {d(1)}, {d(5)} {cap()}", f"Calle {cap()} {d(2)}", f"{d(3)} {cap()} Road, {cap()}",
        ])
    elif what in (8, 9):
        kind = "name"
        lead += rng.choice(["Mr ", "Mr. ", "Mrs. ", "Ms ", "Dr. ", "Prof. ", "Herr ", "Frau ", "my name is ", "name: ", "Name: ", "Dear ", "Dear Mr ", "contact: ", "signed by "])
        body = rng.choice([cap(), f"{cap()} {cap()}", f"{cap()} {some(upper, 1)}. {cap()}", f"{cap()} {cap()} {cap()}", f"{cap()} van {cap()}", f"{cap()} {cap()}-{cap()}", cap() + word() + word() + word()])
        tail = rng.choice(["", ",", " " + word()])
    elif what == 10:
        lead += rng.choice(["Dear ", "Hi ", "name: ", "to: ", "Hello "])
        body = rng.choice(["Sir or " + word(), "Madam", "All", "Team", "Customer", "Everyone", "The " + word(), "This " + word(), "Friends", "You"])
    elif what == 11:
        body = rng.choice([f"{d(2)}:{d(2)}:{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}", ":".join(some("0123456789abcdef", 2) for _ in range(6)), f"{word()} at {word()} dot", f"{word()} at {word()} dot {word()}", f"look (at) {word()}", f"{d(1)}:{d(2)}:{d(2)}:{d(2)}"])
    elif what == 12:
        body = rng.choice([f"{d(4)}.{d(4)}.{d(4)}.{d(3)}", f"{some(upper, 2)}{d(2)} {d(4)} {d(4)}", f"{d(4)}-{d(2)}-{d(4)}", f"{d(4)}_{d(4)}_{d(4)}_{d(2)}", f"{some(upper, 2)}{d(2)}{some(upper, 8)}", f"{d(8)}-{some(upper, 1)}{some(upper, 1)}"])
    else:
        body = rng.choice([f"{d(2)} {word()} way", f"{d(3)} {word()} {word()}", f"{cap()} Street", f"account {word()}", f"the {word()} road {d(2)} {word()}", f"passport {word()}", f"{d(2)} {cap()} {cap()}"])
    text = " ".join(word() for _ in range(rng.randint(0, 3)))
    text += (" " if text else "") + lead
    start = len(text)
    return text + body + tail + rng.choice(["", ".", ","]) + " " + word(), [(start, kind, start + len(body))] if kind else []


class _Lattice:
    """The candidates of a passage by where they begin and end, and which are right."""

    def __init__(self, n: int, found: list[tuple[int, int]], want: list[tuple[int, int]]) -> None:
        self.n, self.found, self.want = n, found, want
        self.by_end: dict[int, list[tuple[int, int]]] = {}
        self.by_start: dict[int, list[tuple[int, int]]] = {}
        for k, (i, j) in enumerate(found):
            self.by_end.setdefault(j, []).append((k, i))
            self.by_start.setdefault(i, []).append((k, j))

    def masses(self, total: list[float]) -> list[float]:
        """Log of each candidate's probability, but for its own score, by forward and backward sums."""
        n, ahead, behind = self.n, [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        for j in range(1, n + 1):
            own = self.by_end.get(j)
            ahead[j] = _logsum([ahead[j - 1], *(ahead[i] + total[k] for k, i in own)]) if own else ahead[j - 1]
        for i in range(n - 1, -1, -1):
            own = self.by_start.get(i)
            behind[i] = _logsum([behind[i + 1], *(behind[j] + total[k] for k, j in own)]) if own else behind[i + 1]
        return [ahead[i] + behind[j] - ahead[n] for i, j in self.found]


def made_passages(made: int, seed: int) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Passages to train on, of all makers."""
    makers = ((_made, made), (_made_long, made // 6), (_made_keyed, made), (_made_forms, 2 * made))
    return [make(rng) for k, (make, n) in enumerate(makers) for rng in [random.Random(seed + k)] for _ in range(n)]


def train(made: int = 900, rounds: int = 24, seed: int = 5, size: int = 120) -> Model:
    """Weights of greatest penalised likelihood over made-up passages, in batches, by gradient steps with a step per weight."""
    index: dict[str, int] = {}
    lattices, rows, firsts = [], [], [0]
    for text, gold in made_passages(made, seed):
        spans, cover = atoms(text, 0, len(text)), Cover([])
        found = candidates(text, spans, cover, triggers(text, cover)[1])
        if not found:
            continue
        want = [(k, KINDS.index(t)) for s, t, e in gold for k, (i, j) in enumerate(found) if spans[i][0] == s and spans[j - 1][1] == e]
        lattices.append(_Lattice(len(spans), found, want))
        rows += [[index.setdefault(f, len(index)) for f in features(text, spans[i][0], spans[j - 1][1])] for i, j in found]
        firsts.append(len(rows))
    weights = np.zeros((len(index), len(KINDS)))
    square = np.full_like(weights, 1e-3)
    order = np.random.default_rng(seed)
    for step in range(rounds):
        shuffled = order.permutation(len(lattices))
        for at in range(0, len(shuffled), size):
            batch = shuffled[at : at + size].tolist()
            own = [k for b in batch for k in range(firsts[b], firsts[b + 1])]
            flat, cand = np.concatenate([rows[k] for k in own]), np.repeat(np.arange(len(own)), [len(rows[k]) for k in own])
            scores = np.add.reduceat(weights[flat], np.searchsorted(cand, np.arange(len(own))))
            total = np.logaddexp.reduce(scores, axis=1).tolist()
            push, done = np.zeros_like(scores), 0
            for b in batch:
                n = len(lattices[b].found)
                mass = np.array(lattices[b].masses(total[done : done + n]))
                push[done : done + n] -= np.exp(mass[:, None] + scores[done : done + n])
                for k, t in lattices[b].want:
                    push[done + k, t] += 1
                done += n
            gradient = np.stack([np.bincount(flat, push[cand, t], len(index)) for t in range(len(KINDS))], axis=1)
            gradient -= 0.02 * len(batch) / len(lattices) * weights
            square += gradient**2
            weights += 0.5 * gradient / np.sqrt(square)
    return Model(index, weights)


_TRAINED: list[Model] = []


def trained() -> Model:
    """The model of the fixed seed, trained once in a process."""
    if not _TRAINED:
        _TRAINED.append(train())
    return _TRAINED[0]


def _logsum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


# ---- over documents


def find(text: bytes, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text in UTF-8, as (start, kind index, end) in code points, in order."""
    hints = Hints(text)
    if not hints.some:
        return [], []
    s = text.decode("utf-8", "replace")
    base = base_spans(s)
    return base, sorted(base + model.decode(s, Cover(base), hints))  # decode() gives what base spans leave


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _digests(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for raw in texts(b.column("text")):
                base, spans = find(raw, model)
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns))], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return run


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text counts as empty (no spans); null and repeated doc_ids keep a row each; an empty table gives none. Further
    columns are not read. Whole texts are searched; memory holds one Arrow batch.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return slim.mapInArrow(released(_digests(model or trained())), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(text: bytes, model: Model) -> bytes:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    _, spans = find(text, model)
    if not spans:
        return text
    s, out, at = text.decode("utf-8", "replace"), [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [s[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, s[at:]]).encode()


def _masked(model: Model, names: list[str]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            new = [mask(raw, model).decode("utf-8", "replace") for raw in texts(b.column("text"))]
            was = b.column("text").is_null().to_pylist()
            new = [None if n else x for x, n in zip(new, was, strict=True)]
            put = {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                put["n_chars"] = pa.array([None if x is None else len(x) for x in new], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([put.get(n, b.column(n)) for n in names], names=names)

    return run


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with personal data masked in text and n_chars (where there is one) to match; other columns stay.

    Null text stays null and empty text empty; null and repeated doc_ids keep a row each; an empty table gives none. Whole
    texts are searched, however long; columns of any other name pass through.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(released(_masked(model or trained(), docs.columns)), docs.schema)
