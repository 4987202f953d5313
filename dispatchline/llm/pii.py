"""Problem 3: personal data inside free text, by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs and their spelled forms, digits, plus signs
and digit words, street types, titles, phrases that announce a name, and the given and family names of the directory.
From each anchor a deterministic local parser expands to the left and to the right as far as its grammar goes - the left
side is read on the reversed text - and validates the stretch (digit counts, form of the identifier, house number and
street type, context of a name that is also a common word). No parser looks through a window, so nothing is cut, however
long it is. Anchors are looked up in a view of the text in lower case with white space runs as one blank and without
invisible characters; a map leads back, so spans come out exactly as written.

The names of the directory are the only broadcast: contacts is a fixed table (3,000 rows, bound
``MAX_NAMES``). A family name outside it is found after a title, after a given name, and after a phrase that announces a
name (there with any initial), by its capital in a text whose case says something.

Edge cases: null or empty texts have no spans; very long texts are scanned whole, each stretch once; equal spans of a
field come out once in ``find`` and are all replaced in ``redact``; overlaps are resolved in the order email,
idnum, phone, address, name; an empty directory leaves the rules without names; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

MAX_NAMES = 200_000

# Words and forms of the desk's languages.
DIGIT_WORDS = {"oh": "0", "zero": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
JOINTS = "dot underscore plus dash hyphen".split()
STREET_TYPES = "street st road rd avenue ave lane ln court ct terrace gardens gdns close way drive place square crescent grove walk mews".split()
FOREIGN_STREETS = ["ul.", "al.", "os.", "pl.", "вул.", "просп.", "пров.", "бул."]
UNITS = "flat apt apartment unit suite".split()
WEAK_TITLES = ("miss", "sir", "rev")  # which are common words, too
NO_STREET = set("the a an of out in my your our this that and or to at by is was for on with from if you we it".split())
TITLES = "mr mrs ms miss mx dr prof sir rev".split()
ANNOUNCE = ["name is ", "name: ", "ask for ", "speak to ", "spoke to "]
#: English given and family names that are common words, too; alone they need a context.
COMMON_WORDS = set("amber angel april art august autumn banks bill bishop brook brooks burnside carol chase christian cliff coral dale dawn dean drake drew earl eve faith fern frank frost gene glen grace grant gray green guy hall harmony hazel heath heather holly hope hunter iris ivy jack jasmine jay jewel joy june king lance lee lily long mark mason may melody miles nick norm olive page parker pat pearl penny poppy price ray reed rich rob robin rock rose ruby rusty sandy scarlet skip sky stone sue summer sunny tanner taylor tiffany trip victor violet wade walker ward warren wayne will wood young".split())
#: Words of closed classes and of letters, which are no names though a capital may open them.
NO_NAME = set("a about after again all also am an and any are as at be because been before being but by can cheers could dear did do does down each erm even for from get go good got had has have he hello her here hi him his how i if in into is it its just kind let many me more morning my near need no not now of off on only or order our out over please regards same she should since so some sorry thank thanks that the their them then there these they this those though to today tomorrow too under until up us was we were what when where which while who why will with without would yes yet you your".split())
#: Words that lead to a name that is also a common word, and words after one.
LEADS = {("name", "is"), ("ask", "for"), ("speak", "to"), ("spoke", "to"), ("neighbour", "called"), ("it", "is"), ("thank", "you"), ("hi", "there"), ("hello", "there")}
GREETS = set("hi hello hiya hey dear morning evening afternoon thanks cheers ta regards name".split())
FOLLOWS = re.compile(r" (?:has|upstairs|let|again)(?!\w)")
#: A name alone at the end of a text signs it, unless these words lead to it.
DETERMINERS = set("the a my our your".split())
UNSIGNED = set("have the a my our your at of it in around near behind above to is and or".split())
FIRM_WORDS = set("ltd limited homes housing assoc association property care estates estate lettings co company inc plc group services".split())
PLACEHOLDERS = {"", "-", "--", "n/a", "none", "unknown", "unknown caller", "voicemail", "web enquiry", "anonymous", "withheld"}


def _any(words) -> str:
    return "|".join(words)


def _reversed(words) -> str:
    return "|".join(w[::-1] for w in words)


INVISIBLE = re.compile("[­​-‏⁠﻿]")
ODD = re.compile("[­​-‏⁠﻿]|[^\\S ]|  ")
LOCAL = r"[\w.+%-]+"
EMAIL = re.compile(rf"{LOCAL}@[a-z0-9-]+(?:\.[a-z0-9-]+)+|{LOCAL} ?[(\[]at[)\]] ?[a-z0-9-]+(?:(?:\.| dot )[a-z0-9-]+)+")
EMAIL_LEFT = re.compile(rf" ?{LOCAL}")
#: A chain of words tied by spelled signs, to the left (reversed) and to the right of a spelled dot, and the domain of an address in it.
CHAIN_LEFT = re.compile(rf"{LOCAL}(?: (?:{_reversed([*JOINTS, 'at'])}) {LOCAL})*")
CHAIN_RIGHT = re.compile(rf"(?: (?:{_any([*JOINTS, 'at'])}) {LOCAL})+")
SPELLED_DOMAIN = re.compile(r"[a-z0-9-]++(?: dot [a-z0-9-]++)++(?! at [\w-]+ dot )")
PHONE = re.compile(r"(?<![\w@/+.-])(?:\+\d{1,3}(?:[ .-]?\(?\d\)?){7,12}|00[1-9](?:[ .-]?\d){8,12}|\(0\d{2,4}\)(?:[ .-]?\d){6,8}|0[1-9](?:[ .-]?\d){8,9}|\(\d{3}\) ?\d{3}-\d{4})(?![\w@])(?!-\d)")
_DIGIT = rf"(?:(?:{_any(TIMES)}) )?(?:{_any(DIGIT_WORDS)})"
SPOKEN = re.compile(rf"(?<!\w){_DIGIT}(?: {_DIGIT}){{4,}}(?!\w)")
SPOKEN_LEFT = re.compile(rf"(?: (?:{_reversed([*DIGIT_WORDS, *TIMES])})(?!\w))+")
DIGITS = re.compile(r"\d+")
IDNUM = re.compile(r"(?<![\w-])(?:[a-z]{2}([ -]?)\d\d\1\d\d\1\d\d\1[a-d]|\d{7}[a-w][a-iw]?|\d{3}-\d\d-\d{4})(?![\w-])")
POSTCODE = r"(?:[,.]? ?[a-z]{1,2}\d[a-z\d]? \d[a-z]{2}(?!\w))?"
STREET = re.compile(rf"(?<![\w/.-])(?:(?:{_any(UNITS)})\.? ?\d+[a-z]?,? )?\d+[a-z]?(?:-\d+[a-z]?)? ([^\W\d][\w'’-]*(?: [^\W\d][\w'’-]*)?) (?:{_any(STREET_TYPES)})(?!\w){POSTCODE}")
STREET_LEFT = re.compile(rf"[\w'’-]*[^\W\d](?: [\w'’-]*[^\W\d])? (?:[a-z]?\d+-)?[a-z]?\d+(?![\w/.-])(?: ,?[a-z]?\d+ ?\.?(?:{_reversed(UNITS)})(?![\w/.-]))?")
FOREIGN = re.compile(r"(?<!\w)(?:(?:ul|al|os|pl)\. ?[\w-]+(?: [\w-]+)? \d+[a-z]?(?:/\d+[a-z]?)?(?:,? \d\d-\d{3})?|(?:вул|просп|пров|бул)\. ?[\w'’-]+(?: [\w'’-]+)?, ?\d+[а-яa-z]?(?:/\d+[а-яa-z]?)?(?:, кв\. ?\d+)?)(?!\w)")
WORDS_BEFORE = re.compile(r"[ ,.!:–-]*(\w+)(?: (\w+))?")
TAIL = re.compile(r"[^\W_]")
TITLE_BEFORE = re.compile(rf" \.?(?:{_reversed(TITLES)})(?!\w)")
INITIAL_BEFORE = re.compile(r" ?\.[^\W\d_](?![\w'’.-])")
BETWEEN = re.compile(r" (?:[^\W\d_]\.? )?")
WORD = re.compile(r"[^\W\d_][\w'’-]*")
TITLED = re.compile(rf"(?:(?:{_any(TITLES)})\.? )?((?:[^\W\d_]\. ?)?([^\W\d_][\w'’-]+))")
NEXT_WORD = re.compile(r" ([^\W\d_][\w'’-]+)")
THREE_WORDS = re.compile(r"[\w'’-]+(?: [\w'’-]+){0,2}")
SENDER = re.compile(r"\s*((?:[^\W\d_][\w'’.-]*)(?:,? [^\W\d_][\w'’-]*){1,2})\s*")


def view(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case with single blanks, and the place of each character (None: the same places)."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if not ODD.search(low):
        return low, None
    out, at, blank = [], [], False
    for i, c in enumerate(low):
        if c.isspace():
            if not blank:
                out.append(" ")
                at.append(i)
            blank = True
        elif not INVISIBLE.match(c):
            out.append(c)
            at.append(i)
            blank = False
    at.append(len(low))
    return "".join(out), at


def automaton(given: set[str], family: set[str]):
    """All anchors, each with its kind and length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds = {"@": "email", "(at)": "email", "[at]": "email", " dot ": "spelled", "+": "plus"}
    kinds |= {d: "digit" for d in "0123456789"}
    kinds |= {f"{w} ": "spoken" for w, d in DIGIT_WORDS.items() if d == "0"}
    kinds |= {f" {x}": "street" for x in STREET_TYPES} | {x: "foreign" for x in FOREIGN_STREETS}
    for x in TITLES:
        kinds[f"{x} "] = kinds[f"{x}. "] = "title"
    kinds |= dict.fromkeys(ANNOUNCE, "announced")
    kinds |= {x: "given" for x in given} | {x: "family" if x not in given else "either" for x in family}
    for word, kind in kinds.items():
        a.add_word(word, (kind, len(word)))
    if len(a):
        a.make_automaton()
    return a


def spoken_number(t: str) -> int:
    """Length of the leading part of digit words that makes a phone number of 10 or 11 digits, or 0."""
    digits, times, best = "", 1, 0
    for m in re.finditer(r"\w+", t):
        w = m.group()
        if w in TIMES:
            times = TIMES[w]
            continue
        digits += DIGIT_WORDS[w] * times
        times = 1
        if len(digits) > 11:
            break
        if len(digits) >= 10:
            best = m.end()
    return best if digits.startswith("0") else 0


class Scan:
    """One text while its anchors are expanded: the view, the stretches taken so far and what its case says."""

    def __init__(self, text: str):
        self.text = text
        self.t, self.at = view(text)
        self.n = len(self.t)
        self.r = self.t[::-1]
        self.found: list[tuple[int, int, str]] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self._cased: bool | None = None

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e)
        return i == 0 or self.ends[i - 1] <= s

    def add(self, s: int, e: int, kind: str) -> None:
        """Take a stretch unless a part of it is taken; those taken are kept in order."""
        if self.free(s, e):
            i = bisect_left(self.starts, s)
            self.starts.insert(i, s)
            self.ends.insert(i, e)
            self.found.append((s, e, kind))

    def left(self, pattern: re.Pattern, s: int) -> int:
        """Where the stretch begins that the pattern, which is for reversed text, reads to the left of ``s``."""
        m = pattern.match(self.r, self.n - s)
        return s - (m.end() - m.start()) if m else s

    def raw(self, s: int, e: int) -> str:
        return self.text[s:e] if self.at is None else self.text[self.at[s] : self.at[e - 1] + 1]

    def cased(self) -> bool:
        """Whether capitals say anything here: not in texts of one case nor where most words have one."""
        if self._cased is None:
            words = re.findall(r"[^\W\d_]{2,}", self.text)
            capital = sum(w[0].isupper() for w in words)
            self._cased = any(w[1:].islower() for w in words) and 0 < capital <= max(2, 0.6 * len(words))
        return self._cased

    def capital(self, s: int, e: int) -> bool:
        """A word written with a capital and small letters, no function word, in a text whose case says something."""
        raw = self.raw(s, e)
        return raw[0].isupper() and any(c.islower() for c in raw) and self.t[s:e] not in NO_NAME and self.cased()

    def words_before(self, s: int) -> tuple[str, str]:
        """The last word before a place and the one before it."""
        m = WORDS_BEFORE.match(self.r, self.n - s)
        return ((m.group(1) or "")[::-1], (m.group(2) or "")[::-1]) if m else ("", "")


def _emails(x: Scan, hits: dict) -> None:
    for s, _ in hits.get("email", ()):
        if m := EMAIL.match(x.t, x.left(EMAIL_LEFT, s)):
            x.add(m.start(), m.end(), "email")
    done = 0
    for s, _ in hits.get("spelled", ()):
        if s >= done and (right := CHAIN_RIGHT.match(x.t, s)):
            done, start = right.end(), x.left(CHAIN_LEFT, s)
            while (sign := x.t.find(" at ", start, done)) >= 0:
                if m := SPELLED_DOMAIN.match(x.t, sign + 4):
                    x.add(start, m.end(), "email")
                start = m.end() + 1 if m and m.end() < done else sign + 4


def _numbers(x: Scan, hits: dict) -> None:
    runs, end = [], -1
    for s, _ in hits.get("digit", ()):
        if s >= end:
            end = DIGITS.match(x.t, s).end()
            runs.append((s, end))
    for s, e in runs:
        size = e - s
        b = s if size in (3, 7) else s - 2 if size == 6 else s - 3 if size == 2 else -1
        if b >= 0 and (m := IDNUM.match(x.t, b)):
            x.add(m.start(), m.end(), "idnum")
    for s, _ in hits.get("plus", ()):
        if m := PHONE.match(x.t, s):
            x.add(m.start(), m.end(), "phone")
    for s, _ in runs:
        bracket = s > 0 and x.t[s - 1] == "("
        if (bracket or x.t[s] == "0") and (m := PHONE.match(x.t, s - bracket)):
            x.add(m.start(), m.end(), "phone")
    done = 0
    for s, _ in hits.get("spoken", ()):
        if s >= done and (m := SPOKEN.match(x.t, x.left(SPOKEN_LEFT, s))):
            done = m.end()
            if k := spoken_number(m.group()):
                x.add(m.start(), m.start() + k, "phone")


def _addresses(x: Scan, hits: dict) -> None:
    for s, e in hits.get("street", ()):
        if (e == x.n or not x.t[e].isalnum()) and (m := STREET.match(x.t, x.left(STREET_LEFT, s))) and not NO_STREET & set(m.group(1).split(" ")):
            x.add(m.start(), m.end(), "address")
    for s, _ in hits.get("foreign", ()):
        if m := FOREIGN.match(x.t, s):
            x.add(m.start(), m.end(), "address")


def _in_context(x: Scan, s: int, e: int) -> bool:
    """Whether a name that is also a common word is meant as a name here."""
    last, one_before = x.words_before(s)
    if last in GREETS or (one_before, last) in LEADS or TITLE_BEFORE.match(x.r, x.n - s):
        return True
    tied = x.t.endswith(f"{last} ", 0, s)
    if FOLLOWS.match(x.t, e):
        return not (tied and last in DETERMINERS)
    return not (tied and last in UNSIGNED) and not TAIL.search(x.t, e)


def _directory_names(x: Scan, hits: dict, family: set[str], whole: bool) -> None:
    t, n = x.t, x.n
    names = [(s, e, k) for k in ("given", "family", "either") for s, e in hits.get(k, ()) if (s == 0 or not (t[s - 1].isalnum() or t[s - 1] in "_'’-")) and (e == n or not (t[e].isalnum() or t[e] in "_-" and e + 1 < n and t[e + 1].isalnum()))]
    names.sort(key=lambda y: (y[0], -y[1]))
    longest: list[tuple[int, int, str]] = []
    for y in names:
        if not longest or y[0] >= longest[-1][1]:
            longest.append(y)
    names, i = longest, 0
    while i < len(names):
        s, e, kind = names[i]
        i += 1
        if not x.free(s, e):
            continue
        both = False
        follower = names[i] if i < len(names) else None
        gap = t[e : follower[0]] if follower and follower[0] - e <= 4 else None
        # whether the follower begins a name of its own: given and family
        own = follower and i + 1 < len(names) and names[i + 1][2] != "given" and t[follower[1] : names[i + 1][0]] == " "
        if gap is not None and kind != "family" and follower[2] != "given" and BETWEEN.fullmatch(gap):
            e, both, i = follower[1], True, i + 1  # given family
        elif gap is not None and kind != "given" and follower[2] != "family" and gap in (", ", ",") and not own:
            e, both, i = follower[1], True, i + 1  # family, given
        elif gap == " " and kind != "given" and follower[2] == "given" and not FOLLOWS.match(t, e) and t[follower[0] : follower[1]] not in COMMON_WORDS and not own:
            e, both, i = follower[1], True, i + 1  # family given
        elif kind == "given" and (m := NEXT_WORD.match(t, e)) and m.group(1) not in family and x.raw(e, e + 1) == " " and x.capital(s, e) and x.capital(m.start(1), m.end(1)) and not _no_person(x, m.start(1)):
            if t[s:e] not in COMMON_WORDS or _in_context(x, s, e) or s > 1 and t[s - 2].isalnum() and x.words_before(s)[0] not in DETERMINERS:
                e, both = m.end(), True  # a family name that isn't in the directory
        if kind != "given" or both:
            b = x.left(INITIAL_BEFORE, s)
            if b < s and not (kind != "family" and both) and x.free(b, s):
                s, both = b, True
        if both or whole or t[s:e] not in COMMON_WORDS or _in_context(x, s, e):
            x.add(s, e, "name")


def _no_person(x: Scan, s: int) -> bool:
    """Whether the words from a place on are those of a firm or a street."""
    m = THREE_WORDS.match(x.t, s)
    words = m.group().split(" ") if m else []
    return bool(FIRM_WORDS & set(words) or set(STREET_TYPES) & set(words[:2]))


def _led_names(x: Scan, hits: dict) -> None:
    """Names outside the directory, after a title or an announcing phrase."""
    for kind in ("title", "announced"):
        for s, e in hits.get(kind, ()):
            if s and x.t[s - 1].isalnum():
                continue
            m = TITLED.match(x.t, e)
            if not m or not x.free(s, m.end()):
                continue
            (b, last), word = m.span(1), m.start(2)
            named = x.capital(word, last) if x.cased() else kind == "title" and not x.t.startswith(WEAK_TITLES, s) and m.group(2) not in NO_NAME
            if not named or kind == "title" and x.cased() and not x.raw(s, s + 1).isupper() or _no_person(x, word):
                continue
            after = NEXT_WORD.match(x.t, last)
            if after and x.free(after.start(), after.end()) and x.raw(last, last + 1) == " " and x.capital(*after.span(1)):
                last = after.end()
            x.add(b, last, "name")


def _sender(x: Scan) -> None:
    """A sender field that is nothing but two or three words, and no firm or placeholder."""
    rest, last = [], 0
    for s, e, _ in sorted(x.found):
        rest += [x.t[last:s], " " * (e - s)]
        last = e
    rest = re.sub(r"\([^)]*\)", lambda m: " " * len(m.group()), "".join([*rest, x.t[last:]]))
    if rest.strip() not in PLACEHOLDERS and not FIRM_WORDS & set(re.findall(r"\w+", rest)) and "&" not in rest and (m := SENDER.fullmatch(rest)):
        x.add(m.start(1), m.end(1), "name")


def spans(text: str, ac, family: set[str], whole: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each stretch of personal data; ``whole``: the text is a sender field."""
    x = Scan(text)
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, (kind, size) in ac.iter(x.t):
        hits.setdefault(kind, []).append((end - size + 1, end + 1))
    _emails(x, hits)
    _numbers(x, hits)
    _addresses(x, hits)
    _directory_names(x, hits, family, whole)
    _led_names(x, hits)
    if whole and not any(k == "name" for *_, k in x.found):
        _sender(x)
    if x.at is None:
        return sorted(x.found)
    return sorted((x.at[s], x.at[e - 1] + 1, k) for s, e, k in x.found)


def directory(contacts: DataFrame) -> tuple[set[str], set[str]]:
    """Given and family names in lower case."""
    rows = contacts.select("given_name", "family_name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the directory has more than {MAX_NAMES} names, which is the bound of what is broadcast")
    clean = lambda k: {r[k].strip().lower() for r in rows if r[k] and len(r[k].strip()) > 1}
    return clean(0), clean(1)


def find(messages: DataFrame, contacts: DataFrame, fields: tuple[str, ...] = ("body", "from_name")) -> DataFrame:
    """row_id, field_name, pii_kind, span_text: each distinct stretch of personal data of each field."""
    given, family = directory(contacts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ac = automaton(given, family)
        for pdf in batches:
            ids, kinds, names, texts = [], [], [], []
            for field in fields:
                for row, text in zip(pdf["row_id"].to_numpy(), pdf[field].to_numpy()):
                    if text:
                        for kind, span in {(k, text[s:e]): 0 for s, e, k in spans(text, ac, family, field == "from_name")}:
                            ids.append(row)
                            names.append(field)
                            kinds.append(kind)
                            texts.append(span)
            if ids:
                yield pd.DataFrame({"row_id": ids, "field_name": names, "pii_kind": kinds, "span_text": texts})

    return spread(messages.select("row_id", *fields)).mapInPandas(run, "row_id bigint, field_name string, pii_kind string, span_text string")


def redact(messages: DataFrame, contacts: DataFrame, fields: tuple[str, ...] = ("body", "from_name")) -> DataFrame:
    """row_id and the fields with each stretch replaced by [EMAIL], [PHONE], [IDNUM], [ADDRESS] or [NAME]."""
    given, family = directory(contacts)

    def clean(text: str | None, ac, whole: bool) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for s, e, k in spans(text, ac, family, whole):
            out += [text[last:s], f"[{k.upper()}]"]
            last = e
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ac = automaton(given, family)
        for pdf in batches:
            yield pd.DataFrame({"row_id": pdf["row_id"]} | {f: [clean(x, ac, f == "from_name") for x in pdf[f]] for f in fields})

    return spread(messages.select("row_id", *fields)).mapInPandas(run, "row_id bigint, " + ", ".join(f"{f} string" for f in fields))
