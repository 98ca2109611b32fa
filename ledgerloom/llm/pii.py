"""Personal details in free text: found, and replaced with typed placeholders.

Details stand within a line. One linear-time expression over all lines picks those that may hold one, and only they are
read closely. Numbers are replaced within their format by a keyed Feistel permutation, other details by a keyed code, so
equal values stay linked across documents while the text stays readable.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship
from .tokens import by_bytes

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# --- Parts of names, streets and numbers ------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΫЀ-Я"
_LETTER = r"[^\W\d_]"
_WORD = rf"(?:(?:[Oo]['’]|[Dd]['’]|Mc|Mac)?[{_UP}](?:{_LETTER}|['’](?={_LETTER}))+)"
_PART = rf"{_WORD}(?:-{_WORD})*"
_INITIAL = rf"[{_UP}]\."
# Particles of surnames.
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ben|ter|ten|zu|af|av)"
_GIVEN = rf"(?:{_PART}|{_INITIAL})"
_SURNAME = rf"(?:{_PARTICLE}[ ]){{0,2}}{_PART}"
_STRAIGHT = rf"{_GIVEN}(?:[ ]{_GIVEN}){{0,2}}[ ]{_SURNAME}"
_TURNED = rf"{_SURNAME},[ ]{_GIVEN}(?:[ ]{_GIVEN}){{0,2}}"
# Scripts without capitals: two or three words of letters of one such script, or an unbroken name of two to five signs.
_OTHER = r"(?:[\u0590-\u08FF\u0900-\u0DFF\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF·・\u200c\u200d]+(?:[ \u3000][\u0590-\u08FF\u0900-\u0DFF\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF·・\u200c\u200d]+){0,3})"
_NAME = rf"(?:{_TURNED}|{_STRAIGHT})"
NAME = re.compile(rf"(?<![\w.@/-]){_NAME}(?![\w@]|[.]\w|-\w)")
# Words that make a capitalised phrase no person.
_NO_PERSON = frozenset(
    """bot ci build team list lists admin release service system support robot sync the and for from into this that with merge
    revert section limit lower upper index cache table page window note notes todo fixme group order by select update insert
    delete having where create alter patch subject date commit author signed reviewed tested reported acked change mon tue wed
    thu fri sat sun jan feb mar apr may jun jul aug sep oct nov dec monday tuesday wednesday thursday friday saturday
    sunday january february march april june july august september october november december no not null""".split()
)

_TLD = r"[A-Za-z]{2,24}"
_LOCAL = r"[\w%+'’-]+(?:\.[\w%+'-]+)*"
_PLAIN_MAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}@(?:(?!_)[\w-]+\.)+{_TLD}(?![\w-]|\.\w)")
_AT, _DOT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+)", r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\.)"
_SPELLED_MAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9_+-]+(?:{_DOT}[A-Za-z0-9_+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}{_TLD}(?![\w-])", re.I)
_MESSAGE_ID = re.compile(r"^\W*(?:message-id|in-reply-to|references|content-id)\b", re.I)
_LOGIN = re.compile(r"\b(?:ssh|scp|sftp|rsync|telnet|mosh|login|psql|mysql)\b[^@]*$", re.I)

_EXTENSION = r"(?:,?[ ]?(?:ext\.?|extn\.?|extension|x)[ ]?\d{1,6})?"
_PHONES = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00[ ]?)[1-9]\d{0,2}(?:[ ./-]?\(\d{1,4}\)[ ./-]?\d{1,5}|[ ./-]?\d{1,5})(?:[ ./-]?\d{2,8}){1,5}"
    r"|(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[ .-])[2-9]\d{2}[.-]\d{4}"
    r"|\(0\d{1,4}\)[ ]?\d{3,5}[ -]?\d{3,5}(?:[ -]?\d{2,4})?"
    r"|0\d{2,4}[/]\d{4,9}(?:-\d{1,4})?"
    r"|0\d{2,4}[ -]\d{5,8}"
    r"|0\d{2,4}[ ]\d{3,4}[ ]\d{3,4}"
    rf"){_EXTENSION}(?![\w/-]|[.:,]\d|\.\.)"
)

# What announces a phone number.
_PHONE_LABELS = r"(?:phone|mobile|mob|cell|tel|telephone|telefon|téléphone|teléfono|whatsapp|handy|fax)"
_PHONE_LEAD = re.compile(rf"(?<![A-Za-z]){_PHONE_LABELS}(?:[ ](?:no\.?|number|nr\.?))?(?:\.|[ ]is)?[ ]?[:=#]?[ ]?$", re.I)
_LABELLED_PHONES = re.compile(rf"(?<![A-Za-z_]){_PHONE_LABELS}(?:[ ](?:no\.?|number|nr\.?))?(?:\.|[ ]is)?[ ]?[:=#]?[ ]?(\+?\d[\d ()./-]{{6,18}}\d{_EXTENSION})(?![\w/-]|[.:,]\d)", re.I)

# What numbers that governments give to persons are called, and how they are written.
_ID_LABELS = r"""SSN|social\s+security(?:\s+(?:no\.?|number|nr\.?))?|aadh?aar(?:[ _-]?(?:no\.?|number|nr|card|id))?|PAN(?:[ _-]?(?:no\.?|number|card))?|
passport(?:[ _-]?(?:no\.?|number|nr\.?))?|nino|NI[ _](?:no\.?|number)|national\s+insurance(?:\s+(?:no\.?|number))?|national[ _]id(?:\s+(?:no\.?|number))?|
Steuer-?ID(?:nr\.?)?|Steueridentifikationsnummer|tax[ _]id(?:\s+(?:no\.?|number))?|DNI|NIE|NIR|CPF|CNPF|BSN|PESEL|TFN|SIN|CURP|codice\s+fiscale|voter[ _]id|driving\s+licen[cs]e(?:\s+(?:no\.?|number))?|
numéro\s+de\s+sécurité\s+sociale|Reisepass(?:nr\.?|nummer)?|pasaporte|passeport|паспорт|СНИЛС"""
_ID_VALUES = r"""\d{3}[- ]\d{2}[- ]\d{4}|\d{4}[ -]\d{4}[ -]\d{4}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{3}[.]\d{3}[.]\d{3}-\d{2}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|
[A-Z]{5}[ ]?\d{4}[ ]?[A-Z]|[12][ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}(?:[ ]\d{2})?|[A-Z]{1,3}[ ]?\d{6,9}[A-Z]?|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{9,15}"""
_IDS = re.compile(rf"(?<![A-Za-z0-9])(?:{_ID_LABELS})(?:\s*[:=#]\s*|\s+(?:is\s+)?)[\"']?({_ID_VALUES})(?![\w]|-\d)".replace("\n", ""), re.I)

# Without a label: shapes whose check digits must be right.
_PROVEN = re.compile(r"(?<![\w.+/-])(?:\d{3}[.]\d{3}[.]\d{3}-\d{2}|[12][ ]\d{2}[ ](?:0[1-9]|1[0-2])[ ]\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{2})(?![\w/-]|[.:,]\d)")

# Kinds of streets.
_STREET = r"""Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Terrace|Ter|Close|Cl|Court|Ct|Drive|Dr|Place|Pl|Square|Sq|Way|Crescent|Cres|Boulevard|Blvd|Highway|Hwy|
Parade|Parkway|Pkwy|Row|Walk|Gardens|Grove|Hill|Mews|Park|Marg|Nagar|Path|Chowk|Salai|Gali|Bazaar|Colony|Enclave|Vihar|Layout""".replace("\n", "")
_PLACE = rf"[{_UP}](?:{_LETTER}|['’](?={_LETTER}))+(?:-{_LETTER}+)*"
_TOWN = rf"{_PLACE}(?:[ ]{_PLACE}){{0,2}}"
_POST = r"(?:,[ ][A-Z]{2}[ ]\d{5}(?:-\d{4})?|[ ]-[ ]\d{5,6}|,?[ ]\d{4,6}(?:-\d{4})?|,?[ ][A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2})"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)[ ]?(?:No\.?[ ]?)?\w{1,5},?[ ])"
_ADDRESSES = re.compile(
    r"(?<![\w/.-])(?:"
    rf"{_UNIT}?(?:H\.?[ ]?No\.?[ ]?)?\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}}){{0,3}},?[ ](?:{_PLACE}[ ]){{1,3}}(?:{_STREET})\.?(?:,[ ](?:Sector|Block|Phase|Ward)[ ]\w{{1,4}})?,[ ]{_TOWN}{_POST}?"
    rf"|{_UNIT}?\d{{1,5}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|via|viale|piazza|corso)[ ](?:(?:de|du|des|la|le|les|della|dei|del)[ ]){{0,2}}{_TOWN},[ ](?:\d{{4,5}}[ ])?{_TOWN}{_POST}?"
    rf"|(?:Calle|Avenida|Avda\.?|Paseo|Plaza|C/|Rua|Travessa|Via|Viale|Piazza|Corso)[ ](?:(?:de|del|la|las|los|el|da|do|dos)[ ]){{0,2}}{_TOWN},?[ ]\d{{1,5}}(?:,[ ]\d{{1,3}}[ºª°][ ]?\w{{0,4}})?,[ ](?:\d{{4,5}}[ ])?{_TOWN}{_POST}?"
    rf"|(?:{_PLACE}[ -])?[{_UP}]{_LETTER}*?(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm)[ ]\d{{1,4}}[ ]?[a-z]?,[ ](?:\d{{4,5}}[ ])?{_TOWN}"
    r")(?!\w)"
)

# --- Where a name stands ------------------------------------------------------------------------------------------------
# Words before a name that announce a person, in the languages of the corpus's messages.
_LEADS = re.compile(
    r"(?:^\W{0,4}(?:Author|Commit|Committer|From|User|To|Cc|Sender|Maintainer|Contact|Owner|Reporter|Assignee)\b\s*:?\s*"
    r"|^\W{0,6}[A-Z][A-Za-z]+(?:-[a-z]+)*-[Bb]y\s*:\s*"
    r"|@author\s+|\bowner\s*[:=]\s*|\bcontact\s*:?\s*|\bcc\s*:?\s+|\b(?:by|ask|asked|to|with|from|told|tell|thanks|per|for|via|and|between|belonged to|belongs to)\s+"
    r"|\b(?:von|an|mit|gehörte|durch|par|avec|à|con|por|para|per|da|com|от|для|с)\s+"
    r"|[\"']?(?:full_?|first_|last_|display_?|customer_?|user_?|contact_?|employee_?)?name[\"']?\s*[:=]\s*[\"']?"
    r"|(?:Employee|Person|Customer|Contact|User|Patient|Member|Author)\(\s*[\"']"
    r"|(?:\(|^\W?|,)\s*\d+\s*,\s*[\"']|<td>\s*|<li>\s*)$"
)
# Words that announce a person whatever follows the name in ordinary prose, and what may follow a name where a person is at.
_PROSE = re.compile(r"\b(?:by|[Ee]mail|[Pp]ing|[Cc]all|[Aa]sk|[Aa]sked|[Tt]ell|told|[Tt]hanks to|[Mm]eet|met|[Tt]hank)\s+$|\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+$")
_THEN = re.compile(r"^(?:['’]s\b|\s+(?:yesterday|today|tomorrow|last|this|about|again)\b)")
_DESK = re.compile(r"\bat\s+$")
_OF_DESK = re.compile(r"^['’]s\s+(?:desk|office|place|house|home|machine|laptop|request)\b")
_AFTER = re.compile(r"^(?:\s*<[^>]*@|\s*[(\[<]?\s*$|\s+(?:saw|said|says|asked|wrote|reported|reports|noticed|found|confirmed|agreed|suggested|pointed|mentioned|told|called|hat|a\s+signalé|vio|relatou)\b)")
_HEADER = re.compile(r"^\W{0,4}(?:(?:Author|Commit|Committer|From|User|To|Cc)\b\s*:?\s*|[A-Z][A-Za-z]+(?:-[a-z]+)*-[Bb]y\s*:\s*)$")
_LEAD_OTHER = re.compile(rf"(?:^|[\"'>:,(\s])({_OTHER})\s*(?=$|[:/<,;(（\"'])")

# What a line shows that may hold a detail, each as one linear-time expression (RE2) that admits at least the lines its
# close reading takes; RE2 knows only ASCII white space and digits by itself. A closer look follows only for what a line shows.
_S = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_WITHIN = r"[^\x00-&(-,.-@\[-`{-\x7f]"  # what a part of a name may hold: no ASCII but letters, ' and -
_ID_CUE = (
    r"(?:ssn|nino|dni|nie|nir|cpf|cnpf|bsn|pesel|tfn|sin|curp)[^a-z]|pan(?:[^a-z]|n|c)|social|aad|passport|pasaporte|passeport|reisepass|ni[ _]n|insurance|"
    r"national[ _]id|steuer|tax[ _]id|codice|voter|driving|sécurité|паспорт|снилс"
).replace("i", "[iıİ]")
_CUES = {
    "mail": rf"[^ @]@[^ @]|[\[({{<]{_S}?(?i:at|dot|\.){_S}?[\])}}>]|{_S}(?i:dot){_S}",
    "phone": r"\+[1-9]\d{0,2}[ (./-]*\d[\d ()./-]{6}|(?:^|[^\w.+/-])(?:00 ?[1-9][\d ()./-]{5}|[2-9]\d\d[ .-][2-9]\d\d[.-]\d{4}|\([2-9]\d\d\) ?[2-9]\d\d[.-]\d{4}|\(0\d{1,4}\) ?\d{3}|0\d{2,4}[/ -]\d{3})|(?i:phone|mob|cell|tel|téléphone|teléfono|whatsapp|handy|fax).*\d".replace(r"\d", r"\p{Nd}"),
    "id": rf"(?i:{_ID_CUE}).*\p{{Nd}}",
    "proven": r"\p{Nd}{3}[.]\p{Nd}{3}[.]\p{Nd}{3}-\p{Nd}{2}|[12] \p{Nd}{2} \p{Nd}{2} \p{Nd}{2} \p{Nd}{3} \p{Nd}{3} \p{Nd}{2}",
    "address": (
        r"\d[\pL\pN_/-]*,? (?:[^ ,]+ ){1,4}[^ ,]+, ?[\p{Lu}\d]|\d ?(?:bis|ter|quater)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|via|viale|piazza|corso) "
        r"|\b(?:Calle|Avenida|Avda\.?|Paseo|Plaza|C/|Rua|Travessa|Via|Viale|Piazza|Corso) |(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm) \d"
    ).replace(r"\d", r"\p{Nd}"),
    "name": rf"[{_UP}](?:\.|{_WITHIN}+,?) (?:[a-z]{{2,5}} ){{0,2}}(?:[OoDd]['’])?[{_UP}](?:\.|{_WITHIN})",
    "birth": r"(?i:born|dob|birth|geboren|née?).*\p{Nd}",
    "other": r"[\x{0590}-\x{0DFF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}·\x{200C}\x{200D}]",
}
_ALL = frozenset(_CUES)


def _free(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y, _ in spans)


def _is_person(text: str) -> bool:
    words = re.findall(r"[^\W\d_]+", text)
    return len([w for w in words if w]) >= 2 and not any(w.lower() in _NO_PERSON for w in words) and any(len(w) > 1 for w in words)


def find_in_line(line: str, cues: frozenset[str] = _ALL) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each detail of a line, in order, none overlapping. cues: what the line may show."""
    spans: list[tuple[int, int, str]] = []
    if "mail" in cues and "@" in line and not _MESSAGE_ID.match(line):
        for m in _PLAIN_MAIL.finditer(line):
            a, b = m.span()
            before, after = line[:a], line[b : b + 2]
            remote = after[:1] == ":" and after[1:].strip() != "" or after[:1] == "/"
            if not remote and not re.search(r"\w+://\S*$", before) and not _LOGIN.search(before):
                spans.append((a, b, "email"))
    if "mail" in cues:
        for m in _SPELLED_MAIL.finditer(line):
            bracketed = re.search(r"[\[({<]\s?at\s?[\])}>]", m[0], re.I)
            if (bracketed or re.search(r"\sdot\s|[\[({<]", m[0], re.I)) and _free(spans, *m.span()):
                spans.append((*m.span(), "email"))
    for m in _IDS.finditer(line) if "id" in cues else ():
        value = m[1]
        if _free(spans, *m.span(1)) and sum(c.isdigit() for c in value) >= 4:
            spans.append((*m.span(1), "id_number"))
    for m in _PROVEN.finditer(line) if "proven" in cues else ():
        if _free(spans, *m.span()) and checked_kind(m[0]):
            spans.append((*m.span(), "id_number"))
    for m in _ADDRESSES.finditer(line) if "address" in cues else ():
        if _free(spans, *m.span()):
            spans.append((*m.span(), "street_address"))
    for m in _PHONES.finditer(line) if "phone" in cues else ():
        digits = sum(c.isdigit() for c in re.split(r"e?x", m[0])[0])
        # A plus in the first column marks an added line, unless groups follow as in a phone number.
        marker = m.start() == 0 and m[0][0] == "+" and not re.match(r"\+\d{1,3}[ (]", m[0])
        before = line[: m.start()]
        if 8 <= digits <= 15 and not marker and _free(spans, *m.span()) and (_PHONE_LEAD.search(before) or not re.search(r"[#:]\d*$|\d[:-]$", before)):
            spans.append((*m.span(), "phone"))
    for m in _LABELLED_PHONES.finditer(line) if "phone" in cues else ():
        if 8 <= sum(c.isdecimal() for c in re.split(r"e?x", m[1])[0]) <= 15 and _free(spans, *m.span(1)):
            spans.append((*m.span(1), "phone"))
    if "name" in cues or "other" in cues:
        spans += _names(line, spans)
    return sorted(spans)


def _names(line: str, details: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    at = 0
    while m := NAME.search(line, at):
        # "Reported von Ada Byron" holds a lead, "Ada von Byron" a particle: what follows the word tells.
        lead = re.match(rf"{_PART}[ ]{_PARTICLE}[ ]", m[0])
        inner = NAME.match(line, m.start() + lead.end()) if lead else None
        if inner and inner.end() > m.end():
            m = inner
        a, b = m.span()
        at = b
        if re.search(r"['’]s$", m[0]):  # of a person
            b -= 2
        text = line[a:b]
        while True:  # a word that announces a person may look like a first name
            first = re.match(rf"({_GIVEN})[ ](?={_STRAIGHT}$)", text)
            if first and first[1].lower() in _NO_PERSON | {"contact", "owner", "customer", "talked", "ask", "thanks", "cc", "user"}:
                a += first.end()
                text = line[a:b]
            else:
                break
        if not _is_person(text) or not _free(details, a, b) or not _free(out, a, b):
            continue
        before, after = line[:a], line[b:]
        # Something that identifies a person stands right behind it.
        near = any(0 <= x - b <= 6 and not re.search(r"\w", line[b:x]) or (k == "id_number" and 0 <= x - b <= 40 and re.fullmatch(r"[\"']?\s*[,/:;(-]\s*[\"']?[\w .:=#-]*", line[b:x])) for x, _, k in details)
        header = _HEADER.search(before) is not None
        if header and not (re.match(r"\s*(?:<|$)", after)):
            continue
        lead = _LEADS.search(before) is not None
        speaks = not re.search(r"\w", before) and _AFTER.match(after) and not re.match(r"\s*$", after)
        if "," in text and not (lead or near or speaks):
            continue
        if near or header or (lead and re.match(r"\s*(?:$|[<,;:.)\"'/]|\(|about\b|who\b|that\b|über\b|wegen\b|sobre\b|à\b|au\b|and\b|saw\b|in\b|on\b|via\b|instead\b|if\b)", after)) or speaks or (_PROSE.search(before) and not re.search(r"\b[A-Z]{2,}\b", text) and (_THEN.match(after) or re.search(r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+$", before))) or (_DESK.search(before) and _OF_DESK.match(after)):
            out.append((a, b, "person_name"))
    if not line.isascii():
        for m in _LEAD_OTHER.finditer(line):
            a, b = m.span(1)
            follows = any(0 <= x - b <= 4 or (k == "id_number" and 0 <= x - b <= 40) for x, _, k in details)
            if (follows or _LEADS.search(line[:a])) and _free(details, a, b) and _free(out, a, b) and b - a >= 2:
                out.append((a, b, "person_name"))
    return out


# --- Pseudonyms -----------------------------------------------------------------------------------------------------------


def feistel(symbols: list[int], radix: int, key: bytes, tweak: bytes = b"") -> list[int]:
    """A keyed permutation of the strings of len(symbols) symbols below radix: ten rounds of an alternating Feistel network
    with addition modulo the half's size. Strings of one symbol are shifted by a keyed amount."""
    n = len(symbols)
    u = n // 2
    a, b = 0, 0
    for s in symbols[:u]:
        a = a * radix + s
    for s in symbols[u:]:
        b = b * radix + s
    sizes = [radix**u, radix ** (n - u)]
    for i in range(10):
        f = int.from_bytes(hmac.digest(key, tweak + bytes([i, n % 256, radix]) + b.to_bytes(16, "big"), "sha256")[:16], "big")
        a, b = b, (a + f) % sizes[i % 2]
    out = []
    for value, length in ((a, u), (b, n - u)):
        part = []
        for _ in range(length):
            value, r = divmod(value, radix)
            part.append(r)
        out += part[::-1]
    return out


def unfeistel(symbols: list[int], radix: int, key: bytes, tweak: bytes = b"") -> list[int]:
    """The inverse of feistel."""
    n = len(symbols)
    u = n // 2
    a, b = 0, 0
    for s in symbols[:u]:
        a = a * radix + s
    for s in symbols[u:]:
        b = b * radix + s
    sizes = [radix**u, radix ** (n - u)]
    for i in reversed(range(10)):
        f = int.from_bytes(hmac.digest(key, tweak + bytes([i, n % 256, radix]) + a.to_bytes(16, "big"), "sha256")[:16], "big")
        a, b = (b - f) % sizes[i % 2], a
    out = []
    for value, length in ((a, u), (b, n - u)):
        part = []
        for _ in range(length):
            value, r = divmod(value, radix)
            part.append(r)
        out += part[::-1]
    return out


def _luhn_like(digits: list[int], weights: tuple[int, ...]) -> int:
    return sum(d * w for d, w in zip(digits, weights, strict=True))


def _verhoeff(digits: list[int]) -> bool:
    """Verhoeff's check: the dihedral group of ten, with its permutation applied once more for each place."""
    times = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5
    turn, c = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), 0
    for i, d in enumerate(reversed(digits)):
        for _ in range(i % 8):
            d = turn[d]
        c = times(c, d)
    return c == 0


def _mod_11_10(digits: list[int]) -> bool:
    product = 10
    for d in digits[:-1]:
        product = ((d + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == digits[-1]


def _cpf(d: list[int]) -> bool:
    one = _luhn_like(d[:9], tuple(range(10, 1, -1))) * 10 % 11 % 10
    two = _luhn_like(d[:10], tuple(range(11, 1, -1))) * 10 % 11 % 10
    return len(set(d)) > 1 and d[9:] == [one, two]


def _letter_of(text: str) -> bool:
    """The letter that ends a Spanish number; a leading X, Y, Z stands for 0, 1, 2."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(text[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == text[-1]


_digits = lambda t: [int(c) for c in t]
# Government numbers with check digits, by the shape of their letters and digits, and the check.
CHECKED = {
    "aadhaar": (r"[2-9]\d{11}", lambda t: _verhoeff(_digits(t))),
    "pesel": (r"\d{11}", lambda t: _luhn_like(_digits(t), (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)) % 10 == 0),
    "cpf": (r"\d{11}", lambda t: _cpf(_digits(t))),
    "steuer-id": (r"[1-9]\d{10}", lambda t: _mod_11_10(_digits(t))),
    "bsn": (r"\d{9}", lambda t: _luhn_like(_digits(t), (9, 8, 7, 6, 5, 4, 3, 2, -1)) % 11 == 0),
    "nir": (r"[12]\d{14}", lambda t: 97 - int(t[:13]) % 97 == int(t[13:])),
    "dni": (r"\d{8}[A-Z]", _letter_of),
    "nie": (r"[XYZ]\d{7}[A-Z]", _letter_of),
}


def checked_kind(text: str) -> str | None:
    """The first kind of government number of whose shape text is and whose check digits are right."""
    bare = re.sub(r"[^0-9A-Z]", "", text.upper()) if text.isascii() else ""
    return next((k for k, (shape, right) in CHECKED.items() if re.fullmatch(shape, bare) and right(bare)), None)


def _permuted(text: str, key: bytes, kind: str) -> str:
    """text with its digits and letters permuted among themselves; lower case stays lower case, all else stays."""
    digits = [int(c) for c in text if c.isdecimal()]
    letters = [ord(c.upper()) - 65 for c in text if "A" <= c.upper() <= "Z"]
    new_digits = iter(feistel(digits, 10, key, kind.encode())) if digits else iter(())
    new_letters = iter(feistel(letters, 26, key, kind.encode())) if letters else iter(())
    out = []
    for c in text:
        if c.isdecimal():
            out.append(str(next(new_digits)))
        elif "A" <= c.upper() <= "Z":
            out.append(chr((65 if c.isupper() else 97) + next(new_letters)))
        else:
            out.append(c)
    return "".join(out)


def permute_number(text: str, key: bytes, kind: str) -> str:
    """A number of the same format: digits become digits, letters letters of the same case, all else stays. A prefix that
    says how to dial (+ and country code, leading zeros) stays too. Equal digits give equal digits however they are grouped.

    A government number whose check digits are right becomes another of its kind with right ones: the permutation is walked until it
    comes to one, which keeps it a permutation of the right ones."""
    kept = re.match(r"\+\d{1,3}(?=[ (.-])|0+", text) if kind == "phone" else None
    body_from = kept.end() if kept else 0
    main = re.split(r"(?=,?\s?e?x)", text[body_from:])[0] if kind == "phone" else text[body_from:]
    new = _permuted(main, key, kind)
    of = checked_kind(main) if kind == "id_number" else None
    while of and checked_kind(new) != of:
        new = _permuted(new, key, kind)
    return text[:body_from] + new + text[body_from + len(main) :]


def permute_date(day: date, key: bytes, first: date = date(1850, 1, 1), days: int = 65_000) -> date:
    """Another day of the same span, keyed; the permutation of five digits is walked until it falls within the span."""
    n = (day - first).days
    if not 0 <= n < days <= 100_000:
        return day
    while True:
        n = int("".join(map(str, feistel([int(c) for c in f"{n:05d}"], 10, key, b"date"))))
        if n < days:
            return first + timedelta(days=n)


_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in _MONTHS) + r")\.?"
_BIRTH = re.compile(
    r"(\b(?:born(?:\s+on)?|DOB|date\s+of\s+birth|birth[ _]?date|birthday|geboren(?:\s+am)?|née?\s+le)\s*[:=]?\s*)"
    rf"(\d{{4}}([-/.])\d{{1,2}}\3\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\4\d{{4}}|\d{{1,2}}[ ]{_MONTH}[ ]\d{{4}}|{_MONTH}[ ]\d{{1,2}},?[ ]\d{{4}})(?!\w)", re.I,
)


def permute_birth(text: str, key: bytes) -> str | None:
    """The keyed day for a date of birth, in the layout of text: year first, day first, or with the month's name; null if it is none."""
    parts = re.findall(r"\d+|[A-Za-z]+", text)
    named = next((i for i, x in enumerate(parts) if x.isalpha()), None)
    if named is not None:
        order = (2, named, 1 - named)
        month = next(i for i, m in enumerate(_MONTHS, 1) if m[:3].lower() == parts[named][:3].lower())
    else:
        order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
        month = int(parts[1])
    try:
        new = permute_date(date(int(parts[order[0]]), month, int(parts[order[2]])), key)
    except ValueError:
        return None
    name = None if named is None else _MONTHS[new.month - 1] if len(parts[named]) > 3 else _MONTHS[new.month - 1][:3]
    fresh = {order[0]: f"{new.year:04d}", order[1]: name or str(new.month), order[2]: str(new.day)}
    spots = iter(range(3))

    def put(m: re.Match) -> str:
        i = next(spots)
        return fresh[i].zfill(len(m[0])) if m[0].isdigit() else fresh[i]

    return re.sub(r"\d+|[A-Za-z]+", put, text)


def secret_key(secret: bytes) -> bytes:
    """The key of all pseudonyms: a hash of the whole secret, however long it is."""
    return hashlib.sha256(secret).digest()


def placeholder(kind: str, text: str, key: bytes) -> str:
    """``<KIND:pseudonym>``: a number of the same format, or a keyed code of 128 bits of the text without case and spacing."""
    if kind in ("phone", "id_number"):
        return f"<{kind.upper()}:{permute_number(text, key, kind)}>"
    same = re.sub(r"\W+", " ", text.casefold()).strip()
    return f"<{kind.upper()}:{hashlib.blake2b(same.encode(), key=key, digest_size=16).hexdigest()}>"


def redact_line(line: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    """The line with its details and dates of birth replaced. key: see secret_key."""
    births = [(*m.span(2), "birth") for m in _BIRTH.finditer(line) if _free(spans, *m.span(2))]
    out, at = [], 0
    for a, b, kind in sorted(spans + births):
        new = placeholder(kind, line[a:b], key) if kind != "birth" else permute_birth(line[a:b], key)
        out += [line[at:a], line[a:b] if new is None else new if kind != "birth" else f"<BIRTH_DATE:{new}>"]
        at = b
    return "".join(out) + line[at:]


# --- Operators ------------------------------------------------------------------------------------------------------------

_BREAK = re.compile(r"(\r\n|\n|\r)")


def find_in_text(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each detail of a text."""
    out, at = [], 0
    for i, part in enumerate(_BREAK.split(text or "")):
        if i % 2 == 0:
            out += [(at + a, at + b, k) for a, b, k in find_in_line(part)]
        at += len(part)
    return out


def redact(text: str | None, secret: bytes) -> str | None:
    """The text with its details replaced; null stays null."""
    if text is None:
        return None
    key = secret_key(secret)
    return "".join(redact_line(p, find_in_line(p), key) if i % 2 == 0 else p for i, p in enumerate(_BREAK.split(text)))


def _maybe_lines(texts: pa.StringArray) -> Iterator[tuple[int, str, frozenset[str]]]:
    """(row, line, cues) of all lines that show something. Expressions run once for each different line of the batch."""
    lines = pc.split_pattern_regex(pc.fill_null(texts, ""), r"\r\n|\n|\r")
    rows, coded = pc.list_parent_indices(lines), pc.list_flatten(lines).dictionary_encode()
    shown = np.zeros(len(coded.dictionary), np.uint8)
    for i, cue in enumerate(_CUES.values()):
        shown |= pc.match_substring_regex(coded.dictionary, cue).to_numpy(zero_copy_only=False).astype(np.uint8) << i
    codes = coded.indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(shown[codes])
    seen = np.unique(codes[at])
    words = dict(zip(seen.tolist(), coded.dictionary.take(pa.array(seen)).to_pylist(), strict=True))
    sets = [frozenset(c for i, c in enumerate(_CUES) if mask >> i & 1) for mask in range(1 << len(_CUES))]
    for row, code in zip(rows.to_numpy(zero_copy_only=False)[at].tolist(), codes[at].tolist(), strict=True):
        yield row, words[code], sets[shown[code]]


class _Lines:
    """Spans of lines, each read once while it is remembered; memory is bounded by characters and never changes a result."""

    def __init__(self, most: int = 32_000_000):
        self.known: dict[str, list[tuple[int, int, str]]] = {}
        self.size, self.most = 0, most

    def of(self, texts: pa.StringArray) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
        """(row, line, spans) of all lines that show something."""
        for row, line, cues in _maybe_lines(texts):
            spans = self.known.get(line)
            if spans is None:
                if self.size > self.most:
                    self.known.clear()
                    self.size = 0
                spans = self.known[line] = find_in_line(line, cues)
                self.size += len(line) + 100
            yield row, line, spans


def find_details(documents: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, found_text, placeholder): one row per row of documents, kind and different text, exactly as written, with the
    placeholder that replace_details puts in its place.

    Null, empty and blank texts hold nothing. Repeated documents come out each on its own; within one, a detail counts once. Texts
    of any length are read whole, line by line. An empty table gives no rows; further columns are not read. No shuffle.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, code, new = _Lines(), secret_key(secret), {}
        for batch in batches:
            for b in by_bytes(batch, 1):
                found = dict.fromkeys((row, k, line[x:y]) for row, line, spans in lines.of(b.column(1)) for x, y, k in spans)
                if len(new) > 100_000:
                    new.clear()
                for _, k, t in found:
                    if (k, t) not in new:
                        new[k, t] = placeholder(k, t, code)
                rows = pa.array([r for r, _, _ in found], pa.int64())
                cells = [pa.array(c, pa.string()) for c in ([k for _, k, _ in found], [t for _, _, t in found], [new[k, t] for _, k, t in found])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *cells], names=[key, "kind", "found_text", "placeholder"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, found_text string, placeholder string")


def replace_details(documents: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with each detail that find_details finds, and dates of birth, replaced by placeholders; null stays null. The secret
    links equal values."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, code = _Lines(), secret_key(secret)
        for batch in batches:
            for b in by_bytes(batch, 1):
                new: dict[int, dict[str, str]] = {}
                for row, line, spans in lines.of(b.column(1)):
                    fresh = redact_line(line, spans, code)
                    if fresh != line:
                        new.setdefault(row, {})[line] = fresh
                texts = b.column(1).to_pylist()
                for row, by_line in new.items():
                    texts[row] = "".join(by_line.get(p, p) if i % 2 == 0 else p for i, p in enumerate(_BREAK.split(texts[row])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, text])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
