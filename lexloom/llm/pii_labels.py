"""A small labelled table of invented sentences for the sequence model: (token, tag) lists made from forms and contexts.

Kinds: ``national`` (phone numbers without a plus sign), ``identifier`` (numbers of persons and papers), ``obfuscated`` (mail
addresses spelled with words) and ``secret`` (keys, tokens, passwords). Forms have # for a digit, X for a capital, h for a
hexadecimal digit, k for a letter or digit and c for a capital or digit; a fixed generator fills them, so that the table is
the same on each run. Contexts have {} for the span. Sentences without a span hold numbers and cue words of other uses.
"""

from __future__ import annotations

KINDS = ("national", "identifier", "obfuscated", "secret")

PHONES = (
    "(###) ###-####", "###-###-####", "### ### ####", "0## ### ####", "0### ######", "0#### ######", "0# ## ## ## ##", "9## ## ## ##",
    "9# ### ## ##", "###.###.####", "(0##) #######", "0###-#######", "0##/#######", "1-800-###-####",
)
PHONE_CONTEXTS = (
    "call me on {} this evening", "call {}", "phone {} or write", "tel: {} before noon", "his number is {}", "mobile {} please", "fax {} is off",
    "Phone: {}", "ring {} and ask for me", "téléphone {} merci", "tél. {}", "Telefon {} bitte", "Tel.: {}", "rufen Sie {} an",
    "teléfono {} por favor", "llame al {}", "you can reach her at {}", "my cell: {}", "text {} now", "contact: {}",
)
IDENTIFIERS = ("###-##-####", "########X", "X#######X", "X########", "XX######X", "# ## ## ## ### ### ##", "## ### ### ###", "##/###/#####", "XX ## ## ## X")
IDENTIFIER_CONTEXTS = (
    "my SSN is {}", "SSN: {}", "social security number {}", "her social security no. {} leaked", "passport no. {}", "passport {} expired", "DNI {}",
    "con DNI {} y domicilio", "NIE: {}", "Steuernummer {}", "Personalausweis {} gültig", "numéro de sécurité sociale {}", "passeport {} perdu",
    "national ID {}", "licence {} was his", "insurance number {}",
)
NAMES = ("anna", "pat", "lee", "kim", "jo", "maria", "hans", "luc", "john", "smith", "weber", "garcia", "martin", "info", "sales", "m.roux", "r2", "tom88")
PLACES = ("example", "mail", "gmail", "post", "firma", "correo", "work", "uni", "shop")
ENDINGS = ("com", "org", "net", "de", "fr", "es", "edu", "io")
AT = ("at", "at", "AT", "(at)", "[at]", "{at}", "<at>", "-at-")
DOT = {"at": "dot", "AT": "DOT", "(at)": "(dot)", "[at]": "[dot]", "{at}": "{dot}", "<at>": "<dot>", "-at-": "-dot-"}
MAIL_CONTEXTS = ("write to {} today", "mail {} soon", "contact {} for this", "email {} or call", "e-mail: {} thanks", "{}", "my address is {}", "reach me at {}", "schreiben Sie an {}", "escriba a {}", "écrivez à {}")
SECRETS = (
    "h" * 32, "h" * 40, "h" * 64, "AKIA" + "c" * 16, "AKIA" + "X" * 12 + "#" + "X" * 3, "XXXX" + "c" * 16, "ghx_" + "k" * 30, "sk-" + "k" * 36, "k" * 20, "k" * 24, "k" * 40, "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh",
    "kkkkkkkk/kkkkkkkk+kkkkkkkkkkkkkk=", "kkkkk##kkkkkk", "kk#kkkkkk#k!", "hunter#kkk##", "dragon##kk#", "Sommer####kk", "k#kk#kkkk",
)
SECRET_CONTEXTS = (
    "token = {} and more", "token: {}", "the token {} works", "api_key: {} is old", "api key {}", "apikey={}", "password = {} was reset", "password: {}",
    "passwd {}", "pwd: {}", "my password is {}", "secret = {} in the file", "secret: \"{}\"", "key {} leaked", "{} is the aws key", "access key {}", "Authorization: Bearer {}",
    "export SECRET_KEY={}", "contraseña: {}", "mot de passe : {}", "Passwort: {}", "clave {}",
)
PLAIN = (
    "at noon the dot on the map moved .", "she was at the corner , not there", "the room 201 is on floor 3 .", "in 1998 there were 555 of them",
    "licensed under version 3.0 of the text", "pages 201 - 334 are lost", "it cost 3,344 and 55 more", "on 2021-03-14 at 10:30 it began", "am 14.03.2021 um 9.30 Uhr",
    "le 14 juillet 1789 à 9 h", "el 12/05/1999 por la tarde", "12 000 habitants en 2004", "75011 Paris , 28013 Madrid , 10115 Berlin", "ISBN 978-3-16-148410-0 , second print",
    "he said : yes ; and no .", "the token of thanks was small", "a key opens the door", "his password was long", "the secret was out", "call me at ten", "phone calls at home",
    "write at once", "mail came at noon", "score 4-2 in game 17 .", "from 10 to 20 at most", "the number ################ is long", "see ###.##.##.## for it",
    "a.##@mail#.example.com wrote it", "tom@example.org wrote back", "call +1 (###) ###-#### now", "tel +44 20 #### #### works", "en la ley 12 de 1999 .", "Nº 45 , p. 12-18",
    "nothing here is private at all", "x = 3 and y = 4", "the value = 10 of it", "key = value", "key: none", "token: none yet", "password: required", "at the dot com boom",
    "version 2.0.1 of the tool", "release v10.4.12-beta3 today", "a long-winded well-known half-open thing", "(a) first (b) second", "[1] the note [2] more", "anna at home",
    "john smith at work", "dot and dash", "look at example and compare", "colour #ff00aa on white", "COVID-19 and H1N1", "MP3 players and A4 paper", "§ 12 Abs. 3 Satz 1",
    "model XC90 of 2015", "flight LH 4711 at gate B22", "order no. 4711 of 1,200", "10 ml twice a day", "5 x 10 = 50", "1.000.000 euros", "route 66 and highway 101",
    "temperature 21.5 at 1013 hPa", "https://example.org/2020/01/05/a-page?id=12345", "line 120 , column 45", "the 1990s and the 2000s", "id 17 of 300", "section 4.2.1 says so",
)
LINKS = ("at", "dot", "to", "or", "is", "and", "of", "mail", "write", "number", "call", "key", "token", "=", "AT", "contact", "password", "secret", "phone", "com", "org", "my", "de", "es")
MARKS = ("", "", "", "", ",", ".", "***", "!!", "###", ".***", "|", ";", "?", "%", "$$")
ONSETS, VOWELS, CODAS = "b c d f g h l m n p r s t v w".split(), "a e i o u ä é ó".split(), ["", "", "n", "s", "r", "ng", "st"]


class Filler:
    """A fixed sequence of choices."""

    def __init__(self, seed: int):
        self.state = seed

    def turn(self, n: int) -> int:
        self.state = (self.state * 1103515245 + 12345) % 2147483648
        return (self.state >> 8) % n

    def one(self, of):
        return of[self.turn(len(of))]

    def filled(self, form: str) -> str:
        letters = "abcdefghijklmnopqrstuvwxyz"
        marks = {"#": "0123456789", "X": letters.upper(), "h": "0123456789abcdef", "k": letters + letters.upper() + "0123456789" * 3, "c": letters.upper() + "0123456789"}
        return "".join(self.one(marks[x]) if x in marks else x for x in form)

    def address(self) -> str:
        at = self.one(AT)
        dot = DOT[at]
        parts = [self.one(NAMES), *([dot, self.one(NAMES)] if self.turn(3) == 0 else []), at, self.one(PLACES), *([dot, self.one(PLACES)] if self.turn(4) == 0 else []), dot, self.one(ENDINGS)]
        return ("" if at[0] in "([{<-" and self.turn(2) else " ").join(parts)

    def word(self) -> str:
        word = "".join(self.one(ONSETS) + self.one(VOWELS) + self.one(CODAS) for _ in range(1 + self.turn(4)))
        return self.one((word, word, word, word.capitalize(), word.upper()))


def tagged(context: str, span: str, kind: str) -> list[tuple[str, str]]:
    """Tokens of the context with those of the span tagged; what touches the span without a blank is part of its token."""
    begin = context.find("{}")
    text, end, row, at = context.replace("{}", span), begin + len(span), [], 0
    for token in text.split():
        at = text.index(token, at)
        inside = begin >= 0 and at < end and at + len(token) > begin
        row.append((token, ("I-" if row and row[-1][1] != "O" else "B-") + kind if inside else "O"))
        at += len(token)
    return row


def labelled_rows(each: int = 110, plain: int = 260, seed: int = 12345) -> list[list[tuple[str, str]]]:
    """`each` sentences of every kind, some inside a longer sentence; all of PLAIN three times; `plain` rows of invented prose
    with cue words strewn in, sometimes with a word many times over."""
    f, rows = Filler(seed), []
    forms = {
        "national": (PHONE_CONTEXTS, lambda: f.filled(f.one(PHONES))),
        "identifier": (IDENTIFIER_CONTEXTS, lambda: f.filled(f.one(IDENTIFIERS))),
        "obfuscated": (MAIL_CONTEXTS, f.address),
        "secret": (SECRET_CONTEXTS, lambda: f.filled(f.one(SECRETS)) if f.turn(8) else f.one(("hunter", "dragon", "letmein")) + f.filled("#kk##")),
    }
    prose = lambda n: [(f.word(), "O") for _ in range(n)]
    for kind, (contexts, span) in forms.items():
        for k in range(each):
            row = tagged(contexts[k % len(contexts)], span(), kind)
            if k % 3 == 2:
                row[-1] = (row[-1][0] + f.one((".", ",", "")), row[-1][1])
            rows.append(prose(f.turn(6)) + row + prose(f.turn(6)) if f.turn(2) else row)
    for _ in range(3):
        rows += [tagged(f.filled(x) if "##" in x else x, "", "") for x in PLAIN]
    for _ in range(plain):
        row = []
        while len(row) < 10 + f.turn(12):
            word = f.one(LINKS) if f.turn(4) == 0 else f.word()
            row += [(word + f.one(MARKS), "O")] * (1 if f.turn(9) else 2 + f.turn(14))
        rows.append(row)
    for word in ("at", "At", "AT", "dot", "to", "key", "token"):  # a word many times over, between other words
        rows += [prose(1 + f.turn(4)) + [(word, "O")] * (1 + f.turn(24)) + prose(1 + f.turn(4)) for _ in range(5)]
    return rows
