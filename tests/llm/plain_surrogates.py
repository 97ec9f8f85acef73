"""The rules for surrogates said again in plain Python."""

import hashlib
import re

import regex

from skein.llm import pii


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


class PlainSurrogates:
    """The rules for surrogates said again in plain Python."""

    def __init__(self, key):
        self.key, self.attempts = key, {}

    def digest(self, kind, canonical):
        said = "|".join([self.key, kind, canonical, str(self.attempts.get((kind, canonical), 0))]).encode()
        return hashlib.sha256(said).hexdigest() + hashlib.sha256(b"more|" + said).hexdigest()

    def matches(self, text):
        if text is None:
            return []
        surnames = list(dict.fromkeys(m.group().split(" ")[-1] for m in regex.finditer(pii.PATTERNS["name"], text)))
        return list(regex.finditer(pii.ANY + (r"|(?<![\p{L}\p{N}])(?:" + "|".join(surnames) + ")" + pii._EDGE if surnames else ""), text))

    def kind(self, m):
        for kind, p in pii.PATTERNS.items():
            if regex.fullmatch(p, m):
                if kind == "long":
                    return "card" if luhn(re.sub(r"\D", "", m)) else "none"
                return kind if kind != "iban" or mod97(m.replace(" ", "")) == 1 else "none"
        return "name"

    def canonical(self, kind, m):
        digits = re.sub(r"\D", "", m)
        if kind == "phone":
            return "+" + digits if m.startswith("+") or re.fullmatch("1[0-9]{10}", digits) else "+1" + digits if re.fullmatch("[2-9][0-9]{9}", digits) else digits
        return digits if kind in ("card", "ssn") else m if kind in ("none", "key") else m.replace(" ", "") if kind == "iban" else m.split(" ")[-1].lower() if kind == "name" else m.lower()

    def given(self, m):
        title = regex.match(pii._TITLE + " ", m)
        words = m[title.end() :].split(" ")[:-1] if title else []
        while words and words[-1] in "von van der den de da di del della du la le zu zur bin ibn al".split():
            words.pop()
        if not words:
            return None
        return "given_" + ("f" if regex.search(pii._WOMAN, title.group()[:-1]) else "m"), " ".join(words).lower()

    def letters(self, m, digest, counted=None, keep=-1, hexadecimal=False):
        out, seen = "", 0
        for i, c in enumerate(m):
            if counted:
                seen += c in counted
                if seen <= keep:
                    out += c
                    continue
            d = digest[(seen if counted else i + 1) % 128]
            if keep >= 0:
                d = digest[(seen - keep) % 128]
            script = next((s for s in ("cyrillic", "greek", "arabic", "hebrew", "devanagari", "han", "hangul") if regex.match(rf"\p{{{s}}}", c)), "latin")
            letter = pii.LETTERS[script][int(d, 16)]
            if hexadecimal:
                out += d.upper() if c in "ABCDEF" else d if c in "0123456789abcdef" else c
            else:
                out += d.translate(str.maketrans("abcdef", "135790")) if c in "0123456789" else letter.upper() if regex.match(r"\p{Lu}", c) else letter if regex.match(r"\p{L}", c) else c
        return out

    def name(self, like, digest, kind, canonical):
        script = next((s for s in ("cyrillic", "greek") if regex.search(rf"\p{{{s}}}", like)), "latin")
        n = pii.NAME_SYLLABLES + self.attempts.get((kind, canonical), 0)
        a, b, c = pii.SYLLABLES[script]
        made = "".join(a[int(digest[2 * i], 16)] + b[int(digest[2 * i + 1], 16)] + c[int(digest[2 * i + 1], 16)] for i in range(n))
        return (made + (pii.ENDINGS[script, kind[-1]] if kind.startswith("given_") else "")).capitalize()

    def surrogate(self, m):
        kind = self.kind(m)
        canonical = self.canonical(kind, m)
        digest = self.digest(kind, canonical)
        numbers = "0123456789"
        if kind == "email":
            local, domain = m.split("@")
            host = f"mail{int(digest[89:97], 16)}.example.{domain.lower().split('.')[-1]}"
            return self.letters(local, digest) + "@" + (host if re.search("[a-z]", domain) else host.upper())
        if kind in ("secret", "ipv6"):
            return self.letters(m, digest, hexadecimal=True)
        if kind == "key":
            stays = len(regex.match("github_pat_|sk_live_|sk-|eyJ|.{4}", m).group())
            return m[:stays] + self.letters(m[stays:], digest)
        if kind == "ip":
            return ".".join(str(int(digest[2 * k : 2 * k + 2], 16) % 254 + 1) for k in range(4))
        if kind == "phone":
            return self.letters(m, digest, numbers, len(re.sub(r"\D", "", m)) - len(re.sub(pii._CODE, "", canonical)))
        if kind == "card":
            new = self.letters(m, digest, numbers, 1)
            return next(new[:-1] + d for d in numbers if luhn(re.sub(r"\D", "", new[:-1] + d))) if luhn(canonical) else new
        if kind in ("ssn", "none"):
            return self.letters(m, digest, numbers) if kind == "ssn" else m
        title = regex.match(f"({pii._TITLE}) ", m)
        last, given = m.split(" ")[-1], self.given(m)
        alike = lambda new: new.upper() if last.upper() == last and len(last) > 2 else new
        parts = [title.group(1)] if title else []
        if given:
            parts.append(alike(self.name(m, self.digest(*given), *given)))
        return " ".join([*parts, alike(self.name(m, digest, "name", canonical))])

    def replaced(self, text):
        found = self.matches(text)
        if not found:
            return text, 0
        out, at = "", 0
        for m in found:
            out += text[at : m.start()] + self.surrogate(m.group())
            at = m.end()
        return out + text[at:], sum(self.kind(m.group()) != "none" for m in found)
