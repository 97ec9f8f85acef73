"""Surrogates for personal data: each detected entity gets a keyed replacement of its own type, script and format.

Detection is one pattern over whole texts: e-mail addresses, secrets (hexadecimal ones of any length, web tokens, and access keys with a known beginning), IP addresses of both versions, account
(IBAN), telephone, card and social-security numbers, and names after a form of address. An entity has a canonical form (digits alone, lower case,
the surname), and its surrogate is derived from a keyed digest of type and canonical form. So all mentions of one entity, in any format
and any document, get the same surrogate (coreference), digits stay digits and letters stay letters of their script and case, card and
account numbers keep a valid check digit, and forms of address keep their gender. The distinct entities of the corpus are checked: where
two of one type would share a surrogate, or a surrogate is itself an entity of the corpus, the later one is derived anew until none clash
(distinctness). Surnames and given names, by gender, are entities of their own, so different full names stay different.

Only DataFrame functions are used. Texts are split at the matches and put together again, so a surrogate is never searched for entities.

Edge cases: a null text stays null and an empty one empty, both without entities; texts without entities are unchanged; very long texts and
entities are handled whole; repeated rows get equal surrogates, and of entities that clash the first in alphabetical order keeps its surrogate (ties);
rows with a null id are handled like others; an empty table gives an empty result. All columns of the input stay, but one named n_entities gives way to
the result.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import beside, perhaps, row_hash, rows_with, saved, shuffle_width

# Forms of address by gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "госпожа", "Lady", "Doña", "Signora", "Κυρία", "κυρία"]
MALE_TITLES = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "господин", "Sir", "Lord", "Don", "Signor", "Κύριος", "κύριος"]
OTHER_TITLES = ["Dr", "Prof", "Professor", "Doktor", "Доктор", "доктор", "Профессор", "профессор"]  # surrogate given names have the ending of men
HEX = "0123456789abcdef"
# For each script the letters that stand for the sixteen hexadecimal digits in a replaced word.
LETTERS = {
    "latin": "abcdefghiklmnopr", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ", "arabic": "ابتثجحخدذرزسشصضط", "hebrew": "אבגדהזחטיכלמנסעפ",
    "devanagari": "कखगघचछजझटठडढतथदध", "han": "天地人山水火木金土日月风云花石竹", "hangul": "가나다라마바사아자차카타파하고노",
}
# A syllable of a surrogate name is a consonant for one hexadecimal digit, and a vowel and a closing consonant for the next.
SYLLABLES = {
    "latin": ("bdfghklmnprstvwz", "aeioaeioaeioaeio", "llllnnnnrrrrssss"),
    "cyrillic": ("бвгдзклмнпрстфхч", "аеиоаеиоаеиоаеио", "ллллннннррррсссс"),
    "greek": ("βγδζθκλμνπρστφχψ", "αειοαειοαειοαειο", "λλλλννννρρρρσσσσ"),
}
# Endings of surrogate given names, by gender.
ENDINGS = {("latin", "f"): "ia", ("latin", "m"): "us", ("cyrillic", "f"): "ия", ("cyrillic", "m"): "ий", ("greek", "f"): "ία", ("greek", "m"): "ιος"}
NAME_SYLLABLES = 4  # of a first attempt, 2**32 names; a later attempt has more

BROADCAST_BYTES = 16 << 20  # of re-derived surrogates that are sent to all tasks; beyond that, the texts that hold one are shuffled
ROUNDS = 24  # of deriving surrogates that clash anew; entities of a type that has fewer surrogates than the corpus has entities are an error

_LOCAL = r"[\p{L}\p{N}._%+-]"
_TITLES = FEMALE_TITLES + MALE_TITLES + OTHER_TITLES
_WRITTEN_TITLES = _TITLES + [t.upper() for t in _TITLES if t[0].isupper()]
_ONE_TITLE = "(?:" + "|".join(sorted(_WRITTEN_TITLES, key=lambda t: (-len(t), t))) + r")\.?"
_TITLE = rf"{_ONE_TITLE}(?: {_ONE_TITLE}){{0,2}}"
_WORD = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:['’]\p{L}[\p{L}\p{M}]+|-\p{Lu}[\p{L}\p{M}]*)*"
_PARTICLES = r"(?:(?:von|van|der|den|de|da|di|del|della|du|la|le|zu|zur|bin|ibn|al) ){0,3}"
_EDGE = r"(?![\p{L}\p{N}])"
_NO_DATE = r"(?![0-9]{2}[./-][0-9]{2}[./-][0-9]{4}(?![0-9]))"
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z0-9-]*[A-Za-z0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9_])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}+|xox[abprs]-[0-9A-Za-z-]{10,}+"
    r"|github_pat_[0-9A-Za-z_]{22,}+|sk-(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{20,}+|eyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)(?![A-Za-z0-9_])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:\+[1-9][0-9]{0,2}[ ./-]?(?:\([0-9]{1,5}\)[ ./-]?)?(?:[0-9][ ./-]?){5,13}[0-9](?![0-9])"
    r"|(?<![.,/-])(?:1[ .-])?(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.|[0-9]{3} [0-9]{3} )[0-9]{4}(?![0-9]|[ -][0-9])"
    rf"|(?<![.,/-]){_NO_DATE}(?![0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))(?:\(0[1-9][0-9]{{0,3}}\) ?|0[1-9][0-9]{{0,3}}[ /-])(?:[0-9][ -]?){{5,9}}[0-9](?![0-9]))",
    "card": r"(?<![0-9])[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![0-9])",
    "long": r"(?<![0-9.,])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?: [0-9]{4}){3} [0-9]{1,3}|[0-9]{4}(?:-[0-9]{4}){3}-[0-9]{1,3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE} (?:(?:{_WORD}|\p{{Lu}}\.) ){{0,3}}{_PARTICLES}{_WORD}{_EDGE}",
}
_CODE = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|0[0-9])"  # country code, or the beginning of an area code
_WOMAN = rf"(?i)(?:^| )(?:{'|'.join(FEMALE_TITLES)})(?:$|[. ])"
ANY = "|".join(PATTERNS.values())
# What every entity contains: a digit, an @, or a form of address before a blank; first letters are looked at first.
_BY_LETTER = [(letter, "|".join(t[1:] for t in group)) for letter, group in groupby(sorted(_WRITTEN_TITLES), key=lambda t: t[0])]
_HINT = rf"[0-9@]|(?=[{''.join(letter for letter, _ in _BY_LETTER)}])(?:{'|'.join(f'{letter}(?:{rest})' for letter, rest in _BY_LETTER)})\.? "
_KEY_BEGINNING = r"^(github_pat_|sk_live_|sk-|eyJ|.{4})"  # what of a key stays
_STREAM = 128  # hexadecimal digits of a digest


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _kind(match: Column, digits: Column, bare: Column) -> Column:
    """Type of a match of ANY: the first pattern that matches it whole."""
    first = reduce(lambda rest, kind: F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(rest), reversed(PATTERNS), F.lit("name"))
    # A long number is a card, and an IBAN one at all, if its check digits are right; else it is nobody's and stays.
    checked = F.array(_struct(kind=first))
    real = F.transform(checked, lambda f: F.when(f["kind"] == "long", F.when(_checked(digits, digits) == digits, "card").otherwise("none")).when(f["kind"] == "iban", F.when(_iban_rest(bare) == 1, "iban").otherwise("none")).otherwise(f["kind"]))
    return F.element_at(real, 1)


def _canonical(kind: Column, match: Column, digits: Column, bare: Column) -> Column:
    # A national number of the 3-3-4 form is the same as with +1.
    abroad = F.when(match.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.rlike("^[2-9][0-9]{9}$"), F.concat(F.lit("+1"), digits)).when(digits.rlike("^1[0-9]{10}$"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", abroad).when(kind.isin("card", "ssn"), digits).when(kind.isin("none", "key"), match).when(kind == "iban", bare)
        .when(kind == "name", F.lower(F.regexp_extract(match, r"(\S+)$", 1))).otherwise(F.lower(match))
    )


def _given_name(match: Column) -> Column:
    return F.regexp_extract(match, rf"^{_TITLE} ((?:(?:{_WORD}|\p{{Lu}}\.) ){{0,2}}(?:{_WORD}|\p{{Lu}}\.)) {_PARTICLES}{_WORD}$", 1)


def _gender(match: Column) -> Column:
    return F.when(F.regexp_extract(match, rf"^({_TITLE}) ", 1).rlike(_WOMAN), "f").otherwise("m")


def _digest(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """_STREAM hexadecimal digits."""
    said = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(said, 256), F.sha2(F.concat(F.lit("more|"), said), 256))


def _translated(digit: Column, table: Column) -> Column:
    return F.call_function("translate", digit, F.lit(HEX), table)


def _letters_of(c: Column) -> Column:
    """The table of LETTERS for the script of a letter."""
    scripts = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari", "han": "IsHan", "hangul": "IsHangul"}
    others = reduce(lambda rest, s: F.when(c.rlike(rf"\p{{{scripts[s]}}}"), F.lit(LETTERS[s])).otherwise(rest), scripts, F.lit(LETTERS["latin"]))
    return F.when(c.rlike("[A-Za-z]"), F.lit(LETTERS["latin"])).otherwise(others)


def _replaced(kind: Column, match: Column, digest: Column, kept: Column) -> Column:
    """Digits become digits and letters letters of the same case and script (hexadecimal digits for secrets and addresses); everything else stays.

    A character takes the digit of the digest at its own place, or in numbers, which are written in several formats, at its place among the
    digits (in an IBAN among letters and digits); the first `kept` of those stay.
    """

    def one(c: Column, i: Column) -> Column:
        upto = F.substring(match, F.lit(1), i + 1)
        among = F.when(kind.isin("phone", "card", "ssn"), F.length(_digits(upto))).when(kind == "iban", F.length(F.regexp_replace(upto, "[^0-9A-Z]", ""))).otherwise(i + 1)
        return F.struct(c.alias("c"), among.alias("place"), F.substring(digest, F.pmod(among - kept, F.lit(_STREAM)) + 1, F.lit(1)).alias("digit"))

    def new(e: Column) -> Column:
        c, digit = e["c"], e["digit"]
        letter = _translated(digit, _letters_of(c))
        plain = F.when(c.rlike("[0-9]"), F.translate(digit, "abcdef", "135790")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)
        hexadecimal = F.when(c.rlike("[A-F]"), F.upper(digit)).when(c.rlike("[0-9a-f]"), digit).otherwise(c)
        return F.when(e["place"] <= kept, c).when(kind.isin("secret", "ipv6"), hexadecimal).otherwise(plain)

    return F.concat_ws("", F.transform(F.transform(F.split(match, ""), one), new))


def _checked(card: Column, digits: Column) -> Column:
    """The same number with its last digit made the Luhn check digit."""

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1))), weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), ((10 - total % 10) % 10).cast("string"))


def _iban_rest(account: Column) -> Column:
    """Remainder modulo 97 of an IBAN without blanks, its first four characters put last and letters read as 10 to 35; 1 if the check digits are right."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)

    return F.aggregate(F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _account(new: Column) -> Column:
    """An IBAN with right check digits."""
    bare = F.replace(new, F.lit(" "), F.lit(""))
    rest = _iban_rest(F.concat(F.substring(bare, F.lit(1), F.lit(2)), F.lit("00"), F.substring(bare, F.lit(5), F.length(bare))))
    return F.concat(F.substring(new, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(new, F.lit(5), F.length(new)))


def _syllables_of(match: Column) -> Column:
    """Syllable tables and endings of given names for the script of a name."""
    of = lambda s: F.struct(*[F.lit(x).alias(n) for n, x in zip(("first", "vowel", "last", "f", "m"), (*SYLLABLES[s], ENDINGS[s, "f"], ENDINGS[s, "m"]))])
    return F.when(match.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(match.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _made_name(tables: Column, digest: Column, attempt: Column, ending: Column) -> Column:
    def syllable(i: Column) -> Column:
        a, b = F.substring(digest, 2 * i + 1, F.lit(1)), F.substring(digest, 2 * i + 2, F.lit(1))
        return F.concat(_translated(a, tables["first"]), _translated(b, tables["vowel"]), _translated(b, tables["last"]))

    return F.initcap(F.concat(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(NAME_SYLLABLES - 1) + attempt), syllable)), ending))


def surrogates(key: str, described: Column) -> Column:
    """Replacements of an array of structs (kind, canonical, match, attempt, given, given_attempt).

    Each step hands its results on as array elements, so that they are made once: digests and name tables, replaced characters and names, surrogates.
    """

    def begun(e: Column) -> Column:
        kept = F.when(e["kind"] == "phone", F.length(_digits(e["match"])) - F.length(F.regexp_replace(e["canonical"], _CODE, ""))).when(e["kind"] == "card", 1).when(e["kind"] == "iban", 2).when(e["kind"] == "key", F.length(F.regexp_extract(e["match"], _KEY_BEGINNING, 1))).otherwise(0)
        given = F.when(e["given"].isNotNull(), _digest(key, e["given"]["kind"], e["given"]["canonical"], e["given_attempt"]))
        return _struct(e=e, digest=_digest(key, e["kind"], e["canonical"], e["attempt"]), given=given, tables=_syllables_of(e["match"]), kept=kept, body=F.when(e["kind"] == "email", F.substring_index(e["match"], "@", 1)).otherwise(e["match"]))

    def made(d: Column) -> Column:
        e, tables = d["e"], d["tables"]
        gender = F.right(F.coalesce(e["given"]["kind"], e["kind"]), F.lit(1))
        ending = F.when(gender == "f", tables["f"]).otherwise(tables["m"])
        named = e["kind"].startswith("given_") | (e["kind"] == "name")
        last = F.when(named, _made_name(tables, d["digest"], e["attempt"], F.when(e["kind"] == "name", "").otherwise(ending)))
        first = F.when(d["given"].isNotNull(), _made_name(tables, d["given"], e["given_attempt"], ending))
        said = F.regexp_extract(e["match"], r"(\S+)$", 1)
        capitals = (F.upper(said) == said) & (F.length(said) > 2) & (F.lower(said) != said)
        return _struct(e=e, digest=d["digest"], new=F.when(~named & (e["kind"] != "none"), _replaced(e["kind"], d["body"], d["digest"], d["kept"])), first=F.when(capitals, F.upper(first)).otherwise(first), last=F.when(capitals, F.upper(last)).otherwise(last))

    return F.transform(F.transform(F.transform(described, begun), made), _surrogate)


def _surrogate(d: Column) -> Column:
    e, digest, new = d["e"], d["digest"], d["new"]
    kind, match = e["kind"], e["match"]
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.conv(F.substring(digest, 2 * k + 1, F.lit(2)), 16, 10).cast("int") % 254 + 1).cast("string"))
    domain = F.substring_index(match, "@", -1)
    host = F.concat(F.lit("mail"), F.conv(F.substring(digest, F.lit(90), F.lit(8)), 16, 10), F.lit(".example."), F.substring_index(F.lower(domain), ".", -1))
    title = F.regexp_extract(match, rf"^({_TITLE}) ", 1)
    return (
        F.when(kind == "none", match).when(kind == "email", F.concat(new, F.lit("@"), F.when(domain.rlike("[a-z]"), host).otherwise(F.upper(host)))).when(kind == "ip", F.concat_ws(".", octets))
        .when(kind == "iban", _account(new)).when(kind == "card", F.when(_checked(e["canonical"], e["canonical"]) == e["canonical"], _checked(new, _digits(new))).otherwise(new))
        .when(new.isNotNull(), new).otherwise(F.concat_ws(" ", F.when(title != "", title), d["first"], d["last"]))
    )


def entities(text: Column) -> Column:
    """All matches in a text, in order; empty for most texts after a cheap look for what every entity contains."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.concat(F.lit("("), pattern(text), F.lit(")")), F.lit(1))).otherwise(F.array().cast("array<string>"))


def pattern(text: Column) -> Column:
    """ANY, and the surnames that stand in the text after a form of address, as they are written, without one."""
    named = F.when(text.rlike(PATTERNS["name"]), F.regexp_extract_all(text, F.lit(f"({PATTERNS['name']})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    surnames = F.array_distinct(F.transform(named, lambda n: F.regexp_extract(n, r"(\S+)$", 1)))
    return F.when(F.size(surnames) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.concat_ws("|", surnames), F.lit(")" + _EDGE))).otherwise(F.lit(ANY))


def described(matches: Column, attempt=lambda kind, canonical: F.lit(0)) -> Column:  # noqa: ANN001
    """Matches as structs (match, kind, canonical, attempt, given, given_attempt); `given` is the kind and canonical form of a given name."""
    parts = F.transform(matches, lambda m: _struct(match=m, digits=_digits(m), bare=F.replace(m, F.lit(" "), F.lit(""))))
    kinds = F.transform(parts, lambda e: _struct(e=e, kind=_kind(e["match"], e["digits"], e["bare"])))
    firsts = F.transform(kinds, lambda k: _struct(match=k["e"]["match"], kind=k["kind"], canonical=_canonical(k["kind"], k["e"]["match"], k["e"]["digits"], k["e"]["bare"]), first=F.when(k["kind"] == "name", _given_name(k["e"]["match"]))))
    person = lambda e: F.when(e["first"] != "", _struct(kind=F.concat(F.lit("given_"), _gender(e["match"])), canonical=F.lower(e["first"])))
    known = F.transform(firsts, lambda e: _struct(match=e["match"], kind=e["kind"], canonical=e["canonical"], given=person(e)))
    return F.transform(known, lambda e: _struct(match=e["match"], kind=e["kind"], canonical=e["canonical"], attempt=attempt(e["kind"], e["canonical"]), given=e["given"], given_attempt=F.coalesce(attempt(e["given"]["kind"], e["given"]["canonical"]), F.lit(0))))


def clashes(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt) of the corpus entities whose first surrogate is taken; usually none.

    `found` holds the distinct (kind, canonical). In each round, of those that share a surrogate the first keeps it, and one that
    equals an entity of the corpus is given up; the others are derived anew.
    """
    nobody = F.lit(None).cast("struct<kind:string,canonical:string>")
    one = F.array(F.struct(F.col("canonical").alias("match"), F.col("kind"), F.col("canonical"), F.col("attempt"), nobody.alias("given"), F.lit(0).alias("given_attempt")))
    rekeyed = lambda df: df.withColumn("surrogate", F.element_at(F.transform(surrogates(key, one), lambda s: _canonical(F.col("kind"), s, _digits(s), F.replace(s, F.lit(" "), F.lit("")))), 1))
    # Rows are small and their surrogates are work: they are dealt to as many tasks as a shuffle has.
    now = saved(rekeyed(found.repartition(shuffle_width(found.sparkSession), "canonical").withColumn("attempt", F.lit(0))))
    taken = found.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(ROUNDS):
        owner = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("keeps"), F.count(F.lit(1)).alias("k"))
        bad = owner.join(taken, ["kind", "surrogate"], "left").where("k > 1 or real").select("kind", "surrogate", "keeps", F.coalesce("real", F.lit(False)).alias("real"))
        bad = saved(bad)
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "canonical", "attempt")
        marked = now.join(bad, ["kind", "surrogate"], "left")
        again = F.col("keeps").isNotNull() & (F.col("real") | (F.col("keeps") != F.struct("attempt", "canonical")))
        now = saved(rekeyed(marked.select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"))))
    kinds = [r["kind"] for r in bad.select("kind").distinct().collect()]
    raise ValueError(f"after {ROUNDS} rounds entities still share surrogates; there may be too many of {kinds} for their format")


def _with_attempts(rows: DataFrame, found: DataFrame, again: DataFrame) -> DataFrame:
    """Add `_again`, a map from entity to attempt, to the rows (`_holder`, …) whose entities are derived anew."""
    if again.isEmpty():
        return rows.withColumn("_again", F.lit(None).cast("map<string,int>"))
    entry = F.struct(F.concat_ws("|", "kind", "canonical").alias("k"), F.col("attempt").alias("v"))
    per_row = saved(found.join(again, ["kind", "canonical"]).groupBy("_holder").agg(F.map_from_entries(F.collect_set(entry)).alias("_again")))
    size = per_row.agg(F.sum(F.aggregate(F.map_keys("_again"), F.lit(64).cast("long"), lambda a, k: a + F.length(k) + 32))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_row), "_holder", "left")
    marked = perhaps(rows, F.col("_holder"), per_row.select("_holder"))
    here = marked.where("_perhaps").drop("_perhaps").join(per_row.hint("shuffle_merge"), "_holder", "left")
    return here.unionByName(marked.where("not _perhaps").drop("_perhaps").withColumn("_again", F.lit(None).cast("map<string,int>")))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the entities in the text column and add n_entities; other columns stay."""
    holder = row_hash(id_col, text_col)
    mentions = saved(docs.select(holder.alias("_holder"), described(entities(F.col(text_col))).alias("_found")).where(F.size("_found") > 0))
    named = lambda e: F.struct(e["kind"].alias("kind"), e["canonical"].alias("canonical"))
    every = F.concat(F.transform(F.filter("_found", lambda e: e["kind"] != "none"), named), F.transform(F.filter("_found", lambda e: e["given"].isNotNull()), lambda e: named(e["given"])))
    found = mentions.select("_holder", F.explode(every).alias("e")).select("_holder", "e.kind", "e.canonical").distinct()
    again = saved(clashes(found.select("kind", "canonical").distinct(), key))
    known = _with_attempts(beside(docs, _holder=holder, _text=F.col(text_col)), found, again)
    attempt = lambda kind, canonical: F.coalesce(F.element_at(F.col("_again"), F.concat_ws("|", kind, canonical)), F.lit(0))
    text = F.col("_text")
    split = known.withColumn("_found", described(entities(text), attempt)).withColumn("_new", surrogates(key, F.col("_found")))
    pieces = F.split(text, pattern(text), -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, F.col("_new"), lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))))
    n = F.coalesce(F.size(F.filter("_found", lambda e: e["kind"] != "none")), F.lit(0))
    out = rows_with(split, docs.columns, **{text_col: F.when(F.size("_found") > 0, joined).otherwise(text), "n_entities": n})
    return out.select(*docs.columns, "n_entities") if "n_entities" not in docs.columns else out


def pii_query(docs: DataFrame, key: str = "skein-surrogates") -> DataFrame:
    return replace_entities(docs.select("doc_id", "text"), key)
