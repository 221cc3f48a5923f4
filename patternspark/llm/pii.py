"""Personal data replaced by surrogates.

Entities are found by one alternation of expressions. Each distinct entity gets a surrogate drawn from a keyed digest:
digits become digits, letters letters of the same case, punctuation stays; card numbers keep their scheme and pass the
Luhn check, IBANs their country and the check modulo 97, addresses their top-level domain, telephone numbers what
precedes the national number. Equal entities get equal surrogates, also when written in another format (coreference);
surrogates that meet each other or a real entity are drawn again (distinctness).

A name is a title with the words after it, and every word of it is an entity of its own: the last is a family name, those
before it are given names of the title's gender. So `Mr John Smith`, `Mr. Smith` and a bare `Smith` or `John` later in
the same text are told apart and brought together alike. Scripts stay: Latin, Greek and Cyrillic words get words of
theirs. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Titles before a name, by gender.
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Г-н", "г-н", "Mister", "Herrn", "Sr", "Господин", "господин", "Κύριος", "κύριος")
FEMALE = (
    "Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Г-жа", "г-жа", "Fräulein", "Sra", "Srta", "Señorita", "Mme", "Mlle",
    "Mademoiselle", "Госпожа", "госпожа", "Κυρία", "κυρία",
)
EITHER = ("Mx", "Dr", "Prof", "Professor", "Doctor", "Doktor", "Dra", "Д-р", "д-р", "Проф", "проф")
PARTICLES = (
    "von", "van", "vom", "zu", "zum", "zur", "de", "del", "della", "der", "den", "di", "da", "do", "dos", "du", "la", "le",
    "bin", "ibn", "al",
)
_TITLE = rf"(?:{'|'.join(MALE + FEMALE + EITHER)})(?!\p{{L}})\.?"
TITLES = rf"{_TITLE}(?: {_TITLE})*+"
#: A capital with what follows it: inner capitals, hyphens and apostrophes, but no possessive 's; or an initial.
_REST = r"[\p{L}\p{M}]*+(?:['’](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_NAME = rf"(?:\p{{Lu}}\.(?= )|\p{{Lu}}{_REST}(?:-\p{{L}}{_REST})*+)"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
#: A word that may be a name told before, wherever it stands.
BARE = rf"(?<![\p{{L}}\p{{M}}])\p{{Lu}}{_REST}"
#: Card numbers of other lengths or prefixes than 16 digits from 3 to 6; these must pass the Luhn check.
_OTHER_CARDS = "|".join((
    r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}",
    r"3(?:0[0-5]|[689][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4}",
    r"(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[ -]?[0-9]{4}){3}",
    r"4[0-9]{12}",
    r"[3-6][0-9]{16,18}",
    r"(?:50|5[6-9]|6[0-9])[0-9]{10,13}",
))
#: Countries by the length of their IBANs, for those written in groups.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(length: int, countries: str) -> str:
    rest = rf" [A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}{rest}"


_GROUPED = "|".join(_grouped(n, c) for n, c in IBANS.items())
_PHONES = "|".join((
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
))
_SIX = rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?"
EXPRESSIONS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:{_SIX})(?![0-9A-Za-z:.])",
    "phone": _PHONES,
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9A-Za-z])"
    + rf"|(?<![0-9A-Za-z])(?:{_OTHER_CARDS})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
    + rf"|(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}} )(?:{_GROUPED})(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}}){TITLES} {_PARTICLES}{_NAME}(?: {_PARTICLES}(?!{_TITLE} ){_NAME})*+",
}
ALL = "|".join(f"(?:{x})" for x in EXPRESSIONS.values())
#: Syllables of surrogate names, by script: first, middle, endings of male and of female given names and of families.
SYLLABLES = {
    "latin": (
        "Al Be Co Da El Fa Ge Ha Jo Ka Lu Ma No Pe Ro Sa", "ba ce di fo gu la me ni po ra si to vu xa ze lo",
        "ron mas bert vin gor lan nik tor", "lina ria nora sela tina vera mira dana", "dorf mann sen berg lund wick ford ley",
        "dorf mann sen berg lund wick ford ley",
    ),
    "greek": (
        "Αλ Βε Γα Δη Ελ Ζα Ηλ Θα Κα Λα Μα Νο Πα Ρο Σα Τα", "βα γε δι φο γου λα με νι πο ρα σι το κα ξα ζε λο",
        "νος ρος μας λης σης τος κος δης", "νια ρια λινα σια τια κη δα μα", "πουλος ιδης ακης ογλου ατος ιανος ελης ινος",
        "πουλου ιδου ακη ογλου ατου ιανου ελη ινου",
    ),
    "cyrillic": (
        "Ал Бе Во Да Ев Га Ки Ла Ма Но Па Ро Са Та Фе Юл", "ба ве ди го гу ла ме ни по ра си то ву жа зе ло",
        "рон мас берт вин гор лан ник тор", "лина рия нора села тина вера мира дана", "нов рин ский лев шин ков дов тин",
        "нова рина ская лева шина кова дова тина",
    ),
}
#: What every entity but a name has, cheap to look for: only texts with it are searched for entities.
MARK = r"[0-9@]"
MOST_ROUNDS = 24
#: Rounds after which surrogates grow where their kind allows it: e-mail addresses and names.
LONGER_AFTER = 5

#: Parts of a document's list of names.
BUCKETS = 256
_FOUND = "array<struct<at:int,new:string,kind:string>>"


def _kind(value: Column) -> Column:
    dots = F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(value.contains(":"), "ip6")
        .when(value.rlike(r"^\p{L}[^0-9]*$"), "name")
        .when(value.rlike("^[A-Z]{2}"), "iban")
        .when((dots == 3) & value.rlike("^[0-9.]+$"), "ip")
        .when(value.rlike("^[+(]") | value.rlike("^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when((digits == 9) & value.contains("-"), "ssn")
        .otherwise("card")
    )


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def _groups(value: Column) -> tuple[Column, Column]:
    """Groups of an address of eight on both sides of its gap, as numbers without leading zeros."""

    def groups(side: Column) -> Column:
        plain = F.transform(F.split(side, ":"), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))
        return F.filter(plain, lambda g: g != "")

    gap = value.contains("::")
    left = F.when(gap, F.substring_index(value, "::", 1)).otherwise(value)
    return groups(left), groups(F.when(gap, F.substring_index(value, "::", -1)).otherwise(""))


def _norm(kind: Column, value: Column) -> Column:
    """What all spellings of an entity have in common; telephone numbers: the national number where it is known."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    left, right = _groups(value)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    national = F.when(value.rlike(r"^\+1") & (F.length(plain) == 11), F.substring(plain, 2, 10))
    national = national.otherwise(F.when(value.startswith("+"), F.concat(F.lit("+"), plain)).otherwise(plain))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "ip6", _joined(F.concat(left, zeros, right), ":"))
        .when(kind == "phone", national)
        .when(kind == "ip", value)
        .otherwise(plain)
    )


def _chars(value: Column, f) -> Column:
    """Concatenation of f(character, its place from 1)."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value)))
    return _joined(F.transform(places, lambda i: f(F.substr(value, i, F.lit(1)), i)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, byte: Column) -> Column:
    return (
        F.when(c.rlike("[0-9]"), (byte % 10).cast("string"))
        .when(c.rlike("[a-z]"), F.char(F.lit(97) + byte % 26))
        .when(c.rlike("[A-Z]"), F.char(F.lit(65) + byte % 26))
        .otherwise(c)
    )


def _luhn_digit(body: Column) -> Column:
    """The digit that follows all others of a card number."""
    n = F.length(body)

    def worth(i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _iban(country: Column, account: Column) -> Column:
    """Country, check digits and account: the whole, its first four characters last, is 1 modulo 97."""
    moved = F.concat(account, country, F.lit("00"))

    def add(a: Column, i: Column) -> Column:
        c = F.substr(moved, i, F.lit(1))
        letter = F.ascii(c) - 55  # A is 10
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _real(kind: Column, norm: Column) -> Column:
    """Whether a match is an entity: cards of other forms than 16 digits from 3 to 6 need their check digit."""
    body = F.substr(norm, F.lit(1), F.length(norm) - 1)
    return (kind != "card") | norm.rlike("^[3-6][0-9]{15}$") | (_luhn_digit(body) == F.right(norm, F.lit(1)))


def stream_of(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """128 keyed hex digits for an entity and an attempt."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 512)


def _named(norm: Column, stream: Column, attempt: Column) -> Column:
    """A surrogate for a word of a name, `<sort>|<word>`."""
    sort, word = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)

    def made(script: str) -> Column:
        first, middle, *ends = (F.array(*map(F.lit, x.split())) for x in SYLLABLES[script])
        pick = lambda xs, n, i: F.get(xs, _byte(stream, F.lit(i)) % n)
        grown = F.sequence(F.lit(3), F.lit(3) + attempt)
        more = _joined(F.transform(grown, lambda i: F.get(middle, _byte(stream, i) % 16)), "")
        he, she, house, her_house = (pick(x, 8, 40) for x in ends)
        given = F.when(sort == "given-m", he).when(sort == "given-f", she)
        given = given.otherwise(F.when(_byte(stream, F.lit(41)) % 2 == 0, he).otherwise(she))
        family = F.when(word.rlike("(?:[ая]|ου|η)$"), her_house).otherwise(house)
        return F.concat(pick(first, 16, 1), pick(middle, 16, 2), more, F.when(sort == "family", family).otherwise(given))

    script = F.when(word.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(word.rlike(r"\p{IsGreek}"), made("greek"))
    return script.otherwise(made("latin"))


def surrogate(kind: Column, norm: Column, stream: Column, attempt: Column) -> Column:
    """A draw for an entity: of its kind, with what its kind keeps."""
    size = F.length(norm)
    keep_last = F.when(kind == "email", F.length(F.substring_index(norm, ".", -1))).otherwise(0)
    scheme = F.when(norm.rlike("^[3-6][0-9]{15}$"), 1).when(norm.startswith("2"), 4).otherwise(3)
    keep_first = F.when(kind == "card", scheme).when(kind == "iban", 2).when(norm.startswith("+"), 2).otherwise(0)
    # area codes and exchanges of national numbers of ten digits begin with 2 to 9
    leading = (kind == "phone") & (size == 10) & ~norm.startswith("+")

    def draw(c: Column, i: Column) -> Column:
        byte = _byte(stream, i)
        new = F.when(leading & i.isin(1, 4), (2 + byte % 8).cast("string")).otherwise(_letter(c, byte))
        return F.when((i > size - keep_last) | (i <= keep_first), c).otherwise(new)

    free = _chars(norm, draw)
    body = F.substr(free, F.lit(1), F.length(free) - 1)
    octets = _joined(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (1 + _byte(stream, i) % 254).cast("string")), ".")

    def group(g: Column, i: Column) -> Column:
        digits = F.substr(stream, 4 * i + 1, F.length(g))
        head = F.translate(F.substr(digits, F.lit(1), F.lit(1)), "0", "8")
        return F.when(g == "0", g).otherwise(F.concat(head, F.substr(digits, F.lit(2))))

    eight = _joined(F.transform(F.split(norm, ":"), group), ":")
    extra = F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - LONGER_AFTER))
    extra = _joined(F.transform(extra, lambda i: F.char(F.lit(97) + _byte(stream, 64 - i) % 26)), "")
    return (
        F.when(kind == "name", _named(norm, stream, attempt))
        .when(kind == "ip", octets)
        .when(kind == "ip6", eight)
        .when(kind == "card", F.concat(body, _luhn_digit(body)))
        .when(kind == "iban", _iban(F.left(norm, F.lit(2)), F.substr(free, F.lit(5))))
        .when((kind == "email") & (attempt > LONGER_AFTER), F.concat(extra, free))
        .otherwise(free)
    )


def _rendered(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the format of an occurrence."""
    bare = F.regexp_replace(new, "[^0-9A-Za-z]", "")
    # what an occurrence has before the common part, such as a country's dialling code, stays
    extra = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", "")) - F.length(bare)
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9A-Za-z]", "")) - extra
    drawn = lambda c, i: F.when(c.rlike("[0-9A-Za-z]") & (place(i) > 0), F.substr(bare, place(i), F.lit(1))).otherwise(c)
    spaced = _chars(value, drawn)
    upper = lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(new, i, F.lit(1)))).otherwise(F.substr(new, i, F.lit(1)))
    cased = F.concat(_chars(value, upper), F.substr(new, F.length(value) + 1))
    left, right = _groups(value)
    told = F.split(new, ":")
    said = F.split(value, "::", 2)

    def side(text: Column, groups: Column) -> Column:
        """Groups of one side, with the zeros that stand before those of the occurrence."""
        wide = F.filter(F.split(text, ":"), lambda g: g != "")
        return _joined(F.zip_with(wide, groups, lambda w, g: F.when(w.rlike("^0."), F.lpad(g, 4, "0")).otherwise(g)), ":")

    ends = side(F.get(said, 0), F.slice(told, F.lit(1), F.size(left)))
    tails = side(F.coalesce(F.get(said, 1), F.lit("")), F.slice(told, 9 - F.size(right), F.size(right)))
    eight = F.when(value.contains("::"), F.concat(ends, F.lit("::"), tails)).otherwise(ends)
    eight = F.when(value.rlike("[A-F]"), F.upper(eight)).otherwise(eight)
    return F.when(kind == "ip", new).when(kind == "ip6", eight).when(kind == "email", cased).otherwise(spaced)


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, norm, new): a surrogate for every distinct entity; none is used twice, none is a real entity.

    Names meet each other as words, whatever sort they are of. RuntimeError where a format has so few values that
    MOST_ROUNDS draws don't make all surrogates distinct.
    """
    plain = lambda x: F.when(F.col("kind") == "name", F.lower(F.substring_index(x, "|", -1))).otherwise(F.col(x))
    real = entities.select("kind", plain("norm").alias("met")).distinct().withColumn("real", F.lit(True))
    now = entities.withColumn("attempt", F.lit(0))
    # draws cost far more than their bytes tell, so the number of tasks is given
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(MOST_ROUNDS):
        keyed = now.repartition(tasks, "kind", "norm").withColumn(
            "stream", stream_of(F.col("kind"), F.col("norm"), key, F.col("attempt"))
        )
        new = surrogate(F.col("kind"), F.col("norm"), F.col("stream"), F.col("attempt"))
        drawn = keyed.select("kind", "norm", "attempt", new.alias("new")).withColumn("met", plain("new"))
        drawn = scratch.written(drawn, "drawn")
        owner = drawn.groupBy("kind", "met").agg(F.min(F.struct("attempt", "norm")).alias("o"))
        owner = owner.select("kind", "met", F.col("o.norm").alias("owner")).join(real, ["kind", "met"], "left")
        owner = scratch.written(owner, "owners")
        again = (F.col("owner") != F.col("norm")) | F.coalesce("real", F.lit(False))
        checked = scratch.written(drawn.join(owner, ["kind", "met"]).withColumn("again", again), "checked")
        scratch.drop(drawn, owner)
        if checked.where("again").isEmpty():
            return checked.select("kind", "norm", "new")
        now = checked.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError("too many entities for distinct surrogates of their format")


def _listed(pairs: Column) -> Column:
    """map<bucket, map<norm, new>> of an array of (norm, new): a map is searched from its start, so long ones are split."""
    placed = F.transform(
        pairs, lambda x: F.struct(_bucket(x["norm"]).alias("bucket"), x["norm"].alias("norm"), x["new"].alias("new"))
    )

    def grouped(all_: Column) -> Column:
        buckets = F.array_distinct(F.transform(all_, lambda x: x["bucket"]))

        def own(b: Column) -> Column:
            return F.transform(
                F.filter(all_, lambda x: x["bucket"] == b), lambda x: F.struct(x["norm"].alias("norm"), x["new"].alias("new"))
            )

        return F.map_from_entries(F.transform(buckets, lambda b: F.struct(b.alias("bucket"), F.map_from_entries(own(b)).alias("of"))))

    # bound to a name by an array of one, so that buckets are found once
    return F.get(F.transform(F.array(placed), grouped), F.lit(0))


def _bucket(norm: Column) -> Column:
    return F.pmod(F.xxhash64(norm), F.lit(BUCKETS)).cast("int")


def _told(words: Column, norm: Column) -> Column:
    """The surrogate of an entity in _listed(), or null."""
    return F.try_element_at(F.try_element_at(words, _bucket(norm)), norm)


def _word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "’", "'"))


def _titles(value: Column) -> Column:
    return F.regexp_extract(value, f"^{TITLES}", 0)


def _gender(value: Column) -> Column:
    told = F.transform(F.split(_titles(value), " "), lambda t: F.regexp_replace(t, r"\.$", ""))
    male, female = (F.arrays_overlap(told, F.array(*map(F.lit, x))) for x in (MALE, FEMALE))
    return F.when(male, "m").when(female, "f").otherwise("x")


def _each_word(value: Column, f) -> Column:
    """Array by words of a name after its titles, of arrays by their hyphened parts, of f(part, sort); null for particles."""
    words = F.split(F.substr(value, F.length(_titles(value)) + 2), " ")
    gender = _gender(value)

    def parts(w: Column, i: Column) -> Column:
        sort = F.when(i == F.size(words) - 1, F.lit("family")).otherwise(F.concat(F.lit("given-"), gender))
        return F.when(~w.isin(*PARTICLES), F.transform(F.split(w, "-"), lambda p: f(p, sort)))

    return F.transform(words, parts)


def _name_words(value: Column) -> Column:
    """Entities of a name: `<sort>|<word>` for every word but initials."""
    told = _each_word(value, lambda p, sort: F.when(~p.endswith("."), F.concat_ws("|", sort, _word(p))))
    return F.array_compact(F.flatten(F.filter(told, lambda x: x.isNotNull())))


def _like(word: Column, new: Column) -> Column:
    """new, in capitals where the word is."""
    return F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(new)).otherwise(new)


def _initial(word: Column, key: str) -> Column:
    byte = F.conv(F.substring(stream_of(F.lit("initial"), _word(word), key, F.lit(0)), 1, 4), 16, 10).cast("int")
    alphabets = {"Cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЭЮЯ", "Greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
    pick = lambda letters: F.substr(F.lit(letters), 1 + byte % len(letters), F.lit(1))
    out = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for script, letters in alphabets.items():
        out = F.when(word.rlike(rf"\p{{Is{script}}}"), pick(letters)).otherwise(out)
    return F.concat(out, F.lit("."))


def _particle(word: Column, key: str) -> Column:
    """Another particle."""
    byte = F.conv(F.substring(stream_of(F.lit("particle"), word, key, F.lit(0)), 1, 4), 16, 10).cast("int")
    known = F.array(*map(F.lit, PARTICLES))
    return F.get(known, (F.array_position(known, word).cast("int") + byte % (len(PARTICLES) - 1)) % len(PARTICLES))


def _renamed(value: Column, words: Column, key: str) -> Column:
    """A name with its titles and separators, and surrogates by `words`, as _listed() makes them."""

    def new(p: Column, sort: Column) -> Column:
        found = _told(words, F.concat_ws("|", sort, _word(p)))
        return F.when(p.endswith("."), _initial(p, key)).otherwise(F.coalesce(_like(p, found), p))

    given = F.split(F.substr(value, F.length(_titles(value)) + 2), " ")
    told = F.zip_with(
        given, _each_word(value, new), lambda w, x: F.when(x.isNull(), _particle(w, key)).otherwise(_joined(x, "-"))
    )
    return F.concat(_titles(value), F.lit(" "), _joined(told, " "))


def _coreferent(gap: Column, words: Column) -> Column:
    """Text between entities, in which the words of names told in the same document have their surrogates."""
    found = F.regexp_extract_all(gap, F.lit(BARE), F.lit(0))
    between = F.split(gap, BARE, -1)
    sorts = ("family", "given-m", "given-f", "given-x")

    def new(w: Column) -> Column:
        told = F.coalesce(*(_told(words, F.concat(F.lit(f"{s}|"), _word(w))) for s in sorts))
        return F.when(F.length(w) > 1, F.coalesce(_like(w, told), w)).otherwise(w)

    both = F.zip_with(between, F.transform(found, new), lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))
    return F.when(F.size(found) == 0, gap).otherwise(_joined(both, ""))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and _pii_count and _pii_kinds (comma-joined, in order of place).

    key: a secret; who knows it and a guess of an entity can tell whether the guess is right. Every other column and
    every row stays as it is; a null text stays null with count 0, a text without entities stays byte for byte. Repeated
    rows are rewritten alike. Bare names that follow from a titled one in the same text are replaced and not counted.
    Columns named _pii_* in docs are refused, and so is an empty key. RuntimeError: see assign().
    """
    if clash := [c for c in docs.columns if c.startswith("_pii_")]:
        raise ValueError(f"documents already have {clash}")
    if not key:
        raise ValueError("a secret key is needed")
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.col(text_col)
    holds = (text.rlike(MARK) | text.rlike(EXPRESSIONS["name"])) & text.rlike(ALL)
    marked = docs.withColumn("_pii_found", F.when(holds, F.regexp_extract_all(text, F.lit(ALL), F.lit(0))))
    hits = marked.where("_pii_found is not null").withColumn("_pii_gaps", F.split(text, ALL, -1))
    hits = hits.withColumn("_pii_row", F.monotonically_increasing_id()).drop(text_col)
    hits = scratch.written(hits, "hits")  # the row numbers are fixed by writing them
    seen = hits.select("_pii_row", F.posexplode("_pii_found").alias("at", "value")).withColumn("kind", _kind(F.col("value")))
    other = seen.where("kind <> 'name'").withColumn("norm", _norm(F.col("kind"), F.col("value")))
    real = _real(F.col("kind"), F.col("norm"))
    words = seen.where("kind = 'name'").select(
        "_pii_row", "kind", F.explode(_name_words(F.col("value"))).alias("norm")
    ).distinct()
    entities = other.where(real).select("kind", "norm").unionByName(words.select("kind", "norm")).distinct()
    names = assign(scratch.written(entities, "entities"), key, scratch)
    at = F.struct("at", _rendered(F.col("kind"), F.col("value"), F.col("new")).alias("new"), "kind")
    told = other.where(real).join(names, ["kind", "norm"]).select("_pii_row", at.alias("x"))
    # matches that are no entities stay as they are
    kept = F.struct("at", F.col("value").alias("new"), F.lit(None).cast("string").alias("kind"))
    told = told.unionByName(other.where(~real).select("_pii_row", kept.alias("x")))
    told = told.groupBy("_pii_row").agg(F.collect_list("x").alias("_pii_new"))
    # as many words as a document's own names have
    own = words.join(names, ["kind", "norm"]).groupBy("_pii_row").agg(F.collect_list(F.struct("norm", "new")).alias("pairs"))
    own = own.select("_pii_row", _listed(F.col("pairs")).alias("_pii_words"))
    told = scratch.written(told.join(own, "_pii_row", "full"), "told")
    fresh = hits.join(told, "_pii_row", "left")
    named = F.transform(
        "_pii_found",
        lambda v, i: F.struct(i.alias("at"), _renamed(v, F.col("_pii_words"), key).alias("new"), F.lit("name").alias("kind")),
    )
    named = F.when(F.col("_pii_words").isNotNull(), F.filter(named, lambda x: _kind(F.get("_pii_found", x["at"])) == "name"))
    nothing = F.array().cast(_FOUND)
    all_new = F.array_sort(F.concat(F.coalesce("_pii_new", nothing), F.coalesce(named, nothing)))
    fresh = fresh.withColumn("_pii_all", all_new)
    gaps = F.when(F.col("_pii_words").isNull(), F.col("_pii_gaps")).otherwise(
        F.transform("_pii_gaps", lambda g: _coreferent(g, F.col("_pii_words")))
    )
    both = F.zip_with(gaps, "_pii_all", lambda gap, new: F.concat(gap, F.coalesce(new["new"], F.lit(""))))
    kinds = F.array_compact(F.transform("_pii_all", lambda x: x["kind"]))
    fresh = fresh.withColumns({text_col: _joined(both, ""), "_pii_count": F.size(kinds), "_pii_kinds": _joined(kinds, ",")})
    clean = docs.where(~F.coalesce(holds, F.lit(False))).withColumns({"_pii_count": F.lit(0), "_pii_kinds": F.lit("")})
    columns = [*docs.columns, "_pii_count", "_pii_kinds"]
    return fresh.select(*columns).unionByName(clean.select(*columns))
