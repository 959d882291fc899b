"""Keyed, type-consistent surrogates for personal data.

Entities (e-mail and IP addresses, phone, card and account numbers, names after
a title) are found by patterns. A surrogate has the type, script and format of
what it replaces: letters become letters of their script and case (Latin ones
where a script has no alphabet here), digits digits, punctuation stays; card
numbers that pass the Luhn test and account numbers whose check digits hold get
surrogates that do so too; names keep title, hyphens and capitals.

What is drawn are atoms: numbers and IP addresses as a whole, the local part and
the host of an address, the given and the family name of a person. Equal atoms,
however written, have one normal form and one surrogate in all documents, so
"Mrs. Berg" and "Mrs. Jordan Berg" keep one family name and addresses of one
host one host. A phone number's atom is what follows its country code, which
stays. All words after a title belong to the name: the last is the family name,
those before are given names; particles stay, and so does a possessive s. A
family name that stands by itself later in the same text is replaced too. The gender of the title is part of a given name's normal form;
a name under a title without gender takes the one that it has elsewhere, if
that is one only.

Surrogates are drawn from a keyed hash. A draw that equals another atom's draw,
or an atom that really occurs, is drawn again under a higher attempt until none
collides, so distinct entities stay distinct. Attempts above SAME_LENGTH
lengthen hosts, local parts and names, attempts above SAME_FORMAT all others, so
that the draws of some attempt must be free.

Only rows with an entity are staged and shuffled. Everything is built from SQL
functions.

Defined results: a null text stays null and counts no entity; ids are not read,
so rows repeated under one id, null included, are rewritten each by itself; an
empty table gives an empty result; a column named _entities is replaced, other
columns are carried along unread.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

# Titles by gender, given names by script and gender, syllables and endings by script.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"], "n": ["Dr", "Prof"]}
GIVEN = {
    "latin": {"m": ["Adam", "Boris", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo"], "f": ["Alma", "Berta", "Clara", "Diana", "Edith", "Flora", "Greta", "Helen"], "n": ["Alex", "Chris", "Jules", "Kim", "Lou", "Robin", "Sam", "Toni"]},
    "cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб"], "f": ["Анна", "Вера", "Галина", "Дарья"], "n": ["Саша", "Женя", "Валя", "Шура"]},
    "greek": {"m": ["Νίκος", "Γιώργος", "Πέτρος", "Κώστας"], "f": ["Μαρία", "Ελένη", "Άννα", "Σοφία"], "n": ["Αγάπη", "Φώτη", "Χαρά", "Ζωή"]},
}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "tu", "va", "wen", "zor", "lan"], "cyrillic": ["ба", "ве", "ги", "до", "ка", "ле", "ми", "но", "па", "ре", "си", "ту", "ва", "зен", "мор", "лан"], "greek": ["βα", "γε", "δι", "κο", "λα", "με", "νι", "πο", "ρα", "σε", "τι", "φο", "χα", "ζεν", "μορ", "λαν"]}
ENDINGS = {
    "latin": {"m": ["us", "ard", "olf", "or", "ert", "in"], "f": ["ia", "ina", "ana", "ita", "elle", "ette"], "n": ["is", "ey", "en", "el", "yn", "ay"]},
    "cyrillic": {"m": ["слав", "мир", "ий", "он"], "f": ["ина", "ия", "ана", "ея"], "n": ["ша", "ня", "ля", "ко"]},
    "greek": {"m": ["ος", "ης", "ων", "ας"], "f": ["ία", "ούλα", "ίνα", "άνα"], "n": ["ι", "ώ", "ού", "ύ"]},
}

#: Words inside a name that stay as they are.
PARTICLES = ["van", "von", "der", "den", "de", "da", "di", "del", "della", "dos", "du", "la", "le", "ter", "ten", "zu", "zum", "zur", "af", "av", "bin", "ibn", "al", "el", "y"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "(?:" + "|".join(t for names in TITLES.values() for t in names) + r")\.?"
# a capitalised word that is no title, with its inner hyphens and apostrophes but without a possessive s
_WORD = r"(?!(?:" + "|".join(t for names in TITLES.values() for t in names) + r")(?!\p{L}))\p{Lu}(?=[\p{L}'’-])\p{L}*(?:['’](?![sS](?!\p{L}))\p{L}+|-\p{L}+)*(?![\p{L}])"
_INSIDE = "(?:" + "|".join(PARTICLES) + r"|\p{Lu}\.|" + _WORD + ")"
#: Patterns by type; at one place the first that matches wins.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!-?\d)",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:(?<!\d)\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE} (?:\p{{Lu}}\.? ){{0,3}}(?:{_INSIDE} ){{0,4}}{_WORD}",
}
_ALL = "|".join(TYPES.values())
#: A word that may be a family name by itself.
_BARE = rf"(?<![\p{{L}}\p{{N}}'’-]){_WORD}"
_LETTERS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[0-9]": "0123456789",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "天地山水火木金土日月明春秋夏冬花石林江海云雨风雪",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてと",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテト",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초",
    r"[\p{IsArabic}&&\p{L}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"[\p{IsHebrew}&&\p{L}]": "אבגדהוזחטיכלמנסעפצקרשת",
    r"[\p{IsDevanagari}&&\p{L}]": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    r"[\p{IsThai}&&\p{L}]": "กขคงจฉชซดตถทธนบปผพภมยรลวสห",
    r"[\u0660-\u0669]": "٠١٢٣٤٥٦٧٨٩",
    r"[\u06F0-\u06F9]": "۰۱۲۳۴۵۶۷۸۹",
    r"[\u0966-\u096F]": "०१२३४५६७८९",
    r"[\uFF10-\uFF19]": "０１２３４５６７８９",
    r"\p{Ll}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    # letters and digits of all other scripts
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{N}": "0123456789",
}
#: Attempts that keep the length of names and addresses, and attempts that keep the format of all others.
SAME_LENGTH = 3
SAME_FORMAT = 12
#: Tasks in which surrogates are drawn, for each core.
DRAW_TASKS = 2
_SCHEMA = "array<struct<kind:string,original:string,replacement:string>>"
_CUT = "(?<=['’ -])"
_PARTICLE = "^(?:" + "|".join(PARTICLES) + ")$"
#: The country code of a phone number: what stands before the first separator, or before the last ten digits.
_CODE = r"^\+(?:\d{1,3}(?=[ .(-])|\d{1,3}(?=\d{10}$))?"


def _type_of(raw: Column) -> Column:
    """The type whose pattern is the whole of `raw`; look-around holds at the ends of the match."""
    out = F.lit("name")
    for name, pattern in reversed([x for x in TYPES.items() if x[0] != "name"]):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _draws(key: str, *salt: Column) -> Column:
    """Eight integers below 2**32 from the key and the salt, whose parts are told apart by their lengths."""
    inner, outer = (sha256(f"{part}:{key}".encode()).hexdigest() for part in ("inner", "outer"))
    text = [s.cast("string") for s in salt]
    message = F.concat(F.lit(inner), *[x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)])
    digest = F.sha2(F.concat(F.lit(outer), F.sha2(message, 256)), 256)
    return F.transform(F.regexp_extract_all(digest, F.lit("[0-9a-f]{8}"), F.lit(0)), lambda w: F.conv(w, 16, 10).cast("long"))


def _pick(options: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(draw, F.lit(len(options))) + 1).cast("int"))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _masked(key: str, value: Column, *salt: Column) -> Column:
    """Each letter or digit replaced by one of its script, case and kind."""

    def one(c: Column, draw: Column) -> Column:
        out = c
        for pattern, letters in reversed(_LETTERS.items()):
            new = F.substring(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            plain = {"[a-z]": c.between("a", "z"), "[A-Z]": c.between("A", "Z"), "[0-9]": c.between("0", "9")}
            out = F.when(plain.get(pattern, c.rlike(f"^{pattern}$")), new).otherwise(out)
        return out

    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 8).cast("int"))
    draws = F.flatten(F.transform(blocks, lambda i: _draws(key, *salt, F.lit("mask"), i)))
    return F.array_join(F.zip_with(_chars(value), F.slice(draws, F.lit(1), F.size(_chars(value))), one), "")


def _grown(key: str, options: list[str], attempt: int, free: int, *salt: Column) -> Column:
    """What attempts above `free` add: more with each, so that some attempt must be free."""
    return F.concat(F.lit(""), *[_pick(options, _draws(key, *salt, F.lit("more"), F.lit(i))[0]) for i in range(attempt - free)])


def _digit_sum(digits: Column) -> Column:
    """The Luhn sum."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i))


def _mod97(account: Column) -> Column:
    """The remainder by 97 of an account number, its first four characters last and letters counted from 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(turned), F.lit(0), add)


def _name(key: str, norm: Column, attempt: int, salt: tuple, gender: Column | None) -> Column:
    """A name with as many parts, joined by the same signs; a given name has the ending of its gender."""
    out = None
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", ".")):
        grown = lambda i: _grown(key, SYLLABLES[script], attempt, SAME_LENGTH, *salt, i)  # noqa: B023, E731
        syllables = lambda d, n: [_pick(SYLLABLES[script], d[j]) for j in range(n)]  # noqa: B023, E731

        def part(p: Column, i: Column) -> Column:
            d = _draws(key, *salt, F.lit("part"), i)
            sign = F.regexp_extract(p, "(['’ -])$", 1)
            if gender is None:
                return F.concat(*syllables(d, 3 if attempt == 0 else 5), grown(i), sign)  # noqa: B023
            word = F.lit("")
            for g in ENDINGS[script]:  # noqa: B023
                own = F.lower(_pick(GIVEN[script][g], d[0])) if attempt == 0 else F.concat(*syllables(d, 2), grown(i), _pick(ENDINGS[script][g], d[7]))  # noqa: B023
                word = F.when(gender == g, own).otherwise(word)
            letters = next(x for x in _LETTERS.values() if x[0] == {"latin": "a", "cyrillic": "а", "greek": "α"}[script])  # noqa: B023
            initial = F.concat(_pick(list(letters), d[0]), grown(i), F.regexp_extract(p, r"\.", 0))
            word = F.when(F.trim(p).rlike(_PARTICLE), F.trim(p)).when(p.rlike(r"^\p{L}\.?[ -]?$"), initial).otherwise(word)
            return F.concat(word, sign)

        whole = F.array_join(F.transform(F.split(norm, _CUT), part), "")
        out = F.when(norm.rlike(test), whole) if out is None else out.when(norm.rlike(test), whole)
    return out


def surrogate(key: str, kind: Column, norm: Column, gender: Column, attempt: int) -> Column:
    """The surrogate of an atom's normal form under one attempt, in normal form."""
    salt = (kind, norm, gender, F.lit(attempt))
    late = _grown(key, list("0123456789"), attempt, SAME_FORMAT, *salt)
    letters = _grown(key, list(_LETTERS["[a-z]"]), attempt, SAME_LENGTH, *salt)
    local = F.concat(_masked(key, F.substring_index(norm, "@", 1), *salt), letters, F.lit("@"), F.substring_index(norm, "@", -1))
    top = F.substring_index(norm, ".", -1)
    host = F.concat(_masked(key, F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1), *salt), letters, F.lit("."), top)
    d = _draws(key, *salt, F.lit("octets"))
    octets = [(F.pmod(d[i], F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)]
    ip = F.concat(F.concat_ws(".", *octets), F.when(F.length(late) > 0, F.concat(F.lit("."), late)).otherwise(F.lit("")))
    digits = _masked(key, norm, *salt)
    stem = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(10 - F.pmod(_digit_sum(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.when(F.pmod(_digit_sum(norm), F.lit(10)) == 0, F.concat(stem, check.cast("string"))).otherwise(digits)
    body = _masked(key, F.substring(norm, F.lit(5), F.length(norm)), *salt)
    proof = F.lpad((98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    account = F.when(_mod97(norm) == 1, F.concat(F.substring(norm, 1, 2), proof, body)).otherwise(F.concat(F.substring(norm, 1, 2), F.substring(_masked(key, F.substring(norm, 3, 2), *salt, F.lit("check")), 1, 2), body))
    out = F.when(kind == "local", local).when(kind == "host", host).when(kind == "ip", ip).when(kind == "card", F.concat(card, late)).when(kind == "account", F.concat(account, late))
    return out.when(kind == "family", _name(key, norm, attempt, salt, None)).when(kind == "given", _name(key, norm, attempt, salt, gender)).otherwise(F.concat(digits, late))


def distinct_surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, gender, surrogate) for the distinct atoms (kind, norm, gender) of `found`; collisions are drawn again.

    A given name's gender tells atoms apart; other atoms have none ("").
    """
    atom = ["kind", "norm", "gender"]
    spark = found.sparkSession
    tasks = DRAW_TASKS * spark.sparkContext.defaultParallelism
    real = staged(found.select(*atom).distinct(), "pii-atoms")
    names = real.select("kind", F.lower("norm").alias("folded")).distinct()
    settled, open_, attempt = [], real, 0
    while True:
        # few small rows, but dear ones: dealt to a fixed number of tasks
        drawn = open_.repartition(tasks, *atom).select(*atom, surrogate(key, F.col("kind"), F.col("norm"), F.col("gender"), attempt).alias("surrogate"))
        drawn = staged(drawn.withColumn("folded", F.lower("surrogate")), "pii-drawn")
        taken = names
        for part in settled:
            taken = taken.unionByName(part.select("kind", "folded"))
        # of equal draws the least atom keeps it
        first = drawn.groupBy("kind", "folded").agg(F.min(F.struct("norm", "gender")).alias("who")).join(taken, ["kind", "folded"], "left_anti")
        good = first.select("kind", F.col("who.norm").alias("norm"), F.col("who.gender").alias("gender"))
        settled.append(staged(drawn.join(good, atom), "pii-settled"))
        open_ = staged(open_.join(settled[-1], atom, "left_anti"), "pii-open")
        attempt += 1
        if not open_.limit(1).count():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*atom, "surrogate")


def _gender(raw: Column) -> Column:
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(raw.rlike("^(?:" + "|".join(TITLES[g]) + r")\.? "), g).otherwise(out)
    return out


def _parsed(raws: DataFrame) -> DataFrame:
    """raw with kind and its atoms: `one` always, `two` for the host of an address and the given name of a person."""
    raw, kind = F.col("raw"), F.col("kind")
    rows = raws.withColumn("kind", _type_of(raw))
    bare = F.regexp_replace(raw, rf"^{_TITLE} ", "")
    # what stands in front and stays: a title with particles, a country code
    title = F.regexp_extract(raw, rf"^({_TITLE} )", 1)
    first = F.regexp_extract(bare, "^(.*) ", 1)
    idle = F.forall(F.split(F.lower(first), " "), lambda w: w.rlike(_PARTICLE))
    lead = F.when(kind == "name", F.concat(title, F.when(idle, F.concat(first, F.lit(" "))).otherwise(F.lit("")))).when(kind == "phone", F.regexp_extract(raw, _CODE, 0)).otherwise(F.lit(""))
    rows = rows.withColumns({"lead": lead, "family": F.when(kind == "name", F.substring_index(bare, " ", -1)), "given": F.when((kind == "name") & ~idle & (first != ""), first), "gender": F.when(kind == "name", _gender(raw))})
    # the gender that a full name has under other titles
    person = [F.lower("given").alias("_g"), F.lower("family").alias("_f")]
    known = rows.where("given is not null and gender != 'n'").select(*person, "gender").groupBy("_g", "_f").agg(F.min("gender").alias("_least"), F.max("gender").alias("_most"))
    known = known.where("_least = _most").select("_g", "_f", F.col("_least").alias("_known"))
    rows = rows.join(known, (F.lower("given") == F.col("_g")) & (F.lower("family") == F.col("_f")), "left")
    gender = F.when(F.col("gender") == "n", F.coalesce("_known", F.lit("n"))).otherwise(F.col("gender"))
    none = F.lit("")
    atom = lambda k, norm, g=none: F.struct(k.alias("kind"), norm.alias("norm"), g.alias("gender"))
    digits = F.regexp_replace(F.substring(raw, F.length("lead") + 1, F.length(raw)), r"[^0-9]", "")
    norm = F.when(kind.isin("card", "social", "phone"), digits).when(kind == "account", F.regexp_replace(raw, " ", "")).otherwise(raw)
    one = F.when(kind == "name", atom(F.lit("family"), F.lower("family"))).when(kind == "email", atom(F.lit("local"), F.lower(raw))).otherwise(atom(kind, norm))
    two = F.when(F.col("given").isNotNull(), atom(F.lit("given"), F.lower("given"), gender)).when(kind == "email", atom(F.lit("host"), F.lower(F.substring_index(raw, "@", -1))))
    return rows.select("raw", "kind", "lead", "given", "family", one.alias("one"), two.alias("two"))


def _styled(new: Column, raw: Column) -> Column:
    """A lower-case name with the capitals of what it replaces, part by part."""
    capital = F.array_join(F.zip_with(F.split(new, _CUT), F.split(raw, _CUT), lambda p, r: F.when(F.lower(r) == r, p).otherwise(F.initcap(p))), "")
    return F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(new)).otherwise(capital)


def _rendered(one: Column, two: Column) -> Column:
    """The surrogates of an entity's atoms in the format of the occurrence (raw, kind, lead, given, family)."""
    raw, kind = F.col("raw"), F.col("kind")
    body = F.substring(raw, F.length("lead") + 1, F.length(raw))
    digit = F.when(kind == "account", F.lit("^[A-Za-z0-9]$")).otherwise(F.lit("^[0-9]$"))

    def put(acc: Column, c: Column) -> Column:
        hit = F.regexp_like(c, digit)
        return F.struct((acc["n"] + F.when(hit, 1).otherwise(0)).alias("n"), F.concat(acc["out"], F.when(hit, F.substring(one, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    laid = F.aggregate(_chars(body), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), put)
    spread = F.concat("lead", laid["out"], F.substring(one, laid["n"] + 1, F.length(one)))
    name = F.concat("lead", F.coalesce(F.concat(_styled(two, F.col("given")), F.lit(" ")), F.lit("")), _styled(one, F.col("family")))
    mail = F.concat(F.substring_index(one, "@", 1), F.lit("@"), two)
    same = F.array_join(F.zip_with(_chars(mail), _chars(raw), lambda m, r: F.when(F.lower(r) != r, F.upper(m)).otherwise(m)), "")
    shouted = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(mail)).otherwise(mail)
    email = F.when(F.length(mail) == F.length(raw), same).otherwise(shouted)
    return F.when(kind == "email", email).when(kind == "ip", one).when(kind == "name", name).otherwise(spread)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with the text rewritten, and _entities: an array of (kind, original, replacement) in order.

    The key decides all surrogates; the same key gives the same ones where the
    same entities occur.
    """
    docs = docs.drop("_entities")
    text, has = F.col(text_col), text_of(text_col).rlike(_ALL)
    plain = docs.where(~has).withColumn("_entities", F.array().cast(_SCHEMA))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = staged(docs.where(has).select(F.monotonically_increasing_id().alias("rid"), row, text.alias("text"), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0)).alias("hits")), "pii-rows")

    raws = staged(_parsed(rows.select(F.explode(F.array_distinct("hits")).alias("raw")).distinct()), "pii-raws")
    atoms = raws.select(F.explode(F.array_compact(F.array("one", "two"))).alias("a")).select("a.*")
    made = distinct_surrogates(atoms, key)
    side = lambda n: made.select(F.struct("kind", "norm", "gender").alias(n), F.col("surrogate").alias(f"new_{n}"))
    family = F.when(F.col("kind") == "name", F.struct(F.lower("family").alias("word"), F.col("new_one").alias("new")))
    news = raws.join(side("one"), "one").join(side("two"), "two", "left").select("raw", F.struct("kind", _rendered(F.col("new_one"), F.col("new_two")).alias("new")).alias("new"), family.alias("family"))
    news = staged(news, "pii-new")

    # a row's maps hold what occurs in its own text: its entities, and its family names with the place of the first
    own = rows.select("rid", F.explode(F.array_distinct("hits")).alias("raw")).join(news, "raw").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("new"))
    names = rows.select("rid", F.posexplode("hits").alias("at", "raw")).join(news.where("family is not null").select("raw", "family"), "raw")
    names = names.groupBy("rid", F.col("family.word").alias("word")).agg(F.min(F.struct("at", "family.new")).alias("first")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("word", "first"))).alias("names"))
    done = rows.join(own, "rid").join(names, "rid", "left").withColumn("put", F.transform("hits", lambda r: F.struct(F.element_at(F.col("new"), r)["kind"].alias("kind"), r.alias("original"), F.element_at(F.col("new"), r)["new"].alias("replacement"))))
    done = done.withColumn("gaps", F.split("text", _ALL, -1))

    def bare(gap: Column, at: Column) -> Column:
        """A gap's capitalised words, with the surrogate of those that a name before has as family name."""
        known = lambda w: F.try_element_at(F.col("names"), F.lower(w))
        return F.transform(F.regexp_extract_all(gap, F.lit(_BARE), F.lit(0)), lambda w: F.struct(F.lit("name").alias("kind"), w.alias("original"), F.when(known(w)["at"] < at, _styled(known(w)["new"], w)).alias("replacement")))

    found = F.when(F.col("names").isNotNull(), F.transform("gaps", bare)).otherwise(F.transform("gaps", lambda g: F.array().cast(_SCHEMA)))
    done = done.withColumn("bare", found)
    # where nothing is found in a gap it stays whole
    some = lambda b: F.exists(b, lambda w: w["replacement"].isNotNull())
    patched = F.zip_with("gaps", "bare", lambda g, b: F.when(some(b), F.array_join(F.zip_with(F.split(g, _BARE, -1), b, lambda x, w: F.concat(x, F.coalesce(w["replacement"], w["original"], F.lit("")))), "")).otherwise(g))
    done = done.withColumn("gaps", patched)
    mixed = F.zip_with("gaps", "put", lambda g, p: F.concat(g, F.coalesce(p["replacement"], F.lit(""))))
    # entities in order: those of a gap, then the one behind it
    listed = F.flatten(F.zip_with("bare", "put", lambda b, p: F.concat(F.filter(b, lambda w: w["replacement"].isNotNull()), F.when(p.isNotNull(), F.array(p)).otherwise(F.array().cast(_SCHEMA)))))
    cols = [F.array_join(mixed, "").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return plain.unionByName(done.select(*cols, listed.cast(_SCHEMA).alias("_entities")))
