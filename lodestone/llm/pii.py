"""Surrogate generation for personal data, in SQL functions only.

Entities are found by one pattern; of card numbers only those whose checksum is right, and
where a text names somebody in full, the family name by itself is found in it too. Each
distinct entity of the corpus gets a surrogate from a keyed hash: letters stay letters of
their case and script, digits stay digits, separators stay, card numbers keep their
checksum's validity, names keep their gender. The same entity has the same surrogate wherever
it stands and however it is written (case, separators, country code), and surrogates are
checked: two entities of a type never share one, and none is an entity of the corpus. What
collides is hashed again, and gets longer after some attempts, so that there is always room.

Texts stay in their rows until all surrogates are known; only entities are shuffled before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.llm.common import apart, dropped, written
from lodestone.llm.names import GIVEN_F, GIVEN_M, TITLES, TITLES_F, TITLES_M

# Syllables of surrogate names by script.
LATIN = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "za", "ze"]
GREEK = ["βα", "βε", "βι", "γα", "γε", "γο", "δα", "δε", "δο", "θα", "θε", "θο", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "πα", "πε", "πο", "ρα", "ρε", "ρο", "τα", "το"]
CYRILLIC = ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то"]

# Letters by class, from which those of the class are replaced.
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsLatin}&&\p{Ll}]": "abcdefghijklmnopqrstuvwxyz",
    r"[\p{IsLatin}&&\p{Lu}]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшщыьэюя",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЬЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρτυφχψω",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΤΥΦΧΨΩ",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsHan}": "一丁七万三上下不世中主久之九也二五人今他代以位作八六",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{N}": "0123456789",
}
#: Attempts after which a surrogate is a character longer, and those after which the work is given up with an error.
WIDER, MOST = 4, 60

_CAP = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _any(words: list[str]) -> str:
    """A pattern of any of the words, longest first: a tree by character, so that long lists cost no more than short ones."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        branches = [c + pattern(at[c]) for c in sorted(at) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in at else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in at else body

    return pattern(tree)


_TITLES = _any([*TITLES, *TITLES_M, *TITLES_F])
_GIVEN = rf"{_any([*GIVEN_M, *GIVEN_F])}(?:-\p{{Lu}}\p{{L}}+)?"
#: calling codes of E.164: of one, two and three digits
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: national forms: North America; pairs (France); Spain; an area code with its 0 (Germany, United Kingdom)
_NATIONAL = "|".join([
    r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4}|[0-9]{8})",
    r"[6-9][0-9]{2}(?:(?: [0-9]{3}){2}|(?:-[0-9]{3}){2}|(?: [0-9]{2}){3}|(?:-[0-9]{2}){3})",
    r"(?=(?:[ ()/-]{0,3}[0-9]){8,13}(?![0-9]))(?:\(0[1-9][0-9]{1,4}\)|0[1-9][0-9]{1,4})(?: ?[/-] ?| )[0-9]{2,8}(?:[ -][0-9]{2,5}){0,3}",
])
#: type and pattern, in the order in which they are tried at a place; none has a capturing group
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,}",
    "secret": r"(?:(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}[\"'])(?=[^\s\"'\p{L}\p{N}]*[\p{L}\p{N}])[^\s\"']{6,}|(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}))",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.[0-9])",
    "card": r"(?<![0-9])(?=[2-6])(?:(?:[0-9]{4}[ -]?){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"(?:(?<![\w.])(?:(?=\+(?:[ .()/-]{{0,3}}[0-9]){{8,15}}(?![0-9]))\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{1,4}}\)?|[/-][0-9]{{1,4}}){{2,7}}|\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{2,4}}\)?){{2,4}}|00{_CODE}[ .-](?=(?:[ .()-]{{0,3}}[0-9]){{7,13}}(?![0-9]))\(?[0-9]{{1,4}}\)?(?:[ .-]?[0-9]{{1,4}}){{1,6}}|{_NATIONAL}))(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLES}\.? ){{1,3}}{_CAP}(?: {_CAP}){{0,2}}|{_GIVEN} {_CAP})",
}
#: What every entity holds, quick to look for: texts without any of it aren't searched for entities.
GATE = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|[=:]\s{{0,3}}[\"']|[0-9A-Fa-f]{{32}}|AKIA|gh[pousr]_|sk-|0[1-9][ -][0-9]{{2}}|(?<!\p{{L}})(?:{_TITLES}\.?|{_GIVEN}) \p{{Lu}}"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_LEADING = rf"^(?:{_TITLES}\.? )+"
#: What isn't replaced has no type and no entity.
_PIECES = "array<struct<lead:string,kind:string,raw:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _kind(entity: Column) -> Column:
    # what follows a word such as "password" has no shape of its own and is what no other type matches
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind != "secret":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _name_pieces(lead: Column, entity: Column) -> Column:
    """A name's words: titles go to the next word's lead; given names have the gender of the titles, else their own."""
    titles = F.regexp_extract(entity, _LEADING, 0)
    own = F.split(F.substring(entity, F.length(titles) + 1, F.length(entity)), " ")
    known = F.regexp_extract(F.get(own, F.lit(0)), r"^[^-]+", 0)
    female = titles.rlike(rf"(?<!\p{{L}}){_any(TITLES_F)}\.? ") | (~titles.rlike(rf"(?<!\p{{L}}){_any(TITLES_M)}\.? ") & known.isin(*GIVEN_F) & ~known.isin(*GIVEN_M))
    before = F.concat(lead, titles)
    given = F.when(female, F.lit("given_f")).otherwise(F.lit("given_m"))
    return F.transform(
        own,
        lambda w, j: F.struct(
            F.when(j == 0, before).otherwise(F.lit(" ")).alias("lead"),
            # of one word after a title it is the family name
            F.when((j < F.size(own) - 1), given).otherwise(F.lit("family")).alias("kind"),
            w.alias("raw"),
        ),
    )


def _plain(lead: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(lead.alias("lead"), none.alias("kind"), none.alias("raw"))).cast(_PIECES)


def pieces(text: Column, family: Column | None = None) -> Column:
    """The text as pieces: what stands before an entity, its type and the entity; a last one has no type.

    ``family`` is an array of family names that are entities by themselves.
    """
    pattern = F.lit(PATTERN) if family is None else F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(family, "|"), F.lit(r")(?!\p{L})"))

    def cut(entities: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                gap = F.get(gaps, i)

                def typed(k: Column) -> Column:
                    whole = F.array(F.struct(gap.alias("lead"), k.alias("kind"), e.alias("raw")))
                    wrong = (k == "card") & (_luhn(_digits(e)) % 10 != 0)
                    return F.when(wrong, _plain(F.concat(gap, e))).when(k == "name", _name_pieces(gap, e)).otherwise(whole).cast(_PIECES)

                kind = _kind(e) if family is None else F.when(F.array_contains(family, e), F.lit("family")).otherwise(_kind(e))
                return let(kind, typed)

            return F.concat(F.flatten(F.transform(entities, one)), _plain(F.get(gaps, F.size(entities))))

        return let(F.split(text, pattern, -1), with_gaps)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), cut)


def normal(kind: Column, raw: Column) -> Column:
    """What makes two mentions the same entity."""
    digits = _digits(raw)
    return (
        # without the country's code and the 0 that stands for it
        F.when(kind == "phone", F.regexp_replace(_digits(F.regexp_replace(raw, rf"^(?:\+|00(?={_CODE}[ .-])){_CODE}", "")), "^0", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.isin("email", "given_m", "given_f", "family"), F.lower(raw))
        .otherwise(raw)
    )


def _luhn(digits: Column) -> Column:
    """The sum of a digit string's Luhn digits."""
    n = F.length(digits)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """A type-consistent replacement for a normal form from a keyed hash; every ``WIDER`` attempts it is a character longer."""
    more = F.floor(attempt / WIDER).cast("int")
    # a hash gives 32 values; as an array, so that a long secret's are found at once
    blocks = F.sequence(F.lit(0), F.floor((F.length(norm) + more) / 32).cast("int"))
    seed = F.sha2(F.concat_ws("\0", F.lit(key), kind, attempt.cast("string"), norm), 256)
    stream = let(seed, lambda x: F.transform(blocks, lambda i: F.sha2(F.concat(x, i.cast("string")), 256)))

    def byte(s: Column, i: Column | int) -> Column:
        at = F.lit(i) if isinstance(i, int) else i
        return F.conv(F.substring(F.get(s, F.shiftright(at, 5)), 2 * F.pmod(at, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")

    def letter(alphabet: str, b: Column) -> Column:
        return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))

    def by_character(s: Column) -> Column:
        # further characters stand before the others
        wide = F.concat(F.when(kind.isin("phone", "card", "ssn"), F.repeat(F.lit("1"), more)).when(kind == "iban", F.lit("")).otherwise(F.repeat(F.lit("a"), more)), norm, F.when(kind == "iban", F.repeat(F.lit("1"), more)).otherwise(F.lit("")))
        chars = F.filter(F.split(wide, ""), lambda c: c != "")
        facts = F.struct(
            F.when(kind == "email", F.length(wide) - F.length(F.substring_index(wide, ".", -1))).otherwise(F.length(wide)).alias("top"),
            norm.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$").alias("hex"),
        )

        def replaced(f: Column) -> Column:
            def other(c: Column, i: Column) -> Column:
                b = byte(s, i)
                out = F.when((i >= f["top"]) | ((kind == "iban") & (i < 2)), c).when((i == 0) & F.regexp_like(c, F.lit("^[1-9]$")), letter("123456789", b))
                for pattern, alphabet in ALPHABETS.items():
                    new = letter(alphabet, b)
                    if pattern in ("[a-z]", "[A-Z]"):
                        new = F.when(f["hex"], letter(alphabet[:6], b)).otherwise(new)
                    out = out.when(F.regexp_like(c, F.lit(f"^{pattern}$")), new)
                return out.otherwise(c)

            return F.array_join(F.transform(chars, other), "")

        made = let(facts, replaced)

        def checked(m: Column) -> Column:
            # the last digit makes the checksum valid
            body = F.substring(m, F.lit(1), F.length(m) - 1)
            return F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

        return F.when(kind == "card", let(made, checked)).otherwise(made)

    def made(s: Column) -> Column:
        ip = F.concat_ws(".", (byte(s, 0) % 223 + 1).cast("string"), *[byte(s, i).cast("string") for i in (1, 2)], (byte(s, 3) % 254 + 1).cast("string"))
        cyrillic, greek = norm.rlike(r"\p{IsCyrillic}"), norm.rlike(r"\p{IsGreek}")

        def syllables(n: int) -> Column:
            def pick(names: list[str]) -> Column:
                held = F.array(*[F.lit(x) for x in names])
                return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1) + more), lambda i: F.get(held, byte(s, i) % len(names))), "")

            return F.when(cyrillic, pick(CYRILLIC)).when(greek, pick(GREEK)).otherwise(pick(LATIN))

        def ending(female: Column, endings: list[tuple[str, str]]) -> Column:
            of = lambda pair: F.when(female, F.lit(pair[1])).otherwise(F.lit(pair[0]))
            return F.when(cyrillic, of(endings[0])).when(greek, of(endings[1])).otherwise(of(endings[2]))

        family = F.concat(syllables(4), ending(norm.rlike("(?:ва|на|ая|ου)$"), [("в", "ва"), ("ς", "υ"), ("n", "n")]))
        given = F.concat(syllables(3), ending(kind == "given_f", [("н", "на"), ("ς", "να"), ("n", "na")]))
        return F.when(kind == "ip", ip).when(kind == "family", family).when(kind.isin("given_m", "given_f"), given).otherwise(by_character(s))

    return let(stream, made)


def poured(kind: Column, raw: Column, sur: Column) -> Column:
    """The surrogate in the format of the mention: its case, separators and country code."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    name = F.when(upper, F.upper(sur)).otherwise(F.concat(F.upper(F.substring(sur, 1, 1)), F.substring(sur, F.lit(2), F.length(sur))))
    # letters and digits of the mention are replaced from the right end; what is left over stays, and what the surrogate has over comes first
    unit = F.when(kind.isin("phone", "card", "ssn"), F.lit("^[0-9]$")).otherwise(F.lit("^[^ ]$"))
    spare = F.length(sur) - F.size(F.filter(chars, lambda c: F.regexp_like(c, unit)))
    start = F.struct(spare.alias("k"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.regexp_like(c, unit)
        first = hit & (acc["k"] == spare) & (spare > 0)
        new = F.when(first, F.substring(sur, F.lit(1), spare + 1)).otherwise(F.substring(sur, acc["k"] + 1, F.lit(1)))
        cased = F.when((c != F.lower(c)), F.upper(new)).otherwise(new)
        return F.struct((acc["k"] + hit.cast("int")).alias("k"), F.concat(acc["out"], F.when(hit & (acc["k"] >= 0), cased).otherwise(c)).alias("out"))

    shaped = F.aggregate(chars, start, step, lambda acc: acc["out"])
    # a secret is its own normal form
    return F.when(kind.isin("ip", "secret"), sur).when(kind.isin("family", "given_m", "given_f"), name).otherwise(shaped)


def surrogates(entities: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """``kind, norm, sur`` for distinct entities: injective within a type, and no surrogate is an entity.

    An error is raised if ``most`` attempts aren't enough.
    """
    found = written(entities.select("kind", "norm").distinct(), "entities")
    table = written(found.withColumn("attempt", F.lit(0)).withColumn("sur", surrogate(F.col("kind"), F.col("norm"), F.lit(0), key)), "surrogates")
    for _ in range(most):
        real = found.select("kind", F.col("norm").alias("sur")).withColumn("real", F.lit(True))
        first = table.groupBy("kind", "sur").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        lost = table.join(first, ["kind", "sur"], "left").join(real, ["kind", "sur"], "left").withColumn("lost", F.coalesce(F.col("first") != F.col("norm"), F.lit(False)) | F.col("real").isNotNull())
        if lost.where("lost").isEmpty():
            dropped(found)
            return table.select("kind", "norm", "sur")
        again = F.when(F.col("lost"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        after = lost.select("kind", "norm", again.alias("attempt"), "sur", "lost")
        after = written(after.withColumn("sur", F.when(F.col("lost"), surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)).otherwise(F.col("sur"))).drop("lost"), "surrogates")
        dropped(table)
        table = after
    raise RuntimeError(f"entities still collide after {most} attempts")


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their columns, entities in the text replaced; ``n_entities`` (bigint) is added.

    Null and empty texts come back unchanged with 0. Rows may repeat and ids may be null:
    each row is worked on by itself. Equal rows get equal texts. Texts may be of any length; no
    rows give no rows. ``key`` keys the hash: who lacks it can't tell a surrogate's entity by
    hashing candidates. Secrets of symbols only (masked ones) aren't entities.
    """
    docs, back = apart(docs.drop("n_entities"), text_col)
    found = F.coalesce(F.col(text_col).rlike(GATE) & F.col(text_col).rlike(PATTERN), F.lit(False))
    clean = docs.where(~found).withColumn("n_entities", F.lit(0).cast("long"))
    held = docs.where(found).withColumn("__x", pieces(F.col(text_col)))
    # who is named in full is looked for by family name as well
    names = F.array_distinct(F.transform(F.filter("__x", lambda x: (x["kind"] == "family") & (F.length(x["raw"]) > 2)), lambda x: x["raw"]))
    held = held.withColumn("__f", names).withColumn("__x", F.when(F.size("__f") > 0, pieces(F.col(text_col), F.col("__f"))).otherwise(F.col("__x")))
    # the row key is fixed once the table is written
    held = written(held.drop("__f", text_col).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    parts = held.select("__row", F.posexplode(F.transform("__x", lambda x: F.struct(x["kind"].alias("kind"), x["raw"].alias("raw")))).alias("pos", "x")).select("__row", "pos", "x.*")
    own = parts.where("kind is not null").withColumn("norm", normal(F.col("kind"), F.col("raw")))
    table = surrogates(own, key)
    set_ = own.join(table, ["kind", "norm"]).select("__row", "pos", poured(F.col("kind"), F.col("raw"), F.col("sur")).alias("s"))
    every = set_.unionByName(parts.where("kind is null").select("__row", "pos", F.lit("").alias("s")))
    lists = every.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("__s"))
    text = F.array_join(F.zip_with("__x", "__s", lambda x, s: F.concat(x["lead"], s)), "")
    changed = held.join(lists, "__row").withColumn(text_col, text).withColumn("n_entities", F.size(F.filter("__x", lambda x: x["kind"].isNotNull())).cast("long"))
    return back(clean.unionByName(changed.select(*clean.columns)))
