"""Surrogates for personal data: each entity found gets a keyed replacement of its own type, gender, script and
format, the same wherever the entity stands and another for every other entity. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, keyed, materialize

KEY = "corpus"
#: From this attempt on a surrogate other than a name is longer than its entity, so that any number of entities gets
#: distinct ones. Names grow by a syllable every other attempt.
WIDEN = 24
_both = lambda titles: f"{titles}|{titles.upper()}"
_TITLE_M, _TITLE_F = _both("Mr|Herr|Monsieur|Señor|Sr|г-н|господин"), _both("Mrs|Ms|Miss|Frau|Madame|Señora|Sra|г-жа|госпожа")
#: Titles that tell no gender.
_TITLE_N = _both("Dr|Prof|Professor|Doktor|Docteur|Doctor|Доктор|Профессор")
_FIRST = lambda titles: "".join(sorted({t[0] for t in titles.split("|")}))
#: Words in capitals that begin a sentence after a name and are no part of it.
_NO_NAME = (
    "The|This|That|These|Those|There|Then|He|She|It|They|We|You|His|Her|In|On|At|To|Of|For|From|And|But|Or|If|As|By|With|When|Who|Is|Was|Has|An|"
    "Der|Die|Das|Ein|Eine|Er|Sie|Es|Wir|Und|Aber|Im|Am|Ist|Hat|Le|La|Les|Un|Une|Il|Elle|Ils|Et|Mais|Dans|Est|El|Los|Las|Una|Ella|Pero|En|Que|Released|Licensed|Он|Она|Они|Это|Но|На|Не"
)
#: A name: letters with inner capitals, and parts after a hyphen or an apostrophe that begin with one.
_NAME = r"\p{Lu}(?=['’-]?\p{L})[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
_PERSON = lambda titles: rf"(?=[{_FIRST(titles)}])(?<![\p{{L}}])(?:{titles})\.?\s{{1,3}}{_NAME}(?: (?!(?:{_NO_NAME})(?![\p{{L}}])){_NAME})?"
#: What a text with an entity contains, but for digits and @: cheap to look for before the patterns are tried.
SIGNS = [*f"{_TITLE_M}|{_TITLE_F}".split("|"), *(f"{t}{x}" for t in _TITLE_N.split("|") for x in (".", " ")), "password=", "passwd=", "secret=", "api_key="]
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FO|FI|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: Patterns by type, in the order in which they are tried at a place. What has no bound is possessive.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}+",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<![\d.-])\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "access": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    # by the country's length; of other countries groups of four, or any length without blanks
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?![A-Za-z0-9])|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9]))",
    "man": _PERSON(_TITLE_M),
    "woman": _PERSON(_TITLE_F),
    "person": _PERSON(_TITLE_N),
    "secret": r"(?<==)(?<=password=|passwd=|secret=|api_key=)[^\s\"',;]{6,}+",
    # last, as these fit what the types above do: 8 to 15 digits after a plus sign
    "abroad": r"(?<![\w+])\+(?=\d(?:[ .()/-]{0,2}\d){7,14}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,5}\)|[ ./-]?\d){5,14}(?!\d)",
    "number": r"(?<![\d.])(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)",
}
#: A card of another length or grouping than four by four; counts if its check digit is right.
LUHN = "number"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NAMES = {
    ("man", True): "Adam Bruno Colin David Erik Felix Gavin Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(),
    ("woman", True): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Petra".split(),
    ("person", True): "Alex Robin Kim Noel Chris Toni Dominique Sascha Jules Morgan Andrea Camille Luca Quinn Rene Sidney".split(),
    ("person", False): "Саша Женя Валя Слава Шура Вася Паша Витя Лёня Гена Стася Тоша Мика Рада Лада Юля".split(),
    ("man", False): "Антон Борис Виктор Григорий Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
    ("woman", False): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Кира Лариса Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {True: "bar den fel gor hal jen kor lin mar nel por ran sel tor ven wil".split(), False: "бар вен гор дан жел зор кал лен мар нор пел ров сан тел фор чен".split()}


#: Types whose digits and letters make the entity, whatever stands between them: 1234-5678 is 1234 5678.
LOOSE = ("card", "number", "phone", "abroad", "iban", "ssn")
#: Types of the parts of names: family or first name by gender, each by script.
PEOPLE = ("man", "woman", "person")
CYRILLIC = r"\p{IsCyrillic}"
_SCRIPT = {True: "", False: "_cyrillic"}


def _noise(*parts: Column) -> Column:
    """256 hex digits of a keyed hash."""
    text = F.concat_ws("\u0001", *parts)
    return F.concat(F.sha2(text, 512), F.sha2(F.concat(text, F.lit("+")), 512))


def _number(noise: Column, i: Column, below: int) -> Column:
    """The i-th number of the noise, under below."""
    return F.pmod(F.conv(F.substring(noise, F.pmod(i, F.lit(63)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _pick(options: list[str], n: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in options)), n)


def _shape(text: Column, noise: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Digits, small and capital letters each replaced by their own kind, Cyrillic by Cyrillic, other letters by Latin ones; all else stays."""
    small, capital, cyrillic = F.lit(letters), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("абвгдежзиклмнопрстуфхцчшщэюя")

    def one(c: Column, i: Column) -> Column:
        at = lambda chars, n: F.substring(chars, _number(noise, i, n) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), at(F.lit("0123456789"), 10)).when(c.rlike("[a-z]"), at(small, len(letters))).when(c.rlike("[A-Z]"), at(capital, 26)).when(c.rlike(CYRILLIC), at(cyrillic, 29)).when(c.rlike(r"\p{Lu}"), at(capital, 26)).when(c.rlike(r"\p{L}"), at(small, len(letters))).when(c.rlike(r"\p{M}"), F.lit("")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _checked(number: Column) -> Column:
    """A card number with its last digit made the check digit; other characters stay."""
    digits = F.regexp_replace(number, r"\D", "")
    # from the right, the check digit aside: every other digit counts twice
    value = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    body = F.transform(F.reverse(F.split(F.regexp_replace(digits, r"\d$", ""), "")), lambda d, i: value(d.cast("int"), i))
    check = F.pmod(10 - F.pmod(F.aggregate(body, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))
    return F.concat(F.regexp_replace(number, r"\d$", ""), check.cast("string"))


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the whole entity fits."""
    tests = [(k, entity.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items() if k != "secret"]
    return reduce(lambda rest, t: F.when(t[1], F.lit(t[0])).otherwise(rest), reversed(tests), F.lit("secret"))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of an entity at an attempt: attempts differ, all else stays the same for a key."""
    salt = attempt.cast("string")
    noise = _noise(F.lit(key), kind, entity, salt)
    n = lambda i, below: _number(noise, F.lit(i), below)
    at = F.instr(entity, "@")
    email = F.concat(_shape(F.substring(entity, F.lit(1), at - 1), noise), F.lit("@"), _shape(F.regexp_replace(F.substring(entity, at + 1, F.length(entity)), r"\.\p{L}+$", ""), F.reverse(noise)), F.regexp_extract(entity, r"\.\p{L}+$", 0))
    code = F.regexp_extract(entity, r"^\+\d", 0)
    phone = F.concat(code, _shape(F.substring(entity, F.length(code) + 1, F.length(entity)), noise))
    card = _checked(F.concat(F.substring(entity, 1, 1), _shape(F.substring(entity, F.lit(2), F.length(entity)), noise)))
    ip = F.concat_ws(".", *((n(i, 254) + 1).cast("string") for i in range(4)))
    access = F.concat(F.lit("AKIA"), _shape(F.substring(entity, F.lit(5), F.length(entity)), noise))
    iban = F.concat(F.substring(entity, 1, 2), _shape(F.substring(entity, F.lit(3), F.length(entity)), noise))
    def syllables(latin: bool, count: Column) -> Column:
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[latin], _number(noise, i, len(SYLLABLES[latin])))), ""))

    longer = F.floor(attempt / 2).cast("int")
    names = {f"family{_SCRIPT[x]}": syllables(x, longer + 4) for x in SYLLABLES}
    for (gender, latin), known in NAMES.items():
        ending = ("a" if latin else "а") if gender == "woman" else ""
        names[f"{gender}{_SCRIPT[latin]}"] = F.when(attempt < 2, _pick(known, n(9, 16))).otherwise(F.concat(syllables(latin, longer + 1), F.lit(ending)))
    cases = {"email": email, "phone": phone, "card": card, "ip": ip, "access": access, "hex": _shape(entity, noise, "abcdef"), "iban": iban, "abroad": phone, "number": card}
    whole = reduce(lambda rest, k: F.when(kind == k, cases[k]).otherwise(rest), cases, _shape(entity, noise))
    whole = F.when(attempt < WIDEN, whole).otherwise(F.concat(whole, F.substring(noise, 1, 8)))
    return reduce(lambda rest, k: F.when(kind == k, names[k]).otherwise(rest), names, whole)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, entity and its surrogate for each distinct entity (kind, entity).

    A surrogate that another entity has got, or that is itself an entity of the table, is drawn anew.
    """
    todo, settled = entities.withColumn("attempt", F.lit(0)), None
    pair = ["kind", "entity"]
    while True:
        drawn = materialize(todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)))
        first = drawn.groupBy("surrogate").agg(F.min(F.struct(*pair)).alias("_f")).select("surrogate", "_f.*")
        ok = drawn.join(first, ["surrogate", *pair], "left_semi").join(entities.select(F.col("entity").alias("surrogate")), "surrogate", "left_anti")
        if settled is not None:
            ok = ok.join(settled.select("surrogate"), "surrogate", "left_anti")
        ok = materialize(ok.select(*pair, "surrogate", "attempt"))
        settled = ok if settled is None else settled.unionByName(ok)
        todo = drawn.join(ok.select(*pair), pair, "left_anti").select(*pair, (F.col("attempt") + 1).alias("attempt"))
        todo = materialize(todo)
        if todo.isEmpty():
            return settled.select(*pair, "surrogate")


def _plain(name: Column) -> Column:
    """A name in capitals throughout as one that begins with a capital."""
    return F.when(name == F.upper(name), F.initcap(F.lower(name))).otherwise(name)


def name_parts(names: DataFrame) -> DataFrame:
    """names (kind, entity) with their title and what follows it, and kind and text of family and first name (null: none)."""
    rest = F.regexp_replace("entity", r"^\S+\s+", "")
    parts = F.split(rest, " ")
    typed = lambda stem, part: F.concat(stem, F.when(part.rlike(CYRILLIC), _SCRIPT[False]).otherwise(_SCRIPT[True]))
    rows = names.select("kind", "entity", F.regexp_extract("entity", r"^\S+\s+", 0).alias("title"), F.element_at(parts, -1).alias("_family"), F.when(F.size(parts) > 1, parts[0]).alias("_first"))
    rows = rows.withColumn("family", _plain(F.col("_family"))).withColumn("first", _plain(F.col("_first")))
    return rows.withColumn("family_kind", typed(F.lit("family"), F.col("family"))).withColumn("first_kind", typed(F.col("kind"), F.col("first")))


def _core(entity: Column) -> Column:
    """An entity's letters, digits and plus sign."""
    return F.regexp_replace(entity, r"[^A-Za-z0-9+]", "")


def _laid_out(core: Column, entity: Column) -> Column:
    """The characters of core in the places of the entity's own, with what stands between them there."""
    place = lambda i: F.length(_core(F.substring(entity, F.lit(1), i)))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(r"[A-Za-z0-9+]"), F.substring(core, place(i) + 1, F.lit(1))).otherwise(c)), "")


def replacements(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entity and surrogate for each distinct entity (kind, entity).

    Families and first names are settled by themselves, each distinct, and names are put together from them: a family has
    one surrogate with every title and first name, which no other family has, and so different names stay different. Of
    LOOSE types what makes the entity is settled by itself too, and laid out as the entity is.
    """
    is_name, loose = F.col("kind").isin(*PEOPLE), F.col("kind").isin(*LOOSE)
    named = name_parts(entities.where(is_name))
    parts = named.select(F.explode(F.array(F.struct(F.col("family_kind").alias("kind"), F.col("family").alias("entity")), F.struct(F.col("first_kind").alias("kind"), F.col("first").alias("entity")))).alias("x"))
    parts = parts.select("x.*").where("entity is not null").distinct()
    cores = entities.where(loose).select("kind", _core(F.col("entity")).alias("entity")).distinct()
    settled = surrogates(materialize(entities.where(~is_name & ~loose).unionByName(cores).unionByName(parts)), key)
    side = lambda k: settled.select(F.col("kind").alias(f"{k}_kind"), F.col("entity").alias(k), F.col("surrogate").alias(f"new_{k}"))
    whole = hot_join(materialize(named), side("family"), "family", "family_kind").join(side("first"), ["first", "first_kind"], "left")
    as_was = lambda k: F.when(F.col(f"_{k}") == F.upper(f"_{k}"), F.upper(f"new_{k}")).otherwise(F.col(f"new_{k}"))
    whole = whole.select("entity", F.concat("title", F.concat_ws(" ", as_was("first"), as_was("family"))).alias("surrogate"))
    laid = entities.where(loose).select(F.col("kind").alias("core_kind"), "entity", _core(F.col("entity")).alias("core")).join(side("core"), ["core_kind", "core"])
    laid = laid.select("entity", F.concat(_laid_out(F.col("new_core"), F.col("entity")), F.substring("new_core", F.length("core") + 1, F.length("new_core"))).alias("surrogate"))
    other = settled.where(F.col("kind").isin([k for k in PATTERNS if k not in PEOPLE and k not in LOOSE]))
    return other.select("entity", "surrogate").unionByName(laid).unionByName(whole)


def replace_entities(docs: DataFrame, columns: list[str] | None = None, key: str = KEY) -> DataFrame:
    """The rows of docs (doc_id, text), with the named columns, their texts' entities replaced, and n_replaced.

    Names stand after a title, in capitals or not; they have inner capitals, hyphens and apostrophes, and a second word that is
    no common first word of a sentence. Texts without an entity, empty and null ones stay as they are. Entities match where no longer one has begun before;
    of types that begin at one place the first in PATTERNS counts. Rows that repeat a doc_id are treated alike. No rows: no
    rows.
    """
    cols = columns or ["doc_id", "text"]
    rest = [c for c in cols if c != "text"]
    base = keyed(docs, *cols)
    sign = reduce(lambda a, x: a | F.col("text").contains(x), SIGNS, F.col("text").rlike("[0-9@]"))
    has = F.coalesce(F.when(sign, F.col("text").rlike(ANY)), F.lit(False))
    hits = materialize(base.where(has).select("_rid", *rest, F.split("text", ANY).alias("_pieces"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("_found")))
    spots = hits.select("_rid", F.posexplode("_found").alias("at", "entity"))
    entities = materialize(spots.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select(kind_of(F.col("entity")).alias("kind"), "entity"))
    real = (F.col("kind") != LUHN) | (_checked(F.col("entity")) == F.col("entity"))
    known = replacements(entities.where(real), key).unionByName(entities.where(~real).select("entity", F.col("entity").alias("surrogate")))
    # an entity may stand in any share of the rows
    filled = hot_join(materialize(spots), known, "entity").groupBy("_rid").agg(F.collect_list(F.struct("at", "surrogate")).alias("_new"), F.count_if(F.col("surrogate") != F.col("entity")).alias("_n"))
    new = F.transform(F.sort_array("_new"), lambda x: x["surrogate"])
    text = F.array_join(F.zip_with("_pieces", new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = hits.join(filled, "_rid").select(*rest, text.alias("text"), F.col("_n").alias("n_replaced"))
    same = base.where(~has).select(*rest, "text", F.lit(0).cast("long").alias("n_replaced"))
    return same.unionByName(done).select(*cols, "n_replaced")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
