"""Personal data by surrogates.

Detected entities are brought to a canonical form, so that mentions of one entity in different formats or
documents are one row of the entity table. A keyed digest (HMAC) draws a surrogate of the same kind for each:
digits for digits, letters of the same script and case for letters, gendered first names by title, valid check
digits for valid check digits. Surrogates are checked: one that two entities share, or that is itself an
entity of the corpus, is drawn again with the next attempt; once LONGER attempts have failed, its format is taken
to be too full, and further draws are longer, so drawing ends. Each mention then gets its entity's surrogate in the
mention's own format.

Names are found after titles. First names and surnames are entities of their own, so Dr. Smith, Mr J. Smith and
Mrs Anna Smith share a surname afterwards too, and where a document has a titled name, its bare mentions of the
same first name or surname are replaced with it.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import row_key, written

#: The session's setting for the key; its name is one that Spark redacts.
KEY_SETTING = "planeflow.pii.secret"
LONGER = 8

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
TITLES = (*MALE, *FEMALE, "Dr", "Prof")
_MALE, _FEMALE, _TITLE = "|".join(MALE), "|".join(FEMALE), "|".join(sorted(TITLES, key=lambda t: -len(t)))
_PART = r"\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{L}{2,}+|-\p{L}++)*+"
_BEFORE = r"(?:\p{Lu}\.(?=[ \p{Lu}]) ?|(?:von|vom|van|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|zu|zum|al|bin|ben) )*+"
#: Kinds in order of preference, as alternatives of one pattern. No loop gives back what it took over a group, and
#: nothing starts inside what a loop would take again, so the time is linear and the stack is bounded.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![\p{L}\p{N}_])(?:(?=[0-9a-f]{0,31}[a-f])[0-9a-f]{32,}+|(?=[0-9A-F]{0,31}[A-F])[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+)(?![\p{L}\p{N}_])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? ){{1,3}}+{_BEFORE}{_PART}(?: (?!(?:{_TITLE})\.? ){_BEFORE}{_PART})*+",
}
PATTERN = "|".join(PATTERNS.values())


def may_have(text: Column) -> Column:
    """False only where no pattern can match: cheap searches that spare most texts the patterns."""
    out = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    for mark in ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", *(f"{t}{end}" for t in TITLES for end in (" ", "."))):
        out = out | F.contains(text, F.lit(mark))
    return out | text.rlike("[a-f]{32}|[A-F]{32}")


#: Alphabets by script and case; a letter is replaced by one of its own alphabet.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâäçèéêëìíîïñòóôöùúûü",
    "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
    "абвгдежзиклмнопрстуфхцчшэюя",
    "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
MEN = "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Martin Noel Oscar Paul Robert Simon Thomas Victor".split()
WOMEN = "Alice Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split()
MEN_CYRILLIC = "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён".split()
WOMEN_CYRILLIC = "Анна Белла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса".split()
SYLLABLES = "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za zo".split()
SYLLABLES_CYRILLIC = "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во за зо".split()


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return F.coalesce(out, F.lit("name"))


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    code = F.regexp_extract(mention, r"^\+([0-9]{1,3})[^0-9]", 1)
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit(" "), digits.substr(F.length(code) + 1, F.length(digits)))).otherwise(digits)
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(mention)
    )


def name_parts(mention: Column) -> Column:
    """(kind, token) of a titled name's parts: the last one is a surname, those before are first names of the
    title's gender; initials and particles are none."""
    gender = F.when(mention.rlike(rf"^(?:{_MALE})\.? "), "m").when(mention.rlike(rf"^(?:{_FEMALE})\.? "), "f").otherwise("n")
    body = F.split(F.regexp_replace(mention, rf"^(?:(?:{_TITLE})\.? )+", ""), " ")
    tokens = F.filter(F.transform(body, lambda x: F.regexp_replace(x, r"^(?:\p{Lu}\.)+", "")), lambda x: x.rlike(r"^\p{Lu}"))
    return F.transform(tokens, lambda x, i: F.struct(F.when(i == F.size(tokens) - 1, F.lit("surname")).otherwise(F.concat(F.lit("first:"), gender)).alias("kind"), x.alias("token")))


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256, in hexadecimal digits."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    inner, outer = (F.lit(bytes(x ^ pad for x in raw.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _draw(stream: Column, i: Column, n) -> Column:
    """The i-th number below n of a stream of hexadecimal digits, four of them for each number."""
    block = F.sha2(F.concat(stream, F.lit("/"), F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substr(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n


def _letters(value: Column, stream: Column, alphabets=ALPHABETS) -> Column:
    """Each character by a drawn one of its own alphabet; others stay."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for alphabet in reversed(alphabets):
            out = F.when(F.instr(F.lit(alphabet), c) > 0, F.substr(F.lit(alphabet), _draw(stream, i, len(alphabet)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_digit(body: Column) -> Column:
    """The check digit that completes body."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), weigh), F.lit(0), lambda s, x: s + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _pick(stream: Column, i: int, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _draw(stream, F.lit(i), len(words)) + 1)


def surrogate(kind: Column, value: Column, stream: Column, attempt: int = 0) -> Column:
    """The canonical surrogate of a canonical value, out of a stream of keyed digits."""
    more = max(0, attempt - LONGER)
    numeric, at_front = F.concat(value, F.lit("0" * more)), F.concat(F.lit("a" * more), value)
    ending = F.regexp_extract(value, r"(\.[^.]+)$", 1)
    email = F.concat(_letters(F.substr(at_front, F.lit(1), F.length(at_front) - F.length(ending)), stream), ending)
    country = F.regexp_extract(value, r"^(\+[0-9]+ )", 1)
    phone = F.concat(country, _letters(F.substr(numeric, F.length(country) + 1), stream))
    number = _letters(numeric, stream)
    body, old = F.substr(number, F.lit(1), F.length(number) - 1), F.substr(value, F.lit(1), F.length(value) - 1)
    valid = luhn_digit(old) == F.substr(value, F.length(value))
    card = F.when(valid, F.concat(body, luhn_digit(body))).otherwise(number)
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (_draw(stream, i, 254) + 1).cast("string")), ".")
    prefix = F.regexp_extract(value, r"^(AKIA|gh[pousr]_|sk-|[A-Z]{2}(?=[0-9]{2}))", 1)
    code = F.concat(prefix, _letters(F.substr(numeric, F.length(prefix) + 1), stream))
    low, high = "0123456789abcdef", "0123456789ABCDEF"
    hexa = F.when(value.rlike("^[0-9a-f]+$"), _letters(numeric, stream, (low,))).otherwise(_letters(numeric, stream, (high,)))
    secret = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hexa).otherwise(code)

    def made(syllables, first: int, n: int):
        return F.concat(*(_pick(stream, first + i, syllables) for i in range(n)))

    def first_name(men, women, syllables, endings):
        man = F.when(kind == "first:m", True).when(kind == "first:f", False).otherwise(_draw(stream, F.lit(0), 2) == 0)
        if attempt < 2:
            return F.lower(F.when(man, _pick(stream, 1, men)).otherwise(_pick(stream, 1, women)))
        return F.concat(made(syllables, 1, attempt), F.when(man, F.lit(endings[0])).otherwise(F.lit(endings[1])))

    cyrillic = value.rlike(r"\p{IsCyrillic}")
    given = F.when(cyrillic, first_name(MEN_CYRILLIC, WOMEN_CYRILLIC, SYLLABLES_CYRILLIC, "ня")).otherwise(first_name(MEN, WOMEN, SYLLABLES, "na"))
    size = 3 + (attempt + 1) // 2
    surname = F.when(cyrillic, made(SYLLABLES_CYRILLIC, 0, size)).otherwise(made(SYLLABLES, 0, size))
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", number)
    return out.when(kind == "ip", octets).when(kind == "iban", code).when(kind == "surname", surname).when(kind.startswith("first:"), given).otherwise(secret)


def rendered(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogate in the mention's format: its separators and its capitals; what is longer goes to the end."""
    symbols = F.regexp_replace(new, r"[^\p{L}\p{N}]", "")
    fill = F.aggregate(
        F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(symbols, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i")),
        lambda s: F.concat(s["out"], F.substr(symbols, s["i"])),
    )
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    email = F.when(upper, F.upper(new)).otherwise(new)
    name = F.when(upper & (F.length(mention) > 1), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), fill).when(kind == "email", email).when((kind == "surname") | kind.startswith("first:"), name).otherwise(new)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two entities of a kind share a surrogate, and
    none is an entity itself. Of those that clash the least value keeps its draw; the others draw again, and
    longer ones after LONGER attempts."""
    entities = written(entities, "entities")
    done, left, attempt = None, entities, 0
    while not left.isEmpty():
        drawn = left.withColumn("stream", keyed(key, F.concat_ws("/", "kind", F.lit(str(attempt)), "value")))
        drawn = written(drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("stream"), attempt)).drop("stream"), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = first.join(entities.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = written(good.select("kind", "value", "surrogate"), "accepted")
        done = good if done is None else done.unionByName(good)
        left = written(left.join(good.select("kind", "value"), ["kind", "value"], "left_anti"), "clashes")
        attempt += 1
    return done if done is not None else entities.withColumn("surrogate", F.col("value"))


def session_key(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one, which then holds for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _filled(text: Column, pattern, news: Column) -> Column:
    """text with the i-th match of pattern replaced by the i-th of news."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(news, i), F.lit("")))), "")


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per input row: id, text with surrogates, entities (array of kinds, in order), null text staying null.

    Texts without an entity are returned unchanged. Rows that repeat an identifier and a text get equal
    results; null identifiers are allowed; no rows give no rows; a text of any length takes linear time. The same
    key gives the same surrogates for the same entity table; without one the session's is taken. In a document
    with a titled name, all mentions of its first names and surname as whole words are replaced, titled or not.
    Initials become another letter, and particles stay."""
    spark = docs.sparkSession
    key = key or session_key(spark)
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    maybe = F.coalesce(may_have(F.col("text")), F.lit(False))
    none = F.array().cast("array<string>")
    clean = rows.filter(~maybe).select("id", "text", none.alias("entities"))
    read = written(rows.filter(maybe).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))), "mentions")
    clean = clean.unionByName(read.filter("size(found) = 0").select("id", "text", none.alias("entities")))
    dirty = read.filter("size(found) > 0")
    each = dirty.select("_id", "_h", "found").dropDuplicates(["_id", "_h"]).select("_id", "_h", F.posexplode("found").alias("i", "mention")).withColumn("kind", kind_of(F.col("mention")))
    each = written(each.withColumn("value", canonical(F.col("kind"), F.col("mention"))), "values")
    plain, named = each.filter("kind <> 'name'"), each.filter("kind = 'name'")
    parts = named.select("_id", "_h", F.explode(name_parts(F.col("mention"))).alias("x")).select("_id", "_h", "x.*").withColumn("value", F.lower("token"))
    parts = written(parts, "name-parts")
    table = written(surrogates(plain.select("kind", "value").unionByName(parts.select("kind", "value")).distinct(), key), "surrogates")
    new = plain.join(table, ["kind", "value"]).select("_id", "_h", F.struct("i", "kind", rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new")).alias("x"))
    letter = _letters(F.regexp_extract("mention", r"(?<!\p{L})(\p{Lu})\.", 1), keyed(key, F.col("mention")))
    initials = F.regexp_replace("mention", r"(?<!\p{L})\p{Lu}\.", F.concat(letter, F.lit(".")))
    kept = F.when(F.col("mention").rlike(r"(?<!\p{L})\p{Lu}\."), initials).otherwise(F.col("mention"))
    new = new.unionByName(named.select("_id", "_h", F.struct("i", "kind", kept.alias("new")).alias("x")))
    by_row = new.groupBy("_id", "_h").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # one surrogate a word in a document: a surname's before a first name's, a gendered one's before another
    known = parts.join(table, ["kind", "value"]).withColumn("new", rendered(F.col("kind"), F.col("token"), F.col("surrogate")))
    known = known.groupBy("_id", "_h", "token").agg(F.max(F.struct(F.expr("case kind when 'surname' then 2 when 'first:n' then 0 else 1 end").alias("rank"), "new"))["new"].alias("new"))
    known = known.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("token", "new"))).alias("names"))
    both = dirty.join(by_row, ["_id", "_h"]).join(known, ["_id", "_h"], "left")
    both = both.withColumn("text", _filled(F.col("text"), F.lit(PATTERN), F.transform("xs", lambda x: x["new"])))
    words = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:\Q"), F.array_join(F.reverse(F.array_sort(F.map_keys("names"))), r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}])"))
    both = both.withColumn("words", words)
    hits = F.transform(F.regexp_extract_all("text", F.col("words"), F.lit(0)), lambda w: F.element_at("names", w))
    text = F.when(F.col("names").isNull(), F.col("text")).otherwise(_filled(F.col("text"), F.col("words"), hits))
    return clean.unionByName(both.select("id", text.alias("text"), F.expr("transform(xs, x -> x.kind)").alias("entities")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
