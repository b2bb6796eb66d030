"""PII: detected entities receive keyed surrogates of the same type, gender, script and format.

Main path: DataFrame functions only.  Every surrogate is computed from the entity and a secret key by a
Feistel network over the characters of its format: a letter stays a letter of its script and
case, a vowel a vowel, a digit a digit, punctuation stays.  A Feistel network is a permutation of the
strings of one format, so distinct entities get distinct surrogates, and one entity gets the same
surrogate wherever it occurs (coreference) without a table of all entities.  Given names move
within a list of their gender and script, by an offset keyed by the new surname and never 0.  Card numbers keep the
state of their check digit, IBANs their country and the state of theirs, and known access tokens their prefix: a valid
number stays valid, and a permutation of the rest with the distance from the right check digit is still one.
``distinct_ok`` is the check of distinctness within each document, ``collisions`` the one over a whole corpus.

Patterns repeat single characters or a bounded number of groups only, so that neither the matcher's stack nor its time
grows beyond the text's length.

Defined results: a null text stays null and has no entities; an empty text stays empty; repeated
rows get equal results; other columns pass through unless named like an output; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Given names by gender and script (fixed values).
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan James John Karl Louis Marco Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Berta Clara Diana Emma Flora Greta Helen Irene Jane Katja Laura Maria Nina Olga Paula Rosa Sarah Teresa Ursula Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Григорий Дмитрий Иван Кирилл Михаил Николай Олег Павел Сергей".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария Наталья Ольга Полина Светлана".split(),
    ("m", "greek"): "Αντώνης Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
}
#: Further given names that announce an untitled name; their surrogates come from the letters.
MORE = ("Aaron Abigail Adrian Alan Albert Alejandro Alexander Alexandra Amanda Amelia Amy Andrea Andreas Andrew Angela Anita Anna Anne Annette Anthony Antoine Antonio Arthur Barbara Benjamin Bernard Betty "
        "Brandon Brenda Brian Camille Carlos Carmen Carol Caroline Catherine Charles Charlotte Christina Christine Christopher Claire Claudia Cynthia Daniel Daniela Deborah Dennis Diego Dominik Donald Dorothy "
        "Edward Elena Elisabeth Elizabeth Emily Emmanuel Eric Esther Eva Fernando Florian Francisco Frank Franz Frederick Gabriel Gary George Gerald Gloria Gregory Hans Harold Heather Heinrich Helmut Henri Henry Ingrid Isabel Isabelle "
        "Jacob Jacqueline Jacques Jason Javier Jean Jeffrey Jennifer Jeremy Jessica Joachim Jonathan Jorge Jose José Joseph Joshua Juan Judith Julia Julie Justin Karen Katharina Katherine Kathleen Kenneth Kevin Kimberly Klaus Larry Laurent Linda Lisa Lucas Lucia "
        "Luis Lukas Manuel Margaret Marie Martin Martha Mary Matthew Matthias Melissa Michael Michel Michelle Miguel Monica Nancy Nathalie Nathan Nicholas Nicole Olivia Pablo Pamela Patricia Patrick Pedro Peter Petra Philip Philippe Pierre "
        "Rachel Ralph Raymond Rebecca Richard Roger Ronald Ruth Ryan Samantha Samuel Sandra Scott Sebastian Sharon Sofia Sophia Sophie Stefan Stephanie Stephen Steven Susan Susanne Sylvie Theresa Timothy Ulrich Veronica Victoria Walter William Wolfgang Zoe").split()
#: Titles that announce a name, by gender (fixed values).
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Госпожа", "Κυρία"],
}
#: Alphabets within which a character moves.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâäáãåèéêëìíîïòóôöõùúûü", "ÀÂÄÁÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "çñßšžý",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αειουωη", "βγδζθκλμνξπρστφχψς", "ΑΕΙΟΥΩΗ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέίόύώή",
]
HEX = ["0123456789abcdef"]
#: With upper-case letters, a digit stays a digit and a letter its case.
CASED = ["0123456789", "abcdef", "ABCDEF"]

_NAME = r"\p{Lu}[\p{L}'’]{0,60}\p{L}"
_TITLE = "|".join(t for g in ("m", "f") for t in sorted(TITLES[g], key=len, reverse=True))
_LISTED = "|".join(n for names in [*GIVEN.values(), MORE] for n in names)
#: Phrases after which two capitalised words are a name (fixed values).
CUES = ("name is", "named", "signed by", "written by", "Dear", "Sincerely,", "Regards,")
#: Prefixes of access tokens and what follows them (fixed values).
TOKENS = ("sk_live_", "[0-9A-Za-z]{16,}+"), ("sk_test_", "[0-9A-Za-z]{16,}+"), ("AKIA", "[0-9A-Z]{16}"), ("ghp_", "[0-9A-Za-z]{30,}+"), ("xoxb-", r"[0-9A-Za-z\-]{16,}+"), ("AIza", r"[0-9A-Za-z_\-]{35}")
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FIRST = rf"(?!(?:{_TITLE})(?!\p{{L}})){_NAME}"  # a title is no name
#: Entity patterns in the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}+",
    "token": _EDGE + "(?:" + "|".join(a + b for a, b in TOKENS) + ")" + _END,
    "secret": _EDGE + "[0-9a-f]{32,}+" + _END,
    "hex": _EDGE + "[0-9A-Fa-f]{32,}+" + _END,
    "ip6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}]|\.[0-9])",
    "phone": r"(?<![\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])",
    "card": _EDGE + r"[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}" + _END,
    "iban": _EDGE + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "name": rf"(?:(?=[\p{{Lu}}г])(?<!\p{{L}})(?=\p{{L}}[\p{{L}}\-]{{0,40}}\.? \p{{Lu}})(?:(?:{_TITLE})\.? {_FIRST}(?: {_FIRST})?|(?:{_LISTED}) {_FIRST})|(?<=(?:{'|'.join(CUES)}) ){_FIRST} {_FIRST})(?!\p{{L}})",
}
ALL = "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _draw(seed: Column, i: Column) -> Column:
    """A number from a keyed digest; each block of twelve characters has a digest of its own."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 12).cast("string")), 256)
    return F.conv(F.substr(block, F.pmod(i, F.lit(12)) * 5 + 1, F.lit(5)), 16, 10).cast("long")


def _number(*parts: Column) -> Column:
    return F.conv(F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _shift(c: Column, n: Column, classes: list[str]) -> Column:
    """Character c moved n places round its class; characters of no class stay."""
    out = c
    for k in classes:
        at = F.position(c, F.lit(k))
        out = F.when(at > 0, F.substr(F.lit(k), ((at - 1 + n) % len(k) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _round(key: str, r: int):
    """One Feistel round of both parts and of the address halves: one half moves by a digest of the other."""

    def part(s: Column, i: int) -> tuple[Column, Column]:
        still, moves = (s[f"x{i}"], s[f"y{i}"]) if r % 2 == 0 else (s[f"y{i}"], s[f"x{i}"])
        seed = F.concat_ws("|", F.lit(f"{key}|{r}|{i}"), s["k"], F.length(moves).cast("string"), still)
        chars = F.filter(F.split(moves, ""), lambda c: c != "")
        new = F.array_join(F.transform(chars, lambda c, j: F.when(s["k"] == "secret", _shift(c, _draw(seed, j), HEX)).when(s["k"].isin("hex", "ip6"), _shift(c, _draw(seed, j), CASED)).otherwise(_shift(c, _draw(seed, j), CLASSES))), "")
        return (still, new) if r % 2 == 0 else (new, still)

    def step(s: Column) -> Column:
        (x1, y1), (x2, y2) = part(s, 1), part(s, 2)
        moved = F.pmod(s["n1"] + _number(F.lit(f"{key}|{r}|ip"), s["n2"].cast("string")), F.lit(65536))
        return F.struct(*[s[c].alias(c) for c in ("k", "head", "mid", "tail", "given", "gender")], x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), s["n2"].alias("n1"), moved.alias("n2"))

    return step


def _luhn(text: Column) -> Column:
    """The check digit behind the digits of a text."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(text, "[^0-9]", "")), ""), lambda c: c != "")
    twice = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("long"))
    return F.pmod(-F.aggregate(twice, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(10))


def _mod97(account: Column, country: Column) -> Column:
    """The check digits of an IBAN, as a number."""
    chars = F.filter(F.split(F.regexp_replace(F.concat(account, country, F.lit("00")), " ", ""), ""), lambda c: c != "")
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return 98 - F.aggregate(chars, F.lit(0).cast("long"), lambda t, c: ((t * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("long"))


def kind_of(entity: Column) -> Column:
    """The kind of a whole entity; a name by a cue is known by being nothing else."""
    out = F.lit("name")
    for k, p in list(PATTERNS.items())[-2::-1]:
        out = F.when(entity.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def _parts(s: Column) -> Column:
    """An entity cut into two parts that move and the text round them that stays; for numbers with check digits, ``tail`` has their distance from the right ones."""
    e, k = s["e"], s["k"]
    domain = F.substring_index(e, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    title = F.when(k == "name", F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)).otherwise("")
    prefix = F.regexp_extract(e, "^(" + "|".join(a for a, _ in TOKENS) + ")", 1)
    rest = F.substr(e, F.length(title) + 1, F.length(e))
    two = (k == "name") & (F.instr(rest, " ") > 0)
    octet = lambda i: F.coalesce(F.get(F.split(e, r"\."), F.lit(i)).try_cast("long"), F.lit(0)).cast("long")
    body = F.substr(e, F.lit(1), F.length(e) - 1)
    country, account = F.substr(e, F.lit(1), F.lit(2)), F.substr(e, F.lit(5), F.length(e))
    first = (F.when(k == "email", F.substring_index(e, "@", 1)).when(k == "name", F.when(two, F.substring_index(rest, " ", 1)).otherwise(""))
             .when(k == "token", F.substr(e, F.length(prefix) + 1, F.length(e))).when(k == "card", body).when(k == "iban", account).otherwise(e))
    second = F.when(k == "email", F.substr(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)).when(k == "name", F.substring_index(rest, " ", -1)).otherwise("")
    off = (F.when(k == "card", F.pmod(F.substr(e, F.length(e), F.lit(1)).try_cast("long") - _luhn(body), F.lit(10)))
           .when(k == "iban", F.pmod(F.substr(e, F.lit(3), F.lit(2)).try_cast("long") - _mod97(account, country), F.lit(100))))
    bare = F.regexp_replace(title, r"\.? $", "")
    return F.struct(
        k.alias("k"), F.when(k == "token", prefix).when(k == "iban", country).otherwise(title).alias("head"), F.when(k == "email", "@").when(two, " ").otherwise("").alias("mid"),
        F.when(k == "email", F.concat(F.lit("."), tld)).otherwise(F.coalesce(off.cast("string"), F.lit(""))).alias("tail"),
        F.when(k == "name", first).otherwise("").alias("given"),
        F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise("").alias("gender"),
        first.alias("p1"), second.alias("p2"), (octet(0) * 256 + octet(1)).alias("n1"), (octet(2) * 256 + octet(3)).alias("n2"))


def _halves(s: Column) -> Column:
    cut = lambda p: (F.length(s[p]) / 2).cast("int")
    out = [s[c].alias(c) for c in ("k", "head", "mid", "tail", "given", "gender")]
    for i in (1, 2):
        out += [F.substr(s[f"p{i}"], F.lit(1), cut(f"p{i}")).alias(f"x{i}"), F.substr(s[f"p{i}"], cut(f"p{i}") + 1, F.length(s[f"p{i}"])).alias(f"y{i}")]
    return F.struct(*out, s["n1"].alias("n1"), s["n2"].alias("n2"))


def _joined(key: str):
    """The surrogate from its moved parts.  A listed given name moves within its list by an offset keyed by the new surname."""

    def build(s: Column) -> Column:
        p1, p2 = F.concat(s["x1"], s["y1"]), F.concat(s["x2"], s["y2"])
        first = p1
        for (g, script), names in GIVEN.items():
            arr = F.array(*map(F.lit, names))
            at = F.array_position(arr, s["given"])
            to = (at + F.pmod(_number(F.lit(f"{key}|given|{script}"), p2), F.lit(len(names) - 1))) % len(names)  # never the name itself
            first = F.when((at > 0) & s["gender"].isin(g, ""), F.get(arr, to.cast("int"))).otherwise(first)
        ip = F.concat_ws(".", *[x.cast("long").cast("string") for n in ("n1", "n2") for x in (F.floor(s[n] / 256), s[n] % 256)])
        card = F.concat(p1, ((_luhn(p1) + s["tail"].try_cast("long")) % 10).cast("string"))
        iban = F.concat(s["head"], F.lpad(((_mod97(p1, s["head"]) + s["tail"].try_cast("long")) % 100).cast("string"), 2, "0"), p1)
        return F.when(s["k"] == "ip", ip).when(s["k"] == "card", card).when(s["k"] == "iban", iban).otherwise(F.concat(s["head"], F.when(s["k"] == "name", first).otherwise(p1), s["mid"], p2, s["tail"]))

    return build


def with_surrogates(df: DataFrame, ents: str, out: str, key: str) -> DataFrame:
    """Adds ``out``: the surrogates of the entity array ``ents``, one projection for each round."""
    df = df.withColumn(out, F.transform(ents, lambda e: F.struct(e.alias("e"), kind_of(e).alias("k"))))
    for step in (_parts, _halves, *[_round(key, r) for r in range(4)], _joined(key)):
        df = df.withColumn(out, F.transform(out, step))
    return df


def secret_key(spark) -> str:
    """The session's key, spark.lodestar.pii.key; where that is unset a fixed one, so that runs can be compared."""
    return spark.conf.get("spark.lodestar.pii.key", None) or "only for comparing runs"


def entities(docs: DataFrame) -> Column:
    """The entities of a text in order; texts without a digit, an @, the start of a token or a name are not searched by all patterns."""
    sign = "[0-9@:]|[A-Fa-f]{32}|" + "|".join(a for a, _ in TOKENS)
    some = F.col("text").rlike(sign) | F.col("text").rlike(PATTERNS["name"])
    return F.when(some, F.regexp_extract_all("text", F.lit(f"({ALL})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns with the text replaced, n_entities, and distinct_ok: as many distinct surrogates as entities."""
    if not key:
        raise ValueError("a secret key is needed: with a known one the surrogates can be turned back")
    keep = [c for c in docs.columns if c not in ("n_entities", "distinct_ok", "_ents", "_subs")]
    found = docs.select(*keep, entities(docs).alias("_ents"))
    found = with_surrogates(found, "_ents", "_subs", key)
    gaps = F.split("text", ALL, -1)
    text = F.when(F.size("_ents") > 0, F.array_join(F.zip_with(gaps, F.col("_subs"), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep],
                        F.coalesce(F.size("_ents"), F.lit(0)).cast("long").alias("n_entities"),
                        (F.size(F.array_distinct("_ents")) == F.size(F.array_distinct("_subs"))).alias("distinct_ok"))


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Surrogates that two distinct entities of the corpus share: none, unless the permutation is broken."""
    ents = docs.where(F.col("text").isNotNull()).select(F.explode(entities(docs)).alias("entity")).distinct()
    return with_surrogates(ents.select(F.array("entity").alias("e")), "e", "s", key).select(F.col("s")[0].alias("surrogate")).groupBy("surrogate").agg(F.count("*").alias("n")).where("n > 1")
